"""Evaluation texts inside training text (problem 7).

Method: a BM25 inverted index of the test items: of each term its postings (item, impact), and of each term and
block of items the largest impact. Every passage of every document is a query. The maxima of its terms bound its
score in each block (the block-max test of WAND, done for many passages at once); postings are read only for blocks
that can reach the threshold, all items at or above it are kept, and verified word by word.

The threshold loses nothing: an item's impacts are divided by the least score that any of its spans of
MIN_WORDS words can have, so a passage that holds such a span scores 1 or more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 15
#: A passage has 2 * MIN_WORDS words, the next begins MIN_WORDS + 1 later: each span of MIN_WORDS lies in one.
PASSAGE, STRIDE = 2 * MIN_WORDS, MIN_WORDS + 1
K1, B = 1.2, 0.75
BLOCK = 16
#: The largest index that is sent to the executors, in bytes, and what a character of an item's text takes of it at most.
INDEX_BYTES, BYTES_A_CHAR = 256 << 20, 24
#: The most entries of an array of bounds or scores.
_CELLS = 1 << 21

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Unbroken stretches of letters and digits, in lower case."""
    return _WORD.findall(text.lower())


def _pointers(sorted_ids: np.ndarray, n: int) -> np.ndarray:
    """Where each of the ids 0 to n - 1 begins in a sorted array, and its end."""
    return np.searchsorted(sorted_ids, np.arange(n + 1)).astype(np.int64)


def _expand(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, place) for all places of the ranges."""
    count = end - begin
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + begin[which]


def build_index(items: list[tuple[int, str, str]]) -> dict | None:
    """Postings, block maxima and spans of the items (item_id, kind, text) that have MIN_WORDS words or more."""
    told = [(i, k, words(t)) for i, k, t in sorted(items, key=lambda x: (x[0], x[1] or ""))]
    told = [x for x in told if len(x[2]) >= MIN_WORDS]
    if not told:
        return None
    term = {w: n for n, w in enumerate(dict.fromkeys(w for _, _, ws in told for w in ws))}
    n, v = len(told), len(term)
    texts = [np.fromiter((term[w] for w in ws), np.int32, len(ws)) for _, _, ws in told]
    counted = [np.unique(t, return_counts=True) for t in texts]
    df = np.bincount(np.concatenate([t for t, _ in counted]), minlength=v)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    mean = sum(map(len, texts)) / n
    impact_of = np.zeros(v)
    impacts = []
    for text, (terms, tf) in zip(texts, counted):
        impact = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(text) / mean))
        impact_of[terms] = impact
        windows = np.sort(np.lib.stride_tricks.sliding_window_view(text, MIN_WORDS), axis=1)
        once = np.ones(windows.shape, bool)
        once[:, 1:] = windows[:, 1:] != windows[:, :-1]
        impacts.append(impact / (impact_of[windows] * once).sum(axis=1).min())
    of_term = np.concatenate([t for t, _ in counted])
    of_item = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t, _ in counted])
    impact = np.concatenate(impacts).astype(np.float32)
    order = np.lexsort((of_item, of_term))
    of_term, of_item, impact = of_term[order], of_item[order], impact[order]
    block = of_term.astype(np.int64) * (n // BLOCK + 1) + of_item // BLOCK
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    owners, starts = _expand(np.zeros(n, np.int64), np.array([len(t) - MIN_WORDS + 1 for t in texts]))
    begins = np.cumsum([0] + [len(t) for t in texts])[:-1]
    flat = np.concatenate(texts)
    weights = np.cumprod(np.full(MIN_WORDS, 1099511628211, np.uint64))
    keys = np.concatenate([(np.lib.stride_tricks.sliding_window_view(t, MIN_WORDS).astype(np.uint64) * weights).sum(axis=1) for t in texts])
    order = np.argsort(keys, kind="stable")
    return {
        "ids": np.array([x[0] for x in told], np.int64),
        "kinds": [x[1] for x in told],
        "lengths": np.array([len(t) for t in texts], np.int32),
        "term": term,
        "posting_at": _pointers(of_term, v),
        "posting_item": of_item,
        "posting_impact": impact,
        "block_at": _pointers(of_term[first], v),
        "block": (of_item[first] // BLOCK).astype(np.int32),
        "block_max": np.maximum.reduceat(impact, first),
        "n_blocks": (n - 1) // BLOCK + 1,
        "weights": weights,
        "keys": keys[order],
        "words": flat,
        "span_at": (begins[owners] + starts)[order].astype(np.int32),
        "owners": owners[order].astype(np.int32),
    }


def index_bytes(index: dict) -> int:
    """What the index takes in memory, the vocabulary at 150 bytes a term."""
    return sum(x.nbytes for x in index.values() if isinstance(x, np.ndarray)) + 150 * len(index["term"])


def _scored(index: dict, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, score) of all items that score 1 or more for a row of different terms; unknown ones are len(term)."""
    rows, cols = np.nonzero(terms < len(index["term"]))
    t = terms[rows, cols]
    which, at = _expand(index["block_at"][t], index["block_at"][t + 1])
    n = index["n_blocks"]
    bound = np.bincount(rows[which] * n + index["block"][at], index["block_max"][at], len(terms) * n)
    near = bound >= 1 - 1e-4
    live = near.reshape(len(terms), n).any(axis=1)[rows]
    rows, t = rows[live], t[live]
    which, at = _expand(index["posting_at"][t], index["posting_at"][t + 1])
    item = index["posting_item"][at]
    kept = near[rows[which] * n + item // BLOCK]
    pair, impact, n_pairs = rows[which[kept]] * len(index["ids"]) + item[kept], index["posting_impact"][at[kept]], len(terms) * len(index["ids"])
    if n_pairs <= _CELLS:
        score = np.bincount(pair, impact, n_pairs)
        pair = np.flatnonzero(score >= 1 - 1e-4)
        score = score[pair]
    else:
        pair, place = np.unique(pair, return_inverse=True)
        score = np.bincount(place, impact, len(pair))
    top = score >= 1 - 1e-4
    return pair[top] // len(index["ids"]), pair[top] % len(index["ids"]), score[top]


def search(index: dict, docs: list[tuple[int, str]]) -> list[tuple[int, int, float, int, float]]:
    """(doc, item position, best passage score, matching spans, overlap) for the docs (any key, text).

    overlap: the share of the item's words that lie in matching spans.
    """
    term, unknown = index["term"], len(index["term"])
    rows, passages = [], []
    for key, text in docs:
        ids = np.fromiter((term.get(w, unknown) for w in _WORD.findall(text.lower())), np.int32)
        if len(ids) < MIN_WORDS:
            continue
        count = max(1, -(-(len(ids) - MIN_WORDS + 1) // STRIDE))
        padded = np.full((count - 1) * STRIDE + PASSAGE, unknown, np.int32)
        padded[: len(ids)] = ids[: len(padded)]
        view = np.lib.stride_tricks.sliding_window_view(padded, PASSAGE)[::STRIDE]
        # only passages with MIN_WORDS words in a row that some item has can hold a span
        gaps = np.concatenate([[0], np.cumsum(padded == unknown)])
        starts = np.flatnonzero(gaps[MIN_WORDS:] == gaps[:-MIN_WORDS])
        known = np.unique(starts // STRIDE)
        known = known[known < count]
        passages.append(view[known])
        rows += [key] * len(known)
    if not rows:
        return []
    found: dict[tuple[int, int], list] = {}
    all_passages = np.concatenate(passages)
    step = max(16, min(4096, _CELLS // index["n_blocks"]))
    for s in range(0, len(all_passages), step):
        part = all_passages[s : s + step]
        terms = np.sort(part, axis=1)
        terms[:, 1:][terms[:, 1:] == terms[:, :-1]] = unknown  # a term counts once
        at, item, score = _scored(index, terms)
        if not len(at):
            continue
        best = dict(zip(zip(at.tolist(), item.tolist()), score.tolist()))
        # verification: spans of the passage among the item's, word by word
        own = np.unique(at)
        spans = np.lib.stride_tricks.sliding_window_view(part[own], MIN_WORDS, axis=1)
        hashed = (spans.astype(np.uint64) * index["weights"]).sum(axis=2).ravel()
        lo, hi = (np.searchsorted(index["keys"], hashed, side) for side in ("left", "right"))
        for flat in np.flatnonzero(hi > lo):
            a, place = divmod(int(flat), spans.shape[1])
            for hit in range(lo[flat], hi[flat]):
                j, begin = int(index["owners"][hit]), int(index["span_at"][hit])
                if (int(own[a]), j) in best and (index["words"][begin : begin + MIN_WORDS] == spans[a, place]).all():
                    entry = found.setdefault((rows[s + int(own[a])], j), [0.0, 0, set()])
                    entry[0] = max(entry[0], best[int(own[a]), j])
                    entry[1] += 1
                    entry[2].update(range(begin, begin + MIN_WORDS))
    return [(key, j, score, n, len(covered) / int(index["lengths"][j])) for (key, j), (score, n, covered) in found.items()]


def leaked_items(documents: DataFrame, items: DataFrame, most_bytes: int = INDEX_BYTES) -> DataFrame:
    """(doc_id, item_id, kind, score, n_spans, overlap): documents with MIN_WORDS or more consecutive words of an item.

    ``overlap`` is the share of the question, solution or answer (see kind) that the document repeats in such spans.
    ``items`` (item_id, kind, text) are a held-out set: the index holds only their postings and words, and goes to
    every executor. If it could exceed ``most_bytes`` the items are split into as many parts as that takes, each
    searched by all documents. Documents are never moved. Null and short texts match nothing; a repeated document
    row is reported once for each item; items with equal text are all reported; empty tables give no rows.
    """
    spark = documents.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("kind").cast("string").alias("kind"), "text").where("item_id is not null and text is not null").distinct()
    n_chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_parts = max(1, -(-n_chars * BYTES_A_CHAR // most_bytes))
    schema = "doc_id long, item_id long, kind string, score double, n_spans long, overlap double"
    out = None
    for k in range(n_parts):
        chosen = items if n_parts == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_parts)) == k)
        index = build_index([tuple(r) for r in chosen.collect()])
        if index is None:
            continue
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                docs = [(d, t) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if d is not None and t]
                hits = search(index, docs)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([h[0] for h in hits], pa.int64()),
                        "item_id": pa.array([int(index["ids"][h[1]]) for h in hits], pa.int64()),
                        "kind": pa.array([index["kinds"][h[1]] for h in hits], pa.string()),
                        "score": pa.array([h[2] for h in hits], pa.float64()),
                        "n_spans": pa.array([h[3] for h in hits], pa.int64()),
                        "overlap": pa.array([h[4] for h in hits], pa.float64()),
                    }
                )

        found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.groupBy("doc_id", "item_id", "kind").agg(*[F.max(c).alias(c) for c in ("score", "n_spans", "overlap")])
