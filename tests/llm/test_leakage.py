"""Leaked items against a plain comparison of all spans."""

import random

import numpy as np

from codeloom.llm import leakage


def brute(docs, items):
    out = set()
    for d, text in docs:
        w = leakage.words(text or "")
        spans = {tuple(w[i : i + 15]) for i in range(len(w) - 14)}
        for i, _, t in items:
            v = leakage.words(t or "")
            if any(tuple(v[k : k + 15]) in spans for k in range(len(v) - 14)):
                out.add((d, i))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)]
    items = [(n, rng.choice(["prompt", "answer"]), " ".join(rng.choice(vocab) for _ in range(rng.randint(10, 60)))) for n in range(40)]
    items += [(99, "answer", items[0][2]), (100, "answer", None)]
    docs = []
    for d in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 200))]
        if rng.random() < 0.6:
            own = leakage.words(rng.choice(items[:40])[2])
            k, s = rng.randint(10, 20), rng.randint(0, 10)
            at = rng.randint(0, len(w))
            w[at:at] = own[s : s + k]
        mark = rng.choice([" ", ", ", "\n> ", " - ", "\t"])
        docs.append((d, mark.join(x.upper() if rng.random() < 0.2 else x for x in w)))
    return docs + [(500, None), (501, ""), (502, "x " * 50_000 + items[3][2] + " y" * 50_000)], items


def test_like_brute_force(spark):
    docs, items = corpus(1)
    d = spark.createDataFrame(docs + docs[:3], "doc_id long, text string").selectExpr("*", "'clash' as kind", "1 as item_id")
    i = spark.createDataFrame(items + items[:2], "item_id long, kind string, text string")
    whole = leakage.leaked_items(d, i).collect()
    got = {(r["doc_id"], r["item_id"]) for r in whole}
    assert got == brute(docs, items) and len(whole) == len(got) and len(got) > 30
    assert all(r["score"] >= 1 - 1e-3 and r["n_spans"] >= 1 and 0 < r["overlap"] <= 1 for r in whole)
    assert all(r["overlap"] == 1 for r in whole if r["doc_id"] == 502 and r["item_id"] == 3)
    blocks = {(r["doc_id"], r["item_id"]) for r in leakage.leaked_items(d, i, most_bytes=40_000).collect()}
    assert blocks == got


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "prompt", "a b c")], "item_id long, kind string, text string")
    assert leakage.leaked_items(docs, items).count() == 0 and leakage.leaked_items(docs, items.limit(0)).count() == 0


def test_every_span_scores_one():
    docs, items = corpus(3)
    index = leakage.build_index([x for x in items if x[2]])
    for begin, owner in zip(index["span_at"].tolist(), index["owners"].tolist()):
        terms = np.unique(index["words"][begin : begin + 15])
        row = np.full((1, 30), len(index["term"]))
        row[0, : len(terms)] = terms
        _, found, score = leakage._scored(index, row)
        assert owner in found.tolist() and score.min() >= 1 - 1e-4


def test_block_maxima():
    _, items = corpus(4)
    index = leakage.build_index([x for x in items if x[2]])
    for t in range(len(index["term"])):
        low, high = index["posting_at"][t : t + 2]
        most = {}
        for item, impact in zip(index["posting_item"][low:high], index["posting_impact"][low:high]):
            most[item // leakage.BLOCK] = max(most.get(item // leakage.BLOCK, 0), impact)
        low, high = index["block_at"][t : t + 2]
        assert dict(zip(index["block"][low:high], index["block_max"][low:high])) == most


def test_many_items_fit():
    """20,000 items of 60 words over a large vocabulary: far below the bound, and found like by brute force."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(50_000)]
    items = [(n, "prompt", " ".join(vocab[int(len(vocab) * rng.random() ** 3)] for _ in range(60))) for n in range(20_000)]
    index = leakage.build_index(items)
    chars = sum(len(t) for _, _, t in items)
    assert leakage.index_bytes(index) <= min(leakage.BYTES_A_CHAR * chars, leakage.INDEX_BYTES)
    docs = [(n, " ".join(rng.choice(vocab) for _ in range(40)) + " " + " ".join(leakage.words(items[n * 7][2])[5 : 19 + n % 2])) for n in range(60)]
    got = {(d, j) for d, j, *_ in leakage.search(index, docs)}
    assert got == {(n, n * 7) for n in range(1, 60, 2)}
