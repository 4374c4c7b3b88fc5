"""Mixing sources to target shares of all tokens (problem 8).

Method: each record of a source gets the same expected number of copies, the whole part for certain and the
fraction by pivotal dependent rounding: two records with fractional copies are paired, and token mass moves
at random from one to the other until one of them is a whole number. The records are dealt to nodes by a hash of seed
and id. Each node pairs its records in the order of that hash and passes on at most one fractional record a source;
those residuals are paired the same way up a reduction tree. The token total of a source is thus met but for the last record.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to the vocabulary above.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Children of a node of the tree, and records of a leaf on average.
FANOUT, LEAF = 16, 1 << 17
EPS = 1e-9


def source_name(source):
    """A source as it is compared: trimmed, lower case."""
    return F.lower(F.trim(source))


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) by a public byte-level BPE vocabulary; ``tokenizer`` is its file on every executor.

    Null text has 0 tokens. A text of any length is encoded whole, in pieces that the split pattern would cut
    anyway.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "source", "n_tokens"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_name(F.col("source")).alias("source"), "text")
    return rows.mapInArrow(run, "doc_id long, source string, n_tokens long")


def plan(totals: list[tuple[str, int]], targets: list[tuple[str, float, int]]) -> dict[str, float]:
    """Expected copies of a record for each source.

    The total is the largest at which every source that has tokens can give its share without using a record
    more than max_repeats times; a source without tokens gives nothing, and the others keep their targets in
    proportion. Sources without a target, and targets of 0, get no copies.
    """
    have = {s: t for s, t in totals if s is not None and t}
    usable = [(s, share, cap) for s, share, cap in targets if have.get(s) and share and share > 0 and cap and cap > 0]
    if not usable:
        return {}
    whole = sum(share for _, share, _ in usable)
    total = min(have[s] * cap / (share / whole) for s, share, cap in usable)
    return {s: min(float(cap), total * share / whole / have[s]) for s, share, cap in usable}


def _coin(seed: int, a: int, b: int) -> float:
    """A number in [0, 1) drawn by the pair, so that a task run again decides alike."""
    return int.from_bytes(hashlib.blake2b(f"{seed}:{a}:{b}".encode(), digest_size=8).digest(), "little") / 2**64


def settle(one: list, other: list, seed: int) -> None:
    """One pivotal step on two records [id, tokens, fraction]: token mass moves until a fraction is 0 or 1.

    The expected fractions stay as they were, and so does the sum of tokens times fraction.
    """
    up = min((1 - one[2]) * one[1], other[2] * other[1])  # mass that may go from other to one
    down = min(one[2] * one[1], (1 - other[2]) * other[1])
    if _coin(seed, one[0], other[0]) < down / (up + down):
        moved = up
    else:
        moved = -down
    one[2] += moved / one[1]
    other[2] -= moved / other[1]


def _fractional(x: float) -> bool:
    return EPS < x < 1 - EPS


def reduce_fractions(rows: Iterator[tuple[str, int, int, float]], seed: int) -> Iterator[tuple[str, int, int, float, bool]]:
    """(source, id, tokens, fraction, settled): all rows in turn, each settled but the one left of each source."""
    held: dict[str, list] = {}
    for source, key, tokens, fraction in rows:
        if not _fractional(fraction) or not tokens:
            yield source, key, tokens, round(fraction) if tokens else 0.0, True
            continue
        new = [key, tokens, fraction]
        old = held.pop(source, None)
        if old is None:
            held[source] = new
            continue
        settle(old, new, seed)
        for x in (old, new):
            if _fractional(x[2]) and source not in held:
                held[source] = x
            else:
                yield source, x[0], x[1], float(round(x[2])), True
    for source, (key, tokens, fraction) in held.items():
        yield source, key, tokens, fraction, False


def mix(counted: DataFrame, targets: DataFrame, seed: int = 1, fanout: int = FANOUT, leaf: int = LEAF) -> DataFrame:
    """(doc_id, source, n_tokens, copies): the records used, with the times each is used, at most max_repeats.

    ``counted``: (doc_id, source, n_tokens), read twice. ``targets``: (source, target_share, max_repeats), one
    row a source, compared trimmed and lower-cased. Repeated records are records of their own; records of 0
    tokens, of a null source or of a source without target are not used; empty tables give no rows. The result
    depends on the records and the seed, not on files, their order or tasks.
    """
    spark = counted.sparkSession
    wanted = [tuple(r) for r in targets.select(source_name(F.col("source")), "target_share", "max_repeats").where("source is not null").collect()]
    sums = counted.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).where(F.col("source").isin([w[0] for w in wanted])).collect()
    copies = plan([(r["source"], r["t"]) for r in sums], wanted)
    leaves = max(1, -(-sum(r["n"] for r in sums) // leaf))
    schema = "doc_id long, source string, n_tokens long, whole long, fraction double, settled boolean, node long"
    if not copies:
        return spark.createDataFrame([], "doc_id long, source string, n_tokens long, copies long")

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, str, int, int, float]]:
            for batch in batches:
                for d, s, n, node in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    yield node, s, d, n, copies[s] % 1.0

        out: dict[str, list] = {"doc_id": [], "source": [], "n_tokens": [], "whole": [], "fraction": [], "settled": [], "node": []}

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({k: pa.array(v, {"source": pa.string(), "fraction": pa.float64(), "settled": pa.bool_()}.get(k, pa.int64())) for k, v in out.items()})
            for v in out.values():
                v.clear()
            return made

        for node, own in itertools.groupby(rows(), lambda r: r[0]):
            for source, key, tokens, fraction, settled in reduce_fractions((r[1:] for r in own), seed):
                for k, v in zip(out, (key, source, tokens, int(copies[source]), fraction, settled, node)):
                    out[k].append(v)
                if len(out["doc_id"]) >= 8192:
                    yield flush()
        if out["doc_id"]:
            yield flush()

    usable = counted.where(F.col("source").isin(list(copies)) & (F.col("n_tokens") > 0)).select("doc_id", "source", "n_tokens")
    draw = F.xxhash64(F.lit(seed), "doc_id")
    usable = usable.withColumns({"node": F.pmod(draw, F.lit(leaves)), "draw": draw}).repartition("node").sortWithinPartitions("node", "draw", "doc_id", "source", "n_tokens")
    usable = usable.select("doc_id", "source", "n_tokens", "node")
    decided = materialize(usable.mapInArrow(first_pass, schema))

    def merge(level: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["node", "doc_id", "n_tokens"])
            whole = pdf["whole"].iloc[0]
            out = [
                (key, source, tokens, whole, fraction, settled)
                for source, key, tokens, fraction, settled in reduce_fractions(zip(pdf.source, pdf.doc_id, pdf.n_tokens, pdf.fraction), seed + level)
            ]
            made = pd.DataFrame(out, columns=["doc_id", "source", "n_tokens", "whole", "fraction", "settled"])
            return made.assign(node=int(pdf["node"].iloc[0]) // fanout)

        return run

    # the tree: residuals of ``fanout`` nodes meet in one, level by level; a node gets at most one a source and child
    done = decided.where("settled")
    open_rows = decided.where("not settled")
    nodes, level = leaves, 0
    while nodes > 1:
        level += 1
        merged = materialize(open_rows.groupBy("source", F.floor(F.col("node") / fanout).alias("parent")).applyInPandas(merge(level), schema))
        done, open_rows = done.unionByName(merged.where("settled")), merged.where("not settled")
        nodes = -(-nodes // fanout)
    # one fractional record of each source is left: a last coin
    coin = F.pmod(F.xxhash64(F.lit(seed), "source", "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    last = open_rows.withColumn("fraction", F.when(coin < F.col("fraction"), 1.0).otherwise(0.0))
    used = done.unionByName(last).withColumn("copies", F.col("whole") + F.round("fraction").cast("long"))
    return used.where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def shares(mixture: DataFrame, counted: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: target and actual share of the mixture's tokens, records and tokens in and out, most copies.

    Sources with a target that are missing, and sources without a target, are rows too.
    """
    want = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    got = mixture.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_used"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_out"), F.max("copies").alias("most_copies")
    )
    had = counted.groupBy("source").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_tokens").alias("tokens_in"))
    total = mixture.agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0] or 0
    joined = had.where("source is not null").join(want, "source", "full").join(got, "source", "left")
    return joined.fillna(0, ["n_used", "tokens_out", "most_copies", "n_records", "tokens_in"]).withColumn(
        "actual_share", F.col("tokens_out") / F.lit(max(total, 1))
    )
