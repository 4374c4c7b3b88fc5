"""Copies, caps and shares of a mixture."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from codeloom.llm import mixing

TARGETS = [("A", 0.5, 1), (" b ", 0.3, 4), ("c", 0.1, 2), ("gone", 0.1, 3), (None, 0.0, 1)]


@pytest.fixture(scope="module")
def counted(spark):
    rng = random.Random(5)
    rows = [(n, rng.choice(["a"] * 12 + ["b", "c", "c", "free", None]), rng.choice([0, 5, 20, 50, 400])) for n in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").repartition(9, "doc_id")


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_shares_caps_and_residuals(counted, targets):
    mixture = mixing.mix(counted, targets, fanout=2, leaf=100).cache()
    totals = {r["source"]: r["t"] for r in mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t")).collect()}
    assert set(totals) == {"a", "b", "c"}
    whole = sum(totals.values())
    for source, share in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
        assert abs(totals[source] / whole - share) < 0.004
    have = dict(map(tuple, counted.groupBy("source").agg(F.sum("n_tokens")).collect()))
    copies = mixing.plan(list(have.items()), [(s.strip().lower(), t, m) for s, t, m in TARGETS if s])
    for source, total in totals.items():  # but for one record the tokens are met
        assert abs(total - copies[source] * have[source]) <= 400
    most = {r["source"]: r["m"] for r in mixture.groupBy("source").agg(F.max("copies").alias("m")).collect()}
    assert most["a"] <= 1 and most["b"] <= 4 and most["c"] <= 2
    assert mixture.where("n_tokens = 0").count() == 0 and mixture.groupBy("doc_id").count().where("count > 1").count() == 0
    report = {r["source"]: r for r in mixing.shares(mixture, counted, targets).collect()}
    assert report["gone"]["actual_share"] == 0 and report["free"]["target_share"] is None and report["free"]["n_used"] == 0
    # other files, order and partitions make no difference
    again = mixing.mix(counted.repartition(3, "n_tokens").sortWithinPartitions(F.desc("doc_id")), targets, fanout=2, leaf=100)
    assert again.exceptAll(mixture).count() == 0 and mixture.exceptAll(again).count() == 0
    other = mixing.mix(counted, targets, seed=2, fanout=2, leaf=100)
    assert other.exceptAll(mixture).count() > 0


def test_fractions_keep_their_expectation():
    rows = [("s", n, w, p) for n, (w, p) in enumerate([(1, 0.3), (5, 0.7), (2, 0.5), (9, 0.1), (4, 0.4)])]
    mass = sum(w * p for _, _, w, p in rows)
    taken = {n: [] for n in range(5)}
    for seed in range(3000):
        got = list(mixing.reduce_fractions(iter(rows), seed))
        assert sorted(r[1] for r in got) == [0, 1, 2, 3, 4]
        assert sum(not r[4] for r in got) <= 1 and all(r[3] in (0, 1) for r in got if r[4])
        assert abs(sum(r[2] * r[3] for r in got) - mass) < 1e-6
        for r in got:
            taken[r[1]].append(r[3])
    for n, (_, _, _, p) in enumerate(rows):
        assert abs(statistics.mean(taken[n]) - p) < 0.03


def test_tokens(spark):
    docs = spark.createDataFrame([(1, " Guide ", "hello world"), (2, None, None), (3, "x", ""), (4, "y", "ab " * 40_000)], "doc_id long, source string, text string").withColumn("n_tokens", F.lit("clash"))
    got = {r["doc_id"]: (r["source"], r["n_tokens"]) for r in mixing.token_counts(docs).collect()}
    assert got[1] == ("guide", 2) and got[2] == (None, 0) and got[3] == ("x", 0) and got[4][1] >= 40_000


def test_empty(spark, counted, targets):
    assert mixing.mix(counted.limit(0), targets).count() == 0 and mixing.mix(counted, targets.limit(0)).count() == 0
