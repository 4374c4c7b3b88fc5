"""Run summaries against a plain loop, with chunks and batches far smaller than the runs."""

import itertools

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from codeloom.operators.chunks import ordered_runs

ROWS = st.lists(
    st.tuples(st.sampled_from("ab"), st.sampled_from(["x", "y", None]), st.integers(0, 3), st.one_of(st.none(), st.integers(0, 9))),
    max_size=60,
)


def brute(rows):
    """Runs of equal y within k, in the order given; None stands alone."""
    out = []
    for k, group in itertools.groupby(rows, key=lambda r: r[0]):
        last = object()
        for _, at, y, n in group:
            if y is not None and y == last:
                out[-1][2] += 1
                out[-1][3] += n or 0
                out[-1][5] = at
            else:
                out.append([k, y, 1, n or 0, at, at])
            last = y if y is not None else object()
    return sorted(map(tuple, out), key=repr)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=ROWS, chunks=st.integers(1, 9))
def test_runs_like_a_loop(spark, rows, chunks):
    numbered = sorted(((k, n, y, v) for n, (k, y, _, v) in enumerate(rows)), key=lambda r: (r[0], r[1]))
    df = spark.createDataFrame(numbered * 2, "k string, at int, y string, v long")
    got = ordered_runs(df, ["k", "at"], ["k", "y"], ["k"], same=["k", "at"], alone="y", sums=["v"], ends=["at"], chunks=chunks)
    got = got.select("k", "y", "n_rows", "sum_v", "first_at", "last_at").collect()
    assert sorted(map(tuple, got), key=repr) == brute(numbered)


def test_one_run_over_all_chunks(spark):
    df = spark.createDataFrame([("k", n, n // 3, 1) for n in range(500)], "k string, at int, other int, v long")
    got = ordered_runs(df, ["k", "other", "at"], ["k"], ["k"], sums=["v"], distinct="other", chunks=12).collect()
    assert [(r["k"], r["n_rows"], r["sum_v"], r["n_distinct"]) for r in got] == [("k", 500, 500, 167)]


def test_empty(spark):
    df = spark.createDataFrame([], "k string, at int, v long")
    assert ordered_runs(df, ["k", "at"], ["k"], ["k"], sums=["v"]).count() == 0
