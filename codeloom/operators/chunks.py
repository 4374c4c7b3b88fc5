"""Run summaries over range-sorted chunks.

The rows are range partitioned on a composite of key and secondary order, so a key that holds a third
of all rows spreads over as many partitions (chunks) as its rows need: Spark samples the quantiles of
the whole composite. Each chunk, one task, turns its sorted rows into run summaries while they stream by
in Arrow batches. Only the first and the last run of a chunk can continue in a neighbour, so only those,
two rows a chunk at most, are merged afterwards; all other summaries are final.

A summary is associative: (rows, sums, first values, last values, distinct count with its two ends).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.session import materialize


def range_sorted(df: DataFrame, order: list[str], chunks: int | None = None) -> DataFrame:
    """Range partitions on ``order`` by sampled quantiles and sorts each partition.

    Rows equal in all of ``order`` share a partition. ``chunks``: a fixed number of partitions; without it
    spark.sql.shuffle.partitions holds and AQE may join neighbours.
    """
    split = df.repartitionByRange(chunks, *order) if chunks else df.repartitionByRange(*order)
    return split.sortWithinPartitions(*order)


def changes(table: pa.Table, columns: list[str]) -> np.ndarray:
    """For rows 1.. of the table: whether any column differs from the row before; nulls equal nulls."""
    n = table.num_rows
    out = np.zeros(max(n - 1, 0), dtype=bool)
    for c in columns:
        col = table.column(c).combine_chunks()
        a, b = col.slice(0, n - 1), col.slice(1)
        differs = pc.fill_null(pc.not_equal(a, b), False)
        out |= np.asarray(differs.to_numpy(zero_copy_only=False), dtype=bool)
        if col.null_count:
            out |= np.asarray(pc.xor(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False), dtype=bool)
    return out


def _merge(a: dict, b: dict, sums: list[str], firsts: list[str], distinct: str | None) -> dict:
    """The summary of two neighbouring pieces of one run."""
    out = dict(b, n_rows=a["n_rows"] + b["n_rows"], pos=a["pos"])
    for s in sums:
        out[f"sum_{s}"] = a[f"sum_{s}"] + b[f"sum_{s}"]
    for f in firsts:
        out[f"first_{f}"] = a[f"first_{f}"]
    if distinct:
        out["n_distinct"] = a["n_distinct"] + b["n_distinct"]
        if a[f"last_{distinct}"] is not None and a[f"last_{distinct}"] == b[f"first_{distinct}"]:
            out["n_distinct"] -= 1
    return out


def chunk_runs(
    df: DataFrame,
    order: list[str],
    run: list[str],
    *,
    same: list[str] | None = None,
    alone: str | None = None,
    sums: list[str] = (),
    ends: list[str] = (),
    distinct: str | None = None,
    chunks: int | None = None,
    clean: dict | None = None,
) -> DataFrame:
    """One row per run and chunk: ``run`` columns, n_rows, sum_*, first_*, last_*, n_distinct, chunk, pos, edge.

    ``same``: a row that equals its predecessor in these columns is a repetition and is not counted (they
    must be implied by equality in ``order``, so that repetitions share a chunk). ``alone``: rows null in
    this column join no run. ``sums``: long columns, null counts 0. ``ends``: columns whose first and last
    value are kept. ``distinct``: a column, sorted within the run, whose different non-null values are
    counted. ``edge``: the first or last run of its chunk. ``clean``: columns outside ``order`` that take another
    value once the rows are sorted, so that the sampling for the ranges doesn't compute them.
    """
    ends = list(dict.fromkeys([*ends, *([distinct] if distinct else [])]))
    sums, run = list(sums), list(run)
    needed = list(dict.fromkeys([*order, *run, *sums, *ends, *(same or []), *([alone] if alone else [])]))
    fields = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType(
        [T.StructField(c, fields[c]) for c in run]
        + [T.StructField("n_rows", T.LongType())]
        + [T.StructField(f"sum_{c}", T.LongType()) for c in sums]
        + [T.StructField(f"{e}_{c}", fields[c]) for c in ends for e in ("first", "last")]
        + ([T.StructField("n_distinct", T.LongType())] if distinct else [])
        + [T.StructField("chunk", T.IntegerType()), T.StructField("pos", T.LongType()), T.StructField("edge", T.BooleanType())]
    )

    def summaries(table: pa.Table, starts: np.ndarray, pos: int, chunk: int, fresh: np.ndarray | None) -> pa.Table:
        n = table.num_rows
        stops = np.append(starts[1:], n)
        cols = {c: table.column(c).take(pa.array(starts)) for c in run}
        cols["n_rows"] = pa.array(stops - starts)
        for c in sums:
            values = np.asarray(pc.fill_null(table.column(c).combine_chunks(), 0).cast(pa.int64()).to_numpy(zero_copy_only=False))
            cols[f"sum_{c}"] = pa.array(np.add.reduceat(values, starts))
        for c in ends:
            cols[f"first_{c}"] = table.column(c).take(pa.array(starts))
            cols[f"last_{c}"] = table.column(c).take(pa.array(stops - 1))
        if distinct:
            new = fresh.copy()
            new[starts] = True
            new &= ~np.asarray(table.column(distinct).combine_chunks().is_null().to_numpy(zero_copy_only=False), dtype=bool)
            cols["n_distinct"] = pa.array(np.add.reduceat(new.astype(np.int64), starts))
        k = len(starts)
        cols["chunk"] = pa.array(np.full(k, chunk, dtype=np.int32))
        cols["pos"] = pa.array(np.arange(pos, pos + k))
        cols["edge"] = pa.array(np.zeros(k, dtype=bool))
        return pa.table(cols)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, pos = TaskContext.get().partitionId(), 0
        before: pa.Table | None = None
        open_run: dict | None = None
        layout = None

        def out(rows: list[dict] | pa.Table) -> Iterator[pa.RecordBatch]:
            made = pa.Table.from_pylist(rows, schema=layout) if isinstance(rows, list) else rows
            yield from made.combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            joined = pa.concat_tables([before, table]) if before is not None else table
            head = before is None
            if same:
                keep = changes(joined, same)
                keep = np.insert(keep, 0, True) if head else keep
                before = table.slice(table.num_rows - 1)
                if not keep.all():
                    table = table.filter(pa.array(keep))
                    if not table.num_rows:
                        continue
                    joined = pa.concat_tables([joined.slice(0, 1), table]) if not head else table
            else:
                before = table.slice(table.num_rows - 1)
            new = changes(joined, run)
            new = np.insert(new, 0, True) if head else new
            if alone:
                new |= np.asarray(table.column(alone).combine_chunks().is_null().to_numpy(zero_copy_only=False), dtype=bool)
            fresh = None
            if distinct:
                fresh = changes(joined, [distinct])
                fresh = np.insert(fresh, 0, True) if head else fresh
            starts = np.flatnonzero(new)
            goes_on = int(not new[0])
            if goes_on:
                starts = np.insert(starts, 0, 0)
            made = summaries(table, starts, pos - goes_on, chunk, fresh)
            layout = made.schema
            pos = pos - goes_on + made.num_rows
            rest = made.slice(0, made.num_rows - 1)
            if goes_on:
                first = _merge(open_run, made.slice(0, 1).to_pylist()[0], sums, ends, distinct)
                if made.num_rows == 1:
                    open_run = dict(first, edge=open_run["edge"])
                    continue
                yield from out([dict(first, edge=open_run["edge"])])
                yield from out(rest.slice(1))
            else:
                if open_run is not None:
                    yield from out([open_run])
                if made.num_rows > 1 and made.column("pos")[0].as_py() == 0:
                    yield from out([dict(rest.slice(0, 1).to_pylist()[0], edge=True)])
                    yield from out(rest.slice(1))
                else:
                    yield from out(rest)
            open_run = made.slice(made.num_rows - 1).to_pylist()[0]
            open_run["edge"] = open_run["pos"] == 0
        if open_run is not None:
            yield from out([dict(open_run, edge=True)])

    return range_sorted(df.select(*needed), order, chunks).withColumns(clean or {}).mapInArrow(scan, schema)


def stitch_runs(
    partial: DataFrame,
    run: list[str],
    within: list[str],
    *,
    alone: str | None = None,
    sums: list[str] = (),
    ends: list[str] = (),
    distinct: str | None = None,
) -> DataFrame:
    """The runs of the whole order from those of the chunks; chunk, pos and edge are gone.

    The summaries are written once to the shared folder. Those of inner runs pass through. Those at the
    edges, at most two a chunk, are put in order and merged wherever the last run of one chunk and the first
    of the next agree. ``within``: columns of the run whose groups are merged apart from each other; the
    number of chunks bounds each group.
    """
    ends = list(dict.fromkeys([*ends, *([distinct] if distinct else [])]))
    partial = materialize(partial)
    w = Window.partitionBy(*within).orderBy("chunk", "pos")
    agrees = F.lag("chunk").over(w) < F.col("chunk")
    for c in run:
        agrees = agrees & F.lag(c).over(w).eqNullSafe(F.col(c))
    if alone:
        agrees = agrees & F.col(alone).isNotNull()
    edges = partial.where("edge").withColumn("new", F.when(agrees, 0).otherwise(1))
    if distinct:
        doubled = (F.col("new") == 0) & (F.lag(f"last_{distinct}").over(w) == F.col(f"first_{distinct}"))
        edges = edges.withColumn("doubled", F.coalesce(doubled.cast("long"), F.lit(0)))
    edges = edges.withColumn("run_no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct("chunk", "pos")
    merged = edges.groupBy(*dict.fromkeys([*within, *run]), "run_no").agg(
        F.sum("n_rows").alias("n_rows"),
        *[F.sum(f"sum_{c}").alias(f"sum_{c}") for c in sums],
        *[x for c in ends for x in (F.min_by(f"first_{c}", at).alias(f"first_{c}"), F.max_by(f"last_{c}", at).alias(f"last_{c}"))],
        *([(F.sum("n_distinct") - F.sum("doubled")).alias("n_distinct")] if distinct else []),
    )
    names = [c for c in partial.columns if c not in ("chunk", "pos", "edge")]
    return partial.where("not edge").select(names).unionByName(merged.select(names))


def ordered_runs(df: DataFrame, order: list[str], run: list[str], within: list[str], *, same=None, alone=None, sums=(), ends=(), distinct=None, chunks=None, clean=None) -> DataFrame:
    """chunk_runs followed by stitch_runs."""
    partial = chunk_runs(df, order, run, same=same, alone=alone, sums=sums, ends=ends, distinct=distinct, chunks=chunks, clean=clean)
    return stitch_runs(partial, run, within, alone=alone, sums=sums, ends=ends, distinct=distinct)
