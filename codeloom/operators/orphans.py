"""References to records that do not exist at their time (problem 3).

Method: the instants at which an id is live are integers (microseconds); each entity row contributes the
range [indexed_at, deleted_at). Sorted by start, the ranges compress into contiguous runs; a reference
matches the preceding run start of its id and is an orphan if there is none or its time lies beyond the
run's end. Parents and references are range partitioned together on (id, time), so that the references of
a hot id spread over many partitions; the end of the last run at each partition's edge is carried on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.chunks import changes, range_sorted
from codeloom.session import materialize

#: End of a range that is still open, and the state of an id without a parent row so far.
OPEN, NONE = 2**62, -(2**62)


def micros(ts: F.Column) -> F.Column:
    """Microseconds since 1970 of a timestamp with or without zone, as it reads."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def live_ranges(entities: DataFrame) -> DataFrame:
    """(ref_id, at, until) of each entities row; rows without id or start, and empty ranges, are left out."""
    until = F.coalesce(micros(F.col("deleted_at")), F.lit(OPEN))
    return (
        entities.where("id is not null and indexed_at is not null")
        .select(F.col("id").alias("ref_id"), micros(F.col("indexed_at")).alias("at"), until.alias("until"))
        .where("until > at")
    )


def all_references(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(ref_field, row_id, ref_id, at) of the four fields.

    Nulls are no references, nor are elements of calls without `::`. Rows without a time are left out: they
    have no period.
    """
    ends = F.explode(
        F.array(
            F.struct(F.lit("edges.src").alias("ref_field"), F.col("src").alias("ref_id")),
            F.struct(F.lit("edges.dst").alias("ref_field"), F.col("dst").alias("ref_id")),
        )
    ).alias("e")
    of_edges = edges.select(F.col("edge_id").alias("row_id"), micros(F.col("recorded_at")).alias("at"), ends)
    listed = F.concat(
        F.transform(
            F.filter(F.coalesce("calls", F.array().cast("array<string>")), lambda x: x.contains("::")),
            lambda x: F.struct(F.lit("entities.calls").alias("ref_field"), x.alias("ref_id")),
        ),
        F.transform(
            F.coalesce("called_by", F.array().cast("array<string>")),
            lambda x: F.struct(F.lit("entities.called_by").alias("ref_field"), x.alias("ref_id")),
        ),
    )
    of_entities = entities.select("row_id", micros(F.col("indexed_at")).alias("at"), F.explode(listed).alias("e"))
    names = ["e.ref_field", "row_id", "e.ref_id", "at"]
    return of_edges.select(names).union(of_entities.select(names)).where("ref_id is not null and at is not null")


def orphan_references(references: DataFrame, ranges: DataFrame, chunks: int | None = None) -> DataFrame:
    """The distinct (ref_field, row_id, ref_id, at) of ``references`` that fall in no range of their ref_id.

    ``ranges``: (ref_id, at, until), half open, overlapping or repeated as they come. A reference at a
    range's start is live, at its end not. Empty references give no rows; without ranges all are orphans.
    """
    both = (
        ranges.select("ref_id", "at", F.lit(0).alias("kind"), "until", F.lit(None).cast("string").alias("ref_field"), F.lit(None).cast("long").alias("row_id"))
        .unionByName(references.select("ref_id", "at", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("until"), "ref_field", F.col("row_id").cast("long").alias("row_id")))
    )
    order = ["ref_id", "at", "kind", "ref_field", "row_id"]
    schema = "ref_field string, row_id long, ref_id string, at long, state string, chunk int, until long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId()
        before: pa.Table | None = None
        carried, inside = NONE, False  # the last id's end so far; whether that id began in this chunk
        names = ["ref_field", "row_id", "ref_id", "at"]

        def rows(table: pa.Table, state: str, until: int | None) -> Iterator[pa.RecordBatch]:
            k = table.num_rows
            cols = {c: table.column(c) for c in names} | {
                "state": pa.array([state] * k, pa.string()),
                "chunk": pa.array(np.full(k, chunk, np.int32)),
                "until": pa.array([until] * k, pa.int64()),
            }
            yield from pa.table(cols).combine_chunks().to_batches()

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            table = pa.Table.from_batches([batch])
            joined = pa.concat_tables([before, table]) if before is not None else table
            other_id, fresh = changes(joined, ["ref_id"]), changes(joined, [*order, "until"])
            if before is None:
                other_id, fresh = np.insert(other_id, 0, False), np.insert(fresh, 0, True)
            before = table.slice(n - 1)
            at = table.column("at").combine_chunks().to_numpy(zero_copy_only=False)
            is_ref = table.column("kind").combine_chunks().to_numpy(zero_copy_only=False) == 1
            until = pc.fill_null(table.column("until").combine_chunks(), NONE).to_numpy(zero_copy_only=False).copy()
            # a running maximum within each id: that of its current run's end, as the ranges come by start
            starts = np.flatnonzero(np.insert(other_id[1:], 0, True))
            if not other_id[0]:
                until[0] = max(until[0], carried)
            group = np.cumsum(np.insert(other_id[1:], 0, False))
            if (until != NONE).any():
                levels, code = np.unique(until, return_inverse=True)
                until = levels[np.maximum.accumulate(code + group * len(levels)) - group * len(levels)]
            group_inside = group > 0
            group_inside |= bool(other_id[0]) or inside
            orphan = is_ref & fresh & ~(at < until)
            for state, mask in (("orphan", orphan & group_inside), ("pending", orphan & ~group_inside)):
                if mask.any():
                    yield from rows(table.filter(pa.array(mask)), state, None)
            carried = int(until[-1])
            inside = inside or bool(other_id[0]) or len(starts) > 1
        if before is not None:
            yield from rows(before, "tail", carried)

    found = materialize(range_sorted(both, order, chunks).mapInArrow(scan, schema))
    # What an id's ends reach at the edge of each chunk; as many rows as there are chunks.
    tails = found.where("state = 'tail'").select("chunk", F.col("ref_id").alias("tail_id"), "until")
    by_id = Window.partitionBy("tail_id").orderBy("chunk")
    in_order = Window.orderBy("chunk")
    carry = tails.select(
        F.lead("chunk").over(in_order).alias("chunk"), "tail_id", F.max("until").over(by_id).alias("reach")
    ).where("chunk is not null")
    names = ["ref_field", "row_id", "ref_id", "at"]
    pending = (
        found.where("state = 'pending'")
        .join(F.broadcast(carry), "chunk", "left")  # at most a row for each chunk
        .where(~((F.col("tail_id") == F.col("ref_id")) & (F.col("at") < F.col("reach"))) | F.col("tail_id").isNull())
    )
    return found.where("state = 'orphan'").select(names).union(pending.select(names))


def period_of(at: F.Column) -> F.Column:
    """`YYYY-MM` of microseconds since 1970."""
    stamp = F.timestamp_add("MICROSECOND", at, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.date_format(stamp, "yyyy-MM")
