"""Per-key results over references when a few keys hold most of them (problem 2).

Method: range partition on (field, key, neighbour, observation) with sampled quantiles, so that heavy keys
are split across partitions; one partial state per key and partition; stitch the states at the boundaries.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.chunks import ordered_runs

FIELDS = ("edges.src", "edges.dst", "entities.called_by")


def edge_references(edges: DataFrame) -> DataFrame:
    """(ref_field, ref_key, neighbour, ref_row, weight): two rows per edge row, one for each end."""
    ends = F.explode(
        F.array(
            F.struct(F.lit("edges.src").alias("ref_field"), F.col("src").alias("ref_key"), F.col("dst").alias("neighbour")),
            F.struct(F.lit("edges.dst").alias("ref_field"), F.col("dst").alias("ref_key"), F.col("src").alias("neighbour")),
        )
    )
    return edges.select(F.col("edge_id").alias("ref_row"), ends.alias("e")).select("e.*", "ref_row", F.lit(1).cast("long").alias("weight"))


def called_by_references(entities: DataFrame, *, each: bool = True) -> DataFrame:
    """The elements of called_by under the row's id: a row for each, or (``each=False``) a row with their number."""
    row = [F.lit("entities.called_by").alias("ref_field"), F.col("id").alias("ref_key")]
    if each:
        caller = F.posexplode("called_by").alias("at", "neighbour")
        out = entities.select(*row, caller, F.col("row_id").alias("ref_row"))
        return out.select("ref_field", "ref_key", "neighbour", "ref_row", F.lit(1).cast("long").alias("weight"), "at")
    n = F.coalesce(F.size("called_by"), F.lit(0)).cast("long")
    n = F.when(n > 0, n).otherwise(F.lit(0)).cast("long")
    return entities.select(*row, F.lit(None).cast("string").alias("neighbour"), F.col("row_id").alias("ref_row"), n.alias("weight"))


def key_counts(references: DataFrame, chunks: int | None = None) -> DataFrame:
    """(ref_field, ref_key, n_refs) for every key, the null key included.

    References are counted once per (ref_field, ref_key, ref_row); ``weight`` is how many references a row
    stands for, null 0. Repeated rows count once, ties share a partition, an empty table gives no rows,
    further columns are ignored.
    """
    order = ["ref_field", "ref_key", "ref_row"]
    runs = ordered_runs(
        references.select(*order, "weight"), order, order[:2], order[:2], same=order, sums=["weight"], chunks=chunks
    )
    return runs.select("ref_field", "ref_key", F.col("sum_weight").alias("n_refs"))


def key_neighbours(references: DataFrame, chunks: int | None = None) -> DataFrame:
    """(ref_field, ref_key, n_refs, n_neighbours, first_neighbour, last_neighbour) for every key.

    The neighbours of a key are never gathered: sorted within the key, they are counted as they change.
    Null neighbours count as references, not as neighbours; ``first``/``last`` are in byte order, null first.
    ``at`` tells apart equal references within one row, where the table has it.
    """
    if "at" not in references.columns:
        references = references.withColumn("at", F.lit(0))
    order = ["ref_field", "ref_key", "neighbour", "ref_row", "at"]
    runs = ordered_runs(references, order, order[:2], order[:2], same=order, sums=["weight"], distinct="neighbour", chunks=chunks)
    return runs.select(
        "ref_field",
        "ref_key",
        F.col("sum_weight").alias("n_refs"),
        F.col("n_distinct").alias("n_neighbours"),
        "first_neighbour",
        "last_neighbour",
    )


def heavy_keys(counts: DataFrame, share: float = 0.02) -> DataFrame:
    """The keys of key_counts that hold at least ``share`` of their field's references; the null key adds to the total only."""
    totals = counts.groupBy("ref_field").agg(F.sum("n_refs").alias("total"))
    return (
        counts.join(F.broadcast(totals), "ref_field")  # one row a field
        .where(F.col("ref_key").isNotNull() & (F.col("n_refs") > 0) & (F.col("n_refs") >= F.col("total") * F.lit(Decimal(str(share)))))
        .select("ref_field", "ref_key", "n_refs", "total")
    )
