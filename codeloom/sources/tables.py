"""The Parquet tables, and the current state of the ones that keep history.

``entities`` has several rows per id (one per index run) and exact duplicates, ``edges`` has one row
per observation. The reference-style operators work on the current graph: of each id the last row,
unless that row is deleted; of the edges the distinct pairs with both ends given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current_entities(entities: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The last row of each id by (indexed_at, row_id), if it is not deleted. Null ids are left out.

    One hash aggregation with map-side combine; repeated rows fall together in it. Give ``columns`` so
    that only those are read and shuffled.
    """
    columns = columns or [c for c in entities.columns if c not in ("indexed_at", "row_id", "deleted_at")]
    kept = [c for c in columns if c != "id"]
    last = F.max_by(
        F.struct(F.col("deleted_at").alias("deleted_at"), *[F.col(c) for c in kept]), F.struct("indexed_at", "row_id")
    )
    return (
        entities.where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(last.alias("e"))
        .where(F.col("e.deleted_at").isNull())
        .select("id", *[F.col(f"e.{c}").alias(c) for c in kept])
    )


def current_edges(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) with both ends given."""
    return edges.where("src is not null and dst is not null").select("src", "dst").distinct()


def distinct_actions(actions: DataFrame, columns: list[str]) -> DataFrame:
    """One row per action id, the one delivered last (logged_at); null ids are left out."""
    kept = [c for c in columns if c != "id"]
    return (
        actions.where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max_by(F.struct(*kept), F.struct(F.col("logged_at"), *kept)).alias("a"))
        .select("id", *[F.col(f"a.{c}").alias(c) for c in kept])
    )
