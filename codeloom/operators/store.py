"""A graph kept as partitioned Parquet: indexing, overwrite, upsert, cascading delete, stale marks.

``entities`` and ``edges`` are partitioned by a hash of the file (for an edge, of its source's file). A change
rewrites only the partitions that it touches (dynamic partition overwrite). A change isn't atomic over both tables,
but repeating it gives the same result, so a job that died is run again.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.paths import id_path
from codeloom.operators.resolve import call_edges, with_callers
from codeloom.session import materialize
from codeloom.sources.trees import extract_all

ENTITY_TABLE = (
    "row_id long, id string, name string, entity_type string, file_path string, line_start int, line_end int, language string,"
    " docstring string, calls array<string>, called_by array<string>, indexed_at timestamp_ntz, deleted_at timestamp_ntz"
)
EDGE_TABLE = "src string, dst string"


def index_files(files: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) of (file_path, language, content) rows, in the form of the entities and edges tables.

    ``at`` is the time of this run, for indexed_at. Of several declarations of one id in a file the first counts.
    """
    entities, imports = extract_all(files)
    edges = materialize(call_edges(entities, imports))
    first = F.min_by(F.struct("name", "entity_type", "file_path", "line_start", "line_end", "language", "docstring", "calls"), F.struct("line_start", "line_end"))
    one = entities.groupBy("id").agg(first.alias("e")).select("id", "e.*")
    rows = with_callers(one, edges).withColumns(
        {"row_id": F.xxhash64("id"), "indexed_at": F.lit(at).cast("timestamp_ntz"), "deleted_at": F.lit(None).cast("timestamp_ntz")}
    )
    return rows.select([f.split()[0] for f in ENTITY_TABLE.replace("array<string>", "x").split(", ")]), edges


def upsert(entities: DataFrame, edges: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and edges after ``changed`` entities replaced those of the same id.

    The edges out of a changed entity become those of its ``calls`` that are ids; edges into it stay.
    """
    ids = changed.select("id").distinct()
    columns = [c for c in entities.columns if c in changed.columns]
    kept = entities.join(ids, "id", "left_anti").select(columns).unionByName(changed.select(columns).dropDuplicates(["id"]))
    out = changed.select(F.col("id").alias("src"), F.explode("calls").alias("dst")).where(F.col("dst").contains("::"))
    links = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").select("src", "dst").unionByName(out).distinct()
    return kept, links


def delete_files(entities: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and edges without the files in ``paths`` (file_path) and every edge from or to them."""
    gone = entities.join(paths.select("file_path").distinct(), "file_path", "left_semi").select("id").distinct()
    kept = entities.join(paths.select("file_path").distinct(), "file_path", "left_anti")
    links = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return kept, links.select("src", "dst")


def clear_history(actions: DataFrame, before: str | None = None) -> DataFrame:
    """The action log after its history was cleared: nothing, or what happened at ``before`` or later. The graph isn't touched."""
    return actions.where("false") if before is None else actions.where(F.coalesce("ts", "logged_at") >= F.lit(before).cast("timestamp_ntz"))


class GraphTables:
    """entities, edges and the log of stale marks below one folder that all executors share; api.CodeGraph.open reads it."""

    def __init__(self, spark: SparkSession, root: str, parts: int = 256) -> None:
        self.spark, self.root, self.parts = spark, root.rstrip("/"), parts

    def _part(self, path: Column) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(self.parts)).cast("int")

    def _placed(self, name: str, df: DataFrame) -> DataFrame:
        return df.withColumn("part", self._part(F.col("file_path") if name == "entities" else id_path(F.col("src"))))

    def _write(self, name: str, df: DataFrame, dynamic: bool) -> None:
        writer = df.repartition("part").write.mode("overwrite").partitionBy("part")
        writer.option("partitionOverwriteMode", "dynamic" if dynamic else "static").parquet(f"{self.root}/{name}.parquet")

    def _schema(self, name: str) -> str:
        return {"entities": ENTITY_TABLE, "edges": EDGE_TABLE}[name]

    def _rows(self, name: str) -> DataFrame:
        return self.spark.read.schema(self._schema(name) + ", part int").parquet(f"{self.root}/{name}.parquet")

    def read(self, name: str) -> DataFrame:
        """A table; rows without key only keep emptied partitions in place."""
        return self._rows(name).where("id is not null" if name == "entities" else "src is not null").drop("part")

    def overwrite(self, entities: DataFrame, edges: DataFrame) -> None:
        for name, df in (("entities", entities), ("edges", edges.select("src", "dst").where("src is not null").distinct())):
            self._write(name, self._placed(name, df), dynamic=False)

    def _replace(self, name: str, new: DataFrame, old: DataFrame) -> None:
        """Rewrites the partitions in which the table changes from ``old`` to ``new``."""
        columns = [f.split()[0] for f in self._schema(name).replace("array<string>", "x").split(", ")]
        new, old = self._placed(name, new.select(columns)), self._placed(name, old.select(columns))
        # a checksum per partition tells which changed
        sums = lambda df, c: df.groupBy("part").agg(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias(c), F.count(F.lit(1)).alias(f"n_{c}"))
        both = sums(new, "a").join(sums(old, "b"), "part", "full")
        touched = materialize(both.where("not (a <=> b) or not (n_a <=> n_b)").select("part"))
        empty = touched.select(*[F.lit(None).cast(t).alias(c) for c, t in ((f.split()[0], f.split()[1]) for f in self._schema(name).split(", "))], "part")
        rows = materialize(new.join(touched, "part", "left_semi").select(*columns, "part").unionByName(empty))
        self._write(name, rows, dynamic=True)

    def change(self, entities: DataFrame, edges: DataFrame) -> None:
        """Moves the tables to the given state, called_by following from the edges, and rewrites the partitions that differ."""
        edges = materialize(edges.select("src", "dst").where("src is not null").distinct())
        entities = materialize(with_callers(entities, edges))
        self._replace("entities", entities, self.read("entities"))
        self._replace("edges", edges, self.read("edges"))

    def upsert(self, changed: DataFrame) -> None:
        self.change(*upsert(self.read("entities"), self.read("edges"), changed))

    def delete(self, paths: DataFrame) -> None:
        self.change(*delete_files(self.read("entities"), self.read("edges"), paths))

    def _mark(self, paths: DataFrame, stale: bool) -> None:
        marks = paths.select("file_path").distinct().withColumns({"stale": F.lit(stale), "seq": F.lit(time.time_ns())})
        marks.write.mode("append").parquet(f"{self.root}/stale_log")

    def mark_stale(self, paths: DataFrame) -> None:
        self._mark(paths, True)

    def clear_stale(self, paths: DataFrame) -> None:
        self._mark(paths, False)

    def stale(self) -> DataFrame:
        """(file_path): files whose last mark says so."""
        log = self.spark.read.schema("file_path string, stale boolean, seq long").parquet(f"{self.root}/stale_log")
        return log.groupBy("file_path").agg(F.max_by("stale", "seq").alias("stale")).where("stale").select("file_path")

    def heartbeat(self, at: str) -> None:
        """Notes the time of a finished reconciliation."""
        self.spark.range(1).select(F.lit(at).alias("at"), F.lit(time.time_ns()).alias("seq")).write.mode("append").parquet(f"{self.root}/heartbeats")

    def last_heartbeat(self) -> str | None:
        row = self.spark.read.schema("at string, seq long").parquet(f"{self.root}/heartbeats").agg(F.max_by("at", "seq")).first()
        return row[0]

    def load(self) -> tuple[DataFrame, DataFrame]:
        """Entities, and the edges whose source is one of them."""
        entities = self.read("entities")
        return entities, self.read("edges").join(entities.select(F.col("id").alias("src")), "src", "left_semi")
