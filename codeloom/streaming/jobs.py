"""Streams over the action log and over file events.

Deliveries repeat and come late. One watermark on the time of the action bounds all state: ids by which
repetitions are dropped, and open windows, leave the state store once it has passed them. For state beyond an executor's memory set spark.sql.streaming.stateStore.providerClass to the RocksDB provider.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.functions.paths import clean_action, clean_path
from codeloom.operators.resolve import call_edges, exploded_calls
from codeloom.operators.store import GraphTables, delete_files
from codeloom.session import materialize, scratch_dir
from codeloom.sources.trees import extract_all, extract_imports, is_source_file

#: By default actions may come so late; callers choose their own.
LATE = "30 days"
DEBOUNCE = "500 milliseconds"


def action_stream(spark: SparkSession, path: str, files_per_trigger: int = 100, late: str = LATE) -> DataFrame:
    """The action log as a stream of its Parquet files, spellings cleaned, repeated deliveries dropped.

    ``late`` bounds the state: rows and repetitions that come later than it behind the newest action are dropped
    by the watermark. The log of this project is up to ten days late.
    """
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # a pattern may name a single file, a plain path must be a folder
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)
    rows = rows.withColumn("event_at", F.coalesce("ts", "logged_at").cast("timestamp")).withWatermark("event_at", late)
    rows = rows.dropDuplicatesWithinWatermark(["id"])
    return rows.withColumns({"action_type": clean_action(F.col("action_type")), "file_path": clean_path(F.col("file_path"))})


def file_counters(stream: DataFrame) -> DataFrame:
    """(file_path, n_accesses, last_accessed); a late action never moves last_accessed back."""
    named = stream.where("file_path is not null")
    return named.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_accesses"), F.max("ts").alias("last_accessed"))


def window_counts(stream: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    """(window_start, action_type, n): tumbling, or with ``slide`` sliding, windows of event time."""
    window = F.window("event_at", width, slide) if slide else F.window("event_at", width)
    counts = stream.groupBy(window.alias("w"), "action_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "action_type", "n")


def run_to_end(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now and returns the table it leaves.

    Each batch is written to its own folder; in complete mode the last one is the whole result.
    """
    spark = stream.sparkSession
    base = f"{scratch_dir(spark)}/codeloom/stream-{uuid.uuid4().hex}"
    seen: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{number}")
        seen.append(number)

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not seen:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{base}/out/{max(seen)}")
    return spark.read.schema(stream.schema).parquet(*[f"{base}/out/{n}" for n in seen])


def log_sink(stream: DataFrame, log: str, errors: str, checkpoint: str) -> StreamingQuery:
    """Appends the actions to ``log``, and the errors among them to ``errors`` as well."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")
        batch.where("action_type = 'error'").write.mode("overwrite").parquet(f"{errors}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_events(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """File events landed as JSON lines (file_path, exists, at), as a stream; ``late`` bounds the state of debounced."""
    rows = spark.readStream.schema("file_path string, exists boolean, at timestamp_ntz").json(path)
    return rows.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)


def session_counts(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(session_id, started, ended, n): bursts of a session's actions with no pause of ``gap``."""
    burst = stream.groupBy(F.session_window("event_at", gap).alias("w"), "session_id")
    return burst.agg(F.count(F.lit(1)).alias("n")).select("session_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def debounced(events: DataFrame, quiet: str = DEBOUNCE) -> DataFrame:
    """(file_path, kind, at): one event for each burst of a source file's events (file_path, exists, at), its last.

    A burst ends when the file was left alone for ``quiet``, so it is never split; it comes out once the
    watermark has passed it. A path that exists was modified, one that doesn't was deleted.
    """
    sources = events.where(is_source_file(F.col("file_path")))
    last = F.max(F.struct("at", "exists")).alias("last")
    rows = sources.groupBy("file_path", F.session_window("at", quiet)).agg(last)
    return rows.select("file_path", F.when(F.col("last.exists"), "modified").otherwise("deleted").alias("kind"), F.col("last.at").alias("at"))


def reconcile(entities: DataFrame, edges: DataFrame, events: DataFrame, contents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, edges, settled) after file events (file_path, kind, at); ``contents`` (file_path, language, content) as they are now.

    The last event of a file counts. Its entities leave with all their edges. A modified file that is still in
    ``contents`` is parsed again: its calls are resolved against the whole graph, and calls from files that stayed into it
    are resolved anew (the imports of those that call a name it declares are read again). Edges that were there
    stay if both ends still are. ``settled`` (file_path) are the files parsed again: deleted ones, and files gone
    by the time of their event, are not.
    """
    columns = [c for c in entities.columns if c in ("id", "name", "entity_type", "file_path", "line_start", "line_end", "language", "docstring", "calls")]
    last = events.groupBy("file_path").agg(F.max_by("kind", "at").alias("kind"))
    kept, links = delete_files(entities, edges, last)
    changed = contents.join(last.where("kind <> 'deleted'").select("file_path"), "file_path", "left_semi")
    fresh, imports = extract_all(changed)
    fresh = fresh.dropDuplicates(["id"])
    nodes = kept.select(columns).unionByName(fresh.select(columns))
    outward = call_edges(fresh, imports, nodes)
    # who of the others calls something by a name that the changed files declare, or by its id
    names = fresh.select(F.col("name").alias("last")).distinct()
    calls = exploded_calls(kept).withColumn("last", F.element_at(F.filter(F.split("call", "[.:]"), lambda p: p != ""), -1))
    asking = materialize(calls.join(names, "last", "left_semi").groupBy("id", "file_path").agg(F.collect_set("call").alias("calls")))
    files = contents.join(asking.select("file_path").distinct(), "file_path", "left_semi")
    inward = call_edges(asking.join(kept.select("id", "name"), "id"), extract_imports(files), nodes)
    inward = inward.join(fresh.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    back = edges.join(kept.select(F.col("id").alias("src")), "src", "left_semi").join(fresh.select(F.col("id").alias("dst")), "dst", "left_semi")
    out = links.unionByName(outward).unionByName(inward).unionByName(back.select("src", "dst")).distinct()
    return nodes, out, changed.select("file_path").distinct()


def reconciler(store: GraphTables, events: DataFrame, contents, checkpoint: str, at: str | None = None) -> StreamingQuery:
    """Keeps a store up to date with a stream of debounced file events; ``contents()`` gives the files as they are now.

    The files of a batch are stale until it is written; those that are gone stay marked. ``at`` is the time that
    parsed entities get, by default now.
    """

    def apply(batch: DataFrame, number: int) -> None:
        batch = materialize(batch)
        if batch.isEmpty():
            return
        store.mark_stale(batch)
        entities = store.read("entities")
        nodes, links, settled = reconcile(entities, store.read("edges"), batch, contents())
        # as in indexing, a parsed entity gets the time of this run
        now = F.lit(at).cast("timestamp_ntz") if at else F.localtimestamp()
        times = entities.join(batch.select("file_path"), "file_path", "left_anti").select("id", "row_id", "indexed_at", "deleted_at")
        full = nodes.join(times, "id", "left")
        full = full.withColumns({"row_id": F.coalesce("row_id", F.xxhash64("id")), "indexed_at": F.coalesce("indexed_at", now)})
        store.change(full, links)
        store.clear_stale(settled)
        store.heartbeat(str(number))

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
