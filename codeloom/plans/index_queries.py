"""Queries of extraction, resolution, storage and streaming, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.paths import clean_action, clean_path
from codeloom.operators import lookup, rank, resolve, store
from codeloom.plans.base import CLEAN_PATH, CURRENT, query
from codeloom.plans.graph_queries import ASK, FILE, K
from codeloom.session import materialize, scratch_dir
from codeloom.sources import trees
from codeloom.sources.tables import current_edges, current_entities, load
from codeloom.streaming import jobs

EXCLUDE = ["vendor", "node_modules", "tests", "DIST"]
EXT = "lower(nullif(regexp_extract(file_path, '[^/]\\.([^./]+)$', 1), ''))"


@query("select distinct file_path from source_files where not list_has_any(string_split(lower(file_path), '/'), ['vendor', 'node_modules', 'tests', 'dist'])")
def exclude_paths(spark: SparkSession, d: str) -> DataFrame:
    files = load(spark, d, "source_files").select("file_path").distinct()
    return files.where(trees.not_excluded(F.col("file_path"), EXCLUDE))


@query(
    f"""select distinct file_path, case when {EXT} = 'py' then 'python' when {EXT} = 'rs' then 'rust' when {EXT} in ('js', 'jsx', 'mjs', 'cjs') then 'javascript'
  when {EXT} in ('ts', 'tsx', 'mts', 'cts') then 'typescript' when {EXT} = 'go' then 'go' end as language from source_files"""
)
def language_inference(spark: SparkSession, d: str) -> DataFrame:
    files = load(spark, d, "source_files").select("file_path").distinct()
    return files.withColumn("language", trees.infer_language(F.col("file_path")))


MODULE = r"""replace(ltrim(case when regexp_replace({0}, '\.[^./]+$', '') similar to '(.*/)?(__init__|mod)' then regexp_replace(regexp_replace({0}, '\.[^./]+$', ''), '/?(__init__|mod)$', '')
  else regexp_replace({0}, '\.[^./]+$', '') end, '/'), '/', '.')"""


@query(f"select distinct file_path, {MODULE.format('file_path')} as module from source_files")
def module_names(spark: SparkSession, d: str) -> DataFrame:
    files = load(spark, d, "source_files").select("file_path").distinct()
    return files.withColumn("module", trees.module_name(F.col("file_path")))


@query()
def extract_entities(spark: SparkSession, d: str) -> DataFrame:
    """Everything declared in the source files."""
    return trees.extract_entities(load(spark, d, "source_files"))


@query("select distinct id, name, entity_type, file_path, line_start, true as extracted from entities")
def extracted_known(spark: SparkSession, d: str) -> DataFrame:
    """For each entity of the table whether scanning all source files finds it, in that line."""
    columns = ["id", "name", "entity_type", "file_path", "line_start"]
    found = trees.extract_entities(load(spark, d, "source_files")).select(columns).distinct().withColumn("extracted", F.lit(True))
    return load(spark, d, "entities").select(columns).distinct().join(found, columns, "left").fillna(False, ["extracted"])


@query()
def extract_imports(spark: SparkSession, d: str) -> DataFrame:
    return trees.extract_imports(load(spark, d, "source_files"))


@query()
def resolve_imports(spark: SparkSession, d: str) -> DataFrame:
    """Edges between files that imports give, from the texts alone."""
    return resolve.resolve_imports(*trees.extract_all(load(spark, d, "source_files")))


@query()
def index_edges(spark: SparkSession, d: str) -> DataFrame:
    """All edges that indexing the files gives."""
    return resolve.call_edges(*trees.extract_all(load(spark, d, "source_files")))


@query(
    CURRENT.rstrip()
    + f""", e as (select distinct g.src, s.file_path as source_file, d.id as dst, d.name, d.file_path as dst_file from g join ce s on s.id = g.src join ce d on d.id = g.dst
    where s.file_path <> d.file_path and regexp_full_match(d.name, '\\w+')),
  chosen as (select source_file, name, arg_max(dst_file, dst) as dst_file from e group by all),
  sym as (select {MODULE.format('file_path')} as module, name, max(id) as id from ce group by all)
select distinct e.src, sym.id as dst from e join chosen using (source_file, name) join sym on sym.module = {MODULE.format('chosen.dst_file')} and sym.name = e.name where e.src <> sym.id"""
)
def resolve_implied_imports(spark: SparkSession, d: str) -> DataFrame:
    """Calls between files written anew as a bare name and an import of it, and resolved again through these imports."""
    nodes = materialize(current_entities(load(spark, d, "entities"), ["id", "name", "file_path"]))
    links = current_edges(load(spark, d, "edges"))
    source = nodes.select(F.col("id").alias("src"), F.col("file_path").alias("source_file"))
    target = nodes.where(F.col("name").rlike(r"^\w+$")).select(F.col("id").alias("dst"), F.col("name").alias("symbol"), F.col("file_path").alias("dst_file"))
    across = materialize(links.join(source, "src").join(target, "dst").where("source_file <> dst_file"))
    chosen = across.groupBy("source_file", "symbol").agg(F.max_by("dst_file", "dst").alias("dst_file"))
    imports = chosen.select(
        "source_file", F.translate(trees.module_name(F.col("dst_file")), ".", "/").alias("module_path"), "symbol",
        F.lit(None).cast("string").alias("alias"), F.col("symbol").alias("imported_name"), F.lit(0).alias("ordinal"),
    )
    calling = across.groupBy(F.col("src").alias("id"), F.col("source_file").alias("file_path")).agg(F.collect_set("symbol").alias("calls"))
    return resolve.resolve_calls(calling, imports, nodes).select("src", "dst").distinct()


@query(
    CURRENT.rstrip()
    + """, f as (select distinct file_path from ce), e as (select distinct file_path from a where action_type = 'file_edit'), r as (select distinct file_path from a where action_type = 'test_run' and file_path is not null)
select file_path from f where file_path in (select file_path from e) and file_path not in (select file_path from r)"""
)
def stale_marks(spark: SparkSession, d: str) -> DataFrame:
    """Files are marked stale that were edited, and cleared that were tested; what is left of the marks."""
    tables = store.GraphTables(spark, f"{scratch_dir(spark)}/codeloom/store-{uuid.uuid4().hex}")
    files = current_entities(load(spark, d, "entities"), ["id", "file_path"]).select("file_path").distinct()
    log = load(spark, d, "actions").select(clean_path(F.col("file_path")).alias("file_path"), clean_action(F.col("action_type")).alias("kind"))
    of = lambda kind: files.join(log.where(F.col("kind") == kind), "file_path", "left_semi")
    tables.mark_stale(of("file_edit"))
    tables.clear_stale(of("test_run"))
    return tables.stale()


@query("select id from actions where id is not null and coalesce(ts, logged_at) >= timestamp '2024-07-01' group by id")
def clear_history(spark: SparkSession, d: str) -> DataFrame:
    """The ids left in the log after its first half year was cleared."""
    return store.clear_history(load(spark, d, "actions"), "2024-07-01 00:00:00").where("id is not null").select("id").distinct()


@query("select distinct file_path, coalesce(regexp_matches(file_path, '[^/\\\\]\\.(rs|py|js|jsx|mjs|cjs|ts|tsx|mts|cts|go)$'), false) as watched from (select file_path from actions union select file_path from source_files) where file_path is not null")
def watched_files(spark: SparkSession, d: str) -> DataFrame:
    """Whether a watcher looks at each path of the log and the files; the extension's case counts."""
    paths = load(spark, d, "actions").select("file_path").unionByName(load(spark, d, "source_files").select("file_path"))
    return paths.where("file_path is not null").distinct().withColumn("watched", trees.is_source_file(F.col("file_path")))


INDEXED_AT = "2024-12-31 00:00:00"


def _indexed(spark: SparkSession, d: str) -> store.GraphTables:
    """A store with the source files as indexed."""
    tables = store.GraphTables(spark, f"{scratch_dir(spark)}/codeloom/store-{uuid.uuid4().hex}", parts=32)
    tables.overwrite(*store.index_files(load(spark, d, "source_files"), INDEXED_AT))
    return tables


@query()
def index_then_search(spark: SparkSession, d: str) -> DataFrame:
    """The files are indexed and stored, and a question is asked of what was stored."""
    tables = _indexed(spark, d)
    found = rank.ranked_query(tables.read("entities"), load(spark, d, "actions"), ASK, K)
    return found.select("file_path", F.round("score", 6).alias("score"), "n_entities")


@query(f"select distinct id, name, entity_type, line_start from entities where file_path = '{FILE}'")
def index_then_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The files are indexed and stored, and one file's entities are looked up in what was stored."""
    return lookup.entities_in_file(_indexed(spark, d).read("entities"), FILE).select("id", "name", "entity_type", "line_start")


@query(CURRENT.rstrip() + ", l as (select src, dst from g where src in (select id from ce)) select src, dst from l")
def load_graph(spark: SparkSession, d: str) -> DataFrame:
    """The graph is stored and loaded again: the edges whose source is an entity."""
    rows, edges = load(spark, d, "entities"), current_edges(load(spark, d, "edges"))
    names = [f.split()[0] for f in store.ENTITY_TABLE.replace("array<string>", "x").split(", ")]
    current = current_entities(rows, [c for c in names if c not in ("row_id", "indexed_at", "deleted_at")])
    whole = current.withColumns({c: F.lit(None) for c in ("row_id", "indexed_at", "deleted_at")}).select(*names)
    tables = store.GraphTables(spark, f"{scratch_dir(spark)}/codeloom/store-{uuid.uuid4().hex}", parts=32)
    tables.overwrite(whole, edges)
    return tables.load()[1]


@query(
    CURRENT.rstrip()
    + """, c as (select distinct id, file_path, unnest(calls) as call from ce),
  n as (select distinct file_path, name, id from ce),
  l as (select *, list_last([p for p in regexp_split_to_array(call, '[.:]') if p <> '']) as last from c where call is not null)
select l.id, l.file_path, call, coalesce(w.id, p.id, call) as target from l left join n w on w.file_path = l.file_path and w.name = call
left join n p on w.id is null and p.file_path = l.file_path and p.name = l.last"""
)
def resolve_intra_file(spark: SparkSession, d: str) -> DataFrame:
    entities = current_entities(load(spark, d, "entities"), ["id", "file_path", "name", "calls"])
    return resolve.resolve_in_file(entities)


@query(CURRENT + f"select {MODULE.format('file_path')} as module, name, max(id) as id from ce group by all")
def symbol_table(spark: SparkSession, d: str) -> DataFrame:
    return resolve.symbol_table(current_entities(load(spark, d, "entities"), ["id", "file_path", "name"]))


@query(
    CURRENT.rstrip()
    + f""", gone as (select id from ce where file_path = '{FILE}')
select src, dst from g where src not in (select id from gone) and dst not in (select id from gone)"""
)
def delete_file_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The edges left after one file is deleted."""
    entities = current_entities(load(spark, d, "entities"), ["id", "file_path"])
    paths = spark.createDataFrame([(FILE,)], "file_path string")
    return store.delete_files(entities, current_edges(load(spark, d, "edges")), paths)[1]


@query(
    CURRENT.rstrip()
    + """, ch as (select id, calls from ce where entity_type = 'test_function')
select src, dst from g where src not in (select id from ch)
union select id, c from (select id, unnest(calls) as c from ch) where contains(c, '::')"""
)
def upsert_entity(spark: SparkSession, d: str) -> DataFrame:
    """The edges after every test function is stored again with the calls it has."""
    entities = current_entities(load(spark, d, "entities"), ["id", "name", "entity_type", "file_path", "calls"])
    changed = entities.where("entity_type = 'test_function'")
    return store.upsert(entities, current_edges(load(spark, d, "edges")), changed)[1]


@query(CURRENT + "select file_path, count(*) as n_accesses, max(ts) as last_accessed from a where file_path is not null group by file_path")
def stream_counters(spark: SparkSession, d: str) -> DataFrame:
    """The counters that the action stream leaves, equal to those of the whole log."""
    return jobs.run_to_end(jobs.file_counters(jobs.action_stream(spark, f"{d}/actions.parquet")))


@query(CURRENT + "select date_trunc('day', ts)::timestamp as window_start, action_type, count(*) as n from a where ts is not null group by all")
def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    return jobs.run_to_end(jobs.window_counts(jobs.action_stream(spark, f"{d}/actions.parquet")))


@query(
    CURRENT.rstrip()
    + """, ev as (
  select file_path, arg_max(case when dst_gone then 'deleted' else 'modified' end, row_id) as kind from (
    select file_path, row_id, deleted_at is not null as dst_gone from entities) group by file_path having kind = 'deleted'
)
select id from ce where file_path not in (select file_path from ev)"""
)
def stream_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """The ids left after the files whose last entity row is a deletion are reported as deleted."""
    rows = load(spark, d, "entities")
    entities = current_entities(rows, ["id", "name", "entity_type", "file_path", "line_start", "line_end", "language", "docstring", "calls"])
    last = rows.groupBy("file_path").agg(F.max_by(F.when(F.col("deleted_at").isNotNull(), "deleted").otherwise("modified"), "row_id").alias("kind"))
    events = last.where("kind = 'deleted'").withColumn("at", F.lit(0))
    contents = load(spark, d, "source_files").select("file_path", "language", "content")
    return jobs.reconcile(entities, current_edges(load(spark, d, "edges")), events, contents)[0].select("id")


@query()
def stream_reconcile_tree(spark: SparkSession, d: str) -> DataFrame:
    """The entities after a stream of events: of the indexed files those with an even name hash were modified, a third of these are gone."""
    files = load(spark, d, "source_files").select("file_path", "language", "content")
    tables = _indexed(spark, d)
    draw = F.pmod(F.xxhash64("file_path"), F.lit(6))
    landed = f"{scratch_dir(spark)}/codeloom/events-{uuid.uuid4().hex}"
    paths = files.where("file_path is not null").select("file_path").distinct()
    events = paths.where(draw % 2 == 0).select("file_path", (draw != 4).alias("exists"), F.lit("2025-01-01 00:00:00").cast("timestamp_ntz").alias("at"))
    after = spark.createDataFrame([("after.py", True, "2025-01-02 00:00:00")], "file_path string, exists boolean, at string")  # moves the watermark on
    events.unionByName(after.withColumn("at", F.col("at").cast("timestamp_ntz"))).write.json(landed)
    left = files.where(~((draw == 2) | (draw == 4)))  # 2: gone by the time of the event
    for _ in range(2):
        stream = jobs.debounced(jobs.file_events(spark, landed))
        jobs.reconciler(tables, stream, lambda: left, f"{landed}-checkpoint", INDEXED_AT).awaitTermination()
    return tables.read("entities").select("id", "file_path", "line_start", F.size("called_by").alias("n_callers"))


@query(
    f"""with e as (select file_path, action_type <> 'error' as here, ts from (select {CLEAN_PATH} as file_path, action_type, ts from actions) where file_path is not null and ts is not null
    and regexp_matches(file_path, '[^/\\\\]\\.(rs|py|js|jsx|mjs|cjs|ts|tsx|mts|cts|go)$')),
  m as (select *, case when ts < lag(ts) over w + interval 10 minutes then 0 else 1 end as fresh from e window w as (partition by file_path order by ts)),
  s as (select *, sum(fresh) over (partition by file_path order by ts rows unbounded preceding) as burst from m)
select file_path, case when max(struct_pack(ts := ts, here := here)).here then 'modified' else 'deleted' end as kind, max(ts) as at from s group by file_path, burst"""
)
def debounced_events(spark: SparkSession, d: str) -> DataFrame:
    """The log read as file events (an error stands for a file that is gone): one event for each burst of ten minutes."""
    rows = load(spark, d, "actions").select(clean_path(F.col("file_path")).alias("file_path"), (F.col("action_type") != "error").alias("exists"), F.col("ts").alias("at"))
    return jobs.debounced(rows.where("file_path is not null and at is not null"), "10 minutes")


@query(CURRENT + "select id, session_id, file_path from a where action_type = 'error'")
def stream_error_log(spark: SparkSession, d: str) -> DataFrame:
    """The errors that the log sink writes apart, read back."""
    base = f"{scratch_dir(spark)}/codeloom/log-{uuid.uuid4().hex}"
    jobs.log_sink(jobs.action_stream(spark, f"{d}/actions.parquet"), f"{base}/log", f"{base}/errors", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/errors").select("id", "session_id", "file_path")


@query(
    CURRENT.rstrip()
    + """, m as (select session_id, ts, case when ts < lag(ts) over w + interval 30 minutes then 0 else 1 end as fresh from a where ts is not null window w as (partition by session_id order by ts)),
  s as (select *, sum(fresh) over (partition by session_id order by ts rows unbounded preceding) as burst from m)
select session_id, min(ts) as started, max(ts) + interval 30 minutes as ended, count(*) as n from s where session_id is not null group by session_id, burst"""
)
def stream_session_counts(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of each session, counted over the whole log by the stream's operator."""
    rows = load(spark, d, "actions").where("id is not null")
    last = rows.groupBy("id").agg(F.max_by(F.struct("session_id", "ts"), "logged_at").alias("a")).select("a.*")
    found = jobs.session_counts(last.where("session_id is not null and ts is not null").withColumn("event_at", F.col("ts")))
    return found
