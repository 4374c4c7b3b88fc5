"""Queries over the entities, the call edges and the action log, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import paths, text
from codeloom.operators import graph, history, lookup, rank
from codeloom.plans.base import CURRENT, CURRENT_RECURSIVE, query
from codeloom.sources.tables import current_edges, current_entities, load

HUB, CALLED, FILE, NAME = "src/core/runner.py::run_everything", "src/core/config.rs::setting", "src/core/config.rs", "setting"
ASK, K = "route handler", 10
SHOWN = "id, name, entity_type, file_path, line_start, coalesce(line_end, -1) as line_end, language"
WHY = text.REASONS
#: Unknown line numbers and distances are shown as -1.
UNKNOWN = -1


def _e(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "entities")


def _g(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "edges")


def _a(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "actions")


def _most_calling(edges: DataFrame, by: str, n: int = 1) -> DataFrame:
    """The n ids with most distinct edges at their ``by`` end."""
    return current_edges(edges).groupBy(F.col(by).alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(n).select("id")


# scans, lookups, neighbours


@query(CURRENT + f"select {SHOWN} from ce where starts_with(id, 'src/')")
def prefix_scan(spark: SparkSession, d: str) -> DataFrame:
    """The current entities below one folder, by the prefix of their ids."""
    return lookup.entities_with_prefix(_e(spark, d), "src/").fillna(UNKNOWN, ["line_end"])


@query("select id, case when contains(id, '::') then replace(split_part(id, '::', 1), '\\', '/') || substr(id, length(split_part(id, '::', 1)) + 1) else replace(id, '\\', '/') end as normal from (select entity_id as id from actions union select id from entities union select replace(id, '/', '\\') from entities) where id is not null")
def normalized_ids(spark: SparkSession, d: str) -> DataFrame:
    """All ids of the log and the graph, and the graph's written with backslashes, in one form."""
    ids = _e(spark, d).select("id")
    windows = ids.select(F.translate("id", "/", "\\").alias("id"))
    all_ids = _a(spark, d).select(F.col("entity_id").alias("id")).unionByName(ids).unionByName(windows).where("id is not null").distinct()
    return all_ids.select("id", paths.normalize_id(F.col("id")).alias("normal"))


@query(CURRENT + "select id, session_id, action_type, file_path from a where id = (select min(id) from actions)")
def get_action(spark: SparkSession, d: str) -> DataFrame:
    first = _a(spark, d).agg(F.min("id")).first()[0]
    return history.action_by_id(_a(spark, d), first).select("id", "session_id", "action_type", "file_path")


@query(CURRENT + f"select {SHOWN} from ce")
def entities_scan(spark: SparkSession, d: str) -> DataFrame:
    return current_entities(_e(spark, d), lookup.SHOWN).fillna(UNKNOWN, ["line_end"])


@query(CURRENT + "select src, dst from g")
def edges_scan(spark: SparkSession, d: str) -> DataFrame:
    return current_edges(_g(spark, d))


@query(CURRENT + f"select {SHOWN} from ce where id = '{CALLED}'")
def entity_by_id(spark: SparkSession, d: str) -> DataFrame:
    return lookup.entity_by_id(_e(spark, d), CALLED).fillna(UNKNOWN, ["line_end"])


@query(CURRENT + f"select {SHOWN} from ce where name = '{NAME}'")
def entity_by_name(spark: SparkSession, d: str) -> DataFrame:
    return lookup.entities_by_name(_e(spark, d), NAME).fillna(UNKNOWN, ["line_end"])


@query(CURRENT + f"select {SHOWN} from ce where file_path = '{FILE}'")
def entities_in_file(spark: SparkSession, d: str) -> DataFrame:
    return lookup.entities_in_file(_e(spark, d), FILE).fillna(UNKNOWN, ["line_end"])


@query(CURRENT + f"select {SHOWN} from ce where lower(language) = 'python'")
def entities_by_language(spark: SparkSession, d: str) -> DataFrame:
    return lookup.entities_by_language(_e(spark, d), "python").fillna(UNKNOWN, ["line_end"])


@query(CURRENT + f"select {SHOWN} from ce where entity_type = 'test_function'")
def all_tests(spark: SparkSession, d: str) -> DataFrame:
    return lookup.all_tests(_e(spark, d)).fillna(UNKNOWN, ["line_end"])


@query(CURRENT + f"select {SHOWN} from ce where id in (select src from g where dst = '{CALLED}')")
def callers(spark: SparkSession, d: str) -> DataFrame:
    return lookup.callers(_e(spark, d), _g(spark, d), CALLED).fillna(UNKNOWN, ["line_end"])


@query(CURRENT + f"select {SHOWN} from ce where id in (select dst from g where src = '{HUB}')")
def callees(spark: SparkSession, d: str) -> DataFrame:
    return lookup.callees(_e(spark, d), _g(spark, d), HUB).fillna(UNKNOWN, ["line_end"])


@query(CURRENT + "select src, dst from g where exists (select 1 from g h where h.src = g.dst and h.dst = g.src)")
def edge_exists(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose reverse is an edge as well."""
    edges = _g(spark, d)
    reversed_ = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return lookup.edges_that_exist(current_edges(reversed_), edges)


@query(CURRENT + "select src, dst from g where src in (select id from ce) and dst in (select id from ce)")
def dangling_edges_removed(spark: SparkSession, d: str) -> DataFrame:
    return lookup.without_dangling(_g(spark, d), _e(spark, d))


@query(CURRENT + "select id, name, file_path as file, entity_type as type, language as lang from ce")
def export_nodes(spark: SparkSession, d: str) -> DataFrame:
    return lookup.nodes_and_links(_e(spark, d), _g(spark, d))[0]


@query(CURRENT + "select src as source, dst as target from g where src in (select id from ce) and dst in (select id from ce)")
def export_nodes_links(spark: SparkSession, d: str) -> DataFrame:
    return lookup.nodes_and_links(_e(spark, d), _g(spark, d))[1]


# aggregates and indexes


@query(
    CURRENT
    + """select (select count(*) from ce) as n_entities, (select count(distinct file_path) from ce) as n_files,
  (select count(distinct language) from ce) as n_languages, (select count(*) from ce where entity_type = 'test_function') as n_tests,
  (select count(*) from g) as n_edges"""
)
def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    return lookup.graph_counts(_e(spark, d), _g(spark, d))


@query(CURRENT + "select file_path, count(*) as n, string_agg(id, ',' order by id) as ids from ce group by file_path")
def file_index(spark: SparkSession, d: str) -> DataFrame:
    return lookup.file_index(_e(spark, d))


@query(CURRENT + "select lower(language) as language, id from ce")
def language_index(spark: SparkSession, d: str) -> DataFrame:
    return lookup.language_index(_e(spark, d))


def _adjacency_sql(by: str, other: str) -> str:
    return (
        CURRENT
        + f"""select {by} as id, block_no, count(*) as n, string_agg({other}, ',' order by {other}) as neighbours from (
  select g.{by}, g.{other}, cast(('0x' || substr(md5(g.{other}), 1, 6))::bigint % ceil(t.n / {lookup.BLOCK}.0)::bigint as bigint) as block_no
  from g join (select {by}, count(*) as n from g group by {by}) t on t.{by} = g.{by}) group by all"""
    )


@query(_adjacency_sql("src", "dst"))
def adjacency_forward(spark: SparkSession, d: str) -> DataFrame:
    return lookup.adjacency(_g(spark, d), "src")


@query(_adjacency_sql("dst", "src"))
def adjacency_reverse(spark: SparkSession, d: str) -> DataFrame:
    return lookup.adjacency(_g(spark, d), "dst")


WHOLE = ", w as (select * from g where src in (select id from ce) and dst in (select id from ce))"


@query(
    CURRENT.rstrip()
    + WHOLE
    + " select id, count(*) as degree from (select src as id from w union all select dst from w) group by id order by degree desc, id limit 5"
)
def god_nodes(spark: SparkSession, d: str) -> DataFrame:
    return lookup.god_nodes(_e(spark, d), _g(spark, d))


@query(
    CURRENT.rstrip()
    + WHOLE
    + " select src, dst from w where split_part(src, '/', 2) <> split_part(dst, '/', 2) and split_part(src, '/', 2) <> '' and split_part(dst, '/', 2) <> '' order by src, dst limit 5"
)
def cross_module_edges(spark: SparkSession, d: str) -> DataFrame:
    """The first five, by the second segment of the ids."""
    return lookup.cross_module_edges(_e(spark, d), _g(spark, d))


@query(
    CURRENT.rstrip()
    + WHOLE
    + r""" select src, dst from w where regexp_replace(split_part(src, '::', 1), '/[^/]*$', '') <> regexp_replace(split_part(dst, '::', 1), '/[^/]*$', '')
  and regexp_replace(split_part(src, '::', 1), '/[^/]*$', '') <> '' and regexp_replace(split_part(dst, '::', 1), '/[^/]*$', '') <> ''"""
)
def cross_folder_edges(spark: SparkSession, d: str) -> DataFrame:
    """All edges between folders."""
    return lookup.cross_module_edges(_e(spark, d), _g(spark, d), n=None, by_folder=True)


@query(CURRENT + "select file_path, count(*) as n_entities from ce group by file_path order by n_entities desc, file_path limit 5")
def largest_files(spark: SparkSession, d: str) -> DataFrame:
    return lookup.largest_files(_e(spark, d))


# graph


def _bfs_sql(near: str, far: str, depth: int, start: str) -> str:
    steps = "".join(
        f""", l{i} as (select distinct {far} as id, {i} as depth from g where {near} in (select id from l{i - 1})
  and {far} not in ({" union all ".join(f"select id from l{j}" for j in range(i))}))"""
        for i in range(1, depth + 1)
    )
    start = f", l0 as (select id, 0 as depth from ({start}))"
    return CURRENT.rstrip() + start + steps + "".join(f"{' union all ' if i else ' '}select id, depth from l{i}" for i in range(depth + 1))


def _top_sql(by: str, n: int = 1) -> str:
    return f"select {by} as id from (select {by}, count(*) as n from g group by {by} order by n desc, {by} limit {n})"


@query(_bfs_sql("src", "dst", 3, _top_sql("src")))
def bfs_depth3(spark: SparkSession, d: str) -> DataFrame:
    """From the id with most callees."""
    edges = _g(spark, d)
    return graph.reach(edges, _most_calling(edges, "src"), 3)


@query(_bfs_sql("dst", "src", 3, _top_sql("dst")))
def reverse_bfs_depth3(spark: SparkSession, d: str) -> DataFrame:
    edges = _g(spark, d)
    return graph.reach(edges, _most_calling(edges, "dst"), 3, reverse=True)


@query(f"select * from ({_bfs_sql('src', 'dst', 2, _top_sql('src', 20))}) where depth > 0")
def dependency_chain(spark: SparkSession, d: str) -> DataFrame:
    """From the twenty ids with most callees, two calls deep."""
    edges = _g(spark, d)
    return graph.dependency_chain(edges, _most_calling(edges, "src", 20), 2)


def _paths_sql(depth: int) -> str:
    ends = f""", s as ({_top_sql("src", 3)}), t as ({_top_sql("dst", 8)}), ends as (select s.id as source, t.id as target from s join t on true),
  p0 as (select id as source, id, [id] as path from s)"""
    steps = "".join(
        f""", p{i} as (select source, dst as id, list_append(min(path), dst) as path from p{i - 1} join g on src = id
  where not exists (select 1 from ({" union all ".join(f"select source, id from p{j}" for j in range(i))}) v where v.source = p{i - 1}.source and v.id = dst)
  group by source, dst)"""
        for i in range(1, depth + 1)
    )
    union = " union all ".join(f"select * from p{i}" for i in range(depth + 1))
    return (
        CURRENT.rstrip()
        + ends
        + steps
        + f" select source, target, len(path) - 1 as hops, array_to_string(path, ' > ') as path from ends join ({union}) u using (source) where u.id = target"
    )


@query(_paths_sql(5))
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    """Between the three ids that call most and the eight called most."""
    edges = _g(spark, d)
    one = F.lit(1)
    sources = _most_calling(edges, "src", 3).select(F.col("id").alias("source"), one.alias("k"))
    targets = _most_calling(edges, "dst", 8).select(F.col("id").alias("target"), one.alias("k"))
    found = graph.shortest_paths(edges, sources.join(targets, "k").drop("k"))
    return found.withColumn("path", F.array_join("path", " > "))


def _closure_sql(start: str) -> str:
    return CURRENT_RECURSIVE.rstrip() + f", start as ({start}), r(id) as (select id from start union select g.src from r join g on g.dst = r.id)"


@query(
    _closure_sql(f"select id from ce where file_path = '{FILE}'")
    + f" select distinct file_path from ce where id in (select id from r) and file_path <> '{FILE}'"
)
def impact_subtree(spark: SparkSession, d: str) -> DataFrame:
    return graph.impact_of_file(_e(spark, d), _g(spark, d), FILE)


@query(
    _closure_sql(f"select '{CALLED}' as id")
    + f" select id, name, file_path, line_start, coalesce(line_end, -1) as line_end from ce where id in (select id from r) and id <> '{CALLED}' and entity_type = 'test_function'"
)
def tests_covering(spark: SparkSession, d: str) -> DataFrame:
    starts = spark.createDataFrame([(CALLED,)], "id string")
    return graph.tests_covering(_e(spark, d), _g(spark, d), starts).fillna(UNKNOWN, ["line_end"])


# scores

TOKENS = text.query_tokens(ASK)


def _share(x: str) -> str:
    return "((" + " + ".join(f"coalesce(contains(lower({x}), '{t}'), false)::int" for t in TOKENS) + f")::double / {len(TOKENS)}.0::double)"


def _any_name(xs: str) -> str:
    hit = " or ".join(f"contains(lower(split_part(x, '::', -1)), '{t}')" for t in TOKENS)
    return f"coalesce(len([x for x in {xs} if {hit}]) > 0, false)"


DISTANCE = f"""dist as (
  select id, case when {_share("name")} > 0 or {_share("file_path")} > 0 then 0
    when {_any_name("calls")} or {_any_name("called_by")} then 1
    when id in (select c.id from (select id, unnest(calls) as callee from ce) c join ce t on t.id = c.callee where {_any_name("t.calls")}) then 2
    end as distance from ce)"""
RECENT = """recent as (
  select file_path, greatest(0, (max(at_us) over () - at_us) // 1000000) as seconds from (
    select file_path, epoch_us(max(ts)) as at_us, arg_max(id, (ts, id)) as last_id from a where file_path is not null group by file_path order by at_us desc, last_id desc limit 50))"""
KEY_SCORE = f"greatest({_share(chr(115) + 'plit_part(id, ' + repr('::') + ', -1)')}, {_share('split_part(id, ' + repr('::') + ', 1)')})"
SCORED = f"""scored as (
  select ce.id, name, ce.file_path, distance, seconds, {KEY_SCORE.replace("split_part(id", "split_part(ce.id")} as key_score,
    0.4::double * greatest({_share("name")}, {_share("ce.file_path")})
    + 0.3::double * (case distance when 0 then 1.0 when 1 then 0.7 when 2 then 0.4 when 3 then 0.2 else 0.0 end)::double
    + 0.2::double * coalesce(pow(0.5::double, seconds / 3600.0::double), 0.0::double) + 0.1::double * {_share("docstring")} as score,
    case when {" or ".join(f"contains(lower(name), '{t}')" for t in [ASK, *ASK.split()])} then '{WHY["name"]}' || name
      when {" or ".join(f"contains(lower(ce.file_path), '{t}')" for t in [ASK, *ASK.split()])} then '{WHY["path"]}' || ce.file_path
      when distance = 1 then '{WHY["direct"]}'
      when distance > 1 then '{WHY["graph"]}' || distance || '{WHY["hops"]}'
      when seconds < 60 then '{WHY["now"]}'
      when seconds < 3600 then '{WHY["recent"]}' || seconds // 60 || '{WHY["minutes"]}'
      when seconds is not null then '{WHY["recent"]}' || seconds // 3600 || '{WHY["hours"]}'
      when contains(lower(docstring), '{ASK}') then '{WHY["docstring"]}"{ASK}"'
      else '{WHY["other"]}' end as reason
  from ce join dist using (id) left join recent on recent.file_path = ce.file_path)"""
SCORES = CURRENT.rstrip() + ", " + ", ".join([DISTANCE, RECENT, SCORED])
STALE = f""", stale as (
  select e.file_path from (select file_path, max(ts) as edited from a where action_type = 'file_edit' group by file_path) e
  join (select file_path, max(indexed_at) as indexed from entities group by file_path) i on i.file_path = e.file_path where edited > indexed)"""


@query(CURRENT + r"select id, array_to_string([lower(t) for t in regexp_split_to_array(name, '[\s_\-:./]') if strlen(lower(t)) >= 2], ',') as tokens from ce")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return current_entities(_e(spark, d), ["id", "name"]).select("id", F.array_join(text.tokenize(F.col("name")), ",").alias("tokens"))


@query(CURRENT + f"select id, {_share('name')} as score from ce")
def name_score(spark: SparkSession, d: str) -> DataFrame:
    return current_entities(_e(spark, d), ["id", "name"]).select("id", text.name_score(F.col("name"), ASK).alias("score"))


@query(CURRENT + f"select id, {_share('docstring')} as score from ce")
def docstring_score(spark: SparkSession, d: str) -> DataFrame:
    return current_entities(_e(spark, d), ["id", "docstring"]).select("id", text.docstring_score(F.col("docstring"), ASK).alias("score"))


@query(
    CURRENT
    + """select file_path, round(pow(0.5::double, greatest(0, ((select epoch_us(max(ts)) from a where file_path is not null) - epoch_us(max(ts))) // 1000000) / 3600.0::double), 6) as score
from a where file_path is not null group by file_path"""
)
def recency_score(spark: SparkSession, d: str) -> DataFrame:
    """Of every file in the log, as of its latest entry."""
    at = F.unix_micros(F.col("last_accessed").cast("timestamp"))
    files = history.file_access(_a(spark, d)).select("file_path", at.alias("at"), F.lit(1).alias("k"))
    latest = files.agg(F.max("at").alias("now")).withColumn("k", F.lit(1))
    score = text.recency_score(text.elapsed_seconds(F.col("now"), F.col("at")))
    return files.join(F.broadcast(latest), "k").select("file_path", F.round(score, 6).alias("score"))


@query(CURRENT.rstrip() + ", " + DISTANCE + " select id, coalesce(distance, -1) as distance from dist")
def approx_distance(spark: SparkSession, d: str) -> DataFrame:
    nodes = current_entities(_e(spark, d), ["id", "name", "file_path", "calls", "called_by"])
    return graph.approx_distance(nodes, ASK).fillna(UNKNOWN, ["distance"])


def _scored(spark: SparkSession, d: str) -> DataFrame:
    nodes = current_entities(_e(spark, d), ["id", "name", "file_path", "docstring", "calls", "called_by"])
    return rank.score_entities(nodes, ASK, rank.recency(_a(spark, d)))


@query(SCORES + " select id, round(score, 6) as score from scored")
def combined_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("id", F.round("score", 6).alias("score"))


@query(SCORES + " select id, reason from scored")
def reason(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("id", "reason")


PREFILTER = f"pre as (select id, {KEY_SCORE} as key_score from ce order by key_score desc, id limit {max(4 * K, 20)})"


@query(CURRENT.rstrip() + ", " + PREFILTER + " select id, key_score from pre")
def prefilter_topk(spark: SparkSession, d: str) -> DataFrame:
    return rank.prefilter(current_entities(_e(spark, d), ["id"]), ASK, K)


RANKED = (
    SCORES
    + ", "
    + PREFILTER
    + f"""{STALE}, files as (
  select file_path, max(score) as score, arg_max(reason, (score, -key_score, id)) as reason, count(*) as n_entities, string_agg(id, ',' order by id) as entities
  from scored where score > 0 {{only}} group by file_path order by max(score) desc, file_path limit {K})
select f.file_path, round(f.score, 6) as score, reason, n_entities, entities, case when s.file_path is null then null else '{rank.STALE}' end as stale_warning
from files f left join stale s on s.file_path = f.file_path"""
)


def _ranked(spark: SparkSession, d: str, use_prefilter: bool) -> DataFrame:
    stale = history.stale_files(_a(spark, d), _e(spark, d))
    found = rank.ranked_query(_e(spark, d), _a(spark, d), ASK, K, stale, use_prefilter=use_prefilter)
    return found.withColumns({"score": F.round("score", 6), "entities": F.array_join("entities", ",")})


@query(RANKED.replace("{only}", "and id in (select id from pre)"))
def query_ranked(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, True)


@query(RANKED.replace("{only}", ""))
def query_ranked_full(spark: SparkSession, d: str) -> DataFrame:
    """Without the prefilter: every entity is scored in full."""
    return _ranked(spark, d, False)


# history


@query(
    CURRENT
    + """select file_path, max(ts) as last_accessed, arg_max(id, (ts, id)) as last_id from a where file_path is not null and ts is not null
group by file_path order by last_accessed desc, last_id desc limit 50"""
)
def recent_files(spark: SparkSession, d: str) -> DataFrame:
    return history.recent_files(_a(spark, d), 50)


@query(
    CURRENT
    + """select file_path, count(*) as n_accesses, max(ts) as last_accessed from a where file_path is not null
group by file_path order by n_accesses desc, last_accessed desc, replace(file_path, '/', '|') limit 50"""
)
def frequent_files(spark: SparkSession, d: str) -> DataFrame:
    return history.frequent_files(_a(spark, d), 50)


@query(CURRENT + "select id, session_id, action_type, file_path, entity_id, ts, metadata from a where action_type = 'error' order by ts desc, id desc limit 50")
def recent_errors(spark: SparkSession, d: str) -> DataFrame:
    return history.recent_errors(_a(spark, d), 50)


@query(CURRENT + "select file_path, count(*) as n_accesses, max(ts) as last_accessed from a where file_path is not null group by file_path")
def file_access_counts(spark: SparkSession, d: str) -> DataFrame:
    return history.file_access(_a(spark, d))


@query(
    CURRENT
    + """select f.file_path, coalesce(x.n, 0) as n_accesses, x.last_accessed from (select distinct file_path from ce) f
left join (select file_path, count(*) as n, max(ts) as last_accessed from a group by file_path) x on x.file_path = f.file_path"""
)
def last_accessed(spark: SparkSession, d: str) -> DataFrame:
    """Of every indexed file, null if never."""
    files = current_entities(_e(spark, d), ["id", "file_path"]).select("file_path").distinct()
    return history.access_of(files, _a(spark, d))


@query("select count(distinct id) as n_actions from actions")
def total_actions(spark: SparkSession, d: str) -> DataFrame:
    return history.total_actions(_a(spark, d))


@query(CURRENT.rstrip() + STALE + " select file_path from stale")
def stale_files(spark: SparkSession, d: str) -> DataFrame:
    return history.stale_files(_a(spark, d), _e(spark, d))


@query(
    CURRENT.rstrip()
    + STALE
    + f""" select c.file_path, n_entities, case when s.file_path is null then null else '{rank.STALE}' end as stale_warning
from (select file_path, count(*) as n_entities from ce group by file_path) c left join stale s on s.file_path = c.file_path"""
)
def stale_join(spark: SparkSession, d: str) -> DataFrame:
    """Every file with its entities and, if it is stale, the warning."""
    files = current_entities(_e(spark, d), ["id", "file_path"]).groupBy("file_path").agg(F.count(F.lit(1)).alias("n_entities"))
    flagged = history.stale_files(_a(spark, d), _e(spark, d)).withColumn("stale_warning", F.lit(rank.STALE))
    return files.join(flagged, "file_path", "left")
