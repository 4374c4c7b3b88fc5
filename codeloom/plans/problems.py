"""Queries of the general training-data problems (2 to 5), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import features, heavy_keys, orphans, runs
from codeloom.plans.base import CLEAN_ACTION, CLEAN_PATH, query
from codeloom.session import materialize
from codeloom.sources.tables import load

REFS_SQL = """
with refs as (
  select 'edges.src' as ref_field, src as ref_key, dst as neighbour from (select distinct edge_id, src, dst from edges)
  union all
  select 'edges.dst', dst, src from (select distinct edge_id, src, dst from edges)
  union all
  select 'entities.called_by', id, unnest(called_by) from (select distinct row_id, id, called_by from entities)
)"""


@query(
    REFS_SQL
    + """, n as (select ref_field, ref_key, count(*) as n_refs from refs group by all),
t as (select ref_field, sum(n_refs) as total from n group by all)
select ref_field, ref_key from n join t using (ref_field) where ref_key is not null and n_refs >= 0.02 * total"""
)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, entities = load(spark, sf_dir, "edges"), load(spark, sf_dir, "entities")
    references = heavy_keys.edge_references(edges).unionByName(heavy_keys.called_by_references(entities, each=False))
    counts = materialize(heavy_keys.key_counts(references))
    return heavy_keys.heavy_keys(counts).select("ref_field", "ref_key")


@query(
    REFS_SQL
    + """ select ref_field, ref_key, count(*) as n_refs, count(distinct neighbour) as n_neighbours,
  case when count(neighbour) < count(*) then null else min(neighbour) end as first_neighbour, max(neighbour) as last_neighbour
from refs group by all"""
)
def p2_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id with its references, different callers or callees, and the first and last of them."""
    edges, entities = load(spark, sf_dir, "edges"), load(spark, sf_dir, "entities")
    of_edges = heavy_keys.edge_references(edges).withColumn("at", F.lit(0))
    return heavy_keys.key_neighbours(of_edges.unionByName(heavy_keys.called_by_references(entities)))


ORPHANS_SQL = """
with refs as (
  select 'edges.src' as ref_field, recorded_at as t, edge_id as row_id, src as ref_id from edges
  union all select 'edges.dst', recorded_at, edge_id, dst from edges
  union all select * from (select 'entities.calls', indexed_at, row_id, unnest(calls) as c from entities) where contains(c, '::')
  union all select 'entities.called_by', indexed_at, row_id, unnest(called_by) from entities
), r as (select distinct ref_field, strftime(t, '%Y-%m') as period, row_id, ref_id, t from refs where ref_id is not null),
lives as (select distinct id, indexed_at, deleted_at from entities),
found as (
  select ref_field, period, row_id, ref_id from r where not exists (
    select 1 from lives l where l.id = r.ref_id and l.indexed_at <= r.t and (l.deleted_at is null or l.deleted_at > r.t))
)"""


def _orphans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges, entities = load(spark, sf_dir, "edges"), load(spark, sf_dir, "entities")
    references = orphans.all_references(entities, edges)
    return references, orphans.orphan_references(references, orphans.live_ranges(entities))


@query(ORPHANS_SQL + " select distinct ref_field, period, row_id, ref_id from found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = _orphans(spark, sf_dir)
    return found.select("ref_field", orphans.period_of(F.col("at")).alias("period"), "row_id", "ref_id")


@query(
    ORPHANS_SQL
    + """ select ref_field, period, count(*) as n_orphans, count(distinct ref_id) as n_ids
from found group by all"""
)
def p3_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orphans per field and month, and how many different ids they name."""
    _, found = _orphans(spark, sf_dir)
    month = found.select("ref_field", orphans.period_of(F.col("at")).alias("period"), "ref_id")
    # counted per id first: a missing id that holds most orphans is one row per map task after that
    per_id = month.groupBy("ref_field", "period", "ref_id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.groupBy("ref_field", "period").agg(F.sum("n").alias("n_orphans"), F.count(F.lit(1)).alias("n_ids"))


FEATURES_SQL = f"""
with v as (
  select * from actions where id is not null and file_path is not null and ts is not null
  qualify row_number() over (partition by id order by logged_at desc) = 1
), e as (
  select {CLEAN_PATH} as file_path, {CLEAN_ACTION} as action_type, tool, epoch_us(ts) as at_us, duration_ms from v
), s as (
  select file_path, action_type, tool, count(*) as n, coalesce(sum(duration_ms), 0)::bigint as total_ms, max(at_us) as last_at from e group by all
), a as (select max(epoch_us(ts)) as as_of from actions)
"""


def _state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The state kept by deltas: every action as it was delivered first, then all later deliveries as changes (-1 and +1)."""
    actions = load(spark, sf_dir, "actions")
    as_of = actions.select(F.max(features.micros(F.col("ts")))).first()[0]
    both = materialize(features.deliveries(features.feature_events(actions)))
    known = both.select("id", "first.*")
    deltas = materialize(features.redeliveries(both))
    return features.apply_deltas(features.initial_state(known), known, deltas), as_of or 0


@query(
    FEATURES_SQL
    + """ select file_path, sum(n)::bigint as n_actions, count(*) as n_pairs, sum(total_ms)::bigint as total_ms, max(as_of) - max(last_at) as since_us,
  string_agg(coalesce(action_type, '') || '|' || coalesce(tool, '') || '|' || n || '|' || (as_of - last_at) || '|' || total_ms, ';'
    order by action_type nulls first, tool nulls first) as features
from s, a group by file_path"""
)
def p4_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per file; ``features`` lists action_type|tool|count|microseconds since the last|total ms."""
    state, as_of = _state(spark, sf_dir)
    text = F.transform(
        "features",
        lambda x: F.concat_ws("|", F.coalesce(x["action_type"], F.lit("")), F.coalesce(x["tool"], F.lit("")), x["n"], x["since_us"], x["total_ms"]),
    )
    return features.feature_rows(state, as_of).withColumn("features", F.array_join(text, ";"))


@query(FEATURES_SQL + " select file_path, action_type, tool, n, total_ms, as_of - last_at as since_us from s, a")
def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in long form: a row for each file, action type and tool."""
    state, as_of = _state(spark, sf_dir)
    return state.select(*features.PAIR, "n", "total_ms", (F.lit(as_of) - F.col("last_at")).alias("since_us"))


RUNS_SQL = f"""
with d as (select * from actions qualify row_number() over (partition by id order by logged_at) = 1),
c as (select session_id, id, ts, duration_ms, {CLEAN_ACTION} as action_type, {CLEAN_PATH} as file_path from d),
l as (
  select *, case when file_path is not null and lag(file_path) over w = file_path and lag(action_type) over w is not distinct from action_type
    then 0 else 1 end as fresh
  from c window w as (partition by session_id order by ts, id)
), g as (select *, sum(fresh) over (partition by session_id order by ts, id) as run_no from l),
runs as (
  select session_id, action_type, file_path, arg_min(id, (ts, id)) as first_id, arg_max(id, (ts, id)) as last_id, min(ts) as first_ts,
    max(ts) as last_ts, count(*) as n_actions, max(epoch_us(ts)) - min(epoch_us(ts)) as span_us, coalesce(sum(duration_ms), 0)::bigint as total_ms
  from g group by session_id, run_no, action_type, file_path
)"""


@query(RUNS_SQL + " select session_id, first_id, last_id from runs where n_actions >= 2")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    collapsed = runs.collapse_runs(load(spark, sf_dir, "actions"))
    return runs.repeated_runs(collapsed).select("session_id", "first_id", "last_id")


@query(RUNS_SQL + " select * from runs")
def p5_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session with its runs as one row each and all other actions as they are."""
    return runs.collapse_runs(load(spark, sf_dir, "actions"))
