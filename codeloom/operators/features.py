"""A feature row per file from the action log, kept up to date by signed deltas (problem 4).

Method: the state has, for each (file, action type, tool), the count, the total duration and the latest
time. New actions are inserts (+1); an action delivered again or changed retracts (-1) the version it had
before. Counts and totals add up. A maximum is recomputed from the log only where a retraction reaches the
latest event, and there only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paths import clean_action, clean_path
from codeloom.operators.orphans import micros
from codeloom.session import materialize

PAIR = ["file_path", "action_type", "tool"]


def feature_events(actions: DataFrame) -> DataFrame:
    """(id, logged_us, file_path, action_type, tool, at, duration_ms), spellings cleaned; rows without id, file or ts are left out."""
    return actions.where("id is not null and file_path is not null and ts is not null").select(
        "id",
        micros(F.col("logged_at")).alias("logged_us"),
        clean_path(F.col("file_path")).alias("file_path"),
        clean_action(F.col("action_type")).alias("action_type"),
        "tool",
        micros(F.col("ts")).alias("at"),
        "duration_ms",
    )


def deliveries(events: DataFrame) -> DataFrame:
    """(id, first, last): of each id the version delivered first, and the last one if it is another.

    A null logged_us is before all others. Versions in between are inserted and retracted again, so they change
    nothing. One aggregation with map-side combine.
    """
    rest = F.struct(*[c for c in events.columns if c != "id"])
    both = events.groupBy("id").agg(F.min(rest).alias("first"), F.max(rest).alias("last"))
    return both.withColumn("last", F.when(F.col("first") < F.col("last"), F.col("last")))


def redeliveries(both: DataFrame) -> DataFrame:
    """signed_deltas of what was delivered again, from deliveries(): the versions stand side by side, so nothing is joined."""
    signed = F.array(F.struct(F.col("first").alias("v"), F.lit(-1).alias("sign")), F.struct(F.col("last").alias("v"), F.lit(1).alias("sign")))
    return both.where("last is not null").select("id", F.explode(signed).alias("d")).select("id", "d.v.*", "d.sign")


def last_versions(events: DataFrame) -> DataFrame:
    """Of each id the version delivered last; equal versions fall together."""
    rest = [c for c in events.columns if c != "id"]
    return events.groupBy("id").agg(F.max(F.struct(*rest)).alias("v")).select("id", "v.*")


def initial_state(versions: DataFrame) -> DataFrame:
    """(file, action type, tool, n, total_ms, last_at). Null durations add nothing; null types and tools are values of their own."""
    return versions.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).cast("long").alias("total_ms"),
        F.max("at").alias("last_at"),
    )


def signed_deltas(known: DataFrame, arrived: DataFrame) -> DataFrame:
    """The changes from ``known`` (last versions so far) by ``arrived`` (later deliveries): +1 rows and -1 rows.

    A version that only came again unchanged still retracts and inserts, as its content isn't compared.
    An arrival older than the known version changes nothing; a null logged_us is older than all others. Only the
    known versions of ids that arrive again are joined.
    """
    new = last_versions(arrived)
    rest = [c for c in known.columns if c != "id"]
    before = known.join(new.select("id"), "id", "left_semi").select("id", F.struct(*rest).alias("old"))
    both = new.select("id", F.struct(*rest).alias("new")).join(before, "id", "left")
    both = both.where(F.col("old").isNull() | (F.col("old") < F.col("new")))
    signed = F.explode(
        F.filter(
            F.array(F.struct(F.col("old").alias("v"), F.lit(-1).alias("sign")), F.struct(F.col("new").alias("v"), F.lit(1).alias("sign"))),
            lambda x: x["v"].isNotNull(),
        )
    )
    return both.select("id", signed.alias("d")).select("id", "d.v.*", "d.sign")


def apply_deltas(state: DataFrame, known: DataFrame, deltas: DataFrame) -> DataFrame:
    """The state after ``deltas``; ``known`` are the versions behind ``state``, read again only for affected maxima.

    Triples whose count falls to 0 disappear. Repeated inserts of one id must have been settled by
    signed_deltas. ``deltas`` is read several times and should be materialised.
    """
    inserted = F.col("sign") > 0
    change = deltas.groupBy(*PAIR).agg(
        F.sum("sign").alias("dn"),
        F.coalesce(F.sum(F.col("duration_ms") * F.col("sign")), F.lit(0)).cast("long").alias("dms"),
        F.max(F.when(inserted, F.col("at"))).alias("in_at"),
        F.max(F.when(~inserted, F.col("at"))).alias("out_at"),
    )
    on = [state[c].eqNullSafe(change[c]) for c in PAIR]
    keys = [F.coalesce(state[c], change[c]).alias(c) for c in PAIR]
    moved = state.join(change, on, "full").select(
        *keys,
        (F.coalesce("n", F.lit(0)) + F.coalesce("dn", F.lit(0))).alias("n"),
        (F.coalesce("total_ms", F.lit(0)) + F.coalesce("dms", F.lit(0))).alias("total_ms"),
        F.greatest("last_at", "in_at").alias("last_at"),
        # a retraction at the latest event, not covered by a later insert
        F.coalesce((F.col("out_at") >= F.col("last_at")) & (F.coalesce("in_at", F.lit(-(2**62))) < F.col("out_at")), F.lit(False)).alias("reached"),
    )
    moved = materialize(moved.where("n > 0"))
    # written, so that its size is known: mostly nothing or little, and the versions then stay where they are
    affected = materialize(moved.where("reached").select(*[F.col(c).alias(f"k_{c}") for c in PAIR]))
    match = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in PAIR]
    gone = deltas.where("sign < 0").select("id")
    again = known.join(affected, match, "left_semi").join(gone, "id", "left_anti").select(*PAIR, "at")
    again = again.unionByName(deltas.where("sign > 0").join(affected, match, "left_semi").select(*PAIR, "at"))
    latest = again.groupBy(*PAIR).agg(F.max("at").alias("last_at"))
    names = [*PAIR, "n", "total_ms", "last_at"]
    settled = moved.where("reached").drop("last_at")
    on = [settled[c].eqNullSafe(latest[c]) for c in PAIR]
    settled = settled.join(latest, on).select(*[settled[c] for c in PAIR], "n", "total_ms", latest["last_at"])
    return moved.where("not reached").select(names).unionByName(settled.select(names))


def feature_rows(state: DataFrame, as_of: int) -> DataFrame:
    """One row per file: totals over all, and ``features``, sorted structs (action_type, tool, n, since_us, total_ms).

    ``as_of``: microseconds since 1970 from which the time since the last action counts. The number of
    pairs, not of actions, bounds the gathered group.
    """
    pair = F.struct("action_type", "tool", "n", (F.lit(as_of) - F.col("last_at")).alias("since_us"), "total_ms")
    return state.groupBy("file_path").agg(
        F.sum("n").alias("n_actions"),
        F.count(F.lit(1)).alias("n_pairs"),
        F.sum("total_ms").alias("total_ms"),
        (F.lit(as_of) - F.max("last_at")).alias("since_us"),
        F.array_sort(F.collect_list(pair)).alias("features"),
    )


def feature_columns(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``rows`` with three columns for each given (action_type, tool): n__, since_us__, total_ms__ (0, null, 0 where absent)."""
    by_pair = F.map_from_entries(
        F.transform(
            "features",
            lambda x: F.struct(F.concat_ws("\u0001", x["action_type"], x["tool"]), F.struct(x["n"], x["since_us"], x["total_ms"])),
        )
    )
    out = rows.withColumn("by_pair", by_pair)
    made = {}
    for action, tool in pairs:
        at = F.try_element_at(F.col("by_pair"), F.lit(f"{action}\u0001{tool}"))
        made[f"n__{action}__{tool}"] = F.coalesce(at["n"], F.lit(0))
        made[f"since_us__{action}__{tool}"] = at["since_us"]
        made[f"total_ms__{action}__{tool}"] = F.coalesce(at["total_ms"], F.lit(0))
    return out.withColumns(made).drop("by_pair", "features")
