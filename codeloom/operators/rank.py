"""Ranked retrieval of files for a natural-language query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text
from codeloom.functions.paths import id_name, id_path
from codeloom.operators import history
from codeloom.operators.graph import approx_distance
from codeloom.operators.orphans import micros
from codeloom.session import materialize
from codeloom.sources.tables import current_entities

RECENT_FILES = 50
#: Fixed value: the warning beside files that changed after they were indexed.
STALE = "File has pending changes -re-indexing in progress"


def recency(actions: DataFrame, as_of_us: int | None = None) -> DataFrame:
    """(file_path, seconds) of the RECENT_FILES files accessed last, counted from ``as_of_us`` or from the latest of them."""
    recent = history.recent_files(actions, RECENT_FILES).select("file_path", micros(F.col("last_accessed")).alias("at"))
    if as_of_us is None:
        latest = recent.agg(F.max("at").alias("now"))
        recent = recent.withColumn("k", F.lit(1)).join(F.broadcast(latest.withColumn("k", F.lit(1))), "k").drop("k")
        now = F.col("now")
    else:
        now = F.lit(as_of_us)
    return recent.select("file_path", text.elapsed_seconds(now, F.col("at")).alias("seconds"))


def key_score(query: str):
    """The better of the two name scores that an id alone gives."""
    return F.greatest(text.name_score(id_name(F.col("id")), query), text.name_score(id_path(F.col("id")), query))


def prefilter(nodes: DataFrame, query: str, k: int) -> DataFrame:
    """(id, key_score): the max(4k, 20) entities whose id scores best by name or path; ties by id."""
    return nodes.select("id", key_score(query).alias("key_score")).orderBy(F.desc("key_score"), "id").limit(max(4 * k, 20))


def score_entities(nodes: DataFrame, query: str, recent: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Each entity, or each of ``chosen`` (id), with its signals, combined score and reason."""
    asked = nodes.join(F.broadcast(chosen.select("id")), "id", "left_semi") if chosen is not None else nodes
    asked = asked.select("id", "name", "file_path", "docstring")
    distance = approx_distance(nodes, query, chosen)
    scored = asked.join(distance, "id").join(F.broadcast(recent), "file_path", "left")  # at most RECENT_FILES rows
    return scored.select(
        "id",
        "name",
        "file_path",
        "distance",
        "seconds",
        key_score(query).alias("key_score"),
        text.combined_score(
            text.name_score(F.col("name"), query),
            text.name_score(F.col("file_path"), query),
            text.graph_score(F.col("distance")),
            text.recency_score(F.col("seconds")),
            text.docstring_score(F.col("docstring"), query),
        ).alias("score"),
        text.reason(F.col("name"), F.col("file_path"), F.col("docstring"), F.col("distance"), F.col("seconds"), query).alias("reason"),
    )


def rank_files(scored: DataFrame, k: int) -> DataFrame:
    """(file_path, score, reason, n_entities, entities): files by their best entity.

    Of equally good entities the last in prefilter order (key score falling, then id) gives the reason.
    """
    return (
        scored.groupBy("file_path")
        .agg(
            F.max("score").alias("score"),
            F.max_by("reason", F.struct(F.col("score"), -F.col("key_score"), F.col("id"))).alias("reason"),
            F.count(F.lit(1)).alias("n_entities"),
            F.array_sort(F.collect_list("id")).alias("entities"),
        )
        .orderBy(F.desc("score"), "file_path")
        .limit(k)
    )


def ranked_query(entities: DataFrame, actions: DataFrame, query: str, k: int, stale: DataFrame | None = None, as_of_us: int | None = None, use_prefilter: bool = True) -> DataFrame:
    """The k files that answer a query best: (file_path, score, reason, n_entities, entities, stale_warning).

    A blank query or k of 0 gives no rows. With ``use_prefilter`` only entities that do well by id are scored
    in full, so a documentation-only match can be missed; without it all are.
    """
    query, columns = query.strip(), ["id", "name", "file_path", "docstring", "calls", "called_by"]
    chosen = None
    if not query or k <= 0:
        nodes, k = current_entities(entities.where("false"), columns), 0
    elif use_prefilter:
        # ids alone choose the candidates; the other columns are read for these and what they call
        chosen = materialize(prefilter(current_entities(entities, ["id"]), query, k))
        asked = current_entities(entities.join(F.broadcast(chosen.select("id")), "id", "left_semi"), ["id", "calls"])
        around = asked.select(F.explode(F.concat(F.array("id"), F.coalesce("calls", F.array().cast("array<string>")))).alias("id"))
        nodes = materialize(current_entities(entities.join(around.distinct(), "id", "left_semi"), columns))
    else:
        nodes = materialize(current_entities(entities, columns))
    scored = score_entities(nodes, query, recency(actions, as_of_us), chosen).where("score > 0")
    ranked = rank_files(scored, k)
    if stale is None:
        return ranked.withColumn("stale_warning", F.lit(None).cast("string"))
    flagged = stale.select("file_path", F.lit(STALE).alias("stale_warning"))
    return ranked.join(flagged, "file_path", "left")
