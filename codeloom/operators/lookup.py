"""Lookups, neighbours, indexes and counts over the current entities and edges.

Filters on the looked-up key come before the history is reduced to current rows, so that they reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.sources.tables import current_edges, current_entities

SHOWN = ["id", "name", "entity_type", "file_path", "line_start", "line_end", "language"]
BLOCK, SALTS = 1000, 32


def entity_by_id(entities: DataFrame, entity_id: str) -> DataFrame:
    return current_entities(entities.where(F.col("id") == entity_id), SHOWN)


def entities_by_name(entities: DataFrame, name: str) -> DataFrame:
    """Exact and case-sensitive, ordered by id."""
    ids = entities.where(F.col("name") == name).select("id").distinct()
    return current_entities(entities.join(ids, "id", "left_semi"), SHOWN).where(F.col("name") == name).orderBy("id")


def entities_with_prefix(entities: DataFrame, prefix: str) -> DataFrame:
    """The current entities whose id begins with the prefix, ordered by id; the test reaches the scan."""
    return current_entities(entities.where(F.col("id").startswith(prefix)), SHOWN).orderBy("id")


def entities_in_file(entities: DataFrame, path: str) -> DataFrame:
    return current_entities(entities.where(F.col("file_path") == path), SHOWN)


def entities_by_language(entities: DataFrame, language: str) -> DataFrame:
    """The language compared in lower case, as it is now: an id counts by its last row."""
    return current_entities(entities, SHOWN).where(F.lower("language") == language.lower())


def all_tests(entities: DataFrame) -> DataFrame:
    return current_entities(entities, SHOWN).where("entity_type = 'test_function'").orderBy("id")


def callers(entities: DataFrame, edges: DataFrame, entity_id: str) -> DataFrame:
    """The current entities with a call to ``entity_id``; callers without entity are left out."""
    ids = edges.where((F.col("dst") == entity_id) & F.col("src").isNotNull()).select(F.col("src").alias("id")).distinct()
    return current_entities(entities.join(ids, "id", "left_semi"), SHOWN)


def callees(entities: DataFrame, edges: DataFrame, entity_id: str) -> DataFrame:
    ids = edges.where((F.col("src") == entity_id) & F.col("dst").isNotNull()).select(F.col("dst").alias("id")).distinct()
    return current_entities(entities.join(ids, "id", "left_semi"), SHOWN)


def edges_that_exist(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Of the (src, dst) pairs those that are edges."""
    known = current_edges(edges)
    return pairs.join(known, ["src", "dst"], "left_semi")


def without_dangling(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """The distinct edges with a current entity at both ends."""
    ids = current_entities(entities, ["id"])
    return (
        current_edges(edges)
        .join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
        .join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        .select("src", "dst")
    )


def graph_counts(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: entities, edges (dangling ones too), files, languages, tests."""
    nodes = current_entities(entities, ["id", "file_path", "language", "entity_type"])
    # (file, language) first: the distinct counts then see one row for each
    files = nodes.groupBy("file_path", "language").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("entity_type") == "test_function").alias("t")
    )
    counted = files.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_entities"),
        F.count_distinct("file_path").alias("n_files"),
        F.count_distinct("language").alias("n_languages"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("n_tests"),
    )
    links = current_edges(edges).agg(F.count(F.lit(1)).alias("n_edges"))
    return counted.withColumn("k", F.lit(1)).join(links.withColumn("k", F.lit(1)), "k").drop("k")


def file_index(entities: DataFrame) -> DataFrame:
    """(file_path, n, ids): the ids of each file in order; a file's entities bound the list."""
    return (
        current_entities(entities, ["id", "file_path"])
        .groupBy("file_path")
        .agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))
    )


def language_index(entities: DataFrame) -> DataFrame:
    """(language, id) rows: a language may hold most ids, so they are not gathered in one list."""
    return current_entities(entities, ["id", "language"]).select(F.lower("language").alias("language"), "id")


def adjacency(edges: DataFrame, by: str, block: int = BLOCK) -> DataFrame:
    """(id, block_no, n, neighbours): the neighbours of each id, in blocks of about ``block``.

    ``by`` is src for callees, dst for callers. A hub has many blocks, so no list and no task grows with it;
    neighbours are told apart by their md5. Only ids with more than one block are joined, each spread over
    SALTS rows, so that a hub's edges don't meet in one task before they have their blocks.
    """
    other = "dst" if by == "src" else "src"
    pairs = current_edges(edges)
    degree = pairs.groupBy(by).agg(F.count(F.lit(1)).alias("degree"))
    heavy = degree.where(F.col("degree") > block).select(F.col(by).alias("hub"), F.ceil(F.col("degree") / F.lit(block)).cast("long").alias("blocks"))
    heavy = heavy.withColumn("hub_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    place = F.conv(F.substring(F.md5(F.col(other).cast("binary")), 1, 6), 16, 10).cast("long")
    salt = F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")
    small = pairs.join(heavy, (F.col(by) == F.col("hub")) & (salt == F.col("hub_salt")), "left")
    small = small.withColumn("block_no", F.pmod(place, F.coalesce("blocks", F.lit(1).cast("long"))))
    return (
        small.groupBy(F.col(by).alias("id"), "block_no")
        .agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list(other)), ",").alias("neighbours"))
    )


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): calls in and out."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def god_nodes(entities: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    """The ids with most connections, dangling edges aside; ties by id."""
    return degrees(without_dangling(edges, entities)).orderBy(F.desc("degree"), "id").limit(n)


def second_segment(entity_id: Column) -> Column:
    return F.get(F.split(entity_id, "/"), F.lit(1))


def directory(entity_id: Column) -> Column:
    """The folder of an id's path."""
    return F.regexp_replace(F.substring_index(entity_id, "::", 1), r"/[^/]*$", "")


def cross_module_edges(entities: DataFrame, edges: DataFrame, n: int | None = 5, by_folder: bool = False) -> DataFrame:
    """Edges between modules: ends that differ in the second `/` segment of their ids, or (``by_folder``) in folder."""
    module = directory if by_folder else second_segment
    a, b = module(F.col("src")), module(F.col("dst"))
    found = without_dangling(edges, entities).where((a != b) & (a != "") & (b != ""))
    return found.orderBy("src", "dst").limit(n) if n is not None else found


def largest_files(entities: DataFrame, n: int = 5) -> DataFrame:
    counts = current_entities(entities, ["id", "file_path"]).groupBy("file_path").agg(F.count(F.lit(1)).alias("n_entities"))
    return counts.orderBy(F.desc("n_entities"), "file_path").limit(n)


def nodes_and_links(entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a graph view needs: (id, name, file, type, lang) and (source, target)."""
    nodes = current_entities(entities, ["id", "name", "file_path", "entity_type", "language"]).select(
        "id", "name", F.col("file_path").alias("file"), F.col("entity_type").alias("type"), F.col("language").alias("lang")
    )
    links = without_dangling(edges, entities).select(F.col("src").alias("source"), F.col("dst").alias("target"))
    return nodes, links
