"""Reachability, shortest paths, impact and coverage over call edges.

One loop serves them all: a frontier of new ids is joined with the edges, and what was visited before is
dropped. Each round's frontier is written to the shared folder, so lineage stays short, the size of the
next join side is known to the optimiser (it broadcasts small frontiers, and shuffles large ones), and the
test for the end reads a file's footer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paths import id_name
from codeloom.functions.text import name_score, query_tokens
from codeloom.session import discard, materialize
from codeloom.sources.tables import current_entities

COMPACT_EVERY = 8


def reach(edges: DataFrame, starts: DataFrame, depth: int | None = None, reverse: bool = False) -> DataFrame:
    """(id, depth): everything reachable from the ids in ``starts``, themselves at depth 0, each id once.

    Unknown starts and ends without entity are kept; null ends are no edges; cycles end; ``depth`` None
    means until nothing is new. Repeated edges and starts change nothing.
    """
    near, far = ("dst", "src") if reverse else ("src", "dst")
    links = edges.where("src is not null and dst is not null").select(F.col(near).alias("id"), F.col(far).alias("next"))
    if depth is None or depth > 2:
        links = materialize(links.distinct())
    frontier = materialize(starts.select("id").where("id is not null").distinct().withColumn("depth", F.lit(0)))
    visited, level = frontier, 0
    while depth is None or level < depth:
        level += 1
        found = links.join(frontier.select("id"), "id").select(F.col("next").alias("id")).distinct()
        frontier = materialize(found.join(visited.select("id"), "id", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
        if level % COMPACT_EVERY == 0:
            visited = materialize(visited)
    return visited


def dependency_chain(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """What the starts call, directly or not, without the starts."""
    return reach(edges, starts, depth).join(starts.select("id"), "id", "left_anti")


def shortest_paths(edges: DataFrame, ends: DataFrame, depth: int = 5) -> DataFrame:
    """(source, target, hops, path): for each (source, target) a shortest call path of at most ``depth`` hops.

    Of equally short paths the first in the order of their ids. A source that is its target has the path of
    itself; pairs without a path give no row. All sources advance together; a pair leaves when it is found.
    """
    links = materialize(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    ends = materialize(ends.select("source", "target").where("source is not null and target is not null").distinct())
    found = ends.where("source = target").select("source", "target", F.array("source").alias("path"))
    frontier = ends.where("source <> target").select("source", F.col("source").alias("id"), F.array("source").alias("path")).distinct()
    frontier, visited = materialize(frontier), None
    open_pairs = ends.where("source <> target")
    for _ in range(depth):
        visited = frontier.select("source", "id") if visited is None else visited.unionByName(frontier.select("source", "id"))
        step = links.join(frontier, links["src"] == frontier["id"]).groupBy("source", F.col("dst").alias("id")).agg(F.min("path").alias("path"))
        step = step.join(visited, ["source", "id"], "left_anti").select("source", "id", F.array_append("path", F.col("id")).alias("path"))
        step = materialize(step)
        hit = step.join(open_pairs.withColumnRenamed("target", "id"), ["source", "id"])
        found = found.unionByName(hit.select("source", F.col("id").alias("target"), "path"))
        open_pairs = materialize(open_pairs.join(step.select("source", F.col("id").alias("target")), ["source", "target"], "left_anti"))
        if open_pairs.isEmpty():
            break
        frontier = step.join(open_pairs.select("source").distinct(), "source", "left_semi")
    return found.select("source", "target", (F.size("path") - 1).alias("hops"), "path")


def impact_of_file(entities: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """(file_path): other files with an entity that calls into the file, directly or not."""
    starts = current_entities(entities.where(F.col("file_path") == path), ["id"])
    ids = reach(edges, starts, reverse=True).select("id")
    files = current_entities(entities, ["id", "file_path"]).join(ids, "id", "left_semi")
    return files.where(F.col("file_path") != path).select("file_path").distinct()


def tests_covering(entities: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """The test functions that call one of the starts, directly or not; the starts themselves aside."""
    ids = reach(edges, starts, reverse=True).where("depth > 0").select("id")
    shown = ["id", "name", "file_path", "line_start", "line_end", "entity_type"]
    tests = current_entities(entities, shown).where("entity_type = 'test_function'")
    return tests.join(ids, "id", "left_semi").drop("entity_type").orderBy("id")


def any_name_matches(ids: Column, query: str) -> Column:
    """Whether the last `::` part of any of the ids contains a token of the query."""
    tokens = query_tokens(query)
    if not tokens:
        return F.lit(False)

    def match(x: Column) -> Column:
        name = F.lower(id_name(x))
        out = F.contains(name, F.lit(tokens[0]))
        for t in tokens[1:]:
            out = out | F.contains(name, F.lit(t))
        return out

    return F.coalesce(F.exists(ids, match), F.lit(False))


def approx_distance(nodes: DataFrame, query: str, candidates: DataFrame | None = None) -> DataFrame:
    """(id, distance): calls between an entity and one that the query names, 0 to 2, null beyond.

    0: its own name or path matches; 1: a name in its calls or called_by; 2: a name in the calls of one it
    calls. ``nodes`` (id, name, file_path, calls, called_by); with ``candidates`` (id) only those are answered.
    """
    own = (name_score(F.col("name"), query) > 0) | (name_score(F.col("file_path"), query) > 0)
    direct = any_name_matches(F.col("calls"), query) | any_name_matches(F.col("called_by"), query)
    flagged = nodes.where(any_name_matches(F.col("calls"), query)).select(F.col("id").alias("callee"))
    asked = nodes.join(candidates.select("id"), "id", "left_semi") if candidates is not None else nodes
    second = asked.select("id", F.explode("calls").alias("callee")).join(flagged, "callee", "left_semi").select("id").distinct()
    return (
        asked.select("id", own.alias("own"), direct.alias("direct"))
        .join(second.withColumn("second", F.lit(True)), "id", "left")
        .select("id", F.when(F.col("own"), 0).when(F.col("direct"), 1).when(F.col("second"), 2).alias("distance"))
    )


def components(links: DataFrame) -> DataFrame:
    """(id, component): connected components of undirected links (a, b); component is its least id.

    Rounds of two star steps: each id hands its larger neighbours, then its smaller ones, to the least it
    knows. The least ids come from a grouped minimum and a join, so no list is built at a hub. The rounds end
    when a checksum of the links stands still, after about as many as the log of the longest path.
    """

    def checksum(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges)
    before = checksum(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, materialize(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
        discard(last)
        now = checksum(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
