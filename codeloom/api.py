"""One object for the questions that people and tools ask of a code graph.

Each method returns a DataFrame; ``ask`` takes the short written forms; ``tool`` the named calls with
arguments that an assistant makes, and answers in text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.operators import graph, history, lookup, rank
from codeloom.sources.tables import load


class NotFound(ValueError):
    """An id that names no current entity."""


#: The tools by name, with their required and optional arguments.
TOOLS = {
    "query_graph": (["query"], ["top_k"]),
    "get_callers": (["entity_id"], []),
    "get_callees": (["entity_id"], []),
    "shortest_path": (["from", "to"], []),
    "explain_entity": (["entity_id"], []),
    "find_tests": ([], ["entity_id"]),
}
MOST_RESULTS, DEFAULT_RESULTS, DEFAULT_DEPTH = 20, 5, 3


class CodeGraph:
    def __init__(self, entities: DataFrame, edges: DataFrame, actions: DataFrame) -> None:
        self.entities, self.edges, self.actions = entities, edges, actions
        self.spark: SparkSession = entities.sparkSession

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> CodeGraph:
        """The tables of a folder."""
        return cls(*(load(spark, folder, t) for t in ("entities", "edges", "actions")))

    def _ids(self, *ids: str) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id string")

    def known_id(self, entity_id: str) -> str:
        """The id as given, or with `/` for `\\` in its path, whichever names an entity; as given if neither does."""
        path, mark, rest = entity_id.partition("::")
        other = path.replace("\\", "/") + mark + rest
        for i in dict.fromkeys((entity_id, other)):
            if not self.entity(i).isEmpty():
                return i
        return entity_id

    def entity(self, entity_id: str) -> DataFrame:
        return lookup.entity_by_id(self.entities, entity_id)

    def named(self, name: str) -> DataFrame:
        return lookup.entities_by_name(self.entities, name)

    def in_file(self, path: str) -> DataFrame:
        return lookup.entities_in_file(self.entities, path)

    def callers(self, entity_id: str) -> DataFrame:
        return lookup.callers(self.entities, self.edges, entity_id)

    def callees(self, entity_id: str) -> DataFrame:
        return lookup.callees(self.entities, self.edges, entity_id)

    def reach(self, entity_id: str, depth: int | None = DEFAULT_DEPTH, reverse: bool = False) -> DataFrame:
        return graph.reach(self.edges, self._ids(entity_id), depth, reverse)

    def dependencies(self, entity_id: str, depth: int = DEFAULT_DEPTH) -> DataFrame:
        return graph.dependency_chain(self.edges, self._ids(entity_id), depth)

    def path(self, source: str, target: str) -> list[str]:
        """A shortest call path of at most five hops, or nothing."""
        pair = self.spark.createDataFrame([(source, target)], "source string, target string")
        row = graph.shortest_paths(self.edges, pair).first()
        return list(row["path"]) if row else []

    def impact(self, path: str) -> DataFrame:
        return graph.impact_of_file(self.entities, self.edges, path)

    def tests(self, entity_id: str | None = None) -> DataFrame:
        """The tests that reach an entity, or all tests."""
        return graph.tests_covering(self.entities, self.edges, self._ids(entity_id)) if entity_id else lookup.all_tests(self.entities)

    def search(self, query: str, k: int = DEFAULT_RESULTS, use_prefilter: bool = True) -> DataFrame:
        stale = history.stale_files(self.actions, self.entities)
        return rank.ranked_query(self.entities, self.actions, query, k, stale, use_prefilter=use_prefilter)

    def ask(self, text: str, k: int = 10) -> DataFrame:
        """`callers ID`, `callees ID`, `file PATH`, `entity NAME`, `bfs ID [DEPTH]`, `reverse_bfs ID [DEPTH]`, `dependency_chain ID [DEPTH]`, else a search."""
        form, *rest = text.split() or [""]
        if form in ("callers", "callees") and len(rest) == 1:
            if self.entity(rest[0]).isEmpty():
                raise NotFound(rest[0])
            return getattr(self, form)(rest[0])
        if form == "file" and len(rest) == 1:
            return self.in_file(rest[0])
        if form == "entity" and len(rest) == 1:
            return self.named(rest[0])
        if form in ("bfs", "reverse_bfs", "dependency_chain") and len(rest) in (1, 2):
            depth = int(rest[1]) if len(rest) == 2 else DEFAULT_DEPTH
            if depth < 0:
                raise ValueError("a depth is 0 or more")
            return self.dependencies(rest[0], depth) if form == "dependency_chain" else self.reach(rest[0], depth, form == "reverse_bfs")
        return self.search(text, k)

    def tool(self, name: str, arguments: dict) -> str:
        """The answer of one of TOOLS as text."""
        if name not in TOOLS:
            raise ValueError(f"unknown tool: {name}")
        missing = [a for a in TOOLS[name][0] if not isinstance(arguments.get(a), str)]
        if missing:
            raise ValueError(f"{name} needs {', '.join(missing)}")
        if name == "query_graph":
            k = min(max(int(arguments.get("top_k", DEFAULT_RESULTS)), 1), MOST_RESULTS)
            found = self.search(arguments["query"], k).orderBy("score", ascending=False).collect()
            lines = [f"{n}. {r['file_path']} ({r['score']:.3f}): {r['reason']}" + (f" [{r['stale_warning']}]" if r["stale_warning"] else "") for n, r in enumerate(found, 1)]
        elif name == "shortest_path":
            lines = self.path(self.known_id(arguments["from"]), self.known_id(arguments["to"]))
        else:
            given = arguments.get("entity_id")
            i = self.known_id(given) if given else None
            found = {"get_callers": self.callers, "get_callees": self.callees, "explain_entity": self.entity, "find_tests": self.tests}[name](i)
            lines = [f"{r['id']} ({r['file_path']}:{r['line_start']}-{r['line_end']})" for r in found.orderBy("id").toLocalIterator()]
        return "\n".join(lines) if lines else f"nothing found by {name} {arguments}"
