"""Traversal, ranking and history on small graphs."""

import random

import pytest

from codeloom.functions import text
from codeloom.operators import graph, history, lookup, rank

BATCH, GLAZE, MIX, TEST, WEDGE = "src/batch.rs::batch", "src/kiln.rs::glaze_bowl", "src/kiln.rs::mix_clay", "tests/kiln_test.rs::test_glaze", "tests/kiln_test.rs::wedge_clay"


@pytest.fixture(scope="module")
def code(make_entities, make_edges):
    entities = make_entities(
        [
            {"id": BATCH, "docstring": "Fires all that is waiting", "calls": [GLAZE]},
            {"id": GLAZE, "docstring": "Glazes a bowl by its recipe", "calls": [MIX], "called_by": [BATCH]},
            {"id": MIX, "called_by": [GLAZE]},
            {"id": TEST, "entity_type": "test_function", "calls": [GLAZE]},
            {"id": WEDGE},
        ]
    )
    return entities, make_edges([(BATCH, GLAZE), (GLAZE, MIX), (TEST, GLAZE), (BATCH, GLAZE)])


def start(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def ids(df):
    return {r["id"] for r in df.select("id").collect()}


def test_reach(spark, code):
    _, edges = code
    assert ids(graph.reach(edges, start(spark, BATCH), 1)) == {BATCH, GLAZE}
    assert ids(graph.reach(edges, start(spark, BATCH), 2)) == {BATCH, GLAZE, MIX}
    assert ids(graph.reach(edges, start(spark, MIX), 2, reverse=True)) == {MIX, GLAZE, BATCH, TEST}
    assert ids(graph.dependency_chain(edges, start(spark, BATCH), 2)) == {GLAZE, MIX}
    assert ids(graph.reach(edges, start(spark, "unknown"), 3)) == {"unknown"}
    assert graph.reach(edges, start(spark), None).count() == 0


def test_reach_like_a_loop_with_cycles(spark, make_edges):
    rng = random.Random(4)
    pairs = [(f"n{rng.randint(0, 25)}", f"n{rng.randint(0, 25)}") for _ in range(45)] + [("n0", None), (None, "n1")]
    depth, level = {"n0": 0}, 0
    while True:
        level += 1
        new = {b for a, b in pairs if a in depth and b and b not in depth}
        if not new:
            break
        depth |= dict.fromkeys(new, level)
    got = {r["id"]: r["depth"] for r in graph.reach(make_edges(pairs), start(spark, "n0")).collect()}
    assert got == depth


def test_paths(spark, code):
    _, edges = code
    pairs = spark.createDataFrame([(BATCH, MIX), (MIX, BATCH), ("x", "x"), (TEST, MIX)], "source string, target string")
    got = {(r["source"], r["target"]): r["path"] for r in graph.shortest_paths(edges, pairs).collect()}
    assert got == {(BATCH, MIX): [BATCH, GLAZE, MIX], ("x", "x"): ["x"], (TEST, MIX): [TEST, GLAZE, MIX]}


def test_paths_end_at_the_limit_and_break_ties_by_id(spark, make_edges):
    edges = make_edges([("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), *[(f"k{i}", f"k{i + 1}") for i in range(7)]])
    pairs = spark.createDataFrame([("a", "d"), ("k0", "k5"), ("k0", "k6")], "source string, target string")
    got = {r["target"]: r["path"] for r in graph.shortest_paths(edges, pairs).collect()}
    assert got["d"] == ["a", "b", "d"] and len(got["k5"]) == 6 and "k6" not in got


def test_impact_and_tests(spark, code, make_entities, make_edges):
    entities, edges = code
    assert {r[0] for r in graph.impact_of_file(entities, edges, "src/kiln.rs").collect()} == {"src/batch.rs", "tests/kiln_test.rs"}
    assert ids(graph.tests_covering(entities, edges, start(spark, MIX))) == {TEST}
    assert ids(graph.tests_covering(entities, edges, start(spark, BATCH))) == set()
    chain = ["deep.rs::test_deep", *[f"deep.rs::{c}" for c in "abcdef"], "deep.rs::target"]
    deep = make_entities([{"id": c, "entity_type": "test_function" if "test" in c else "function"} for c in chain])
    assert ids(graph.tests_covering(deep, make_edges(list(zip(chain, chain[1:]))), start(spark, "deep.rs::target"))) == {chain[0]}


def test_lookups(spark, code):
    entities, edges = code
    assert ids(lookup.callers(entities, edges, GLAZE)) == {BATCH, TEST} and ids(lookup.callees(entities, edges, GLAZE)) == {MIX}
    assert lookup.entity_by_id(entities, "no").count() == 0
    assert ids(lookup.entities_in_file(entities, "src/kiln.rs")) == {GLAZE, MIX}
    assert ids(lookup.entities_by_name(entities, "batch")) == {BATCH} and ids(lookup.entities_by_language(entities, "RUST")) == {BATCH, GLAZE, MIX, TEST, WEDGE}
    pairs = spark.createDataFrame([(BATCH, GLAZE), (GLAZE, BATCH)], "src string, dst string")
    assert lookup.edges_that_exist(pairs, edges).count() == 1
    counts = lookup.graph_counts(entities, edges).first()
    assert (counts["n_entities"], counts["n_edges"], counts["n_files"], counts["n_tests"]) == (5, 3, 3, 1)
    assert lookup.god_nodes(entities, edges).first()["id"] == GLAZE


def test_current_rows(make_entities, at):
    rows = make_entities(
        [
            {"id": "a::f", "row_id": 1, "line_start": 1},
            {"id": "a::f", "row_id": 2, "indexed_at": at(5), "line_start": 9},
            {"id": "a::f", "row_id": 2, "indexed_at": at(5), "line_start": 9},
            {"id": "a::g", "row_id": 3, "deleted_at": at(1)},
            {"id": "a::h", "row_id": 4, "deleted_at": at(1)},
            {"id": "a::h", "row_id": 5, "indexed_at": at(9)},
        ]
    )
    got = lookup.current_entities(rows, ["id", "line_start"])
    assert {(r["id"], r["line_start"]) for r in got.collect()} == {("a::f", 9), ("a::h", 1)}


def test_adjacency_blocks(spark, make_edges):
    edges = make_edges([("hub", f"n{i}") for i in range(50)] + [("a", "b")])
    blocks = lookup.adjacency(edges, "src", block=10).collect()
    hub = [b for b in blocks if b["id"] == "hub"]
    assert len(hub) > 1 and sorted(x for b in hub for x in b["neighbours"].split(",")) == sorted(f"n{i}" for i in range(50))


def files(df):
    return [(r["file_path"], round(r["score"], 6), r["reason"]) for r in df.collect()]


def test_ranked_query(code, make_actions):
    entities, _ = code
    none = make_actions([{"file_path": None}])
    assert files(rank.ranked_query(entities, none, "glaze", 2)) == [
        ("src/kiln.rs", 0.8, "name match: glaze_bowl"),
        ("tests/kiln_test.rs", 0.7, "name match: test_glaze"),
    ]
    assert files(rank.ranked_query(entities, none, "batch", 5))[0][0] == "src/batch.rs"
    for query, k in (("", 5), ("   ", 5), ("batch", 0), ("zzzz", 5)):
        assert files(rank.ranked_query(entities, none, query, k)) == []


def test_prefilter_keeps_a_path_match(make_entities, make_actions):
    rows = [{"id": "src/billing_system.rs::process"}] + [{"id": f"src/filler_{i}.rs::billing_other_{i}"} for i in range(25)]
    got = rank.ranked_query(make_entities(rows), make_actions([{"file_path": None}]), "billing system", 1)
    assert [r["file_path"] for r in got.collect()] == ["src/billing_system.rs"]


def test_documentation_only_matches_need_the_full_scan(make_entities, make_actions):
    rows = [{"id": f"a/f{i:03}.rs::g{i}"} for i in range(30)] + [{"id": "z/z.rs::z", "docstring": "Frobnicates things"}]
    entities, log = make_entities(rows), make_actions([{"file_path": None}])
    assert files(rank.ranked_query(entities, log, "frobnicates", 1)) == []
    assert files(rank.ranked_query(entities, log, "frobnicates", 1, use_prefilter=False)) == [("z/z.rs", 0.1, 'docstring mentions "frobnicates"')]


def test_recency_and_stale(code, make_actions, at, spark):
    entities, _ = code
    log = make_actions([{"file_path": "src/batch.rs", "ts": at(0)}, {"file_path": "x.rs", "ts": at(3600)}])
    stale = spark.createDataFrame([("src/batch.rs",)], "file_path string")
    row = rank.ranked_query(entities, log, "batch", 1, stale).first()
    assert row["stale_warning"] == rank.STALE and abs(row["score"] - (0.4 + 0.3 + 0.2 * 0.5)) < 1e-9


def column(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("name", "query", "expected"),
    [("glaze_bowl", "glaze bowl", 1.0), ("glaze_bowl", "glaze unknown", 0.5), ("glaze_bowl", "g", 0.0), (None, "bowl", 0.0)],
)
def test_name_score(spark, name, query, expected):
    from pyspark.sql import functions as F

    assert column(spark, text.name_score(F.lit(name).cast("string"), query)) == expected


def test_other_scores(spark):
    from pyspark.sql import functions as F

    assert [column(spark, text.graph_score(F.lit(d).cast("int"))) for d in (0, 1, 2, 3, 4, None)] == [1.0, 0.7, 0.4, 0.2, 0.0, 0.0]
    assert [column(spark, text.recency_score(F.lit(s).cast("long"))) for s in (0, 3600, 7200, None)] == [1.0, 0.5, 0.25, 0.0]
    assert 0 < column(spark, text.recency_score(F.lit(30 * 86400))) < 1e-100
    assert column(spark, text.tokenize(F.lit("a::Foo_bar-x.yz/é q"))) == ["foo", "bar", "yz", "é"]
    assert text.query_tokens("Auth flow/x") == ["auth", "flow"]


def test_history(make_actions, at):
    log = make_actions(
        [
            {"file_path": "file_a.rs", "ts": at(-500)},
            {"file_path": "file_b.rs", "ts": at(-400)},
            {"file_path": "file_a.rs", "ts": at(-300), "action_type": "file_edit"},
            {"file_path": "file_c.rs", "ts": at(-200), "action_type": "ERROR"},
            {"file_path": "./file_a.rs", "ts": at(-100)},
        ]
    )
    twice = log.unionByName(log)
    assert [r["file_path"] for r in history.recent_files(twice, 2).collect()] == ["file_a.rs", "file_c.rs"]
    assert [tuple(r)[:2] for r in history.frequent_files(twice, 3).collect()] == [("file_a.rs", 3), ("file_c.rs", 1), ("file_b.rs", 1)]
    assert [r["file_path"] for r in history.recent_errors(twice, 1).collect()] == ["file_c.rs"]
    assert history.total_actions(twice).first()[0] == 5 and history.recent_files(twice, 0).count() == 0
    assert history.action_by_id(twice, "a003").first()["action_type"] == "error"


def test_components_like_union_find(spark):
    rng = random.Random(6)
    pairs = [(f"{rng.randint(0, 80):02}", f"{rng.randint(0, 80):02}") for _ in range(60)] + [(f"p{i:02}", f"p{i + 1:02}") for i in range(40)] + [("hub", f"h{i}") for i in range(50)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    expected = {x: find(x) for x in root if any(x in p and p[0] != p[1] for p in pairs)}
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == expected
