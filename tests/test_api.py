"""The facade, and the entry points with and without the text subpackage."""

import subprocess
import sys

import pytest

from codeloom.api import TOOLS, CodeGraph, NotFound
from codeloom.operators import history
from codeloom.streaming import jobs

A, B, C = "src/a.rs::main", "src/b.rs::load", "tests/t.rs::test_load"


@pytest.fixture(scope="module")
def code(make_entities, make_edges, make_actions):
    entities = make_entities([{"id": A, "calls": [B]}, {"id": B, "docstring": "Loads rows"}, {"id": C, "entity_type": "test_function"}])
    return CodeGraph(entities, make_edges([(A, B), (C, B)]), make_actions([{"file_path": "src/b.rs"}]))


def ids(df):
    return {r["id"] for r in df.collect()}


def test_ask(code):
    assert ids(code.ask(f"callers {B}")) == {A, C} and ids(code.ask(f"callees {A}")) == {B}
    assert ids(code.ask("file src/b.rs")) == {B} and ids(code.ask("entity main")) == {A}
    assert ids(code.ask(f"bfs {A} 1")) == {A, B} and ids(code.ask(f"reverse_bfs {B}")) == {A, B, C} and ids(code.ask(f"dependency_chain {A}")) == {B}
    assert [r["file_path"] for r in code.ask("load").orderBy("score", ascending=False).collect()][0] in ("src/b.rs", "tests/t.rs")
    with pytest.raises(NotFound):
        code.ask("callers nobody::x")
    with pytest.raises(ValueError):
        code.ask(f"bfs {A} -1")


def test_tools(code):
    assert len(TOOLS) == 6
    assert code.tool("get_callers", {"entity_id": "src\\b.rs::load"}).splitlines() == [f"{A} (src/a.rs:1-2)", f"{C} (tests/t.rs:1-2)"]
    assert code.tool("shortest_path", {"from": A, "to": B}).splitlines() == [A, B]
    assert code.tool("find_tests", {"entity_id": B}) == code.tool("find_tests", {}) == f"{C} (tests/t.rs:1-2)"
    assert code.tool("query_graph", {"query": "load", "top_k": 99}).startswith("1. ")
    assert code.tool("explain_entity", {"entity_id": "x::y"}).startswith("nothing found")
    for name, arguments in (("nope", {}), ("get_callers", {})):
        with pytest.raises(ValueError):
            code.tool(name, arguments)


def test_impact_and_tests(code):
    assert {r["file_path"] for r in code.impact("src/b.rs").collect()} == {"src/a.rs", "tests/t.rs"}
    assert code.path(B, A) == []
    assert history.stale_files(code.actions, code.entities).count() == 0


def test_session_windows(spark, make_actions, at, tmp_path):
    log = f"{tmp_path}/actions.parquet"
    make_actions([{}, {}, {"ts": at(7200)}]).write.parquet(log)
    got = jobs.run_to_end(jobs.session_counts(jobs.action_stream(spark, log)))
    assert sorted(r["n"] for r in got.collect()) == [1, 2]


def test_core_imports_without_the_text_subpackage():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('codeloom.llm'): raise ImportError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "q, s = e.queries(), e.oracle_sql()\n"
        "assert 'p2_found' in q and 'p1_found' not in q and set(s) <= set(q)\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True)
