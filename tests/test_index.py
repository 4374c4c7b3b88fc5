"""Trees, resolution across files, storage and reconciling."""

import os
import re

import pytest
from pyspark.sql import functions as F

from codeloom.api import CodeGraph
from codeloom.operators import report, resolve, store
from codeloom.sources import trees
from codeloom.streaming import jobs


@pytest.fixture()
def files(spark):
    return lambda **texts: spark.createDataFrame([(p, None, t) for p, t in texts["of"].items()], "file_path string, language string, content string")


def edges_of(files, of):
    f = files(of=of)
    return {(r["src"], r["dst"]) for r in resolve.call_edges(trees.extract_entities(f), trees.extract_imports(f)).collect()}


def test_calls_in_a_file(files):
    assert edges_of(files, {"kiln.py": "def heat():\n    pass\ndef fire():\n    heat()\n"}) == {("kiln.py::fire", "kiln.py::heat")}


@pytest.mark.parametrize(
    "caller",
    [
        "from lab.scale import weigh\ndef test_run():\n    weigh()\n",
        "from lab.scale import weigh as w\ndef test_run():\n    w()\n",
        "import lab.scale as s\ndef test_run():\n    s.weigh()\n",
        "from .scale import weigh\ndef test_run():\n    weigh()\n",
        "from ..lab.scale import weigh\ndef test_run():\n    weigh()\n",
        "from . import scale\ndef test_run():\n    scale.weigh()\n",
    ],
)
def test_calls_through_python_imports(files, caller):
    got = edges_of(files, {"lab/scale.py": "def weigh():\n    pass\n", "other/scale.py": "def weigh():\n    pass\n", "lab/bench.py": caller})
    assert got == {("lab/bench.py::test_run", "lab/scale.py::weigh")}


def test_calls_through_rust_and_script_imports(files):
    rust = {"src/clay/mix.rs": "pub fn stir() {}\n", "src/kiln.rs": "use crate::clay::mix::stir;\nuse crate::clay::mix;\nfn fire() { stir(); }\nfn other() { mix::stir(); }\n"}
    got = edges_of(files, rust)
    assert got == {("src/kiln.rs::fire", "src/clay/mix.rs::stir"), ("src/kiln.rs::other", "src/clay/mix.rs::stir")}
    near = {"src/a/mod.rs": "pub fn top() {}\n", "src/a/b.rs": "use super::top;\nuse self::c::deep;\nfn f() { top(); deep(); }\n", "src/a/b/c.rs": "pub fn deep() {}\n", "src/z/a.rs": "pub fn top() {}\n"}
    assert edges_of(files, near) == {("src/a/b.rs::f", "src/a/mod.rs::top"), ("src/a/b.rs::f", "src/a/b/c.rs::deep")}
    script = {"lib/x.js": "export function f() {}\n", "lib/y.js": "import { f as g } from './x';\nfunction h() { g(); }\n"}
    assert edges_of(files, script) == {("lib/y.js::h", "lib/x.js::f")}
    steps = {"x.js": "export function f() {}\n", "lib/x.js": "export function f() {}\n", "lib/in/deep/y.js": "import { f } from '../../x';\nimport { f as g } from '../../../x';\nfunction h() { f(); }\nfunction i() { g(); }\n"}
    assert edges_of(files, steps) == {("lib/in/deep/y.js::h", "lib/x.js::f"), ("lib/in/deep/y.js::i", "x.js::f")}


def test_relative_imports_never_match_by_the_last_component(files):
    assert edges_of(files, {"far/x.js": "export function f() {}\n", "lib/y.js": "import { f } from './x';\nfunction h() { f(); }\n"}) == set()


def test_names_that_nothing_declares_give_no_edge(files):
    assert edges_of(files, {"kiln.py": "def heat():\n    somewhere_else()\n"}) == set()


def test_read_tree(spark, tmp_path):
    (tmp_path / "src" / "Vendor").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("def f(): pass\n")
    (tmp_path / "src" / "Vendor" / "b.py").write_text("def g(): pass\n")
    (tmp_path / "notes.txt").write_text("no")
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe\xfa")
    got = trees.read_tree(spark, str(tmp_path), ["vendor"])
    assert [tuple(r) for r in got.collect()] == [("src/a.py", "def f(): pass\n")]


def test_paths(spark):
    paths = ["src/x.rs", "a/__init__.py", "a/mod.rs", "mod.rs", "X.PY", "notes.md", "noext", "a.d/b.jsx"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    p = F.col("p")
    got = [tuple(r) for r in df.select(trees.module_name(p), trees.infer_language(p), trees.is_source_file(p)).collect()]
    assert [g[0] for g in got] == ["src.x", "a", "a", "", "X", "notes", "noext", "a.d.b"]
    assert [g[1] for g in got] == ["rust", "python", "rust", "rust", "python", None, None, "javascript"]
    assert [g[2] for g in got] == [True, True, True, True, False, False, False, True]


def test_symbols_last_wins(spark):
    rows = [("a.py::f", "a.py", "f"), ("a.py::C::f", "a.py", "f"), ("b.py::f", "b.py", "f")]
    got = resolve.symbol_table(spark.createDataFrame(rows, "id string, file_path string, name string")).collect()
    assert {(r["module"], r["name"]): r["id"] for r in got} == {("a", "f"): "a.py::f", ("b", "f"): "b.py::f"}


TREE = {
    "shop/cart.py": "from shop.price import total\n\ndef fill():\n    total()\n    check()\n\ndef check():\n    pass\n",
    "shop/price.py": "from shop.tax import rate\n\ndef total():\n    rate()\n",
    "shop/tax.py": "def rate():\n    pass\n",
    "shop/gone.py": "from shop.tax import rate\n\ndef old():\n    rate()\n",
}
AT = "2024-05-01 00:00:00"


def state(entities, edges):
    """What lookups see of a graph."""
    rows = {tuple(r) for r in entities.select("id", "name", "line_start", F.array_join("called_by", " ")).collect()}
    return rows, {tuple(r) for r in edges.select("src", "dst").collect()}


def test_index_then_ask(spark, files, make_actions, tmp_path):
    """What is indexed and stored can be asked: lookup, search, reach."""
    root = f"file://{tmp_path}/g"
    tables = store.GraphTables(spark, root, parts=3)
    tables.overwrite(*store.index_files(files(of=TREE), AT))
    make_actions([{"file_path": "shop/tax.py"}]).write.parquet(f"{root}/actions.parquet")
    graph = CodeGraph.open(spark, root)
    assert {r["id"] for r in graph.callers("shop/tax.py::rate").collect()} == {"shop/price.py::total", "shop/gone.py::old"}
    assert {r["id"] for r in graph.reach("shop/cart.py::fill").collect()} >= {"shop/price.py::total", "shop/tax.py::rate"}
    assert graph.entities.where("id = 'shop/tax.py::rate'").first()["called_by"] == ["shop/gone.py::old", "shop/price.py::total"]
    best = graph.search("rate tax", k=1).first()
    assert best["file_path"] == "shop/tax.py"
    assert graph.path("shop/cart.py::fill", "shop/tax.py::rate") == ["shop/cart.py::fill", "shop/price.py::total", "shop/tax.py::rate"]


def test_store_round_trip(spark, files, tmp_path):
    s = store.GraphTables(spark, f"file://{tmp_path}/g", parts=4)
    s.overwrite(*store.index_files(files(of=TREE), AT))
    assert s.read("entities").count() == 5 and s.read("edges").count() == 4
    s.delete(spark.createDataFrame([("shop/tax.py",)], "file_path string"))
    assert s.read("entities").count() == 4
    assert {tuple(r) for r in s.read("edges").collect()} == {("shop/cart.py::fill", "shop/price.py::total"), ("shop/cart.py::fill", "shop/cart.py::check")}
    changed = s.read("entities").where("id = 'shop/cart.py::fill'").withColumn("calls", F.array(F.lit("shop/gone.py::old"), F.lit("raw_name")))
    changed = store.materialize(changed)  # the store's files are about to be replaced
    for _ in range(2):
        s.upsert(changed)
        assert [tuple(r) for r in s.read("edges").collect()] == [("shop/cart.py::fill", "shop/gone.py::old")] and s.read("entities").count() == 4
    s.mark_stale(changed)
    s.mark_stale(changed)
    assert s.stale().count() == 1
    s.clear_stale(changed)
    assert s.stale().count() == 0
    s.overwrite(store.materialize(s.read("entities").limit(1)), spark.createDataFrame([], "src string, dst string"))
    assert s.read("entities").count() == 1 and s.read("edges").count() == 0 and s.load()[0].count() == 1
    s.heartbeat("then")
    s.heartbeat("now")
    assert s.last_heartbeat() == "now"


def test_a_change_leaves_other_partitions_alone(spark, files, tmp_path):
    s = store.GraphTables(spark, f"file://{tmp_path}/g", parts=50)
    s.overwrite(*store.index_files(files(of=TREE), AT))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "g" / "entities.parquet").glob("part=*/*.parquet")}
    s.delete(spark.createDataFrame([("shop/gone.py",)], "file_path string"))
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "g" / "entities.parquet").glob("part=*/*.parquet")}
    # the deleted file's partition, and that of tax.py, which it called
    assert len(before.items() & after.items()) == len(before) - 2


@pytest.mark.parametrize("touched", [["shop/price.py"], ["shop/tax.py"], ["shop/cart.py", "shop/gone.py"], ["shop/gone.py"], ["shop/price.py", "shop/tax.py", "shop/cart.py"]])
def test_reconcile_equals_indexing_the_changed_tree(spark, files, tmp_path, touched):
    """After a stream of events the store holds what indexing the tree anew gives; gone and vanished files stay stale."""
    now = dict(TREE)
    now["shop/price.py"] = "from shop.tax import rate\n\n\ndef total():\n    rate()\n    extra()\n\ndef extra():\n    pass\n" if "shop/price.py" in touched else TREE["shop/price.py"]
    if "shop/gone.py" in touched:
        del now["shop/gone.py"]
    s = store.GraphTables(spark, f"file://{tmp_path}/g", parts=4)
    s.overwrite(*store.index_files(files(of=TREE), AT))
    landed = f"{tmp_path}/events"
    # gone.py is reported as modified, but isn't there any more
    rows = [(p, True, f"2024-05-02 00:00:0{n}") for n, p in enumerate(touched)] + [("late.py", True, "2024-05-09 00:00:00")]
    spark.createDataFrame(rows, "file_path string, exists boolean, at string").withColumn("at", F.col("at").cast("timestamp_ntz")).coalesce(1).write.json(landed)
    events = jobs.debounced(jobs.file_events(spark, landed))
    for _ in range(2):
        jobs.reconciler(s, events, lambda: files(of=now), f"file://{tmp_path}/cp", AT).awaitTermination()
    assert state(*s.load()) == state(*store.index_files(files(of=now), AT))
    assert {r["file_path"] for r in s.stale().collect()} == {"shop/gone.py"} & set(touched)
    assert s.last_heartbeat() is not None


def test_reconcile_keeps_calls_of_others(spark, files):
    """The caller alone is parsed again; its call into a file that stays must still be found."""
    of = {"payroll.py": "def payout():\n    pass\n", "main.py": "from payroll import payout\ndef go():\n    payout()\n"}
    entities, edges = store.index_files(files(of=of), AT)
    events = spark.createDataFrame([("main.py", "modified", 1)], "file_path string, kind string, at int")
    nodes, links, settled = jobs.reconcile(entities, edges, events, files(of=of))
    assert {tuple(r) for r in links.collect()} == {("main.py::go", "payroll.py::payout")} and nodes.count() == 2
    assert [r["file_path"] for r in settled.collect()] == ["main.py"]
    gone = spark.createDataFrame([("payroll.py", "modified", 1), ("payroll.py", "deleted", 2)], "file_path string, kind string, at int")
    nodes, links, settled = jobs.reconcile(entities, edges, gone, files(of=of))
    assert links.count() == 0 and nodes.count() == 1 and settled.count() == 0


def test_debounce(spark, at):
    rows = [("a.rs", True, at(0)), ("a.rs", False, at(0.4)), ("a.rs", True, at(0.8)), ("a.rs", False, at(5)), ("a.txt", True, at(0))]
    got = jobs.debounced(spark.createDataFrame(rows, "file_path string, exists boolean, at timestamp_ntz")).orderBy("at").collect()
    assert [(r["file_path"], r["kind"], r["at"]) for r in got] == [("a.rs", "modified", at(0.8)), ("a.rs", "deleted", at(5))]


def test_clear_history(make_actions, at):
    log = make_actions([{}, {"ts": at(9)}, {"ts": None, "logged_at": at(9)}])
    assert store.clear_history(log).count() == 0 and store.clear_history(log, str(at(5))).count() == 2


def test_streams_and_sinks(spark, make_actions, tmp_path, at):
    log = f"{tmp_path}/actions.parquet"
    actions = make_actions([{"action_type": "Error"}, {"file_path": "b.rs"}, {"ts": at(-5), "logged_at": at(9)}])
    actions.unionByName(actions.limit(1)).write.parquet(log)
    got = jobs.run_to_end(jobs.file_counters(jobs.action_stream(spark, log)))
    assert sorted(map(tuple, got.collect())) == [("a.rs", 2, at(0)), ("b.rs", 1, at(1))]
    jobs.log_sink(jobs.action_stream(spark, log), f"{tmp_path}/log", f"{tmp_path}/errors", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/log").count() == 3 and spark.read.parquet(f"{tmp_path}/errors").count() == 1
    sliding = jobs.run_to_end(jobs.window_counts(jobs.action_stream(spark, log), "2 days", "1 day"))
    assert sliding.agg(F.sum("n")).first()[0] == 6


def test_exports(spark, make_entities, make_edges, tmp_path):
    entities = make_entities([{"id": "a/x.rs::f"}, {"id": "b/y.rs::<g>"}])
    edges = make_edges([("a/x.rs::f", "b/y.rs::<g>"), ("a/x.rs::f", "gone::h")])
    report.export_json(entities, edges, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "links")).count() == 1
    page = report.export_html(entities, edges, f"file://{tmp_path}/html")
    names = re.findall(r'src="([^"]+)"', page)
    data = "".join((tmp_path / "html" / n).read_text() for n in names)
    assert data.count("graph.nodes.push(") == 2 and data.count("graph.links.push(") == 1
    assert "<g>" not in data and "b/y.rs" in data and "\\u003cg>" in data
    text = report.markdown_report(entities, edges, "T")
    assert "entities: 2 in 2 files" in text and "`a/x.rs::f` to `b/y.rs::<g>`" in text


def test_scratch_is_cleared(spark):
    from codeloom import session

    first, second = (session.materialize(spark.range(3)) for _ in range(2))
    folder = lambda df: df._scratch_path.removeprefix("file://")
    assert os.path.isdir(folder(first)) and os.path.isdir(folder(second))
    session.discard(first, None, spark.range(1))
    assert not os.path.isdir(folder(first)) and second.count() == 3
    session.cleanup(spark)
    assert not os.path.isdir(folder(second))
