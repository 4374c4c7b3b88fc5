"""Which comments say something, and which function they belong to."""

import pytest

from codeloom.llm.docpairs import documented_functions, says_something


@pytest.mark.parametrize(
    "doc",
    [
        "Polls a flat lease, then collects its volumes locally.",
        "@param {*} x\n Drops rows that have no key.",
        "@returns the sorted rows of the table",
        ":param x: the number of rows to read\n:return:",
        "Prüft jede Zeile und verwirft Einträge.",
        "TODO: later\nReads the file line by line.",
        "Loads users faster than the cache can.",
    ],
)
def test_prose(doc):
    assert says_something(doc, "load_users")


@pytest.mark.parametrize(
    "doc",
    [
        None, "", "  \n ", "---", "...", "??", "TODO", "FIXME: write docs", "XXX docs", "tbd", "todo - write docs", "N/A", "none", "(undocumented)", "fill me in",
        "no description", "Description goes here.", "Method description", "Add a summary here", "Docstring placeholder.", "Stub created by the editor.", "Auto-generated method stub",
        "Load users.", "Loads the users.", "load_users", "load_users()", "This method is called load_users.", "The load users function.", "LoadUsers",
        "@param users\n@returns", "Args:\n\nReturns:\n", ":param users:\n:return:", "@internal", "@param {*} users",
        "return users.load()", "let users = load_all();", "load_users(users);", "SPDX-License-Identifier: MIT", "Copyright 2024 the authors. All rights reserved.", "Licensed under the terms in LICENSE.txt",
    ],
)
def test_nothing(doc):
    assert not says_something(doc, "load_users")


def test_pairs(spark):
    py = 'def a():\n    """Reads every row twice."""\n\ndef b():\n    """TODO"""\n\nclass C:\n    """Holds rows."""\n    def a(self):\n        "Closes what was opened."\n'
    ts = "/** Reads the index from disk. */\nexport function f(p: string): void;\n\nexport function f(p: any): void { }\n"
    stub = "/** Opens the remote archive. */\nexport function g(p: string): void;\n"
    body = "export function g(p: string): void { return; }\n"
    files = spark.createDataFrame(
        [("p.py", "r", "python", py), ("p.py", "r", "python", py), ("t.ts", "r", None, ts), ("u.d.ts", "r", None, stub), ("u.ts", "r", None, body), ("n.py", "r", None, None), (None, None, None, "x"), ("e.py", "r", None, "")],
        "file_path string, repo string, language string, content string",
    ).selectExpr("*", "'clash' as doc")
    ids = [("p.py::a", "function"), ("p.py::a", "function"), ("p.py::b", "function"), ("p.py::C", "class"), ("p.py::C::a", "method"), ("t.ts::f", "function"), ("u.ts::g", "function"), (None, "function")]
    entities = spark.createDataFrame(ids, "id string, entity_type string").selectExpr("*", "'clash' as name")
    got = {r["entity_id"]: r for r in documented_functions(files, entities).collect()}
    assert set(got) == {"p.py::a", "p.py::C::a", "t.ts::f", "u.ts::g"}
    assert got["p.py::a"]["description"] == "Reads every row twice." and got["p.py::a"]["code"].startswith("def a")
    assert got["u.ts::g"]["code"].startswith("export function g")
    assert got["u.ts::g"]["doc_from"] == "declaration" and got["t.ts::f"]["doc_from"] == "own"
    assert documented_functions(files.limit(0), entities).count() == 0 and documented_functions(files, entities.limit(0)).count() == 0


SAID = "Keeps every row on disk."


@pytest.mark.parametrize(
    "declared, defined, entity",
    [
        # traits, base classes and interfaces in other files, and stubs in other roots
        (("core/store.rs", f"pub trait Store {{\n    /// {SAID}\n    fn save(&self, n: u32) -> bool;\n}}\n"), ("disk/d.rs", "impl Store for Disk {\n    fn save(&self, k: u32) -> bool {\n        true\n    }\n}\n"), "disk/d.rs::Disk::save"),
        (("a/base.py", f'class Base(ABC):\n    def save(self, n: int):\n        """{SAID}"""\n'), ("b/disk.py", "class Disk(Base):\n    def save(self, k: int):\n        return k\n"), "b/disk.py::Disk::save"),
        (("stubs/pkg/mod.pyi", f'def save(n: int) -> bool:\n    """{SAID}"""\n    ...\n'), ("src/pkg/mod.py", "def save(k: int):\n    return True\n"), "src/pkg/mod.py::save"),
        (("a/store.ts", f"export interface Store {{\n  /** {SAID} */\n  save(n: number): boolean;\n}}\n"), ("b/disk.ts", "export class Disk extends Base implements Store {\n  save(k: number): boolean {\n    return true;\n  }\n}\n"), "b/disk.ts::Disk::save"),
        (("types/mod.d.ts", f"/** {SAID} */\nexport function save(n: number): boolean;\n"), ("src/mod.ts", "export function save(k: number): boolean {\n  return true;\n}\n"), "src/mod.ts::save"),
        (("a/base.js", f"class Base {{\n  /** {SAID} */\n  save(n) {{ return n; }}\n}}\n"), ("b/disk.js", "class Disk extends Base {\n  save(k) { return k; }\n}\n"), "b/disk.js::Disk::save"),
        (("store/store.go", f"package store\n\ntype Store interface {{\n\t// {SAID}\n\tSave(n int) error\n}}\n"), ("store/disk.go", "package store\n\nfunc (d *Disk) Save(k int) error {\n\treturn nil\n}\n"), "store/disk.go::Disk::Save"),
    ],
)
def test_only_the_join_gives_the_pair(spark, declared, defined, entity):
    entities = spark.createDataFrame([(entity, "method")], "id string, entity_type string")
    pairs = lambda rows: [(r["entity_id"], r["description"], r["doc_from"] in ("declaration", "base")) for r in documented_functions(spark.createDataFrame(rows, "file_path string, repo string, language string, content string"), entities).collect()]
    d, o = ((p, "r", "python" if p.endswith("pyi") else None, t) for p, t in (declared, defined))
    assert pairs([d, o]) == [(entity, SAID, True)]
    assert pairs([o]) == pairs([d[:1] + ("else",) + d[2:], o]) == []  # alone, or declared in another repository
    # another signature is another function
    other = {"u32": "u64", "int": "str", "number": "string", "(k)": "(k, more)", "int)": "string)"}
    changed = o[3]
    for a, b in other.items():
        if a in changed:
            changed = changed.replace(a, b)
            break
    assert pairs([d, (*o[:3], changed)]) == []
