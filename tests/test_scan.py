"""Declarations, comments, calls and imports of small texts."""

import pytest

from codeloom.sources.imports import imports_of
from codeloom.sources.scan import is_test_name, language_of, scan


def kinds(path, text):
    return [(d["id"], d["entity_type"]) for d in scan(path, text)]


def docs(path, text):
    return {d["name"]: d["doc"] for d in scan(path, text)}


def test_python_entities_and_lines():
    text = 'import os\n\n@hook\ndef f(a,\n      b=")"):\n    """Doc."""\n    def inner(): pass\n    return 1\n\n\nclass C(Base):\n    x = "def no():"\n\n    async def m(self):\n        # def no(): pass\n        return 2\n'
    found = scan("p.py", text)
    assert [(d["id"], d["entity_type"], d["line_start"], d["line_end"]) for d in found] == [
        ("p.py::f", "function", 4, 8),
        ("p.py::C", "class", 11, 16),
        ("p.py::C::m", "method", 14, 16),
    ]
    assert found[0]["doc"] == "Doc." and found[2]["doc"] is None


def test_python_strings_hide_declarations():
    assert kinds("p.py", 'T = """\ndef no():\n    pass\n"""\ndef yes():\n    pass\n') == [("p.py::yes", "function")]


@pytest.mark.parametrize("quote", ['"""', "'''", 'r"""', '"', "'"])
def test_python_docstring_quotes(quote):
    end = quote.lstrip("r")
    assert docs("p.py", f"def f():\n    # why\n    {quote}Says it.{end}\n    return 1\n") == {"f": "Says it."}


def test_rust_kinds_and_docs():
    text = (
        "/// Outer.\n#[inline]\npub fn a(x: u32) -> u32 { if x > 1 { b() } 1 }\n\n// plain\nfn b() {}\n\nimpl<T: X> Shape for Square<T> {\n"
        '    #[doc = "By attribute."]\n    fn area(&self) -> u32 { "}" ; 1 }\n}\n\n#[cfg(test)]\nmod tests {\n    #[tokio::test]\n    async fn works() {}\n'
        "    fn helper() {}\n}\n/** Block.\n * More. */\nfn c() {}\n/// Apart.\n\nfn d() {}\n"
    )
    assert kinds("r.rs", text) == [
        ("r.rs::a", "function"),
        ("r.rs::b", "function"),
        ("r.rs::Square::area", "method"),
        ("r.rs::works", "test_function"),
        ("r.rs::helper", "function"),
        ("r.rs::c", "function"),
        ("r.rs::d", "function"),
    ]
    found = docs("r.rs", text)
    assert found["a"].strip() == "Outer." and found["b"] is None and found["area"] == "By attribute." and found["d"] is None
    assert found["c"].split() == ["Block.", "More."]


def test_go_receivers_tests_and_comments():
    text = "package p\n\n// Says it.\nfunc (s *Store) Get(k string) int {\n\treturn 1\n}\n\n// apart\n\nfunc Free() {}\n\nfunc TestX(t *testing.T) {}\nfunc Testament() {}\nfunc TestY() {}\n"
    assert kinds("g.go", text) == [
        ("g.go::Store::Get", "method"),
        ("g.go::Free", "function"),
        ("g.go::TestX", "test_function"),
        ("g.go::Testament", "function"),
        ("g.go::TestY", "function"),
    ]
    assert docs("g.go", text)["Get"].strip() == "Says it." and docs("g.go", text)["Free"] is None


def test_script_functions_arrows_and_classes():
    text = "/** Adds. */\nexport function add(a, b) { return a + b; }\n// plain\nconst twice = (x) => { return x * 2; };\nclass Box {\n  constructor(v) { if (v) { go(v); } }\n  /**\n   * Opens.\n   */\n  open(k) { for (const x of k) { close(x); } }\n}\n"
    assert kinds("s.js", text) == [
        ("s.js::add", "function"),
        ("s.js::twice", "function"),
        ("s.js::Box", "class"),
        ("s.js::Box::constructor", "method"),
        ("s.js::Box::open", "method"),
    ]
    found = docs("s.js", text)
    assert found["add"].strip() == "Adds." and found["twice"] is None and found["open"].strip() == "Opens."


def test_overloads_have_signatures_and_no_body():
    found = scan("t.ts", "/** First. */\nexport function f(a: string): void;\nexport function f(a: any): void { return; }\n")
    assert [(d["signature"], d["body"]) for d in found] == [("(string)", False), ("(any)", True)]


def test_line_ends_and_unknown_languages():
    assert scan("p.py", "def f():\r\n    '''D.'''\r\n    pass\r\n")[0]["doc"] == "D."
    assert scan("p.txt", "def f(): pass") == [] and scan("p.py", "") == []
    assert language_of("x", "RS") == "rust" and language_of("x.PY") == "python" and language_of("x", None) is None


def test_calls():
    found = {d["name"]: d["calls"] for d in scan("p.py", "def f():\n    g(h(1))\n    a.b.c()\n    # no()\n    print('no()')\n    g()\n", calls=True)}
    assert found["f"] == ["g", "h", "a.b.c", "print"]
    found = {d["name"]: d["calls"] for d in scan("r.rs", "fn f() { x::y(); println!(\"z\"); s.t(); if a(b) {} }", calls=True)}
    assert found["f"] == ["x::y", "s.t", "a"]
    found = {d["name"]: d["calls"] for d in scan("s.ts", "class A {\n  m() { this.n(); new B(); }\n  n() {}\n}", calls=True)}
    assert found["m"] == ["n"] and found["A"] == ["n"]


def test_test_names():
    assert [is_test_name(n) for n in ("test_a", "testA", "test", "test_", "tester")] == [True, True, False, False, False]


@pytest.mark.parametrize(
    ("path", "text", "expected"),
    [
        ("a.py", "import a.b, c as d\nfrom m import (f as g,\n  h)\nfrom . import q\n", [("a.b", None, "a"), ("c", None, "d"), ("m", "f", "g"), ("m", "h", "h"), (".", "q", "q")]),
        ("a.rs", "use a::b::{c, d as e, f::{self, g}};\npub use h;\n", [("a::b", "c", "c"), ("a::b", "d", "e"), ("a::b", "f", "f"), ("a::b::f", "g", "g"), ("", "h", "h")]),
        ("a.go", 'import "fmt"\nimport (\n\tx "a/b"\n\t"c/d"\n)\n', [("fmt", None, "fmt"), ("a/b", None, "x"), ("c/d", None, "d")]),
        ("a.ts", "import D, { a, b as c } from './x';\nimport * as n from 'y';\nimport { T } from \"z\";\n", [("./x", "default", "D"), ("./x", "a", "a"), ("./x", "b", "c"), ("z", "T", "T")]),
    ],
)
def test_imports(path, text, expected):
    assert [(i["module_path"], i["symbol"], i["imported_name"]) for i in imports_of(path, text)] == expected
