"""The imports of one source text: (module_path, symbol, alias, imported_name)."""

from __future__ import annotations

import re

from codeloom.sources.scan import language_of

_PY = re.compile(r"^[ \t]*(?:from[ \t]+(?P<module>[.\w]+)[ \t]+import[ \t]+(?P<names>\([^)]*\)|[^\n#;]+)|import[ \t]+(?P<plain>[^\n#;]+))", re.M)
_RUST = re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?use\s+(?P<path>[^;]+);", re.M)
_GO = re.compile(r"^import\s+(?:\((?P<group>[^)]*)\)|(?P<single>[^\n]+))", re.M)
_JS = re.compile(r"^import\s+(?P<what>[^'\";]+?)\s+from\s+['\"](?P<module>[^'\"]+)['\"]", re.M)


def _item(module: str, symbol: str | None, alias: str | None, name: str) -> dict:
    return {"module_path": module, "symbol": symbol, "alias": alias, "imported_name": name}


def _aliased(text: str, word: str = "as") -> tuple[str, str | None]:
    parts = re.split(rf"\s+{word}\s+", text.strip(), maxsplit=1)
    return parts[0].strip(), parts[1].strip() if len(parts) > 1 else None


def _rust_tree(path: str, prefix: str = "") -> list[tuple[str, str | None]]:
    """(full path, alias) of each leaf of a `use` tree."""
    path = path.strip()
    if "{" not in path:
        leaf, alias = _aliased(path)
        return [(prefix + leaf, alias)] if leaf else []
    head, rest = path.split("{", 1)
    inner = rest[: rest.rfind("}")]
    out, depth, part = [], 0, ""
    for c in inner + ",":
        if c == "," and depth == 0:
            out += _rust_tree(part, prefix + head.strip()) if part.strip() else []
            part = ""
        else:
            depth += (c == "{") - (c == "}")
            part += c
    return out


def imports_of(path: str, text: str, language: str | None = None) -> list[dict]:
    """All imports of a text in order. Namespace imports of JavaScript bind no known symbol and are left out."""
    language, text = language_of(path, language), text.replace("\r\n", "\n")
    out: list[dict] = []
    if language == "python":
        for m in _PY.finditer(text):
            if m["plain"]:
                for part in m["plain"].split(","):
                    module, alias = _aliased(part)
                    if module:
                        out.append(_item(module, None, alias, alias or module.split(".")[0]))
            else:
                for part in m["names"].strip("() \t\n").split(","):
                    symbol, alias = _aliased(part)
                    if symbol and symbol != "*":
                        out.append(_item(m["module"], symbol, alias, alias or symbol))
    elif language == "rust":
        for m in _RUST.finditer(text):
            for full, alias in _rust_tree(re.sub(r"\s+", " ", m["path"])):
                module, _, symbol = full.rpartition("::")
                if symbol not in ("*", "self", ""):
                    out.append(_item(module, symbol, alias, alias or symbol))
                elif symbol == "self":
                    outer, _, last = module.rpartition("::")
                    out.append(_item(outer, last, alias, alias or last))
    elif language == "go":
        for m in _GO.finditer(text):
            for line in (m["group"] or m["single"]).split("\n"):
                spec = re.match(r"\s*(?P<alias>[\w.]+)?\s*\"(?P<path>[^\"]+)\"", line)
                if spec:
                    out.append(_item(spec["path"], None, spec["alias"], spec["alias"] or spec["path"].rsplit("/", 1)[-1]))
    elif language in ("javascript", "typescript"):
        for m in _JS.finditer(text):
            what = m["what"].removeprefix("type ").strip()
            named = re.search(r"\{([^}]*)\}", what)
            default = re.sub(r"\{[^}]*\}", "", what).strip(" ,")
            if default and "*" not in default:
                out.append(_item(m["module"], "default", None, default))
            for part in named[1].split(",") if named else ():
                symbol, alias = _aliased(part.strip().removeprefix("type "))
                if symbol:
                    out.append(_item(m["module"], symbol, alias, alias or symbol))
    return out
