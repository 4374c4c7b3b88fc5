"""Functions, classes, calls and comments of one source text (Python, Rust, Go, JavaScript, TypeScript).

Strings and comments are blanked first, in one pass; declarations and the brackets that end them are then looked
for in what is left, at the same places. That finds declarations in code as people write it; it is no parser (no
macros, no generated templates).
Everything across files (symbols, imports, edges) is done with joins, see operators/resolve.py.
"""

from __future__ import annotations

import re

#: File extensions of each language.
EXTENSIONS = {
    "python": ["py"],
    "rust": ["rs"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "typescript": ["ts", "tsx", "mts", "cts"],
    "go": ["go"],
}
LANGUAGE_OF = {e: lang for lang, es in EXTENSIONS.items() for e in es}

_STRINGS = r'"(?:\\.|[^"\\\n])*"'
#: An unclosed comment reaches to the end, so that it is looked through once.
_C_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_JS_REGEX = r"(?:(?<=[=(,:;!&|?{}\[])|(?<=\breturn))[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/"
#: What is no code: strings and comments (and patterns in JavaScript).
_SKIPPED = {
    "python": re.compile(r"(?:\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\.|[^\\])*?(?:'''|\Z))|" + _STRINGS + r"|'(?:\\.|[^'\\\n])*'|#[^\n]*", re.S),
    "rust": re.compile(_C_COMMENT + r"|b?r(#*)\".*?(?:\"\1|\Z)|b?\"(?:\\.|[^\"\\])*\"|'(?:\\[^\n']+|[^'\\\n])'", re.S),
    "go": re.compile(_C_COMMENT + "|" + _STRINGS + r"|`[^`]*`|'(?:\\[^\n']+|[^'\\\n])'", re.S),
    "javascript": re.compile(_C_COMMENT + "|" + _STRINGS + r"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|" + _JS_REGEX, re.S),
}
_SKIPPED["typescript"] = _SKIPPED["javascript"]
_TOKENS = {
    "python": re.compile(r"^(?P<indent>[ \t]*)(?:async[ \t]+)?(?P<kind>def|class)[ \t]+(?P<name>\w+)", re.M),
    "rust": re.compile(r"\b(?P<owner>impl|trait)\b(?P<head>[^;{]*)\{|\bfn\s+(?P<name>\w+)|(?P<brace>[{};])"),
    "go": re.compile(
        r"^func\s+(?:\((?P<recv>[^)]*)\)\s*)?(?P<name>\w+)|^type\s+(?P<declares>\w+)(?:\[[^\]]*\])?\s+interface\s*\{|^[ \t]+(?P<method>[A-Za-z]\w*)\(|(?P<brace>[{}])", re.M
    ),
    "javascript": re.compile(
        r"\bclass\s+(?P<owner>[\w$]+)(?P<head>[^;{]*)\{|\binterface\s+(?P<declares>[\w$]+)(?P<more>[^;{=]*)\{"
        r"|\bfunction\s*\*?\s*(?P<name>[\w$]+)"
        r"|\b(?:const|let|var)\s+(?P<bound>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?:function\b|(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|[\w$]+)\s*(?::[^=\n{]+)?=>)"
        r"|^[ \t]*(?:(?:public|private|protected|static|async|readonly|override|get|set|abstract)\s+)*[*#]?(?P<method>[\w$]+)\s*(?:<[^>\n]*>)?\("
        r"|(?P<brace>[{}])",
        re.M,
    ),
}
_TOKENS["typescript"] = _TOKENS["javascript"]
_NOT_METHODS = frozenset("if for while switch catch return function with do else new typeof await throw super".split())
_CALL = {
    "python": re.compile(r"(?:\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\.|[^\\])*?(?:'''|\Z))|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|#[^\n]*|(?<![\w.])(?P<c>[A-Za-z_]\w*(?:\s*\.\s*\w+)*)\s*\(", re.S),
    "rust": re.compile(_C_COMMENT + r"|\"(?:\\.|[^\"\\])*\"|(?<![\w.:])(?P<c>[A-Za-z_]\w*(?:(?:\.|::)\w+)*)(?:::<[^()]*?>)?\s*\(", re.S),
    "js": re.compile(_C_COMMENT + r"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|(?<![\w.$])(?P<c>[A-Za-z_$][\w$]*(?:\??\.[\w$]+)*)\s*\(", re.S),
}
_CALL["go"] = _CALL["javascript"] = _CALL["typescript"] = _CALL["js"]
_NOT_CALLS = frozenset(
    "if for while switch match return def class fn func function catch elif else and or not in is lambda print_ with assert del yield await new typeof async loop unsafe move".split()
)


def language_of(path: str, language: str | None = None) -> str | None:
    """The language by extension, else by its name in any spelling."""
    found = LANGUAGE_OF.get(path.rsplit(".", 1)[-1].lower())
    if found or not language:
        return found
    named = language.strip().lower()
    return LANGUAGE_OF.get(named, named if named in EXTENSIONS else None)


def is_test_name(name: str) -> bool:
    return bool(re.match(r"test_.", name, re.S)) or (name.startswith("test") and name[4:5].isupper())


def blanked(text: str, language: str) -> str:
    """The text with spaces for strings and comments; line breaks and all places stay. Python's comments keep their mark."""

    def blank(m: re.Match) -> str:
        out = re.sub(r"[^\n]", " ", m.group())
        return "#" + out[1:] if language == "python" and m.group().startswith("#") else out

    return _SKIPPED[language].sub(blank, text)


def _close(text: str, at: int, opened: str, closed: str) -> int:
    """The place behind the bracket that closes the one at ``at``."""
    depth = 0
    for m in re.compile(f"[{re.escape(opened + closed)}]").finditer(text, at):
        depth += 1 if m.group() == opened else -1
        if not depth:
            return m.end()
    return len(text)


_BASES = re.compile(r"[ \t]*\(([^()]*)\)")


def _python(text: str, bare: str) -> list[dict]:
    out, stack = [], []  # stack: (indent, kind, name, bases)
    for m in _TOKENS["python"].finditer(bare):
        indent = len(m["indent"].expandtabs(8))
        while stack and stack[-1][0] >= indent:
            stack.pop()
        inside = any(x[1] == "def" for x in stack)
        owner = stack[-1][2] if stack and stack[-1][1] == "class" else ""
        heads = _BASES.match(bare, m.end()) if m["kind"] == "class" else None
        stack.append((indent, m["kind"], m["name"], re.findall(r"(\w+)\s*(?:\[[^\]]*\])?\s*(?:,|$)", heads[1]) if heads else []))
        if not inside:
            bases = stack[-2][3] if owner else []
            out.append({"name": m["name"], "owner": owner if m["kind"] == "def" else "", "kind": m["kind"], "at": m.start("kind"), "indent": indent, "within": owner, "bases": bases})
    lines_end = len(text.rstrip())
    for d in out:
        body = re.compile(r"^(?![ \t]{%d,}\S|[ \t]*$|[ \t]*[)\]])" % (d["indent"] + 1), re.M)
        opened = re.compile(r"\w+[ \t]+\w+[ \t]*(?:\[[^\]]*\])?[ \t]*\(").match(bare, d["at"])
        d["head"] = _close(bare, opened.end() - 1, "(", ")") if opened else d["at"]
        start = text.find("\n", d["head"])
        m = body.search(bare, start + 1) if start >= 0 else None
        d["end"] = len(text[: m.start() if m else lines_end].rstrip())
        d["body"] = True
    return out


def _braced(text: str, language: str) -> list[dict]:
    """The declarations of a blanked text."""
    out, owners, depth = [], [], 0  # owners: (depth inside, owner in ids, type, bases, only declares)
    until = -1  # inside this function's body nothing is a declaration
    for m in _TOKENS[language].finditer(text):
        if m.start() < until:
            continue
        kind = m.lastgroup
        if kind == "brace":
            depth += {"{": 1, "}": -1, ";": 0}[m["brace"]]
            while owners and owners[-1][0] > depth:
                owners.pop()
            continue
        found = m.groupdict()
        if found.get("owner") or found.get("declares"):
            if language == "rust":
                head = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", m["head"])).split(" where ")[0]
                name = re.findall(r"\w+", head.split(" for ")[-1])
                if m["owner"] == "impl":
                    of = re.findall(r"\w+", head.split(" for ")[0])[-1:] if " for " in head else []
                    owners.append((depth + 1, name[-1] if name else "", name[-1] if name else "", of, False))
                else:
                    owners.append((depth + 1, "", name[0] if name else "", re.findall(r"\w+", head.partition(":")[2]), False))
            elif found.get("declares"):
                owners.append((depth + 1, m["declares"], m["declares"], re.findall(r"[\w$]+", found.get("more") or "")[1:], True))
            else:
                name = m["owner"]
                of = [x for x in re.findall(r"[\w$]+", re.sub(r"<[^<>]*>", "", m["head"])) if x not in ("extends", "implements")]
                owners.append((depth + 1, name, name, of, False))
                out.append({"name": name, "owner": "", "kind": "class", "at": m.start(), "end": _close(text, m.end() - 1, "{", "}"), "body": True, "within": "", "bases": []})
            depth += 1
            continue
        name = found.get("name") or found.get("bound") or found.get("method")
        if not name:
            continue
        _, owner, within, bases, declares = owners[-1] if owners and owners[-1][0] == depth else (0, "", "", [], False)
        if found.get("method") and (not owner or name in _NOT_METHODS):
            continue
        if found.get("recv") is not None:
            types = re.findall(r"\w+", re.sub(r"\[[^\]]*\]", "", m["recv"]))
            owner = within = types[-1] if types else ""
        at = m.start(next(k for k in ("name", "bound", "method") if found.get(k)))
        opened = text.find("(", at)
        after = _close(text, opened, "(", ")") if opened >= 0 and not found.get("bound") else m.end()
        brace = re.compile(r"[{;\n]" if declares else r"[{;]").search(text, after)
        if declares:
            stop, body = (brace.start() if brace else after), False
        elif found.get("bound"):
            arrow = re.compile(r"\s*\{").match(text, m.end())
            stop = _close(text, arrow.end() - 1, "{", "}") if arrow or "function" in m.group() and brace else text.find("\n", m.end())
            if not arrow and "function" in m.group() and brace:
                stop = _close(text, brace.start(), "{", "}")
            stop, body = (len(text) if stop < 0 else stop), True
        elif brace and brace.group() == "{":
            stop, body = _close(text, brace.start(), "{", "}"), True
        else:
            stop, body = (brace.end() if brace else after), False
        out.append({"name": name, "owner": owner, "kind": "def", "at": at, "end": stop, "body": body, "within": within, "bases": bases, "interface": declares})
        until = stop
    return out


def scan(path: str, text: str, language: str | None = None, calls: bool = False, interfaces: bool = False) -> list[dict]:
    """The declarations of a text: id, name, owner, entity_type, line_start, line_end, signature, body, doc, code (and calls).

    ``within`` is the type, trait or interface around a method, ``bases`` what that type extends or implements. With
    ``interfaces`` the methods that interfaces only declare come too.

    Lines count from 1; CRLF is read as LF. An unknown language gives none. Nested functions belong to the
    function around them.
    """
    language = language_of(path, language)
    if not language or not text:
        return []
    text = text.replace("\r\n", "\n")
    bare = blanked(text, language)
    found = _python(text, bare) if language == "python" else _braced(bare, language)
    lines = text.split("\n")
    breaks = [0]
    for line in lines:
        breaks.append(breaks[-1] + len(line) + 1)
    out, row = [], 0
    named = {text.find(d["name"], d["at"]) for d in found}
    for d in sorted(found, key=lambda d: d["at"]):
        if d.get("interface") and not interfaces:
            continue
        while breaks[row + 1] <= d["at"]:
            row += 1
        last = row
        while breaks[last + 1] < d["end"]:
            last += 1
        start = breaks[row]
        opened = bare.find("(", d["at"], d["end"])
        args = text[opened : _close(bare, opened, "(", ")")] if opened >= 0 else ""
        owner = d["owner"]
        is_class = d["kind"] == "class"
        test = is_test_name(d["name"])
        if language == "rust":
            test = any(re.match(r"\s*#\[\s*(?:\w+\s*::\s*)*(?:test|rstest|wasm_bindgen_test)\s*[\](]", x) for x in _attributes(lines, row))
        elif language == "go":
            test = bool(re.match(r"Test(?![a-z])", d["name"])) and "testing.T" in args
        entity = {
            "id": "::".join(x for x in (path, owner, d["name"]) if x),
            "name": d["name"],
            "owner": owner,
            "entity_type": "class" if is_class else "test_function" if test else "method" if owner else "function",
            "line_start": row + 1,
            "line_end": last + 1,
            "signature": signature(args, language),
            "body": d["body"],
            "within": d["within"],
            "bases": d["bases"],
            "doc": doc_comment(lines, row, text, bare, d.get("head", d["at"]), language),
            "code": text[start : d["end"]],
        }
        if calls:
            entity["calls"] = called(text, d["at"], d["end"], language, named)
        out.append(entity)
    return out


def called(text: str, start: int, end: int, language: str, named: set[int]) -> list[str]:
    """The callee texts between two places, in order, each once; ``named`` are the places of declared names.

    A leading ``this.`` is dropped. Names that are declared there, keywords and nested declarations aren't calls.
    """
    out = {}
    for m in _CALL[language].finditer(text, start, end):
        if not m["c"] or m.start("c") in named or re.search(r"\b(?:def|fn|func|function|class|new)\s+$", text[max(0, m.start() - 20) : m.start()]):
            continue
        name = re.sub(r"\s", "", m["c"])
        if language in ("javascript", "typescript"):
            name = name.removeprefix("this.")
        if name.split(".")[0] not in _NOT_CALLS:
            out[name] = None
    return list(out)


def _attributes(lines: list[str], row: int) -> list[str]:
    """The Rust attribute lines directly above a row, comments between them passed over."""
    out = []
    for i in range(row - 1, -1, -1):
        s = lines[i].strip()
        if s.startswith("#["):
            out.append(s)
        elif not (s.startswith(("//", "/*", "*")) or s.endswith("*/")):
            break
    return out


def signature(args: str, language: str) -> str:
    """The parameters without names, defaults and spacing: ``(u32,&str)``, or ``(_,_)`` where types aren't written."""
    inner = args.strip()[1:-1] if args else ""
    parts, depth, part = [], 0, ""
    for c in inner:
        depth += (c in "([{<") - (c in ")]}>")
        if c == "," and depth == 0:
            parts.append(part)
            part = ""
        else:
            part += c
    parts = [p.strip() for p in [*parts, part] if p.strip()]
    kinds = []
    for p in parts:
        p = re.split(r"(?<![=!<>])=(?![=>])", p)[0].strip()
        if re.fullmatch(r"&?\s*(?:mut\s+)?self|cls", p):
            continue
        if language == "go":
            kinds.append(p.split(None, 1)[1] if " " in p else "_")
        else:
            kinds.append(p.split(":", 1)[1].strip() if ":" in p else "_")
    return "(" + ",".join(re.sub(r"\s+", "", k) for k in kinds) + ")"


_PY_DOC = re.compile(r"(?:[ \t]*(?:#[^\n]*)?\n)*[ \t]*(?P<prefix>[rRuU]?)(?P<q>\"\"\"|'''|\"|')")


def doc_comment(lines: list[str], row: int, text: str, bare: str, head: int, language: str) -> str | None:
    """The documentation comment of the declaration in line ``row`` (from 0), without its marks; None if there is none.

    ``bare`` is the blanked text, ``head`` the place behind a Python declaration's parameters.

    Python: the string that opens the body. Rust: outer doc comments (line, block, attribute) directly above,
    other attributes may stand between. Go: a comment directly above. JavaScript, TypeScript: a ``/** */``
    block directly above, decorators may stand between.
    """
    if language == "python":
        colon = re.compile(r"[^\n:]*(?::(?![ \t]*(?:#[^\n]*)?$)[^\n:]*)*:[ \t]*(?:#[^\n]*)?\n", re.M).match(bare, head)
        m = _PY_DOC.match(text, colon.end()) if colon else None
        if not m:
            return None
        body = re.compile(r"((?:\\.|[^\\])*?)" + m["q"], re.S).match(text, m.end())
        return body.group(1) if body else None
    out: list[str] = []
    i = row - 1
    while i >= 0:
        s = lines[i].strip()
        if language == "rust" and s.startswith("#["):
            m = re.match(r"#\[\s*doc\s*=\s*r?#*\"(.*)\"#*\s*\]", s)
            if m:
                out.append(m[1].replace('\\"', '"'))
        elif language == "rust" and s.startswith("///") and not s.startswith("////"):
            out.append(s[3:])
        elif language == "go" and s.startswith("//"):
            if not re.match(r"//(?:go:|export |line |nolint)", s):
                out.append(s[2:])
        elif s.endswith("*/"):
            k = i
            while k >= 0 and "/*" not in lines[k]:
                k -= 1
            block = "\n".join(lines[max(k, 0) : i + 1]).strip()
            if k < 0 or not block.startswith("/*"):
                break
            is_doc = block.startswith("/**") and not block.startswith(("/***", "/**/"))
            if language == "go" or is_doc:
                inner = re.sub(r"^/\*\*?|\*/$", "", block)
                out.append("\n".join(re.sub(r"^\s*\*(?!\*)", "", x) for x in inner.split("\n")))
            if language in ("javascript", "typescript") or not (is_doc or language == "go"):
                break
            i = k
        elif language in ("javascript", "typescript") and s.startswith("@"):
            pass
        else:
            break
        i -= 1
    return "\n".join(reversed(out)) if out else None
