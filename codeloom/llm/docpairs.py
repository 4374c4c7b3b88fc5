"""Functions paired with their documentation (problem 1).

Method: the declarations of all files form a symbol table. A definition takes its own documentation comment, else
that of a separate declaration: one of the same module-qualified name and normalised signature (a stub file in any
root, an overload), or the method of that name and signature in a trait, interface or base class that its
type names, wherever that is declared in the repository (in Go, an interface of the same package). Only then are
empty and trivial texts dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import materialize
from codeloom.sources.scan import scan

_DECLARATIONS = (
    "file_path string, repo string, language string, id string, name string, owner string, entity_type string,"
    " line_start int, signature string, body boolean, within string, bases array<string>, doc string, code string"
)

#: Line openings and whole lines that say nothing.
_TODO = re.compile(r"(?i)(?:todo|fixme|xxx|tbd|wip|hack)\b")
_LICENCE = re.compile(r"(?i)\bspdx\b|\blicen[sc]ed\b|\ball rights reserved\b|^\W*copyright\b|^\W*(?:\(c\)|©)\s*\d{4}|\bLICENSE(?:\.\w+)?\b")
_STUB = re.compile(
    r"(?i)\W*(?:(?:auto-?\s?generated\s+)?(?:method|function|docstring|class|code)?\s*(?:stub|placeholder)(?:\s+(?:created|generated|added)\b.*)?"
    r"|(?:stub|placeholder)\b.{0,40}|(?:method|function|class|module|short|brief)?\s*(?:description|summary|documentation|docstring|comment|text)(?:\s+(?:goes|comes)?\s*here)?"
    r"|(?:please\s+)?(?:add|insert|write|enter|put|your)\s+(?:a |an |the |your |some )?(?:short |brief )?(?:summary|description|doc\w*|comment|text)(?:\s+here)?"
    r"|fill (?:me|this|it)(?: in)?|no (?:description|documentation|docs?|comment)(?: (?:yet|available|provided))?|undocumented|not documented(?: yet)?|to be (?:documented|written|done|defined|added)|coming soon|n/?a|none|null|nil|empty|docs?|lorem ipsum.*)\W*"
)
_CODE = re.compile(r"(?:(?:let|const|var|return|await|mut)\s+)*[\w.\[\]]+(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|(?:\s*:?=\s*\S.*))[;{]?")
_CODE_LINE = re.compile(r"(?:return|let|const|var|import|from|use|def|fn|func|function|if|for|while|package)\b.*[;{}()=]\s*:?|.*[;{}]|\}|\)|>>>.*")
_TAG = re.compile(r"[@\\](?P<t>\w+)|:(?P<r>\w+)(?:[^:\n]*):|(?:Args|Arguments|Parameters|Params|Returns?|Raises|Yields|Throws|Examples?|Notes?|See also|Attributes)\s*(?::|$)", re.I)
_NAMED = frozenset("param parameter arg argument property prop template typeparam throws raises exception type".split())
_FILLER = frozenset("a an the this that function method is are called named test tests of for to and it does routine helper".split())
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+|\d+")


def _forms(word: str) -> set[str]:
    w = word.lower()
    out = {w}
    for end, more in (("s", ""), ("es", ""), ("ies", "y"), ("ed", ""), ("ed", "e"), ("ing", ""), ("ing", "e"), ("er", ""), ("er", "e")):
        if w.endswith(end) and len(w) > len(end) + 2:
            out.add(w[: -len(end)] + more)
            if len(w) > len(end) + 3 and w[-len(end) - 1] == w[-len(end) - 2 : -len(end) - 1] and end in ("ed", "ing"):
                out.add(w[: -len(end) - 1])
    return out


def says_something(doc: str | None, name: str | None) -> bool:
    """Whether a documentation text has prose beyond to-do marks, stubs, the name, bare tags, code and licences."""
    if not doc:
        return False
    own = set().union(*[_forms(w) for w in _WORD.findall(name or "")]) if name else set()
    for raw in doc.split("\n"):
        line = re.sub(r"^[\s*/#!\"'`]+|[\s*/#\"'`]+$", "", raw)
        tag = _TAG.match(line)
        if tag:
            rest = re.sub(r"^\s*\{[^}]*\}", "", line[tag.end() :])
            if (tag["t"] or "").lower() in _NAMED:
                rest = re.sub(r"^\s*[\[\]\w.$*=]+", "", rest)
            line = re.sub(r"^[\s:\-–]+", "", rest)
            if len(re.findall(r"[^\W\d_]{2,}", line)) < 2:
                continue
        if not re.search(r"[^\W\d_]", line) or _TODO.match(line) or _LICENCE.search(line) or _STUB.fullmatch(line):
            continue
        if _CODE.fullmatch(line) or _CODE_LINE.fullmatch(line):
            continue
        words = [w for w in _WORD.findall(line) if w.lower() not in _FILLER and not w.isdigit()]
        if not words or all(_forms(w) & own for w in words):
            continue
        return True
    return False


def description(doc: str) -> str:
    """The text without comment marks, one space for each stretch of white space within a line."""
    lines = [re.sub(r"\s+", " ", re.sub(r"^[\s*/#!]+", "", x)).strip() for x in doc.split("\n")]
    return "\n".join(lines).strip()


def declarations(source_files: DataFrame, code: str = "all") -> DataFrame:
    """A row for each declaration in the files. Rows without path or content give none.

    ``code``: whether all have their code, or only those that are "documented", or "none".
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _DECLARATIONS.split(",")]
        for batch in batches:
            rows = []
            for path, repo, language, content in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if path is None or content is None:
                    continue
                for d in scan(path, content, language, interfaces=True):
                    if d["entity_type"] != "class":
                        rows.append(d | {"file_path": path, "repo": repo, "language": language, "code": d["code"] if code == "all" or code == "documented" and d["doc"] else None})
            kinds = {"line_start": pa.int32(), "body": pa.bool_(), "bases": pa.list_(pa.string())}
            cols = {n: pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names}
            yield from pa.table(cols).to_batches()

    return source_files.select("file_path", "repo", "language", "content").mapInArrow(run, _DECLARATIONS)


#: Folders that hold sources or declarations, and are no part of a module's name.
_ROOTS = r"^(?:(?:src|lib|stubs|typings|types|@types|include)/)+"


def symbol_docs(table: DataFrame) -> DataFrame:
    """``table`` of declarations with documentation found elsewhere filled in; ``doc_from`` is own, declaration, base or null.

    A definition without documentation takes that of a documented declaration of the same repository: first of
    one with its module (the path without `.d`, extension and _ROOTS), owner, name and normalised signature, then of
    the method with its name and normalised signature in the traits, interfaces and base classes of its type, in
    their order. Of several the first by path and line. The symbol table has one row a key, made with map-side
    combine; keys that many definitions ask for are split by AQE.
    """
    repo, sep = F.coalesce("repo", F.lit("")), "\u0001"
    module = F.regexp_replace(F.regexp_replace("file_path", r"(\.d)?\.\w+$", ""), _ROOTS, "")
    go = F.col("file_path").endswith(".go")
    folder = F.regexp_replace("file_path", r"/?[^/]*$", "")
    here = F.concat_ws(sep, F.lit("name"), repo, module, "owner", "name", "signature")
    member = lambda base: F.concat_ws(sep, F.lit("base"), repo, base, "name", "signature")
    package = F.concat(F.lit("*"), folder)

    own = F.length(F.trim("doc")) > 0
    separate = ~F.col("body") | F.col("file_path").rlike(r"(\.d\.[mc]?ts|\.pyi)$")
    gives = F.filter(F.array(F.when(separate, here), F.when(F.col("within") != "", member(F.when(go, F.when(separate, package)).otherwise(F.col("within"))))), lambda k: k.isNotNull())
    # a missing base makes concat_ws leave it out, so Go's definitions are told apart here
    gives = F.when(go & F.col("body"), F.array().cast("array<string>")).otherwise(gives)
    symbols = (
        table.where(own)
        .select(F.explode(gives).alias("key"), "doc", "file_path", "line_start")
        .groupBy("key")
        .agg(F.min_by("doc", F.struct("file_path", "line_start")).alias("found"))
    )
    asks = F.concat(F.array(here), F.when(go, F.when(F.col("within") != "", F.array(member(package)))).otherwise(F.transform("bases", member)))
    documented = table.where(own).withColumn("doc_from", F.lit("own"))
    bare = table.where(~F.coalesce(own, F.lit(False)))
    at = ["repo", "file_path", "line_start", "id"]
    asked = bare.select(*at, F.posexplode(F.coalesce(asks, F.array(here))).alias("rank", "key")).join(symbols, "key")
    taken = asked.groupBy(*at).agg(F.min_by(F.struct("found", "rank"), "rank").alias("t"))
    taken = taken.select(*[F.col(c).alias(f"_{c}") for c in at], F.col("t.found").alias("found"), F.col("t.rank").alias("rank"))
    same = [bare[c].eqNullSafe(taken[f"_{c}"]) if c == "repo" else bare[c] == taken[f"_{c}"] for c in at]
    filled = bare.join(taken, same, "left").withColumns(
        {"doc_from": F.when(F.col("rank") == 0, "declaration").when(F.col("rank") > 0, "base"), "doc": F.coalesce("found", "doc")}
    )
    return documented.unionByName(filled.select(documented.columns))


def documented_functions(source_files: DataFrame, entities: DataFrame, code: bool = True) -> DataFrame:
    """(entity_id, name, entity_type, language, file_path, line_start, description, doc_from, code): one row per entity id.

    The entities of type function, method and test_function, deleted ones and repeated rows included, whose
    function in source_files has documentation that says something. The texts come from source_files alone:
    entities.docstring may be missing, cut or stale. Of several declarations with one id the first documented
    one counts. Empty or null content, unknown languages and empty tables give no rows; extra columns are
    ignored.
    """
    # the code of functions without documentation, most of which give no pair, isn't written
    table = symbol_docs(materialize(declarations(source_files, "documented" if code else "none")))

    @F.pandas_udf("string")
    def kept(doc: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([description(d) if says_something(d, n) else None for d, n in zip(doc, name)], dtype=object)

    told = table.withColumn("description", kept("doc", "name")).where("description is not null")
    ids = entities.where("id is not null and entity_type in ('function', 'method', 'test_function')").select(F.col("id").alias("entity_id")).distinct()
    w = Window.partitionBy("entity_id").orderBy(F.col("doc_from") != "own", "file_path", "line_start")
    first = told.withColumnRenamed("id", "entity_id").withColumn("nth", F.row_number().over(w)).where("nth = 1")
    first = first.join(ids, "entity_id", "left_semi")
    if code:
        first = materialize(first)
        files = first.where("doc_from <> 'own'").select("file_path").distinct()
        late = declarations(source_files.join(files, "file_path", "left_semi")).groupBy(F.col("id").alias("entity_id"), "line_start").agg(F.first("code").alias("late"))
        first = first.join(late, ["entity_id", "line_start"], "left").withColumn("code", F.coalesce("code", "late"))
    return first.select("entity_id", "name", "entity_type", "language", "file_path", "line_start", "description", "doc_from", "code")
