"""Source trees and file tables as DataFrames, and the extraction of entities and imports from them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import materialize
from codeloom.sources.imports import imports_of
from codeloom.sources.scan import EXTENSIONS, scan

#: The extensions that a watcher looks at, in this spelling only.
WATCHED = ("rs", "py", "js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts", "go")

ENTITY_FIELDS = (
    "id string, name string, entity_type string, file_path string, line_start int, line_end int, language string,"
    " docstring string, calls array<string>"
)
IMPORT_FIELDS = "source_file string, module_path string, symbol string, alias string, imported_name string, ordinal int"


def read_tree(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """(file_path, content) of the source files below ``root``, paths relative to it.

    Each file is one row. Files that aren't UTF-8 are left out; ``exclude`` names path components, as in
    not_excluded.
    """
    base = root.rstrip("/") + "/"
    names = "*.{" + ",".join(WATCHED) + "}"  # the others aren't opened
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=names).load(base)
    path = F.substring_index(F.col("path"), base, -1)
    rows = files.select(path.alias("file_path"), F.col("content").alias("raw")).where(is_source_file(F.col("file_path")))
    rows = rows.where(not_excluded(F.col("file_path"), exclude or [])).where("is_valid_utf8(cast(raw as string))")
    return rows.select("file_path", F.col("raw").cast("string").alias("content"))


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; null without one."""
    return F.nullif(F.regexp_extract(path, r"[^/\\]\.([^./\\]+)$", 1), F.lit(""))


def infer_language(path: Column) -> Column:
    """The language by extension in any case; null for others."""
    ext, out = F.lower(extension(path)), F.lit(None).cast("string")
    for language, extensions in EXTENSIONS.items():
        out = F.when(ext.isin(extensions), language).otherwise(out)
    return out


def is_source_file(path: Column) -> Column:
    return F.coalesce(extension(path).isin(*WATCHED), F.lit(False))


def not_excluded(path: Column, exclude: list[str]) -> Column:
    """False where any component of the path equals one of the names, in any case."""
    names = [x.lower() for x in exclude]
    return ~F.exists(F.split(F.lower(path), "/"), lambda part: part.isin(names)) if names else F.lit(True)


def module_name(path: Column) -> Column:
    """The dotted module of a root-relative path; `__init__` and `mod` files are their folder."""
    bare = F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")
    folder = F.regexp_replace(bare, r"/?(__init__|mod)$", "")
    whole = F.when(F.substring_index(bare, "/", -1).isin("__init__", "mod"), folder).otherwise(bare)
    return F.translate(F.ltrim(whole, F.lit("/")), "/", ".")


_FACTS = f"{ENTITY_FIELDS}, module_path string, symbol string, alias string, imported_name string, ordinal int"


def extract_facts(files: DataFrame) -> DataFrame:
    """Entities and imports of (file_path, language, content) rows in one pass over the texts.

    A row is an entity (``ordinal`` is null) or an import of ``file_path``, with ``ordinal`` its place in the file.
    Repeated rows count once, and rows without path or content give none. The texts never move: what they hold is
    compared, not they themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"line_start": pa.int32(), "line_end": pa.int32(), "ordinal": pa.int32(), "calls": pa.list_(pa.string())}
        names = [f.split()[0] for f in _FACTS.split(",")]
        for batch in batches:
            rows = []
            for path, language, content in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [d | {"file_path": path, "docstring": d["doc"]} for d in scan(path, content, language, calls=True)]
                rows += [d | {"file_path": path, "ordinal": i} for i, d in enumerate(imports_of(path, content, language))]
            yield from pa.table({n: pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in names}).to_batches()

    texts = files.where("file_path is not null and content is not null").select("file_path", "language", "content")
    return texts.mapInArrow(run, _FACTS).distinct().withColumn("language", infer_language(F.col("file_path")))


def _entities(facts: DataFrame) -> DataFrame:
    return facts.where("ordinal is null").select([f.split()[0] for f in ENTITY_FIELDS.replace("array<string>", "x").split(", ")])


def _imports(facts: DataFrame) -> DataFrame:
    return facts.where("ordinal is not null").select(F.col("file_path").alias("source_file"), "module_path", "symbol", "alias", "imported_name", "ordinal")


def extract_entities(files: DataFrame) -> DataFrame:
    """Entities of (file_path, language, content) rows, with the callee texts of each; repeated rows count once."""
    return _entities(extract_facts(files))


def extract_imports(files: DataFrame) -> DataFrame:
    """Imports of (file_path, language, content) rows; ``ordinal`` is their place in the file."""
    return _imports(extract_facts(files))


def extract_all(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """extract_entities and extract_imports from one pass, written once."""
    facts = materialize(extract_facts(files))
    return _entities(facts), _imports(facts)
