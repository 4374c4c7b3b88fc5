"""Queries of the problems on text and code (1, 6, 7, 8, 9), and the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import docpairs, leakage, mixing, provenance, residue
from codeloom.session import materialize
from codeloom.sources.tables import load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query()
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked for are comments at the function itself; p1_pairs has those taken from other declarations too."""
    files, entities = load(spark, sf_dir, "source_files"), load(spark, sf_dir, "entities")
    return docpairs.documented_functions(files, entities, code=False).where("doc_from = 'own'").select("entity_id")


@query()
def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs themselves: code and description of each documented function."""
    return docpairs.documented_functions(load(spark, sf_dir, "source_files"), load(spark, sf_dir, "entities"))


@query()
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = provenance.classify(load(spark, sf_dir, "source_files"))
    return kinds.where("kind is not null").select("file_path").distinct()


@query()
def p6_hand_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that remain, with the entities of each."""
    kinds = provenance.classify(load(spark, sf_dir, "source_files"))
    files = kinds.groupBy("file_path").agg({"kind": "max"}).where("`max(kind)` is null").select("file_path")
    counts = load(spark, sf_dir, "entities").where("id is not null").select("file_path", "id").distinct().groupBy("file_path").count()
    return files.join(counts.withColumnRenamed("count", "n_entities"), "file_path", "left").fillna(0, ["n_entities"])


LEAKS_SQL = """
with w as (
  select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as ws from eval_items where text is not null
), spans as (
  select distinct item_id, array_to_string(ws[i : i + 14], ' ') as span from (select item_id, ws, unnest(range(1, len(ws) - 13)) as i from w where len(ws) >= 15)
), dw as (
  select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as ws from documents where text is not null
), ds as (
  select distinct doc_id, array_to_string(ws[i : i + 14], ' ') as span from (select doc_id, ws, unnest(range(1, len(ws) - 13)) as i from dw where len(ws) >= 15)
)"""


@query(LEAKS_SQL + " select distinct doc_id, item_id from ds join spans using (span)")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


@query(LEAKS_SQL + " select item_id, kind, count(distinct doc_id) as n_docs from ds join spans using (span) join eval_items using (item_id) group by all")
def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaked items with the number of documents that hold each."""
    leaks = leakage.leaked_items(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))
    return leaks.groupBy("item_id", "kind").agg(F.count(F.lit(1)).alias("n_docs"))


@query()
def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = materialize(mixing.token_counts(load(spark, sf_dir, "documents")))
    return mixing.mix(counted, load(spark, sf_dir, "mix_targets"))


@query()
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the share asked for and the share reached."""
    targets = load(spark, sf_dir, "mix_targets")
    counted = materialize(mixing.token_counts(load(spark, sf_dir, "documents")))
    return mixing.shares(materialize(mixing.mix(counted, targets)), counted, targets)


@query()
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(load(spark, sf_dir, "documents")).select("doc_id")


@query()
def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that remain, as (doc_id, n_chars of the text)."""
    documents = load(spark, sf_dir, "documents")
    kept = documents.join(residue.residue(documents).select("doc_id"), "doc_id", "left_anti")
    return kept.select("doc_id", F.length("text").alias("text_chars"))
