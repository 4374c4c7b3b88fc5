"""Very long and odd texts pass through every operator in reasonable time."""

import time

import pytest
from pyspark.sql import functions as F

from codeloom.llm import docpairs, leakage, mixing, provenance, residue

LONG = [
    "word " * 40_000,
    "a" * 200_000,
    "(" * 40_000,
    '"""' + "x" * 60_000,
    "/* " * 20_000,
    "{{ " * 20_000,
    "var x = (a, " * 10_000,
    "\n" * 60_000,
    "\u0000퟿\U0001f600" * 10_000,
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("name", ["docs", "files", "leaks", "tokens", "residue"])
def test_long_texts(spark, texts, name):
    begun = time.time()
    files = texts.select(F.concat(F.lit("src/f"), "doc_id", F.element_at(F.array(F.lit(".py"), F.lit(".js"), F.lit(".rs"), F.lit(".go")), (F.col("doc_id") % 4 + 1).cast("int"))).alias("file_path"), F.lit("r").alias("repo"), F.lit(None).cast("string").alias("language"), F.col("text").alias("content"))
    if name == "docs":
        assert docpairs.declarations(files).count() >= 0
    elif name == "files":
        assert provenance.classify(files).count() == len(LONG)
    elif name == "leaks":
        items = spark.createDataFrame([(1, "answer", "word " * 20)], "item_id long, kind string, text string")
        assert [r["doc_id"] for r in leakage.leaked_items(texts, items).collect()] == [0]
    elif name == "tokens":
        counted = mixing.token_counts(texts.withColumn("source", F.lit("s")))
        assert counted.where("n_tokens > 0").count() == len(LONG)
    else:
        assert residue.residue(texts).count() >= 0
    assert time.time() - begun < 120
