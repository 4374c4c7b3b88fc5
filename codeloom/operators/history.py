"""Recency, frequency and errors in the action log. An action delivered twice is one action."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paths import clean_action, clean_path, encode_path
from codeloom.sources.tables import distinct_actions


def cleaned_actions(actions: DataFrame) -> DataFrame:
    """(id, session_id, action_type, file_path, entity_id, ts, metadata): one row per id, spellings cleaned."""
    kept = distinct_actions(actions, ["id", "session_id", "action_type", "file_path", "entity_id", "ts", "metadata"])
    return kept.withColumns({"action_type": clean_action(F.col("action_type")), "file_path": clean_path(F.col("file_path"))})


def file_access(actions: DataFrame) -> DataFrame:
    """(file_path, n_accesses, last_accessed) of every file in the log."""
    return (
        cleaned_actions(actions)
        .where("file_path is not null")
        .groupBy("file_path")
        .agg(F.count(F.lit(1)).alias("n_accesses"), F.max("ts").alias("last_accessed"))
    )


def recent_files(actions: DataFrame, n: int) -> DataFrame:
    """The n files accessed last, latest first; ties by the later action id.

    A delivery twice moves no maximum, so the log isn't reduced to one row per id first.
    """
    last = (
        actions.where("file_path is not null and ts is not null")
        .groupBy(clean_path(F.col("file_path")).alias("file_path"))
        .agg(F.max(F.struct("ts", "id")).alias("last"))
    )
    return last.select("file_path", F.col("last.ts").alias("last_accessed"), F.col("last.id").alias("last_id")).orderBy(
        F.desc("last_accessed"), F.desc("last_id")
    ).limit(max(n, 0))


def frequent_files(actions: DataFrame, n: int) -> DataFrame:
    """The n files with most actions; ties by last access, then path."""
    ordered = file_access(actions).orderBy(F.desc("n_accesses"), F.desc("last_accessed"), encode_path(F.col("file_path")))
    return ordered.limit(max(n, 0))


def recent_errors(actions: DataFrame, n: int) -> DataFrame:
    """The n latest errors."""
    errors = actions.where(clean_action(F.col("action_type")) == "error")
    return cleaned_actions(errors).orderBy(F.desc("ts"), F.desc("id")).limit(max(n, 0))


def action_by_id(actions: DataFrame, action_id: str) -> DataFrame:
    return cleaned_actions(actions.where(F.col("id") == action_id))


def total_actions(actions: DataFrame) -> DataFrame:
    return actions.where("id is not null").select("id").distinct().agg(F.count(F.lit(1)).alias("n_actions"))


def access_of(files: DataFrame, actions: DataFrame) -> DataFrame:
    """``files`` (file_path) with their counts, 0 and null for those never accessed."""
    return files.join(file_access(actions), "file_path", "left").fillna(0, ["n_accesses"])


def stale_files(actions: DataFrame, entities: DataFrame) -> DataFrame:
    """(file_path): files edited after their last index run."""
    edits = (
        actions.where(clean_action(F.col("action_type")) == "file_edit")
        .groupBy(clean_path(F.col("file_path")).alias("file_path"))
        .agg(F.max("ts").alias("edited"))
    )
    indexed = entities.groupBy("file_path").agg(F.max("indexed_at").alias("indexed"))
    return edits.join(indexed, "file_path").where("edited > indexed").select("file_path")
