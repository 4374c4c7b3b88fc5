"""Runs of the same action on the same file in a session (problem 5).

Method: chunks of the actions, range sorted by (session, time, id), encode their runs locally; the runs at
the edges of neighbouring chunks are joined where they agree. A session of any size spreads over chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paths import clean_action, clean_path
from codeloom.operators.chunks import ordered_runs
from codeloom.operators.orphans import micros


def collapse_runs(actions: DataFrame, chunks: int | None = None) -> DataFrame:
    """The sequence of each session with every run of equal actions as one row.

    (session_id, action_type, file_path, first_id, last_id, first_ts, last_ts, n_actions, span_us, total_ms).
    Actions are ordered by (ts, id) and agree if their spellings, cleaned, do. Rows with one id are one
    action (they carry the same session and ts). Actions without file_path stand alone and end a run. Null
    durations count 0; a null session or ts is a value like any other, first in order; null action types
    agree with each other. An empty table gives no rows; further columns are ignored.
    """
    rows = actions.select("session_id", "ts", "id", "action_type", "file_path", "duration_ms")
    clean = {"action_type": clean_action(F.col("action_type")), "file_path": clean_path(F.col("file_path"))}
    order, run = ["session_id", "ts", "id"], ["session_id", "action_type", "file_path"]
    runs = ordered_runs(rows, order, run, ["session_id"], same=order, alone="file_path", sums=["duration_ms"], ends=["id", "ts"], chunks=chunks, clean=clean)
    return runs.select(
        *run,
        "first_id",
        "last_id",
        "first_ts",
        "last_ts",
        F.col("n_rows").alias("n_actions"),
        (micros(F.col("last_ts")) - micros(F.col("first_ts"))).alias("span_us"),
        F.col("sum_duration_ms").alias("total_ms"),
    )


def repeated_runs(collapsed: DataFrame) -> DataFrame:
    """The runs of two or more actions."""
    return collapsed.where("n_actions >= 2 and file_path is not null")
