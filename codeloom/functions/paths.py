"""Columns for paths, ids and spelling variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_path(path: Column) -> Column:
    """`\\` as `/`, `.` segments and doubled slashes dropped; a leading slash stays. Null stays null."""
    slashed = F.translate(path, "\\", "/")
    parts = F.filter(F.split(slashed, "/"), lambda p: ~p.isin("", "."))
    return F.concat(F.when(slashed.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))


def clean_action(action_type: Column) -> Column:
    """Lower case, `-` as `_`."""
    return F.translate(F.lower(action_type), "-", "_")


def id_name(entity_id: Column) -> Column:
    """The last `::` part of an id."""
    return F.substring_index(entity_id, "::", -1)


def id_path(entity_id: Column) -> Column:
    """The first `::` part of an id."""
    return F.substring_index(entity_id, "::", 1)


def normalize_id(entity_id: Column) -> Column:
    """`\\` as `/` in the path part only."""
    path = id_path(entity_id)
    return F.concat(F.translate(path, "\\", "/"), F.substring(entity_id, F.length(path) + 1, F.length(entity_id)))


def encode_path(path: Column) -> Column:
    """Slashes of either kind as `|`, the form used in ordered keys."""
    return F.translate(path, "/\\", "||")
