"""What the query modules share: registration, and the SQL of the current graph and log."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that states the same result."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


CLEAN_PATH = """case when file_path is null then null else
    (case when replace(file_path, '\\', '/') like '/%' then '/' else '' end)
    || array_to_string([x for x in string_split(replace(file_path, '\\', '/'), '/') if x not in ('', '.')], '/') end"""
CLEAN_ACTION = "replace(lower(action_type), '-', '_')"

#: ce: current entities; g: distinct edges; a: distinct cleaned actions.
CURRENT = f"""with ce as (
  select * from (select * from entities where id is not null qualify row_number() over (partition by id order by indexed_at desc, row_id desc) = 1)
  where deleted_at is null
), g as (select distinct src, dst from edges where src is not null and dst is not null),
a as (
  select id, session_id, {CLEAN_ACTION} as action_type, {CLEAN_PATH} as file_path, entity_id, ts, metadata from actions
  where id is not null qualify row_number() over (partition by id order by logged_at desc) = 1
)
"""
CURRENT_RECURSIVE = CURRENT.replace("with ce", "with recursive ce", 1)
