import datetime as dt
import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="spark-test-")
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        .config("spark.checkpoint.dir", f"file://{folder}/checkpoints")
        .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
        .config("spark.local.dir", folder)
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def at():
    """A timestamp some seconds after a fixed start."""
    return lambda seconds: dt.datetime(2024, 3, 1) + dt.timedelta(seconds=seconds)


ENTITY = (
    "row_id long, id string, name string, entity_type string, file_path string, line_start int, line_end int, language string,"
    " docstring string, calls array<string>, called_by array<string>, indexed_at timestamp_ntz, deleted_at timestamp_ntz"
)


@pytest.fixture(scope="session")
def make_entities(spark, at):
    def make(rows):
        """rows: dicts with id and anything that differs from the defaults."""
        full = []
        for n, r in enumerate(rows):
            path, name = r["id"].split("::")[0], r["id"].split("::")[-1]
            base = {
                "row_id": n, "name": name, "entity_type": "function", "file_path": path, "line_start": 1, "line_end": 2, "language": "rust",
                "docstring": None, "calls": [], "called_by": [], "indexed_at": at(0), "deleted_at": None,
            }
            full.append({**base, **r})
        names = [f.split()[0] for f in ENTITY.replace("array<string>", "x").split(", ")]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in full], ENTITY)

    return make


@pytest.fixture(scope="session")
def make_edges(spark, at):
    def make(pairs):
        return spark.createDataFrame([(n, a, b, at(n)) for n, (a, b) in enumerate(pairs)], "edge_id long, src string, dst string, recorded_at timestamp_ntz")

    return make


ACTION = (
    "id string, session_id string, action_type string, file_path string, entity_id string, ts timestamp_ntz, tool string,"
    " duration_ms long, metadata string, logged_at timestamp_ntz"
)


@pytest.fixture(scope="session")
def make_actions(spark, at):
    def make(rows):
        full = []
        for n, r in enumerate(rows):
            base = {"id": f"a{n:03}", "session_id": "s", "action_type": "file_read", "file_path": "a.rs", "entity_id": None, "ts": at(n), "tool": "view", "duration_ms": 1, "metadata": None}
            row = {**base, **r}
            row.setdefault("logged_at", row["ts"])
            full.append(row)
        names = [f.split()[0] for f in ACTION.split(", ")]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in full], ACTION)

    return make
