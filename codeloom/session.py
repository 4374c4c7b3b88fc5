"""Sessions, and the shared folder in which a job cuts its lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: dict[str, str] = {}
_WRITTEN: dict[str, set[str]] = {}


def build_session(app: str = "codeloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators assume: UTC, AQE, skew handling, Arrow."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. A temporary folder stands in for it in local mode only."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _SCRATCH.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-codeloom-"))


def materialize(df: DataFrame) -> DataFrame:
    """Writes df once as Parquet to the shared folder and reads it back.

    Several consumers can then read it without running its plan again, and lost executors cost no
    recomputation. The files stay until discard() or cleanup(): a result that is still to be read may need them.
    """
    path = f"{scratch_dir(df.sparkSession)}/codeloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, set()).add(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _WRITTEN.get(spark.sparkContext.applicationId, set()).discard(path)


def discard(*frames: DataFrame | None) -> None:
    """Deletes what materialize() wrote for these, once nothing will read them again; other DataFrames are left alone."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            _delete(df.sparkSession, path)


def cleanup(spark: SparkSession) -> None:
    """Deletes all that this application's operators wrote to the scratch folder. Read or write results before."""
    for path in sorted(_WRITTEN.get(spark.sparkContext.applicationId, set())):
        _delete(spark, path)
