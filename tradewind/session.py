"""Session set-up and the shared folder for staged results."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, app: str = "tradewind", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster use the one spark-submit made."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Folders standing in for ``spark.checkpoint.dir``, by application.
_fallback: dict[str, str] = {}


def staging_root(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    A temporary folder stands in only for a ``local`` master, where driver and
    executors are one process. Spark refuses to set ``spark.checkpoint.dir`` at
    run time, so the folder is remembered here.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _fallback:
        _fallback[application] = tempfile.mkdtemp(prefix="tradewind-")
    return _fallback[application]


def staging_path(spark: SparkSession, label: str) -> str:
    return f"{staging_root(spark)}/tradewind/{label}-{uuid.uuid4().hex}"


_scope: ContextVar[list[str] | None] = ContextVar("staged in this scope", default=None)
#: Staged outside any scope, by application; ``release_staged`` deletes them.
_loose: dict[str, list[str]] = {}


def stage(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """Write ``df`` to the shared folder; return the written table and its row count.

    Later passes then read the same stored values. Recomputing instead could
    add up doubles in another order and move a row across a rank boundary, and
    after losing an executor it would repeat the whole upstream plan.
    """
    path = staging_path(df.sparkSession, label)
    own = _loose.setdefault(df.sparkSession.sparkContext.applicationId, [])
    paths = _scope.get()
    (own if paths is None else paths).append(path)
    seen = Observation(label)
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["rows"]


@contextmanager
def staging_scope(spark: SparkSession) -> Iterator[None]:
    """Delete what was staged inside the block. Write results to tables before it ends.

    A thread started inside belongs to the block if it runs in a copy of its context.
    """
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)
        delete_paths(spark, paths)


def release_staged(spark: SparkSession) -> None:
    """Delete what this application staged outside ``staging_scope``.

    Call it once the results that read the staged tables are written.
    """
    delete_paths(spark, _loose.pop(spark.sparkContext.applicationId, []))


def path_exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def delete_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders wherever they are; those that do not exist are passed over."""
    configuration = spark._jsc.hadoopConfiguration()
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(configuration).delete(folder, True)
