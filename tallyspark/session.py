"""Session construction and lineage-cutting helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Defaults a job of this library wants.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tallyspark", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session. Only a local-mode session (tests) with no such
    setting gets its own scratch folder; on a cluster a missing setting is an
    error, because a machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="tallyspark-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


@contextmanager
def shuffle_cleanup(spark: SparkSession):
    """Writes inside take their shuffle files with them when they end: only for
    plans that nothing reads again."""
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


# the tables that cut_lineage has written since the innermost settled() began
_written: ContextVar[list | None] = ContextVar("tallyspark_written", default=None)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a parquet table under the shared checkpoint folder
    and read it back: later consumers read the table instead of recomputing
    the plan, and it survives lost executors. (``Dataset.checkpoint`` would
    run the plan twice: once to count, once to write.) The write's shuffle files
    go with its end, as nothing reads them again."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "tables", uuid.uuid4().hex)
    with shuffle_cleanup(spark):
        df.write.mode("error").option("compression", "zstd").parquet(path)
    if (written := _written.get()) is not None:
        written.append(path)
    return spark.read.parquet(path)


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def passing_tables(spark: SparkSession):
    """The tables that ``cut_lineage`` writes inside are removed at the end."""
    written: list[str] = []
    token = _written.set(written)
    try:
        yield written
    finally:
        _written.reset(token)
        delete(spark, *written)


def settled(build: Callable[[], DataFrame]) -> DataFrame:
    """``cut_lineage`` of what ``build`` returns, without the tables that were
    written on the way: steps that are settled one after the other hold the disk
    one at a time, where one plan of them all would hold the shuffles of all."""
    with passing_tables(SparkSession.active()) as written:
        out = cut_lineage(build())
        kept = written.pop()
    if (outer := _written.get()) is not None:
        outer.append(kept)
    return out


def table_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(spark, sf_dir, name))
