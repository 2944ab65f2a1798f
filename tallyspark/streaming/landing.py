"""Landing new versions of dropped files into a table (L2).

The reference copies one file from a drop folder to a destination on a
schedule, replacing the old copy. As a Spark job:

* ``land_latest`` (batch, same-name overwrite): list the folder, anti-join
  the listing with a manifest of already landed versions on
  (path, length, modificationTime), read only the new versions and
  overwrite just their partitions of the destination (dynamic partition
  overwrite), then append them to the manifest. Re-running with nothing
  new lands nothing. A retried or lost task only rewrites its own output.
* ``land_stream`` (versioned names): a file-source stream with an
  ``availableNow`` trigger; its checkpoint remembers what was landed. The
  streaming file source never re-reads a path it has seen, so it only
  suits drop folders whose file names carry a version.

Scheduling (times of day, retries) is left to the caller's scheduler.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.names import relative_path
from tallyspark.session import cut_lineage
from tallyspark.sources.inventory import inventory

MANIFEST_KEYS = ["path", "length", "modificationTime"]


def _manifest(spark: SparkSession, manifest: str) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(manifest)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.read.parquet(manifest).select(*MANIFEST_KEYS)
    return spark.createDataFrame([], "path string, length long, modificationTime timestamp")


def land_latest(spark: SparkSession, src: str, dest: str, manifest: str, fmt: str = "csv",
                glob: str = "*", options: dict | None = None, partition_col: str = "source_name") -> int:
    """Land every new file version under ``src``; returns how many files.

    Files are told apart by their path below ``src``. The listing is written
    once: data and manifest follow the same one, so a file that is replaced
    meanwhile is landed again by the next run. A csv file whose header differs
    from the others' is an error, not a silent mix-up of columns.
    """
    inv = inventory(spark, src, glob)
    new = cut_lineage(inv.join(_manifest(spark, manifest), MANIFEST_KEYS, "left_anti"))
    # the list of new files is a directory listing, as small as the file count
    paths = [r["path"] for r in new.select("path").collect()]
    if not paths:
        return 0
    reader = spark.read.format(fmt).option("enforceSchema", "false").options(**(options or {}))
    data = reader.load(paths).withColumn(partition_col, relative_path(spark, src, F.col("_metadata.file_path")))
    (data.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(partition_col).parquet(dest))
    new.select(*MANIFEST_KEYS).write.mode("append").parquet(manifest)
    return len(paths)


def land_stream(spark: SparkSession, src: str, dest: str, checkpoint: str, schema, fmt: str = "csv",
                glob: str = "*", options: dict | None = None, partition_col: str = "source_name"):
    """Process every file not yet seen by the stream, then stop."""
    stream = (spark.readStream.format(fmt).schema(schema).options(**(options or {}))
              .option("pathGlobFilter", glob).load(src)
              .withColumn(partition_col, relative_path(spark, src, F.col("_metadata.file_path"))))

    def batch(df: DataFrame, epoch: int) -> None:
        # a batch that is replayed after a failure overwrites its own partitions
        (df.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy(partition_col, "epoch").parquet(dest))

    q = (stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
         .foreachBatch(batch).start())
    q.awaitTermination()
    return q


def uncommit(spark: SparkSession, checkpoint: str) -> None:
    """Takes back the last commit of a stream that has stopped: its next run
    repeats that epoch, with the files it had, before it takes new ones."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    commits = hadoop.Path(checkpoint, "commits")
    fs = commits.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    epochs = [s.getPath().getName() for s in fs.listStatus(commits)] if fs.exists(commits) else []
    epochs = [int(n) for n in epochs if n.isdigit()]
    if epochs:
        fs.delete(hadoop.Path(commits, str(max(epochs))), False)


def landing_paths(base: str) -> dict:
    return {k: os.path.join(base, k) for k in ("drop", "dest", "manifest", "stream_ckpt")}
