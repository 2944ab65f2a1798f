"""Drop-folder inventory (L1, D3): file metadata without reading contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def inventory(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, name, length, modificationTime) of every file matching ``glob``.

    The binary-file source prunes the ``content`` column when it is not
    selected, so only the listing and file status are read.
    """
    df = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
          .option("recursiveFileLookup", str(recursive).lower()).load(path))
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "modificationTime")


def first_names(inv: DataFrame, n: int = 10) -> DataFrame:
    """D3: the first ``n`` entries by path (a top-n, only n rows move)."""
    return inv.orderBy("path").limit(n)
