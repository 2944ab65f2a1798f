"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import checkpoint_dir, read_table

# The separators of "words": the six ASCII white-space bytes. bytes.split()
# without arguments splits at exactly these.
SPACES = b" \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, under fixed names, whatever
    else the table carries."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column of an Arrow batch, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], text_col: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into runs of rows of about ``limit`` bytes of text
    (one row at least), so that what a task derives from a run stays small."""
    for batch in batches:
        start = size = 0
        for i, n in enumerate(byte_lengths(batch.column(text_col))):
            if i > start and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)


def byte_lengths(column: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return [n or 0 for n in pc.binary_length(column).to_pylist()]


def lean(run: Callable) -> Callable:
    """``run``, a function of ``mapInArrow``, that gives the memory it no longer
    needs back to the system when it ends. Spark keeps Python workers for
    later tasks; those that wait count against an executor's memory with all
    that they hold."""

    def running(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return running


def release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


class Scratch:
    """Tables written once in the shared folder named by ``spark.checkpoint.dir``.

    They cut the lineage: later steps read a table that survives lost
    executors. ``drop`` removes one that no later step reads. A write's shuffle
    files go with its end, as nothing reads them again: the executors' disks
    hold one step's, not those of all steps so far.
    """

    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")

    def path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def write(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        before = self.spark.conf.get(self.CLEANUP)
        self.spark.conf.set(self.CLEANUP, "true")
        try:
            df.write.mode("error").option("compression", compression).parquet(self.path(name))
        finally:
            self.spark.conf.set(self.CLEANUP, before)
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(schema) if schema is not None else reader).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(scratch: Scratch, df: DataFrame, order: list[Column], name: str,
             into: str = "position") -> DataFrame:
    """Adds the 0-based place of each row in the global order ``order``.

    The rows are range-partitioned and sorted, and written once with their
    partition and their place in it; the partitions' counts, one row each,
    give every partition its offset. No task sees more than one range, and
    rows of equal leading keys are split by the later ones.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id()
    parts = scratch.write(
        sorted_rows.withColumn("_part", F.shiftright(row, 33).cast("int"))
        .withColumn("_row", row.bitwiseAND(F.lit((1 << 33) - 1))), name)
    counts = parts.groupBy("_part").agg(F.count("*").alias("n")).collect()  # one row per partition
    offsets, total = [], 0
    for part, n in sorted((r["_part"], r["n"]) for r in counts):
        offsets.append((part, total))
        total += n
    table = df.sparkSession.createDataFrame(offsets, "_part int, _offset long")
    return (parts.join(F.broadcast(table), "_part")
            .withColumn(into, F.col("_offset") + F.col("_row")).drop("_part", "_row", "_offset"))


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, packed) with the text compressed, to be shuffled;
    ``docs`` has doc_id, text and text_hash. A null text stays null."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = [None if t is None else compressor.compress(t) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(packed, pa.binary())],
                names=["doc_id", "text_hash", "packed"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text_hash", "text").mapInArrow(
        lean(pack), f"doc_id {id_type}, text_hash long, packed binary")


def unpacked(packed: bytes | None) -> bytes | None:
    import zstandard

    return None if packed is None else zstandard.ZstdDecompressor().decompress(packed)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
