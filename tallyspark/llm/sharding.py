"""Proportional stratified interleaving (operator 1).

Rows are shuffled by a seeded hash within their source and ranked there. The
fractional rank ``(rank + 1/2) / rows of the source`` spreads every source
evenly over (0, 1); in the order of the fractional ranks every stretch holds
the sources in their proportions, so cutting that order into equal stretches
gives shards with the mixture of the whole. Shard sizes differ by one row at
most (law ``rows``).

Only ids, sizes and checksums are moved, never texts. Both rankings are range
sorts whose keys end in the row's hash and id, so a source that holds a third
of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import Scratch, numbered


def interleave(docs: DataFrame, n_shards: int = 16, seed: int = 17, id_col: str = "doc_id",
               text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, source, shard, slot.

    A null text has size 1 and the checksum of no bytes (0); rows without a
    source are a source of their own; ids may be null or repeat (equal keys
    take neighbouring places). With fewer rows than shards the last shards
    stay empty. Other columns of ``docs`` are not read.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 at least")
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.col(source_col).cast("string").alias("source"),
    ).select(
        "doc_id", "source",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    rows = scratch.write(rows.withColumn("mix", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))), "rows")

    keys = [F.col("source").asc_nulls_first(), F.col("mix"), F.col("doc_id").asc_nulls_first(), F.col("text_crc32")]
    by_source = numbered(scratch, rows, keys, "by_source", "place")
    # the sources are consecutive in that order: rank = place - first place
    sources = by_source.groupBy("source").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    joined = by_source.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
    fractions = joined.select(
        "r.doc_id", "r.source", "r.size", "r.text_crc32", "r.mix",
        ((F.col("place") - F.col("first") + F.lit(0.5)) / F.col("n")).alias("fraction"))

    order = [F.col("fraction"), F.col("mix"), F.col("source").asc_nulls_first(),
             F.col("doc_id").asc_nulls_first(), F.col("text_crc32")]
    placed = numbered(scratch, fractions, order, "by_fraction", "place")
    total = rows.count()
    return _cut(placed, total, n_shards)


def _cut(placed: DataFrame, total: int, n_shards: int) -> DataFrame:
    """Places 0 .. total - 1 into ``n_shards`` stretches; the first
    ``total % n_shards`` of them have one row more."""
    least, longer = divmod(total, n_shards)
    edge = longer * (least + 1)  # places before it lie in the longer stretches
    place = F.col("place")
    in_longer = place < F.lit(edge)
    shard = F.when(in_longer, F.floor(place / F.lit(least + 1))).otherwise(
        F.lit(longer) + F.floor((place - F.lit(edge)) / F.lit(max(least, 1))))
    slot = F.when(in_longer, place % F.lit(least + 1)).otherwise((place - F.lit(edge)) % F.lit(max(least, 1)))
    return placed.select("doc_id", "size", "text_crc32", "source", shard.cast("int").alias("shard"),
                         slot.cast("long").alias("slot"))
