"""Target-distribution importance resampling (operator 11).

Texts are bags of hashed word n-grams. Counting the buckets over the corpus and
over a target table gives each bucket the logarithm of its relative frequency;
a document's weight is the sum over its features, and adding Gumbel noise and
taking the highest scores draws documents in proportion to their weights
without replacement.

Buckets are CRC-32 values. Inside a task the distinct features of a slice are
found by numbering words and pairs, gathered by their length in bytes into
two-dimensional arrays, and all checksums of such an array are updated column
by column; the buckets are then scattered back to the occurrences. (Features of
more than 2 KB take their checksums one by one.)

Texts are read twice, once for the counts and once for the weights, and never
shuffled. A task sends one row per bucket; the table of gains has as many rows
as buckets. Ranks come from a range sort of ids and scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import Scratch, as_bytes, free_name, id_and_text, numbered, slices

BUCKETS = 10_000
LONGEST = 3  # words of a feature
SEED = 42
MIN_WORDS = 20
PERCENT = 5
SLICE = 1 << 20  # bytes of text whose features are looked at together
BLOCK = 1 << 20  # bytes of features whose checksums are taken together
LONG = 2048  # bytes of a feature that is too long to have many of its length
SCALE = 1000


def crc_table() -> np.ndarray:
    """CRC-32 of single bytes, by the reflected polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = crc_table()
_WORD = np.zeros(256, bool)  # bytes of words, after A-Z have become a-z
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def crc32_rows(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of every row of a two-dimensional array of bytes."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        crc = _CRC[(crc ^ column) & 0xFF] ^ (crc >> np.uint32(8))
    return ~crc


def crc32_pieces(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of the given pieces of ``data``, those of equal length together;
    pieces above ``LONG`` bytes one by one."""
    out = np.empty(len(starts), np.uint32)
    small = len(lengths) and lengths.max() < 1 << 16
    order = np.argsort(lengths.astype(np.uint16) if small else lengths, kind="stable")
    sizes, first = np.unique(lengths[order], return_index=True)
    for size, a, b in zip(sizes.tolist(), first, [*first[1:], len(order)]):
        if size > LONG:
            for row in order[a:b].tolist():
                out[row] = zlib.crc32(data[starts[row]:starts[row] + size])
            continue
        windows = np.lib.stride_tricks.sliding_window_view(data, size)
        step = max(1, BLOCK // size)
        for at in range(a, b, step):
            rows = order[at:min(at + step, b)]
            out[rows] = crc32_rows(windows[starts[rows]])
    return out


def words_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, lengths, words of each text): the lower-case words of all
    texts behind one another in ``data``, one space after each."""
    joined = b"\n".join(t or b"" for t in texts) + b"\n"
    raw = _LOWER[np.frombuffer(joined, np.uint8)]
    inside = _WORD[raw]
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    kept = inside.copy()
    kept[ends] = True
    data = raw[kept]
    begins = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    lengths = ends - begins
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(ends) else ends
    data[starts + lengths] = 32
    edges = np.cumsum([len(t or b"") + 1 for t in texts])
    per_text = np.diff(np.searchsorted(begins, edges), prepend=0)
    return data, starts, lengths, per_text


def feature_buckets(texts: list[bytes | None], buckets: int = BUCKETS, longest: int = LONGEST):
    """(buckets of all features, text of each, words of each text). Features of
    one text never reach into the next."""
    data, starts, lengths, per_text = words_of(texts)
    n = len(starts)
    text_of = np.repeat(np.arange(len(texts)), per_text)
    runs = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), n, [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)])
    word = np.asarray(runs.dictionary_encode().indices) if n else starts
    ids, found, owners = word.astype(np.int64), [], []
    for size in range(1, longest + 1):
        if size > 1:  # a longer feature is the shorter one before it and one more word
            whole = text_of[size - 1:] == text_of[:n - size + 1]
            ids = np.where(whole, ids[:len(whole)] * np.int64(n) + word[size - 1:], -1)
            at = np.flatnonzero(whole)
        else:
            at = np.arange(n)
        if not len(at):
            break
        back = np.asarray(pa.array(ids[at]).dictionary_encode().indices)  # numbered as they first appear
        first = np.empty(back.max() + 1, np.int64)
        first[back[::-1]] = np.arange(len(back) - 1, -1, -1)
        last = at[first] + size - 1
        crc = crc32_pieces(data, starts[at[first]], starts[last] + lengths[last] - starts[at[first]])
        found.append((crc % np.uint32(buckets)).astype(np.int64)[back])
        owners.append(text_of[at])
        ids = ids.copy()
        ids[at] = back  # numbers below n again, so that the next product fits
    none = np.empty(0, np.int64)
    return (np.concatenate(found) if found else none, np.concatenate(owners) if owners else none, per_text)


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n): features of all texts by bucket; buckets without any have no row."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices([batch], "text", SLICE):
                total += np.bincount(feature_buckets(as_bytes(part.column("text")), buckets, longest)[0],
                                     minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Of each bucket, the scaled logarithm of its smoothed share of the target
    over that of the corpus. One row a bucket comes to the driver."""
    counts = np.zeros((2, buckets), np.float64)
    rows = corpus.withColumn("side", F.lit(0)).unionByName(target.withColumn("side", F.lit(1)))
    for r in rows.collect():
        counts[r["side"], r["bucket"]] = r["n"]
    (s, t), (all_s, all_t) = counts, counts.sum(axis=1)
    return np.floor(SCALE * np.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).astype(np.int64)


def gumbel(id_col: Column, seed: int = SEED) -> Column:
    """Scaled Gumbel noise of a row, from a digest of its id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-SCALE * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def weights(docs: DataFrame, table: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
            longest: int = LONGEST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_features, weight."""
    rows = id_and_text(docs, id_col, text_col)
    held = docs.sparkSession.sparkContext.broadcast(table)  # one number a bucket

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for batch in batches:
            for part in slices([batch], "text", SLICE):
                found, owners, n_words = feature_buckets(as_bytes(part.column("text")), len(gain), longest)
                n = part.num_rows
                sums = np.zeros(n, np.int64)
                np.add.at(sums, owners, gain[found])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n_words.astype(np.int64)),
                     pa.array(np.bincount(owners, minlength=n).astype(np.int64)), pa.array(sums)],
                    names=["doc_id", "n_words", "n_features", "weight"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(weigh, f"doc_id {id_type}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, id_col: str = "doc_id",
             text_col: str = "text", target_text_col: str = "text", seed: int = SEED,
             min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_features, weight, score, rank.

    ``percent`` of the documents with ``min_words`` words are drawn, the
    highest scores first, ties by the smaller id (null first); ``rank`` is null
    where a row is not drawn. Null and empty texts have no features and weight
    0. Repeated rows are drawn separately, and rows with a null id share their
    noise. Empty tables on either side are allowed. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "importance")
    table = gains(bucket_counts(docs, text_col), bucket_counts(target, target_text_col))
    scored = weights(docs, table, id_col, text_col).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    enough = F.col("n_words") >= min_words
    scored = scratch.write(scored, "scored")
    drawn = scored.where(enough).count() * percent // 100
    # those that cannot be drawn come last
    order = [enough.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features")]
    placed = numbered(scratch, scored, order, "placed", "place")
    return placed.select("doc_id", "n_words", "n_features", "weight", "score",
                         F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))


def sample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", **how) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns. Ids must be unique."""
    key = free_name(docs, "drawn_id")
    ids = resample(docs, target, percent, id_col, **how).where("rank is not null").select(F.col("doc_id").alias(key))
    return docs.join(ids, F.col(id_col).eqNullSafe(F.col(key)), "left_semi")
