"""N-gram Jaccard join with adaptive multi-match prefixes (operator 8).

Two documents link when the Jaccard similarity of their word shingles reaches
the threshold t. All documents sort their n shingles by one order, rare ones
first. Linked documents share at least ceil(t n) of them, so their first
``n - ceil(t n) + l`` shingles have ``l`` in common. A longer prefix costs a few
more index rows and lets the join ask for more common shingles before it
verifies a pair; each document picks the l with the least estimated cost, from
the frequencies of the shingles in its prefix. A pair needs the smaller l of
the two.

The order needs no exact frequencies, only to be the same everywhere: shingles
found frequent by a count over all documents come last, the others by
descending length (long words are rare words), ties by hash.

Steps:

* Documents of equal word sequences form classes; one of each class joins.
* Prefix rows of shingles with one owner are dropped, then documents with too
  few rows left for a partner of compatible size.
* Contraction: every document is verified against a few members of each of its
  shingles' groups, the one with the fewest rare shingles (the likely original of
  a group of edited copies) and random ones; a group of n gives a few times n
  pairs. Large groups of near copies fall together here.
* Join: all pairs of a group that lie in different components still, counted
  over the groups; those with min(l, l') or more are verified. Pairs that meet
  at a frequent shingle must be able to reach the threshold by frequent ones.
* The components of all links.

Shingle sets are compared as 64-bit hashes inside the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tallyspark.llm.common import Scratch, as_bytes, free_name, id_and_text, lean, slices, unpacked
from tallyspark.llm.components import components
from tallyspark.llm.words import as_longs, shingles, words_by_text

MOST_L = 4
FREQUENT_TABLE = 1 << 19  # entries of the table of frequent shingles, at most
LEAST_FREQUENT = 8  # documents with a shingle before it counts as frequent
COUNT_FLUSH = 3_000_000  # shingles that a task counts at a time
VERIFY_COST = 0.05  # of one shingle of a candidate, in index rows
COMMON_BY_CHANCE = 0.3  # expected other owners of a shingle that isn't frequent
_LONGEST = 1 << 14  # bytes of a shingle that still count in the order
SLICE_BYTES = 2 << 20  # of text that a task hashes at a time
PARTNERS = 4  # members of a group that its documents are verified against first


def _count(k: int):
    """(shingle, documents of this stretch with it) of shingles that occur twice."""

    def flush(sets: list[np.ndarray]) -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(sets), return_counts=True)
        notable = n > 1
        return pa.RecordBatch.from_arrays(
            [pa.array(as_longs(values[notable])), pa.array(n[notable])], names=["token", "n"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, total = [], 0
        for batch in slices(batches, "text", SLICE_BYTES):
            for hashes, _ in words_by_text([t or b"" for t in as_bytes(batch.column("text"))]):
                if len(hashes):
                    sets.append(np.unique(shingles(hashes, k)))
                    total += len(sets[-1])
                if total >= COUNT_FLUSH:
                    yield flush(sets)
                    sets, total = [], 0
        if sets:
            yield flush(sets)

    return count


def frequent_shingles(texts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and their counts. All documents are
    counted; the table is bounded, whatever their number."""
    counts = texts.mapInArrow(lean(_count(k)), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = counts.where(F.col("n") >= LEAST_FREQUENT)
    scratch = Scratch(texts.sparkSession, "frequent")
    counts = scratch.write(counts, "counts")
    by_size = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("size")).count().collect()
    least, room = None, FREQUENT_TABLE
    for r in sorted(by_size, key=lambda r: -r["size"]):
        if r["count"] > room:
            break
        least, room = 1 << r["size"], room - r["count"]
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    table = counts.where(F.col("n") >= least).toPandas()
    tokens = table["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    scratch.drop("counts")
    return tokens[order], table["n"].to_numpy(np.int64)[order]


def prefix(own: np.ndarray, lengths: np.ndarray, table: tuple[np.ndarray, np.ndarray],
           percent: int) -> tuple[int, int, np.ndarray]:
    """(l, number of rare shingles, prefix) of a document with the distinct
    shingles ``own``, sorted, and their lengths in bytes."""
    tokens, counts = table
    n = len(own)
    owners = np.zeros(n, np.int64)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
        found = tokens[at] == own
        owners[found] = counts[at[found]]
    # frequent ones last, long ones first, then by hash; own is in its order
    key = ((owners > 0).astype(np.int64) << 62) - (np.minimum(lengths, _LONGEST) << 46) + (own >> np.uint64(18)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    least = n - -(-percent * n // 100)  # shingles that a linked document may lack
    most = min(MOST_L, n - least)
    others = np.where(owners > 0, owners, COMMON_BY_CHANCE)[order[:least + most]]
    rows = np.cumsum(others)[least:least + most]
    l = 1 + np.arange(most)
    cost = least + l + rows + rows / l * (n * VERIFY_COST)
    best = int(np.argmin(cost))
    return best + 1, int(n - np.count_nonzero(owners)), own[order[:least + best + 1]]


def sequence_key(text: bytes | None) -> bytes | None:
    """128-bit hash of a text's word sequence; null without words."""
    words = (text or b"").lower().split()
    return xxhash.xxh3_128_digest(b" ".join(words)) if words else None


def _sets(k: int, table, percent: int):
    """(doc_id, n, key) of every document; l, rare and prefix with the first
    of each word sequence in this task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in slices(batches, "text", SLICE_BYTES):
            n, keys, ls, rares, prefixes = [], [], [], [], []
            texts = [t or b"" for t in as_bytes(batch.column("text"))]
            for text, (hashes, lengths) in zip(texts, words_by_text(texts)):
                key, l, rare, tokens = sequence_key(text), None, None, None
                own, first = np.unique(shingles(hashes, k), return_index=True)
                if key is not None and key not in seen:
                    seen.add(key)
                    ends = np.concatenate(([0], np.cumsum(lengths)))
                    size = min(k, len(lengths))
                    l, rare, tokens = prefix(own, (ends[size:] - ends[:-size])[first], table.value, percent)
                    tokens = as_longs(tokens)
                n.append(len(own)), keys.append(key), ls.append(l), rares.append(rare), prefixes.append(tokens)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(ls, pa.int32()), pa.array(rares, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))],
                names=["doc_id", "n", "key", "l", "rare", "tokens"])

    return run


def _texts_by_key(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, compressed text) of the first document of each word sequence in
    this task."""
    seen, compressor = set(), zstandard.ZstdCompressor(level=1)
    for batch in slices(batches, "text"):
        keys, texts = [], []
        for text in as_bytes(batch.column("text")):
            key = sequence_key(text)
            if key is not None and key not in seen:
                seen.add(key)
                keys.append(key), texts.append(compressor.compress(text))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(texts, pa.binary())],
                                         names=["key", "packed"])


def _shingle_sets(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "packed", 1 << 20):
            texts = [unpacked(t) for t in batch.column("packed").to_pylist()]
            sets = [as_longs(np.unique(shingles(hashes, k))) for hashes, _ in words_by_text(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(sets, pa.list_(pa.int64()))],
                                             names=["cid", "own"])

    return run


def _compatible(percent: int):
    """May documents of n and m shingles with a common one at the places pos
    and qos of their prefixes link, as far as sizes, places and the numbers of
    rare shingles tell?

    A frequent shingle in both prefixes means that these hold all rare ones. If
    frequent shingles alone cannot reach the threshold, the two documents link
    only if they share a rare one, and then they meet there."""
    n, m, p, q = F.col("n"), F.col("m"), F.col("pos"), F.col("qos")
    most = F.least(p, q) + F.least(n - p, m - q)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & _enough(most, percent) & (
        (p < F.col("rare")) | _enough(_frequent_in_common(), percent))


def _frequent_in_common():
    """The frequent shingles that two documents can share, at most."""
    return F.least(F.col("n") - F.col("rare"), F.col("m") - F.col("sare"))


def _enough(overlap, percent: int):
    # overlap / (n + m - overlap) >= percent / 100
    return overlap * (100 + percent) >= (F.col("n") + F.col("m")) * percent


def _prune(scratch: Scratch, shared: DataFrame, percent: int) -> DataFrame:
    """Drops documents that share too few shingles with documents of compatible
    size. Sizes fall into classes by powers of 100 / percent; two compatible
    documents lie in one class or in neighbours, so each row counts in the
    class of its size and in the next."""
    step = F.floor(F.log("n") / F.log(F.lit(100.0 / percent))).cast("int")
    rows = shared.withColumn("size_class", F.explode(F.array(step, step + 1)))
    groups = rows.groupBy("token", "size_class").agg(F.count("*").alias("members"), F.min("l").alias("least"))
    rows = rows.join(groups.where("members > 1"), ["token", "size_class"])
    kept = (rows.groupBy("cid", "token").agg(F.min("least").alias("least"))
            .groupBy("cid").agg(F.count("*").alias("common"), F.min("least").alias("needed"))
            .where("common >= needed").select("cid"))
    rows = scratch.write(shared.join(kept, "cid", "left_semi"), "kept")
    groups = rows.groupBy("token").count().where("count > 1").select("token")
    return scratch.write(rows.join(groups, "token", "left_semi"), "index")


def _verified(scratch: Scratch, pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """pairs (a, b) with a flag ``linked``."""
    left = sets.select(F.col("cid").alias("a"), F.col("own").alias("own_a"))
    right = sets.select(F.col("cid").alias("b"), F.col("own").alias("own_b"))
    common = F.size(F.array_intersect("own_a", "own_b"))
    union = F.size("own_a") + F.size("own_b") - common
    return scratch.write(pairs.join(left, "a").join(right, "b").select(
        "a", "b", (common * 100 >= union * percent).alias("linked")), name)


def _labelled(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, key (of the word sequence) of every row, and of its component
    the least id and the key of a document with it."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    texts = id_and_text(docs, id_col, text_col)
    id_type = texts.schema["doc_id"].dataType.simpleString()
    table = spark.sparkContext.broadcast(frequent_shingles(texts.select("text"), k))
    rows = scratch.write(texts.mapInArrow(
        lean(_sets(k, table, percent)), f"doc_id {id_type}, n long, key binary, l int, rare long, tokens array<long>"), "rows")
    classes = scratch.write(
        rows.where("tokens is not null").select("key", "n", "l", "rare", "tokens").dropDuplicates(["key"])
        .withColumn("cid", F.monotonically_increasing_id()), "classes")
    rows = scratch.write(rows.select("doc_id", "n", "key"), "members")
    scratch.drop("rows")  # the prefixes are with the classes now

    index = classes.select("cid", F.posexplode("tokens").alias("pos", "token"))
    several = index.groupBy("token").count().where("count > 1").select("token")
    shared = index.join(several, "token", "left_semi")
    shared = scratch.write(shared.join(classes.select("cid", "n", "l", "rare"), "cid"), "shared")
    classes = scratch.write(classes.select("cid", "key"), "class_keys")
    index = _prune(scratch, shared, percent)
    scratch.drop("classes", "shared", "kept")

    wanted = index.select("cid").distinct().join(classes.select("cid", "key"), "cid")
    words = texts.select("text").mapInArrow(lean(_texts_by_key), "key binary, packed binary")
    found = words.join(wanted, "key").select("cid", "packed").dropDuplicates(["cid"])
    sets = scratch.write(found.mapInArrow(lean(_shingle_sets(k)), "cid long, own array<long>"), "sets")

    # contraction
    member, mix = F.struct("cid", "n", "pos", "rare"), [F.xxhash64("cid", "token", F.lit(i)) for i in range(PARTNERS)]
    members = [F.min_by(member, F.struct("rare", mix[0])), *(F.min_by(member, m) for m in mix[1:])]
    partners = index.groupBy("token").agg(F.array_distinct(F.array(*members)).alias("partners"))
    near = (index.join(partners, "token").select("cid", "n", "pos", "rare", F.explode("partners").alias("p"))
            .select("cid", "n", "pos", "rare", F.col("p.cid").alias("did"), F.col("p.n").alias("m"),
                    F.col("p.pos").alias("qos"), F.col("p.rare").alias("sare"))
            .where((F.col("cid") != F.col("did")) & _compatible(percent)))
    pairs = near.select(F.least("cid", "did").alias("a"), F.greatest("cid", "did").alias("b")).distinct()
    tried = _verified(scratch, pairs, sets, percent, "tried")
    links = tried.where("linked").select("a", "b")
    parts = scratch.write(components(scratch, links, "contracted"), "contracted")

    # join
    index = index.join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn(
        "root", F.coalesce("root", "cid"))
    index = scratch.write(index, "rooted")
    scratch.drop("index")
    mixed = index.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    index = index.join(mixed.select("token"), "token", "left_semi")
    other = index.select("token", F.col("cid").alias("did"), F.col("n").alias("m"), F.col("l").alias("k"),
                         F.col("pos").alias("qos"), F.col("rare").alias("sare"),
                         F.col("root").alias("soot"))
    pairs = (index.join(other, "token").where((F.col("cid") < F.col("did")) & (F.col("root") != F.col("soot"))
                                              & _compatible(percent))
             .withColumn("needed", F.when(_enough(_frequent_in_common(), percent), F.least("l", "k")).otherwise(1))
             .groupBy(F.col("cid").alias("a"), F.col("did").alias("b"))
             .agg(F.count("*").alias("common"), F.first("needed").alias("needed"))
             .where("common >= needed").select("a", "b"))
    pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
    joined = _verified(scratch, pairs, sets, percent, "joined")
    scratch.drop("sets", "rooted", "tried")
    links = joined.where("linked").select("a", "b").unionByName(
        parts.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    parts = components(scratch, links, "joined_parts")

    by_key = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    by_key = by_key.join(classes.select("key", "cid"), "key").join(
        parts.withColumnRenamed("node", "cid"), "cid", "left").select(
        "key", "least", F.coalesce("root", "cid").alias("root"))
    by_root = by_key.groupBy("root").agg(
        F.min("least").alias("component"),
        F.min_by("key", F.struct(F.col("least").isNull(), "least", "key")).alias("chosen"))
    labels = by_key.join(by_root, "root").select("key", "component", "chosen")
    return rows.select("doc_id", "n", "key").join(labels, "key", "left")


def jaccard_classes(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    component_id is the least doc_id that links reach, the row's own included.
    A text without words (null, empty or blank) has no shingles and links with
    nothing: its component_id is its own id. One with fewer than ``k`` words has
    one shingle, all of them. Repeated rows are one class and null ids are
    passed over as component ids, unless a component has no other. Other
    columns of ``docs`` are not read. An empty table gives no rows.
    """
    return _labelled(docs, k, percent, id_col, text_col).select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Of each component of ``jaccard_classes`` one row of ``docs``, that of the
    least id (null ids last), with all its columns; of its repetitions one.
    Rows without words stay."""
    key, single = free_name(docs, "key"), free_name(docs, "single")
    chosen = _labelled(docs, k, percent, id_col, text_col).where(
        (F.col("key") == F.col("chosen")) & F.col("doc_id").eqNullSafe(F.col("component"))).select(
        F.col("doc_id").alias("chosen_id"), F.col("key").alias("chosen_key")).distinct()
    schema = StructType([*docs.schema.fields, StructField(key, BinaryType())])
    keyed = docs.mapInArrow(lean(_with_key(text_col, key)), schema)
    kept = keyed.join(chosen, (F.col(key) == F.col("chosen_key")) & F.col(id_col).eqNullSafe(F.col("chosen_id")),
                      "left").where(F.col("chosen_key").isNotNull() | F.col(key).isNull())
    kept = kept.withColumn(single, F.when(F.col(key).isNull(), F.monotonically_increasing_id()))
    return kept.dropDuplicates([id_col, key, single]).select(*docs.columns)


def _with_key(text_col: str, name: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [sequence_key(t) for t in as_bytes(batch.column(text_col))]
            yield batch.append_column(pa.field(name, pa.binary()), pa.array(keys, pa.binary()))

    return run
