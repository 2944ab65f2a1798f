"""Exact-substring removal by a distributed, sampled suffix sort (operator 2).

Every byte covered by a string of ``length`` bytes that also starts earlier
(smaller document id, or earlier in the same document) goes.

Suffixes are not shipped one by one. The ``length``-byte prefix of a suffix, its
*window*, has an anchor: the place of the ANCHOR-byte string in it with the
least hash, the leftmost of equal ones. Equal windows have their anchors at
the same place, so they meet wherever the suffix that starts at the anchor goes.
Neighbouring suffixes mostly share their anchor; such a run travels as one
segment of text.

1. Splitters are drawn from a sample of anchors; segments are range-partitioned
   by the leading bytes of their anchors' suffixes. A task sends a segment that
   it has met before only once; the later ones are duplicates by definition.
   A leading string so frequent that it fills whole ranges is spread: its
   segments go apart into windows, which are dealt by their own bytes.
2. A bucket sorts its segments, keeps the first of equal ones, and sorts the
   windows of those that share an anchor with others by multikey quicksort, on
   eight bytes at a time. In each run of equal windows all but the earliest are
   duplicates. Equal windows never lie in different buckets.
3. The removed ranges are joined to the documents and cut out.

Buckets get about ``bucket_bytes`` of text each, whatever the size of the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import Scratch, as_bytes, id_and_text, packed_texts, slices, unpacked

LENGTH = 100
ANCHOR = 24
BUCKET_BYTES = 8 << 20
SAMPLE_DOCUMENTS = 2000  # for the splitters
SAMPLE_ANCHORS = 200_000
SLICE_BYTES = 2 << 20
FLUSH_BYTES = 16 << 20  # segments that a task holds before it sends them
SORT_LEAF = 2048
SORT_WINDOWS = 200_000  # windows in one sort, unless one anchor has more

_PLACE_BITS = np.uint64(26)  # places in a slice; the other 38 bits are hash
_PLACES = np.uint64((1 << 26) - 1)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # odd multipliers
_NO_ID = np.iinfo(np.int64).max  # null ids come last


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a big-endian number, zeros after the
    end."""
    n = len(data)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = data
    out = np.empty(n + 8, np.uint64)
    for shift in range(8):
        part = padded[shift:shift + (n + 8 - shift + 7) // 8 * 8].view(">u8")
        out[shift::8] = part[:len(out[shift::8])]
    return out


def anchors(data: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> np.ndarray:
    """For each start of a window in ``data`` (of 64 MB at most) the place of
    its anchor. Windows may cross documents; the caller drops those."""
    n = len(data) - length + 1
    if n <= 0:
        return np.empty(0, np.int64)
    word = words_at(data)
    m = len(data) - anchor + 1
    mixed = np.zeros(m, np.uint64)
    for at in range(0, anchor, 8):
        mixed ^= word[at:at + m]
        mixed *= _M1
        mixed ^= mixed >> np.uint64(29)
    mixed *= _M2
    key = (mixed & ~_PLACES) | np.arange(m, dtype=np.uint64)
    span = length - anchor + 1
    blocks = -(-m // span)
    grid = np.full((blocks, span), np.iinfo(np.uint64).max, np.uint64)
    grid.ravel()[:m] = key
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(after[:n], before[span - 1:span - 1 + n]) & _PLACES).astype(np.int64)


def segments(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """Runs of windows with one anchor: (first start, last start, anchor), for
    documents that lie in ``data`` one behind the other, up to ``ends``."""
    at = anchors(data, length, anchor)
    if not len(at):
        return (np.empty(0, np.int64),) * 3
    starts = np.concatenate(([0], ends[:-1]))
    valid = np.zeros(len(at) + 1, np.int8)
    for s, e in zip(starts, ends):
        if e - s >= length:
            valid[s:e - length + 1] = 1
    change = np.empty(len(at), bool)
    change[0] = True
    change[1:] = at[1:] != at[:-1]
    inside = valid[:-1] == 1
    change |= np.concatenate(([True], ~inside[:-1])) & inside
    begin = np.flatnonzero(change & inside)
    # a run ends before the next one begins, or where its document's windows end
    stop = np.flatnonzero(inside & np.concatenate((change[1:] | ~inside[1:], [True])))
    return begin, stop, at[begin]


class _Sender:
    """Collects a task's segments by bucket and packs them to rows."""

    def __init__(self, splitters: np.ndarray, hot: set[bytes], buckets: int, length: int, anchor: int):
        self.splitters, self.hot, self.buckets = splitters, hot, buckets
        self.length, self.anchor = length, anchor
        self.compressor = zstandard.ZstdCompressor(level=3)
        self.clear()

    def clear(self) -> None:
        self.seen: dict[tuple[bytes, int], tuple[int, int, int]] = {}
        self.held: dict[int, list] = {}
        self.bytes = 0

    def add(self, bucket: int, text: bytes, at: int, doc: tuple[int, int], start: int) -> None:
        self.held.setdefault(bucket, []).append((text, at, doc[0], doc[1], start))
        self.bytes += len(text) + 40

    def rows(self) -> pa.RecordBatch:
        buckets, blobs = [], []
        for bucket, held in self.held.items():
            texts, at, ids, hashes, starts = zip(*held)
            numbers = np.array([list(map(len, texts)), at, ids, hashes, starts], np.int64)
            # columns of numbers compress well as differences
            head = np.diff(numbers, axis=1, prepend=0).tobytes()
            buckets.append(bucket)
            blobs.append(self.compressor.compress(len(texts).to_bytes(8, "little") + head + b"".join(texts)))
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())],
                                          names=["bucket", "segments"])


def unpack(blob: bytes) -> tuple[list[bytes], np.ndarray]:
    plain = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(plain[:8], "little")
    numbers = np.cumsum(np.frombuffer(plain, np.int64, 5 * n, 8).reshape(5, n), axis=1)
    ends = 8 + 40 * n + np.cumsum(numbers[0])
    return [plain[e - k:e] for e, k in zip(ends.tolist(), numbers[0].tolist())], numbers[1:]


_SENT = "bucket int, segments binary, doc_id long, text_hash long, start long, stop long"


def _send(splitters: np.ndarray, hot: set[bytes], buckets: int, length: int, anchor: int):
    """Rows of two kinds, both with a bucket: packed segments, and ranges that
    are known to be duplicates already, which a bucket hands on."""

    def known(found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        ids, hashes, start, stop = zip(*merge_ranges(found)) if found else ((), (), (), ())
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array([h % buckets for h in hashes], pa.int32()), pa.nulls(n, pa.binary()), pa.array(ids, pa.int64()),
             pa.array(hashes, pa.int64()), pa.array(start, pa.int64()), pa.array(stop, pa.int64())],
            names=["bucket", "segments", "doc_id", "text_hash", "start", "stop"])

    def packed(sender: _Sender) -> pa.RecordBatch:
        rows = sender.rows()
        unused = pa.array(np.zeros(rows.num_rows, np.int64))  # not null: pandas would turn the column to floats
        return pa.RecordBatch.from_arrays([*rows.columns, unused, unused, unused, unused],
                                          names=["bucket", "segments", "doc_id", "text_hash", "start", "stop"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(splitters, hot, buckets, length, anchor)
        for batch in slices(batches, "text", SLICE_BYTES):
            ids = [_NO_ID if i is None else i for i in batch.column("doc_id").to_pylist()]
            hashes = batch.column("text_hash").to_pylist()
            texts = as_bytes(batch.column("text"))
            order = sorted((i for i, t in enumerate(texts) if t and len(t) >= length),
                           key=lambda i: (ids[i], hashes[i]))
            for part in _parts(order, texts, length):
                found: list[tuple[int, int, int, int]] = []
                # what was sent before may lie behind these documents
                sender.seen.clear()
                data = np.frombuffer(b"".join(texts[i][a:b] for i, a, b in part), np.uint8)
                ends = np.cumsum([b - a for _, a, b in part])
                begin, stop, at = segments(data, ends, length, anchor)
                owner = np.searchsorted(ends, begin, "right")
                base = np.concatenate(([0], ends[:-1]))
                plain = data.tobytes()
                keys = np.array([plain[p:p + anchor] for p in at.tolist()], f"S{anchor}")
                bucket = np.searchsorted(splitters, keys, "right")
                for d, lo, hi, p, to in zip(owner.tolist(), begin.tolist(), stop.tolist(), at.tolist(),
                                            bucket.tolist()):
                    i, first, _ = part[d]
                    doc, start = (ids[i], hashes[i]), lo - int(base[d]) + first
                    text = plain[lo:hi + length]
                    place = (*doc, start)
                    before = sender.seen.setdefault((text, p - lo), place)
                    if before is not place:
                        if before != place:  # a repeated row is not a repeat of itself
                            found.append((*place, start + len(text)))
                        continue
                    if hot and text[p - lo:p - lo + anchor] in hot:
                        for o in range(hi - lo + 1):
                            window = text[o:o + length]
                            sender.add(buckets + zlib.crc32(window) % buckets, window, 0, doc, start + o)
                    else:
                        sender.add(to, text, p - lo, doc, start)
                yield known(found)
                if sender.bytes >= FLUSH_BYTES:
                    yield packed(sender)
        if sender.held:
            yield packed(sender)

    return run


def _parts(order: list[int], texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Runs of (text, from, to) of one slice at most; a longer text is cut into
    stretches that overlap so that each window lies in one."""
    part, size = [], 0
    for i in order:
        n = len(texts[i])
        if n > 2 * SLICE_BYTES:
            for a in range(0, n - length + 1, SLICE_BYTES):
                yield [(i, a, min(n, a + SLICE_BYTES + length - 1))]
            continue
        part.append((i, 0, n))
        size += n
        if size >= SLICE_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def merge_ranges(ranges: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Ranges (doc, hash, start, stop) with overlapping and touching ones joined."""
    out: list[list[int]] = []
    for doc, text_hash, start, stop in sorted(ranges):
        if out and out[-1][0] == doc and out[-1][1] == text_hash and start <= out[-1][3]:
            out[-1][3] = max(out[-1][3], stop)
        else:
            out.append([doc, text_hash, start, stop])
    return [tuple(r) for r in out]


def multikey_quicksort(keys: np.ndarray, leaf: int = SORT_LEAF) -> np.ndarray:
    """The order that sorts the rows of ``keys`` (numbers) by their columns.

    Three-way partitions by a pivot of one column; equal rows go on with the
    next column. Small parts are sorted outright."""
    order = np.arange(len(keys))
    todo = [(0, len(keys), 0)]
    rng = np.random.default_rng(1)
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2:
            continue
        part = order[lo:hi]
        if hi - lo <= leaf:
            columns = keys[part, depth:]
            order[lo:hi] = part[np.lexsort(columns.T[::-1])]
            continue
        column = keys[part, depth]
        pivot = np.sort(column[rng.integers(0, hi - lo, 31)])[15]
        less, more = column < pivot, column > pivot
        equal = ~(less | more)
        n_less, n_equal = int(less.sum()), int(equal.sum())
        order[lo:hi] = np.concatenate((part[less], part[equal], part[more]))
        todo.append((lo, lo + n_less, depth))
        todo.append((lo + n_less + n_equal, hi, depth))
        if depth + 1 < keys.shape[1]:
            todo.append((lo + n_less, lo + n_less + n_equal, depth + 1))
    return order


def repeated_windows(texts: list[bytes], ids: np.ndarray, hashes: np.ndarray, starts: np.ndarray,
                     length: int) -> list[tuple[int, int, int, int]]:
    """Ranges of windows that occur earlier, among those of all ``texts``."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(texts)), counts)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = np.repeat(np.cumsum(sizes) - sizes, counts) + inner
    word = words_at(data)
    offsets = [*range(0, length - 8, 8), length - 8]
    keys = np.stack([word[first + o] for o in offsets], axis=1)
    order = multikey_quicksort(keys)
    ordered = keys[order]
    new = np.ones(len(order), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    run = np.cumsum(new) - 1
    place = starts[owner] + inner
    rank = np.empty(len(order), np.int64)
    columns = (place, hashes[owner], ids[owner])
    by_place = np.lexsort(columns)
    # equal places, those of repeated rows, have one rank
    other = np.zeros(len(order), bool)
    for column in columns:
        other[1:] |= np.diff(column[by_place]) != 0
    rank[by_place] = np.cumsum(other)
    earliest = np.minimum.reduceat(rank[order], np.flatnonzero(new))
    again = order[rank[order] != earliest[run]]
    return [(int(ids[owner[i]]), int(hashes[owner[i]]), int(place[i]), int(place[i]) + length) for i in again]


def duplicates_of_bucket(texts: list[bytes], numbers: np.ndarray, length: int,
                         anchor: int) -> list[tuple[int, int, int, int]]:
    """Ranges of the bucket's windows that occur earlier."""
    at, ids, hashes, starts = numbers
    first: dict[tuple[bytes, int], int] = {}
    ranges = []
    for i in np.lexsort((starts, hashes, ids)).tolist():
        before = first.setdefault((texts[i], int(at[i])), i)
        # a repeated row is not a repeat of itself
        if (ids[i], hashes[i], starts[i]) != (ids[before], hashes[before], starts[before]):
            ranges.append((int(ids[i]), int(hashes[i]), int(starts[i]), int(starts[i]) + len(texts[i])))
    groups: dict[bytes, list[int]] = {}
    for (text, place), i in first.items():
        groups.setdefault(text[place:place + anchor], []).append(i)
    batch: list[int] = []
    windows = 0

    def sort() -> None:
        own = np.array(batch)
        ranges.extend(repeated_windows([texts[i] for i in batch], ids[own], hashes[own], starts[own], length))

    for members in groups.values():
        if len(members) > 1:
            batch.extend(members)
            windows += sum(len(texts[i]) - length + 1 for i in members)
            if windows >= SORT_WINDOWS:
                sort()
                batch, windows = [], 0
    if batch:
        sort()
    return merge_ranges(ranges)


def _sort_bucket(length: int, anchor: int):
    columns = ["doc_id", "text_hash", "start", "stop"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        known = frame["segments"].isna()
        out = frame.loc[known, columns]
        parts = [unpack(b) for b in frame.loc[~known, "segments"]]
        if not parts:
            return out
        texts = [t for p in parts for t in p[0]]
        found = duplicates_of_bucket(texts, np.concatenate([p[1] for p in parts], axis=1), length, anchor)
        return pd.concat([out, pd.DataFrame(found, columns=columns).astype("int64")])

    return run


def _sample_anchors(length: int, anchor: int, keep: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            texts = [t[:4 * SLICE_BYTES] for t in as_bytes(batch.column("text")) if t and len(t) >= length]
            if not texts:
                continue
            data = np.frombuffer(b"".join(texts), np.uint8)
            _, _, at = segments(data, np.cumsum([len(t) for t in texts]), length, anchor)
            at = at[np.random.default_rng(len(data)).permutation(len(at))[:keep]]
            plain = data.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([plain[p:p + anchor] for p in at.tolist()], pa.binary())],
                                             names=["leading"])

    return run


def _splitters(texts: DataFrame, buckets: int, n_docs: int, length: int, anchor: int) -> np.ndarray:
    """Cuts between ``buckets`` ranges of leading strings, from a sample."""
    fraction = min(1.0, SAMPLE_DOCUMENTS / max(n_docs, 1))
    rows = texts.sample(fraction=fraction, seed=7).select("text").mapInArrow(
        _sample_anchors(length, anchor, 20_000), "leading binary").limit(SAMPLE_ANCHORS).toPandas()
    sample = np.sort(np.array(rows["leading"].tolist() or [b""], f"S{anchor}"))
    return sample[np.linspace(0, len(sample) - 1, buckets + 1).astype(int)[1:-1]]


def _remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "packed", 1 << 20):
        kept, spans, sizes = [], [], []
        for packed, ranges in zip(batch.column("packed").to_pylist(), batch.column("ranges").to_pylist()):
            text = unpacked(packed) or b""
            own = [(r[2], r[3]) for r in merge_ranges([(0, 0, x["start"], x["stop"]) for x in ranges or ()])]
            out, at = [], 0
            for a, b in own:
                out.append(text[at:a])
                at = b
            kept.append(b"".join([*out, text[at:]]) if own else text)
            spans.append([{"start": a, "stop": b} for a, b in own])
            sizes.append(len(text))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
            names=["doc_id", "n_bytes", "kept", "spans"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, bucket_bytes: int = BUCKET_BYTES,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, kept (binary: a cut may
    split a character) and spans, the maximal removed ranges of bytes.

    A null text is empty. Ids are whole numbers; null ids come after all
    others. Rows of equal id (or none) and equal text are one document, no repeat of
    each other, and get equal results; rows of equal id and different texts are ordered by the texts'
    hashes. Other columns of ``docs`` are not read. An empty table gives no
    rows.
    """
    if not 16 <= anchor <= length or anchor % 8:
        raise ValueError("anchor must be a multiple of 8 from 16 on, and length at least as much")
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    texts = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    size = texts.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    buckets = max(2, -(-(size["bytes"] or 0) // bucket_bytes))
    splitters = _splitters(texts, buckets, size["n"], length, anchor)
    values, times = np.unique(splitters, return_counts=True)
    hot = {bytes(v).ljust(anchor, b"\0") for v in values[times > 1]}

    sent = texts.mapInArrow(_send(splitters, hot, buckets, length, anchor), _SENT)
    ranges = scratch.write(sent.groupBy("bucket").applyInPandas(
        _sort_bucket(length, anchor), "doc_id long, text_hash long, start long, stop long"), "ranges")
    by_doc = ranges.groupBy(F.col("doc_id").alias("r_id"), F.col("text_hash").alias("r_hash")).agg(
        F.collect_list(F.struct("start", "stop")).alias("ranges"))  # of one document
    # texts travel to their ranges compressed
    joined = packed_texts(texts).join(by_doc, (F.coalesce("doc_id", F.lit(int(_NO_ID))) == F.col("r_id"))
                        & (F.col("text_hash") == F.col("r_hash")), "left")
    return joined.select("doc_id", "packed", "ranges").mapInArrow(
        _remove, "doc_id long, n_bytes long, kept binary, spans array<struct<start: long, stop: long>>")
