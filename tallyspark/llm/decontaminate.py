"""Benchmark decontamination by SimHash windows (operator 6).

A document leaks a benchmark item when a window of the item's number of words
(the whole document, if it has fewer) has a weighted Jaccard similarity of
``percent`` or more with it, over k-word shingles weighted by their occurrences.

Each window is a 64-bit SimHash of its words. The items' fingerprints are
indexed by blocks of bits: two fingerprints within RADIUS differ by at most
RADIUS // BLOCKS bits in one of BLOCKS blocks, so looking up all values of a
block that near finds every fingerprint within the radius. Candidates are then
verified exactly, word by word. A document with fewer words than an item is
one window: it is verified if enough of its shingles are the item's.

Windows without a single shingle of the benchmark cannot reach any similarity
and are not fingerprinted; a bitmap of the benchmark's shingle hashes tells.

The benchmark is small, the documents are not: the items are broadcast in
blocks of BLOCK_BYTES of text, each block against all documents in one map step
without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import id_and_text, lean, slices
from tallyspark.llm.words import WordHashes, shingles

K = 5
PERCENT = 80
BLOCKS, RADIUS = 8, 23
BLOCK_BYTES = 8 << 20  # of benchmark text in one broadcast
_BITMAP_BITS = 20

# ASCII punctuation parts words; other characters belong to them
_PARTS = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words, without ASCII punctuation."""
    return (text or "").lower().encode("utf-8", "replace").translate(_PARTS).split()


def weighted(words: list[bytes], k: int = K) -> Counter:
    """k-word shingles and their occurrences; all words as one if there are fewer."""
    k = min(k, len(words))
    return Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if words else Counter()


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity; 0 if either is empty."""
    least = sum((a & b).values())
    return least / (sum(a.values()) + sum(b.values()) - least) if least else 0.0


def _signs(hashes: np.ndarray) -> np.ndarray:
    """One row of 64 signs for each hash."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def simhashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of all windows of ``size`` words."""
    sums = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(_signs(hashes), axis=0, out=sums[1:])
    bits = (sums[size:] - sums[:-size]) > 0
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


@dataclass
class Items:
    """Index of one block of benchmark items."""

    ids: list
    words: list[list[bytes]]

    def __post_init__(self):
        hashes = WordHashes()
        self.k = K
        self.shingles = [weighted(w, self.k) for w in self.words]
        own = [hashes.of(w) for w in self.words]
        self.prints = np.array([simhashes(h, len(h))[0] for h in own], np.uint64)
        self.sizes = np.array([len(w) for w in self.words])
        pairs = [(s, i) for i, h in enumerate(own) for s in shingles(h, self.k).tolist()]
        # items with fewer words than a shingle are looked up by their first word
        self.short = {int(h[0]) for h in own if len(h) < self.k}
        self.table = np.array(sorted({s for s, i in pairs if self.sizes[i] >= self.k}), np.uint64)
        self.bitmap = np.zeros(1 << _BITMAP_BITS, bool)
        self.bitmap[(self.table >> np.uint64(64 - _BITMAP_BITS)).astype(np.int64)] = True
        self.items_of: dict[int, list[int]] = {}
        for s, i in pairs:
            self.items_of.setdefault(s, []).append(i)
        width, near = 64 // BLOCKS, RADIUS // BLOCKS
        flips = [sum(1 << b for b in c) for n in range(near + 1) for c in combinations(range(width), n)]
        # windows are as long as an item, so each size has an index of its own
        self.blocks: dict[int, list[dict[int, list[int]]]] = {}
        for i, p in enumerate(self.prints.tolist()):
            index = self.blocks.setdefault(int(self.sizes[i]), [{} for _ in range(BLOCKS)])
            for at, block in enumerate(index):
                for flip in flips:
                    block.setdefault((p >> at * width & (1 << width) - 1) ^ flip, []).append(i)

    def hits(self, hashes: np.ndarray) -> list[int]:
        """Places in a document of shingles that an item has too."""
        if len(hashes) >= self.k and len(self.table):
            own = shingles(hashes, self.k)
            maybe = np.flatnonzero(self.bitmap[(own >> np.uint64(64 - _BITMAP_BITS)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.table, own[maybe]), len(self.table) - 1)
            places = maybe[self.table[at] == own[maybe]].tolist()
        else:
            places = []
        if self.short:
            places += [i for i, h in enumerate(hashes.tolist()) if h in self.short]
        return places

    def within(self, fingerprint: int, size: int) -> set[int]:
        """All items of ``size`` words whose fingerprints lie within the radius."""
        width = 64 // BLOCKS
        found: set[int] = set()
        for at, block in enumerate(self.blocks[size]):
            found.update(block.get(fingerprint >> at * width & (1 << width) - 1, ()))
        return {i for i in found if (int(self.prints[i]) ^ fingerprint).bit_count() <= RADIUS}

    def leaks(self, words: list[bytes], hashes: np.ndarray, percent: int) -> list[tuple[int, int, float]]:
        """(item, first word of the window, similarity): of overlapping windows
        of an item the most similar, the first of equal ones."""
        places = self.hits(hashes)
        if not places:
            return []
        near = Counter(i for p in places for i in self._near(hashes, p))
        sizes = {int(self.sizes[i]) for i in near}
        best = self._longer(words, near, percent)
        for size in sorted(s for s in sizes if s <= len(words)):
            starts = sorted({s for p in places
                             for s in range(max(0, p + min(self.k, size) - size), min(p, len(words) - size) + 1)})
            found: dict[int, list[tuple[int, float]]] = {}
            for lo, hi in _runs(starts):
                prints = simhashes(hashes[lo:hi + size], size)
                for start, fingerprint in enumerate(prints.tolist(), lo):
                    for i in self.within(fingerprint, size):
                        value = similarity(weighted(words[start:start + size], self.k), self.shingles[i])
                        if value * 100 >= percent:
                            found.setdefault(i, []).append((start, value))
            for i, windows in found.items():
                kept: list[tuple[int, float]] = []
                for start, value in sorted(windows, key=lambda w: (-w[1], w[0])):
                    if all(abs(start - s) >= size for s, _ in kept):
                        kept.append((start, value))
                best.extend((i, start, value) for start, value in kept)
        return sorted(best, key=lambda b: (b[1], b[0]))

    def _longer(self, words: list[bytes], near: Counter, percent: int) -> list[tuple[int, int, float]]:
        """Leaks of items with more words than the document, as one window.
        ``near`` has at least the number of shingles that they have in common."""
        n = len(words) - self.k + 1
        enough = [i for i, most in near.items() if len(words) < self.sizes[i]
                  and most * (100 + percent) >= percent * (n + int(self.sizes[i]) - self.k + 1)]
        own = weighted(words, self.k) if enough else None
        values = [(i, 0, similarity(own, self.shingles[i])) for i in enough]
        return [v for v in values if v[2] * 100 >= percent]

    def _near(self, hashes: np.ndarray, place: int) -> Iterable[int]:
        if self.short and int(hashes[place]) in self.short:
            yield from (i for i, w in enumerate(self.words) if len(w) < self.k)
        if place + self.k <= len(hashes):
            yield from self.items_of.get(int(shingles(hashes[place:place + self.k], self.k)[0]), ())


def _runs(starts: list[int]) -> Iterator[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    at = 0
    for i in range(1, len(starts) + 1):
        if i == len(starts) or starts[i] != starts[i - 1] + 1:
            yield starts[at], starts[i - 1]
            at = i


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The benchmark as blocks of bounded size; items without words are left
    out, items of equal words stay apart."""
    rows = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes)
    for block in range(n):
        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == block).collect()  # about block_bytes
        items = [(r["item_id"], w) for r in part if (w := words_of(r["text"]))]
        if items:
            yield Items([i for i, _ in items], [w for _, w in items])


def _scan(shared, percent: int):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, hashes = shared.value, WordHashes()
        id_type = pa.array(items.ids).type
        for batch in slices(batches, "text"):
            rows, ids, starts, sizes, values = [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                words = words_of(text)
                for i, start, value in items.leaks(words, hashes.of(words), percent):
                    rows.append(row)
                    ids.append(items.ids[i])
                    starts.append(start)
                    sizes.append(min(int(items.sizes[i]), len(words)))
                    values.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(ids, id_type),
                 pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(values, pa.float64())],
                names=["doc_id", "item_id", "first_word", "n_words", "similarity"])

    return scan


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, id_col: str = "doc_id",
          text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per leaked passage: doc_id, item_id, first_word, n_words,
    similarity. Clean documents have no row.

    Null and empty texts, of documents or items, have no words and leak
    nothing. Items of fewer than five words count as one shingle. Repeated rows
    are reported each. A document shorter than an item is one window as a whole.
    Other columns are not read. Without documents or items there are no rows.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    item_type = benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}, first_word long, n_words long, similarity double"
    out = spark.createDataFrame([], schema)
    for items in item_blocks(benchmark, item_col, item_text_col):
        out = out.unionByName(rows.mapInArrow(lean(_scan(spark.sparkContext.broadcast(items), percent)), schema))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns."""

    def keep(shared):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, hashes = shared.value, WordHashes()
            for batch in batches:
                clean = []
                for text in batch.column(text_col).to_pylist():
                    words = words_of(text)
                    clean.append(not items.leaks(words, hashes.of(words), percent))
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    for items in item_blocks(benchmark, item_col, item_text_col):
        docs = docs.mapInArrow(lean(keep(docs.sparkSession.sparkContext.broadcast(items))), docs.schema)
    return docs
