"""Bulk-synchronous best-fit packing (operator 5).

Documents are encoded, cut into pieces of at most ``capacity`` tokens, and the
pieces are packed into sequences:

1. The largest pieces open sequences: all that cannot share one with another
   of them, and as many as the total needs at least.
2. A *sweep* range-sorts the remaining pieces and the gaps of the open
   sequences by size. Going down, every piece takes its successor, the
   smallest gap left that is large enough; of several pieces with one successor
   the higher-ranked takes it and the next one takes the next gap. Each range
   is swept by a task on its own; what stays unmatched in the ranges is matched
   across them by rank, from one (pieces, gaps) count a range.
3. The gaps shrink by what they took, and the sweep is repeated.
4. After some sweeps small pieces are joined to bundles, so that a sequence of
   thousands of tiny documents does not need thousands of sweeps. When no gap
   fits any more, a large rest opens sequences as in 1; a small one is cut into
   sequences in its sorted order.

A sweep moves ids and lengths only. No group is collected anywhere: equal
lengths, however many, are split between ranges by their ids.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import Scratch, id_and_text, lean, slices

CAPACITY = 4096
END_ID = 1
CACHE_WORDS = 250_000  # words whose ids a worker remembers
ROWS_PER_RANGE = 20_000  # at most, unless that makes too many ranges
LEAST_RANGES, MOST_RANGES = 8, 10_000  # of a sweep; the driver adds up their counts
SWEEPS_BEFORE_BUNDLES = 8
SMALL_REST = 0.02  # of the pieces: such a rest is cut in its sorted order

_PIECES = "piece int, start long, length long, ids_crc32 long"


class _WordIds(dict):
    """word -> its ids; a word that is not there yet is encoded when it is asked for."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__({"": b""})
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.encode(word)
        return ids


class WordEncoder:
    """Ids of texts, as little-endian unsigned 32-bit bytes, by a tokenizer
    whose tokens never cross a blank or a line feed: every word is encoded once
    and remembered. Words of letters with one final point or comma share the
    ids of the bare word. Texts that hold a special token's string, or letters
    whose lower case depends on their neighbours, are left to the tokenizer."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.bytes_as_letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.limit = cache_words
        self.ids = _WordIds(self._word)
        self.marks = {m: self._whole(m) for m in ".,"}

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        if word[-1:] in self.marks and word[:-1].isalpha():
            stem, mark = word[:-1], self.marks[word[-1]]
            return self.ids[stem] + mark  # the bare word is remembered too
        if word.isalpha():  # one pre-token, in lower case and composed already
            letters = word if word.isascii() else self.bytes_as_letters.pre_tokenize_str(word)[0][0]
            return self._pack([t.id for t in self.model.tokenize(letters)])
        return self._whole(word)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if ("Σ" in text or "İ" in text or not unicodedata.is_normalized("NFC", text)
                or any(s in text for s in self.special)):
            return self._whole(text)
        words = text.lower().replace("\n", " ").split(" ")
        ids = self.ids
        if len(ids) > self.limit:
            ids = self.ids = _WordIds(self._word)
        return b"".join(map(ids.__getitem__, words))


@lru_cache(maxsize=2)
def encoder_of(path: str) -> WordEncoder:
    """One encoder a worker, which keeps what it has learnt between tasks."""
    return WordEncoder(path)


def _cut(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in slices(batches, "text"):
            rows, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = encoder.encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32."""
    rows = id_and_text(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(_cut(vocabulary, capacity, end_id)), f"doc_id {id_type}, {_PIECES}")


# --- one sweep -------------------------------------------------------------


def match_down(is_piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of matched gaps and of the pieces that take them, for entries in
    descending order: a piece takes the nearest gap before it that is left."""
    stack, gaps, pieces = [], [], []
    for at, piece in enumerate(is_piece.tolist()):
        if not piece:
            stack.append(at)
        elif stack:
            gaps.append(stack.pop())
            pieces.append(at)
    return np.array(gaps, np.int64), np.array(pieces, np.int64)


_SWEPT = "part long, kind string, rank long, unit long, length long, bin long, gap long"


def _sweep_range(rows: pd.DataFrame) -> pd.DataFrame:
    """One range: its matches, and what is left of its pieces and gaps, ranked."""
    rows = rows.sort_values(["size", "is_piece", "mix", "id"], ascending=[False, True, True, True])
    part, size, ids = rows["part"].iat[0], rows["size"].to_numpy(), rows["id"].to_numpy()
    is_piece = rows["is_piece"].to_numpy()
    gaps, pieces = match_down(is_piece)
    left = np.ones(len(rows), bool)
    left[gaps] = left[pieces] = False
    at = np.flatnonzero(left)
    out = [pd.DataFrame({"part": part, "kind": "matched", "rank": np.zeros(len(gaps), np.int64),
                         "unit": ids[pieces], "length": size[pieces], "bin": ids[gaps], "gap": size[gaps]})]
    for kind, places in (("piece", at[is_piece[at] == 1]), ("gap", at[is_piece[at] == 0])):
        out.append(pd.DataFrame({"part": part, "kind": kind, "rank": np.arange(len(places)), "unit": ids[places],
                                 "length": size[places], "bin": ids[places], "gap": size[places]}))
    return pd.concat(out, ignore_index=True)


def across(counts: dict[int, tuple[int, int]]) -> list[tuple[str, int, int, int, int, int]]:
    """Matches between ranges, from each range's counts of unmatched (pieces,
    gaps): stretches (kind, part, first rank, last rank, number of the match of
    the first rank, step). Pieces of a range take the smallest gaps left in the
    ranges above it."""
    stack: list[list[int]] = []  # [part, gaps left]
    out, number = [], 0
    for part in sorted(counts):
        pieces, gaps = counts[part]
        taken = 0
        while taken < pieces and stack:
            above = stack[-1]
            n = min(pieces - taken, above[1])
            out.append(("piece", part, taken, taken + n - 1, number, 1))
            out.append(("gap", above[0], above[1] - n, above[1] - 1, number + n - 1, -1))
            number, taken, above[1] = number + n, taken + n, above[1] - n
            if not above[1]:
                stack.pop()
        if gaps:
            stack.append([part, gaps])
    return out


def _bundle_range(target: int):
    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "mix", "id"], ascending=[False, True, True])
        head, filled, heads, offsets = None, 0, [], []
        for unit, length in zip(rows["id"].tolist(), rows["size"].tolist()):
            if head is None or filled + length > target:
                head, filled = unit, 0
            heads.append(head)
            offsets.append(filled)
            filled += length
        return pd.DataFrame({"unit": rows["id"].to_numpy(), "length": rows["size"].to_numpy(), "bundle": heads,
                             "inner": offsets})

    return join


class _Packing:
    """The state between sweeps: a table of entries (is_piece, size, id), the
    remaining units and the gaps of the open sequences."""

    def __init__(self, scratch: Scratch, units: DataFrame, capacity: int):
        self.scratch, self.spark, self.capacity = scratch, scratch.spark, capacity
        self.log: list[tuple[str, DataFrame]] = []  # placements and bundlings, in order
        self.steps = 0
        full = units.where(F.col("length") >= capacity)
        self.place(full.select("unit", F.col("unit").alias("bin"), F.lit(0).cast("long").alias("offset")))
        self.entries = self._units(units.where(F.col("length") < capacity))
        self.measure()

    def name(self, what: str) -> str:
        self.steps += 1
        return f"{self.steps:04d}_{what}"

    def place(self, rows: DataFrame) -> None:
        self.log.append(("place", rows.select("unit", "bin", "offset")))

    def place_alone(self, units: DataFrame) -> None:
        self.place(units.select("unit", F.col("unit").alias("bin"), F.lit(0).cast("long").alias("offset")))

    @staticmethod
    def _units(units: DataFrame) -> DataFrame:
        return units.select(F.lit(1).alias("is_piece"), F.col("length").alias("size"), F.col("unit").alias("id"))

    @staticmethod
    def _gaps(gaps: DataFrame) -> DataFrame:
        return gaps.select(F.lit(0).alias("is_piece"), F.col("gap").alias("size"), F.col("bin").alias("id"))

    def measure(self) -> None:
        """Counts by kind and size, at most twice the capacity of them: where
        each class of equal entries begins in the descending order."""
        counts = {(r["size"], r["is_piece"]): r["count"]
                  for r in self.entries.groupBy("size", "is_piece").count().collect()}
        pieces = {s: n for (s, p), n in counts.items() if p}
        self.n = sum(pieces.values())
        self.tokens = sum(s * n for s, n in pieces.items())
        self.large = sum(n for s, n in pieces.items() if s > self.capacity // 2)
        least = min(pieces, default=0)
        self.classes, self.rows = [], 0
        for (size, piece), n in sorted(counts.items(), key=lambda c: (-c[0][0], c[0][1])):
            if size >= least:  # smaller gaps are done
                self.classes.append((size, piece, self.rows, n))
                self.rows += n
        self.gaps = sum(n for _, piece, _, n in self.classes if not piece)
        self.per_bundling = max(ROWS_PER_RANGE, -(-self.rows // MOST_RANGES))
        self.per_sweep = min(self.per_bundling, max(1, -(-self.rows // LEAST_RANGES)))

    def ranged(self, entries: DataFrame, per_range: int) -> DataFrame:
        """Adds ``place``, about the place in the descending order, and the
        number of the range; equal entries are spread
        by a hash of their ids, which is their order too."""
        table = self.spark.createDataFrame(self.classes, "size long, is_piece int, first long, n long")
        mix = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
        return entries.join(F.broadcast(table), ["size", "is_piece"]).withColumn("mix", mix).withColumn(
            "place", F.col("first") + F.floor(F.col("n") * F.col("mix") / F.lit(float(1 << 30)))).withColumn(
            "part", F.floor(F.col("place") / per_range)).select(
            "is_piece", "size", "id", "mix", "place", "part")

    def open(self) -> None:
        """The largest units open sequences: those of more than half the
        capacity, and about as many as the total needs."""
        k = max(self.large, -(-self.tokens // self.capacity))
        units = self.scratch.write(self.ranged(self.entries.where("is_piece = 1"), self.per_sweep), self.name("opened"))
        first = units.where(F.col("place") < k).select(F.col("id").alias("unit"), F.col("size").alias("length"))
        self.place_alone(first)
        self.entries = units.where(F.col("place") >= k).select("is_piece", "size", "id").unionByName(
            self._gaps(first.select(F.col("unit").alias("bin"), (F.lit(self.capacity) - F.col("length")).alias("gap"))))
        self.measure()

    def sweep(self) -> int:
        """One sweep; the number of matches."""
        swept = self.scratch.write(self.ranged(self.entries, self.per_sweep).groupBy("part").applyInPandas(
            _sweep_range, _SWEPT), self.name("swept"))
        pairs, left = swept.where("kind = 'matched'"), swept.where("kind <> 'matched'")
        before = self.n
        counts: dict[int, list[int]] = {}
        for r in left.groupBy("part", "kind").count().collect():  # two rows a range
            counts.setdefault(r["part"], [0, 0])[r["kind"] == "gap"] = r["count"]
        table = self.spark.createDataFrame(
            across({p: (c[0], c[1]) for p, c in counts.items()}),
            "kind string, part long, first long, last long, number long, step int")
        left = left.alias("l").join(
            F.broadcast(table).alias("s"), (F.col("l.kind") == F.col("s.kind")) & (F.col("l.part") == F.col("s.part"))
            & F.col("rank").between(F.col("first"), F.col("last")), "left").select(
            "l.*", (F.col("number") + F.col("step") * (F.col("rank") - F.col("first"))).alias("match"))
        met = left.where("kind = 'piece' and match is not null").select("match", "unit", "length").join(
            left.where("kind = 'gap' and match is not null").select("match", "bin", "gap"), "match")
        met = self.scratch.write(met.drop("match"), self.name("across"))
        pairs = pairs.select("unit", "length", "bin", "gap").unionByName(met)
        left = left.where("match is null")
        self.place(pairs.select("unit", "bin", (F.lit(self.capacity) - F.col("gap")).alias("offset")))
        self.entries = self._units(left.where("kind = 'piece'")).unionByName(
            self._gaps(left.where("kind = 'gap'"))).unionByName(
            self._gaps(pairs.select("bin", (F.col("gap") - F.col("length")).alias("gap"))))
        self.measure()
        return before - self.n

    def bundle(self, target: int) -> DataFrame:
        """Joins neighbours in the order of size to units of ``target`` tokens
        at most; larger units stay alone. A bundle has the id of its first."""
        units = self.entries.where("is_piece = 1")
        members = self.scratch.write(
            self.ranged(units, self.per_bundling).groupBy("part").applyInPandas(
                _bundle_range(target), "unit long, length long, bundle long, inner long"), self.name("bundles"))
        self.log.append(("bundle", members.select("unit", "bundle", "inner")))
        bundles = members.groupBy(F.col("bundle").alias("unit")).agg(F.sum("length").alias("length"))
        bundles = self.scratch.write(bundles, self.name("bundled"))
        self.entries = self._units(bundles).unionByName(self.entries.where("is_piece = 0"))
        self.measure()
        return bundles

    def placements(self) -> DataFrame:
        """Each unit's sequence and offset, bundles taken apart again."""
        out = self.spark.createDataFrame([], "unit long, bin long, offset long")
        for what, rows in reversed(self.log):
            if what == "place":
                out = out.unionByName(rows)
            else:
                out = rows.join(out.withColumnRenamed("unit", "bundle"), "bundle").select(
                    "unit", "bin", (F.col("offset") + F.col("inner")).alias("offset"))
        return out


def pack(units: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """Places units (``unit`` long, unique; ``length`` 1 .. capacity): unit,
    bin (the id of the unit that opened the sequence), offset."""
    packing = _Packing(scratch, units, capacity)
    total, target, sweeps = packing.n, capacity // 8, 0
    stuck = True
    while packing.n:
        if stuck or not packing.gaps:
            if sweeps and packing.n <= max(1, SMALL_REST * total):
                packing.place_alone(packing.bundle(capacity))
                break
            packing.open()
        elif sweeps and sweeps % SWEEPS_BEFORE_BUNDLES == 0 and target < capacity:
            packing.bundle(target)
            target *= 2
        stuck = not packing.n or not packing.sweep()
        sweeps += 1
    return packing.placements()


def best_fit(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset.

    A null or empty text is one piece, its end id. Rows with equal or null ids
    are packed as documents of their own. Other columns of ``docs`` are not
    read. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "best_fit")
    pieces = scratch.write(
        cut_pieces(docs, vocabulary, capacity, end_id, id_col, text_col)
        .withColumn("unit", F.monotonically_increasing_id()), "pieces")
    placed = pack(pieces.select("unit", "length"), scratch, capacity)
    return pieces.join(placed, "unit").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
