"""Line deduplication by a segment-partition edit join (operator 4).

A line goes when the same line, or one within ``most`` edits of it, occurs
earlier (smaller document id, or further up in the document). Lines are
compared without surrounding white space; lines of fewer than MIN_BYTES bytes
always stay. Edits are insertions, deletions and replacements of bytes.

1. Every line is cut into zones of nearly equal size. ``most`` edits fall into
   ``most`` zones at most; what lies before, between and after these is the same
   in both lines, at a shift that the edits before it bound. A choice of zones is
   a cell; its key is the hash of all that lies outside. Lines within ``most``
   edits share a key of some cell, the shorter one unshifted. The first cells
   are those of ``most + 1`` zones, where one zone remains to be hashed.
2. Of the lines that share a key each is compared with the earliest and a random
   one. A line needs only one earlier near line to go, so those that this
   settles ask no more.
3. The other lines of a key are compared with all earlier ones of it if at most
   CROWD of them are open. If more are, the key says too little: its cell is cut
   into zones of half the size, the lines are keyed anew by its finer cells, and
   step 2 follows again. So a group of n like lines makes at most CROWD * n
   comparisons for a key, not n * n, and lines that agree in all but ever
   smaller zones either settle or part. At ``finest`` zones all open ones are
   compared, however many.
4. Compared lines must have nearly the same length and the same counts of bytes in
   eight classes, bounds that need no text and are tested inside the join. The
   texts of the pairs that remain are fetched and verified by banded bit-parallel
   edit distance.

Lines are known by 64-bit hashes; every distinct line is written once, with its
first place and the keys of its first cells.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tallyspark.llm.common import Scratch, as_bytes, free_name, lean, packed_texts, slices, unpacked
from tallyspark.llm.edit_distance import edits

MOST = 2
MIN_BYTES = 20
CROWD = 256  # open lines that a key is asked for one by one
_NO_ID = np.iinfo(np.int64).max  # null ids come last


def lines_of(text: bytes | None, min_bytes: int = MIN_BYTES) -> list[tuple[int, bytes]]:
    """(number, stripped line) of the lines that take part."""
    out = []
    for i, line in enumerate((text or b"").split(b"\n")):
        line = line.strip()
        if len(line) >= min_bytes:
            out.append((i, line))
    return out


def line_id(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def profiles(lines: list[bytes]) -> np.ndarray:
    """Counts of each line's bytes in eight classes, modulo 16, four bits each."""
    classes = np.frombuffer(b"".join(lines), np.uint8) & 7
    row = np.repeat(np.arange(len(lines)), np.fromiter(map(len, lines), np.int64, len(lines)))
    counts = np.bincount(row * 8 + classes, minlength=8 * len(lines)).reshape(-1, 8)
    return ((counts & 15) << np.arange(0, 32, 4)).sum(axis=1)


def segment_bounds(length: int, most: int) -> list[tuple[int, int]]:
    """(start, size) of the ``most + 1`` segments; the last ones are longer."""
    size, longer = divmod(length, most + 1)
    bounds, at = [], 0
    for i in range(most + 1):
        n = size + (i > most - longer)
        bounds.append((at, n))
        at += n
    return bounds


def probe_shifts(most: int) -> list[tuple[int, int, int]]:
    """(by how much a line is longer, number of the segment, shift): the places,
    from the segment's own, at which a line holds it if it is within ``most`` edits."""
    shifts = []
    for longer in range(most + 1):
        for i in range(most + 1):
            # i edits before the segment at most, or most - i after it
            low, high = max(-i, longer - (most - i)), min(i, longer + (most - i))
            shifts += [(longer, i, shift) for shift in range(low, high + 1)]
    return shifts


def index_keys(line: bytes, most: int) -> list[tuple]:
    """What ``index_columns`` hashes, for one line."""
    return [(len(line), i, line[at:at + n]) for i, (at, n) in enumerate(segment_bounds(len(line), most))]


def probe_keys(line: bytes, most: int) -> list[tuple]:
    """What ``probe_columns`` hashes, for one line: under these keys a line of at
    most this length is found if it is within ``most`` edits."""
    keys = []
    for longer, i, shift in probe_shifts(most):
        length = len(line) - longer
        if length > 0:
            at, n = segment_bounds(length, most)[i]
            if 0 <= at + shift <= len(line) - n:
                keys.append((length, i, line[at + shift:at + shift + n]))
    return keys


def _segment(length: Column, i: int, most: int) -> tuple[Column, Column]:
    """``segment_bounds`` of segment ``i`` as columns."""
    longer = length % (most + 1)
    size = ((length - longer) / (most + 1)).cast("int")
    return size * i + F.greatest(F.lit(0), longer + (i - most - 1)), size + (longer > most - i).cast("int")


def index_columns(content: str, most: int) -> list[Column]:
    """A key for each segment of a line, of its length, number and bytes."""
    length = F.octet_length(content)
    keys = []
    for i in range(most + 1):
        at, n = _segment(length, i, most)
        keys.append(F.xxhash64(length, F.lit(i), F.substring(F.col(content), at + 1, n)))
    return keys


def probe_columns(content: str, most: int, segment: int | None = None) -> list[Column]:
    """The keys under which the lines near a line and not longer are found, by
    one segment or by all, null where the line has no such place."""
    size = F.octet_length(content)
    keys = []
    for longer, i, shift in probe_shifts(most):
        if segment not in (None, i):
            continue
        length = size - longer
        at, n = _segment(length, i, most)
        at = at + shift
        keys.append(F.when((length > 0) & (at >= 0) & (at + n <= size),
                           F.xxhash64(length, F.lit(i), F.substring(F.col(content), at + 1, n))))
    return keys


def rung(length: int) -> int:
    """``length`` cut to its six leading bits: lines of like length are cut alike."""
    low = max(0, length.bit_length() - 6)
    return length >> low << low


def finest(most: int) -> int:
    """The most zones: a cell's number, of a rung and ``most`` zones, fits 63 bits."""
    return min(1024, 1 << 32 // most)


def cell_number(size: int, zones: tuple[int, ...], n: int) -> int:
    for zone in zones:
        size = size * n + zone
    return size & ((1 << 63) - 1)


def cell_of(number: int, n: int, most: int) -> tuple[int, tuple[int, ...]]:
    zones = []
    for _ in range(most):
        number, zone = divmod(number, n)
        zones.append(zone)
    return number, tuple(reversed(zones))


def cell_places(length: int, size: int, zones: tuple[int, ...], n: int) -> list[tuple[int, bool, tuple]]:
    """(cell, own, runs) for each way in which a line of ``length`` can hold what
    lies outside of ``zones``, of ``n``, of a line of rung ``size`` that is near
    and not longer. ``own``: unshifted, at the line's own rung. As many edits
    as zones precede a run at most, so that is the range of its shift; the last
    run ends with the line. Of ``-left`` or less, ``left`` edits being left after
    the run, all of them insert and the lines are of one length: then the other
    one, taken as the shorter, meets this one at another shift."""
    most = len(zones)

    def at(i: int) -> int:
        return i * size // n

    start, tail = at(zones[0]), size - at(zones[-1] + 1)
    between = [(k + 1, at(z + 1), at(after)) for k, (z, after) in enumerate(zip(zones, zones[1:]))
               if at(z + 1) < at(after)]
    number, places = cell_number(size, zones, n), []
    for shifts in product(*(sorted(range(max(-k, k - most + 1), k + 1), key=abs) for k, _, _ in between)):
        runs = [(0, start), *((a + s, b + s) for (_, a, b), s in zip(between, shifts)), (length - tail, length)]
        runs = tuple((a, b) for a, b in runs if a < b)
        if all(a >= 0 and b <= length for a, b in runs):
            places.append((number, size == rung(length) and not any(shifts), runs))
    return places


@lru_cache(1 << 12)
def first_places(length: int, most: int) -> list[tuple[int, bool, tuple]]:
    """``cell_places`` of all cells of ``most + 1`` zones; the longer of two near
    lines also takes the rungs of the lengths that it can reach."""
    sizes = sorted({rung(length - less) for less in range(min(most, length) + 1)})
    return [place for size in sizes for zones in combinations(range(most + 1), most)
            for place in cell_places(length, size, zones, most + 1)]


def finer_places(length: int, cells: Iterable[int], n: int, most: int) -> list[tuple[int, bool, tuple]]:
    """``cell_places`` of the cells of ``2 * n`` zones inside ``cells``, of ``n``."""
    finer = set()
    for cell in cells:
        size, zones = cell_of(cell, n, most)
        halves = [half for zone in zones for half in (2 * zone, 2 * zone + 1)]
        finer.update((size, chosen) for chosen in combinations(halves, most))
    return [place for size, zones in sorted(finer) for place in cell_places(length, size, zones, 2 * n)]


def cell_keys(line: bytes, places: list[tuple[int, bool, tuple]]) -> dict[int, tuple[int, bool]]:
    """{key: (cell, own)}; of equal keys the unshifted one."""
    keys: dict[int, tuple[int, bool]] = {}
    for cell, own, runs in places:
        held = line[runs[0][0]:runs[0][1]] if len(runs) == 1 else b"".join([line[a:b] for a, b in runs])
        keys.setdefault(xxhash.xxh3_64_intdigest(held, cell) - (1 << 63), (cell, own))
    return keys


KEYS = "key: long, cell: long, own: boolean"


def _key_columns(keyed: Iterable[dict[int, tuple[int, bool]]]) -> tuple[np.ndarray, list[pa.Array]]:
    """Where each line's keys end, from 0, and the keys' columns."""
    ends, columns = array("q", [0]), (array("q"), array("q"), array("b"))
    for keys in keyed:
        for key, (cell, own) in keys.items():
            columns[0].append(key), columns[1].append(cell), columns[2].append(own)
        ends.append(len(columns[0]))
    key, cell, own = (np.array(c) for c in columns)
    return np.array(ends), [pa.array(key), pa.array(cell), pa.array(own.astype(bool))]


def _finer(n: int, most: int):
    """(id, key, cell, own) of each line's cells of ``2 * n`` zones inside the given ones."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], "content", 1 << 18):
                ends, columns = _key_columns(
                    cell_keys(line, finer_places(len(line), cells, n, most))
                    for line, cells in zip(part.column("content").to_pylist(), part.column("cells").to_pylist()))
                at = pa.array(np.repeat(np.arange(part.num_rows), np.diff(ends)))
                yield pa.RecordBatch.from_arrays([part.column("id").take(at), *columns],
                                                 names=["id", "key", "cell", "own"])

    return run


def _occurrences(min_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, ids = [], [], []
            for row, text in enumerate(as_bytes(batch.column("text"))):
                for number, line in lines_of(text, min_bytes):
                    rows.append(row), numbers.append(number), ids.append(line_id(line))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("did").take(at), batch.column("text_hash").take(at),
                 pa.array(numbers, pa.int32()), pa.array(ids, pa.int64())],
                names=["did", "text_hash", "line", "id"])

    return run


def _profile_distance(a: str, b: str) -> Column:
    """Sum over the classes of the differences modulo 16, never more than the
    sum of the true differences."""
    total = F.lit(0)
    for c in range(8):
        left = F.shiftright(F.col(a), 4 * c).bitwiseAND(F.lit(15))
        right = F.shiftright(F.col(b), 4 * c).bitwiseAND(F.lit(15))
        gap = F.abs(left - right)
        total = total + F.least(gap, F.lit(16) - gap)
    return total


def _fetch(most: int):
    """(id, content, profile, keys, did, text_hash, line, repeated) of the wanted lines of each document."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "packed", 1 << 18):
            rows, ids, contents, numbers, repeated = [], [], [], [], []
            for row, (packed, wanted) in enumerate(zip(batch.column("packed").to_pylist(),
                                                       batch.column("wanted").to_pylist())):
                lines = (unpacked(packed) or b"").split(b"\n")
                for w in wanted:
                    rows.append(row), ids.append(w["id"]), numbers.append(w["line"])
                    contents.append(lines[w["line"]].strip()), repeated.append(w["repeated"])
            at = pa.array(rows, pa.int64())
            ends, columns = _key_columns(cell_keys(line, first_places(len(line), most)) for line in contents)
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                columns, names=["key", "cell", "own"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(contents, pa.binary()),
                 pa.array(profiles(contents), pa.int64()), keys, batch.column("doc_id").take(at),
                 batch.column("text_hash").take(at), pa.array(numbers, pa.int32()), pa.array(repeated, pa.bool_())],
                names=["id", "content", "profile", "keys", "did", "text_hash", "line", "repeated"])

    return run


def _verify(most: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [edits(a, b, most) <= most for a, b in zip(batch.column("content_a").to_pylist(),
                                                              batch.column("content_b").to_pylist())]
            yield batch.select(["earlier", "later"]).filter(pa.array(near, pa.bool_()))

    return run


def _identified(docs: DataFrame, id_col: str, text_col: str, did: str = "did", text_hash: str = "text_hash"):
    return docs.withColumns({
        did: F.coalesce(F.col(id_col).cast("long"), F.lit(int(_NO_ID))),
        text_hash: F.xxhash64(F.col(text_col).cast("string"))})


PLACE = ("did", "text_hash", "line")


def _later(scratch: Scratch, pairs: DataFrame, lines: DataFrame, most: int, name: str) -> DataFrame:
    """(id) of the lines that are the later one of a pair (a, b) within ``most`` edits."""
    pairs = scratch.write(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                          f"{name}_pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    contents = scratch.write(lines.join(wanted, "id", "left_semi"), f"{name}_contents")
    place = F.struct(*PLACE)
    left = contents.select(F.col("id").alias("a"), F.col("content").alias("left"), place.alias("first_a"))
    right = contents.select(F.col("id").alias("b"), F.col("content").alias("right"), place.alias("first_b"))
    a_first = F.col("first_a") < F.col("first_b")
    links = pairs.join(left, "a").join(right, "b").select(
        F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("earlier"),
        F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("later"),
        F.col("left").alias("content_a"), F.col("right").alias("content_b"),
    ).mapInArrow(lean(_verify(most)), "earlier long, later long")
    later = scratch.write(links.select(F.col("later").alias("id")).distinct(), name)
    scratch.drop(f"{name}_pairs", f"{name}_contents")
    return later


def _close(most: int) -> Column:
    return ((F.col("id") != F.col("id_b")) & (F.abs(F.col("size") - F.col("size_b")) <= most)
            & (_profile_distance("profile", "profile_b") <= 2 * most))


def _members(scratch: Scratch, rows: DataFrame, name: str) -> DataFrame:
    """(key, cell, id) of the keys that several lines hold, one of them as its
    own. One shuffle of the rows serves both the count and the filter."""
    same = Window.partitionBy("key")
    return scratch.write(rows.withColumns({
        "n": F.count("*").over(same), "owned": F.max("own").over(same)}).where("n > 1 and owned").select(
            "key", "cell", "id"), f"{name}_members")


def _first_pairs(members: DataFrame, most: int) -> DataFrame:
    """Each line with the earliest and a random one of those that share a key
    (line ids are hashes, so the least is any)."""
    line = F.struct(F.col("id").alias("id_b"), F.col("profile").alias("profile_b"), F.col("size").alias("size_b"))
    chosen = members.groupBy("key").agg(F.min_by(line, F.struct(*PLACE)).alias("earliest"),
                                        F.min_by(line, "id").alias("any"))
    return members.join(chosen, "key").select("id", "profile", "size", F.inline(F.array("earliest", "any"))).where(
        _close(most)).select(F.col("id").alias("a"), F.col("id_b").alias("b"))


def _open_members(scratch: Scratch, members: DataFrame, settled: DataFrame, name: str) -> DataFrame:
    """The members of keys that hold open lines (not settled, and not the key's
    earliest, which none of its lines can settle): whether each is open, and
    whether the key is crowded with them."""
    marked = members.join(settled.withColumn("settled", F.lit(True)), "id", "left").withColumn(
        "open", F.col("settled").isNull()).drop("settled")
    is_open = F.col("open").cast("long")
    keys = scratch.write(marked.groupBy("key").agg(
        (F.sum(is_open) - F.min_by(is_open, F.struct(*PLACE))).alias("n")).where("n > 0").select(
        "key", (F.col("n") > CROWD).alias("crowded")), f"{name}_keys")
    return scratch.write(marked.join(keys, "key"), f"{name}_open")


def _all_pairs(members: DataFrame, most: int) -> DataFrame:
    """Each open line with all earlier ones that share a key, settled or not."""
    earlier = members.select("key", F.col("id").alias("id_b"), F.col("profile").alias("profile_b"),
                             F.col("size").alias("size_b"), F.struct(*PLACE).alias("place_b"))
    later = members.where("open").select("key", "id", "profile", "size", F.struct(*PLACE).alias("place"))
    return later.join(earlier, "key").where(_close(most) & (F.col("place_b") < F.col("place"))).select(
        F.col("id").alias("a"), F.col("id_b").alias("b"))


def _near_lines(scratch: Scratch, lines: DataFrame, most: int) -> DataFrame:
    """(id) of the lines within ``most`` edits of an earlier one."""
    n, found = most + 1, []
    members = _members(scratch, lines.select("id", F.inline("keys")), f"cells_{n}")
    ids = scratch.write(members.select("id").distinct(), "known_ids")
    known = scratch.write(lines.drop("keys", "repeated").hint("merge").join(ids, "id", "left_semi"), "known")
    facts = known.select("id", "profile", F.octet_length("content").alias("size"), *PLACE)
    while True:
        name = f"cells_{n}"
        members = scratch.write(members.join(facts, "id"), f"{name}_facts")
        found.append(_later(scratch, _first_pairs(members, most), known, most, f"{name}_settled"))
        left = _open_members(scratch, members, reduce(DataFrame.unionByName, found).distinct(), name)
        crowded = F.col("crowded") & F.lit(2 * n <= finest(most))
        found.append(_later(scratch, _all_pairs(left.where(~crowded), most), known, most, f"{name}_near"))
        cells = scratch.write(left.where(crowded).groupBy("id").agg(F.collect_set("cell").alias("cells")),
                              f"{name}_crowded")
        done = cells.isEmpty()
        if not done:
            rows = scratch.write(known.select("id", "content").join(cells, "id").mapInArrow(
                lean(_finer(n, most)), f"id: long, {KEYS}"), f"{name}_finer")
            members = _members(scratch, rows, f"cells_{2 * n}")
        scratch.drop(*(f"{name}_{x}" for x in ("members", "facts", "keys", "open", "crowded", "finer")))
        if done:
            break
        n *= 2
    near = scratch.write(reduce(DataFrame.unionByName, found).distinct(), "near")
    scratch.drop("known", "known_ids")
    return near


def repeated_lines(docs: DataFrame, most: int = MOST, min_bytes: int = MIN_BYTES, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """The lines that go, one row per document that has any: did (the id, null
    as the largest long), text_hash, exact and near (numbers of its lines)."""
    scratch = Scratch(docs.sparkSession, "lines")
    texts = _identified(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")),
                        "doc_id", "text")
    seen = scratch.write(texts.select("did", "text_hash", "text").mapInArrow(
        lean(_occurrences(min_bytes)), "did long, text_hash long, line int, id long"), "occurrences")
    place = F.struct(*PLACE)
    firsts = seen.groupBy("id").agg(F.min(place).alias("first"), (F.count("*") > 1).alias("repeated")).select(
        "id", "first.*", "repeated")
    by_doc = firsts.groupBy(F.col("did").alias("doc_id"), "text_hash").agg(
        F.collect_list(F.struct("id", "line", "repeated")).alias("wanted"))
    # rows that are one document (equal id and text) are read once
    packed = packed_texts(texts.select(F.col("did").alias("doc_id"), "text_hash", "text")).dropDuplicates(
        ["doc_id", "text_hash"])
    lines = scratch.write(packed.join(by_doc, ["doc_id", "text_hash"]).mapInArrow(
        lean(_fetch(most)), f"id long, content binary, profile long, keys array<struct<{KEYS}>>, "
        "did long, text_hash long, line int, repeated boolean"), "distinct")

    near = _near_lines(scratch, lines, most).withColumn("is_near", F.lit(True))

    # a line that occurs once and is near no other stays
    asked = scratch.write(lines.select("id", "repeated", place.alias("first")).join(near, "id", "left").where(
        "repeated or is_near").drop("repeated"), "asked")
    judged = seen.join(asked, "id").select(
        "did", "text_hash", "line", (place != F.col("first")).alias("again"),
        F.coalesce("is_near", F.lit(False)).alias("is_near"))
    decisions = scratch.write(judged.where("again or is_near").groupBy("did", "text_hash").agg(
        F.collect_set(F.when(F.col("again"), F.col("line"))).alias("exact"),
        F.collect_set(F.when(~F.col("again"), F.col("line"))).alias("near")), "decisions")
    scratch.drop("occurrences", "distinct", "near", "asked")
    return decisions


def _pack(text_name: str):
    """The text column compressed, for the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = [None if t is None else compressor.compress(t) for t in as_bytes(batch.column(text_name))]
            yield batch.set_column(batch.schema.get_field_index(text_name), text_name, pa.array(packed, pa.binary()))

    return run


def _cut(text_name: str, exact_name: str, near_name: str, keep: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_name):
            texts = []
            for packed, exact, near in zip(batch.column(text_name).to_pylist(), batch.column(exact_name).to_pylist(),
                                           batch.column(near_name).to_pylist()):
                text, gone = unpacked(packed), {*(exact or ()), *(near or ())}
                if gone:
                    lines = text.split(b"\n")
                    text = b"\n".join(line for i, line in enumerate(lines) if i not in gone)
                texts.append(text)
            at = batch.schema.get_field_index(text_name)
            out = batch.set_column(at, text_name, pa.array(texts, pa.binary()).cast(pa.string()))
            yield out.select(keep)

    return run


def without_repeated_lines(docs: DataFrame, most: int = MOST, min_bytes: int = MIN_BYTES, id_col: str = "doc_id",
                           text_col: str = "text") -> DataFrame:
    """``docs`` with all its rows and columns, and the repeated lines cut out
    of the texts.

    A null text stays null; one whose lines all go is empty. Ids are whole
    numbers; null ids come after all others. Rows of equal id and equal text
    are one document and are cut alike; rows of equal id and different texts are
    ordered by the texts' hashes. An empty table gives an empty one.
    """
    return _joined(docs, most, min_bytes, id_col, text_col)[0]


def _joined(docs: DataFrame, most: int, min_bytes: int, id_col: str, text_col: str,
            counts: bool = False) -> tuple[DataFrame, tuple[str, str]]:
    did, text_hash, exact, near = (free_name(docs, n) for n in ("did", "text_hash", "exact", "near"))
    decisions = repeated_lines(docs, most, min_bytes, id_col, text_col).select(
        F.col("did").alias(did), F.col("text_hash").alias(text_hash), F.col("exact").alias(exact),
        F.col("near").alias(near))
    rows = _identified(docs, id_col, text_col, did, text_hash)
    packed = StructType([StructField(f.name, BinaryType()) if f.name == text_col else f for f in rows.schema])
    joined = rows.mapInArrow(lean(_pack(text_col)), packed).join(decisions, [did, text_hash], "left").select(
        *docs.columns, exact, near)
    keep = [*docs.columns, exact, near] if counts else docs.columns
    schema = StructType([docs.schema[c] if c in docs.columns else joined.schema[c] for c in keep])
    return joined.mapInArrow(lean(_cut(text_col, exact, near, keep)), schema), (exact, near)


def line_dedup(docs: DataFrame, most: int = MOST, min_bytes: int = MIN_BYTES, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text without the repeated lines,
    n_exact and n_near, the lines cut as equal to or near an earlier one. The
    cases are those of ``without_repeated_lines``."""
    rows, (exact, near) = _joined(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")),
        most, min_bytes, "doc_id", "text", counts=True)

    def count(name: str) -> Column:
        return F.coalesce(F.size(name), F.lit(0)).cast("long")

    return rows.select("doc_id", "text", F.greatest(count(exact), F.lit(0)).alias("n_exact"),
                       F.greatest(count(near), F.lit(0)).alias("n_near"))
