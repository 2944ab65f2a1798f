"""SentencePiece encoding and decoding for merge-type vocabularies (operator 13).

A normalised text starts as single characters. An agenda holds every adjacent
pair of symbols that together form a piece, best score first and leftmost among
equals; the best pair is joined, its two new neighbour pairs enter the agenda,
and entries whose symbols have changed are passed over. What is no piece in the
end is spelt in byte pieces.

A join never crosses a place where no piece has these two characters side by
side, so a text is cut there into runs that are encoded on their own. The runs
of an Arrow batch are found by numpy and reduced to the distinct ones; short
runs of equal length are encoded side by side, each with its agenda as a row of
a matrix of ranks, and longer ones with a heap. They are then encoded by the
sentencepiece library too; decoding is the library's, held against the texts.
A difference ends the job. A task remembers runs that it has encoded.

The scan is one map step without a shuffle. Its memory is that of a slice of
8 MB or of one document, and some 500 bytes for each character of a run, which
is long only where a text has neither spaces nor marks.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tallyspark.llm.common import as_bytes, id_and_text, slices

MARK = "▁"  # stands for a space
SHORT = 48  # characters of a run that is encoded beside others of its length
BLOCK = 1 << 20  # characters encoded side by side
SLICE = 8 << 20  # bytes of text whose runs are looked at together
CHECKED = 1000  # runs to a text that the library encodes
REMEMBERED = 64 << 20  # bytes of runs and ids that a task remembers

# Fixed values of the model file: types of pieces, and the type of a vocabulary made of merges.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2

_DDL = "ids array<int>, decoded string"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at:at + size], at + size
        yield key >> 3, value


class Vocabulary:
    """What a model file says about its pieces and its normalisation."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            model = list(_fields(file.read()))
        trainer = dict(v for n, value in model if n == 2 for v in _fields(value))
        normaliser = dict(v for n, value in model if n == 3 for v in _fields(value))
        if trainer.get(3, 1) != MERGES:
            raise ValueError(f"{path} is no vocabulary of merges")
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1) or trainer.get(24, 0):
            raise ValueError(f"{path} changes characters, removes spaces or marks the ends of words")
        self.prefix = MARK if normaliser.get(3, 1) else ""
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores = []
        for number, value in model:
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
        if USER_DEFINED in self.kinds or UNUSED in self.kinds or self.kinds.count(BYTE) != 256:
            raise ValueError(f"{path} has user-defined or unused pieces, or lacks byte pieces")
        normal = [i for i, kind in enumerate(self.kinds) if kind == NORMAL]
        self.ids = {self.pieces[i]: i for i in normal}
        place = {score: n for n, score in enumerate(sorted({scores[i] for i in normal}, reverse=True))}
        # of each piece of two characters or more: 0 for the best score; equal scores share a rank
        self.ranks = {self.pieces[i]: place[scores[i]] for i in normal if len(self.pieces[i]) > 1}
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i, kind in enumerate(self.kinds) if kind == BYTE}



class Joins:
    """Which symbols join into which. Symbols are pieces by their ids, and
    behind them the characters of pieces that are no pieces themselves."""

    def __init__(self, vocabulary: Vocabulary):
        letters = sorted({c for p in vocabulary.ranks for c in p})
        symbol = dict(vocabulary.ids)
        for c in letters:
            symbol.setdefault(c, len(vocabulary.pieces) + len(symbol))
        self.none = len(vocabulary.pieces)  # above every rank
        self.width = max(symbol.values(), default=0) + 1
        joins = [(symbol[p[:i]] * self.width + symbol[p[i:]], rank, symbol[p])
                 for p, rank in vocabulary.ranks.items() for i in range(1, len(p))
                 if p[:i] in symbol and p[i:] in symbol]
        table = np.array(sorted(joins), np.int64).reshape(-1, 3)
        self.pairs = np.append(table[:, 0], np.iinfo(np.int64).max)
        self.ranks = np.append(table[:, 1], self.none).astype(np.int32)
        self.results = np.append(table[:, 2], -1).astype(np.int32)
        # of code points: their symbol, and their class (0: in no piece of two characters or more)
        self.symbols = np.full(0x110000, -1, np.int32)
        self.classes = np.zeros(0x110000, np.int16)
        for piece, number in symbol.items():
            if len(piece) == 1:
                self.symbols[ord(piece)] = number
        for n, c in enumerate(letters, 1):
            self.classes[ord(c)] = n
        self.beside = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for piece in vocabulary.ranks:
            for x, y in zip(piece, piece[1:]):
                self.beside[self.classes[ord(x)], self.classes[ord(y)]] = True

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Row of each pair of symbols in the table; the last row if it is none."""
        pairs = left.astype(np.int64) * self.width + right
        rows = np.searchsorted(self.pairs, pairs)
        return np.where(self.pairs[rows] == pairs, rows, len(self.pairs) - 1)

    def join(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of each row of ``runs`` (code points) after all joins, one row
        behind the other, and their number in each row. In every round each
        unfinished row joins its best pair, the leftmost of equals."""
        n, length = runs.shape
        symbols = self.symbols[runs].ravel()
        agenda = np.full((n, length), self.none, np.int32)
        rows = np.full((n, length), len(self.pairs) - 1, np.int64)
        table = symbols.reshape(n, length)
        rows[:, :-1] = self.find(table[:, :-1], table[:, 1:])
        agenda[:] = self.ranks[rows]
        rows, ranks = rows.ravel(), agenda.ravel()
        place = np.tile(np.arange(length, dtype=np.int32), n)
        after, before = place + 1, place - 1
        alive = np.ones(n * length, bool)
        open_rows = np.arange(n)
        while len(open_rows):
            best = agenda[open_rows].argmin(axis=1)
            first = open_rows * length
            left = first + best
            going = ranks[left] < self.none
            open_rows, first, left = open_rows[going], first[going], left[going]
            right = first + after[left]
            symbols[left] = self.results[rows[left]]
            alive[right] = False
            ranks[right] = self.none
            after[left] = after[right]
            # the pair with the symbol that follows, if there is one
            follows = after[left] < length
            ranks[left[~follows]] = self.none
            x, y = left[follows], first[follows] + after[left[follows]]
            before[y] = x - first[follows]
            rows[x] = self.find(symbols[x], symbols[y])
            ranks[x] = self.ranks[rows[x]]
            # the pair with the symbol before
            leads = before[left] >= 0
            x, y = first[leads] + before[left[leads]], left[leads]
            rows[x] = self.find(symbols[x], symbols[y])
            ranks[x] = self.ranks[rows[x]]
        return symbols[alive], alive.reshape(n, length).sum(axis=1)


def _starts(counts: np.ndarray) -> np.ndarray:
    """0 and the running sums of counts."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(_starts(counts).astype(np.int32)), pa.array(values, pa.int32()))


def _joined(texts: pa.StringArray, counts: np.ndarray, between: str) -> pa.StringArray:
    """Texts put together, so many at a time."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(_starts(counts).astype(np.int32)), texts), between)


def _sha256(texts: list[bytes]) -> pa.StringArray:
    return pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())


class Codec:
    """Encodes and decodes texts; one to a task."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.vocabulary = Vocabulary(path)
        self.joins = Joins(self.vocabulary)
        self.library = SentencePieceProcessor(model_file=path)
        # runs are looked up between line ends, if no piece joins over these; else a text is one run
        line_end = self.joins.classes[10]
        self.cuts = not self.joins.beside[line_end].any() and not self.joins.beside[:, line_end].any()
        self.known_runs = pa.array([], pa.string())
        self.known_codes = pa.array([], pa.list_(pa.int32()))
        self.decimals = pa.array([str(i) for i in range(len(self.vocabulary.pieces))], pa.string())

    def runs(self, texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The runs of normalised texts, and where each text's runs begin (and
        the last one's end)."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        edge = np.zeros(len(points) + 1, bool)
        if self.cuts and len(points):
            kinds = self.joins.classes[points]
            np.logical_not(self.joins.beside[kinds[:-1], kinds[1:]], out=edge[1:-1])
        edge[0] = True
        edge[ends] = True
        edges = np.flatnonzero(edge)
        raw = joined.encode()
        first_bytes = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80  # of characters
        at = np.append(np.flatnonzero(first_bytes), len(raw))[edges]
        runs = pa.StringArray.from_buffers(len(edges) - 1, pa.array(at.astype(np.int32)).buffers()[1],
                                           pa.py_buffer(raw))
        return runs.dictionary_encode(), np.searchsorted(edges, np.concatenate([[0], ends]))

    def join_heap(self, text: str) -> list[str]:
        """Symbols of a long run, with the agenda as a heap."""
        rank_of, n = self.vocabulary.ranks.get, len(text)
        symbols: list[str | None] = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # an entry is the rank of a pair's piece and the place of its left symbol, as one number
        agenda = [(rank << 40) | i for i in range(n - 1)
                  if (rank := rank_of(text[i:i + 2])) is not None]
        heapify(agenda)
        place = (1 << 40) - 1
        while agenda:
            entry = heappop(agenda)
            left = entry & place
            symbol = symbols[left]
            if symbol is None or (right := after[left]) >= n:
                continue
            piece = symbol + symbols[right]
            if rank_of(piece) != entry >> 40:
                continue  # one of the two has been joined with another since
            symbols[left], symbols[right] = piece, None
            after[left] = follower = after[right]
            if follower < n:
                before[follower] = left
                if (rank := rank_of(piece + symbols[follower])) is not None:
                    heappush(agenda, (rank << 40) | left)
            if left and (rank := rank_of(symbols[leader := before[left]] + piece)) is not None:
                heappush(agenda, (rank << 40) | leader)
        return [symbol for symbol in symbols if symbol is not None]

    def spell(self, symbols: list[str]) -> list[int]:
        """Ids of symbols, in byte pieces where they are no pieces."""
        ids, spelt = self.vocabulary.ids, self.vocabulary.bytes
        return [i for s in symbols for i in ([ids[s]] if s in ids else [spelt[b] for b in s.encode()])]

    def encode_runs(self, runs: pa.StringArray) -> pa.ListArray:
        """Ids of each run."""
        lengths = pc.utf8_length(runs).to_numpy(zero_copy_only=False)
        parts, order = [], []
        for length in np.unique(lengths).tolist():
            chosen = np.flatnonzero(lengths == length)
            step = max(1, BLOCK // max(length, 1)) if length <= SHORT else 1
            for at in range(0, len(chosen), step):
                places = chosen[at:at + step]
                if length > SHORT:
                    ids = np.array(self.spell(self.join_heap(runs[int(places[0])].as_py())), np.int32)
                    counts = np.array([len(ids)])
                else:
                    text = _joined(runs.take(pa.array(places)), np.array([len(places)]), "")[0].as_py()
                    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(places), length)
                    ids, counts = self.joins.join(points)
                    if len(ids) and (ids.min() < 0 or ids.max() >= self.joins.none):
                        ids, counts = self._spelt(points, ids, counts)
                parts.append(_lists(ids, counts))
                order.append(places)
        if not parts:
            return pa.array([], pa.list_(pa.int32()))
        back = np.empty(len(lengths), np.int64)
        back[np.concatenate(order)] = np.arange(len(lengths))
        return pa.concat_arrays(parts).take(pa.array(back))

    def _spelt(self, points: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with the characters that are no pieces in byte pieces."""
        at = _starts(counts)
        out = []
        for row, (a, b) in enumerate(zip(at, at[1:])):
            own = ids[a:b]
            if own.min() < 0 or own.max() >= self.joins.none:
                own = self.spell(self.join_heap("".join(map(chr, points[row].tolist()))))
            out.append(np.asarray(own, np.int32))
        return np.concatenate(out), np.array([len(o) for o in out])

    def check(self, runs: pa.StringArray, ids: pa.ListArray) -> None:
        """Holds the ids of runs against the library's: of many runs in one text,
        a line end before each, or of each text, where texts are not cut."""
        flat, at = ids.flatten().to_numpy(), ids.offsets.to_numpy()
        if not self.cuts:
            texts = [r[len(self.vocabulary.prefix):].replace(MARK, " ") for r in runs.to_pylist()]
            own = [flat[a:b] for a, b in zip(at, at[1:])]
        else:
            lead = self.library.encode("\n")
            starts = list(range(0, len(runs), CHECKED))
            joined = _joined(runs, np.diff([*starts, len(runs)]), "\n").to_pylist()
            texts = ["\n" + text.replace(MARK, " ") for text in joined]
            own = []
            for i in starts:
                cut = at[i:i + CHECKED + 1]
                own.append(np.concatenate([lead[:-1], np.insert(flat[cut[0]:cut[-1]], cut[:-1] - cut[0], lead[-1])]))
        for text, mine, found in zip(texts, own, self.library.encode(texts, num_threads=1) if texts else ()):
            if not np.array_equal(mine, found):
                raise ValueError(f"the library encodes otherwise: {text[:500]!r}")

    def codes(self, runs: pa.StringArray) -> pa.ListArray:
        """Ids of distinct runs, remembered, or else encoded and checked."""
        found = pc.index_in(runs, value_set=self.known_runs)
        new = runs.filter(found.is_null())
        new_codes = self.encode_runs(new)
        self.check(new, new_codes)
        place = found.fill_null(-1).to_numpy(zero_copy_only=False)
        place = np.where(place < 0, len(self.known_runs) - 1 + np.cumsum(place < 0), place)
        all_codes = pa.concat_arrays([self.known_codes, new_codes])
        codes = all_codes.take(pa.array(place))
        if self.known_runs.nbytes + new.nbytes + all_codes.nbytes <= REMEMBERED:
            self.known_runs, self.known_codes = pa.concat_arrays([self.known_runs, new]), all_codes
        elif runs.nbytes + codes.nbytes <= REMEMBERED:
            self.known_runs, self.known_codes = runs, codes
        return codes

    def encode(self, texts: list[str | None]) -> tuple[pa.ListArray, pa.StringArray]:
        """Ids of whole texts, as lists and as decimals with commas; none for
        null and for the empty text."""
        prefix = self.vocabulary.prefix
        runs, first = self.runs([prefix + t.replace(" ", MARK) if t else "" for t in texts])
        codes = self.codes(runs.dictionary)
        decimals = pc.binary_join(pa.ListArray.from_arrays(codes.offsets, self.decimals.take(codes.flatten())), ",")
        ids = codes.take(runs.indices)
        lists = pa.ListArray.from_arrays(pa.array(ids.offsets.to_numpy()[first]), ids.flatten())
        return lists, pc.binary_join(
            pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), decimals.take(runs.indices)), ",")

    def decode(self, texts: list[str | None], ids: pa.ListArray) -> list[str]:
        """What the library's ``decode`` makes of the ids of ``texts``. Their
        pieces spell the normalised texts, so nothing but marks may differ."""
        flat, at = ids.flatten().to_numpy().tolist(), ids.offsets.to_pylist()
        decoded = self.library.decode([flat[a:b] for a, b in zip(at, at[1:])]) if texts else []
        for text, found in zip(texts, decoded):
            if found != (text or "") and found != text.replace(MARK, " "):
                raise ValueError(f"the library decodes {text[:200]!r} otherwise")
        return decoded


def _map(docs: DataFrame, path: str, ddl: str, columns):
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            for part in slices([batch], "text", SLICE):
                texts = part.column("text").to_pylist()
                ids, decimals = codec.encode(texts)
                out = columns(texts, ids, decimals, codec.decode(texts, ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *out.values()], names=["doc_id", *out])

    return docs.mapInArrow(scan, f"doc_id {id_type}, {ddl}")


def piece_codes(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids, decoded.

    ``path`` names a model file that every worker can open. Null and empty
    texts have no ids and decode to the empty text. Repeated rows and null ids
    give a row each; an empty table gives an empty result. Other columns of
    ``docs`` are not read. Ids of begin and end are not added.
    """

    def columns(texts, ids, decimals, decoded):
        return {"ids": ids, "decoded": pa.array(decoded, pa.string())}

    return _map(id_and_text(docs, id_col, text_col), path, _DDL, columns)


def piece_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``piece_codes``, with counts and digests in place of ids and texts,
    and whether the decoded text is the text itself (a text with a word mark of
    its own is not; null counts as empty)."""

    def columns(texts, ids, decimals, decoded):
        return {
            "n_tokens": pc.list_value_length(ids).cast(pa.int64()),
            "ids_sha256": _sha256(as_bytes(decimals)),
            "decoded_sha256": _sha256([d.encode() for d in decoded]),
            "round_trip": pa.array([d == (t or "") for t, d in zip(texts, decoded)], pa.bool_()),
        }

    return _map(id_and_text(docs, id_col, text_col), path,
                "n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean", columns)
