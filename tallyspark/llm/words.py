"""Words and word shingles as 64-bit hashes, computed by numpy inside tasks.

A word is a run of bytes other than the six ASCII white-space bytes; lower case
is that of A-Z. Both are what ``bytes.split`` and ``bytes.lower`` do.
"""

from __future__ import annotations

import numpy as np
import xxhash

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # odd; 2^64 / golden ratio
_HALF = np.uint64(32)
_BLOCK = 1 << 20  # bytes hashed at a time

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_BYTE_VALUES = np.random.default_rng(2024).integers(0, 1 << 64, 256, np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, made once."""

    up: np.ndarray | None = None
    down: np.ndarray | None = None

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls.up is None or len(cls.up) < n:
            base = 0xD1342543DE82EF95
            cls.up, cls.down = _powers(base, n), _powers(pow(base, -1, 1 << 64), n)
        return cls.up, cls.down


def hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, hash) of every word of ``data`` (bytes). A word's hash
    is a polynomial of random values of its bytes, taken from prefix sums."""
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + _BLOCK)
        if end < len(data):  # cut at the last white space, or after a word of more than a block
            spaces = np.flatnonzero(_IS_SPACE[data[at:end]])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
            else:
                later = np.flatnonzero(_IS_SPACE[data[end:]])
                end = end + int(later[0]) if len(later) else len(data)
        parts.append(_hash_block(data[at:end], at))
        at = end
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(columns) for columns in zip(*parts))


def _hash_block(data: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edges = np.diff(_IS_SPACE[data].view(np.int8), prepend=np.int8(1), append=np.int8(1))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    up, down = _Powers.of(max(len(data), _BLOCK))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[:len(data)], out=sums[1:])
    lengths = ends - starts
    hashes = (sums[ends] - sums[starts]) * down[starts]
    hashes ^= lengths.astype(np.uint64) * _MULTIPLIER
    hashes ^= hashes >> _HALF
    hashes *= _MULTIPLIER
    hashes ^= hashes >> _HALF
    return starts + at, lengths, hashes


def words_by_text(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, lengths) of the lower-case words of each text, hashed together."""
    joined = b"\n".join(texts).lower()
    starts, lengths, hashes = hash_words(np.frombuffer(joined, np.uint8))
    ends = np.cumsum([len(t) + 1 for t in texts])
    cuts = np.searchsorted(starts, ends).tolist()
    return [(hashes[a:b], lengths[a:b]) for a, b in zip([0, *cuts], cuts)]


class WordHashes(dict):
    """Hash of each word, remembered for up to ``limit`` words; for callers
    that need the words themselves too. (Not the hash of ``hash_words``.)"""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.limit:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words, in order; of the whole sequence, as
    one, when there are fewer; none without words."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(k, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out ^= hashes[i:n - k + 1 + i]
        out *= _MULTIPLIER
        out ^= out >> _HALF
    return out


def as_longs(hashes: np.ndarray) -> np.ndarray:
    """The same bits as signed 64-bit numbers, Spark's long."""
    return hashes.astype(np.uint64, copy=False).view(np.int64)
