"""Quality rules with compression bands (operator 10).

Natural text compresses within a narrow band that depends on its length.
Text far below the band repeats itself; text far above it is noise, such as
encoded binary. The ratio of compressed to plain bytes is taken over the whole
document and over fixed chunks of it, each against the limits for its length.

The scan is one map step: no shuffle, and one document in memory at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tallyspark.llm.common import SPACES, as_bytes, id_and_text, lean

# (from so many bytes on, least ratio, greatest ratio). Short texts compress
# badly because of the frame's overhead, hence no upper limit for them.
BANDS = (
    (0, 0.30, None),
    (256, 0.30, 0.95),
    (512, 0.30, 0.85),
    (1024, 0.28, 0.72),
    (4096, 0.26, 0.66),
    (16384, 0.24, 0.62),
    (65536, 0.22, 0.60),
)
CHUNK_BYTES = 4096
LEVEL = 3
# A document goes when chunks outside their band hold this share of its bytes.
BAD_SHARE = 0.25
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SYMBOLS = b"#*$%&|<>"
_NOT_WORD_STARTS = SPACES + bytes(range(0x80, 0xC0))  # spaces and UTF-8 continuation bytes

_FIELDS = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()),
    ("kept", pa.bool_()), ("ratio", pa.float64()), ("n_chunks", pa.int64()),
    ("n_bad_chunks", pa.int64()), ("reason", pa.string()),
]
_DDL = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long, reason string")


def repeat_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that occurs twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, covered_to = 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            total += i + 3 - max(i, covered_to)
            covered_to = i + 3
    return total


def band(n_bytes: int, bands: tuple = BANDS) -> tuple[float, float | None]:
    """The limits for a text of ``n_bytes`` bytes."""
    return next((low, high) for least, low, high in reversed(bands) if n_bytes >= least)


def outside(n_bytes: int, ratio: float, bands: tuple = BANDS) -> str | None:
    low, high = band(n_bytes, bands)
    return "repetitive" if ratio < low else "incompressible" if high is not None and ratio > high else None


def measure(text: bytes | None, compressor: zstandard.ZstdCompressor, bands: tuple = BANDS,
            chunk_bytes: int = CHUNK_BYTES) -> tuple:
    """All measures of one document, in the order of the result's columns."""
    text = text or b""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    n_repeat = repeat_words(words)
    base_failed = len(words) < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * len(words)
    ratio, n_chunks, n_bad, bad_bytes, reason = None, 0, 0, 0, "base" if base_failed else None
    if text:
        ratio = len(compressor.compress(text)) / len(text)
        whole = outside(len(text), ratio, bands)
        if len(text) > chunk_bytes:
            for start in range(0, len(text), chunk_bytes):
                chunk = text[start:start + chunk_bytes]
                n_chunks += 1
                if outside(len(chunk), len(compressor.compress(chunk)) / len(chunk), bands):
                    n_bad += 1
                    bad_bytes += len(chunk)
        reason = reason or whole or ("chunks" if bad_bytes >= BAD_SHARE * len(text) else None)
    return (len(words), len(text.translate(None, _NOT_WORD_STARTS)),
            len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)),
            n_repeat, base_failed, reason is None, ratio, n_chunks, n_bad, reason)


def _scan(bands: tuple, chunk_bytes: int, level: int):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            rows = [measure(t, compressor, bands, chunk_bytes) for t in as_bytes(batch.column("text"))]
            columns = list(zip(*rows)) if rows else [[] for _ in _FIELDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS))],
                names=["doc_id", *(n for n, _ in _FIELDS)])

    return scan


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: tuple = BANDS,
                  chunk_bytes: int = CHUNK_BYTES, level: int = LEVEL) -> DataFrame:
    """One row per row of ``docs``: its counts, ratios and verdict.

    A null or empty text has no words, a null ratio, and fails the base rules.
    Repeated rows and repeated or null ids are judged row by row. Other columns
    of ``docs``, whatever their names, are not read. An empty table gives an
    empty result. ``reason`` names the first rule that a text fails: ``base``,
    ``repetitive``, ``incompressible`` or ``chunks``.
    """
    rows = id_and_text(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(_scan(bands, chunk_bytes, level)), f"doc_id {id_type}, {_DDL}")


def keep_good(docs: DataFrame, text_col: str = "text", bands: tuple = BANDS,
              chunk_bytes: int = CHUNK_BYTES, level: int = LEVEL) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            texts = as_bytes(batch.column(text_col))
            yield batch.filter(pa.array([measure(t, compressor, bands, chunk_bytes)[6] for t in texts], pa.bool_()))

    return docs.mapInArrow(lean(keep), docs.schema)
