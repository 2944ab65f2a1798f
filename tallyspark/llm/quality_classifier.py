"""Quality classifier on random Fourier features (operator 3).

A document is a short vector of statistics of its text. Random cosine features
of the standardised vector approximate a Gaussian kernel, so a linear ridge
regression on them is a kernel machine whose training state does not grow with
the data: every task sums its part of the normal equations, the parts are
added, and one small system is solved. The raw scores become probabilities by
isotonic regression on labelled rows that the fit has not seen.

The vectors are computed once, in one map step over the whole texts, and
written; texts are never shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import Scratch, as_bytes, id_and_text

FEATURES = 256  # random features
WIDTH = 3.0  # of the kernel, in standard deviations
RIDGE = 1e-3  # per training row
MOST_TRAINING_ROWS = 500_000  # labelled rows that are fitted, a sample by hash beyond it
BINS = 1000  # of the raw score, for the calibration
SLIVER = 0.002  # share of the raw score in a score
BLOCKS = 16  # of rows of the normal equations
FOLDS = 5  # fold 0 is held out, fold 1 calibrates, the others fit

_SYMBOLS = b"#*$%&|<>"
_STOPS = b"!?"
_POINTS = b".,;:"
_DIGITS = b"0123456789"
_UPPER = bytes(range(65, 91))
_HIGH = bytes(range(128, 256))

NAMES = (
    "log_bytes", "log_words", "word_bytes", "distinct_words", "repeated_neighbours", "top_word", "symbols",
    "stops", "points", "digits", "upper", "high", "log_line_words", "distinct_lines", "ratio", "symbol_words",
    "upper_words",
)


def statistics(text: bytes | None, compressor: zstandard.ZstdCompressor) -> list[float]:
    """The vector of a text; of an empty one, zeros."""
    text = text or b""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(NAMES)

    def share(of: bytes) -> float:
        return 1 - len(text.translate(None, of)) / size

    counts = Counter(words)  # of the whole text
    lines = [line for line in text.split(b"\n") if line.strip()]
    letters = sum(map(len, words))
    return [
        math.log1p(size), math.log1p(n), letters / n, math.log(len(counts)) / math.log(n) if n > 1 else 1.0,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        max(counts.values()) / n,
        share(_SYMBOLS), share(_STOPS), share(_POINTS), share(_DIGITS), share(_UPPER), share(_HIGH),
        math.log1p(n / len(lines)), len(set(lines)) / len(lines), len(compressor.compress(text)) / size,
        sum(k for w, k in counts.items() if not w.isalpha() and len(w.translate(None, _SYMBOLS)) < len(w)) / n,
        sum(k for w, k in counts.items() if w.isupper()) / n,
    ]


def _vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compressor = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        values = [statistics(t, compressor) for t in as_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.list_(pa.float64()))],
                                         names=["doc_id", "x"])


def vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the vector ``x`` of each row."""
    rows = id_and_text(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_vectors, f"doc_id {id_type}, x array<double>")


def fold(doc_id: Column) -> Column:
    """Fold of an id: crc32 of its text, of no text for null, modulo FOLDS."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


@dataclass
class Model:
    """Standardisation, random features, weights and calibration."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    probability: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        z = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw_scores(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; a sliver of the raw score keeps the order within
        stretches that the calibration maps to one value."""
        raw = self.raw_scores(x)
        return (1 - SLIVER) * np.interp(raw, self.raw, self.probability) + SLIVER * np.clip((raw + 0.5) / 2, 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(NAMES))


def _normal_equations(model: Model):
    """A task's part: FEATURES + 1 rows of ZtZ with Zty behind, in blocks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = FEATURES + 1
        total = np.zeros((n, n + 1))
        for batch in batches:
            if batch.num_rows:
                z = model.features(_matrix(batch.column("x")))
                y = batch.column("label").to_numpy()
                total[:, :n] += z.T @ z
                total[:, n] += z.T @ y
        parts = np.array_split(total, BLOCKS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(BLOCKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
            names=["block", "part"])

    return run


def _add(frame: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(p) for p in frame["part"])
    return pd.DataFrame({"block": [frame["block"].iat[0]], "part": [total.tobytes()]})


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators: mean place and mean value of each block of
    the increasing function nearest to ``y`` with weights ``n``."""
    blocks: list[list[float]] = []  # [weight, sum of y, sum of x]
    for a, b, w in zip(x, y, n):
        blocks.append([w, b * w, a * w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    weight, total, place = np.array(blocks).T
    return place / weight, total / weight


def fit(points: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
        seed: int = 5) -> Model:
    """Learns from the labelled rows of the folds 1 and up. ``points`` are all
    rows of ``vectors``; their means and deviations standardise."""
    rows = points.agg(*[f(F.col("x")[i]).alias(f"{k}{i}") for i in range(len(NAMES))
                        for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([rows[f"m{i}"] or 0.0 for i in range(len(NAMES))])
    scale = np.array([rows[f"s{i}"] or 1.0 for i in range(len(NAMES))])
    rng = np.random.default_rng(seed)
    n = FEATURES + 1
    model = Model(mean, scale, rng.normal(size=(len(NAMES), FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES),
                  np.zeros(n), np.array([0.0, 1.0]), np.array([0.5, 0.5]))

    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("label")).where(
        F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    known = known.withColumn("fold", fold(F.col("doc_id"))).where("fold <> 0")
    count = known.count()
    if count > MOST_TRAINING_ROWS:
        share = int(MOST_TRAINING_ROWS / count * (1 << 30))
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    scratch = Scratch(points.sparkSession, "classifier")
    known = scratch.write(points.join(known, "doc_id").select("x", "label", "fold"), "labelled")

    parts = known.where("fold <> 1").select("x", "label").mapInArrow(_normal_equations(model), "block int, part binary")
    blocks = parts.groupBy("block").applyInPandas(_add, "block int, part binary").orderBy("block").collect()
    if blocks:
        total = np.concatenate([np.frombuffer(b["part"]) for b in blocks]).reshape(n, n + 1)
        if total[-1, n - 1]:  # rows
            system = total[:, :n] + RIDGE * total[-1, n - 1] * np.diag([*[1.0] * FEATURES, 0.0])
            model.weights = np.linalg.lstsq(system, total[:, n], rcond=None)[0]

    def raw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.raw_scores(_matrix(batch.column("x")))
            place = np.clip(((score + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(score), batch.column("label")],
                                             names=["bin", "score", "label"])

    def bins(rows: DataFrame) -> pd.DataFrame:
        return rows.select("x", "label").mapInArrow(raw, "bin long, score double, label double").groupBy("bin").agg(
            F.avg("score").alias("x"), F.avg("label").alias("y"), F.count("*").alias("n")).toPandas().sort_values("x")

    table = bins(known.where("fold = 1"))
    if table.empty:  # too few labels to keep a fold apart
        table = bins(known)
    if len(table):
        model.raw, model.probability = isotonic(*(table[c].to_numpy(float) for c in ("x", "y", "n")))
    return model


def score(points: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``vectors``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"))
            values = np.clip(model.scores(x), 0, 1) if len(x) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.float64())],
                                             names=["doc_id", "score"])

    id_type = points.schema["doc_id"].dataType.simpleString()
    return points.mapInArrow(run, f"doc_id {id_type}, score double").select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
                   text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null, empty and blank texts have the vector of zeros and a score like any
    other. Labels without an id or a value, or of unknown documents, are not
    used; repeated ones count each. Without any label every score is 0.5. A
    null id is in the held-out fold. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    points = scratch.write(vectors(docs, id_col, text_col), "points")
    return score(points, fit(points, labels, label_col, id_col), threshold)
