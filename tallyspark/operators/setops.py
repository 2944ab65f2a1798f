"""Key and row set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import KEYS


def _keys(df: DataFrame, keys=KEYS) -> DataFrame:
    return df.select(*[F.col(f"`{k}`") for k in keys])


def key_intersect(a: DataFrame, b: DataFrame, keys=KEYS) -> DataFrame:
    """Distinct keys on both sides (null-safe, like set intersection)."""
    return _keys(a, keys).intersect(_keys(b, keys))


def key_except(a: DataFrame, b: DataFrame, keys=KEYS) -> DataFrame:
    """Distinct keys of ``a`` absent from ``b``."""
    return _keys(a, keys).subtract(_keys(b, keys))


def key_set_equal(a: DataFrame, b: DataFrame, keys=KEYS) -> DataFrame:
    """One row, true when both distinct key sets are equal."""
    ka, kb = _keys(a, keys).distinct(), _keys(b, keys).distinct()
    inter = ka.intersect(kb)
    na, nb, ni = (x.agg(F.count(F.lit(1))).scalar() for x in (ka, kb, inter))
    return ka.sparkSession.range(1).select((na == nb) & (na == ni)).toDF("key_sets_equal")


def rows_equal(a: DataFrame, b: DataFrame, cols) -> DataFrame:
    """Multiset equality of rows over ``cols``, order-free and null-safe.

    One aggregate: every distinct row gets +1 per occurrence in ``a`` and -1
    per occurrence in ``b``; the multisets are equal iff no row is left with
    a non-zero balance. No sort, and equal rows pre-aggregate map-side.
    """
    sel = [F.col(f"`{c}`") for c in cols]
    both = (a.select(*sel, F.lit(1).alias("__s")).unionByName(b.select(*sel, F.lit(-1).alias("__s"))))
    bal = both.groupBy(*sel).agg(F.sum("__s").alias("__b"))
    return bal.agg((F.count_if(F.col("__b") != 0) == 0).alias("rows_equal"))


def pile_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by column name; a column missing on one side is null there."""
    return a.unionByName(b, allowMissingColumns=True)


def pile_totals(pile: DataFrame, label: str, keys=KEYS) -> DataFrame:
    """A4 + A21: rows and distinct keys of a pile (struct form counts null keys)."""
    return pile.agg(F.lit(label).alias("pile"), F.count(F.lit(1)).alias("n_rows"),
                    F.count_distinct(F.struct(*[F.col(f"`{k}`") for k in keys])).alias("n_keys"))
