"""Matching the piles and the unmatched remainders.

Keys are compared as text. ``match`` is a many-to-many inner equi-join:
two debts on one key and one credit give two rows. Orphans come from an
anti-join of one pile against the *distinct* keys of the other, so the
match itself is never materialized to find them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import AMT, KEYS, safe_pct
from tallyspark.operators.money import money_sum
from tallyspark.session import cut_lineage


def _q(c: str) -> str:
    return f"`{c}`"


def _suffix(df: DataFrame, keys, suffix: str, other_cols) -> DataFrame:
    """Suffix the non-key columns that also exist on the other side (Q30)."""
    return df.select(*[F.col(_q(c)).alias(f"{c}{suffix}") if (c not in keys and c in other_cols)
                       else F.col(_q(c)) for c in df.columns])


def _key_cond(left: DataFrame, right: DataFrame, keys, null_safe: bool):
    conds = [(left[_q(k)].eqNullSafe(right[_q(k)]) if null_safe else left[_q(k)] == right[_q(k)])
             for k in keys]
    return reduce(lambda a, b: a & b, conds)


HOT_PAIRS = 1 << 20  # pairs of one key that one task makes, about
MOST_COPIES = 64     # of a row of such a key; beyond, its tasks make more pairs


def _hot_keys(debt: DataFrame, credit: DataFrame, keys, pairs: int) -> DataFrame:
    """(keys as ``__h_*``, __d_parts, __c_parts): keys with more than ``pairs`` pairs
    of rows, and into how many parts their debt and credit rows are dealt. Null
    equals null. Parts are about equally large, so that fewest copies are made."""
    def counts(df, name, prefix):
        return df.groupBy(*[F.col(_q(k)).alias(f"{prefix}{k}") for k in keys]).agg(
            F.count(F.lit(1)).cast("double").alias(name)).where(F.col(name) > 1)

    nd, nc = counts(debt, "__nd", "__h_"), counts(credit, "__nc", "__c_")
    cond = reduce(lambda a, b: a & b, [nd[_q(f"__h_{k}")].eqNullSafe(nc[_q(f"__c_{k}")]) for k in keys])
    cells = F.col("__nd") * F.col("__nc") / F.lit(pairs)
    most = F.lit(float(MOST_COPIES))
    d_parts = F.least(F.ceil(F.sqrt(cells * F.col("__nd") / F.col("__nc"))), F.col("__nd"), F.ceil(cells), most)
    c_parts = F.least(F.ceil(cells / F.col("__d_parts")), F.col("__nc"), most)
    return nd.join(nc, cond).where(cells > 1).withColumn("__d_parts", d_parts).select(
        *[F.col(_q(f"__h_{k}")) for k in keys], F.col("__d_parts").cast("long").alias("__d_parts"),
        c_parts.cast("long").alias("__c_parts"))


def _dealt_sides(d: DataFrame, c: DataFrame, hot: DataFrame, keys) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``__d_part`` and ``__c_part``: the rows of a hot key are dealt
    into the parts of their own side and copied to all parts of the other one, so
    that each pair of rows meets in one of its cells."""
    def dealt(df, own, other):
        cond = reduce(lambda a, b: a & b, [df[_q(k)].eqNullSafe(hot[_q(f"__h_{k}")]) for k in keys])
        # a retried task must deal its rows the same way
        part = F.pmod(F.xxhash64(*[F.col(_q(x)) for x in df.columns]), F.col(f"{own}s"))
        every = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(f"{other}s") - 1, F.lit(0).cast("long")))
        cols = [F.col(_q(x)) for x in df.columns]
        return df.join(hot, cond, "left").select(*cols, F.coalesce(part, F.lit(0).cast("long")).alias(own),
                                                 F.explode(every).alias(other))

    return dealt(d, "__d_part", "__c_part"), dealt(c, "__c_part", "__d_part")


def match(debt: DataFrame, credit: DataFrame, keys=KEYS, null_keys: str = "drop",
          suffixes=("_DEBT", "_CREDIT"), hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Inner join on ``keys``; overlapping non-key columns suffixed.

    ``null_keys='drop'`` is the plain equi-join (null never matches);
    ``'match'`` makes null equal null, like a pandas merge (J2). Either way
    it is a hash / sort-merge join on the keys, never a nested loop; AQE
    picks broadcast when one side turns out small and splits skewed keys.

    AQE tells skew by bytes. A key of many rows on both sides, as the null key
    is, makes far more pairs than bytes, so in null-safe form the rows of such a
    key are dealt into parts on both sides, and every two parts meet in a cell of
    their own. The hot keys are counted when the match is built.
    """
    if null_keys not in ("drop", "match"):
        raise ValueError("null_keys must be 'drop' or 'match'")
    d = _suffix(debt, keys, suffixes[0], credit.columns)
    c = _suffix(credit, keys, suffixes[1], debt.columns)
    if null_keys == "drop":
        return d.join(c, on=list(keys), how="inner")
    # null-safe: join on the null-safe condition, then keep one copy of the keys
    # each has more than 2 * sqrt(hot_pairs) rows, so there are few beside the rows
    hot = F.broadcast(cut_lineage(_hot_keys(debt, credit, keys, hot_pairs)))
    d, c = _dealt_sides(d, c, hot, keys)
    right = {*keys, "__d_part", "__c_part"}
    c2 = c.select(*[F.col(_q(k)).alias(f"__r_{k}") if k in right else F.col(_q(k)) for k in c.columns])
    conds = reduce(lambda a, b: a & b, [d[_q(k)].eqNullSafe(c2[_q(f"__r_{k}")]) for k in keys])
    out = d.join(c2, conds & (d["__d_part"] == c2["__r___d_part"]) & (d["__c_part"] == c2["__r___c_part"]), "inner")
    return out.drop(*[f"__r_{k}" for k in right], "__d_part", "__c_part")


def distinct_keys(pile: DataFrame, keys=KEYS) -> DataFrame:
    return pile.select(*[F.col(_q(k)) for k in keys]).distinct()


def matched_keys(debt: DataFrame, credit: DataFrame, keys=KEYS) -> DataFrame:
    """Distinct keys present on both sides (semi-join of distinct keys)."""
    return distinct_keys(debt, keys).join(distinct_keys(credit, keys), on=list(keys), how="left_semi")


def orphans(left: DataFrame, right: DataFrame, keys=KEYS, null_safe: bool = True) -> DataFrame:
    """Rows of ``left`` whose key never occurs in ``right``.

    Null-safe by default, as set membership of key tuples is in the
    reference (a null key equals a null key).
    """
    rk = distinct_keys(right, keys)
    if not null_safe:
        return left.join(rk, on=list(keys), how="left_anti")
    rk = rk.select(*[F.col(_q(k)).alias(f"__r_{k}") for k in keys])
    cond = reduce(lambda a, b: a & b, [left[_q(k)].eqNullSafe(rk[_q(f"__r_{k}")]) for k in keys])
    return left.join(rk, cond, "left_anti")


def _key_struct(keys):
    return F.struct(*[F.col(_q(k)) for k in keys])


def orphan_debt_summary(debt: DataFrame, credit: DataFrame, keys=KEYS, amount: str = AMT) -> DataFrame:
    """A19 + A21 + P20: one row with key counts, orphan rows / total, match rate."""
    od = orphans(debt, credit, keys)
    tot = debt.agg(F.count_distinct(_key_struct(keys)).alias("n_debt_keys"))
    o = od.agg(F.count_distinct(_key_struct(keys)).alias("n_orphan_keys"),
               F.count(F.lit(1)).alias("n_orphan_rows"),
               money_sum(amount).alias("orphan_total"))
    n_keys = tot.scalar()  # one-row aggregate read as a scalar subquery
    return (o.select(n_keys.alias("n_debt_keys"), "*")
               .withColumn("match_rate_pct",
                           F.round(safe_pct(F.col("n_debt_keys") - F.col("n_orphan_keys"), F.col("n_debt_keys")), 6)))


def orphan_credit_summary(debt: DataFrame, credit: DataFrame, keys=KEYS, amount: str = AMT) -> DataFrame:
    """Distinct orphan credit keys and the amount over orphan rows."""
    oc = orphans(credit, debt, keys)
    return oc.agg(F.count_distinct(_key_struct(keys)).alias("n_orphan_keys"),
                  F.count(F.lit(1)).alias("n_orphan_rows"),
                  money_sum(amount).alias("orphan_total"))


def orphan_credit_sample(debt: DataFrame, credit: DataFrame, keys=KEYS, amount: str = AMT,
                         n: int = 5) -> DataFrame:
    """D2 + J7: the first ``n`` orphan credit keys (key order, nulls first),
    each with its smallest amount, plus how many more orphan keys exist.

    The per-key amount is a partial aggregate (no group is collected); the
    top-n is a TakeOrdered, so only ``n`` rows per partition move.
    """
    oc = orphans(credit, debt, keys)
    per_key = oc.groupBy(*[F.col(_q(k)) for k in keys]).agg(F.min(amount).alias(amount))
    total = per_key.agg(F.count(F.lit(1)).alias("n_orphan_keys"))
    top = per_key.orderBy(*[F.col(_q(k)).asc_nulls_first() for k in keys]).limit(n)
    return top.withColumn("n_more", F.greatest(total.scalar() - F.lit(n), F.lit(0)))
