"""Matching, orphans, breakdowns (reference tests T:156-233, T:527-634)."""

import random

from pyspark.sql import functions as F

from conftest import pile
from tallyspark.operators import breakdown as bd
from tallyspark.operators import match as mt

D_REF, C_REF = "M2D-RECU 01.01.2026", "M6D-DEV 01.05.2026"


def test_duplicates_make_cartesian_rows(spark):
    d = pile(spark, [("1234", "OP-001", 100.0, D_REF), ("1234", "OP-001", 100.0, D_REF), ("5678", "OP-002", 200.0, D_REF)])
    c = pile(spark, [("1234", "OP-001", 100.0, C_REF), ("5678", "OP-002", 200.0, C_REF)])
    m = mt.match(d, c)
    assert m.count() == 3
    assert "Amt_Float_DEBT" in m.columns and "Accounting_Ref_CREDIT" in m.columns and "Card" in m.columns


def test_no_matches(spark):
    d = pile(spark, [("1111", "OP-AAA")])
    c = pile(spark, [("9999", "OP-ZZZ")])
    assert mt.match(d, c).count() == 0


def test_breakdown_sums_debt_side(spark):
    d = pile(spark, [("1234", "OP-001", 100.0, D_REF), ("1234", "OP-001", 150.0, D_REF)])
    c = pile(spark, [("1234", "OP-001", 250.0, C_REF)])
    for pre in (True, False):
        r = bd.breakdown(d, c, preaggregate=pre).collect()
        assert len(r) == 1 and r[0]["Total_Conciliated_Amount"] == 250.0 and r[0]["Count_Operations"] == 2


def test_preaggregated_breakdown_equals_direct(spark):
    rnd = random.Random(7)
    drows = [(str(rnd.randint(1, 5)), f"OP-{rnd.randint(1, 8)}", round(rnd.uniform(1, 99), 2), f"D {rnd.randint(1, 3)}")
             for _ in range(300)]
    crows = [(str(rnd.randint(1, 5)), f"OP-{rnd.randint(1, 8)}", 1.0, f"C {rnd.randint(1, 3)}") for _ in range(120)]
    d, c = pile(spark, drows), pile(spark, crows)
    a = sorted(map(tuple, bd.breakdown(d, c, preaggregate=True).collect()))
    b = sorted(map(tuple, bd.breakdown(d, c, preaggregate=False).collect()))
    assert a == b
    # and both equal a plain Python nested loop
    want = {}
    for dc, do, da, dr in drows:
        for cc, co, _, cr in crows:
            if (dc, do) == (cc, co):
                n, s = want.get((dr, cr), (0, 0))
                want[(dr, cr)] = (n + 1, s + round(da * 100))
    assert {(r[0], r[1]): (r[2], round(r[3] * 100)) for r in a} == want


def test_orphans(spark):
    d = pile(spark, [("1234", "OP-001", 100.0), ("5678", "OP-002", 200.0), ("9999", "OP-003", 300.0)])
    c = pile(spark, [("1234", "OP-001", 100.0)])
    od = {(r[0], r[1]) for r in mt.orphans(d, c).collect()}
    assert od == {("5678", "OP-002"), ("9999", "OP-003")}
    s = mt.orphan_debt_summary(d, c).collect()[0]
    assert (s["n_debt_keys"], s["n_orphan_keys"], s["orphan_total"]) == (3, 2, 500.0)
    assert abs(s["match_rate_pct"] - 33.333333) < 1e-6
    c2 = pile(spark, [("1234", "OP-001"), ("AAAA", "OP-100"), ("BBBB", "OP-200")])
    d2 = pile(spark, [("1234", "OP-001")])
    assert mt.orphan_credit_summary(d2, c2).collect()[0]["n_orphan_keys"] == 2
    assert mt.orphans(pile(spark, [("1234", "OP-001"), ("5678", "OP-002")]),
                      pile(spark, [("1234", "OP-001"), ("5678", "OP-002"), ("9999", "OP-003")])).count() == 0


def test_orphans_null_safe(spark):
    d = pile(spark, [("1", None), (None, "x")])
    c = pile(spark, [("1", None), ("2", None)])
    assert {(r[0], r[1]) for r in mt.orphans(c, d).collect()} == {("2", None)}


def test_null_safe_match_and_bridging(spark):
    cols = ("Card", "Operation Number", "Origin_File")
    d = pile(spark, [("1", None, "a"), ("1", None, "b"), ("2", "x", "a")], cols)
    c = pile(spark, [("1", None, "k"), ("2", "x", "k")], cols)
    assert mt.match(d, c, null_keys="match").count() == 3
    assert mt.match(d, c, null_keys="drop").count() == 1
    b = bd.bridging(d, c, file_col="Origin_File").collect()
    assert [(r[0], r[1]) for r in b] == [("k", 2)]


def test_sample_is_ordered_and_counts_rest(spark):
    c = pile(spark, [(str(i), f"OP-{i}", float(i)) for i in range(9)] + [(None, "Z", 1.0)])
    d = pile(spark, [("0", "OP-0", 0.0)])
    rows = mt.orphan_credit_sample(d, c).collect()
    assert [r["Card"] for r in rows] == [None, "1", "2", "3", "4"]
    assert rows[0]["n_more"] == 4
    assert F is not None


def test_hot_key_breakdown_without_blow_up(spark):
    """A key holding a third of both piles: 20k x 10k = 200M joined rows that
    the pre-aggregated form never builds."""
    from pyspark.sql import functions as F
    n = 60000
    d = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.col("id").cast("string")).alias("Card"),
        F.when(F.col("id") % 3 == 0, F.lit("OP")).otherwise(F.lit("X")).alias("Operation Number"),
        F.lit(1.25).alias("Amt_Float"), (F.col("id") % 4).cast("string").alias("Accounting_Ref"))
    c = spark.range(n // 2).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("c"), F.col("id").cast("string"))).alias("Card"),
        F.when(F.col("id") % 3 == 0, F.lit("OP")).otherwise(F.lit("X")).alias("Operation Number"),
        F.lit(2.0).alias("Amt_Float"), F.lit("C").alias("Accounting_Ref"))
    rows = bd.breakdown(d, c).collect()
    assert sum(r["Count_Operations"] for r in rows) == 20000 * 10000
    assert sum(r["Total_Conciliated_Amount"] for r in rows) == 20000 * 10000 * 1.25
    assert len(rows) == 4


def test_pairs_of_a_hot_null_key_are_made_by_many_tasks(spark):
    """Every pair once, rows without a partner none, and no task makes a big
    share of the pairs of one key (one did before)."""
    d = pile(spark, [("", None, float(i), "D", "d.xlsx") for i in range(600)] + [("c", "o", 1.0, "D", "d.xlsx")] * 2
             + [("x", "y", 1.0, "D", "d.xlsx")])
    c = pile(spark, [("", None, float(i), "C", "c.xlsx") for i in range(40)] + [("c", "o", 2.0, "C", "c.xlsx")] * 3)
    for most in (1 << 20, 500):
        rows = mt.match(d, c, null_keys="match", hot_pairs=most)
        got = [(r["Operation Number"], r["Amt_Float_DEBT"], r["Amt_Float_CREDIT"]) for r in rows.collect()]
        want = [(None, float(i), float(j)) for i in range(600) for j in range(40)] + [("o", 1.0, 2.0)] * 6
        assert sorted(got, key=str) == sorted(want, key=str)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        made = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(made) == 24_006 and max(made) < 12_000


def test_rows_of_a_hot_key_are_copied_few_times(spark):
    """The credit rows of a hot key went to every part of its debt rows: with the
    square of the key's rows. Now either side is copied to the other's parts,
    some square root of that, and never more than MOST_COPIES times."""
    d = pile(spark, [("", None, float(i), "D", "d.xlsx") for i in range(900)] + [("x", "y", 1.0, "D", "d.xlsx")])
    c = pile(spark, [("", None, float(i), "C", "c.xlsx") for i in range(400)] + [("x", "y", 1.0, "C", "c.xlsx")])
    for pairs, most in ((1000, 2 + 900 * 16 + 400 * 32), (1, 2 + 900 * mt.MOST_COPIES + 400 * mt.MOST_COPIES)):
        a, b = mt._dealt_sides(d, c, mt._hot_keys(d, c, mt.KEYS, pairs), mt.KEYS)
        assert 1300 < a.count() + b.count() <= most
        assert a.where("Card = 'x'").count() == b.where("Card = 'x'").count() == 1
        got = mt.match(d, c, null_keys="match", hot_pairs=pairs)
        assert got.count() == got.distinct().count() == 360_001
