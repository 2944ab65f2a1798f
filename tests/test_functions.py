"""Scalar rules: file names, amounts, keys, dates (reference tests T:61-151)."""

import datetime as dt

from pyspark.sql import functions as F

from tallyspark.functions import (blank_to_null, last_business_day, lenient_amount, source_type,
                                  standardized_ref, strict_amount, strip_ws)


def one(spark, col, values, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(col(F.col("x"))).collect()]


def test_standardized_names(spark):
    names = ["m2d-recu 01.15.2026.xlsx", "M2D-RECU-01-15-2026.xlsx", "some_m2d-recu_12.31.2025_extra.xlsx",
             "m6d-dev 01.15.2026.xlsx", "M6D-DEV-01-15-2026.xlsx", "m2d-recu-nodate.xlsx",
             "random.xlsx", "m6d-dev m2d-recu 1-2-3.xlsx"]
    assert one(spark, standardized_ref, names) == [
        "M2D-RECU 01.15.2026", "M2D-RECU 01-15-2026", "M2D-RECU 12.31.2025",
        "M6D-DEV 01.15.2026", "M6D-DEV 01-15-2026", "M2D-RECU NO_DATE",
        "UNKNOWN random.xlsx", "M2D-RECU 1-2-3"]


def test_lenient_amounts(spark):
    got = one(spark, lenient_amount, ["$1,234.56", "€500.00", "-$100.50", "1234", "invalid", None,
                                      "1.234,56", "(100)", "1E5", "23.00-", "", ".5", "1."])
    assert got == [1234.56, 500.0, -100.5, 1234.0, 0.0, 0.0, 1.23456, 100.0, 15.0, 0.0, 0.0, 0.5, 1.0]


def test_strict_amounts(spark):
    got = one(spark, strict_amount, ["  23.00 ", "", "   ", None, "abc", "1,000.5", "-7"])
    assert got == [23.0, None, None, None, None, 1000.5, -7.0]


def test_strip_and_blank(spark):
    assert one(spark, strip_ws, ["  1234  ", "ABC-123\n", "\t OP-456 \t", "　x\xa0"]) == \
        ["1234", "ABC-123", "OP-456", "x"]
    assert one(spark, blank_to_null, ["", "  ", "\t\n", "a", None, " a "]) == [None, None, None, "a", None, " a "]


def test_source_type(spark):
    assert one(spark, source_type, ["M2D-RECU 01.01.2026", "M6D-DEV x", "UNKNOWN a b"]) == \
        ["M2D-RECU", "M6D-DEV", "UNKNOWN"]


def test_last_business_day(spark):
    days = [dt.date(2026, 12, 7) + dt.timedelta(days=i) for i in range(7)]  # Monday .. Sunday
    got = one(spark, last_business_day, days, "date")
    want = []
    for d in days:
        back = 3 if d.weekday() == 0 else 2 if d.weekday() == 6 else 1
        want.append(d - dt.timedelta(days=back))
    assert got == want


def test_amount_parsers_on_random_strings(spark):
    """P5 / P7 against plain Python on random text (digits, signs, dots,
    currency, separators, letters, spaces)."""
    import random
    import re
    rnd = random.Random(3)
    alphabet = "0123456789" * 3 + "..--$€,  ()eE+abcXN\t"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    texts += ["1.", ".5", "-.5", "-", ".", "--1", "1-", "0007", "-0", "1e5", "+1", "(100)", "1.234,56"]

    def parse(t):
        kept = re.sub(r"[^0-9.\-]", "", t)
        try:
            return float(kept)
        except ValueError:
            return None

    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = df.select("x", lenient_amount(F.col("x")).alias("l"), strict_amount(F.col("x")).alias("s")).collect()
    for r in got:
        want = parse(r["x"])
        assert r["s"] == want, r["x"]
        assert r["l"] == (0.0 if want is None else want), r["x"]


NAMES = {
    "12.1.2026m2d-recu": "M2D-RECU 12.1.2026", "M6d-Dev_1-1.2026": "M6D-DEV 1-1.2026",
    "m6d-dev 12.1": "M6D-DEV NO_DATE", "x1.2.3.4m2d-recu": "M2D-RECU 1.2.3",
    "m2d-recu-12-1-2026-1": "M2D-RECU 12-1-2026", "m6d-dev12.2026.1 M2D-RECU": "M2D-RECU 12.2026.1",
    "ab 1.1.1.xlsx": "UNKNOWN ab 1.1.1.xlsx", "M2D RECU 1.1.1": "UNKNOWN M2D RECU 1.1.1",
    "m2d-recu 1..1.1 2-2-2": "M2D-RECU 2-2-2", "m6d-dev.12.": "M6D-DEV NO_DATE", "": "UNKNOWN ",
}


def test_standardized_names_of_odd_names(spark):
    assert one(spark, standardized_ref, list(NAMES)) == list(NAMES.values())
