"""Ledger piles derived from the TPC-H-style tables (FIXTURES.md F1-F3).

Each lineitem joined to its order is one card operation:
``Card = o_custkey``, ``Operation Number = l_orderkey-l_linenumber``,
``Original Amount = '$' || l_extendedprice`` (two decimals), and each ship
month is one delivered file. DEBT has every row; CREDIT the returned ones.
Everything is derived by Spark from the given tables, so the work of every
query grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.text import AMOUNT, CARD, FILE, OP
from tallyspark.session import read_table
from tallyspark.sources.piles import clean_pile

# Fixed values of the fixture design (FIXTURES.md): file-name prefixes per
# pile, the moduli of l_partkey that inject faults in F2, and the copy
# suffixes of F3.
DEBT_FILE_PREFIX = "m2d-recu "
CREDIT_FILE_PREFIX = "m6d-dev "
F2_BOTH_BLANK, F2_CARD_BLANK, F2_CARD_PADDED = 97, 101, 89
F2_OP_NULL = 103
F2_INVALID, F2_NEGATIVE, F2_TIMES_1000 = 109, 107, 113
F2_ORPHAN_CREDIT = 83
F3_RENAME_MOD = 20
F3_COPIES = ("copy-a", "copy-b", "copy-c")  # unchanged, amount + 1, ops renamed


def money_text(x: Column) -> Column:
    return F.concat(F.lit("$"), x.cast("decimal(18,2)").cast("string"))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem x orders -> card, op, price, partkey, returnflag, month."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag", "l_shipdate")
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # a big-big join at scale: sort-merge on the order key (never broadcast
    # orders); the shuffle also spreads the rows over all tasks
    j = li.join(od.hint("merge"), li.l_orderkey == od.o_orderkey, "inner")
    return j.select(
        F.col("o_custkey").cast("string").alias("card"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("op"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_partkey").alias("pk"),
        F.col("l_returnflag").alias("rf"),
        F.concat(F.date_format("l_shipdate", "yyyy-MM"), F.lit("-01")).alias("m"),
    )


def _raw(b: DataFrame, prefix: str) -> DataFrame:
    return b.select(F.col("card").alias(CARD), F.col("op").alias(OP),
                    money_text(F.col("price")).alias(AMOUNT),
                    F.concat(F.lit(prefix), F.col("m"), F.lit(".xlsx")).alias(FILE))


def f1_raw(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """F1 raw pile (all text): DEBT = every row, CREDIT = returned rows."""
    b = base(spark, sf_dir)
    if side == "DEBT":
        return _raw(b, DEBT_FILE_PREFIX)
    return _raw(b.where(F.col("rf") == "R"), CREDIT_FILE_PREFIX)


def f1(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    return clean_pile(f1_raw(spark, sf_dir, side))


def f2_raw(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """F1 with faults chosen by ``l_partkey`` modulus (see FIXTURES.md)."""
    b = base(spark, sf_dir)
    prefix = DEBT_FILE_PREFIX
    if side == "CREDIT":
        b = b.where(F.col("rf") == "R")
        prefix = CREDIT_FILE_PREFIX
    pk = F.col("pk")
    card = (F.when(pk % F2_BOTH_BLANK == 0, F.lit("  "))
             .when(pk % F2_CARD_BLANK == 0, F.lit(""))
             .when(pk % F2_CARD_PADDED == 0, F.concat(F.lit("\t"), F.col("card"), F.lit("  ")))
             .otherwise(F.col("card")))
    op = F.when((pk % F2_BOTH_BLANK == 0) | (pk % F2_OP_NULL == 0), F.lit(None).cast("string"))
    if side == "CREDIT":
        op = op.when(pk % F2_ORPHAN_CREDIT == 0, F.concat(F.col("op"), F.lit("X")))
    op = op.otherwise(F.col("op"))
    amt = (F.when(pk % F2_INVALID == 0, F.lit("invalid"))
            .when(pk % F2_NEGATIVE == 0, F.concat(F.lit("-"), money_text(F.col("price"))))
            .when(pk % F2_TIMES_1000 == 0, money_text(F.col("price") * 1000))
            .otherwise(money_text(F.col("price"))))
    return b.select(card.alias(CARD), op.alias(OP), amt.alias(AMOUNT),
                    F.concat(F.lit(prefix), F.col("m"), F.lit(".xlsx")).alias(FILE))


def f2(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    return clean_pile(f2_raw(spark, sf_dir, side))


def f3_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 DEBT plus three renamed copies of its largest month.

    copy-a is unchanged (DUPLICATE), copy-b has every amount + 1
    (SUSPICIOUS), copy-c renames the operations of ``l_partkey % 20 = 0``
    (about 5%, WARNING). The largest month is found by an aggregate whose
    single-row result is joined back (a one-row broadcast).
    """
    b = base(spark, sf_dir)
    sizes = b.groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.col("n").desc(), F.col("m").asc()).limit(1).select("m")
    big = b.join(F.broadcast(top), "m", "left_semi")
    orig = _raw(b, DEBT_FILE_PREFIX)

    def copy(tag: str, op: Column, price: Column) -> DataFrame:
        return big.select(F.col("card").alias(CARD), op.alias(OP), money_text(price).alias(AMOUNT),
                          F.concat(F.lit(DEBT_FILE_PREFIX), F.col("m"), F.lit(f" {tag}.xlsx")).alias(FILE))

    a = copy(F3_COPIES[0], F.col("op"), F.col("price"))
    bb = copy(F3_COPIES[1], F.col("op"), F.col("price") + 1)
    c = copy(F3_COPIES[2], F.when(F.col("pk") % F3_RENAME_MOD == 0, F.concat(F.col("op"), F.lit("W")))
                              .otherwise(F.col("op")), F.col("price"))
    return orig.unionByName(a).unionByName(bb).unionByName(c)


def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_pile(f3_raw(spark, sf_dir))


# --- F4: rendered report lines -------------------------------------------------------
# Fixed values of the report rendering: file name pattern, the text of the
# page header lines, constant field values, and the key arithmetic that
# chooses where headers, blank and noise lines, truncated lines and blank
# amounts go (same rules in the SQL oracle).
F4_PAGE_STAR = "***** PAGINA "
F4_TITLE = "   REPORTE DE MOVIMIENTOS PENDIENTES"
F4_RULE = " " + "-" * 60
F4_HEADING = "OPERAC  RS  MOVIM  MONEDA IMPORTE"
F4_NOISE = "TOTAL MOVIMIENTOS "
F4_PREAMBLE = "0000 INICIO DE TARJETA"
F4_TIE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def f4_selectors():
    """(page header, blank line, noise line, short line 2, blank amount)."""
    ok, ln, pk, sk = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    return ((ok + ln + pk) % 5 == 0, (ok + pk) % 7 == 0, (pk + sk) % 11 == 0, (ok + sk) % 13 == 0, pk % 17 == 0)


def _dec2(c: Column) -> Column:
    return c.cast("decimal(18,2)").cast("string")


def _lpad(c, n):
    return F.lpad(c.cast("string"), n, " ")


def _rpad(c, n):
    return F.rpad(c.cast("string"), n, " ")


def f4_lines(spark: SparkSession, sf_dir: str, mode: str = "fixed", splits: str = "fine") -> DataFrame:
    """(file, split_start, pos, value) of a card report per nation.

    Per customer: a digit-first preamble line (ignored before the first card
    of a file, a dropped line 1 after it) and a ``- TARJETA`` header. Per
    lineitem: line 1, optional blank / noise line, optional 5-line page
    header, line 2. Every lineitem is cut by a split boundary: inside the
    page header when there is one, else between line 1 and line 2.
    """
    li = read_table(spark, sf_dir, "lineitem")
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cu = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # the smaller tables first: line items are shuffled once, not with their orders' columns again
    oc = od.join(cu.hint("merge"), od.o_custkey == cu.c_custkey)
    j = li.join(oc.hint("merge"), li.l_orderkey == oc.o_orderkey)
    sel5, sel7, sel11, sel13, sel17 = f4_selectors()
    ck = F.col("c_custkey")
    file = F.concat(F.lit("tarjetas_"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit(".txt"))
    tie = [F.col(c) for c in F4_TIE]
    price = F.col("l_extendedprice")
    operac = F.lpad(((F.col("l_orderkey") * 8 + F.col("l_linenumber")) % 1000000).cast("string"), 6, "0")
    movim = F.concat(F.col("l_returnflag"), F.col("l_linestatus"), F.lit("MV"))
    cuenta = F.concat(F.lit("194-"), F.col("l_partkey").cast("string"), F.lit("-0-"), F.col("l_suppkey").cast("string"))
    fecope = F.date_format("l_shipdate", "ddMMyyyy")
    fbase = F.date_format("o_orderdate", "ddMMyyyy")
    afect = _dec2(price.cast("decimal(18,2)") + F.lit(1).cast("decimal(18,2)"))
    tax = _dec2(F.col("l_tax"))
    l2vals = [F.concat(F.lit("T"), F.col("l_suppkey").cast("string")), F.col("l_returnflag"),
              F.col("l_orderkey").cast("string"), F.concat(F.lit("SUPP "), F.col("l_suppkey").cast("string")),
              F.lit("LIMA"), F.lit("PE"), F.col("l_partkey").cast("string"), F.lit("N"),
              F.col("l_linenumber").cast("string"), F.lit("05"), F.lit("7"), tax]
    if mode == "fixed":
        line1 = F.concat(operac, F.lit("  "), F.lit("01"), F.lit("  "), _rpad(movim, 5), F.lit("  "), F.lit("604"),
                         _lpad(_dec2(price), 15), F.lit("SOL"), _lpad(_dec2(F.col("l_quantity")), 15), F.lit("USD"),
                         F.when(sel17, F.lit(" " * 15)).otherwise(_lpad(afect, 15)), F.lit("AHO "),
                         _rpad(cuenta, 20), _rpad(fecope, 9), _rpad(F.lit("234248"), 7), _rpad(fbase, 9),
                         F.lit("06-27 "))
        widths = [11, 5, 15, 26, 14, 6, 13, 5, 12, 5, 6, 21]
        full2 = F.concat(F.lit(" "), *[_rpad(v, w) for v, w in zip(l2vals, widths)])
        line2 = F.when(sel13, F.substring(full2, 1, 100)).otherwise(full2)
    else:
        line1 = F.concat_ws("  ", operac, F.lit("01"), movim, F.lit("604"), _dec2(price), F.lit("SOL"),
                            _dec2(F.col("l_quantity")), F.lit("USD"), afect, F.lit("AHO"), cuenta, fecope,
                            F.lit("234248"), fbase, F.lit("06-27"))
        line2 = F.concat(F.lit(" "), F.when(sel13, F.concat_ws("  ", *l2vals[:9]))
                                      .otherwise(F.concat_ws("  ", *l2vals)))
    okey = F.col("l_orderkey").cast("string")
    sub = [  # (subline, text or null, after the split cut?)
        (0, line1, F.lit(False)),
        (1, F.when(sel7, F.lit("")), F.lit(False)),
        (2, F.when(sel11, F.concat(F.lit(F4_NOISE), okey)), F.lit(False)),
        (3, F.when(sel5, F.concat(F.lit(F4_PAGE_STAR), okey, F.lit(" *****"))), F.lit(False)),
        (4, F.when(sel5, F.lit(F4_TITLE)), F.lit(False)),
        (5, F.when(sel5, F.lit(F4_RULE)), sel5),
        (6, F.when(sel5, F.lit(F4_HEADING)), sel5),
        (7, F.when(sel5, F.lit(F4_RULE)), sel5),
        (8, line2, F.lit(True)),
    ]
    arr = F.array(*[F.struct(F.lit(i).alias("sub"), t.alias("value"), h.alias("half")) for i, t, h in sub])
    items = j.select(file.alias("file"), ck.alias("ck"), *tie, F.explode(arr).alias("x"))
    items = items.where(F.col("x.value").isNotNull())
    # compact order key (valid while custkey < 2^31 and orderkey < 2^32):
    # a = custkey, orderkey; b = line number, a hash of the whole lineitem
    # (tie-break only), sub-line
    a = F.shiftleft(F.col("ck"), 32) + F.col("l_orderkey")
    item = (F.shiftleft(F.col("l_linenumber").cast("long"), 54)
            + F.pmod(F.xxhash64(*[F.col(c) for c in F4_TIE]), F.lit(1 << 54)))
    if splits == "fine":
        split = F.struct(a.alias("a"), item.alias("i"), F.col("x.half").cast("int").alias("half"))
    else:
        split = F.col("ck")
    li_lines = items.select(
        "file",
        split.alias("split_start"),
        F.struct(a.alias("a"), (F.shiftleft(item, 4) + F.col("x.sub")).alias("b")).alias("pos"),
        F.col("x.value").alias("value"))
    # customer lines: preamble + card header, before the customer's items
    holder = (F.when(ck % 13 == 0, F.lit(""))
               .when(ck % 5 == 0, F.concat(F.lit("  nombre "), F.col("c_name")))
               .when(ck % 11 == 0, F.concat(F.lit("  "), F.col("c_name")))
               .otherwise(F.concat(F.lit("  NOMBRE "), F.col("c_name"))))
    header = F.concat(F.when(ck % 7 == 0, F.lit(" ")).otherwise(F.lit("")), F.lit("- TARJETA "),
                      F.lpad(ck.cast("string"), 16, "0"), holder)
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    # customer lines sort before the customer's items: orderkey slot -1
    ca = F.shiftleft(ck, 32) - F.lit(1)
    if splits == "fine":
        csplit = F.struct(ca.alias("a"), F.lit(0).cast("long").alias("i"), F.lit(0).alias("half"))
    else:
        csplit = ck
    carr = F.array(F.struct(F.lit(0).alias("sub"), F.lit(F4_PREAMBLE).alias("value")),
                   F.struct(F.lit(1).alias("sub"), header.alias("value")))
    c_lines = cust.select(file.alias("file"), ca.alias("a"), csplit.alias("split_start"),
                          F.explode(carr).alias("x")).select(
        "file", "split_start", F.struct(F.col("a"), F.col("x.sub").cast("long").alias("b")).alias("pos"),
        F.col("x.value").alias("value"))
    return c_lines.unionByName(li_lines)
