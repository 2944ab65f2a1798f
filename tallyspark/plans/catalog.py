"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the whole given tables (through the fixtures of
``tallyspark.sources.fixtures``) and returns a DataFrame; queries over
files, and those that cut their lineage, write them while they are built.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.amounts import lenient_amount, strict_amount
from tallyspark.functions.dates import LINEAR_REPORT_BASE, ddmmyyyy, last_business_day
from tallyspark.functions.names import name_matches, standardized_ref
from tallyspark.functions.text import AMOUNT, AMT, FILE, KEYS, OP, REF, source_type
from tallyspark.operators import breakdown as bd
from tallyspark.operators import match as mt
from tallyspark.operators import quality as ql
from tallyspark.operators import setops as so
from tallyspark.operators.money import money_sum
from tallyspark.session import cut_lineage, passing_tables, read_table, shuffle_cleanup
from tallyspark.sources import fixtures as fx
from tallyspark.sources.lines import line_counts
from tallyspark.sources.piles import dropped_rows, minimal_clean

Q: dict = {}


def register(name: str):
    def deco(fn):
        Q[name] = fn
        return fn
    return deco


def _union(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


# --- matching and breakdowns (F1) -------------------------------------------

@register("breakdown_by_debt")
def q_breakdown_by_debt(spark: SparkSession, sf: str) -> DataFrame:
    return bd.breakdown(fx.f1(spark, sf, "DEBT"), fx.f1(spark, sf, "CREDIT"), by="debt")


@register("breakdown_by_credit")
def q_breakdown_by_credit(spark: SparkSession, sf: str) -> DataFrame:
    return bd.breakdown(fx.f1(spark, sf, "DEBT"), fx.f1(spark, sf, "CREDIT"), by="credit")


@register("breakdown_direct")
def q_breakdown_direct(spark: SparkSession, sf: str) -> DataFrame:
    """A1 through the full many-to-many match (the reference's plan)."""
    return bd.breakdown(fx.f1(spark, sf, "DEBT"), fx.f1(spark, sf, "CREDIT"), by="debt", preaggregate=False)


@register("match_audit")
def q_match_audit(spark: SparkSession, sf: str) -> DataFrame:
    return mt.match(fx.f1(spark, sf, "DEBT"), fx.f1(spark, sf, "CREDIT"))


def _f2_minimal(spark, sf, side):
    return minimal_clean(fx.f2_raw(spark, sf, side))


@register("match_nullsafe")
def q_match_nullsafe(spark: SparkSession, sf: str) -> DataFrame:
    return mt.match(_f2_minimal(spark, sf, "DEBT"), _f2_minimal(spark, sf, "CREDIT"), null_keys="match")


@register("bridging_credits")
def q_bridging(spark: SparkSession, sf: str) -> DataFrame:
    return bd.bridging(_f2_minimal(spark, sf, "DEBT"), _f2_minimal(spark, sf, "CREDIT"),
                       file_col="Origin_File", null_keys="match")


@register("matched_keys")
def q_matched_keys(spark: SparkSession, sf: str) -> DataFrame:
    return mt.matched_keys(fx.f1(spark, sf, "DEBT"), fx.f1(spark, sf, "CREDIT"))


@register("orphan_debts")
def q_orphan_debts(spark: SparkSession, sf: str) -> DataFrame:
    return mt.orphans(fx.f1(spark, sf, "DEBT"), fx.f1(spark, sf, "CREDIT"))


@register("orphan_debt_summary")
def q_orphan_debt_summary(spark: SparkSession, sf: str) -> DataFrame:
    return mt.orphan_debt_summary(fx.f1(spark, sf, "DEBT"), fx.f1(spark, sf, "CREDIT"))


@register("orphan_credits")
def q_orphan_credits(spark: SparkSession, sf: str) -> DataFrame:
    return mt.orphans(fx.f2(spark, sf, "CREDIT"), fx.f2(spark, sf, "DEBT"))


@register("orphan_credit_summary")
def q_orphan_credit_summary(spark: SparkSession, sf: str) -> DataFrame:
    return mt.orphan_credit_summary(fx.f2(spark, sf, "DEBT"), fx.f2(spark, sf, "CREDIT"))


@register("orphan_credit_sample")
def q_orphan_credit_sample(spark: SparkSession, sf: str) -> DataFrame:
    return mt.orphan_credit_sample(fx.f2(spark, sf, "DEBT"), fx.f2(spark, sf, "CREDIT"), n=5)


# --- names, cleaning, amounts -----------------------------------------------

def _names(spark: SparkSession, sf: str) -> DataFrame:
    """File names: every F1 file plus names built from ``nation`` that
    exercise NO_DATE, UNKNOWN, upper case and both keywords."""
    nat = read_table(spark, sf, "nation")
    files = (fx.f1_raw(spark, sf, "DEBT").select(FILE)
             .unionByName(fx.f1_raw(spark, sf, "CREDIT").select(FILE)))
    built = [
        nat.select(F.concat(F.lit("M2D-RECU-"), "n_name", F.lit(".xlsx")).alias(FILE)),
        nat.select(F.concat("n_name", F.lit(" 01.02.2026.xlsx")).alias(FILE)),
        nat.select(F.concat(F.lit("x_m6d-dev_"), F.col("n_nationkey").cast("string"), F.lit("."),
                            F.col("n_regionkey").cast("string"), F.lit(".2026.XLSX")).alias(FILE)),
        nat.select(F.concat(F.lit("M6D-DEV M2D-RECU "), "n_name", F.lit(" 1-2-3.xlsx")).alias(FILE)),
    ]
    return _union([files, *built]).distinct()


@register("std_names")
def q_std_names(spark: SparkSession, sf: str) -> DataFrame:
    ref = standardized_ref(F.col(FILE))
    return _names(spark, sf).select(FILE, ref.alias(REF), source_type(ref).alias("source_type"))


@register("file_selection")
def q_file_selection(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col(FILE)
    return _names(spark, sf).select(
        FILE,
        name_matches(n, "m2d-recu").alias("in_debt_pile"),
        name_matches(n, "m6d-dev").alias("in_credit_pile"),
        name_matches(n, "m2d-recu", "prefix").alias("debt_prefix"),
        name_matches(n, "m6d-dev", "prefix").alias("credit_prefix"))


@register("clean_keys")
def q_clean_keys(spark: SparkSession, sf: str) -> DataFrame:
    return fx.f2(spark, sf, "DEBT")


@register("dropped_rows")
def q_dropped_rows(spark: SparkSession, sf: str) -> DataFrame:
    return dropped_rows(fx.f2_raw(spark, sf, "DEBT"))


def _amount_texts(spark, sf):
    return (fx.f2_raw(spark, sf, "DEBT").select(AMOUNT)
            .unionByName(fx.f2_raw(spark, sf, "CREDIT").select(AMOUNT)))


@register("clean_amounts")
def q_clean_amounts(spark: SparkSession, sf: str) -> DataFrame:
    return _amount_texts(spark, sf).distinct().select(AMOUNT, lenient_amount(AMOUNT).alias(AMT))


@register("strict_amounts")
def q_strict_amounts(spark: SparkSession, sf: str) -> DataFrame:
    return _amount_texts(spark, sf).distinct().select(AMOUNT, strict_amount(AMOUNT).alias("amount_strict"))


# --- quality (F2) -----------------------------------------------------------

@register("quality_summary")
def q_quality_summary(spark: SparkSession, sf: str) -> DataFrame:
    raw = {s: fx.f2_raw(spark, sf, s).withColumn(AMT, lenient_amount(AMOUNT)) for s in ("DEBT", "CREDIT")}
    return _union([ql.quality_counts(fx.f2(spark, sf, "DEBT"), "DEBT"),
                   ql.quality_counts(fx.f2(spark, sf, "CREDIT"), "CREDIT"),
                   ql.quality_counts(raw["DEBT"], "DEBT_RAW"),
                   ql.quality_counts(raw["CREDIT"], "CREDIT_RAW")])


@register("quality_outliers")
def q_quality_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return _union([ql.outliers(fx.f2(spark, sf, s), s) for s in ("DEBT", "CREDIT")])


@register("quality_dup_keys")
def q_quality_dup_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _union([ql.dup_key_groups(fx.f1(spark, sf, s)).select(F.lit(s).alias("pile"), "*")
                   for s in ("DEBT", "CREDIT")])


# --- set operations -----------------------------------------------------------

@register("key_intersect")
def q_key_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return so.key_intersect(fx.f1(spark, sf, "DEBT"), fx.f1(spark, sf, "CREDIT"))


@register("key_except")
def q_key_except(spark: SparkSession, sf: str) -> DataFrame:
    return so.key_except(fx.f1(spark, sf, "DEBT"), fx.f1(spark, sf, "CREDIT"))


@register("pile_union")
def q_pile_union(spark: SparkSession, sf: str) -> DataFrame:
    return so.pile_union(fx.f1(spark, sf, "DEBT"), fx.f1(spark, sf, "CREDIT").drop(AMOUNT))


@register("pile_totals")
def q_pile_totals(spark: SparkSession, sf: str) -> DataFrame:
    return _union([so.pile_totals(fx.f1(spark, sf, "DEBT"), "F1_DEBT"),
                   so.pile_totals(fx.f1(spark, sf, "CREDIT"), "F1_CREDIT"),
                   so.pile_totals(fx.f2(spark, sf, "DEBT"), "F2_DEBT"),
                   so.pile_totals(fx.f2(spark, sf, "CREDIT"), "F2_CREDIT")])


# --- dates --------------------------------------------------------------------

@register("last_business_day")
def q_last_business_day(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    b = last_business_day(F.col("d"))
    return d.select(F.date_format("d", "yyyy-MM-dd").alias("order_date"),
                    F.date_format(b, "yyyy-MM-dd").alias("last_business_day"),
                    ddmmyyyy(b).alias("business_date_text"),
                    F.concat(F.lit(LINEAR_REPORT_BASE + " ("), ddmmyyyy(b), F.lit(")")).alias("output_name"))


# --- duplicate files and cross-pile checks -----------------------------------------

from tallyspark.operators import dupfiles as dfl  # noqa: E402


@register("file_clusters")
def q_file_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """A14 as groups of files on the pile with copied files."""
    return dfl.file_clusters(fx.f3(spark, sf))


@register("intra_file_pairs")
def q_intra_file_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return dfl.file_pairs(fx.f3(spark, sf))


def _cross(spark, sf, check):
    d = fx.f1(spark, sf, "DEBT")
    scen = {"clean": (d, fx.f1(spark, sf, "CREDIT")), "self": (d, fx.f1(spark, sf, "DEBT"))}
    return _union([dfl.cross_checks(a, b)[check].select(F.lit(s).alias("scenario"), "*")
                   for s, (a, b) in scen.items()])


for _chk in ("exact", "overlap", "fingerprint", "types"):
    register(f"cross_{_chk}")(lambda spark, sf, _c=_chk: _cross(spark, sf, _c))


# --- report linearization (F4) ---------------------------------------------------------

from tallyspark.operators import linearize as lz  # noqa: E402
from tallyspark.operators.layout import DEFAULT_LAYOUT, DELIMITER_LAYOUT  # noqa: E402


def _report(spark, sf, mode, splits):
    """The rendered report, written once to the shared checkpoint folder (as
    a real report would be read from storage) so the fixture's joins are
    not recomputed by each consumer."""
    return cut_lineage(fx.f4_lines(spark, sf, mode, splits=splits))


@register("linearize_fixed")
def q_linearize_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed-width layout; one split per customer block."""
    return lz.linearize(_report(spark, sf, "fixed", "customer"), DEFAULT_LAYOUT, mode="split")


@register("linearize_split")
def q_linearize_split(spark: SparkSession, sf: str) -> DataFrame:
    """Split-parallel form (W4) with a split boundary inside every line pair
    or page header, so all state crosses splits."""
    return lz.linearize(_report(spark, sf, "fixed", "fine"), DEFAULT_LAYOUT, mode="split")


@register("linearize_delim")
def q_linearize_delim(spark: SparkSession, sf: str) -> DataFrame:
    return lz.linearize(_report(spark, sf, "delimiter", "fine"), DELIMITER_LAYOUT, mode="split")


@register("line_counts")
def q_line_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Lines per report file."""
    return line_counts(fx.f4_lines(spark, sf, "fixed")).withColumnRenamed("file", "report_file")


@register("report_holders")
def q_report_holders(spark: SparkSession, sf: str) -> DataFrame:
    return lz.card_headers(_report(spark, sf, "fixed", "fine"), DEFAULT_LAYOUT, mode="split")


# --- run verdicts -------------------------------------------------------------------------

from tallyspark.plans import reconcile as rc  # noqa: E402


@register("run_issues")
def q_run_issues(spark: SparkSession, sf: str) -> DataFrame:
    """G1-G7 on the dirty piles (F2), each pile written once and shared by
    all checks (as ``reconcile()`` does)."""
    return rc.run_issues(cut_lineage(fx.f2(spark, sf, "DEBT")), cut_lineage(fx.f2(spark, sf, "CREDIT")))


@register("run_issues_clean")
def q_run_issues_clean(spark: SparkSession, sf: str) -> DataFrame:
    """G1-G7 on the clean piles (F1), each pile written once."""
    return rc.run_issues(cut_lineage(fx.f1(spark, sf, "DEBT")), cut_lineage(fx.f1(spark, sf, "CREDIT")))


@register("run_issues_copies")
def q_run_issues_copies(spark: SparkSession, sf: str) -> DataFrame:
    """G1: a debt pile with copied files."""
    return rc.run_issues(cut_lineage(fx.f3(spark, sf)), cut_lineage(fx.f1(spark, sf, "CREDIT")))


@register("run_issues_empty")
def q_run_issues_empty(spark: SparkSession, sf: str) -> DataFrame:
    """A credit pile without rows."""
    debt = cut_lineage(fx.f1(spark, sf, "DEBT"))
    return rc.run_issues(debt, debt.where("false"))


@register("run_issues_self")
def q_run_issues_self(spark: SparkSession, sf: str) -> DataFrame:
    """One pile on both sides."""
    debt = cut_lineage(fx.f1(spark, sf, "DEBT"))
    return rc.run_issues(debt, debt)


@register("run_issues_disjoint")
def q_run_issues_disjoint(spark: SparkSession, sf: str) -> DataFrame:
    """Piles without a common key."""
    credit = fx.f1(spark, sf, "CREDIT")
    other = credit.withColumn(OP, F.concat(F.col(OP), F.lit("Z")))
    return rc.run_issues(cut_lineage(fx.f1(spark, sf, "DEBT")), cut_lineage(other))


# --- workbook piles (S1, S4, S7-S9) ---------------------------------------------------------

import os as _os  # noqa: E402
import re as _re  # noqa: E402
import uuid as _uuid  # noqa: E402

from tallyspark.functions.text import CARD  # noqa: E402
from tallyspark.session import checkpoint_dir  # noqa: E402
from tallyspark.sources import workbook as wbk  # noqa: E402
from tallyspark.plans.sinks import report_paths, write_match, write_report, write_run  # noqa: E402
from tallyspark.sources.piles import read_pile  # noqa: E402

WORKBOOK_COLS = (CARD, OP, AMOUNT)


def _smallest_file(raw: DataFrame) -> str:
    """The F1 file with the fewest rows (ties: first name): a one-row aggregate."""
    r = (raw.groupBy(FILE).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").asc(), F.col(FILE).asc()).limit(1).collect())
    return r[0][0]


def _workbook_folder(spark: SparkSession, sf: str) -> str:
    """Write the F1 DEBT pile as one workbook per month under the shared
    checkpoint folder; the smallest month lacks the Card header and one
    extra file is not a workbook at all."""
    raw = cut_lineage(fx.f1_raw(spark, sf, "DEBT"))
    bad = _smallest_file(raw)
    out = _os.path.join(checkpoint_dir(spark), f"workbooks-{_uuid.uuid4().hex}")
    wbk.write_workbooks(raw, out, WORKBOOK_COLS, renamed={bad: ["Tarjeta", OP, AMOUNT]}) \
        .write.format("noop").mode("overwrite").save()
    with open(_os.path.join(wbk.local_dir(out), "m2d-recu corrupt.xlsx"), "wb") as fh:
        fh.write(b"this is not a workbook")
    return out


@register("workbook_pile")
def q_workbook_pile(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = read_pile(spark, _workbook_folder(spark, sf), "m2d-recu", fmt="xlsx")
    return rows


@register("workbook_file_errors")
def q_workbook_file_errors(spark: SparkSession, sf: str) -> DataFrame:
    _, errors = read_pile(spark, _workbook_folder(spark, sf), "m2d-recu", fmt="xlsx")
    return errors.select("file", "reason")


# --- csv piles from real files (S1-S3, S8, S9, P1, P6) -------------------------------------------

def _csv_folder(spark: SparkSession, sf: str, line_ends: bool = False) -> str:
    """The F1 piles as csv files with the ledger's names, blanks and all, in
    two folders that hold files of equal names; the smallest debt month has no
    Card column in the first folder, and one file has no amount.

    With ``line_ends`` every other operation number has a line end in it.

    Spark writes the folders; each part file then gets its ledger name, a
    rename for every file of the listing."""
    out = _os.path.join(checkpoint_dir(spark), f"csv-{_uuid.uuid4().hex}")
    raw = fx.f1_raw(spark, sf, "DEBT").unionByName(fx.f1_raw(spark, sf, "CREDIT"))
    bad = _smallest_file(fx.f1_raw(spark, sf, "DEBT"))
    half = F.when(F.right(F.col(OP), F.lit(1)).isin(*"13579"), "first").otherwise("second")
    with passing_tables(spark):
        rows = cut_lineage(raw.withColumn("half", half)
                           .withColumn("name", F.replace(FILE, F.lit(".xlsx"), F.lit(".csv"))).drop(FILE))
        if line_ends:
            cut = F.concat(F.substring(OP, 1, 1), F.lit("\n"), F.substring(F.col(OP), 2, 1 << 30))
            rows = rows.withColumn(OP, F.when(F.right(F.col(OP), F.lit(1)).isin(*"02468"), cut).otherwise(F.col(OP)))
        broken = (F.col("name") == bad.replace(".xlsx", ".csv")) & (F.col("half") == "first")
        for part, frame in (("whole", rows.where(~broken)),
                            ("broken", rows.where(broken).withColumnRenamed(CARD, "Tarjeta")),
                            ("noamount", rows.where(broken).drop(AMOUNT)
                             .withColumn("name", F.lit("m2d-recu 1.1.2026 noamount.csv")))):
            _write_named(spark, frame, out, f"{out}-{part}")
    return out


def _write_named(spark: SparkSession, frame: DataFrame, out: str, tmp: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    with shuffle_cleanup(spark):
        (frame.repartition("half", "name").write.option("header", "true").option("quoteAll", "true")
              .partitionBy("half", "name").csv(tmp))
    fs = jvm.org.apache.hadoop.fs.Path(tmp).getFileSystem(conf)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(tmp).select("path")
    for (path,) in files.collect():
        half_dir, name = _re.search(r"half=(\w+)/name=([^/]+)/", path).groups()
        folder = jvm.org.apache.hadoop.fs.Path(f"{out}/{half_dir}")
        fs.mkdirs(folder)
        fs.rename(jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(folder, name))


PILE_COLS = (CARD, OP, AMOUNT, AMT, FILE, REF)


@register("csv_pile")
def q_csv_pile(spark: SparkSession, sf: str) -> DataFrame:
    """Both piles of one folder tree, read back from csv."""
    path = _csv_folder(spark, sf)
    return _union([read_pile(spark, path, k, fmt="csv", recursive=True)[0].select(*PILE_COLS)
                   for k in ("m2d-recu", "m6d-dev")])


@register("csv_line_ends")
def q_csv_line_ends(spark: SparkSession, sf: str) -> DataFrame:
    """Debt files whose quoted cells hold line ends."""
    rows, _ = read_pile(spark, _csv_folder(spark, sf, line_ends=True), "m2d-recu", fmt="csv", recursive=True)
    return rows.select(*PILE_COLS)


@register("csv_pile_minimal")
def q_csv_pile_minimal(spark: SparkSession, sf: str) -> DataFrame:
    """The older reader, by prefix and without blank handling; a file
    without the amount column is part of its pile."""
    rows, _ = read_pile(spark, _csv_folder(spark, sf), "M2D", match="prefix", fmt="csv", clean="minimal",
                        recursive=True)
    return rows.select(CARD, OP, AMOUNT, "Origin_File")


@register("csv_file_errors")
def q_csv_file_errors(spark: SparkSession, sf: str) -> DataFrame:
    _, errors = read_pile(spark, _csv_folder(spark, sf), "m2d-recu", fmt="csv", recursive=True)
    return errors.select("file", "reason")


@register("csv_reconcile")
def q_csv_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """From files to the report table: both piles, matched, broken down by
    debt file, written and read back."""
    path = _csv_folder(spark, sf)
    debt, credit = (cut_lineage(read_pile(spark, path, k, fmt="csv", recursive=True)[0]) for k in ("m2d-recu", "m6d-dev"))
    report = _os.path.join(checkpoint_dir(spark), f"report-{_uuid.uuid4().hex}")
    paths = write_report(bd.breakdown(debt, credit, by="debt"), None, None, report)
    return spark.read.parquet(paths["By_Debt_File"])


@register("csv_mass_match")
def q_csv_mass_match(spark: SparkSession, sf: str) -> DataFrame:
    """Matched keys and amounts of the csv piles through the match sink."""
    path = _csv_folder(spark, sf)
    debt, credit = (cut_lineage(read_pile(spark, path, k, fmt="csv", recursive=True)[0]) for k in ("m2d-recu", "m6d-dev"))
    out = _os.path.join(checkpoint_dir(spark), f"match-{_uuid.uuid4().hex}")
    write_match(mt.match(debt, credit), out)
    return spark.read.parquet(out).select(CARD, OP, "Amt_Float_DEBT", "Amt_Float_CREDIT")


# --- whole runs (E1, E2): from files to tables and back ----------------------------------------

@register("reconcile_report")
def q_reconcile_report(spark: SparkSession, sf: str) -> DataFrame:
    """Both csv piles through all checks, the report written and its three
    tables read back; the audit log summed by files. (The orphan credits of
    these piles block a strict run, see ``reconcile_blocked``.)"""
    path = _csv_folder(spark, sf)
    debt, credit = (read_pile(spark, path, k, fmt="csv", recursive=True)[0] for k in ("m2d-recu", "m6d-dev"))
    out = _os.path.join(checkpoint_dir(spark), f"report-{_uuid.uuid4().hex}")
    write_run(rc.reconcile(debt, credit, strict=False), out)
    read = {name: spark.read.parquet(p) for name, p in report_paths(spark, out).items()}
    log = read["Detailed_Audit_Log"]
    read["Detailed_Audit_Log"] = log.groupBy(bd.REF_DEBT, bd.REF_CREDIT).agg(
        F.count(F.lit(1)).alias("Count_Operations"), money_sum(f"{AMT}_DEBT").alias("Total_Conciliated_Amount"))
    return _union([df.select(F.lit(name).alias("report"), bd.REF_DEBT, bd.REF_CREDIT, "Count_Operations",
                             "Total_Conciliated_Amount") for name, df in read.items()])


@register("reconcile_blocked")
def q_reconcile_blocked(spark: SparkSession, sf: str) -> DataFrame:
    """E1 on the dirty piles (F2), strict: the issues, the status they give, and
    the tables that are written (none)."""
    out = _os.path.join(checkpoint_dir(spark), f"report-{_uuid.uuid4().hex}")
    res = rc.reconcile(fx.f2(spark, sf, "DEBT"), fx.f2(spark, sf, "CREDIT"))
    write_run(res, out)
    return res.issues.withColumns({"status": F.lit(res.status()),
                                   "n_tables": F.lit(len(report_paths(spark, out))).cast("long")})


def _old_piles(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The csv piles as the older loader reads them."""
    path = _csv_folder(spark, sf)
    return tuple(cut_lineage(read_pile(spark, path, k, match="prefix", fmt="csv", clean="minimal", recursive=True)[0])
                 for k in ("M2D-RECU", "M6D-DEV"))


@register("mass_match_audit")
def q_mass_match_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The older flow's match of csv files, through its sink."""
    out = _os.path.join(checkpoint_dir(spark), f"match-{_uuid.uuid4().hex}")
    write_match(rc.mass_match(*_old_piles(spark, sf))[0], out)
    return spark.read.parquet(out).select(CARD, OP, f"{AMOUNT}_DEBT", "Origin_File_DEBT", f"{AMOUNT}_CREDIT",
                                          "Origin_File_CREDIT")


@register("mass_match_bridging")
def q_mass_match_bridging(spark: SparkSession, sf: str) -> DataFrame:
    """Credit files of that match that span two debt files or more."""
    return rc.mass_match(*_old_piles(spark, sf))[1]


# --- drop folder and landing (L1, L2, D3) ------------------------------------------------------

from tallyspark.sources.inventory import first_names as _first_names  # noqa: E402
from tallyspark.sources.inventory import inventory as _inventory  # noqa: E402
from tallyspark.streaming import landing as ld  # noqa: E402


def _drop_folder(spark: SparkSession, sf: str) -> dict:
    """The F1 DEBT pile dropped as CSV files (one folder per month) under the
    shared checkpoint folder."""
    paths = ld.landing_paths(_os.path.join(checkpoint_dir(spark), f"landing-{_uuid.uuid4().hex}"))
    (fx.f1_raw(spark, sf, "DEBT").write.mode("overwrite").option("header", "true")
       .partitionBy(FILE).csv(paths["drop"]))
    return paths


@register("inventory")
def q_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """L1: the month folders of the drop folder and whether they hold bytes."""
    p = _drop_folder(spark, sf)
    return _folders(_inventory(spark, p["drop"], "*.csv"))


def _folders(inv: DataFrame) -> DataFrame:
    folder = F.regexp_extract("path", f"/{FILE}=([^/]*)/", 1)
    return inv.groupBy(folder.alias("folder")).agg((F.sum("length") > 0).alias("has_bytes"))


@register("first_names")
def q_first_names(spark: SparkSession, sf: str) -> DataFrame:
    """D3: the first ten month folders of the listing."""
    p = _drop_folder(spark, sf)
    folders = _folders(_inventory(spark, p["drop"], "*.csv")).select(F.col("folder").alias("path"))
    return _first_names(folders).select(F.col("path").alias("folder"))


@register("land_latest")
def q_land_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Land the drop folder twice (the second run finds nothing new) and
    return the landed rows."""
    p = _drop_folder(spark, sf)
    opts = {"header": "true"}
    ld.land_latest(spark, p["drop"], p["dest"], p["manifest"], "csv", "*.csv", opts)
    ld.land_latest(spark, p["drop"], p["dest"], p["manifest"], "csv", "*.csv", opts)
    return spark.read.parquet(p["dest"]).select(CARD, OP, AMOUNT)


@register("key_set_equal")
def q_key_set_equal(spark: SparkSession, sf: str) -> DataFrame:
    """X3 on F1: DEBT vs CREDIT (different) and DEBT vs DEBT (equal)."""
    d = fx.f1(spark, sf, "DEBT")
    return _union([so.key_set_equal(d, fx.f1(spark, sf, "CREDIT")).select(F.lit("clean").alias("scenario"), "*"),
                   so.key_set_equal(d, fx.f1(spark, sf, "DEBT")).select(F.lit("self").alias("scenario"), "*")])


@register("land_stream")
def q_land_stream(spark: SparkSession, sf: str) -> DataFrame:
    """L2, stream form: the DEBT pile dropped in two steps with a run after
    each, a third run that repeats the second one's epoch (its commit is taken
    back, as if it had stopped just before), and all landed rows."""
    p = ld.landing_paths(_os.path.join(checkpoint_dir(spark), f"landing-{_uuid.uuid4().hex}"))
    rows = fx.f1_raw(spark, sf, "DEBT").select(CARD, OP, AMOUNT)
    odd = F.coalesce(F.right(F.col(OP), F.lit(1)).isin(*"13579"), F.lit(False))

    def run() -> None:
        ld.land_stream(spark, p["drop"], p["dest"], p["stream_ckpt"], rows.schema, "csv", "*.csv", {"header": "true"})

    for drop in (rows.where(odd), rows.where(~odd)):
        drop.write.mode("append").option("header", "true").csv(p["drop"])
        run()
    ld.uncommit(spark, p["stream_ckpt"])
    run()
    return spark.read.parquet(p["dest"]).select(CARD, OP, AMOUNT)


# --- reports as text files (S5, S6, K3, K4, A20) ----------------------------------------------------

import datetime as _dt  # noqa: E402

from tallyspark.plans import linear_report  # noqa: E402

LEAST_SPLIT = 1 << 16  # bytes


def _report_folder(spark: SparkSession, sf: str) -> str:
    """The printed report as text files, lines in order. A nation's report comes
    in parts of at most 4,096 customer numbers, so a task writes no more than that;
    a part begins with the lines of a card."""
    out = _os.path.join(checkpoint_dir(spark), f"reports-{_uuid.uuid4().hex}")
    lines = fx.f4_lines(spark, sf, "fixed", splits="customer")
    lines = lines.withColumn("part", F.shiftright("split_start", 12))
    (lines.repartition("file", "part").sortWithinPartitions("file", "part", "pos")
          .select("file", "part", "value").write.partitionBy("file", "part").text(out))
    return out


def _linear_run(spark: SparkSession, sf: str) -> tuple[str, int]:
    """E3 over the text files, read in 64 byte splits or more (smaller than the
    session's where the files are small, so that splits cut files)."""
    folder = _report_folder(spark, sf)
    size = _inventory(spark, folder, "*.txt").agg(F.sum("length")).first()[0] or 0
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    if size // 64 < (128 << 20):
        spark.conf.set(setting, str(max(LEAST_SPLIT, size // 64)))
    try:
        return linear_report.run(spark, folder, f"{folder}-out", _dt.date(2026, 1, 5))
    finally:
        spark.conf.set(setting, before)


@register("report_run")
def q_report_run(spark: SparkSession, sf: str) -> DataFrame:
    """The records of all report files, as written."""
    path, _ = _linear_run(spark, sf)
    return spark.read.parquet(path).withColumn("report_file", F.regexp_extract("report_file", "^file=([^/]*)/", 1))


@register("report_run_count")
def q_report_run_count(spark: SparkSession, sf: str) -> DataFrame:
    """How many records E3 counted while it wrote them."""
    return spark.range(1).select(F.lit(_linear_run(spark, sf)[1]).cast("long").alias("records"))
