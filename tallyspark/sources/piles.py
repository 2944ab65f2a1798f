"""Piles: every row of every file of one category, all source columns text.

``clean_pile`` is the loader's cleaning (P2-P6); ``read_pile`` reads real
files (parquet / csv / workbook) and tags each row with its file name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.amounts import lenient_amount
from tallyspark.functions.names import base_name, decoded, name_matches, standardized_ref
from tallyspark.functions.text import AMOUNT, AMT, FILE, KEYS, REF, blank_to_null, is_blank, strip_ws
from tallyspark.session import cut_lineage
from tallyspark.sources.inventory import inventory
from tallyspark.sources.records import open_after, records


def clean_pile(raw: DataFrame, keys=KEYS, amount: str | None = AMOUNT, file_col: str = FILE,
               ref_col: str = REF, blank_keys_to_null: bool = True, with_amount: bool = True) -> DataFrame:
    """Loader cleaning, in the reference order.

    1. blank / whitespace-only keys -> null (P2)
    2. drop rows whose keys are *all* null (P3)
    3. tag the standardized source name from the file name (P6, P1)
    4. strip keys (P4)
    5. ``Amt_Float`` = lenient amount (P5); files without the amount column
       never reach a pile (S9), so the column is required here.
    """
    df = raw
    if blank_keys_to_null:
        df = df.select(*[blank_to_null(c).alias(c) if c in keys else F.col(f"`{c}`")
                         for c in df.columns])
        df = df.na.drop(how="all", subset=list(keys))
    df = df.withColumn(ref_col, standardized_ref(F.col(file_col)))
    for k in keys:
        df = df.withColumn(k, strip_ws(F.col(f"`{k}`")))
    if with_amount and amount is not None:
        df = df.withColumn(AMT, lenient_amount(F.col(f"`{amount}`")))
    return df


def minimal_clean(raw: DataFrame, keys=KEYS, file_col: str = FILE) -> DataFrame:
    """Older loader (S2): strip keys, tag ``Origin_File``; no blank handling."""
    df = raw.withColumnRenamed(file_col, "Origin_File")
    for k in keys:
        df = df.withColumn(k, strip_ws(F.col(f"`{k}`")))
    return df


def dropped_rows(raw: DataFrame, keys=KEYS, file_col: str = FILE) -> DataFrame:
    """Per file, rows read and rows dropped as all-blank keys (one pass)."""
    all_blank = None
    for k in keys:
        t = is_blank(F.col(f"`{k}`"))
        all_blank = t if all_blank is None else (all_blank & t)
    return (raw.groupBy(file_col)
               .agg(F.count(F.lit(1)).alias("rows_read"),
                    F.count_if(all_blank).alias("rows_dropped")))


def _read_csv(spark: SparkSession, path: str, keyword: str, match: str, keys, amount: str | None,
              recursive: bool, options: dict):
    """csv files by name: each file's first record names its own columns, whatever
    their order; files without the needed ones, or with a quoted cell that is
    never closed, are errors, not rows. Cells may hold line ends (read as line
    feeds). Files are read once, as lines in splits of any size, and written to
    the shared checkpoint folder."""
    options = {k.lower(): v for k, v in options.items()}
    sep, quote, escape = (options.get(k) or d for k, d in (("sep", ","), ("quote", '"'), ("escape", "\\")))
    sep = options.get("delimiter", sep)
    value = F.col("value")
    charset = options.pop("encoding", options.pop("charset", "UTF-8"))
    if charset.upper() not in ("UTF-8", "UTF8"):
        value = F.decode(value.cast("binary"), charset)
    out, within = open_after(F.col("value"), sep, quote, escape)
    lines = (spark.read.format("text").option("recursiveFileLookup", str(recursive).lower()).load(path)
             .select(decoded(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("row"), value.alias("value"))
             .where(name_matches(base_name("path"), keyword, match))
             .withColumns({"open_out": out, "open_in": within}))
    lines = cut_lineage(lines)
    joined = lines.where("open_out").limit(1).count() > 0
    if joined:
        text, unclosed = records(lines)
    else:  # every line is a record already
        text, unclosed = lines.select("path", "block", "row", "value"), lines.where("false").select("path")
    text = text.where(F.trim("value") != "")
    if options.get("comment"):
        text = text.where(~F.startswith(F.ltrim("value"), F.lit(options["comment"])))
    if joined:
        text = cut_lineage(text)
    first = text.groupBy("path").agg(F.min_by("value", F.struct("block", "row")).alias("value"),
                                     F.min(F.struct("block", "row")).alias("at"))
    first = cut_lineage(first)  # a row per file, for the widths, the names, the errors and the rows
    # of the header records only: as many cells as separators, and one
    counted = (F.char_length("value") - F.char_length(F.replace("value", F.lit(sep), F.lit("")))) / len(sep)
    width = 1 + int(first.agg(F.max(counted)).first()[0] or 0)
    schema = ", ".join(f"c{i} string" for i in range(width))

    def cells(of: str) -> Column:
        parsed = F.from_csv(F.col(of), schema, {k: str(v) for k, v in options.items()})
        return F.array(*[parsed[f"c{i}"] for i in range(width)])

    heads = first.select("path", "at", cells("value").alias("head"))
    heads = heads.withColumn("names", F.array_distinct(F.filter("head", lambda h: h.isNotNull())))

    def lacks(names) -> Column:
        return ~F.forall(F.array(*[F.lit(n) for n in names]), lambda n: F.array_contains(F.col("names"), n))

    reason = F.when(lacks(keys), F.lit("missing_key_columns"))
    if amount is not None:
        reason = reason.when(lacks([amount]), F.lit("missing_amount"))
    heads = heads.withColumn("reason", reason)
    errors = heads.where(F.col("reason").isNotNull()).select(
        base_name("path").alias("file"), "reason", F.array_join("names", ",").alias("detail")).unionByName(
        unclosed.select(base_name("path").alias("file"), F.lit("unclosed_quote").alias("reason"),
                        F.lit("a quoted cell is never closed").alias("detail")))
    heads = heads.where(F.col("reason").isNull())
    # names of columns, few however many the rows
    names = sorted({*keys, *([amount] if amount else []),
                    *(r[0] for r in heads.select(F.explode("names")).distinct().collect())})
    rows = text.join(heads.select("path", "head", "at"), "path").where(F.struct("block", "row") > F.col("at"))
    rows = rows.select("path", "head", cells("value").alias("cells"))
    rows = rows.select(*[F.get("cells", F.array_position("head", n).cast("int") - 1).alias(n) for n in names],
                       base_name("path").alias(FILE))
    return rows, errors


def _read_parquet(spark: SparkSession, path: str, keyword: str, match: str, recursive: bool, options: dict):
    """parquet files by column name; a listed file that gives no row, as
    corrupt ones do, is an error row."""
    listing = inventory(spark, path, "*", recursive).where(
        name_matches("name", keyword, match) & ~F.col("name").rlike("^[._]")).select("path", "name")
    df = (spark.read.format("parquet").option("ignoreCorruptFiles", "true").option("mergeSchema", "true")
          .option("recursiveFileLookup", str(recursive).lower()).options(**options).load(path))
    columns = [F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]
    rows = df.select(*columns, base_name(decoded(F.col("_metadata.file_path"))).alias(FILE))
    rows = rows.where(name_matches(FILE, keyword, match))
    scheme = "^[a-z0-9+.-]+:/+"
    read = df.select(F.regexp_replace(decoded(F.col("_metadata.file_path")), scheme, "/").alias("read")).distinct()
    errors = listing.join(read, F.regexp_replace("path", scheme, "/") == F.col("read"), "left_anti").select(
        F.col("name").alias("file"), F.lit("unreadable").alias("reason"),
        F.lit("no row could be read").alias("detail"))
    return rows, errors


def read_pile(spark: SparkSession, path: str, keyword: str, match: str = "contains",
              fmt: str = "parquet", keys=KEYS, amount: str = AMOUNT, clean: str = "full",
              options: dict | None = None, recursive: bool = False):
    """Read every file under ``path`` whose base name has ``keyword``.

    Returns ``(rows, file_errors)``: every column as text, and one error row
    (file, reason, detail) for each file that is left out because it cannot be
    read or lacks key columns or the amount (S7-S9), for csv and workbooks by
    each file's own header. Files are told apart by their paths; names are
    those on the file system, decoded. Only the folder itself is listed unless
    ``recursive``.
    """
    options = dict(options or {})
    needed = amount if clean == "full" else None
    if fmt == "xlsx":
        from tallyspark.sources.workbook import read_workbooks
        rows, errors = read_workbooks(spark, path, keys=keys, amount=needed, keyword=keyword, match=match,
                                      recursive=recursive)
    elif fmt == "csv":
        rows, errors = _read_csv(spark, path, keyword, match, keys, needed, recursive, options)
    elif fmt == "parquet":
        rows, errors = _read_parquet(spark, path, keyword, match, recursive, options)
        missing = [k for k in keys if k not in rows.columns]
        if missing:
            raise ValueError(f"pile at {path} has no column(s) {missing}")
    else:
        raise ValueError(f"fmt must be 'parquet', 'csv' or 'xlsx', not {fmt!r}")
    if clean == "full":
        rows = clean_pile(rows, keys=keys, amount=amount)
    elif clean == "minimal":
        rows = minimal_clean(rows, keys=keys)
    return rows, errors


def pile_files(spark: SparkSession, path: str, keyword: str, rows: DataFrame, match: str = "contains",
               recursive: bool = False, file_col: str = FILE) -> DataFrame:
    """(file, n_rows): every listed file of a pile with the rows that ``rows``
    (from ``read_pile``) holds of it, 0 for those with a header only, without
    any content, or left out."""
    listing = inventory(spark, path, "*", recursive).where(
        name_matches("name", keyword, match) & ~F.col("name").rlike("^[._]")).select(F.col("name").alias("file")).distinct()
    counts = rows.groupBy(F.col(file_col).alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return listing.join(counts, "file", "left").select("file", F.coalesce("n", F.lit(0).cast("long")).alias("n_rows"))
