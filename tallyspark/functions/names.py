"""Source-file naming rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords that classify a file, labels of the standardized
# name, the date pattern searched in the lower-cased file name, and the
# placeholders used when no date / no keyword is found.
DEBT_KEYWORD = "m2d-recu"
CREDIT_KEYWORD = "m6d-dev"
DEBT_LABEL = "M2D-RECU"
CREDIT_LABEL = "M6D-DEV"
DATE_PATTERN = r"(\d+[.-]\d+[.-]\d+)"
NO_DATE = "NO_DATE"
UNKNOWN = "UNKNOWN"


def standardized_ref(name) -> Column:
    """P1: 'x_M2D-RECU_12.31.2025.xlsx' -> 'M2D-RECU 12.31.2025'.

    The debt keyword wins when both appear; with neither the result is
    'UNKNOWN <original name>'. The date stays text.
    """
    name = F.col(name) if isinstance(name, str) else name
    # lower-casing never changes digits, '.' or '-', so the date is searched
    # in the name as it is; keywords match case-insensitively
    found = F.regexp_extract(name, DATE_PATTERN, 1)
    date = F.when(found == "", F.lit(NO_DATE)).otherwise(found)
    return (F.when(_has(name, DEBT_KEYWORD), F.concat(F.lit(DEBT_LABEL + " "), date))
             .when(_has(name, CREDIT_KEYWORD), F.concat(F.lit(CREDIT_LABEL + " "), date))
             .otherwise(F.concat(F.lit(UNKNOWN + " "), name)))


def _has(name: Column, keyword: str, prefix: bool = False) -> Column:
    """Case-insensitive keyword test without lower-casing every row (the
    keywords are ASCII, and no other character lower-cases to them)."""
    return name.rlike(("(?i)^" if prefix else "(?i)") + re.escape(keyword))


def decoded(c) -> Column:
    """A path or name as it is on the file system: the file sources' metadata
    columns percent-encode it ('+' stands for itself there)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def relative_path(spark, root: str, file_path) -> Column:
    """The decoded path of a file below ``root``: its identity. For a file
    directly in the folder that is its name."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = re.sub(r"^[a-z0-9+.-]+:/+", "/", fs.makeQualified(jvm_path).toString()).rstrip("/") + "/"
    full = F.regexp_replace(decoded(file_path), "^[a-z0-9+.-]+:/+", "/")
    return F.when(F.startswith(full, F.lit(base)), F.substr(full, F.lit(len(base) + 1))).otherwise(full)


def base_name(path) -> Column:
    return F.substring_index(F.col(path) if isinstance(path, str) else path, "/", -1)


def name_matches(name, keyword: str, match: str = "contains") -> Column:
    """S3: case-insensitive keyword test on a base file name."""
    name = F.col(name) if isinstance(name, str) else name
    if match == "contains":
        return _has(name, keyword)
    if match == "prefix":
        return _has(name, keyword, prefix=True)
    raise ValueError(f"match must be 'contains' or 'prefix', not {match!r}")
