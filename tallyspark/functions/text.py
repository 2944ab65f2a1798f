"""String helpers for keys and refs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ledger column headers and derived column names.
CARD = "Card"
OP = "Operation Number"
AMOUNT = "Original Amount"
REF = "Accounting_Ref"
AMT = "Amt_Float"
FILE = "source_file"
KEYS = (CARD, OP)

# The characters Python's str.strip() / str.isspace() treat
# as whitespace (tab, LF, VT, FF, CR, the four information separators,
# space, NEL, NBSP, OGHAM SPACE MARK, EN QUAD .. HAIR SPACE, LINE and
# PARAGRAPH SEPARATOR, NARROW NBSP, MEDIUM MATHEMATICAL SPACE, IDEOGRAPHIC
# SPACE). Trimming by this set is linear and needs no regex.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
              "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
              "\u2028\u2029\u202f\u205f\u3000")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


WS_CLASS = "[" + "".join(f"\\u{ord(ch):04x}" for ch in WHITESPACE) + "]"


def has_text(c) -> Column:
    """True when the text has a non-whitespace character (stops at the first)."""
    return _c(c).rlike("[^" + WS_CLASS[1:])


def starts_after_ws(c, prefix: str) -> Column:
    """``strip(c).startswith(prefix)`` without stripping the whole text."""
    import re
    return _c(c).rlike("^" + WS_CLASS + "*" + re.escape(prefix).replace("\\ ", " "))


def strip_ws(c) -> Column:
    """Remove all surrounding whitespace (tab, newline, Unicode spaces).
    Plain spaces go first: that is cheaper than the search through the set."""
    return F.btrim(F.trim(_c(c)), F.lit(WHITESPACE))


def is_blank(c) -> Column:
    """True for null, empty or whitespace-only text."""
    c = _c(c)
    return c.isNull() | (strip_ws(c) == "")


def blank_to_null(c) -> Column:
    """Whitespace-only / empty text becomes null."""
    c = _c(c)
    return F.when(strip_ws(c) == "", F.lit(None).cast("string")).otherwise(c)


def is_empty_or_null(c) -> Column:
    """A8/A9 predicate: null or exactly ''."""
    c = _c(c)
    return c.isNull() | (c == "")


def source_type(ref) -> Column:
    """First whitespace-separated token of a ref, e.g. 'M2D-RECU'."""
    return F.regexp_extract(_c(ref), r"(?U)^\s*(\S+)", 1)


def safe_pct(num, den) -> Column:
    """P20: 100 * num / max(den, 1)."""
    return F.lit(100.0) * _c(num) / F.greatest(_c(den), F.lit(1))
