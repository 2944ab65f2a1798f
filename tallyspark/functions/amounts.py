"""Money text to numbers (P5 lenient, P7 strict).

Both keep only ASCII digits, '.' and '-' and then cast; the lenient form
maps anything unparseable (and null) to 0.0, the strict form to null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NOT_NUMERIC = r"[^0-9.\-]"


def _digits(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, _NOT_NUMERIC, "").try_cast("double")


def lenient_amount(c) -> Column:
    """P5: '$1,234.56' -> 1234.56; 'invalid' / null -> 0.0."""
    return F.coalesce(_digits(c), F.lit(0.0))


def strict_amount(c) -> Column:
    """Blank / unparseable -> null."""
    return _digits(c)
