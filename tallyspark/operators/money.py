"""Order-independent money arithmetic.

Float sums depend on the order rows arrive in, which a distributed plan
does not fix. Amounts are summed as decimals and turned back into
doubles only at the end, so every plan (and the SQL oracle) gets the same
number.

An amount column can hold anything, an account number for one. Amounts are
taken to six decimals; one that has more than 26 digits before the point
does not fit and is left out of the sums, and the run reports how many such
amounts a pile has (``unfit``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Six decimals keep sub-cent parts of amounts such as '1.234,56' -> 1.23456;
# with 32 digits in all, products with row counts keep them too.
MONEY_TYPE = "decimal(32,6)"


def as_money(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.try_cast(MONEY_TYPE)


def unfit(c) -> Column:
    """Is there an amount that ``as_money`` cannot hold?"""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & as_money(c).isNull()


def money_sum(c) -> Column:
    """sum(amount) as a double, computed exactly."""
    return F.sum(as_money(c)).cast("double")
