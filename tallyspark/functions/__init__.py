"""Pure column functions (no DataFrame in, Column out)."""

from tallyspark.functions.text import (blank_to_null, strip_ws, is_blank, is_empty_or_null,
                                       source_type, safe_pct, KEYS, CARD, OP, AMOUNT, REF, AMT, FILE)
from tallyspark.functions.amounts import lenient_amount, strict_amount
from tallyspark.functions.names import standardized_ref, name_matches
from tallyspark.functions.dates import last_business_day, ddmmyyyy, linear_output_name

__all__ = [
    "blank_to_null", "strip_ws", "is_blank", "is_empty_or_null", "source_type", "safe_pct",
    "lenient_amount", "strict_amount", "standardized_ref", "name_matches",
    "last_business_day", "ddmmyyyy", "linear_output_name",
    "KEYS", "CARD", "OP", "AMOUNT", "REF", "AMT", "FILE",
]
