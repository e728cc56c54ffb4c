"""``is_numeric(text, precision, scale)`` as a pure Column expression.

Rule: drop thousands commas; the rest must match ``[-+]?[0-9]*\\.?[0-9]+``
(whole string); round half away from zero to ``scale``; true when
``abs(value) < 10^(precision - scale)``; NULL in → NULL out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# \z anchors at the very end (Java's $ would also accept a trailing newline).
NUMERIC_PATTERN = r"^[-+]?[0-9]*\.?[0-9]+\z"


def is_numeric(val: Column | str, precision: int, scale: int) -> Column:
    v = F.col(val) if isinstance(val, str) else val
    cleaned = F.regexp_replace(v, ",", "")
    shape_ok = cleaned.rlike(NUMERIC_PATTERN)
    int_digits = precision - scale
    # Strip sign and leading zeros, then the integer part's length bounds the
    # magnitude before any cast (so a 45-digit number never overflows).
    unsigned = F.regexp_replace(cleaned, r"^[-+]", "")
    int_part = F.regexp_replace(F.split_part(unsigned, F.lit("."), F.lit(1)), "^0+", "")
    short_enough = F.length(int_part) <= F.lit(int_digits)
    # Only reached for short, well-formed text: the integer part fits, and the
    # widest fraction that still fits 38 digits keeps rounding single-step.
    frac_digits = 38 - max(int_digits, 1)
    num = cleaned.try_cast(f"decimal(38,{frac_digits})")
    rounded = F.round(num, scale)
    fits = F.abs(rounded) < F.lit(10 ** int_digits)
    return (F.when(v.isNull(), F.lit(None).cast("boolean"))
            .when(~shape_ok, F.lit(False))
            .when(~short_enough, F.lit(False))
            .otherwise(F.coalesce(fits, F.lit(False))))
