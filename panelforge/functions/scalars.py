"""Column functions for parsing, formatting and comparisons with the semantics that the operators share.

"No value" is NULL. Comparisons with NaN are false, unlike Spark's own, where NaN exceeds everything.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITE = r"(?i)^\s*[+-]?inf(inity)?\s*$"
#: Tried in this order; month first, then day first where the month is impossible.
DATE_PATTERNS = ("M/d/yyyy", "d/M/yyyy", "yyyyMMdd", "MMM d, yyyy")


def strip(text: Column) -> Column:
    """Without white space of any kind at either end; Spark's trim takes spaces only."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def symbol(text: Column) -> Column:
    """The canonical form of a symbol: stripped and in upper case."""
    return F.upper(strip(text))


def number(text: Column) -> Column:
    """A double, or NULL for what is no number; suffixes such as 5d don't count as numbers."""
    good = text.rlike(NUMBER) | text.rlike(INFINITE)
    return F.when(good, strip(text).try_cast("double"))


def day(text: Column) -> Column:
    """The UTC date of an ISO date or time, with or without offset, or one of DATE_PATTERNS; else NULL."""
    stripped = strip(text)
    iso = F.when(stripped.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), stripped.try_cast("timestamp"))
    others = [F.try_to_timestamp(stripped, F.lit(p)) for p in DATE_PATTERNS]
    shaped = [
        F.when(stripped.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), others[0]),
        F.when(stripped.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), others[1]),
        F.when(stripped.rlike(r"^\d{8}$"), others[2]),
        F.when(stripped.rlike(r"^[A-Za-z]{3} \d{1,2}, \d{4}$"), others[3]),
    ]
    return F.to_date(F.coalesce(iso, *shaped))


def utc_naive(text: Column) -> Column:
    """A time without zone: one with an offset is moved to UTC, one without is taken as it stands; NULL for other text."""
    stripped = strip(text)
    offset = stripped.rlike(r"(Z|[+-]\d{2}(:?\d{2})?)$") & stripped.contains(":")
    moment = F.convert_timezone(F.current_timezone(), F.lit("UTC"), stripped.try_cast("timestamp").cast("timestamp_ntz"))
    return F.when(offset, moment).otherwise(stripped.try_cast("timestamp_ntz"))


def is_number(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


def above(value: Column, limit: float | Column) -> Column:
    """value > limit, false for NaN, NULL for NULL."""
    return (value > limit) & ~F.isnan(value)


def at_least(value: Column, limit: float | Column) -> Column:
    return (value >= limit) & ~F.isnan(value)


def ratio_less_one(later: Column, earlier: Column) -> Column:
    """later / earlier - 1; NULL if either is missing or the earlier one is zero."""
    return F.try_divide(later, earlier) - 1


def date_key(value: Column) -> Column:
    """The first ten characters of a time's text."""
    return F.substring(value.cast("string"), 1, 10)


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def fixed(value: Column, decimals: int) -> Column:
    """With so many decimals; halves go to the even neighbour. NULL stays NULL, which format_string would write out."""
    return F.when(value.isNotNull(), F.format_string(f"%.{decimals}f", F.bround(value, decimals)))


def percent(value: Column, decimals: int = 1) -> Column:
    """'12.3%', or 'n/a' without a value."""
    return F.coalesce(F.concat(fixed(value * 100, decimals), F.lit("%")), F.lit("n/a"))


def shortest(value: Column) -> Column:
    """Six significant digits without trailing zeros, with an exponent from a million on or below a ten-thousandth."""
    size = F.abs(value)
    power = F.floor(F.log10(F.when(size > 0, size)))
    # Rounding may carry into the next power of ten.
    mantissa = F.bround(value / F.pow(F.lit(10.0), power), 5)
    carried = F.abs(mantissa) >= 10
    power = F.when(carried, power + 1).otherwise(power)
    mantissa = F.when(carried, mantissa / 10).otherwise(mantissa)
    trim = lambda text: F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    sign = F.when(power < 0, "-").otherwise("+")
    scientific = F.concat(trim(F.format_string("%.5f", mantissa)), F.lit("e"), sign, F.lpad(F.abs(power).cast("string"), 2, "0"))
    plain = F.when(size >= 100_000, F.format_string("%.0f", F.bround(value, 0)))
    for digits in range(1, 10):
        plain = plain.when(size >= 10.0 ** (5 - digits), trim(F.format_string(f"%.{digits}f", F.bround(value, digits))))
    return F.when(size == 0, F.lit("0")).when((power >= 6) | (power < -4), scientific).otherwise(plain)


def path_part(text: Column) -> Column:
    """Letters, digits, '-', '.' and '_' stay, others become '_'; empty becomes '_'."""
    safe = F.regexp_replace(text, r"[^\p{L}\p{N}\-._]", "_")
    return F.when(safe == "", "_").otherwise(safe)
