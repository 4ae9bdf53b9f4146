"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts) -> Column:
    """Microseconds of a timestamp, with or without a zone (the session's zone must be UTC)."""
    return F.unix_micros(col(ts).cast("timestamp"))


def seconds_between(later, earlier) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def finite(c) -> Column:
    """NaN and infinities as NULL."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def rounded(c, places: int = 6) -> Column:
    return F.round(finite(col(c).cast("double")), places)


def steady_mean(c) -> Column:
    """The mean of a group, to the last bit the same in whatever order its rows are added: whole 2^-20ths and what is left of them have
    sums without rounding while values have a usual size, and are no worse than avg else."""
    c = col(c).cast("double")
    whole = F.when(F.abs(c) < F.lit(2.0**32), F.rint(c * F.lit(2.0**20)) / F.lit(2.0**20)).otherwise(c)
    return F.avg(whole) + F.avg(F.nanvl(c - whole, F.lit(0.0)))


def safe_ratio(a, b, floor: float = 0.0) -> Column:
    """a / b, NULL where |b| <= floor."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.when(F.abs(b) > F.lit(floor), a / b)


def slug(c) -> Column:
    """Whatever isn't a letter, digit, dot, dash or underline becomes an underline."""
    return F.regexp_replace(col(c).cast("string"), "[^A-Za-z0-9_.-]", "_")


def joined_path(folder: str, stored) -> Column:
    """A stored path below a folder, with forward slashes."""
    return F.concat_ws("/", F.lit(folder), F.ltrim(F.translate(col(stored), "\\", "/"), F.lit("/")))


def digest(*cols) -> Column:
    """16 hex digits that change if and only if the values do."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(col(c).cast("string"), F.lit("\x00")) for c in cols]), 256), 1, 16)


def column_index(ref) -> Column:
    """The number from 0 of a spreadsheet column: 'A' is 0, 'AA3' is 26."""
    letters = F.filter(F.split(F.upper(F.regexp_extract(col(ref), "^([A-Za-z]+)", 1)), ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64) - 1


def text_cell(c) -> Column:
    return F.trim(F.coalesce(col(c), F.lit("")))


def number_cell(c) -> Column:
    return col(c).try_cast("double")


def whole_cell(c) -> Column:
    """The nearest whole number of a cell, ties to even; NULL if it isn't a number."""
    return F.bround(number_cell(c), 0).cast("int")


def percent(c) -> Column:
    return F.when(col(c).isNull(), F.lit("n/a")).otherwise(F.format_string("%.1f%%", 100 * col(c).cast("double")))
