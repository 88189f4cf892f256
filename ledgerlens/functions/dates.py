"""Date parsing and calendar features (session time zone is UTC)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_DATE_FORMATS: tuple[str, ...] = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
    "MM/dd/yyyy",
    "M/d/yyyy",
)

MICROS_PER_DAY = 86_400_000_000


def _col(c):
    return F.col(c) if isinstance(c, str) else c


# Text shape -> formats to try.  Selecting by shape first means a value is
# only parsed with formats that can fit it (a failed parse is costly).
_SHAPES = (
    (r"^\d{4}-\d{2}-\d{2}$", ("yyyy-MM-dd",)),
    (r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d{1,9})?([+-]\d{2}:?\d{2}|Z)?$", None),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", ("M/d/yyyy",)),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", ("M/d/yy",)),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", ("yyyy/M/d",)),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$", ("yyyy-MM-dd HH:mm",)),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}$", ("yyyy-MM-dd'T'HH:mm",)),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", ("M/d/yyyy H:mm",)),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", ("MMM d, yyyy",)),
)


def parse_date(c: Column | str, formats: Sequence[str] = DEFAULT_DATE_FORMATS) -> Column:
    """First format that parses wins; zoned text is converted to UTC,
    naive text is taken as UTC.  Unparseable -> NULL."""
    s = F.regexp_replace(_col(c).cast("string"), r"^\s+|\s+$", "")
    if tuple(formats) != DEFAULT_DATE_FORMATS:
        return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats])
    out = None
    for shape, fmts in _SHAPES:
        fmts = fmts or tuple(f for f in formats if "HH" in f)
        val = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in fmts]) if len(fmts) > 1 \
            else F.try_to_timestamp(s, F.lit(fmts[0]))
        cond = s.rlike(shape)
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out


def as_utc_timestamp(c: Column | str) -> Column:
    """TIMESTAMP_NTZ / DATE input -> TIMESTAMP (wall clock read as UTC)."""
    return _col(c).cast("timestamp")


def day_of_week_name(d: Column) -> Column:
    return F.date_format(d, "EEEE")


def day_of_week_index(d: Column) -> Column:
    """0 = Monday ... 6 = Sunday."""
    return F.weekday(d)


def week_of_month(d: Column) -> Column:
    return (F.floor((F.dayofmonth(d) - 1) / 7) + 1).cast("int")


def is_weekend(d: Column) -> Column:
    return F.coalesce(F.weekday(d) >= 5, F.lit(False))


def week_label(d: Column) -> Column:
    """Monday-to-Sunday week as ``YYYY-MM-DD/YYYY-MM-DD``."""
    start = F.date_trunc("week", d)
    return F.concat(F.date_format(start, "yyyy-MM-dd"), F.lit("/"),
                    F.date_format(F.date_add(start, 6), "yyyy-MM-dd"))


def month_label(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def micros(d: Column) -> Column:
    return F.unix_micros(d.cast("timestamp"))


def day_number(d: Column) -> Column:
    """Whole UTC days since the epoch."""
    return F.floor(micros(d) / MICROS_PER_DAY).cast("long")


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days between two timestamps."""
    return (micros(later) - micros(earlier)) / float(MICROS_PER_DAY)
