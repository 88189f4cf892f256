"""Operators over a header table ``(file_path, header[, n_rows])``.

Format detection, generic column mapping, ambiguity warnings and the reject
report are array-function projections over one row per file, so they run as
one distributed job however many files arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.rules import (
    AMOUNT_VARIANTS,
    BOFA_MARKER,
    BOFA_REQUIRED,
    CHASE_REQUIRED,
    CREDIT_VARIANTS,
    DATE_VARIANTS,
    DEBIT_VARIANTS,
    DESC_VARIANTS,
    PLAID_REQUIRED,
)


def _lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def raw_columns(h: Column) -> Column:
    """Column names of a CSV header line; quotes around a name are not part
    of it, and a quoted name may hold commas and doubled quotes."""
    parts = F.regexp_extract_all(F.concat(F.lit(","), h), F.lit(r',(\s*"(?:[^"]|"")*"\s*|[^,]*)'), F.lit(1))
    return F.transform(parts, lambda c: F.when(
        c.rlike(r'^\s*".*"\s*$'),
        F.regexp_replace(F.regexp_replace(c, r'^\s*"|"\s*$', ""), '""', '"')).otherwise(c))


def stripped_columns(h: Column) -> Column:
    return F.transform(raw_columns(h), lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""))


def normalised_columns(h: Column) -> Column:
    return F.transform(raw_columns(h), lambda c: F.regexp_replace(
        F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"\s+", " "))


def _has_all(cols: Column, required) -> Column:
    return F.size(F.array_except(_lits(required), cols)) == 0


def format_expr(h: Column) -> Column:
    cols = stripped_columns(h)
    low = F.transform(cols, lambda c: F.lower(c))
    return (F.when(_has_all(cols, CHASE_REQUIRED), F.lit("chase"))
            .when(_has_all(cols, BOFA_REQUIRED) & F.array_contains(cols, BOFA_MARKER), F.lit("bofa"))
            .when(_has_all(low, PLAID_REQUIRED), F.lit("plaid"))
            .otherwise(F.lit("generic")))


def detect_formats(headers: DataFrame, header: str = "header") -> DataFrame:
    """Layout per file; bank layouts are tested first, in fixed order."""
    return headers.withColumn("format", format_expr(F.col(header)))


def _find(h: Column, variants) -> Column:
    """Original column whose normalised name equals the first (sorted)
    variant present; the last such column when names repeat."""
    norm = normalised_columns(h)
    pick = F.try_element_at(F.filter(_lits(sorted(variants)), lambda v: F.array_contains(norm, v)), F.lit(1))
    pos = F.size(norm) - F.array_position(F.reverse(norm), pick) + 1
    return F.when(pick.isNotNull(), F.try_element_at(raw_columns(h), pos.cast("int")))


def map_columns(headers: DataFrame, header: str = "header") -> DataFrame:
    h = F.col(header)
    return headers.withColumns({
        "date_col": _find(h, DATE_VARIANTS),
        "desc_col": _find(h, DESC_VARIANTS),
        "amount_col": _find(h, AMOUNT_VARIANTS),
        "debit_col": _find(h, DEBIT_VARIANTS),
        "credit_col": _find(h, CREDIT_VARIANTS),
    })


def _like_any(norm: Column, variants) -> Column:
    return F.filter(norm, lambda c: F.exists(_lits(sorted(variants)), lambda v: F.instr(c, v) > 0))


def header_ambiguities(headers: DataFrame, header: str = "header") -> DataFrame:
    """(file_path, kind, columns) warnings for generic files with data:
    several date-like or amount-like headers (substring match), and an amount
    column that takes precedence over debit/credit columns."""
    h = F.col(header)
    d = detect_formats(map_columns(headers, header), header)
    if "n_rows" in d.columns:
        d = d.where(F.col("n_rows") > 0)
    d = d.where(F.col("format") == "generic")
    norm = normalised_columns(h)
    dates = _like_any(norm, DATE_VARIANTS)
    amounts = _like_any(norm, AMOUNT_VARIANTS)
    warn = F.array(
        F.when(F.size(dates) > 1, F.struct(F.lit("date").alias("kind"), F.array_join(dates, ",").alias("columns"))),
        F.when(F.size(amounts) > 1,
               F.struct(F.lit("amount").alias("kind"), F.array_join(amounts, ",").alias("columns"))),
        F.when(F.col("amount_col").isNotNull() & (F.col("debit_col").isNotNull() | F.col("credit_col").isNotNull()),
               F.struct(F.lit("amount_precedence").alias("kind"), F.col("amount_col").alias("columns"))),
    )
    return (d.select("file_path", F.explode(F.filter(warn, lambda w: w.isNotNull())).alias("w"))
            .select("file_path", "w.kind", "w.columns"))


def reject_report(headers: DataFrame, header: str = "header") -> DataFrame:
    """(file_path, format, reason) for files that cannot be parsed; one bad
    file never fails the job, the good ones continue."""
    d = detect_formats(map_columns(headers, header), header)
    empty = (F.col("n_rows") == 0) if "n_rows" in d.columns else F.lit(False)
    generic = F.col("format") == "generic"
    reason = (F.when(empty, F.lit("CSV has no data rows"))
              .when(generic & F.col("date_col").isNull(), F.lit("Cannot detect a date column"))
              .when(generic & F.col("desc_col").isNull(), F.lit("Cannot detect a description column"))
              .when(generic & F.col("amount_col").isNull()
                    & (F.col("debit_col").isNull() | F.col("credit_col").isNull()),
                    F.lit("Cannot detect an amount column")))
    return d.select("file_path", "format", reason.alias("reason")).where(F.col("reason").isNotNull())
