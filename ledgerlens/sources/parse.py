"""Raw string frames -> standard transaction schema.

A raw frame is what a CSV scan yields: every column STRING plus the file it
came from.  Parsers are projections (no shuffle) except the occurrence index
that disambiguates identical lines inside one file.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.dates import parse_date
from ledgerlens.functions.ids import transaction_id
from ledgerlens.functions.money import combine_debit_credit, parse_amount, parse_number
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
from ledgerlens.operators.common import group_hash

STANDARD_COLUMNS = ("date", "description", "amount", "raw_description", "source", "transaction_id")


def validate(df: DataFrame) -> bool:
    """Whether ``df`` has every standard column and at least one row (reads one row)."""
    return set(STANDARD_COLUMNS) <= set(df.columns) and not df.isEmpty()
FILE_COL = "file_path"


def occurrence_index(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str] = (),
                     out: str = "occurrence", buckets: int = 1024) -> DataFrame:
    """0-based index of each row among rows with equal ``group_cols``.

    Identical lines can be a large share of one file, so a group is split
    into ``buckets`` by a hash of the whole row: count per (group, bucket),
    prefix-sum the counts per group (at most ``buckets`` rows per group), then
    number rows locally within (group, bucket).  The bucket is a function of
    the row's content, so every branch of the plan and every retry sees the
    same split whatever the partitioning.  Only rows equal in *every* column
    share a bucket.

    Rows are numbered where their (group, bucket) lies and take only offsets
    above 0 from the other side, few where most lines occur once: the rows are
    shuffled and sorted once.  The group is one struct, whose null fields are
    equal to each other, behind its hash, by which the sorts mostly decide.
    """
    salt, group, digest = "_ll_salt", "_ll_group", "_ll_hash"
    # Salt from the row's own content: the ordering columns when given (a line
    # number or row id identifies the row), else every column.
    salt_src = list(order_cols) or list(df.columns)
    d = df.withColumn(salt, F.pmod(F.xxhash64(*[F.col(c) for c in salt_src]), F.lit(buckets)))
    local_order = [F.col(c) for c in order_cols if c not in group_cols] or [F.lit(1)]
    d = d.select(group_hash(df, group_cols).alias(digest), F.struct(*group_cols).alias(group), salt,
                 *[F.col(c) for c in df.columns if c not in group_cols])
    counts = d.groupBy(digest, group, salt).agg(F.count(F.lit(1)).alias("_ll_n"))
    before = F.sum("_ll_n").over(Window.partitionBy(digest, group).orderBy(salt)) - F.col("_ll_n")
    offsets = counts.select(digest, group, salt, before.alias("_ll_off")).where(F.col("_ll_off") > 0)
    local = Window.partitionBy(digest, group, salt).orderBy(*local_order)
    rows = d.withColumn("_ll_local", F.row_number().over(local) - 1).join(offsets, [digest, group, salt], "left")
    cols = [F.col(f"{group}.{c}").alias(c) if c in group_cols else F.col(c) for c in df.columns]
    return rows.select(*cols, (F.col("_ll_local") + F.coalesce("_ll_off", F.lit(0))).cast("long").alias(out))


def with_transaction_id(df: DataFrame, date_text: str = "date_text", raw: str = "raw_description",
                        amount: str = "amount", file_cols: Sequence[str] = (FILE_COL,),
                        order_cols: Sequence[str] = ()) -> DataFrame:
    """Add ``transaction_id`` from the unparsed date text, raw text and amount,
    with the occurrence index among identical lines of the same file."""
    amount_key = F.coalesce(F.format_string("%.4f", F.col(amount)), F.lit("nan"))
    keyed = df.withColumn("_ll_amount_key", amount_key)
    occ = occurrence_index(keyed, [*file_cols, date_text, raw, "_ll_amount_key"], order_cols, "_ll_occ")
    return occ.withColumn(
        "transaction_id", transaction_id(F.col(date_text), F.col(raw), F.col(amount), F.col("_ll_occ"), F.col("_ll_amount_key"))
    ).drop("_ll_occ", "_ll_amount_key")


def _finalise(df: DataFrame, source: str, keep: Sequence[str]) -> DataFrame:
    """Standard columns with ids.  Lines that agree in every output column
    collapse to one row with their number (map-side, so a line that fills a
    third of a file is no skew), and the numbers unfold to occurrences.  Lines
    of one id text may still differ in the amount beyond its four digits; their
    occurrences follow each other by amount."""
    line = [*keep, "date_text", "raw_description", "_ll_amount_key"]
    rest = ["date_parsed", "description", "amount"]
    rows = df.withColumn("_ll_amount_key", F.coalesce(F.format_string("%.4f", F.col("amount")), F.lit("nan")))
    counted = rows.groupBy(*line, *rest).agg(F.count(F.lit(1)).alias("_ll_n"))
    upto = F.sum("_ll_n").over(Window.partitionBy(*line).orderBy("amount"))  # collapsed rows only
    occ = F.explode(F.sequence(F.col("_ll_upto") - F.col("_ll_n"), F.col("_ll_upto") - 1))
    d = counted.withColumn("_ll_upto", upto).withColumn("_ll_occ", occ)
    return d.select(*keep, F.col("date_parsed").alias("date"), "description", "amount", "raw_description",
                    F.lit(source).alias("source"),
                    transaction_id(F.col("date_text"), F.col("raw_description"), F.col("amount"), F.col("_ll_occ")).alias("transaction_id"))


def _desc(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def parse_chase(raw: DataFrame, keep: Sequence[str] = (FILE_COL,)) -> DataFrame:
    """Chase: date text inferred, signed Amount with ``$``/``,`` stripped."""
    d = raw.select(*keep,
                   F.col("`Transaction Date`").alias("date_text"),
                   _desc(F.col("Description")).alias("description"),
                   parse_amount(F.col("Amount")).alias("amount"))
    d = d.withColumn("raw_description", F.col("description")).withColumn("date_parsed", parse_date("date_text"))
    return _finalise(d, "chase", keep)


def parse_bofa(raw: DataFrame, keep: Sequence[str] = (FILE_COL,)) -> DataFrame:
    """BofA: month/day/year, one or two digits; the id uses the parsed date's text form."""
    parsed = F.try_to_timestamp(F.trim(F.col("Date")), F.lit("M/d/yyyy"))
    d = raw.select(*keep,
                   parsed.alias("date_parsed"),
                   _desc(F.col("Description")).alias("description"),
                   parse_amount(F.col("Amount")).alias("amount"))
    d = (d.withColumn("raw_description", F.col("description"))
          .withColumn("date_text", F.coalesce(F.date_format("date_parsed", "yyyy-MM-dd HH:mm:ss"), F.lit("NaT"))))
    return _finalise(d, "bofa", keep)


def parse_plaid(raw: DataFrame, keep: Sequence[str] = (FILE_COL,)) -> DataFrame:
    """Plaid: lower-case headers, pending rows dropped, sign flipped."""
    cols = {c.strip().lower(): c for c in raw.columns}
    r = raw
    if "pending" in cols:
        r = r.where(~F.lower(F.col(f"`{cols['pending']}`")).eqNullSafe("true"))
    d = r.select(*keep,
                 F.col(f"`{cols['date']}`").alias("date_text"),
                 _desc(F.col(f"`{cols['name']}`")).alias("description"),
                 (-parse_number(F.col(f"`{cols['amount']}`"))).alias("amount"))
    d = d.withColumn("raw_description", F.col("description")).withColumn("date_parsed", parse_date("date_text"))
    return _finalise(d, "plaid", keep)


@dataclass(frozen=True)
class ColumnMapping:
    date: str | None
    description: str | None
    amount: str | None = None
    debit: str | None = None
    credit: str | None = None


def generic_mapping(columns: Sequence[str]) -> ColumnMapping:
    """Columns of a generic header, as ``headers.map_columns`` picks them: the
    first variant in sorted order, the last of columns with equal names."""
    by_name = {re.sub(r"\s+", " ", c.strip().lower()): c for c in columns}

    def pick(variants: Sequence[str]) -> str | None:
        return min((v for v in by_name if v in variants), default=None)

    found = [pick(v) for v in (DATE_VARIANTS, DESC_VARIANTS, AMOUNT_VARIANTS, DEBIT_VARIANTS, CREDIT_VARIANTS)]
    return ColumnMapping(*[None if v is None else by_name[v] for v in found])


def parse_generic(raw: DataFrame, mapping: ColumnMapping | None = None,
                  keep: Sequence[str] = (FILE_COL,)) -> DataFrame:
    """Generic layout: fuzzy-mapped columns; amount wins over debit/credit."""
    m = mapping or generic_mapping([c for c in raw.columns if c not in keep])
    if m.date is None or m.description is None or (m.amount is None and (m.debit is None or m.credit is None)):
        raise ValueError(f"unmappable generic header: {raw.columns}")
    if m.amount is not None:
        amount = parse_amount(F.col(f"`{m.amount}`"), generic=True)
    else:
        amount = combine_debit_credit(parse_amount(F.col(f"`{m.debit}`"), generic=True),
                                      parse_amount(F.col(f"`{m.credit}`"), generic=True))
    d = raw.select(*keep,
                   F.col(f"`{m.date}`").alias("date_text"),
                   _desc(F.col(f"`{m.description}`")).alias("description"),
                   amount.alias("amount"))
    d = d.withColumn("raw_description", F.col("description")).withColumn("date_parsed", parse_date("date_text"))
    return _finalise(d, "generic", keep)


@dataclass(frozen=True)
class FormatSpec:
    """A bank layout: header test + projection to the standard schema."""
    name: str
    detect: Callable[[Sequence[str]], bool]
    parse: Callable[..., DataFrame]
    required: tuple[str, ...] = field(default=())


def _stripped(cols: Sequence[str]) -> set[str]:
    return {c.strip() for c in cols}


FORMATS: list[FormatSpec] = [
    FormatSpec("chase", lambda cols: set(CHASE_REQUIRED) <= _stripped(cols), parse_chase, CHASE_REQUIRED),
    FormatSpec("bofa", lambda cols: set(BOFA_REQUIRED) <= _stripped(cols) and BOFA_MARKER in _stripped(cols),
               parse_bofa, BOFA_REQUIRED),
    FormatSpec("plaid", lambda cols: set(PLAID_REQUIRED) <= {c.strip().lower() for c in cols},
               parse_plaid, PLAID_REQUIRED),
]
GENERIC = FormatSpec("generic", lambda cols: True, parse_generic)


def register_format(spec: FormatSpec, first: bool = False) -> None:
    """Plug-in point for new bank layouts: ``detect(columns) -> bool`` and
    ``parse(raw_df) -> standard frame``.  Layouts are tested in order (the
    generic layout is always last); ``first=True`` puts it before the banks."""
    if first:
        FORMATS.insert(0, spec)
    else:
        FORMATS.append(spec)


def format_for(columns: Sequence[str]) -> FormatSpec:
    for spec in FORMATS:
        if spec.detect(columns):
            return spec
    return GENERIC
