"""Description normalisation, de-duplication and calendar features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.dates import (
    MICROS_PER_DAY,
    day_number,
    day_of_week_name,
    is_weekend,
    micros,
    week_of_month,
)
from ledgerlens.functions.rules import NEAR_DUP_MAX_DAYS
from ledgerlens.functions.text import normalize_description
from ledgerlens.operators.common import Keys, group_hash


def normalize_descriptions(df: DataFrame, src: str = "description", out: str = "description",
                           with_category: bool = False) -> DataFrame:
    """Clean merchant text (optionally also the keyword category).

    The rules run row-wise inside whole-stage codegen: a narrow projection, so
    building the plan starts no job and the ledger is not shuffled.
    """
    from ledgerlens.operators.categorize import categorize_keywords

    out_df = df.withColumn(out, normalize_description(F.col(src)))
    return categorize_keywords(out_df, src=out) if with_category else out_df


def merchant_dimension(df: DataFrame, src: str = "raw_description") -> DataFrame:
    """Distinct raw strings with their clean form (the merchant dimension)."""
    return df.select(src).distinct().withColumn("description", normalize_description(F.col(src)))


def dedup_exact(df: DataFrame, keys: Keys = (), id_col: str = "transaction_id",
                order: tuple[str, ...] = ("date", "source", "raw_description")) -> DataFrame:
    """Keep one row per (keys, id): the first by ``order`` then every column.

    A hash aggregate with map-side partial aggregation, so a hot id (many
    copies of one line) collapses before the shuffle.
    """
    cols = df.columns
    order_cols = [c for c in order if c in cols] + [c for c in cols if c not in order]
    rank = F.struct(*[F.col(c) for c in order_cols])
    rows = F.struct(*[F.col(c) for c in cols])
    return (df.groupBy(*keys, id_col).agg(F.min_by(rows, rank).alias("_ll_row"))
            .select("_ll_row.*"))


def dedup_near(df: DataFrame, keys: Keys = (), window_days: int = 2, id_col: str = "transaction_id") -> DataFrame:
    """Drop a row when the previous row with the same (keys, description,
    amount) — in (date, id) order — is at most ``window_days`` days earlier.

    With a window of at least one day every row after the first of a UTC day
    has a predecessor less than a day back, so only the first row of each
    (group, day) can survive, and it survives iff the last row of the previous
    non-empty day is more than the window away.  That is one partial-aggregated
    ``groupBy`` plus a ``lag`` over days (bounded by the calendar), never a
    window over a whole (possibly huge) merchant group.  NULL dates are kept.
    """
    if not 0 <= window_days <= NEAR_DUP_MAX_DAYS:
        raise ValueError(f"near_dup_window_days must be between 0 and {NEAR_DUP_MAX_DAYS}, got {window_days}")
    if window_days == 0:
        return df
    cols = df.columns
    group = [*keys, "description", "amount"]
    # Text and whole-number keys need not travel twice.  Floating-point ones are
    # kept in the row: groups hold 0.0 and -0.0 as one value.
    plain = [c for c in (*keys, "description") if df.schema[c].dataType.typeName() in ("string", "byte", "short", "integer", "long")]
    rows = F.struct(*[F.col(c) for c in cols if c not in plain])
    # NULL-date rows are always kept: each becomes its own group (keyed by its
    # id) and its own window.
    undated = F.when(F.col("date").isNull(), F.col(id_col))
    first_of_day = (
        df.groupBy(group_hash(df, group).alias("_ll_hash"), day_number(F.col("date")).alias("_ll_day"), *group, undated.alias("_ll_undated"))
        .agg(F.min_by(rows, F.struct("date", id_col)).alias("_ll_row"), F.max("date").alias("_ll_last"))
    )
    prev = F.lag("_ll_last").over(Window.partitionBy("_ll_hash", *group, "_ll_undated").orderBy("_ll_day"))
    limit = window_days * MICROS_PER_DAY
    return (first_of_day.withColumn("_ll_prev", prev)
            .where(F.col("_ll_prev").isNull() | F.col("_ll_row.date").isNull()
                   | ((micros(F.col("_ll_row.date")) - micros(F.col("_ll_prev"))) > limit))
            .select(*[F.col(c if c in plain else f"_ll_row.`{c}`").alias(c) for c in cols]))


def deduplicate(df: DataFrame, near_dup_window_days: int = 2, keys: Keys = (),
                ids_unique: bool = False) -> DataFrame:
    """Exact duplicates by transaction id, then near duplicates.

    ``ids_unique=True`` states that ids were just assigned per key with the
    occurrence index (so no two rows of a key share one) and skips the exact
    pass, which would be a no-op shuffle.  Frames unioned from several
    sources or loads must keep the default."""
    if not 0 <= near_dup_window_days <= NEAR_DUP_MAX_DAYS:
        raise ValueError(
            f"near_dup_window_days must be between 0 and {NEAR_DUP_MAX_DAYS}, got {near_dup_window_days}")
    exact = df if ids_unique else dedup_exact(df, keys)
    return dedup_near(exact, keys, near_dup_window_days)


def normalize_dates(df: DataFrame) -> DataFrame:
    """day_of_week, week_of_month, is_weekend, hour (UTC)."""
    d = F.col("date")
    return df.withColumns({
        "day_of_week": day_of_week_name(d),
        "week_of_month": week_of_month(d),
        "is_weekend": is_weekend(d),
        "hour": F.hour(d),
    })
