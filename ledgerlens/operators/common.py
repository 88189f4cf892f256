"""Helpers shared by operators: key handling, skew-safe ordering primitives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.dates import day_number
from ledgerlens.plans.materialize import materialize

Keys = Sequence[str]


def expenses(df: DataFrame) -> DataFrame:
    return df.where(F.col("amount") < 0)


def income(df: DataFrame) -> DataFrame:
    return df.where(F.col("amount") > 0)


def require_columns(df: DataFrame, *cols: str) -> bool:
    return all(c in df.columns for c in cols)


def key_cols(keys: Keys) -> list[Column]:
    return [F.col(k) for k in keys]


def group_hash(df: DataFrame, cols: Keys) -> Column:
    """A number that leads the sort of groups by ``cols`` and mostly decides it.
    Only columns whose equal values have equal bits enter: 0.0 and -0.0 are one
    group."""
    plain = {"string", "boolean", "byte", "short", "integer", "long", "date", "timestamp", "timestamp_ntz", "decimal"}
    hashed = [c for c in cols if df.schema[c].dataType.typeName() in plain]
    return F.xxhash64(*hashed) if hashed else F.lit(0).cast("long")


def join_on_keys(left: DataFrame, right: DataFrame, keys: Keys, how: str = "inner") -> DataFrame:
    """Equi-join on ``keys``; with no keys the right side is one row (a global
    aggregate) and is attached with a constant-key join."""
    if keys:
        return left.join(right, list(keys), how)
    # Global aggregate: exactly one row, so the broadcast size is bounded.
    one = "_ll_one"
    return (left.withColumn(one, F.lit(0))
            .join(F.broadcast(right.withColumn(one, F.lit(0))), one, how).drop(one))


def prev_in_order(df: DataFrame, keys: Keys, ts: str, tiebreak: str, out: str) -> DataFrame:
    """``lag(ts)`` over (keys) ordered by (ts, tiebreak), without a window over rows.

    Rows after the first of a moment have that moment before them.  The first
    one, which has the least ``tiebreak`` (unique per key), takes the key's
    previous moment, found among the distinct moments: an aggregate with
    map-side combine, so any number of rows of one moment or day is no skew.
    Distinct moments are ordered inside (keys, UTC day); a day's first moment
    takes the last one of the previous day that has any.  NULL timestamps get
    NULL.
    """
    day, first, before = "_ll_day", "_ll_first", "_ll_before"
    moments = (df.where(F.col(ts).isNotNull()).groupBy(*keys, ts).agg(F.min(tiebreak).alias(first))
               .withColumn(day, day_number(F.col(ts))))
    moments = moments.withColumn(before, F.lag(ts).over(Window.partitionBy(*keys, day).orderBy(ts)))
    days = moments.groupBy(*keys, day).agg(F.max(ts).alias("_ll_last"))
    days = (days.withColumn("_ll_day_before", F.lag("_ll_last").over(Window.partitionBy(*keys).orderBy(day)))
            .drop("_ll_last"))
    moments = (moments.join(days, [*keys, day]).withColumn(before, F.coalesce(before, "_ll_day_before"))
               .select(*keys, ts, first, before))
    joined = df.join(moments, [*keys, ts], "left")
    return (joined.withColumn(out, F.when(F.col(tiebreak) == F.col(first), F.col(before)).when(F.col(first).isNotNull(), F.col(ts)))
            .select(*df.columns, out))


def optional_columns(df: DataFrame, **types: str) -> DataFrame:
    """Add the named columns as NULL where ``df`` lacks them."""
    return df.select("*", *(F.lit(None).cast(t).alias(c) for c, t in types.items() if c not in df.columns))


def top_k(df: DataFrame, keys: Keys, order: Sequence[Column], k: int, salt_col: str | None = None,
          buckets: int = 1024, rank_col: str | None = None) -> DataFrame:
    """Rows with the ``k`` smallest ``order`` per key (``order`` must be total).

    Two rounds so a hot key is never ranked in one task: top-k within
    (keys, salt bucket), then top-k of those survivors (≤ k·buckets per key).
    Without keys this is a distributed take-ordered.
    """
    if not keys:
        out = df.orderBy(*order).limit(k)
        if rank_col:
            out = out.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))
        return out
    if salt_col is not None:
        salt = F.pmod(F.xxhash64(F.col(salt_col)), F.lit(buckets))
        first = Window.partitionBy(*keys, salt).orderBy(*order)
        df = df.withColumn("_ll_r", F.row_number().over(first)).where(F.col("_ll_r") <= k).drop("_ll_r")
    final = Window.partitionBy(*keys).orderBy(*order)
    name = rank_col or "_ll_rank"
    out = df.withColumn(name, F.row_number().over(final)).where(F.col(name) <= k)
    return out if rank_col else out.drop(name)


def global_position(df: DataFrame, order: Sequence[Column | str], out: str) -> DataFrame:
    """0-based position of every row in a total ``order``, without one task
    that sees all rows: range partitions are sorted and numbered, and each
    adds the rows of the partitions before it (one count per partition)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Partition * 2^33 + position in it; written once, so both reads see one numbering.
    placed = materialize(df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                         .withColumn("_ll_place", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("_ll_place", 33).alias("_ll_part")
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_ll_n"))
    before = F.coalesce(F.sum("_ll_n").over(Window.orderBy("_ll_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_ll_part", before.alias("_ll_before"))  # one row per partition
    inside = F.col("_ll_place") - F.shiftleft(F.col("_ll_part"), 33)
    return (placed.withColumn("_ll_part", part).join(F.broadcast(sizes), "_ll_part")
            .withColumn(out, F.col("_ll_before") + inside).drop("_ll_place", "_ll_part", "_ll_before"))


def exact_quantile(df: DataFrame, keys: Keys, col: str, q: float, out: str = "quantile",
                   accuracy: int = 10_000, buckets: int = 4096) -> DataFrame:
    """Exact linear-interpolation quantile per key (numpy/``quantile_cont``
    semantics) without holding a key's values in one aggregation buffer.

    1. A mergeable sketch (``percentile_approx``, rank error <= n/accuracy)
       brackets the quantile per key, three errors wide on each side.
    2. One pass counts the rows below the bracket and keeps the values next to
       it (largest below, smallest above); rows inside are reduced to
       (value, count) — at most about 6·n/accuracy distinct values per key,
       ties included.  The brackets and this table are written once, so the
       rows are joined with their bracket once and no task holds the sorts and
       tables of all steps together.
    3. Those values fall into ``buckets`` equal parts of the bracket; a running
       count over the parts finds the one or two that hold the ranks
       floor((n-1)q) and ceil((n-1)q), and a running count over the values of
       these alone the order statistics, which are interpolated.  So no window
       holds all of a key's values.  With b the
       bracket's lower rank, floor((n-1)q) >= b-1, and likewise above, so a
       rank outside the bracket is always one of the two neighbours.
    """
    if not 0.0 <= q <= 1.0:
        raise ValueError(f"quantile must be in [0, 1], got {q}")
    x = F.col(col)
    width = 3.0 / accuracy
    lo_q, hi_q = max(0.0, q - width), min(1.0, q + width)
    base = df.where(x.isNotNull()) if keys else df.where(x.isNotNull()).withColumn("_ll_one", F.lit(0))
    kk = list(keys) or ["_ll_one"]
    bounds = base.groupBy(*kk).agg(
        F.count(F.lit(1)).alias("_ll_n"),
        F.percentile_approx(x, F.array(F.lit(lo_q), F.lit(hi_q)), F.lit(accuracy)).alias("_ll_b"),
        F.min(x).alias("_ll_min"), F.max(x).alias("_ll_max"))
    lo_b = F.lit(lo_q) == 0.0
    hi_b = F.lit(hi_q) == 1.0
    bounds = materialize(bounds.select(*kk, "_ll_n",
                                       F.when(lo_b, F.col("_ll_min")).otherwise(F.col("_ll_b")[0]).alias("_ll_lo"),
                                       F.when(hi_b, F.col("_ll_max")).otherwise(F.col("_ll_b")[1]).alias("_ll_hi")), "quantile-brackets")
    j = base.select(*kk, x.alias("_ll_x")).join(bounds, kk)
    zone = F.when(F.col("_ll_x") < F.col("_ll_lo"), -1).when(F.col("_ll_x") > F.col("_ll_hi"), 1).otherwise(0)
    under, within, over = (F.col("_ll_zone") == z for z in (-1, 0, 1))
    # Order-preserving buckets of equal width across the bracket.
    value, low, high = (F.col(c).cast("double") for c in ("_ll_x", "_ll_lo", "_ll_hi"))
    share = F.try_divide(value - low, high - low) * buckets
    finite = (high - low > 0) & (high - low < float("inf"))  # else one bucket
    bucket = F.when(finite, F.least(F.floor(share), F.lit(buckets - 1))).otherwise(F.lit(0)).cast("int")
    parts = (j.withColumn("_ll_zone", zone)
             .groupBy(*kk, "_ll_n", "_ll_zone", F.when(within, bucket).alias("_ll_bucket"), F.when(within, F.col("_ll_x")).alias("_ll_value"))
             .agg(F.count(F.lit(1)).alias("_ll_c"), F.min("_ll_x").alias("_ll_least"), F.max("_ll_x").alias("_ll_most")))
    parts = materialize(parts, "quantile-parts")

    def rows_in(zones: Column) -> Column:
        return F.coalesce(F.sum(F.when(zones, F.col("_ll_c"))), F.lit(0))
    known = parts.groupBy(*kk, "_ll_n").agg(rows_in(under).alias("_ll_below"), rows_in(~over).alias("_ll_upto"),
                                            F.max(F.when(under, F.col("_ll_most"))).alias("_ll_left"),
                                            F.min(F.when(over, F.col("_ll_least"))).alias("_ll_right"))
    inside = parts.where(within).select(*kk, "_ll_bucket", F.col("_ll_value").alias("_ll_x"), "_ll_c")
    pos = (F.col("_ll_n") - 1) * F.lit(q)
    r_lo = F.floor(pos)
    r_hi = F.ceil(pos)

    def holds(rank: Column) -> Column:
        return (F.col("_ll_start") <= rank) & (rank < F.col("_ll_end"))

    def running(part: Sequence[str], order: str) -> Column:
        return F.sum("_ll_c").over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # At most ``buckets`` rows per key, of which one or two hold a rank.
    hit = (inside.groupBy(*kk, "_ll_bucket").agg(F.sum("_ll_c").alias("_ll_c"))
           .withColumn("_ll_end", running(kk, "_ll_bucket")).join(known.select(*kk, "_ll_n", "_ll_below"), kk)
           .withColumn("_ll_end", F.col("_ll_end") + F.col("_ll_below"))   # ranks < _ll_end
           .withColumn("_ll_start", F.col("_ll_end") - F.col("_ll_c"))
           .where(holds(r_lo) | holds(r_hi)).select(*kk, "_ll_bucket", "_ll_n", F.col("_ll_start").alias("_ll_first")))
    ranked = (inside.join(hit, [*kk, "_ll_bucket"])
              .withColumn("_ll_end", running([*kk, "_ll_bucket"], "_ll_x") + F.col("_ll_first"))
              .withColumn("_ll_start", F.col("_ll_end") - F.col("_ll_c")))
    found = ranked.groupBy(*kk).agg(F.max(F.when(holds(r_lo), F.col("_ll_x"))).alias("_ll_vlo"),
                                    F.max(F.when(holds(r_hi), F.col("_ll_x"))).alias("_ll_vhi"))
    picked = known.join(found, kk, "left")
    for v, r in (("_ll_vlo", r_lo), ("_ll_vhi", r_hi)):
        picked = picked.withColumn(v, F.when(r < F.col("_ll_below"), F.col("_ll_left"))
                                   .when(r >= F.col("_ll_upto"), F.col("_ll_right")).otherwise(F.col(v)))
    frac = (F.col("_ll_n") - 1) * F.lit(q) - F.floor((F.col("_ll_n") - 1) * F.lit(q))
    res = picked.select(*kk, (F.col("_ll_vlo") + (F.col("_ll_vhi") - F.col("_ll_vlo")) * frac).alias(out))
    return res if keys else res.drop("_ll_one")
