"""Behavioural detectors.  Each is filter + aggregate + threshold + headline,
returning one typed row per (key, finding)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.dates import MICROS_PER_DAY, day_number, micros, month_label, week_label
from ledgerlens.functions.money import exact_sum, round_half_up
from ledgerlens.functions.rules import FOOD_DINING, SEVERITY_ORDER, SUBSCRIPTIONS
from ledgerlens.operators.common import Keys, expenses, prev_in_order, optional_columns

#: Columns a detector may do without; where they are missing it finds nothing.
OPTIONAL = {"category": "string", "hour": "int", "is_weekend": "boolean"}


def _is_exp():
    return F.col("amount") < 0


def _pct0(x):
    """Whole percent text of a ratio (e.g. 0.37 -> '37%')."""
    return F.concat(F.format_string("%.0f", round_half_up(x * 100.0, 0)), F.lit("%"))


def _f(fmt, x, digits):
    return F.format_string(fmt, round_half_up(x, digits))


def _late_aggs():
    food = (F.col("category") == FOOD_DINING) & _is_exp()
    late = food & ((F.col("hour") >= 22) | (F.col("hour") < 4))
    return [
        (F.min("hour") != F.max("hour")).alias("_ll_hours"),
        F.count_if(food).alias("total_food_transactions"),
        F.count_if(late).alias("late_night_transaction_count"),
        exact_sum(F.abs("amount"), late).alias("late_night_total"),
    ]


def _late_finish(g: DataFrame, keys: Keys) -> DataFrame:
    pct = F.try_divide(F.col("late_night_transaction_count"), F.col("total_food_transactions"))
    return (g.where(F.col("_ll_hours") & (F.col("total_food_transactions") > 0) & (pct >= 0.15))
            .select(*keys, F.lit("LATE_NIGHT_SPENDING").alias("type"),
                    F.concat(_pct0(pct), F.lit(" of food spend happens after 10 PM")).alias("headline"),
                    F.lit("info").alias("severity"),
                    "late_night_transaction_count", "total_food_transactions", "late_night_total",
                    round_half_up(pct * 100.0, 1).alias("percentage")))


def late_night_spending(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """Share of food_dining expense rows at hour >= 22 or < 4 is >= 15 %,
    provided the ledger has more than one distinct hour (time of day known)."""
    df = optional_columns(df, **OPTIONAL)
    return _late_finish(df.groupBy(*keys).agg(*_late_aggs()), keys)


def _subs_aggs():
    sub = _is_exp() & (F.col("category") == SUBSCRIPTIONS)
    return [F.sort_array(F.collect_set(F.when(sub, F.col("description")))).alias("subscriptions"),
            exact_sum(F.abs("amount"), sub).alias("total_spend")]


def _subs_finish(g: DataFrame, keys: Keys, max_subscriptions: int = 5) -> DataFrame:
    g = g.withColumn("subscription_count", F.size("subscriptions"))
    return (g.where(F.col("subscription_count") > max_subscriptions)
            .select(*keys, F.lit("SUBSCRIPTION_CREEP").alias("type"),
                    F.format_string("%d active subscriptions totalling $%.2f",
                                    F.col("subscription_count"), F.col("total_spend")).alias("headline"),
                    F.lit("warning").alias("severity"),
                    "subscription_count", "subscriptions", "total_spend"))


def subscription_creep(df: DataFrame, keys: Keys = (), max_subscriptions: int = 5) -> DataFrame:
    """More than ``max_subscriptions`` distinct subscription merchants."""
    df = optional_columns(df, **OPTIONAL)
    return _subs_finish(df.groupBy(*keys).agg(*_subs_aggs()), keys, max_subscriptions)


def _weekend_aggs():
    e = _is_exp()
    wk = F.col("is_weekend")
    return [exact_sum(F.abs("amount"), e & wk).alias("_ll_ws"),
            F.count_if(e & wk).alias("_ll_wn"),
            exact_sum(F.abs("amount"), e & ~wk).alias("_ll_ds"),
            F.count_if(e & ~wk).alias("_ll_dn")]


def _weekend_finish(g: DataFrame, keys: Keys, threshold: float = 1.3) -> DataFrame:
    wavg = F.try_divide(F.col("_ll_ws"), F.col("_ll_wn"))
    davg = F.try_divide(F.col("_ll_ds"), F.col("_ll_dn"))
    g = (g.where((F.col("_ll_wn") > 0) & (F.col("_ll_dn") > 0))
         .withColumn("_ll_wavg", wavg).withColumn("_ll_davg", davg)
         .withColumn("_ll_ratio", F.when(F.col("_ll_davg") > 0, F.try_divide(F.col("_ll_wavg"), F.col("_ll_davg")))
                     .otherwise(F.lit(1.0))))
    r = F.col("_ll_ratio")
    return (g.where(r >= threshold)
            .select(*keys, F.lit("WEEKEND_SPLURGE").alias("type"),
                    F.concat(F.lit("Weekend spend is "), _f("%.1f", r, 1), F.lit("x higher than weekdays"))
                    .alias("headline"),
                    F.when(r < 2.0, F.lit("info")).otherwise(F.lit("warning")).alias("severity"),
                    round_half_up(F.col("_ll_wavg"), 2).alias("weekend_avg"),
                    round_half_up(F.col("_ll_davg"), 2).alias("weekday_avg"),
                    round_half_up(r, 2).alias("ratio")))


def weekend_splurge(df: DataFrame, keys: Keys = (), threshold: float = 1.3) -> DataFrame:
    """Mean |amount| per weekend expense vs per weekday expense."""
    df = optional_columns(df, **OPTIONAL)
    return _weekend_finish(df.groupBy(*keys).agg(*_weekend_aggs()), keys, threshold)


def merchant_dominance(df: DataFrame, keys: Keys = (), share: float = 0.25) -> DataFrame:
    """Merchants holding more than ``share`` of their category's spend."""
    df = optional_columns(df, **OPTIONAL)
    m = (expenses(df).where(F.col("category").isNotNull())
         .groupBy(*keys, "category", "description")
         .agg(exact_sum(F.col("amount")).alias("_ll_m")))
    # One row per (key, category, merchant): the category window is small.
    w = Window.partitionBy(*keys, "category")
    m = (m.withColumn("_ll_cat", F.abs(exact_sum(F.col("_ll_m"), over=w)))
          .withColumn("amount", F.abs("_ll_m")))
    pct = F.try_divide(F.col("amount"), F.col("_ll_cat"))
    return (m.where((F.col("_ll_cat") != 0) & (pct > share))
            .select(*keys, F.lit("SINGLE_MERCHANT_DOMINANCE").alias("type"),
                    F.concat(F.col("description"), F.lit(" is "), _pct0(pct), F.lit(" of your "),
                             F.col("category"), F.lit(" spend")).alias("headline"),
                    F.lit("info").alias("severity"),
                    F.col("description").alias("merchant"), "category", "amount",
                    F.col("_ll_cat").alias("category_total"),
                    round_half_up(pct * 100.0, 1).alias("percentage")))


def anomalous_week(df: DataFrame, keys: Keys = (), factor: float = 1.5) -> DataFrame:
    """The top week (earliest on ties) when it is >= factor x the weekly mean."""
    weeks = (expenses(df).groupBy(*keys, week_label(F.col("date")).alias("week"))
             .agg(exact_sum(F.col("amount")).alias("_ll_w")))
    # max week with earliest label on ties: order by (total desc, week asc)
    best = F.min_by(F.struct(F.abs("_ll_w").alias("v"), F.col("week").alias("w")),
                    F.struct((-F.abs("_ll_w")).alias("nv"), F.col("week").alias("w")))
    g = weeks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_ll_n"),
        F.abs(exact_sum(F.col("_ll_w"))).alias("_ll_tot"),
        best.alias("_ll_best"),
    )
    avg = F.try_divide(F.col("_ll_tot"), F.col("_ll_n"))
    mx = F.col("_ll_best.v")
    g = g.withColumn("_ll_avg", avg)
    return (g.where((F.col("_ll_n") >= 2) & ~(mx < F.col("_ll_avg") * factor))
            .select(*keys, F.lit("ANOMALOUS_WEEK").alias("type"),
                    F.concat(F.lit("Week of "), F.col("_ll_best.w"), F.lit(" was "),
                             _f("%.1f", F.try_divide(mx, F.col("_ll_avg")), 1), F.lit("x your typical week")).alias("headline"),
                    F.lit("warning").alias("severity"),
                    F.col("_ll_best.w").alias("anomalous_week"),
                    round_half_up(mx, 2).alias("week_total"),
                    round_half_up(F.col("_ll_avg"), 2).alias("weekly_average"),
                    round_half_up(F.try_divide(mx, F.col("_ll_avg")), 2).alias("multiplier")))


def income_gaps(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """Income rows with the whole-day gap to the previous deposit."""
    inc = df.where(F.col("amount") > 0)
    inc = prev_in_order(inc, keys, "date", "transaction_id", "_ll_prev")
    gap = F.floor((micros(F.col("date")) - micros(F.col("_ll_prev"))) / MICROS_PER_DAY)
    return inc.withColumn("gap_days", gap).drop("_ll_prev")


def income_irregularity(df: DataFrame, keys: Keys = (), min_deposits: int = 3,
                        min_std_days: float = 5.0) -> DataFrame:
    """At least ``min_deposits`` deposits whose day gaps have a sample standard
    deviation of at least ``min_std_days``.  Gap moments use exact integer sums,
    so the threshold test does not depend on summation order."""
    if "category" not in df.columns:
        df = df.limit(0)
    g = income_gaps(df, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("income_events"),
        F.count("gap_days").alias("_ll_m"),
        F.sum("gap_days").alias("_ll_s1"),
        F.sum(F.col("gap_days") * F.col("gap_days")).alias("_ll_s2"),
    )
    m, s1, s2 = F.col("_ll_m"), F.col("_ll_s1"), F.col("_ll_s2")
    num = m * s2 - s1 * s1                       # exact: (m-1)·m·var
    std = F.sqrt(F.try_divide(num.cast("double"), (m * (m - 1)).cast("double")))
    avg = F.try_divide(s1.cast("double"), m)
    return (g.where((F.col("income_events") >= min_deposits) & (m >= 2)
                    & (num >= F.lit(min_std_days * min_std_days) * m * (m - 1)))
            .select(*keys, F.lit("INCOME_IRREGULARITY").alias("type"),
                    F.concat(F.lit("Income arrives every "), _f("%.0f", avg, 0), F.lit(" days on average (±"),
                             _f("%.0f", std, 0), F.lit(" days)")).alias("headline"),
                    F.lit("info").alias("severity"),
                    "income_events",
                    round_half_up(avg, 1).alias("avg_gap_days"),
                    round_half_up(std, 1).alias("std_gap_days")))


def income_deposits(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """The deposits behind an income finding with their position (0, 1, ...) in
    date order, as rows: a list per account would put a whole account into one
    value, and a window over it into one task.

    Positions come from the account's days: deposits before the day, plus the
    place inside the day.
    """
    flagged = income_irregularity(df, keys).select(*keys)
    inc = df.where(F.col("amount") > 0).select(*keys, "date", "transaction_id", "amount")
    one = F.lit(0).alias("_ll_one")  # with no keys the finding is one row or none
    inc = inc.join(flagged, list(keys), "left_semi") if keys else inc.select("*", one).join(flagged.select(one), "_ll_one", "left_semi").drop("_ll_one")
    inc = inc.withColumn("_ll_day", F.coalesce(day_number(F.col("date")).cast("long"), F.lit(1 << 62)))  # undated last
    days = inc.groupBy(*keys, "_ll_day").agg(F.count(F.lit(1)).alias("_ll_n"))
    upto = F.sum("_ll_n").over(Window.partitionBy(*keys).orderBy("_ll_day"))
    days = days.select(*keys, "_ll_day", (upto - F.col("_ll_n")).alias("_ll_before"))
    placed = inc.join(days, [*keys, "_ll_day"])
    inside = F.row_number().over(Window.partitionBy(*keys, "_ll_day").orderBy("date", "transaction_id")) - 1
    return placed.withColumn("position", (F.col("_ll_before") + inside).cast("long")).drop("_ll_day", "_ll_before")


def recurring_forgotten(df: DataFrame, keys: Keys = (), min_months: int = 2) -> DataFrame:
    """Non-subscription expenses with the same (merchant, amount) in at least
    ``min_months`` distinct calendar months.  Two partial aggregates instead of
    a distinct-count: (group, month) first, then count months per group."""
    if "category" not in df.columns:  # without categories nothing is known to be no subscription
        df = df.limit(0)
    e = optional_columns(df, **OPTIONAL).where(_is_exp() & ~F.col("category").eqNullSafe(SUBSCRIPTIONS))
    months = e.groupBy(*keys, "description", "amount", month_label(F.col("date")).alias("_ll_month")).agg(
        F.count(F.lit(1)).alias("_ll_c"))
    g = months.groupBy(*keys, "description", "amount").agg(F.count(F.lit(1)).alias("months_seen"))
    return (g.where(F.col("months_seen") >= min_months)
            .select(*keys, F.lit("RECURRING_FORGOTTEN").alias("type"),
                    F.concat(F.lit("Possible forgotten recurring: "), F.col("description"),
                             F.format_string(" at $%.2f/month", F.abs("amount"))).alias("headline"),
                    F.lit("info").alias("severity"),
                    F.col("description").alias("merchant"), "amount", "months_seen"))


def _as_pattern(d: DataFrame, keys: Keys, order: int) -> DataFrame:
    data_cols = [c for c in d.columns if c not in (*keys, "type", "headline", "severity")]
    data = F.to_json(F.struct(*data_cols)) if data_cols else F.lit("{}")
    return d.select(*keys, "type", "headline", "severity", data.alias("data"),
                    F.lit(order).alias("detector_order"))


def detect_patterns(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """Union of every detector, in the fixed detector order, with the
    severity rank (critical < warning < info) for presentation."""
    # Late-night, subscription and weekend detectors are per-key scalars:
    # one aggregate pass feeds all three instead of three scans and shuffles.
    g = optional_columns(df, **OPTIONAL).groupBy(*keys).agg(*_late_aggs(), *_subs_aggs(), *_weekend_aggs())
    parts = [_late_finish(g, keys), _subs_finish(g, keys),
             _weekend_finish(g, keys), merchant_dominance(df, keys), anomalous_week(df, keys),
             income_irregularity(df, keys), recurring_forgotten(df, keys)]
    out = None
    for i, p in enumerate(parts):
        p = _as_pattern(p, keys, i)
        out = p if out is None else out.unionByName(p)
    rank = None
    for name, r in SEVERITY_ORDER:
        rank = F.when(F.col("severity") == name, r) if rank is None else rank.when(F.col("severity") == name, r)
    return out.withColumn("severity_rank", rank.otherwise(99))
