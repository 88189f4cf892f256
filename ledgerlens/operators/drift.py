"""Period-over-period drift: categories, merchants, subscriptions, velocity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.dates import micros
from ledgerlens.functions.money import exact_sum, round_half_up
from ledgerlens.functions.rules import DRIFT_HINTS, SUBSCRIPTIONS
from ledgerlens.operators.common import Keys, expenses, join_on_keys, optional_columns, top_k


def _check(threshold: float) -> None:
    if not 0.0 <= threshold <= 1.0:
        raise ValueError(f"drift_threshold must be between 0.0 and 1.0, got {threshold}")


def category_totals(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """|sum| of expenses per category; none without a category column."""
    df = optional_columns(df, category="string")
    return (expenses(df).where(F.col("category").isNotNull()).groupBy(*keys, "category")
            .agg(F.abs(exact_sum(F.col("amount"))).alias("total")))


def category_drift(cur: DataFrame, prev: DataFrame, keys: Keys = (), threshold: float = 0.20) -> DataFrame:
    """Categories whose spend rose / fell by more than ``threshold``; a
    category with no previous spend is 'increased' with NULL change_pct."""
    _check(threshold)
    c = category_totals(cur, keys).withColumnRenamed("total", "_ll_c")
    p = category_totals(prev, keys).withColumnRenamed("total", "_ll_p")
    j = c.join(p, [*keys, "category"], "full_outer")
    cv = F.coalesce("_ll_c", F.lit(0.0))
    pv = F.coalesce("_ll_p", F.lit(0.0))
    change = F.try_divide(cv - pv, F.abs(pv))
    pct = round_half_up(change * 100.0, 1)
    j = (j.withColumn("current", round_half_up(cv, 2)).withColumn("previous", round_half_up(pv, 2))
          .withColumn("change_pct", F.when(pv != 0, pct))
          .withColumn("direction", F.when((pv == 0) & (cv > 0), F.lit("increased"))
                      .when((pv != 0) & (change > threshold), F.lit("increased"))
                      .when((pv != 0) & (change < -threshold), F.lit("decreased"))))
    hint = (F.when(F.col("change_pct").isNull(),
                   F.concat(F.col("category"), F.lit(" is new this period ($"), F.col("current").cast("string"), F.lit(")")))
            .when(F.col("direction") == "increased",
                  F.concat(F.col("category"), F.lit(" spending rose "), F.col("change_pct").cast("string"),
                           F.lit("% ($"), F.col("previous").cast("string"), F.lit(" → $"),
                           F.col("current").cast("string"), F.lit(")")))
            .otherwise(F.concat(F.col("category"), F.lit(" spending fell "), F.abs("change_pct").cast("string"),
                                F.lit("% ($"), F.col("previous").cast("string"), F.lit(" → $"),
                                F.col("current").cast("string"), F.lit(")"))))
    return (j.where(F.col("direction").isNotNull())
            .select(*keys, "category", "direction", "current", "previous", "change_pct", hint.alias("hint")))


def _set_drift(cur: DataFrame, prev: DataFrame, keys: Keys, added: str, removed: str) -> DataFrame:
    c = cur.select(*keys, "description").distinct()
    p = prev.select(*keys, "description").distinct()
    on = [*keys, "description"]
    return (c.join(p, on, "left_anti").withColumn("change", F.lit(added))
            .unionByName(p.join(c, on, "left_anti").withColumn("change", F.lit(removed)))
            .withColumnRenamed("description", "merchant"))


def merchant_drift(cur: DataFrame, prev: DataFrame, keys: Keys = ()) -> DataFrame:
    """Merchants (any sign) only in the current period ('new') or only in the
    previous one ('dropped')."""
    return _set_drift(cur, prev, keys, "new", "dropped")


def subscription_drift(cur: DataFrame, prev: DataFrame, keys: Keys = ()) -> DataFrame:
    """Subscription merchants that appeared ('new') or disappeared ('cancelled')."""
    sub = F.col("category") == SUBSCRIPTIONS
    cur, prev = (optional_columns(x, category="string") for x in (cur, prev))
    return _set_drift(cur.where(sub), prev.where(sub), keys, "new", "cancelled")


def drift_hints(cur: DataFrame, prev: DataFrame, keys: Keys = (), merchants: int = 5) -> DataFrame:
    """(keys, kind, hint): one hint naming the first ``merchants`` new merchants
    by name, and one for each new or cancelled subscription (a row each, so no
    list grows with the ledger).  Null names give none; category hints come
    from :func:`category_drift`."""
    new = merchant_drift(cur, prev, keys).where("change = 'new' AND merchant IS NOT NULL")
    named = (top_k(new, keys, [F.col("merchant")], merchants, salt_col="merchant").groupBy(*keys)
             .agg(F.array_join(F.sort_array(F.collect_list("merchant")), ", ").alias("_ll_names"))
             .where("_ll_names <> ''")
             .select(*keys, F.lit("merchants").alias("kind"), F.concat(F.lit(DRIFT_HINTS["merchants"]), "_ll_names").alias("hint")))
    subs = subscription_drift(cur, prev, keys).where("merchant IS NOT NULL")
    text = F.when(F.col("change") == "new", DRIFT_HINTS["new"]).otherwise(DRIFT_HINTS["cancelled"])
    return named.unionByName(subs.select(*keys, F.concat(F.col("change"), F.lit("_subscription")).alias("kind"),
                                         F.concat(text, F.col("merchant")).alias("hint")))


def spending_velocity(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """Second-half vs first-half expense total around the midpoint of the
    expense dates; rows at the midpoint belong to the first half."""
    e = expenses(df).where(F.col("date").isNotNull())
    bounds = e.groupBy(*keys).agg(F.min(micros(F.col("date"))).alias("_ll_lo"),
                                  F.max(micros(F.col("date"))).alias("_ll_hi"))
    j = join_on_keys(e, bounds, keys)
    first = F.lit(2) * micros(F.col("date")) <= F.col("_ll_lo") + F.col("_ll_hi")
    g = j.groupBy(*keys).agg(
        exact_sum(F.abs("amount"), first).alias("first_half"), exact_sum(F.abs("amount"), ~first).alias("second_half"),
    )
    ratio = F.when(F.col("first_half") > 0, F.try_divide(F.col("second_half"), F.col("first_half"))).otherwise(F.lit(1.0))
    trend = (F.when(F.col("second_half") == 0, F.lit("stable"))
             .when(ratio > 1.25, F.lit("accelerating"))
             .when(ratio < 0.75, F.lit("decelerating"))
             .otherwise(F.lit("stable")))
    accounts = df.select(*keys).distinct() if keys else None
    g = g.withColumn("velocity_trend", trend)
    if accounts is not None:
        g = accounts.join(g, list(keys), "left").withColumn(
            "velocity_trend", F.coalesce("velocity_trend", F.lit("stable")))
    return g
