"""Spending statistics (totals, by category / week / merchant, extremes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.dates import week_label
from ledgerlens.functions.money import exact_sum
from ledgerlens.functions.rules import SUBSCRIPTIONS
from ledgerlens.operators.common import Keys, expenses, join_on_keys, optional_columns, top_k

def _is_exp():
    return F.col("amount") < 0


def _is_inc():
    return F.col("amount") > 0


def _totals() -> list[Column]:
    amount = F.col("amount")
    return [exact_sum(amount, _is_exp()).alias("total_spent"), exact_sum(amount, _is_inc()).alias("total_income"),
            exact_sum(amount, _is_exp() | _is_inc()).alias("net"), F.count(F.lit(1)).alias("transaction_count"),
            F.count_if(_is_exp()).alias("expense_count"), F.count_if(_is_inc()).alias("income_count")]


def totals(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """total_spent (negative), total_income, net and row counts per key."""
    return df.groupBy(*keys).agg(*_totals())


def by_category(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """Expense total (absolute), count and mean per category."""
    df = optional_columns(df, category="string")
    return (expenses(df).where(F.col("category").isNotNull())
            .groupBy(*keys, "category")
            .agg(exact_sum(F.abs("amount")).alias("total"), F.count(F.lit(1)).alias("count"))
            .withColumn("avg", F.col("total") / F.col("count")))


def by_week(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """Absolute expense total per Monday-Sunday week label."""
    return (expenses(df).groupBy(*keys, week_label(F.col("date")).alias("week"))
            .agg(exact_sum(F.abs("amount")).alias("total")))


def by_merchant(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """|sum| and count of expenses per merchant (description)."""
    return (expenses(df).groupBy(*keys, "description")
            .agg(F.abs(exact_sum(F.col("amount"))).alias("total"),
                 F.count(F.lit(1)).alias("count"),
                 F.min("date").alias("first_seen")))


def top_merchants(df: DataFrame, keys: Keys = (), n: int = 20) -> DataFrame:
    """Top ``n`` merchants by spend per key (ties: description)."""
    m = by_merchant(df, keys)
    return top_k(m, keys, [F.col("total").desc(), F.col("description")], n, rank_col="rank").drop("first_seen")


def subscription_total(df: DataFrame, keys: Keys = ()) -> DataFrame:
    df = optional_columns(df, category="string")
    cond = _is_exp() & (F.col("category") == SUBSCRIPTIONS)
    return df.groupBy(*keys).agg(exact_sum(F.abs("amount"), cond).alias("subscription_total"))


def largest_transaction(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """Most negative expense per key; ties -> earliest date, then id."""
    best = F.min_by(F.struct("description", "amount", "date"), F.struct("amount", "date", "transaction_id"))
    return (expenses(df).groupBy(*keys).agg(best.alias("_ll_l"))
            .select(*keys, F.col("_ll_l.description").alias("largest_description"),
                    F.col("_ll_l.amount").alias("largest_amount"),
                    F.col("_ll_l.date").alias("largest_date")))


def most_frequent_merchant(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """Merchant with most expense rows; ties -> first seen, then name."""
    m = by_merchant(df, keys)
    order = [F.col("count").desc(), F.col("first_seen"), F.col("description")]
    return (top_k(m, keys, order, 1)
            .select(*keys, F.col("description").alias("most_frequent_merchant"),
                    F.col("count").alias("most_frequent_count")))


def compute_stats(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """One row per key with every scalar statistic.

    Totals, subscription total and the largest expense come from a single
    aggregate over the ledger; the most frequent merchant needs a merchant
    aggregate first.  Both results are one row per key and are joined.
    """
    df = optional_columns(df, category="string")
    sub = exact_sum(F.abs("amount"), _is_exp() & (F.col("category") == SUBSCRIPTIONS))
    largest = F.min_by(F.when(_is_exp(), F.struct("description", "amount", "date")),
                       F.when(_is_exp(), F.struct("amount", "date", "transaction_id")))
    scal = df.groupBy(*keys).agg(
        *_totals(),
        sub.alias("subscription_total"),
        largest.alias("_ll_l"),
    ).select(*keys, "total_spent", "total_income", "net", "transaction_count", "expense_count",
             "income_count", "subscription_total",
             F.col("_ll_l.description").alias("largest_description"),
             F.col("_ll_l.amount").alias("largest_amount"),
             F.col("_ll_l.date").alias("largest_date"))
    freq = most_frequent_merchant(df, keys)
    return _attach(scal, freq, keys)


def _attach(scal: DataFrame, freq: DataFrame, keys: Keys) -> DataFrame:
    return join_on_keys(scal, freq, keys, "left")


FACETS = ("category", "week", "merchant")


def stats_facets(df: DataFrame, keys: Keys = (), merchants: int = 20) -> DataFrame:
    """Expenses by category, week and merchant in one scan: (keys, facet, name,
    total, count, avg, rank).

    One aggregate over three grouping sets.  total is the absolute sum; rank
    orders a facet by total, ties by name, and merchants keep the first
    ``merchants``.  Null categories and undated weeks are left out; without a
    category column that facet is empty.
    """
    e = expenses(optional_columns(df, category="string")).withColumn("week", week_label(F.col("date")))
    cols = {"category": "category", "week": "week", "merchant": "description"}
    rows = (e.groupingSets([[*keys, cols[f]] for f in FACETS], *keys, *cols.values())
            .agg(F.grouping_id(*keys, *cols.values()).alias("_ll_set"), F.abs(exact_sum(F.col("amount"))).alias("total"),
                 F.count(F.lit(1)).alias("count")))
    facet = name = None
    for i, f in enumerate(FACETS):
        this = F.col("_ll_set") == 7 - (4 >> i)  # the bits of the columns that a set leaves out
        facet = F.when(this, f) if facet is None else facet.when(this, f)
        name = F.when(this, F.col(cols[f])) if name is None else name.when(this, F.col(cols[f]))
    rows = rows.select(*keys, facet.alias("facet"), name.alias("name"), "total", "count").where("name is not null")
    # Merchants may be many: first a rank inside salted parts of the key, then one among the survivors.
    order = [F.col("total").desc(), F.col("name")]
    salt = F.pmod(F.xxhash64("name"), F.lit(256))
    first = F.row_number().over(Window.partitionBy(*keys, "facet", salt).orderBy(*order))
    kept = (F.col("facet") != "merchant") | (F.col("rank") <= merchants)
    rows = rows.withColumn("rank", first).where(kept)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "facet").orderBy(*order))).where(kept)
    return rows.select(*keys, "facet", "name", "total", "count", (F.col("total") / F.col("count")).alias("avg"), "rank")


def share_of_spend(df: DataFrame, keys: Keys = (), merchants: int = 20) -> DataFrame:
    """Category and merchant facets with their percentage of the key's spend,
    and the subscriptions' percentage of it as a row of its own facet."""
    facets = stats_facets(df, keys, merchants).where("facet <> 'week'")
    spend = expenses(df).groupBy(*keys).agg(exact_sum(F.abs("amount")).alias("_ll_spend"))
    subs = facets.where((F.col("facet") == "category") & (F.col("name") == SUBSCRIPTIONS)).withColumn("facet", F.lit("outflow"))
    rows = join_on_keys(facets.unionByName(subs), spend, keys)
    share = F.try_divide(F.col("total"), F.col("_ll_spend")) * 100.0
    return rows.select(*keys, "facet", "name", "total", share.alias("pct_of_spend"))


def spend_share(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """Category share of total spend, in percent (derived figure)."""
    cats = by_category(df, keys)
    w = Window.partitionBy(*keys)
    # Category rows are already aggregated (≤ categories per key), so the
    # window here ranges over a handful of rows per key.
    return cats.withColumn("pct_of_spend",
                           F.try_divide(F.col("total"), exact_sum(F.col("total"), over=w)) * 100.0)


def weekly_spikes(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """Weekly totals against the weekly mean: SPIKE (≥1.5x) / LOW (≤0.5x)."""
    weeks = by_week(df, keys)
    w = Window.partitionBy(*keys)
    mean = exact_sum(F.col("total"), over=w) / F.count(F.lit(1)).over(w)
    ratio = F.try_divide(F.col("total"), F.col("weekly_average"))
    return (weeks.withColumn("weekly_average", mean)
            .withColumn("ratio", F.when(F.col("weekly_average") > 0, ratio))
            .withColumn("annotation", F.when(F.col("ratio") >= 1.5, F.lit("SPIKE"))
                        .when(F.col("ratio") <= 0.5, F.lit("LOW"))))
