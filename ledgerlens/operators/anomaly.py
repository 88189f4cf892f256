"""Anomaly scoring: features, z-score / isolation-forest scores, percentile
threshold, top-N reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.dates import MICROS_PER_DAY, micros
from ledgerlens.functions.money import MOMENT, exact_sum, round_half_up
from ledgerlens.functions.rules import DAY_NAMES, OTHER_CATEGORY
from ledgerlens.operators.common import Keys, exact_quantile, expenses, join_on_keys, prev_in_order, top_k

FEATURES = ("amount_abs", "dow", "hour", "category_encoded", "days_since_prev")
MATERIALIZE_SCORES = True


def category_index(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """(keys, category, category_encoded): dense alphabetical index of the
    categories present among the expenses, 'other' excluded."""
    cats = (expenses(df).where(F.col("category").isNotNull() & (F.col("category") != OTHER_CATEGORY))
            .select(*keys, "category").distinct())
    # Distinct categories per key: a few rows per key, safe to rank.
    w = Window.partitionBy(*keys).orderBy("category")
    return cats.withColumn("category_encoded", (F.dense_rank().over(w) - 1).cast("int"))


def anomaly_features(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """Expense rows with the five model features (NULL -> 0)."""
    e = expenses(df)
    dow = F.lit(0)
    if "day_of_week" in df.columns:
        expr = None
        for i, name in enumerate(DAY_NAMES):
            cond = F.col("day_of_week") == name
            expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
        dow = expr.otherwise(F.lit(0))
    hour = F.coalesce(F.col("hour"), F.lit(0)) if "hour" in df.columns else F.lit(0)
    e = e.withColumn("amount_abs", F.abs("amount")).withColumn("dow", dow.cast("int")) \
         .withColumn("hour", hour.cast("int"))
    if "category" in df.columns:
        idx = category_index(df, keys)
        e = e.join(idx, [*keys, "category"], "left") if keys else e.join(idx, ["category"], "left")
        e = e.withColumn("category_encoded", F.coalesce("category_encoded", F.lit(-1)))
    else:
        e = e.withColumn("category_encoded", F.lit(-1))
    e = prev_in_order(e, keys, "date", "transaction_id", "_ll_prev")
    gap = (micros(F.col("date")) - micros(F.col("_ll_prev"))) / float(MICROS_PER_DAY)
    return e.withColumn("days_since_prev", F.coalesce(gap, F.lit(0.0))).drop("_ll_prev")


def zscore_scores(feats: DataFrame, keys: Keys = ()) -> DataFrame:
    """|x - mean| / (population std + 1e-9) of |amount| per key.

    Mean and variance come from exact DECIMAL sums, so every engine and every
    partitioning yields bit-identical scores; amounts of 1e12 and more are
    added as doubles.
    """
    x = F.col("amount_abs")
    fits = x.try_cast(MOMENT)  # its square is exact in 38 digits
    square = F.coalesce(F.try_sum(fits * fits).cast("double"), F.sum(F.when(fits.isNotNull(), x * x)), F.lit(0.0))
    g = feats.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_ll_n"),
        exact_sum(x, as_type=MOMENT).alias("_ll_s1"),
        (square + F.coalesce(F.sum(F.when(fits.isNull(), x * x)), F.lit(0.0))).alias("_ll_s2"),
    )
    n = F.col("_ll_n").cast("double")
    g = (g.withColumn("_ll_mean", F.col("_ll_s1") / n)
          .withColumn("_ll_std", F.sqrt(F.greatest((F.col("_ll_s2") - F.col("_ll_s1") * F.col("_ll_s1") / n) / n,
                                                   F.lit(0.0))))
          .select(*keys, "_ll_n", "_ll_mean", "_ll_std"))
    s = join_on_keys(feats, g, keys)
    return (s.withColumn("raw_score", F.abs(F.col("amount_abs") - F.col("_ll_mean")) / (F.col("_ll_std") + 1e-9))
             .drop("_ll_mean", "_ll_std"))


def minmax_normalise(scored: DataFrame, keys: Keys = (), col: str = "raw_score") -> DataFrame:
    g = scored.groupBy(*keys).agg(F.min(col).alias("_ll_lo"), F.max(col).alias("_ll_hi"))
    s = join_on_keys(scored, g, keys)
    return (s.withColumn(col, (F.col(col) - F.col("_ll_lo")) / (F.col("_ll_hi") - F.col("_ll_lo") + 1e-9))
             .drop("_ll_lo", "_ll_hi"))


def _reason(amount_abs, merchant, median, weekend):
    ratio = F.try_divide(amount_abs, median)
    return (F.when(amount_abs > median * 5,
                   F.format_string("$%.2f at %s is %.1fx the median transaction", amount_abs, merchant,
                                   round_half_up(ratio, 1)))
            .when(F.coalesce(weekend, F.lit(False)),
                  F.format_string("Unusually large weekend purchase: $%.2f at %s", amount_abs, merchant))
            .otherwise(F.format_string("$%.2f at %s is an outlier for this period", amount_abs, merchant)))


def score_anomalies(df: DataFrame, keys: Keys = (), method: str = "zscore", contamination: float = 0.05,
                    top_n: int = 3, min_expenses: int = 5, forest=None) -> DataFrame:
    """Add anomaly_score, is_anomaly, anomaly_reason to every row.

    Scores are computed for expenses; other rows score 0.  Per key: fewer than
    ``min_expenses`` expenses or (near-)identical scores flag nothing;
    otherwise rows with score >= the (1 - contamination) percentile of the
    expense scores are flagged, and the ``top_n`` highest-scoring expenses that
    are flagged get a reason.
    """
    if not 0.0 < contamination < 0.5:
        raise ValueError(f"contamination must be in (0, 0.5), got {contamination}")
    feats = anomaly_features(df, keys)
    from ledgerlens.plans.materialize import materialize
    if method == "zscore":
        scored = zscore_scores(feats, keys)
    elif method == "iforest":
        from ledgerlens.operators.iforest import iforest_scores
        # The features feed the counts, the forests and the join back: written once, and only the columns the scores need.
        feats = materialize(feats.select(*keys, "transaction_id", *FEATURES), "iforest-features")
        # Python-computed scores: written once before normalising.
        scored = minmax_normalise(materialize(iforest_scores(feats, keys, forest=forest), "iforest-scores"), keys)
    else:
        raise ValueError(f"unknown method {method!r}")
    # The score table (four narrow columns) feeds the threshold and median
    # quantiles, the top-N ranking and the join back: it is written once so
    # the feature windows are not recomputed for every consumer.
    scored = scored.select(*keys, "transaction_id", "raw_score", "amount_abs")
    if MATERIALIZE_SCORES:
        scored = materialize(scored, "anomaly-scores")

    q = 1.0 - contamination
    base = [F.count(F.lit(1)).alias("_ll_cnt"), F.min("raw_score").alias("_ll_lo"),
            F.max("raw_score").alias("_ll_hi")]
    # Exact flag threshold and median |amount| per key, without a buffer that
    # holds a key's values.
    stats = scored.groupBy(*keys).agg(*base)
    thr = exact_quantile(scored, keys, "raw_score", q, "_ll_thr")
    med = exact_quantile(scored, keys, "amount_abs", 0.5, "_ll_median")
    stats = join_on_keys(join_on_keys(stats, thr, keys, "left"), med, keys, "left")
    close = F.abs(F.col("_ll_hi") - F.col("_ll_lo")) <= (1e-8 + 1e-5 * F.abs(F.col("_ll_lo")))
    # One row per key, written once: its tables and sorts are not held beside
    # those of the join with the ledger.
    stats = materialize(stats.select(*keys, ((F.col("_ll_cnt") >= min_expenses) & ~close).alias("_ll_active"),
                                     "_ll_thr", "_ll_median"), "anomaly-limits")

    ranked = top_k(scored.select(*keys, "transaction_id", "raw_score"), keys,
                   [F.col("raw_score").desc(), F.col("transaction_id")], top_n, salt_col="transaction_id",
                   rank_col="_ll_rank")
    exp_scores = scored.select(*keys, "transaction_id", "raw_score", "amount_abs")
    exp_scores = exp_scores.join(ranked.select(*keys, "transaction_id", "_ll_rank"),
                                 [*keys, "transaction_id"], "left")

    out = df.join(exp_scores, [*keys, "transaction_id"], "left")
    out = join_on_keys(out, stats, keys, "left")
    active = F.coalesce(F.col("_ll_active"), F.lit(False))
    score = F.when(active, F.coalesce(F.col("raw_score"), F.lit(0.0))).otherwise(F.lit(0.0))
    out = out.withColumn("anomaly_score", score)
    flagged = active & (F.col("anomaly_score") >= F.col("_ll_thr"))
    out = out.withColumn("is_anomaly", F.coalesce(flagged, F.lit(False)))
    weekend = F.col("is_weekend") if "is_weekend" in df.columns else F.lit(False)
    has_reason = F.col("is_anomaly") & F.col("_ll_rank").isNotNull() & (F.col("amount") < 0)
    reason = _reason(F.abs(F.col("amount")), F.coalesce(F.col("description"), F.lit("Unknown")),
                     F.col("_ll_median"), weekend)
    out = out.withColumn("anomaly_reason", F.when(has_reason, reason).otherwise(F.lit("")))
    return out.drop("raw_score", "amount_abs", "_ll_rank", "_ll_active", "_ll_thr", "_ll_median")


def extract_anomalies(scored: DataFrame, keys: Keys = (), limit: int = 5) -> DataFrame:
    """Flagged rows, highest score first, ``limit`` per key, display form."""
    flagged = scored.where(F.col("is_anomaly"))
    top = top_k(flagged, keys, [F.col("anomaly_score").desc(), F.col("transaction_id")], limit,
                salt_col="transaction_id", rank_col="rank")
    return top.select(*keys, "rank", F.date_format("date", "yyyy-MM-dd").alias("date"),
                      F.coalesce(F.col("description"), F.lit("")).alias("description"), "amount",
                      round_half_up(F.col("anomaly_score"), 3).alias("score"),
                      F.coalesce(F.col("anomaly_reason"), F.lit("")).alias("reason"))
