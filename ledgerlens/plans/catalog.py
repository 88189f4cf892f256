"""Registered queries: Spark DataFrame builders and their DuckDB oracles.

Every query reads the driver tables (``sf_dir``) through the derived ledgers,
so its work grows with the data.  Keys are ``account_id`` throughout.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import stats as st
from ledgerlens.operators.clean import dedup_exact, dedup_near, merchant_dimension, normalize_dates
from ledgerlens.operators.categorize import categorize_keywords
from ledgerlens.plans import analyze as an
from ledgerlens.plans import oracle as o
from ledgerlens.plans.materialize import materialize
from ledgerlens.sources.ledgers import ledger_events, ledger_orders, table

KEYS = ["account_id"]
QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _events(spark, d):
    return ledger_events(spark, d)


def _orders(spark, d):
    return ledger_orders(spark, d)


def enriched_events(spark, d, window=2, once=False):
    """Enriched events ledger.  ``once=True`` when several facets of one query
    read it: it is then written once instead of recomputed per facet."""
    e = an.enrich(_events(spark, d), KEYS, window)
    return materialize(e, "enriched-events") if once else e


def enriched_orders(spark, d, window=2, once=False):
    e = an.enrich(_orders(spark, d), KEYS, window)
    return materialize(e, "enriched-orders") if once else e


E = o.enriched_cte("events", 2, "e")
EO = o.enriched_cte("orders", 2, "e")


# ---------------------------------------------------------------------------
# Flagship: cleaned, categorised ledger -> spend by category per account
# ---------------------------------------------------------------------------

def flagship(spark: SparkSession, d: str) -> DataFrame:
    # Single consumer: stays one lazy plan (nothing written).
    return st.by_category(an.enrich(_events(spark, d), KEYS, 2), KEYS)


FLAGSHIP_SQL = f"""WITH {E}
SELECT account_id, category, CAST(SUM(CAST(abs(amount) AS DECIMAL(18,2))) AS DOUBLE) AS total,
       COUNT(*) AS count,
       CAST(SUM(CAST(abs(amount) AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS avg
FROM e WHERE amount < 0 AND category IS NOT NULL GROUP BY account_id, category"""

register("by_category", FLAGSHIP_SQL)(flagship)


# ---------------------------------------------------------------------------
# Cleaning
# ---------------------------------------------------------------------------

@register("normalize_descriptions",
          f"SELECT raw_description, {o.normalize('raw_description')} AS description "
          f"FROM (SELECT DISTINCT raw_description FROM ({o.LEDGER_EVENTS}))")
def q_normalize(spark, d):
    return merchant_dimension(_events(spark, d))


@register("normalize_dates",
          f"SELECT row_id, account_id, date, {o.date_features()} FROM ({o.LEDGER_EVENTS})")
def q_dates(spark, d):
    return normalize_dates(_events(spark, d)).select(
        "row_id", "account_id", "date", "day_of_week", "week_of_month", "is_weekend", "hour")


@register("keyword_category",
          f"""SELECT row_id, description, category, CAST(CASE WHEN category = 'other' THEN 0.0 ELSE 0.9 END AS DOUBLE) AS category_confidence,
  CAST(-1 AS INTEGER) AS cluster_id
FROM (SELECT row_id, description, {o.keyword_category('description')} AS category
      FROM (SELECT row_id, {o.normalize('raw_description')} AS description FROM ({o.LEDGER_EVENTS})))""")
def q_keyword(spark, d):
    from ledgerlens.operators.clean import normalize_descriptions
    e = normalize_descriptions(_events(spark, d), src="raw_description")
    return categorize_keywords(e).select("row_id", "description", "category", "category_confidence", "cluster_id")


@register("transaction_id",
          f"SELECT account_id, date, amount, raw_description, transaction_id FROM ({o.ledger_ids('events')})")
def q_tid(spark, d):
    return an.with_ledger_ids(_events(spark, d), KEYS).select(
        "account_id", "date", "amount", "raw_description", "transaction_id")


_LI_TID_SQL = f"""SELECT l_suppkey, l_shipdate, l_quantity, raw, {o.tid("date_text", "raw", "amount", "occ")} AS transaction_id
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_suppkey, date_text, raw, coalesce(printf('%.4f', amount), 'nan')
                                   ORDER BY l_orderkey, l_linenumber) - 1 AS occ
      FROM (SELECT l_suppkey, l_shipdate, l_quantity, l_orderkey, l_linenumber,
                   strftime(l_shipdate, '%Y-%m-%d') AS date_text,
                   'PART ' || l_returnflag || l_linestatus AS raw, -l_quantity AS amount FROM lineitem))"""


@register("transaction_id_lineitem", _LI_TID_SQL)
def q_tid_lineitem(spark, d):
    from ledgerlens.sources.parse import with_transaction_id
    li = table(spark, d, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_quantity", "l_orderkey", "l_linenumber",
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date_text"),
        F.concat(F.lit("PART "), F.col("l_returnflag"), F.col("l_linestatus")).alias("raw"),
        (-F.col("l_quantity")).alias("amount"))
    t = with_transaction_id(li, date_text="date_text", raw="raw", amount="amount", file_cols=["l_suppkey"],
                            order_cols=["l_orderkey", "l_linenumber"])
    return t.select("l_suppkey", F.col("l_shipdate").cast("timestamp").alias("l_shipdate"), "l_quantity", "raw",
                    "transaction_id")


_LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_LI_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
             "l_returnflag", "l_linestatus"]


@register("dedup_exact",
          f"SELECT {', '.join(_LI_COLS)} FROM lineitem QUALIFY ROW_NUMBER() OVER "
          f"(PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(_LI_ORDER)}) = 1")
def q_dedup_exact(spark, d):
    li = table(spark, d, "lineitem").select(*_LI_COLS)
    return dedup_exact(li, keys=["l_orderkey"], id_col="l_linenumber", order=tuple(_LI_ORDER)).select(*_LI_COLS)


def _near_sql(w):
    return (f"SELECT account_id, date, description, amount, raw_description, transaction_id "
            f"FROM ({o.cleaned('events', w)})")


def _near_q(w):
    def fn(spark, d):
        return an.clean(_events(spark, d), KEYS, w).select(
            "account_id", "date", "description", "amount", "raw_description", "transaction_id")
    return fn


for _w in (0, 2, 7):
    register(f"dedup_near_w{_w}", _near_sql(_w))(_near_q(_w))


@register("filter_period",
          f"""WITH {E} SELECT row_id, account_id, date, amount, description FROM e
WHERE date >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY""")
def q_period(spark, d):
    from ledgerlens.operators.filters import filter_period
    e = filter_period(enriched_events(spark, d), days=7, as_of="2024-01-31 00:00:00")
    return e.select("row_id", "account_id", "date", "amount", "description")


# ---------------------------------------------------------------------------
# Statistics
# ---------------------------------------------------------------------------

_TOTALS = """CAST(COALESCE(SUM(CASE WHEN amount < 0 THEN CAST(amount AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS total_spent,
  CAST(COALESCE(SUM(CASE WHEN amount > 0 THEN CAST(amount AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS total_income,
  CAST(COALESCE(SUM(CASE WHEN amount < 0 THEN CAST(amount AS DECIMAL(18,2)) END), 0)
     + COALESCE(SUM(CASE WHEN amount > 0 THEN CAST(amount AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS net,
  COUNT(*) AS transaction_count, COUNT(*) FILTER (WHERE amount < 0) AS expense_count,
  COUNT(*) FILTER (WHERE amount > 0) AS income_count"""

register("totals", f"WITH {E} SELECT account_id, {_TOTALS} FROM e GROUP BY account_id")(
    lambda spark, d: st.totals(enriched_events(spark, d), KEYS))

register("by_week", f"""WITH {E} SELECT account_id, {o.week_label()} AS week,
  CAST(SUM(CAST(abs(amount) AS DECIMAL(18,2))) AS DOUBLE) AS total FROM e WHERE amount < 0 GROUP BY ALL""")(
    lambda spark, d: st.by_week(enriched_events(spark, d), KEYS))

_MERCH = """m AS (SELECT account_id, description, CAST(abs(SUM(CAST(amount AS DECIMAL(18,2)))) AS DOUBLE) AS total,
  COUNT(*) AS count, MIN(date) AS first_seen FROM e WHERE amount < 0 GROUP BY account_id, description)"""

register("by_merchant_top20", f"""WITH {E}, {_MERCH}
SELECT account_id, description, total, count, rank FROM
 (SELECT *, ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY total DESC, description) AS rank FROM m)
WHERE rank <= 20""")(lambda spark, d: st.top_merchants(enriched_events(spark, d), KEYS, 20))

register("subscription_total", f"""WITH {E} SELECT account_id,
  CAST(COALESCE(SUM(CASE WHEN amount < 0 AND category = 'subscriptions' THEN CAST(abs(amount) AS DECIMAL(18,2)) END), 0)
  AS DOUBLE) AS subscription_total FROM e GROUP BY account_id""")(
    lambda spark, d: st.subscription_total(enriched_events(spark, d), KEYS))

_LARGEST = """l AS (SELECT account_id, description AS largest_description, amount AS largest_amount, date AS largest_date
  FROM e WHERE amount < 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY amount, date, transaction_id) = 1)"""

register("largest_txn", f"WITH {E}, {_LARGEST} SELECT * FROM l")(
    lambda spark, d: st.largest_transaction(enriched_events(spark, d), KEYS))

_FREQ = """f AS (SELECT account_id, description AS most_frequent_merchant, count AS most_frequent_count FROM m
  QUALIFY ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY count DESC, first_seen, description) = 1)"""

register("most_frequent", f"WITH {E}, {_MERCH}, {_FREQ} SELECT * FROM f")(
    lambda spark, d: st.most_frequent_merchant(enriched_events(spark, d), KEYS))

register("compute_stats", f"""WITH {E}, {_MERCH}, {_FREQ}, {_LARGEST},
s AS (SELECT account_id, {_TOTALS},
  CAST(COALESCE(SUM(CASE WHEN amount < 0 AND category = 'subscriptions' THEN CAST(abs(amount) AS DECIMAL(18,2)) END), 0)
  AS DOUBLE) AS subscription_total FROM e GROUP BY account_id)
SELECT s.*, l.largest_description, l.largest_amount, l.largest_date, f.most_frequent_merchant, f.most_frequent_count
FROM s LEFT JOIN l USING (account_id) LEFT JOIN f USING (account_id)""")(
    lambda spark, d: st.compute_stats(enriched_events(spark, d, once=True), KEYS))

register("spend_share", f"""WITH {E},
c AS (SELECT account_id, category, CAST(SUM(CAST(abs(amount) AS DECIMAL(18,2))) AS DOUBLE) AS total, COUNT(*) AS count
      FROM e WHERE amount < 0 AND category IS NOT NULL GROUP BY ALL)
SELECT account_id, category, total, count, total / count AS avg,
  total / CAST(SUM(CAST(total AS DECIMAL(18,2))) OVER (PARTITION BY account_id) AS DOUBLE) * 100.0 AS pct_of_spend FROM c""")(
    lambda spark, d: st.spend_share(enriched_events(spark, d), KEYS))

_MONEY_SUM = "CAST(abs(SUM(CAST(amount AS DECIMAL(18,2)))) AS DOUBLE)"
_FACETS = f"""fr AS (
  SELECT account_id, 'category' AS facet, category AS name, {_MONEY_SUM} AS total, COUNT(*) AS count FROM e
  WHERE amount < 0 AND category IS NOT NULL GROUP BY ALL
  UNION ALL SELECT account_id, 'week', {o.week_label()}, {_MONEY_SUM}, COUNT(*) FROM e WHERE amount < 0 AND date IS NOT NULL GROUP BY ALL
  UNION ALL SELECT account_id, 'merchant', description, {_MONEY_SUM}, COUNT(*) FROM e WHERE amount < 0 GROUP BY ALL),
fk AS (SELECT * FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY account_id, facet ORDER BY total DESC, name) AS INTEGER) AS rank FROM fr)
       WHERE facet <> 'merchant' OR rank <= 20)"""

register("stats_facets", f"WITH {E}, {_FACETS} SELECT account_id, facet, name, total, count, total / count AS avg, rank FROM fk")(
    lambda spark, d: st.stats_facets(enriched_events(spark, d), KEYS))

register("share_of_spend", f"""WITH {E}, {_FACETS},
sp AS (SELECT account_id, {_MONEY_SUM} AS spend FROM e WHERE amount < 0 GROUP BY ALL),
s AS (SELECT account_id, facet, name, total FROM fk WHERE facet <> 'week'
      UNION ALL SELECT account_id, 'outflow', name, total FROM fk WHERE facet = 'category' AND name = 'subscriptions')
SELECT account_id, facet, name, total, total / spend * 100.0 AS pct_of_spend FROM s JOIN sp USING (account_id)""")(
    lambda spark, d: st.share_of_spend(enriched_events(spark, d, once=True), KEYS))

register("weekly_spikes", f"""WITH {E},
w AS (SELECT account_id, {o.week_label()} AS week, CAST(SUM(CAST(abs(amount) AS DECIMAL(18,2))) AS DOUBLE) AS total
      FROM e WHERE amount < 0 GROUP BY ALL),
a AS (SELECT *, CAST(SUM(CAST(total AS DECIMAL(18,2))) OVER (PARTITION BY account_id) AS DOUBLE)
                / COUNT(*) OVER (PARTITION BY account_id) AS weekly_average FROM w)
SELECT *, CASE WHEN ratio >= 1.5 THEN 'SPIKE' WHEN ratio <= 0.5 THEN 'LOW' END AS annotation
FROM (SELECT *, CASE WHEN weekly_average > 0 THEN total / weekly_average END AS ratio FROM a)""")(
    lambda spark, d: st.weekly_spikes(enriched_events(spark, d), KEYS))


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLES)


def _load_all() -> None:
    # Query families register themselves on import.
    from ledgerlens.plans import catalog_more  # noqa: F401
