"""Further query families: behavioural detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import patterns as pt
from ledgerlens.plans import oracle as o
from ledgerlens.plans.catalog import KEYS, enriched_events, enriched_orders, register

RHU = o.rhu


def late_sql(e: str) -> str:
    food = "category = 'food_dining' AND amount < 0"
    late = f"{food} AND (hour >= 22 OR hour < 4)"
    return f"""SELECT account_id, 'LATE_NIGHT_SPENDING' AS type,
  printf('%.0f', {RHU('pct * 100.0', 0)}) || '% of food spend happens after 10 PM' AS headline, 'info' AS severity,
  late_night_transaction_count, total_food_transactions, late_night_total, {RHU('pct * 100.0', 1)} AS percentage
FROM (SELECT *, late_night_transaction_count / total_food_transactions AS pct FROM (
  SELECT account_id, min(hour) <> max(hour) AS hrs,
    COUNT(*) FILTER (WHERE {food}) AS total_food_transactions,
    COUNT(*) FILTER (WHERE {late}) AS late_night_transaction_count,
    CAST(COALESCE(SUM(CASE WHEN {late} THEN CAST(abs(amount) AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS late_night_total
  FROM {e} GROUP BY account_id))
WHERE hrs AND total_food_transactions > 0 AND pct >= 0.15"""


def subs_sql(e: str, as_text: bool = True) -> str:
    lst = "array_to_string(subscriptions, '|')" if as_text else "subscriptions"
    return f"""SELECT account_id, 'SUBSCRIPTION_CREEP' AS type,
  printf('%d active subscriptions totalling $%.2f', subscription_count, total_spend) AS headline,
  'warning' AS severity, subscription_count, {lst} AS subscriptions, total_spend
FROM (SELECT account_id, list_sort(list(DISTINCT description)) AS subscriptions,
        CAST(len(list(DISTINCT description)) AS INTEGER) AS subscription_count,
        CAST(SUM(CAST(abs(amount) AS DECIMAL(18,2))) AS DOUBLE) AS total_spend
      FROM {e} WHERE amount < 0 AND category = 'subscriptions' GROUP BY account_id)
WHERE subscription_count > 5"""


def weekend_sql(e: str) -> str:
    return f"""SELECT account_id, 'WEEKEND_SPLURGE' AS type,
  'Weekend spend is ' || printf('%.1f', {RHU('ratio', 1)}) || 'x higher than weekdays' AS headline,
  CASE WHEN ratio < 2.0 THEN 'info' ELSE 'warning' END AS severity,
  {RHU('wavg', 2)} AS weekend_avg, {RHU('davg', 2)} AS weekday_avg, {RHU('ratio', 2)} AS ratio
FROM (SELECT *, CASE WHEN davg > 0 THEN wavg / davg ELSE 1.0 END AS ratio FROM (
  SELECT *, ws / wn AS wavg, ds / dn AS davg FROM (
    SELECT account_id,
      CAST(SUM(CASE WHEN is_weekend THEN CAST(abs(amount) AS DECIMAL(18,2)) END) AS DOUBLE) AS ws,
      COUNT(*) FILTER (WHERE is_weekend) AS wn,
      CAST(SUM(CASE WHEN NOT is_weekend THEN CAST(abs(amount) AS DECIMAL(18,2)) END) AS DOUBLE) AS ds,
      COUNT(*) FILTER (WHERE NOT is_weekend) AS dn
    FROM {e} WHERE amount < 0 GROUP BY account_id) WHERE wn > 0 AND dn > 0))
WHERE ratio >= 1.3"""


def dominance_sql(e: str) -> str:
    return f"""SELECT account_id, 'SINGLE_MERCHANT_DOMINANCE' AS type,
  description || ' is ' || printf('%.0f', {RHU('pct * 100.0', 0)}) || '% of your ' || category || ' spend' AS headline,
  'info' AS severity, description AS merchant, category, amount, category_total, {RHU('pct * 100.0', 1)} AS percentage
FROM (SELECT *, amount / category_total AS pct FROM (
  SELECT account_id, category, description, CAST(abs(m) AS DOUBLE) AS amount,
    CAST(abs(SUM(m) OVER (PARTITION BY account_id, category)) AS DOUBLE) AS category_total
  FROM (SELECT account_id, category, description, SUM(CAST(amount AS DECIMAL(18,2))) AS m
        FROM {e} WHERE amount < 0 AND category IS NOT NULL GROUP BY ALL)))
WHERE category_total <> 0 AND pct > 0.25"""


def week_sql(e: str) -> str:
    return f"""WITH wk AS (SELECT account_id, {o.week_label()} AS week, SUM(CAST(amount AS DECIMAL(18,2))) AS w
            FROM {e} WHERE amount < 0 GROUP BY ALL),
g AS (SELECT account_id, COUNT(*) AS n, CAST(abs(SUM(w)) AS DOUBLE) AS tot FROM wk GROUP BY account_id),
b AS (SELECT account_id, week, CAST(abs(w) AS DOUBLE) AS mx FROM wk
      QUALIFY ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY abs(w) DESC, week) = 1)
SELECT account_id, 'ANOMALOUS_WEEK' AS type,
  'Week of ' || week || ' was ' || printf('%.1f', {RHU('mx / avg', 1)}) || 'x your typical week' AS headline,
  'warning' AS severity, week AS anomalous_week, {RHU('mx', 2)} AS week_total, {RHU('avg', 2)} AS weekly_average,
  {RHU('mx / avg', 2)} AS multiplier
FROM (SELECT g.account_id, n, tot / n AS avg, b.week, b.mx FROM g JOIN b USING (account_id))
WHERE n >= 2 AND NOT (mx < avg * 1.5)"""


def income_sql(e: str) -> str:
    return f"""WITH gaps AS (
  SELECT account_id, CAST(floor((epoch_us(date) - epoch_us(prev)) / 86400000000) AS BIGINT) AS gap_days FROM (
    SELECT *, LAG(date) OVER (PARTITION BY account_id ORDER BY date ASC NULLS LAST, transaction_id) AS prev
    FROM {e} WHERE amount > 0)),
g AS (SELECT account_id, COUNT(*) AS income_events, COUNT(gap_days) AS m, SUM(gap_days) AS s1,
        SUM(gap_days * gap_days) AS s2 FROM gaps GROUP BY account_id),
s AS (SELECT *, m * s2 - s1 * s1 AS num FROM g)
SELECT account_id, 'INCOME_IRREGULARITY' AS type,
  'Income arrives every ' || printf('%.0f', {RHU('avg', 0)}) || ' days on average (±' || printf('%.0f', {RHU('std', 0)})
  || ' days)' AS headline, 'info' AS severity, income_events, {RHU('avg', 1)} AS avg_gap_days,
  {RHU('std', 1)} AS std_gap_days
FROM (SELECT *, CAST(s1 AS DOUBLE) / m AS avg, sqrt(CAST(num AS DOUBLE) / CAST(m * (m - 1) AS DOUBLE)) AS std FROM s
      WHERE income_events >= 3 AND m >= 2 AND num >= 25.0 * m * (m - 1))"""


def recurring_sql(e: str) -> str:
    return f"""SELECT account_id, 'RECURRING_FORGOTTEN' AS type,
  'Possible forgotten recurring: ' || description || printf(' at $%.2f/month', abs(amount)) AS headline,
  'info' AS severity, description AS merchant, amount, months_seen
FROM (SELECT account_id, description, amount, COUNT(DISTINCT strftime(date, '%Y-%m')) AS months_seen
      FROM {e} WHERE amount < 0 AND category IS DISTINCT FROM 'subscriptions' GROUP BY ALL)
WHERE months_seen >= 2"""


EV = o.enriched_cte("events", 2, "e")
OR = o.enriched_cte("orders", 2, "e")


def _subs_query(spark, d):
    s = pt.subscription_creep(enriched_events(spark, d), KEYS)
    return s.withColumn("subscriptions", F.array_join("subscriptions", "|"))


register("late_night", f"WITH {EV} {late_sql('e')}")(lambda s, d: pt.late_night_spending(enriched_events(s, d), KEYS))
register("subscription_creep", f"WITH {EV} {subs_sql('e')}")(_subs_query)
register("weekend_splurge", f"WITH {EV} {weekend_sql('e')}")(
    lambda s, d: pt.weekend_splurge(enriched_events(s, d), KEYS))
register("weekend_splurge_orders", f"WITH {OR} {weekend_sql('e')}")(
    lambda s, d: pt.weekend_splurge(enriched_orders(s, d), KEYS))
register("merchant_dominance", f"WITH {EV} {dominance_sql('e')}")(
    lambda s, d: pt.merchant_dominance(enriched_events(s, d), KEYS))
register("anomalous_week", f"WITH {EV}, {week_sql('e').removeprefix('WITH ')}")(
    lambda s, d: pt.anomalous_week(enriched_events(s, d), KEYS))
register("income_irregularity", f"WITH {OR}, {income_sql('e').removeprefix('WITH ')}")(
    lambda s, d: pt.income_irregularity(enriched_orders(s, d, once=True), KEYS))
register("income_deposits", f"""WITH {OR}, i AS ({income_sql('e')})
SELECT e.account_id, ROW_NUMBER() OVER (PARTITION BY e.account_id ORDER BY e.date, e.transaction_id) - 1 AS position, e.date, e.amount
FROM e JOIN i ON e.account_id = i.account_id WHERE e.amount > 0""")(
    lambda s, d: pt.income_deposits(enriched_orders(s, d, once=True), KEYS).select("account_id", "position", "date", "amount"))
register("recurring_forgotten", f"WITH {OR} {recurring_sql('e')}")(
    lambda s, d: pt.recurring_forgotten(enriched_orders(s, d), KEYS))


def _union_sql() -> str:
    parts = []
    ctes = [o.enriched_cte("events", 2, "ev"), o.enriched_cte("orders", 2, "eo")]
    for ledger, cte in (("events", "ev"), ("orders", "eo")):
        for i, f in enumerate((late_sql, subs_sql, weekend_sql, dominance_sql, week_sql, income_sql, recurring_sql)):
            body = f(cte)
            if body.startswith("WITH "):
                name = f"w_{ledger}_{i}"
                ctes.append(f"{name} AS ({body})")
                body = f"SELECT * FROM {name}"
            parts.append(f"SELECT '{ledger}' AS ledger, account_id, type, headline, severity, {i} AS detector_order "
                         f"FROM ({body})")
    sev = "CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 99 END"
    return (f"WITH {', '.join(ctes)} SELECT *, {sev} AS severity_rank FROM ("
            + " UNION ALL ".join(parts) + ")")


@register("detect_patterns", _union_sql())
def q_patterns(spark, d):
    cols = ["ledger", *KEYS, "type", "headline", "severity", "detector_order", "severity_rank"]
    ev = pt.detect_patterns(enriched_events(spark, d, once=True), KEYS).withColumn("ledger", F.lit("events"))
    eo = pt.detect_patterns(enriched_orders(spark, d, once=True), KEYS).withColumn("ledger", F.lit("orders"))
    return ev.select(*cols).unionByName(eo.select(*cols))


from ledgerlens.plans import catalog_anomaly  # noqa: E402,F401
