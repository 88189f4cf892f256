"""Anomaly and drift queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import anomaly as an
from ledgerlens.operators import drift as dr
from ledgerlens.plans import oracle as o
from ledgerlens.plans.catalog import KEYS, enriched_events, enriched_orders, register

RHU = o.rhu
EV = o.enriched_cte("events", 2, "e")
OR = o.enriched_cte("orders", 2, "e")

_FEAT = f"""x AS (SELECT * FROM e WHERE amount < 0),
ci AS (SELECT account_id, category,
         CAST(DENSE_RANK() OVER (PARTITION BY account_id ORDER BY category) - 1 AS INTEGER) AS category_encoded
       FROM (SELECT DISTINCT account_id, category FROM x WHERE category IS NOT NULL AND category <> 'other')),
f AS (SELECT x.account_id, x.transaction_id, abs(x.amount) AS amount_abs, CAST({o.dow_index('x.day_of_week')} AS INTEGER) AS dow,
        CAST(coalesce(x.hour, 0) AS INTEGER) AS hour, coalesce(ci.category_encoded, -1) AS category_encoded,
        coalesce(CAST(epoch_us(x.date) - epoch_us(LAG(x.date) OVER (PARTITION BY x.account_id
                 ORDER BY x.date ASC NULLS LAST, x.transaction_id)) AS DOUBLE) / CAST(86400000000 AS DOUBLE), 0.0)
          AS days_since_prev
      FROM x LEFT JOIN ci ON x.account_id = ci.account_id AND x.category = ci.category)"""

_Z = """g AS (SELECT account_id, COUNT(*) AS n, CAST(SUM(CAST(amount_abs AS DECIMAL(18,2))) AS DOUBLE) AS s1,
        CAST(SUM(CAST(amount_abs AS DECIMAL(18,2)) * CAST(amount_abs AS DECIMAL(18,2))) AS DOUBLE) AS s2
      FROM f GROUP BY account_id),
gs AS (SELECT account_id, s1 / CAST(n AS DOUBLE) AS mean,
         sqrt(greatest((s2 - s1 * s1 / CAST(n AS DOUBLE)) / CAST(n AS DOUBLE), 0.0)) AS std FROM g),
s AS (SELECT f.*, abs(f.amount_abs - gs.mean) / (gs.std + 1e-9) AS raw_score FROM f JOIN gs USING (account_id))"""

_FLAGS = f"""st AS (SELECT account_id, COUNT(*) AS cnt, min(raw_score) AS lo, max(raw_score) AS hi,
         quantile_cont(raw_score, 0.95) AS thr, median(amount_abs) AS med FROM s GROUP BY account_id),
st2 AS (SELECT *, cnt >= 5 AND NOT (abs(hi - lo) <= 1e-8 + 1e-5 * abs(lo)) AS active FROM st),
rk AS (SELECT account_id, transaction_id, raw_score,
         ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY raw_score DESC, transaction_id) AS rnk FROM s),
j AS (SELECT e.*, rk.raw_score, rk.rnk, st2.active, st2.thr, st2.med FROM e
      LEFT JOIN rk ON e.account_id = rk.account_id AND e.transaction_id = rk.transaction_id
      LEFT JOIN st2 ON e.account_id = st2.account_id),
k AS (SELECT *, CASE WHEN coalesce(active, false) THEN coalesce(raw_score, 0.0) ELSE 0.0 END AS anomaly_score FROM j),
fl AS (SELECT *, coalesce(coalesce(active, false) AND anomaly_score >= thr, false) AS is_anomaly FROM k),
scored AS (SELECT *, CASE WHEN is_anomaly AND rnk <= 3 AND amount < 0 THEN
    CASE WHEN abs(amount) > med * 5 THEN printf('$%.2f at %s is %.1fx the median transaction', abs(amount),
                                               coalesce(description, 'Unknown'), {RHU('abs(amount) / med', 1)})
         WHEN coalesce(is_weekend, false) THEN printf('Unusually large weekend purchase: $%.2f at %s', abs(amount),
                                                      coalesce(description, 'Unknown'))
         ELSE printf('$%.2f at %s is an outlier for this period', abs(amount), coalesce(description, 'Unknown')) END
  ELSE '' END AS anomaly_reason FROM fl)"""


def _feat_q(spark, d):
    return an.anomaly_features(enriched_events(spark, d, once=True), KEYS).select(
        "account_id", "transaction_id", "amount_abs", "dow", "hour", "category_encoded", "days_since_prev")


register("anomaly_features", f"WITH {EV}, {_FEAT} SELECT * FROM f")(_feat_q)


def _z_q(spark, d):
    f = an.anomaly_features(enriched_events(spark, d, once=True), KEYS)
    return an.zscore_scores(f, KEYS).select("account_id", "transaction_id", "amount_abs", "raw_score")


register("anomaly_zscore", f"WITH {EV}, {_FEAT}, {_Z} SELECT account_id, transaction_id, amount_abs, raw_score FROM s")(_z_q)


def _flags_q(spark, d):
    s = an.score_anomalies(enriched_events(spark, d, once=True), KEYS, method="zscore")
    return s.select("account_id", "transaction_id", "anomaly_score", "is_anomaly", "anomaly_reason")


register("anomaly_flags", f"""WITH {EV}, {_FEAT}, {_Z}, {_FLAGS}
SELECT account_id, transaction_id, anomaly_score, is_anomaly, anomaly_reason FROM scored""")(_flags_q)


def _extract_q(spark, d):
    s = an.score_anomalies(enriched_events(spark, d, once=True), KEYS, method="zscore")
    return an.extract_anomalies(s, KEYS, limit=5)


register("extract_anomalies", f"""WITH {EV}, {_FEAT}, {_Z}, {_FLAGS}
SELECT account_id, rank, strftime(date, '%Y-%m-%d') AS date, coalesce(description, '') AS description, amount,
  {RHU('anomaly_score', 3)} AS score, coalesce(anomaly_reason, '') AS reason
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY anomaly_score DESC, transaction_id) AS rank
      FROM scored WHERE is_anomaly) WHERE rank <= 5""")(_extract_q)


# ---------------------------------------------------------------------------
# Drift: orders ledger split at 1998-01-01 (previous period before, current after)
# ---------------------------------------------------------------------------

SPLIT = "1998-01-01 00:00:00"
CUR = f"date >= TIMESTAMP '{SPLIT}'"
PREV = f"date < TIMESTAMP '{SPLIT}'"


def _periods(spark, d):
    e = enriched_orders(spark, d, once=True)
    cut = F.to_timestamp(F.lit(SPLIT))
    return e.where(F.col("date") >= cut), e.where(F.col("date") < cut)


def _cat_totals(where):
    return (f"SELECT account_id, category, CAST(abs(SUM(CAST(amount AS DECIMAL(18,2)))) AS DOUBLE) AS t FROM e "
            f"WHERE {where} AND amount < 0 AND category IS NOT NULL GROUP BY ALL")


_CAT_DRIFT = f"""WITH {OR}, c AS ({_cat_totals(CUR)}), p AS ({_cat_totals(PREV)}),
j AS (SELECT coalesce(c.account_id, p.account_id) AS account_id, coalesce(c.category, p.category) AS category,
        coalesce(c.t, 0.0) AS cv, coalesce(p.t, 0.0) AS pv
      FROM c FULL OUTER JOIN p ON c.account_id = p.account_id AND c.category = p.category),
k AS (SELECT *, CASE WHEN pv <> 0 THEN (cv - pv) / abs(pv) END AS change FROM j),
r AS (SELECT account_id, category,
        CASE WHEN pv = 0 AND cv > 0 THEN 'increased' WHEN pv <> 0 AND change > 0.2 THEN 'increased'
             WHEN pv <> 0 AND change < -0.2 THEN 'decreased' END AS direction,
        {RHU('cv', 2)} AS current, {RHU('pv', 2)} AS previous,
        CASE WHEN pv <> 0 THEN {RHU('change * 100.0', 1)} END AS change_pct FROM k)
SELECT *, CASE WHEN change_pct IS NULL THEN category || ' is new this period ($' || CAST(current AS VARCHAR) || ')'
  WHEN direction = 'increased' THEN category || ' spending rose ' || CAST(change_pct AS VARCHAR) || '% ($'
       || CAST(previous AS VARCHAR) || ' → $' || CAST(current AS VARCHAR) || ')'
  ELSE category || ' spending fell ' || CAST(abs(change_pct) AS VARCHAR) || '% ($' || CAST(previous AS VARCHAR)
       || ' → $' || CAST(current AS VARCHAR) || ')' END AS hint
FROM r WHERE direction IS NOT NULL"""


def _cat_drift_q(spark, d):
    cur, prev = _periods(spark, d)
    return dr.category_drift(cur, prev, KEYS, 0.20)


register("category_drift", _CAT_DRIFT)(_cat_drift_q)


def _set_sql(extra: str, added: str, removed: str) -> str:
    return f"""WITH {OR},
c AS (SELECT DISTINCT account_id, description FROM e WHERE {CUR} {extra}),
p AS (SELECT DISTINCT account_id, description FROM e WHERE {PREV} {extra})
SELECT account_id, description AS merchant, '{added}' AS change FROM c
  WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.account_id = c.account_id AND p.description = c.description)
UNION ALL
SELECT account_id, description AS merchant, '{removed}' AS change FROM p
  WHERE NOT EXISTS (SELECT 1 FROM c WHERE p.account_id = c.account_id AND p.description = c.description)"""


def _merchant_drift_q(spark, d):
    cur, prev = _periods(spark, d)
    return dr.merchant_drift(cur, prev, KEYS)


def _sub_drift_q(spark, d):
    cur, prev = _periods(spark, d)
    return dr.subscription_drift(cur, prev, KEYS)


register("merchant_drift", _set_sql("", "new", "dropped"))(_merchant_drift_q)
register("subscription_drift", _set_sql("AND category = 'subscriptions'", "new", "cancelled"))(_sub_drift_q)


def _hints_q(spark, d):
    cur, prev = _periods(spark, d)
    return dr.drift_hints(cur, prev, KEYS)


_NEW_SQL, _SUB_SQL = (_set_sql(*x).split(f"WITH {OR},")[1] for x in
                      (("", "new", "dropped"), ("AND category = 'subscriptions'", "new", "cancelled")))
register("drift_hints", f"""WITH {OR}, m AS (WITH {_NEW_SQL}), s AS (WITH {_SUB_SQL}),
f AS (SELECT * FROM m WHERE change = 'new' QUALIFY ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY merchant) <= 5)
SELECT account_id, 'merchants' AS kind, 'New merchants this period: ' || string_agg(merchant, ', ' ORDER BY merchant) AS hint
FROM f GROUP BY account_id
UNION ALL
SELECT account_id, change || '_subscription' AS kind,
  CASE WHEN change = 'new' THEN 'New subscriptions: ' ELSE 'Cancelled subscriptions: ' END || merchant AS hint FROM s""")(_hints_q)


def _velocity_q(spark, d):
    cur, _ = _periods(spark, d)
    return dr.spending_velocity(cur, KEYS)


register("spending_velocity", f"""WITH {OR}, cur AS (SELECT * FROM e WHERE {CUR}),
x AS (SELECT * FROM cur WHERE amount < 0 AND date IS NOT NULL),
b AS (SELECT account_id, min(epoch_us(date)) AS lo, max(epoch_us(date)) AS hi FROM x GROUP BY account_id),
h AS (SELECT x.account_id,
        CAST(COALESCE(SUM(CASE WHEN 2 * epoch_us(date) <= lo + hi THEN CAST(abs(amount) AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS first_half,
        CAST(COALESCE(SUM(CASE WHEN NOT (2 * epoch_us(date) <= lo + hi) THEN CAST(abs(amount) AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS second_half
      FROM x JOIN b USING (account_id) GROUP BY x.account_id),
a AS (SELECT DISTINCT account_id FROM cur)
SELECT a.account_id, h.first_half, h.second_half,
  coalesce(CASE WHEN h.second_half = 0 THEN 'stable'
       WHEN (CASE WHEN h.first_half > 0 THEN h.second_half / h.first_half ELSE 1.0 END) > 1.25 THEN 'accelerating'
       WHEN (CASE WHEN h.first_half > 0 THEN h.second_half / h.first_half ELSE 1.0 END) < 0.75 THEN 'decelerating'
       ELSE 'stable' END, 'stable') AS velocity_trend
FROM a LEFT JOIN h USING (account_id)""")(_velocity_q)

from ledgerlens.plans import catalog_store  # noqa: E402,F401
