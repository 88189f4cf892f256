"""Store and narrative queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.rules import LOW_SIGNAL_PHRASES
from ledgerlens.operators.narrative import guard_insights, migrate_narratives, parse_narratives, quality_guard
from ledgerlens.plans import oracle as o
from ledgerlens.plans.catalog import KEYS, enriched_orders, register
from ledgerlens.sources import store as sto
from ledgerlens.sources.ledgers import ledger_orders, table

# Two loads of the orders ledger: up to 1997 and from 1997 on (1997 overlaps).
LOAD1 = "date < TIMESTAMP '1998-01-01 00:00:00'"
LOAD2 = "date >= TIMESTAMP '1997-01-01 00:00:00'"
OR = o.enriched_cte("orders", 2, "e")


def _loads(e):
    return (e.where(F.col("date") < F.to_timestamp(F.lit("1998-01-01 00:00:00"))),
            e.where(F.col("date") >= F.to_timestamp(F.lit("1997-01-01 00:00:00"))))


@register("insert_new_transactions", f"""WITH {OR}, l1 AS (SELECT * FROM e WHERE {LOAD1}), l2 AS (SELECT * FROM e WHERE {LOAD2})
SELECT account_id, transaction_id, date, amount, description FROM l2
WHERE NOT EXISTS (SELECT 1 FROM l1 WHERE l1.account_id = l2.account_id AND l1.transaction_id = l2.transaction_id)""")
def q_insert(spark, d):
    l1, l2 = _loads(enriched_orders(spark, d, once=True))
    return sto.insert_new(l2, l1, KEYS).select("account_id", "transaction_id", "date", "amount", "description")


def _delta_sql(src: str) -> str:
    return f"""SELECT account_id, lower(regexp_replace(description, '^\\s+|\\s+$', '', 'g')) AS normalized_name,
  min(description) AS name, SUM(CAST(abs(amount) AS DECIMAL(18,2))) AS total_spent, COUNT(*) AS transaction_count,
  min(date) AS first_seen, max(date) AS last_seen
FROM {src} WHERE amount < 0 GROUP BY ALL"""


def _delta_cat_sql(src: str) -> str:
    return f"""SELECT d.*, c.category FROM ({_delta_sql(src)}) d LEFT JOIN (
  SELECT account_id, lower(regexp_replace(description, '^\\s+|\\s+$', '', 'g')) AS normalized_name, category
  FROM {src} WHERE amount < 0 AND category IS NOT NULL
  QUALIFY ROW_NUMBER() OVER (PARTITION BY account_id, lower(regexp_replace(description, '^\\s+|\\s+$', '', 'g'))
                             ORDER BY date, transaction_id) = 1) c USING (account_id, normalized_name)"""


_MERGE = f"""l1 AS (SELECT * FROM e WHERE {LOAD1}), l2 AS (SELECT * FROM e WHERE {LOAD2}),
b AS ({_delta_cat_sql('l1')}), dl AS ({_delta_cat_sql('l2')}),
mg AS (SELECT coalesce(b.account_id, dl.account_id) AS account_id, coalesce(b.normalized_name, dl.normalized_name) AS normalized_name,
  CASE WHEN b.account_id IS NOT NULL THEN b.name ELSE dl.name END AS name,
  CASE WHEN b.account_id IS NOT NULL THEN b.category ELSE dl.category END AS category,
  CASE WHEN b.account_id IS NOT NULL THEN b.first_seen ELSE dl.first_seen END AS first_seen,
  CASE WHEN dl.account_id IS NOT NULL THEN dl.last_seen ELSE b.last_seen END AS last_seen,
  CAST(coalesce(b.total_spent, 0) + coalesce(dl.total_spent, 0) AS DECIMAL(18,2)) AS total_spent,
  CAST(coalesce(b.transaction_count, 0) + coalesce(dl.transaction_count, 0) AS BIGINT) AS transaction_count
FROM b FULL OUTER JOIN dl ON b.account_id = dl.account_id AND b.normalized_name = dl.normalized_name)"""


def _merged(e):
    l1, l2 = _loads(e)
    base = sto.merchant_delta(l1, KEYS)
    return sto.merge_merchants(base, sto.merchant_delta(l2, KEYS), KEYS)


@register("merchant_upsert", f"WITH {OR}, {_MERGE} SELECT * FROM mg")
def q_upsert(spark, d):
    return _merged(enriched_orders(spark, d, once=True))


@register("top_merchants", f"""WITH {OR}, {_MERGE}
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY total_spent DESC, normalized_name) AS rank FROM mg)
WHERE rank <= 5""")
def q_top_merchants(spark, d):
    return sto.top_merchants_table(_merged(enriched_orders(spark, d, once=True)), KEYS, 5)


# Analysis runs: one run per (account, calendar year) of the orders ledger,
# with a narrative whose tldr states the year's spend.
def _runs(spark, d):
    lo = ledger_orders(spark, d)
    runs = sto.run_rows(lo, KEYS, period=F.year("date"), source_file="ledger_orders")
    spent = lo.groupBy("account_id", F.year("date").alias("yr")).agg(
        F.sum(F.when(F.col("amount") < 0, F.abs("amount").cast("decimal(18,2)"))).cast("double").alias("spent"))
    nar = spent.select(
        F.substring(F.sha2(F.concat_ws("|", F.col("account_id").cast("string"), F.col("yr").cast("string")), 256), 1, 12)
        .alias("run_id"),
        F.to_json(F.struct(F.lit(1).alias("schema_version"),
                           F.format_string("Spent $%.2f in %d", F.coalesce("spent", F.lit(0.0)), F.col("yr")).alias("tldr"),
                           F.array().cast("array<string>").alias("insights"),
                           F.lit("").alias("next_steps"))).alias("narrative_json"))
    return sto.run_rows(lo, KEYS, period=F.year("date"), source_file="ledger_orders", narrative=nar)


_RUNS = f"""lo AS ({o.LEDGER_ORDERS}),
runs AS (SELECT account_id, min(date) AS period_start, max(date) AS period_end, COUNT(*) AS transaction_count,
  substr(sha256(CAST(account_id AS VARCHAR) || '|' || CAST(year(date) AS VARCHAR)), 1, 12) AS run_id,
  max(date) + INTERVAL 1 DAY AS created_at, 'ledger_orders' AS source_file,
  json_object('schema_version', 1, 'tldr', printf('Spent $%.2f in %d',
      coalesce(CAST(SUM(CASE WHEN amount < 0 THEN CAST(abs(amount) AS DECIMAL(18,2)) END) AS DOUBLE), 0.0), year(date)),
    'insights', json('[]'), 'next_steps', '')::VARCHAR AS narrative_json
  FROM lo GROUP BY account_id, year(date))"""


@register("history", f"""WITH {_RUNS}
SELECT run_id, created_at, period_start, period_end, source_file, transaction_count,
  json_extract_string(narrative_json, '$.tldr') AS tldr FROM runs""")
def q_history(spark, d):
    return sto.history(_runs(spark, d))


@register("read_transactions_range", f"""WITH {OR}
SELECT account_id, transaction_id, date, description, raw_description, amount, source, category,
  category_confidence FROM e
WHERE date >= TIMESTAMP '1996-03-01 00:00:00' AND date <= TIMESTAMP '1996-06-30 00:00:00'""")
def q_read_range(spark, d):
    # Stored transactions: the enriched ledger as written once, then scanned
    # by date range (predicates reach the Parquet scan).
    e = enriched_orders(spark, d, once=True)
    return sto.read_range(e, "1996-03-01 00:00:00", "1996-06-30 00:00:00").select(
        "account_id", "transaction_id", "date", "description", "raw_description", "amount", "source", "category",
        "category_confidence")


RUN_KEY = "7|1998"


@register("run_lookup", f"""WITH {_RUNS}
SELECT run_id, period_start, period_end, transaction_count, TRUE AS valid, 1 AS schema_version,
  json_extract_string(narrative_json, '$.tldr') AS tldr, 0 AS n_insights, '' AS next_steps, false AS newer_than_supported
FROM runs WHERE run_id = substr(sha256('{RUN_KEY}'), 1, 12)""")
def q_run_lookup(spark, d):
    import hashlib
    rid = hashlib.sha256(RUN_KEY.encode()).hexdigest()[:12]
    r = sto.run_detail(_runs(spark, d), rid)
    return r.select("run_id", "period_start", "period_end", "transaction_count", "valid", "schema_version", "tldr",
                    "n_insights", "next_steps", "newer_than_supported")


@register("previous_period", f"""WITH {_RUNS},
prev AS (SELECT account_id, run_id, period_start, period_end FROM runs WHERE period_end < TIMESTAMP '2000-01-01 00:00:00'
         QUALIFY ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY period_end DESC) = 1)
SELECT t.account_id, prev.run_id, t.row_id, t.date, t.amount FROM lo t JOIN prev
  ON t.account_id = prev.account_id AND t.date BETWEEN prev.period_start AND prev.period_end""")
def q_prev(spark, d):
    lo = ledger_orders(spark, d)
    runs = _runs(spark, d)
    current = lo.select("account_id").distinct().withColumn("current_start",
                                                            F.to_timestamp(F.lit("2000-01-01 00:00:00")))
    return sto.previous_period(lo, runs, current, KEYS).select("account_id", "run_id", "row_id", "date", "amount")


@register("previous_period_starts", f"""WITH {_RUNS},
st AS (SELECT DISTINCT account_id, TIMESTAMP '1995-01-01 00:00:00' AS current_start FROM lo
       UNION ALL SELECT DISTINCT account_id, TIMESTAMP '1998-01-01 00:00:00' FROM lo WHERE account_id % 3 = 0),
prev AS (SELECT st.account_id, current_start, run_id, period_start, period_end FROM st JOIN runs
           ON st.account_id = runs.account_id AND period_end < current_start
         QUALIFY ROW_NUMBER() OVER (PARTITION BY st.account_id, current_start ORDER BY period_end DESC, run_id DESC) = 1)
SELECT t.account_id, current_start, prev.run_id, t.row_id, t.amount FROM lo t JOIN prev
  ON t.account_id = prev.account_id AND t.date BETWEEN prev.period_start AND prev.period_end""")
def q_prev_starts(spark, d):
    """Two starts for a third of the accounts, one for the others."""
    lo = ledger_orders(spark, d)
    accounts = lo.select("account_id").distinct()
    starts = (accounts.withColumn("current_start", F.to_timestamp(F.lit("1995-01-01 00:00:00")))
              .unionByName(accounts.where("account_id % 3 = 0").withColumn("current_start", F.to_timestamp(F.lit("1998-01-01 00:00:00")))))
    return sto.previous_period(lo, _runs(spark, d), starts, KEYS).select("account_id", "current_start", "run_id", "row_id", "amount")


@register("table_counts", f"""WITH {OR}, {_MERGE}, {_RUNS}
SELECT 'transactions' AS table_name, COUNT(*) AS n FROM e
UNION ALL SELECT 'analysis_runs', COUNT(*) FROM runs
UNION ALL SELECT 'merchants', COUNT(*) FROM mg""")
def q_counts(spark, d):
    e = enriched_orders(spark, d, once=True)  # the transactions counted are those that make the merchants
    return sto.table_counts({"transactions": e, "analysis_runs": _runs(spark, d), "merchants": _merged(e)})


# ---------------------------------------------------------------------------
# Narrative data over conversations
# ---------------------------------------------------------------------------

# Phrases given by the caller in addition to the built-in list.
EXTRA_PHRASES = ("the", "you ")


def _phr_sql(phrases) -> str:
    return " OR ".join(f"contains(t, {o.q(p.lower())})" for p in phrases)


@register("quality_guard", f"""SELECT conv_id, turn, {_phr_sql((*LOW_SIGNAL_PHRASES, *EXTRA_PHRASES))} AS suppressed
FROM (SELECT conv_id, turn, lower(coalesce(role, '') || ' ' || coalesce(text, '')) AS t FROM conversations)""")
def q_guard(spark, d):
    c = table(spark, d, "conversations")
    g = quality_guard(c, "role", "text", (*LOW_SIGNAL_PHRASES, *EXTRA_PHRASES))
    return g.select("conv_id", "turn", "suppressed")


def _narr_json(spark, d):
    """One narrative JSON per conversation turn: version cycles 0 (absent) /
    1 / 2, every 4th turn has a non-list ``insights``, every 5th is wrapped in
    prose (malformed)."""
    c = table(spark, d, "conversations")
    v = F.col("turn") % 3
    ins = F.array(F.struct(F.col("role").alias("headline"), F.col("text").alias("detail")))
    good = F.to_json(F.struct(F.when(v > 0, v).alias("schema_version"), F.col("text").alias("tldr"),
                              ins.alias("insights"), F.col("role").alias("next_steps")))
    bad_list = F.to_json(F.struct(F.when(v > 0, v).alias("schema_version"), F.col("text").alias("tldr"),
                                  F.col("role").alias("insights")))
    j = F.when(F.col("turn") % 4 == 3, bad_list).otherwise(good)
    j = F.when(F.col("turn") % 5 == 4, F.concat(F.lit("Here is the JSON: "), j)).otherwise(j)
    return c.select("conv_id", "turn", j.alias("narrative_json"))


_NJ = """nj AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'Here is the JSON: ' || j ELSE j END AS narrative_json FROM (
  SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN
      CASE WHEN turn % 3 > 0 THEN json_object('schema_version', turn % 3, 'tldr', text, 'insights', role)
           ELSE json_object('tldr', text, 'insights', role) END
    ELSE CASE WHEN turn % 3 > 0 THEN json_object('schema_version', turn % 3, 'tldr', text,
                 'insights', json_array(json_object('headline', role, 'detail', text)), 'next_steps', role)
         ELSE json_object('tldr', text, 'insights', json_array(json_object('headline', role, 'detail', text)),
                 'next_steps', role) END END::VARCHAR AS j
  FROM conversations)),
p AS (SELECT conv_id, turn, coalesce(json_valid(narrative_json) AND regexp_matches(narrative_json, '^\\s*\\{'), false) AS valid,
  CASE WHEN json_valid(narrative_json) THEN TRY_CAST(json_extract_string(narrative_json, '$.schema_version') AS INTEGER) END AS schema_version,
  CASE WHEN json_valid(narrative_json) THEN json_extract_string(narrative_json, '$.tldr') END AS tldr,
  CASE WHEN json_valid(narrative_json) AND json_type(narrative_json, '$.insights') = 'ARRAY'
       THEN CAST(json_array_length(narrative_json, '$.insights') AS INTEGER) END AS n_insights,
  CASE WHEN json_valid(narrative_json) THEN json_extract_string(narrative_json, '$.next_steps') END AS next_steps,
  CASE WHEN json_valid(narrative_json) THEN json_extract_string(narrative_json, '$.generated_at') END AS generated_at
  FROM nj)"""


@register("parse_narrative", f"WITH {_NJ} SELECT * FROM p")
def q_parse_narr(spark, d):
    return parse_narratives(_narr_json(spark, d)).select(
        "conv_id", "turn", "valid", "schema_version", "tldr", "n_insights", "next_steps", "generated_at")


@register("migrate_narrative", f"""WITH {_NJ}
SELECT conv_id, turn, coalesce(schema_version, 0) AS schema_version,
  CASE WHEN coalesce(schema_version, 0) = 0 THEN coalesce(tldr, '') ELSE tldr END AS tldr,
  CASE WHEN coalesce(schema_version, 0) = 0 THEN coalesce(n_insights, 0) ELSE n_insights END AS n_insights,
  CASE WHEN coalesce(schema_version, 0) = 0 THEN coalesce(next_steps, '') ELSE next_steps END AS next_steps,
  CASE WHEN coalesce(schema_version, 0) = 0 THEN coalesce(generated_at, '') ELSE generated_at END AS generated_at,
  coalesce(schema_version, 0) > 1 AS newer_than_supported
FROM p WHERE valid""")
def q_migrate(spark, d):
    p = parse_narratives(_narr_json(spark, d)).where(F.col("valid"))
    return migrate_narratives(p).select("conv_id", "turn", "schema_version", "tldr", "n_insights", "next_steps",
                                        "generated_at", "newer_than_supported")


@register("narrative_insights", f"""WITH {_NJ},
i AS (SELECT nj.conv_id, nj.turn, unnest(from_json(json_extract(nj.narrative_json, '$.insights'), '[{{"headline":"VARCHAR","detail":"VARCHAR"}}]')) AS x
      FROM nj JOIN p ON nj.conv_id = p.conv_id AND nj.turn = p.turn WHERE p.valid AND p.n_insights > 0)
SELECT conv_id, turn, x.headline AS headline, x.detail AS detail, {_phr_sql(EXTRA_PHRASES).replace('(t, ', "(lower(coalesce(x.headline, '') || ' ' || coalesce(x.detail, '')), ")} AS suppressed
FROM i""")
def q_insights(spark, d):
    """Every insight of the valid narratives, kept or suppressed."""
    p = migrate_narratives(parse_narratives(_narr_json(spark, d)).where("valid"))
    g = guard_insights(p, phrases=EXTRA_PHRASES)
    parts = [g.select("conv_id", "turn", F.explode(c).alias("x"), F.lit(s).alias("suppressed"))
             for c, s in (("insights", False), ("suppressed_insights", True))]
    return parts[0].unionByName(parts[1]).select("conv_id", "turn", "x.headline", "x.detail", "suppressed")


from ledgerlens.plans import catalog_parse  # noqa: E402,F401
