"""Parse and header queries (bank-export text derived from the ledgers)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.rules import (
    AMOUNT_VARIANTS,
    CREDIT_VARIANTS,
    DATE_VARIANTS,
    DEBIT_VARIANTS,
    DESC_VARIANTS,
)
from ledgerlens.plans import oracle as o
from ledgerlens.plans.catalog import register
from ledgerlens.sources import exports as ex
from ledgerlens.sources import headers as hd
from ledgerlens.sources import parse as ps
from ledgerlens.sources.ledgers import ledger_orders, table

LO = o.LEDGER_ORDERS
NUMERIC = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
OUT = ["file_path", "date", "description", "amount", "raw_description", "source", "transaction_id"]


def _gate(s: str) -> str:
    return f"CASE WHEN regexp_matches({s}, '{NUMERIC}') THEN TRY_CAST({s} AS DOUBLE) END"


def _bank_amount(x: str) -> str:
    return _gate(f"regexp_replace({x}, '[$,]', '', 'g')")


def _generic_amount(x: str) -> str:
    return _gate(f"regexp_replace(regexp_replace({x}, '[$,\\s]', '', 'g'), '\\((.+)\\)', '-\\1', 'g')")


def _money_text(e: str) -> str:
    return f"format('{{:,.2f}}', {e})"


def _parse_sql(raw: str, date_text: str, date: str, desc: str, amount: str, source: str, where: str = "TRUE") -> str:
    return f"""WITH r AS ({raw}),
p AS (SELECT file_path, _ll_line, {date_text} AS date_text, {date} AS date, coalesce({desc}, '') AS description,
        {amount} AS amount FROM r WHERE {where}),
oc AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY file_path, date_text, description, coalesce(printf('%.4f', amount), 'nan')
                                    ORDER BY _ll_line) - 1 AS occ FROM p)
SELECT file_path, date, description, amount, description AS raw_description, '{source}' AS source,
  {o.tid('date_text', 'description', 'amount', 'occ')} AS transaction_id FROM oc"""


_CHASE_RAW = f"""SELECT 'chase_' || account_id || '.csv' AS file_path, row_id AS _ll_line,
  strftime(date, '%m/%d/%Y') AS "Transaction Date", raw_description AS "Description",
  (CASE WHEN amount < 0 THEN '-' ELSE '' END) || '$' || {_money_text('abs(amount)')} AS "Amount" FROM ({LO})"""
_BOFA_RAW = f"""SELECT 'bofa_' || account_id || '.csv' AS file_path, row_id AS _ll_line,
  strftime(date, '%m/%d/%Y') AS "Date", raw_description AS "Description", {_money_text('amount')} AS "Amount" FROM ({LO})"""
_PLAID_RAW = f"""SELECT 'plaid_' || account_id || '.csv' AS file_path, row_id AS _ll_line,
  strftime(date, '%Y-%m-%d') AS date_s, raw_description AS name, printf('%.2f', -amount) AS amount_s,
  CASE WHEN row_id % 10 = 0 THEN 'true' ELSE 'false' END AS pending FROM ({LO})"""
_GENERIC_RAW = f"""SELECT 'generic_' || account_id || '.csv' AS file_path, row_id AS _ll_line,
  strftime(date, '%Y-%m-%d') AS "Date", raw_description AS "Description",
  CASE WHEN amount < 0 THEN '($' || {_money_text('abs(amount)')} || ')' ELSE '$' || {_money_text('amount')} END AS "Amount"
FROM ({LO})"""
_SPLIT_RAW = f"""SELECT 'split_' || account_id || '.csv' AS file_path, row_id AS _ll_line,
  strftime(date, '%Y-%m-%d') AS date_s, raw_description AS description_s,
  CASE WHEN amount < 0 THEN {_money_text('abs(amount)')} ELSE '' END AS debit,
  CASE WHEN amount > 0 THEN {_money_text('amount')} ELSE '' END AS credit FROM ({LO})"""


def _q(export, parser):
    def fn(spark, d):
        return parser(export(ledger_orders(spark, d))).select(*OUT)
    return fn


register("parse_chase", _parse_sql(_CHASE_RAW, '"Transaction Date"', "try_strptime(\"Transaction Date\", '%m/%d/%Y')",
                                   '"Description"', _bank_amount('"Amount"'), "chase"))(
    _q(ex.chase_export, ps.parse_chase))
register("parse_bofa", _parse_sql(
    _BOFA_RAW, "coalesce(strftime(try_strptime(\"Date\", '%m/%d/%Y'), '%Y-%m-%d %H:%M:%S'), 'NaT')",
    "try_strptime(\"Date\", '%m/%d/%Y')", '"Description"', _bank_amount('"Amount"'), "bofa"))(
    _q(ex.bofa_export, ps.parse_bofa))
register("parse_plaid", _parse_sql(
    _PLAID_RAW, "date_s", "try_strptime(date_s, '%Y-%m-%d')", "name",
    f"-({_gate(o.strip_ws('amount_s'))})",
    "plaid", "NOT (lower(pending) IS NOT DISTINCT FROM 'true')"))(
    _q(ex.plaid_export, ps.parse_plaid))
register("parse_generic", _parse_sql(_GENERIC_RAW, '"Date"', "try_strptime(\"Date\", '%Y-%m-%d')", '"Description"',
                                     _generic_amount('"Amount"'), "generic"))(
    _q(ex.generic_export, ps.parse_generic))
register("parse_debit_credit", _parse_sql(
    _SPLIT_RAW, "date_s", "try_strptime(date_s, '%Y-%m-%d')", "description_s",
    f"coalesce(-abs({_generic_amount('debit')}), 0.0) + coalesce(abs({_generic_amount('credit')}), 0.0)", "generic"))(
    _q(ex.debit_credit_export, ps.parse_generic))


# ---------------------------------------------------------------------------
# Header job over one statement file per customer
# ---------------------------------------------------------------------------

def _layout_sql() -> str:
    n = len(ex.HEADER_LAYOUTS)
    return "CASE " + " ".join(f"WHEN c_custkey % {n} = {i} THEN {o.q(h)}" for i, h in enumerate(ex.HEADER_LAYOUTS)) + " END"


_H = f"""h AS (SELECT 'statement_' || CAST(c_custkey AS VARCHAR) || '.csv' AS file_path, {_layout_sql()} AS header,
        CAST(coalesce(n, 0) AS BIGINT) AS n_rows
      FROM customer LEFT JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) oc ON c_custkey = oc.o_custkey),
c AS (SELECT *, string_split(header, ',') AS rc,
        list_transform(string_split(header, ','), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS sc,
        list_transform(string_split(header, ','),
          lambda x: regexp_replace(lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g')) AS nc FROM h)"""


def _lst(vals) -> str:
    return "[" + ", ".join(o.q(v) for v in vals) + "]"


_FMT = ("CASE WHEN list_has_all(sc, ['Transaction Date', 'Description', 'Amount']) THEN 'chase' "
        "WHEN list_has_all(sc, ['Date', 'Description', 'Amount']) AND list_contains(sc, 'Running Bal.') THEN 'bofa' "
        "WHEN list_has_all(list_transform(sc, lambda x: lower(x)), ['date', 'name', 'amount']) THEN 'plaid' "
        "ELSE 'generic' END")


def _find_sql(variants) -> str:
    pick = f"list_filter({_lst(sorted(variants))}, lambda v: list_contains(nc, v))[1]"
    return f"rc[len(nc) - list_position(list_reverse(nc), {pick}) + 1]"


_MAP = f"""m AS (SELECT *, {_FMT} AS format, {_find_sql(DATE_VARIANTS)} AS date_col, {_find_sql(DESC_VARIANTS)} AS desc_col,
  {_find_sql(AMOUNT_VARIANTS)} AS amount_col, {_find_sql(DEBIT_VARIANTS)} AS debit_col,
  {_find_sql(CREDIT_VARIANTS)} AS credit_col FROM c)"""


def _headers(spark, d):
    return ex.statement_headers(table(spark, d, "customer"), table(spark, d, "orders"))


register("detect_format", f"WITH {_H} SELECT file_path, header, n_rows, {_FMT} AS format FROM c")(
    lambda spark, d: hd.detect_formats(_headers(spark, d)))
register("map_columns", f"""WITH {_H}, {_MAP}
SELECT file_path, header, n_rows, date_col, desc_col, amount_col, debit_col, credit_col FROM m""")(
    lambda spark, d: hd.map_columns(_headers(spark, d)))


def _matches(variants) -> str:
    alt = "|".join(sorted(variants))
    return f"list_filter(nc, lambda x: regexp_matches(x, '{alt}'))"


register("header_ambiguities", f"""WITH {_H}, {_MAP},
g AS (SELECT *, {_matches(DATE_VARIANTS)} AS dm, {_matches(AMOUNT_VARIANTS)} AS am FROM m
      WHERE format = 'generic' AND n_rows > 0)
SELECT file_path, 'date' AS kind, array_to_string(dm, ',') AS columns FROM g WHERE len(dm) > 1
UNION ALL SELECT file_path, 'amount', array_to_string(am, ',') FROM g WHERE len(am) > 1
UNION ALL SELECT file_path, 'amount_precedence', amount_col FROM g
  WHERE amount_col IS NOT NULL AND (debit_col IS NOT NULL OR credit_col IS NOT NULL)""")(
    lambda spark, d: hd.header_ambiguities(_headers(spark, d)))

register("reject_report", f"""WITH {_H}, {_MAP}
SELECT file_path, format, reason FROM (SELECT file_path, format,
  CASE WHEN n_rows = 0 THEN 'CSV has no data rows'
       WHEN format = 'generic' AND date_col IS NULL THEN 'Cannot detect a date column'
       WHEN format = 'generic' AND desc_col IS NULL THEN 'Cannot detect a description column'
       WHEN format = 'generic' AND amount_col IS NULL AND (debit_col IS NULL OR credit_col IS NULL)
         THEN 'Cannot detect an amount column' END AS reason FROM m) WHERE reason IS NOT NULL""")(
    lambda spark, d: hd.reject_report(_headers(spark, d)))

from ledgerlens.plans import catalog_embed  # noqa: E402,F401
