"""Bank-export text frames derived from a ledger.

String-typed frames shaped like each bank's CSV export (as a CSV scan with an
all-STRING schema would return them), used to exercise the parsers on data
that grows with the ledger.  ``_ll_line`` stands in for the line number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FIXED VALUES — header lines of the bank layouts and generic variants.
CHASE_HEADER = "Transaction Date,Post Date,Description,Category,Type,Amount,Memo"
BOFA_HEADER = "Date,Description,Amount,Running Bal."
PLAID_HEADER = "date,name,amount,category,account_id,pending"
GENERIC_HEADER = "Date,Description,Amount"
HEADER_LAYOUTS = [
    CHASE_HEADER,
    BOFA_HEADER,
    PLAID_HEADER,
    GENERIC_HEADER,
    "Transaction Date,Memo,Transaction Amount",
    "date,description,debit,credit",
    "description,amount",
    "date_of_posting,Transaction Date,description,amount",
    "not,valid,csv",
    "date,description,amount,debit,credit",
]


def _file(prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.col("account_id").cast("string"), F.lit(".csv"))


def _num(c: Column) -> Column:
    return F.format_number(c, 2)


def chase_export(ledger: DataFrame) -> DataFrame:
    amt = F.concat(F.when(F.col("amount") < 0, F.lit("-")).otherwise(F.lit("")), F.lit("$"), _num(F.abs("amount")))
    d = F.date_format("date", "MM/dd/yyyy")
    return ledger.select(_file("chase_").alias("file_path"), F.col("row_id").alias("_ll_line"),
                         d.alias("Transaction Date"), d.alias("Post Date"),
                         F.col("raw_description").alias("Description"), F.lit("").alias("Category"),
                         F.when(F.col("amount") < 0, "Sale").otherwise("Payment").alias("Type"),
                         amt.alias("Amount"), F.lit("").alias("Memo"))


def bofa_export(ledger: DataFrame) -> DataFrame:
    return ledger.select(_file("bofa_").alias("file_path"), F.col("row_id").alias("_ll_line"),
                         F.date_format("date", "MM/dd/yyyy").alias("Date"),
                         F.col("raw_description").alias("Description"), _num(F.col("amount")).alias("Amount"),
                         F.lit("0.00").alias("Running Bal."))


def plaid_export(ledger: DataFrame) -> DataFrame:
    return ledger.select(_file("plaid_").alias("file_path"), F.col("row_id").alias("_ll_line"),
                         F.date_format("date", "yyyy-MM-dd").alias("date"),
                         F.col("raw_description").alias("name"),
                         F.format_string("%.2f", -F.col("amount")).alias("amount"),
                         F.lit("").alias("category"), F.col("account_id").cast("string").alias("account_id"),
                         F.when(F.col("row_id") % 10 == 0, "true").otherwise("false").alias("pending"))


def generic_export(ledger: DataFrame) -> DataFrame:
    amt = F.when(F.col("amount") < 0, F.concat(F.lit("($"), _num(F.abs("amount")), F.lit(")"))) \
           .otherwise(F.concat(F.lit("$"), _num(F.col("amount"))))
    return ledger.select(_file("generic_").alias("file_path"), F.col("row_id").alias("_ll_line"),
                         F.date_format("date", "yyyy-MM-dd").alias("Date"),
                         F.col("raw_description").alias("Description"), amt.alias("Amount"))


def debit_credit_export(ledger: DataFrame) -> DataFrame:
    return ledger.select(_file("split_").alias("file_path"), F.col("row_id").alias("_ll_line"),
                         F.date_format("date", "yyyy-MM-dd").alias("date"),
                         F.col("raw_description").alias("description"),
                         F.when(F.col("amount") < 0, _num(F.abs("amount"))).otherwise(F.lit("")).alias("debit"),
                         F.when(F.col("amount") > 0, _num(F.col("amount"))).otherwise(F.lit("")).alias("credit"))


def statement_headers(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """(file_path, header, n_rows): one statement file per customer, layout by
    customer key, data rows = the customer's orders (zero for many)."""
    n = len(HEADER_LAYOUTS)
    layout = None
    for i, h in enumerate(HEADER_LAYOUTS):
        cond = (F.col("c_custkey") % n) == i
        layout = F.when(cond, F.lit(h)) if layout is None else layout.when(cond, F.lit(h))
    counts = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_rows"))
    return (customers.select("c_custkey").join(counts, "c_custkey", "left")
            .select(F.concat(F.lit("statement_"), F.col("c_custkey").cast("string"), F.lit(".csv")).alias("file_path"),
                    layout.alias("header"), F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows")))
