"""Parsers, transaction ids, header rules and the CSV directory scan."""

from __future__ import annotations

import hashlib
import os
import tempfile

from pyspark.sql import functions as F

from ledgerlens.sources import headers as hd
from ledgerlens.sources import parse as ps
from ledgerlens.sources.csv import scan


def _raw(spark, header, rows):
    cols = header.split(",")
    schema = ", ".join(f"`{c}` STRING" for c in cols)
    return spark.createDataFrame(rows, schema).withColumn("file_path", F.lit("f.csv"))


def test_alternate_generic_names(spark):
    raw = _raw(spark, "Transaction Date,Memo,Transaction Amount", [("2026-01-01", "Uber", "-12.00")])
    r = ps.parse_generic(raw).collect()[0]
    assert r["amount"] == -12.0 and r["description"] == "Uber" and r["source"] == "generic"


def test_debit_credit(spark):
    raw = _raw(spark, "date,description,debit,credit",
               [("2026-01-01", "Rent", "1200.00", None), ("2026-01-02", "Salary", None, "3000.00")])
    got = {r["description"]: r["amount"] for r in ps.parse_generic(raw).collect()}
    assert got == {"Rent": -1200.0, "Salary": 3000.0}


def test_amount_wins_over_debit_credit(spark):
    raw = _raw(spark, "date,description,amount,debit,credit", [("2026-01-01", "Coffee", "-4.50", "4.50", None)])
    assert ps.parse_generic(raw).collect()[0]["amount"] == -4.5


def test_currency_symbol_and_parens(spark):
    raw = _raw(spark, "date,description,amount", [("2026-01-01", "A", "$34.99"), ("2026-01-01", "B", "($1,200.00)"),
                                                  ("2026-01-01", "C", "1.0d"), ("2026-01-01", "D", "nan")])
    got = {r["description"]: r["amount"] for r in ps.parse_generic(raw).collect()}
    assert got == {"A": 34.99, "B": -1200.0, "C": None, "D": None}


def test_identical_rows_get_distinct_stable_ids(spark):
    raw = _raw(spark, "date,description,amount", [("2026-01-01", "Coffee", "-4.50")] * 3)
    ids1 = sorted(r["transaction_id"] for r in ps.parse_generic(raw).collect())
    ids2 = sorted(r["transaction_id"] for r in ps.parse_generic(raw.repartition(3)).collect())
    assert len(set(ids1)) == 3 and ids1 == ids2
    base = "2026-01-01|Coffee|-4.5000"
    expect = sorted(hashlib.sha256(p.encode()).hexdigest()[:16] for p in (base, base + "|1", base + "|2"))
    assert ids1 == expect


def test_occurrence_index_multiset_independent_of_partitions(spark):
    df = spark.range(0, 500).select((F.col("id") % 7).alias("g"), F.col("id"))
    for parts in (1, 5):
        d = df.repartition(parts)
        out = ps.occurrence_index(d, ["g"], ["id"]).groupBy("g").agg(
            F.sort_array(F.collect_list("occurrence")).alias("o")).collect()
        for r in out:
            assert r["o"] == list(range(len(r["o"])))


def test_plaid_pending_and_sign(spark):
    raw = _raw(spark, "date,name,amount,pending", [("2026-01-01", "Cafe", "4.50", "false"),
                                                    ("2026-01-02", "Cafe", "9.00", "TRUE"),
                                                    ("2026-01-03", "Pay", "-100", None)])
    got = {r["date"].day: r["amount"] for r in ps.parse_plaid(raw).collect()}
    assert got == {1: -4.5, 3: 100.0}


def test_bofa_strict_date(spark):
    raw = _raw(spark, "Date,Description,Amount,Running Bal.", [("04/01/2026", "X", "-1,200.00", "0"),
                                                                ("2026-04-01", "Y", "-1.00", "0")])
    got = {r["description"]: (r["date"], r["amount"]) for r in ps.parse_bofa(raw).collect()}
    assert got["X"][1] == -1200.0 and got["X"][0].day == 1 and got["Y"][0] is None


def test_header_rules(spark):
    h = spark.createDataFrame([
        ("a", "Transaction Date,Post Date,Description,Category,Type,Amount,Memo", 3),
        ("b", "Date,Description,Amount,Running Bal.", 3),
        ("c", "DATE,Name,AMOUNT", 3),
        ("d", "date_of_posting,Transaction Date,description,amount", 3),
        ("e", "description,amount", 3),
        ("f", "date,description,amount", 0),
        ("g", "not,valid,csv", 2),
    ], "file_path STRING, header STRING, n_rows BIGINT")
    fmt = {r["file_path"]: r["format"] for r in hd.detect_formats(h).collect()}
    assert fmt == {"a": "chase", "b": "bofa", "c": "plaid", "d": "generic", "e": "generic", "f": "generic",
                   "g": "generic"}
    m = {r["file_path"]: r["date_col"] for r in hd.map_columns(h).collect()}
    assert m["d"] == "Transaction Date"
    rej = {r["file_path"]: r["reason"] for r in hd.reject_report(h).collect()}
    assert rej == {"e": "Cannot detect a date column", "f": "CSV has no data rows",
                   "g": "Cannot detect a date column"}
    amb = {(r["file_path"], r["kind"]) for r in hd.header_ambiguities(h).collect()}
    assert ("d", "date") in amb


def test_csv_directory_scan(spark):
    root = tempfile.mkdtemp(prefix="ll-csv-")
    files = {
        "chase.csv": "﻿Transaction Date,Post Date,Description,Category,Type,Amount,Memo\n"
                     "04/01/2026,04/02/2026,NETFLIX.COM,,Sale,-15.49,\n"
                     "04/03/2026,04/03/2026,\"RENT, MAIN ST\",,Sale,\"-1,200.00\",\n",
        "plaid.csv": "date,name,amount,pending\n2026-04-01,Cafe,4.50,false\n2026-04-02,Cafe,9.00,true\n",
        "latin.csv": None,
        "bad.csv": "description,amount\nX,1\n",
        "empty.csv": "date,description,amount\n",
    }
    for name, text in files.items():
        with open(os.path.join(root, name), "wb") as fh:
            if text is None:
                fh.write("date,description,amount\n2026-04-01,CAF\xc9 LUMI\xc8RE,-3.00\n".encode("latin-1"))
            else:
                fh.write(text.encode("utf-8"))
    tx, rejects = scan(spark, root)
    got = sorted((r["source"], r["description"], r["amount"]) for r in tx.collect())
    assert got == [("chase", "NETFLIX.COM", -15.49), ("chase", "RENT, MAIN ST", -1200.0),
                   ("generic", "CAFÉ LUMIÈRE", -3.0), ("plaid", "Cafe", -4.5)]
    rej = {os.path.basename(r["file_path"]): r["reason"] for r in rejects.collect()}
    assert rej == {"bad.csv": "Cannot detect a date column", "empty.csv": "CSV has no data rows"}


def test_identical_lines_across_splits(spark):
    root = tempfile.mkdtemp(prefix="ll-csv-split-")
    with open(os.path.join(root, "big.csv"), "w") as fh:
        fh.write("date,description,amount\n" + "2026-01-01,Coffee,-4.50\n" * 200)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        tx, _ = scan(spark, root)
        ids = sorted(r["transaction_id"] for r in tx.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    base = "2026-01-01|Coffee|-4.5000"
    expect = sorted(hashlib.sha256((base if i == 0 else f"{base}|{i}").encode()).hexdigest()[:16]
                    for i in range(200))
    assert ids == expect


def test_bank_amounts_may_be_blank_padded(spark):
    from pyspark.sql import functions as F

    from ledgerlens.functions.money import parse_amount

    rows = spark.createDataFrame([(" -4.00 ",), ("$1,200.50",), ("4 5",), ("x",)], "a string")
    assert [r[0] for r in rows.select(parse_amount(F.col("a"))).collect()] == [-4.0, 1200.5, None, None]


def test_scan_of_untidy_files(spark):
    root = tempfile.mkdtemp(prefix="ll-csv-untidy-")
    files = {
        "quoted.csv": '"Date","Description","Amount"\n2026-01-01,"JOE ""S"" PIZZA, NY",-4.50\n',
        "with space.csv": "date,description,amount\n2026-01-02,Space,-1.00\n",
        "blank led.csv": "\n\ndate,description,amount\n2026-01-03,Blank,-2.00\n",
        "padded.csv": " Transaction Date ,Post Date, Description,Category,Type, Amount ,Memo\n"
                      "04/01/2026,04/02/2026,Padded,,Sale, -4.00 ,\n",
        "twice.csv": "date,description,Amount,amount\n2026-01-04,Twice,-1.00,-9.00\n",
        "bofa.csv": "Date,Description,Amount,Running Bal.\n4/1/2026,Bofa,-3.00,10.00\n",
        "short.csv": "date,description,amount\n01/05/26,Short,-5.00\n\"Jan 5, 2026\",Named,-6.00\n",
    }
    for name, text in files.items():
        with open(os.path.join(root, name), "w") as fh:
            fh.write(text)
    tx, rejects = scan(spark, root)
    assert rejects.count() == 0
    got = {r["description"]: (str(r["date"])[:10], r["amount"]) for r in tx.collect()}
    assert got == {'JOE "S" PIZZA, NY': ("2026-01-01", -4.5), "Space": ("2026-01-02", -1.0),
                   "Blank": ("2026-01-03", -2.0), "Padded": ("2026-04-01", -4.0), "Twice": ("2026-01-04", -9.0),
                   "Bofa": ("2026-04-01", -3.0), "Short": ("2026-01-05", -5.0), "Named": ("2026-01-05", -6.0)}


def test_registered_layout_with_unknown_names_is_scanned(spark):
    from pyspark.sql import functions as F

    from ledgerlens.sources import parse as ps

    def parse(raw):
        return raw.select("file_path", F.to_timestamp("buchung").alias("date"), F.col("zweck").alias("description"),
                          F.col("betrag").cast("double").alias("amount"), F.col("zweck").alias("raw_description"),
                          F.lit("own").alias("source"), F.sha2("zweck", 256).alias("transaction_id"))

    root = tempfile.mkdtemp(prefix="ll-csv-own-")
    with open(os.path.join(root, "own.csv"), "w") as fh:
        fh.write("buchung,zweck,betrag\n2026-01-01,Own,-7.00\n")
    spec = ps.FormatSpec("own", lambda cols: {"buchung", "zweck", "betrag"} <= set(cols), parse)
    ps.register_format(spec)
    try:
        tx, rejects = scan(spark, root)
        assert rejects.count() == 0 and tx.collect()[0]["amount"] == -7.0
    finally:
        ps.FORMATS.remove(spec)


def test_identical_lines_unfold_to_their_occurrences(spark):
    """A line that fills most of a file, and amounts that agree in four digits only."""
    from ledgerlens.functions.ids import transaction_id

    lines = [("f", "2024-01-01", "Coffee", "-4.5")] * 500 + [("f", "2024-01-01", "Coffee", "-4.50")] * 3
    lines += [("f", "2024-01-01", "Coffee", "-4.50001")] * 2 + [("g", "2024-01-01", "Coffee", "-4.5"), ("f", None, None, "x"), ("f", None, None, None)]
    raw = spark.createDataFrame(lines, "file_path string, Date string, Description string, Amount string").repartition(4)
    got = ps.parse_generic(raw)
    assert got.count() == len(lines)
    f = got.where("file_path = 'f' and description = 'Coffee'")
    assert f.select("transaction_id").distinct().count() == 505
    want = spark.range(505).select(transaction_id(F.lit("2024-01-01"), F.lit("Coffee"), F.lit(-4.5), F.col("id")).alias("transaction_id"))
    assert f.select("transaction_id").exceptAll(want).count() == 0
    assert got.where("amount is null").select("transaction_id").distinct().count() == 2
    assert ps.parse_generic(raw.limit(0)).count() == 0


def test_parsing_scans_once(spark, tmp_path):
    raw = spark.createDataFrame([("f", "2024-01-01", "Coffee", "-4.5")], "file_path string, Date string, Description string, Amount string")
    raw.write.parquet(str(tmp_path / "raw"))
    plan = ps.parse_generic(spark.read.parquet(str(tmp_path / "raw")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
