"""What the jobs hold and move: findings F4 to F6 of round 3."""

from __future__ import annotations

import datetime as dt
import re

from ledgerlens.functions.rules import SEED_VOCAB
from ledgerlens.functions.text import keyword_category
from ledgerlens.operators.clean import dedup_near
from ledgerlens.plans import analyze as an
from ledgerlens.sources.parse import occurrence_index


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _ledger(spark, n=60):
    rows = [(i, i % 3 if i % 20 else None, dt.datetime(2026, 1, 1) + dt.timedelta(hours=i), -float(i % 7) - 1.0, ["NETFLIX.COM", None, "CAFE 12345"][i % 3])
            for i in range(n)]
    return spark.createDataFrame(rows, "row_id LONG, account_id LONG, date TIMESTAMP, amount DOUBLE, raw_description STRING")


def test_lines_are_shuffled_once_to_be_numbered(spark):
    """one exchange holds the rows; the offsets' ones hold groups only."""
    df = spark.createDataFrame([("a", 1, "p"), ("a", 2, "q"), (None, 3, "r"), (None, 4, "s"), ("b", 5, None)], "g STRING, id INT, payload STRING")
    out = occurrence_index(df, ["g"], ["id"], buckets=3)
    assert out.columns == ["g", "id", "payload", "occurrence"]
    formatted = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    inputs = re.findall(r"\) Exchange\nInput \[\d+\]: (\[.*\])", formatted)
    assert len(inputs) >= 3 and sum("payload" in i for i in inputs) == 1
    got = {}
    for r in out.collect():
        got.setdefault(r["g"], []).append(r["occurrence"])
    assert {g: sorted(o) for g, o in got.items()} == {"a": [0, 1], None: [0, 1], "b": [0]}


def test_near_duplicates_carry_no_text_twice(spark):
    """neither the group's text nor the category is in the rows that the aggregate holds."""
    e = an.enrich(_ledger(spark), ["account_id"])
    held = re.findall(r"min_by\((named_struct|struct)?\(?([^\n]*)", e._jdf.queryExecution().optimizedPlan().toString())
    assert held and not any("category" in h[1].split("_ll_row")[0] for h in held)


def test_zeros_of_both_signs_are_near_duplicates(spark):
    at = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([(0.0, "a", 0.0, at, "1"), (-0.0, "a", -0.0, at, "2"), (1.0, "a", -0.0, at, "3")],
                               "k DOUBLE, description STRING, amount DOUBLE, date TIMESTAMP, transaction_id STRING")
    assert [r["transaction_id"] for r in dedup_near(df, ["k"]).orderBy("transaction_id").collect()] == ["1", "3"]


def test_categories_are_one_small_expression(spark):
    """a hundred tests spelled out made a method too long to be compiled."""
    words = [(f"xx {t.upper()} yy",) for _, terms in SEED_VOCAB for t in terms] + [("nothing",), ("",), (None,)]
    df = spark.createDataFrame(words, "d STRING").select("d", keyword_category("d").alias("c"))

    def want(d):
        return next((c for c, terms in SEED_VOCAB if any(t in (d or "").lower() for t in terms)), "other")
    assert all(r["c"] == want(r["d"]) for r in df.collect())
    assert _plan(df).count("Contains(") == len(SEED_VOCAB)
