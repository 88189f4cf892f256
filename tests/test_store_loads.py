"""The store's plain tables: appends, pruned months, named loads."""

from __future__ import annotations

import os
import random
import tempfile
from datetime import datetime
from functools import reduce

from pyspark.sql import functions as F

from ledgerlens.plans.run import run_analysis
from ledgerlens.sources.store import LedgerStore, fold_merchants, in_months_of, merchant_delta, merge_merchants, run_rows
from ledgerlens.streaming.incremental import process_batch

TX = "account_id BIGINT, date TIMESTAMP, description STRING, raw_description STRING, amount DOUBLE, source STRING, category STRING, transaction_id STRING"
LEDGER = "row_id BIGINT, account_id BIGINT, date TIMESTAMP, amount DOUBLE, raw_description STRING"


def tx(spark, rows):
    return spark.createDataFrame([(k, d and datetime.fromisoformat(d), n, n, a, "chase", c, i) for k, d, n, a, c, i in rows], TX)


def store(spark):
    return LedgerStore(spark, tempfile.mkdtemp(prefix="ll-loads-"), ["account_id"])


def merchants(s):
    return {(r.account_id, r.normalized_name): (float(r.total_spent), r.transaction_count) for r in s.read("merchants").collect()}


def test_append_touches_only_new_files(spark):
    s = store(spark)
    jan = tx(spark, [(1, "2026-01-05", "a", -1.0, "x", "t1"), (None, "2026-01-06", "b", -1.0, None, "t2"), (1, None, "c", -1.0, None, "t3")])
    assert s.save_transactions(jan, "r") == 3
    files = {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(s.root) for f in fs if f.endswith(".parquet")}
    assert s.save_transactions(jan.unionByName(jan), "r") == 0  # null keys and dates are found again
    feb = tx(spark, [(1, "2026-02-05", "a", -1.0, "x", "t4"), (1, "2026-02-05", "a", -1.0, "x", "t4"), (1, "2026-01-05", "a", -1.0, "x", "t1")])
    assert s.save_transactions(feb, "r") == 1
    now = {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(s.root) for f in fs if f.endswith(".parquet")}
    assert files.items() <= now.items() and s.read("transactions").count() == 4
    assert s.save_transactions(feb.limit(0), "r") == 0


def test_a_batch_reads_its_months_only(spark):
    s = store(spark)
    s.save_transactions(tx(spark, [(1, f"2026-{m:02d}-05", "a", -1.0, "x", f"t{m}") for m in range(1, 7)]), "r")
    got = in_months_of(s.read("transactions"), tx(spark, [(1, "2026-03-09", "a", -1.0, "x", "n"), (1, "2026-04-01", "a", -1.0, "x", "n")]))
    assert sorted(r.transaction_id for r in got.collect()) == ["t3", "t4"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    part = next(p for p in plan.split("PartitionFilters")[1:])
    assert "year" in part.split("PushedFilters")[0] and "month" in part.split("PushedFilters")[0]
    assert len(got.inputFiles()) >= 1 and in_months_of(s.read("transactions"), tx(spark, [])).count() == 0


def test_fold_equals_repeated_merges(spark):
    rng = random.Random(3)
    loads = [tx(spark, [(rng.randint(1, 2), f"2026-0{rng.randint(1, 5)}-1{rng.randint(0, 9)}", rng.choice(["Cafe", "cafe ", "Rent"]), -float(rng.randint(1, 9)),
                         rng.choice(["food", None]), f"t{n}-{i}") for i in range(12)]) for n in range(4)]
    deltas = [merchant_delta(d, ["account_id"]) for d in loads]
    merged = reduce(lambda b, d: merge_merchants(b, d, ["account_id"]), deltas[1:], merge_merchants(deltas[0].limit(0), deltas[0], ["account_id"]))
    log = reduce(lambda a, b: a.unionByName(b), [d.withColumn("loaded_at", F.lit(n)).withColumn("load", F.lit("l")) for n, d in enumerate(deltas)])
    folded = fold_merchants(log, ["account_id"])
    assert sorted(map(str, folded.select(*merged.columns).collect())) == sorted(map(str, merged.collect()))


def test_named_loads_replace_themselves(spark):
    s = store(spark)
    a = tx(spark, [(1, "2026-04-01", "Cafe", -4.0, "food", "a"), (1, "2026-04-02", "Big", -1e25, "x", "b")])
    b = tx(spark, [(1, "2026-05-01", "cafe", -1.0, "other", "c")])
    s.upsert_merchants(a, "20260401")
    s.upsert_merchants(b, "1e5")
    s.upsert_merchants(a, "20260401")  # again: keeps its place before the second load
    r = s.read("merchants").where("normalized_name = 'cafe'").first()
    assert (float(r.total_spent), r.transaction_count, r.category, r.name) == (5.0, 2, "food", "Cafe")
    assert r.first_seen == datetime(2026, 4, 1) and r.last_seen == datetime(2026, 5, 1)
    assert s.read("merchants").where("normalized_name = 'big'").first().transaction_count == 1
    assert store(spark).get_merchants().count() == 0


def test_replayed_epoch_adds_nothing(spark):
    s = store(spark)
    a = tx(spark, [(1, "2026-04-01", "NETFLIX.COM", -15.0, None, "a"), (1, "2026-04-03", "SPOTIFY", -9.0, None, "b")])
    process_batch(a, 0, s)
    once = merchants(s)
    process_batch(a, 0, s)
    assert merchants(s) == once and s.read("transactions").count() == 2
    process_batch(a, 0, s, stream="other")  # another stream's epoch 0 is another load
    assert {k: v[1] for k, v in merchants(s).items()} == {k: 2 * v[1] for k, v in once.items()}


def test_runs_are_unique(spark):
    s = store(spark)
    runs = run_rows(tx(spark, [(1, "2026-01-05", "a", -1.0, None, "t"), (2, "2026-01-06", "a", -1.0, None, "t")]), ["account_id"])
    assert (s.save_runs(runs), s.save_runs(runs.unionByName(runs))) == (2, 0) and s.read("analysis_runs").count() == 2


def test_a_run_that_died_is_completed(spark):
    s = store(spark)
    rows = [(i, [1, 2, 1, None][i], datetime(2026, 1, 2 + i), -3.0 * (i + 1), n) for i, n in enumerate(["NETFLIX.COM", "SHELL OIL", "STARBUCKS", "WHOLE FOODS"])]
    led = spark.createDataFrame(rows, LEDGER)
    whole = store(spark)
    run_analysis(led, whole)
    keep, s.upsert_merchants = s.upsert_merchants, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    try:
        run_analysis(led, s)
    except RuntimeError:
        pass
    s.upsert_merchants = keep
    assert s.read("transactions").count() == 4 and s.read("merchants") is None
    run_analysis(led, s)
    assert s.read("transactions").count() == 4 and merchants(s) == merchants(whole)
    ids = {r.account_id: r.run_id for r in s.read("analysis_runs").collect()}
    assert all(ids[r.account_id] == r.run_id for r in s.read("transactions").collect())
