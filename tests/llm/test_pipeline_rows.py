from __future__ import annotations

import random

import pytest


def prose(rng, n):
    return " ".join(f"{rng.choice('red green blue black white'.split())}{rng.randint(0, 99)}" for _ in range(n))


@pytest.fixture()
def case(spark, tmp_path):
    rng = random.Random(9)
    clean, other, third, fourth = (prose(rng, 80) for _ in range(4))
    item = prose(rng, 30)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    edited = clean.split()
    edited[40] = "edited"
    rows = [(None, clean), (None, " ".join(edited)), (None, other), (None, f"{third} {item}"), (7, fourth), (7, f"{third} {item} end"),
            (7, clean), (8, "..."), (8, "..."), (None, None), (None, None)]
    docs = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, row_number int").repartition(3)
    return docs, str(tmp_path), rows


def test_each_row_follows_its_own_contamination(spark, case):
    import corpus_pipeline as p

    docs, folder, rows = case
    out = p.remove_contaminated(spark, docs, folder)
    assert out.columns == docs.columns
    assert sorted(r.row_number for r in out.collect()) == [0, 1, 2, 4, 6, 7, 8, 9, 10]


def test_each_row_follows_its_own_class(spark, case):
    import corpus_pipeline as p

    docs, folder, rows = case
    out = p.drop_near_duplicates(spark, docs, folder)
    got = {r.row_number for r in out.collect()}
    assert out.columns == docs.columns and len(got & {0, 1, 6}) == 1 and len(got & {3, 5}) == 1
    assert got >= {2, 4, 7, 8, 9, 10} and len(got) == 8  # wordless rows all stay
