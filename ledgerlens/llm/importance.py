"""Importance resampling of documents toward a target text distribution.

Both distributions are hashed n-gram counts.  A text's UTF-8 bytes go through
one 256-byte table that lower-cases A-Z and blanks every separator, and
``bytes.split`` yields its words.  ``zlib.crc32`` takes a running value, so the
crc of an n-gram continues the crc of its first n-1 words.  Counters of the
buckets are reduced per task and summed by Spark; the table of gains has one
entry per bucket.  Weight and Gumbel noise give each document a score, and the
highest scores are drawn (sampling without replacement).
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.common import fresh_name, materialize, stretch

BUCKETS = 10_000
MAX_N = 3
MIN_WORDS = 20
SHARE = 5  # percent of the documents with MIN_WORDS words
SEED = 42
CHUNK_WORDS = 1 << 17  # words of a text whose n-grams are held at once

# Digits, letters and all non-ASCII bytes are word bytes; A-Z become a-z; the rest is blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


def ngram_crcs(words: list[bytes], max_n: int = MAX_N) -> Iterator[list[int]]:
    """The crc32 of every run of 1 to ``max_n`` words joined by one space,
    repeats kept, in bounded lists."""
    for lo in range(0, len(words), CHUNK_WORDS):
        part = words[lo:lo + CHUNK_WORDS + max_n - 1]
        spaced = [b" " + w for w in part]
        crc = list(map(zlib.crc32, part))
        starts = min(CHUNK_WORDS, len(words) - lo)
        yield crc[:starts]
        for n in range(1, max_n):
            crc = list(map(zlib.crc32, spaced[n:], crc))
            yield crc[:starts]


def _buckets(crcs: list[int], buckets: int) -> np.ndarray:
    return np.array(crcs, dtype=np.uint32) % np.uint32(buckets)


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, max_n: int = MAX_N) -> DataFrame:
    """(bucket, n): features of all texts per bucket; a task sends at most
    ``buckets`` rows."""
    def run(batches):
        total: Counter[int] = Counter()
        for b in batches:
            for text in b.column(0):
                for crcs in ngram_crcs(word_list(text.as_py()), max_n):
                    total.update(_buckets(crcs, buckets).tolist())
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(list(total), pa.int32()), "n": pa.array(list(total.values()), pa.int64())})
    counts = texts.select(texts[text_col].alias("text")).mapInArrow(run, "bucket int, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed target share over its raw share."""
    s_all, t_all = sum(raw.values()), sum(target.values())
    return np.array([math.floor(1000 * math.log(float((target.get(b, 0) + 1) * (s_all + buckets)) / float((raw.get(b, 0) + 1) * (t_all + buckets))))
                     for b in range(buckets)], dtype=np.int64)


def noise(doc_id, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, fixed by the id; a null id has an empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weigh(table: np.ndarray, max_n: int, seed: int):
    buckets = len(table)

    def run(batches):
        for b in batches:
            words, feats, weight = [], [], []
            for text in b.column(2):
                w = word_list(text.as_py())
                n = total = 0
                for crcs in ngram_crcs(w, max_n):
                    n += len(crcs)
                    total += int(table[_buckets(crcs, buckets)].sum())
                words.append(len(w))
                feats.append(n)
                weight.append(total)
            ids = b.column(1).to_pylist()
            score = [x + noise(i, seed) for x, i in zip(weight, ids)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in (words, feats, weight, score))],
                                             names=["row", "doc_id", "n_words", "n_features", "weight", "score"])
    return run


def importance(docs: DataFrame, target: DataFrame, row: str | None = None, share: int = SHARE, min_words: int = MIN_WORDS,
               buckets: int = BUCKETS, max_n: int = MAX_N, seed: int = SEED, id_col: str = "doc_id",
               text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(row, doc_id, n_words, n_features, weight, score, rank) of every row.

    ``row`` names a column that numbers the rows (from a written table); null
    without one.  rank is 1, 2, 3... over the floor(share % of N) highest
    scores among the N rows of ``min_words`` words or more, null for the rest;
    ties go to the smaller id, null ids last, then by n_features, weight and
    row, so rows that still tie are alike.  Null and empty texts have no words
    and weight 0; very long texts are taken whole, a bounded run of words at a
    time.  Repeated rows count and are ranked each.  An empty ``docs`` gives no
    rows; an empty ``target`` leaves its smoothed uniform share.  Other columns
    are ignored.

    The tables of counts have at most ``buckets`` rows; they alone reach the
    driver.  The rank is global: rows are range-partitioned by score and
    numbered inside their partition after the rows of the partitions before.
    """
    spark = docs.sparkSession
    # At most ``buckets`` rows each.
    raw = {r.bucket: r.n for r in bucket_counts(docs, text_col, buckets, max_n).collect()}
    wanted = {r.bucket: r.n for r in bucket_counts(target, target_col, buckets, max_n).collect()}
    rows = docs.select((docs[row].cast("bigint") if row else F.lit(None).cast("bigint")).alias("row"),
                       docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    scored = rows.mapInArrow(_weigh(gains(raw, wanted, buckets), max_n, seed),
                             "row long, doc_id long, n_words long, n_features long, weight long, score long")
    scored = scored.withColumn("short", F.col("n_words") < min_words)
    order = ["short", F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight", F.asc_nulls_last("row")]
    scored = (scored.repartitionByRange(stretch(spark), *order).sortWithinPartitions(*order)
              .withColumn("place", F.monotonically_increasing_id()))  # partition * 2^33 + position in it
    scored = materialize(scored, "importance")
    part = F.shiftright("place", 33).alias("part")
    sizes = scored.groupBy(part).agg(F.count("*").alias("n"), F.count_if(~F.col("short")).alias("long_enough"))
    # One row per partition.
    sizes = sorted(sizes.collect(), key=lambda r: r.part)
    drawn = share * sum(r.long_enough for r in sizes) // 100
    before, first = 0, []
    for r in sizes:
        first.append((r.part, before))
        before += r.n
    first = spark.createDataFrame(first, "part long, before long")
    place = F.col("before") + F.col("place") - F.shiftleft(F.col("part"), 33) + 1
    return (scored.withColumn("part", part).join(F.broadcast(first), "part")
            .select("row", "doc_id", "n_words", "n_features", "weight", "score", F.when(place <= drawn, place).alias("rank")))


def resample(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns (settings of :func:`importance`)."""
    row = fresh_name(docs, "row_number")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    ranks = importance(numbered, target, row=row, **settings)
    drawn = ranks.where("rank is not null").select(F.col("row").alias(row))
    return numbered.join(drawn, row, "left_semi").drop(row)
