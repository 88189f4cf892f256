"""Quality scores from an interpolated modified Kneser-Ney n-gram model.

The units are characters (words of an open vocabulary would make nearly every
n-gram new), the order is ``ORDER``.  The model is trained on all trusted rows
(labels.quality = 1) outside a held-out fold:

* n-grams are counted in each task and summed by n-gram (sharded by n-gram);
  lower orders use continuation counts, the number of distinct characters
  before them, taken from the distinct n-grams of the next order;
* discounts D1, D2, D3+ of each order come from its counts of counts;
* every distinct n-gram of the corpus gets its probability once, by joins with
  the count tables sharded by n-gram and by context, order by order;
* documents are scored with the joined table: as an array of hashes and
  log-probabilities sent to the tasks up to ``MAX_TABLE`` n-grams, by a join
  with per-document n-gram counts beyond.

A document's perplexity is compared with quantiles, per language, of the
held-out trusted rows: below the low one it is repetitive, above the high one
unlike trusted text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.common import broadcast_if_small, materialize, with_fields
from ledgerlens.llm.textblocks import blocks, mix, seeds

ORDER = 5
BOS = "\x02"  # stands before a text's first character
LOW, HIGH = 0.005, 0.99
MAX_TABLE = 6_000_000  # n-grams (12 bytes each) sent to the tasks; more join by shuffle
MAX_BROADCAST_ROWS = 1_000_000  # (doc_id) rows of the trusted set

_U = np.uint64
_MUL = seeds(ORDER, 53)


def _grams(data: np.ndarray, off: np.ndarray) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The block's characters with ORDER-1 BOS before each text, and per
    character of a text: row, start of the n-gram that ends there, its hash."""
    lead = ORDER - 1
    starts = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[off]
    lengths = np.diff(starts)
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(lengths)), lengths)
    padded = np.full(len(chars) + lead * len(lengths), ord(BOS), np.uint32)
    at = np.arange(len(chars)) + lead * (row + 1)
    padded[at] = chars
    h = np.zeros(len(chars), _U)
    with np.errstate(over="ignore"):
        for j in range(ORDER):
            h += padded[at - lead + j].astype(_U) * _MUL[j]
    return padded, row, at - lead, mix(h)


def _plain(data: np.ndarray) -> np.ndarray:
    """NUL, which fixed-width strings lose at their end, as another control."""
    return np.where(data == 0, 1, data).astype(np.uint8)


def hash_grams(grams: list[str]) -> np.ndarray:
    c = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(len(grams), ORDER).astype(_U)
    with np.errstate(over="ignore"):
        return mix((c * _MUL[None, :]).sum(axis=1, dtype=_U))


def gram_counts(texts: DataFrame) -> DataFrame:
    """(gram, n): counts of all n-grams in the column ``text``."""
    def run(batches):
        known, total, names = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, f"<U{ORDER}")

        def send():
            return pa.RecordBatch.from_arrays([pa.array(names.tolist(), pa.string()), pa.array(total)], names=["gram", "n"])
        for b in batches:
            for _, _, data, off in blocks(b.column(0)):
                padded, _, at, h = _grams(_plain(data), off)
                u, i, n = np.unique(h, return_index=True, return_counts=True)
                c = padded[at[i][:, None] + np.arange(ORDER)] if len(i) else np.zeros((0, ORDER), np.uint32)
                s = np.frombuffer(c.astype("<u4").tobytes(), f"<U{ORDER}")
                all_h, all_n, all_s = np.concatenate([known, u]), np.concatenate([total, n]), np.concatenate([names, s])
                known, first, inv = np.unique(all_h, return_index=True, return_inverse=True)
                total = np.bincount(inv, all_n, minlength=len(known)).astype(np.int64)
                names = all_s[first]
                if len(known) > 1_000_000:  # bounded memory; the rest of the task starts anew
                    yield send()
                    known, total, names = known[:0], total[:0], names[:0]
        if len(known):
            yield send()
    return texts.select("text").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """D1, D2, D3+ from the counts of counts."""
    found = {r["n"]: r["k"] for r in counts.where("n <= 4").groupBy("n").agg(F.count("*").alias("k")).collect()}
    n1, n2, n3, n4 = (found.get(i, 0) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]


def train(texts: DataFrame) -> list[tuple[DataFrame, DataFrame, list[float]]]:
    """Per order from 1 to ORDER its counts (gram, n), context sums
    (ctx, total, back) and discounts; back is the mass left to the lower order."""
    model = []
    counts = materialize(gram_counts(texts), "grams")
    for n in range(ORDER, 0, -1):
        d = _discounts(counts)
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        # An order below the highest also counts what only follows BOS; BOS itself is never predicted.
        ctx = F.substring("gram", 1, n - 1) if n > 1 else F.lit("")
        sums = counts.groupBy(ctx.alias("ctx")).agg(F.sum("n").cast("double").alias("total"), F.sum(cut).alias("mass"))
        sums = materialize(sums.select("ctx", "total", (F.col("mass") / F.col("total")).alias("back")), "contexts")
        model.append((counts, sums, d))
        if n > 1:
            counts = materialize(counts.groupBy(F.substring("gram", 2, n - 1).alias("gram")).agg(F.count("*").alias("n")), "grams")
    return model[::-1]


def probabilities(model, grams: DataFrame) -> DataFrame:
    """(gram, logp) of each distinct ORDER-gram: interpolated over all orders."""
    want = [grams.select("gram").distinct()]
    for n in range(ORDER - 1, 0, -1):
        want.append(want[-1].select(F.substring("gram", 2, n).alias("gram")).distinct())
    letters = model[0][0].count() + 1  # seen characters and one for all others
    p = None
    for n, (counts, sums, d) in enumerate(model, start=1):
        q = materialize(want[ORDER - n], "asked")
        ctx = F.substring("gram", 1, n - 1) if n > 1 else F.lit("")
        rest = F.substring("gram", 2, n - 1)
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        q = q.join(counts, "gram", "left").withColumn("ctx", ctx).join(sums, "ctx", "left")
        if p is None:
            q = q.withColumn("low", F.lit(1.0 / letters))
        else:
            q = q.withColumn("rest", rest).join(p.select(F.col("gram").alias("rest"), F.col("p").alias("low")), "rest")
        own = F.greatest(F.coalesce((F.col("n") - cut) / F.col("total"), F.lit(0.0)), F.lit(0.0))
        p = materialize(q.select("gram", F.when(F.col("total").isNull(), F.col("low"))
                                 .otherwise(own + F.col("back") * F.col("low")).alias("p")), "probabilities")
    return p.select("gram", F.log("p").alias("logp"))


def first_places(keys: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """Of sorted hashes: where the first with each leading bits stands (one or
    two hashes a slot), and the shift that leaves these bits."""
    bits = max(1, len(keys).bit_length() - 1)
    shift = _U(64 - bits)
    return np.searchsorted(keys, np.arange(1 << bits, dtype=_U) << shift).astype(np.int32), shift


def places(keys: np.ndarray, first: np.ndarray, shift: np.uint64, h: np.ndarray) -> np.ndarray:
    """Position in ``keys`` of each of ``h``, which are all among them."""
    at = first[h >> shift]
    miss = np.flatnonzero(keys[at] != h)
    while len(miss):
        at[miss] += 1
        miss = miss[keys[at[miss]] != h[miss]]
    return at


def score(docs: DataFrame, table: DataFrame) -> DataFrame:
    """``docs`` (with column text) plus lm_chars and lm_logp."""
    spark = docs.sparkSession
    base = docs.drop("lm_chars", "lm_logp")
    schema = with_fields(base, ("lm_chars", "long"), ("lm_logp", "double"))

    if table.count() <= MAX_TABLE:
        got = table.toArrow()
        h = hash_grams(got.column("gram").to_pylist())
        order = np.argsort(h)
        shared = spark.sparkContext.broadcast((h[order], got.column("logp").to_numpy()[order].astype(np.float32), *first_places(h[order])))

        def run(batches):
            keys, logp, first, shift = shared.value
            for b in batches:
                n, total = np.zeros(len(b), np.int64), np.zeros(len(b))
                for lo, hi, data, off in blocks(b.column(b.schema.get_field_index("text")), 1 << 21):
                    _, row, _, h = _grams(_plain(data), off)
                    if len(row):
                        n[lo:hi] = np.bincount(row, minlength=hi - lo)
                        total[lo:hi] = np.bincount(row, logp[places(keys, first, shift, h)], minlength=hi - lo)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n), pa.array(total)], names=[*b.schema.names, "lm_chars", "lm_logp"])
        return base.mapInArrow(run, schema)

    # Beyond the bound: n-gram counts of each row, joined with the table.
    def counts(batches):
        for b in batches:
            ids = b.column(1)
            for lo, hi, data, off in blocks(b.column(0)):
                padded, row, at, h = _grams(_plain(data), off)
                c = padded[at[:, None] + np.arange(ORDER)] if len(at) else np.zeros((0, ORDER), np.uint32)
                s = np.frombuffer(c.astype("<u4").tobytes(), f"<U{ORDER}").tolist()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + lo)), pa.array(s, pa.string())], names=["lm_row", "gram"])

    rows = materialize(base.withColumn("lm_row", F.monotonically_increasing_id()), "rows")
    per = rows.select("text", "lm_row").mapInArrow(counts, "lm_row long, gram string").groupBy("lm_row", "gram").agg(F.count("*").alias("n"))
    sums = per.join(table, "gram").groupBy("lm_row").agg(F.sum("n").alias("lm_chars"), F.sum(F.col("n") * F.col("logp")).alias("lm_logp"))
    out = rows.join(sums, "lm_row", "left")
    return out.select(*base.columns, F.coalesce("lm_chars", F.lit(0)).cast("long").alias("lm_chars"), F.coalesce("lm_logp", F.lit(0.0)).alias("lm_logp"))


def quality(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(doc_id, lang, n_chars, perplexity, low, high, keep) of every row.

    perplexity is per character (null for null and empty texts, which are not
    kept).  low and high are the quantiles of the language's held-out trusted
    rows; a language without any takes those of all languages; without trusted
    rows at all both are null and every text with characters is kept.  Null
    lang is a language of its own.  A doc_id labelled twice is trusted if every
    row says so.  Repeated rows, null ids and extra columns are allowed."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text")
    trusted = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality").where("doc_id is not null")
               .groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
               .select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held")))
    trusted = materialize(trusted, "trusted")
    learn = broadcast_if_small(trusted.where("not held").select("doc_id"), MAX_BROADCAST_ROWS)
    model = train(rows.join(learn, "doc_id", "left_semi"))
    table = probabilities(model, materialize(gram_counts(rows), "corpus-grams"))
    scored = materialize(score(rows, table).select("doc_id", "lang", F.col("lm_chars").alias("n_chars"), F.when(
        F.col("lm_chars") > 0, F.exp(-F.col("lm_logp") / F.col("lm_chars"))).alias("perplexity")), "scored")
    held = scored.join(trusted.where("held").select("doc_id"), "doc_id", "left_semi").where("perplexity is not null")
    cut = lambda q: F.percentile_approx("perplexity", q, 10_000)
    by = held.groupBy(F.coalesce("lang", F.lit("")).alias("g")).agg(cut(low).alias("low"), cut(high).alias("high"))
    every = held.agg(cut(low).alias("all_low"), cut(high).alias("all_high")).first()  # one row
    out = scored.withColumn("g", F.coalesce("lang", F.lit(""))).join(broadcast_if_small(by, 100_000), "g", "left")
    out = (out.withColumn("low", F.coalesce("low", F.lit(every["all_low"]).cast("double")))
           .withColumn("high", F.coalesce("high", F.lit(every["all_high"]).cast("double"))))
    fits = F.coalesce((F.col("perplexity") >= F.col("low")) & (F.col("perplexity") <= F.col("high")), F.lit(True))
    return out.select("doc_id", "lang", "n_chars", "perplexity", "low", "high", (F.col("perplexity").isNotNull() & fits).alias("keep"))
