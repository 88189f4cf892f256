"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A text is the bag of its character n-grams (lengths ``NGRAMS``, over each word
between boundary marks), hashed to ``BUCKETS`` rows of an embedding table.  The
bag's mean vector goes through a linear softmax.  Table and softmax are
trained jointly by Adam in numpy.  An unseen misspelling shares most of its
n-gram vectors with the spelling seen in training.

Training uses a bounded sample of labelled rows (``max_toxic`` and
``max_clean`` texts, chosen by hash of the id).  Because the model is linear
after averaging, scoring needs one float per bucket: a table of fixed size
that is broadcast, while every text is scored whole where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.common import release_memory, with_fields
from ledgerlens.llm.textblocks import blocks, mix

NGRAMS = (3, 4, 5)
BUCKETS = 1 << 18
DIM = 8
GAIN = 30.0
EPOCHS, MIN_STEPS = 8, 300  # small samples are read more often
BATCH = 128
RATE = 0.05
DECAY = 1e-3  # pull of every used embedding toward zero, per step
MIN_TEXTS = 5  # buckets of fewer training texts stay at the zero vector
MAX_TOXIC, MAX_CLEAN = 1500, 4500
PAD = 100  # neutral n-grams added to every bag, so a few words alone decide little
THRESHOLD = 0.5

_U = np.uint64
_CODE_MUL = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                                0xE7037ED1A0B428DB)]


def ngram_buckets(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length (row of the n-gram, its bucket) over a block."""
    n_rows = len(offsets) - 1
    starts = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]  # row starts in characters
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    # Rows apart by two separators, so no n-gram spans rows.
    lengths = np.diff(starts)
    padded = np.zeros(len(chars) + 2 * (n_rows + 1), np.uint32)
    row_of_char = np.repeat(np.arange(n_rows), lengths)
    padded[np.arange(len(chars)) + 2 * row_of_char + 2] = chars
    row_of = np.repeat(np.arange(n_rows + 1), np.append(lengths + 2, 2))
    upper = (padded >= 65) & (padded <= 90)
    padded[upper] += 32
    word = ((padded >= 48) & (padded <= 57)) | ((padded >= 97) & (padded <= 122)) | (padded >= 128)
    code = np.where(word, padded, 1).astype(_U)
    with np.errstate(over="ignore"):
        for n in NGRAMS:
            m = len(code) - n + 1
            ok = word[1:m + 1].copy()
            for j in range(2, n - 1):
                ok &= word[j:m + j]
            at = np.flatnonzero(ok)
            h = np.full(len(at), n, dtype=_U)
            for j in range(n):
                h += code[at + j] * _CODE_MUL[j]
            yield row_of[at + 1], (mix(h) & _U(BUCKETS - 1)).astype(np.int64)


def text_bags(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per row (distinct buckets, their shares of the padded bag)."""
    for lo, hi, data, off in blocks(column):
        parts = list(ngram_buckets(data, off))
        row, b = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(row, kind="stable")
        row, b = row[order], b[order]
        cut = np.searchsorted(row, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            u, c = np.unique(b[cut[i]:cut[i + 1]], return_counts=True)
            yield u.astype(np.int32), (c / (PAD + c.sum())).astype(np.float32)


@dataclass
class Model:
    """One score per bucket and a bias: logit = GAIN * mean(score) + bias."""

    score: np.ndarray
    bias: float


def train(texts: list[str | None], labels: list[int], seed: int = 17) -> Model:
    """Joint training of the bucket embeddings and the softmax."""
    rng = np.random.default_rng(seed)
    # Embeddings start at zero, so a bucket never trained adds nothing.
    emb = np.zeros((BUCKETS, DIM), np.float32)
    soft = (rng.random((DIM, 2)) - 0.5).astype(np.float32)
    bias = np.zeros(2, np.float32)
    bags = list(text_bags(pa.array(texts, pa.string())))
    seen = np.zeros(BUCKETS, np.int32)
    for u, _ in bags:
        seen[u] += 1
    bags = [(u[seen[u] >= MIN_TEXTS], w[seen[u] >= MIN_TEXTS]) for u, w in bags]
    y = np.asarray(labels, dtype=np.int64)
    if len(set(labels)) < 2:  # nothing to tell apart
        p = (float(y.sum()) + 1.0) / (len(y) + 2.0)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))))
    params = [emb, soft, bias]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    epochs = max(EPOCHS, -(-MIN_STEPS // -(-len(bags) // BATCH)))
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), BATCH):
            pick = order[lo:lo + BATCH]
            sizes = np.array([len(bags[i][0]) for i in pick])
            g = np.concatenate([bags[i][0] for i in pick])
            w = np.concatenate([bags[i][1] for i in pick]) * np.float32(GAIN)
            row = np.repeat(np.arange(len(pick)), sizes)
            hidden = np.stack([np.bincount(row, w * emb[g, d], minlength=len(pick)) for d in range(DIM)], 1)
            z = hidden @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1.0
            p /= len(pick)
            back = (p @ soft.T).astype(np.float32)
            used, where = np.unique(g, return_inverse=True)
            demb = np.stack([np.bincount(where, w * back[row, d], minlength=len(used)) for d in range(DIM)], 1)
            demb += DECAY * emb[used]
            step += 1
            rate = RATE * (1 - epoch / epochs) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for k, grad in enumerate((demb, hidden.T @ p, p.sum(0))):
                at = used if k == 0 else slice(None)  # lazy moments for the rows in use
                m1[k][at] = 0.9 * m1[k][at] + 0.1 * grad
                m2[k][at] = 0.999 * m2[k][at] + 0.001 * grad * grad
                params[k][at] -= (rate * m1[k][at] / (np.sqrt(m2[k][at]) + 1e-8)).astype(np.float32)
    return Model((emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def score_texts(column: pa.Array, model: Model) -> np.ndarray:
    """Probability of the toxic class for each row (null or no word: from the bias alone)."""
    out = np.zeros(len(column))
    for lo, hi, data, off in blocks(column):
        total, count = np.zeros(hi - lo), np.zeros(hi - lo, np.int64)
        for row, b in ngram_buckets(data, off):
            total += np.bincount(row, model.score[b], minlength=hi - lo)
            count += np.bincount(row, minlength=hi - lo)
        out[lo:hi] = GAIN * total / (PAD + count) + model.bias
    return 1.0 / (1.0 + np.exp(-np.clip(out, -60, 60)))


def training_sample(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC,
                    max_clean: int = MAX_CLEAN) -> DataFrame:
    """(text, toxic) of at most ``max_toxic`` and ``max_clean`` labelled rows,
    outside the held-out fold; chosen by hash of doc_id.  A doc_id labelled
    twice counts as toxic if any row says so; null labels and ids are skipped."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    lab = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic").where("doc_id is not null and toxic is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
           .groupBy(F.col("doc_id")).agg(F.max("toxic").alias("toxic")))
    lab = lab.join(docs.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi")
    by = F.xxhash64("doc_id")
    ids = (lab.where("toxic = 1").orderBy(by, "doc_id").limit(max_toxic)
           .union(lab.where("toxic = 0").orderBy(by, "doc_id").limit(max_clean)))
    # At most max_toxic + max_clean rows by construction.
    return (docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
            .groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))


def fit(docs: DataFrame, labels: DataFrame, **bounds) -> Model:
    """Train on the bounded sample, in one task; the driver gets the model's
    BUCKETS floats only."""
    def run(batches):
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        m = train([r[2] for r in rows], [int(r[1]) for r in rows])
        yield pa.RecordBatch.from_pydict({"score": pa.array([m.score.astype("<f4").tobytes()], pa.binary()), "bias": pa.array([m.bias])})

    sample = training_sample(docs, labels, **bounds).select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text"))
    got = sample.repartition(1).mapInArrow(run, "score binary, bias double").first()
    return Model(np.frombuffer(got["score"], "<f4"), float(got["bias"]))


def add_toxicity(docs: DataFrame, model: Model, out: str = "toxicity") -> DataFrame:
    """``docs`` with one more column: the probability that the text is toxic.

    Reads only ``text``.  Null and empty texts get the bias's probability.  All
    other columns, rows and repeats pass through; a column named ``out``
    already there is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.score, model.bias))
    keep = docs.drop(out)

    def run(batches):
        m = Model(*shared.value)
        for b in batches:
            s = score_texts(b.column(b.schema.get_field_index("text")), m)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=[*b.schema.names, out])
        release_memory()

    return keep.mapInArrow(run, with_fields(keep, (out, "double")))
