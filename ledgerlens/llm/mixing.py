"""Mixing sources to target weights by soft domain membership.

A softmax classifier over hashed byte trigrams, trained on a bounded sample of
labelled rows, gives every document posterior probabilities p of the domains.
With n tokens in a document and rate x (its expected number of copies), domain
k holds sum_i n_i p_ik x_i expected tokens.  Accelerated projected gradient
fits nonnegative rates by least squares so that those totals match the targets,
starting from x = 1.

The gradient step is taken in sqrt(n) x, so rates depend on membership and not
on length.  Rates stay with their rows: one iteration is one pass over the
posterior table that replays the (few numbers of) earlier residuals per row
and sums one vector of K domain totals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ledgerlens.llm.common import materialize, release_memory, with_fields
from ledgerlens.llm.textblocks import blocks, mix, words

FEATURES = 2048
SAMPLE_PER_DOMAIN = 400
TRAIN_STEPS = 150
MAX_ITERATIONS, TOLERANCE = 120, 1e-4  # rounds, share of a domain's target; a fit that ends short of its targets says by how much


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Square roots of hashed byte-trigram shares, one row per text."""
    n = len(off) - 1
    out = np.zeros((n, FEATURES), np.float32)
    if len(data) >= 3:
        d = data.astype(np.uint64)
        code = d[:-2] << np.uint64(16) | d[1:-1] << np.uint64(8) | d[2:]
        row = np.repeat(np.arange(n), np.diff(off))[:len(code)]
        ok = row == np.repeat(np.arange(n), np.diff(off))[2:]
        b = (mix(code) & np.uint64(FEATURES - 1)).astype(np.int64)
        out = np.bincount((row * FEATURES + b)[ok], minlength=n * FEATURES).reshape(n, FEATURES).astype(np.float32)
    return np.sqrt(out / np.maximum(out.sum(1, keepdims=True), 1))


def train_classifier(texts: list[str | None], domains: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression (weights, bias) by Adam; full batches."""
    x = np.concatenate([features(d, o) for _, _, d, o in blocks(pa.array(texts, pa.string()))])
    y = np.asarray(domains)
    share = np.bincount(y, minlength=k) / len(y)
    w, b = np.zeros((FEATURES, k)), np.log(np.maximum(share, 1e-6))
    m = [np.zeros_like(w), np.zeros_like(b)]
    v = [np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, TRAIN_STEPS + 1):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        for i, (par, g) in enumerate(((w, x.T @ p / len(y) + 1e-5 * w), (b, p.mean(0)))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            par -= 0.3 * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.99 ** t)) + 1e-8)
    return w, b


def labelled_sample(docs: DataFrame, labels: DataFrame, per_domain: int = SAMPLE_PER_DOMAIN) -> list:
    """At most ``per_domain`` labelled texts of each domain lang/quality,
    chosen by hash of doc_id: [(doc_id, domain, text)]."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text")
    lab = (labels.select("doc_id", "quality").where("doc_id is not null and quality is not null")
           .groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.max("quality").alias("quality")))
    rows = (docs.where("doc_id is not null").join(lab, F.col("doc_id") == F.col("id"))
            .select("doc_id", F.concat_ws("/", F.coalesce("lang", F.lit("none")), F.concat(F.lit("q"), "quality")).alias("domain"),
                    F.xxhash64("doc_id").alias("at")))
    rows = rows.groupBy("doc_id", "at").agg(F.min("domain").alias("domain"))  # an id of several languages has one domain
    # The hash is uniform, so its lowest 4 * per_domain / n share of a domain holds
    # the per_domain lowest rows: only those are ranked, however large the domain.
    share = rows.groupBy("domain").agg((F.lit(4.0 * per_domain) / F.count(F.lit(1))).alias("share"))
    low = (rows.join(F.broadcast(share), "domain")  # one row a domain
           .where(F.col("at").cast("double") / 2.0**64 + 0.5 <= F.col("share")).drop("share"))
    w = Window.partitionBy("domain").orderBy("at", "doc_id")
    pick = low.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_domain)
    ids = F.broadcast(pick.select(F.col("doc_id").alias("id"), "domain"))  # per_domain rows a domain
    got = docs.join(ids, F.col("doc_id") == F.col("id")).groupBy("doc_id", "domain").agg(F.min("text").alias("text"))
    return sorted((r["doc_id"], r["domain"], r["text"]) for r in got.collect())


def add_posteriors(docs: DataFrame, weights: np.ndarray, bias: np.ndarray, prefix: str = "mix") -> DataFrame:
    """``docs`` with mix_tokens (words) and mix_domains (posterior array)."""
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))
    n_col, p_col = f"{prefix}_tokens", f"{prefix}_domains"
    keep = docs.drop(n_col, p_col)

    def run(batches):
        w, b = shared.value
        for batch in batches:
            n, post = np.zeros(len(batch), np.int64), np.zeros((len(batch), len(b)))
            for lo, hi, data, off in blocks(batch.column(batch.schema.get_field_index("text")), 1 << 21):
                n[lo:hi] = np.bincount(words(data, off).row, minlength=hi - lo)
                z = features(data, off) @ w + b
                z = np.exp(z - z.max(1, keepdims=True))
                post[lo:hi] = z / z.sum(1, keepdims=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(list(post), pa.list_(pa.float64()))],
                                             names=[*batch.schema.names, n_col, p_col])
        release_memory()

    return keep.mapInArrow(run, with_fields(keep, (n_col, "long"), (p_col, "array<double>")))


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k) if len(column) else np.zeros((0, k))


def replay(p: np.ndarray, residuals: np.ndarray, scale: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates x and look-ahead rates y of rows with posteriors p after the given
    residuals (one row per iteration) of accelerated projected gradient."""
    x = y = np.ones(len(p))
    t = 1.0
    for r in residuals:
        new = np.maximum(0.0, y - step * (p @ (r / scale)))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = np.maximum(0.0, new + (t - 1) / t2 * (new - x))
        x, t = new, t2
    return x, y


def fit_rates(scored: DataFrame, targets: np.ndarray, prefix: str = "mix") -> tuple[np.ndarray, np.ndarray, float, float]:
    """Weighted residual history, scale and step of the fit, which with :func:`replay`
    give every row's rate, and the largest share by which a domain misses its target.

    Rounds go on until every domain is within ``TOLERANCE`` of its target, at
    most ``MAX_ITERATIONS``: targets that few rows can meet are approached only."""
    k = len(targets)
    total = float(targets.sum())
    scale = np.where(targets > 0, targets, total)
    want = targets / scale

    def sums(residuals, step, gram=False):
        hist = np.array(residuals).reshape(-1, k)

        def run(batches):
            acc = np.zeros(k * k if gram else k)
            for b in batches:
                n, p = b.column(0).to_numpy().astype(float), _matrix(b.column(1), k)
                if gram:
                    a = np.sqrt(n)[:, None] * p / scale
                    acc += (a.T @ a).ravel()
                else:
                    acc += (n * replay(p, hist, scale, step)[1]) @ p / scale
            yield pa.RecordBatch.from_pydict({"v": pa.array([acc], pa.list_(pa.float64()))})
        got = scored.select(f"{prefix}_tokens", f"{prefix}_domains").mapInArrow(run, "v array<double>")
        # One vector of K numbers per task, added on the way to the driver.
        parts = (got.select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect())
        out = np.zeros(k * k if gram else k)
        for r in parts:
            out[r["i"]] = r["v"]
        return out

    # Residuals are weighted by the inverse Gram matrix of the domains, which
    # makes 1 the right step and evens out domains of different size.
    g = sums([], 0.0, gram=True).reshape(k, k)
    weight = np.linalg.pinv(g + 1e-9 * np.trace(g) * np.eye(k))
    step = 1.0
    residuals: list[np.ndarray] = []
    while True:
        r = sums(residuals, step) - want
        if np.abs(r).max() < TOLERANCE or len(residuals) == MAX_ITERATIONS:
            break
        residuals.append(weight @ r)
    return np.array(residuals).reshape(-1, k), scale, step, float(np.abs(r).max())


def default_targets(names: list[str], tokens: np.ndarray, low_quality: float = 0.05, power: float = 0.7,
                    margin: float = 1.02) -> np.ndarray:
    """Languages by tokens**power, ``low_quality`` of each language's share for
    its q0 domain (all of it where only one is present).  The total is the
    least at which every q1 domain holds ``margin`` times its own tokens, so
    trusted text is repeated rather than dropped."""
    langs = [n.rsplit("/", 1)[0] for n in names]
    by = {g: sum(tokens[i] for i in range(len(names)) if langs[i] == g) ** power for g in langs}
    share = np.zeros(len(names))
    for i, n in enumerate(names):
        both = {m for m in names if m.rsplit("/", 1)[0] == langs[i]}
        part = 1.0 if len(both) == 1 else low_quality if n.endswith("/q0") else 1 - low_quality
        share[i] = by[langs[i]] * part
    share /= max(share.sum(), 1e-300)
    whole = [tokens[i] / share[i] for i, n in enumerate(names) if not n.endswith("/q0") and share[i] > 0]
    return margin * max(whole, default=tokens.sum()) * share


def mix_to_targets(docs: DataFrame, labels: DataFrame, targets=default_targets, prefix: str = "mix") -> DataFrame:
    """``docs`` with mix_tokens, mix_domains, mix_rate, mix_copies and
    mix_residual (``prefix`` names another beginning; columns of these names are
    replaced).

    mix_residual, the same in every row, is the largest share by which the fit
    misses a domain's target: below ``TOLERANCE`` where the targets can be met.

    mix_copies is the integer part of the rate plus one with the probability
    of the fraction, drawn by hash of doc_id and text.  Documents without
    words belong to the prior's domains with 0 tokens.  Without labelled rows
    every rate is 1.  Null ids, repeated rows and extra columns pass through.
    """
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels)
    names = sorted({d for _, d, _ in sample})
    if names:
        weights, bias = train_classifier([t for _, _, t in sample], [names.index(d) for _, d, _ in sample], len(names))
    else:
        weights, bias = np.zeros((FEATURES, 1)), np.zeros(1)
    k = len(bias)
    scored = materialize(add_posteriors(docs, weights, bias, prefix), "posteriors")
    n_col, p_col, r_col, c_col, e_col = (f"{prefix}_{x}" for x in ("tokens", "domains", "rate", "copies", "residual"))
    tokens = np.zeros(k)
    for r in (scored.select(F.posexplode(p_col).alias("i", "p"), F.col(n_col).alias("n")).groupBy("i")
              .agg(F.sum(F.col("p") * F.col("n")).alias("t")).collect()):
        tokens[r["i"]] = r["t"]
    want = targets(names, tokens) if names else tokens
    hist, scale, step, missed = (fit_rates(scored, np.asarray(want), prefix) if tokens.sum() > 0
                                 else (np.zeros((0, k)), np.ones(k), 0.0, 0.0))
    shared = spark.sparkContext.broadcast((hist, scale, step))
    base = scored.drop(r_col, c_col, e_col)

    def run(batches):
        h, s, st = shared.value
        for b in batches:
            x, _ = replay(_matrix(b.column(b.schema.get_field_index(p_col)), k), h, s, st)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(x)], names=[*b.schema.names, r_col])

    rated = base.mapInArrow(run, with_fields(base, (r_col, "double")))
    draw = (F.xxhash64(F.lit("mix"), "doc_id", "text").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52)))
    floor = F.floor(r_col)
    return (rated.withColumn(c_col, (floor + (draw < F.col(r_col) - floor).cast("int")).cast("long"))
            .withColumn(e_col, F.lit(missed)))
