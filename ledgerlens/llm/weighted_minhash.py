"""Near duplicates by improved consistent weighted sampling (Ioffe, 2010).

A document is the set of its five-word shingles, each weighted by
tf x idf.  ``HASHES`` weighted samples per document are banded; documents that
share a band are candidates and are verified by exact weighted Jaccard
similarity (sum of minima / sum of maxima, 0.8 or more).

* idf: document frequencies of all documents are counted in a table of
  ``DF_SLOTS`` hashed slots, a fixed size however large the corpus; a slot's
  frequency is at least its shingles'.  idf = 1 + ``IDF_SPAN`` * ln((N+1)/(df+1))
  / ln(N+1).  The span is small: the shingles of a large class of near copies
  are frequent because of the class, and a steep idf would push its members
  below the threshold.
* Exact copies (same words) collapse to one representative before any pair is
  made, so a group of copies of any size is one node.
* In a band's group every member is paired with one pivot, never with every
  other; members outside the pivot's component meet further pivots.  Members
  outside it after ``PIVOT_ROUNDS`` are compared with their whole group, block
  by block, so no link between documents sharing a band is lost, while a group
  that its pivots join costs a few pairs per member.  A block sends a spanning
  forest of its links, not its pairs.
* Components of the verified links are the classes; a class id is the
  smallest doc_id in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.common import broadcast_if_small, connected_components, materialize, star_forest
from ledgerlens.llm.textblocks import blocks, content_key, mix, seeds, windows, words

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 3  # a pair at 0.8 shares a band with probability 1 - (1 - 0.8**3)**12 > 0.9998
HASHES = BANDS * ROWS
PIVOT_ROUNDS = 2
QUERY_BLOCK, MEMBER_BLOCK = 512, 1024  # rows compared in one task
IDF_SPAN = 0.1
DF_SLOTS = 1 << 20
DF_SLICES = 64
MAX_BROADCAST_ROWS = 1_000_000  # (rep, key, id) rows of 40 bytes; more join by shuffle

_U = np.uint64
_SALT = seeds(HASHES, 31)
_STEP = seeds(3, 37)


def _distinct(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per row of a block its distinct shingles and their counts."""
    row, h = windows(words(data, off), SHINGLE)
    cut = np.searchsorted(row, np.arange(len(off)))
    for i in range(len(off) - 1):
        yield np.unique(h[cut[i]:cut[i + 1]], return_counts=True)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> _U(40)).astype(np.int64) & (DF_SLOTS - 1)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Hashed document frequencies over all documents, and their number.

    A task sends one table of ``DF_SLOTS`` counts in ``DF_SLICES`` slices; the
    tables are added slice by slice as they stream in.  The result has a fixed
    size.
    """
    width = DF_SLOTS // DF_SLICES

    def count(batches):
        table, n = np.zeros(DF_SLOTS, np.int32), 0
        for b in batches:
            for lo, hi, data, off in blocks(b.column(0)):
                n += hi - lo
                for h, _ in _distinct(data, off):
                    table[np.unique(_slot(h))] += 1
        yield pa.RecordBatch.from_pydict({
            "slice": pa.array(range(DF_SLICES), pa.int32()), "n": pa.array([n] + [0] * (DF_SLICES - 1), pa.int64()),
            "counts": pa.array([t.tobytes() for t in table.reshape(DF_SLICES, width)], pa.binary())})

    def add(batches):
        total, n = {}, 0
        for b in batches:
            n += sum(b.column(1).to_pylist())
            for s, c in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                t = total.setdefault(s, np.zeros(width, np.int64))
                t += np.frombuffer(c, np.int32)
        keys = sorted(total)
        yield pa.RecordBatch.from_pydict({
            "slice": pa.array(keys, pa.int32()), "n": pa.array([n] + [0] * (len(keys) - 1) if keys else [], pa.int64()),
            "counts": pa.array([np.minimum(total[k], 2**31 - 1).astype(np.int32).tobytes() for k in keys], pa.binary())})

    schema = "slice int, n long, counts binary"
    got = (docs.select("text").mapInArrow(count, schema).repartition(DF_SLICES, "slice")
           .mapInArrow(add, schema).collect())  # DF_SLICES rows
    df = np.zeros(DF_SLOTS, np.int64)
    for r in got:
        df[r["slice"] * width:(r["slice"] + 1) * width] = np.frombuffer(r["counts"], np.int32)
    return df, sum(r["n"] for r in got)


def idf_table(df: np.ndarray, n: int) -> np.ndarray:
    return (1 + IDF_SPAN * np.log((n + 1) / (np.minimum(df, n) + 1)) / np.log(max(n, 1) + 1)).astype(np.float32)


def signature(h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Improved consistent weighted samples of a weighted set: per hash the
    sampled (element, quantised weight) as 64 bits."""
    best = np.full(HASHES, np.inf)
    out = np.zeros(HASHES, _U)
    unit = 1.0 / (1 << 24)
    for lo in range(0, len(h), 8192):  # bounded memory for very long texts
        e, lw = h[lo:lo + 8192, None], np.log(weight[lo:lo + 8192, None].astype(np.float64))
        with np.errstate(over="ignore"):
            x1 = mix(e ^ _SALT[None, :])
            x2 = mix(x1 + _STEP[0])
            low = _U(0xFFFFFF)
            u = [((v & low).astype(np.float64) + 0.5) * unit for v in (x1, x1 >> _U(24), x2, x2 >> _U(24))]
            beta = (((x1 >> _U(48)) | ((x2 >> _U(48)) << _U(16))).astype(np.float64) + 0.5) / (1 << 32)
            r = -np.log(u[0] * u[1])  # Gamma(2, 1)
            log_c = np.log(-np.log(u[2] * u[3]))  # log of Gamma(2, 1)
            t = np.floor(lw / r + beta)
            log_a = log_c - r * (t - beta) - r
            at = np.argmin(log_a, axis=0)
            col = np.arange(HASHES)
            value = log_a[at, col]
            sample = mix(e[at, 0] ^ (t[at, col].astype(np.int64).astype(_U) * _STEP[2]))
        better = value < best
        best[better], out[better] = value[better], sample[better]
    return out


def _bands(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        rows = sig.reshape(BANDS, ROWS)
        key = np.arange(1, BANDS + 1, dtype=_U) * _STEP[0]
        for j in range(ROWS):
            key = mix(key ^ rows[:, j]) + _STEP[1]
    return key.astype(np.int64)


def _samples(docs: DataFrame, idf, row: str | None = None) -> DataFrame:
    """(doc_id, k1, k2, total, bands) of every row, and its number (num) from
    the column ``row``, if any: the 128-bit key of its word sequence ((0, 0)
    without words), its total weight and its band keys."""
    def run(batches):
        table, known = idf.value, {}
        for b in batches:
            k = [np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)]
            total, bands = np.zeros(len(b)), []
            for lo, hi, data, off in blocks(b.column(1)):
                w = words(data, off)
                k[0][lo:hi], k[1][lo:hi] = content_key(w, hi - lo)
                row, h = windows(w, SHINGLE)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    key = (k[0][lo + i], k[1][lo + i])
                    if key not in known:  # copies in one task are sampled once
                        e, c = np.unique(h[cut[i]:cut[i + 1]], return_counts=True)
                        weight = c * table[_slot(e)]
                        if len(known) >= 20_000:
                            known.clear()
                        known[key] = (float(weight.sum()), _bands(signature(e, weight)) if len(e) else np.zeros(0, np.int64))
                    total[lo + i] = known[key][0]
                    bands.append(known[key][1])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(k[0]), pa.array(k[1]), pa.array(total), pa.array(bands, pa.list_(pa.int64())), *b.columns[2:]],
                names=["doc_id", "k1", "k2", "total", "bands", *b.schema.names[2:]])
    num = [F.col(row).cast("bigint").alias("num")] if row else []
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *num)
    return rows.mapInArrow(run, "doc_id long, k1 long, k2 long, total double, bands array<long>" + ", num long" * len(num))


def _texts_of(docs: DataFrame, pick: DataFrame) -> DataFrame:
    """(rep, text) for each picked (rep, k1, k2, own): the text of a row with
    that key and id.  Repeated rows give a text more than once."""
    def run(batches):
        for b in batches:
            k = [np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)]
            for lo, hi, data, off in blocks(b.column(1)):
                k[0][lo:hi], k[1][lo:hi] = content_key(words(data, off), hi - lo)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(k[0]), pa.array(k[1])],
                                             names=["doc_id", "text", "t1", "t2"])
    rows = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
            .mapInArrow(run, "doc_id long, text string, t1 long, t2 long"))
    return rows.join(broadcast_if_small(pick, MAX_BROADCAST_ROWS),
                     (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2"))
                     & F.col("doc_id").eqNullSafe(F.col("own"))).select("rep", "text")


def weighted_jaccard(h1, w1, h2, w2) -> float:
    """Of two sorted weighted sets: sum of minima / sum of maxima."""
    at = np.searchsorted(h2, h1)
    at[at == len(h2)] = 0
    both = h2[at] == h1 if len(h2) else np.zeros(len(h1), bool)
    low = float(np.minimum(w1[both], w2[at[both]]).sum(dtype=np.float64)) if both.any() else 0.0
    high = float(w1.sum(dtype=np.float64)) + float(w2.sum(dtype=np.float64)) - low
    return low / high if high > 0 else 0.0


def _verify(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """The pairs (a, b) with their weighted Jaccard similarity s."""
    def sets(table, ids, column):
        at = np.unique(ids, return_index=True)[1]
        out = {}
        for lo, _, data, off in blocks(column.take(pa.array(at))):
            for i, (h, c) in enumerate(_distinct(data, off)):
                out[ids[at[lo + i]]] = (h, c * table[_slot(h)])
        return out

    def run(batches):
        table = idf.value
        for b in batches:
            x, y = (b.column(i).to_numpy() for i in (0, 1))
            one, two = sets(table, x, b.column(2)), sets(table, y, b.column(3))
            s = [weighted_jaccard(*one[i], *two[j]) for i, j in zip(x, y)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64())], names=["a", "b", "s"])
    one = texts.select(F.col("rep").alias("a"), F.col("text").alias("t1"))
    two = texts.select(F.col("rep").alias("b"), F.col("text").alias("t2"))
    # The pivot side may repeat often; it joins last, as a skewed join that Spark splits.
    joined = pairs.join(two, "b").join(one, "a").select("a", "b", "t1", "t2")
    return joined.mapInArrow(run, "a long, b long, s double")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, class_id, kept, and the column ``row`` if
    one is named, which numbers the rows of a written table.

    class_id is the smallest doc_id among documents linked, directly or
    through others, by equal word sequences or a weighted Jaccard similarity
    of ``threshold`` or more; kept marks exactly one row per class, the first
    by (doc_id, repeat).  Null, empty and wordless texts link with nothing:
    each such row is kept, its class_id its own doc_id.  A text of one to four
    words is one shingle.  Rows with a null doc_id take part; their class_id is
    the smallest non-null id of the class, if any.  Repeated rows are copies.
    Reads doc_id and text only; other columns are ignored.
    """
    spark = docs.sparkSession
    df, n = document_frequencies(docs)
    idf = spark.sparkContext.broadcast(idf_table(df, n))  # DF_SLOTS floats
    sampled = materialize(_samples(docs, idf, row), "samples")
    # Rows of one key have the same words, so the same total and bands.
    reps = materialize(sampled.where("k1 <> 0 or k2 <> 0").groupBy("k1", "k2")
                       .agg(F.min("doc_id").alias("first"), F.first("total").alias("total"), F.first("bands").alias("bands"))
                       .withColumn("rep", F.monotonically_increasing_id()), "reps")
    members = reps.select("rep", "total", F.explode("bands").alias("band"))
    # Groups of at least two; map-side counts, one row per band value.  The
    # pivot of a group is its member with the most company over all its bands,
    # which in a family of edits is the text they were edited from.
    groups = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(members.join(groups, "band"), "band-groups")
    company = members.groupBy("rep").agg(F.sum("n").alias("company"))
    known = members.drop("n").join(company, "rep")
    pivots = known.groupBy("band").agg(F.max(F.struct("company", (-F.col("rep")).alias("r"))).alias("p")).select("band", (-F.col("p.r")).alias("pivot"))
    members = materialize(members.drop("n").join(pivots, "band"), "members")
    first = materialize(_ordered(members.where("rep <> pivot"), "pivot", "rep").distinct(), "pairs")
    pick = reps.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "k1", "k2", F.col("first").alias("own"))
    texts = materialize(_texts_of(docs, materialize(pick, "pick")), "texts")
    known = materialize(_verify(first, texts, idf), "similarities")
    # Every member's similarity to its group's pivot.
    own = _ordered(members, "pivot", "rep", "band", "rep", "total", "pivot").join(known, ["a", "b"], "left")
    members = materialize(own.select("band", "rep", "total", "pivot", F.coalesce("s", F.lit(1.0)).alias("sp")), "members")
    far = 1 - threshold + 1e-6
    placed = _place(members, known.where(F.col("s") >= threshold - 1e-6))
    for _ in range(PIVOT_ROUNDS - 1):
        # The most similar member outside the pivot's component meets all members of other components.
        odd = placed.where("component <> pc")
        if not odd.head(1):
            break
        nxt = odd.groupBy("band").agg(F.max(F.struct("sp", "rep", "component", "total")).alias("p")).select(
            "band", F.col("p.rep").alias("x"), F.col("p.component").alias("cx"), F.col("p.total").alias("tx"), F.col("p.sp").alias("sx"))
        pairs = _pairs(nxt, _named(placed, "y"), threshold, far, F.lit(True))
        known = materialize(known.union(_verify(materialize(pairs.join(known, ["a", "b"], "left_anti"), "pairs"), texts, idf)), "similarities")
        placed = _place(members, known.where(F.col("s") >= threshold - 1e-6))
    rest = _cross_links(placed, texts, idf, threshold)
    links2 = materialize(known.where(F.col("s") >= threshold - 1e-6).select("a", "b").union(rest), "links")
    comp = connected_components(links2).select(F.col("node").alias("rep"), "component")
    of = reps.join(comp, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    of = materialize(of.select("k1", "k2", "first", "component"), "classes")
    lead = of.groupBy("component").agg(F.min("first").alias("class_id"))
    of = of.join(lead, "component").withColumn("leads", F.col("first").eqNullSafe(F.col("class_id")))
    marked = _mark(sampled.drop("total", "bands"), of)
    return marked.withColumnRenamed("num", row) if row else marked


def _place(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members of band groups with their component and the pivot's (pc)."""
    comp = connected_components(links)
    placed = members.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    pc = comp.select(F.col("node").alias("pivot"), F.col("component").alias("pc"))
    return materialize(placed.join(pc, "pivot", "left").withColumn("pc", F.coalesce("pc", "pivot")), "placed")


def compare_sets(q: list[tuple], m: list[tuple], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all pairs of weighted sets (hashes, counts, idf)
    whose weighted Jaccard similarity reaches the threshold.

    The k-th occurrence of a shingle is a feature of its own, so a sum of
    minima is a product of 0/1 rows; shared features are multiplied in slices."""
    both = [*q, *m]
    row = np.repeat(np.arange(len(both)), [int(c.sum()) for _, c, _ in both])
    nth = np.concatenate([np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) for _, c, _ in both]).astype(_U)
    h = np.concatenate([np.repeat(e, c) for e, c, _ in both])
    w = np.concatenate([np.repeat(x, c) for _, c, x in both]).astype(np.float64)
    total = np.bincount(row, w, minlength=len(both))
    with np.errstate(over="ignore"):
        _, first, col, times = np.unique(mix(h + nth * _STEP[0]), return_index=True, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    place = np.full(len(times), -1)
    place[shared] = np.arange(len(shared))
    at = place[col]
    row, at, weight = row[at >= 0], at[at >= 0], w[first[shared]]
    common = np.zeros((len(q), len(m)))
    for lo in range(0, len(shared), 4096):
        hit = (at >= lo) & (at < lo + 4096)
        x = np.zeros((len(both), min(4096, len(shared) - lo)))
        x[row[hit], at[hit] - lo] = 1.0
        common += (x[:len(q)] * weight[lo:lo + 4096]) @ x[len(q):].T
    high = total[:len(q), None] + total[None, len(q):] - common
    return np.nonzero(common >= (threshold - 1e-6) * high)


def _cross_links(placed: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """Links (a, b) between the members outside their group's pivot component
    and all members of their groups, as a spanning forest of each block."""
    sizes = materialize(placed.groupBy("band").agg(
        F.ceil(F.sum((F.col("component") != F.col("pc")).cast("long")) / QUERY_BLOCK).alias("nq"),
        F.ceil(F.count("*") / MEMBER_BLOCK).alias("nm")).where("nq > 0"), "odd-groups")
    dealt = placed.join(sizes, "band")
    zero = F.lit(0).cast("long")
    q = dealt.where("component <> pc").select("band", F.pmod(F.xxhash64("rep"), F.col("nq")).alias("qb"),
                                              F.explode(F.sequence(zero, F.col("nm") - 1)).alias("mb"), "rep", F.lit(True).alias("query"))
    m = dealt.select("band", F.explode(F.sequence(zero, F.col("nq") - 1)).alias("qb"),
                     F.pmod(F.xxhash64("rep", F.lit(1)), F.col("nm")).alias("mb"), "rep", F.lit(False).alias("query"))
    rows = q.unionByName(m).join(texts.dropDuplicates(["rep"]), "rep")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table = idf.value
        sets = []
        for _, _, data, off in blocks(pa.array(pdf["text"], pa.string())):
            sets += [(h, c, table[_slot(h)]) for h, c in _distinct(data, off)]
        ask, ids = pdf["query"].to_numpy(), pdf["rep"].to_numpy()
        if not ask.any() or ask.all():
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        i, j = compare_sets([s for s, k in zip(sets, ask) if k], [s for s, k in zip(sets, ask) if not k], threshold)
        links = star_forest(ids[ask][i], ids[~ask][j])
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return rows.groupBy("band", "qb", "mb").applyInPandas(run, "a long, b long")


def _ordered(df: DataFrame, x: str, y: str, *keep: str) -> DataFrame:
    """(a, b), the smaller and the larger of two columns, and the kept ones."""
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), *keep)


def _named(placed: DataFrame, x: str, *more) -> DataFrame:
    end = x[-1]
    return placed.select("band", F.col("rep").alias(x), F.col("component").alias(f"c{end}"), F.col("total").alias(f"t{end}"),
                         F.col("sp").alias(f"s{end}"), *more)


def _pairs(one: DataFrame, two: DataFrame, threshold: float, far: float, which) -> DataFrame:
    """Distinct pairs (a, b) of rows of a band in different components that may
    reach the threshold: similarity cannot exceed the ratio of the total
    weights, and 1 - similarity is a metric, so two rows whose similarities to
    the pivot differ by more than 1 - threshold are too far apart."""
    may = ((F.col("cx") != F.col("cy")) & which & (F.abs(F.col("sx") - F.col("sy")) <= far)
           & (F.least("tx", "ty") >= F.greatest("tx", "ty") * (threshold - 1e-6)))
    return _ordered(one.join(two, "band").where(may), "x", "y").distinct()


def _mark(keyed: DataFrame, of: DataFrame) -> DataFrame:
    """Class and kept flag for every row.  One row per class leads: the first
    of the rows holding the leading representative's smallest id."""
    num = [c for c in keyed.columns if c == "num"]
    rows = keyed.withColumn("row", F.col("num") if num else F.monotonically_increasing_id())  # over a written table
    hit = rows.join(of, ["k1", "k2"], "left")
    lead = F.col("leads") & F.col("doc_id").eqNullSafe(F.col("first"))
    # Ties: rows that repeat (component, id) of a leader; only such rows are compared.
    best = (hit.where(lead).groupBy("component").agg(F.min("row").alias("best"))
            .withColumnRenamed("component", "c"))
    out = hit.join(best, (F.col("row") == F.col("best")) & (F.col("component") == F.col("c")), "left")
    return out.select("doc_id", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      (F.col("component").isNull() | F.col("best").isNotNull()).alias("kept"), *num)
