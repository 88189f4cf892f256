"""Removal of repeated byte strings across a corpus.

A byte is removed if a string of ``MIN_LENGTH`` bytes that covers it also
starts somewhere else.  Texts are cut where equal strings must meet: every
window of MIN_LENGTH bytes is assigned to its anchor, the ``ANCHOR``-byte
string in it with the least hash, so equal windows have equal anchors at equal
offsets.  A run of windows with one anchor occurrence is a segment, and
segments meet by anchor hash:

1. anchors that occur once are dropped (counted before anything is moved);
2. equal segments collapse to one with a multiplicity; a group with a single
   string is settled by that;
3. the distinct segments of the other groups are indexed in blocks of whole
   groups: suffix order, Burrows-Wheeler transform, then breadth-first
   backward extension of intervals, which derives the common-prefix array by
   increasing value and stops at MIN_LENGTH.  What is still unset separates
   no windows: suffixes between two set places share MIN_LENGTH bytes.

A group too large for a block is dealt again by the content around narrower
ranges of offsets, down to a single offset, where the key is the whole window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.common import broadcast_if_small, materialize, stretch
from ledgerlens.llm.textblocks import blocks, byte_prefix, span_hash

MIN_LENGTH = 200
ANCHOR = 48
SPAN = MIN_LENGTH - ANCHOR + 1  # anchor positions in a window
BLOCK_BYTES = 1 << 20  # of segments indexed at once
GROUP_BYTES = BLOCK_BYTES  # a larger group is dealt again
WIDTHS = (40, 10, 3, 1)  # offset ranges of the successive dealings
MAX_ANCHORS = 6_000_000  # repeated anchors sent to the tasks as 8-byte hashes; more join by shuffle
MAX_BROADCAST_ROWS = 200_000

_U = np.uint64


def segments(data: np.ndarray, off: np.ndarray):
    """Segments of a block of texts: (row, first, windows, anchor, hash): byte
    position (in the block) of the first window, number of windows, position
    and hash of the anchor.  A position has 30 bits, so a text is under 1 GiB
    (a string in Spark is under 2 GiB)."""
    e = np.zeros(0, np.int64)
    n = len(data)
    if n < MIN_LENGTH:
        return e, e, e, e, np.zeros(0, _U)
    prefix = byte_prefix(data)
    at = np.arange(n - ANCHOR + 1)
    h = span_hash(prefix, at, at + ANCHOR)
    packed = (h >> _U(30) << _U(30)) | at.astype(_U)  # the leftmost of equal hashes wins
    m = len(packed)
    full = -(-m // SPAN) * SPAN
    x = np.full(full, np.iinfo(np.uint64).max, _U)
    x[:m] = packed
    grid = x.reshape(-1, SPAN)
    fore = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = m - SPAN + 1  # windows in the block, as if it were one text
    least = np.minimum(back[:starts], fore[SPAN - 1:SPAN - 1 + starts])
    anchor = (least & _U((1 << 30) - 1)).astype(np.int64)
    # Windows inside one text only.
    lengths = np.diff(off)
    row = np.repeat(np.arange(len(lengths)), np.maximum(lengths - MIN_LENGTH + 1, 0))
    first = np.concatenate(([0], np.cumsum(np.maximum(lengths - MIN_LENGTH + 1, 0))))[:-1]
    pos = np.arange(len(row)) - first[row] + off[row]
    if not len(pos):
        return e, e, e, e, np.zeros(0, _U)
    a = anchor[pos]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (row[1:] != row[:-1])
    cut = np.flatnonzero(new)
    return row[cut], pos[cut], np.diff(np.append(cut, len(a))), a[cut], h[a[cut]]


def _content(seg: bytes, off: int) -> tuple[int, int]:
    """128 bits of a segment and its anchor's offset."""
    d = hashlib.blake2b(b"%d|" % off + seg, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by at least their first ``depth`` bytes."""
    n = len(text)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = text
    key = np.zeros(n, _U)
    for j in range(8):
        key <<= _U(8)
        key |= padded[j:n + j]
    done = 8
    rank = np.empty(n, np.int32)  # a block has under 2^31 bytes
    while True:
        order = np.argsort(key).astype(np.int32)  # the order among equals does not matter
        s = key[order]
        new = np.ones(n, np.int32)
        new[1:] = s[1:] != s[:-1]
        del s
        rank[order] = np.cumsum(new, dtype=np.int32)
        if done >= depth or rank[order[-1]] == n:
            return order
        key = rank.astype(_U) * _U(n + 1)
        key[:max(0, n - done)] += rank[done:].astype(_U)
        done *= 2


def common_prefix_cuts(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """cut[r]: whether the suffixes at ranks r-1 and r differ in their first
    ``length`` bytes, for suffixes without the separator 0 there.

    Interval expansion on the Burrows-Wheeler transform: the intervals of the
    strings of length l are extended backward to those of length l + 1, and an
    interval that ends at an unset place sets its common prefix to l and goes
    on; others are dropped.  Values come in increasing order, so the expansion
    stops at ``length``.
    """
    n = len(text)
    bwt = text[order - 1]  # order 0 takes the last byte, a separator
    front = text[order]
    jump = np.empty(n, np.int32)  # rank of the suffix one byte longer
    jump[np.argsort(bwt, kind="stable")] = np.arange(n, dtype=np.int32)
    cut = np.zeros(n + 1, bool)
    cut[0] = cut[n] = True
    lo, hi = np.array([0]), np.array([n])
    owner = np.zeros(n, np.int32)
    for _ in range(length):
        size = hi - lo
        total = int(size.sum())
        if not total:
            break
        iv = np.repeat(np.arange(len(lo), dtype=np.int32), size)
        at = np.arange(total, dtype=np.int32) + (lo - (np.cumsum(size) - size)).astype(np.int32)[iv]
        real = bwt[at] != 0  # windows hold no separator
        to, iv = jump[at[real]], iv[real]
        if total * 8 > n:  # order by rank: by a table when many, else by sorting
            owner[to] = iv + 1
            to = np.flatnonzero(owner)
            iv = owner[to] - 1
            owner[to] = 0
        else:
            by = np.argsort(to)
            to, iv = to[by], iv[by]
        if not len(to):
            break
        new = np.ones(len(to), bool)
        new[1:] = (iv[1:] != iv[:-1]) | (front[to[1:]] != front[to[:-1]])
        begin = np.flatnonzero(new)
        lo = to[begin]
        hi = to[np.append(begin[1:], len(to)) - 1] + 1
        fresh = ~cut[hi]
        lo, hi = lo[fresh], hi[fresh]
        cut[hi] = True
    return cut[:n]


def repeated_windows(segs: list[bytes], n_windows: np.ndarray, copies: np.ndarray) -> list[np.ndarray]:
    """Per segment, which of its windows start more than once, counting copies."""
    lengths = np.array([len(s) for s in segs])
    begin = np.cumsum(lengths + 1) - lengths - 1
    # 0 parts segments; 255 never occurs in UTF-8
    text = np.frombuffer(b"".join(s.replace(b"\0", b"\xff") + b"\0" for s in segs), np.uint8)
    order = suffix_order(text, MIN_LENGTH)
    cut = common_prefix_cuts(text, order, MIN_LENGTH)
    weight = np.zeros(len(text), np.int64)
    starts = np.repeat(begin, n_windows) + np.arange(int(n_windows.sum())) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    weight[starts] = np.repeat(copies, n_windows)
    group = np.cumsum(cut) - 1
    total = np.bincount(group, weight[order])
    often = np.zeros(len(text), bool)
    often[order] = total[group] >= 2
    return np.split(often[starts], np.cumsum(n_windows)[:-1])


def covered(often: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges of a segment covered by its repeated windows."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], often.astype(np.int8), [0]))))
    out: list[tuple[int, int]] = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b - 1 + MIN_LENGTH)
        else:
            out.append((a, b - 1 + MIN_LENGTH))
    return out


_RANGES = "array<struct<a:int,b:int>>"


def _index(batches):
    """Rows (key, c1, c2, n, windows, seg) ordered by key -> (c1, c2, ranges)."""
    held: list[tuple] = []  # whole groups
    group: list[tuple] = []  # the group being read
    size = group_size = 0

    def flush():
        got = repeated_windows([h[4] for h in held], np.array([h[3] for h in held]), np.array([h[2] for h in held]))
        ranges = [[{"a": a, "b": b} for a, b in covered(g)] for g in got]
        out = pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()),
                                          pa.array(ranges, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))],
                                         names=["c1", "c2", "ranges"])
        held.clear()
        return out

    last = None
    for batch in batches:
        for key, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if key != last:
                if held and size + group_size > BLOCK_BYTES:  # the group does not fit
                    yield flush()
                    size = 0
                held += group
                size += group_size
                group, group_size, last = [], 0, key
            group.append(row)
            group_size += len(row[4])
    if held and size + group_size > BLOCK_BYTES:
        yield flush()
    held += group
    if held:
        yield flush()


def _deal(width: int):
    """Cut segments into pieces of windows whose anchor offset lies in one
    range of ``width``, keyed by the bytes all such windows share."""
    def run(batches):
        for b in batches:
            out = {k: [] for k in ("c1", "c2", "base", "key", "d1", "d2", "n", "off", "windows", "seg")}
            for c1, c2, n, off, w, seg in zip(*(c.to_pylist() for c in b.columns)):
                start = 0
                while start < w:
                    d = off - start  # anchor offset in the window
                    low = d // width * width
                    count = min(w - start, d - low + 1)
                    core = seg[off - low:off - (low + width - 1) + MIN_LENGTH]
                    piece = seg[start:start + count - 1 + MIN_LENGTH]
                    d1, d2 = _content(piece, off - start)
                    for k, v in zip(out, (c1, c2, start, _content(core, low)[0], d1, d2, n, off - start, count, piece)):
                        out[k].append(v)
                    start += count
            types = dict(c1=pa.int64(), c2=pa.int64(), base=pa.int32(), key=pa.int64(), d1=pa.int64(), d2=pa.int64(), n=pa.int64(),
                         off=pa.int32(), windows=pa.int32(), seg=pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, types[k]) for k, v in out.items()], names=list(out))
    return run


def _settle(mixed: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    """(c1, c2, ranges) of distinct segments (key, c1, c2, n, off, windows, seg)
    whose groups hold several strings."""
    spark = mixed.sparkSession
    sizes = mixed.groupBy("key").agg(F.sum(F.length("seg")).alias("bytes"))
    large = materialize(sizes.where(F.col("bytes") > GROUP_BYTES).select("key"), "large-groups")
    rest, done = mixed, None
    if widths and large.head(1):
        rest = mixed.join(large, "key", "left_anti")
        pieces = materialize(mixed.join(large, "key", "left_semi").select("c1", "c2", "n", "off", "windows", "seg").mapInArrow(
            _deal(widths[0]), "c1 long, c2 long, base int, key long, d1 long, d2 long, n long, off int, windows int, seg binary"), "pieces")
        one = pieces.groupBy("key", "d1", "d2").agg(F.sum("n").alias("n"), F.min(F.struct("off", "windows", "seg")).alias("s"))
        one = materialize(one.select("key", "d1", "d2", "n", "s.off", "s.windows", "s.seg"), "distinct-pieces")
        several = materialize(one.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key"), "mixed")
        alone = one.join(several, "key", "left_anti").select(
            F.col("d1").alias("c1"), F.col("d2").alias("c2"),
            F.when(F.col("n") >= 2, F.array(F.struct(F.lit(0).alias("a"), (F.col("windows") - 1 + MIN_LENGTH).alias("b"))))
            .otherwise(F.array().cast(_RANGES)).alias("ranges"))
        again = one.join(several, "key", "left_semi").select("key", F.col("d1").alias("c1"), F.col("d2").alias("c2"), "n", "off", "windows", "seg")
        part = alone.unionByName(_settle(materialize(again, "mixed-pieces"), widths[1:]))
        part = part.withColumnRenamed("c1", "d1").withColumnRenamed("c2", "d2")
        hit = pieces.select("c1", "c2", "base", "d1", "d2").join(part, ["d1", "d2"]).withColumn("r", F.explode("ranges"))
        done = hit.groupBy("c1", "c2").agg(F.collect_list(F.struct((F.col("r.a") + F.col("base")).alias("a"),
                                                                   (F.col("r.b") + F.col("base")).alias("b"))).alias("ranges"))
    found = (rest.select("key", "c1", "c2", "n", "windows", "seg").repartition(stretch(spark), "key").sortWithinPartitions("key")
             .mapInArrow(_index, f"c1 long, c2 long, ranges {_RANGES}"))
    return materialize(found if done is None else found.unionByName(done), "settled")


def _occurrences(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """(key, c1, c2, k1, k2, first, off, windows) of each segment whose anchor
    is repeated; k1, k2 name the row by id and text."""
    names = ["key", "c1", "c2", "k1", "k2", "first", "off", "windows"]
    schema = "key long, c1 long, c2 long, k1 long, k2 long, first int, off int, windows int"

    def rows(k1, k2, column, keep):
        for lo, hi, data, off in blocks(column):
            row, pos, w, a, h = segments(data, off)
            ok = keep(lo, row, h)
            row, pos, w, a, h = row[ok], pos[ok], w[ok], a[ok], h[ok]
            raw = data.tobytes()
            c = [_content(raw[p:p + n - 1 + MIN_LENGTH], x - p) for p, n, x in zip(pos.tolist(), w.tolist(), a.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.astype(np.int64)), pa.array([x[0] for x in c], pa.int64()), pa.array([x[1] for x in c], pa.int64()),
                 pa.array(k1[lo + row]), pa.array(k2[lo + row]), pa.array(pos - off[row], pa.int32()), pa.array(a - pos, pa.int32()), pa.array(w, pa.int32())], names=names)

    if repeated.count() <= MAX_ANCHORS:
        table = np.sort(repeated.toArrow().column(0).to_numpy())
        shared = docs.sparkSession.sparkContext.broadcast(table)

        def run(batches):
            known = shared.value

            def keep(lo, row, h):
                if not len(known):
                    return np.zeros(len(h), bool)
                x = h.astype(np.int64)
                return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x
            for b in batches:
                yield from rows(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2), keep)
        return docs.select("k1", "k2", "text").mapInArrow(run, schema)

    # Beyond the bound: anchors of each text that are repeated, by joins.
    def anchors(batches):
        for b in batches:
            k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            for lo, hi, data, off in blocks(b.column(2)):
                row, _, _, _, h = segments(data, off)
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(k1[lo + row]), pa.array(k2[lo + row])],
                                                 names=["key", "k1", "k2"])

    def run_listed(batches):
        for b in batches:
            listed = [np.unique(x.values.to_numpy()) for x in b.column(3)]

            def keep(lo, row, h):
                x, ok = h.astype(np.int64), np.zeros(len(h), bool)
                for r in np.unique(row).tolist():
                    ok[row == r] = np.isin(x[row == r], listed[lo + r])
                return ok
            yield from rows(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2), keep)

    lists = (docs.select("k1", "k2", "text").mapInArrow(anchors, "key long, k1 long, k2 long").distinct().join(repeated, "key", "left_semi")
             .groupBy("k1", "k2").agg(F.collect_list("key").alias("keys")))  # bounded by the text
    return docs.join(lists, ["k1", "k2"]).select("k1", "k2", "text", "keys").mapInArrow(run_listed, schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row;
    kept holds the remaining bytes.

    Matches never cross rows.  Null text is empty; texts under ``MIN_LENGTH``
    bytes lose nothing.  Rows that repeat an id and a text are copies of each
    other.  Null ids take part.  Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # A row is named by 128 bits of its id and text, taken in the JVM: no task needs a second Python worker for them.
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit("row"), "text", "doc_id").alias("k2"))

    def anchors(batches):
        for b in batches:
            for _, _, data, off in blocks(b.column(0)):
                h, n = np.unique(segments(data, off)[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(n, pa.int64())], names=["key", "n"])

    counts = docs.select("text").mapInArrow(anchors, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    repeated = materialize(counts.where("n > 1").select("key"), "anchors")
    seen = materialize(_occurrences(docs, repeated), "segments")
    place = F.min(F.struct("k1", "k2", "first")).alias("at")
    one = materialize(seen.groupBy("key", "c1", "c2", "off", "windows").agg(F.count("*").alias("n"), place), "distinct-segments")
    several = materialize(one.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key"), "mixed")
    alone = one.join(several, "key", "left_anti").where("n > 1").select("c1", "c2", F.array(
        F.struct(F.lit(0).alias("a"), (F.col("windows") - 1 + MIN_LENGTH).alias("b"))).alias("ranges"))
    mixed = _fetch(docs, one.join(several, "key", "left_semi"))
    settled = alone.unionByName(_settle(materialize(mixed, "mixed-segments"), WIDTHS)).where(F.size("ranges") > 0)
    spans = (seen.select("k1", "k2", "first", "c1", "c2").join(settled, ["c1", "c2"]).withColumn("r", F.explode("ranges"))
             .select("k1", "k2", (F.col("first") + F.col("r.a")).alias("a"), (F.col("first") + F.col("r.b")).alias("b")))
    # Rows that repeat id and text bring each span more than once.
    lists = materialize(spans.distinct().groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans")), "spans")
    return _cut(docs, lists)


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted distinct segments, each from one place."""
    lists = materialize(wanted.select("key", "c1", "c2", "n", "off", "windows", "at.k1", "at.k2", "at.first").groupBy("k1", "k2")
                        .agg(F.collect_list(F.struct("key", "c1", "c2", "n", "off", "windows", "first")).alias("want")), "wanted")
    texts = docs.join(broadcast_if_small(lists, MAX_BROADCAST_ROWS), ["k1", "k2"]).select("text", "want")

    def run(batches):
        for b in batches:
            out = {k: [] for k in ("key", "c1", "c2", "n", "off", "windows", "seg")}
            for text, want in zip(b.column(0), b.column(1).to_pylist()):
                raw = memoryview(text.as_buffer())
                for w in want:
                    for k in ("key", "c1", "c2", "n", "off", "windows"):
                        out[k].append(w[k])
                    out["seg"].append(bytes(raw[w["first"]:w["first"] + w["windows"] - 1 + MIN_LENGTH]))
            types = dict(off=pa.int32(), windows=pa.int32(), seg=pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, types.get(k, pa.int64())) for k, v in out.items()], names=list(out))

    got = texts.mapInArrow(run, "key long, c1 long, c2 long, n long, off int, windows int, seg binary")
    return got.dropDuplicates(["key", "c1", "c2"])  # repeated rows hold the place twice


def _cut(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """Remove the listed spans from each row's bytes."""
    texts = docs.join(broadcast_if_small(lists, MAX_BROADCAST_ROWS), ["k1", "k2"], "left")

    def run(batches):
        for b in batches:
            n, gone, count, kept = [], [], [], []
            for text, spans in zip(b.column(1).fill_null(""), b.column(2)):
                raw = memoryview(text.as_buffer())
                size, merged = len(raw), []
                for s in spans.as_py() or ():
                    if merged and s["a"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["b"])
                    else:
                        merged.append([s["a"], s["b"]])
                at, parts = 0, []
                for a, z in merged:
                    parts.append(raw[at:a])
                    at = z
                parts.append(raw[at:])
                n.append(size)
                gone.append(sum(z - a for a, z in merged))
                count.append(len(merged))
                kept.append(b"".join(parts))
            sha = [hashlib.sha256(k).hexdigest() for k in kept]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()),
                                              pa.array(sha, pa.string()), pa.array(kept, pa.binary())],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return texts.select("doc_id", "text", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
