"""Benchmark decontamination with a distributed positional inverted index.

The index stores training token postings (term_id, row, pos), written by the
tasks that read the documents: sharded by document, no shuffle.  Only terms
of the test vocabulary are stored, since no other posting can be asked for; a
posting of the reserved term 0 closes each document and holds its length.

A phrase is found by intersecting offset-adjusted posting lists, rarest test
term first: the two rarest terms of the phrase (by frequency in the index)
give start positions that are intersected, then the remaining terms are
checked at the surviving starts only.  Proximity search lets each term stand
up to ``slop`` words off its place.  DataFrame and SQL functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.llm.common import broadcast_if_small, materialize

SIZE = 10  # words of a window
MAX_BROADCAST_ROWS = 500_000  # rows of at most 64 bytes or one word; more join by shuffle

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # between words, before lower-casing
_CLOSE = " "  # no word: the key of the closing posting


def _fold(word: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(word, _UPPER, _LOWER)


def _split(df: DataFrame, text: str, *keep: Column) -> DataFrame:
    """Rows with ``parts`` (the words, maybe with an empty string at either
    end), ``lead`` (1 if the first is empty) and ``n_words``."""
    parts = df.select(*keep, F.split(F.coalesce(F.col(text), F.lit("")), _GAP, -1).alias("parts"))
    lead = (F.col("parts")[0] == "").cast("int")
    tail = ((F.size("parts") > 1) & (F.element_at("parts", -1) == "")).cast("int")
    return parts.withColumn("lead", lead).withColumn("n_words", F.size("parts") - F.col("lead") - tail)


def tokens(df: DataFrame, text: str, *keep: Column) -> DataFrame:
    """One row per word: the kept columns, n_words, pos, word (folded)."""
    names = [c for c in df.select(*keep).columns]
    s = _split(df, text, *keep)
    return (s.select(*names, "n_words", "lead", F.posexplode("parts").alias("p", "word")).where("word <> ''")
            .select(*names, "n_words", (F.col("p") - F.col("lead")).alias("pos"), _fold(F.col("word")).alias("word")))


@dataclass
class PositionalIndex:
    """postings (term_id, row, pos), documents (row, doc_id, n_words), vocabulary (term_id, word)."""

    postings: DataFrame
    documents: DataFrame
    vocabulary: DataFrame


def build_index(docs: DataFrame, test_words: DataFrame, row: str | None = None) -> PositionalIndex:
    """Index the whole ``text`` of every row of ``docs`` (doc_id, text) for the
    words in ``test_words`` (word).  Rows have the numbers of the column
    ``row``, or are numbered here."""
    vocab = materialize(test_words.select("word").distinct()
                        .withColumn("term_id", F.monotonically_increasing_id() + 1), "vocab")
    # Full lower-casing is the join key (cheap on ASCII); the folded word
    # decides among terms with equal keys.
    keyed = vocab.select(F.lower("word").alias("key"), F.col("word").alias("term"), "term_id").unionByName(
        docs.sparkSession.range(1).select(F.lit(_CLOSE).alias("key"), F.lit(_CLOSE).alias("term"), F.lit(0).cast("long").alias("term_id")))
    number = F.col(row).cast("bigint") if row else F.monotonically_increasing_id()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", number.alias("row"))
    s = _split(rows, "text", F.col("row"), F.col("doc_id"))
    closed = s.withColumn("parts", F.concat("parts", F.array(F.lit(_CLOSE))))
    found = (closed.select("row", "doc_id", "n_words", "lead", F.posexplode("parts").alias("p", "w"))
             .withColumn("key", F.lower("w"))
             .join(broadcast_if_small(materialize(keyed, "terms"), MAX_BROADCAST_ROWS), "key")
             .where(_fold(F.col("w")) == F.col("term"))
             .select("term_id", "row", F.when(F.col("term_id") == 0, F.col("n_words")).otherwise(F.col("p") - F.col("lead")).alias("pos"),
                     F.when(F.col("term_id") == 0, F.col("doc_id")).alias("doc_id")))
    # Row numbers are drawn once: everything later reads this table.
    stored = materialize(found, "postings")
    return PositionalIndex(stored.where("term_id > 0").select("term_id", "row", "pos"),
                           stored.where("term_id = 0").select("row", "doc_id", F.col("pos").alias("n_words")), vocab)


def phrase_terms(index: PositionalIndex, phrases: DataFrame) -> DataFrame:
    """``phrases`` (phrase, off, word) with term_id, the number of words
    (size) and the rank of each by rarity in the index; phrases with a term
    that the index lacks are left out, as they cannot occur."""
    freq = index.postings.groupBy("term_id").agg(F.count("*").alias("freq"))
    known = phrases.join(index.vocabulary, "word").join(freq, "term_id", "left")
    w = Window.partitionBy("phrase")
    ranked = (known.withColumn("least", F.min(F.coalesce("freq", F.lit(0))).over(w)).where("least > 0")
              .withColumn("size", F.count("*").over(w))
              .withColumn("rank", F.row_number().over(w.orderBy("freq", "off"))))
    return materialize(ranked.select("phrase", "off", "term_id", "size", "rank"), "phrases")


def phrase_matches(index: PositionalIndex, phrases: DataFrame) -> DataFrame:
    """(row, phrase, size, start) of every exact occurrence of the phrases."""
    terms = phrase_terms(index, phrases)

    def starts(rank: int) -> DataFrame:
        lists = broadcast_if_small(terms.where(F.col("rank") == rank), MAX_BROADCAST_ROWS)
        return index.postings.join(lists, "term_id").select(
            "row", "phrase", "size", (F.col("pos") - F.col("off")).alias("start")).where("start >= 0")

    rarest = starts(1)
    both = rarest.where("size > 1").join(starts(2).drop("size"), ["row", "phrase", "start"])
    alive = materialize(rarest.where("size = 1").unionByName(both.select(*rarest.columns)), "starts")
    rest = terms.where("rank > 2").select("phrase", "off", "term_id")
    asked = (alive.join(broadcast_if_small(rest, MAX_BROADCAST_ROWS), "phrase")
             .select("row", "phrase", "start", (F.col("start") + F.col("off")).alias("pos"), "term_id"))
    rows = broadcast_if_small(materialize(alive.select("row").distinct(), "rows"), MAX_BROADCAST_ROWS)
    there = index.postings.join(rows, "row", "left_semi")
    right = (asked.join(there, ["row", "pos", "term_id"]).groupBy("row", "phrase", "start").agg(F.count("*").alias("n")))
    return (alive.where("size <= 2")
            .unionByName(alive.join(right, ["row", "phrase", "start"]).where("n = size - 2").select(*alive.columns)))


def proximity_matches(index: PositionalIndex, phrases: DataFrame, slop: int) -> DataFrame:
    """(row, phrase, start): starts implied by the rarest term of a phrase at
    which every other term stands at most ``slop`` words off its place."""
    terms = phrase_terms(index, phrases)
    first = terms.where("rank = 1")
    near = index.postings.join(broadcast_if_small(first, MAX_BROADCAST_ROWS), "term_id").select(
        "row", "phrase", "size", (F.col("pos") - F.col("off")).alias("start"))
    near = materialize(near, "starts")
    asked = near.join(terms.where("rank > 1").select("phrase", "off", "term_id"), "phrase").select(
        "row", "phrase", "start", "off", "term_id")
    p = index.postings.join(near.select("row").distinct(), "row", "left_semi")
    found = (asked.join(p, ["row", "term_id"]).where(F.abs(F.col("pos") - F.col("start") - F.col("off")) <= slop)
             .select("row", "phrase", "start", "off").distinct()
             .groupBy("row", "phrase", "start").agg(F.count("*").alias("n")))
    return (near.join(found, ["row", "phrase", "start"], "left").where("coalesce(n, 0) = size - 1")
            .select("row", "phrase", "start"))


def benchmark_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """(phrase, item_id, off, word): every window of ``size`` consecutive words
    of each item; an item of fewer words, but not none, is one window."""
    items = benchmark.select(F.col("item_id"), "text").withColumn("item", F.monotonically_increasing_id())
    t = tokens(items, "text", F.col("item"), F.col("item_id"))
    last = F.greatest(F.col("n_words") - size, F.lit(0))
    begin = F.sequence(F.greatest(F.col("pos") - (size - 1), F.lit(0)), F.least(F.col("pos"), last))
    w = t.withColumn("begin", F.explode(begin))
    return materialize(w.select(F.concat_ws(":", "item", "begin").alias("phrase"), "item_id",
                                (F.col("pos") - F.col("begin")).cast("int").alias("off"), "word"), "windows")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, row: str | None = None) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, and the column ``row`` if one is named, which numbers the
    rows of a written table.

    n_hit counts the document's words inside any occurrence of a window;
    n_items the items with occurring windows (items_sha256: their ids sorted
    as strings, comma-joined).  Null and empty texts have no words; such items
    have no window.  Repeated rows are told apart; items that repeat an item_id
    count once, items with a null id hit words but are not listed.  Extra
    columns are ignored.  Empty tables: no rows, or no hits.
    """
    windows = benchmark_windows(benchmark, size)
    index = build_index(docs, windows, row)
    found = phrase_matches(index, windows.select("phrase", "off", "word"))
    found = materialize(found, "matches")
    # Union of [start, start + size) per document.
    spans = found.groupBy("row", "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    w = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(w), F.lit(0))), F.lit(0))
    hits = spans.withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    owner = windows.select("phrase", "item_id").distinct()
    items = (found.select("row", "phrase").distinct().join(broadcast_if_small(owner, MAX_BROADCAST_ROWS), "phrase")
             .groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids")))
    none = F.array().cast("array<string>")
    out = index.documents.join(hits, "row", "left").join(items, "row", "left")
    ids = F.coalesce("ids", none)
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"),
                      (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), *([F.col("row").alias(row)] if row else []))
