from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    return w, [zlib.crc32(g.encode()) % 10000 for g in grams]


def brute(rows, target):
    raw = Counter(b for _, t in rows for b in features(t)[1])
    want = Counter(b for t in target for b in features(t)[1])
    S, T = sum(raw.values()), sum(want.values())
    gain = [math.floor(1000 * math.log((want[b] + 1) * (S + 10000) / ((raw[b] + 1) * (T + 10000)))) for b in range(10000)]
    out, long_enough = [], []
    for n, (i, t) in enumerate(rows):
        w, f = features(t)
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
        if len(w) >= 20:
            long_enough.append((-score, i is None, i or 0, n))
    for rank, (*_, n) in enumerate(sorted(long_enough)[:5 * len(long_enough) // 100], 1):
        out[n][4] = rank
    return out


def many(corpus):
    """Enough rows for several draws, with ties (equal id and text) among the best."""
    rows = [(1000 + i, f"{corpus[i % 12][1]} extra{i} Ünïcode-Wörter x{i % 7}'s") for i in range(150)]
    return corpus + rows + [(2000, "goal words " * 40)] * 3 + [(None, "goal words " * 40)]


TARGET = ["Goal words here, goal WORDS there", None, "", "alpha1 beta2 gamma3"]


def key(r):
    return str([x if x is not None else -1 for x in r])


def test_importance_equals_brute_force(spark, corpus):
    from ledgerlens.llm.importance import importance

    rows = many(corpus)
    docs = spark.createDataFrame([(i, t, 5, "z") for i, t in rows], "doc_id long, text string, rank int, bucket string").repartition(5)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = [tuple(r) for r in importance(docs, target).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    want = brute(rows, TARGET)
    assert sorted(map(key, got)) == sorted(map(key, want))
    drawn = sorted(r[4] for r in got if r[4] is not None)
    assert drawn == list(range(1, len(drawn) + 1)) and len(drawn) >= 5


def test_resample_returns_the_drawn_rows_whole(spark, corpus):
    from ledgerlens.llm.importance import importance, resample

    rows = many(corpus)
    docs = spark.createDataFrame([(i, t, 5, "z") for i, t in rows], "doc_id long, text string, row_number int, score string")
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = resample(docs, target)
    assert got.columns == docs.columns
    want = importance(docs, target).where("rank is not null")
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r.doc_id) for r in want.collect())


def test_long_text_goes_in_runs_of_words(monkeypatch):
    from ledgerlens.llm import importance as m

    words = m.word_list("One two THREE four five, six seven eight nine ten" * 30)
    whole = Counter(c for part in m.ngram_crcs(words) for c in part)
    monkeypatch.setattr(m, "CHUNK_WORDS", 4)
    assert Counter(c for part in m.ngram_crcs(words) for c in part) == whole
    assert whole == Counter(zlib.crc32(b" ".join(words[i:i + n])) for n in (1, 2, 3) for i in range(len(words) - n + 1))


def test_empty_tables(spark, corpus):
    from ledgerlens.llm.importance import importance

    none = spark.createDataFrame([], "doc_id long, text string")
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    assert importance(none, target).count() == 0
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    got = [tuple(r) for r in importance(docs, none).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert sorted(map(key, got)) == sorted(map(key, brute(corpus, [])))
