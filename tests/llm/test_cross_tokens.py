from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers as P

    return str(P.path("byte_bpe_50k.json")), str(P.path("piece_bpe_32k.model"))


ODD = [(500, "naïve café — 日本語のテキスト 🙂🙂 ​ done"), (501, "<|endoftext|> x <0x41> </s> ok"), (502, "a  b\t\tc\n\n\nd "), (503, "▁literal"),
       (504, " leading"), (505, "\x00nul\x01"), (506, "ﬁ ligature ½"), (507, "9" * 300), (508, "!?" * 400), (509, "word " * 3000)]


def brute(rows, paths):
    """Per row (id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest), by nested loops over tokens."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    tok = Tokenizer.from_file(paths[0])
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    letter = {}
    for b in range(256):  # the byte-level alphabet: printable bytes stand for themselves, the rest follow from 256
        letter[chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 else None] = b
    letter.pop(None)
    for i, b in enumerate(x for x in range(256) if x not in letter.values()):
        letter[chr(256 + i)] = b
    assert decoders.ByteLevel()
    per, held = [], Counter()
    for i, t in rows:
        groups = []
        if t:
            whole = (" " + t).encode()
            a, b = tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)
            xa = [bytes(letter[c] for c in tok.id_to_token(x)) for x in a]
            xb = [bytes([int(sp.id_to_piece(x)[3:5], 16)]) if sp.is_byte(x) else sp.id_to_piece(x).replace("▁", " ").encode() for x in b]
            if b"".join(xa) == whole == b"".join(xb):
                ga, gb, pa_, pb, ia, ib = [], [], 0, 0, 0, 0
                while ia < len(a) or ib < len(b):
                    if pa_ <= pb:
                        ga.append(a[ia])
                        pa_ += len(xa[ia])
                        ia += 1
                    else:
                        gb.append(b[ib])
                        pb += len(xb[ib])
                        ib += 1
                    if pa_ == pb and ga and gb:
                        groups.append((ga, gb))
                        ga, gb = [], []
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        held.update(links.keys())
        per.append((i, groups, links))
    top = Counter()
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for i, groups, links in per:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((i, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), sum(links.values()),
                    sum(n for p, n in links.items() if held[p] == top[p[0]]), sum(n * held[p] for p, n in links.items()),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def key(r):
    return str(tuple(r))


def test_alignment_equals_brute_force(spark, corpus, paths, monkeypatch):
    from ledgerlens.llm import cross_tokens as c

    rows = corpus + ODD
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, a int, slot string").repartition(3)
    want = sorted(brute(rows, paths), key=key)
    assert sorted((tuple(r) for r in c.cross_alignment(docs, *paths).collect()), key=key) == want
    assert any(w[7] == "" and w[0] == 503 for w in want) and any(w[1] > 2 for w in want)


def test_links_are_the_same_in_small_slices(corpus, paths, monkeypatch):
    from ledgerlens.llm import cross_tokens as c

    tok = c.Tokenizers(*paths)
    al = c.align(tok.encode([" " + t for _, t in corpus + ODD if t]).good(), tok.len_a, tok.len_b)
    one = c._add_up(list(c.links(al, 32000)))
    monkeypatch.setattr(c, "LINK_SLICE", 97)
    two = c._add_up(list(c.links(al, 32000)))
    assert all((x == y).all() for x, y in zip(one, two))


def test_chunks_are_encoded_as_in_the_whole(paths):
    """Random strings of letters, marks, digits and every kind of white space."""
    import random

    from ledgerlens.llm import cross_tokens as c

    tok, rng = c.Tokenizers(*paths), random.Random(4)
    assert tok.splits
    letters = ["a", "B", "the", "'s", "'ll", ".", ",", "!!", "7", "2024", "é", "日本", "🙂", "▁", "<s>", "_", "\u0301", "\x1c", "\x85"]
    space = [" ", " ", " ", "  ", "   ", "\n", "\t", "\r\n", "\u00a0", "\u3000", "\u200b", "\x0b"]
    texts = ["".join(rng.choice(letters if rng.random() < 0.6 else space) for _ in range(rng.randint(1, 40))) for _ in range(8000)]
    whole = tok.encode([" " + t for t in texts])
    at_a, at_b = np.cumsum(whole.size_a) - whole.size_a, np.cumsum(whole.size_b) - whole.size_b
    for i, t in enumerate(texts):
        parts = tok.encode(tok.chunks(t))
        assert parts.same.all() == whole.same[i], repr(t)
        if whole.same[i]:
            assert parts.a.tolist() == whole.a[at_a[i]:at_a[i] + whole.size_a[i]].tolist(), repr(t)
            assert parts.b.tolist() == whole.b[at_b[i]:at_b[i] + whole.size_b[i]].tolist(), repr(t)
    assert 0 < whole.same.sum() < len(texts)


def test_cache_starts_anew(corpus, paths, monkeypatch):
    from ledgerlens.llm import cross_tokens as c

    texts = [t for _, t in corpus + ODD]
    one, two = c.Aligner(c.Tokenizers(*paths)), c.Aligner(c.Tokenizers(*paths))
    want = [one.align([t]) for t in texts]
    monkeypatch.setattr(c, "CACHE_CHUNKS", 50)
    for t, (facts, groups, links) in zip(texts, want):
        f, g, k = two.align([t])
        assert (f == facts).all() and g == groups
        assert sorted(zip(*(x.tolist() for x in k))) == sorted(zip(*(x.tolist() for x in links)))


def test_bitmaps_and_planes_round_trip():
    from ledgerlens.llm import cross_tokens as c

    rng = np.random.default_rng(3)
    sizes = [1, 2, c.ARRAY_MAX, c.ARRAY_MAX + 1, c.CONTAINER, 17]
    docs = np.concatenate([np.sort(rng.choice(c.CONTAINER, s, replace=False)) for s in sizes])
    counts = rng.integers(1, 4, len(docs))
    counts[0], counts[1:3] = 70_000, 1
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    n = np.array(sizes)
    for lo, hi in ((0, 6), (2, 5)):  # also as a slice of a longer column
        a, b = offsets[lo], offsets[hi]
        assert (c.unpack_bitmaps(c.pack_bitmaps(docs, offsets).slice(lo, hi - lo), n[lo:hi]) == docs[a:b]).all()
        assert (c.unpack_planes(c.pack_planes(counts, offsets).slice(lo, hi - lo), n[lo:hi]) == counts[a:b]).all()
    assert len(c.pack_bitmaps(docs, offsets)[4].as_py()) == c.CONTAINER // 8
    assert isinstance(c.pack_planes(counts, offsets), pa.Array)


def test_partials_of_a_container_are_merged(spark, corpus, paths, monkeypatch):
    """One partition whose batches are small: a pair's container has many partials."""
    from ledgerlens.llm import cross_tokens as c

    rows = [r for r in corpus + ODD if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        of_docs, postings = c.index_links(docs, *paths)
        got = {(r.a, r.b): (r.n_docs, r.n_links, r.is_best) for r in c.pair_table(postings).collect()}
        assert sorted((tuple(r) for r in c.cross_alignment(docs, *paths).collect()), key=key) == sorted(brute(rows, paths), key=key)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert postings.count() == len(got) and of_docs.count() == len(rows)  # one container, so one posting a pair
    assert sum(n for _, n, _ in got.values()) == sum(r.n_links for r in of_docs.collect())


def test_empty_table(spark, paths):
    from ledgerlens.llm.cross_tokens import cross_alignment

    assert cross_alignment(spark.createDataFrame([], "doc_id long, text string"), *paths).count() == 0
    only = spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")
    assert sorted(key(r) for r in cross_alignment(only, *paths).collect()) == sorted(map(str, [(None, 0, 0, 0, 0, 0, 0, ""), (1, 0, 0, 0, 0, 0, 0, "")]))
