from __future__ import annotations

import hashlib
import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def test_suffix_dedup_equals_brute_force(docs, corpus):
    from ledgerlens.llm.suffix_dedup import MIN_LENGTH, remove_repeats

    texts = [(i, (t or "").encode()) for i, t in corpus]
    seen = Counter(b[s:s + MIN_LENGTH] for _, b in texts for s in range(len(b) - MIN_LENGTH + 1))
    want = []
    for i, b in texts:
        cover = np.zeros(len(b) + 1, int)
        for s in range(len(b) - MIN_LENGTH + 1):
            if seen[b[s:s + MIN_LENGTH]] > 1:
                cover[s:s + MIN_LENGTH] = 1
        kept = bytes(x for x, c in zip(b, cover) if not c)
        want.append((i, len(b), int(cover[:len(b)].sum()), int((np.diff(np.concatenate(([0], cover[:len(b)]))) == 1).sum()),
                     hashlib.sha256(kept).hexdigest()))
    got = [tuple(r)[:5] for r in remove_repeats(docs).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[4])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_suffix_dedup_large_groups_and_shuffle_path_agree(docs, monkeypatch):
    from ledgerlens.llm import suffix_dedup as s

    one = sorted((str(r.doc_id), r.n_removed, r.kept_sha256) for r in s.remove_repeats(docs).collect())
    monkeypatch.setattr(s, "GROUP_BYTES", 600)  # every mixed group is dealt again
    monkeypatch.setattr(s, "MAX_ANCHORS", 0)
    two = sorted((str(r.doc_id), r.n_removed, r.kept_sha256) for r in s.remove_repeats(docs).collect())
    assert one == two


def test_minhash_equals_brute_force(docs, corpus):
    from ledgerlens.llm import weighted_minhash as m

    df, n = m.document_frequencies(docs)
    assert n == len(corpus)
    got = m.near_duplicates(docs).collect()
    assert len(got) == len(corpus)
    by = {r.doc_id: r.class_id for r in got}
    grams = []
    for i, t in corpus:
        w = words(t)
        grams.append((i, Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()))
    # idf spans 10 %: pairs clear of the threshold must agree with plain weights.
    for i, a in grams:
        for j, b in grams:
            if i is None or j is None or not a or not b:
                continue
            sim = sum((a & b).values()) / sum((a | b).values())
            if sim >= 0.85:
                assert by[i] == by[j], (i, j, sim)
    assert {by[i] for i in range(200, 208)} == {1} and {by[i] for i in range(100, 105)} == {0}
    assert by[403] == by[404] == 403 and by[400] == 400 and by[401] == 401
    assert by[None] == 2
    kept = Counter(r.class_id for r in got if r.kept)
    assert all(v == 1 for c, v in kept.items()) and set(kept) == {r.class_id for r in got}
    assert len({by[i] for i in range(300, 306)}) == 6  # a shared passage is not a near copy


def test_minhash_blocks_find_all_pairs():
    from ledgerlens.llm.weighted_minhash import compare_sets, weighted_jaccard

    rng = np.random.default_rng(1)
    sets = []
    for _ in range(40):
        h = np.unique(rng.integers(0, 40, 30).astype(np.uint64))
        sets.append((h, rng.integers(1, 4, len(h)), 1 + (h % np.uint64(7)) / 70.0))
    i, j = compare_sets(sets[:25], sets[25:], 0.4)
    want = {(x, y) for x in range(25) for y in range(15)
            if weighted_jaccard(sets[x][0], sets[x][1] * sets[x][2], sets[25 + y][0], sets[25 + y][1] * sets[25 + y][2]) >= 0.4}
    assert set(zip(i.tolist(), j.tolist())) == want and want


def test_minhash_signature_estimates_weighted_jaccard():
    from ledgerlens.llm import weighted_minhash as m

    rng = np.random.default_rng(2)
    same = n = 0
    for k in range(60):
        h = np.unique(rng.integers(0, 1 << 62, 120).astype(np.uint64))
        w = rng.random(len(h)) + 0.5
        a, b = slice(0, 100), slice(20, 120)
        same += (m.signature(h[a], w[a]) == m.signature(h[b], w[b])).sum()
        n += m.HASHES
    assert abs(same / n - 80 / 120) < 0.06


def test_token_files_round_trip(spark, docs, corpus, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from ledgerlens.llm.token_files import read_token_index, write_token_files

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    tok = Tokenizer.from_file(path)
    odd = [(900, "a  b"), (901, " lead"), (902, "it's x\n\ny"), (903, "a\n b <|endoftext|> c,d.\nE"), (904, "日本 語。x"),
           (905, "x<|endoftext|>y"), (906, "<|endoftext|>"), (907, "a, <|endoftext|>  <|endoftext|> b"), (908, "<|endoftext <|endoftext|")]
    all_docs = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = sorted([*corpus, *odd], key=lambda r: (r[0] is not None, r[0] or 0))
    got = read_token_index(spark, write_token_files(all_docs, path, str(tmp_path / "t"))).collect()
    got = sorted(got, key=lambda r: r.start)
    start = 0
    for (i, t), r in zip(rows, got):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens) == (i, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
    assert len(got) == len(rows)
    none = write_token_files(empty(spark, "doc_id long, text string"), path, str(tmp_path / "e"))
    assert read_token_index(spark, none).count() == 0


def test_decontamination_equals_brute_force(spark, docs, corpus):
    from ledgerlens.llm.decontaminate import build_index, contamination, proximity_matches

    long_item = " ".join(words(corpus[3][1])[20:45]).upper()
    items = [(5, long_item), (12, "Two words"), (3, None), (4, "..."), (None, " ".join(words(corpus[4][1])[:12])), (5, long_item), (9, "nowhere to be found")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t in corpus:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            x = words(text)
            size = min(10, len(x))
            for s in range(len(x) - size + 1 if size else 0):
                for p in range(len(w) - size + 1):
                    if w[p:p + size] == x[s:s + size]:
                        hit.update(range(p, p + size))
                        if item is not None:
                            ids.add(str(item))
        want.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    got = [tuple(r) for r in contamination(docs, bench).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert contamination(docs, empty(spark, "item_id long, text string")).where("contaminated").count() == 0
    assert contamination(empty(spark, "doc_id long, text string"), bench).count() == 0
    # Proximity: one word put between the phrase's words.
    d = spark.createDataFrame([(1, "red green blue"), (2, "red big green blue"), (3, "blue red")], "doc_id long, text string")
    phrase = spark.createDataFrame([("p", 0, "red"), ("p", 1, "green"), ("p", 2, "blue")], "phrase string, off int, word string")
    index = build_index(d, phrase)
    near = proximity_matches(index, phrase, 1).join(index.documents, "row")
    assert {r.doc_id for r in near.collect()} == {1, 2}


def test_vectors_equal_brute_force(spark):
    from ledgerlens.llm.vector_dedup import linked_vectors

    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 64))
    vecs = [(int(k), int(k % 2), [float(np.float32(x)) for x in base[k % 6] + 0.12 * rng.normal(size=64) * (k % 5 != 0)]) for k in range(300)]
    vecs += [(1000, 0, None), (1001, None, vecs[0][2]), (1002, 0, [0.0] * 64), (1003, 0, [float("nan")] + [1.0] * 63), (1004, 0, [None] + [1.0] * 63),
             (1005, 0, [1.0] * 8), (1006, 0, [1.0] * 8), (1007, 0, [2.0] * 8), (1008, 0, [])]
    df = spark.createDataFrame([(*v, 1) for v in vecs], "vec_id long, label int, embedding array<float>, rep int").repartition(5)
    good = [(i, lab, np.array(v, float)) for i, lab, v in vecs
            if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i, _, _ in vecs}
    for i, a, x in good:
        for j, b, y in good:
            if i != j and a == b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[i].add(j)
    comp = {i: i for i in links}
    while True:
        new = {i: min([comp[i], *(comp[j] for j in links[i])]) for i in links}
        if new == comp:
            break
        comp = new
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in linked_vectors(df).collect()}
    assert got == {i: (len(links[i]), comp[i], comp[i] == i) for i in links}
    assert sum(len(x) for x in links.values()) > 500


def test_reply_trees_and_template(spark):
    from ledgerlens.llm.chat_trees import chain, digest, format_branches, read_back

    rows = [("a", 1, None, "user", "hi", 0.0), ("a", 2, 1, "assistant", "x<|end|>\\y", 0.9), ("a", 3, 1, "assistant", "</s>[INST]", 0.1),
            ("a", 4, 3, "user", "<|user|>", 0.2), ("a", 5, 99, "user", None, 5.0), ("c", 1, 2, "user", "loop", 0.0), ("c", 2, 1, "user", "loop", 0.0)]
    m = spark.createDataFrame(rows, "conv string, node long, parent long, role string, text string, score double")
    f = format_branches(m, best=2)
    got = {}
    for r in sorted(read_back(f).collect(), key=lambda r: (r.conv, r.leaf, r.at)):
        got.setdefault((r.conv, r.leaf), []).append((r.role, r.text, r.loss))
    assert got == {("a", 5): [("user", "", None)], ("a", 2): [("user", "hi", None), ("assistant", "x<|end|>\\y", "x<|end|>\\y")]}
    own = "</s>[INST] ok [/INST]"
    c = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own), (None, 2, None, None)], "conv_id long, turn long, role string, text string")
    d = {r.conv: r for r in digest(format_branches(chain(c))).collect()}
    assert d["-7"].n_turns == 2 and d["-7"].loss_chars == len(own) and d[""].n_turns == 1
    assert d["-7"].loss_sha256 == hashlib.sha256(own.encode()).hexdigest()
    turns = "".join(f"{r}\n{own}\n" for r in ("user", "assistant"))
    assert d["-7"].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert digest(format_branches(chain(empty(spark, "conv_id long, turn long, role string, text string")))).count() == 0


def test_main_text_and_site_templates(spark):
    from ledgerlens.llm.site_templates import extract_main_text, main_text

    page = ("<html><body><header>Site</header><nav>m</nav><div class='cookie-notice'>c</div><article><header><h1>T &amp; x</h1></header>"
            "<p>a<b>b</b>  c<br>d</p><ul><li>one<li>two</ul><div class='ad'>x</div><form>f</form><script>var a='<p>';</script>"
            "<section id=comments><p>me</p></section></article><aside>s</aside><footer>f</footer></body>")
    assert main_text(page, set()) == "T & x\nab c d\none\ntwo"
    rows = [(i, f"http://h.org/{i}", f"<body><div>Welcome to our site</div><div><p>story {i}</p><p>more</p></div></body>") for i in range(8)]
    rows += [(100, None, None), (101, "http://h.org/x", ""), (102, "http://other.org/", "<div>Welcome to our site</div>"), (7, rows[7][1], rows[7][2])]
    got = extract_main_text(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and by[100] == "" and by[101] == "" and by[102] == "Welcome to our site"
    assert by[3].startswith("story 3") and "Welcome" not in by[3]
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract_main_text(empty(spark, "page_id long, url string, html string")).count() == 0


def test_kneser_ney_equals_brute_force(spark, monkeypatch):
    from ledgerlens.llm import quality_lm as q

    train = ["the cat sat on the mat", "a cat and a hat", "the dog", "that is the end of the cat é"]
    ask = ["the hat", "zzz", "", None, "the cat sat"]
    n = q.ORDER
    grams = Counter()
    for t in train:
        s = q.BOS * (n - 1) + t
        grams.update(s[i:i + n] for i in range(len(t)))
    levels = [grams]
    for _ in range(n - 1):
        levels.append(Counter(g[1:] for g in levels[-1]))
    letters = len(levels[-1]) + 1

    def disc(c):
        k = Counter(v for v in c.values() if v <= 4)
        if not k[1] or not k[2]:
            return [0.5, 1.0, 1.5]
        y = k[1] / (k[1] + 2 * k[2])
        d = [1 - 2 * y * k[2] / k[1], 2 - 3 * y * k[3] / k[2], 3 - 4 * y * k[4] / k[3] if k[3] else 1.5]
        return [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]

    def prob(g):
        if not g:
            return 1 / letters
        c = levels[n - len(g)]
        d = disc(c)
        same = {x: v for x, v in c.items() if x[:-1] == g[:-1]}
        low = prob(g[1:])
        if not same:
            return low
        total = sum(same.values())
        back = sum(d[min(v, 3) - 1] for v in same.values()) / total
        return max(c.get(g, 0) - d[min(c.get(g, 0), 3) - 1], 0) / total + back * low if c.get(g) else back * low

    model = q.train(spark.createDataFrame([(t,) for t in train], "text string"))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ask)], "id long, text string")
    table = q.materialize(q.probabilities(model, q.gram_counts(rows)), "t")
    want = [sum(math.log(prob((q.BOS * (n - 1) + (t or ""))[i:i + n])) for i in range(len(t or ""))) for t in ask]
    for bound in (10**6, 0):  # table sent to the tasks, and joined
        monkeypatch.setattr(q, "MAX_TABLE", bound)
        got = {r.id: r.lm_logp for r in q.score(rows, table).collect()}
        assert all(abs(got[i] - w) < 1e-4 * max(1, abs(w)) for i, w in enumerate(want))


def test_quality_and_toxicity_on_edges(spark, docs):
    from ledgerlens.llm.quality_lm import quality
    from ledgerlens.llm.toxicity import add_toxicity, score_texts, train

    none = empty(spark, "doc_id long, quality int, toxic int")
    assert quality(docs, none).where("keep").count() == docs.where("length(text) > 0").count()
    m = train(["you are an idiot and a moron", "good day to you all"] * 40, [1, 0] * 40)
    out = {r.text: r.score for r in add_toxicity(docs.select("doc_id", "text", "n"), m, "score").collect()}
    assert all(0 <= x <= 1 for x in out.values()) and None in out and "" in out
    import pyarrow as pa
    p = score_texts(pa.array(["what an idi0t and a mor0n you are idiots", "good day all"]), m)
    assert p[0] > p[1]
    assert add_toxicity(empty(spark, "doc_id long, text string"), m, "score").count() == 0


def test_mixing_meets_targets(spark, docs):
    from ledgerlens.llm.mixing import mix_to_targets

    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    want = lambda names, tokens: tokens * np.linspace(0.5, 1.5, len(names))
    rows = mix_to_targets(docs, labels, want).collect()
    n = np.array([r.mix_tokens for r in rows], float)
    p = np.array([r.mix_domains for r in rows])
    x = np.array([r.mix_rate for r in rows])
    assert (x >= 0).all() and np.allclose((n * x) @ p, want(["a", "b"], n @ p), rtol=2e-3)
    assert all(int(r.mix_rate) <= r.mix_copies <= int(r.mix_rate) + 1 for r in rows)
    assert {r.mix_rate for r in mix_to_targets(docs, empty(spark, "doc_id long, quality int, toxic int")).collect()} == {1.0}


def test_pipeline_on_small_tables(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 50
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES]) == '["toxicity", "near_duplicates", "decontamination", "mixing", "token_files"]'
    assert out.where(F.col("n_tokens") < 1).count() == 0
