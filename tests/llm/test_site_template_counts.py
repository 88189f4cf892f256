from __future__ import annotations


def texts(spark, rows):
    from ledgerlens.llm.site_templates import extract_main_text

    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert len(got) == len(rows)
    return {r.page_id: r.text for r in got}


def story(i):
    return f"The story number{i} tells what happened in town{i}."


def test_recurring_prose_in_articles_is_template(spark):
    page = "<article><h1>Title {i}</h1><p>{s} It was <b>new</b> then.</p><p>Sign up for the weekly letter.</p><ul><li>One</li><li>Two</li></ul></article>"
    by = texts(spark, [(i, f"http://a.org/{i}", page.format(i=i, s=story(i))) for i in range(9)])
    assert by == {i: f"Title {i}\n{story(i)} It was new then." for i in range(9)}


def test_copies_keep_their_text(spark):
    inside = "<article><div class=entry><p>All of this text is here.</p></div><p>The end.</p></article>"
    rows = [(i, f"http://a.org/?from={i}", f"<body>{inside}</body>") for i in range(6)]
    rows += [(10 + i, f"http://b.org/?from={i}", "<body><div><p>All of this text is here.</p></div></body>") for i in range(6)]
    rows += [(20 + i, None, "<body><div><p>No host at all.</p></div></body>") for i in range(6)]
    # Edited copies: another line changed in each.
    lines = [f"<p>Line {k} of a long and careful text.</p>" for k in range(24)]
    for i in range(24):
        rows.append((30 + i, f"http://c.org/{i}", "<article>" + "".join([*lines[:i], f"<p>Edit {i}</p>", *lines[i + 1:]]) + "</article>"))
    by = texts(spark, rows)
    assert all(by[i] == "All of this text is here.\nThe end." for i in range(6))
    assert all(by[10 + i] == "All of this text is here." and by[20 + i] == "No host at all." for i in range(6))
    assert all(by[30 + i].count("\n") == 23 for i in range(24))


def test_hot_and_small_hosts_find_their_templates(spark):
    rows = [(i, f"http://hot.org/{i}", f"<body><div>{'Section of sports' if i < 8 else 'No section' + str(i)}</div><div>{story(i)}</div></body>") for i in range(200)]
    rows += [(1000 + i, f"http://small.org/{i}", f"<body><div>Welcome to us</div><div>{story(i)}</div></body>") for i in range(3)]
    by = texts(spark, rows)
    assert all(by[i] == story(i) for i in range(8)) and by[9].startswith("No section9")
    assert all(by[1000 + i] == story(i) for i in range(3))


def test_lines_of_articles_go_only_with_evidence(spark):
    """A sentence that stands in some articles stays; one that the site also
    prints outside, or in half of its articles, goes."""
    def page(i, *lines, foot=""):
        return f"<body><article><h1>Title {i}</h1><p>{story(i)}</p>{''.join(f'<p>{x}</p>' for x in lines)}<p>End of {i}.</p></article>{foot}</body>"

    said, printed, usual = "That is all we know.", "Read more in our archive.", "Write to the editors."
    rows = []
    for i in range(40):
        lines = ([said] if i % 4 == 0 else []) + ([printed] if i % 4 == 1 else []) + ([usual] if i % 2 else [])
        rows.append((i, f"http://a.org/{i}", page(i, *lines, foot=f"<p>{printed}</p>" if i % 3 == 0 else "")))
    rows += [(100 + i, f"http://few.org/{i}", page(100 + i, said)) for i in range(3)]
    by = texts(spark, rows)
    for i, text in by.items():
        body = f"Title {i}\n{story(i)}\n"
        assert text == body + (f"{said}\n" if i >= 100 or i % 4 == 0 else "") + f"End of {i}."


def test_formulas_and_fallbacks_stay(spark):
    by = texts(spark, [(1, None, "<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p><object>A map</object><canvas>A chart</canvas></article>")])
    assert by[1].replace("\n", " ").split() == "So x=1 holds. A mapA chart".split()


def test_empty_tables_and_long_pages(spark):
    from ledgerlens.llm.site_templates import extract_main_text

    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract_main_text(none).count() == 0
    words = " ".join(f"word{i}" for i in range(60_000))
    by = texts(spark, [(1, "http://a.org/", f"<article><p>{words}</p></article>"), (2, "http://a.org/2", None), (3, None, "")])
    assert by == {1: words, 2: "", 3: ""}


def test_templates_equal_brute_force_counts(spark):
    import random

    from ledgerlens.llm import site_templates as st

    rnd = random.Random(5)
    rows = []
    for i in range(120):
        host = rnd.choice(["hot.org"] * 6 + ["b.org", "c.org"])
        lines = [rnd.choice(["Often said.", "Rarely said.", "Also here.", f"Own line {i}.", f"Other line {i}."]) for _ in range(6)]
        body = "".join(f"<div><p>{x}</p><p>And more.</p></div>" if rnd.random() < 0.3 else f"<p>{x}</p>" for x in lines)
        rows.append((i, f"http://{host}/{i}", f"<article>{body}</article><p>{rnd.choice(['Also here.', 'Foot.'])}</p>" if i % 5 else f"<body>{body}</body>"))
    pages = spark.createDataFrame(rows + rows[:20], "page_id long, url string, html string")
    got = {tuple(r) for r in st.site_templates(st.subtrees(pages)).collect()}
    by: dict = {}
    for _, url, html in rows:
        for digest, main, before, after, line in st.page_subtrees(html):
            by.setdefault((url.split("/")[2], digest, line), []).append((main, before, after))
    want = set()
    for (host, digest, line), seen in by.items():
        n = len({m for m, _, _ in seen})
        pages_of = len({m for m, _, _ in by[host, 0, 0]})
        enough = max(st.MIN_PAGES, pages_of * st.LINE_SHARE) if line else min(st.MIN_PAGES, pages_of)
        between = max(len({b for _, b, _ in seen}), len({a for _, _, a in seen}))
        if digest and n >= 2 and n >= enough and 2 * between >= n:
            want.add((host, digest))
    assert got == want and len(want) > 5
