"""Near-duplicates, neighbours, pages and dialogues."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F


def brute_components(rows, size, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    top = {d: d for d, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(rows[i][0]), find(rows[j][0])
                top[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for (d, _), s in zip(rows, sets, strict=True)}


def variants(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own))
    common = " ".join(word() for _ in range(60))
    rows += [common + " " + " ".join(word() for _ in range(25)) for _ in range(60)]  # alike, but under the threshold
    rows += [None, "", "  \n", "one", "ONE", "one two", "one two", "A\tb\nc d e", "a b c D e"]
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, monkeypatch, size):
    from notegrid.llm import neardup

    monkeypatch.setattr(neardup, "SLICE", 6)  # so that groups are dealt in several slices
    rows = variants(size)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, key string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.link(df, size).collect()}
    assert got == brute_components(rows, size, 80)


def test_near_duplicates_edges(spark):
    from notegrid.llm import neardup

    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (9, None), (5, "other text than before by far")]
    got = sorted(((r.doc_id or -1), r.component_id, r.kept) for r in neardup.link(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.n_shingles)
    assert got == [(-1, None, True), (5, 5, True), (5, 5, True), (5, 5, True), (7, 5, False)]
    assert neardup.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_without(spark):
    from notegrid.llm import neardup

    docs = spark.range(300).select(F.when(F.col("id") != 7, F.col("id")).alias("doc_id"), F.col("id").alias("_near"), F.lit("x").alias("_bits"), F.col("id").alias("_gone"))
    gone = spark.range(0, 600, 3).select(F.col("id").alias("doc_id"))
    got = neardup.without(docs, gone)
    assert got.columns == docs.columns and sorted(r._near for r in got.collect()) == [i for i in range(300) if i % 3 or i == 7]
    assert neardup.without(docs, gone.limit(0)).count() == 300 and neardup.without(docs.limit(0), gone).count() == 0


def test_prefix_and_components(spark):
    from notegrid.llm import neardup

    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 205)], "a long, b long")
    got = {r.id: r.component for r in neardup.components(edges).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and got[205] == got[100] == 100


def test_neighbours(spark, sf):
    from notegrid.llm.neighbours import hilbert, search

    # the curve visits every cell once, by steps of one
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    key = hilbert(cells, 3)
    assert sorted(key) == list(range(512)) and (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()

    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    pdf = df.toPandas()
    v, ids = np.stack(pdf.embedding.to_numpy()).astype(float), pdf.vec_id.to_numpy()
    got = search(df, F.col("vec_id") % 100 == 0).toPandas()
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((v - v[ids == q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        want = ids[np.lexsort((ids, d))[:10]]
        own = got[got.query_id == q].sort_values("rank")
        assert np.allclose(own.score, [d[ids == x][0] for x in own.vec_id]) and own["rank"].tolist() == list(range(1, 11))
        hits, total = hits + len(set(own.vec_id) & set(want)), total + 10
    assert hits / total >= 0.9


def test_neighbours_edges(spark):
    from notegrid.llm.neighbours import search

    nan = float("nan")
    rows = [(i, [1.0, 2.0]) for i in range(0, 30)] + [(100, [1.0, 2.5]), (100, [1.0, 2.5]), (200, None), (300, [0.0, 0.0]), (400, [nan, 1.0]), (500, [None, 1.0]), (None, [1.0, 1.0]), (600, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<double>, score int")
    got = search(df, F.col("vec_id") % 100 == 0).collect()
    assert {r.query_id for r in got} == {0, 100}
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0] == list(range(1, 11))
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 100] == list(range(10))
    assert search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    few = search(df.filter("vec_id in (0, 100)"), F.col("vec_id") % 100 == 0).collect()
    assert sorted((r.query_id, r.vec_id) for r in few) == [(0, 100), (100, 0)]


def test_neighbours_ties(spark):
    import pandas as pd

    from notegrid.llm.neighbours import ranked, search

    # 64 distinct vectors at exactly one distance from the query
    rows = [(0, [8.0] * 64)] + [(i, [8.0 + (j == i - 1) for j in range(64)]) for i in range(64, 0, -1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(search(df, F.col("vec_id") == 0).collect(), key=lambda r: r["rank"])
    assert [r.vec_id for r in got] == list(range(1, 11)) and {r.score for r in got} == {1.0}
    # blocks of queries don't change the result
    rng = np.random.default_rng(4)
    many = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    one, few = (sorted(map(tuple, search(many, F.col("vec_id") % 3 == 0, range_rows=r, share=1.0).collect())) for r in (8192, 16))
    assert one == few
    # against brute force, distances of few values
    v = rng.integers(0, 3, (200, 4)).astype(float)
    left = pd.DataFrame({"vid": rng.permutation(200), "v": list(v)})
    right = pd.DataFrame({"vid": np.arange(1000, 1300), "v": list(rng.integers(0, 3, (300, 4)).astype(float))})
    found = ranked(left, right, 7).reset_index(drop=True)
    for i, own in found.groupby("qid"):
        d = np.sqrt(((np.stack(left.v) - right.v[i - 1000]) ** 2).sum(axis=1))
        want = sorted(zip(d, left.vid, strict=True))[:7]
        assert list(zip(own.score, own.vid, strict=True)) == want


PAGE = '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="ad">Buy</div><article><h1>Head &amp; line</h1><p><b>First<br>part<p>Second  &lt;p&gt;\n text</p><aside>Side</aside><div class="share-box">Share</div></article><section id="comments-12"><article>I agree</article></section><form><p>Name</p></form><footer>&copy; x</footer></body></html>'


def test_main_text():
    from notegrid.llm.htmltext import main_text

    assert main_text(PAGE, None, set(), set()) == "Head & line First part Second <p> text"
    assert main_text("", None, set(), set()) == "" and main_text("plain &eacute; text", None, set(), set()) == "plain é text"
    assert main_text("<div><p>one</p><p><a href=x>link</a></p>two<b>bold</b></div><p class='x", None, set(), set()) == "one twobold"
    assert main_text("<div class=cookie>ok</div><main><header><h1>T</h1><p>by</p></header>a < b &amp; c</main>", None, set(), set()) == "T a < b & c"
    assert main_text("<script>x", None, set(), set()) == ""


def test_hostile_markup():
    import time

    from notegrid.llm.htmltext import main_text

    for html in ("<a " * 330_000, "<div>" * 60_000 + "</p></span></ul>" * 30_000, '<a b="' * 150_000, "<![CDATA[" * 100_000, "<a " * 330_000 + 'b=">"', "<a b='x " * 100_000, "<" * 1_000_000):
        start = time.time()
        main_text(html, None, set(), set())
        assert time.time() - start < 3
    assert main_text("<p title='a>b'>x</p><p a=b'c>y</p><![CDATA[z]]><!-- > -->w", None, set(), set()) == "x y w"


def plain_page(i, extra=""):
    """No article, no telling names or tags; menus, adverts and footers differ from page to page."""
    menu = "".join(f"<a href=/{i}{k}>go {i * 7 + k}</a> " for k in range(5))
    body = "".join(f"<p>Paragraph {k} of story {i} says {i * k} things.</p>" for k in range(6))
    return f"<html><body><div class=xa>{menu}</div><div class=xb>Buy thing {i}</div><div class=xc><h1>Story {i}</h1><div class=xd>{body}</div><div class=xe>Sent to all readers</div>{extra}</div><div class=xf>Imprint {i % 3}</div></body></html>"


def plain_text(i):
    return f"Story {i} " + " ".join(f"Paragraph {k} of story {i} says {i * k} things." for k in range(6))


def test_pages_by_template(spark):
    from notegrid.llm.htmltext import extract, main_text

    rows = [(i, f"http://d.example/{i}", plain_page(i)) for i in range(9)]
    rows += [(20, "http://d.example/odd", "<article><p>Another layout</p></article>"), (30, "http://e.example/1", plain_page(1))]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == plain_text(i) for i in range(9))  # slots decide, and the boxed note is template text
    assert got[20] == "Another layout"
    assert got[30] == main_text(plain_page(1), None, set(), set()) != plain_text(1)  # a lone page has no template
    # an article whose class holds a word of the list is the main slot all the same
    rows = [(i, f"http://f.example/{i}", f"<nav>{i}</nav><article class='post tags-travel'><h1>T{i}</h1><p>{'long text ' * 9}{i}</p></article><div class=comments>{'I agree ' * 5}{i}</div>") for i in range(8)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"T{i} {'long text ' * 9}{i}" for i in range(8))
    # pages that are near copies of one another keep what they share
    rows = [(i, f"http://g.example/{i}", f"<div class=a>top</div><article><p>{'Shared passage. ' * 20}</p><p>day {i}</p></article>") for i in range(8)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"{('Shared passage. ' * 20).strip()} day {i}" for i in range(8))


def test_classes_equal_brute_force(spark):
    from collections import Counter, defaultdict

    from notegrid.llm.htmltext import LEAST_PAGES, SUPPORT, classes, page_tokens
    from notegrid.storage import Workspace

    rng = random.Random(7)
    rows = []
    for i in range(40):
        parts = [f"<div class=c{'abc'[k]}>{rng.choice(['same', 'other', str(i)])}</div>" * rng.randint(0, 2) for k in range(3)]
        rng.shuffle(parts)
        rows.append((i, f"http://h{i % 3}.example/{i}", "<body><div class=top>always</div>" + "".join(parts) + f"<p>{i // 2}</p></body>"))
    pages = {}  # (host, page digest) -> tokens of the copy with the least digest
    from notegrid.llm.htmltext import digest

    for _, url, html in rows:
        page, tokens = page_tokens(html)
        key = url.split("/")[2], page
        if key not in pages or digest(html) < pages[key][0]:
            pages[key] = digest(html), tokens
    vectors = defaultdict(dict)
    for (host, page), (_, tokens) in pages.items():
        for row in tokens:
            vectors[host, row[0]][page] = row[4]
    sizes = Counter(h for h, _ in pages)
    want = {k: v for k, v in vectors.items() if sizes[k[0]] >= LEAST_PAGES and len(v) >= sizes[k[0]] * SUPPORT}
    keep = Workspace(spark, "test")
    got = {(r.host, r.token): r for r in classes(spark.createDataFrame(rows, "page_id long, url string, html string"), keep)[0].collect()}
    assert set(got) == set(want) and all(got[k].support == len(v) for k, v in want.items())
    places = defaultdict(set)
    for (host, page), (_, tokens) in pages.items():
        own = defaultdict(list)
        for row in sorted(tokens, key=lambda r: (r[5], r[0])):
            if (host, row[0]) in want:
                own[frozenset(want[host, row[0]].items())].append(row[0])
        for members in own.values():
            for n, token in enumerate(members):
                places[host, token].add(n)
    for k, v in want.items():
        same = {x for x in want if x[0] == k[0] and want[x] == v}
        assert {x for x in got if x[0] == k[0] and got[x].vector == got[k].vector} == same
        assert got[k].steady == (len(places[k]) == 1)
    keep.close()


def test_pages(spark):
    from notegrid.llm.htmltext import extract

    body = "<body><div class='top'>Our site since 1999</div><div class='text'><p>{}</p></div></body>"
    rows = [(i, f"http://h.example/{i}", body.format(f"Story number {i} " * 5), "x") for i in range(8)] + [(20, None, None, "x"), (21, "no url", PAGE, "x"), (21, "no url", PAGE, "x"), (22, "http://lone.example/a", body.format("alone"), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in extract(df).collect()}
    assert got[3].text == ("Story number 3 " * 5).strip() and got[3].n_chars == len(got[3].text)  # the template's text is gone
    assert got[20].text == "" and got[21].text.startswith("Head & line") and got[22].text == "Our site since 1999 alone"
    assert extract(df).count() == len(rows) and extract(df.limit(0)).count() == 0


def test_pages_repeated_text(spark):
    from notegrid.llm.htmltext import extract

    top = "<div class='top'>Our site since 1999</div>"
    body = "<body>" + top + "<div class='text'>{}</div></body>"
    copy = "<p>Short one</p><p>" + "Long passage of the copied story. " * 10 + "</p>"
    rows = [(i, f"http://a.example/{i}", body.format(f"<p>Story number {i}</p>")) for i in range(6)]
    # copies: some equal in all, some with another date, together more than half of the host's pages
    rows += [(10 + i, f"http://a.example/c{i}", body.format(f"{copy}<p>Seen on day {i // 2}</p>")) for i in range(20)]
    article = "<body>" + top + "<article><h1>Head</h1><p>Short one</p><p>day {}</p></article></body>"
    rows += [(40 + i, f"http://b.example/{i}", article.format(i // 3)) for i in range(30)]
    rows += [(80 + i, f"http://b.example/o{i}", f"<body>{top}<article><p>Other {i}</p></article></body>") for i in range(8)]
    # an even number of equal pages must not cancel out; a text of an optional box is template with its box
    rows += [(100 + i, "http://c.example/x", body.format("<p>Twice</p>")) for i in range(2)]
    rows += [(110 + i, f"http://c.example/{i}", body.format(f"<p>Page {i}</p>" + ("<div class='box'>Boxed</div>" if i % 4 else ""))) for i in range(8)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story number 3"
    long = ("Long passage of the copied story. " * 10).strip()
    assert all(got[10 + i] == f"Short one {long} Seen on day {i // 2}" for i in range(20))
    assert all(got[40 + i] == f"Head Short one day {i // 3}" for i in range(30)) and got[80] == "Other 0"
    assert got[100] == got[101] == "Twice" and got[110] == "Page 0" and got[111] == "Page 1"


def test_names_only_weigh():
    from notegrid.llm.htmltext import main_text

    read = lambda html: main_text(html, None, set(), set())
    assert read('<nav><a href=x>Home</a></nav><article class="post ad-free"><p>Hello world body</p></article>') == "Hello world body"
    assert read('<div class="content share-enabled has-sidebar"><p>Body here text</p></div>') == "Body here text"
    assert read('<article class="post tags-travel"><p>Article text</p></article><div><p>Side</p></div>') == "Article text"
    assert read('<article class="notice"><p>The long one of them</p></article><div class=x><p>side</p></div>') == "The long one of them"
    assert read('<article class="comment"><p>hi</p></article><div><p>The longer text of the page</p></div>') == "The longer text of the page"
    assert read('<main><article class="comment-list"><p>a reply</p></article><p>real text</p></main>') == "real text"
    assert read('<div class="site-footer">Imprint</div><div><p>Text</p></div>') == "Text"
    assert read("<nav>menu</nav>") == read('<div hidden="">x</div>') == ""


def test_visible_text_is_never_lost_by_names():
    from notegrid.llm.htmltext import main_text

    rng = random.Random(9)
    for _ in range(400):
        depth, parts = 0, []
        for k in range(rng.randint(1, 12)):
            if depth and rng.random() < 0.4:
                parts.append("</div>")
                depth -= 1
            else:
                name = "-".join(rng.choices(["ad", "comment", "share", "free", "list", "menu", "a", "promo"], k=rng.randint(1, 2)))
                parts.append(f"<{'div'} class='{name}'>")
                depth += 1
                if rng.random() < 0.5:
                    parts.append(f"<p>visible {k}</p>" if rng.random() < 0.8 else f"<a href=x>linked {k}</a>")
        html = "".join(parts)
        assert bool(main_text(html, None, set(), set())) or "visible" not in html, html


def test_rotation(spark, duck, sf):
    from notegrid.llm.chat import ORACLE, rotate

    key = ["conv_id", "assistant", "part"]
    got = rotate(spark.read.parquet(f"{sf}/conversations.parquet")).toPandas().sort_values(key).reset_index(drop=True)
    want = duck.sql(ORACLE).df().sort_values(key).reset_index(drop=True)[list(got.columns)]
    assert (got == want).all().all() and len(got)


def test_rotation_edges(spark):
    from notegrid.llm.chat import rotate

    rows = [(1, t, ["ann", "bob", "cy"][t % 3], f"say {t}") for t in range(600)] + [(2, None, None, None), (2, 1, "system", "be <|im_end|> good"), (None, 0, "ann", "x"), (3, 0, "system", "only"), (4, 5, "ann", "same"), (4, 5, "ann", "same")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, part int")
    got = rotate(df).toPandas().sort_values(["conv_id", "assistant", "part"])
    one = got[(got.conv_id == 1) & (got.assistant == "bob")]
    assert one.part.tolist() == [0, 1, 2] and one.n_turns.sum() == 600
    whole = "".join(one.rendered)
    spans = [tuple(map(int, x.split(":"))) for m in one["mask"] for x in m.split(",")]
    assert [whole[a:b] for a, b in spans] == [f"say {t}<|im_end|>" for t in range(1, 600, 3)]
    assert set(got[got.conv_id == 2].assistant) == {"unknown"} and "be < |im_end|> good" in got[got.conv_id == 2].rendered.iloc[0]
    assert len(got[got.conv_id.isna()]) == 1 and 3 not in set(got.conv_id) and got[got.conv_id == 4].n_turns.tolist() == [2]
    assert rotate(df.limit(0)).count() == 0
