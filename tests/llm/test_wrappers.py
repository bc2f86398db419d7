"""Folding, alignment and extraction of main texts."""

import html
import json
import random
import re
import tracemalloc

from keysieve.llm import wrappers as W

PAGES = "page_id long, url string, html string, text string, host string"


def texts(spark, rows):
    frame = spark.createDataFrame([(i, u, h, "old", "old") for i, u, h in rows], PAGES)
    got = W.extract(frame).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    return {r.page_id: r.text for r in got}


def test_folding_is_lossless_and_nests():
    keys = ["ul", *["li", "#", "/li"] * 5, "/ul", *["p", "b", "#", "br", *["p", "#", "/p"] * 3] * 2]
    items = W.Folder().fold(keys)
    assert items == ["ul", ["li", "#", "/li"], "/ul", ["p", "b", "#", "br", ["p", "#", "/p"]]]
    assert W.slots_of(items, keys) == [-1, *[-1, 0, -1] * 5, -1, *[-1, -1, 1, -1, *[-1, 2, -1] * 3] * 2]


def test_alignment_makes_optional_groups_and_slots():
    a = W.wrapper_of(["div", "#", "/div", "p", "#", "/p"], [1, 2], [1, 2], 3)
    b = W.wrapper_of(["div", "#", "/div", "hr", ["p", "#", "/p"]], [1, 9], [1, 9], 1)
    both = W.align(a, b)
    assert [(k if isinstance(k, str) else "+", o) for k, o, _ in both] == [
        ("div", False), ("#", False), ("/div", False), ("p", True), ("#", True), ("/p", True), ("hr", True), ("+", True)
    ]
    assert both[1][2].low == both[1][2].high == 1 and both[1][2].pages == 4


ARTICLE = (
    '<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a href=/>x</a></nav>'
    '<!-- c --><div class="ad">buy</div><article><h1>A &amp; B</h1><p><b>bold</b>ly\n  said<br>twice<br><p>un&eacute;ven &#8364;</p>'
    '<aside>side</aside><form><p>form</p></form><div id="comments"><p>first!</p></div></article><footer>&copy; f</footer>'
)


def test_article_without_its_surroundings(spark):
    rows = [
        (1, "http://a.test/1", ARTICLE), (2, "http://a.test/2", None), (3, "http://a.test/3", ""), (4, "http://b.test", "just text &lt;b&gt;"),
        (5, None, "<main><p>main <i>part</i>.</p><header><p>kept</p></header></main><header>top</header><p>out"), (None, "::bad::", "<p>no id</p>"),
        (6, "http://c.test", "<p>a</p> <p>b</p>" + "<p>long</p>" * 20_000), (1, "http://a.test/1", ARTICLE),
        (9, "http://f.test", "<article><p>own</p></article><article class='comment'><p>reader</p></article><div class='comment-list'>x</div>"),
        (7, "http://d.test", "<article>broken <p title='>' class=x>tail <!-- never closed"), (8, "http://e.test", "<" * 50 + "a<b" * 50),
    ]
    got = texts(spark, rows)
    assert got[1] == "A & B boldly said twice unéven €"
    assert got[2] == got[3] == ""
    assert got[4] == "just text <b>"
    assert got[5] == "main part. kept"
    assert got[None] == "no id"
    assert got[6] == "a b" + " long" * 20_000
    assert got[9] == "own"
    assert got[7] == "broken tail"
    assert texts(spark, []) == {}


def test_without_article_the_changing_texts_stay(spark):
    page = '<div class=logo>Our site</div><div class="menu"><ul><li>Home</li></ul></div><div class=txt>{}</div><div class="sidebar">s{}</div><p>All rights</p>'
    rows = [(i, "http://x.test/%d" % i, page.format("".join(f"<p>par {i}.{k}</p>" for k in range(i % 4 + 1)), i)) for i in range(12)]
    assert texts(spark, rows) == {i: " ".join(f"par {i}.{k}" for k in range(i % 4 + 1)) for i in range(12)}


def test_driver_pages_equal_a_direct_cut(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in W.extract(frame).collect()}
    for r in frame.collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside))
        assert got[r.page_id] == " ".join(b for b in blocks if b)


def test_wrapper_survives_storage():
    made = W.wrapper_of(["p", "#", ["li", "#"]], [1, 2], [3, 4], 2)
    again = W._load(json.loads(json.dumps(W._dump(made))))
    assert W._dump(again) == W._dump(made)


def test_copies_of_a_page_say_nothing_about_its_slots(spark):
    whole, quote = "<div><p>Whole article</p></div>", "<h2>Rare heading</h2><pre>code</pre><p>text {}</p><h6>Site</h6>"
    rows = [(1, "http://a.test/1", whole), (2, "http://a.test/2", whole), (3, None, whole), (4, "::odd::", whole), (5, "http://b.test/0", quote.format(0))]
    rows += [(5 + i, "http://b.test/%d" % i, quote.format(0) if i == 1 else f"<p>text {i}</p><h6>Site</h6>") for i in range(1, 6)]
    got = texts(spark, rows)
    assert [got[i] for i in (1, 2, 3, 4)] == ["Whole article"] * 4
    assert got[5] == got[6] == "Rare heading code text 0"
    assert [got[i] for i in (7, 8, 9, 10)] == [f"text {i}" for i in (2, 3, 4, 5)]


def test_names_that_only_contain_a_word_do_not_empty_a_page(spark):
    side = '<div class="sidebar-wrapper"><p>side</p></div><div class="left-sidebar"><p>side</p></div>'
    rows = [
        (1, "http://a.test", f'<div class="content-sidebar-wrap"><main><p>one</p></main>{side}</div>'),
        (2, "http://b.test", f'<div id=page class="has-sidebar"><article><p>two</p></article>{side}</div>'),
        (3, "http://c.test", f'<div class="no-comments"><p>three</p>{side}</div>'),
        (4, "http://d.test", '<article class="post comment-status-open category-discussion"><p>four</p></article>'),
        (5, "http://e.test", '<div class="sidebar"><article><p>five</p><div class="share">x</div></article></div><nav>menu</nav>'),
        (6, "http://f.test", '<div class="promo"><p>six</p></div><footer>f</footer>'),
        (7, "http://g.test", '<main><p>seven</p></main><div class="related"><article><p>teaser</p></article></div>'),
        (8, "http://h.test", '<article><p>eight</p></article><div id="comments"><article class="comment-body"><p>reader</p></article></div>'),
    ]
    assert texts(spark, rows) == dict(zip(range(1, 9), "one two three four five six seven eight".split()))


def test_numbers_in_names_make_no_expressions(spark):
    rows = [(i, f"http://a.test/{i}", f'<div id=post-{i} class="c{i} entry x3f{i}a"><p>text {i}</p></div><p>foot</p>') for i in range(40)]
    frame = spark.createDataFrame([(*r, "", "") for r in rows], PAGES)
    choices, _ = W.infer(frame)
    assert choices.count() == 1
    assert texts(spark, rows) == {i: f"text {i}" for i in range(40)}


def test_alignment_of_long_pages_needs_little_memory(monkeypatch):
    rng = random.Random(4)
    for n, m in ((1, 9), (40, 31), (60, 90)):
        a, b = rng.choices("abcd", k=n), rng.choices("abcd", k=m)
        exact = len(W._table_run(a, b))
        monkeypatch.setattr(W, "CELLS", 12)
        found = W._common(a, b)
        monkeypatch.undo()
        assert len(found) == exact and all(a[i] == b[j] for i, j in found)
        assert all(i < k and j < l for (i, j), (k, l) in zip(found, found[1:]))
    long = [[(rng.choice("abcdefgh"), False, None) for _ in range(4000)] for _ in range(2)]
    tracemalloc.start()
    W.align(*long)
    assert tracemalloc.get_traced_memory()[1] < 30 << 20
    tracemalloc.stop()


def test_a_host_of_many_expressions_is_aligned_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(W, "GROUP", 3)
    tags = ["h2", "pre", "ul", "dl", "table"]
    rows = []
    for i in range(32):
        own = "".join(f"<{t}>{t} {i}</{t}>" for k, t in enumerate(tags) if i >> k & 1)
        rows.append((i, f"http://a.test/{i}", f"<div>top</div>{own}<p>text {i}</p>"))
    got = texts(spark, rows)
    assert all(r.endswith(f"text {i}") and r.count(str(i)) >= 1 for i, r in got.items())
    assert [got[0], got[1]] == ["text 0", "h2 1 text 1"]


SITE = "<article><h1>Weekly</h1>{}<div class=more>Read more on our site</div></article>"


def _own(i):
    return "".join(f"<p>text {i}.{k}</p>" for k in range(i % 3 + 1)) + ("<pre>quoted</pre>" if i in (2, 5) else "")


def test_a_line_on_all_pages_of_a_host_goes_from_inside_the_article(spark):
    rows = [(i, f"http://a.test/{i}", SITE.format(_own(i))) for i in range(12)]
    # A host of two pages, and copies of one page with another date, show no template.
    rows += [(20 + i, f"http://b.test/{i}", SITE.format(_own(i))) for i in range(2)]
    rows += [(30 + i, f"http://c.test/{i}", f"<p>day {i}</p>" + SITE.format("<p>same</p>")) for i in range(4)]
    got = texts(spark, rows)
    own = lambda i: "Weekly " + " ".join([f"text {i}.{k}" for k in range(i % 3 + 1)] + ["quoted"] * (i in (2, 5)))
    assert {i: got[i] for i in range(12)} == {i: own(i) for i in range(12)}
    assert [got[20], got[21]] == [own(i) + " Read more on our site" for i in (0, 1)]
    assert {got[30 + i] for i in range(4)} == {"Weekly same Read more on our site"}


def test_the_line_goes_by_alignment(monkeypatch):
    own = [
        W.wrapper_of(["article", "h1", "#", "/h1", *body, "div class=more", "#", "/div", "/article"], [1, *at, 7], [1, *at, 7], 2, i, i + 1)
        for i, (body, at) in enumerate([(["p", "#", "/p"], [20]), (["p", "#", "/p", "pre", "#", "/pre"], [30, 31]), (["ul", "#", "/ul"], [40])])
    ]
    whole = W.align(W.align(own[0], own[1]), own[2])
    assert [W.chosen(whole, x) for x in own] == [[True, True, False], [True, True, True, False], [True, True, False]]
    monkeypatch.setattr(W, "_common", lambda a, b: [])
    assert all(all(W.chosen(whole, x)) for x in own)
