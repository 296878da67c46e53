import random

from spanloom.llm import wrappers as w


def text(html, template=None):
    return w.page_text(w.blocks(html), template)


def test_article_and_boilerplate():
    html = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li>More</ul></nav><!-- ad <p>x</p> --><div class="ad">buy</div>
    <div id="cookie-notice">We use</div><article class="post"><header><h1>Ti&amp;tle &lt;b&gt;</h1></header><p><b>Un  closed<br><p>second&nbsp;one
    with <a href='x>y'>link</a>s</p><aside>side</aside><ul><li>one<li>two</ul><form>mail <input></form><p>a < b &unknown; caf&eacute;</p>
    <section id="comments"><article class="comment">nice</article></section></article><footer>&copy; x</footer></body></html>"""
    assert text(html) == "Ti&tle <b>\nUn closed\nsecond one with links\none\ntwo\na < b &unknown; café"


def test_main_and_body():
    assert text("<body><div>a<main><p>b</main>c") == "b"
    assert text("<div role=main>b<p>c</div>d") == "b\nc"
    assert text("<p>a<p>b<script>x") == "a\nb"
    assert text("<p>a<!-- open") == "a"
    assert text("") == "" and text("plain & simple") == "plain & simple" and text("<") == "<" and text("<article></article>x") == ""


def test_marks_of_boilerplate():
    for mark in ("ad", "ad-slot", "topnav", "mainMenu", "cookieBar", "user_comments", "newsletter-box", "related posts", "site-header"):
        assert text(f'<div class="{mark}">x</div><div id="{mark}">y</div><p>text</p>') == "text", mark
    for mark in ("add", "shadow", "download", "commentary", "header-title-text"[7:], "navy", "broadcast"):
        assert text(f'<div class="{mark}">x</div><p>text</p>') == "x\ntext", mark


def test_deep_and_long():
    assert text("<div>" * 5000 + "a" + "</div>" * 5000) == "a"
    assert text("<article>" + "<p>word word</p>" * 20000 + "</article>").count("\n") == 19999


def test_alignment_makes_slots_optionals_and_repeats():
    pages = ["<div><h1>A</h1><p>x</p><p>y</p><b>Fixed</b></div>", "<div><h1>B</h1><p>z</p><h2>new</h2><b>Fixed</b></div>"]
    a, b = (w.stream(w.blocks(p)) for p in pages)
    items = {i[0]: i for i in w.align(a, b)}
    assert items["/div/h1"][1:4] == [False, False, 0] and items["/div/p"][1]
    assert items["/div/h2"][2] and items["/div"][3] == w.text_hash("Fixed")
    group = w.stream(w.blocks("<h2>a</h2><p>b</p><h2>c</h2><p>d</p><h2>e</h2><p>f</p>"))
    assert len(group) == 1 and group[0][1] and [x[0] for x in group[0][4]] == ["/h2", "/p"]
    assert w.as_regex(group) == "(/h2# /p#)+"


def test_bounded():
    r = random.Random(1)
    items = w.stream([])
    for _ in range(40):
        items = w.align(items, w.stream(w.blocks("".join(f"<{t}>x</{t}>" for t in r.choices([f"t{i}" for i in range(60)], k=50)))))
    assert len(items) <= w.MOST_ITEMS


ROWS = [(i, f"http://h.example/{i}", f"<div>Menu</div><div><p>own text {i}</p></div><div>End</div>") for i in range(20)]
ROWS += [(30, None, None), (31, "http://one.example:80/", "<p>Menu</p>"), (32, "bad", ""), (3, ROWS[3][1], ROWS[3][2]), (None, "http://h.example", ROWS[0][2])]


def test_constants_of_the_host_go(spark):
    frame = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS template", "3 AS text").repartition(6)
    for limit in (w.SHIP_BYTES, -1):
        out = w.extract(frame, limit).collect()
        expected = [(i, u, f"own text {i if i is not None else 0}" if u and "h.ex" in u else {31: "Menu"}.get(i, "")) for i, u, _ in ROWS]
        assert sorted([(r.page_id, r.url, r.text) for r in out], key=repr) == sorted(expected, key=repr)
        assert all(r.n_chars == len(r.text) for r in out)


def test_no_pages(spark):
    assert w.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_constants_inside_articles_go(spark):
    shell = "<nav>x</nav><article><h1>Title {0}</h1><p>own {0}</p><p>more {0}</p><div>Share this story</div><section><h4>About us</h4></section></article>"
    main = "<main><h2>Shop</h2><p>item {0}</p></main>"
    rows = [(i, "http://a.example/", shell.format(i)) for i in range(9)] + [(10 + i, "http://m.example/", main.format(i)) for i in range(4)]
    rows += [(20 + i, "http://copies.example/", shell.format(0).replace("x", f"menu {i}")) for i in range(5)]
    out = {r.page_id: r.text for r in w.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(out[i] == f"Title {i}\nown {i}\nmore {i}" for i in range(9))
    assert all(out[10 + i] == f"item {i}" for i in range(4))
    assert all(out[20 + i] == "Title 0\nown 0\nmore 0\nShare this story\nAbout us" for i in range(5))


def test_text_after_deep_nesting():
    assert text("<body><div><article>" + "<div>" * 100 + "deep" + "</div>" * 100 + "<p>tail</p></article></div>out") == "deep\ntail"
    assert text("<article>" + "<div>" * 100 + "<nav>menu</nav><p>own</p>" + "</div>" * 100 + "<p>tail</p></article>") == "own\ntail"


def test_constants_after_many_items_stay():
    pages = ["".join(f"<t{(i * 7 + p) % 397}>{p} {i}</t{(i * 7 + p) % 397}>" for i in range(390)) + "<h6>Imprint</h6>" for p in range(4)]
    items = None
    for page in pages:
        new = w.cut_items(w.stream(w.blocks(page)))
        items = new if items is None else w.align(items, new)
    assert w.pair_hash("/h6", w.text_hash("Imprint")) in w.constants(items, 3)


def test_common_is_a_longest_subsequence():
    r = random.Random(3)
    for n in (5, 40, 400):
        x, y = (w.np.array([r.randrange(20) for _ in range(n)]) for _ in range(2))
        pairs = w.common(x, y)
        assert all(x[i] == y[j] for i, j in pairs) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:]))
        assert len(pairs) == w.lengths(x, y)[-1]


def test_marked_inline_elements():
    assert text('<article><p>one <span class="share">Share <span>it</span> now</span> two</p><p>three</p></article>') == "one two\nthree"
    assert text('<p>one <a class="ad">buy<div>in</div></a> two') == "one\ntwo"
    assert text('<p>a <b>b</b> <span class="promo">x<p>c') == "a b\nc"


def pages_of(host, bodies):
    return [(i, f"http://{host}/{i}", body) for i, body in enumerate(bodies)]


def test_marks_need_evidence_of_the_host(spark):
    """In an article, a marked element that one page has is content; one that the host's pages share is template."""
    own = ["notice", "related-work", "search results", "banner-history", "reply"]
    once = [f'<article><p>text {i}</p><div class="{own[i]}">about {own[i]}</div></article>' for i in range(5)]
    shared = [f'<article><p>text {i}</p><section id="comments"><p>reader {i * 7} says {i}</p></section></article>' for i in range(5)]
    few = [f'<article><p>text {i}</p><div class="notice">mind {i}</div></article>' for i in range(2)]
    wrapped = [f'<div class="widget"><article><p>text {i}</p></article></div>' for i in range(4)]
    rows = pages_of("once.example", once) + pages_of("shared.example", shared) + pages_of("few.example", few) + pages_of("wrapped.example", wrapped)
    for limit in (w.SHIP_BYTES, -1):
        out = {r.url: r.text for r in w.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), limit).collect()}
        assert all(out[f"http://once.example/{i}"] == f"text {i}\nabout {own[i]}" for i in range(5))
        assert all(out[f"http://shared.example/{i}"] == f"text {i}" for i in range(5))
        assert all(out[f"http://few.example/{i}"] == f"text {i}" for i in range(2))
        assert all(out[f"http://wrapped.example/{i}"] == f"text {i}" for i in range(4))


def brute(pages):
    """What a host's pages keep: of each article's blocks those whose (tag, text) is not on every page."""
    everywhere = set.intersection(*[set(p) for p in pages])
    return ["\n".join(t for tag, t in p if (tag, t) not in everywhere) for p in pages]


def test_templates_against_brute_force(spark):
    """Random templates around and inside random articles, a tag per place, so that constants are what all pages share."""
    r = random.Random(11)
    rows, expected = [], {}
    for h in range(12):
        n = r.randrange(3, 9)
        fixed = {f"t{k}": f"fixed {h} {k}" for k in range(r.randrange(1, 5))}
        pages = []
        for i in range(n):
            blocks = [(f"o{k}", f"own {h} {i} {k}") for k in range(r.randrange(1, 6))]
            for tag, text_ in fixed.items():
                blocks.insert(min(len(blocks), 2 * int(tag[1:])), (tag, text_))
            pages.append(blocks)
        for i, (blocks, kept) in enumerate(zip(pages, brute(pages), strict=True)):
            url = f"http://h{h}.example/{i}"
            body = "".join(f"<{tag}>{t}</{tag}>" for tag, t in blocks)
            rows.append((len(rows), url, f"<nav>menu</nav><article>{body}</article><footer>end</footer>" if h % 3 else body))
            expected[url] = kept
    out = {r.url: r.text for r in w.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert out == expected
