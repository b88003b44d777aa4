import html
import random
import time
from collections import defaultdict

from labelflow.llm import wrappers as w

from .helpers import prose

SCHEMA = "page_id bigint, url string, html string, _page string, text string"


def _texts(spark, rows, parts=3):
    rows = [(i, u, h, "mine", "old") for i, (u, h) in enumerate(rows)]
    random.Random(parts).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return {r["page_id"]: r["text"] for r in w.extract(df).collect()}


def alone(page):
    """A page under no wrapper."""
    got = w.parse(page)
    return w.main_text(got.blocks, got.articles)


def plain(rows):
    """All pages in memory: places with one text beside enough contents are template."""
    seen, pages = defaultdict(lambda: (set(), set())), []
    for url, page in rows:
        host = (url or "").lower().split("://")[-1].split("/")[0] if "://" in (url or "") else ""
        pages.append(w.parse(page or "", host))
        for b in pages[-1].blocks:
            texts, contents = seen[host, b.place]
            texts.add(b.key)
            contents.add(pages[-1].content())
    template = {k for (_, k), (t, c) in seen.items() if len(t) == 1 and len(c) >= w.ENOUGH}
    return {i: w.main_text(p.blocks, p.articles, template) for i, p in enumerate(pages)}


def article(rng, blocks, rest=""):
    body = "".join(f"<p>{html.escape(b)}</p>" for b in blocks)
    return (f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>"
            f"<p>no';</script></head><body><header><p>Site</p></header><nav><ul><li><a href='/a'>"
            f"Home</a></li><li><a>News</a></li></ul></nav><!-- <p>x</p> --><div class=\"ad\">Buy "
            f"{rng.randint(0, 99)}</div><article>{body}</article>{rest}<aside>More</aside>"
            f"<footer>&copy; us</footer></body></html>")


def test_articles(spark):
    rng = random.Random(1)
    blocks = [[" ".join(prose(rng, 9).split()) + " & <1>" for _ in range(rng.randint(1, 6))]
              for _ in range(12)]
    blocks[4] = blocks[3]  # copies of an article stay
    rows = [(f"https://h{i % 2}.example/{i}", article(rng, b)) for i, b in enumerate(blocks)]
    got = _texts(spark, rows)
    assert got == {i: "\n".join(b) for i, b in enumerate(blocks)}


def test_pages_without_an_article_drop_the_template(spark):
    rng, rows, want = random.Random(2), [], []
    for i in range(6):
        blocks = [" ".join(prose(rng, 12).split()) for _ in range(rng.randint(1, 4))]
        body = "".join(f"<p>{b}</p>" for b in blocks)
        rows.append((f"http://soup.example/{i}",
                     f"<body><div class=top>Welcome to the site</div><div class=c>{body}</div>"
                     f"<div class=end>All rights kept</div></body>"))
        want.append("\n".join(blocks))
    assert _texts(spark, rows) == dict(enumerate(want))


def test_what_never_counts():
    page = ("<body><article><h1>Head</h1><p>One&nbsp;two\n three</p><div class='ad-box'>Ad</div>"
            "<form><label>Mail</label><button>Send</button></form><p>Four<br>five</p>"
            "<div class='cookie-notice'>Cookies</div><aside>Side</aside>"
            "<section id='comments'><p>Nice post</p></section><noscript>js</noscript>"
            "<footer>Tags</footer></article><div>Outside</div></body>")
    assert alone(page) == "Head\nOne two three\nFour\nfive"


def test_broken_markup_and_references():
    for page, want in [
            ("<article><p><b>A.<br><p>B &amp; C &#233; &eacute; &lt;p&gt;</article>",
             "A.\nB & C é é <p>"),
            ("", ""), ("just text", "just text"), ("<p", "<p"), ("a < b", "a < b"),
            ("<article><ul><li>x<li>y</ul></article>", "x\ny"),
            ("<article>t<!-- open", "t"), ("<script>while(1)", ""),
            ("<article><p title='a>b'>q</p></article>", "q"),
            ("<article></article><p>only</p>", "only"),
            ("<div class='content has-sidebar'><p>z</p></div><div id='leftSidebar'>n</div>", "z")]:
        assert alone(page) == want, page


def test_wrapper_inference(spark):
    pages = ["<body><div><p>a</p><p>b</p><p>c</p></div><h2>x</h2><div class=f12>same</div></body>",
             "<body><div><p>d</p></div><div class=f7>same</div></body>"]
    want = "<body.><div.>(<p.>#</p>)+</div>(<h2.>text</h2>)?<div.f>text</div></body>"
    for rows in (pages, pages[::-1]):
        df = spark.createDataFrame([("http://h.example/", p) for p in rows], "url string, html string")
        for parts in (1, 2):
            assert w.expression(w.infer(df.repartition(parts)).collect()) == want


def _site(rng, host, n, own_names=False):
    """Pages without any telling name, their template told by repetition alone."""
    rows = []
    for i in range(n):
        blocks = [" ".join(prose(rng, rng.randint(5, 25)).split()) for _ in range(rng.randint(1, 5))]
        body = "".join(f"<p>{b}</p>" for b in blocks)
        box = f"<div class='x{i} {'q' * (i % 50)}r{i}'>" if own_names else "<div class=t>"
        head = "<h2>Summary</h2>" if rng.random() < 0.7 else ""
        rows.append((f"http://{host}/{i}", f"<body><div class=a><b>{host}</b></div><ul class=m><li>Home"
                     f"</li><li>News {rng.choice('ab')}</li></ul>{box}{head}{body}</div>"
                     f"<div class=z>Rights</div></body>"))
    return rows


def test_order_and_partitions_do_not_matter(spark):
    rng = random.Random(11)
    rows = _site(rng, "a.example", 30) + _site(rng, "b.example", 25, own_names=True) \
        + _site(rng, "c.example", 2) + [(None, "<p>x</p>"), ("http://a.example/", None)]
    rows += rows[3:6]
    want = plain(rows)
    for parts in (1, 5, 16):
        assert _texts(spark, rows, parts) == want
    assert all("Rights" not in want[i] and "a.example" not in want[i] for i in range(30))


def test_the_wrapper_decides_against_the_rules(spark):
    """An element that marks an article holds the same promotion on every page; the text lies in
    plain elements: by the rules alone the promotion would be the main text."""
    rng, rows, want = random.Random(12), [], {}
    for i in range(6):
        body = " ".join(prose(rng, 20).split())
        rows.append((f"http://promo.example/{i}", f"<body><article><p>Try our paper</p></article>"
                     f"<div class=t><p>{body}</p></div></body>"))
        want[i] = body
        assert alone(rows[-1][1]) == "Try our paper"
    assert _texts(spark, rows) == want


def test_headings_inside_articles_stay(spark):
    rng, rows, want = random.Random(13), [], {}
    for i in range(5):
        body = [" ".join(prose(rng, 20).split()) for _ in range(2)]
        rows.append((f"http://head.example/{i}", f"<body><article><h2>Summary</h2><p>{body[0]}</p>"
                     f"<p>{body[1]}</p><h3>Pass it on</h3><div class=s>By letter</div></article>"
                     f"</body>"))
        want[i] = "\n".join(["Summary", *body])
    assert _texts(spark, rows) == want


def test_deep_and_long_pages(spark):
    deep = "<div>" * 100_000 + "<p>text</p>" + "</div>" * 100_000
    open_ = "<div><p>" * 50_000 + "end"
    long = "<article>" + "".join(f"<p>Line {i}</p>" for i in range(100_000)) + "</article>"
    got = _texts(spark, [("http://d.example/", deep), ("http://d.example/", open_),
                         ("http://l.example/", long)], parts=2)
    assert got[0] == "text" and got[1] == "end"
    assert got[2] == "\n".join(f"Line {i}" for i in range(100_000))


def test_many_pages_of_one_host_with_their_own_names_take_linear_time():
    rng, spent = random.Random(14), []
    rows = _site(rng, "one.example", 4000, own_names=True)
    for n in (1000, 4000):
        began = time.process_time()
        plain(rows[:n])
        spent.append(time.process_time() - began)
    assert spent[1] < 8 * spent[0] + 1


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://a.example/", "<p>x</p>", "r", "i", "b", "p", 5)],
                               "page_id int, url string, html string, row string, id string, "
                               "blocks string, place string, text int")
    got = w.extract(df)
    assert got.columns == ["page_id", "url", "row", "id", "blocks", "place", "text"]
    assert tuple(got.first()) == (1, "http://a.example/", "r", "i", "b", "p", "x")


def test_nulls_empty_and_hosts(spark):
    rows = [(None, None), ("", ""), ("no scheme", "<p>x</p>"), ("http://A.example/", None),
            ("http://a.example", "<article>y</article>"), ("http://a.example", "<article>y</article>")]
    assert _texts(spark, rows) == {0: "", 1: "", 2: "x", 3: "", 4: "y", 5: "y"}
    none = spark.createDataFrame([], SCHEMA)
    assert w.extract(none).collect() == []


def test_copies_do_not_erase_the_main_text(spark):
    words = " ".join(prose(random.Random(3), 30).split())
    rows = [(f"http://copies.example/{i}", f"<body><h1>Head</h1><p>{words}</p><p>x</p>"
             f"<div>Seen {i}</div></body>") for i in range(5)]
    assert _texts(spark, rows) == {i: f"Head\n{words}\nx\nSeen {i}" for i in range(5)}


def test_text_on_one_page_only_is_no_template(spark):
    rng = random.Random(6)
    body = [" ".join(prose(rng, 20).split()) for _ in range(5)]
    rows = [(f"http://one.example/{i}", f"<body><p>{b}</p>{'<h2>Only here</h2>' if i == 2 else ''}"
             f"<div class=end>All rights kept</div></body>") for i, b in enumerate(body)]
    assert _texts(spark, rows) == {i: b + ("\nOnly here" if i == 2 else "")
                                   for i, b in enumerate(body)}


def test_template_inside_articles(spark):
    rng = random.Random(7)
    body = [" ".join(prose(rng, 20).split()) for _ in range(5)]
    rows = [(f"http://art.example/{i}", f"<body><article><p>{b}</p><div class=k>Tell your friends"
             f"</div></article></body>") for i, b in enumerate(body)]
    assert _texts(spark, rows) == dict(enumerate(body))


def test_teaser_cards_do_not_mark_the_main_text(spark):
    rng = random.Random(8)
    body = [" ".join(prose(rng, 30).split()) for _ in range(4)]
    cards = [[f"Card {i} {k}" for k in range(3)] for i in range(4)]
    rows = [(f"http://cards.example/{i}", f"<body><div class=text><p>{b}</p></div><section>"
             + "".join(f"<article>{c}</article>" for c in cards[i]) + "</section></body>")
            for i, b in enumerate(body)]
    assert _texts(spark, rows) == {i: "\n".join([b, *cards[i]]) for i, b in enumerate(body)}


def test_pages_are_matched_against_their_hosts_wrapper(spark):
    """The wrapper that extraction uses has optional and repeated groups, slots and template texts;
    a page of another build does not match it."""
    rows = [(k, "http://m.example/", f"<body><h3>Site</h3><div class='item'>text of page {k}</div>"
             + (f"<div class='item'>more of page {k}</div>" if k % 2 else "")
             + ("<section>Often the same</section>" if k % 3 else "")
             + (f"<p class='rare'>only {k}</p>" if k == 4 else "") + "</body>") for k in range(12)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = [w.wrappers(df.repartition(p)).collect() for p in (1, 5)]
    assert [len(g) for g in got] == [1, 1] and {g[0].n for g in got} == {12}
    made = [w.Wrapper(g[0].nodes) for g in got]
    assert made[0].known == made[1].known
    pages = [w.parse(r[2], "m.example") for r in rows]
    shapes = {k: p.shape for page in pages for k, p in page.places.items()}
    told = {shapes[k]: bits for k, (_, bits) in made[0].known.items()}
    assert told == {"": 0, "body.": 0, "h3.": w.TEMPLATE, "div.item": w.REPEATED,
                    "section.": w.OPTIONAL | w.TEMPLATE}  # the rare one is unknown
    for page in pages:
        assert {shapes[k] for k in made[0].match(page)} <= {"h3.", "section."}
    for other in ("<body><div class='item'>no head</div></body>",
                  "<body><h3>Site</h3><h3>Site</h3><div class='item'>x</div></body>"):
        assert made[0].match(w.parse(other, "m.example")) is None
    texts = {r.page_id: r.text for r in w.extract(df).collect()}
    assert texts[4] == "text of page 4\nonly 4" and texts[1] == "text of page 1\nmore of page 1"
