"""Article text of pages: literal cases, and a parser that keeps a stack of elements over random nestings."""

import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from corvane.sources import pages

VOID = set(pages.VOID)


def texts(spark, htmls):
    frame = spark.createDataFrame(list(enumerate(htmls)), "id long, html string").withColumn("title", F.lit("t"))
    return [r.text.split("---\n\n", 1)[1] for r in pages.article_text(frame, "html", "title").orderBy("id").collect()]


def test_nested_noise_goes_whole(spark):
    toc = '<div class="toc"><div class="toctitle">Contents</div><ul><li>one</li></ul><div>two</div></div>'
    got = texts(spark, [
        f'<body><p>menu</p><div class="mw-parser-output"><p>a</p>{toc}<p>b</p><div>c<div>d</div></div></div><p>foot</p></body>',
        f'<body><div id="mw-content-text"><p>x{toc}y</p></div>z</body>',
        '<body>a<nav><nav>in</nav>still</nav>b</body>',
        '<body>a<table class="metadata x"><tr><td><table><tr><td>deep</td></tr></table>more</td></tr></table>b</body>',
        '<body>a<span class="mw-editsection">[<span>edit</span>]</span> b <span class="plain">c</span></body>',
        '<p>no body &amp; no main</p><div id=toc>gone</div>rest',
        '<body>a<img class="navbox">b<br class="navbox"/>c<div class="navbox"/>d</body>',
        '<body>a<div class="noprint">never closed<p>b</p></body>',
        '<body>a<p title="x > y <div class=\'toc\'>">b</p></body>',
        '<body>a<div data-class="toc">b</div><div CLASS=\'nine\ttocs\'>gone</div></body>',
        None, "", "plain < text", "<body></body>",
        '<script>var x = "<div class=toc>";</script><body>a<!-- <div class="toc"> -->b<style>p > a {}</style></body>',
    ])
    assert got == ["a\n\nb\n\nc\nd", "x\ny", "a\nb", "a\nb", "a b c", "no body & no main\n\nrest", "ab\nc\nd", "a", "a\nb", "a\nb", "", "", "plain < text", "", "ab"]


def test_head_line(spark):
    frame = spark.createDataFrame([(1, "<body>abc</body>", "T", "http://x"), (2, None, None, None)], "id long, html string, title string, url string")
    got = [r.text for r in pages.article_text(frame, "html", "title", "url").orderBy("id").collect()]
    assert got == ["# T\n\n*Source: http://x*  \n*Length: 3 chars*\n\n---\n\nabc", "# \n\n*Source: *  \n*Length: 0 chars*\n\n---\n\n"]


class Plain(HTMLParser):
    """Counts by name, as main_blocks states them."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.events = []

    def handle_starttag(self, tag, attrs):
        self.events.append((tag, 0 if tag in VOID else 1, dict(attrs)))

    def handle_startendtag(self, tag, attrs):
        self.events.append((tag, 0, dict(attrs)))

    def handle_endtag(self, tag):
        self.events.append((tag, -1, {}))

    def handle_data(self, data):
        self.events.append(data)


def plain(html):
    p = Plain()
    p.feed(html)
    p.close()
    words = lambda a: (a.get("class") or "").split()
    tags = [e for e in p.events if not isinstance(e, str) and e[1] == 1]
    main = next((t for t in tags if t[0] == "div" and "mw-parser-output" in words(t[2])), None) or next((t for t in tags if t[2].get("id") == "mw-content-text"), None) or next((t for t in tags if t[0] == "body"), None)
    out, depth, skip, within, begun = [], 0, 0, "", main is None
    for e in p.events:
        if isinstance(e, str):
            if begun and not skip and (depth or main is None):
                out.append(e)
            continue
        name, step, attrs = e
        if e is main:
            begun, depth = True, 1
            out.append("\n")
            continue
        if not begun or (main is not None and not depth):
            continue
        c = words(attrs)
        if main is not None and name == main[0]:
            depth += step
        if skip:
            skip += step if name == within else 0
        elif step == 1 and ((name in ("span", "div") and any(w in x for x in c for w in ("mw-editsection", "noprint", "toc"))) or (name == "table" and "metadata" in c) or attrs.get("id") == "toc" or {"printfooter", "mw-jump-link", "navbox"} & set(c) or name == "nav"):
            skip, within = 1, name
            continue
        if not skip and name in pages.BLOCK and (depth or main is None):
            out.append("\n")
    return "".join("".join(out).split())


def test_equals_a_plain_loop_on_random_nestings(spark):
    rng = random.Random(4)
    parts = ["w{} ", "<p>", "</p>", "<div>", "</div>", "</div>", '<div class="a toc">', '<span class="mw-editsection-x">', "<span>", "</span>", "</span>", "<nav>", "</nav>", '<table class="metadata">', "<table>", "</table>", "</table>", "<br>", '<img class="navbox">', '<p id="toc">', '<ul class="navbox">', "</ul>", '<div class="mw-parser-output x">', '<b id="mw-content-text">', "</b>", "<body>"]
    htmls = ["".join(rng.choice(parts).format(k) for k in range(rng.randint(1, 60))) for _ in range(400)]
    got = texts(spark, htmls)
    assert ["".join(t.split()) for t in got] == [plain(h) for h in htmls]


def test_long_page(spark):
    page = "<body>" + '<div class="noprint"><div>x</div></div><p>word</p>' * 20_000 + "</body>"
    assert texts(spark, [page])[0].count("word") == 20_000
