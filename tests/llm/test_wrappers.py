import hashlib
import re

from corvane.llm import html_wrapper


def texts(spark, rows):
    return {r.page_id: r.text for r in html_wrapper.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_wrapper_keeps_article_text(spark):
    same = "s" * 250
    rows = [(k, f"http://long/{k}", f"<body><div>Home</div><p>{same} {k}</p></body>") for k in range(6)]
    rows += [(k, f"http://copies/{k}", "<body><h1>Title</h1><p>only text</p></body>") for k in range(10, 20)]
    # copies of one page with a place of its own, among other pages of the host
    rows += [(k, f"http://mixed/{k}", "<body><p>copied</p><h2>single</h2></body>") for k in range(20, 26)]
    rows += [(k, f"http://mixed/{k}", f"<body><p>page {k}</p></body>") for k in range(26, 32)]
    got = texts(spark, rows)
    assert all(got[k] == f"{same} {k}" for k in range(6))
    assert all(got[k] == "Title\nonly text" for k in range(10, 20))
    assert all(got[k] == "copied\nsingle" for k in range(20, 26)) and got[26] == "page 26"


def test_wrapper_has_no_widest_node(spark):
    # every page has 300 blocks of its own before the template's last block
    own = lambda k: "".join(f"<section class='s{chr(97 + k)}{chr(97 + j // 26)}{chr(97 + j % 26)}'><p>{k} {j}</p></section>" for j in range(300))
    rows = [(k, f"http://wide/{k}", f"<body>{own(k)}<table><tr><td>Imprint</table></body>") for k in range(6)]
    got = texts(spark, rows)
    assert all(got[k].split("\n") == [f"{k} {j}" for j in range(300)] for k in range(6))
    table = html_wrapper.wrappers(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert table.count() == 1801 and table.where("not optional and not slot").count() == 1


def test_wrapper_decides_every_page(spark):
    # an article in use, dropped by its class, in a comment only, and in a script only
    parts = [
        "<article><div>Read later</div><p>text {}</p></article>",
        "<p>text {}</p><article class='comment'>hi</article>",
        "<p>text {}</p><!-- <article > -->",
        "<p>text {}</p><script>'<main >'</script>",
    ]
    rows = [(10 * j + k, f"http://host{j}/{k}", f"<body><div>Home</div>{part.format(k)}</body>") for j, part in enumerate(parts) for k in range(6)]
    got = texts(spark, rows)
    assert all(got[10 * j + k] == f"text {k}" for j in range(4) for k in range(6))


def _hidden(page):
    """The page with its tag names nav, article and footer and its class names made meaningless."""
    code = lambda w: "x" + hashlib.md5(w.encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop"))[:8]
    page = re.sub(r"<(/?)(nav|article|footer)\b", lambda m: f"<{m[1]}{code(m[2])}", page)
    return re.sub(r'class="([^"]*)"', lambda m: f'class="{code(m[1])}"', page)


def test_wrapper_decides_without_names(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    rows = [tuple(r) for r in pages.collect()]
    named = texts(spark, rows)
    hidden = [(i, u, _hidden(h or "")) for i, u, h in rows]
    got = texts(spark, hidden)
    assert sum(got[i] == named[i] for i in named) >= 0.95 * len(named)
    bare = {i: html_wrapper.main_text(html_wrapper.parse(h or ""), {}) for i, _, h in rows}
    assert sum(bare[i] != named[i] for i in named) >= 0.95 * len(named)
    # the expression does not depend on the order or the partitions of the pages
    frame = spark.createDataFrame(hidden, "page_id long, url string, html string")
    first, second = ({tuple(r) for r in html_wrapper.expression(f).collect()} for f in (frame.coalesce(1), frame.orderBy("html").repartition(7)))
    assert first == second


def test_groups_and_their_rounds():
    spots = lambda labels: html_wrapper._spots([html_wrapper.Node(x) for x in labels.split()])
    assert spots("p p p") == [(0, True)] * 3
    assert spots("h2 p p h2 p h2") == [(0, True)] * 6
    # no round follows at once: the second div is a place of its own
    assert spots("div p div") == [(0, False), (0, False), (1, False)]
    assert spots("hr h2 p h2 p hr") == [(0, False), *[(0, True)] * 4, (1, False)]
    assert spots("") == []


def test_menu_without_container_and_odd_rows(spark):
    menu = "<ul>" + "".join(f"<li><a href='/{j}'>entry {j} {{0}}</a></li>" for j in range(4)) + "</ul>"
    rows = [(k, f"http://flat/{k}", f"<body>{menu.format(k)}<p>prose of page {k}</p><p>and <a href='/'>more</a> of it</p></body>") for k in range(3)]
    # a list of links within the article is text
    rows += [(k, f"http://art/{k}", f"<body><article><p>prose of page {k}</p>{menu.format(k)}</article></body>") for k in range(3, 6)]
    rows += [(6, None, "<p>no host"), (7, "http://flat/7", None), (8, "http://flat/8", ""), (9, None, None), (3, *rows[3][1:]), (None, "http://one/", "<div>" * 3000 + "deep")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, wrapper string, h long")
    got = [tuple(r) for r in html_wrapper.extract_main_text(frame).select("page_id", "text").collect()]
    assert len(got) == len(rows) and got.count((3, "prose of page 3\n" + "\n".join(f"entry {j} 3" for j in range(4)))) == 2
    assert all((k, f"prose of page {k}\nand more of it") in got for k in range(3))
    assert {(6, "no host"), (7, ""), (8, ""), (9, ""), (None, "deep")} <= set(got)
    assert html_wrapper.extract_main_text(frame.limit(0)).count() == 0
