"""Main text by wrappers: a union-free expression per host, with optional and repeated groups and text slots."""

from __future__ import annotations

import functools
import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import by_bytes, materialize

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([A-Za-z][A-Za-z0-9-]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*)>|<[!?/][^>]*>?|[^<]+|<", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW = frozenset("script style textarea title noscript template iframe svg select button".split())
_VOID = frozenset("area base col embed hr img input link meta source track wbr br".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br wbr img".split())
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split())
#: Elements and words of class, id and role that hold no article text.
_NO_TEXT = frozenset("nav header footer aside form script style head menu dialog".split())
_NO_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner sidebar comment comments disqus cookie cookies consent notice menu nav navbar navigation breadcrumb breadcrumbs"
    " footer header masthead share sharing social newsletter subscribe popup modal complementary contentinfo search".split()
)
#: A fixed pattern: names of lists of other pages; other words that begin so, such as related-work, are no such lists.
_RELATED = re.compile(r"^related(?:[-_]?(?:posts?|articles?|links?|stories|story|content|items?|news|pages?))?$")
_MARKS = {"article": 1, "main": 2}
#: Elements that are blocks of a text or hold its parts in rows: never the container of an article.
_BLOCKS = frozenset("# p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table caption thead tbody tfoot tr td th figure figcaption address legend label option hr".split())
#: A container with one of these as its own child is a text itself.
_PROSE = frozenset("# p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Texts that so many distinct pages of a host share in one place belong to its template.
TEMPLATE_PAGES = 5
#: A place is the article's container from this share of its parent's prose on, in the pages that have it.
CONTAINER_SHARE = 0.6
#: A repeated place is a list of links from this share of linked characters on.
LINK_SHARE = 0.8
_TEMPLATE, _LINKS = 1, 2


class Node:
    """An element, or a text where label is '#'."""

    __slots__ = ("label", "children", "text", "drop", "before", "linked")

    def __init__(self, label: str, text: str | None = None, drop: bool = False, before: list[str] | None = None, linked: int = 0):
        self.label, self.text, self.drop, self.before, self.linked = label, text, drop, before, linked
        self.children: list[Node] = []


def parse(page: str) -> Node:
    """The block structure of a page: inline elements melt into the texts around them, broken nesting is closed.

    An inline element whose names tell an advert, say, goes with all it holds, and the text around it stays one block: it
    keeps the text before it in before, which goes on when the element ends or is cut off by the end of its block. A text
    counts its characters within links in linked; a link ends with its block at the latest.
    """
    root = Node("root")
    stack, parts = [root], []
    in_link, linked = False, 0

    def flush() -> None:
        nonlocal in_link, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                stack[-1].children.append(Node("#", text, linked=min(linked, len(text))))
        in_link, linked = False, 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            if stack[-1].before is None:
                flush()
            else:
                parts[:] = stack[-1].before
            stack.pop()

    def name_of(k: int) -> str:
        return _element(stack[k].label)

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            if not m[0].startswith("<") or m[0] == "<":
                parts.append(m[0])
                linked += len(m[0]) if in_link else 0
            continue
        name = name.lower()
        closing = m[1] == "/"
        if name in _RAW and not closing:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in _INLINE:
            if name == "a":
                in_link = not closing
            if name in ("br", "img"):
                parts.append(" ")
            if closing:
                # an inline element ends within its block only
                k = len(stack) - 1
                while k and stack[k].before is not None and name_of(k) != name:
                    k -= 1
                if k and stack[k].before is not None:
                    close(k)
            elif name not in _VOID and not m[3].endswith("/") and _unwanted(m[3]):
                stack.append(Node(name, drop=True, before=list(parts)))
                parts.clear()
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if name_of(k) == name:
                    close(k)
                    break
            else:
                flush()
            continue
        # an advert that its paragraph's end cuts off must not take the next paragraph along
        top = len(stack) - 1
        while top and stack[top].before is not None:
            top -= 1
        closes = _CLOSES.get(name, ("p",) if name in _ENDS_P else ())
        if closes and top and name_of(top) in closes:
            close(top)
            while len(stack) > 1 and name_of(len(stack) - 1) in closes:
                close(len(stack) - 1)
        flush()
        if name in _VOID:
            continue
        drop = name in _NO_TEXT or _unwanted(m[3])
        # what its names reject has a place of its own, so that a place is rejected as a whole or not at all
        node = Node(".".join([name, *sorted(_words(m[3]))]) + ("!" if drop else ""), drop=drop)
        stack[-1].children.append(node)
        if not m[3].endswith("/"):
            stack.append(node)
    close(1)
    flush()
    return root


def _element(label: str) -> str:
    return label.partition(".")[0].rstrip("!")


def _unwanted(attributes: str) -> bool:
    """Whether class, id or role name what is no article text."""
    if not attributes or "=" not in attributes:
        return False
    return bool(_NO_WORDS & _words(attributes)) or any(_RELATED.match(t) for groups in _NAMES.findall(attributes) for value in groups for t in value.lower().split())


def _words(attributes: str) -> set[str]:
    if not attributes or "=" not in attributes:
        return set()
    return {w for groups in _NAMES.findall(attributes) for value in groups for w in re.split(r"[^a-z]+", value.lower()) if w}


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


@functools.lru_cache(1 << 16)
def _place(parent: int, label: str, run: int) -> int:
    return _hash(f"{parent} {label} {run}")


def _spots(children: list[Node]) -> list[tuple[int, bool]]:
    """Each sibling's number among the groups of its label, and whether its group repeats.

    Equal neighbours are one repeated group. So is a sequence of labels that follows itself at once, h2 p h2 p, say, with what of it
    comes once more at the end: its rounds share their numbers. The pages of a host meet in these numbers.
    """
    runs: list[list] = []
    for c in children:
        if runs and runs[-1][0] == c.label:
            runs[-1][1] += 1
        else:
            runs.append([c.label, 1])
    following, seen_at = [0] * len(runs), {}
    for i in range(len(runs) - 1, -1, -1):
        following[i] = seen_at.get(runs[i][0], 0)
        seen_at[runs[i][0]] = i
    out: list[tuple[int, bool]] = []
    numbers: dict[str, int] = {}
    i = 0
    while i < len(runs):
        period = following[i] - i
        end = i + 1
        if period > 0:
            end = i + period
            while end < len(runs) and runs[end][0] == runs[end - period][0]:
                end += 1
        square = period > 0 and end >= i + 2 * period
        if not square:
            end, period = i + 1, 1
        first = []
        for label, _ in runs[i : i + period]:
            first.append(numbers.get(label, 0))
            numbers[label] = first[-1] + 1
        for k in range(i, end):
            out += [(first[(k - i) % period], square or runs[k][1] > 1)] * runs[k][1]
        i = end
    return out


def outline(tree: Node) -> list[tuple[Node, int, int, int, bool, bool]]:
    """(node, place, position of its parent, mark, rejected, repeated) of every node in page order, the root first.

    The place is the path of labels and of their numbers among their siblings. mark has bit 1 within an article and bit 2 within a main; rejected
    is what _NO_TEXT and _NO_WORDS name, with all it holds.
    """
    out: list[tuple[Node, int, int, int, bool, bool]] = []
    # an explicit stack, as pages nest to any depth
    todo: list[tuple] = [(tree, 0, -1, 0, False, False)]
    while todo:
        node, place, _, mark, off, _ = row = todo.pop()
        at = len(out)
        out.append(row)
        below = [
            (c, _place(place, c.label, number), at, mark | _MARKS.get(_element(c.label), 0), off or c.drop, repeats)
            for c, (number, repeats) in zip(node.children, _spots(node.children), strict=True)
        ]
        todo.extend(reversed(below))
    return out


def _prose(rows: list[tuple[Node, int, int, int, bool, bool]]) -> list[list[int]]:
    """Characters outside and within links below every node, without what is rejected in it."""
    sums = [[0, 0] for _ in rows]
    for k in range(len(rows) - 1, -1, -1):
        node, _, up, _, _, _ = rows[k]
        if node.label == "#":
            sums[k] = [len(node.text) - node.linked, node.linked]
        if up >= 0 and not node.drop:
            sums[up][0] += sums[k][0]
            sums[up][1] += sums[k][1]
    return sums


def _host(url: str) -> str:
    return f"lower(regexp_extract(coalesce({url}, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


#: What a page says of a place: the least and largest hash of its texts, whether it repeats, its prose and linked characters, its parent's
#: prose, and whether it may hold an article.
_FACTS = ("place", "low", "high", "n", "prose", "linked", "around", "fit")


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, signs, places = [], [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = outline(parse(page.as_py()))
            sums = _prose(rows)
            texts = [any(_element(c.label) in _PROSE for c in node.children) for node, *_ in rows]
            sign, own = hashlib.blake2b(digest_size=16), {}
            for (node, place, up, _, off, repeats), (prose, linked) in zip(rows[1:], sums[1:], strict=True):
                text = node.label == "#"
                h = _hash(node.text) if text else 0
                if text:
                    sign.update(b"%d %d " % (place, h))
                fit = int(not off and _element(node.label) not in _BLOCKS and not texts[up])
                old = own.get(place)
                if old is None:
                    own[place] = [h if text else None, h if text else None, 1 + repeats, prose, linked, sums[up][0], fit]
                else:
                    old[0], old[1] = (min(old[0], h), max(old[1], h)) if text else (None, None)
                    old[2:] = [2, old[3] + prose, old[4] + linked, old[5] + sums[up][0], min(old[6], fit)]
            hosts.append(host)
            signs.append(sign.digest())
            places.append([dict(zip(_FACTS, (p, *v), strict=True)) for p, v in own.items()])
        kind = pa.list_(pa.struct([(name, pa.int64()) for name in _FACTS]))
        yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(signs, pa.binary()), pa.array(places, kind)], names=["host", "sign", "places"])


def expression(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, place, is_text, pages, optional, repeated, slot, share, linked, fit): a row per node of the host's union-free expression.

    The pages of a host are aligned by their places: a place that not all pages have is optional, one that a page has several times in a
    group is repeated, a text whose hashes differ is a slot. share is the part of their parents' prose that the place holds in the pages that
    have it, linked the part of its characters within links, fit that it may hold an article in all of them. Pages with the same
    texts in the same places count once. All are sums, minima and maxima, which Spark combines before the shuffle, so neither the order
    of pages nor their partitions matter.
    """
    rows = pages.where(F.col(html_col).isNotNull()).select(F.expr(_host(f"`{url_col}`")).alias("host"), F.col(html_col).alias("page"))
    facts = ", ".join(f"{name}: bigint" for name in _FACTS)
    own = by_bytes(rows).mapInArrow(_infer, f"host string, sign binary, places array<struct<{facts}>>")
    # null stands for the page itself, so the host's pages are counted in the same pass
    page = F.array(F.struct(*[F.lit(None).cast("long").alias(name) for name in _FACTS]))
    distinct = own.groupBy("host", "sign").agg(F.first("places").alias("places")).select("host", F.explode(F.concat(page, "places")).alias("p"))
    table = distinct.groupBy("host", "p.place").agg(
        F.count("*").alias("pages"), F.min("p.low").alias("low"), F.max("p.high").alias("high"), F.max("p.n").alias("n"),
        F.sum("p.prose").alias("prose"), F.sum("p.linked").alias("links"), F.sum("p.around").alias("around"), F.min("p.fit").alias("fit"),
    )
    total = table.where("place is null").select(F.col("host").alias("h"), F.col("pages").alias("of"))
    held = table.where("place is not null").join(total, F.col("host") == F.col("h"))
    return held.select(
        "host", "place", F.col("low").isNotNull().alias("is_text"), "pages", (F.col("pages") < F.col("of")).alias("optional"), (F.col("n") > 1).alias("repeated"),
        F.coalesce(F.col("low") != F.col("high"), F.lit(False)).alias("slot"),
        F.coalesce(F.try_divide("prose", "around"), F.lit(0.0)).alias("share"),
        F.coalesce(F.try_divide(F.col("links"), F.col("prose") + F.col("links")), F.lit(0.0)).alias("linked"), (F.col("fit") == 1).alias("fit"),
    )


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, place, pages, optional, repeated, slot): the texts of the host's expression, those that names reject among them."""
    return expression(pages, url_col, html_col).where("is_text").select("host", "place", "pages", "optional", "repeated", "slot")


def flags(table: DataFrame) -> DataFrame:
    """(host, place, flag) of the places that decide: _TEMPLATE, _LINKS, and from 4 on, in fours, the per cent of a container's share."""
    template = F.col("is_text") & ~F.col("slot") & (F.col("pages") >= TEMPLATE_PAGES)
    links = F.col("is_text") & F.col("repeated") & (F.col("linked") >= LINK_SHARE)
    holds = ~F.col("is_text") & F.col("fit") & ~F.col("repeated") & (F.col("share") >= CONTAINER_SHARE)
    flag = F.when(template, _TEMPLATE).otherwise(0) + F.when(links, _LINKS).otherwise(0) + F.when(holds, 4 * F.ceil(F.col("share") * 100)).otherwise(0)
    return table.select("host", "place", flag.cast("int").alias("flag")).where("flag > 0")


def main_text(tree: Node, wrapper: dict[int, int]) -> str:
    """The texts that the wrapper leaves, in order. Without a wrapper all texts stay.

    From the root down, the wrapper's container with the greatest share is entered as long as it has a text, an article being the last; what
    lies beside it is left out. Within it go the texts of the template, rejected names, and lists of links where nothing had to be left out on the way and
    no article or main tells them from menus. Where some of the rest is in an article, or else in a main, only that stays.
    """
    if not wrapper:
        return "\n".join(node.text for node, *_ in outline(tree) if node.label == "#")
    rows = outline(tree)
    sums = _prose(rows)
    below: list[list[int]] = [[] for _ in rows]
    for k, row in enumerate(rows[1:], 1):
        below[row[2]].append(k)
    at, chose = 0, False
    while True:
        held = [k for k in below[at] if wrapper.get(rows[k][1], 0) >= 4 and not rows[k][4] and sum(sums[k])]
        if not held:
            break
        best = max(held, key=lambda k: wrapper[rows[k][1]])
        chose = chose or any(k != best and (rows[k][0].label == "#" or rows[k][0].children) for k in below[at])
        at = best
        if _element(rows[at][0].label) == "article":
            break
    inside, kept = {at}, []
    for k in range(at, len(rows)):
        node, place, up, mark, off, _ = rows[k]
        if k != at and up not in inside:
            continue
        inside.add(k)
        flag = wrapper.get(place, 0)
        if node.label == "#" and not off and not flag & _TEMPLATE and not (flag & _LINKS and not chose and not mark):
            kept.append((node.text, mark))
    for bit in (1, 2):
        marked = [text for text, mark in kept if mark & bit]
        if marked:
            return "\n".join(marked)
    return "\n".join(text for text, _ in kept)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col and text of every row.

    Every page takes its host's wrapper, a host of one page that of this page: the place that holds most of its parent's prose is the
    container of the article, a place where TEMPLATE_PAGES distinct pages or more, and no page of the host another, have one text is template, a repeated
    group of links is a menu. Names and classes are features: what they reject within the container goes, and an article or main is
    preferred. Null and empty pages have empty text, a null url is the host ''. Repeated rows are extracted each; other columns, of any
    name, are ignored.
    """
    decided = flags(expression(pages, url_col, html_col))
    table = materialize(decided.groupBy("host").agg(F.collect_list(F.struct("place", "flag")).alias("wrapper")), "wrappers").toDF("h", "wrapper")
    rows = pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"), F.coalesce(F.col(html_col), F.lit("")).alias("p"), F.expr(_host(f"`{url_col}`")).alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a host without a flagged place has a wrapper all the same, of no container and no template
            known = ({e["place"]: e["flag"] for e in w.as_py() or ()} or {0: 0} for w in batch.column(3))
            texts = [main_text(parse(page.as_py()), w) for page, w in zip(batch.column(2), known, strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["i", "u", "text"])

    wrapped = rows.join(table, F.col("host") == F.col("h"), "left").select("i", "u", "p", "wrapper")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return by_bytes(wrapped).mapInArrow(run, f"i {kinds['i']}, u {kinds['u']}, text string").toDF(id_col, url_col, "text")
