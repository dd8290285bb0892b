"""Web pages to article text: the main content block without nested noise, by one fold over a page's tags."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements without an end, and elements that stand on lines of their own.
VOID = "area base br col embed hr img input link meta source track wbr".split()
BLOCK = "p div h1 h2 h3 h4 h5 h6 li ul ol tr table article section header footer br blockquote nav main aside".split()
_TAG = r"""</?[a-zA-Z][a-zA-Z0-9]*(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""


class Selector(NamedTuple):
    """Elements by name (any, if empty) and by a class or id: one of `words` within the class or, with whole, as the whole class or id. No attribute: the name alone."""

    names: tuple[str, ...] = ()
    attribute: str = ""
    words: tuple[str, ...] = ()
    whole: bool = True


#: What is main content, the first that a page has, and what is noise within it.
MAIN = (Selector(("div",), "class", ("mw-parser-output",)), Selector((), "id", ("mw-content-text",)), Selector(("body",)))
NOISE = (
    Selector(("span", "div"), "class", ("mw-editsection", "noprint", "toc"), whole=False),
    Selector(("table",), "class", ("metadata",)),
    Selector((), "id", ("toc",)),
    Selector((), "class", ("printfooter", "mw-jump-link", "navbox")),
    Selector(("nav",)),
)


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute in a tag, between spaces, white space within as single spaces."""
    pattern = rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])
    return F.concat(F.lit(" "), F.regexp_replace(value, r"\s+", " "), F.lit(" "))


def _is(tag: Column, selector: Selector) -> Column:
    """Whether a tag (struct of name, class and id) opens such an element."""
    named = tag["name"].isin(*selector.names) if selector.names else F.lit(True)
    if not selector.attribute:
        return named
    words = [F.contains(tag[selector.attribute], F.lit(f" {w} " if selector.whole else w)) for w in selector.words]
    return named & reduce(Column.__or__, words)


def _stretch(since: Column, last: Column) -> Column:
    """Pieces since to last as text: the fold's list of them is a string, as appending to one is far cheaper than to an array."""
    return F.concat(since.cast("string"), F.lit(":"), last.cast("string"), F.lit(" "))


def main_blocks(body: Column, main: tuple[Selector, ...] = MAIN, noise: tuple[Selector, ...] = NOISE) -> Column:
    """The html of the first element that main names (of its first selector that occurs; all, if none does) without the elements that noise names; tags are gone, block tags as line ends.

    Start and end tags of a name are counted, so an element ends at its own end tag however deeply others of its name are nested in it; one that is never closed
    goes on to the end. The fold carries a few numbers and the kept stretches, whose number is that of the noise elements, so a long page costs in proportion to its length.
    """
    tags = F.regexp_extract_all(body, F.lit(_TAG), F.lit(0))
    pieces = F.split(body, _TAG, -1)

    def told(tag: Column) -> Column:
        name, attributes = F.lower(F.regexp_extract(tag, "[a-zA-Z0-9]+", 0)), F.contains(tag, F.lit("="))
        close, alone = F.startswith(tag, F.lit("</")), F.endswith(tag, F.lit("/>")) | name.isin(*VOID)
        step = F.when(close, -1).when(alone, 0).otherwise(1)
        return F.struct(name.alias("name"), step.alias("step"), *[F.when(attributes & (step == 1), _attribute(tag, a)).otherwise("  ").alias(a) for a in ("class", "id")])

    def marked(tag: Column, at: Column) -> Column:
        rank = reduce(lambda w, s: w.when(_is(tag, s[1]), s[0]), enumerate(main), F.when(tag["step"] != 1, len(main))).otherwise(len(main))
        junk = (tag["step"] == 1) & reduce(Column.__or__, [_is(tag, s) for s in noise])
        return F.struct(tag["name"].alias("name"), tag["step"].alias("step"), junk.alias("noise"), rank.alias("rank"), at.cast("int").alias("at"))

    def folded(marks: Column, start: Column) -> Column:
        """start: the tag that opens the main block, struct(at, name, rank)."""
        whole = start["rank"] >= len(main)
        zero = F.struct(F.when(whole, 1).otherwise(0).alias("depth"), F.lit(0).alias("skip"), F.lit("").alias("within"), F.when(whole, 0).otherwise(-1).alias("since"), F.lit("").alias("kept"))

        def step(acc: Column, tag: Column) -> Column:
            opens = ~whole & (tag["at"] == start["at"])
            inside = ~opens & (acc["depth"] > 0)
            depth = F.when(opens, 1).when(inside & ~whole & (tag["name"] == start["name"]), acc["depth"] + tag["step"]).otherwise(acc["depth"])
            junk = inside & (acc["skip"] == 0) & tag["noise"]
            skip = F.when(junk, 1).when(inside & (acc["skip"] > 0) & (tag["name"] == acc["within"]), acc["skip"] + tag["step"]).otherwise(acc["skip"])
            ends = inside & (depth == 0)
            resumes = opens | (inside & (acc["skip"] > 0) & (skip == 0))
            since = F.when(ends | junk, -1).when(resumes, tag["at"] + 1).otherwise(acc["since"])
            closed = (junk | ends) & (acc["since"] >= 0)
            kept = F.when(closed, F.concat(acc["kept"], _stretch(acc["since"], tag["at"]))).otherwise(acc["kept"])
            return F.struct(depth.alias("depth"), skip.alias("skip"), F.when(junk, tag["name"]).otherwise(acc["within"]).alias("within"), since.alias("since"), kept.alias("kept"))

        kept = F.aggregate(marks, zero, step, lambda acc: F.when(acc["since"] >= 0, F.concat(acc["kept"], _stretch(acc["since"], F.size(marks)))).otherwise(acc["kept"]))
        return F.transform(F.split(F.rtrim(kept), " "), lambda x: F.split(x, ":").cast("array<int>"))

    def text(row: Column) -> Column:
        marks, parts = row["marks"], row["parts"]
        none = F.struct(F.lit(len(main)).alias("rank"), F.lit(-1).alias("at"), F.lit("").alias("name"))
        start = F.coalesce(F.array_min(F.transform(F.filter(marks, lambda t: t["rank"] < len(main)), lambda t: F.struct(t["rank"].alias("rank"), t["at"].alias("at"), t["name"].alias("name")))), none)
        # a piece stands behind the tag that it follows
        led = F.transform(parts, lambda p, k: F.when((k > 0) & F.get(marks, k - 1)["name"].isin(*BLOCK), F.concat(F.lit("\n"), p)).otherwise(p))
        both = F.array(F.struct(start.alias("start"), led.alias("led")))
        kept = lambda x: F.transform(F.filter(folded(marks, x["start"]), lambda s: F.size(s) == 2), lambda s: F.array_join(F.slice(x["led"], s[0] + 1, s[1] - s[0] + 1), ""))
        return F.transform(both, lambda x: F.array_join(kept(x), ""))[0]

    # bound as variables of lambdas, tags and pieces are found once a page
    rows = F.array(F.struct(F.transform(tags, told).alias("tags"), pieces.alias("parts")))
    rows = F.transform(rows, lambda r: F.struct(F.transform(r["tags"], marked).alias("marks"), r["parts"].alias("parts")))
    return F.transform(rows, text)[0]


def tidy(text: Column) -> Column:
    """The commonest character references decoded, spaces around line ends gone, two line ends at most, none at the ends."""
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t]*\n[ \t]*", "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def article_text(pages: DataFrame, html: str, title: str, source: str | None = None, main: tuple[Selector, ...] = MAIN, noise: tuple[Selector, ...] = NOISE) -> DataFrame:
    """pages with text: the main content block without noise, tags and blank lines, under the title, the source and the length.

    Scripts, styles, the head and comments go first. A null or empty page has an empty article; a null title is empty. No shuffle, no Python.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    for tag in ("script", "style", "head"):
        body = F.regexp_replace(body, rf"(?is)<{tag}\b.*?</{tag}\s*>", "")
    body = F.regexp_replace(body, r"(?s)<!--.*?-->", "")
    article = tidy(main_blocks(body, main, noise))
    where = F.concat(F.lit("*Source: "), F.coalesce(F.col(source), F.lit("")), F.lit("*  \n")) if source else F.lit("")
    # bound once, or the article is made again for its length
    headed = F.transform(F.array(article), lambda a: F.concat(F.lit("# "), F.coalesce(F.col(title), F.lit("")), F.lit("\n\n"), where, F.lit("*Length: "), F.length(a).cast("string"), F.lit(" chars*\n\n---\n\n"), a))[0]
    return pages.withColumn("text", headed)
