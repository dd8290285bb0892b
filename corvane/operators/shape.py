"""From page texts to records, options, columns and keys. Each operator works within a row: lines are an array of the document's row,
so nothing is shuffled and a record never leaves its document."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

#: What opens a record, an inline record and an answer line, and what marks noise, keys, options, columns and points.
RECORD = r"(?i)^(?:question\s+)?(\d{1,3})[.):](?:\s|$)"
INLINE = r"(?:(?<=\s)|(?<=\?)|(?<=\.))(\d{1,3})[.)]\s+(?=[A-Z(])"
ANSWER = r"^(\d{1,3})[.)]\s*(.+)$"
KEY_WORDS = ("answer key", "answer sheet", "solutions", "key:", "answers:", "point value")
OPTION_LINE = r"^[A-Ea-e][.)]$"
OPTION = r"\(([A-Ea-e])\)|(?:^|\s)([a-e])[.)]\s+|(?:^|(?<!\d)\s)([A-E])[.)]\s+"
MATCHING = r"(?i)\bmatch\b[^.?]{0,60}\b(?:following|each|column|item|term|choice|description)\b|\bcolumn\s+[ab]\b"
DIGIT_MARK, ALPHA_MARK = r"(?:^|\s)(\d{1,2})[.)]\s", r"(?:^|\s)([A-Za-z])[.)]\s"
ROW_MARK = r"^\(?([A-Za-z]|\d{1,2})[.)]\s*(.*)$"
POINTS = r"(?i)[(\[]\s*[\d¼½¾⅛-⅞./]+\s*(?:point|pt|pts|points)s?\.?(?:\s+each)?\s*[)\]]"
POINT_PREFIX = r"(?i)^\(\d+(\.\d+)?\s*pts?\b"
HEADING = r"(?i)^(?:chapter|unit|section)\s+([0-9]{1,3}|[ivxlcdm]{1,7}|[a-z]+)\b[:.\-—]?\s*(.*)$"
PAGE_MARK = r"^##\s*Page\s+(\d+)\s*$"
ASKS = (
    r"(?i)[?:]|_{3,}|\b(?:which|what|who|how|when|where|why|describe|identify|calculate|find|name|list|draw|circle|select|choose|explain|determine|compute|state|define|evaluate|"
    r"estimate|approximate|derive|prove|show|verify|sketch|graph|plot|label|match|order|rank|convert|express|simplify|solve|deduce|infer|conclude|given|suppose|assume|consider|let|"
    r"imagine|recall|note that|the (?:value|ratio|magnitude|sign|direction|sum|product|difference|integral|derivative|limit|maximum|minimum|average|mean|median|probability|fraction|"
    r"percentage|coefficient) of|true or false|true/false|t/f|which of the (?:following|above)|all of the following)\b"
)


@F.pandas_udf(StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    """NFKC; Spark has no function for it."""
    return texts.str.normalize("NFKC")


def normalize_text(text: Column) -> Column:
    """Compatibility characters folded, zero-width ones and point markers such as (2 pts) removed, white space collapsed; null is empty.

    A row of ASCII alone has nothing to fold and gives the Python function a null instead of its text.
    """
    plain = F.coalesce(text, F.lit(""))
    return _bare(F.coalesce(_compatible(F.when(plain.rlike(r"[^\x00-\x7f]"), plain)), plain))


@F.pandas_udf(ArrayType(StringType()))
def _all_compatible(texts: pd.Series) -> pd.Series:
    """_compatible for arrays."""
    return texts.map(lambda row: [None if x is None else unicodedata.normalize("NFKC", x) for x in row], na_action="ignore")


def normalize_texts(texts: Column) -> Column:
    """normalize_text of each element; a null array is empty."""
    plain = F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")))
    folded = F.coalesce(_all_compatible(F.when(F.exists(plain, lambda x: x.rlike(r"[^\x00-\x7f]")), plain)), plain)
    return F.transform(folded, _bare)


def _bare(folded: Column) -> Column:
    visible = F.regexp_replace(F.regexp_replace(folded, "[​‌‍﻿]", ""), POINTS, " ")
    return F.trim(F.regexp_replace(visible, r"(?U)\s+", " "))


def _lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))


def _slices(rows: Column, at: Column) -> Column:
    """array<array<string>>: rows cut before each of the ascending places at, which count from 1; the first slice is empty where the first place is 1."""
    return F.zip_with(F.concat(F.array(F.lit(1)), at), F.concat(at, F.array(F.size(rows) + 1)), lambda a, b: F.slice(rows, a, b - a))


def _cut(rows: Column, opens: Callable[[Column], Column] | Column) -> Column:
    """array<array<string>>: the rows before the first that opens a slice, then each of those with the rows after it. Cuts are places, not marks within the
    text, so rows may hold any character."""
    flags = F.transform(rows, opens) if callable(opens) else opens
    at = F.array_compact(F.transform(flags, lambda o, k: F.when(o, k + 1)))
    # bound as a lambda's variable, the places are found once
    return F.transform(F.array(F.struct(rows.alias("rows"), at.alias("at"))), lambda x: _slices(x["rows"], x["at"]))[0]


def _has_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def is_cover(text: Column, markers: tuple[str, ...]) -> Column:
    """A marker occurs, fewer than three numbered lines have over 20 characters, and fewer than 25 lines are filled or three have a run of five underscores."""
    lines = _lines(text)
    real = F.filter(lines, lambda x: x.rlike(RECORD) & (F.length(F.trim(F.regexp_replace(x, RECORD, ""))) > 20))
    filled, blanks = F.filter(lines, lambda x: x != ""), F.filter(lines, lambda x: x.rlike("_{5,}"))
    return _has_any(F.lower(F.coalesce(text, F.lit(""))), markers) & (F.size(real) < 3) & ((F.size(filled) < 25) | (F.size(blanks) >= 3))


def is_key(text: Column) -> Column:
    """A key word occurs, or at least five numbered lines have fewer than 60 characters after the number."""
    short = F.filter(_lines(text), lambda x: x.rlike(ANSWER) & (F.length(F.trim(F.regexp_extract(x, ANSWER, 2))) < 60))
    return _has_any(F.lower(F.coalesce(text, F.lit(""))), KEY_WORDS) | (F.size(short) >= 5)


def is_noise(line: Column, prefixes: tuple[str, ...]) -> Column:
    """Under three characters or opened by a boilerplate prefix, and no bare option marker."""
    low, opened = F.lower(line), F.lit(False)
    for prefix in prefixes:
        opened = opened | low.startswith(prefix)
    return ~line.rlike(OPTION_LINE) & ((F.length(line) < 3) | opened)


def split_inline(line: Column) -> Column:
    """The line, cut at its inline record anchors where it has two or more; else as it is, in an array of one."""
    cut = F.regexp_replace(line, r"(?=" + INLINE + r")", "\n")
    return F.when(F.regexp_count(line, F.lit(INLINE)) >= 2, F.filter(F.transform(F.split(cut, "\n"), lambda x: F.trim(x)), lambda x: x != "")).otherwise(F.array(line))


@F.pandas_udf(ArrayType(BooleanType()))
def _opens(lines: pd.Series) -> pd.Series:
    """Which lines open a record, where a record with a matching cue takes rows numbered 1, 2, ... up to 25 as its own."""
    record, cue = re.compile(RECORD), re.compile(MATCHING)

    def one(row) -> list[bool]:
        out, body, last = [], None, 0
        for line in row:
            hit = record.match(line)
            own = hit is not None and body is not None and int(hit[1]) == last + 1 <= 25 and cue.search(body) is not None
            if own:
                last += 1
            elif hit:
                body, last = "", 0
                line = line[hit.end() :].strip()
            if body is not None:
                body = f"{body} {line}".strip()
            out.append(hit is not None and not own)
        return out

    return lines.map(one, na_action="ignore")


def segment_records(docs: DataFrame, pages: str, markers: tuple[str, ...], noise: tuple[str, ...], absorb: bool = True) -> DataFrame:
    """docs, without pages, with ord, number and body: a line that opens with a number opens a record, the lines after it are its body.

    Blank and cover pages are skipped; the first line with a key word ends the document; noise lines are left out; lines with
    several inline numbers are cut there. A body of eight characters or fewer gives no record. With absorb, the numbered rows of a
    matching table stay in their record; only documents with a matching cue reach Python for that.
    """
    shown = F.filter(F.coalesce(pages, F.array().cast("array<string>")), lambda p: (F.trim(F.coalesce(p, F.lit(""))) != "") & ~is_cover(p, markers))
    lines = F.filter(F.flatten(F.transform(shown, _lines)), lambda x: x != "")
    keyed = F.array_position(F.transform(lines, lambda x: _has_any(F.lower(x), KEY_WORDS)), True)
    lines = F.when(keyed > 0, F.slice(lines, F.lit(1), F.greatest(keyed - 1, F.lit(0)).cast("int"))).otherwise(lines)
    lines = F.flatten(F.transform(F.filter(lines, lambda x: ~is_noise(x, noise)), split_inline))
    rest = [c for c in docs.columns if c != pages]
    rows = docs.select(F.struct(*rest).alias("doc"), lines.alias("lines"))
    starts = F.transform("lines", lambda x: x.rlike(RECORD))
    if absorb:
        cued = F.array_join("lines", " ").rlike(MATCHING)
        starts = F.coalesce(_opens(F.when(cued, F.col("lines"))), starts)
    parts = F.transform(F.slice(_cut(F.col("lines"), starts), 2, 1 << 30), lambda p: F.array_join(p, " "))
    records = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, RECORD, 1).alias("number"), F.trim(F.regexp_replace(p, RECORD, "")).alias("body")))
    records = F.filter(records, lambda r: F.length(r["body"]) > 8)
    out = rows.select("doc.*", F.posexplode(records).alias("ord", "r"))
    return out.select(*rest, "ord", "r.number", "r.body")


def explode_options(text: Column) -> Column:
    """struct(stem, choices array<letter, text>) of a body with inline options; no options: the text itself and an empty array.

    Markers ascend strictly within A to E. A first marker after A is taken only where the stem asks something and the missing A is
    the text after its last ? or run of underscores, and then only if B comes first. No option is empty or opens with another marker; their
    mean length is 150 at most and the stem has eight characters.
    """
    body = F.coalesce(text, F.lit(""))
    kind = "array<struct<letter:string,text:string>>"

    def found(b: Column) -> Column:
        marks = F.regexp_extract_all(b, F.lit(OPTION), F.lit(0))
        letters = F.transform(marks, lambda m: F.upper(F.regexp_extract(m, "[A-Ea-e]", 0)))
        parts = F.split(b, OPTION, -1)
        # a marker at the very start leaves no part before it
        parts = F.when(F.size(parts) <= F.size(marks), F.concat(F.array(F.lit("")), parts)).otherwise(parts)
        return F.struct(letters.alias("letters"), parts.alias("parts"))

    def judged(f: Column) -> Column:
        letters, parts = f["letters"], f["parts"]
        texts = F.transform(F.slice(parts, 2, 1 << 30), lambda x: F.trim(x))
        head = F.try_element_at(parts, F.lit(1))
        ascending = (F.array_sort(F.array_distinct(letters)) == letters) & (F.size(letters) >= 2)
        asked = F.contains(head, F.lit("?")) | F.contains(head, F.lit("____"))
        last_mark, last_blank = F.instr(F.reverse(head), "?"), F.instr(F.reverse(head), "____")
        by_mark = (last_mark > 0) & ((last_blank == 0) | (last_mark < last_blank))
        stem = F.when(by_mark, F.substring(head, F.lit(1), F.length(head) - last_mark + 1)).otherwise(F.regexp_extract(head, r"^(?s)(.*____)", 1))
        inferred = F.trim(F.substring(head, F.length(stem) + 1, F.length(head)))
        explicit = letters[0] == "A"
        choices = F.zip_with(letters, texts, lambda x, t: F.struct(x.alias("letter"), t.alias("text")))
        guessed = F.concat(F.array(F.struct(F.lit("A").alias("letter"), inferred.alias("text"))), choices)
        whole = F.array_join(letters, "") == F.substring(F.lit("BCDE"), F.lit(1), F.size(letters))
        out = F.when(explicit, F.struct(F.trim(head).alias("stem"), choices.cast(kind).alias("choices"))).when(asked & whole & F.trim(stem).rlike(ASKS), F.struct(F.trim(stem).alias("stem"), guessed.cast(kind).alias("choices")))
        sound = F.forall(out["choices"], lambda c: (c["text"] != "") & ~c["text"].rlike(OPTION_LINE) & ~c["text"].rlike(r"^[A-Ea-e][.)]\s"))
        mean = F.aggregate(out["choices"], F.lit(0), lambda s, c: s + F.length(c["text"])) / F.size(out["choices"])
        return F.when(ascending & sound & (mean <= 150) & (F.length(out["stem"]) >= 8), out)

    none = F.struct(body.alias("stem"), F.array().cast(kind).alias("choices"))
    # bound as a lambda's variable, the text is matched once
    return F.coalesce(F.transform(F.transform(F.array(body), found), judged)[0], none)


def explode_option_lines(text: Column) -> Column:
    """struct(stem, choices) of a region with one option a line: marked lines with their continuations, two to five from A on; or
    without any marker two to five lines as A, B, ...; else the text and no choices."""
    kind = "array<struct<letter:string,text:string>>"
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(_lines(F.regexp_replace(body, "\r", "\n")), lambda x: x != "")
    mark = r"^\(?([A-Ea-e])[).]\s*(.*)$"

    def judged(rows: Column) -> Column:
        parts = F.transform(_cut(rows, lambda x: x.rlike(mark)), lambda p: F.array_join(p, " "))
        marked = F.slice(parts, 2, 1 << 30)
        choices = F.transform(marked, lambda x: F.struct(F.upper(F.regexp_extract(x, mark, 1)).alias("letter"), F.trim(F.regexp_extract(x, mark, 2)).alias("text"))).cast(kind)
        n, letters = F.size(choices), F.array_join(F.transform(choices, lambda c: c["letter"]), "")
        good = n.between(2, 5) & (letters == F.substring(F.lit("ABCDE"), F.lit(1), n)) & F.forall(choices, lambda c: c["text"] != "")
        placed = F.transform(rows, lambda x, k: F.struct(F.chr(k + 65).alias("letter"), x.alias("text"))).cast(kind)
        return F.when(good, F.struct(F.trim(parts[0]).alias("stem"), choices.alias("choices"))).when((n == 0) & F.size(rows).between(2, 5), F.struct(F.lit("").alias("stem"), placed.alias("choices")))

    none = F.struct(body.alias("stem"), F.array().cast(kind).alias("choices"))
    return F.coalesce(F.transform(F.array(lines), judged)[0], none)


def is_matching(body: Column) -> Column:
    """A matching cue, and over six row markers or both kinds of them."""
    digits, letters = F.regexp_count(body, F.lit(DIGIT_MARK)), F.regexp_count(body, F.lit(ALPHA_MARK))
    return body.rlike(MATCHING) & ((digits + letters > 6) | ((digits > 0) & (letters > 0)))


def merge_continuations(rows: Column) -> Column:
    """Rows without blanks to fill in; one without a marker joins the marked row before it, rows before any marker stay apart."""
    bare = F.filter(F.transform(F.coalesce(rows, F.array().cast("array<string>")), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^_{2,}\s*", ""))), lambda x: x != "")

    def merged(parts: Column) -> Column:
        return F.concat(parts[0], F.transform(F.slice(parts, 2, 1 << 30), lambda p: F.array_join(p, " ")))

    cut = F.transform(F.array(bare), lambda b: _cut(b, lambda x: x.rlike(ROW_MARK)))
    return F.transform(cut, merged)[0]


def label_rows(rows: Column, numeric: bool) -> Column:
    """array<label, text>: a row's own marker in upper case, else its place as a number or letter; blank rows are left out."""
    kept = F.filter(F.transform(rows, lambda x: F.trim(x)), lambda x: x != "")

    def one(x: Column, k: Column) -> Column:
        marked = x.rlike(ROW_MARK)
        place = (k + 1).cast("string") if numeric else F.chr(k + 65)
        return F.struct(F.when(marked, F.upper(F.regexp_extract(x, ROW_MARK, 1))).otherwise(place).alias("label"), F.when(marked, F.trim(F.regexp_extract(x, ROW_MARK, 2))).otherwise(x).alias("text"))

    return F.transform(kept, one)


def extract_answers(docs: DataFrame, key: str, pages: str) -> DataFrame:
    """(key, number, answer) from key pages: the last sound line of each number.

    An answer has 1 to 150 characters, is no point marker, no question and no numbered item itself.
    """
    lines = F.flatten(F.transform(F.filter(F.coalesce(pages, F.array().cast("array<string>")), is_key), _lines))
    rows = docs.select(key, F.posexplode(F.filter(lines, lambda x: x.rlike(ANSWER))).alias("at", "line"))
    rows = rows.select(key, "at", F.regexp_extract("line", ANSWER, 1).alias("number"), F.trim(F.regexp_extract("line", ANSWER, 2)).alias("answer"))
    sound = (F.length("answer").between(1, 150)) & ~F.col("answer").rlike(POINT_PREFIX) & ~F.col("answer").endswith("?") & ~F.col("answer").rlike(RECORD)
    return rows.where(sound).groupBy(key, "number").agg(F.max_by("answer", "at").alias("answer"))


def key_pairs(answer: Column, left: Column) -> Column:
    """map(label, letter) where the answer has exactly as many letters as there are left labels, by position; else an empty map."""
    letters = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit("[A-Za-z]"), F.lit(0))
    labels = F.coalesce(left, F.array().cast("array<string>"))
    fits = (F.size(letters) == F.size(labels)) & (F.size(labels) > 0)
    return F.when(fits, F.map_from_arrays(labels, F.transform(letters, F.upper))).otherwise(F.create_map().cast("map<string,string>"))


def attach_pairs(items: DataFrame, docs: DataFrame, key: str, pages: str, number: str, left: Column, pairs: str) -> DataFrame:
    """items with pairs from the key pages of docs (key, pages) where they had none: the first line of an item's number whose answer has as many letters as
    the item has left labels. left is null for items that are not matching ones; null and empty pairs are none."""
    lines = F.flatten(F.transform(F.filter(F.coalesce(pages, F.array().cast("array<string>")), is_key), _lines))
    rows = docs.select(key, F.posexplode(lines).alias("_at", "line")).withColumn("line", F.trim("line")).where(F.col("line").rlike(ANSWER))
    rows = rows.select(key, "_at", F.regexp_extract("line", ANSWER, 1).alias(number), F.trim(F.regexp_extract("line", ANSWER, 2)).alias("_answer"))
    asked = items.where(left.isNotNull() & (F.coalesce(F.size(pairs), F.lit(0)) <= 0)).select(key, number, left.alias("_left"))
    found = asked.join(rows, [key, number]).withColumn("_found", key_pairs(F.col("_answer"), F.col("_left"))).where("size(_found) > 0")
    first = found.groupBy(key, number).agg(F.min_by("_found", "_at").alias("_found"))
    joined = items.join(first, [key, number], "left")
    return joined.withColumn(pairs, F.when(left.isNotNull() & (F.coalesce(F.size(pairs), F.lit(0)) <= 0), F.coalesce("_found", pairs)).otherwise(F.col(pairs))).select(*items.columns)


def greedy_chunks(docs: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """(key, chunk_no, chunk): a text within most characters is one chunk as it is; a longer one is cut at runs of two or more newlines
    and paragraphs are added while their lengths, plus two for each that is followed by another, stay within most.

    The paragraph that opens a chunk after a cut counts without those two. A longer paragraph stands alone; null is the empty text.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    parts = F.split(whole, r"\n{2,}")
    # one pass over the paragraphs' lengths finds the places of those that start a chunk; the texts are cut there afterwards
    state = F.struct(F.lit(0).alias("used"), F.lit(1).alias("place"), F.array().cast("array<int>").alias("cuts"))

    def step(s: Column, p: Column) -> Column:
        cut = (s["used"] + F.length(p) > most) & (s["place"] > 1)
        used = F.when(cut, F.length(p)).otherwise(s["used"] + F.length(p) + 2)
        cuts = F.when(cut, F.concat(s["cuts"], F.array(s["place"]))).otherwise(s["cuts"])
        return F.struct(used.alias("used"), (s["place"] + 1).alias("place"), cuts.alias("cuts"))

    placed = F.transform(F.array(parts), lambda b: F.struct(b.alias("rows"), F.aggregate(b, state, step, lambda s: s["cuts"]).alias("at")))
    chunks = F.transform(F.transform(placed, lambda x: _slices(x["rows"], x["at"]))[0], lambda c: F.array_join(c, "\n\n"))
    return docs.select(key, F.posexplode(F.when(F.length(whole) <= most, F.array(whole)).otherwise(chunks)).alias("chunk_no", "chunk"))


def chapters(docs: DataFrame, key: str, markdown: str) -> DataFrame:
    """(key, chapter_no, title, start_page, end_page) from heading lines and the page marks before them; the end is one before the next start, not
    below the own start, and for the last the last page. Documents without headings have no rows."""
    # what stands before the first mark is page 1
    cut = _cut(_lines(F.col(markdown)), lambda x: x.rlike(PAGE_MARK))
    number = lambda p: F.coalesce(F.regexp_extract(F.try_element_at(p, F.lit(1)), PAGE_MARK, 1).try_cast("int"), F.lit(1))
    pages = F.transform(cut, lambda p: F.struct(number(p).alias("page"), F.filter(p, lambda x: x.rlike(HEADING)).alias("titles")))
    rows = docs.select(key, pages.alias("pages"))
    heads = F.flatten(F.transform("pages", lambda p: F.transform(p["titles"], lambda t: F.struct(t.alias("title"), p["page"].alias("page")))))
    last = F.array_max(F.transform("pages", lambda p: p["page"]))
    rows = rows.select(key, heads.alias("heads"), last.alias("last")).select(key, "heads", "last", F.posexplode("heads").alias("k", "h"))
    after = F.try_element_at("heads", F.col("k") + 2)["page"] - 1
    end = F.greatest(F.coalesce(after, F.col("last")), F.col("h.page"))
    return rows.select(key, F.col("k").alias("chapter_no"), "h.title", F.col("h.page").alias("start_page"), end.alias("end_page"))


def slice_chapters(pages: DataFrame, chapters: DataFrame, key: str) -> DataFrame:
    """(key, chapter_no, text): the pages (key, page, text) of each chapter in order, joined by blank lines; an equi-join on the document with the
    page range behind it."""
    held = pages.select(key, "page", F.col("text").alias("page_text")).join(chapters.select(key, "chapter_no", "start_page", "end_page"), key)
    held = held.where("page between start_page and end_page")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "page_text"))), lambda x: x["page_text"])
    return held.groupBy(key, "chapter_no").agg(F.trim(F.array_join(ordered, "\n\n")).alias("text"))


def assemble_pages(pages: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """(key, markdown): pages that are not blank, in order, each under its page mark; spaces before line ends go, three newlines or more become two."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")), r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    rows = pages.select(key, F.col(page).alias("page"), clean.alias("text")).where("text != ''")
    part = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: F.concat(F.lit("## Page "), x["page"].cast("string"), F.lit("\n\n"), x["text"]))
    return rows.groupBy(key).agg(F.array_join(part, "\n\n").alias("markdown"))


def split_columns(layout: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, split_x) of regions of two columns: the middle of the widest gap between distinct left edges at one decimal, the rightmost of
    equals; only for four blocks or more, a gap of 20 or more, and two blocks at least on each side."""
    edges = layout.groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.round("x0", 1))).alias("xs"))
    gaps = F.zip_with(F.slice("xs", 2, 1 << 30), F.expr("slice(xs, 1, size(xs) - 1)"), lambda b, a: F.struct((b - a).alias("gap"), a.alias("lo")))
    edges = edges.where("n >= 4 and size(xs) >= 2").withColumn("best", F.array_max(gaps)).where("best.gap >= 20")
    split = edges.select(*keys, (F.col("best.lo") + F.col("best.gap") / 2).alias("split_x"))
    sides = layout.join(split, keys).groupBy(*keys, "split_x").agg(F.count_if(F.col("x0") <= F.col("split_x")).alias("l"), F.count_if(F.col("x0") > F.col("split_x")).alias("r"))
    return sides.where("l >= 2 and r >= 2").select(*keys, "split_x")


def name_meta(name: Column) -> Column:
    """struct(year, division, label) from the underscore parts of a file name: the second, the third in upper case, and the rest."""
    parts = F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "_")
    rest = F.array_join(F.slice(parts, 4, 1 << 30), "_")
    label = F.trim(F.replace(F.replace(F.replace(rest, F.lit("_test"), F.lit("")), F.lit("_key"), F.lit("")), F.lit("_"), F.lit(" ")))
    return F.struct(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("?")).alias("year"), F.coalesce(F.upper(F.try_element_at(parts, F.lit(3))), F.lit("?")).alias("division"), label.alias("label"))


def split_focus(name: Column) -> Column:
    """struct(event, focus): cut at the first ' - '; without one the focus is empty."""
    parts = F.split(name, " - ", 2)
    return F.struct(F.trim(parts[0]).alias("event"), F.trim(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))).alias("focus"))


def attach_answers(items: DataFrame, answers: DataFrame, key: str, number: str) -> DataFrame:
    """items with answer: that of the source of least precedence (key document, then inline, then OCR); matching items and all items of a document with
    suffixed numbers have none, as numbers that restart make answers unsure.

    answers: key, number, answer, precedence; one row per key, number and precedence.
    """
    best = answers.groupBy(key, number).agg(F.min_by("answer", "precedence").alias("answer"))
    unsure = items.where(F.col(number).rlike("[a-z]$")).select(key).distinct().withColumn("unsure", F.lit(True))
    joined = items.drop("answer").join(best, [key, number], "left").join(unsure, key, "left")
    keep = F.col("unsure").isNull() & ~F.coalesce(F.col("qtype") == "matching", F.lit(False))
    return joined.withColumn("answer", F.coalesce(F.when(keep, F.col("answer")), F.lit(""))).drop("unsure")
