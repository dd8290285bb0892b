"""Reading and writing banks, catalogues, rosters and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.ranks import ranked
from corvane.functions.storage import written
from corvane.operators.lookup import classify_by_table
from corvane.operators.reports import plain_key, unique_keys
from corvane.operators.shape import normalize_text, normalize_texts
from corvane.operators.similar import dedup_greedy
from corvane.operators.text import OTHER

ITEM = (
    "struct<number:string,topic:string,focus:string,text:string,choices:array<struct<letter:string,text:string>>,answer:string,images:array<string>,source:string,year:string,division:string,"
    "page:int,context_id:string,qtype:string,validation:struct<status:string,rationale:string>,lastEditedBy:string,lastEditedDateTime:string>"
)
#: One collection's state; sections that old files lack are null.
STATE = f"_schema_version int, collection string, questions map<string,array<{ITEM}>>, contexts map<string,array<struct<id:string,title:string,text:string>>>, annotations map<string,string>, manual map<string,string>, pdf_meta map<string,struct<year:string,tournament:string>>, _corrupt_record string"
CANDIDATE = "array<struct<text:string,answer:string,topic:string,choices:array<struct<letter:string,text:string>>,type:string,rationale:string,source_snippet:string,image_description:string,image_context:string>>"
#: Usernames, file roles and what of a file name tells year and division.
USERNAME = r"^[a-z][a-z0-9_]{1,31}$"
ROLE = r"(?i)^.+_(test|key)\.(pdf|docx|doc)$"
DOCUMENT = r"(?i)\.(pdf|docx|doc)$"
YEAR, DIVISION = r"(19|20)\d{2}", r"(?<![a-zA-Z])(BC|B|C)(?![a-zA-Z])"


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """The states below path, one JSON object a line, upgraded; a line that is no object has _corrupt_record and nothing else."""
    return upgrade_states(spark.read.schema(STATE).json(path))


def upgrade_states(states: DataFrame) -> DataFrame:
    """states at version 3: sections that came with versions 2 and 3 are empty where older states lack them."""
    version = F.coalesce("_schema_version", F.lit(1))
    sound = F.col("_corrupt_record").isNull()
    empty = {c: F.create_map().cast(states.schema[c].dataType) for c in ("annotations", "manual", "pdf_meta")}
    filled = {c: F.when(sound & (version < since), F.coalesce(F.col(c), empty[c])).otherwise(F.col(c)) for c, since in (("annotations", 2), ("manual", 2), ("pdf_meta", 3))}
    return states.withColumns({**filled, "_schema_version": F.when(sound, F.lit(3))})


def rename_status(status: Column) -> Column:
    """A test's state under its present name."""
    return F.when(status == "building", "preparing").otherwise(status)


def bank_items(states: DataFrame) -> DataFrame:
    """(collection, doc, ord, fields of the item): one row per item in the order of its document; items never leave their state's row before they are exploded."""
    docs = states.select("collection", F.explode("questions").alias("doc", "items"))
    return docs.select("collection", "doc", F.posexplode("items").alias("ord", "item")).select("collection", "doc", "ord", "item.*")


def bank_contexts(states: DataFrame) -> DataFrame:
    """(collection, key, title, text) of shared contexts; an id is unique within its document only, so the key is doc::id."""
    docs = states.select("collection", F.explode("contexts").alias("doc", "all")).select("collection", "doc", F.explode("all").alias("c"))
    return docs.select("collection", F.concat_ws("::", "doc", "c.id").alias("key"), "c.title", "c.text")


def link_manifest(catalog: DataFrame, terms: list[str]) -> DataFrame:
    """(url, filename, kind) of the entries (event, test_link, key_link, notes_link, other_links) whose event contains a term in either case; other links only to PDFs."""
    match = F.lit(False)
    for term in terms:
        match = match | F.lower("event").contains(term.lower())
    main = F.array(*[F.struct(F.col(f"{k}_link").alias("url"), F.lit(k).alias("kind")) for k in ("test", "key", "notes")])
    other = F.transform(F.filter(F.coalesce("other_links", F.array().cast("array<struct<href:string,text:string>>")), lambda o: o["href"].endswith(".pdf")), lambda o: F.struct(o["href"].alias("url"), F.coalesce(o["text"], F.lit("other")).alias("kind")))
    rows = catalog.where(match).select(F.explode(F.concat(main, other)).alias("l")).where("l.url is not null")
    return rows.select("l.url", F.element_at(F.split("l.url", "/"), -1).alias("filename"), "l.kind")


def pending_links(manifest: DataFrame, files: DataFrame, least: int = 1000) -> DataFrame:
    """Links whose file is not there with more than least bytes."""
    return manifest.join(files.where(F.col("length") > least).select("filename"), "filename", "left_anti")


def inventory(files: DataFrame, processed: DataFrame) -> DataFrame:
    """(filename, bucket, year, division): test files not processed yet are ready, or needs_conversion as .doc and .docx without a PDF; documents of no role and of no
    test's prefix are unrecognized, with year and division as far as the name tells. Others have no row.

    Supplementary files are found by the test's prefix: every prefix of a name that ends before an underscore is looked up, so no pair of files is compared.
    """
    names = files.select("filename").distinct()
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    tests = names.where(F.lower(F.regexp_extract("filename", ROLE, 1)) == "test").withColumn("pdf", F.concat(stem, F.lit(".pdf")))
    there = names.select(F.col("filename").alias("pdf"), F.lit(True).alias("there"))
    done = processed.select(F.col("filename").alias("pdf")).distinct().withColumn("done", F.lit(True))
    judged = tests.join(there, "pdf", "left").join(done, "pdf", "left")
    ready = judged.where("there and done is null").select(F.col("pdf").alias("filename")).distinct().withColumn("bucket", F.lit("ready"))
    convert = judged.where("there is null").select("filename", F.lit("needs_conversion").alias("bucket"))
    roots = tests.select(F.regexp_replace("pdf", r"(?i)_test\.pdf$", "").alias("root")).distinct()
    odd = names.where(F.col("filename").rlike(DOCUMENT) & ~F.col("filename").rlike(ROLE))
    parts = F.split("filename", "_")
    cuts = odd.where(F.lower("filename").endswith(".pdf")).select("filename", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "_"))).alias("root"))
    known = cuts.join(roots, "root", "left_semi").select("filename").distinct()
    unknown = odd.join(known, "filename", "left_anti").select("filename", F.lit("unrecognized").alias("bucket"))
    guess = lambda p: F.when(F.col("bucket") == "unrecognized", F.upper(F.regexp_extract("filename", p, 0)))
    return ready.union(convert).union(unknown).select("filename", "bucket", guess(YEAR).alias("year"), guess(DIVISION).alias("division"))


def list_sources(files: DataFrame) -> DataFrame:
    """(stem, name, kind, size, has_markdown, markdown_size): a PDF with its Markdown of the same stem is one source; text files without a PDF stand for themselves."""
    dot = r"^(.*)\.(pdf|md|txt)$"
    rows = files.select(F.regexp_extract("filename", dot, 1).alias("stem"), F.regexp_extract("filename", dot, 2).alias("kind"), "filename", "length").where("kind != ''")
    at = rows.groupBy("stem").agg(F.max(F.when(F.col("kind") == "pdf", F.struct("filename", "length"))).alias("pdf"), F.max(F.when(F.col("kind") == "md", F.struct("filename", "length"))).alias("md"), F.max(F.when(F.col("kind") == "txt", F.struct("filename", "length"))).alias("txt"))
    options = F.when(F.col("pdf").isNotNull(), F.array(F.struct("pdf.filename", F.lit("pdf").alias("kind"), "pdf.length", F.col("md").isNotNull().alias("has"), F.coalesce("md.length", F.lit(0)).alias("md_length"))))
    alone = F.filter(F.array(F.when(F.col("md").isNotNull(), F.struct("md.filename", F.lit("md").alias("kind"), "md.length", F.lit(True).alias("has"), F.col("md.length").alias("md_length"))), F.when(F.col("txt").isNotNull(), F.struct("txt.filename", F.lit("txt").alias("kind"), "txt.length", F.lit(True).alias("has"), F.col("txt.length").alias("md_length")))), lambda x: x.isNotNull())
    return at.select("stem", F.explode(F.coalesce(options, alone)).alias("s")).select("stem", F.col("s.filename").alias("name"), "s.kind", F.col("s.length").alias("size"), F.col("s.has").alias("has_markdown"), F.col("s.md_length").alias("markdown_size"))


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """The CSV files below path with headers trimmed, in lower case and without a byte order mark; all values are trimmed strings, missing columns null."""
    raw = spark.read.csv(path, header=True)
    names = {c.strip("﻿ ").lower(): c for c in raw.columns}
    return raw.select(*[(F.trim(F.col(f"`{names[c]}`")) if c in names else F.lit(None).cast("string")).alias(c) for c in ("display_name", "username", "events")])


def import_roster(rows: DataFrame, users: DataFrame, lineup: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(created, errors, rostered) of rows (row, display_name, username, events cut by ;): a row needs a name and a sound, new username, the first row of equal ones wins; rostered
    counts created students per event of the lineup.

    A blank username is made of the name by unique_keys; names that rows of the file give themselves are theirs, in whatever order the rows stand. A name of one
    letter or digit makes no sound username. Runs jobs when called if there are blank ones.
    """
    blank = F.coalesce("username", F.lit("")) == ""
    named = rows.withColumn("username", F.lower("username"))
    usable = (F.coalesce("display_name", F.lit("")) != "") & F.when(blank, F.length(plain_key(F.col("display_name"))) > 1).otherwise(F.col("username").rlike(USERNAME))
    first = named.where(usable & ~blank).groupBy("username").agg(F.min("row").alias("first"))
    known = users.select("username", F.lit(True).alias("known")).distinct()
    judged = named.join(first, "username", "left").join(known, "username", "left")
    reason = F.when(F.coalesce("display_name", F.lit("")) == "", "display_name is required").when(~usable, "username is malformed").when(~blank & (F.col("known") | (F.col("row") != F.col("first"))), "username is taken")
    judged = judged.withColumn("reason", reason)
    created = judged.where(F.col("reason").isNull() & ~blank).select("row", "username", "display_name", "events")
    open_ = named.where(usable & blank).select("row", "display_name", "events")
    if not open_.isEmpty():
        made = unique_keys(open_, "display_name", "row", users.select("username").union(created.select("username")), "username")
        created = created.unionByName(made)
    wanted = created.select("username", F.explode(F.array_distinct(F.filter(F.transform(F.split(F.coalesce("events", F.lit("")), ";"), lambda x: F.trim(x)), lambda e: e != ""))).alias("slug"))
    rostered = wanted.join(lineup.select("slug").distinct(), "slug", "left_semi").groupBy("slug").agg(F.count("*").alias("n"))
    return created, judged.where("reason is not null").select("row", "reason"), rostered


def repaired(raw: Column) -> Column:
    """A model's JSON answer with straight quotes, without fences and prose around the outermost brackets, and without commas before closing ones."""
    plain = F.translate(F.trim(raw), "“”‘’", "\"\"''")
    bare = F.regexp_replace(F.regexp_replace(plain, r"(?i)^```(?:json)?\s*", ""), r"\s*```\s*$", "")
    inner = F.regexp_extract(bare, r"(?s)[\[{].*[\]}]", 0)
    return F.regexp_replace(inner, r",(\s*[}\]])", "$1")


def parse_candidates(raw: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(candidates, quarantine): the objects of {"candidates": [...]} or of a bare array, one row each with ord, tried as they come, then repaired, then with single quotes made
    double; rows that none of this mends are quarantined whole."""
    keys = [c for c in raw.columns if c != text]

    def parsed(c: Column) -> Column:
        own = F.when(c.startswith("["), F.from_json(c, CANDIDATE))
        return F.coalesce(own, F.when(c.startswith("{"), F.from_json(c, f"candidates {CANDIDATE}")["candidates"]))

    mended = repaired(F.col(text))
    found = F.coalesce(parsed(F.trim(text)), parsed(mended), parsed(F.regexp_replace(mended, "'([^']*)'", "\"$1\"")))
    judged = raw.withColumn("found", found)
    rows = judged.where("found is not null").select(*keys, F.posexplode("found").alias("ord", "c")).select(*keys, "ord", "c.*")
    return rows, judged.where("found is null").select(*raw.columns)


def import_candidates(raw: DataFrame, order: str, text: str, bank: DataFrame, keywords: DataFrame, start: int, marked: bool = False, percent: int = 40, least: int = 12) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(items, rejected, quarantine, counts) of raw (order, text): model answers from parsing to numbered items of a bank (item_id, text).

    Candidates come by order, which is unique and not null, and by their place within a text. Texts under least characters, null ones too, are invalid; then texts,
    answers and choices are normalised, choices are lettered anew without empty ones, and a text similar to one of the bank or to an earlier accepted one is a
    duplicate. The accepted are numbered from start; a topic that keywords (topic, topic_ord, phrase, weight) do not know is told by the text, a lacking one is OTHER.
    marked makes them validated ones, else those with a rationale or snippet are uncertain. rejected has (order, ord, outcome, reason, matched), where matched is a bank
    item for reason bank and a candidate's rank among all for batch; counts is one row (added, duplicate, invalid, quarantined). Runs jobs when called.
    """
    rows, quarantine = parse_candidates(raw.select(order, text), text)
    rows = rows.select(order, "ord", F.struct(*[c for c in rows.columns if c not in (order, "ord")]).alias("c"))
    trimmed = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    texts = F.filter(normalize_texts(F.transform(F.col("c.choices"), lambda x: x["text"])), lambda x: x != "")
    clean = ranked(rows, [], [order, "ord"], "pos").select(
        order, "ord", "pos", "c", (F.length(trimmed(F.col("c.text"))) >= least).alias("valid"), normalize_text(F.col("c.text")).alias("text"), normalize_text(F.col("c.answer")).alias("answer"), texts.alias("texts"))
    clean = written(clean, "candidates")
    found = dedup_greedy(clean.where("valid").select(F.col("pos").alias("doc_id"), "text"), bank, percent, 0)
    judged = clean.join(found.select(F.col("doc_id").alias("pos"), "reason", "matched"), "pos", "left")
    outcome = F.when(~F.col("valid"), "invalid").when(F.col("reason").isNotNull(), "duplicate").otherwise("added")
    judged = written(judged.withColumn("outcome", outcome), "judged")
    numbered = ranked(judged.where("outcome = 'added'"), [], ["pos"], "nth")
    given = F.when(F.coalesce("c.topic", F.lit("")) == "", OTHER).otherwise(F.col("c.topic"))
    names = keywords.select(F.col("topic").alias("given"), F.lit(True).alias("known")).where("given is not null").distinct()
    told = classify_by_table(numbered.withColumn("given", given), "text", keywords, "told").join(names, "given", "left")
    why, snippet = trimmed(F.col("c.rationale")), F.substring(trimmed(F.col("c.source_snippet")), 1, 240)
    label = F.when(snippet != "", F.concat(F.lit("LLM-derived from: "), F.substring(snippet, 1, 80))).otherwise("LLM-derived")
    if marked:
        verdict = F.struct(F.lit("correct").alias("status"), F.when(why != "", why).otherwise("Marked validated on import.").alias("rationale"), F.lit("Imported (manually marked validated)").alias("source"))
    else:
        verdict = F.when((why != "") | (snippet != ""), F.struct(F.lit("uncertain").alias("status"), why.alias("rationale"), label.alias("source")))
    hint = trimmed(F.when(F.coalesce("c.image_description", F.lit("")) == "", F.col("c.image_context")).otherwise(F.col("c.image_description")))
    kind = F.when(F.coalesce("c.type", F.lit("")) != "", F.col("c.type")).when(F.size("texts") > 0, "mc").otherwise("short")
    items = told.select(
        order, "ord", (F.col("nth") + start - 1).cast("string").alias("number"), F.when(F.col("known") | (F.col("given") == OTHER), F.col("given")).otherwise(F.col("told")).alias("topic"), kind.alias("type"), "text",
        F.transform("texts", lambda x, k: F.struct(F.chr(k + 65).alias("letter"), x.alias("text"))).alias("choices"), "answer", F.lit("Imported").alias("source"), F.lit("").alias("year"), F.lit("").alias("division"),
        F.lit(1).alias("page"), F.when(hint != "", hint).alias("pending_image"), verdict.alias("validation"))
    outcomes = judged.select("outcome").union(quarantine.select(F.lit("quarantined")))
    counts = outcomes.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("added", "duplicate", "invalid", "quarantined")])
    return items, judged.where("outcome <> 'added'").select(order, "ord", "outcome", "reason", "matched"), quarantine, counts


def flat_items(items: DataFrame) -> DataFrame:
    """items as flat text columns: options as "A. x | B. y", verdict fields lifted, nothing null."""
    choices = F.array_join(F.transform(F.coalesce("choices", F.array().cast("array<struct<letter:string,text:string>>")), lambda c: F.concat(F.coalesce(c["letter"], F.lit("?")), F.lit(". "), F.coalesce(c["text"], F.lit("")))), " | ")
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("number", "topic", "focus", "text", "answer")]
    rest = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "year", "division", "doc", "context_id")]
    lifted = [F.coalesce(F.col(f"validation.{c}"), F.lit("")).alias(n) for c, n in (("status", "validation_status"), ("rationale", "rationale"))]
    return items.select(*plain, choices.alias("choices"), *rest, *lifted)


def export_csv(items: DataFrame, path: str) -> None:
    """Flat CSV files with headers below path; quotes are doubled within quotes and empty texts are quoted, so texts with commas, quotes and line ends and empty texts come back."""
    flat_items(items).write.csv(path, header=True, escape='"')


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """What export_csv has written, all columns text: an empty text is empty again, as none was null."""
    return spark.read.csv(path, header=True, escape='"', multiLine=True, nullValue="\x00")


def export_json(items: DataFrame, contexts: DataFrame, path: str) -> None:
    """Nested JSON lines below path/items and path/contexts, a folder per collection."""
    items.write.partitionBy("collection").json(f"{path}/items")
    contexts.write.partitionBy("collection").json(f"{path}/contexts")


def write_snapshot(items: DataFrame, saved_at: Column, path: str) -> None:
    """Append the items as they are now, by day of the snapshot and by a hash of the document, so that one document is read from few files and there are no more folders than
    days and hashes."""
    stamped = items.withColumn("saved_at", saved_at).withColumns({"day": F.to_date("saved_at"), "part": F.pmod(F.xxhash64("doc"), F.lit(64)).cast("int")})
    stamped.repartition("day", "part").write.partitionBy("day", "part").mode("append").parquet(path)


def html_to_text(pages: DataFrame, html: str, title: str) -> DataFrame:
    """pages with text: the html without scripts, styles, navigation, tables of contents and comments, tags as line ends or spaces, the commonest character references decoded, blank lines collapsed,
    under the title and the length. Patterns cannot balance nested blocks: a noise block ends at its first closing tag."""
    body = F.coalesce(F.col(html), F.lit(""))
    for tag in ("script", "style", "nav", "head"):
        body = F.regexp_replace(body, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    body = F.regexp_replace(body, r"(?s)<!--.*?-->", " ")
    body = F.regexp_replace(body, r"""(?is)<(span|div|table)\b[^>]*(?:class|id)\s*=\s*["'][^"']*(?:toc|noprint|editsection|navbox|metadata|printfooter)[^"']*["'][^>]*>.*?</\1\s*>""", " ")
    body = F.regexp_replace(body, r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|tr|table|article|section|header|footer|br|blockquote)\b[^>]*>", "\n")
    body = F.regexp_replace(body, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        body = F.replace(body, F.lit(entity), F.lit(char))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"[ \t]*\n[ \t]*", "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return pages.withColumn("text", F.concat(F.lit("# "), F.coalesce(F.col(title), F.lit("")), F.lit("\n\n*Length: "), F.length(text).cast("string"), F.lit(" chars*\n\n---\n\n"), text))
