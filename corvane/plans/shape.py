"""Registered queries of text shaping and layout, and the SQL they must equal.

Documents have no numbered lines, so the queries number their lines first; parts give options and columns, conversations pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import layout, shape

MARKERS = ("the ", "que ")
PREFIXES = ("licensed", "page ")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered(spark, sf_dir, head: str = "", wrap: int = 10**6) -> DataFrame:
    """doc_id and pages: one page, each line that is not blank with its number in front."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    page = F.array_join(F.transform(lines, lambda x, k: F.concat((k % wrap + 1).cast("string"), F.lit(". "), x)), "\n")
    return _t(spark, sf_dir, "documents").select("doc_id", F.array(F.concat(F.lit(head), page)).alias("pages"))


def c1_normalize(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    raw = F.concat(F.lit(" ２ "), "p_name", F.lit("  (2 pts each)  "), F.when(F.col("p_size") % 2 == 0, F.lit("ﬁn​")).otherwise("[½ pt] end"), F.lit(" (3 parts)"))
    return part.select("p_partkey", shape.normalize_text(raw).alias("text"))


def c3_cover_pages(spark, sf_dir):
    pages = _numbered(spark, sf_dir).join(_t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    page = F.when(F.col("doc_id") % 2 == 0, F.col("pages")[0]).otherwise(F.col("text"))
    return pages.select("doc_id", shape.is_cover(page, MARKERS).alias("cover"))


def c4_key_pages(spark, sf_dir):
    return _numbered(spark, sf_dir).select("doc_id", shape.is_key(F.col("pages")[0]).alias("key"))


def c5_records(spark, sf_dir):
    found = shape.segment_records(_numbered(spark, sf_dir), "pages", (), PREFIXES, absorb=False)
    return found.select("doc_id", "number", F.length("body").alias("n_chars"))


def c6_inline(spark, sf_dir):
    line = F.concat(F.lit("7. What is "), "p_name", F.lit("? 8. Which "), "p_brand", F.when(F.col("p_size") % 2 == 0, F.lit(" is it? 9) (A) "),).otherwise(F.lit(" of 5. them")), "p_type")
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(shape.split_inline(line), "|").alias("lines"))


def c7_absorb(spark, sf_dir):
    found = shape.segment_records(_numbered(spark, sf_dir, "1. Match each item in column a\n"), "pages", (), PREFIXES)
    return found.select("doc_id", "number", F.length("body").alias("n_chars"))


def _choices(part, text, cut):
    got = cut(text)
    return part.select("p_partkey", F.transform(F.array(got), lambda g: F.struct(g["stem"].alias("stem"), F.array_join(F.transform(g["choices"], lambda c: F.concat_ws("=", c["letter"], c["text"])), "|").alias("choices")))[0].alias("g")).select("p_partkey", "g.*")


def c9_options(spark, sf_dir):
    size = F.col("p_size") % 5
    tail = F.when(size == 0, F.concat(F.lit(" a. "), "p_brand", F.lit(" b. "), "p_type", F.lit(" c. "), "p_name")).when(size == 1, F.concat(F.lit(" "), "p_brand", F.lit(" b. "), "p_type", F.lit(" c. x")))
    tail = tail.when(size == 2, F.concat(F.lit(" b. "), "p_type", F.lit(" a. "), "p_brand")).when(size == 3, F.concat(F.lit(" (A) "), "p_brand", F.lit(" (C) "), "p_type")).otherwise("")
    return _choices(_t(spark, sf_dir, "part"), F.concat(F.lit("What is "), "p_name", F.lit("?"), tail), shape.explode_options)


def c10_option_lines(spark, sf_dir):
    size = F.col("p_size") % 4
    text = F.when(size == 0, F.concat(F.lit("Pick "), "p_name", F.lit("\na. "), "p_brand", F.lit("\nwrapped\n(B) "), "p_type")).when(size == 1, F.concat("p_name", F.lit("\n\n"), "p_brand", F.lit("\n"), "p_type"))
    text = text.when(size == 2, F.concat(F.lit("b. "), "p_name", F.lit("\nc. "), "p_brand")).otherwise(F.col("p_name"))
    return _choices(_t(spark, sf_dir, "part"), text, shape.explode_option_lines)


def c11_matching(spark, sf_dir):
    cue = F.when(F.col("p_size") % 2 == 0, "Match each item: ").otherwise("Name them: ")
    marks = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.col("p_size") % 9 + 1), lambda k: F.concat(k.cast("string"), F.lit(". row"))))
    return _t(spark, sf_dir, "part").select("p_partkey", shape.is_matching(F.concat(cue, marks, F.when(F.col("p_size") % 3 == 0, " a. x").otherwise(""))).alias("matching"))


def _rows():
    return F.when(F.col("p_size") % 2 == 0, F.array(F.lit("lead"), F.concat(F.lit("____ 1. "), "p_brand"), F.lit(" more "), F.lit(""), F.concat(F.lit("b) "), "p_type"))).otherwise(F.array("p_brand", F.concat(F.lit("__ "), "p_type")))


def c12_continuations(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(shape.merge_continuations(_rows()), "|").alias("merged"))


def c13_labels(spark, sf_dir):
    labelled = shape.label_rows(shape.merge_continuations(_rows()), True)
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(labelled, lambda r: F.concat_ws("=", r["label"], r["text"])), "|").alias("labelled"))


def c14_columns(spark, sf_dir):
    return shape.split_columns(_t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("x0")), ["l_orderkey"])


def c15_answers(spark, sf_dir):
    return shape.extract_answers(_numbered(spark, sf_dir, wrap=7), "doc_id", "pages")


def c16_pairs(spark, sf_dir):
    answer = F.concat(F.lit("a, C;"), F.when(F.col("p_size") % 2 == 0, "b").otherwise(""))
    pairs = shape.key_pairs(answer, F.when(F.col("p_size") % 7 > 0, F.array(F.lit("1"), F.lit("2"), F.lit("3"))))
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(F.array_sort(F.map_entries(pairs)), lambda e: F.concat(e["key"], e["value"])), ",").alias("pairs"))


def c16_attached(spark, sf_dir):
    """Documents are brands by thousands of keys, items their parts; a key page has two lines of some parts, of which the first that fits counts."""
    part, size = _t(spark, sf_dir, "part"), F.col("p_size")
    number, doc = (F.col("p_partkey") % 1000).cast("string"), F.concat_ws("/", "p_brand", F.floor(F.col("p_partkey") / 1000))
    first = F.concat(number, F.lit(". a c"), F.when(size % 4 > 0, " b").otherwise(""))
    line = F.concat(first, F.lit("\n"), number, F.lit(". C, B, A"))
    docs = part.where("p_size % 3 > 0").groupBy(doc.alias("doc")).agg(F.array(F.concat(F.lit("ANSWER KEY\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n"))).alias("pages"))
    none = F.create_map().cast("map<string,string>")
    items = part.select(doc.alias("doc"), number.alias("number"), F.when(size % 5 > 0, F.slice(F.array(F.lit("1"), F.lit("2"), F.lit("3")), 1, F.when(size % 7 == 0, 2).otherwise(3))).alias("left"), F.when(size % 11 == 0, F.create_map(F.lit("1"), F.lit("Z"))).otherwise(none).alias("pairs"))
    out = shape.attach_pairs(items, docs, "doc", "pages", "number", F.col("left"), "pairs")
    return out.select("doc", "number", F.array_join(F.transform(F.array_sort(F.map_entries("pairs")), lambda e: F.concat(e["key"], e["value"])), ",").alias("pairs"))


def c17_paragraphs(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return shape.greedy_chunks(docs, "doc_id", "text", 900).select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"))


def _markdown(spark, sf_dir):
    turns = _t(spark, sf_dir, "conversations")
    head = F.when(F.col("role") == "user", F.concat(F.lit("Chapter "), F.col("turn").cast("string"), F.lit(": asked\n"))).otherwise("")
    return shape.assemble_pages(turns.select("conv_id", (F.col("turn") + 1).alias("page"), F.concat(head, F.coalesce("text", F.lit(""))).alias("text")), "conv_id", "page", F.col("text"))


def c18_chapters(spark, sf_dir):
    return shape.chapters(_markdown(spark, sf_dir), "conv_id", "markdown").where("title like 'Chapter %: asked'").select("conv_id", "title", "start_page")


def c18_ranges(spark, sf_dir):
    plain = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(F.lit("## Page "), (x["turn"] + 1).cast("string"), F.when(x["role"] == "user", "\nUnit x").otherwise("\ntext"))), "\n").alias("markdown"))
    return shape.chapters(plain, "conv_id", "markdown")


def c19_names(spark, sf_dir):
    name = F.concat(F.lit("circuits_"), F.year("o_orderdate").cast("string"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("_b_"), F.lower("o_orderpriority"), F.lit("_state_test.pdf"))).otherwise(".pdf"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", shape.name_meta(name).alias("m")).select("o_orderkey", "m.*")


def c20_focus(spark, sf_dir):
    name = F.concat(F.lit(" "), "p_brand", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" - "), "p_type", F.lit(" - "), "p_name")).otherwise(""))
    return _t(spark, sf_dir, "part").select("p_partkey", shape.split_focus(name).alias("f")).select("p_partkey", "f.*")


def c21_slices(spark, sf_dir):
    pages = _t(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("page"), "text")
    parts = pages.groupBy("conv_id").agg(F.max("page").alias("last")).select("conv_id", F.explode(F.array(F.struct(F.lit(0).alias("chapter_no"), F.lit(0).alias("start_page"), F.lit(1).alias("end_page")), F.struct(F.lit(1).alias("chapter_no"), F.lit(1).alias("start_page"), F.lit(9).alias("end_page")))).alias("c")).select("conv_id", "c.*")
    return shape.slice_chapters(pages, parts, "conv_id").select("conv_id", "chapter_no", F.length("text").alias("n_chars"))


def s14_assembled(spark, sf_dir):
    return _markdown(spark, sf_dir).select("conv_id", F.regexp_count("markdown", F.lit("(?m)^## Page \\d+$")).alias("n_pages"), F.length("markdown").alias("n_chars"))


def j1_attach_answers(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    items = orders.select(F.col("o_custkey").alias("doc"), F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 97 == 0, "b").otherwise("")).alias("number"), F.when(F.col("o_orderstatus") == "P", "matching").alias("qtype"))
    answers = _t(spark, sf_dir, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("doc")), "l_orderkey")
    answers = answers.where("l_linenumber > 1").groupBy("doc", F.col("l_orderkey").cast("string").alias("number"), F.col("l_linenumber").alias("precedence")).agg(F.max("l_returnflag").alias("answer"))
    return shape.attach_answers(items, answers, "doc", "number")


def _paged(spark, sf_dir):
    return _t(spark, sf_dir, "events").withColumn("page", F.to_date("ts"))


def j3_images(spark, sf_dir):
    number = F.when(F.col("event_type") == "click", F.col("event_id").cast("string"))
    image = F.when(F.col("event_type") == "view", F.concat(F.lit("img"), "event_id"))
    said = _paged(spark, sf_dir).where("event_type = 'view' and event_id % 5 < 2").select("user_id", F.concat(F.lit("img"), "event_id").alias("image"), F.when(F.col("event_id") % 5 == 0, "PREV").otherwise("said").alias("number"))
    return layout.assign_images(_paged(spark, sf_dir), "user_id", ["ts", "event_id"], "page", number, image, said).select("user_id", "image", "number")


def j3_known_images(spark, sf_dir):
    """As j3_images without explicit numbers; only clicks of even ids are items."""
    number = F.when(F.col("event_type") == "click", F.col("event_id").cast("string"))
    image = F.when(F.col("event_type") == "view", F.concat(F.lit("img"), "event_id"))
    known = _paged(spark, sf_dir).where("event_type = 'click' and event_id % 2 = 0").select("user_id", F.col("event_id").cast("string").alias("number"))
    return layout.assign_images(_paged(spark, sf_dir), "user_id", ["ts", "event_id"], "page", number, image, known=known).select("user_id", "image", "number")


def j4_intervals(spark, sf_dir):
    line = _t(spark, sf_dir, "lineitem")
    rows = line.where("l_linenumber <= 2").select("l_orderkey", F.col("l_quantity").alias("y")).distinct()
    points = line.where("l_linenumber > 2").select("l_orderkey", (F.col("l_quantity") + 0.5).alias("y"), F.concat(F.lit("i"), "l_partkey").alias("image"))
    return layout.assign_interval(rows, points, ["l_orderkey"], "y", "y")


def j5_boxes(spark, sf_dir):
    line = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_quantity").alias("y0")).agg(F.min("l_suppkey").cast("double").alias("x0"), F.max("l_partkey").cast("double").alias("x1"), F.max("l_linenumber").alias("k"))
    lines = line.withColumn("y1", F.col("y0") + 4)
    return layout.region_boxes(lines, ["l_orderkey"], F.when(F.col("k") <= 2, F.col("k")))


def j6_pages(spark, sf_dir):
    pages = _t(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).cast("int").alias("page"), "text")
    items = pages.select("conv_id", ((F.col("page") * 7) % 5 * 10 + F.col("page")).alias("at"), F.when(F.col("page") % 3 == 0, F.concat(F.substring("text", 5, 200), F.lit("?"))).when(F.col("page") % 3 == 1, F.substring("text", 3, 300)).otherwise("nowhere").alias("text"))
    return layout.locate_pages(items, pages, "conv_id", "at", "text")


QUERIES = {
    f.__name__: f
    for f in (c1_normalize, c3_cover_pages, c4_key_pages, c5_records, c6_inline, c7_absorb, c9_options, c10_option_lines, c11_matching, c12_continuations, c13_labels, c14_columns, c15_answers, c16_pairs, c16_attached, c17_paragraphs, c18_chapters, c18_ranges, c19_names, c20_focus, c21_slices, s14_assembled, j1_attach_answers, j3_images, j3_known_images, j4_intervals, j5_boxes, j6_pages)
}

_L = """l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS k FROM (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS a FROM documents))"""
_KEYED = "regexp_matches(lower(line), 'answer key|answer sheet|solutions|key:|answers:|point value')"
_BEFORE = f"b AS (SELECT * FROM l WHERE k < coalesce((SELECT min(k) FROM l x WHERE x.doc_id = l.doc_id AND {_KEYED}), 1000000))"
_PAGES = "pg AS (SELECT conv_id, turn + 1 AS page, role, trim(regexp_replace(regexp_replace(CASE WHEN role = 'user' THEN 'Chapter ' || turn || ': asked' || chr(10) ELSE '' END || coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), '[ \\t]+\\n', chr(10), 'g')) AS t FROM conversations)"
SQL = {
    "c1_normalize": "SELECT p_partkey, '2 ' || p_name || CASE WHEN p_size % 2 = 0 THEN ' fin (3 parts)' ELSE ' [1⁄2 pt] end (3 parts)' END AS text FROM part",
    "c3_cover_pages": f"""WITH {_L}, c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (length(line) > 20 AND k <= 999) AS real, count(*) FILTER (contains(line, '_____')) AS blanks FROM l GROUP BY 1)
        SELECT doc_id, (contains(lower(coalesce(text, '')), 'the ') OR contains(lower(coalesce(text, '')), 'que ')) AND (doc_id % 2 = 1 OR coalesce(real, 0) < 3) AND (coalesce(n, 0) < 25 OR blanks >= 3) AS cover FROM documents LEFT JOIN c USING (doc_id)""",
    "c4_key_pages": f"""WITH {_L}, c AS (SELECT doc_id, count(*) FILTER (length(line) < 60 AND k <= 999) AS short, bool_or({_KEYED}) AS word FROM l GROUP BY 1)
        SELECT doc_id, coalesce(word OR short >= 5, false) AS key FROM documents LEFT JOIN c USING (doc_id)""",
    "c5_records": f"WITH {_L}, {_BEFORE} SELECT doc_id, k::VARCHAR AS number, length(line)::INT AS n_chars FROM b WHERE length(line) > 8 AND k <= 999",
    "c6_inline": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '7. What is ' || p_name || '?|8. Which ' || p_brand || ' is it?|9) (A) ' || p_type ELSE '7. What is ' || p_name || '? 8. Which ' || p_brand || ' of 5. them' || p_type END AS lines FROM part",
    "c7_absorb": f"""WITH {_L}, {_BEFORE}, f AS (SELECT doc_id, sum(length(line) + 2 + length(k::VARCHAR) + 1) AS n FROM b WHERE k <= 25 GROUP BY 1)
        SELECT doc_id, '1' AS number, (27 + coalesce(n, 0))::INT AS n_chars FROM documents LEFT JOIN f USING (doc_id) UNION ALL SELECT doc_id, k::VARCHAR, length(line)::INT FROM b WHERE k > 25 AND k <= 999 AND length(line) > 8""",
    "c9_options": """SELECT p_partkey, 'What is ' || p_name || '?' || CASE WHEN p_size % 5 = 2 THEN ' b. ' || p_type || ' a. ' || p_brand ELSE '' END AS stem,
        CASE p_size % 5 WHEN 0 THEN 'A=' || p_brand || '|B=' || p_type || '|C=' || p_name WHEN 1 THEN 'A=' || p_brand || '|B=' || p_type || '|C=x' WHEN 3 THEN 'A=' || p_brand || '|C=' || p_type ELSE '' END AS choices FROM part""",
    "c10_option_lines": """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Pick ' || p_name WHEN 1 THEN '' WHEN 2 THEN 'b. ' || p_name || chr(10) || 'c. ' || p_brand ELSE p_name END AS stem,
        CASE p_size % 4 WHEN 0 THEN 'A=' || p_brand || ' wrapped|B=' || p_type WHEN 1 THEN 'A=' || p_name || '|B=' || p_brand || '|C=' || p_type ELSE '' END AS choices FROM part""",
    "c11_matching": "SELECT p_partkey, p_size % 2 = 0 AND (p_size % 9 + 1 + (p_size % 3 = 0)::INT > 6 OR p_size % 3 = 0) AS matching FROM part",
    "c12_continuations": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'lead|1. ' || p_brand || ' more|b) ' || p_type ELSE p_brand || '|' || p_type END AS merged FROM part",
    "c13_labels": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '1=lead|1=' || p_brand || ' more|B=' || p_type ELSE '1=' || p_brand || '|2=' || p_type END AS labelled FROM part",
    "c14_columns": """WITH d AS (SELECT DISTINCT l_orderkey, l_quantity AS x FROM lineitem), g AS (SELECT l_orderkey, x, lead(x) OVER (PARTITION BY l_orderkey ORDER BY x) - x AS gap FROM d),
        s AS (SELECT l_orderkey, arg_max(x + gap / 2, (gap, x)) AS split_x, max(gap) AS gap FROM g WHERE gap IS NOT NULL GROUP BY 1)
        SELECT l_orderkey, any_value(split_x) AS split_x FROM lineitem JOIN s USING (l_orderkey) WHERE gap >= 20 GROUP BY 1 HAVING count(*) >= 4 AND count(*) FILTER (l_quantity <= split_x) >= 2 AND count(*) FILTER (l_quantity > split_x) >= 2""",
    "c15_answers": f"""WITH {_L}, c AS (SELECT doc_id FROM l GROUP BY 1 HAVING count(*) FILTER (length(line) < 60) >= 5 OR bool_or({_KEYED}))
        SELECT doc_id, ((k - 1) % 7 + 1)::VARCHAR AS number, line AS answer FROM l WHERE doc_id IN (SELECT doc_id FROM c) AND length(line) <= 150 AND NOT ends_with(line, '?') AND NOT regexp_matches(line, '^(?i:question\\s+)?\\d{{1,3}}[.):](\\s|$)') AND NOT regexp_matches(line, '(?i)^\\(\\d+(\\.\\d+)?\\s*pts?\\b')
        QUALIFY row_number() OVER (PARTITION BY doc_id, (k - 1) % 7 ORDER BY k DESC) = 1""",
    "c16_attached": """SELECT p_brand || '/' || p_partkey // 1000 AS doc, (p_partkey % 1000)::VARCHAR AS number, CASE WHEN p_size % 11 = 0 THEN '1Z' WHEN p_size % 5 = 0 OR p_size % 3 = 0 THEN ''
        WHEN p_size % 7 = 0 THEN CASE WHEN p_size % 4 = 0 THEN '1A,2C' ELSE '' END WHEN p_size % 4 > 0 THEN '1A,2C,3B' ELSE '1C,2B,3A' END AS pairs FROM part""",
    "c16_pairs": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_size % 7 > 0 THEN '1A,2C,3B' ELSE '' END AS pairs FROM part",
    "c17_paragraphs": """WITH RECURSIVE w AS (SELECT doc_id, replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) AS t FROM documents),
        a AS (SELECT doc_id, regexp_split_to_array(t, '\\n{2,}') AS p FROM w WHERE length(t) > 900),
        r AS (SELECT doc_id, 1 AS i, length(p[1]) + 2 AS used, 0 AS chunk_no, length(p[1]) AS n FROM a
            UNION ALL SELECT r.doc_id, i + 1, CASE WHEN used + length(p[i + 1]) > 900 THEN length(p[i + 1]) ELSE used + length(p[i + 1]) + 2 END,
            CASE WHEN used + length(p[i + 1]) > 900 THEN chunk_no + 1 ELSE chunk_no END, length(p[i + 1]) FROM r JOIN a USING (doc_id) WHERE i < len(p))
        SELECT doc_id, chunk_no, (sum(n) + 2 * (count(*) - 1))::INT AS n_chars FROM r GROUP BY ALL UNION ALL SELECT doc_id, 0, length(t)::INT FROM w WHERE length(t) <= 900""",
    "c18_chapters": "SELECT conv_id, 'Chapter ' || turn || ': asked' AS title, (turn + 1)::INT AS start_page FROM conversations WHERE role = 'user'",
    "c18_ranges": """SELECT conv_id, (row_number() OVER w - 1)::INT AS chapter_no, 'Unit x' AS title, (turn + 1)::INT AS start_page,
        greatest(coalesce(lead(turn) OVER w, (SELECT max(turn) + 1 FROM conversations c WHERE c.conv_id = conversations.conv_id)), turn + 1)::INT AS end_page FROM conversations WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "c19_names": """SELECT o_orderkey, year(o_orderdate)::VARCHAR AS year, CASE WHEN o_orderkey % 3 > 0 THEN 'B' ELSE '?' END AS division,
        CASE WHEN o_orderkey % 3 > 0 THEN lower(o_orderpriority) || ' state' ELSE '' END AS label FROM orders""",
    "c20_focus": "SELECT p_partkey, p_brand AS event, CASE WHEN p_size % 2 = 0 THEN p_type || ' - ' || p_name ELSE '' END AS focus FROM part",
    "c21_slices": """WITH c AS (SELECT DISTINCT conv_id, n AS chapter_no, CASE n WHEN 0 THEN 0 ELSE 1 END AS a, CASE n WHEN 0 THEN 1 ELSE 9 END AS b FROM conversations, range(2) r(n))
        SELECT conv_id, chapter_no::INT AS chapter_no, length(trim(string_agg(text, chr(10) || chr(10) ORDER BY turn)))::INT AS n_chars FROM conversations JOIN c USING (conv_id) WHERE turn BETWEEN a AND b GROUP BY ALL""",
    "s14_assembled": f"WITH {_PAGES} SELECT conv_id, count(*)::INT AS n_pages, (sum(8 + length(page::VARCHAR) + 2 + length(t)) + 2 * (count(*) - 1))::INT AS n_chars FROM pg WHERE t <> '' GROUP BY 1",
    "j1_attach_answers": """WITH i AS (SELECT o_custkey AS doc, o_orderkey, o_orderkey::VARCHAR || CASE WHEN o_orderkey % 97 = 0 THEN 'b' ELSE '' END AS number, CASE WHEN o_orderstatus = 'P' THEN 'matching' END AS qtype FROM orders),
        a AS (SELECT l_orderkey, max(l_returnflag) AS answer FROM lineitem WHERE l_linenumber > 1 GROUP BY l_orderkey, l_linenumber QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = 1)
        SELECT doc, number, qtype, CASE WHEN qtype IS NULL AND doc NOT IN (SELECT doc FROM i WHERE ends_with(number, 'b')) THEN coalesce(answer, '') ELSE '' END AS answer FROM i LEFT JOIN a ON l_orderkey = o_orderkey""",
    "j3_images": """WITH e AS (SELECT *, CASE WHEN event_type = 'click' THEN event_id END AS c, ts::DATE AS page FROM events),
        r AS (SELECT *, last_value(c IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS own,
            last_value(c IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY page RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS prev_any FROM e),
        p AS (SELECT user_id, page, (SELECT arg_max(x.c, (x.ts, x.event_id)) FROM e x WHERE x.user_id = d.user_id AND x.page < d.page AND x.c IS NOT NULL) AS prev FROM (SELECT DISTINCT user_id, page FROM e) d)
        SELECT user_id, 'img' || event_id AS image, CASE event_id % 5 WHEN 0 THEN prev::VARCHAR WHEN 1 THEN 'said' ELSE own::VARCHAR END AS number FROM r JOIN p USING (user_id, page) WHERE event_type = 'view'""",
    "j3_known_images": """WITH r AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts::DATE, ts, event_id ROWS UNBOUNDED PRECEDING) AS c FROM events)
        SELECT user_id, 'img' || event_id AS image, c::VARCHAR AS number FROM r WHERE event_type = 'view' AND c % 2 = 0""",
    "j4_intervals": """WITH r AS (SELECT DISTINCT l_orderkey, l_quantity AS y FROM lineitem WHERE l_linenumber <= 2), s AS (SELECT *, lead(y) OVER (PARTITION BY l_orderkey ORDER BY y) AS z FROM r),
        p AS (SELECT l_orderkey, l_quantity + 0.5 AS q, 'i' || l_partkey AS image FROM lineitem WHERE l_linenumber > 2)
        SELECT s.l_orderkey, y, min_by(image, (q, image)) AS image FROM s LEFT JOIN p ON p.l_orderkey = s.l_orderkey AND q >= y AND (z IS NULL OR q < z) GROUP BY ALL""",
    "j5_boxes": """WITH l AS (SELECT l_orderkey, l_quantity AS y, min(l_suppkey)::DOUBLE AS x0, max(l_partkey)::DOUBLE AS x1, max(l_linenumber) AS k FROM lineitem GROUP BY ALL),
        a AS (SELECT l_orderkey, y, k AS number, lead(y) OVER (PARTITION BY l_orderkey ORDER BY y) AS z FROM l WHERE k <= 2)
        SELECT a.l_orderkey, number, min(l.x0) AS x0, a.y AS y0, max(l.x1) AS x1, least(max(l.y) + 4, any_value(z)) AS y1 FROM a JOIN l ON l.l_orderkey = a.l_orderkey AND l.y >= a.y AND (z IS NULL OR l.y < z) GROUP BY a.l_orderkey, number, a.y""",
    "j6_pages": """WITH RECURSIVE p AS (SELECT conv_id, (turn + 1)::INT AS page, text FROM conversations),
        i AS (SELECT conv_id, page * 7 % 5 * 10 + page AS place, substr(trim(substr(CASE page % 3 WHEN 0 THEN substr(text, 5, 200) || '?' WHEN 1 THEN substr(text, 3, 300) ELSE 'nowhere' END, 1, 40)), 1, 25) AS needle FROM p),
        h AS (SELECT i.conv_id, place, row_number() OVER (PARTITION BY i.conv_id ORDER BY place) AS k, list_sort((SELECT list(page) FROM p WHERE p.conv_id = i.conv_id AND needle <> '' AND contains(text, needle))) AS hits FROM i),
        r AS (SELECT conv_id, place, k, coalesce(hits[1], 1) AS page FROM h WHERE k = 1
            UNION ALL SELECT h.conv_id, h.place, h.k, coalesce(list_filter(hits, lambda x: x >= r.page)[1], hits[1], r.page) FROM r JOIN h ON h.conv_id = r.conv_id AND h.k = r.k + 1)
        SELECT conv_id, place::INT AS "at", page FROM r""",
}
