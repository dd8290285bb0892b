"""Registered queries of reports, pools, samples, numbers, keys and similarity, and the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import items, lookup, reports, similar
from corvane.operators.dedup import hashed_shingles
from corvane.sources import bank


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _items(spark, sf_dir):
    """Parts as items: the brand is the document, some of them generated or scraped."""
    size = F.col("p_size")
    doc = F.concat(F.when(size % 5 == 0, "_generated_").when(size % 5 == 1, "_scraped_").otherwise(""), "p_brand")
    return _t(spark, sf_dir, "part").select(
        doc.alias("doc"), F.col("p_partkey").alias("number"), F.col("p_type").alias("topic"), F.col("p_name").alias("text"), F.when(size % 3 == 0, F.array("p_name", "p_type")).alias("choices"),
        F.when(size % 4 == 0, F.array(F.lit("i.png"))).alias("images"), F.when(size % 7 == 0, "matching").when(size % 7 == 1, "mcq").alias("qtype"), F.when(size % 6 == 0, F.create_map(F.lit("1"), F.lit("A"))).alias("pairs"),
        F.when(size % 2 == 0, "A").when(size % 11 == 0, " ").alias("answer"), F.when(size % 3 == 1, "correct").when(size % 3 == 2, "uncertain").alias("status"), F.when(size % 8 == 0, F.col("p_partkey") % 3).alias("context_id"),
    )


def p1_item_flags(spark, sf_dir):
    meta = _t(spark, sf_dir, "part").where("p_size = 10").groupBy(F.concat(F.lit("_generated_"), "p_brand").alias("doc")).agg(F.max("p_partkey").alias("edited_at"))
    out = reports.item_flags(_items(spark, sf_dir), meta, "doc")
    return out.select("number", "is_mcq", "is_matching", "has_image", "is_synthetic", "status", "context_key", "doc_edited_at")


def p3_practice_pool(spark, sf_dir):
    return reports.practice_pool(_items(spark, sf_dir), kind="mcq", origin="pdf").select("number")


def p3_matching_pool(spark, sf_dir):
    return reports.practice_pool(_items(spark, sf_dir), topic="PROMO", kind="matching").select("number")


def p4_builder_page(spark, sf_dir):
    kept = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 30").select(F.col("l_partkey").alias("number"))
    return reports.builder_pool(_items(spark, sf_dir), ["number"], kept, search="RED", topic="SMALL").select("number", "text")


def p5_attention(spark, sf_dir):
    return reports.needs_attention(a2_doc_status(spark, sf_dir))


def p7_clean_items(spark, sf_dir):
    size = F.col("p_size")
    raw = _t(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("text"), F.lit(" a ").alias("answer"), F.when(size % 3 > 0, F.col("p_type")).otherwise(F.lit(" ")).alias("topic"), F.array(F.struct(F.lit(" a").alias("letter"), F.col("p_type").alias("text")), F.struct(F.lit("b").alias("letter"), F.when(size % 2 == 0, "x").otherwise(" ").alias("text"))).alias("choices"), F.when(size % 4 == 0, "x1").otherwise(F.concat(F.lit(" "), size.cast("string"))).alias("page"))
    out = reports.clean_items(raw)
    return out.select("p_partkey", "text", "answer", "topic", F.array_join(F.transform("choices", lambda c: F.concat(c["letter"], F.lit("="), c["text"])), "|").alias("choices"), "page")


def p9_pair_verdicts(spark, sf_dir):
    line = _t(spark, sf_dir, "lineitem")
    pairs = line.groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_linenumber") > 1, F.col("l_returnflag") != "A")).alias("pairs"))
    return pairs.select("l_orderkey", reports.pair_verdict(F.col("pairs")).alias("verdict"))


def _customer_files(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))


def a2_doc_status(spark, sf_dir):
    return reports.doc_status(_customer_files(spark, sf_dir), _t(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderpriority").startswith("1"), F.col("o_orderstatus") == "F")


def a2_status_page(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    edited, keyed = orders.where("o_orderstatus = 'P'"), _customer_files(spark, sf_dir).where("o_custkey % 3 = 0")
    return reports.status_page(a2_doc_status(spark, sf_dir), edited, keyed, "o_custkey", "questions", True)


def _collection_page(spark, sf_dir, coach) -> tuple[DataFrame, DataFrame]:
    nations = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("slug"), F.when(F.col("n_nationkey") % 5 > 0, F.col("n_nationkey") % 5 == 4).alias("archived"))
    files = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("slug"), "s_acctbal")
    allowed = _t(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("slug"))
    return reports.collection_page(a3_collections(spark, sf_dir), nations, files, "slug", "archived", F.col("s_acctbal") > 2000, coach, allowed)


def a3_coach_page(spark, sf_dir):
    rows, archived = _collection_page(spark, sf_dir, True)
    return rows.select("slug", "items", "files").unionByName(archived, allowMissingColumns=True)


def a3_helper_page(spark, sf_dir):
    rows, archived = _collection_page(spark, sf_dir, False)
    return rows.select("slug", "items", "files").unionByName(archived, allowMissingColumns=True)


def a6_outline(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("f"), (F.col("doc_id") % 7).cast("string"))).otherwise("").alias("focus"), "lang")
    return reports.focus_outline(docs, F.col("focus"), F.col("lang"), ["f5", "f1", "f3", "f9"], ["fr", "de", "xx"])


def a3_collections(spark, sf_dir):
    items = _items(spark, sf_dir).withColumn("slug", (F.col("number") % 30).cast("int"))
    files = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("slug"), "s_acctbal")
    return reports.collection_summary(_t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("slug")), items, files, "slug", "doc", F.col("s_acctbal") > 1000)


def a4_taxonomy_counts(spark, sf_dir):
    return reports.topic_counts(_t(spark, sf_dir, "part"), F.col("p_type"), ["LARGE", "ECONOMY", "Unused", "SMALL"])


def a6_nested_counts(spark, sf_dir):
    return reports.nested_counts(_t(spark, sf_dir, "documents"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).otherwise(" "), F.col("lang"))


def a11_token_cost(spark, sf_dir):
    usage = _t(spark, sf_dir, "events").select("event_type", F.floor("value").cast("long").alias("input_tokens"), (F.col("event_id") % 100).alias("output_tokens"))
    return reports.usage_cost(usage, "event_type", F.when(F.col("event_type").startswith("c"), 300.0).otherwise(100.0), F.lit(1500.0))


def a12_conversation_cost(spark, sf_dir):
    return reports.estimate_cost(_t(spark, sf_dir, "conversations"), "conv_id", F.col("text"), 200, 3.0, 15.0)


def _jobs(spark, sf_dir):
    return _t(spark, sf_dir, "events").select((F.col("event_id") % 700).alias("job"), (F.col("event_id") % 700 % 9).alias("slug"), "ts", "event_id", F.col("event_type").alias("status"))


def r3_latest_jobs(spark, sf_dir):
    return reports.latest_jobs(_jobs(spark, sf_dir), "job", "slug", ["ts", "event_id"], "ts", 20).select("job", "slug", "status", "rank")


def a13_active_jobs(spark, sf_dir):
    latest = reports.latest_jobs(_jobs(spark, sf_dir), "job", "slug", ["ts", "event_id"], "ts", 10**6)
    return reports.active_jobs(latest, "slug", F.col("status").isin("click", "view"), _t(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("slug")))


def a14_over_quota(spark, sf_dir):
    latest = reports.latest_jobs(_jobs(spark, sf_dir), "job", "slug", ["ts", "event_id"], "ts", 10**6)
    return reports.over_quota(latest, "slug", F.col("status").isin("click", "view"), 30)


def w6_interrupted(spark, sf_dir):
    latest = reports.latest_jobs(_jobs(spark, sf_dir), "job", "slug", ["ts", "event_id"], "ts", 10**6)
    return reports.interrupted(latest, F.col("status") == "click", F.col("ts"), F.lit("2024-01-31").cast("timestamp"), 3 * 86_400).select("job", "status", "interrupted")


def a15_import_report(spark, sf_dir):
    return reports.import_report(_t(spark, sf_dir, "events"), ["user_id"], "event_type", ["view", "error"])


def _log(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("e")).select("user_id", F.posexplode("e").alias("k", "e")).select("user_id", (F.col("k") + 1).alias("line_no"), F.col("e").cast("string").alias("line"))


def r4_truncated_log(spark, sf_dir):
    return reports.truncate_log(_log(spark, sf_dir), "user_id", "line_no", "line", 40).withColumn("line", F.regexp_replace("line", "^… ", "... "))


def r4_log_tail(spark, sf_dir):
    return reports.log_tail(_log(spark, sf_dir), "user_id", "line_no", 60)


def r5_sample(spark, sf_dir):
    return reports.sample_n(_items(spark, sf_dir).where("status = 'correct'"), "number", 25, 4).select("number")


def r6_group_sample(spark, sf_dir):
    """User turns as the pool, two conversations of three being groups, whose long other turns come along."""
    turns = _t(spark, sf_dir, "conversations").withColumns({"g": F.when(F.col("conv_id") % 3 > 0, F.col("conv_id")), "k": F.col("conv_id") * 1000 + F.col("turn")})
    return reports.sample_groups(turns.where("role = 'user'"), turns, "g", "k", 60, 4, F.length("text") > 150).select("k")


def r2_clusters(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    context = F.when(F.col("o_orderstatus") != "P", F.concat_ws("::", F.col("o_custkey"), F.col("o_orderstatus")))
    return reports.cluster_contexts(rows, "o_orderkey", context).select("o_orderkey", "anchor", "within")


def r1_blank_years(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").withColumn("year", F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate")))
    topic, *within = reports.bank_order("o_orderpriority", "year", "o_orderkey")
    return items.running_number(rows, [topic], within).select("o_orderkey", "running")


def r8_page(spark, sf_dir):
    return _items(spark, sf_dir).where("topic = 'PROMO'").orderBy("number").limit(100).select("number", "topic")


def k2_numbers(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return reports.assign_numbers(orders, F.lit(501), F.floor(F.col("o_orderkey") / 1000), ["o_orderkey"]).select("o_orderkey", "number")


def k3_canonical(spark, sf_dir):
    size = F.col("p_size")
    options = F.when(size % 3 > 0, F.array("p_name", F.when(size % 3 == 1, "").otherwise(F.col("p_brand")), "p_type"))
    item = reports.canonical_item(options, F.array((size % 4).cast("int"), F.lit(0)), F.array("p_brand"))
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(item["choices"], lambda c: F.concat(c["letter"], F.lit("="), c["text"])), "|").alias("choices"), item["answer"].alias("answer"))


def k4_unique_keys(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select("p_partkey", "p_name")
    existing = _t(spark, sf_dir, "part").where("p_size = 3").select(F.concat(F.regexp_replace("p_name", " ", ""), F.when(F.col("p_partkey") % 2 == 0, (F.col("p_partkey") % 50 + 2).cast("string")).otherwise("")).alias("username")).distinct()
    return reports.unique_keys(rows, "p_name", "p_partkey", existing, "username").select("p_partkey", "username")


def _keywords(spark, sf_dir):
    """Every benchmark item is a topic: its words of six letters or more are its phrases, weighed by their first place."""
    words = _t(spark, sf_dir, "benchmark").select(F.col("item_id").cast("int").alias("topic_ord"), F.posexplode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0)))).alias("k", "phrase"))
    return words.select(F.concat(F.lit("topic "), "topic_ord").alias("topic"), "topic_ord", "phrase", (F.col("k") % 3 + 1).alias("weight"))


def a5_table(spark, sf_dir):
    return lookup.classify_by_table(_t(spark, sf_dir, "documents").select("doc_id", "text"), "text", _keywords(spark, sf_dir)).select("doc_id", "topic")


def j16_price_table(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    prices = part.where("p_partkey % 7 = 0").select(F.expr("left(p_name, 2 + p_partkey % 6)").alias("prefix"), F.col("p_partkey").alias("ord"), F.col("p_size").cast("double").alias("price_in"), F.lit(0.5).alias("price_out"))
    return lookup.price_by_table(part.select("p_partkey", "p_name"), "p_name", prices, {"price_in": 1.5, "price_out": 7.5}).select("p_partkey", "price_in", "price_out")


def d3_similar_pairs(spark, sf_dir):
    return similar.similar_pairs(_t(spark, sf_dir, "documents"), "doc_id", "text", 40).select("a", "b", F.round("similarity", 6).alias("similarity"))


def d3_jaccard(spark, sf_dir):
    # made before they meet, so that an item's set is made once and not for each document
    sets = lambda name, key, s: _t(spark, sf_dir, name).select(key, hashed_shingles(F.col("text")).alias(s))
    both = sets("documents", "doc_id", "s").join(sets("benchmark", "item_id", "other"), F.col("doc_id") % 40 == F.col("item_id"))
    return both.select("doc_id", F.round(similar.jaccard(F.col("s"), F.col("other")), 6).alias("similarity"))


def d5_greedy(spark, sf_dir):
    return similar.dedup_greedy(_t(spark, sf_dir, "documents").select("doc_id", "text"), _t(spark, sf_dir, "benchmark"))


def d6_taken(spark, sf_dir):
    judged = d5_greedy(spark, sf_dir).join(_t(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    taken, rejected = similar.take_kept(judged, F.col("lang"), 300)
    return taken.select("doc_id", F.lit("taken").alias("outcome")).union(rejected.select("doc_id", F.lit("rejected")))


def d6_quotas(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    known = docs.where("doc_id % 7 = 0").select("doc_id")
    taken, rejected, skipped = similar.collect_kept(docs, "doc_id", "lang", "doc_id", "text", ["fr", "en", "de"], 45, known, _t(spark, sf_dir, "benchmark"))
    label = lambda found, outcome: found.select("doc_id", "lang", F.lit(outcome).alias("outcome"))
    return label(taken, "taken").union(label(rejected, "rejected")).union(label(skipped, "skipped"))


def s7_imported(spark, sf_dir):
    k, topics = F.col("doc_id"), F.concat(F.lit("topic "), (F.col("doc_id") % 40).cast("string"))
    topic = F.when(k % 3 == 0, topics).when(k % 3 == 1, "unknown")
    choices = F.when(k % 4 == 0, F.array(*[F.struct(F.lit(letter).alias("letter"), F.lit(text).alias("text")) for letter, text in (("c", "(2 pts) one"), ("a", " "), ("b", "two"))]))
    item = F.to_json(F.struct("text", topic.alias("topic"), choices.alias("choices"), F.when(k % 5 == 0, " as said ").alias("rationale")))
    raw = F.when(k % 2 == 0, F.concat(F.lit("["), item, F.lit("]"))).otherwise(F.concat(F.lit('{"candidates": ['), item, F.lit("]}")))
    bank_ = _t(spark, sf_dir, "benchmark").select("item_id", "text")
    items, rejected, _, _ = bank.import_candidates(_t(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")), "doc_id", "raw", bank_, _keywords(spark, sf_dir), 1001)
    shown = F.array_join(F.transform("choices", lambda c: F.concat(c["letter"], F.lit("="), c["text"])), "|")
    added = items.select("doc_id", F.lit("added").alias("outcome"), F.col("number").cast("long").alias("number"), "topic", "type", shown.alias("choices"), F.col("validation.rationale").alias("rationale"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("number", "long"), ("topic", "string"), ("type", "string"), ("choices", "string"), ("rationale", "string"))]
    return added.union(rejected.select("doc_id", "outcome", *none))


QUERIES = {
    f.__name__: f
    for f in (d6_quotas, s7_imported, p1_item_flags, p3_practice_pool, p3_matching_pool, p4_builder_page, p5_attention, p7_clean_items, p9_pair_verdicts, a2_doc_status, a3_collections, a4_taxonomy_counts, a6_nested_counts, a11_token_cost, a12_conversation_cost, a13_active_jobs, a14_over_quota, a15_import_report, r1_blank_years, r2_clusters, r3_latest_jobs, r4_truncated_log, r4_log_tail, r5_sample, r6_group_sample, r8_page, k2_numbers, k3_canonical, k4_unique_keys, a2_status_page, a3_coach_page, a3_helper_page, a6_outline, a5_table, j16_price_table, d3_similar_pairs, d3_jaccard, d5_greedy, d6_taken, w6_interrupted)
}

_I = """i AS (SELECT CASE p_size % 5 WHEN 0 THEN '_generated_' WHEN 1 THEN '_scraped_' ELSE '' END || p_brand AS doc, p_partkey AS number, p_type AS topic, p_name AS text, p_size % 3 = 0 AS mcq, p_size % 4 = 0 AS img,
    CASE p_size % 7 WHEN 0 THEN 'matching' WHEN 1 THEN 'mcq' END AS qtype, p_size % 6 = 0 AS pairs, p_size % 2 = 0 AS answered, CASE p_size % 3 WHEN 1 THEN 'correct' WHEN 2 THEN 'uncertain' END AS status, CASE WHEN p_size % 8 = 0 THEN p_partkey % 3 END AS context_id FROM part)"""
_J = "j AS (SELECT event_id % 700 AS job, event_id % 700 % 9 AS slug, ts, event_type AS status FROM events QUALIFY row_number() OVER (PARTITION BY event_id % 700 ORDER BY ts DESC, event_id DESC) = 1)"
_G = """w AS (SELECT {id} AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {table}), {s} AS (SELECT id, list_distinct(CASE WHEN len(w) < 3 THEN w ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w)"""
_DG, _BG = _G.format(id="doc_id", table="documents", s="s"), _G.format(id="item_id", table="benchmark", s="bs").replace("w AS (SELECT item_id", "bw AS (SELECT item_id").replace("FROM w)", "FROM bw)")
_PAIRS = """e AS (SELECT id, len(s) AS n, unnest(s) AS g FROM s), pr AS (SELECT a.id AS a, b.id AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS sim FROM e a JOIN e b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id HAVING 100 * count(*) >= 40 * (any_value(a.n) + any_value(b.n) - count(*)))"""
_GREEDY = f"""WITH RECURSIVE {_DG}, {_BG}, {_PAIRS}, f AS (SELECT id, len(s) AS n, unnest(s) AS g FROM bs),
    bk AS (SELECT d.doc_id, min(m.item) AS matched FROM documents d JOIN (SELECT e.id AS id, f.id AS item FROM e JOIN f USING (g) GROUP BY e.id, f.id HAVING 100 * count(*) >= 40 * (any_value(e.n) + any_value(f.n) - count(*))) m ON m.id = d.doc_id WHERE length(trim(coalesce(text, ''))) >= 12 GROUP BY 1),
    o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM documents WHERE length(trim(coalesce(text, ''))) >= 12 AND doc_id NOT IN (SELECT doc_id FROM bk)),
    nb AS (SELECT y.k AS k, list(x.k) AS before FROM pr JOIN o x ON x.doc_id = a JOIN o y ON y.doc_id = b GROUP BY y.k),
    g AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept UNION ALL SELECT g.k + 1, CASE WHEN len(list_intersect(coalesce(before, []), kept)) > 0 THEN kept ELSE list_append(kept, g.k + 1) END FROM g LEFT JOIN nb ON nb.k = g.k + 1 WHERE g.k < (SELECT max(k) FROM o)),
    kp AS (SELECT unnest(kept) AS k FROM g WHERE k = (SELECT max(k) FROM o)),
    mt AS (SELECT y.doc_id, min(a) AS matched FROM pr JOIN o x ON x.doc_id = a JOIN kp ON kp.k = x.k JOIN o y ON y.doc_id = b WHERE y.k NOT IN (SELECT k FROM kp) GROUP BY 1),
    j AS (SELECT d.doc_id, d.lang, CASE WHEN length(trim(coalesce(text, ''))) < 12 THEN 'too short' WHEN bk.doc_id IS NOT NULL THEN 'bank' WHEN mt.doc_id IS NOT NULL THEN 'batch' END AS reason, coalesce(bk.matched, mt.matched) AS matched FROM documents d LEFT JOIN bk USING (doc_id) LEFT JOIN mt USING (doc_id))"""
SQL = {
    "p1_item_flags": f"""WITH {_I}, m AS (SELECT '_generated_' || p_brand AS doc, max(p_partkey) AS edited FROM part WHERE p_size = 10 GROUP BY 1)
        SELECT number, mcq AS is_mcq, coalesce(qtype = 'matching', false) AS is_matching, img AS has_image, starts_with(doc, '_') AS is_synthetic, coalesce(status, 'unvalidated') AS status, doc || '::' || context_id AS context_key, edited AS doc_edited_at FROM i LEFT JOIN m USING (doc)""",
    "p3_practice_pool": f"WITH {_I} SELECT number FROM i WHERE coalesce(qtype, '') <> 'matching' AND mcq AND answered AND doc NOT LIKE '\\_%' ESCAPE '\\'",
    "p3_matching_pool": f"WITH {_I} SELECT number FROM i WHERE qtype = 'matching' AND pairs AND topic = 'PROMO'",
    "p4_builder_page": f"WITH {_I} SELECT number, text FROM i WHERE status = 'correct' AND contains(text, 'red') AND topic = 'SMALL' AND number NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 30) ORDER BY number LIMIT 100",
    "p5_attention": """SELECT c_custkey AS o_custkey, count(o_orderkey) AS items, count(*) FILTER (starts_with(o_orderpriority, '1')) AS images, count(*) FILTER (o_orderstatus = 'F') AS answers, count(o_orderkey) > 0 AS processed
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(o_orderkey) = 0 OR count(*) FILTER (o_orderstatus = 'F') < 0.3 * count(o_orderkey)""",
    "p7_clean_items": """SELECT p_partkey, p_name AS text, 'a' AS answer, CASE WHEN p_size % 3 > 0 THEN p_type ELSE 'Other / General' END AS topic, 'A=' || p_type || CASE WHEN p_size % 2 = 0 THEN '|B=x' ELSE '' END AS choices, CASE WHEN p_size % 4 > 0 THEN p_size END AS page FROM part""",
    "p9_pair_verdicts": "SELECT l_orderkey, CASE WHEN count(*) FILTER (l_linenumber > 1) = 0 THEN 'uncertain' WHEN count(*) FILTER (l_linenumber > 1 AND l_returnflag = 'A') = 0 THEN 'correct' ELSE 'incorrect' END AS verdict FROM lineitem GROUP BY 1",
    "a2_doc_status": "SELECT c_custkey AS o_custkey, count(o_orderkey) AS items, count(*) FILTER (starts_with(o_orderpriority, '1')) AS images, count(*) FILTER (o_orderstatus = 'F') AS answers, count(o_orderkey) > 0 AS processed FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "a3_collections": f"""WITH {_I}, d AS (SELECT number % 30 AS slug, doc, count(*) AS n FROM i GROUP BY ALL)
        SELECT n_nationkey AS slug, (SELECT count(*) FROM d WHERE slug = n_nationkey) AS docs, (SELECT coalesce(sum(n), 0)::BIGINT FROM d WHERE slug = n_nationkey) AS items, (SELECT count(*) FROM d WHERE slug = n_nationkey AND doc[1] <> '_') AS processed,
        (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal <= 1000) AS unrecognized FROM nation""",
    "a4_taxonomy_counts": "SELECT k::INT AS topic_ord, t AS topic, (SELECT count(*) FROM part WHERE CASE WHEN p_type IN ('LARGE', 'ECONOMY', 'SMALL') THEN p_type ELSE 'Other / General' END = t) AS n FROM (VALUES (0, 'LARGE'), (1, 'ECONOMY'), (2, 'Unused'), (3, 'SMALL'), (4, 'Other / General')) v(k, t)",
    "a6_nested_counts": "SELECT focus, lang AS topic, count(*) AS n FROM (SELECT CASE WHEN doc_id % 3 > 0 THEN source ELSE '(no focus)' END AS focus, lang FROM documents) GROUP BY ROLLUP (focus, lang)",
    "a11_token_cost": "SELECT event_type, count(*) AS calls, sum(floor(value))::BIGINT AS input_tokens, sum(event_id % 100)::BIGINT AS output_tokens, round(sum(floor(value) * CASE WHEN starts_with(event_type, 'c') THEN 300.0 ELSE 100.0 END + event_id % 100 * 1500.0)::DOUBLE / 1000000, 4) AS cost FROM events GROUP BY 1",
    "a12_conversation_cost": "SELECT conv_id, greatest(1, sum(length(coalesce(text, ''))) // 4)::BIGINT AS input_tokens, 200::BIGINT AS output_tokens, round((greatest(1, sum(length(coalesce(text, ''))) // 4) * 3.0 + 3000)::DOUBLE / 1000000, 6) AS cost FROM conversations GROUP BY 1",
    "a13_active_jobs": f"WITH {_J} SELECT n_nationkey::BIGINT AS slug, (SELECT count(*) FROM j WHERE slug = n_nationkey AND status IN ('click', 'view')) AS active FROM nation WHERE n_regionkey = 1",
    "a14_over_quota": f"WITH {_J} SELECT slug, count(*) AS active FROM j WHERE status IN ('click', 'view') GROUP BY 1 HAVING count(*) >= 30",
    "w6_interrupted": f"WITH {_J} SELECT job, status, status = 'click' AND ts < TIMESTAMP '2024-01-28' AS interrupted FROM j",
    "a15_import_report": "SELECT user_id, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type NOT IN ('view', 'error')) AS other FROM events GROUP BY 1",
    "r1_blank_years": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, CASE WHEN o_orderstatus <> 'P' THEN -year(o_orderdate) ELSE 0 END, o_orderkey::VARCHAR) AS running FROM orders",
    "r2_clusters": """WITH c AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey || '::' || o_orderstatus END AS c FROM orders)
        SELECT o_orderkey, CASE WHEN c IS NULL THEN o_orderkey ELSE min(o_orderkey) OVER (PARTITION BY c) END AS anchor, CASE WHEN c IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY c ORDER BY o_orderkey) END::INT AS within FROM c""",
    "r3_latest_jobs": f"WITH {_J} SELECT job, slug, status, (row_number() OVER (PARTITION BY slug ORDER BY ts DESC, job DESC))::INT AS rank FROM j QUALIFY rank <= 20",
    "r4_truncated_log": """WITH l AS (SELECT user_id, event_id::VARCHAR AS line, (row_number() OVER (PARTITION BY user_id ORDER BY event_id))::INT AS line_no, (count(*) OVER (PARTITION BY user_id))::INT AS n FROM events)
        SELECT user_id, line_no, line FROM l WHERE line_no > n - 40 UNION ALL SELECT DISTINCT user_id, n - 40, '... ' || (n - 40) || ' earlier lines dropped' FROM l WHERE n > 40""",
    "r4_log_tail": "SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id))::INT AS line_no, event_id::VARCHAR AS line FROM events QUALIFY line_no > 60",
    "r5_sample": f"WITH {_I} SELECT number FROM i WHERE status = 'correct' ORDER BY md5('4:' || number), number LIMIT 25",
    "r6_group_sample": """WITH t AS (SELECT role, CASE WHEN conv_id % 3 > 0 THEN 'g' || conv_id ELSE 's' || (conv_id * 1000 + turn) END AS name, conv_id % 3 > 0 AS grouped, conv_id * 1000 + turn AS k, length(text) > 150 AS answered FROM conversations),
        m AS (SELECT name, k FROM t WHERE role = 'user' UNION ALL SELECT name, k FROM t WHERE role <> 'user' AND grouped AND answered AND name IN (SELECT name FROM t WHERE role = 'user')),
        z AS (SELECT name, count(*) AS n FROM m GROUP BY 1), b AS (SELECT name, sum(n) OVER (ORDER BY md5('4:' || name), name) - n AS before FROM z)
        SELECT k FROM m WHERE name IN (SELECT name FROM b WHERE before < 60)""",
    "r8_page": "SELECT p_partkey AS number, p_type AS topic FROM part WHERE p_type = 'PROMO' ORDER BY 1 LIMIT 100",
    "k2_numbers": "SELECT o_orderkey, 500 + row_number() OVER (ORDER BY o_orderkey) AS number FROM orders WHERE o_orderstatus = 'F'",
    "k3_canonical": """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'A=' || p_name || '|C=' || p_type ELSE 'A=' || p_name || '|B=' || p_brand || '|C=' || p_type END AS choices,
        CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN CASE p_size % 4 WHEN 0 THEN 'A, A' WHEN 1 THEN 'C, A' ELSE 'A' END ELSE CASE p_size % 4 WHEN 0 THEN 'A, A' WHEN 1 THEN 'B, A' WHEN 2 THEN 'C, A' ELSE 'A' END END AS answer FROM part""",
    "k4_unique_keys": """WITH b AS (SELECT p_partkey, replace(p_name, ' ', '') AS base, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part),
        x AS (SELECT DISTINCT replace(p_name, ' ', '') || CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 50 + 2)::VARCHAR ELSE '' END AS u FROM part WHERE p_size = 3),
        f AS (SELECT base, k, row_number() OVER (PARTITION BY base ORDER BY k) AS nth FROM (SELECT DISTINCT base FROM b), range(2, 2000) t(k) WHERE base || k NOT IN (SELECT u FROM x)),
        n AS (SELECT *, base NOT IN (SELECT u FROM x) AS open FROM b)
        SELECT p_partkey, CASE WHEN open AND r = 1 THEN n.base ELSE n.base || k END AS username FROM n LEFT JOIN f ON f.base = n.base AND f.nth = n.r - open::INT""",
    "a2_status_page": """SELECT c_custkey AS o_custkey, count(o_orderkey) AS items, count(*) FILTER (starts_with(o_orderpriority, '1')) AS images, count(*) FILTER (o_orderstatus = 'F') AS answers, count(o_orderkey) > 0 AS processed,
        count(*) FILTER (o_orderstatus = 'P') > 0 AS edited, c_custkey % 3 = 0 AS has_key FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
    "a3_coach_page": f"""WITH {_I} SELECT n_nationkey AS slug, CASE WHEN n_nationkey % 5 <> 4 THEN (SELECT count(*) FROM i WHERE number % 30 = n_nationkey) END AS items,
        CASE WHEN n_nationkey % 5 <> 4 THEN (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 2000) END AS files FROM nation""",
    "a3_helper_page": f"""WITH {_I} SELECT n_nationkey AS slug, (SELECT count(*) FROM i WHERE number % 30 = n_nationkey) AS items,
        (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 2000) AS files FROM nation WHERE n_nationkey % 5 <> 4 AND n_regionkey = 1""",
    "a6_outline": """WITH d AS (SELECT CASE WHEN doc_id % 4 > 0 THEN 'f' || doc_id % 7 ELSE '(no focus)' END AS focus, CASE WHEN lang IN ('fr', 'de') THEN lang ELSE 'Other / General' END AS topic FROM documents)
        SELECT CASE focus WHEN 'f5' THEN 0 WHEN 'f1' THEN 1 WHEN 'f3' THEN 2 ELSE 4 END::INT AS focus_ord, focus, CASE topic WHEN 'fr' THEN 0 WHEN 'de' THEN 1 ELSE 3 END::INT AS topic_ord, topic, count(*) AS n
        FROM d WHERE focus IN ('f5', 'f1', 'f3', '(no focus)') GROUP BY ALL""",
    "a5_table": """WITH w AS (SELECT item_id, list_filter(list_transform(regexp_extract_all(lower(text), '[a-z]{6,}'), lambda x: x), lambda x: true) AS w FROM benchmark),
        u AS (SELECT item_id, unnest(w) AS phrase, unnest(range(len(w))) AS k FROM w), f AS (SELECT item_id, phrase, min(k) AS k FROM u GROUP BY ALL),
        kw AS (SELECT item_id, phrase, (row_number() OVER (PARTITION BY item_id ORDER BY k) - 1) % 3 + 1 AS weight FROM f),
        h AS (SELECT doc_id, phrase FROM documents, (SELECT DISTINCT phrase FROM kw) p WHERE contains(lower(coalesce(text, '')), phrase)),
        s AS (SELECT doc_id, item_id, sum(weight) AS score FROM h JOIN kw USING (phrase) GROUP BY ALL), b AS (SELECT doc_id, item_id FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) = 1)
        SELECT doc_id, coalesce('topic ' || item_id, 'Other / General') AS topic FROM documents LEFT JOIN b USING (doc_id)""",
    "j16_price_table": """WITH p AS (SELECT left(p_name, (2 + p_partkey % 6)::INT) AS prefix, p_partkey AS ord, p_size::DOUBLE AS price_in FROM part WHERE p_partkey % 7 = 0)
        SELECT p_partkey, coalesce((SELECT arg_min(price_in, ord) FROM p WHERE starts_with(p_name, prefix)), 1.5)::DOUBLE AS price_in, (CASE WHEN EXISTS (SELECT 1 FROM p WHERE starts_with(p_name, prefix)) THEN 0.5 ELSE 7.5 END)::DOUBLE AS price_out FROM part""",
    "d3_similar_pairs": f"WITH {_DG}, {_PAIRS} SELECT a, b, round(sim, 6) AS similarity FROM pr",
    "d3_jaccard": f"WITH {_DG}, {_BG} SELECT s.id AS doc_id, CASE WHEN len(s.s) = 0 OR len(bs.s) = 0 THEN 0.0 ELSE round(len(list_intersect(s.s, bs.s)) / (len(s.s) + len(bs.s) - len(list_intersect(s.s, bs.s))), 6) END::DOUBLE AS similarity FROM s JOIN bs ON s.id % 40 = bs.id",
    "d5_greedy": f"{_GREEDY} SELECT doc_id, reason IS NULL AS kept, reason, matched FROM j",
    "d6_taken": f"""{_GREEDY}, t AS (SELECT lang, doc_id FROM j WHERE reason IS NULL ORDER BY lang, doc_id LIMIT 300), m AS (SELECT max((lang, doc_id)) AS last, count(*) AS n FROM t)
        SELECT doc_id, 'taken' AS outcome FROM t UNION ALL SELECT doc_id, 'rejected' FROM j, m WHERE reason IN ('bank', 'batch') AND (n < 300 OR (lang, doc_id) < last)""",
}
SQL["d6_quotas"] = (
    _GREEDY.replace("documents", "gathered").replace(">= 12", ">= 0").replace("< 12", "< 0").replace(
        "WITH RECURSIVE", """WITH RECURSIVE asked AS (SELECT doc_id AS own, lang, coalesce(text, '') AS text, list_position(['fr', 'en', 'de'], lang) * 51 + row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS spot FROM documents
            WHERE lang IN ('fr', 'en', 'de') QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 50),
        gathered AS (SELECT spot AS doc_id, lang, text FROM asked WHERE own % 7 <> 0 AND trim(text) <> ''),""")
    + """, t AS (SELECT doc_id FROM j WHERE reason IS NULL ORDER BY doc_id LIMIT 45), m AS (SELECT max(doc_id) AS last, count(*) AS n FROM t),
        got AS (SELECT doc_id AS spot, 'taken' AS outcome FROM t UNION ALL SELECT doc_id, 'rejected' FROM j, m WHERE reason IS NOT NULL AND (n < 45 OR doc_id < last))
        SELECT own AS doc_id, lang, outcome FROM got JOIN asked USING (spot) UNION ALL SELECT own, lang, 'skipped' FROM asked WHERE own % 7 = 0"""
)
SQL["s7_imported"] = f"""{_GREEDY}, told AS ({SQL["a5_table"]}), names AS (SELECT DISTINCT 'topic ' || item_id AS topic FROM benchmark WHERE regexp_matches(lower(text), '[a-z]{{6,}}')),
    added AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) + 1000 AS number, CASE doc_id % 3 WHEN 0 THEN 'topic ' || (doc_id % 40) WHEN 1 THEN 'unknown' ELSE 'Other / General' END AS given FROM j WHERE reason IS NULL)
    SELECT doc_id, 'added' AS outcome, number, CASE WHEN given = 'Other / General' OR given IN (SELECT topic FROM names) THEN given ELSE told.topic END AS topic, CASE WHEN doc_id % 4 = 0 THEN 'mc' ELSE 'short' END AS type,
        CASE WHEN doc_id % 4 = 0 THEN 'A=one|B=two' ELSE '' END AS choices, CASE WHEN doc_id % 5 = 0 THEN 'as said' END AS rationale FROM added JOIN told USING (doc_id)
    UNION ALL SELECT doc_id, CASE reason WHEN 'too short' THEN 'invalid' ELSE 'duplicate' END, NULL, NULL, NULL, NULL, NULL FROM j WHERE reason IS NOT NULL"""
