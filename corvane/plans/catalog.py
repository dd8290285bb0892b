"""The registered queries of the library's own operators and the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators import dedup, grading, relations, text

TAXONOMY = [("Articles", [("the ", 1), ("that ", 2)]), ("French", [("que ", 2), ("eau", 1)]), ("German", [("der ", 2), ("sch", 1)]), ("Spanish", [("ción", 3)])]
BOILERPLATE = ["copyright", "page", "licensed"]
PRICES = [("pur", 3.0), ("c", 0.5), ("s", 0.25)]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def a1_facets(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    checked = F.coalesce(F.col("quality").cast("string"), F.lit("unvalidated"))
    return relations.facets(rows, {"source": F.col("source"), "lang": F.col("lang"), "verdict": checked, "all": F.lit("total")})


def a4_topic_counts(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy(text.classify(F.col("text"), TAXONOMY).alias("topic")).agg(F.count("*").alias("n"))


def a5_classify(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.classify(F.col("text"), TAXONOMY).alias("topic"))


def a7_score_totals(spark, sf_dir):
    line = _t(spark, sf_dir, "lineitem")
    auto = F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))
    return grading.score_totals(line, ["l_suppkey"], auto, F.when(F.col("l_returnflag") == "R", F.lit(1.0)), F.col("l_quantity"))


def a11_usage_cost(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").withColumn("price", relations.prefix_price(F.col("event_type"), PRICES, 1.0))
    return rows.groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.sum("price"), 4).alias("cost"))


def a12_token_estimate(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.token_estimate(F.col("text"), 200).alias("tokens"))


def c2_content_lines(spark, sf_dir):
    lines = text.content_lines(_t(spark, sf_dir, "documents"), "doc_id", "text", BOILERPLATE)
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def c8_repeat_suffix(spark, sf_dir):
    line = _t(spark, sf_dir, "lineitem")
    nth = F.row_number().over(Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber"))
    return line.select("l_orderkey", "l_linenumber", F.concat("l_returnflag", text.repeat_suffix(nth)).alias("number"))


def d1_key_dedup(spark, sf_dir):
    # the key's part of the text goes along, the text does not
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.substring("text", 1, 80).alias("head"))
    return dedup.first_per_key(docs, [F.col("source"), F.col("lang"), F.col("head")], "doc_id").select("doc_id", "source", "lang")


def d2_shingles(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(dedup.word_shingles(F.col("text"), word=dedup.SPACED)).cast("long").alias("n_shingles"))


def d2_word_shingles(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(dedup.word_shingles(F.col("text"))).cast("long").alias("n_shingles"))


def d4_duplicate_of_bank(spark, sf_dir):
    return dedup.duplicate_of_bank(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"), word=dedup.SPACED)


def d4_word_duplicate_of_bank(spark, sf_dir):
    return dedup.duplicate_of_bank(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def e6_patch_merge(spark, sf_dir):
    line = _t(spark, sf_dir, "lineitem")
    fields = {"status": (F.col("l_returnflag") != "N", F.col("l_linestatus")), "quantity": (F.col("l_quantity") > 10, F.when(F.col("l_quantity") <= 45, F.col("l_quantity")))}
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return relations.patch_merge(line, "l_orderkey", order, fields)


def g1_choice_grading(spark, sf_dir):
    line = _t(spark, sf_dir, "lineitem")
    return line.groupBy("l_orderkey").agg(F.sum(grading.choice_points(F.lower("l_returnflag"), F.concat(F.lit(" "), "l_returnflag", "l_linestatus"))).alias("points"), F.count("*").alias("answers"))


def g1_key_grading(spark, sf_dir):
    key = F.concat(F.lit(" "), F.when(F.col("l_linestatus") == "F", "a").otherwise("n"), "l_linestatus")
    points = grading.choice_points(F.lower("l_returnflag"), key)
    return _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(points).alias("points"), F.count("*").alias("answers"))


def j3_as_of(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    return relations.as_of(events, "user_id", ["ts", "event_id"], F.col("event_type") == "click", F.col("event_id"), F.to_date("ts")).select("event_id", "anchor")


def j15_unknown_ids(spark, sf_dir):
    return _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


def p9_verdict(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "Correct").when(F.col("quality") == 0, "incorrect").otherwise("unknown")
    return rows.select("doc_id", grading.verdict(F.col("text"), status).alias("verdict"))


def r3_newest(spark, sf_dir):
    return relations.newest_per_key(_t(spark, sf_dir, "events"), "user_id", [F.col("ts").desc(), F.col("event_id").desc()], 5).select("user_id", "event_id", "rank")


def w4_limiter(spark, sf_dir):
    rows = relations.trailing_limit(_t(spark, sf_dir, "events"), "user_id", "ts", 86_400, 5)
    return rows.select("event_id", "recent", "blocked")


def w4_failure_limiter(spark, sf_dir):
    kind = F.col("event_type")
    rows = relations.trailing_limit(_t(spark, sf_dir, "events"), "user_id", "ts", 10 * 86_400, 3, kind == "click", kind == "purchase")
    return rows.select("event_id", "recent", "blocked")


def w4_strict_limiter(spark, sf_dir):
    kind = F.col("event_type")
    rows = relations.trailing_limit(_t(spark, sf_dir, "events").withColumn("ts", F.date_trunc("hour", "ts")), "user_id", "ts", 10 * 86_400, 3, kind == "click", kind == "purchase", exclusive=True)
    return rows.select("event_id", "recent", "blocked")


def _new_ids(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").withColumn("doc_id", F.when(F.col("doc_id") % 10 > 0, F.col("doc_id")))
    return relations.new_only(docs, _t(spark, sf_dir, "labels"), "doc_id")


def j15_new_ids(spark, sf_dir):
    return _new_ids(spark, sf_dir)[0].groupBy("lang").agg(F.count("*").alias("fresh"))


def j15_skipped(spark, sf_dir):
    return _new_ids(spark, sf_dir)[1]


QUERIES = {f.__name__: f for f in (w4_strict_limiter, j15_new_ids, j15_skipped, a1_facets, a4_topic_counts, a5_classify, a7_score_totals, a11_usage_cost, a12_token_estimate, c2_content_lines, c8_repeat_suffix, d1_key_dedup, d2_shingles, d2_word_shingles, d4_duplicate_of_bank, d4_word_duplicate_of_bank, e6_patch_merge, g1_choice_grading, g1_key_grading, j3_as_of, j15_unknown_ids, p9_verdict, r3_newest, w4_limiter, w4_failure_limiter)}

_SCORES = ", ".join("(" + " + ".join(f"CASE WHEN contains(lower(coalesce(text, '')), '{p}') THEN {w} ELSE 0 END" for p, w in phrases) + f") AS s{k}" for k, (_, phrases) in enumerate(TAXONOMY))
_TOPIC = "CASE WHEN greatest(s0, s1, s2, s3) = 0 THEN 'Other / General' " + " ".join(f"WHEN s{k} = greatest(s0, s1, s2, s3) THEN '{t}'" for k, (t, _) in enumerate(TAXONOMY)) + " END"
_SHINGLES = """w AS (SELECT {id}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM {table}),
    s AS (SELECT {id}, list_distinct(CASE WHEN len(w) < 3 THEN w ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w)"""
_DOCS, _BANK = _SHINGLES.format(id="doc_id", table="documents"), _SHINGLES.format(id="item_id", table="benchmark").replace("w AS", "bw AS").replace("s AS (SELECT", "bs AS (SELECT").replace("FROM w)", "FROM bw)")
SQL = {
    "a1_facets": """WITH d AS (SELECT d.*, coalesce(l.quality::VARCHAR, 'unvalidated') AS v FROM documents d LEFT JOIN labels l USING (doc_id)),
        f AS (SELECT 'source' AS facet, source AS value FROM d UNION ALL SELECT 'lang', lang FROM d UNION ALL SELECT 'verdict', v FROM d UNION ALL SELECT 'all', 'total' FROM d)
        SELECT facet, value, count(*) AS n FROM f WHERE value IS NOT NULL GROUP BY ALL""",
    "a4_topic_counts": f"SELECT {_TOPIC} AS topic, count(*) AS n FROM (SELECT {_SCORES} FROM documents) GROUP BY 1",
    "a5_classify": f"SELECT doc_id, {_TOPIC} AS topic FROM (SELECT doc_id, {_SCORES} FROM documents)",
    "a7_score_totals": "SELECT l_suppkey, sum(CASE l_returnflag WHEN 'A' THEN l_quantity WHEN 'R' THEN 1.0 ELSE 0.0 END)::DOUBLE AS earned, sum(l_quantity)::DOUBLE AS possible FROM lineitem GROUP BY 1",
    "a11_usage_cost": "SELECT event_type, count(*) AS calls, round(sum(CASE WHEN starts_with(event_type, 'pur') THEN 3.0 WHEN starts_with(event_type, 'c') THEN 0.5 WHEN starts_with(event_type, 's') THEN 0.25 ELSE 1.0 END)::DOUBLE, 4) AS cost FROM events GROUP BY 1",
    "a12_token_estimate": "SELECT doc_id, greatest(1, length(coalesce(text, '')) // 4)::BIGINT + 200 AS tokens FROM documents",
    "c2_content_lines": """WITH l AS (SELECT doc_id, trim(unnest(string_split(coalesce(text, ''), chr(10)))) AS line FROM documents)
        SELECT doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM l
        WHERE regexp_matches(line, '^[A-Ea-e][.)]$') OR NOT (length(line) < 3 OR starts_with(lower(line), 'copyright') OR starts_with(lower(line), 'page') OR starts_with(lower(line), 'licensed')) GROUP BY 1""",
    "c8_repeat_suffix": """WITH n AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) - 1 AS k FROM lineitem)
        SELECT l_orderkey, l_linenumber, l_returnflag || CASE WHEN k = 0 THEN '' WHEN k < 26 THEN chr((97 + k)::INT) ELSE chr((96 + k // 26)::INT) || chr((97 + k % 26)::INT) END AS number FROM n""",
    "d1_key_dedup": "SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang, substr(text, 1, 80) ORDER BY doc_id) = 1",
    "d2_shingles": f"WITH {_DOCS} SELECT doc_id, len(s)::BIGINT AS n_shingles FROM s",
    "d4_duplicate_of_bank": f"""WITH {_DOCS}, {_BANK},
        e AS (SELECT doc_id, len(s) AS nd, unnest(s) AS g FROM s), f AS (SELECT item_id, len(s) AS nb, unnest(s) AS g FROM bs),
        p AS (SELECT doc_id, item_id, count(*) / (nd + nb - count(*)) AS sim FROM e JOIN f USING (g) GROUP BY doc_id, item_id, nd, nb),
        m AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY (sim >= 0.4) DESC, CASE WHEN sim >= 0.4 THEN 0 ELSE sim END DESC, item_id) = 1)
        SELECT doc_id, coalesce(sim >= 0.4, false) AS duplicate, item_id AS matched, round(coalesce(sim, 0), 6) AS similarity FROM documents LEFT JOIN m USING (doc_id)""",
    "e6_patch_merge": """WITH a AS (SELECT DISTINCT l_orderkey FROM lineitem),
        s AS (SELECT l_orderkey, l_linestatus AS status FROM lineitem WHERE l_returnflag <> 'N' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) = 1),
        q AS (SELECT l_orderkey, CASE WHEN l_quantity <= 45 THEN l_quantity END AS quantity FROM lineitem WHERE l_quantity > 10 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) = 1)
        SELECT l_orderkey, status, quantity FROM a LEFT JOIN s USING (l_orderkey) LEFT JOIN q USING (l_orderkey)""",
    "g1_choice_grading": "SELECT l_orderkey, count(*) AS points, count(*) AS answers FROM lineitem GROUP BY 1",
    "g1_key_grading": "SELECT l_orderkey, count(*) FILTER (l_returnflag = CASE l_linestatus WHEN 'F' THEN 'A' ELSE 'N' END) AS points, count(*) AS answers FROM lineitem GROUP BY 1",
    "j3_as_of": """SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS anchor FROM events""",
    "j15_unknown_ids": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "p9_verdict": "SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'unavailable' WHEN quality = 1 THEN 'correct' WHEN quality = 0 THEN 'incorrect' ELSE 'uncertain' END AS verdict FROM documents LEFT JOIN labels USING (doc_id)",
    "r3_newest": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events QUALIFY rank <= 5",
    "w4_limiter": """WITH c AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS recent FROM events)
        SELECT event_id, recent, recent >= 5 AS blocked FROM c""",
    "w4_strict_limiter": """WITH h AS (SELECT event_id, user_id, event_type, date_trunc('hour', ts) AS ts FROM events),
        s AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS cleared FROM h),
        c AS (SELECT s.event_id, count(f.ts) AS recent FROM s LEFT JOIN h f ON f.event_type = 'click' AND f.user_id = s.user_id AND f.ts > s.ts - INTERVAL 10 DAY AND f.ts <= s.ts AND (s.cleared IS NULL OR f.ts > s.cleared) GROUP BY s.event_id)
        SELECT event_id, recent, recent >= 3 AS blocked FROM c""",
    "j15_new_ids": "SELECT lang, count(*) AS fresh FROM documents WHERE doc_id % 10 = 0 OR doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1",
    "j15_skipped": "SELECT count(*) AS skipped FROM documents WHERE doc_id % 10 > 0 AND doc_id IN (SELECT doc_id FROM labels)",
    "w4_failure_limiter": """WITH s AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS cleared FROM events),
        f AS (SELECT user_id, ts FROM events WHERE event_type = 'click'),
        c AS (SELECT s.event_id, count(f.ts) AS recent FROM s LEFT JOIN f ON f.user_id = s.user_id AND f.ts BETWEEN s.ts - INTERVAL 10 DAY AND s.ts AND (s.cleared IS NULL OR f.ts > s.cleared) GROUP BY s.event_id)
        SELECT event_id, recent, recent >= 3 AS blocked FROM c""",
}
# the same statements over Unicode words
_SPLIT, _WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\r]+'), lambda x: x <> '')", r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
SQL |= {"d2_word_shingles": SQL["d2_shingles"].replace(_SPLIT, _WORDS), "d4_word_duplicate_of_bank": SQL["d4_duplicate_of_bank"].replace(_SPLIT, _WORDS)}
