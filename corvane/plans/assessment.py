"""Registered queries of the item and assessment operators and the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import assessment, items, relations


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def a6_focus_topics(spark, sf_dir):
    focus = F.when(F.trim(F.coalesce("source", F.lit(""))) == "", "(no focus)").otherwise(F.col("source"))
    return _t(spark, sf_dir, "documents").select(focus.alias("focus"), F.col("lang").alias("topic")).rollup("focus", "topic").agg(F.count("*").alias("n"))


def a8_score_grid(spark, sf_dir):
    line = _t(spark, sf_dir, "lineitem")
    return assessment.score_grid(line, "l_suppkey", "l_returnflag", ["A", "N", "R"], F.when(F.col("l_linestatus") == "F", F.col("l_quantity")), F.col("l_quantity"))


def a9_grading_complete(spark, sf_dir):
    return assessment.grading_complete(
        _t(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey", _t(spark, sf_dir, "lineitem"), F.col("l_linestatus") == "O", F.col("l_quantity") > 10
    )


def a14_admission(spark, sf_dir):
    active = _t(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("active"))
    return active.withColumn("full", F.col("active") >= 8)


def c5_segments(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    found = items.segment_records(lines, "doc_id", "line_no", "line", "^[A-M]", "[Ll]icensed under")
    return found.select("doc_id", F.col("record_no").cast("long").alias("record_no"), "n_lines", F.length("body").cast("long").alias("n_chars"))


def c17_chunks(spark, sf_dir):
    chunks = items.greedy_chunks(_t(spark, sf_dir, "documents"), "doc_id", "text", "\n", 9000)
    return chunks.select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"))


def e2_overlay(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    late = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    added = _t(spark, sf_dir, "lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("added").alias("o_orderpriority"))
    return assessment.overlay_rows(orders, "o_orderkey", late, added)


def e8_changed(spark, sf_dir):
    line = _t(spark, sf_dir, "lineitem")
    return assessment.changed_since(line.where("l_linenumber = 1"), line.where("l_linenumber = 2"), "l_orderkey", "l_shipdate")


def g2_matching_credit(spark, sf_dir):
    line = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"), F.max("l_linestatus").alias("l_linestatus"))
    pick = F.when(F.col("l_linestatus") == "F", "R").otherwise("N")
    keyed = line.groupBy("l_orderkey").agg(
        F.map_from_entries(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("pairs"), F.map_from_entries(F.collect_list(F.struct("l_linenumber", pick))).alias("picks")
    )
    return keyed.select("l_orderkey", assessment.matching_credit(F.col("pairs"), F.col("picks"), 4.0).alias("points"))


def j8_effective_window(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("opens"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("closes"))
    own = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("opens_at"))
    return assessment.effective_window(orders, "l_orderkey", ("opens", "closes"), own.withColumn("closes_at", F.lit(None).cast("timestamp")))


def j16_prefix_price(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", relations.prefix_price(F.col("p_brand"), [("Brand#1", 2.5), ("Brand#", 1.0)], 0.5).alias("price"))


def k1_next_number(spark, sf_dir):
    return items.next_number(_t(spark, sf_dir, "lineitem"), "l_orderkey", F.concat(F.col("l_linenumber").cast("string"), F.lower("l_returnflag")))


def p4_builder_pool(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id")
    kept = _t(spark, sf_dir, "labels").where("toxic = 1")
    return assessment.builder_pool(docs, "text", "THE ", F.col("quality") == 1, kept, "doc_id").select("doc_id")


def r1_bank_order(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    out = items.running_number(orders, [F.col("o_orderpriority"), -F.year("o_orderdate")], [F.col("o_orderkey").cast("string")])
    return out.select("o_orderkey", "running")


def r2_context_anchor(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return items.context_anchor(rows, "event_id", F.when(F.col("event_type") != "click", F.col("user_id"))).select("event_id", "anchor")


def r7_stable_order(spark, sf_dir):
    return items.stable_order(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "place")


def u2_ordered_union(spark, sf_dir):
    customers = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("at"))
    suppliers = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("at"))
    return assessment.ordered_union([suppliers, customers], "nation", "at")


def u3_intersect(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(_t(spark, sf_dir, "supplier").select("s_nationkey"))


def u4_except(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).subtract(_t(spark, sf_dir, "supplier").select("s_nationkey"))


def w3_start_once(spark, sf_dir):
    starts = _t(spark, sf_dir, "events").groupBy("user_id", "event_type")
    return starts.agg(F.min(F.struct("ts", "event_id")).alias("m")).select("user_id", "event_type", "m.event_id")


QUERIES = {f.__name__: f for f in (a6_focus_topics, a8_score_grid, a9_grading_complete, a14_admission, c5_segments, c17_chunks, e2_overlay, e8_changed, g2_matching_credit, j8_effective_window, j16_prefix_price, k1_next_number, p4_builder_pool, r1_bank_order, r2_context_anchor, r7_stable_order, u2_ordered_union, u3_intersect, u4_except, w3_start_once)}

_CELLS = ", ".join(f"sum(CASE WHEN l_returnflag = '{t}' AND l_linestatus = 'F' THEN l_quantity END) AS \"{t}_earned\", sum(CASE WHEN l_returnflag = '{t}' THEN l_quantity END) AS \"{t}_possible\"" for t in "ANR")
SQL = {
    "a6_focus_topics": "SELECT focus, lang AS topic, count(*) AS n FROM (SELECT CASE WHEN trim(coalesce(source, '')) = '' THEN '(no focus)' ELSE source END AS focus, lang FROM documents) GROUP BY ROLLUP (focus, lang)",
    "a8_score_grid": f"SELECT l_suppkey, {_CELLS} FROM lineitem GROUP BY 1",
    "a9_grading_complete": "SELECT o_orderkey AS l_orderkey, o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O' AND l_quantity <= 10) AS complete FROM orders",
    "a14_admission": "SELECT user_id, count(*) AS active, count(*) >= 8 AS \"full\" FROM events WHERE event_type = 'purchase' GROUP BY 1",
    "c5_segments": """WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
        l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS k FROM t),
        r AS (SELECT doc_id, line, sum(regexp_matches(line, '^[A-M]')::INT) OVER w AS record_no, max(regexp_matches(line, '[Ll]icensed under')::INT) OVER w AS over_ FROM l
              WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING))
        SELECT doc_id, record_no::BIGINT AS record_no, count(*) AS n_lines, (sum(length(line)) + count(*) - 1)::BIGINT AS n_chars FROM r
        WHERE record_no > 0 AND over_ = 0 GROUP BY doc_id, record_no HAVING sum(length(line)) + count(*) - 1 >= 9""",
    "e2_overlay": """WITH b AS (SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))
        SELECT * FROM b UNION ALL SELECT l_orderkey, 'added' FROM lineitem WHERE l_linenumber = 2 AND l_orderkey NOT IN (SELECT o_orderkey FROM b)""",
    "e8_changed": """SELECT l_orderkey, a.l_shipdate AS old_stamp, b.l_shipdate AS new_stamp FROM (SELECT * FROM lineitem WHERE l_linenumber = 1) a
        FULL JOIN (SELECT * FROM lineitem WHERE l_linenumber = 2) b USING (l_orderkey) WHERE a.l_shipdate IS DISTINCT FROM b.l_shipdate""",
    "g2_matching_credit": "SELECT l_orderkey, round(count(*) FILTER (l_returnflag = CASE WHEN l_linestatus = 'F' THEN 'R' ELSE 'N' END) / count(*) * 4.0, 4) AS points FROM (SELECT l_orderkey, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus FROM lineitem GROUP BY l_orderkey, l_linenumber) GROUP BY 1",
    "j8_effective_window": """WITH o AS (SELECT l_orderkey, max(l_shipdate) AS at FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
        SELECT o_orderkey AS l_orderkey, CASE WHEN o.l_orderkey IS NULL THEN o_orderdate ELSE o.at END AS opens_at, CASE WHEN o.l_orderkey IS NULL THEN o_orderdate + INTERVAL 30 DAY END AS closes_at
        FROM orders LEFT JOIN o ON o.l_orderkey = o_orderkey""",
    "j16_prefix_price": "SELECT p_partkey, (CASE WHEN starts_with(p_brand, 'Brand#1') THEN 2.5 WHEN starts_with(p_brand, 'Brand#') THEN 1.0 ELSE 0.5 END)::DOUBLE AS price FROM part",
    "k1_next_number": "SELECT l_orderkey, max(l_linenumber) + 1 AS next_number FROM lineitem GROUP BY 1",
    "p4_builder_pool": "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE contains(lower(text), 'the ') AND quality = 1 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "r1_bank_order": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, -year(o_orderdate), o_orderkey::VARCHAR) AS running FROM orders",
    "r2_context_anchor": "SELECT event_id, CASE WHEN event_type = 'click' THEN event_id ELSE min(event_id) OVER (PARTITION BY user_id, event_type = 'click') END AS anchor FROM events",
    "r7_stable_order": "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY md5(l_orderkey || ':' || l_linenumber), l_linenumber) AS place FROM lineitem",
    "u2_ordered_union": """WITH a AS (SELECT s_nationkey AS nation, 0 AS source, s_suppkey AS ord FROM supplier UNION ALL SELECT c_nationkey, 1, c_custkey FROM customer)
        SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY nation ORDER BY source, ord) = 1""",
    "u3_intersect": "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "u4_except": "SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier",
    "w3_start_once": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
}
