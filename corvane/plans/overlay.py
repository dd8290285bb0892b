"""Registered queries of the edit overlay and the SQL they must equal.

Orders stand in for items: the customer is the document, the order its number; line items and events are the edits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import overlay


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("number"), F.col("o_orderpriority").alias("topic"), F.col("o_orderstatus").alias("answer"))


def _returned(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")


def e1_deletes(spark, sf_dir):
    return overlay.apply_deletes(_orders(spark, sf_dir), _returned(spark, sf_dir).select(F.col("l_orderkey").alias("number")), ["number"])


def e2_first_adds(spark, sf_dir):
    left = e1_deletes(spark, sf_dir)
    adds = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("number"), F.col("l_suppkey").alias("doc"), F.when(F.col("l_linestatus") == "F", "").otherwise(F.col("l_returnflag")).alias("topic"), F.lit(None).cast("string").alias("answer"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("ord"))
    return overlay.apply_adds(left, adds, ["number"], "ord", {"topic": F.lit("Other / General"), "answer": F.lit("")})


def e3_overrides(spark, sf_dir):
    line = _t(spark, sf_dir, "lineitem")
    field = F.when(F.col("l_linenumber") % 2 == 1, "topic").otherwise("answer")
    edits = line.select(F.col("l_orderkey").alias("number"), field.alias("field"), F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("value"), F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_quantity").alias("by"))
    table = overlay.override_table(edits, ["number"], "field", "value", F.col("by"), ["topic", "answer"])
    return overlay.apply_overrides(_orders(spark, sf_dir), table, ["number"], ["topic", "answer"])


def e4_images(spark, sf_dir):
    line = _t(spark, sf_dir, "lineitem").withColumn("image", F.concat(F.lit("img"), F.col("l_partkey") % 50))
    items = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("number"))
    own = line.groupBy(F.col("l_orderkey").alias("number")).agg(F.transform(F.array_sort(F.collect_set(F.struct("image"))), lambda x: x["image"]).alias("images"))
    items = items.join(own, "number", "left")
    owner = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("l_orderkey"))
    edits = line.join(owner, "l_orderkey")
    detached = edits.where("l_returnflag = 'R' and l_linestatus = 'F'").select("doc", "image")
    assigned = edits.where("l_quantity > 45").groupBy("doc", "image").agg(F.max("l_orderkey").alias("number"), F.min("l_partkey").alias("ord"))
    out = overlay.reassign_images(items, "doc", "number", "images", detached, assigned)
    return out.select("doc", "number", F.array_join(F.array_sort("images"), ",").alias("images"))


def e5_verdicts(spark, sf_dir):
    verdicts = _t(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("number")).agg(F.max("l_returnflag").alias("status"), F.when(F.max("l_quantity") > 25, F.lit("5-LOW")).alias("text_at"), F.max("l_linestatus").alias("answer_at"))
    return overlay.replay_verdicts(_orders(spark, sf_dir), verdicts, ["number"], "topic", "answer").select("number", "status", "stale")


def e6_patch_state(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    return overlay.patch_state(events, ["user_id"], "event_type", "value", F.struct("ts", "event_id"), F.col("event_type") == "error").select("user_id", "field", "value")


def e7_delete_document(spark, sf_dir):
    items = _orders(spark, sf_dir)
    adds = items.where("answer = 'P'")
    deletes = items.where("answer = 'F' and doc % 2 = 0").select("doc", "number")
    left, gone = overlay.delete_document(items, adds, deletes, "doc", "number", F.lit(7))
    return left.select("doc", "number", F.lit("add").alias("kind")).union(gone.select("doc", "number", F.lit("delete")))


def e8_changed_items(spark, sf_dir):
    line = _t(spark, sf_dir, "lineitem").withColumn("editor", F.concat(F.lit("s"), "l_suppkey"))
    return overlay.changed_items(line.where("l_linenumber = 1"), line.where("l_linenumber <= 2"), ["l_orderkey"], "l_shipdate", "editor")


def e9_change_summary(spark, sf_dir):
    changed = _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("editor"))
    return overlay.change_summary(changed, "o_custkey", "o_orderkey")


def j2_effective_meta(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    own = _t(spark, sf_dir, "labels").groupBy("doc_id").agg(F.when(F.max("quality") == 1, "good").otherwise("").alias("year"), F.when(F.max("toxic") == 1, "C").alias("division"))
    return overlay.effective_meta(docs, own, "doc_id", {"year": F.col("source"), "division": F.col("lang")})


def u1_replace_docs(spark, sf_dir):
    cached = _t(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("topic"))
    fresh = _t(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), "quality").alias("topic"))
    return overlay.replace_docs(cached, fresh, "doc_id")


def _snapshots(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("number"), F.trunc("o_orderdate", "year").cast("timestamp").alias("saved_at"))


def s11_list_snapshots(spark, sf_dir):
    return overlay.list_snapshots(_snapshots(spark, sf_dir), "doc", "saved_at")


def s11_restore(spark, sf_dir):
    current = _orders(spark, sf_dir).select("doc", "number")
    return overlay.restore(current, _snapshots(spark, sf_dir), "doc", F.lit(7), "saved_at", F.lit("1996-01-01").cast("timestamp"))


def s11_restore_parts(spark, sf_dir):
    """Items are orders, edits their lines; the snapshot of customer 7 has items only, that of customer 10 both, its edits being empty."""
    orders = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("number"))
    edits = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("number"), "l_linenumber").join(orders, "number").select("doc", "number", F.col("l_linenumber").alias("field"))
    at = F.lit("1996-01-01").cast("timestamp")
    saved = orders.where("number % 2 = 0").withColumn("saved_at", at)
    held = orders.select("doc", at.alias("saved_at")).distinct()
    held = held.withColumn("part", F.lit("items")).union(held.where("doc % 10 = 0").withColumn("part", F.lit("edits")))
    none = edits.where("false").withColumn("saved_at", at)
    out = [overlay.restore_parts({"items": orders, "edits": edits}, {"items": saved, "edits": none}, held, "doc", F.lit(doc), "saved_at", at) for doc in (7, 10)]
    counted = [part.groupBy(F.lit(doc).alias("restored"), F.lit(name).alias("part")).agg(F.count("*").alias("n"), F.sum("number").alias("numbers")) for doc, parts in zip((7, 10), out, strict=True) for name, part in parts.items()]
    return counted[0].union(counted[1]).union(counted[2]).union(counted[3])


def s12_expire(spark, sf_dir):
    kept, _ = overlay.expire(_snapshots(spark, sf_dir), "saved_at", 1000, F.lit("1999-06-01").cast("timestamp"))
    return kept.groupBy("saved_at").agg(F.count("*").alias("n"))


def s12_counts(spark, sf_dir):
    return overlay.expire(_snapshots(spark, sf_dir), "saved_at", 1000, F.lit("1999-06-01").cast("timestamp"))[1]


def p8_backfill_audit(spark, sf_dir):
    items = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.when(F.col("o_orderstatus") != "O", F.when(F.col("o_orderstatus") == "F", "").otherwise(F.lit("someone"))).alias("by"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias("at"))
    meta = _t(spark, sf_dir, "customer").where("c_nationkey < 12").select("c_custkey", F.lit("2001-02-03").cast("timestamp").alias("at"))
    return overlay.backfill_audit(items, meta, "c_custkey", "by", "at", F.lit("admin"), F.lit("2024-01-01").cast("timestamp")).select("o_orderkey", "by", "at")


QUERIES = {f.__name__: f for f in (e1_deletes, e2_first_adds, e3_overrides, e4_images, e5_verdicts, e6_patch_state, e7_delete_document, e8_changed_items, e9_change_summary, j2_effective_meta, u1_replace_docs, s11_list_snapshots, s11_restore, s11_restore_parts, s12_expire, s12_counts, p8_backfill_audit)}

_ITEMS = "i AS (SELECT o_custkey AS doc, o_orderkey AS number, o_orderpriority AS topic, o_orderstatus AS answer FROM orders)"
SQL = {
    "e1_deletes": f"WITH {_ITEMS} SELECT * FROM i WHERE number NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "e2_first_adds": f"""WITH {_ITEMS}, b AS (SELECT * FROM i WHERE number NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')),
        a AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1)
        SELECT * FROM b UNION ALL SELECT l_suppkey, l_orderkey, CASE WHEN l_linestatus = 'F' THEN 'Other / General' ELSE l_returnflag END, '' FROM a WHERE l_orderkey NOT IN (SELECT number FROM b)""",
    "e3_overrides": f"""WITH {_ITEMS}, e AS (SELECT l_orderkey AS number, l_linenumber % 2 AS odd, CASE WHEN l_returnflag <> 'A' THEN l_returnflag END AS v FROM lineitem
            QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_quantity DESC) = 1)
        SELECT doc, i.number, CASE WHEN t.number IS NULL THEN topic ELSE t.v END AS topic, CASE WHEN a.number IS NULL THEN answer ELSE a.v END AS answer
        FROM i LEFT JOIN e t ON t.number = i.number AND t.odd = 1 LEFT JOIN e a ON a.number = i.number AND a.odd = 0""",
    "e4_images": """WITH l AS (SELECT o_custkey AS doc, o_orderkey AS number, 'img' || (l_partkey % 50) AS image, l_returnflag, l_linestatus, l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
        a AS (SELECT doc, image, max(number) AS number FROM l WHERE l_quantity > 45 GROUP BY ALL),
        gone AS (SELECT doc, image FROM l WHERE l_returnflag = 'R' AND l_linestatus = 'F' UNION SELECT doc, image FROM a),
        now AS (SELECT doc, number, image FROM l WHERE (doc, image) NOT IN (SELECT (doc, image) FROM gone) UNION SELECT doc, number, image FROM a)
        SELECT o_custkey AS doc, o_orderkey AS number, coalesce(string_agg(image, ',' ORDER BY image), '') AS images FROM orders LEFT JOIN now ON now.number = o_orderkey GROUP BY ALL""",
    "e5_verdicts": """WITH v AS (SELECT l_orderkey, max(l_returnflag) AS status, CASE WHEN max(l_quantity) > 25 THEN '5-LOW' END AS t, max(l_linestatus) AS a FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
        SELECT o_orderkey AS number, status, CASE WHEN v.l_orderkey IS NOT NULL THEN coalesce(t <> o_orderpriority, false) OR a <> o_orderstatus END AS stale FROM orders LEFT JOIN v ON l_orderkey = o_orderkey""",
    "e6_patch_state": """WITH g AS (SELECT user_id, max((ts, event_id)) AS last FROM events WHERE event_type = 'error' GROUP BY 1)
        SELECT user_id, event_type AS field, value FROM events LEFT JOIN g USING (user_id) WHERE event_type <> 'error' AND (last IS NULL OR (ts, event_id) > last)
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
    "e7_delete_document": """SELECT o_custkey AS doc, o_orderkey AS number, 'add' AS kind FROM orders WHERE o_orderstatus = 'P' AND o_custkey <> 7
        UNION ALL SELECT o_custkey, o_orderkey, 'delete' FROM orders WHERE (o_orderstatus = 'F' AND o_custkey % 2 = 0) OR (o_custkey = 7 AND o_orderstatus <> 'P')""",
    "e8_changed_items": """WITH o AS (SELECT l_orderkey, max(l_shipdate) AS was FROM lineitem WHERE l_linenumber = 1 GROUP BY 1),
        n AS (SELECT l_orderkey, l_shipdate, 's' || l_suppkey AS editor FROM lineitem WHERE l_linenumber <= 2 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, editor DESC) = 1)
        SELECT l_orderkey, editor FROM n LEFT JOIN o USING (l_orderkey) WHERE was IS NULL OR was <> l_shipdate""",
    "e9_change_summary": """WITH c AS (SELECT o_custkey, o_orderkey::VARCHAR AS q, o_orderpriority[1] AS e FROM orders WHERE o_orderstatus = 'F'),
        p AS (SELECT o_custkey, e, count(*) AS n, string_agg(q, ',' ORDER BY q) AS q FROM c GROUP BY ALL)
        SELECT o_custkey, CASE WHEN sum(n) <= 8 THEN string_agg('Q' || q || ' edited by ' || e, '; ' ORDER BY 'Q' || q || ' edited by ' || e)
            ELSE sum(n)::BIGINT || ' questions edited (mostly by ' || arg_max(e, (n, e)) || ')' END AS summary FROM p GROUP BY 1""",
    "j2_effective_meta": """WITH o AS (SELECT doc_id, CASE WHEN max(quality) = 1 THEN 'good' ELSE '' END AS year, CASE WHEN max(toxic) = 1 THEN 'C' END AS division FROM labels GROUP BY 1)
        SELECT doc_id, coalesce(year, source) AS year, coalesce(division, lang) AS division FROM documents LEFT JOIN o USING (doc_id)""",
    "u1_replace_docs": "SELECT doc_id, lang AS topic FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'q' || quality FROM labels",
    "s11_list_snapshots": """WITH s AS (SELECT o_custkey AS doc, date_trunc('year', o_orderdate)::TIMESTAMP AS saved_at, count(*) AS items FROM orders GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY doc ORDER BY saved_at DESC) AS rank FROM s""",
    "s11_restore": """WITH s AS (SELECT o_custkey AS doc, o_orderkey AS number FROM orders WHERE o_custkey = 7 AND year(o_orderdate) = 1996)
        SELECT o_custkey AS doc, o_orderkey AS number FROM orders WHERE o_custkey NOT IN (SELECT doc FROM s) UNION ALL SELECT * FROM s""",
    "s11_restore_parts": """WITH r AS (SELECT unnest([7, 10]) AS restored), e AS (SELECT o_custkey AS doc, o_orderkey AS number FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
        SELECT restored, 'items' AS part, count(*) AS n, sum(o_orderkey)::BIGINT AS numbers FROM r JOIN orders ON o_custkey <> restored OR o_orderkey % 2 = 0 GROUP BY 1
        UNION ALL SELECT restored, 'edits', count(*), sum(number)::BIGINT FROM r JOIN e ON restored = 7 OR doc <> restored GROUP BY 1""",
    "s12_expire": "SELECT date_trunc('year', o_orderdate)::TIMESTAMP AS saved_at, count(*) AS n FROM orders WHERE date_trunc('year', o_orderdate) >= TIMESTAMP '1999-06-01' - INTERVAL 1000 DAY GROUP BY 1",
    "s12_counts": "SELECT count(*) FILTER (date_trunc('year', o_orderdate) < TIMESTAMP '1999-06-01' - INTERVAL 1000 DAY) AS removed, count(*) FILTER (date_trunc('year', o_orderdate) >= TIMESTAMP '1999-06-01' - INTERVAL 1000 DAY) AS kept FROM orders",
    "p8_backfill_audit": """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'someone' ELSE 'admin' END AS by,
        CASE WHEN o_orderstatus = 'P' THEN o_orderdate WHEN c_nationkey < 12 THEN TIMESTAMP '2001-02-03' ELSE TIMESTAMP '2024-01-01' END AS at FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
}
