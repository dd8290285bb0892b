"""Registered streaming queries: each replays the events table as a stream over its files and returns the state it ends in, with the SQL of
the same state in one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.storage import shared_folder
from corvane.streaming import feeds


def _glob(sf_dir: str, name: str) -> str:
    """A table as a pattern: the file source takes a folder or a pattern, and some tables are one file."""
    return f"{sf_dir}/{name}.parque[t]"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    feeds.stateful_session(spark)
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(_glob(sf_dir, "events"))


def _micros(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


def _saves(spark, sf_dir) -> DataFrame:
    """Every user takes a test a day: sign-ups start it, purchases hand it in, other events save an answer."""
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "submit").otherwise("save")
    return _events(spark, sf_dir).select(F.date_format("ts", "yyyy-MM-dd").alias("test"), F.col("user_id").cast("string").alias("username"), kind.alias("kind"), (F.col("event_id") % 3).cast("string").alias("number"), F.col("value").cast("string").alias("answer"), _micros("ts").alias("at"), F.col("event_id").alias("seq"))


def _run(spark, stream, name) -> DataFrame:
    base = shared_folder(spark, name)
    return feeds.run_to_table(stream, f"{base}/table", f"{base}/checkpoint")


def w1_autosave(spark, sf_dir):
    return feeds.last_answers(_run(spark, feeds.gated_saves(_saves(spark, sf_dir)), "w1"))


def w2_gate(spark, sf_dir):
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("username"), F.date_format("ts", "yyyy-MM-dd").alias("test"), F.to_date("ts").cast("timestamp").alias("day")).distinct()
    windows = users.where("username % 4 > 0").select("test", "username", (F.unix_micros("day") + 6 * 3_600_000_000).alias("opens"), (F.unix_micros("day") + 18 * 3_600_000_000).alias("closes"))
    return _run(spark, feeds.gated_saves(_saves(spark, sf_dir), windows), "w2").select("test", "username", "seq", "outcome")


def w3_start_stream(spark, sf_dir):
    starts = _saves(spark, sf_dir).where("kind = 'start'").select("test", "username", "at", "seq")
    return _run(spark, feeds.start_once(starts), "w3").select("test", "username", "seq")


def w4_limiter_stream(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "failure").when(F.col("event_type") == "purchase", "success").otherwise("other")
    attempts = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), kind.alias("kind"), _micros("ts").alias("at"), F.col("event_id").alias("seq"))
    return _run(spark, feeds.limited_attempts(attempts, 5 * 86_400, 3), "w4").select("seq", "recent", "blocked")


def w5_edit_overlay(spark, sf_dir):
    feed = _events(spark, sf_dir).select("user_id", "event_type", "ts", "event_id", "value")
    base, keys = shared_folder(spark, "w5"), ["user_id", "event_type"]
    feeds.merge_edits(feed, f"{base}/table", f"{base}/checkpoint", keys, "value", ["ts", "event_id"]).awaitTermination()
    return feeds.overlay(spark, f"{base}/table", keys, "value", ["ts", "event_id"])


def w5_folded_overlay(spark, sf_dir):
    """Edits by user, folded into a base after the first stream run; a second run finds nothing more and reads the base."""
    feed = _events(spark, sf_dir).select("user_id", "ts", "event_id", "value")
    base, keys, order = shared_folder(spark, "w5"), ["user_id"], ["ts", "event_id"]
    for _ in range(2):
        feeds.merge_edits(feed, f"{base}/table", f"{base}/checkpoint", keys, "value", order).awaitTermination()
        feeds.fold_edits(spark, f"{base}/table", keys, "value", order)
    return feeds.overlay(spark, f"{base}/table", keys, "value", order)


def w6_job_states(spark, sf_dir):
    feed = _events(spark, sf_dir).select((F.col("event_id") % 700).cast("string").alias("job"), (F.col("event_id") % 700 % 9).cast("string").alias("slug"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("ts"), _micros("ts").alias("at"), F.col("event_id").alias("seq"))
    changes = feeds.job_states(feed.withWatermark("ts", "0 seconds"), 3 * 86_400, ("click", "view"), event_time=True)
    return feeds.last_states(_run(spark, changes, "w6")).select("job", "slug", "status", "seq")


def w7_usage_tally(spark, sf_dir):
    tally = feeds.usage_tally(_events(spark, sf_dir), "event_type", {"tokens": F.floor("value").cast("long"), "last_id": F.lit(1).cast("long")})
    base = shared_folder(spark, "w7")
    feeds.write_tally(tally, f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return feeds.read_tally(spark, f"{base}/table").select("event_type", "calls", "tokens")


def w8_new_documents(spark, sf_dir):
    base = shared_folder(spark, "w8")
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    process = lambda rows: rows.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    for _ in range(2):  # the second run finds nothing new
        feeds.new_documents(spark, _glob(sf_dir, "documents"), schema, process, f"{base}/table", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/table")


QUERIES = {f.__name__: f for f in (w1_autosave, w2_gate, w3_start_stream, w4_limiter_stream, w5_edit_overlay, w5_folded_overlay, w6_job_states, w7_usage_tally, w8_new_documents)}

_E = """e AS (SELECT strftime(ts, '%Y-%m-%d') AS test, user_id::VARCHAR AS username, user_id, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'submit' ELSE 'save' END AS kind, (event_id % 3)::VARCHAR AS number, value::VARCHAR AS answer, ts, event_id AS seq,
    epoch_us(ts) - epoch_us(date_trunc('day', ts)) AS us FROM events)"""
_WINDOWED = "x AS (SELECT *, user_id % 4 > 0 AND us < 21600000000 AS early, user_id % 4 > 0 AND us > 64800000000 AS late FROM e)"
SQL = {
    # a save counts between the first start and the first submit that follows it
    "w1_autosave": f"""WITH {_E}, s AS (SELECT test, username, min((ts, seq)) AS a FROM e WHERE kind = 'start' GROUP BY ALL),
        d AS (SELECT e.test, e.username, min((ts, seq)) AS b FROM e JOIN s USING (test, username) WHERE kind = 'submit' AND (ts, seq) > a GROUP BY ALL)
        SELECT test, username, number, answer FROM e JOIN s USING (test, username) LEFT JOIN d USING (test, username) WHERE kind = 'save' AND (ts, seq) > a AND (b IS NULL OR (ts, seq) < b)
        QUALIFY row_number() OVER (PARTITION BY test, username, number ORDER BY ts DESC, seq DESC) = 1""",
    "w2_gate": f"""WITH {_E}, {_WINDOWED}, s AS (SELECT test, username, min((ts, seq)) AS a FROM x WHERE kind = 'start' AND NOT early AND NOT late GROUP BY ALL),
        d AS (SELECT x.test, x.username, min((ts, seq)) AS b FROM x JOIN s USING (test, username) WHERE kind = 'submit' AND NOT early AND NOT late AND (ts, seq) > a GROUP BY ALL),
        n AS (SELECT x.test, x.username, count(*) AS n FROM x JOIN s USING (test, username) LEFT JOIN d USING (test, username) WHERE kind = 'save' AND NOT early AND NOT late AND (ts, seq) > a AND (b IS NULL OR (ts, seq) < b) GROUP BY ALL),
        l AS (SELECT x.test, x.username, min((ts, seq)) AS c FROM x JOIN n USING (test, username) LEFT JOIN d USING (test, username) WHERE kind = 'submit' AND late AND b IS NULL GROUP BY ALL)
        SELECT x.test, x.username, seq, CASE WHEN early OR (late AND NOT (kind = 'submit' AND n.n IS NOT NULL)) THEN 'outside window'
            WHEN kind = 'start' THEN CASE WHEN (ts, seq) = a THEN 'started' ELSE 'already started' END
            WHEN a IS NULL OR (ts, seq) < a THEN 'not started' WHEN (ts, seq) > b OR (ts, seq) > c THEN 'already submitted'
            WHEN kind = 'save' THEN 'saved' WHEN late THEN 'auto_submitted_late' ELSE 'submitted' END AS outcome
        FROM x LEFT JOIN s USING (test, username) LEFT JOIN d USING (test, username) LEFT JOIN n USING (test, username) LEFT JOIN l USING (test, username)""",
    "w3_start_stream": f"WITH {_E} SELECT test, username, seq FROM e WHERE kind = 'start' QUALIFY row_number() OVER (PARTITION BY test, username ORDER BY ts, seq) = 1",
    "w4_limiter_stream": """WITH s AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN (ts, event_id) END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cleared FROM events),
        c AS (SELECT s.event_id AS seq, count(f.ts) AS recent FROM s LEFT JOIN events f ON f.event_type = 'click' AND f.user_id = s.user_id AND (f.ts, f.event_id) <= (s.ts, s.event_id) AND f.ts > s.ts - INTERVAL 5 DAY AND (s.cleared IS NULL OR (f.ts, f.event_id) > s.cleared) GROUP BY s.event_id)
        SELECT seq, recent::INT AS recent, recent >= 3 AS blocked FROM c""",
    "w5_edit_overlay": "SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "w5_folded_overlay": "SELECT user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    # what was last heard of a running job at least three days before the end of the feed
    "w6_job_states": """WITH j AS (SELECT (event_id % 700)::VARCHAR AS job, (event_id % 700 % 9)::VARCHAR AS slug, ts, event_type, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY event_id % 700 ORDER BY ts DESC, event_id DESC) = 1)
        SELECT job, slug, CASE WHEN event_type IN ('click', 'view') AND ts + INTERVAL 3 DAY <= (SELECT max(ts) FROM events) THEN 'interrupted' ELSE event_type END AS status, seq FROM j""",
    "w7_usage_tally": "SELECT event_type, count(*) AS calls, sum(floor(value))::BIGINT AS tokens FROM events GROUP BY 1",
    "w8_new_documents": "SELECT doc_id, length(coalesce(text, ''))::INT AS n FROM documents",
}
