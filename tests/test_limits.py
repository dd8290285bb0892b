import random

from pyspark.sql import functions as F

from corvane.operators import relations


def test_success_clears_failures(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice("ab"), rng.randrange(-3000, 4000), rng.choice(["failure", "failure", "success", "other"])) for k in range(400)]
    rows += [(500, "c", 0, "failure"), (501, "c", 50, "failure"), (502, "c", 60, "success"), (503, "c", 70, "other"), (504, "c", 80, "failure"), (505, "c", 180, "other")]
    frame = spark.createDataFrame(rows, "id int, key string, s int, kind string").withColumn("ts", F.timestamp_seconds("s"))
    out = relations.trailing_limit(frame, "key", "ts", 100, 2, F.col("kind") == "failure", F.col("kind") == "success")
    got = {r.id: (r.recent, r.blocked) for r in out.collect()}
    for k, key, at, _ in rows:
        cleared = max((s for _, o, s, kind in rows if o == key and kind == "success" and s <= at), default=-(10**9))
        want = sum(o == key and kind == "failure" and at - 100 <= s <= at and s > cleared for _, o, s, kind in rows)
        assert got[k] == (want, want >= 2)
    assert out.columns == [*frame.columns, "recent", "blocked"] and got[503] == (0, False) and got[505] == (1, False)
    hot = relations.trailing_limit(frame.withColumn("key", F.lit("k")), "key", "ts", 100, 2)
    assert hot.count() == len(rows) and "slice" in hot._jdf.queryExecution().toString()


def test_as_of_carries_anchors_over_slices(spark):
    rng = random.Random(7)
    rows = [(k, rng.choice(["a", "b", None]), rng.randrange(1000), rng.random() < 0.05) for k in range(500)]
    frame = spark.createDataFrame(rows, "id int, key string, at int, hit boolean")
    got = {r.id: r.anchor for r in relations.as_of(frame, "key", ["at", "id"], F.col("hit"), F.col("id"), F.floor(F.col("at") / 50)).collect()}
    for k, key, at, _ in rows:
        assert got[k] == max(((s, i) for i, o, s, hit in rows if o == key and hit and (s, i) <= (at, k)), default=(0, None))[1]
