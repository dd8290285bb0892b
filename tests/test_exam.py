import pytest
from pyspark.sql import functions as F

from corvane.operators import exam, grading, overlay, reports, schedule


def test_choice_points(spark):
    rows = [("b", " B. x", 1.0), ("", "", 0.0), (" ", "", 0.0), (None, "A", 0.0), ("a", None, 0.0), (" a ", "abc", 1.0), ("b", "ab", 0.0)]
    frame = spark.createDataFrame(rows, "pick string, key string, want double")
    assert frame.where(exam.choice_points(F.col("pick"), F.col("key")) != F.col("want")).count() == 0
    assert frame.where(grading.choice_points(F.col("pick"), F.col("key")) != F.col("want")).count() == 0


def test_matching_needs_left_rows(spark):
    row = spark.sql("SELECT array('1', '2') AS l, map('1', 'A', '2', 'B', '3', 'C') AS k, map('1', 'A', '2', 'x', '3', 'C') AS p, map('1', 'A') AS one")
    points = lambda p: row.select(exam.matching_points(F.col("l"), F.col("k"), F.col(p), F.lit(3.0)).alias("x")).first().x
    assert points("p") == 1.0 and points("one") == 1.0
    assert spark.sql("SELECT array('1') AS l, map() AS k").select(exam.matching_points(F.col("l"), F.col("k").cast("map<string,string>"), F.col("k").cast("map<string,string>"), F.lit(3.0)).alias("x")).first().x == 0.0


def test_first_add_wins_and_gets_defaults(spark):
    items = spark.createDataFrame([("1", "t", "frq")], "number string, topic string, qtype string")
    adds = spark.createDataFrame([("2", "", 1), ("2", "late", 2), ("1", "taken", 1), (None, "none", 1)], "number string, topic string, ord int")
    out = overlay.apply_adds(items, adds, ["number"], "ord", {"topic": F.lit("Other / General"), "qtype": F.lit("frq")})
    assert sorted(map(tuple, out.collect())) == [("1", "t", "frq"), ("2", "Other / General", "frq")]


def test_present_null_overrides(spark):
    items = spark.createDataFrame([("1", "x", 3), ("2", "y", 4)], "number string, text string, page int")
    edits = spark.createDataFrame([("1", "text", None, 2), ("1", "text", "old", 1), ("2", "page", "7", 1), ("2", "other", "z", 1)], "number string, field string, value string, at int")
    table = overlay.override_table(edits, ["number"], "field", "value", F.col("at"), ["text", "page"])
    assert sorted(map(tuple, overlay.apply_overrides(items, table, ["number"], ["text", "page"]).collect())) == [("1", None, 3), ("2", "y", 7)]


def test_images_move(spark):
    items = spark.createDataFrame([("d", "1", ["a", "b", "c"]), ("d", "2", None), ("e", "1", ["a"])], "doc string, number string, images array<string>")
    detached = spark.createDataFrame([("d", "a")], "doc string, image string")
    assigned = spark.createDataFrame([("d", "c", "2", 0), ("d", "z", "2", 1), ("d", "z", "1", 1), ("d", "c", "9", 0)], "doc string, image string, number string, ord int")
    got = {(r.doc, r.number): r.images for r in overlay.reassign_images(items, "doc", "number", "images", detached, assigned).collect()}
    assert got == {("d", "1"): ["b", "z"], ("d", "2"): ["c", "z"], ("e", "1"): ["a"]}


def test_stale_verdicts(spark):
    items = spark.createDataFrame([("1", "text", "A"), ("2", "new", "A"), ("3", "", "A"), ("4", "text", "B"), ("5", "text", None)], "number string, text string, answer string")
    verdicts = spark.createDataFrame([(str(k), "correct", "text", "A" if k < 5 else None) for k in range(1, 6)], "number string, status string, text_at string, answer_at string")
    got = {r.number: r.stale for r in overlay.replay_verdicts(items, verdicts, ["number"], "text", "answer").collect()}
    assert got == {"1": False, "2": True, "3": False, "4": True, "5": False}


def test_agenda(spark):
    ts = lambda s: F.lit(s).cast("timestamp")
    roster = spark.createDataFrame([("u", "c"), ("v", "c")], "username string, slug string")
    windows = spark.createDataFrame([("w", "c")], "window string, slug string").withColumns({"opens_at": ts("2020-01-01"), "closes_at": ts("2099-01-01")})
    none = spark.createDataFrame([], "test string, username string, opens_at timestamp, closes_at timestamp")
    answers = spark.createDataFrame([("t", "v", "submitted", True)], "test string, username string, status string, released boolean")
    test = lambda status: spark.createDataFrame([("t", "w", "c", status)], "test string, window string, slug string, status string")
    rows = {r.username: (r.bucket, r.released) for r in schedule.agenda(roster, windows, test("live"), none, answers, ts("2024-01-01")).collect()}
    assert rows == {"u": ("current", False), "v": ("past", True)}
    assert schedule.agenda(roster, windows, test("preparing"), none, answers, ts("2024-01-01")).count() == 0
    own = spark.createDataFrame([("t", "u")], "test string, username string").withColumns({"opens_at": ts("2030-01-01"), "closes_at": ts("2031-01-01")})
    assert {r.username: r.bucket for r in schedule.agenda(roster, windows, test("live"), own, answers, ts("2024-01-01")).collect()}["u"] == "upcoming"
    edge = {r.username: r.bucket for r in schedule.agenda(roster, windows, test("live"), none, answers, ts("2099-01-01")).collect()}
    assert edge["u"] == "current"


@pytest.mark.parametrize("parts", [1, 7])
def test_unique_keys(spark, parts):
    names = ["Ann Lee", "ann-lee", "ANN LEE", "Bo", "Bo2", "bo", "4th", None, "!!", "x" * 40, "x" * 41, "Ann Lee 3"]
    rows = spark.createDataFrame(list(enumerate(names)), "k int, name string").repartition(parts)
    existing = spark.createDataFrame([("annlee2",), ("s4th",)], "username string")
    got = {r.k: r.username for r in reports.unique_keys(rows, "name", "k", existing, "username").collect()}
    assert len(set(got.values())) == len(names) and not set(got.values()) & {"annlee2", "s4th"}
    assert got[0] == "annlee" and got[11] == "annlee3" and {got[1], got[2]} == {"annlee4", "annlee5"} and got[3] == "bo" and got[4] == "bo2" and got[5] == "bo3"
    assert got[6] == "s4th2" and {got[7], got[8]} == {"student", "student2"} and got[9] == "x" * 32 and len(got[10]) <= 32


def test_groups_are_taken_whole(spark):
    pool = spark.createDataFrame([(g, k) for g in range(20) for k in range(g % 4 + 1)], "g int, k int")
    full = pool.union(spark.createDataFrame([(g, 99) for g in range(20)], "g int, k int"))
    for n in (1, 7, 30, 500):
        got = {(r.g, r.k) for r in reports.sample_groups(pool, full, "g", "k", n, 1).collect()}
        groups = {g for g, _ in got}
        sizes = [g % 4 + 2 for g in groups]  # members outside the pool count, as the taker gets them
        assert got == {(r.g, r.k) for r in full.collect() if r.g in groups} and (sum(sizes) >= n or len(groups) == 20) and sum(sizes) - max(sizes) < max(n, 1) + 4


def test_score_cells_and_who_may_open(spark):
    totals = spark.createDataFrame([("t", "u", 3.0, 4.0, True), ("t", "v", 1.0, 4.0, None), ("open", "u", 2.0, 2.0, True), ("t", "stranger", 4.0, 4.0, True)], "test string, student string, earned double, possible double, released boolean")
    complete = spark.createDataFrame([("t", True), ("t", True), ("open", False)], "test string, complete boolean")
    roster = spark.createDataFrame([("u",), ("u",), ("v",), ("w",), (None,)], "student string")
    visible = spark.createDataFrame([("h", "t", "v"), ("h", "t", "v"), ("u", "t", "u"), ("h", "gone", "u")], "viewer string, test string, student string")
    cells = lambda viewer, role: {(r.student, r.test, r.pending, r.detail_ok) for r in exam.score_cells(totals, complete, roster, visible, viewer, role).collect()}
    bare = {("w", None, None, None), (None, None, None, None)}
    assert cells("h", "volunteer") == bare | {("u", "t", False, False), ("v", "t", True, True)}
    assert cells("u", "student") == bare | {("u", "t", False, True), ("v", "t", True, False)}
    assert cells("c", "coach") == bare | {("u", "t", False, True), ("v", "t", True, True)}
    assert exam.score_cells(totals.limit(0), complete, roster, visible, "c", "coach").where("detail_ok is not null").count() == 0

    viewers = spark.createDataFrame([("c", "coach"), ("c", "coach"), ("h", "volunteer"), ("u", "student"), (None, "coach")], "viewer string, role string")
    asked = spark.createDataFrame([("c", "t", "u", 1), ("c", "none", "x", 2), ("h", "t", "v", 3), ("h", "t", "v", 4), ("h", "t", "u", 5), ("u", "t", "u", 6), ("unknown", "t", "u", 7), (None, "t", "u", 8)], "viewer string, test string, student string, k int")
    got = {r.k: r.may_open for r in exam.may_open(asked, visible, viewers).collect()}
    assert got == {1: True, 2: True, 3: True, 4: True, 5: False, 6: True, 7: False, 8: False}
