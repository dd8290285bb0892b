import pytest
from pyspark.sql import functions as F

from corvane.operators import assessment, layout, reports, schedule


@pytest.mark.parametrize("count", [0, 3, 10])
def test_numbers_follow_the_order(spark, count):
    rows = spark.range(count).select((F.col("id") * 7 % 11).alias("k"))
    got = {r.k: r.number for r in reports.assign_numbers(rows, F.lit(5), F.floor(F.col("k") / 3), ["k"]).collect()}
    assert got == {k: 5 + j for j, k in enumerate(sorted(got))} and len(got) == count


def test_contexts_stay_together(spark):
    rows = spark.createDataFrame([(1, None), (2, "a"), (3, "b"), (4, "a"), (5, None), (6, "b")], "k int, c string")
    got = reports.cluster_contexts(rows, "k", F.col("c")).orderBy("anchor", "within", "k").collect()
    assert [r.k for r in got] == [1, 2, 4, 3, 6, 5]


def test_logs(spark):
    lines = spark.createDataFrame([("j", k, f"l{k}") for k in range(1, 8)] + [("s", 1, "only")], "job string, n int, line string")
    got = sorted(map(tuple, reports.truncate_log(lines, "job", "n", "line", 3).collect()))
    assert got == [("j", 4, "… 4 earlier lines dropped"), ("j", 5, "l5"), ("j", 6, "l6"), ("j", 7, "l7"), ("s", 1, "only")]
    assert reports.log_tail(lines, "job", "n", 6).count() == 1


def test_canonical_items(spark):
    rows = spark.sql("SELECT array('x', '', 'y') AS o, array(1, 0, 9, -1) AS a, array('t') AS t UNION ALL SELECT null, array(0), array('free') UNION ALL SELECT array(''), null, null")
    got = [(["".join(c) for c in r.i.choices], r.i.answer) for r in rows.select(reports.canonical_item(F.col("o"), F.col("a"), F.col("t")).alias("i")).collect()]
    assert got == [(["Ax", "Cy"], "C, A"), ([], "free"), ([], "")]


def test_order_with_blank_years(spark):
    rows = spark.createDataFrame([(1, "2020", "2"), (1, "2020", "10"), (1, "", "1"), (1, None, "0"), (0, "1999", "5"), (1, "2021", "9")], "t int, y string, n string")
    assert [r.n for r in rows.orderBy(*reports.bank_order("t", "y", "n")).collect()] == ["5", "9", "10", "2", "0", "1"]


def test_copied_rosters(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "slug string, username string")
    users = spark.createDataFrame([("u", False), ("v", True), ("w", False)], "username string, disabled boolean")
    lineup = spark.createDataFrame([("a",), ("b",), ("d",)], "slug string")
    roster, counts = schedule.copy_roster(pairs([("a", "u"), ("a", "v"), ("b", "v"), ("c", "w"), ("a", "gone")]), pairs([("a", "w"), ("b", "w"), ("d", "u")]), lineup, users)
    assert sorted(map(tuple, roster.collect())) == [("a", "u"), ("b", "w"), ("d", "u")] and sorted(map(tuple, counts.collect())) == [("a", 1), ("b", 0)]


def test_interval_rows(spark):
    rows = spark.createDataFrame([("p", 1.0), ("p", 5.0), ("q", 0.0)], "page string, y double")
    points = spark.createDataFrame([("p", 0.5, "above"), ("p", 1.0, "b"), ("p", 4.9, "a"), ("p", 5.0, "c"), ("r", 1.0, "none")], "page string, at double, image string")
    got = {(r.page, r.y): r.image for r in layout.assign_interval(rows, points, ["page"], "y", "at").collect()}
    assert got == {("p", 1.0): "b", ("p", 5.0): "c", ("q", 0.0): None}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc string, number string, text string, page int, y double")
    assert layout.locate_pages(none, none, "doc", "number", "text").count() == 0
    assert layout.assign_images(none, "doc", ["y"], "page", F.col("number"), F.col("text")).count() == 0
    assert reports.sample_groups(none, none, "doc", "number", 3, 1).count() == 0 and reports.doc_status(none, none, "doc", F.lit(True), F.lit(True)).count() == 0
    assert assessment.ordered_union([none, none], "doc", "y").count() == 0


def test_status_page_is_sorted_in_either_direction(spark):
    status = spark.createDataFrame([("b", 2, 0, 1, True), ("a", 2, 0, 0, True), ("c", 0, 0, 0, False)], "doc string, items int, images int, answers int, processed boolean")
    edited, keyed = spark.createDataFrame([("a",), ("a",), (None,)], "doc string"), spark.createDataFrame([("c",)], "doc string")
    rows = lambda *a: [(r.doc, r.edited, r.has_key) for r in reports.status_page(status, edited, keyed, "doc", *a).collect()]
    assert rows() == [("a", True, False), ("b", False, False), ("c", False, True)] == rows("unknown")
    assert [r[0] for r in rows("questions", True)] == ["a", "b", "c"] and [r[0] for r in rows("questions")] == ["c", "a", "b"] and [r[0] for r in rows("name", True)] == ["c", "b", "a"]
