"""Grades of whole responses count like a grade for each free-text item; lists of pairs are made without shuffling them."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.operators import exam
from corvane.plans import exam as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def given(spark):
    items = [("t", k, ("mcq", "frq")[k % 2], 2.0) for k in range(7)] + [("u", 1, "mcq", 1.0), ("v", 1, "frq", 3.0)]
    snapshot = spark.createDataFrame(items, "test string, number long, qtype string, max_points double")
    responses = spark.createDataFrame([(t, s, "in_progress" if s == 3 else "submitted", False) for t in "tuv" for s in range(1, 5)], "test string, student long, status string, released boolean")
    manual = spark.createDataFrame([("t", 1, 1, 0.5, 7), ("t", 1, 3, None, 7), ("t", 2, 99, 2.0, 7), ("v", 1, 1, 3.0, 7)], "test string, student long, number long, points double, graded_by long")
    auto = spark.createDataFrame([("t", 1, 0, 1.0), ("t", 2, 2, 0.0)], "test string, student long, number long, points double")
    whole = spark.createDataFrame([("t", 1, 1.0, 9), ("t", 2, 1.0, 9), ("t", 4, 1.5, 9), ("u", 1, 1.0, 9), ("v", 2, 1.0, 8)], "test string, student long, points double, graded_by long")
    each = whole.join(snapshot.where("qtype = 'frq'").select("test", "number"), "test").join(manual.where("points is not null").select("test", "student", "number"), ["test", "student", "number"], "left_anti")
    expanded = manual.where("points is not null").unionByName(each.select(*manual.columns))
    return snapshot, responses, manual, auto, whole, expanded


def same(a, b):
    return Counter(map(tuple, a.select(*sorted(a.columns)).collect())) == Counter(map(tuple, b.select(*sorted(b.columns)).collect()))


def test_whole_grades_stand_for_each_item(spark, given):
    snapshot, responses, manual, auto, whole, expanded = given
    assert same(exam.complete_tests(snapshot, responses, manual, whole), exam.complete_tests(snapshot, responses, expanded))
    assert same(exam.score_totals(snapshot, responses, auto, manual, whole), exam.score_totals(snapshot, responses, auto, expanded))
    answers = spark.createDataFrame([("t", 1, 1, "a"), ("t", 2, 3, "b"), ("t", 2, 2, "c"), ("v", 4, 1, None)], "test string, student long, number long, picked string")
    assert same(exam.worklist(snapshot, responses, answers, manual, whole), exam.worklist(snapshot, responses, answers, expanded))
    viewers = spark.createDataFrame([(9, "volunteer"), (8, "volunteer"), (7, "volunteer"), (1, "student")], "viewer long, role string")
    assigned = spark.createDataFrame([("u", 7)], "test string, viewer long")
    assert same(exam.visible_responses(responses, manual, snapshot, assigned, viewers, whole), exam.visible_responses(responses, manual.unionByName(expanded), snapshot, assigned, viewers))


def test_grades_grow_with_the_lines(spark):
    rows = plans._manual(spark, SF).count() + plans._whole(spark, SF).count()
    assert rows <= spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_a_worklist_is_not_shuffled(spark, given):
    snapshot, responses, manual, _, _, _ = given
    answers = responses.select("test", "student", F.lit(1).cast("long").alias("number"), F.lit("a").alias("picked"))
    plan = exam.worklist(snapshot, responses, answers, manual)._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan.splitlines() if "Exchange" in x or "Join" in x]
    assert "Join" in lines[0]
