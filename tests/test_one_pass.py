"""Whether tests are complete is told from one pass over the lines: a row a response, and the same as by the grades themselves."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.operators import exam
from corvane.plans import exam as plans

SF = "/root/testdata/sf0.001"


def rows(df):
    return Counter(map(tuple, df.select(*sorted(df.columns)).collect()))


def lines_read(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("FileScan" in x and "l_suppkey" in x for x in plan.splitlines())


def test_lines_are_read_once(spark):
    assert lines_read(plans.a9_complete(spark, SF)) == 1
    assert lines_read(plans.g6_release(spark, SF)) == 0  # its responses are a table, made when called


def test_responses_are_shuffled_by_their_own_keys_once(spark):
    marks = spark.createDataFrame([("t", 1, 1, True)], "test string, student long, number long, counts boolean")
    plan = exam.graded_responses(marks)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange" in x for x in plan.splitlines()) == 1


@pytest.mark.parametrize("graded", [(), (("t", 1, 1), ("t", 1, 3), ("t", 1, 3), ("t", 2, 1), ("t", 2, 3)), (("t", 1, 1), ("t", 1, 3), ("t", 2, 1), ("t", 2, 1)), (("t", 1, 1), ("t", 1, 3), ("t", 2, 3), ("t", 2, 1), ("v", None, 1))])
def test_complete_as_by_the_grades(spark, graded):
    snapshot = spark.createDataFrame([("t", k, ("mcq", "frq")[k % 2]) for k in range(5)] + [("u", 1, "mcq"), ("v", 1, "frq"), ("w", 1, "frq"), ("x", 1, None), ("y", None, "frq")], "test string, number long, qtype string")
    taken = [(t, s, "in_progress" if s == 4 else "submitted") for t in "tu" for s in range(1, 5)] + [("v", None, "submitted"), ("w", 1, "in_progress"), ("x", 1, "submitted"), ("y", 1, "submitted")]
    responses = spark.createDataFrame(taken, "test string, student long, status string")
    manual = spark.createDataFrame([(*g, 1.0) for g in graded], "test string, student long, number long, points double")
    whole = spark.createDataFrame([("t", 3, 2.0), ("t", 1, None)], "test string, student long, points double")
    marks = manual.withColumn("counts", F.lit(True)).drop("points").union(responses.select("test", "student", F.lit(2).cast("long"), F.lit(None).cast("boolean")))
    held = responses.join(exam.graded_responses(marks).where("student is not null"), ["test", "student"], "left").fillna(0, "graded")
    held = held.join(whole.withColumnRenamed("points", "each"), ["test", "student"], "left")
    want = exam.complete_tests(snapshot, responses, manual, whole)
    assert rows(exam.complete_by_response(snapshot, held)) == rows(want)
    assert rows(want.where("test in ('u', 'v', 'w', 'x', 'y')")) == Counter({(True, "u"): 1, (False, "v"): 1, (True, "w"): 1, (True, "x"): 1, (False, "y"): 1})
    assert dict(rows(want.where("test = 't'").select("complete"))) == {(len({*graded} & {("t", s, k) for s in (1, 2) for k in (1, 3)}) == 4,): 1}


def test_grades_of_no_student_and_repeats_count_for_none(spark):
    marks = spark.createDataFrame([("t", None, 1, True), ("t", 1, 1, True), ("t", 1, 1, True), ("t", 1, 2, False), ("t", 1, 3, None), ("t", 2, 1, False)], "test string, student long, number long, counts boolean")
    assert rows(exam.graded_responses(marks)) == Counter({(0, None, "t"): 1, (1, 1, "t"): 1, (0, 2, "t"): 1})


def test_held_responses_have_the_grades_of_the_feed(spark):
    held = plans._held(spark, SF, plans._snapshot(spark, SF))
    assert rows(held.select("test", "student", "status", "released")) == rows(plans._responses(spark, SF))
    want = plans._manual(spark, SF).groupBy("test", "student").agg(F.count("*").alias("graded"))
    assert rows(held.where("graded > 0").select("test", "student", "graded")) == rows(want)
