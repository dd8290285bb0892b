"""Score pages grade the responses of complete tests only, and show the same as if all were graded."""

from collections import Counter

from corvane.operators import exam
from corvane.plans import exam as plans

SF = "/root/testdata/sf0.001"


def rows(df):
    return Counter(map(tuple, df.select(*sorted(df.columns)).collect()))


def test_rows_of_complete_tests_keep_their_number(spark):
    complete = spark.createDataFrame([("t", True), ("t", True), ("u", False), (None, True), ("w", None)], "test string, complete boolean")
    given = spark.createDataFrame([("t", 1), ("t", 1), ("u", 2), ("w", 3), (None, 4), ("x", 5)], "test string, n int")
    assert rows(exam.of_complete(given, complete)) == Counter({(1, "t"): 2})


def test_other_tests_leave_before_they_are_graded(spark):
    complete, totals = plans._shown(spark, SF)
    ready = complete.where("complete").select("test")
    assert 0 < ready.count() < complete.count()
    assert rows(totals) == rows(plans.a7_totals(spark, SF).join(ready, "test", "left_semi"))
    assert len(totals.inputFiles()) and "complete-" in totals._jdf.queryExecution().executedPlan().toString()
