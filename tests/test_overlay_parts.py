"""Overlays deal their rows into the set number of partitions, so a task's rows do not grow as keys pack well; repeated and null keys keep their rows."""

from collections import Counter

import pytest

from corvane.operators import assessment
from corvane.plans import assessment as assessment_plans
from corvane.plans import overlay as overlay_plans

SF = "/root/testdata/sf0.001"


def test_overlay_rows_with_repeated_and_null_keys(spark):
    make = lambda rows: spark.createDataFrame(rows, "k long, v string")
    base = make([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")])
    deletes = make([(2, ""), (2, ""), (None, ""), (9, "")])
    adds = make([(1, "x"), (2, "y"), (2, "z"), (4, "w"), (4, "w"), (None, "n")])
    got = Counter(map(tuple, assessment.overlay_rows(base, "k", deletes, adds).collect()))
    assert got == Counter([(1, "a"), (1, "b"), (3, "d"), (None, "e"), (2, "y"), (2, "z"), (4, "w"), (4, "w"), (None, "n")])


@pytest.mark.parametrize("query", [assessment_plans.e2_overlay, overlay_plans.e1_deletes])
def test_no_table_of_keys_is_held_and_partitions_stay(spark, query):
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = query(spark, SF)
        assert "Aggregate" not in rows._jdf.queryExecution().executedPlan().toString()
        assert rows.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
