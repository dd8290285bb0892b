from corvane.plans import reports


def test_sets_are_made_before_they_meet(spark):
    plan = reports.d3_jaccard(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(k for k, x in enumerate(plan) if "Join" in x)
    assert not any("regexp_extract_all" in x for x in plan[:join]) and sum("regexp_extract_all" in x for x in plan[join:]) == 2
