from corvane.plans import catalog


def test_key_differs_from_pick(spark):
    got = catalog.QUERIES["g1_key_grading"](spark, "/root/testdata/sf0.001")
    assert got.where("points < answers").count() > 0 and got.where("points > 0").count() > 0
