from folioscan.operators.skew import spread_join


def test_every_pair_once(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}") for i in range(300)] + [(999, None)], "a long, x string")
    right = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 5}") for i in range(200)] + [(999, None)], "b long, y string")
    got = spread_join(left, right, "x", "y", "a", per_task=20)
    want = left.join(right, left.x == right.y)
    assert got.columns == want.columns and got.count() == want.count() and got.exceptAll(want).count() == 0
    assert spread_join(left.limit(0), right, "x", "y", "a").count() == 0
