"""Joins of blocks that are not broadcast."""

from pyspark.sql import functions as F

from splicelake.operators import intervals as I


def test_blocks_are_not_broadcast(spark):
    points = spark.createDataFrame([("a", 5), ("a", 50)], "c string, at long")
    right = spark.createDataFrame([("a", 0, 10, "x"), ("a", 3, 60, "w")], "rc string, s long, e long, name string")
    got = I.least_over(points, "c", "at", I.Side(right, "rc", "s", "e"), F.col("name"), "least")
    assert "strategy=merge" in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.select("at", "least").collect())) == [(5, "w"), (50, "w")]
