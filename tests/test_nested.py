"""Intervals inside others, counted without pairs."""

import random

from pyspark.sql import functions as F

from splicelake.operators import intervals as I


def test_nested_equals_all_pairs(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice("ab"), s := rng.randrange(5000), s + rng.choice([0, 1, 30, 400, 2500])) for k in range(400)]
    rows += rows[:40] + [(k, "a", 100, 3000) for k in range(5)] + [(7, "a", 0, 9000), (900, None, 1, 5), (901, "a", None, 5), (None, "a", 200, 210)]
    want = {}
    for k, c, s, e in rows:
        for k2, c2, s2, e2 in rows:
            if None not in (k, k2, c, s, s2) and c == c2 and k != k2 and s < e and s2 < e2 and s2 >= s and e2 <= e:
                want[k] = want.get(k, 0) + 1
    df = spark.createDataFrame(rows, "id long, c string, s long, e long")
    got = I.nested(df, "id", "c", "s", "e", "n")
    assert {r.id: r.n for r in got.collect()} == want
    assert got.where("n is null").count() == 0


def test_nested_makes_no_pairs(spark):
    df = spark.range(4000).select("id", F.lit("a").alias("c"), (F.col("id") % 7).alias("s"), (F.col("id") % 7 + 50).alias("e"))
    got = I.nested(df, "id", "c", "s", "e", "n")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_in" in plan and "_low_a" not in plan
    assert got.where("id % 7 = 3").first().n == 570
