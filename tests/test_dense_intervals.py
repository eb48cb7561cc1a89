"""Searches for intervals that make no pairs, against brute force and over places where all rows meet."""

import random

from pyspark.sql import functions as F

from splicelake.operators import fusions as U
from splicelake.operators import intervals as I


def drawn(n, seed):
    r = random.Random(seed)
    return [(k, r.choice("ab"), a := r.randrange(-300, 3000), a + r.choice([0, 1, 7, 90, 1500])) for k in range(n)]


def sides(spark, left, right):
    a = spark.createDataFrame(left + [(-1, None, 1, 5), (-2, "a", None, 5), (-3, "a", 5, None)], "i long, c string, s long, e long")
    b = spark.createDataFrame(right + [(-1, None, 1, 5), (-2, "a", None, 5000)], "j long, rc string, rs long, re long")
    return I.Side(a, "c", "s", "e"), I.Side(b, "rc", "rs", "re")


def test_matched_against_brute_force(spark):
    left, right = drawn(150, 1), drawn(12, 2)
    a, b = sides(spark, left, right)
    held = [x for x in right if x[2] < x[3]]
    over = {i for i, c, s, e in left if s < e and any(c == d and s < f and g < e for _, d, g, f in held)}
    inside = {i for i, c, s, e in left if s < e and any(c == d and g <= s and e <= f for _, d, g, f in held)}
    every = {r.i for r in a.rows.collect()}
    ids = lambda df: sorted(r.i for r in df.collect())
    assert over and inside and over != inside
    assert ids(I.matched(a, b)) == sorted(over)
    assert ids(I.matched(a, b, how="anti")) == sorted(every - over)
    assert ids(I.matched(a, b, inside=True)) == sorted(inside)
    assert ids(I.matched(a, b, inside=True, how="anti")) == sorted(every - inside)


def test_depth_and_least_against_brute_force(spark):
    left, right = drawn(150, 3), drawn(40, 4)
    a, b = sides(spark, left, right)
    held = [x for x in right if x[2] < x[3]]
    at = lambda c, s: [j for j, d, g, f in held if c == d and g <= s < f]
    depth = {r.i: r.n for r in I.depth_at(a.rows.where("i >= 0"), "c", "s", b, "n").collect()}
    assert depth == {i: len(at(c, s)) for i, c, s, _ in left} and len(set(depth.values())) > 3
    least = {r.i: r.n for r in I.least_over(a.rows.where("i >= 0"), "c", "s", b, F.col("j"), "n").collect()}
    assert least == {i: min(at(c, s), default=None) for i, c, s, _ in left}


def test_where_all_rows_meet(spark):
    """Ten thousand millions of pairs."""
    n = 100_000
    a = I.Side(spark.range(n).selectExpr("id as i", "'a' as c", "1000L as s", "1010L as e"), "c", "s", "e")
    b = I.Side(spark.range(n).selectExpr("id as j", "'a' as rc", "990 + id % 20 as rs", "1500 + id % 7 as re"), "rc", "rs", "re")
    assert I.matched(a, b).count() == n and I.matched(a, b, inside=True, how="anti").count() == 0
    hits = b.rows.selectExpr("rc as contig", "rs - 20 as lft", "re + 20 as rgt")
    fusions = a.rows.selectExpr("i as fusion_id", "c as contig1", "c as contig2", "s as lft", "e as rgt")
    assert {r.n_against for r in U.contradicting(fusions, hits).collect()} == {sum(990 + k % 20 <= 1000 for k in range(n)) + n}
    genes = b.rows.selectExpr("rc as contig", "rs as start", "re as end", "'g' || (100000 + j) as gene")
    found = U.annotated(fusions, genes)
    assert {(r.gene1, r.gene2) for r in found.select("gene1", "gene2").distinct().collect()} == {("g100000", "g100000")}
