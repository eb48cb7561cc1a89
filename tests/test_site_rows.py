"""Distance bias and rows of ten genotypes against plain versions."""

import math
import random
from itertools import combinations

import pytest

from splicelake.operators import variants as V


def plain_bias(rows):
    total = weight = 0.0
    for sample in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == sample and r[3] is not None and r[5] != r[6] and not r[7]]
        n = len(own)
        if n < 2:
            continue
        gaps = [abs(a[3] - b[3]) for a, b in combinations(own, 2)]
        m, size, cap = int(sum(gaps) / len(gaps)), sum(r[4] for r in own) // n, min(n, 5)
        mu = size / 2.9
        if n == 2:
            p = 1 / size if m == 0 else (size - m) * 2 / size / size
        elif n == 3:
            p = 0 if m > 2 * mu else math.sin(m * 3.14 / 2 / mu) / (4 * mu / 3.14)
        else:
            v = (size / 1.9 / (cap + 1)) ** 2
            p = math.exp(-((m - mu) ** 2) / (2 if m < mu else 3.125) / v) / (1.125 * math.sqrt(2 * 3.14 * v))
        total, weight = total + p * cap, weight + cap
    return total / weight if weight else 1.0


def test_distance_bias(spark):
    rng = random.Random(3)
    rows = []
    for pos in range(40):
        for _ in range(rng.randint(1, 25)):
            sample, size = rng.choice("xyz"), rng.randint(30, 60)
            rows.append(("c", pos, sample, rng.choice([None, *[rng.randrange(30) for _ in range(9)]]), size, rng.choice("ACG"), "A", rng.random() < 0.1))
    schema = "contig string, pos long, sample string, qpos int, read_len int, base string, ref string, is_del boolean"
    frame = spark.createDataFrame(rows, schema)
    got = {r.pos: r.vdb for r in V.distance_bias(frame).collect()}
    assert set(got) == {r[1] for r in rows} and 1.0 in got.values()
    for pos, value in got.items():
        assert value == pytest.approx(plain_bias([r for r in rows if r[1] == pos]), abs=1e-12)
    assert V.distance_bias(frame.limit(0)).count() == 0


def test_ten_genotypes(spark):
    schema = "contig string, pos long, ref string, alts array<string>, depth long, mq long, samples array<struct<sample: string, pls: array<long>>>"
    six = [10, 11, 12, 13, 14, 15]
    rows = [
        ("c", 1, "G", ["A", "X"], 7, 30, [("s1", six), ("s2", [0] * 6), ("s3", six), ("s4", None)]),
        ("c", 2, "A", ["C"], 1, 30, [("s1", [5, 6, 7]), ("s2", [5, 6, 7])]),
        ("c", 3, "A", ["CC"], 9, 30, [("s1", six)]), ("c", 4, "N", ["C"], 9, 30, [("s1", six)]), ("c", 5, "AC", ["A"], 9, 30, [("s1", six)]), ("c", 6, "A", [], 9, 30, [("s1", six)]),
        ("c", 7, "A", ["C"], 0, 30, [("s1", six)]), ("c", 8, None, ["C"], 4, 30, [("s1", six)]), ("c", 9, "A", None, 4, 30, [("s1", six)]), ("c", 10, "A", ["C"], 4, 30, None), ("c", 11, "A", ["C"], 4, 30, []),
    ]
    got = {(r.pos, r.sample): r for r in V.ten_genotypes(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {(1, "s1"), (1, "s2"), (1, "s3"), (1, "s4"), (2, "s1"), (2, "s2")}
    # alleles: G 0, A 1, X 2 for C and T; genotype (low, high) is at high * (high + 1) / 2 + low
    assert got[1, "s1"].likelihoods == [12, 14, 11, 14, 15, 13, 15, 10, 13, 15]
    assert [got[1, f"s{k}"].depth for k in (1, 2, 3, 4)] == [2, 0, 2, 3]  # 7 / 4, none, 5 / 2 and what is left
    assert got[2, "s1"].likelihoods == [5, 6, None, None, 7, None, None, None, None, None] and got[2, "s2"].depth == 1
    assert got[1, "s4"].likelihoods == [None] * 10
