"""Neighbours, running sums and counts in bins against plain loops over whole contigs."""

import random

import pytest
from pyspark.sql import functions as F

from splicelake.operators import fusions as U
from splicelake.operators import intervals as I
from splicelake.operators import variants as V


@pytest.fixture
def small_bins(monkeypatch):
    monkeypatch.setattr(I, "ORDERED_BIN", 50)


@pytest.fixture
def rows():
    rng = random.Random(1)
    return [(rng.choice("abc"), rng.choice([rng.randint(0, 900), 100, 250]), i) for i in range(300)]


def test_neighbours_and_sums(spark, small_bins, rows):
    df = spark.createDataFrame(rows, "contig string, pos long, id long")
    order = F.struct("pos", "id")
    after = {(r.id, r.x.id if r.x else None) for r in I.beside(df, "contig", "pos", order, "x").collect()}
    before = {(r.id, r.x.id if r.x else None) for r in I.beside(df, "contig", "pos", order, "x", before=True).collect()}
    sums = {r.id: r.x for r in I.running(df, ["contig"], "pos", ["pos", "id"], F.col("id"), "x").collect()}
    for contig in "abc":
        ids = [i for _, _, i in sorted(r for r in rows if r[0] == contig)]
        assert set(zip(ids, [*ids[1:], None], strict=True)) <= after and set(zip(ids, [None, *ids[:-1]], strict=True)) <= before
        assert [sums[i] for i in ids] == [sum(ids[: k + 1]) for k in range(len(ids))]
    assert len(after) == len(before) == len(rows)


def test_dense_snps(spark, rows):
    df = spark.createDataFrame([(c, p * 700, i, "A", "C") for c, p, i in rows], "contig string, pos long, site long, ref string, alt string")
    got = {r.site: r.n_near for r in V.dense(df, window=5000, most=3).collect()}
    want = {i: n for c, p, i in rows if (n := sum(d == c and abs(q - p) * 700 <= 5000 for d, q, _ in rows)) > 3}
    assert got == want and want


def test_genes_inside_an_earlier_one(spark, small_bins):
    rng = random.Random(2)
    genes = [(rng.choice("ab"), s, s + rng.choice([10, 30, 400]), f"{'MIR' if i % 9 == 0 else 'G'}{i}") for i, s in enumerate(rng.randint(0, 2000) for _ in range(150))]
    got = {r.gene for r in U.clean_genes(spark.createDataFrame(genes, "contig string, start long, end long, gene string")).collect()}
    want, reach = set(), {}
    for c, s, e, g in sorted((g for g in genes if not g[3].startswith("MIR")), key=lambda g: (g[0], g[1], -g[2], g[3])):
        if e > reach.get(c, -1):
            want.add(g)
        reach[c] = max(e, reach.get(c, -1))
    assert got == want and len(want) < 130


def test_clusters_and_assembled(spark, small_bins):
    rng = random.Random(3)
    rows = [(i, "a", rng.choice("bc"), rng.randint(0, 3000), rng.randint(0, 900), rng.choice(["ff", "fr"])) for i in range(120)]
    df = spark.createDataFrame(rows, "fusion_id long, contig1 string, contig2 string, lft long, rgt long, dir string")
    got = {}
    for r in U.clusters(df, reach=60).collect():
        got.setdefault(r.cluster, set()).add(r.fusion_id)

    def parts(group, k):
        out, last = [], None
        for r in sorted(group, key=lambda r: (r[k], r[0])):
            if last is None or r[k] - last > 60:
                out.append([])
            out[-1].append(r)
            last = r[k]
        return out

    groups = {}
    for r in rows:
        groups.setdefault((r[1], r[2], r[5]), []).append(r)
    want = [frozenset(r[0] for r in q) for g in groups.values() for p in parts(g, 3) for q in parts(p, 4)]
    assert {frozenset(x) for x in got.values()} == set(want) and len(want) > 40
    counts = {r.fusion_id: r.n_assembled for r in U.assembled(df).collect()}
    assert counts == {r[0]: sum(o[1:3] == r[1:3] and o[4] == r[4] for o in rows) - 1 for r in rows}
