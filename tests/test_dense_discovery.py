"""Discovery without a meeting of all rows, against brute force."""

import random

from pyspark.sql import functions as F

from splicelake.operators import discovery as D
from splicelake.operators import fusions as U
from splicelake.operators import sequences as Q


def test_kmer_map_against_brute_force(spark):
    """One piece of most words is the same, so by two pieces all would meet all."""
    r = random.Random(5)
    draw = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    text = {f"p{k}": "".join("ACGTTGCAAC" + draw(10) for _ in range(12)) for k in range(4)} | {"rep": "A" * 140 + "N"}
    words = [(c, i, s[i : i + 20]) for c, s in text.items() for i in range(len(s) - 19)]
    kmers = {w for _, _, w in words[::5]} | {w[:7] + "A" + w[8:] for _, _, w in words[::7]} | {draw(20)}
    wrong = lambda a, b: sum(x != y for x, y in zip(a, b))
    want = {k: [(c, i, e) for c, i, w in words if (e := wrong(k, w)) <= 1] for k in kmers}
    got = D.kmer_map(spark.createDataFrame([(k,) for k in kmers] * 2, "kmer string"), spark.createDataFrame(list(text.items()), "contig string, seq string"))
    assert any(len(x) > 100 for x in want.values())
    assert sorted((x.kmer, x.contig, x.at, x.errors) for x in got.collect()) == sorted((k, *p) for k, x in want.items() if len(x) <= 100 for p in x)


def test_kmer_map_where_halves_are_equal(spark):
    """A thousand millions of pairs with an equal half and none alike."""
    n = 30_000
    tail = lambda c: F.concat(F.lit("ACGTTGCAAC"), *[F.translate(F.substring(F.sha1(F.concat(c, F.col("id").cast("string"))), k, 1), "0123456789abcdef", "ACGTACGTACGTACGT") for k in range(1, 11)])
    genome = spark.range(n).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("contig"), tail(F.lit("g")).alias("seq"))
    kmers = spark.range(n).select(tail(F.lit("k")).alias("kmer"))
    assert D.kmer_map(kmers, genome).where("errors > 1").count() == 0


def test_resolved_against_brute_force(spark):
    r = random.Random(6)
    rows = {(r.choice("ab"), "b", r.randrange(60), r.randrange(60), r.choice(["ff", "fr"])): r.randrange(1, 5) for _ in range(900)}
    kept = []
    for (a, b, x, y, d), n in rows.items():
        better = ((a, b, x + i, y + j, d) for i in range(-9, 10) if i for j in (i, -i))
        if not any(rows.get(o, 0) > n or (rows.get(o, 0) == n and o[2] < x) for o in better):
            kept.append((a, b, x, y, d, n))
    got = D.resolved(spark.createDataFrame([(*k, n) for k, n in rows.items()], "contig1 string, contig2 string, lft long, rgt long, dir string, n long"))
    assert sorted(map(tuple, got.collect())) == sorted(kept) and len(kept) < len(rows)


def test_spanned_pairs_and_others(spark):
    r = random.Random(7)
    text = {f"p{k}": "".join(r.choice("ACGTN") for _ in range(400)) for k in range(2)}
    genome = spark.createDataFrame(list(text.items()), "contig string, seq string")
    places = lambda s, m: [i for i in range(len(s) - 1) if s[i : i + 2] == m]
    all_pairs = [(c, d, a + 2, s[d - 5 : d] + s[a + 2 : a + 7]) for c, s in text.items() for d in places(s, "GT") for a in places(s, "AG") if 20 <= a + 2 - d < 90 and d >= 5 and a + 7 <= len(s)]
    own = {p[3] for p in all_pairs[::3]}
    kmers = spark.createDataFrame([(k,) for k in own for _ in range(3)], "kmer string")
    parts = D.sites(genome, "GT"), D.sites(genome, "AG"), genome, kmers
    want = sorted(p[:3] for p in all_pairs if p[3] in own)
    plan = D.butterfly(*parts, least=20, most=90)
    assert sorted(map(tuple, plan.collect())) == want
    asked = [p[:3] for p in all_pairs] + [("c9", 1, 50), ("p0", 3, 9)]
    rest = D.not_spanned(spark.createDataFrame(asked * 2, "contig string, donor long, acceptor long"), *parts, least=20, most=90)
    assert sorted(map(tuple, rest.collect())) == sorted(set(asked) - set(want))


def test_equal_ranges_are_fetched_once(spark):
    """Rows that ask for the same bases do not meet at their tile."""
    tiled = Q.tiles(spark.createDataFrame([("p", "ACGTACGTACGT")], "contig string, seq string"), size=4)
    rows = spark.range(2000).selectExpr("id", "'p' as c", "id % 3 as s", "id % 3 + 5 as e").unionByName(spark.createDataFrame([(-1, "q", 1, 3), (-2, None, 1, 3)], "id long, c string, s long, e long"))
    got = {x.id: x.bases for x in Q.fetch(rows, tiled, "c", "s", "e", size=4).collect()}
    assert got == {k: "ACGTACGTACGT"[k % 3 : k % 3 + 5] for k in range(2000)} | {-1: "", -2: ""}


def test_slots_against_brute_force(spark):
    r = random.Random(8)
    reads = [(r.randrange(3), r.choice("lr"), a := r.randrange(0, 40), a + r.randrange(-2, 30)) for _ in range(200)]
    want = {}
    for f, s, a, b in reads:
        for k in range(a, min(b, 30)):
            want[f, s, k] = want.get((f, s, k), 0) + 1
    got = U.slots(spark.createDataFrame(reads, "fusion_id long, side string, near long, far long"), 30)
    assert {(x.fusion_id, x.side, x.slot): x.depth for x in got.collect()} == want


def test_scored_cuts_of_many_runs():
    """Fifty thousand runs, each a stretch of its own."""
    runs = [(100 * k, 100 * k + 3) for k in range(50_000)]
    assert Q.scored_cuts(runs, least=3, penalty=10) == runs
