"""Linkage and phases against plain versions."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np

from splicelake.operators import haplotypes as H
from splicelake.operators import intervals as I


def plain_em(samples):
    """Four haplotype frequencies, a loop for each sum."""
    first = []
    for s in (0, 1):
        told = [max(range(3), key=lambda g: (p[s][g], g)) for p in samples if tuple(p[s]) != (1.0, 1.0, 1.0)]
        first.append(sum(told) / len(told) / 2)
    u, v = first
    f = [(1 - u) * (1 - v), (1 - u) * v, u * (1 - v), u * v]
    for _ in range(50):
        new = [0.0] * 4
        for p in samples:
            joint = {(h, k): f[h] * f[k] * p[0][(h >> 1) + (k >> 1)] * p[1][(h & 1) + (k & 1)] for h in range(4) for k in range(4)}
            total = sum(joint.values())
            for (h, k), x in joint.items():
                new[h] += x / total
                new[k] += x / total
        new = [x / (2 * len(samples)) for x in new]
        moved = max(abs(a - b) for a, b in zip(f, new, strict=True))
        f = new
        if moved < 1e-5:
            break
    return f


def test_haplotype_frequencies(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for pair in range(40):
        samples = []
        for sample in range(rng.randint(1, 12)):
            pls = [[rng.choice([0, 3, 20, 60, 255]) for _ in range(3)] for _ in range(2)]
            rows += [(2 * pair + s, sample, *pls[s]) for s in (0, 1)]
            samples.append([[10 ** (-x / 10) for x in p] for p in pls])
        if all(any(tuple(p[s]) != (1.0, 1.0, 1.0) for p in samples) for s in (0, 1)):
            want[2 * pair] = (len(samples), plain_em(samples))
    got = H.linkage(spark.createDataFrame(rows, "site long, sample int, pl0 long, pl1 long, pl2 long"), spark.createDataFrame([(2 * p, 2 * p + 1) for p in range(40)] + [(0, 1), (5, 999)], "a long, b long"))
    rows = {r.a: r for r in got.collect()}
    assert len(rows) == 40
    for a, (n, f) in want.items():
        r = rows[a]
        assert r.n == n and np.allclose([r.f00, r.f01, r.f10, r.f11], f, atol=1e-9)
        p, q = f[0] + f[1], f[0] + f[2]
        if min(p, q, 1 - p, 1 - q) > 1e-6:
            assert abs(r.r2 - (f[0] * f[3] - f[1] * f[2]) ** 2 / (p * q * (1 - p) * (1 - q))) < 1e-6


def support(path, sites, patterns, counts, k):
    """What reads count for the local haplotypes of a path and their complements; sites before the first are either."""
    best = 0
    for before in itertools.product((0, 1), repeat=k - 1):
        whole, total = [*before, *path], 0
        for site, pattern, n in zip(sites, patterns, counts, strict=True):
            local = whole[site : site + k]
            for side in (local, [1 - x for x in local]):
                total += n * all(c == "0" or int(c) == x + 1 for c, x in zip(pattern, side, strict=True))
        best = max(best, total)
    return best


def test_best_path_is_best():
    rng = random.Random(9)
    for k in (2, 3, 4):
        for _ in range(40):
            n = rng.randint(2, 7)
            sites, patterns, counts = [], [], []
            for _ in range(rng.randint(1, 12)):
                site = rng.randrange(1, n)
                pattern = "".join("0" if site - (k - 1 - j) < 0 else rng.choice("012") for j in range(k - 1)) + rng.choice("12")
                sites.append(site), patterns.append(pattern), counts.append(rng.randint(1, 5))
            path = H.best_path(n, np.array(sites), patterns, np.array(counts), k)
            best = max(support(p, sites, patterns, counts, k) for p in itertools.product((0, 1), repeat=n))
            assert support(list(path), sites, patterns, counts, k) == best


def test_two_haplotypes_are_told_apart(spark):
    """Reads of two haplotypes with some errors, two blocks that no read links, a chimera, a site of its own."""
    rng = random.Random(5)
    truth = {pos: rng.randint(1, 2) for pos in [*range(100, 400, 10), *range(1000, 1300, 10)]}
    places, rows, kind = sorted(truth), [], {}
    for read in range(400):
        first, side = rng.choice(places), read % 2
        own = [p for p in places if first <= p < first + 60]
        kind[read] = (side, len(own))
        rows += [(read, "c", p, (truth[p] if side == 0 else 3 - truth[p]) if rng.random() > 0.03 else rng.randint(1, 2)) for p in own]
    long = [p for p in places if p < 400][:16]
    rows += [(1000, "c", p, truth[p] if i < 8 else 3 - truth[p]) for i, p in enumerate(long)]
    rows += [(2000, "c", 700, 1), (2001, "c", 700, 2), (2002, "c", 120, 0), (None, "c", 120, 1), (2003, "c", 130, 1), (2003, "c", 130, 2)]
    df = spark.createDataFrame(rows, "read_id long, contig string, pos long, allele int")
    sites, reads = (x.collect() for x in H.phased(df))
    starts = defaultdict(set)
    for r in sites:
        starts[r.phase_set].add(r.pos)
    assert {(s, len(p)) for s, p in starts.items()} == {(100, 30), (1000, 30), (700, 1)}
    for s in (100, 1000):
        same = {r.allele == truth[r.pos] for r in sites if r.phase_set == s}
        assert len(same) == 1  # one haplotype or the other, throughout
    assert sum(r.masked for r in sites) < 12  # a chimera and some errors
    straight = {r.phase_set: r.allele == truth[r.pos] for r in sites if r.pos in truth}
    agreed = Counter((r.phase == 0) == (straight[r.phase_set] == (kind[r.read_id][0] == 0)) for r in reads if r.read_id in kind and kind[r.read_id][1] > 2)
    assert agreed[True] > 0.99 * sum(agreed.values())
    flipped = {r.read_id for r in reads if r.flipped}
    assert flipped == {1000} and {r.read_id for r in reads} >= {2000, 2001} and not {r.read_id for r in reads} & {2002, 2003, None}
    single = {r.read_id: (r.phase, r.n_in, r.n_out) for r in reads}
    assert {single[2000][0], single[2001][0]} == {0, 1}
    # counts of a site are those of reads of more than one site, after the chimera was turned
    held = Counter(p for r, c, p, a in rows if r in kind and kind[r][1] > 1 and a) + Counter(long)
    assert all(r.right0 + r.wrong0 + r.right1 + r.wrong1 == held[r.pos] for r in sites if r.pos != 700)
    assert H.phased(df.limit(0))[0].count() == 0 and H.phased(df.limit(0))[1].count() == 0


def test_chimeras_and_masks():
    yes, no = [True] * 8, [False] * 8
    assert H.chimera(np.array(yes + no)).all() or not H.chimera(np.array(yes + no)).any()
    assert H.chimera(np.array([True] * 12 + [False] * 2)) is None and H.chimera(np.array([True, False] * 8)) is None
    clean, bad = [5, 0, 5, 0], [1, 3, 1, 3]
    assert H.error_regions(np.array([clean] * 5 + [bad] * 3 + [clean] * 5)) == [(5, 7)]
    assert H.error_regions(np.array([clean, bad, clean, clean, bad])) == [(1, 1), (4, 4)] and H.error_regions(np.array([clean] * 4)) == []
    assert H.error_regions(np.array([[5, 1, 5, 0]] * 4)) == [] and H.error_regions(np.zeros((0, 4), int)) == []


def test_unions_of_equal_intervals(spark):
    """Many equal intervals, of which only one can be the first: the union is one interval each time."""
    rows = [("c", s, e) for s, e in ((100, 151), (140, 300), (400, 450), (450, 460)) for _ in range(25)]
    for n in range(1, 6):
        found = I.merged(spark.createDataFrame(rows, "contig string, s long, e long").repartition(n), "contig", "s", "e", touching=False)
        assert sorted(map(tuple, found.collect())) == [("c", 100, 300, 50), ("c", 400, 450, 25), ("c", 450, 460, 25)]
