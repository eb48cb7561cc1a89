"""Contrasts of sample groups and scored cuts against plain loops."""

import math
import random

import pytest

from splicelake.operators import discovery as D
from splicelake.operators import sequences as Q
from splicelake.operators import variants as V


def plain_raise(p, g, hardy, rounds):
    for _ in range(rounds):
        new = [0.0] * 3
        for q in p:
            t = [q[k] * g[k] for k in range(3)]
            for k in range(3):
                new[k] += t[k] / sum(t) / len(p)
        if hardy:
            f = new[1] / 2 + new[2]
            new = [(1 - f) ** 2, 2 * f * (1 - f), f * f]
        moved = max(abs(a - b) for a, b in zip(g, new, strict=True))
        g = new
        if moved < 1e-5:
            break
    return g


def likelihood(p, g):
    return sum(math.log(sum(a * b for a, b in zip(q, g, strict=True))) for q in p)


def plain_contrast(samples):
    p, one, two = [q for _, q in samples], [q for g, q in samples if g == 1], [q for g, q in samples if g == 2]
    best = [max(range(3), key=lambda k: (q[k], k)) for q in p if tuple(q) != (1.0, 1.0, 1.0)]
    f = sum(best) / len(best) / 2
    start = [(1 - f) ** 2, 2 * f * (1 - f), f * f]
    equal = plain_raise(p, start, True, 500)
    free = plain_raise(p, equal, False, 50)
    af = lambda g: g[1] / 2 + g[2]
    out = {"af": af(equal), "g_ref": free[0], "g_het": free[1], "g_alt": free[2], "p_hwe": math.erfc(math.sqrt(max(0, likelihood(p, free) - likelihood(p, equal))))}
    if one and two:
        e1, e2 = plain_raise(one, equal, True, 500), plain_raise(two, equal, True, 500)
        g1, g2 = plain_raise(one, free, False, 50), plain_raise(two, free, False, 50)
        gain = likelihood(one, e1) + likelihood(two, e2) - likelihood(one, equal) - likelihood(two, equal)
        out |= {"af1": af(e1), "af2": af(e2), "p_one": math.erfc(math.sqrt(max(0, gain)))}
        out["p_two"] = math.exp(-max(0, likelihood(one, g1) + likelihood(two, g2) - likelihood(one, free) - likelihood(two, free)))
    return out


def test_group_contrast(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for site in range(40):
        samples = []
        for sample in range(rng.randint(1, 10) if site else 1):
            pls = [rng.choice([0, 5, 20, 40]) for _ in range(3)]
            rows.append((site, sample, *pls))
            samples.append((sample % 2 + 1, [10 ** (-x / 10) for x in pls]))
        if any(tuple(q) != (1.0, 1.0, 1.0) for _, q in samples):
            want[site] = plain_contrast(samples)
    groups = spark.createDataFrame([(s, s % 2 + 1) for s in range(10)], "sample int, group int")
    got = {r.site: r for r in V.group_contrast(spark.createDataFrame(rows, "site long, sample int, pl0 long, pl1 long, pl2 long"), groups).collect()}
    assert len(got) == 40 and sum("p_one" in w for w in want.values()) > 25
    for site, w in want.items():
        for name, value in w.items():
            assert abs(got[site][name] - value) < 1e-7, (site, name)
        assert ("p_one" in w) == (got[site].p_one is not None)


def plain_cuts(seq, least, penalty):
    """Base by base: forward to the highest score, then backward."""
    def best(places):
        score = top = 0
        at = None
        for i in places:
            score += 1 if seq[i] == "N" else -penalty
            if score < 0:
                break
            if score > top:
                top, at = score, i
        return at

    out, k = [], 0
    while k < len(seq):
        if seq[k] != "N":
            k += 1
            continue
        e = best(range(k, len(seq)))
        b = best(range(e, -1, -1))
        if e + 1 - b >= least:
            out.append((b, e + 1))
        k = e + 1
    return out


@pytest.mark.parametrize("penalty", [1, 3, 10])
def test_scored_cuts(spark, penalty):
    rng = random.Random(penalty)
    seqs = {"none": "ACGT" * 20, "all": "N" * 90, "": ""}
    for i in range(60):
        seqs[f"s{i}"] = "".join(("N" if k % 2 else "A") * rng.choice([1, 1, 2, 5, 12, 40]) for k in range(rng.randint(1, 30)))
    genome = spark.createDataFrame(list(seqs.items()), "contig string, seq string")
    got = sorted(tuple(r) for r in Q.n_stretches(genome, least=20, penalty=penalty, size=16).collect())
    want = sorted((c, a, b) for c, s in seqs.items() for a, b in plain_cuts(s, 20, penalty))
    assert got == want and len(want) > 30


def test_rescue_beside_mates(spark):
    """A read end beside a mate, in either direction; mates that are too near, on the same strand or at the contig's begin; reads
    whose last segment is placed well."""
    rng = random.Random(7)
    seq = "".join(rng.choices("ACGT", k=3000))
    tiled = Q.tiles(spark.createDataFrame([("c", seq)], "contig string, seq string"), size=64)
    flip = str.maketrans("ACGT", "TGCA")
    end = seq[1000:1015]
    worse = end[:3] + ("A" if end[3] != "A" else "C") + end[4:]
    reads = [("a", "ACGT" * 10 + end), ("b", "ACGT" * 10 + worse[::-1].translate(flip)), ("c", "ACGT" * 10 + end), ("d", "ACGT" * 10 + end), ("e", "ACGT" * 10 + end), ("f", "A" * 10)]
    segs = [(r, 1, "c", False, 100, 125, 0) for r, _ in reads] + [("c", 3, "c", False, 400, 425, 0), ("d", 3, "c", True, 400, 425, 0)]
    mates = [(r, "c", True, 1040, 1065) for r in "abcdf"] + [("e", "c", False, 1040, 1065), ("a", "c", True, 150, 175), ("a", "c", True, 20, 45)]
    got = D.rescued(
        spark.createDataFrame(segs, "read_id string, seg int, contig string, reverse boolean, left long, right long, edit_dist int"),
        spark.createDataFrame(mates, "read_id string, contig string, reverse boolean, left long, right long"), spark.createDataFrame(reads, "read_id string, seq string"), tiled, size=64, total=3, mean=50, sd=20,
    )
    assert sorted((r.read_id, r.seg, r.reverse, r.left, r.right) for r in got.collect()) == [("a", 3, False, 1000, 1015), ("b", 3, True, 1000, 1015), ("d", 3, False, 1000, 1015)]
