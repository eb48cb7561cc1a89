"""Small indels, merged chains and realigned ends, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from splicelake.functions import cigar as C
from splicelake.operators import seams as M
from splicelake.operators import sequences as Q

SIZE = 64
PART = "struct<contig:string,left:bigint,back:boolean,ops:array<struct<op:string,len:int>>,mismatches:int,splice:string,seq:string>"
BREAK = "contig1 string, left long, back1 boolean, contig2 string, right long, back2 boolean, splice string"
FLIP = str.maketrans("ACGT", "TGCA")


@pytest.fixture(scope="module")
def genome():
    rng = random.Random(17)
    return {c: "".join(rng.choices("ACGT", k=900)) for c in "ab"}


@pytest.fixture(scope="module")
def tiled(spark, genome):
    return Q.tiles(spark.createDataFrame(list(genome.items()), "contig string, seq string"), size=SIZE).cache()


def walked(genome, contig, left, back, n):
    """The bases read from ``left`` on, in either direction."""
    return genome[contig][left : left + n] if not back else genome[contig][left - n + 1 : left + 1][::-1].translate(FLIP)


def part(genome, contig, left, seq, back=False, splice=None):
    wrong = sum(a != b for a, b in zip(seq, walked(genome, contig, left, back, len(seq)), strict=True))
    return (contig, left, back, [("m" if back else "M", len(seq))], wrong, splice, seq)


def merged(spark, tiled, chains, breaks=(), insertions=()):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(chains)], f"chain_id long, parts array<{PART}>")
    found = M.merged(df, spark.createDataFrame(list(breaks), BREAK), spark.createDataFrame(list(insertions), "contig string, left long, bases string"), tiled, size=SIZE)
    return {r.chain_id: (r.contig, r.left, r.text, r.mismatches, r.edit_dist, r.splice) for r in found.withColumn("text", F.expr("concat_ws(',', transform(ops, x -> concat(x.len, x.op)))")).collect()}


def test_best_split(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(200):
        n = rng.randint(2, 30)
        rows.append(tuple("".join(rng.choices("ACGN", k=n)) for _ in range(3)))
    got = spark.createDataFrame(rows, "t string, l string, r string").select("*", M.best_split(F.col("t"), F.col("l"), F.col("r")).alias("s")).collect()
    wrong = lambda a, b: sum(x != y or x == "N" for x, y in zip(a, b, strict=True))
    for row in got:
        errors = [(wrong(row.t[:i], row.l[:i]) + wrong(row.t[i:], row.r[i:]), i) for i in range(1, len(row.t))]
        assert (row.s.errors, row.s.at) == min(errors)


def test_small_indels(spark, genome, tiled):
    """A read with two bases gone, one with three more, one that fits as well without, and pairs that are too far apart."""
    g = genome["a"]
    rows = [
        ("a", 100, 152, g[100:123] + g[125:152], 9), ("a", 100, 152, g[100:123] + g[125:152], 9), ("a", 300, 347, g[300:327] + "TTT" + g[327:347], 9),
        ("a", 100, 152, g[100:123] + g[125:152], 0), ("a", 100, 154, g[100:123] + g[127:154], 9), ("a", 100, 150, g[100:150], 9), ("a", 890, 942, "A" * 50, 99),
    ]
    got = M.small_indels(spark.createDataFrame(rows, "contig string, left long, right long, bases string, edits int"), tiled, size=SIZE).collect()
    deletion, insertion = ((r.contig, r.left, r.right, r.bases, r.support) for r in sorted(got, key=lambda r: r.left))
    assert deletion[0] == "a" and deletion[2] - deletion[1] == 3 and deletion[4] == 2 and g[100 : deletion[1] + 1] + g[deletion[2] : 152] == g[100:123] + g[125:152]
    assert insertion[4] == 1 and g[300 : insertion[1] + 1] + insertion[3] + g[insertion[1] + 1 : 347] == g[300:327] + "TTT" + g[327:347]


@pytest.mark.parametrize("back1, back2", [(False, False), (False, True), (True, False), (True, True)])
def test_fusions_at_each_shift(spark, genome, tiled, back1, back2):
    """Reads that go from one contig to the other, in every pair of directions and at every shift that is tried, and the same
    fusions told from the other side."""
    chains, breaks, want = [], [], {}
    for i, d in enumerate(range(-5, 7)):
        p, q = 100 + 60 * i, 120 + 60 * i
        s1, s2 = (-1 if back1 else 1), (-1 if back2 else 1)
        read = walked(genome, "a", p, back1, 20 + d) + walked(genome, "b", q, back2, 20 - d)
        chains.append([part(genome, "a", p, read[:20], back1), part(genome, "b", q - s2 * d, read[20:], back2)])
        row = ("a", p + s1 * (19 + d), back1, "b", q, back2, None)
        breaks.append(row if i % 2 else ("b", q, not back2, "a", p + s1 * (19 + d), not back1, None))
        op = "FR"[back1] + "FR"[back2]
        if -3 <= d <= 4:
            want[i] = ("a", p, f"{20 + d}{'m' if back1 else 'M'},{q}{op},{20 - d}{'m' if back2 else 'M'}", 0, 0, None)
    assert merged(spark, tiled, chains, breaks) == want


def test_chains_of_introns_and_indels(spark, genome, tiled):
    g = genome["a"]
    intron = ("a", 121, False, "a", 220, False, "-")  # last and first exon base
    read = g[100:122] + g[220:238] + g[238:258]
    spliced = [part(genome, "a", 100, read[:20]), part(genome, "a", 218, read[20:40]), part(genome, "a", 238, read[40:])]
    gone = g[400:418] + g[420:442]
    shorter = [part(genome, "a", 400, gone[:20]), part(genome, "a", 422, gone[20:])]
    more = g[500:519] + "GG" + g[519:538]
    longer = [part(genome, "a", 500, more[:20]), part(genome, "a", 518, more[20:])]
    breaks = [intron, ("a", 417, False, "a", 420, False, None), ("a", 120, False, "a", 219, False, "+")]
    left, inserted = 518, "GG"
    got = merged(spark, tiled, [spliced, shorter, longer, spliced[1:], spliced[:1]], breaks, [("a", left, inserted), ("a", left, "GGG"), ("b", left, "GG")])
    assert got[0] == ("a", 100, "22M,98N,38M", 0, 0, "-") and got[1] == ("a", 400, "18M,2D,22M", 0, 2, None) and got[2] == ("a", 500, "19M,2I,19M", 0, 2, None)
    assert got[3][2] == "40M" and got[4][2] == "20M" and len(got) == 5
    # nothing closes the seam, the intron's strand is not that of a part, two insertions fit
    assert merged(spark, tiled, [spliced, longer]) == {}
    other = [(*spliced[0][:5], "+", spliced[0][6]), *spliced[1:]]
    assert merged(spark, tiled, [other], breaks[:1]) == {}
    run = "A" * 30
    flat = {"a": g[:100] + run + g[130:], "b": genome["b"]}
    tiles = Q.tiles(spark.createDataFrame(list(flat.items()), "contig string, seq string"), size=SIZE)
    copies = [part(flat, "a", 100, "A" * 15), part(flat, "a", 114, "A" * 15)]
    assert merged(spark, tiles, [copies], (), [("a", 114, "A")])[0][2] == "15M,1I,14M" and merged(spark, tiles, [copies], (), [("a", 114, "A"), ("a", 115, "A")]) == {}


def test_the_break_of_fewest_mismatches(spark, genome, tiled):
    g = genome["a"]
    read = g[100:123] + g[300:317]
    chain = [part(genome, "a", 100, read[:20]), part(genome, "a", 297, read[20:])]
    wrong = [("a", 119 + d, False, "a", 297 + d, False, "+") for d in (-2, -1, 1, 2, 4)]
    got = merged(spark, tiled, [chain], [*wrong, ("a", 122, False, "a", 300, False, "+")])
    disagree = lambda d: sum(a != b for a, b in zip(read, g[100 : 120 + d] + g[297 + d : 317], strict=True))
    d = min((disagree(d), d) for d in (-2, -1, 1, 2, 3, 4))[1]
    assert disagree(d) == 0 and got[0][:4] == ("a", 100, f"{20 + d}M,177N,{20 - d}M", 0)


def test_two_fusions_are_too_many(spark, genome, tiled):
    parts = [part(genome, c, at, walked(genome, c, at, False, 20)) for c, at in (("a", 100), ("b", 200), ("a", 500))]
    breaks = [("a", 119, False, "b", 200, False, None), ("b", 219, False, "a", 500, False, None)]
    assert merged(spark, tiled, [parts], breaks) == {} and merged(spark, tiled, [parts[:2], parts[1:]], breaks)[1][2] == "20M,500FF,20M"


def test_realigned_ends(spark, genome, tiled):
    g = genome["a"]
    read = g[100:130] + g[230:250]
    ops = lambda *x: [(o, n) for n, o in x]
    hits = [("r", "a", 100, ops((50, "M")), None, read), ("r", "a", 200, ops((50, "M")), None, read), ("f", "a", 100, ops((20, "M"), (500, "FF"), (30, "M")), None, read), ("s", "a", 5, ops((50, "M")), None, g[5:55])]
    df = spark.createDataFrame(hits, "read_id string, contig string, left long, ops array<struct<op:string,len:int>>, splice string, seq string")
    scored = M.edit_distances(df.where("read_id != 'f'"), tiled, size=SIZE).unionByName(df.where("read_id = 'f'").withColumn("edit_dist", F.lit(3)))
    show = lambda juncs: {(r.read_id, r.left, r.text, r.edit_dist, r.splice) for r in M.realigned(scored, spark.createDataFrame(juncs, "contig string, left long, right long, splice string"), tiled, size=SIZE).withColumn("text", C.to_text(F.col("ops"))).collect()}
    old = show([("b", 1, 2, "+")])
    assert len(old) == 4
    before = {x[1]: x[3] for x in old if x[0] == "r"}
    known = [("a", 129, 230, "-"), ("a", 133, 240, "+"), ("a", 2, 20, "+")]  # the last one would begin before the contig
    wrong = sum(a != b for a, b in zip(read, g[100:134] + g[240:256], strict=True))
    want = {("r", 100, "30M100N20M", 0, "-")} | ({("r", 100, "34M106N16M", wrong, "+")} if wrong <= max(before.values()) else set())
    assert show(known) - old == want and old <= show(known)
    many = [("a", 129, 230, "-")] + [("a", 120 + k, 800, "+") for k in range(5)]
    assert ("r", 100, "30M100N20M", 0, "-") in show(many)  # the other end still has one candidate
    assert show(many + [("a", 140, 225, "+")] + [("a", 141, 226 + k, "+") for k in range(5)]) == old
