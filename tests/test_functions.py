"""Column functions and operators on small literal rows."""

from math import atan, pi, sqrt
from random import Random
from time import perf_counter

import pandas as pd
from pyspark.sql import functions as F

from splicelake.functions import cigar
from splicelake.functions import sequence as S
from splicelake.operators import fusions as U
from splicelake.operators import intervals as I
from splicelake.operators import junctions as J
from splicelake.operators import variants as V
from splicelake.sources import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ops(*pairs):
    return F.array(*[F.struct(F.lit(o).alias("op"), F.lit(n).alias("len")) for o, n in pairs])


def test_malformed_operations_are_null(spark):
    for text in ("", "*", "10", "M10", "0M", "5M600000N5M", "5M-"):
        assert one(spark, cigar.parse(F.lit(text))) is None
    assert one(spark, cigar.to_text(cigar.parse(F.lit("5=2X100N7M")))) == "5M2M100N7M"


def test_backward_and_fused_walks(spark):
    assert one(spark, cigar.right_end(F.lit(100), ops(("m", 10), ("n", 50), ("m", 5)))) == 35
    assert one(spark, cigar.right_end(F.lit(100), ops(("M", 10), ("FF", 5000), ("M", 20)))) == 5020
    gap = one(spark, cigar.gaps(F.lit(100), ops(("m", 10), ("n", 50), ("m", 5))))
    assert [(g.start, g.end) for g in gap] == [(40, 90)]


def test_validity(spark):
    assert one(spark, cigar.is_valid(ops(("M", 5), ("N", 60), ("M", 5))))
    for bad in ([("S", 2), ("M", 5)], [("M", 5), ("N", 20), ("M", 5)], [("M", 5), ("I", 4), ("M", 5)], [("M", 5), ("I", 1)], [("M", 5), ("M", 5)]):
        assert not one(spark, cigar.is_valid(ops(*bad)))


def test_splice_track_row(spark):
    # an intron after base 63 up to base 138 with extents 19 and 16 and 64 hits
    juncs = spark.createDataFrame([("fake", 63, 138, False, 19, 16, 0, 64)], "contig string, left long, right long, antisense boolean, left_extent long, right_extent long, min_splice_mms long, supporting_hits long")
    row = J.bed(juncs).first()
    assert (row.bed_start, row.bed_end, row.name, row.score, row.sizes, row.starts) == (45, 154, "JUNC00000001", 64, "19,16", "0,93")
    back = J.from_bed(J.bed(juncs)).first()
    assert (back.left, back.right) == (63, 138)


def test_shadowed_junction(spark):
    rows = [("c", 100, 200, False, 9, 9, 0, 2), ("c", 104, 204, True, 9, 9, 0, 5), ("c", 300, 400, False, 9, 9, 0, 1), ("c", 309, 409, True, 9, 9, 0, 5)]
    juncs = spark.createDataFrame(rows, "contig string, left long, right long, antisense boolean, left_extent long, right_extent long, min_splice_mms long, supporting_hits long")
    assert [r.left for r in J.shadowed(juncs).collect()] == [100]


def test_junction_evidence_merges_in_any_order(spark):
    rows = [("c", 10 + k % 3, 90, False, 5 + k, 20 - k, k % 2) for k in range(12)]
    raw = spark.createDataFrame(rows, "contig string, left long, right long, antisense boolean, left_extent long, right_extent long, splice_mms long")
    whole = sorted(J.aggregate(raw).collect())
    parts = J.merge(J.aggregate(raw.where("left_extent < 9")), J.aggregate(raw.where("left_extent >= 9")))
    assert sorted(parts.select(J.aggregate(raw).columns).collect()) == whole


def test_interval_join_equals_nested_loops(spark):
    a = [(i, "xy"[i % 2], i * 37 % 500, i * 37 % 500 + i % 90) for i in range(60)]
    b = [(i, "xy"[i % 3 % 2], i * 53 % 500, i * 53 % 500 + 5 + i % 200) for i in range(40)]
    left = I.Side(spark.createDataFrame(a, "i long, c string, s long, e long"), "c", "s", "e")
    right = I.Side(spark.createDataFrame(b, "j long, c string, t long, f long"), "c", "t", "f")
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3] and x[2] < x[3])
    for size in (1, 7, 100, 10_000):
        got = sorted((r.i, r.j) for r in I.interval_join(left, right, bin_size=size).collect())
        assert got == want


def test_interval_edges(spark):
    rows = spark.createDataFrame([("c", 10, 20), ("c", 20, 30), ("c", 40, 50)], "c string, s long, e long")
    assert sorted((r.s, r.e, r.n) for r in I.merged(rows, "c", "s", "e").collect()) == [(10, 30, 2), (40, 50, 1)]
    assert sorted((r.s, r.e) for r in I.chopped(rows, "c", "s", "e", (15, 45)).collect()) == [(10, 15), (45, 50)]
    assert sorted((r.s, r.e) for r in I.sliced(rows, "s", "e", 15).collect()) == [(10, 15), (15, 20), (20, 30), (40, 50)]


def test_sequences(spark):
    assert one(spark, S.revcomp(F.lit("AACGX"))) == "NCGTT"
    assert one(spark, S.to_colors(F.lit("AACGT"))) == "A0131"
    assert one(spark, S.from_colors(F.lit("A0131"))) == "AACGT"
    assert one(spark, S.from_colors(F.lit("A04"))) == "AAN"
    assert one(spark, S.translate(F.lit("ATGGCCTAAGG"))) == "MA*"
    assert one(spark, S.from_integers(F.lit("40 -5 0"))) == "I!!"
    assert one(spark, S.to_phred33(F.lit("h@!"))) is None
    assert [one(spark, S.reject_code(F.lit(x))) for x in ("ACGT", "A" * 20, "ACGTACGTACNN", "ACGTACGTACGT")] == ["S", "L", "N", None]


def test_seq_difference(spark):
    pairs = [("ACGTACGT", "ACGTACGT"), ("ACGTACGT", "ACGTTCGT"), ("ACGT", "ACGTACGT"), (None, "A")]
    got = spark.createDataFrame(pairs, "a string, b string").select(U.seq_difference("a", "b").alias("d")).collect()
    assert [r.d for r in got] == [0, 1, 0, None]


def plain_difference(a, b):
    """Cell by cell: mismatches 1, gaps 2, any end of the last row or column free."""
    table = [[2 * j for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [2 * i]
        for j, y in enumerate(b):
            row.append(min(table[-1][j] + (x != y), table[-1][j + 1] + 2, row[j] + 2))
        table.append(row)
    return min(min(r[-1] for r in table), min(table[-1]))


def test_seq_difference_of_many_pairs(spark):
    rng = Random(3)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    pairs = [(text(rng.choice((0, 1, 7, 23))), text(rng.choice((0, 1, 8, 23)))) for _ in range(600)] + [("A", None), ("\u00c4C", "\u00c4CA")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", U.seq_difference("a", "b").alias("d")).collect()
    assert all(r.d == (None if r.b is None else plain_difference(r.a.encode(), r.b.encode())) for r in got) and len(got) == 602

    # whole batches cost about as much as a few single pairs did
    rows = [(text(46), text(46)) for _ in range(20_000)]
    start = perf_counter()
    d = U.seq_difference.func(*map(pd.Series, zip(*rows, strict=True)))
    assert perf_counter() - start < 3 and [d[k] for k in (0, 19_999)] == [plain_difference(*rows[k]) for k in (0, 19_999)]


def test_site_call_and_em(spark):
    sure_ref = [(1, k, 0, 60, 90) for k in range(4)]
    sure_alt = [(2, k, 90, 60, 0) for k in range(4)]
    rows = spark.createDataFrame(sure_ref + sure_alt, "site long, sample long, pl0 long, pl1 long, pl2 long")
    called = {r.site: r for r in V.site_call(rows).collect()}
    assert called[1].p_ref > 0.999 and called[1].ac == 0
    assert called[2].p_ref < 1e-6 and called[2].ac == 8
    af = {r.site: r.af for r in V.em_frequency(rows).collect()}
    assert af[1] < 1e-3 and af[2] > 0.999


def test_text_edges(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    got = {r.name: r.seq for r in T.fasta(lines(">a first\nAC.G\nTT\n", "b\n", "c x\nacgt\n\n")).collect()}
    assert got == {"a": "ACNGTT", "b": "", "c": "ACGT"}
    assert [tuple(r) for r in T.bed(lines("#x", "c\t5\t9", "c\t7", "track a")).collect()] == [("c", 5, 9), ("c", 6, 7)]
    site = T.vcf(lines("##x", "c\t10\t.\tA\tC,G\t3.5\tPASS\tDP=4;AF=0.5\tGT:DP\t0/1:3\t1/1")).first()
    assert (site.pos, site.alt, site.info["DP"], site.samples[0]["DP"], site.samples[1]) == (9, ["C", "G"], "4", "3", {"GT": "1/1"})


def test_p_values():
    assert abs(V._fisher(8, 2, 1, 5) - 0.034965) < 1e-5
    assert abs(V._fisher(5, 5, 5, 5) - 1) < 1e-9
    assert abs(V._beta(0.3, 2.0, 3.0) - 0.3483) < 1e-4
    # means 10 and 8 of five each with unit variance: t = 3.162 at 8 degrees
    assert abs(V._t_test(5, 50, 504, 5, 40, 324) - 0.00667) < 1e-4
    assert V._t_test(1, 9, 81, 1, 4, 16) == V._t_test(0, 0, 0, 5, 40, 324) == V._t_test(2, 8, 34, 1, 9, 81) == 1
    assert abs(V._t_test(2, 18, 170, 1, 4, 16) - (0.5 - atan(5 / sqrt(8 * 1.5)) / pi)) < 1e-9  # one degree of freedom
