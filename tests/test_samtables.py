from math import log, sqrt

from splicelake.operators import samtables as S


def test_capped_mapq(spark):
    high, low = "I", "$"  # qualities 40 and 3
    rows = [
        ("ACGTACGTAC", high * 10, "ACGTACGTAC", 0),  # no mismatch
        ("ACGTACGTAA", high * 10, "ACGTACGTAC", 0),  # one, its quality counts 33
        ("ACGTACGTAA", high * 9 + low, "ACGTACGTAC", 0),  # one of low quality
        ("NCGTACGT=c", high * 10, "ACGNACGTAC", 0),  # N on either side, the reference's base, a small letter
        ("CAGTACGTAC", high * 10, "ACGTACGTAC", 100),  # two, and clipped bases
        ("ACGTACGTAC", high * 10, "ACGTACGTAC", 100),
    ]
    got = [r.cap for r in S.capped_mapq(spark.createDataFrame(rows, "bases string, quals string, ref string, clipped long").coalesce(1)).collect()]
    left = lambda cost: int(sqrt((40 - max(cost, 0)) / 40) * 40 + 0.499)
    assert got == [40, left(33 - 4.343 * log(20)), 40, 40, -1, left(20)]
    assert S.capped_mapq(spark.createDataFrame([], "bases string, quals string, ref string, clipped long")).count() == 0
