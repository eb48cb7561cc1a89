"""Sites that calling goes on with."""

from splicelake.operators import intervals as I
from splicelake.operators import variants as V


def test_site_filters(spark):
    sites = [(1, "1", 10, "A", "C"), (2, "1", 10, "A", "X"), (3, "1", 10, "N", "C"), (4, "1", 10, "AC", "GT"), (5, "1", 10, "A", "C,GT"), (6, "1", 10, "A", "C,G"), (7, "1", 99, "A", "C"), (8, "1", 10, "A", "C"), (9, "2", 10, "A", "C"), (10, "1", 10, "A", "A"), (11, "1", 10, "A", "C")]
    lh = [(s, k, 0 if s == 8 and k else 5, 0, 0) for s in range(1, 11) for k in range(4)]
    sites = spark.createDataFrame(sites, "site long, contig string, pos long, ref string, alt string")
    lh = spark.createDataFrame(lh, "site long, sample long, pl0 long, pl1 long, pl2 long")
    bed = I.Side(spark.createDataFrame([("1", 5, 200)], "c string, s long, e long"), "c", "s", "e")
    got = V.site_filters(sites, lh, covered=0.5, bed=bed, region=(0, 50), samples=(3, 1)).select("site", "samples").collect()
    assert sorted(map(tuple, got)) == [(1, "1,3"), (6, "1,3")]
    assert V.site_filters(sites, lh).where("site = 11").first().samples == ""
    assert sorted(r.site for r in V.site_filters(sites, lh).collect()) == [1, 6, 7, 8, 9, 11]
