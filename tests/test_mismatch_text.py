"""Whole reads against the genome: edit distance and mismatch text."""

from pyspark.sql import functions as F

from splicelake import queries
from splicelake.catalog import discovery as catalog
from splicelake.operators import samtables as S
from splicelake.views import Tables



def test_mismatch_text(spark):
    rows = [
        (1, "ACGTAC", "ACGTAC", "IIIIII"),
        (2, "AAGTNC", "ACGTNC", "ABCDEF"),  # N matches nothing
        (3, "AC--GTA", "ACTTGGA", "IIIII"),  # two bases of the reference deleted
        (4, "ACTTGT", "AC--GT", "IIIIII"),  # two bases inserted
        (5, "GC-A", "AC" + "TA", "III"),
        (6, "A-CT", "AGTT", "III"),  # a mismatch beside a deletion
        (7, "", "", ""),
    ]
    df = spark.createDataFrame(rows, "k int, bases string, ref string, quals string")
    got = {r.k: (r.nm, r.md, r.shown) for r in S.calmd(df, equal=True).collect()}
    assert got == {1: (0, "6", "======"), 2: (2, "1C2N1", "=A==N="), 3: (3, "2^TT1G1", "===T="), 4: (2, "4", "==TT=="), 5: (2, "0A1^T1", "G=="), 6: (2, "1^G0T1", "=C="), 7: (0, "0", "")}
    masked = {r.k: (r.shown, r.shown_quals) for r in S.calmd(df, most=2).where("k < 4").collect()}
    assert masked == {1: ("ACGTAC", "IIIIII"), 2: ("NANNNN", "!B!!E!"), 3: ("NNNTN", "!!!I!")}


def test_reads_are_compared_whole(spark, tmp_path):
    text = "acgtacgtbd" * 15
    spark.createDataFrame([(0, text), (1, None), (2, text[:7])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "ac" * 300), (1, "gt" * 200), (2, "g")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    t = Tables(spark, str(tmp_path))
    rows = catalog.on_genome(t).collect()
    assert sorted((r.read_id, len(r.seq), len(r.ref)) for r in rows) == [(0, 120, 120), (1, 30, 30)]
    for name in ("hit_nm", "sam_calmd"):
        nm = {r.read_id: r.nm for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
        assert nm == {r.read_id: sum(a != b for a, b in zip(r.seq, r.ref, strict=True)) for r in rows}
    assert queries.QUERIES["sam_calmd"](spark, str(tmp_path)).where(F.length("shown") != F.length("shown_quals")).count() == 0
