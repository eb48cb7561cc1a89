"""SAM table operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.catalog import register
from splicelake.catalog.alignments import OPS, sam
from splicelake.functions import cigar
from splicelake.operators import intervals as I
from splicelake.operators import samtables as S
from splicelake.views import Tables

KEY = ["insert_id", "ord"]
ENDS = f"{OPS}, e AS (SELECT insert_id, ord, CAST(max(st + CASE WHEN op IN ('M', 'D', 'N') THEN len ELSE 0 END) AS BIGINT) AS rgt FROM w GROUP BY insert_id, ord), s AS (SELECT v_sam.*, rgt, mapq * 3 + ord AS qual_sum FROM v_sam JOIN e USING (insert_id, ord))"


def rows(t: Tables) -> DataFrame:
    return sam(t).withColumn("rgt", cigar.right_end(F.col("pos"), F.col("ops"))).withColumn("qual_sum", F.col("mapq") * 3 + F.col("ord"))


@register("sam_view", f"WITH {ENDS} SELECT insert_id, ord FROM s WHERE mapq >= 10 AND flag & 3 = 3 AND flag & 516 = 0 AND rg IN ('rg0', 'rg2') AND EXISTS (SELECT 1 FROM v_regions r WHERE 'c' || substr(r.chrom, 2) = s.rname AND iv_begin < rgt AND pos < iv_end)")
def _(t: Tables) -> DataFrame:
    kept = S.view(rows(t), min_mapq=10, require=3, exclude=516, groups=["rg0", "rg2"])
    regions = t.v_regions.select(F.concat(F.lit("c"), F.substring("chrom", 2, 9)).alias("contig"), "iv_begin", "iv_end")
    return I.matched(I.Side(kept, "rname", "pos", "rgt"), I.Side(regions, "contig", "iv_begin", "iv_end")).select(*KEY)


@register("sam_subsample")
def _(t: Tables) -> DataFrame:
    return S.subsample(t.v_sam, 0.25, seed=7).select(*KEY, "qname")


@register("sam_sort", "SELECT insert_id, ord, CAST(row_number() OVER (PARTITION BY rname ORDER BY pos, flag & 16 > 0, insert_id, ord) AS INTEGER) AS place FROM v_sam")
def _(t: Tables) -> DataFrame:
    order = ["pos", S.has(16), *KEY]
    return S.sorted_by(I.running(t.v_sam, ["rname"], "pos", order, F.lit(1), "place")).select(*KEY, F.col("place").cast("int").alias("place"))


@register("sam_merge", "SELECT insert_id, ord, 'a' AS rg FROM v_sam WHERE ord <= 2 AND pos < 9000 UNION ALL SELECT insert_id, ord, 'b' FROM v_sam WHERE ord > 1 AND pos < 9000")
def _(t: Tables) -> DataFrame:
    a = t.v_sam.where("ord <= 2").withColumn("rg", F.lit("a"))
    return a.unionByName(t.v_sam.where("ord > 1").withColumn("rg", F.lit("b"))).where("pos < 9000").select(*KEY, "rg")


@register("sam_cat", "SELECT insert_id, ord FROM v_sam WHERE ord = 1 UNION ALL SELECT insert_id, ord FROM v_sam WHERE ord = 2")
def _(t: Tables) -> DataFrame:
    return t.v_sam.where("ord = 1").select(*KEY).unionByName(t.v_sam.where("ord = 2").select(*KEY))


CONTIGS = "SELECT 'c' || k AS rname, CAST(20000 + k AS BIGINT) AS length FROM (SELECT DISTINCT s_nationkey % 7 AS k FROM supplier)"


@register("sam_idxstats", f"WITH c AS ({CONTIGS} UNION ALL SELECT '*', 0), n AS (SELECT rname, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 4 > 0) AS unmapped FROM v_sam GROUP BY rname) SELECT rname, length, coalesce(mapped, 0) AS mapped, coalesce(unmapped, 0) AS unmapped FROM c LEFT JOIN n USING (rname)")
def _(t: Tables) -> DataFrame:
    contigs = t.supplier.select((F.col("s_nationkey") % 7).alias("k")).distinct().select(F.concat(F.lit("c"), F.col("k").cast("string")).alias("rname"), (F.col("k") + 20000).cast("long").alias("length"))
    return S.idxstats(t.v_sam, contigs)


FLAGS = {
    "total": "true", "duplicates": "flag & 1024 > 0", "mapped": "flag & 4 = 0", "paired": "flag & 1 > 0", "read1": "flag & 65 = 65", "read2": "flag & 129 = 129", "proper": "flag & 7 = 3",
    "both_mapped": "flag & 13 = 1", "singletons": "flag & 13 = 9", "mate_elsewhere": "flag & 13 = 1 AND rnext NOT IN ('=', '*') AND rnext <> rname",
    "mate_elsewhere_q5": "flag & 13 = 1 AND rnext NOT IN ('=', '*') AND rnext <> rname AND mapq >= 5",
}


@register("sam_flagstat", f"SELECT flag & 512 > 0 AS failed, {', '.join(f'count(*) FILTER ({c}) AS {n}' for n, c in FLAGS.items())} FROM v_sam GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return S.flagstat(t.v_sam)


@register(
    "sam_rmdup_pe",
    f"""WITH {ENDS}, k AS (SELECT *, row_number() OVER (PARTITION BY rg, rname, pos, tlen ORDER BY qual_sum DESC, qname, ord) AS k FROM s WHERE flag & 13 = 1 AND rnext = '=' AND tlen > 0)
    SELECT insert_id, ord FROM s WHERE qname NOT IN (SELECT qname FROM k WHERE k > 1)""",
)
def _(t: Tables) -> DataFrame:
    return S.rmdup_paired(rows(t)).select(*KEY)


@register("sam_rmdup_se", f"WITH {ENDS} SELECT insert_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY rg, rname, flag & 16 > 0, CASE WHEN flag & 16 > 0 THEN rgt ELSE pos END ORDER BY qual_sum DESC, qname, ord) AS k FROM s WHERE flag & 4 = 0) WHERE k = 1")
def _(t: Tables) -> DataFrame:
    return S.rmdup_single(rows(t)).select(*KEY)


@register(
    "sam_fixmate",
    f"""WITH {ENDS}, b AS (SELECT * FROM (SELECT *, flag & 64 > 0 AS side, row_number() OVER (PARTITION BY qname, flag & 64 > 0 ORDER BY ord) AS k FROM s WHERE flag & 256 = 0) WHERE k = 1)
    SELECT a.qname, a.ord, CAST((a.flag & ~40) + CASE WHEN m.flag IS NULL OR m.flag & 4 > 0 THEN 8 ELSE 0 END + CASE WHEN m.flag & 16 > 0 THEN 32 ELSE 0 END AS BIGINT) AS flag,
      CASE WHEN m.rname IS NULL THEN '*' WHEN m.rname = a.rname THEN '=' ELSE m.rname END AS rnext, coalesce(m.pos, 0) AS pnext,
      CAST(CASE WHEN m.rname = a.rname THEN CASE WHEN m.flag & 16 > 0 THEN m.rgt ELSE m.pos END - CASE WHEN a.flag & 16 > 0 THEN a.rgt ELSE a.pos END ELSE 0 END AS BIGINT) AS tlen
    FROM b a LEFT JOIN b m ON a.qname = m.qname AND a.side <> m.side""",
)
def _(t: Tables) -> DataFrame:
    return S.fixmate(rows(t))
