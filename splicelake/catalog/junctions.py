"""Junction and indel operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.catalog import register
from splicelake.catalog.alignments import OPS, sam
from splicelake.operators import junctions as J
from splicelake.views import Tables

RAW = "SELECT contig, lft + m1 - 1 AS l, lft + m1 + intron AS r, antisense_splice AS a, m1, m2, edit_dist FROM {0} WHERE intron > 0"
AGG = f"SELECT contig, l, r, a, CAST(max(m1) AS BIGINT) AS le, CAST(max(m2) AS BIGINT) AS re, min(edit_dist) AS mm, count(*) AS n FROM ({RAW}) GROUP BY contig, l, r, a"
OUT = "contig, l AS jl, r AS jr, a AS minus, le, re, mm, n"
GTF = """SELECT DISTINCT contig, ex_end - 1 AS l, nxt AS r, strand = '-' AS a FROM (SELECT *, lead(ex_start) OVER (PARTITION BY contig, tx_id ORDER BY ex_start, ex_end) AS nxt FROM v_exons) WHERE nxt > ex_end"""
ACCEPT = "least(le, re) >= 8 AND mm <= 1 AND (r - l - 1 <= 50000 OR (n >= 2 AND least(le, re) > 12))"
SHADOW = """EXISTS (SELECT 1 FROM j o WHERE o.contig = j.contig AND o.a <> j.a AND o.n > j.n AND abs(o.l - j.l) <= 8 AND abs(o.r - j.r) <= 8 AND (abs(o.l - j.l) < 8 OR abs(o.r - j.r) < 8))"""


def dense(t: Tables) -> DataFrame:
    return J.aggregate(J.extract(t.v_dense_hits))


def out(juncs: DataFrame, *more: str) -> DataFrame:
    return juncs.select("contig", F.col("left").alias("jl"), F.col("right").alias("jr"), F.col("antisense").alias("minus"), F.col("left_extent").cast("long").alias("le"), F.col("right_extent").cast("long").alias("re"), F.col("min_splice_mms").alias("mm"), F.col("supporting_hits").alias("n"), *more)


@register("junc_extract", f"SELECT contig, l AS jl, r AS jr, a AS minus, CAST(m1 AS BIGINT) AS le, CAST(m2 AS BIGINT) AS re FROM ({RAW.format('v_hits')})")
def _(t: Tables) -> DataFrame:
    return J.extract(t.v_hits).select("contig", F.col("left").alias("jl"), F.col("right").alias("jr"), F.col("antisense").alias("minus"), F.col("left_extent").alias("le"), F.col("right_extent").alias("re"))


@register("junc_agg", f"SELECT {OUT} FROM ({AGG.format('v_dense_hits')})")
def _(t: Tables) -> DataFrame:
    return out(dense(t))


@register("junc_merge", f"SELECT contig, l AS jl, r AS jr, a AS minus, max(le) AS le, max(re) AS re, min(mm) AS mm, CAST(sum(n) AS BIGINT) AS n FROM ({AGG.format('v_hits')} UNION ALL {AGG.format('v_dense_hits')}) GROUP BY contig, l, r, a")
def _(t: Tables) -> DataFrame:
    return out(J.merge(J.aggregate(J.extract(t.v_hits)), dense(t)))


@register("junc_accept", f"SELECT {OUT}, {ACCEPT} AS accepted FROM ({AGG.format('v_dense_hits')})")
def _(t: Tables) -> DataFrame:
    return out(dense(t).withColumn("accepted", J.accepted()), "accepted")


@register("junc_shadow", f"WITH j AS ({AGG.format('v_dense_hits')}) SELECT contig, l AS jl, r AS jr, a AS minus FROM j WHERE {SHADOW}")
def _(t: Tables) -> DataFrame:
    return J.shadowed(dense(t)).select("contig", F.col("left").alias("jl"), F.col("right").alias("jr"), F.col("antisense").alias("minus"))


@register(
    "junc_filter",
    f"""WITH j AS ({AGG.format('v_dense_hits')}), k AS (SELECT DISTINCT contig, l, r, a FROM j WHERE l % 50 = 13)
    SELECT {OUT.replace('contig', 'j.contig')}, (j.contig, l, r, a) IN (SELECT (contig, l, r, a) FROM k) OR ({ACCEPT} AND NOT {SHADOW}) AS accepted FROM j""",
)
def _(t: Tables) -> DataFrame:
    juncs = dense(t)
    return out(J.filtered(juncs, juncs.where("left % 50 = 13")), "accepted")


@register("junc_final", f"SELECT {OUT} FROM ({AGG.format('v_dense_hits')}) WHERE least(le, re) >= 8")
def _(t: Tables) -> DataFrame:
    return out(J.final(dense(t)))


@register("junc_gtf", f"SELECT contig, l AS jl, r AS jr, a AS minus FROM ({GTF})")
def _(t: Tables) -> DataFrame:
    return J.annotated(t.v_exons).select("contig", F.col("left").alias("jl"), F.col("right").alias("jr"), F.col("antisense").alias("minus"))


BED = f"""SELECT contig AS chrom, l + 1 - le AS bed_start, r + re AS bed_end, 'JUNC' || lpad(CAST(row_number() OVER (ORDER BY contig, l, r, a) AS VARCHAR), 8, '0') AS name, n AS score,
  CASE WHEN a THEN '-' ELSE '+' END AS strand, le || ',' || re AS sizes, '0,' || (r - (l + 1 - le)) AS starts FROM ({AGG.format('v_dense_hits')}) WHERE {ACCEPT}"""


@register("snk_junc_bed", BED)
def _(t: Tables) -> DataFrame:
    return J.bed(dense(t).where(J.accepted()))


@register("junc_from_bed", f"SELECT contig, l AS jl, r AS jr, a AS minus, n FROM ({AGG.format('v_dense_hits')}) WHERE {ACCEPT}")
def _(t: Tables) -> DataFrame:
    return J.from_bed(J.bed(dense(t).where(J.accepted()))).select("contig", F.col("left").alias("jl"), F.col("right").alias("jr"), F.col("antisense").alias("minus"), F.col("supporting_hits").alias("n"))


@register(
    "junc_sam",
    f"""WITH {OPS}, x AS (SELECT w.*, lag(len) OVER o AS le, lead(len) OVER o AS re, coalesce(xs = '-', flag & 16 > 0) AS a FROM w JOIN v_sam USING (insert_id, ord) WINDOW o AS (PARTITION BY w.insert_id, w.ord ORDER BY i))
    SELECT rname AS contig, CAST(st - 1 AS BIGINT) AS jl, CAST(st + len AS BIGINT) AS jr, a AS minus, max(le) AS le, max(re) AS re, count(*) AS n FROM x WHERE op = 'N' GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    return out(J.aggregate(J.extract_ops(sam(t)))).drop("mm")


@register("junc_load_known", "SELECT contig, ex_end - 1 AS jl, ex_end + 500 AS jr, strand = '-' AS minus, CAST(0 AS BIGINT) AS n FROM v_exons")
def _(t: Tables) -> DataFrame:
    line = t.v_exons.select(F.concat_ws("\t", "contig", (F.col("ex_end") - 1).cast("string"), (F.col("ex_end") + 500).cast("string"), "strand").alias("value"))
    f = F.split("value", "\t")
    return line.select(f[0].alias("contig"), f[1].cast("long").alias("jl"), f[2].cast("long").alias("jr"), (f[3] == "-").alias("minus"), F.lit(0).cast("long").alias("n"))


@register("snk_juncs", f"SELECT contig || chr(9) || l || chr(9) || r || chr(9) || CASE WHEN a THEN '-' ELSE '+' END AS line FROM ({AGG.format('v_dense_hits')})")
def _(t: Tables) -> DataFrame:
    return dense(t).select(F.concat_ws("\t", "contig", F.col("left").cast("string"), F.col("right").cast("string"), F.when(F.col("antisense"), "-").otherwise("+")).alias("line"))


@register("lift_contig_chr", "SELECT event_id, 'chr' || substr(chrom, 2) AS chrom, iv_begin + CAST(substr(chrom, 2) AS BIGINT) * 1000000 AS iv_begin, iv_end + CAST(substr(chrom, 2) AS BIGINT) * 1000000 AS iv_end FROM v_intervals")
def _(t: Tables) -> DataFrame:
    places = t.v_intervals.select("chrom").distinct().select("chrom", F.concat(F.lit("chr"), F.substring("chrom", 2, 9)).alias("to"), (F.substring("chrom", 2, 9).cast("long") * 1_000_000).alias("offset"))
    return t.v_intervals.join(places, "chrom").select("event_id", F.col("to").alias("chrom"), (F.col("iv_begin") + F.col("offset")).alias("iv_begin"), (F.col("iv_end") + F.col("offset")).alias("iv_end"))


INDEL = f"""{OPS}, x AS (SELECT w.*, lag(len) OVER o AS le, lead(len) OVER o AS re,
  coalesce(sum(CASE WHEN op IN ('M', 'I', 'S') THEN len ELSE 0 END) OVER (PARTITION BY insert_id, ord ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS q
  FROM w WINDOW o AS (PARTITION BY insert_id, ord ORDER BY i)),
ins AS (SELECT rname AS contig, CAST(st - 1 AS BIGINT) AS l, substr(seq, CAST(q + 1 AS INTEGER), CAST(len AS INTEGER)) AS bases, le, re FROM x JOIN v_sam USING (insert_id, ord, rname) WHERE op = 'I'),
del AS (SELECT rname AS contig, CAST(st - 1 AS BIGINT) AS l, CAST(st + len AS BIGINT) AS r, le, re FROM x WHERE op = 'D')"""


@register("ins_extract", f"WITH {INDEL} SELECT contig, l, bases, le, re FROM ins")
def _(t: Tables) -> DataFrame:
    return J.indels(sam(t), "I").select("contig", F.col("left").alias("l"), "bases", F.col("left_extent").alias("le"), F.col("right_extent").alias("re"))


def insertions(t: Tables) -> DataFrame:
    return J.indel_counts(J.indels(sam(t), "I"), ["contig", "left", "bases"])


def deletions(t: Tables) -> DataFrame:
    return J.indel_counts(J.indels(sam(t), "D"), ["contig", "left", "right"])


@register("ins_agg", f"WITH {INDEL} SELECT contig, l, bases, count(*) AS n, max(le) AS le, max(re) AS re FROM ins GROUP BY contig, l, bases")
def _(t: Tables) -> DataFrame:
    return insertions(t).select("contig", F.col("left").alias("l"), "bases", F.col("supporting_hits").alias("n"), F.col("left_extent").alias("le"), F.col("right_extent").alias("re"))


@register("del_extract", f"WITH {INDEL} SELECT contig, l, r, le, re FROM del")
def _(t: Tables) -> DataFrame:
    return J.indels(sam(t), "D").select("contig", F.col("left").alias("l"), F.col("right").alias("r"), F.col("left_extent").alias("le"), F.col("right_extent").alias("re"))


@register("del_agg", f"WITH {INDEL} SELECT contig, l, r, count(*) AS n, max(le) AS le, max(re) AS re FROM del GROUP BY contig, l, r")
def _(t: Tables) -> DataFrame:
    return deletions(t).select("contig", F.col("left").alias("l"), F.col("right").alias("r"), F.col("supporting_hits").alias("n"), F.col("left_extent").alias("le"), F.col("right_extent").alias("re"))


@register("indel_merge", f"WITH {INDEL} SELECT contig, l, r, CAST(2 * count(*) AS BIGINT) AS n FROM del GROUP BY contig, l, r")
def _(t: Tables) -> DataFrame:
    twice = deletions(t).unionByName(deletions(t))
    return twice.groupBy("contig", F.col("left").alias("l"), F.col("right").alias("r")).agg(F.sum("supporting_hits").alias("n"))


@register("snk_ins_bed", f"WITH {INDEL} SELECT contig AS chrom, l AS bed_start, l AS bed_end, bases AS name, CAST(least(count(*), 1000) AS BIGINT) AS score FROM ins GROUP BY contig, l, bases")
def _(t: Tables) -> DataFrame:
    return insertions(t).select(F.col("contig").alias("chrom"), F.col("left").alias("bed_start"), F.col("left").alias("bed_end"), F.col("bases").alias("name"), F.least("supporting_hits", F.lit(1000)).cast("long").alias("score"))


@register("snk_del_bed", f"WITH {INDEL} SELECT contig AS chrom, l + 1 AS bed_start, r AS bed_end, '-' AS name, count(*) AS score FROM del GROUP BY contig, l, r")
def _(t: Tables) -> DataFrame:
    return deletions(t).select(F.col("contig").alias("chrom"), (F.col("left") + 1).alias("bed_start"), F.col("right").alias("bed_end"), F.lit("-").alias("name"), F.col("supporting_hits").alias("score"))
