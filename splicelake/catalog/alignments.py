"""Scalar operators on alignment rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.catalog import register
from splicelake.functions import cigar
from splicelake.operators import hits
from splicelake.views import Tables

KEY = ("insert_id", "ord")
#: Operations of v_sam with the reference place where each begins.
OPS = """ops AS (SELECT insert_id, ord, rname, pos, generate_subscripts(n, 1) AS i, CAST(unnest(n) AS BIGINT) AS len, unnest(o) AS op
  FROM (SELECT *, regexp_extract_all(cigar, '([0-9]+)[A-Z]', 1) AS n, regexp_extract_all(cigar, '[0-9]+([A-Z])', 1) AS o FROM v_sam)),
w AS (SELECT *, pos + coalesce(sum(CASE WHEN op IN ('M', 'D', 'N') THEN len ELSE 0 END) OVER (
  PARTITION BY insert_id, ord ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM ops)"""


def sam(t: Tables) -> DataFrame:
    return t.v_sam.withColumn("ops", cigar.parse(F.col("cigar")))


def total(letters: str) -> str:
    marks = ", ".join(f"'{c}'" for c in letters)
    return f"WITH {OPS} SELECT insert_id, ord, CAST(sum(CASE WHEN op IN ({marks}) THEN len ELSE 0 END) AS BIGINT) AS n FROM ops GROUP BY insert_id, ord"


@register("cig_parse", f"WITH {OPS} SELECT insert_id, ord, CAST(i AS INTEGER) AS i, op, CAST(len AS INTEGER) AS len FROM ops")
def _(t: Tables) -> DataFrame:
    return sam(t).select(*KEY, F.posexplode("ops").alias("i", "_x")).select(*KEY, (F.col("i") + 1).alias("i"), "_x.op", "_x.len")


@register("cig_print", "SELECT insert_id, ord, cigar AS printed FROM v_sam")
def _(t: Tables) -> DataFrame:
    return sam(t).select(*KEY, cigar.to_text(F.col("ops")).alias("printed"))


@register("cig_right", f"WITH {OPS} SELECT insert_id, ord, CAST(max(st + CASE WHEN op IN ('M', 'D', 'N') THEN len ELSE 0 END) AS BIGINT) AS rgt FROM w GROUP BY insert_id, ord")
def _(t: Tables) -> DataFrame:
    return sam(t).select(*KEY, cigar.right_end(F.col("pos"), F.col("ops")).alias("rgt"))


@register("cig_readlen", total("MIS"))
def _(t: Tables) -> DataFrame:
    return sam(t).select(*KEY, cigar.read_length(F.col("ops")).alias("n"))


@register("cig_gaplen", total("ID"))
def _(t: Tables) -> DataFrame:
    return sam(t).select(*KEY, cigar.gap_length(F.col("ops")).alias("n"))


@register("sam_alen", total("MI"))
def _(t: Tables) -> DataFrame:
    return sam(t).select(*KEY, cigar.aligned_length(F.col("ops")).alias("n"))


@register("cig_spliced", "SELECT insert_id, ord, cigar LIKE '%N%' AS spliced, CAST(coalesce(TRY_CAST(regexp_extract(cigar, '([0-9]+)N', 1) AS INTEGER), 0) AS INTEGER) AS skip FROM v_sam")
def _(t: Tables) -> DataFrame:
    return sam(t).select(*KEY, cigar.is_spliced(F.col("ops")).alias("spliced"), cigar.longest_skip(F.col("ops")).alias("skip"))


@register("cig_contig", "SELECT insert_id, ord, regexp_full_match(cigar, '[0-9]+M') AS contiguous FROM v_sam")
def _(t: Tables) -> DataFrame:
    return sam(t).select(*KEY, cigar.is_contiguous(F.col("ops")).alias("contiguous"))


@register("cig_gaps", f"WITH {OPS} SELECT insert_id, ord, CAST(st AS BIGINT) AS gap_start, CAST(st + len AS BIGINT) AS gap_end FROM w WHERE op = 'N'")
def _(t: Tables) -> DataFrame:
    return sam(t).select(*KEY, F.inline(cigar.gaps(F.col("pos"), F.col("ops"))).alias("gap_start", "gap_end"))


@register("cig_blocks", f"WITH {OPS} SELECT insert_id, ord, CAST(st AS BIGINT) AS b_start, CAST(st + len AS BIGINT) AS b_end FROM w WHERE op = 'M'")
def _(t: Tables) -> DataFrame:
    return sam(t).select(*KEY, F.inline(cigar.blocks(F.col("pos"), F.col("ops"))).alias("b_start", "b_end", "part")).drop("part")


def fused(t: Tables) -> DataFrame:
    """Alignments of left_ext bases up to ``lft`` and right_ext bases from ``rgt`` on, either side as ``dir`` says."""
    d = F.upper("dir")
    op = lambda side, n: F.struct(F.when(side == "F", "M").otherwise("m").alias("op"), F.col(n).cast("int").alias("len"))
    ops = F.array(op(F.substring(d, 1, 1), "left_ext"), F.struct(d.alias("op"), F.col("rgt").cast("int").alias("len")), op(F.substring(d, 2, 1), "right_ext"))
    start = F.when(F.substring(d, 1, 1) == "F", F.col("lft") - F.col("left_ext") + 1).otherwise(F.col("lft") + F.col("left_ext"))
    return t.v_fusions.withColumn("ops", ops).withColumn("start", start)


@register("cig_fusion_op", "SELECT fusion_id, upper(dir) AS d, lft AS f_left, rgt AS f_right FROM v_fusions")
def _(t: Tables) -> DataFrame:
    return fused(t).withColumn("_f", cigar.fusion(F.col("start"), F.col("ops"))).select("fusion_id", F.col("_f.dir").alias("d"), F.col("_f.left").alias("f_left"), F.col("_f.right").alias("f_right"))


@register(
    "cig_reverse",
    """SELECT fusion_id, right_ext || CASE WHEN substr(dir, 2, 1) = 'f' THEN 'm' ELSE 'M' END || lft || 'F' || left_ext
         || CASE WHEN substr(dir, 1, 1) = 'f' THEN 'm' ELSE 'M' END AS printed,
       CASE dir WHEN 'ff' THEN 'RR' WHEN 'rr' THEN 'FF' ELSE upper(dir) END AS d FROM v_fusions""",
)
def _(t: Tables) -> DataFrame:
    turned = fused(t).withColumn("_r", cigar.reverse(F.col("ops"), F.col("lft")))
    return turned.select("fusion_id", cigar.to_text(F.col("_r")).alias("printed"), F.col("_r")[1]["op"].alias("d"))


@register(
    "cig_partial",
    """SELECT fusion_id, left_ext || CASE WHEN substr(dir, 1, 1) = 'f' THEN 'M' ELSE 'm' END AS first_part,
       right_ext || CASE WHEN substr(dir, 2, 1) = 'f' THEN 'M' ELSE 'm' END AS second_part FROM v_fusions""",
)
def _(t: Tables) -> DataFrame:
    parts = fused(t).withColumn("_p", cigar.partials(F.col("ops")))
    return parts.select("fusion_id", cigar.to_text(F.col("_p.first")).alias("first_part"), cigar.to_text(F.col("_p.second")).alias("second_part"))


@register("cig_valid", r"SELECT insert_id, ord, regexp_full_match(cigar, '[0-9]+M([1-3][ID][0-9]+M|([5-9][0-9]|[0-9]{3,})N[0-9]+M)*') AS valid FROM v_sam")
def _(t: Tables) -> DataFrame:
    return sam(t).select(*KEY, cigar.is_valid(F.col("ops")).alias("valid"))


@register(
    "sam_to_bed",
    f"""WITH {OPS}, e AS (SELECT insert_id, ord, max(st + CASE WHEN op IN ('M', 'D', 'N') THEN len ELSE 0 END) AS en FROM w GROUP BY insert_id, ord)
    SELECT rname AS chrom, pos AS bed_start, CAST(en AS BIGINT) AS bed_end, qname AS name, mapq AS score, CASE WHEN flag & 16 > 0 THEN '-' ELSE '+' END AS strand
    FROM v_sam JOIN e USING (insert_id, ord) WHERE flag & 4 = 0""",
)
def _(t: Tables) -> DataFrame:
    return hits.to_bed(sam(t))


@register(
    "hit_tags",
    """SELECT insert_id, ord, CAST(count(*) OVER p AS BIGINT) AS nh, CAST(row_number() OVER o - 1 AS INTEGER) AS hi,
      CASE WHEN lead(contig) OVER o = contig THEN '=' ELSE lead(contig) OVER o END AS cc, lead(lft) OVER o AS cp,
      CASE WHEN intron > 0 THEN CASE WHEN antisense_splice THEN '-' ELSE '+' END
        WHEN (mate = 1) = antisense_aln THEN '+' ELSE '-' END AS xs
    FROM v_hits WINDOW p AS (PARTITION BY insert_id, mate), o AS (PARTITION BY insert_id, mate ORDER BY contig, lft, ord)""",
)
def _(t: Tables) -> DataFrame:
    tagged = hits.tags(t.v_hits, library="fr-firststrand", order=["contig", "lft", "ord"])
    return tagged.select(*KEY, "nh", "hi", "cc", "cp", "xs")


@register(
    "hit_mapq",
    """SELECT insert_id, ord, CASE n WHEN 1 THEN 50 WHEN 2 THEN 3 WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 0 END AS mapq
    FROM (SELECT *, count(*) OVER (PARTITION BY insert_id, mate) AS n FROM v_hits)""",
)
def _(t: Tables) -> DataFrame:
    return hits.mapq(t.v_hits).select(*KEY, "mapq")


@register(
    "hit_mate_fields",
    """WITH h AS (SELECT *, lft + m1 + intron + CASE WHEN intron > 0 THEN m2 ELSE 0 END AS rgt,
        row_number() OVER (PARTITION BY insert_id, mate ORDER BY as_score DESC, contig, lft, ord) AS k FROM v_hits), b AS (SELECT * FROM h WHERE k = 1)
    SELECT a.insert_id, a.mate, CAST(1 + CASE a.mate WHEN 1 THEN 64 ELSE 128 END + CASE WHEN a.antisense_aln THEN 16 ELSE 0 END
        + CASE WHEN m.insert_id IS NULL THEN 8 WHEN m.antisense_aln THEN 32 ELSE 0 END
        + CASE WHEN m.contig = a.contig AND m.antisense_aln <> a.antisense_aln THEN 2 ELSE 0 END AS INTEGER) AS flag,
      CASE WHEN m.insert_id IS NULL THEN '*' WHEN m.contig = a.contig THEN '=' ELSE m.contig END AS rnext, coalesce(m.lft + 1, 0) AS pnext,
      CAST(CASE WHEN m.contig IS NULL OR m.contig <> a.contig THEN 0
        WHEN a.lft < m.lft OR (a.lft = m.lft AND a.mate = 1) THEN greatest(a.rgt, m.rgt) - a.lft
        ELSE m.lft - greatest(a.rgt, m.rgt) END AS BIGINT) AS tlen
    FROM b a LEFT JOIN b m ON a.insert_id = m.insert_id AND a.mate <> m.mate""",
)
def _(t: Tables) -> DataFrame:
    best = hits.first_hit(hits.with_right(t.v_hits), ["insert_id", "mate"], [F.desc("as_score"), "contig", "lft", "ord"])
    return hits.mate_fields(best).select("insert_id", "mate", "flag", "rnext", "pnext", "tlen")
