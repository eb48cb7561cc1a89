"""Text formats: lines made from the tables and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicelake.catalog import register
from splicelake.catalog.junctions import dense
from splicelake.sources import text as T
from splicelake.views import Tables


def line(df: DataFrame, *parts: Column, sep: str = "\t") -> DataFrame:
    return df.select(F.concat_ws(sep, *parts).alias("value"))


@register("src_fastx", "SELECT name, seq FROM v_reads WHERE length(seq) > 0")
def _(t: Tables) -> DataFrame:
    records = line(t.v_reads.where("length(seq) > 0"), F.concat(F.lit(">"), "name", F.lit(" a read")), F.regexp_replace("seq", "(.{50})", "$1\n"), sep="\n")
    return T.fasta(records).select("name", "seq")


@register("src_fastx_detect", "SELECT CAST(read_id // 1000000 AS VARCHAR) AS file, CASE WHEN mate = 1 THEN 'fasta' ELSE 'fastq' END AS format FROM v_reads WHERE read_id % 1000000 = 0")
def _(t: Tables) -> DataFrame:
    """A file of each document's reads, after a blank line; those that begin with a first mate are FASTA."""
    value = F.concat(F.when(F.col("mate") == 1, ">").otherwise("@"), "name")
    file = F.floor(F.col("read_id") / 1_000_000).cast("string").alias("file")
    lines = t.v_reads.select(file, (F.col("read_id") % 1_000_000 + 1).alias("block"), value.alias("value"))
    blank = t.v_reads.where("read_id % 1000000 = 0").select(file, F.lit(0).cast("long").alias("block"), F.lit("  ").alias("value"))
    return T.formats(lines.unionByName(blank))


@register("snk_fastx", "SELECT '@' || name || '/' || mate || chr(10) || seq || chr(10) || '+' || chr(10) || qual AS value FROM v_reads")
def _(t: Tables) -> DataFrame:
    return T.to_fastq(t.v_reads)


@register("src_fastq", "SELECT read_id AS number, name || '/' || mate AS name, seq, qual FROM v_reads")
def _(t: Tables) -> DataFrame:
    lines = T.to_fastq(t.v_reads).select(F.posexplode(F.split("value", "\n")).alias("line", "value"), F.regexp_extract("value", r"^@read(\d+)/", 1).cast("long").alias("number"))
    return T.fastq(lines)


@register("snk_sam", "SELECT qname || chr(9) || flag || chr(9) || rname || chr(9) || (pos + 1) || chr(9) || mapq || chr(9) || cigar || chr(9) || rnext || chr(9) || (pnext + 1) || chr(9) || tlen || chr(9) || seq || chr(9) || qual || chr(9) || 'NM:i:' || nm AS value FROM v_sam")
def _(t: Tables) -> DataFrame:
    return T.to_sam(t.v_sam, F.concat(F.lit("NM:i:"), F.col("nm").cast("string")))


@register("src_sam", "SELECT qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, CAST(nm AS VARCHAR) AS nm FROM v_sam")
def _(t: Tables) -> DataFrame:
    lines = T.to_sam(t.v_sam, F.concat(F.lit("NM:i:"), F.col("nm").cast("string")))
    header = line(t.supplier.select("s_nationkey").distinct(), F.lit("@SQ"), F.concat(F.lit("SN:c"), F.col("s_nationkey").cast("string")), F.lit("LN:20000"))
    return T.sam(header.unionByName(lines)).select(*T.SAM[:9], F.col("tags")["NM"].alias("nm"))


@register("src_bed", "SELECT chrom AS contig, iv_begin AS s, iv_end AS e FROM v_intervals")
def _(t: Tables) -> DataFrame:
    rows = line(t.v_intervals, F.col("chrom"), F.col("iv_begin").cast("string"), F.col("iv_end").cast("string"))
    return T.bed(rows).select("contig", F.col("start").alias("s"), F.col("end").alias("e"))


@register("src_bed_juncs", "SELECT contig, lft + m1 - 1 AS l, lft + m1 + intron AS r, antisense_splice AS minus FROM v_dense_hits GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    rows = line(dense(t), F.col("contig"), F.col("left").cast("string"), F.col("right").cast("string"), F.when(F.col("antisense"), "-").otherwise("+"))
    return T.junctions(rows).select("contig", F.col("left").alias("l"), F.col("right").alias("r"), F.col("antisense").alias("minus"))


GTF = """WITH r AS (SELECT *, max(ex_end) OVER (PARTITION BY contig, tx_id ORDER BY ex_start, ex_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v_exons),
g AS (SELECT *, sum(CASE WHEN ex_start - reach > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY contig, tx_id ORDER BY ex_start, ex_end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM r),
x AS (SELECT contig, tx_id, gene, strand, g, min(ex_start) AS s, max(ex_end) AS e FROM g GROUP BY ALL)
SELECT tx_id, gene, contig, strand, count(*) AS n_exons, CAST(sum(e - s) AS BIGINT) AS bases FROM x GROUP BY ALL"""


@register("src_gff", GTF)
def _(t: Tables) -> DataFrame:
    names = F.concat(F.lit('gene_id "'), "gene", F.lit('"; transcript_id "'), "tx_id", F.lit('";'))
    rows = line(t.v_exons, F.col("contig"), F.lit("made"), F.lit("exon"), (F.col("ex_start") + 1).cast("string"), F.col("ex_end").cast("string"), F.lit("."), F.col("strand"), F.lit("."), names)
    found = T.gtf(rows).select("tx_id", "gene", "contig", "strand", F.explode("exons").alias("x"))
    return found.groupBy("tx_id", "gene", "contig", "strand").agg(F.count(F.lit(1)).alias("n_exons"), F.sum(F.col("x.end") - F.col("x.start")).alias("bases"))


@register("src_refgene", "SELECT tx_id, gene, contig, strand, min(ex_start) AS s, max(ex_end) AS e, count(*) AS n FROM v_exons GROUP BY tx_id, gene, contig, strand")
def _(t: Tables) -> DataFrame:
    per = t.v_exons.groupBy("tx_id", "gene", "contig", "strand").agg(F.array_sort(F.collect_list(F.struct("ex_start", "ex_end"))).alias("x"))
    text = lambda c: F.concat(F.array_join(F.transform(F.col(f"x.{c}"), lambda v: v.cast("string")), ","), F.lit(","))
    dot = F.lit(".")
    rows = line(per, dot, F.col("tx_id"), F.col("contig"), F.col("strand"), F.array_min("x.ex_start").cast("string"), F.array_max("x.ex_end").cast("string"), dot, dot, dot, text("ex_start"), text("ex_end"), dot, F.col("gene"))
    return T.refgene(rows).select("tx_id", "gene", "contig", "strand", F.col("start").alias("s"), F.col("end").alias("e"), F.size("ex_starts").cast("long").alias("n"))


@register("src_repeatmask", "SELECT chrom AS contig, iv_begin AS s, iv_end AS e FROM v_regions")
def _(t: Tables) -> DataFrame:
    rows = line(t.v_regions, F.lit(" 1 2 3 4"), F.col("chrom"), (F.col("iv_begin") + 1).cast("string"), F.col("iv_end").cast("string"), F.lit("x"), sep=" ")
    return T.repeats(rows).select("contig", F.col("start").alias("s"), F.col("end").alias("e"))


@register("src_vcf", "SELECT contig, pos, ref, alt, CAST(qual AS DOUBLE) AS qual, depth FROM v_variants")
def _(t: Tables) -> DataFrame:
    rows = line(t.v_variants, F.col("contig"), (F.col("pos") + 1).cast("string"), F.lit("."), F.col("ref"), F.col("alt"), F.col("qual").cast("string"), F.lit("."), F.concat(F.lit("DP="), F.col("depth").cast("string")), F.lit("GT:DP"), F.lit("0/1:3"))
    return T.vcf(rows).select("contig", "pos", "ref", F.array_join("alt", ",").alias("alt"), "qual", F.col("info")["DP"].cast("long").alias("depth"))


@register("src_contig_md", "SELECT 'NT_' || n_nationkey AS contig, 'chr' || n_regionkey AS chrom, CAST(n_nationkey * 1000 AS BIGINT) AS shift FROM nation")
def _(t: Tables) -> DataFrame:
    rows = line(t.nation, F.lit("9606"), F.col("n_regionkey").cast("string"), (F.col("n_nationkey") * 1000 + 1).cast("string"), F.lit("."), F.lit("+"), F.concat(F.lit("NT_"), F.col("n_nationkey").cast("string")))
    f = F.split("value", "\t")
    return rows.select(f[5].alias("contig"), F.concat(F.lit("chr"), f[1]).alias("chrom"), (f[2].cast("long") - 1).alias("shift"))
