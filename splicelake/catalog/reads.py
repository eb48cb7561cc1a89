"""Read preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.catalog import register
from splicelake.functions import sequence as S
from splicelake.operators import reads as R
from splicelake.views import Tables

N = {c: f"(length(seq) - length(replace(seq, '{c}', '')))" for c in "ACGTN"}
CODE = f"CASE WHEN length(seq) < 12 THEN 'S' WHEN greatest({N['A']}, {N['C']}, {N['G']}, {N['T']}) > 0.9 * length(seq) THEN 'L' WHEN {N['N']} >= 0.1 * length(seq) THEN 'N' END"
REVCOMP = "reverse(translate(regexp_replace(seq, '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA'))"


@register("revcomp", f"SELECT read_id, {REVCOMP} AS rc FROM v_reads")
def _(t: Tables) -> DataFrame:
    return t.v_reads.select("read_id", S.revcomp(F.col("seq")).alias("rc"))


@register("prep_qual33", "SELECT read_id, qual AS fixed FROM v_reads")
def _(t: Tables) -> DataFrame:
    old = F.translate("qual", "".join(map(chr, range(33, 96))), "".join(map(chr, range(64, 127))))
    return t.v_reads.select("read_id", S.to_phred33(old).alias("fixed"))


@register("prep_intqual", "SELECT read_id, chr(CAST(read_id % 40 + 33 AS INTEGER)) || '!' || chr(CAST(read_id % 7 + 33 AS INTEGER)) AS qual FROM v_reads")
def _(t: Tables) -> DataFrame:
    text = F.concat_ws(" ", (F.col("read_id") % 40).cast("string"), F.lit("-5"), (F.col("read_id") % 7).cast("string"))
    return t.v_reads.select("read_id", S.from_integers(text).alias("qual"))


@register("prep_filter", f"SELECT read_id, {CODE} AS code FROM v_reads")
def _(t: Tables) -> DataFrame:
    return R.prepared(t.v_reads).select("read_id", F.col("trash_code").alias("code"))


@register("prep_ids", f"SELECT k AS number, read_id FROM (SELECT *, row_number() OVER (ORDER BY read_id) - 1 AS k FROM v_reads) WHERE {CODE} IS NULL")
def _(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    cells = t.v_reads.withColumn("_c", F.floor(F.col("read_id") / 4096))
    before = cells.groupBy("_c").agg(F.count(F.lit(1)).alias("_n")).select("_c", F.coalesce(F.sum("_n").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    placed = cells.join(before, "_c").withColumn("number", F.col("_b") + F.row_number().over(Window.partitionBy("_c").orderBy("read_id")) - 1)
    return R.prepared(placed).where("trash_code is null").select("number", "read_id")


@register("prep_pairs", "SELECT coalesce(a.k, b.k) AS number, a.name AS left_name, b.name AS right_name, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'paired' ELSE 'unpaired' END AS mate_state FROM (SELECT read_id // 2 AS k, * FROM v_reads WHERE mate = 1) a FULL JOIN (SELECT read_id // 2 AS k, * FROM v_reads WHERE mate = 2 AND read_id % 7 < 6) b ON a.k = b.k")
def _(t: Tables) -> DataFrame:
    rows = t.v_reads.withColumn("number", F.floor(F.col("read_id") / 2))
    return R.paired(rows.where("mate = 1"), rows.where("mate = 2 and read_id % 7 < 6")).select("number", "left_name", "right_name", "mate_state")


@register("prep_pairname", "SELECT a.read_id, length(a.name) = length(b.name) AND hamming(a.name, CASE WHEN length(a.name) = length(b.name) THEN b.name ELSE a.name END) <= 2 AS agree FROM v_reads a JOIN v_reads b ON b.read_id = a.read_id + 7")
def _(t: Tables) -> DataFrame:
    other = t.v_reads.select((F.col("read_id") - 7).alias("read_id"), F.col("name").alias("other"))
    return t.v_reads.join(other, "read_id").select("read_id", R.names_agree(F.col("name"), F.col("other")).alias("agree"))


LISTED = "SELECT doc_id FROM labels WHERE toxic = 1"


def listed(t: Tables) -> DataFrame:
    return t.labels.where("toxic = 1").select(F.col("doc_id").alias("read_id"))


@register("prep_multi_drop", f"SELECT read_id FROM v_reads WHERE read_id NOT IN ({LISTED})")
def _(t: Tables) -> DataFrame:
    return t.v_reads.join(listed(t), "read_id", "left_anti").select("read_id")


@register("prep_semi", f"SELECT 'read' AS kind, read_id FROM v_reads WHERE read_id IN ({LISTED}) UNION ALL SELECT 'hit', insert_id FROM v_hits WHERE insert_id IN ({LISTED})")
def _(t: Tables) -> DataFrame:
    reads = t.v_reads.join(listed(t), "read_id", "left_semi").select(F.lit("read").alias("kind"), "read_id")
    hits = t.v_hits.withColumnRenamed("insert_id", "read_id").join(listed(t), "read_id", "left_semi").select(F.lit("hit").alias("kind"), "read_id")
    return reads.unionByName(hits)


@register("read_extract", f"SELECT read_id, read_id IN ({LISTED}) AS chosen FROM v_reads")
def _(t: Tables) -> DataFrame:
    reads = t.v_reads
    chosen = reads.join(listed(t), "read_id", "left_semi").select("read_id", F.lit(True).alias("chosen"))
    return chosen.unionByName(reads.join(listed(t), "read_id", "left_anti").select("read_id", F.lit(False).alias("chosen")))


@register("prep_stats", f"SELECT mate, CAST(min(CASE WHEN length(seq) >= 12 THEN length(seq) END) AS INTEGER) AS min_len, CAST(max(CASE WHEN length(seq) >= 12 THEN length(seq) END) AS INTEGER) AS max_len, count(*) AS reads_in, count(*) FILTER ({CODE} IS NULL) AS reads_out FROM v_reads GROUP BY mate")
def _(t: Tables) -> DataFrame:
    return R.read_stats(R.prepared(t.v_reads))


SEGMENTS = """SELECT read_id, i AS num, substr(seq, i * 25 + 1, CASE WHEN i = total - 1 THEN length(seq) ELSE 25 END) AS seg_seq, read_id || '|' || i * 25 || ':' || i || ':' || total AS segment
FROM (SELECT *, unnest(range(total)) AS i FROM (SELECT *, greatest(length(seq) // 25 + CASE WHEN length(seq) >= 25 AND length(seq) % 25 >= 20 THEN 1 ELSE 0 END, 1) AS total FROM v_reads))"""


@register("split_segments", f"SELECT read_id, CAST(num AS INTEGER) AS num, seg_seq, segment FROM ({SEGMENTS})")
def _(t: Tables) -> DataFrame:
    return R.segments(t.v_reads, 25)


@register("seg_name_parse", f"SELECT read_id, CAST(num * 25 AS BIGINT) AS \"offset\", CAST(num AS BIGINT) AS num, CAST(split_part(segment, ':', 3) AS BIGINT) AS total FROM ({SEGMENTS})")
def _(t: Tables) -> DataFrame:
    return R.segments(t.v_reads, 25).select(R.segment_name(F.concat("segment", F.lit("/1"))))


def to_reads(which: str, failed: str) -> str:
    rc = REVCOMP
    return f"""SELECT ord, qname || CASE WHEN flag & 64 > 0 THEN '/1' WHEN flag & 128 > 0 THEN '/2' ELSE '' END AS name, CASE WHEN flag & 16 > 0 THEN {rc} ELSE seq END AS seq,
      CASE WHEN flag & 16 > 0 THEN reverse(qual) ELSE qual END AS qual FROM v_sam WHERE {which} AND {failed}"""


@register("sam_to_reads", to_reads("flag & 4 > 0", "flag & 512 = 0"))
def _(t: Tables) -> DataFrame:
    return R.from_alignments(t.v_sam)


@register("bam2fq", to_reads("true", "true"))
def _(t: Tables) -> DataFrame:
    return R.from_alignments(t.v_sam, which="all", keep_failed=True)


@register("sam_to_reads_paired", "SELECT qname, max(seq) FILTER (flag & 64 > 0) AS first_seq, max(seq) FILTER (flag & 128 > 0) AS second_seq FROM v_sam WHERE flag & 256 = 0 GROUP BY qname HAVING count(*) FILTER (flag & 64 > 0) > 0 AND count(*) FILTER (flag & 128 > 0) > 0")
def _(t: Tables) -> DataFrame:
    side = F.when(F.col("flag").bitwiseAND(64) > 0, "first_seq").otherwise("second_seq")
    pairs = t.v_sam.where(F.col("flag").bitwiseAND(256) == 0).withColumn("side", side).groupBy("qname").pivot("side", ["first_seq", "second_seq"]).agg(F.max("seq"))
    return pairs.where("first_seq is not null and second_seq is not null")


@register("sam2fq_shard", "SELECT insert_id % 8 AS shard, count(*) AS n FROM v_sam GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.v_sam.withColumn("shard", F.pmod("insert_id", F.lit(8))).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@register("color_bp", "SELECT read_id, seq AS bases FROM v_reads WHERE seq NOT LIKE '%N%' AND length(seq) > 1")
def _(t: Tables) -> DataFrame:
    clean = t.v_reads.where("seq not like '%N%' and length(seq) > 1")
    return clean.select("read_id", S.from_colors(S.to_colors(F.col("seq"))).alias("bases"))


@register("sra_solid", "SELECT read_id, substr(qual, 2) AS qual FROM v_reads")
def _(t: Tables) -> DataFrame:
    return t.v_reads.select("read_id", F.expr("substr(qual, 2)").alias("qual"))


@register("src_read_sample", "SELECT mate, CAST(min(length(seq)) AS INTEGER) AS least, CAST(max(length(seq)) AS INTEGER) AS most, min(length(seq)) < 20 AS short FROM (SELECT *, row_number() OVER (PARTITION BY mate ORDER BY read_id) AS k FROM v_reads) WHERE k <= 4 GROUP BY mate")
def _(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    first = t.v_reads.withColumn("_k", F.row_number().over(Window.partitionBy("mate").orderBy("read_id"))).where("_k <= 4")
    return first.groupBy("mate").agg(F.min(F.length("seq")).alias("least"), F.max(F.length("seq")).alias("most"), (F.min(F.length("seq")) < 20).alias("short"))
