"""Sequence table operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.catalog import register
from splicelake.functions import sequence as S
from splicelake.operators import intervals as I
from splicelake.operators import sequences as Q
from splicelake.views import Tables

#: Ranges of events over the genome's contigs.
RANGES = "SELECT event_id, 'p' || (event_id % (SELECT count(*) FROM pages)) AS contig, iv_begin % 3000 - 20 AS s, iv_begin % 3000 - 20 + (iv_end - iv_begin) AS e FROM v_intervals"


def ranges(t: Tables) -> DataFrame:
    n = t.pages.count()
    return t.v_intervals.select("event_id", F.concat(F.lit("p"), (F.col("event_id") % n).cast("string")).alias("contig"), (F.col("iv_begin") % 3000 - 20).alias("s"), (F.col("iv_begin") % 3000 - 20 + F.col("iv_end") - F.col("iv_begin")).alias("e"))


FETCHED = f"SELECT r.*, substr(seq, CAST(greatest(s, 0) + 1 AS INTEGER), CAST(greatest(e - greatest(s, 0), 0) AS INTEGER)) AS bases FROM ({RANGES}) r JOIN v_genome g USING (contig)"


def fetched(t: Tables) -> DataFrame:
    return Q.fetch(ranges(t), Q.tiles(t.v_genome, size=512), "contig", "s", "e", size=512)


@register("src_fasta_seq", "SELECT contig, CAST(i AS INTEGER) AS tile, substr(seq, i * 512 + 1, 512) AS seq FROM (SELECT *, unnest(range((length(seq) - 1) // 512 + 1)) AS i FROM v_genome WHERE length(seq) > 0)")
def _(t: Tables) -> DataFrame:
    return Q.tiles(t.v_genome, size=512)


@register("ref_fetch", f"SELECT event_id, bases FROM ({FETCHED})")
def _(t: Tables) -> DataFrame:
    return fetched(t).select("event_id", "bases")


@register("fa_region", f"SELECT event_id, contig || ':' || (greatest(s, 0) + 1) || '-' || e AS region, length(bases) AS n FROM ({FETCHED})")
def _(t: Tables) -> DataFrame:
    return fetched(t).select("event_id", F.concat("contig", F.lit(":"), (F.greatest("s", F.lit(0)) + 1).cast("string"), F.lit("-"), F.col("e").cast("string")).alias("region"), F.length("bases").cast("long").alias("n"))


@register("seq_subseq", f"SELECT event_id, reverse(translate(regexp_replace(bases, '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA')) AS bases FROM ({FETCHED})")
def _(t: Tables) -> DataFrame:
    return fetched(t).select("event_id", S.revcomp(F.col("bases")).alias("bases"))


@register("fa_index", "SELECT contig, CAST(length(seq) AS BIGINT) AS length FROM v_genome")
def _(t: Tables) -> DataFrame:
    return t.v_genome.select("contig", F.length("seq").cast("long").alias("length"))


COMP = ", ".join(f"CAST(length(seq) - length(replace(seq, '{c}', '')) AS BIGINT) AS n_{c.lower()}" for c in "ACGTN")


@register("seq_comp", f"SELECT contig, CAST(length(seq) AS BIGINT) AS length, {COMP}, CAST((length(seq) - length(replace(seq, 'CG', ''))) / 2 AS BIGINT) AS n_cpg FROM v_genome")
def _(t: Tables) -> DataFrame:
    return Q.composition(t.v_genome)


HET = "SELECT contig, pos, base FROM (SELECT contig, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS base FROM (SELECT contig, string_split(translate(seq, 'N', 'R'), '') AS a FROM v_genome))"


def ambiguous(t: Tables) -> DataFrame:
    return Q.letters(t.v_genome.withColumn("seq", F.translate("seq", "N", "R")))


@register("seq_listhet", f"SELECT contig, CAST(pos AS INTEGER) AS pos, base FROM ({HET}) WHERE base IN ('R', 'Y', 'S', 'W', 'K', 'M')")
def _(t: Tables) -> DataFrame:
    return ambiguous(t).where("base in ('R', 'Y', 'S', 'W', 'K', 'M')")


@register("seq_hety", f"WITH h AS ({HET}), k AS (SELECT contig, unnest([pos // 50, pos // 50 - 1]) AS k, base FROM h) SELECT contig, CAST(k * 50 AS BIGINT) AS start, count(*) AS n, count(*) FILTER (base = 'R') AS het FROM k WHERE k >= 0 GROUP BY contig, k")
def _(t: Tables) -> DataFrame:
    step = F.floor(F.col("pos") / 50)
    rows = ambiguous(t).select("contig", F.explode(F.array(step, step - 1)).alias("k"), "base").where("k >= 0")
    return rows.groupBy("contig", "k").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("base") == "R").alias("het")).select("contig", (F.col("k") * 50).alias("start"), "n", "het")


@register("seq_fq2fa", "SELECT read_id, array_to_string(list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN ascii(substr(qual, i, 1)) - 33 < 25 THEN lower(substr(seq, i, 1)) ELSE substr(seq, i, 1) END), '') AS seq FROM v_reads")
def _(t: Tables) -> DataFrame:
    low = F.zip_with(F.split("seq", ""), F.split("qual", ""), lambda s, q: F.when(F.ascii(q) - 33 < 25, F.lower(s)).otherwise(s))
    return t.v_reads.select("read_id", F.array_join(low, "").alias("seq"))


@register("seq_famask", "SELECT read_id, array_to_string(list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN i % 3 = 1 THEN lower(substr(seq, i, 1)) WHEN i % 3 = 2 THEN substr(seq, i, 1) ELSE 'n' END), '') AS seq FROM v_reads")
def _(t: Tables) -> DataFrame:
    mask = F.expr("substring(repeat('xXn', 50), 1, length(seq))")
    return t.v_reads.select("read_id", Q.apply_mask(F.col("seq"), mask).alias("seq"))


@register("seq_merge", "SELECT a.read_id, array_to_string(list_transform(range(1, length(a.seq) + 1), lambda i: substr('XACMGRSVTWYHKDBN', 1 + ((instr('XACMGRSVTWYHKDBN', substr(a.seq, i, 1)) - 1) | (instr('XACMGRSVTWYHKDBN', substr(b.seq, i, 1)) - 1)), 1)), '') AS seq FROM v_reads a JOIN v_reads b ON b.read_id = a.read_id + 1 AND length(a.seq) = length(b.seq)")
def _(t: Tables) -> DataFrame:
    other = t.v_reads.select((F.col("read_id") - 1).alias("read_id"), F.col("seq").alias("b_seq"))
    return t.v_reads.join(other, "read_id").where(F.length("seq") == F.length("b_seq")).select("read_id", Q.merge_iupac(F.col("seq"), F.col("b_seq")).alias("seq"))


@register("seq_randbase")
def _(t: Tables) -> DataFrame:
    pick = F.when(F.pmod(F.xxhash64("contig", "pos"), F.lit(2)) == 0, "A").otherwise("G")
    return ambiguous(t).where("base = 'R'").select("contig", "pos", pick.alias("base"))


@register("seq_mutate", "WITH c AS (SELECT 'p' || page_id AS contig, page_id % 40 AS pos FROM pages) SELECT contig, CASE WHEN length(seq) > pos THEN substr(seq, 1, CAST(pos AS INTEGER)) || 'T' || substr(seq, CAST(pos AS INTEGER) + 2) ELSE seq END AS seq FROM v_genome JOIN c USING (contig)")
def _(t: Tables) -> DataFrame:
    changes = t.pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("contig"), (F.col("page_id") % 40).alias("pos"), F.lit("T").alias("base"))
    return Q.mutated(t.v_genome, changes, size=1 << 20).select("contig", "seq")


MASK = "SELECT contig, min(s) AS s, max(e) AS e FROM (SELECT *, sum(f) OVER (PARTITION BY contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM (SELECT contig, greatest(s, 0) AS s, e FROM ({0}) WHERE e > 0))) GROUP BY contig, g"


@register(
    "seq_mask",
    f"""WITH m AS ({MASK.format(RANGES)}), p AS (SELECT contig, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS base FROM (SELECT contig, string_split(seq, '') AS a FROM v_genome WHERE length(seq) > 0))
    SELECT p.contig, CAST(pos // 512 AS INTEGER) AS tile, string_agg(CASE WHEN m.contig IS NULL THEN base ELSE lower(base) END, '' ORDER BY pos) AS seq FROM p LEFT JOIN m ON m.contig = p.contig AND s <= pos AND pos < e GROUP BY p.contig, pos // 512""",
)
def _(t: Tables) -> DataFrame:
    inside = ranges(t).where("e > 0").select("contig", F.greatest("s", F.lit(0)).cast("long").alias("start"), F.col("e").alias("end"))
    return Q.masked(t.v_genome, I.merged(inside, "contig", "start", "end"), size=512)


@register("seq_cutn", "WITH p AS (SELECT contig, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS base FROM (SELECT contig, string_split(seq, '') AS a FROM v_genome)), g AS (SELECT *, pos - row_number() OVER (PARTITION BY contig ORDER BY pos) AS g FROM p WHERE base = 'N') SELECT contig, CAST(min(pos) AS INTEGER) AS s, CAST(max(pos) + 1 AS INTEGER) AS e FROM g GROUP BY contig, g HAVING count(*) >= 4")
def _(t: Tables) -> DataFrame:
    return Q.n_runs(t.v_genome, least=4).select("contig", F.col("start").alias("s"), F.col("end").alias("e"))


@register("seq_cutn_scored")
def _(t: Tables) -> DataFrame:
    """Stretches of ten bases or more, as texts have no longer ones, at the usual penalty."""
    return Q.n_stretches(t.v_genome, least=10).select("contig", F.col("start").alias("s"), F.col("end").alias("e"))


@register("fa_split_ranges", "WITH c AS (SELECT contig, length(seq) AS n, CAST(greatest(ceil((length(seq) - 30.0) / 300), 1) AS BIGINT) AS k FROM v_genome) SELECT contig, i * 300 AS s, CASE WHEN i = k - 1 THEN n ELSE (i + 1) * 300 END AS e FROM (SELECT *, unnest(range(k)) AS i FROM c)")
def _(t: Tables) -> DataFrame:
    lengths = t.v_genome.select("contig", F.length("seq").cast("long").alias("length"))
    return Q.windows(lengths, 300).select("contig", F.col("start").alias("s"), F.col("end").alias("e"))


@register("disc_kmer_count", "SELECT kmer, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(seq) - 8), lambda i: substr(seq, i, 10))) AS kmer FROM v_reads WHERE length(seq) >= 10) GROUP BY kmer")
def _(t: Tables) -> DataFrame:
    """One table of counts a core: a task may give all words that there are, so more tasks would shuffle more."""
    return Q.kmer_counts(spread_reads(t, t.spark.sparkContext.defaultParallelism).where(F.length("seq") >= 10), 10)


def spread_reads(t: Tables, *parts: int) -> DataFrame:
    """Reads of texts that are dealt out first, into so many ``parts`` if given, so that a file of one row group is not cut in one task."""
    return t.over("v_reads", documents=t.documents.select("doc_id", "text").repartition(*parts, "doc_id"))


def kmers(t: Tables) -> DataFrame:
    """Each place of a read: its ten bases there, and up to fourteen on either side."""
    at = spread_reads(t).where(F.length("seq") >= 10).withColumn("i", F.explode(F.sequence(F.lit(1), F.length("seq") - 9)))
    left = F.substr("seq", F.greatest(F.col("i") - 14, F.lit(1)), F.least(F.col("i") - 1, F.lit(14)))
    return at.select("read_id", "i", F.substr("seq", "i", F.lit(10)).alias("kmer"), left.alias("left_ext"), F.substr("seq", F.col("i") + 10, F.lit(14)).alias("right_ext"))


KMERS = "SELECT read_id, i, substr(seq, i, 10) AS kmer, substr(seq, greatest(i - 14, 1), least(i - 1, 14)) AS left_ext, substr(seq, i + 10, 14) AS right_ext FROM (SELECT *, unnest(range(1, length(seq) - 8)) AS i FROM v_reads WHERE length(seq) >= 10)"


@register("disc_kmer_ext", f"SELECT DISTINCT kmer, left_ext, right_ext FROM ({KMERS})")
def _(t: Tables) -> DataFrame:
    return Q.extended(spread_reads(t), 10, 14)


@register("disc_ext_prune", f"SELECT DISTINCT kmer, right(left_ext, 4) AS left_ext, substr(right_ext, 1, 4) AS right_ext FROM ({KMERS})")
def _(t: Tables) -> DataFrame:
    return Q.extended(spread_reads(t), 10, 4)


@register("tx_sequences", "SELECT tx_id, string_agg(bases, '' ORDER BY ex_start, ex_end) AS seq FROM (SELECT tx_id, ex_start, ex_end, substr(seq, CAST(1 + ex_start % 900 AS INTEGER), CAST(ex_end - ex_start AS INTEGER)) AS bases FROM v_exons JOIN v_genome ON v_genome.contig = 'p' || substr(v_exons.contig, 2)) GROUP BY tx_id")
def _(t: Tables) -> DataFrame:
    return transcripts(t).select("tx_id", "seq")


def transcripts(t: Tables) -> DataFrame:
    """Exon sequences of a transcript, at made-up places of the genome, in a row."""
    exons = t.v_exons.select("tx_id", "ex_start", "ex_end", F.concat(F.lit("p"), F.substring("contig", 2, 9)).alias("g"), (F.col("ex_start") % 900).alias("s"), (F.col("ex_start") % 900 + F.col("ex_end") - F.col("ex_start")).alias("e"))
    parts = Q.fetch(exons, Q.tiles(t.v_genome, size=512), "g", "s", "e", size=512)
    return parts.groupBy("tx_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("ex_start", "ex_end", "bases")))["bases"], "").alias("seq"))


@register("tx_spliced_seq")
def _(t: Tables) -> DataFrame:
    return transcripts(t).select("tx_id", F.length("seq").alias("n"), S.translate(F.col("seq")).alias("protein"))
