"""Fusion evidence and post-processing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.catalog import register
from splicelake.functions.sequence import hamming
from splicelake.operators import fusions as U
from splicelake.operators import hits as H
from splicelake.operators import junctions as J
from splicelake.views import Tables

CANON = """SELECT fusion_id, CASE WHEN s THEN contig2 ELSE contig1 END AS contig1, CASE WHEN s THEN contig1 ELSE contig2 END AS contig2, CASE WHEN s THEN rgt ELSE lft END AS lft, CASE WHEN s THEN lft ELSE rgt END AS rgt,
  CASE WHEN s THEN CASE dir WHEN 'ff' THEN 'rr' WHEN 'rr' THEN 'ff' ELSE dir END ELSE dir END AS dir, CASE WHEN s THEN right_ext ELSE left_ext END AS left_ext, CASE WHEN s THEN left_ext ELSE right_ext END AS right_ext
FROM (SELECT *, contig1 > contig2 OR (contig1 = contig2 AND lft > rgt) AS s FROM v_fusions)"""
#: Few breakpoints, so that they have several reads.
FEW = f"SELECT contig1, contig2, lft % 20 AS lft, rgt % 3 AS rgt, dir, left_ext, right_ext FROM ({CANON})"
EVIDENCE = f"""SELECT contig1, contig2, lft, rgt, dir, count(*) FILTER (left_ext >= 20 AND right_ext >= 20) AS n, max(left_ext) AS left_ext, max(right_ext) AS right_ext,
  [{', '.join(f'count(*) FILTER (left_ext >= 20 AND right_ext >= 20 AND left_ext > {k})' for k in range(50))}] AS lb, [{', '.join(f'count(*) FILTER (left_ext >= 20 AND right_ext >= 20 AND right_ext > {k})' for k in range(50))}] AS rb
  FROM ({FEW}) GROUP BY contig1, contig2, lft, rgt, dir"""


def few(t: Tables) -> DataFrame:
    rows = U.canonical(t.v_fusions)
    return rows.withColumns({"lft": F.col("lft") % 20, "rgt": F.col("rgt") % 3})


@register("fus_extract", CANON)
def _(t: Tables) -> DataFrame:
    return U.canonical(t.v_fusions).select("fusion_id", *U.KEY, "left_ext", "right_ext")


@register("fus_agg", f"SELECT contig1, contig2, lft, rgt, dir, n, left_ext, right_ext, list_sum(lb)::BIGINT AS l, list_sum(rb)::BIGINT AS r FROM ({EVIDENCE})")
def _(t: Tables) -> DataFrame:
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return U.evidence(few(t)).select(*U.KEY, "n", "left_ext", "right_ext", total("left_bases").alias("l"), total("right_bases").alias("r"))


@register("fus_merge", f"SELECT contig1, contig2, lft, rgt, dir, 2 * n AS n, 2 * list_sum(lb)::BIGINT AS l FROM ({EVIDENCE})")
def _(t: Tables) -> DataFrame:
    found = U.evidence(few(t))
    return U.merge_evidence(found, found).select(*U.KEY, "n", F.aggregate("left_bases", F.lit(0).cast("long"), lambda a, x: a + x).alias("l"))


@register("fus_symm", f"SELECT contig1, contig2, lft, rgt, dir, round(list_sum(list_transform(range(1, 51), lambda i: pow((lb[i] - rb[i]) / n, 2))), 6) AS symm FROM ({EVIDENCE}) WHERE n > 0")
def _(t: Tables) -> DataFrame:
    found = U.evidence(few(t)).where("n > 0")
    return found.select(*U.KEY, F.round(U.symmetry(F.col("n"), F.col("left_bases"), F.col("right_bases")), 6).alias("symm"))


@register("fus_flank_seq", "SELECT fusion_id, CASE WHEN substr(dir, 1, 1) = 'r' THEN reverse(translate(left_seq, 'ACGT', 'TGCA')) ELSE left_seq END AS l, CASE WHEN substr(dir, 2, 1) = 'r' THEN reverse(translate(right_seq, 'ACGT', 'TGCA')) ELSE right_seq END AS r FROM v_fusions")
def _(t: Tables) -> DataFrame:
    turn = lambda c, k: F.when(F.substring("dir", k, 1) == "r", U.revcomp(F.col(c))).otherwise(F.col(c))
    return t.v_fusions.select("fusion_id", turn("left_seq", 1).alias("l"), turn("right_seq", 2).alias("r"))


@register("seq_difference")
def _(t: Tables) -> DataFrame:
    return t.v_fusions.select("fusion_id", U.seq_difference("left_seq", "right_seq").alias("difference"))


@register("fp_filter_seqdiff")
def _(t: Tables) -> DataFrame:
    d = lambda n: U.seq_difference(F.substring("left_seq", 1, n), F.substring("right_seq", 1, n))
    return t.v_fusions.select("fusion_id", d(20).alias("d20"), d(40).alias("d40")).where("d20 > 8 and d20 + d40 >= 20")


NEAR = "SELECT fusion_id, contig1, contig2, lft % 20000 AS lft, rgt % 20000 AS rgt FROM v_fusions"


def near(t: Tables) -> DataFrame:
    return t.v_fusions.select("fusion_id", "contig1", "contig2", (F.col("lft") % 20000).alias("lft"), (F.col("rgt") % 20000).alias("rgt"))


@register(
    "fus_unsupport",
    f"""WITH h AS (SELECT contig, lft + 20 AS s, lft + m1 + intron + CASE WHEN intron > 0 THEN m2 ELSE 0 END - 20 AS e FROM v_hits WHERE m1 + intron + CASE WHEN intron > 0 THEN m2 ELSE 0 END >= 40),
    p AS (SELECT fusion_id, contig1 AS contig, lft AS place FROM ({NEAR}) UNION ALL SELECT fusion_id, contig2, rgt FROM ({NEAR})), c AS (SELECT fusion_id, count(*) AS n FROM p JOIN h ON p.contig = h.contig AND s <= place AND place <= e GROUP BY fusion_id)
    SELECT f.fusion_id, coalesce(n, 0) AS n_against FROM v_fusions f LEFT JOIN c USING (fusion_id)""",
)
def _(t: Tables) -> DataFrame:
    return U.contradicting(near(t), H.with_right(t.v_hits)).select("fusion_id", "n_against")


MATES = "SELECT a.insert_id * 1000 + a.ord * 30 + b.ord AS pair_id, a.contig AS a_contig, b.contig AS b_contig, a.lft AS a_pos, b.lft AS b_pos FROM v_hits a JOIN v_hits b ON a.insert_id = b.insert_id AND a.mate = 1 AND b.mate = 2"
SUPPORT = f"SELECT fusion_id, pair_id, abs(a_pos - lft) AS ldist, abs(b_pos - rgt) AS rdist FROM ({NEAR}) f JOIN ({MATES}) m ON a_contig = contig1 AND b_contig = contig2 AND abs(a_pos - lft) <= 2000 AND abs(b_pos - rgt) <= 2000"


def mates(t: Tables) -> DataFrame:
    p = H.pairs(t.v_hits)
    return p.select((F.col("insert_id") * 1000 + F.col("ord") * 30 + F.col("b_ord")).alias("pair_id"), F.col("contig").alias("a_contig"), F.col("b_contig"), F.col("lft").alias("a_pos"), F.col("b_lft").alias("b_pos"))


def support(t: Tables, reach: int = 2000) -> DataFrame:
    return U.pair_support(near(t), mates(t), reach=reach)


@register("fus_pair_support", SUPPORT)
def _(t: Tables) -> DataFrame:
    return support(t)


@register("fus_pair_topk", f"SELECT fusion_id, pair_id, k FROM (SELECT *, CAST(row_number() OVER (PARTITION BY fusion_id ORDER BY ldist + rdist, pair_id, ldist) AS INTEGER) AS k FROM ({SUPPORT})) WHERE k <= 200")
def _(t: Tables) -> DataFrame:
    return U.nearest_support(near(t), mates(t), most=200).select("fusion_id", "pair_id", "k")


DIFFS = " || ".join(f"hamming(substr(left_seq, {(4 - k) * 9 // 2 + 1}, {(k + 1) * 9}), substr(right_seq, {(4 - k) * 9 // 2 + 1}, {(k + 1) * 9})) || ' '" for k in range(5))
SPACED = "array_to_string(list_transform({0}, lambda x: x || ' '), '')"


@register(
    "snk_fusions",
    f"""WITH c AS (SELECT fusion_id, contig1, contig2, lft % 20 AS lft, rgt % 3 AS rgt, dir FROM ({CANON})), ev AS ({EVIDENCE}),
    st AS (SELECT contig1, contig2, lft, rgt, dir, CAST(sum(n_pairs) AS BIGINT) AS n_pairs, CAST(sum(n_span) AS BIGINT) AS n_span, min(left_seq) AS left_seq, min(right_seq) AS right_seq FROM c JOIN (SELECT fusion_id, n_pairs, n_span, left_seq, right_seq FROM v_fusions) v USING (fusion_id) GROUP BY ALL),
    pr AS (SELECT c.contig1, c.contig2, c.lft, c.rgt, c.dir, ldist, rdist, row_number() OVER (PARTITION BY c.contig1, c.contig2, c.lft, c.rgt, c.dir ORDER BY ldist + rdist, ldist, rdist) AS k FROM c JOIN (@SUPPORT@) p USING (fusion_id)),
    pt AS (SELECT contig1, contig2, lft, rgt, dir, string_agg(ldist || ':' || rdist || ' ', '' ORDER BY k) AS pairs FROM pr WHERE k <= 200 GROUP BY ALL)
    SELECT contig1 || '-' || contig2 || chr(9) || lft || chr(9) || rgt || chr(9) || dir || chr(9) || n || chr(9) || n_pairs || chr(9) || n_span || chr(9) || 0 || chr(9) || left_ext || chr(9) || right_ext || chr(9)
      || printf('%.6f', list_sum(list_transform(range(1, 51), lambda i: pow((lb[i] - rb[i]) / n, 2)))) || chr(9) || '@' || chr(9) || {DIFFS}
      || chr(9) || '@' || chr(9) || left(left_seq, 23) || ' ' || substr(left_seq, 24) || chr(9) || '@' || chr(9) || left(right_seq, 23) || ' ' || substr(right_seq, 24) || chr(9) || '@' || chr(9) || {SPACED.format("lb")} || chr(9) || '@' || chr(9) || {SPACED.format("rb")}
      || chr(9) || '@' || chr(9) || coalesce(pairs, '') AS line FROM ev JOIN st USING (contig1, contig2, lft, rgt, dir) LEFT JOIN pt USING (contig1, contig2, lft, rgt, dir) WHERE n > 0""".replace("@SUPPORT@", SUPPORT),
)
def _(t: Tables) -> DataFrame:
    """Few breakpoints, with the mates of all fusions at each; differences of sequences are counted place by place."""
    rows = few(t)
    stats = rows.groupBy(*U.KEY).agg(F.sum("n_pairs").alias("n_pairs"), F.sum("n_span").alias("n_span"), F.min("left_seq").alias("left_seq"), F.min("right_seq").alias("right_seq"))
    own = t.v_fusions.withColumns({"_c1": F.col("contig1"), "_c2": F.col("contig2"), "_l": F.col("lft") % 20000, "_r": F.col("rgt") % 20000})
    keyed = U.canonical(own).select("fusion_id", F.struct("contig1", "contig2", (F.col("lft") % 20).alias("lft"), (F.col("rgt") % 3).alias("rgt"), "dir").alias("key"), "_c1", "_c2", "_l", "_r")
    keyed = keyed.withColumnsRenamed({"_c1": "contig1", "_c2": "contig2", "_l": "lft", "_r": "rgt"})
    ends = lambda m, side: t.v_hits.where(F.col("mate") == m).select("insert_id", F.col("contig").alias(f"{side}_contig"), F.col("lft").alias(f"{side}_pos"))
    placed = ends(1, "a").join(ends(2, "b"), "insert_id").withColumn("pair_id", F.col("insert_id"))
    nearest = U.nearest_of_groups(keyed, placed, "key", most=200)
    pairs = nearest.groupBy("key").agg(F.collect_list(F.struct("ldist", "rdist")).alias("pairs")).select("key.*", "pairs")
    found = U.evidence(rows).join(stats, [*U.KEY]).join(pairs, [*U.KEY], "left")
    diffs = U.differences(F.col("left_seq"), F.col("right_seq"), differ=hamming)
    return U.report_lines(found.withColumns({"n_against": F.lit(0), "reversed": F.lit(False), "diffs": diffs}))


@register("fp_samples", "SELECT 's' || (fusion_id % 4) AS sample, count(*) AS n FROM v_fusions GROUP BY 1")
def _(t: Tables) -> DataFrame:
    path = F.concat(F.lit("/runs/s"), (F.col("fusion_id") % 4).cast("string"), F.lit("/fusions.out"))
    return t.v_fusions.groupBy(F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1).alias("sample")).agg(F.count(F.lit(1)).alias("n"))


KMERS = "SELECT DISTINCT unnest([substr(left_seq, 1, 23), substr(left_seq, 24, 23), substr(right_seq, 1, 23), substr(right_seq, 24, 23)]) AS kmer FROM v_fusions"


@register("fp_kmer", KMERS)
def _(t: Tables) -> DataFrame:
    parts = [F.substring(c, k, 23) for c in ("left_seq", "right_seq") for k in (1, 24)]
    return t.v_fusions.select(F.explode(F.array(*parts)).alias("kmer")).distinct()


@register("fp_junc_index", "WITH e AS (SELECT contig, ex_end - 1 AS l, lead(ex_start) OVER (PARTITION BY contig, tx_id ORDER BY ex_start, ex_end) AS r, ex_end, strand = '-' AS minus FROM v_exons) SELECT contig, l, r, minus FROM e WHERE r > ex_end UNION SELECT contig, lft + m1 - 1, lft + m1 + intron, antisense_splice FROM v_dense_hits")
def _(t: Tables) -> DataFrame:
    rows = J.annotated(t.v_exons).unionByName(J.extract(t.v_dense_hits).select(*J.KEY)).distinct()
    return rows.select("contig", F.col("left").alias("l"), F.col("right").alias("r"), F.col("antisense").alias("minus"))


COUNTS = "least(left_ext, right_ext) >= 16 AND n_pairs <= 50 * n_reads AND n_reads >= 3 AND n_pairs >= 2"
LIKE = "contig1 = contig2 AND dir = 'ff' AND rgt > lft AND rgt - lft < 100000"


@register("fp_filter_counts", f"SELECT fusion_id FROM v_fusions WHERE {COUNTS}")
def _(t: Tables) -> DataFrame:
    return t.v_fusions.where(U.passes_counts()).select("fusion_id")


@register("fp_filter_intron", f"SELECT fusion_id FROM v_fusions WHERE NOT ({LIKE})")
def _(t: Tables) -> DataFrame:
    return t.v_fusions.where(~U.is_intron_like()).select("fusion_id")


@register(
    "fp_filter_homology",
    """WITH f AS (SELECT *, substr(left_seq, 16, 8) AS lk, substr(right_seq, 24, 8) AS rk, CASE WHEN contig1 = contig2 THEN least(100000, abs(lft - rgt) * 9 // 10) ELSE 100000 END AS w FROM v_fusions),
    m AS (SELECT lk AS kmer, contig1 AS contig, lft AS pos FROM f UNION SELECT rk, contig2, rgt FROM f) SELECT fusion_id FROM f WHERE lk IN (SELECT kmer FROM m) AND rk IN (SELECT kmer FROM m)
    AND NOT EXISTS (SELECT 1 FROM m WHERE kmer = lk AND contig = contig2 AND abs(pos - rgt) < w) AND NOT EXISTS (SELECT 1 FROM m WHERE kmer = rk AND contig = contig1 AND abs(pos - lft) < w)""",
)
def _(t: Tables) -> DataFrame:
    """The places of a k-mer are the breakpoints it stands at. Flanks are hashes, of which 23 bases never recur: 8 bases are taken."""
    left = t.v_fusions.select(F.substring("left_seq", 16, 8).alias("kmer"), F.col("contig1").alias("contig"), F.col("lft").alias("pos"))
    right = t.v_fusions.select(F.substring("right_seq", 24, 8).alias("kmer"), F.col("contig2").alias("contig"), F.col("rgt").alias("pos"))
    return U.not_homologous(t.v_fusions, left.unionByName(right), k=8).select("fusion_id")


GENES = "SELECT contig, gene || '_' || tx_id AS gene, min(ex_start) * 8 AS s, max(ex_end) * 8 AS e FROM v_exons GROUP BY ALL"


def genes(t: Tables) -> DataFrame:
    named = t.v_exons.withColumn("gene", F.concat_ws("_", "gene", "tx_id"))
    return named.groupBy("contig", "gene").agg((F.min("ex_start") * 8).alias("start"), (F.max("ex_end") * 8).alias("end"))


@register("fp_gene_clean", f"SELECT contig, gene FROM (SELECT *, max(e) OVER (PARTITION BY contig ORDER BY s, e DESC, gene ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM ({GENES}) WHERE gene NOT LIKE 'MIR%') WHERE p IS NULL OR e > p")
def _(t: Tables) -> DataFrame:
    return U.clean_genes(genes(t)).select("contig", "gene")


ANNOT = f"SELECT fusion_id, (SELECT min(gene) FROM ({GENES}) g WHERE g.contig = contig1 AND s <= lft AND lft < e) AS gene1, (SELECT min(gene) FROM ({GENES}) g WHERE g.contig = contig2 AND s <= rgt AND rgt < e) AS gene2 FROM v_fusions"


EXONS = "SELECT contig, gene || '_' || tx_id AS gene, strand, ex_start * 8 AS s, ex_end * 8 AS e, row_number() OVER (PARTITION BY contig, gene, tx_id ORDER BY ex_start, ex_end) AS i, lag(ex_end * 8) OVER (PARTITION BY contig, gene, tx_id ORDER BY ex_start, ex_end) AS p FROM v_exons"
PLACED = ", ".join(f"max({c}) FILTER (side = {k}) AS {c}{k}" for k in (1, 2) for c in ("gene", "sense", "site")) + ", " + ", ".join(f"coalesce(bool_or(boundary) FILTER (side = {k}), false) AS boundary{k}" for k in (1, 2))


@register(
    "fp_gene_annot",
    f"""WITH ex AS ({EXONS}), gn AS (SELECT contig, gene, strand, min(s) AS gs, max(e) AS ge FROM ex GROUP BY ALL),
    pt AS (SELECT fusion_id, 1 AS side, contig1 AS contig, lft AS spot, dir[1] = 'f' AS far FROM v_fusions UNION ALL SELECT fusion_id, 2, contig2, rgt, dir[2] = 'r' FROM v_fusions),
    pg AS (SELECT pt.*, strand AS sense, min(gene) AS gene FROM pt JOIN gn ON gn.contig = pt.contig AND gs <= spot AND spot < ge GROUP BY ALL),
    pe AS (SELECT pg.*, s, e, i, p FROM pg JOIN ex ON ex.contig = pg.contig AND ex.gene = pg.gene AND spot <= e - 1 + 3 QUALIFY row_number() OVER (PARTITION BY fusion_id, side, sense ORDER BY i) = 1),
    pl AS (SELECT *, CASE WHEN spot < s - 3 THEN 'intron' || (i - 1) || '(' || p || '-' || (s - 1) || ')' ELSE 'exon' || i || '(' || s || '-' || (e - 1) || ')' END AS site, spot >= s - 3 AND abs(spot - CASE WHEN far THEN e - 1 ELSE s END) <= 3 AS boundary FROM pe
      QUALIFY row_number() OVER (PARTITION BY fusion_id, side ORDER BY sense) = 1)
    SELECT fusion_id, {PLACED} FROM v_fusions LEFT JOIN pl USING (fusion_id) GROUP BY fusion_id""",
)
def _(t: Tables) -> DataFrame:
    """Transcripts of strand + are the first annotation, those of strand - the second."""
    exons = t.v_exons.select("contig", F.concat_ws("_", "gene", "tx_id").alias("gene"), "strand", (F.col("ex_start") * 8).alias("start"), (F.col("ex_end") * 8).alias("end"))
    found = U.described(t.v_fusions, [exons.where(F.col("strand") == s) for s in "+-"])
    return found.withColumnsRenamed({"place1": "site1", "place2": "site2"})


@register("fp_filter_annot", f"SELECT fusion_id FROM ({ANNOT}) WHERE gene1 <> gene2")
def _(t: Tables) -> DataFrame:
    return U.annotated(t.v_fusions, genes(t)).where("gene1 != gene2").select("fusion_id")


RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


@register("fp_orient", f"SELECT fusion_id, CASE dir WHEN 'rr' THEN contig2 ELSE contig1 END AS contig1, CASE dir WHEN 'rr' THEN rgt ELSE lft END AS lft, CASE dir WHEN 'rr' THEN {RC.format('right_seq')} ELSE left_seq END AS left_seq FROM v_fusions")
def _(t: Tables) -> DataFrame:
    return U.oriented(t.v_fusions).select("fusion_id", "contig1", "lft", "left_seq")


@register("fp_depth_digits", f"SELECT contig1, contig2, lft, rgt, dir, array_to_string(list_transform(lb, lambda x: least(x, 9)), '') AS digits FROM ({EVIDENCE})")
def _(t: Tables) -> DataFrame:
    return U.evidence(few(t)).select(*U.KEY, F.array_join(F.transform("left_bases", lambda x: F.least(x, F.lit(9)).cast("string")), "").alias("digits"))


DIST = f"SELECT fusion_id, pair_id, ldist, rdist FROM ({SUPPORT}) WHERE ldist <= 300 AND rdist <= 300"


@register("fp_read_dist", DIST)
def _(t: Tables) -> DataFrame:
    return support(t, 300)


SLOTS = f"SELECT fusion_id, side, slot, count(*) AS depth FROM (SELECT *, unnest(range(n, least(n + 30, 300))) AS slot FROM (SELECT fusion_id, 'l' AS side, ldist AS n FROM ({DIST}) UNION ALL SELECT fusion_id, 'r', rdist FROM ({DIST})) WHERE n < 300) GROUP BY fusion_id, side, slot"


@register("fp_read_coverage", SLOTS)
def _(t: Tables) -> DataFrame:
    return U.pair_slots(near(t), mates(t))


SIDES = f"SELECT fusion_id, side, count(*) AS n, sum(depth) / count(*) AS average, min(slot) AS lead_gap FROM ({SLOTS}) GROUP BY fusion_id, side"


@register("fp_tx_dist")
def _(t: Tables) -> DataFrame:
    """Mates about each fusion, at growing distances, against the introns of the alignments."""
    from splicelake.operators import junctions as J

    off = 30 + F.col("fusion_id") % 150 + 97 * F.col("pair_id")
    rows = t.v_fusions.where("n_pairs > 0").select("fusion_id", "contig1", "contig2", (F.col("lft") % 15_000 + 2000).alias("pos1"), (F.col("rgt") % 15_000 + 2000).alias("pos2"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_pairs"))).alias("pair_id"))
    pairs = rows.withColumns({"mate1": F.col("pos1") - off, "mate2": F.col("pos2") + off})
    introns = J.extract(t.v_hits).select("contig", "left", "right", F.when(F.col("antisense"), "-").otherwise("+").alias("strand"))
    return U.transcript_distances(pairs, introns)


@register("fp_cov_filter", f"SELECT l.fusion_id FROM ({SIDES}) l JOIN ({SIDES}) r ON l.fusion_id = r.fusion_id AND l.side = 'l' AND r.side = 'r' WHERE l.lead_gap < 200 AND r.lead_gap < 200 AND abs(l.n - r.n) <= 20")
def _(t: Tables) -> DataFrame:
    sides = U.pair_slots(near(t), mates(t), ends=True)
    per = sides.groupBy("fusion_id").pivot("side", ["l", "r"]).agg(F.max("n").alias("n"), F.max("lead").alias("lead"))
    return per.where("l_lead < 200 and r_lead < 200 and abs(l_n - r_n) <= 20").select("fusion_id")


@register("fp_assembled", "SELECT f.fusion_id, count(a.fusion_id) AS n_assembled FROM v_fusions f LEFT JOIN v_fusions a ON a.contig1 = f.contig1 AND a.contig2 = f.contig2 AND a.rgt = f.rgt AND a.fusion_id <> f.fusion_id GROUP BY f.fusion_id")
def _(t: Tables) -> DataFrame:
    return U.assembled(t.v_fusions)


SCORED = "SELECT *, CAST(n_reads * 2 + n_pairs - abs(n_reads - n_pairs) + least(300, left_ext * 10) + least(300, right_ext * 10) - least(300, abs(left_ext * 10 - right_ext * 10)) - n_span - least(abs(lft - rgt), 1000) AS BIGINT) AS score FROM v_fusions"


@register("fp_score", f"SELECT fusion_id, score - n_reads AS score FROM ({SCORED})")
def _(t: Tables) -> DataFrame:
    z = F.lit(0)
    parts = {"lcount": F.col("n_reads"), "rcount": F.col("n_pairs"), "lavg": F.col("left_ext") * 10, "ravg": F.col("right_ext") * 10, "lgap": F.col("n_span"), "rgap": z, "lder": z, "rder": z, "dist": F.abs(F.col("lft") - F.col("rgt")), "rate": z}
    return t.v_fusions.withColumns(parts).select("fusion_id", U.score().alias("score"))


CLUSTER = """WITH a AS (SELECT *, CASE WHEN lft - lag(lft) OVER (PARTITION BY contig1, contig2, dir ORDER BY lft, fusion_id) > 500000 THEN 1 ELSE 0 END AS f FROM v_fusions),
b AS (SELECT *, sum(f) OVER (PARTITION BY contig1, contig2, dir ORDER BY lft, fusion_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x FROM a),
c AS (SELECT *, CASE WHEN rgt - lag(rgt) OVER (PARTITION BY contig1, contig2, dir, x ORDER BY rgt, fusion_id) > 500000 THEN 1 ELSE 0 END AS g FROM b),
d AS (SELECT *, sum(g) OVER (PARTITION BY contig1, contig2, dir, x ORDER BY rgt, fusion_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y FROM c)"""


@register("fp_cluster", f"{CLUSTER} SELECT fusion_id, contig1 || ':' || contig2 || ':' || dir || ':' || x || ':' || y AS cluster FROM d")
def _(t: Tables) -> DataFrame:
    return U.clusters(t.v_fusions).select("fusion_id", "cluster")


@register("fp_report_rows", f"{CLUSTER} SELECT contig1 || ':' || contig2 || ':' || dir || ':' || x || ':' || y AS cluster, count(*) AS n, CAST(sum(n_reads) AS BIGINT) AS reads, max(n_pairs) AS most_pairs FROM d GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return U.clusters(t.v_fusions).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("n_reads").alias("reads"), F.max("n_pairs").alias("most_pairs"))
