"""Hit management, best hits and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.catalog import register
from splicelake.operators import hits as H
from splicelake.operators import intervals as I
from splicelake.operators import junctions as J
from splicelake.views import Tables

KEY = ["insert_id", "ord"]
RIGHT = "lft + m1 + intron + CASE WHEN intron > 0 THEN m2 ELSE 0 END AS rgt"
#: All pairs of mates; b: the second one.
PAIRS = f"""h AS (SELECT *, {RIGHT} FROM v_hits),
k AS (SELECT *, row_number() OVER (PARTITION BY insert_id, mate ORDER BY ord) AS k FROM h),
p AS (SELECT a.insert_id, a.ord, b.ord AS b_ord, a.contig, b.contig AS b_contig, a.lft, a.rgt, b.lft AS b_lft, b.rgt AS b_rgt, a.as_score, b.as_score AS b_as_score,
  a.intron, b.intron AS b_intron, a.antisense_aln AS aa, b.antisense_aln AS ba, a.antisense_splice AS asp, b.antisense_splice AS bsp
  FROM k a JOIN k b ON a.insert_id = b.insert_id AND a.mate = 1 AND b.mate = 2 AND a.k <= 41 AND b.k <= 41),
d AS (SELECT *, greatest(rgt, b_rgt) - least(lft, b_lft) AS outer_dist,
  CASE WHEN (lft <= b_lft AND rgt >= b_rgt) OR (b_lft <= lft AND b_rgt >= rgt) THEN 0 WHEN lft < b_lft THEN b_lft - rgt ELSE lft - b_rgt END AS inner_dist FROM p),
g AS (SELECT *, inner_dist > 70 AS too_far, inner_dist < 30 AS too_close, CAST((intron > 0)::INT + (b_intron > 0)::INT AS INTEGER) AS n_spliced, aa <> ba AS opposite,
  CAST(as_score + b_as_score - CASE WHEN inner_dist > 70 THEN CASE WHEN inner_dist - 70 < 20 THEN 3 ELSE 6 END
    WHEN inner_dist < 30 THEN least(3, floor((30 - inner_dist) / 20) + 1) ELSE 0 END - CASE WHEN aa <> ba THEN 0 ELSE 6 END AS BIGINT) AS score FROM d)"""


def hits(t: Tables) -> DataFrame:
    return H.with_right(t.v_hits)


def graded(t: Tables) -> DataFrame:
    return H.graded(H.pairs(hits(t)))


@register(
    "hit_group_multi",
    """WITH b AS (SELECT *, max(as_score) OVER (PARTITION BY insert_id, mate) AS best FROM v_hits),
    g AS (SELECT *, count(*) FILTER (as_score >= -28 AND as_score >= best - 2) OVER (PARTITION BY insert_id, mate) AS n_good FROM b)
    SELECT insert_id, ord, CAST(n_good AS BIGINT) AS n_good, CASE WHEN n_good > 3 THEN 'multi' WHEN best <= -18 THEN 'requeue' ELSE 'keep' END AS fate FROM g""",
)
def _(t: Tables) -> DataFrame:
    return H.group_multi(t.v_hits).select(*KEY, "n_good", "fate")


@register(
    "hit_merge_dedup",
    """WITH u AS (SELECT qname, rname, pos, cigar, flag & 16 > 0 AS reverse, xs FROM v_sam UNION ALL SELECT qname, rname, pos, cigar, flag & 16 > 0, NULL FROM v_sam WHERE mapq % 2 = 0),
    k AS (SELECT *, bool_or(xs IS NOT NULL) OVER (PARTITION BY qname, rname, pos, cigar, reverse) AS known FROM u)
    SELECT DISTINCT qname, rname, pos, cigar, reverse, xs FROM k WHERE xs IS NOT NULL OR NOT known""",
)
def _(t: Tables) -> DataFrame:
    rows = t.v_sam.select("qname", "rname", "pos", "cigar", (F.col("flag").bitwiseAND(16) > 0).alias("reverse"), "xs", "mapq")
    return H.merge_dedup(rows.drop("mapq"), rows.where("mapq % 2 = 0").withColumn("xs", F.lit(None).cast("string")).drop("mapq"))


@register("hit_raw_merge", "SELECT insert_id, ord, contig FROM v_hits UNION ALL SELECT insert_id, ord, contig FROM v_dense_hits")
def _(t: Tables) -> DataFrame:
    return t.v_hits.select(*KEY, "contig").unionByName(t.v_dense_hits.select(*KEY, "contig"))


@register("src_multi", "SELECT insert_id, ord, 'a' AS source FROM v_hits UNION ALL SELECT insert_id, ord, 'b' FROM v_dense_hits")
def _(t: Tables) -> DataFrame:
    return t.v_hits.select(*KEY, F.lit("a").alias("source")).unionByName(t.v_dense_hits.select(*KEY, F.lit("b").alias("source")))


@register("hit_dedup_loc", "SELECT DISTINCT contig, lft, antisense_aln, edit_dist, intron > 0 AS spliced FROM v_dense_hits")
def _(t: Tables) -> DataFrame:
    key = ["contig", "lft", "antisense_aln", "edit_dist", "spliced"]
    return t.v_dense_hits.withColumn("spliced", F.col("intron") > 0).dropDuplicates(key).select(*key)


@register("hit_table_unique", "SELECT DISTINCT insert_id, contig, lft, m1, intron, m2, antisense_aln FROM (SELECT * FROM v_hits UNION ALL SELECT * FROM v_hits WHERE mate = 1)")
def _(t: Tables) -> DataFrame:
    key = ["insert_id", "contig", "lft", "m1", "intron", "m2", "antisense_aln"]
    return t.v_hits.unionByName(t.v_hits.where("mate = 1")).dropDuplicates(key).select(*key)


@register("hit_limits", "SELECT insert_id, ord FROM v_hits WHERE edit_dist <= 2")
def _(t: Tables) -> DataFrame:
    return H.within_limits(t.v_hits).select(*KEY)


@register("best_hits_read", "SELECT insert_id, ord FROM (SELECT *, rank() OVER (PARTITION BY insert_id, mate ORDER BY as_score DESC) AS r FROM v_hits) WHERE r = 1")
def _(t: Tables) -> DataFrame:
    return H.best_of_read(t.v_hits).select(*KEY)


@register("topk_random_ties", "SELECT insert_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY insert_id, mate ORDER BY as_score DESC, contig, lft, ord) AS r FROM v_hits) WHERE r <= 2")
def _(t: Tables) -> DataFrame:
    return H.top_k(t.v_hits, 2, tie=["contig", "lft", "ord"]).select(*KEY)


JUNCS = """j AS (SELECT contig, lft + m1 - 1 AS jl, lft + m1 + intron AS jr, antisense_splice AS minus, CAST(max(m1) AS BIGINT) AS le, CAST(max(m2) AS BIGINT) AS re, count(*) AS n
  FROM v_dense_hits WHERE intron > 0 GROUP BY ALL)"""


@register(
    "hit_rescore",
    f"""WITH {JUNCS} SELECT insert_id, ord, CAST(as_score + CASE WHEN intron = 0 THEN 0 WHEN jl % 10 = 0 THEN 2 ELSE
      -(floor(8 * CASE WHEN n >= 5 THEN least(3 / n + CASE WHEN least(le, re) < least(floor((m1 + m2) / 4), 10) THEN 0.5 ELSE 0 END, 1) ELSE 1 END)
        - CASE WHEN jr % 3 = 0 THEN 6 ELSE 0 END) END AS BIGINT) AS new_score
    FROM v_dense_hits h JOIN j ON j.contig = h.contig AND jl = lft + m1 - 1 AND jr = lft + m1 + intron AND minus = antisense_splice""",
)
def _(t: Tables) -> DataFrame:
    juncs = J.aggregate(J.extract(t.v_dense_hits)).withColumns({"depth": F.lit(3), "gtf": F.col("left") % 10 == 0, "gtf_match": F.col("right") % 3 == 0})
    return H.rescored(t.v_dense_hits, juncs).select(*KEY, F.col("new_score").cast("long"))


@register(
    "hit_drop_bad_juncs",
    f"WITH {JUNCS} SELECT insert_id, ord FROM v_dense_hits h JOIN j ON j.contig = h.contig AND jl = lft + m1 - 1 AND jr = lft + m1 + intron AND minus = antisense_splice WHERE n >= 2 AND least(le, re) >= 8",
)
def _(t: Tables) -> DataFrame:
    juncs = J.aggregate(J.extract(t.v_dense_hits)).withColumn("accepted", (F.col("supporting_hits") >= 2) & (F.least("left_extent", "right_extent") >= 8))
    return H.without_bad_junctions(t.v_dense_hits, juncs).select(*KEY)


@register("pair_distances", f"WITH {PAIRS} SELECT insert_id, ord, b_ord, CAST(outer_dist AS BIGINT) AS outer_dist, CAST(inner_dist AS BIGINT) AS inner_dist FROM d")
def _(t: Tables) -> DataFrame:
    p = H.pairs(hits(t))
    outer, inner = H.distances(*(F.col(c) for c in ("lft", "rgt", "b_lft", "b_rgt")))
    return p.select(*KEY, "b_ord", outer.alias("outer_dist"), inner.alias("inner_dist"))


@register("pair_join", f"WITH {PAIRS} SELECT insert_id, ord, b_ord FROM p")
def _(t: Tables) -> DataFrame:
    return H.pairs(hits(t)).select(*KEY, "b_ord")


@register("pair_grade", f"WITH {PAIRS} SELECT insert_id, ord, b_ord, too_far, too_close, n_spliced, opposite, n_spliced = 2 AND asp = bsp AS consistent, score FROM g")
def _(t: Tables) -> DataFrame:
    return graded(t).select(*KEY, "b_ord", "too_far", "too_close", "n_spliced", "opposite", "consistent", "score")


@register(
    "pair_rescue_junc",
    f"""WITH {PAIRS}, {JUNCS}, r AS (SELECT g.insert_id, g.ord, b_ord, jl - least(rgt, b_rgt) + greatest(lft, b_lft) - jr AS new_dist,
      row_number() OVER (PARTITION BY g.insert_id, g.ord, b_ord ORDER BY jl, jr, minus) AS k
      FROM g JOIN j ON g.contig = b_contig AND j.contig = g.contig AND too_far AND least(rgt, b_rgt) <= jl AND greatest(lft, b_lft) >= jr AND n >= 2
      AND jl - least(rgt, b_rgt) + greatest(lft, b_lft) - jr BETWEEN 30 AND 70)
    SELECT insert_id, ord, b_ord, CAST(new_dist AS BIGINT) AS new_dist FROM r WHERE k = 1""",
)
def _(t: Tables) -> DataFrame:
    juncs = J.aggregate(J.extract(t.v_dense_hits)).where("supporting_hits >= 2")
    return J.rescued_pairs(graded(t), juncs, mean=50, sd=20).select(*KEY, "b_ord", "new_dist")


@register("pair_fusion_flag", f"WITH {PAIRS} SELECT insert_id, ord, b_ord, contig <> b_contig OR aa = ba OR CASE WHEN lft < b_lft THEN b_lft - rgt ELSE lft - b_rgt END NOT BETWEEN 0 AND 5000 AS discordant FROM g")
def _(t: Tables) -> DataFrame:
    p = H.pairs(hits(t))
    return p.select(*KEY, "b_ord", H.is_discordant(p, min_dist=5000).alias("discordant"))


@register("pair_concordant", f"WITH {PAIRS} SELECT insert_id, ord, b_ord, opposite AND contig = b_contig AND inner_dist <= 5000 AS concordant FROM g")
def _(t: Tables) -> DataFrame:
    p = graded(t)
    return p.select(*KEY, "b_ord", H.is_concordant(p, max_intron=5000).alias("concordant"))


BEST = "b AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY insert_id ORDER BY score DESC) AS r FROM g) WHERE r = 1)"


@register("best_pairs", f"WITH {PAIRS}, {BEST} SELECT insert_id, ord, b_ord, score FROM (SELECT *, row_number() OVER (PARTITION BY insert_id ORDER BY ord, b_ord) AS k FROM b) WHERE k <= 2")
def _(t: Tables) -> DataFrame:
    return H.best_pairs(graded(t), 2, tie=["ord", "b_ord"]).select(*KEY, "b_ord", "score")


@register(
    "mixed_report",
    "WITH s AS (SELECT * FROM v_hits WHERE insert_id NOT IN (SELECT a.insert_id FROM v_hits a JOIN v_hits b USING (insert_id) WHERE a.mate = 1 AND b.mate = 2)) SELECT insert_id, ord FROM (SELECT *, rank() OVER (PARTITION BY insert_id, mate ORDER BY as_score DESC) AS r FROM s) WHERE r = 1",
)
def _(t: Tables) -> DataFrame:
    return H.mixed_report(hits(t), H.pairs(hits(t))).select(*KEY)


@register(
    "best_insert_ref",
    f"""WITH {PAIRS}, m AS (SELECT insert_id, contig, max(as_score) FILTER (mate = 1) AS s1, max(as_score) FILTER (mate = 2) AS s2 FROM h GROUP BY insert_id, contig),
    q AS (SELECT insert_id, contig, max(score) AS ps FROM g WHERE contig = b_contig GROUP BY insert_id, contig)
    SELECT insert_id, contig, CASE WHEN ps IS NULL THEN 1 ELSE 2 END AS n_mapped, CAST(coalesce(ps, greatest(s1, s2)) AS BIGINT) AS score FROM m LEFT JOIN q USING (insert_id, contig)""",
)
def _(t: Tables) -> DataFrame:
    paired = graded(t).where("contig = b_contig").groupBy("insert_id", "contig").agg(F.max("score").alias("_p"))
    single = hits(t).groupBy("insert_id", "contig").agg(F.max("as_score").alias("_s"))
    both = single.join(paired, ["insert_id", "contig"], "left")
    return both.select("insert_id", "contig", F.when(F.col("_p").isNull(), 1).otherwise(2).alias("n_mapped"), F.coalesce("_p", "_s").alias("score"))


@register(
    "insert_grade_order",
    f"SELECT insert_id, ord, CAST(row_number() OVER (PARTITION BY insert_id, mate ORDER BY (intron > 0)::INT, floor(intron / 100), edit_dist, ord) AS INTEGER) AS place FROM v_hits",
)
def _(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("insert_id", "mate").orderBy((F.col("intron") > 0).cast("int"), F.floor(F.col("intron") / 100), "edit_dist", "ord")
    return t.v_hits.select(*KEY, F.row_number().over(w).alias("place"))


@register(
    "happy_mates",
    f"""WITH {PAIRS}, y AS (SELECT DISTINCT insert_id, ord, b_ord FROM g WHERE opposite AND contig = b_contig AND inner_dist BETWEEN 0 AND 4000)
    SELECT insert_id, ord, 'happy' AS class FROM y UNION SELECT insert_id, b_ord, 'happy' FROM y UNION ALL
    SELECT insert_id, ord, 'single' FROM v_hits WHERE (insert_id, ord) NOT IN (SELECT (insert_id, ord) FROM y) AND (insert_id, ord) NOT IN (SELECT (insert_id, b_ord) FROM y)""",
)
def _(t: Tables) -> DataFrame:
    happy = graded(t).where("opposite and contig = b_contig and inner_dist between 0 and 4000")
    members = happy.select(*KEY).unionByName(happy.select("insert_id", F.col("b_ord").alias("ord"))).distinct()
    single = t.v_hits.select(*KEY).join(members, KEY, "left_anti")
    return members.withColumn("class", F.lit("happy")).unionByName(single.withColumn("class", F.lit("single")))


@register("inner_dist_list", f"WITH {PAIRS}, {BEST} SELECT insert_id, CAST(inner_dist AS BIGINT) AS inner_dist FROM (SELECT *, row_number() OVER (PARTITION BY insert_id ORDER BY ord, b_ord) AS k FROM b) WHERE k = 1")
def _(t: Tables) -> DataFrame:
    return H.best_pairs(graded(t), 1, tie=["ord", "b_ord"]).select("insert_id", F.col("inner_dist").cast("long"))


@register(
    "library_stats",
    f"""WITH {PAIRS}, {BEST}, o AS (SELECT *, row_number() OVER (PARTITION BY insert_id ORDER BY ord, b_ord) AS k FROM b)
    SELECT count(*) AS aligned, count(*) FILTER (NOT too_far AND NOT too_close AND opposite) AS happy, count(*) FILTER (too_far) AS too_far, count(*) FILTER (too_close) AS too_close,
      count(*) FILTER (NOT opposite) AS same_strand, count(*) FILTER (n_spliced > 0) AS spliced, count(*) FILTER (n_spliced = 0) AS contiguous FROM o WHERE k = 1""",
)
def _(t: Tables) -> DataFrame:
    best = H.best_pairs(graded(t), 1, tie=["ord", "b_ord"])
    return best.agg(
        F.count(F.lit(1)).alias("aligned"), F.count_if(F.expr("not too_far and not too_close and opposite")).alias("happy"), F.count_if("too_far").alias("too_far"), F.count_if("too_close").alias("too_close"),
        F.count_if(~F.col("opposite")).alias("same_strand"), F.count_if(F.col("n_spliced") > 0).alias("spliced"), F.count_if(F.col("n_spliced") == 0).alias("contiguous"),
    )


@register(
    "primary_pick",
    """SELECT insert_id, ord, CAST(row_number() OVER (PARTITION BY insert_id, mate ORDER BY contig, lft, ord) - 1 AS INTEGER) AS hi,
      row_number() OVER (PARTITION BY insert_id, mate ORDER BY as_score DESC, ord) = 1 AS is_primary FROM v_hits""",
)
def _(t: Tables) -> DataFrame:
    return H.primary(t.v_hits, tie=[F.desc("as_score"), "ord"]).select(*KEY, "hi", "is_primary")


READS = "SELECT o_orderkey AS insert_id, CAST(1 AS INTEGER) AS mate FROM orders UNION ALL SELECT o_orderkey, 2 FROM orders"


def reads(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("insert_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("mate"))


@register("unmapped_out", f"SELECT insert_id, mate FROM ({READS}) WHERE (insert_id, mate) NOT IN (SELECT (insert_id, mate) FROM v_hits WHERE edit_dist <= 2)")
def _(t: Tables) -> DataFrame:
    return H.unmapped(reads(t), H.within_limits(t.v_hits))


@register(
    "align_summary",
    f"""WITH {PAIRS}, r AS ({READS}), n AS (SELECT insert_id, mate, count(*) AS n FROM v_hits GROUP BY insert_id, mate), x AS (SELECT r.mate, n.n FROM r LEFT JOIN n USING (insert_id, mate)),
    q AS (SELECT insert_id, bool_and(contig <> b_contig OR aa = ba OR CASE WHEN lft < b_lft THEN b_lft - rgt ELSE lft - b_rgt END NOT BETWEEN 0 AND 5000) AS bad FROM g GROUP BY insert_id)
    SELECT * FROM (SELECT count(*) FILTER (mate = 1) AS input_1, count(*) FILTER (mate = 1 AND n IS NOT NULL) AS mapped_1, count(*) FILTER (mate = 1 AND n > 1) AS multi_1, count(*) FILTER (mate = 1 AND n > 2) AS over_1,
      count(*) FILTER (mate = 2) AS input_2, count(*) FILTER (mate = 2 AND n IS NOT NULL) AS mapped_2, count(*) FILTER (mate = 2 AND n > 1) AS multi_2, count(*) FILTER (mate = 2 AND n > 2) AS over_2,
      round(100.0 * count(n) / count(*), 4)::DOUBLE AS rate FROM x), (SELECT count(*) AS pairs, count(*) FILTER (bad) AS discordant_pairs, round(100.0 * count(*) FILTER (NOT bad) / count(*), 4)::DOUBLE AS concordant_rate FROM q)""",
)
def _(t: Tables) -> DataFrame:
    p = H.pairs(hits(t))
    return H.summary(reads(t), t.v_hits, p.withColumn("discordant", H.is_discordant(p, min_dist=5000)), most=2)


@register("mask_repeats", "SELECT insert_id, ord FROM (SELECT *, " + RIGHT + " FROM v_hits) h WHERE NOT EXISTS (SELECT 1 FROM v_regions r WHERE 'c' || substr(r.chrom, 2) = h.contig AND r.iv_begin <= h.lft AND h.rgt <= r.iv_end)")
def _(t: Tables) -> DataFrame:
    repeats = t.v_regions.select(F.concat(F.lit("c"), F.substring("chrom", 2, 9)).alias("contig"), "iv_begin", "iv_end")
    left = I.Side(hits(t), "contig", "lft", "rgt")
    return I.matched(left, I.Side(repeats, "contig", "iv_begin", "iv_end"), inside=True, how="anti").select(*KEY)


@register(
    "sam_unique",
    """WITH s AS (SELECT *, 100 + as_score - 10 * nm AS score FROM v_sam), k AS (SELECT *, lead(score) OVER o AS second, row_number() OVER o AS k FROM s WINDOW o AS (PARTITION BY qname ORDER BY score DESC, rname, pos, ord))
    SELECT qname, ord, CAST(CASE WHEN second IS NULL OR score <= 0 THEN 250 ELSE least(250, floor(250 * ((score - second) / score) + 0.5)) END AS BIGINT) AS new_mapq FROM k WHERE k = 1""",
)
def _(t: Tables) -> DataFrame:
    return H.unique_mapq(t.v_sam.withColumn("score", 100 + F.col("as_score") - 10 * F.col("nm"))).select("qname", "ord", "new_mapq")


@register(
    "sam_compare",
    """WITH a AS (SELECT insert_id, ord, rname, pos, flag & 16 AS s, mapq >= 10 AS q FROM v_sam WHERE ord <= 4), b AS (SELECT insert_id, ord, rname, pos + mapq * 3 AS pos, flag & 16 AS s, mapq % 20 >= 10 AS q FROM v_sam WHERE ord >= 2)
    SELECT CASE WHEN a.insert_id IS NULL THEN 'only_b' WHEN b.insert_id IS NULL THEN 'only_a' WHEN a.rname = b.rname AND a.s = b.s AND abs(a.pos - b.pos) < 100 THEN 'same' ELSE 'differ' END
      || '/' || CASE WHEN coalesce(a.q, false) THEN 'a' ELSE '' END || CASE WHEN coalesce(b.q, false) THEN 'b' ELSE '' END AS class, count(*) AS n
    FROM a FULL JOIN b ON a.insert_id = b.insert_id AND a.ord = b.ord GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    side = lambda df, x: df.select(*KEY, *(F.col(c).alias(f"{x}_{c}") for c in ("rname", "pos", "s", "q")))
    rows = t.v_sam.withColumn("s", F.col("flag").bitwiseAND(16))
    a = side(rows.where("ord <= 4").withColumn("q", F.col("mapq") >= 10), "a")
    b = side(rows.where("ord >= 2").withColumn("pos", F.col("pos") + F.col("mapq") * 3).withColumn("q", F.col("mapq") % 20 >= 10), "b")
    same = (F.col("a_rname") == F.col("b_rname")) & (F.col("a_s") == F.col("b_s")) & (F.abs(F.col("a_pos") - F.col("b_pos")) < 100)
    kind = F.when(F.col("a_pos").isNull(), "only_b").when(F.col("b_pos").isNull(), "only_a").when(same, "same").otherwise("differ")
    sure = F.concat(F.when(F.col("a_q"), "a").otherwise(""), F.when(F.col("b_q"), "b").otherwise(""))
    return a.join(b, KEY, "full").groupBy(F.concat(kind, F.lit("/"), sure).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "sim_eval",
    """WITH s AS (SELECT mapq, abs(pos - CAST(regexp_extract(qname || '_' || (pos + ord * ord - 4), '_(-?[0-9]+)$', 1) AS BIGINT)) > 5 AS wrong FROM v_sam WHERE flag & 4 = 0)
    SELECT mapq, CAST(sum(count(*)) OVER d AS BIGINT) AS n_at_least, CAST(sum(count(*) FILTER (wrong)) OVER d AS BIGINT) AS wrong_at_least FROM s GROUP BY mapq WINDOW d AS (ORDER BY mapq DESC)""",
)
def _(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    name = F.concat("qname", F.lit("_"), (F.col("pos") + F.col("ord") * F.col("ord") - 4).cast("string"))
    truth = F.regexp_extract(name, r"_(-?\d+)$", 1).cast("long")
    per = t.v_sam.where(F.col("flag").bitwiseAND(4) == 0).groupBy("mapq").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("pos") - truth) > 5).alias("w"))
    down = Window.orderBy(F.desc("mapq"))  # one row a quality
    return per.select("mapq", F.sum("n").over(down).alias("n_at_least"), F.sum("w").over(down).alias("wrong_at_least"))
