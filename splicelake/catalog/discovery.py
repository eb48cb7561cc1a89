"""Discovery operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.catalog import register
from splicelake.catalog.sequences import kmers, spread_reads
from splicelake.functions.sequence import hamming, revcomp
from splicelake.operators import discovery as D
from splicelake.operators import islands as N
from splicelake.operators import junctions as J
from splicelake.operators import samtables as S
from splicelake.operators import sequences as Q
from splicelake.views import Tables

#: Segments of 25 bases: an order's rows are hits of its first segments.
SEGS = "sg AS (SELECT insert_id AS read_id, (ord - 1) % 3 + 1 AS seg, 'c' || (lft % 2) AS contig, antisense_splice AS reverse, lft // 4 AS l, lft // 4 + 25 AS r, edit_dist AS e FROM v_hits)"
STEP = f"{SEGS}, st AS (SELECT a.*, b.contig AS bc, b.reverse AS br, b.l AS bl, b.r AS brr, b.e AS be FROM sg a JOIN sg b ON a.read_id = b.read_id AND b.seg = a.seg + 1)"
GAPS = f"{STEP}, sm AS (SELECT * FROM st WHERE contig = bc AND reverse = br), gp AS (SELECT *, bl - r AS gap FROM sm WHERE bl - r >= 50 AND bl - r < 500000 AND (read_id, seg) NOT IN (SELECT (read_id, seg) FROM sm WHERE bl = r))"


def segments(t: Tables) -> DataFrame:
    return t.v_hits.select(
        F.col("insert_id").alias("read_id"), ((F.col("ord") - 1) % 3 + 1).alias("seg"), F.concat(F.lit("c"), (F.col("lft") % 2).cast("string")).alias("contig"), F.col("antisense_splice").alias("reverse"),
        F.floor(F.col("lft") / 4).alias("left"), (F.floor(F.col("lft") / 4) + 25).alias("right"), "edit_dist",
    )


@register("disc_seg_gaps", f"WITH {GAPS} SELECT read_id, seg, contig, r AS gap_start, bl AS gap_end FROM gp")
def _(t: Tables) -> DataFrame:
    return D.segment_gaps(segments(t), most=500_000).select("read_id", "seg", "contig", F.col("right").alias("gap_start"), F.col("b_left").alias("gap_end"))


TOP = f"WITH {GAPS} SELECT contig, r - 1 AS l, bl AS r, bl - r AS skip FROM gp GROUP BY ALL ORDER BY skip, contig, l, r LIMIT 10000000"


@register("disc_seg_juncs", TOP)
def _(t: Tables) -> DataFrame:
    rows = D.segment_gaps(segments(t), most=500_000).select("contig", (F.col("right") - 1).alias("left"), F.col("b_left").alias("right"), F.col("gap").alias("skip")).distinct()
    return D.top_junctions(rows, 10_000_000).select("contig", F.col("left").alias("l"), F.col("right").alias("r"), "skip")


GENOME = "gn AS (SELECT contig, seq FROM v_genome)"
SITES = f"""{GENOME}, ps AS (SELECT contig, seq, unnest(range(1, length(seq))) AS i FROM gn WHERE length(seq) > 1), dn AS (SELECT contig, i - 1 AS place FROM ps WHERE substr(seq, CAST(i AS INTEGER), 2) = 'GT'),
ac AS (SELECT contig, i - 1 AS place FROM ps WHERE substr(seq, CAST(i AS INTEGER), 2) = 'AG')"""
#: Introns that the coverage search tries, in bases; the reference's defaults.
LEAST, MOST = 50, 20_000
PAIRED = f"{SITES}, sp AS (SELECT dn.contig, dn.place AS donor, ac.place + 2 AS acceptor FROM dn JOIN ac ON dn.contig = ac.contig AND ac.place + 2 - dn.place >= {LEAST} AND ac.place + 2 - dn.place < {MOST})"
FLANKED = f"""{PAIRED}, fl AS (SELECT sp.*, substr(seq, CAST(donor - 4 AS INTEGER), 5) || substr(seq, CAST(acceptor + 1 AS INTEGER), 5) AS flank FROM sp JOIN gn USING (contig) WHERE donor >= 5 AND acceptor + 5 <= length(seq)),
km AS (SELECT DISTINCT unnest(list_transform(range(1, length(seq) - 8), lambda i: substr(seq, i, 10))) AS kmer FROM v_reads WHERE length(seq) >= 10)"""


@register("disc_motif_sites", f"WITH {SITES} SELECT contig, place, 'donor' AS kind FROM dn UNION ALL SELECT contig, place, 'acceptor' FROM ac")
def _(t: Tables) -> DataFrame:
    g = t.v_genome
    named = lambda m, k: D.sites(g, m).select("contig", F.col("at").alias("place"), F.lit(k).alias("kind"))
    return named("GT", "donor").unionByName(named("AG", "acceptor"))


def site_pairs(t: Tables) -> DataFrame:
    return D.site_pairs(D.sites(t.v_genome, "GT"), D.sites(t.v_genome, "AG"), least=LEAST, most=MOST)


@register("disc_all_pairs", f"WITH {PAIRED} SELECT contig, donor, acceptor FROM sp")
def _(t: Tables) -> DataFrame:
    return site_pairs(t).select("contig", "donor", "acceptor")


SPANNED = f"WITH {FLANKED} SELECT contig, donor, acceptor FROM fl WHERE flank IN (SELECT kmer FROM km)"


#: The coverage search takes so many junctions at most, those of least skip; the reference's limit.
MOST_ISLAND = 5_000_000
#: Exon bases beside donors and acceptors of both strands, what reads have beside their places, and the junctions that both agree on.
ISLANDS = f"""{GENOME}, mp AS (SELECT contig, seq, i - 1 AS i, substr(seq, CAST(i AS INTEGER), 2) AS m FROM (SELECT contig, seq, unnest(range(1, length(seq))) AS i FROM gn WHERE length(seq) > 1)),
dn AS (SELECT DISTINCT contig, m = 'CT' AS antisense, i AS donor, substr(seq, CAST(greatest(i - 19, 0) + 1 AS INTEGER), CAST(least(i, 19) AS INTEGER)) AS up FROM mp WHERE m IN ('GT', 'CT') AND i >= 5),
ac AS (SELECT DISTINCT contig, m = 'AC' AS antisense, i + 2 AS acceptor, substr(seq, CAST(i + 3 AS INTEGER), 19) AS down FROM mp WHERE m IN ('AG', 'AC') AND i + 7 <= length(seq)),
rs AS (SELECT DISTINCT seq FROM v_reads WHERE length(seq) >= 17 UNION SELECT reverse(translate(seq, 'ACGT', 'TGCA')) FROM v_reads WHERE length(seq) >= 17),
rp AS (SELECT seq, length(seq) AS len, CAST(unnest(range(5, length(seq) - 4)) AS INTEGER) AS i FROM rs),
lx AS (SELECT DISTINCT substr(seq, greatest(i - 19, 0) + 1, least(i, 19)) AS far, substr(seq, i + 1, 5) AS near FROM rp WHERE i >= 12), rx AS (SELECT DISTINCT substr(seq, i + 1, 19) AS far, substr(seq, i - 4, 5) AS near FROM rp WHERE len - i >= 12),
dk AS (SELECT contig, antisense, donor, right(up, CAST(n AS INTEGER)) AS far FROM (SELECT *, unnest(range(12, length(up) + 1)) AS n FROM dn)), ak AS (SELECT contig, antisense, acceptor, left(down, CAST(n AS INTEGER)) AS far FROM (SELECT *, unnest(range(12, length(down) + 1)) AS n FROM ac)),
dm AS (SELECT DISTINCT contig, antisense, donor, near FROM dk JOIN lx USING (far)), am AS (SELECT DISTINCT contig, antisense, acceptor, near FROM ak JOIN rx USING (far)),
ip AS (SELECT contig, antisense, donor, acceptor FROM dm JOIN ac USING (contig, antisense) WHERE near = left(down, 5) AND acceptor - donor >= {LEAST} AND acceptor - donor < {MOST}
  UNION SELECT contig, antisense, donor, acceptor FROM am JOIN dn USING (contig, antisense) WHERE near = right(up, 5) AND acceptor - donor >= {LEAST} AND acceptor - donor < {MOST}),
ra AS (SELECT *, row_number() OVER (PARTITION BY contig, antisense ORDER BY acceptor) AS k FROM ac), rd AS (SELECT dn.contig, dn.antisense, donor, min(k) AS k0 FROM dn JOIN ra ON ra.contig = dn.contig AND ra.antisense = dn.antisense AND acceptor - donor >= {LEAST} GROUP BY ALL)"""


@register("disc_island_pairs", f"WITH {ISLANDS} SELECT contig, donor, acceptor, antisense, CAST(k - k0 AS BIGINT) AS skip FROM ip JOIN ra USING (contig, antisense, acceptor) JOIN rd USING (contig, antisense, donor) ORDER BY skip, contig, donor, acceptor LIMIT {MOST_ISLAND}")
def _(t: Tables) -> DataFrame:
    found = N.island_pairs(t.v_genome, spread_reads(t), least=LEAST, most=MOST).withColumnsRenamed({"donor": "left", "acceptor": "right"})
    return D.top_junctions(found, MOST_ISLAND).select("contig", F.col("left").alias("donor"), F.col("right").alias("acceptor"), "antisense", "skip")


@register("disc_butterfly", SPANNED)
def _(t: Tables) -> DataFrame:
    return D.butterfly(D.sites(t.v_genome, "GT"), D.sites(t.v_genome, "AG"), t.v_genome, kmers(t), least=LEAST, most=MOST)


@register("disc_union", f"WITH {FLANKED}, u AS (SELECT contig, donor - 1 AS l, acceptor AS r FROM fl WHERE flank IN (SELECT kmer FROM km)) SELECT contig, l, r FROM u UNION SELECT contig, lft + m1 - 1, lft + m1 + intron FROM v_dense_hits")
def _(t: Tables) -> DataFrame:
    parts = D.sites(t.v_genome, "GT"), D.sites(t.v_genome, "AG"), t.v_genome, kmers(t)
    spanned = D.butterfly(*parts, least=LEAST, most=MOST)
    juncs = J.extract(t.v_dense_hits).select("contig", (F.col("left") + 1).alias("donor"), F.col("right").alias("acceptor"))
    found = spanned.unionByName(D.not_spanned(juncs, *parts, least=LEAST, most=MOST))
    return found.select("contig", (F.col("donor") - 1).alias("l"), F.col("acceptor").alias("r"))


@register("disc_strategy", "SELECT mate, CASE WHEN max(length(seq)) // 25 >= 3 THEN 'segments' ELSE 'segments+coverage' END AS search FROM v_reads GROUP BY mate")
def _(t: Tables) -> DataFrame:
    n = F.floor(F.max(F.length("seq")) / 25)
    return t.v_reads.groupBy("mate").agg(F.when(n >= 3, "segments").otherwise("segments+coverage").alias("search"))


WINDOWS = "rw AS (SELECT read_id, substr(seq, 1, 12) AS q, substr(seq, 20, 14) AS l, substr(seq, 40, 14) AS r FROM v_reads WHERE length(seq) >= 60)"


@register(
    "disc_motif_split",
    f"""WITH {WINDOWS}, s AS (SELECT *, unnest(range(1, 12)) AS i FROM rw), m AS (SELECT read_id, i, hamming(substr(q, 1, CAST(i AS INTEGER)), substr(l, 1, CAST(i AS INTEGER))) + hamming(substr(q, CAST(i + 1 AS INTEGER)), substr(r, CAST(i + 3 AS INTEGER))) AS errors,
      substr(l, CAST(i + 1 AS INTEGER), 2) || substr(r, CAST(i + 1 AS INTEGER), 2) AS motif FROM s) SELECT read_id, CAST(i AS INTEGER) AS split, CAST(errors AS INTEGER) AS errors FROM m WHERE errors <= 9 AND motif IN ('GTAG', 'GCAG', 'ATAC')""",
)
def _(t: Tables) -> DataFrame:
    rows = t.v_reads.where(F.length("seq") >= 60).select("read_id", F.substring("seq", 1, 12).alias("q"), F.substring("seq", 20, 14).alias("l"), F.substring("seq", 40, 14).alias("r"))
    found = rows.select("read_id", F.inline(D.splits(F.col("q"), F.col("l"), F.col("r"), most=9)))
    return found.select("read_id", F.col("at").alias("split"), F.col("mismatches").alias("errors"))


CAND = f"""{STEP}, fr AS (SELECT CASE WHEN reverse THEN l ELSE r - 1 END AS p1, CASE WHEN br THEN brr - 1 ELSE bl END AS p2, contig AS c1, bc AS c2, CASE WHEN reverse THEN 'r' ELSE 'f' END || CASE WHEN br THEN 'r' ELSE 'f' END AS dir, e + be AS e
  FROM st WHERE contig <> bc OR reverse <> br OR abs(bl - r) >= 3000), sw AS (SELECT *, c1 > c2 OR (c1 = c2 AND p1 > p2) AS s FROM fr),
cf AS (SELECT CASE WHEN s THEN c2 ELSE c1 END AS contig1, CASE WHEN s THEN c1 ELSE c2 END AS contig2, CASE WHEN s THEN p2 ELSE p1 END AS lft, CASE WHEN s THEN p1 ELSE p2 END AS rgt,
  CASE WHEN s AND dir = 'ff' THEN 'rr' WHEN s AND dir = 'rr' THEN 'ff' ELSE dir END AS dir, e FROM sw), fc AS (SELECT contig1, contig2, lft, rgt, dir, count(*) AS n, min(e) AS edit_dist FROM cf GROUP BY contig1, contig2, lft, rgt, dir)"""


@register("disc_fusion", f"WITH {CAND} SELECT * FROM fc")
def _(t: Tables) -> DataFrame:
    return D.fusion_candidates(segments(t), least=3000)


#: Ends of the junctions of segments, and for each fusion how many of its places are one.
JUNC_ENDS = f"{GAPS.removeprefix(STEP + ', ')}, jc AS (SELECT contig AS jcontig, r - 1 AS place FROM gp UNION SELECT contig, bl FROM gp), fe AS (SELECT fc.*, CAST(a.place IS NOT NULL AS INTEGER) + CAST(b.place IS NOT NULL AS INTEGER) AS ends FROM fc LEFT JOIN jc a ON a.jcontig = contig1 AND a.place = lft LEFT JOIN jc b ON b.jcontig = contig2 AND b.place = rgt)"


@register("disc_fusion_resolve", f"WITH {CAND}, {JUNC_ENDS} SELECT contig1, contig2, lft, rgt, dir, n FROM fe f WHERE NOT EXISTS (SELECT 1 FROM fe o WHERE o.contig1 = f.contig1 AND o.contig2 = f.contig2 AND o.dir = f.dir AND abs(o.lft - f.lft) BETWEEN 1 AND 9 AND abs(o.lft - f.lft) = abs(o.rgt - f.rgt) AND (o.n > f.n OR (o.n = f.n AND (o.ends > f.ends OR (o.ends = f.ends AND o.lft < f.lft)))))")
def _(t: Tables) -> DataFrame:
    juncs = D.segment_gaps(segments(t)).select("contig", (F.col("right") - 1).alias("left"), F.col("b_left").alias("right"))
    return D.resolved(D.fusion_candidates(segments(t), least=3000), juncs).select("contig1", "contig2", "lft", "rgt", "dir", "n")


ENDS = "translate(reverse(substr(bases, 61)), 'ACGT', 'TGCA')"


@register(
    "disc_partner_rescue",
    f"""WITH w AS (SELECT p.contig, k, bases, l3 - 15 AS f, substr(seq, CAST(l3 - 14 AS INTEGER), 70) AS flank FROM v_planted p JOIN v_genome USING (contig) WHERE NOT (k % 3 = 0 AND l3 - l1 - 25 >= 50) AND l3 + 55 - l1 - 25 >= 50 AND l3 >= 15),
    s AS (SELECT *, unnest(range(0, length(flank) - 14)) AS i FROM w WHERE length(flank) >= 15),
    e AS (SELECT contig, k, f, i, false AS reverse, hamming(substr(bases, 61), substr(flank, CAST(i + 1 AS INTEGER), 15)) AS wrong FROM s UNION ALL SELECT contig, k, f, i, true, hamming({ENDS}, substr(flank, CAST(i + 1 AS INTEGER), 15)) FROM s),
    b AS (SELECT contig, k, f, reverse, min(wrong * 1000 + i) AS best FROM e GROUP BY ALL) SELECT contig || ':' || k AS read_id, contig, reverse, CAST(f + best % 1000 AS BIGINT) AS l FROM b WHERE best // 1000 <= 2""",
)
def _(t: Tables) -> DataFrame:
    """Planted reads without hits of their last segment, but for each third, and mates thirty bases behind them."""
    name = F.concat_ws(":", "contig", "k").alias("read_id")
    seg = lambda k, at: t.v_planted.select("k", name, F.lit(k).alias("seg"), "contig", F.lit(False).alias("reverse"), F.col(at).alias("left"), (F.col(at) + 25).alias("right"), F.lit(0).alias("edit_dist"))
    segs = seg(1, "l1").unionByName(seg(3, "l3").where("k % 3 = 0")).drop("k")
    partners = t.v_planted.select(name, "contig", F.lit(True).alias("reverse"), (F.col("l3") + 55).alias("left"), (F.col("l3") + 80).alias("right"))
    found = D.rescued(segs, partners, t.v_planted.select(name, F.col("bases").alias("seq")), Q.tiles(t.v_genome, size=512), size=512, total=3, mean=50, sd=20)
    return found.select("read_id", "contig", "reverse", F.col("left").alias("l"))


RC_Q = "reverse(translate({0}, 'ACGT', 'TGCA'))"
#: In each 500 bases the first GT with an AG 60 to 499 bases on is an intron; reads begin 15 or, on the other strand, end 10 bases before it.
LOST = f"""{SITES}, pd AS (SELECT contig, min(place) AS donor FROM dn GROUP BY contig, place // 500), pl AS (SELECT pd.contig, donor, min(ac.place) + 2 AS acceptor FROM pd JOIN ac ON ac.contig = pd.contig AND ac.place + 2 - donor >= 60 AND ac.place + 2 - donor < 500 GROUP BY ALL),
rd AS (SELECT contig, seq, length(seq) AS len, CASE WHEN donor % 2 = 1 THEN substr(seq, CAST(donor - 9 AS INTEGER), 10) || substr(seq, CAST(acceptor + 1 AS INTEGER), 15) ELSE substr(seq, CAST(donor - 14 AS INTEGER), 15) || substr(seq, CAST(acceptor + 1 AS INTEGER), 10) END AS q,
  donor % 2 = 1 AS reverse, CASE WHEN donor % 2 = 1 THEN donor - 35 ELSE acceptor + 10 END AS l FROM pl JOIN gn USING (contig) WHERE donor >= 25 AND acceptor + 25 <= length(seq)),
wn AS (SELECT *, CASE WHEN reverse THEN l + 17 ELSE greatest(0, least(len - 2, l + 8) - 2000) END AS f, CASE WHEN reverse THEN least(len - 2, l + 2017) ELSE least(len - 2, l + 8) END AS t FROM rd),
wm AS (SELECT contig, q, f, t, sum(CASE WHEN f >= m OR m IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY f, t, q ROWS UNBOUNDED PRECEDING) AS isl FROM (SELECT *, max(t) OVER (PARTITION BY contig ORDER BY f, t, q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM wn WHERE t - f >= 12)),
pool AS (SELECT contig, isl, min(f) AS f, max(t) AS t FROM wm GROUP BY contig, isl), os AS (SELECT contig, isl, replace(q, 'N', 'x') AS s FROM wm UNION SELECT contig, isl, {RC_Q.format("replace(q, 'N', 'x')")} FROM wm),
sd AS (SELECT DISTINCT contig, isl, substr(s, i + 1, 5) AS l5, substr(s, i + 6, 5) AS r5, substr(s, greatest(i - 14, 0) + 1, least(i, 14)) AS lx, substr(s, i + 11, 14) AS rx FROM (SELECT *, CAST(unnest(range(0, 16)) AS INTEGER) AS i FROM os)),
st AS (SELECT p.contig, isl, place, substr(seq, CAST(place + 1 AS INTEGER), 2) AS motif, substr(seq, CAST(greatest(place - 19, 0) + 1 AS INTEGER), CAST(least(place, 19) AS INTEGER)) AS up, substr(seq, CAST(place + 3 AS INTEGER), 19) AS down
  FROM (SELECT *, unnest(range(f, t - 1)) AS place FROM pool) p JOIN gn USING (contig)),
dd AS (SELECT *, right(up, 5) AS l5, left(up, greatest(length(up) - 5, 0)) AS ux FROM st WHERE motif IN ('GT', 'CT') AND length(up) >= 5), aa AS (SELECT *, left(down, 5) AS r5, substr(down, 6) AS dx FROM st WHERE motif IN ('AG', 'AC') AND length(down) >= 5)"""


@register(
    "disc_microexon",
    f"""WITH {LOST} SELECT DISTINCT dd.contig, dd.place - 1 AS l, aa.place + 2 AS r, dd.motif = 'CT' AS antisense FROM dd JOIN sd ON sd.contig = dd.contig AND sd.isl = dd.isl AND sd.l5 = dd.l5
    JOIN aa ON aa.contig = dd.contig AND aa.isl = dd.isl AND aa.r5 = sd.r5 AND (dd.motif = 'GT') = (aa.motif = 'AG') AND aa.place - dd.place >= 50 AND aa.place - dd.place < 2000
    WHERE (length(lx) >= 7 AND suffix(ux, lx)) OR (length(rx) >= 7 AND prefix(dx, rx))""",
)
def _(t: Tables) -> DataFrame:
    """Reads planted over an intron of each 500 bases, whose first segment, which holds the junction, is not mapped."""
    g = t.v_genome
    donors = D.sites(g, "GT").groupBy("contig", F.floor(F.col("at") / 500)).agg(F.min("at").alias("at")).select("contig", "at")
    introns = D.site_pairs(donors, D.sites(g, "AG"), least=60, most=500).groupBy("contig", "donor").agg(F.min("acceptor").alias("acceptor"))
    back = F.col("donor") % 2 == 1
    planted = D.with_flanks(introns, g, 25).select(F.concat_ws(":", "contig", "donor").alias("read_id"), "contig", back.alias("reverse"), F.when(back, F.col("donor") - 35).otherwise(F.col("acceptor") + 10).alias("left"), F.when(back, revcomp(F.substring("flank", 16, 25))).otherwise(F.substring("flank", 11, 25)).alias("seq"))
    segs = planted.select("read_id", F.lit(2).alias("seg"), "contig", "reverse", "left", (F.col("left") + 25).alias("right"))
    return D.microexons(segs, planted.select("read_id", "seq"), g, total=2).select("contig", F.col("left").alias("l"), F.col("right").alias("r"), "antisense")


MATES = "SELECT a.insert_id, a.contig AS c1, b.contig AS c2, a.lft + a.m1 AS e1, b.lft AS s2, a.antisense_aln AS r1, b.antisense_aln AS r2 FROM v_hits a JOIN v_hits b ON a.insert_id = b.insert_id AND a.mate = 1 AND b.mate = 2"


def mates(t: Tables) -> DataFrame:
    one = lambda m, **c: t.v_hits.where(F.col("mate") == m).select("insert_id", *(F.expr(e).alias(n) for n, e in c.items()))
    return one(1, c1="contig", e1="lft + m1", r1="antisense_aln").join(one(2, c2="contig", s2="lft", r2="antisense_aln"), "insert_id")


@register("disc_fusion_closure", f"SELECT DISTINCT c1, c2, e1 + unnest(range(-4, 5)) AS lft, s2 AS rgt FROM ({MATES}) WHERE c1 <> c2")
def _(t: Tables) -> DataFrame:
    ends = mates(t).where("c1 != c2").select("c1", "c2", F.col("e1").alias("at"), F.col("s2").alias("rgt"))
    return D.around(ends, ["c1", "c2", "rgt"], "at", 4, "lft").select("c1", "c2", "lft", "rgt")


@register("disc_closure_best", f"SELECT insert_id, min(s2 - e1) AS inner_dist FROM ({MATES}) WHERE c1 = c2 AND s2 >= e1 GROUP BY insert_id")
def _(t: Tables) -> DataFrame:
    return mates(t).where("c1 = c2 and s2 >= e1").groupBy("insert_id").agg(F.min(F.col("s2") - F.col("e1")).alias("inner_dist"))


#: Mean and deviation of the distance of mates in closed pairs, and what the distance of a chain may be off.
MEAN, SD, WIDE = 200, 20, 55
CLOSE = """m AS (SELECT 'p' || (a.insert_id % 50) AS contig, a.insert_id AS pair_id, a.lft % 3000 AS s1, a.lft % 3000 + a.m1 AS e1, b.lft % 3000 AS s2, b.lft % 3000 + b.m1 AS e2 FROM v_hits a JOIN v_hits b ON a.insert_id = b.insert_id AND a.mate = 1 AND b.mate = 2),
q AS (SELECT pair_id, contig, CASE WHEN s1 < s2 THEN e1 ELSE e2 END AS st, CASE WHEN s1 < s2 THEN s2 ELSE s1 END AS en FROM m),
p AS (SELECT * FROM (SELECT * FROM q WHERE en > st QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY en - st, st) = 1) WHERE en - st BETWEEN 50 AND 5000 AND abs(en - st - 200) > 20),
mt AS (SELECT contig, i AS place, substr(seq, CAST(i + 1 AS INTEGER), 2) AS motif FROM (SELECT contig, seq, unnest(range(length(seq) - 1)) AS i FROM v_genome WHERE contig IN (SELECT contig FROM p))),
dn AS (SELECT contig, place FROM mt WHERE motif = 'GT'), ac AS (SELECT contig, place + 2 AS place FROM mt WHERE motif = 'AG')"""


def hop_sql(k: int, states: str, least: int) -> str:
    return f"""d{k} AS (SELECT s.*, dn.place AS donor, used + dn.place - s.pl AS u2 FROM {states} s JOIN dn ON dn.contig = s.contig AND dn.place >= s.pl + {least} AND dn.place <= s.pl + {MEAN + WIDE} - used AND dn.place + 50 <= en + 5),
    h{k} AS (SELECT d.*, ac.place AS nx, abs(u2 + en - ac.place - {MEAN}) <= {WIDE} AS done FROM d{k} d JOIN ac ON ac.contig = d.contig AND ac.place >= donor + 50 AND ac.place <= donor + 5000 AND ac.place <= en + 5)"""


CLOSED = f"""WITH {CLOSE}, s0 AS (SELECT *, st AS pl, 0 AS used FROM p), {hop_sql(1, "s0", -5)}, s1 AS (SELECT DISTINCT pair_id, contig, st, en, nx AS pl, u2 AS used FROM h1 WHERE u2 + 100 <= {MEAN + WIDE}),
{hop_sql(2, "s1", 100)}, s2 AS (SELECT DISTINCT pair_id, contig, st, en, nx AS pl, u2 AS used FROM h2 WHERE u2 + 100 <= {MEAN + WIDE}), {hop_sql(3, "s2", 100)},
k3 AS (SELECT * FROM h3 WHERE done), k2 AS (SELECT * FROM h2 WHERE done OR (pair_id, nx, u2) IN (SELECT (pair_id, pl, used) FROM k3)), k1 AS (SELECT * FROM h1 WHERE done OR (pair_id, nx, u2) IN (SELECT (pair_id, pl, used) FROM k2))
SELECT pair_id, contig, donor - 1 AS l, nx AS r FROM k1 UNION SELECT pair_id, contig, donor - 1, nx FROM k2 UNION SELECT pair_id, contig, donor - 1, nx FROM k3"""


@register("disc_closure", CLOSED)
def _(t: Tables) -> DataFrame:
    """The closest mates of each insert, closed over the motifs of the contig."""
    hit = lambda n: t.v_hits.where(F.col("mate") == n).select("insert_id", (F.col("lft") % 3000).alias(f"s{n}"), (F.col("lft") % 3000 + F.col("m1")).alias(f"e{n}"))
    both = hit(1).join(hit(2), "insert_id")
    ends = both.select("insert_id", F.when(F.col("s1") < F.col("s2"), F.col("e1")).otherwise(F.col("e2")).alias("start"), F.greatest("s1", "s2").alias("end")).where("start < end")
    near = ends.groupBy("insert_id").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("inner"), "start", "end")).alias("x"))
    pairs = near.select(F.col("insert_id").alias("pair_id"), F.concat(F.lit("p"), (F.col("insert_id") % 50).cast("string")).alias("contig"), "x.start", "x.end")
    motifs = D.sites(t.v_genome, "GT").withColumn("donor", F.lit(True)).unionByName(D.sites(t.v_genome, "AG").withColumn("donor", F.lit(False)))
    return D.closures(pairs, motifs, mean=MEAN, sd=SD).select("pair_id", "contig", F.col("left").alias("l"), F.col("right").alias("r"))


@register(
    "disc_closure_motifs",
    """WITH m AS (SELECT 'p' || (a.insert_id % 50) AS contig, a.lft % 3000 AS s1, a.lft % 3000 + a.m1 AS e1, b.lft % 3000 AS s2, b.lft % 3000 + b.m1 AS e2 FROM v_hits a JOIN v_hits b ON a.insert_id = b.insert_id AND a.mate = 1 AND b.mate = 2),
    far AS (SELECT * FROM m WHERE CASE WHEN s1 < s2 THEN s2 - e1 ELSE s1 - e2 END > 90), w AS (SELECT contig, s1 - 10 AS f, e1 + 10 AS t FROM far UNION SELECT contig, s2 - 10, e2 + 10 FROM far),
    g AS (SELECT contig, i AS place, substr(seq, i + 1, 2) AS motif FROM (SELECT contig, seq, unnest(range(length(seq) - 2)) AS i FROM v_genome WHERE contig IN (SELECT contig FROM w)))
    SELECT contig, place, CASE WHEN motif IN ('GT', 'AG') THEN '+' ELSE '-' END AS strand, motif FROM g WHERE motif IN ('GT', 'AG', 'CT', 'AC') AND EXISTS (SELECT 1 FROM w WHERE w.contig = g.contig AND f <= place AND place < t)""",
)
def _(t: Tables) -> DataFrame:
    hit = lambda n: t.v_hits.where(F.col("mate") == n).select("insert_id", (F.col("lft") % 3000).alias(f"start{n}"), (F.col("lft") % 3000 + F.col("m1")).alias(f"end{n}"), F.col("antisense_aln").alias(f"reverse{n}"))
    pairs = hit(1).join(hit(2), "insert_id").withColumn("contig", F.concat(F.lit("p"), (F.col("insert_id") % 50).cast("string")))
    return D.closure_motifs(pairs, t.v_genome, mean=50, sd=20).select("contig", F.col("at").alias("place"), "strand", "motif")


@register(
    "seg_join",
    f"""WITH {SEGS} SELECT a.read_id, a.contig, a.reverse, a.l AS start, c.r AS stop, a.e + b.e + c.e AS errors FROM sg a JOIN sg b ON a.read_id = b.read_id AND a.contig = b.contig AND a.reverse = b.reverse AND a.seg = 1 AND b.seg = 2
    JOIN sg c ON c.read_id = b.read_id AND c.contig = b.contig AND c.reverse = b.reverse AND c.seg = 3 WHERE b.l - a.r BETWEEN -3 AND 4000 AND c.l - b.r BETWEEN -3 AND 4000""",
)
def _(t: Tables) -> DataFrame:
    return D.joined(segments(t), 3, most=4000).select("read_id", "contig", "reverse", "start", F.col("end").alias("stop"), "errors")


def pieces(rows: DataFrame, size: int) -> DataFrame:
    """``kmer``: the sequences (``seq``) cut into ``size`` bases; a shorter rest is left out."""
    return rows.select(F.explode(F.regexp_extract_all("seq", F.lit(f"(?s).{{{size}}}"), F.lit(0))).alias("kmer"))


@register("kmer_map")
def _(t: Tables) -> DataFrame:
    """All segments of twenty bases of reads, and of contigs with one base changed."""
    changed = F.concat(F.substring("kmer", 1, 9), F.lit("A"), F.substring("kmer", 11, 10)).alias("kmer")
    return D.kmer_map(pieces(spread_reads(t), 20).union(pieces(t.v_genome, 20).select(changed)), t.v_genome)


@register("fp_kmer_map")
def _(t: Tables) -> DataFrame:
    """The 23 bases on either side of each planted breakpoint, with up to three mismatches; of those with over 100 places none."""
    at = F.col("d") + 26
    flanks = t.v_planted.select(F.explode(F.array(F.substr("bases", at - 23, F.lit(23)), F.substr("bases", at, F.lit(23)))).alias("kmer"))
    return D.kmer_map(flanks, t.v_genome, size=23, mismatches=3, exact=4).groupBy("kmer").agg(F.count(F.lit(1)).alias("places"), F.min("errors").alias("errors"))


@register(
    "lift_tx_genome",
    """WITH o AS (SELECT *, coalesce(sum(ex_end - ex_start) OVER (PARTITION BY tx_id ORDER BY ex_start, ex_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM v_exons),
    h AS (SELECT DISTINCT tx_id, 50 AS t_start, 400 AS t_end FROM v_exons) SELECT tx_id, contig, CAST(ex_start + greatest(t_start, o) - o AS BIGINT) AS b_start, CAST(ex_start + least(t_end, o + ex_end - ex_start) - o AS BIGINT) AS b_end
    FROM h JOIN o USING (tx_id) WHERE greatest(t_start, o) < least(t_end, o + ex_end - ex_start)""",
)
def _(t: Tables) -> DataFrame:
    hits = t.v_exons.select("tx_id").distinct().withColumn("t_start", F.lit(50)).withColumn("t_end", F.lit(400))
    return D.lifted(hits, t.v_exons).select("tx_id", "contig", F.col("start").alias("b_start"), F.col("end").alias("b_end"))


FLANK = "SELECT contig, k, substr(seq, CAST(k * 37 % 300 + 1 AS INTEGER), 20) || substr(seq, CAST(k * 37 % 300 + 120 AS INTEGER), 20) AS joined FROM (SELECT *, CAST(substr(contig, 2) AS BIGINT) AS k FROM v_genome)"


@register("junc_seq_db", FLANK)
def _(t: Tables) -> DataFrame:
    k = F.substring("contig", 2, 9).cast("long")
    juncs = t.v_genome.select("contig", k.alias("k"), (k * 37 % 300).alias("a"), (k * 37 % 300 + 20).alias("b"), (k * 37 % 300 + 119).alias("c"), (k * 37 % 300 + 139).alias("d"))
    tiled = Q.tiles(t.v_genome, size=64)
    left = Q.fetch(juncs, tiled, "contig", "a", "b", size=64, out="l")
    return Q.fetch(left, tiled, "contig", "c", "d", size=64, out="r").select("contig", "k", F.concat("l", "r").alias("joined"))


#: Whole reads, each at a place of one of all contigs.
ON_GENOME = """gl AS (SELECT contig, seq AS g, length(seq) AS len FROM v_genome), og AS (SELECT r.*, substr(g, CAST((read_id // 1000000 * 7919 + read_id % 1000000 * 131) % (len - length(seq) + 1) + 1 AS INTEGER), length(seq)) AS ref
  FROM v_reads r JOIN gl ON gl.contig = 'p' || ((read_id // 1000000 + read_id % 1000000) % (SELECT count(DISTINCT contig) FROM gl)) WHERE len >= length(seq) AND length(seq) > 0)"""


def on_genome(t: Tables) -> DataFrame:
    """Whole reads with ``ref``, the bases of a place of one of all contigs."""
    genome = t.v_genome.where("seq is not null").withColumn("_name", F.concat_ws(":", "contig", F.xxhash64("seq")))
    doc, k = F.floor(F.col("read_id") / 1_000_000), F.col("read_id") % 1_000_000
    number = genome.agg(F.count_distinct("contig").alias("_n"))
    reads = spread_reads(t).where("length(seq) > 0").crossJoin(F.broadcast(number)).withColumn("contig", F.concat(F.lit("p"), ((doc + k) % F.col("_n")).cast("string")))
    met = reads.join(genome.select("contig", "_name", F.length("seq").alias("_len")), "contig").where(F.col("_len") >= F.length("seq"))
    hits = met.withColumn("_a", (doc * 7919 + k * 131) % (F.col("_len") - F.length("seq") + 1)).withColumn("_b", F.col("_a") + F.length("seq"))
    tiled = Q.tiles(genome.select(F.col("_name").alias("contig"), "seq").distinct(), size=512)
    return Q.fetch(hits, tiled, "_name", "_a", "_b", size=512, out="ref").select("read_id", "seq", "qual", "ref")


@register("hit_nm", f"WITH {ON_GENOME} SELECT read_id, CAST(hamming(seq, ref) AS INTEGER) AS nm FROM og")
def _(t: Tables) -> DataFrame:
    return on_genome(t).select("read_id", hamming(F.col("seq"), F.col("ref")).alias("nm"))


def against_genome(t: Tables) -> DataFrame:
    hits = t.v_reads.where(F.length("seq") >= 20).select("read_id", F.substring("seq", 1, 20).alias("q"), F.substring("qual", 1, 20).alias("quals"), F.concat(F.lit("p"), (F.col("read_id") % 50).cast("string")).alias("contig"), (F.col("read_id") % 500).alias("a"), (F.col("read_id") % 500 + 20).alias("b"))
    long_enough = t.v_genome.where(F.length("seq") >= 520)
    return Q.fetch(hits, Q.tiles(long_enough, size=512), "contig", "a", "b", size=512, out="ref").where(F.length("ref") == 20)


CAP = """WITH h AS (SELECT read_id, substr(r.seq, 1, 20) AS q, substr(qual, 1, 20) AS quals, substr(g.seq, CAST(1 + read_id % 500 AS INTEGER), 20) AS ref FROM v_reads r JOIN v_genome g ON g.contig = 'p' || (read_id % 50) WHERE length(r.seq) >= 20 AND length(g.seq) >= 520),
b AS (SELECT read_id, CASE WHEN (i + read_id) % 7 = 0 THEN substr(q, i, 1) ELSE substr(ref, i, 1) END AS base, substr(ref, i, 1) AS r, ascii(substr(quals, i, 1)) - 33 AS ql FROM (SELECT *, CAST(unnest(range(1, 21)) AS INTEGER) AS i FROM h)),
n AS (SELECT read_id, 20 + count(*) FILTER (base <> 'N' AND r <> 'N' AND ql >= 13) AS n, count(*) FILTER (base <> r AND base <> 'N' AND r <> 'N' AND ql >= 13) AS mm, coalesce(sum(least(ql, 33)) FILTER (base <> r AND base <> 'N' AND r <> 'N' AND ql >= 13), 0) AS qs FROM b GROUP BY read_id),
t AS (SELECT read_id, qs - 4.343 * coalesce(list_sum(list_transform(range(1, mm + 1), lambda i: ln(n) - ln(i))), 0) + (read_id % 40) / 5.0 AS t FROM n)
SELECT read_id, CASE WHEN t > 40 THEN -1 ELSE CAST(floor(sqrt((40 - greatest(t, 0)) / 40) * 40 + 0.499) AS INTEGER) END AS cap FROM t"""


@register("sam_capmapq", CAP)
def _(t: Tables) -> DataFrame:
    """Each read against bases of the genome that were given to it, but for every seventh, which it keeps."""
    own = F.zip_with(F.split("q", ""), F.split("ref", ""), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    bases = F.array_join(F.transform(own, lambda x, i: F.when((i + 1 + F.col("read_id")) % 7 == 0, x["a"]).otherwise(x["b"])), "")
    return S.capped_mapq(against_genome(t).withColumns({"bases": bases, "clipped": F.col("read_id") % 40})).select("read_id", "cap")


@register(
    "sam_calmd",
    f"""WITH {ON_GENOME}, e AS (SELECT *, array_to_string(list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN substr(seq, i, 1) = substr(ref, i, 1) AND substr(ref, i, 1) <> 'N' THEN '=' ELSE substr(seq, i, 1) END), '') AS own,
      array_to_string(list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN substr(seq, i, 1) = substr(ref, i, 1) AND substr(ref, i, 1) <> 'N' THEN '=' ELSE substr(ref, i, 1) END), '') AS other FROM og),
    n AS (SELECT *, CAST(length(replace(own, '=', '')) AS INTEGER) AS nm FROM e)
    SELECT read_id, nm, array_to_string(list_transform(regexp_extract_all(other, '=*[^=]'), lambda x: (length(x) - 1) || right(x, 1)), '') || (length(other) - length(rtrim(other, '='))) AS md,
      CASE WHEN nm >= 80 THEN replace(own, '=', 'N') ELSE own END AS shown,
      CASE WHEN nm >= 80 THEN array_to_string(list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN substr(own, i, 1) = '=' THEN '!' ELSE substr(qual, i, 1) END), '') ELSE qual END AS shown_quals FROM n""",
)
def _(t: Tables) -> DataFrame:
    return S.calmd(on_genome(t).withColumnsRenamed({"seq": "bases", "qual": "quals"}), equal=True, most=80).select("read_id", "nm", "md", "shown", "shown_quals")
