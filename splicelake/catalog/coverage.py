"""Coverage, depth and pileup operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splicelake.catalog import register
from splicelake.catalog.alignments import OPS, sam
from splicelake.functions import cigar
from splicelake.operators import coverage as C
from splicelake.operators import hits as H
from splicelake.operators import intervals as I
from splicelake.views import Tables

BLOCKS = "SELECT contig, lft AS s, lft + m1 AS e FROM v_hits UNION ALL SELECT contig, lft + m1 + intron, lft + m1 + intron + m2 FROM v_hits WHERE intron > 0"
EVENTS = f"ev AS (SELECT contig, spot, CAST(sum(d) AS BIGINT) AS delta FROM (SELECT contig, s AS spot, 1 AS d FROM ({BLOCKS}) UNION ALL SELECT contig, e, -1 FROM ({BLOCKS})) GROUP BY contig, spot HAVING sum(d) <> 0)"
DEPTH = f"{EVENTS}, dp AS (SELECT contig, spot, CAST(sum(delta) OVER (PARTITION BY contig ORDER BY spot) AS BIGINT) AS depth FROM ev)"
RUNS = f"""{DEPTH}, ch AS (SELECT *, lag(depth) OVER (PARTITION BY contig ORDER BY spot) AS b FROM dp), rn AS (SELECT contig, spot AS s, lead(spot) OVER (PARTITION BY contig ORDER BY spot) AS e, depth FROM ch WHERE b IS NULL OR b <> depth),
ru AS (SELECT * FROM rn WHERE depth > 0 AND e IS NOT NULL)"""
ISLANDS = f"""{RUNS}, im AS (SELECT *, CASE WHEN s > lag(e) OVER (PARTITION BY contig ORDER BY s) THEN 1 ELSE 0 END AS f FROM ru), ig AS (SELECT *, sum(f) OVER (PARTITION BY contig ORDER BY s) AS g FROM im),
il AS (SELECT contig, min(s) AS s, max(e) AS e FROM ig GROUP BY contig, g)"""


def blocks(t: Tables) -> DataFrame:
    h = t.v_hits
    first = h.select("contig", F.col("lft").alias("start"), (F.col("lft") + F.col("m1")).alias("end"))
    second = h.where("intron > 0").select("contig", F.expr("lft + m1 + intron").alias("start"), F.expr("lft + m1 + intron + m2").alias("end"))
    return first.unionByName(second)


def depth(t: Tables) -> DataFrame:
    return C.depths(C.events(blocks(t)))


@register("cov_events", f"WITH {EVENTS} SELECT contig, spot, delta FROM ev")
def _(t: Tables) -> DataFrame:
    return C.events(blocks(t))


@register("cov_prefix", f"WITH {DEPTH} SELECT contig, spot, least(depth, 127) AS depth FROM dp")
def _(t: Tables) -> DataFrame:
    return C.depths(C.events(blocks(t)), cap=127)


@register("cov_update", f"WITH {EVENTS} SELECT contig, CAST(sum(abs(delta)) AS BIGINT) AS change FROM ev GROUP BY contig")
def _(t: Tables) -> DataFrame:
    return C.events(blocks(t)).groupBy("contig").agg(F.sum(F.abs("delta")).alias("change"))


@register("cov_lookup", f"WITH {RUNS} SELECT h.insert_id, h.ord, coalesce(depth, 0) AS depth FROM v_hits h LEFT JOIN ru ON ru.contig = h.contig AND s <= lft - 3 AND lft - 3 < e")
def _(t: Tables) -> DataFrame:
    points = t.v_hits.select("insert_id", "ord", "contig", (F.col("lft") - 3).alias("spot"))
    return C.lookup(points, "spot", C.runs(depth(t))).select("insert_id", "ord", "depth")


@register("cov_stats", f"WITH {ISLANDS} SELECT contig, count(*) AS islands, CAST(sum(e - s) AS BIGINT) AS covered FROM il GROUP BY contig")
def _(t: Tables) -> DataFrame:
    return C.islands(C.runs(depth(t))).groupBy("contig").agg(F.count(F.lit(1)).alias("islands"), F.sum(F.col("end") - F.col("start")).alias("covered"))


@register("disc_islands", f"WITH {ISLANDS} SELECT contig, s, e FROM il WHERE e - s >= 20")
def _(t: Tables) -> DataFrame:
    return C.islands(C.runs(depth(t))).where("end - start >= 20").select("contig", F.col("start").alias("s"), F.col("end").alias("e"))


GRAPH = f"WITH {RUNS} SELECT contig, p AS s, least(p + 40, e) AS e, depth FROM (SELECT *, unnest(generate_series(s, e - 1, 40)) AS p FROM ru)"


@register("cov_bedgraph", GRAPH)
def _(t: Tables) -> DataFrame:
    return C.bedgraph(C.runs(depth(t)), longest=40).select("contig", F.col("start").alias("s"), F.col("end").alias("e"), "depth")


@register("snk_bedgraph", f"SELECT contig || chr(9) || s || chr(9) || e || chr(9) || depth AS line FROM ({GRAPH})")
def _(t: Tables) -> DataFrame:
    return C.bedgraph(C.runs(depth(t)), longest=40).select(F.concat_ws("\t", "contig", F.col("start").cast("string"), F.col("end").cast("string"), F.col("depth").cast("string")).alias("line"))


@register(
    "disc_look_windows",
    f"""WITH {ISLANDS}, lw AS (SELECT contig, greatest(s - 45, 0) AS a, s + 5 AS b FROM il UNION ALL SELECT contig, greatest(e - 5, 0), e + 45 FROM il),
    lm AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY contig ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM lw),
    lg AS (SELECT *, sum(f) OVER (PARTITION BY contig ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM lm) SELECT contig, min(a) AS a, max(b) AS b FROM lg GROUP BY contig, g""",
)
def _(t: Tables) -> DataFrame:
    il = C.islands(C.runs(depth(t)))
    ends = F.array(F.struct(F.greatest(F.col("start") - 45, F.lit(0)).alias("a"), (F.col("start") + 5).alias("b")), F.struct(F.greatest(F.col("end") - 5, F.lit(0)).alias("a"), (F.col("end") + 45).alias("b")))
    return I.merged(il.select("contig", F.inline(ends)), "contig", "a", "b").drop("n")


@register("depth_simple", "SELECT contig, pos, count(*) AS depth FROM v_pileup GROUP BY contig, pos")
def _(t: Tables) -> DataFrame:
    return t.v_pileup.groupBy("contig", "pos").agg(F.count(F.lit(1)).alias("depth"))


@register("depth_multi", "SELECT contig, pos, count(*) FILTER (sample = 's0') AS s0, count(*) FILTER (sample = 's1') AS s1 FROM v_pileup WHERE base_q >= 13 AND map_q >= 20 AND NOT is_del GROUP BY contig, pos")
def _(t: Tables) -> DataFrame:
    pivoted = t.v_pileup.where(C.usable(13, 20)).groupBy("contig", "pos").pivot("sample", ["s0", "s1"]).agg(F.count(F.lit(1)))
    return pivoted.fillna(0, ["s0", "s1"])


@register(
    "depth_fragment",
    """WITH h AS (SELECT *, lft + m1 + intron + CASE WHEN intron > 0 THEN m2 ELSE 0 END AS rgt FROM v_hits), k AS (SELECT *, row_number() OVER (PARTITION BY insert_id, mate ORDER BY ord) AS k FROM h),
    f AS (SELECT contig, insert_id, min(lft) AS s, max(rgt) AS e FROM k WHERE k = 1 GROUP BY contig, insert_id)
    SELECT contig, spot, CAST(sum(d) AS BIGINT) AS delta FROM (SELECT contig, s AS spot, 1 AS d FROM f UNION ALL SELECT contig, e, -1 FROM f) GROUP BY contig, spot HAVING sum(d) <> 0""",
)
def _(t: Tables) -> DataFrame:
    first = H.first_hit(H.with_right(t.v_hits), ["insert_id", "mate"], ["ord"])
    return C.events(first.groupBy("contig", "insert_id").agg(F.min("lft").alias("start"), F.max("rgt").alias("end")))


@register(
    "pileup",
    f"WITH {OPS} SELECT insert_id, ord, rname, CAST(p AS BIGINT) AS spot, op = 'D' AS is_del FROM (SELECT *, unnest(generate_series(CAST(st AS BIGINT), CAST(st + len - 1 AS BIGINT))) AS p FROM w JOIN v_sam USING (insert_id, ord, rname, pos) WHERE op IN ('M', 'D') AND flag & 1796 = 0 AND mapq >= 10)",
)
def _(t: Tables) -> DataFrame:
    rows = sam(t).where((F.col("flag").bitwiseAND(1796) == 0) & (F.col("mapq") >= 10))
    step = rows.select("insert_id", "ord", "rname", F.inline(F.filter(cigar.walk(F.col("pos"), F.col("ops")), lambda x: x["op"].isin("M", "D"))))
    return step.select("insert_id", "ord", "rname", F.explode(F.sequence("start", F.col("end") - 1)).alias("spot"), (F.col("op") == "D").alias("is_del"))


@register(
    "pileup_text",
    """WITH k AS (SELECT *, row_number() OVER (PARTITION BY sample, contig, pos ORDER BY read_no, ord, base_q, base, map_q, qpos) AS k FROM v_pileup), m AS (SELECT contig, pos, ref, read_no, ord,
      CASE WHEN qpos = 0 THEN '^' || chr(CAST(least(map_q + 33, 126) AS INTEGER)) ELSE '' END || CASE WHEN is_del THEN '*' WHEN base = ref THEN CASE WHEN reverse THEN ',' ELSE '.' END WHEN reverse THEN lower(base) ELSE base END
      || CASE WHEN indel > 0 THEN '+' || indel WHEN indel < 0 THEN CAST(indel AS VARCHAR) ELSE '' END || CASE WHEN qpos = read_len - 1 THEN '$' ELSE '' END AS s, chr(CAST(least(base_q + 33, 126) AS INTEGER)) AS q FROM k WHERE k <= 50)
    SELECT contig, pos, ref, CAST(count(*) AS INTEGER) AS depth, string_agg(s, '' ORDER BY read_no, ord, s, q) AS bases, string_agg(q, '' ORDER BY read_no, ord, s, q) AS quals FROM m GROUP BY contig, pos, ref""",
)
def _(t: Tables) -> DataFrame:
    return C.pileup_text(C.capped(t.v_pileup, 50, tie=["read_no", "ord", "base_q", "base", "map_q", "qpos"]))


@register("pileup_samples", "SELECT contig, pos, 'lib' || substr(sample, 2) AS lib, count(*) AS depth FROM v_pileup GROUP BY contig, pos, sample")
def _(t: Tables) -> DataFrame:
    names = t.v_pileup.select("sample").distinct().withColumn("lib", F.concat(F.lit("lib"), F.substring("sample", 2, 9)))
    return t.v_pileup.join(names, "sample").groupBy("contig", "pos", "lib").agg(F.count(F.lit(1)).alias("depth"))


CONSENSUS = """WITH c AS (SELECT contig, pos, base, sum(base_q) AS q, count(*) AS n FROM v_pileup WHERE NOT is_del GROUP BY contig, pos, base),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contig, pos ORDER BY q DESC, base) AS k, sum(n) OVER (PARTITION BY contig, pos) AS depth FROM c) WHERE k = 1)"""


def consensus(t: Tables) -> DataFrame:
    per = t.v_pileup.where("not is_del").groupBy("contig", "pos", "base").agg(F.sum("base_q").alias("q"), F.count(F.lit(1)).alias("n"))
    best = per.groupBy("contig", "pos").agg(F.max_by("base", F.struct("q", F.translate("base", "ACGT", "DCBA"))).alias("base"), F.max("q").alias("q"), F.sum("n").alias("depth"))
    return best


@register("cns_call", f"{CONSENSUS} SELECT contig, pos, base, CAST(q AS BIGINT) AS q, CAST(depth AS BIGINT) AS depth FROM b")
def _(t: Tables) -> DataFrame:
    return consensus(t)


@register(
    "pileup_consensus",
    f"""{CONSENSUS}, g AS (SELECT contig, unnest(generate_series(min(pos), max(pos))) AS pos FROM b GROUP BY contig)
    SELECT g.contig, g.pos // 64 AS tile, string_agg(CASE WHEN base IS NULL THEN 'n' WHEN depth >= 5 THEN base ELSE lower(base) END, '' ORDER BY g.pos) AS seq FROM g LEFT JOIN b ON g.contig = b.contig AND g.pos = b.pos GROUP BY g.contig, g.pos // 64""",
)
def _(t: Tables) -> DataFrame:
    called = consensus(t)
    every = called.groupBy("contig").agg(F.min("pos").alias("a"), F.max("pos").alias("b")).select("contig", F.explode(F.sequence("a", "b")).alias("pos"))
    letter = F.when(F.col("base").isNull(), "n").when(F.col("depth") >= 5, F.col("base")).otherwise(F.lower("base"))
    rows = every.join(called, ["contig", "pos"], "left").select("contig", F.floor(F.col("pos") / 64).alias("tile"), F.struct("pos", letter.alias("l")).alias("_x"))
    return rows.groupBy("contig", "tile").agg(F.array_join(F.array_sort(F.collect_list("_x"))["l"], "").alias("seq"))
