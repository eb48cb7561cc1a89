"""Variant operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splicelake.catalog import register
from splicelake.operators import intervals as I
from splicelake.operators import variants as V
from splicelake.views import Tables

ENDS = "least(least(qpos, read_len - 1 - qpos), 25)"
SUMS = ", ".join(
    f"CAST(sum(CASE WHEN {test} THEN {x} ELSE 0 END) AS BIGINT) AS {name}_{side}, CAST(sum(CASE WHEN {test} THEN {x} * {x} ELSE 0 END) AS BIGINT) AS {name}2_{side}"
    for name, x in (("bq", "base_q"), ("mq", "map_q"), ("end", ENDS))
    for side, test in (("ref", "base = ref"), ("alt", "base <> ref"))
)


@register("var_anno16", f"SELECT contig, pos, sample, count(*) FILTER (base = ref AND NOT reverse) AS ref_fwd, count(*) FILTER (base = ref AND reverse) AS ref_rev, count(*) FILTER (base <> ref AND NOT reverse) AS alt_fwd, count(*) FILTER (base <> ref AND reverse) AS alt_rev, {SUMS} FROM v_pileup WHERE NOT is_del GROUP BY contig, pos, sample")
def _(t: Tables) -> DataFrame:
    return V.anno16(t.v_pileup)


@register("var_alleles", "WITH q AS (SELECT contig, pos, ref, base, sum(base_q) AS q FROM v_pileup WHERE NOT is_del GROUP BY ALL) SELECT contig, pos, ref, ref || coalesce(string_agg(base, '' ORDER BY q DESC, base) FILTER (base <> ref), '') || 'X' AS alleles FROM q GROUP BY contig, pos, ref")
def _(t: Tables) -> DataFrame:
    return V.allele_order(t.v_pileup)


@register(
    "var_vdb",
    """WITH a AS (SELECT contig, pos, sample, qpos, read_len, row_number() OVER () AS k FROM v_pileup WHERE base <> ref AND NOT is_del),
    m AS (SELECT a.contig, a.pos, a.sample, CAST(floor(sum(abs(a.qpos - b.qpos)) / count(*)) AS BIGINT) AS m FROM a JOIN a b ON a.contig = b.contig AND a.pos = b.pos AND a.sample = b.sample AND a.k < b.k GROUP BY ALL),
    n AS (SELECT contig, pos, sample, count(*) AS n, sum(read_len) // count(*) AS z FROM a GROUP BY ALL),
    p AS (SELECT contig, pos, sample, least(n, 5) AS n, m, z, z / 2.9 AS mu, pow(z / 1.9 / (least(n, 5) + 1), 2) AS v FROM m JOIN n USING (contig, pos, sample)),
    q AS (SELECT *, CASE WHEN n = 2 THEN CASE WHEN m = 0 THEN 1 / z ELSE (z - m) * 2.0 / z / z END WHEN n = 3 THEN CASE WHEN m > 2 * mu THEN 0 ELSE sin(m * 3.14 / 2 / mu) / (4 * mu / 3.14) END
      ELSE exp(-(m - mu) * (m - mu) / (CASE WHEN m < mu THEN 2 ELSE 3.125 END) / v) / (1.125 * sqrt(2 * 3.14 * v)) END AS prob FROM p),
    w AS (SELECT contig, pos, sum(prob * n) / sum(n) AS vdb FROM q GROUP BY ALL) SELECT contig, pos, round(coalesce(vdb, 1), 6) AS vdb FROM (SELECT DISTINCT contig, pos FROM v_pileup) LEFT JOIN w USING (contig, pos)""",
)
def _(t: Tables) -> DataFrame:
    return V.distance_bias(t.v_pileup).select("contig", "pos", F.round("vdb", 6).alias("vdb"))


@register(
    "var_site_filters",
    """WITH cv AS (SELECT site, count(DISTINCT sample) FILTER (pl0 <> 0 OR pl1 <> 0 OR pl2 <> 0) AS n, string_agg(DISTINCT CAST(sample AS VARCHAR), ',' ORDER BY CAST(sample AS VARCHAR)) FILTER (sample IN (0, 2)) AS samples FROM v_genotypes GROUP BY site)
    SELECT v.site, coalesce(samples, '') AS samples FROM v_variants v JOIN cv USING (site) WHERE alt <> 'X' AND ref <> alt AND n >= 0.5 * (SELECT count(DISTINCT sample) FROM v_genotypes) AND regexp_matches(ref, '^[ACGTacgt]$') AND NOT regexp_matches(alt, '[^,]{2}')
    AND depth >= 5 AND pos + 1 > 500 AND pos < 45000 AND EXISTS (SELECT 1 FROM v_regions r WHERE substr(r.chrom, 2) = right(v.contig, 1) AND iv_begin <= pos AND pos < iv_end)""",
)
def _(t: Tables) -> DataFrame:
    sites = t.v_variants.where("depth >= 5").withColumn("contig", F.right("contig", F.lit(1)))
    regions = I.Side(t.v_regions.select(F.substring("chrom", 2, 9).alias("c"), "iv_begin", "iv_end"), "c", "iv_begin", "iv_end")
    return V.site_filters(sites, t.v_genotypes, covered=0.5, bed=regions, region=(500, 45_000), samples=(0, 2)).select("site", "samples")


@register("var_em_af")
def _(t: Tables) -> DataFrame:
    return V.em_frequency(t.v_genotypes)


@register("var_call")
def _(t: Tables) -> DataFrame:
    return V.site_call(t.v_genotypes).select("site", "p_ref", "qual", "ac")


@register("var_afs")
def _(t: Tables) -> DataFrame:
    post = V.site_call(t.v_genotypes).select(F.posexplode("posterior").alias("k", "p"))
    return post.groupBy("k").agg(F.sum("p").alias("expected"))


AF = "f AS (SELECT site, sum(CASE WHEN pl1 <= pl0 THEN 1.0 ELSE 0 END) / (2.0 * count(*)) * 0.9 + 0.01 AS af FROM v_genotypes GROUP BY site)"


@register(
    "var_genotype",
    f"""WITH {AF}, p AS (SELECT g.*, pow(10.0::DOUBLE, -pl0 / 10) * ((1 - af) * (1 - af)) AS p0, pow(10.0::DOUBLE, -pl1 / 10) * (2 * af * (1 - af)) AS p1, pow(10.0::DOUBLE, -pl2 / 10) * (af * af) AS p2 FROM v_genotypes g JOIN f USING (site))
    SELECT site, sample, CASE WHEN p0 = greatest(p0, p1, p2) THEN 0 WHEN p1 = greatest(p0, p1, p2) THEN 1 ELSE 2 END AS gt FROM p""",
)
def _(t: Tables) -> DataFrame:
    af = t.v_genotypes.groupBy("site").agg((F.sum(F.when(F.col("pl1") <= F.col("pl0"), 1.0).otherwise(0)) / (2.0 * F.count(F.lit(1))) * 0.9 + 0.01).alias("af"))
    return V.genotype(t.v_genotypes, af).select("site", "sample", "gt")


@register("var_anno_max", "SELECT site, max(CASE WHEN pl1 < pl0 THEN least(pl0 - pl1, 99) ELSE 0 END) AS max_gq, max(dp) AS max_dp FROM v_genotypes GROUP BY site")
def _(t: Tables) -> DataFrame:
    gq = F.when(F.col("pl1") < F.col("pl0"), F.least(F.col("pl0") - F.col("pl1"), F.lit(99))).otherwise(0)
    return t.v_genotypes.groupBy("site").agg(F.max(gq).alias("max_gq"), F.max("dp").alias("max_dp"))


GAP = "list_sort([pl0, pl1, pl2])[2] - list_sort([pl0, pl1, pl2])[1]"


@register("var_qcount", f"SELECT {GAP} AS gap, count(*) AS n FROM v_genotypes GROUP BY 1")
def _(t: Tables) -> DataFrame:
    pl = F.array_sort(F.array("pl0", "pl1", "pl2"))
    return t.v_genotypes.groupBy((pl[1] - pl[0]).alias("gap")).agg(F.count(F.lit(1)).alias("n"))


TEN = " || ' ' || ".join(
    f"coalesce([pl0, pl1, pl2, pl0 + 9, pl1 + 7, pl2 + 8][greatest(x{k}, x{j}) * (greatest(x{k}, x{j}) + 1) // 2 + least(x{k}, x{j}) + 1], 0)" for k in range(4) for j in range(k, 4)
)


@register(
    "var_qcall",
    f"""WITH RECURSIVE s AS (SELECT v.site, contig, pos, ref, alt, depth, mq, sample, pl0, pl1, pl2, row_number() OVER (PARTITION BY v.site ORDER BY sample) - 1 AS i, count(*) OVER (PARTITION BY v.site) AS n FROM v_variants v JOIN v_genotypes g ON g.site = v.site
      WHERE length(ref) = 1 AND length(alt) = 1 AND depth > 0),
    z AS (SELECT *, {', '.join(f"CASE WHEN ref = '{b}' THEN 0 WHEN alt = '{b}' THEN 1 ELSE 2 END AS x{k}" for k, b in enumerate("ACGT"))} FROM s),
    r AS (SELECT site, i, greatest(1, CAST(floor(depth / n + 0.499) AS BIGINT)) AS d, depth - greatest(1, CAST(floor(depth / n + 0.499) AS BIGINT)) AS rest FROM s WHERE i = 0
      UNION ALL SELECT s.site, s.i, greatest(1, CAST(floor(rest / (n - s.i) + 0.499) AS BIGINT)), rest - greatest(1, CAST(floor(rest / (n - s.i) + 0.499) AS BIGINT)) FROM r JOIN s ON s.site = r.site AND s.i = r.i + 1)
    SELECT contig, pos, ref, sample, d AS depth, mq, {TEN} AS likelihoods FROM z JOIN r USING (site, i)""",
)
def _(t: Tables) -> DataFrame:
    """Sites of one other base, with X as their third allele."""
    pls = F.array("pl0", "pl1", "pl2", F.col("pl0") + 9, F.col("pl1") + 7, F.col("pl2") + 8)
    samples = t.v_genotypes.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("sample", pls.alias("pls")))).alias("samples"))
    sites = t.v_variants.withColumn("alts", F.array("alt", F.lit("X"))).join(samples, "site")
    return V.ten_genotypes(sites).withColumn("likelihoods", F.array_join(F.transform("likelihoods", lambda x: x.cast("string")), " "))


@register("var_gl2pl", "SELECT site, sample, CAST(least(255, pl0 * 10) AS BIGINT) - least(pl0 * 10, pl1 * 10, pl2 * 10, 255) AS a, CAST(least(255, pl1 * 10) AS BIGINT) - least(pl0 * 10, pl1 * 10, pl2 * 10, 255) AS b FROM v_genotypes")
def _(t: Tables) -> DataFrame:
    gl = F.array(*[-F.col(f"pl{k}") * 1.0 for k in range(3)])  # log10 likelihoods
    pl = F.transform(gl, lambda x: F.least(F.lit(255), F.floor(-10 * x + 0.499)).cast("long"))
    scaled = F.transform(pl, lambda x: x - F.array_min(pl))
    return t.v_genotypes.select("site", "sample", scaled[0].alias("a"), scaled[1].alias("b"))


@register("var_fix_gt", "SELECT site, sample, 'GT:PL:DP' AS format, CASE WHEN pl0 <= pl1 THEN '0/0' ELSE '0/1' END || ':' || pl0 || ',' || pl1 || ',' || pl2 || ':' || dp AS value FROM v_genotypes")
def _(t: Tables) -> DataFrame:
    gt = F.when(F.col("pl0") <= F.col("pl1"), "0/0").otherwise("0/1")
    old = [("PL", F.concat_ws(",", "pl0", "pl1", "pl2")), ("DP", F.col("dp").cast("string")), ("GT", gt)]
    fields = F.array(*[F.struct(F.lit(n).alias("n"), v.alias("v")) for n, v in old])
    front = F.concat(F.filter(fields, lambda x: x["n"] == "GT"), F.filter(fields, lambda x: x["n"] != "GT"))
    return t.v_genotypes.withColumn("_f", front).select("site", "sample", F.array_join("_f.n", ":").alias("format"), F.array_join("_f.v", ":").alias("value"))


@register("var_fix_pl", "SELECT site, sample, pl0 || ',' || pl2 || ',' || pl1 AS pl FROM v_genotypes")
def _(t: Tables) -> DataFrame:
    return t.v_genotypes.select("site", "sample", F.concat_ws(",", "pl0", "pl2", "pl1").alias("pl"))


BETTER = "i.qual > v.qual OR (i.qual = v.qual AND (i.pos < v.pos OR (i.pos = v.pos AND i.site < v.site)))"


@register(
    "var_filter_vcf",
    f"""SELECT site, CASE WHEN depth < 3 THEN 'd' WHEN depth > 45 THEN 'D' WHEN mq < 10 THEN 'Q' WHEN EXISTS (SELECT 1 FROM v_variants i WHERE i.contig = v.contig AND i.site <> v.site AND length(i.ref) <> length(i.alt) AND abs(i.pos - v.pos) <= 300
      AND (length(v.ref) = length(v.alt) OR {BETTER})) THEN CASE WHEN length(ref) = length(alt) THEN 'W' ELSE 'G' END ELSE 'PASS' END AS filter FROM v_variants v""",
)
def _(t: Tables) -> DataFrame:
    return V.filtered(t.v_variants, window=300).select("site", "filter")


@register("var_filter_pileup", "SELECT site, n_near FROM (SELECT *, count(*) OVER (PARTITION BY contig ORDER BY pos RANGE BETWEEN 5000 PRECEDING AND 5000 FOLLOWING) AS n_near FROM v_variants WHERE length(ref) = length(alt)) WHERE n_near > 2")
def _(t: Tables) -> DataFrame:
    return V.dense(t.v_variants, window=5000, most=2).select("site", "n_near")


@register("var_qstats", "SELECT qual, CAST(sum(count(*)) OVER d AS BIGINT) AS n, CAST(sum(count(*) FILTER (ref || alt IN ('AG', 'GA', 'CT', 'TC'))) OVER d AS BIGINT) AS ts, CAST(sum(count(*) FILTER (known)) OVER d AS BIGINT) AS known FROM v_variants WHERE length(ref) = length(alt) GROUP BY qual WINDOW d AS (ORDER BY qual DESC)")
def _(t: Tables) -> DataFrame:
    per = t.v_variants.where(~V.is_indel()).groupBy("qual").agg(F.count(F.lit(1)).alias("n"), F.count_if(V.is_transition()).alias("ts"), F.count_if("known").alias("known"))
    down = Window.orderBy(F.desc("qual"))  # one row a quality
    return per.select("qual", *(F.sum(c).over(down).alias(c) for c in ("n", "ts", "known")))


@register("var_gapstats", "SELECT length(alt) - length(ref) AS gap, count(*) AS n, (length(alt) - length(ref)) % 3 = 0 AS in_frame FROM v_variants WHERE length(ref) <> length(alt) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    gap = (F.length("alt") - F.length("ref")).cast("long")
    return t.v_variants.where(V.is_indel()).groupBy(gap.alias("gap")).agg(F.count(F.lit(1)).alias("n")).withColumn("in_frame", F.col("gap") % 3 == 0)


@register("var_ldstats", "SELECT contig, count(*) FILTER (gap < 5000) AS strong, count(*) AS n, CAST(sum(gap) FILTER (gap < 5000) AS BIGINT) AS length FROM (SELECT contig, pos - lag(pos) OVER (PARTITION BY contig ORDER BY pos, site) AS gap FROM v_variants) WHERE gap IS NOT NULL GROUP BY contig")
def _(t: Tables) -> DataFrame:
    rows = I.beside(t.v_variants.select("contig", "pos", "site"), "contig", "pos", F.struct("pos", "site"), "before", before=True)
    rows = rows.select("contig", (F.col("pos") - F.col("before.pos")).alias("gap")).where("gap is not null")
    return rows.groupBy("contig").agg(F.count_if(F.col("gap") < 5000).alias("strong"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("gap") < 5000, F.col("gap"))).alias("length"))


@register("var_fillac", "SELECT site, CAST(sum(CASE WHEN pl0 <= pl1 AND pl0 <= pl2 THEN 0 WHEN pl1 <= pl2 THEN 1 ELSE 2 END) AS BIGINT) AS ac, 2 * count(*) AS an FROM v_genotypes GROUP BY site")
def _(t: Tables) -> DataFrame:
    text = F.when((F.col("pl0") <= F.col("pl1")) & (F.col("pl0") <= F.col("pl2")), "0/0").when(F.col("pl1") <= F.col("pl2"), "0/1").otherwise("1/1")
    alleles = t.v_genotypes.select("site", F.explode(F.split(text, "/")).alias("a"))
    return alleles.groupBy("site").agg(F.sum(F.col("a").cast("long")).alias("ac"), F.count(F.lit(1)).alias("an"))


@register("var_subsam", "SELECT site, sample, dp FROM v_genotypes WHERE sample IN (1, 3)")
def _(t: Tables) -> DataFrame:
    return t.v_genotypes.where(F.col("sample").isin(1, 3)).select("site", "sample", "dp")


@register("var_listsam", "SELECT DISTINCT sample FROM v_genotypes")
def _(t: Tables) -> DataFrame:
    return t.v_genotypes.select("sample").distinct()


@register("var_cat", "SELECT site, pos FROM v_variants WHERE contig < 'Brand#3' UNION ALL SELECT site, pos FROM v_variants WHERE contig >= 'Brand#3'")
def _(t: Tables) -> DataFrame:
    return t.v_variants.where("contig < 'Brand#3'").select("site", "pos").unionByName(t.v_variants.where("contig >= 'Brand#3'").select("site", "pos"))


TRIO = "SELECT site, max(pl0) FILTER (sample = {0}) AS a0, max(pl1) FILTER (sample = {0}) AS a1, max(pl2) FILTER (sample = {0}) AS a2 FROM v_genotypes GROUP BY site"


@register(
    "var_pair",
    """WITH w AS (SELECT site, max(pl0) FILTER (sample = 0) AS a0, max(pl1) FILTER (sample = 0) AS a1, max(pl2) FILTER (sample = 0) AS a2, max(pl0) FILTER (sample = 1) AS b0, max(pl1) FILTER (sample = 1) AS b1, max(pl2) FILTER (sample = 1) AS b2 FROM v_genotypes GROUP BY site)
    SELECT site, least(a0 + b0, a1 + b1, a2 + b2) - (least(a0, a1, a2) + least(b0, b1, b2)) AS ratio FROM w WHERE a0 IS NOT NULL AND b0 IS NOT NULL""",
)
def _(t: Tables) -> DataFrame:
    one = lambda k, n: t.v_genotypes.where(F.col("sample") == k).select("site", *(F.col(f"pl{i}").alias(f"{n}{i}") for i in range(3)))
    both = one(0, "a").join(one(1, "b"), "site")
    same = F.least(*[F.col(f"a{i}") + F.col(f"b{i}") for i in range(3)])
    return both.select("site", (same - F.least("a0", "a1", "a2") - F.least("b0", "b1", "b2")).alias("ratio"))


@register("var_group_contrast")
def _(t: Tables) -> DataFrame:
    groups = t.v_genotypes.select("sample", (F.col("sample") % 2 + 1).alias("group")).distinct()
    return V.group_contrast(t.v_genotypes, groups)


#: Genotypes of father, mother and child that inheritance allows.
ALLOWED = [(a, b, c) for a in range(3) for b in range(3) for c in range(3) if any(x + y == c for x in {a // 2, (a + 1) // 2} for y in {b // 2, (b + 1) // 2})]


@register(
    "var_trio",
    "WITH " + ", ".join(f"{n} AS (SELECT site, pl0 AS {n}0, pl1 AS {n}1, pl2 AS {n}2 FROM v_genotypes WHERE sample = {k})" for k, n in enumerate("abc"))
    + f" SELECT site, least({', '.join(f'a{x} + b{y} + c{z}' for x, y, z in ALLOWED)}) - (least(a0, a1, a2) + least(b0, b1, b2) + least(c0, c1, c2)) AS ratio FROM a JOIN b USING (site) JOIN c USING (site)",
)
def _(t: Tables) -> DataFrame:
    one = lambda k, n: t.v_genotypes.where(F.col("sample") == k).select("site", *(F.col(f"pl{i}").alias(f"{n}{i}") for i in range(3)))
    rows = one(0, "a").join(one(1, "b"), "site").join(one(2, "c"), "site")
    bound = F.least(*[F.col(f"a{x}") + F.col(f"b{y}") + F.col(f"c{z}") for x, y, z in ALLOWED])
    free = sum((F.least(*[f"{n}{i}" for i in range(3)]) for n in "bc"), F.least("a0", "a1", "a2"))
    return rows.select("site", (bound - free).alias("ratio"))


@register("var_from_ucsc", "SELECT contig || chr(9) || (pos + 1) || chr(9) || 'rs' || site || chr(9) || ref || chr(9) || alt AS line FROM v_variants")
def _(t: Tables) -> DataFrame:
    return t.v_variants.select(F.concat_ws("\t", "contig", (F.col("pos") + 1).cast("string"), F.concat(F.lit("rs"), F.col("site").cast("string")), "ref", "alt").alias("line"))


@register("var_from_hapmap", "SELECT v.contig, v.pos, v.ref, v.alt, g.sample FROM v_variants v JOIN v_genotypes g USING (site) WHERE v.known")
def _(t: Tables) -> DataFrame:
    return t.v_genotypes.join(t.v_variants.where("known"), "site").select("contig", "pos", "ref", "alt", "sample")


@register("var_from_pileup", "WITH c AS (SELECT contig, pos, ref, base, count(*) AS n FROM v_pileup WHERE NOT is_del AND base <> ref GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY contig, pos ORDER BY n DESC, base) AS k FROM c) SELECT contig, pos + 1 AS pos, ref, base AS alt, n FROM b WHERE k = 1")
def _(t: Tables) -> DataFrame:
    per = t.v_pileup.where("not is_del and base != ref").groupBy("contig", "pos", "ref", "base").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("contig", "pos").orderBy(F.desc("n"), "base")
    return per.withColumn("k", F.row_number().over(w)).where("k = 1").select("contig", (F.col("pos") + 1).alias("pos"), "ref", F.col("base").alias("alt"), "n")


@register("var_consensus_fq", "SELECT contig, pos // 1000 AS tile, string_agg(CASE WHEN depth < 10 OR mq < 10 THEN lower(alt) ELSE alt END, '' ORDER BY pos, site) AS seq FROM v_variants GROUP BY contig, pos // 1000")
def _(t: Tables) -> DataFrame:
    letter = F.when((F.col("depth") < 10) | (F.col("mq") < 10), F.lower("alt")).otherwise(F.col("alt"))
    rows = t.v_variants.select("contig", F.floor(F.col("pos") / 1000).alias("tile"), F.struct("pos", "site", letter.alias("l")).alias("x"))
    return rows.groupBy("contig", "tile").agg(F.array_join(F.array_sort(F.collect_list("x"))["l"], "").alias("seq"))


@register(
    "var_gl",
    """WITH k AS (SELECT *, base_q * pow(0.83::DOUBLE, row_number() OVER (PARTITION BY contig, pos, sample, base, reverse ORDER BY base_q DESC, read_no, ord, map_q, qpos) - 1) AS q FROM v_pileup WHERE NOT is_del),
    s AS (SELECT contig, pos, sample, sum(CASE WHEN base <> ref THEN q ELSE 0 END) AS a, count(*) * 3.0103::DOUBLE AS b, sum(CASE WHEN base = ref THEN q ELSE 0 END) AS c FROM k GROUP BY contig, pos, sample)
    SELECT contig, pos, sample, CAST(least(255, floor(a - least(a, b, c) + 0.5)) AS BIGINT) AS pl0, CAST(least(255, floor(b - least(a, b, c) + 0.5)) AS BIGINT) AS pl1, CAST(least(255, floor(c - least(a, b, c) + 0.5)) AS BIGINT) AS pl2 FROM s""",
)
def _(t: Tables) -> DataFrame:
    return V.likelihoods(t.v_pileup)


@register("var_pv4")
def _(t: Tables) -> DataFrame:
    return V.bias_p_values(V.anno16(t.v_pileup))


@register(
    "var_permute",
    """WITH s AS (SELECT unnest(range(0, 20)) AS seed), g AS (SELECT site, seed, CASE WHEN substr(md5(seed || ':' || sample), 1, 1) < '8' THEN 1 ELSE 0 END AS grp, pl0 FROM v_genotypes, s),
    d AS (SELECT site, seed, abs(coalesce(avg(pl0) FILTER (grp = 1), 0) - coalesce(avg(pl0) FILTER (grp = 0), 0)) AS d FROM g GROUP BY site, seed)
    SELECT a.site, count(*) FILTER (b.d >= a.d - 1e-9) AS n_as_great FROM d a JOIN d b ON a.site = b.site AND a.seed = 0 GROUP BY a.site""",
)
def _(t: Tables) -> DataFrame:
    spread = t.v_genotypes.select("site", "sample", "pl0", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("seed"))
    one = F.substring(F.md5(F.concat(F.col("seed").cast("string"), F.lit(":"), F.col("sample").cast("string"))), 1, 1) < "8"
    mean = lambda test: F.coalesce(F.avg(F.when(test, F.col("pl0"))), F.lit(0.0))
    d = spread.groupBy("site", "seed").agg(F.abs(mean(one) - mean(~one)).alias("d"))
    seen = d.where("seed = 0").select("site", F.col("d").alias("seen"))
    return d.join(seen, "site").groupBy("site").agg(F.count_if(F.col("d") >= F.col("seen") - 1e-9).alias("n_as_great"))
