"""Operators on variant sites and genotype likelihoods."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import erfc, exp, lgamma, log, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splicelake.operators import intervals as I

#: Rounds of expectation and maximisation at most, and the change of a frequency below which they end.
ROUNDS, CHANGE = 50, 1e-5


def anno16(pile: DataFrame) -> DataFrame:
    """Sixteen sums for each site and sample: reads by strand and allele, then sums and sums of squares of base quality,
    mapping quality and distance from the nearer end (at most 25), for reference and other bases."""
    ref = F.col("base") == F.col("ref")
    end = F.least(F.least("qpos", F.col("read_len") - 1 - F.col("qpos")), F.lit(25))
    over = lambda name, test, x: F.sum(F.when(test, x).otherwise(0)).cast("long").alias(name)
    columns = [F.count_if(ref & ~F.col("reverse")).alias("ref_fwd"), F.count_if(ref & F.col("reverse")).alias("ref_rev"), F.count_if(~ref & ~F.col("reverse")).alias("alt_fwd"), F.count_if(~ref & F.col("reverse")).alias("alt_rev")]
    for name, x in (("bq", F.col("base_q")), ("mq", F.col("map_q")), ("end", end)):
        for side, test in (("ref", ref), ("alt", ~ref)):
            columns += [over(f"{name}_{side}", test, x), over(f"{name}2_{side}", test, x * x)]
    return pile.where("not is_del").groupBy("contig", "pos", "sample").agg(*columns)


def is_indel() -> Column:
    return F.length("ref") != F.length("alt")


def site_filters(sites: DataFrame, likelihoods: DataFrame, *, covered: float = 0.0, bed: I.Side | None = None, region: tuple[int, int] | None = None, samples: Sequence[int] = ()) -> DataFrame:
    """``sites`` (``site``, ``contig``, ``pos``, ``ref``, ``alt``) that calling goes on with, and ``samples``, those of ``samples`` (all if none are given) that
    ``likelihoods`` (``site``, ``sample``, ``pl0`` to ``pl2``) hold for them, joined by commas.

    Left out are sites without another allele (X or the reference's own), with fewer than ``covered`` of all samples that have a
    likelihood other than 0, of indels (a reference or one of several alleles longer than a base), of a reference other than
    A, C, G or T, and those outside the intervals of ``bed`` (on ``contig``) or the range ``region`` of every contig. Repeated sites are kept.
    """
    number = likelihoods.agg(F.count_distinct("sample").alias("_all"))
    some = (F.col("pl0") != 0) | (F.col("pl1") != 0) | (F.col("pl2") != 0)
    held = F.col("sample").isin(*samples) if samples else F.col("sample").isNotNull()
    names = F.array_join(F.array_sort(F.collect_set(F.when(held, F.col("sample")))).cast("array<string>"), ",")
    per = likelihoods.groupBy("site").agg(F.count_distinct(F.when(some, F.col("sample"))).alias("_n"), names.alias("samples"))
    rows = sites.where((F.col("alt") != "X") & (F.col("ref") != F.col("alt")) & F.col("ref").rlike("^[ACGTacgt]$") & ~F.col("alt").rlike("[^,]{2}"))
    if region is not None:
        rows = rows.where((F.col("pos") + 1 > region[0]) & (F.col("pos") < region[1]))
    rows = rows.join(per, "site", "left").crossJoin(F.broadcast(number)).where(F.coalesce("_n", F.lit(0)) >= covered * F.col("_all"))
    rows = rows.withColumn("samples", F.coalesce("samples", F.lit(""))).drop("_n", "_all")
    if bed is None:
        return rows
    return I.matched(I.Side(rows.withColumn("_next", F.col("pos") + 1), "contig", "pos", "_next"), bed).drop("_next")


def is_transition() -> Column:
    return F.concat("ref", "alt").isin("AG", "GA", "CT", "TC")


def allele_order(pile: DataFrame) -> DataFrame:
    """``alleles`` of each site: the reference, other bases by quality sum, and X for any other."""
    sums = pile.where("not is_del").groupBy("contig", "pos", "ref", "base").agg(F.sum("base_q").alias("q"))
    others = F.filter(F.collect_list(F.struct((-F.col("q")).alias("k"), "base", (F.col("base") != F.col("ref")).alias("alt"))), lambda x: x["alt"])
    return sums.groupBy("contig", "pos", "ref").agg(F.concat(F.col("ref"), F.array_join(F.array_sort(others)["base"], ""), F.lit("X")).alias("alleles"))


def genotype(likelihoods: DataFrame, frequency: DataFrame) -> DataFrame:
    """Most probable genotype (copies of the other allele) and its quality, from phred likelihoods ``pl0`` to ``pl2`` and the
    site's ``af``."""
    f = F.col("af")
    prior = [(1 - f) * (1 - f), 2 * f * (1 - f), f * f]
    post = [F.pow(F.lit(10.0), -F.col(f"pl{k}") / 10) * p for k, p in enumerate(prior)]
    rows = likelihoods.join(frequency, "site").withColumns({f"_p{k}": p for k, p in enumerate(post)})
    total, best = F.col("_p0") + F.col("_p1") + F.col("_p2"), F.greatest("_p0", "_p1", "_p2")
    gt = F.when(F.col("_p0") == best, 0).when(F.col("_p1") == best, 1).otherwise(2)
    gq = F.least(F.lit(99), F.floor(-10 * F.log10(F.greatest(1 - best / total, F.lit(1e-10))) + 0.499)).cast("long")
    return rows.withColumn("gt", gt).withColumn("gq", gq).drop("_p0", "_p1", "_p2")


def em_frequency(likelihoods: DataFrame, *, rounds: int = 30) -> DataFrame:
    """``af`` of each site by expectation and maximisation over its samples' likelihoods, with the genotype frequencies and
    a Hardy-Weinberg statistic.

    One row a site holds its samples' likelihoods, and a batch of sites is worked on at once.
    """
    per = likelihoods.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("sample", "pl0", "pl1", "pl2"))).alias("s"))
    flat = per.select("site", F.flatten(F.transform("s", lambda x: F.array(x["pl0"], x["pl1"], x["pl2"]))).alias("pl"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = batch["pl"].map(len).to_numpy() // 3
            width = int(n.max(initial=1))
            g = np.zeros((len(batch), width, 3))
            for i, pl in enumerate(batch["pl"]):
                g[i, : n[i]] = 10.0 ** (-np.asarray(pl, float).reshape(-1, 3) / 10)
            f, freq = np.full(len(batch), 0.5), np.full((len(batch), 3), 1 / 3)
            for _ in range(rounds):
                prior = np.stack([(1 - f) ** 2, 2 * f * (1 - f), f**2], 1)
                post = g * prior[:, None]
                post /= np.maximum(post.sum(2, keepdims=True), 1e-300)
                f = (post[..., 1] + 2 * post[..., 2]).sum(1) / (2 * n)
                free = g * freq[:, None]
                free /= np.maximum(free.sum(2, keepdims=True), 1e-300)
                freq = free.sum(1) / n[:, None]
            p = freq[:, 2] + freq[:, 1] / 2
            expect = 2 * p * (1 - p)
            hwe = np.where(expect > 0, n * (1 - freq[:, 1] / np.maximum(expect, 1e-12)) ** 2, 0.0)
            yield pd.DataFrame({"site": batch["site"], "n_samples": n, "af": f, "f_hom_ref": freq[:, 0], "f_het": freq[:, 1], "f_hom_alt": freq[:, 2], "hwe": hwe})

    return flat.mapInPandas(run, "site long, n_samples long, af double, f_hom_ref double, f_het double, f_hom_alt double, hwe double")


def _raised(p: np.ndarray, weight: np.ndarray, begin: np.ndarray, site: np.ndarray, g: np.ndarray, step: Callable[[np.ndarray], np.ndarray], rounds: int) -> np.ndarray:
    """Genotype frequencies ``g`` of each site, raised by expectation over its weighed samples and ``step``, which makes
    frequencies of what is expected, until none moves by CHANGE or more."""
    n = np.maximum(np.add.reduceat(weight, begin), 1e-300)[:, None]
    active = np.ones(len(g), bool)
    for _ in range(rounds):
        share = p * g[site]
        share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
        new = step(np.add.reduceat(share * weight[:, None], begin) / n)
        moved = np.abs(new - g).max(axis=1)
        g = np.where(active[:, None], new, g)
        active &= moved >= CHANGE
        if not active.any():
            break
    return g


def _hardy_weinberg(g: np.ndarray) -> np.ndarray:
    f = g[:, 1] / 2 + g[:, 2]
    return np.stack([(1 - f) ** 2, 2 * f * (1 - f), f * f], axis=1)


def contrasts(p: np.ndarray, group: np.ndarray, begin: np.ndarray) -> dict[str, np.ndarray]:
    """Frequencies of sites and of their two groups of samples, and the tests between them; see ``group_contrast``."""
    site = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(p))))
    told = ~(p == 1).all(axis=1)
    which = np.where(p[:, 0] > p[:, 1], np.where(p[:, 0] > p[:, 2], 0, 2), np.where(p[:, 1] > p[:, 2], 1, 2))
    with np.errstate(invalid="ignore", divide="ignore"):
        f = np.add.reduceat(which * told, begin) / np.add.reduceat(told, begin) / 2
    start = np.stack([(1 - f) ** 2, 2 * f * (1 - f), f * f], axis=1)
    weights = [np.ones(len(p)), (group == 1).astype(float), (group == 2).astype(float)]
    equal = [_raised(p, w, begin, site, start, _hardy_weinberg, 500) for w in weights[:1]]
    equal += [_raised(p, w, begin, site, equal[0], _hardy_weinberg, 500) for w in weights[1:]]
    free = [_raised(p, weights[0], begin, site, equal[0], lambda g: g, ROUNDS)]
    free += [_raised(p, w, begin, site, free[0], lambda g: g, ROUNDS) for w in weights[1:]]

    def gained(better: list[np.ndarray], base: np.ndarray, weight: list[np.ndarray]) -> np.ndarray:
        """Log of how much likelier the samples are."""
        with np.errstate(invalid="ignore", divide="ignore"):
            logs = sum(w * (np.log((p * g[site]).sum(axis=1)) - np.log((p * base[site]).sum(axis=1))) for g, w in zip(better, weight, strict=True))
        return np.maximum(np.add.reduceat(logs, begin), 0)

    root = lambda x: np.array([erfc(sqrt(v)) if v == v else np.nan for v in x])  # noqa: E731  upper gamma function of a half
    both = np.minimum(*(np.add.reduceat(w, begin) for w in weights[1:])) > 0
    of_two = lambda x: np.where(both, x, np.nan)
    frequency = lambda g: g[:, 1] / 2 + g[:, 2]
    return {
        "af": frequency(equal[0]), "g_ref": free[0][:, 0], "g_het": free[0][:, 1], "g_alt": free[0][:, 2], "p_hwe": root(gained(free[:1], equal[0], weights[:1])),
        "af1": of_two(frequency(equal[1])), "af2": of_two(frequency(equal[2])), "p_one": of_two(root(gained(equal[1:], equal[0], weights[1:]))), "p_two": of_two(np.exp(-gained(free[1:], free[0], weights[1:]))),
    }


def group_contrast(likelihoods: DataFrame, groups: DataFrame) -> DataFrame:
    """Whether two groups of samples differ at a site: ``site``, ``af`` and the genotype frequencies ``g_ref``, ``g_het``, ``g_alt`` of
    all samples, ``p_hwe`` (that genotypes are in equilibrium), ``af1`` and ``af2`` of the groups, and the p-values ``p_one`` and
    ``p_two`` of likelihood ratio tests that their allele frequencies, or their genotype frequencies, are one.

    ``likelihoods`` have ``site``, ``sample``, ``pl0`` to ``pl2``; ``groups`` have ``sample`` and ``group`` (1 or 2; other samples count for
    ``af`` only). Null where no sample tells anything or a group has none. Many sites are worked on at once; a site's samples
    come together.
    """
    chance = F.array(*[F.pow(F.lit(10.0), -F.col(f"pl{i}") / 10.0) for i in range(3)]).alias("p")
    rows = likelihoods.join(F.broadcast(groups.select("sample", F.col("group").cast("int").alias("group"))), "sample", "left").select("site", "sample", F.coalesce("group", F.lit(0)).alias("group"), chance)
    each = rows.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("sample", "group", "p"))).alias("x")).select("site", F.col("x.group").alias("group"), F.col("x.p").alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                n = np.array([len(x) for x in batch.column(1)], np.int64)
                found = contrasts(batch.column(2).flatten().flatten().to_numpy().reshape(-1, 3), batch.column(1).flatten().to_numpy(), np.cumsum(n) - n)
                yield pa.record_batch([batch.column(0), *(pa.array(x, pa.float64(), mask=~np.isfinite(x)) for x in found.values())], ["site", *found])

    names = ["af", "g_ref", "g_het", "g_alt", "p_hwe", "af1", "af2", "p_one", "p_two"]
    return each.mapInArrow(run, f"site {likelihoods.schema['site'].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names))


def site_call(likelihoods: DataFrame, *, theta: float = 1e-3) -> DataFrame:
    """Posterior of each count of the other allele at a site, from a recurrence over its samples and the prior
    theta / (copies left): ``p_ref``, ``qual`` (phred), ``ac`` (most probable count) and ``posterior``."""
    per = likelihoods.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("sample", "pl0", "pl1", "pl2"))).alias("s"))
    flat = per.select("site", F.flatten(F.transform("s", lambda x: F.array(x["pl0"], x["pl1"], x["pl2"]))).alias("pl"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            sizes = batch["pl"].map(len).to_numpy() // 3
            for n in np.unique(sizes):
                part = batch[sizes == n]
                g = 10.0 ** (-np.stack(part["pl"].to_list()).astype(float).reshape(len(part), n, 3) / 10)
                z = np.zeros((len(part), 2 * n + 1))
                z[:, 0] = 1
                for j in range(n):
                    m = 2 * (j + 1)
                    k = np.arange(m + 1)
                    new = np.zeros_like(z)
                    new[:, : m + 1] = (m - k) * (m - k - 1) * g[:, j, :1] * z[:, : m + 1]
                    new[:, 1 : m + 1] += 2 * k[1:] * (m - k[1:]) * g[:, j, 1:2] * z[:, :m]
                    new[:, 2 : m + 1] += k[2:] * (k[2:] - 1) * g[:, j, 2:] * z[:, : m - 1]
                    z = new / np.maximum(new.sum(1, keepdims=True), 1e-300)
                prior = np.concatenate([[0.0], theta / np.arange(1, 2 * n + 1)])
                prior[0] = 1 - prior.sum()
                post = z * prior
                post /= np.maximum(post.sum(1, keepdims=True), 1e-300)
                rows.append(pd.DataFrame({"site": part["site"].to_numpy(), "p_ref": post[:, 0], "qual": np.minimum(999.0, -10 * np.log10(np.maximum(post[:, 0], 1e-99))), "ac": post.argmax(1), "posterior": list(post)}))
            if rows:
                yield pd.concat(rows)

    return flat.mapInPandas(run, "site long, p_ref double, qual double, ac long, posterior array<double>")


def distance_bias(pile: DataFrame) -> DataFrame:
    """``contig``, ``pos`` and ``vdb`` of each site: how likely the places in their reads of bases that differ from the reference are as
    far apart as they are; 1 where no sample has two of them. Samples count by their such bases, five at most.

    Of a sample, the mean distance of two places and the mean length of reads are whole numbers, rounded down. Deletions, null
    places and null bases do not count. Places are counted first, so a site of any depth comes down to one row for each place in a
    read, and the distances of all pairs are running sums over these.
    """
    own = pile.groupBy("contig", "pos").agg(F.lit(1).alias("_one")).drop("_one")
    places = pile.where("base != ref and not is_del and qpos is not null").groupBy("contig", "pos", "sample", "qpos").agg(F.count(F.lit(1)).alias("_c"), F.sum("read_len").alias("_len"))
    w = Window.partitionBy("contig", "pos", "sample").orderBy("qpos").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda x: F.coalesce(F.sum(x).over(w), F.lit(0))
    apart = places.withColumn("_d", F.col("_c") * (F.col("qpos") * before(F.col("_c")) - before(F.col("_c") * F.col("qpos"))))
    each = apart.groupBy("contig", "pos", "sample").agg(F.sum("_c").alias("n"), F.sum("_d").alias("_d"), F.sum("_len").alias("_len")).where("n >= 2")
    n, m, size = F.col("n"), F.floor(F.col("_d") / (F.col("n") * (F.col("n") - 1) / 2)), F.floor(F.col("_len") / F.col("n"))
    each = each.select("contig", "pos", F.least(n, F.lit(5)).alias("n"), m.alias("m"), size.alias("size")).withColumn("_mu", F.col("size") / 2.9)
    # How the distance of two, three and more places is spread.
    n, m, size, mu = (F.col(c) for c in ("n", "m", "size", "_mu"))
    two = F.when(m == 0, 1 / size).otherwise((size - m) * 2.0 / size / size)
    three = F.when(m > 2 * mu, 0.0).otherwise(F.sin(m * 3.14 / 2 / mu) / (4 * mu / 3.14))
    var = F.pow(size / 1.9 / (n + 1), 2)
    more = F.exp(-(m - mu) * (m - mu) / F.when(m < mu, 2.0).otherwise(3.125) / var) / (1.125 * F.sqrt(2 * 3.14 * var))
    prob = F.when(n == 2, two).when(n == 3, three).otherwise(more)
    site = each.where("size > 0").groupBy("contig", "pos").agg((F.sum(prob * n) / F.sum(n)).alias("vdb"))
    return own.join(site, ["contig", "pos"], "left").fillna(1.0, ["vdb"])


def ten_genotypes(sites: DataFrame) -> DataFrame:
    """Rows of ten genotypes: ``contig``, ``pos``, ``ref``, ``sample``, ``depth``, ``mq`` and ``likelihoods`` of AA, AC, AG, AT, CC, CG, CT,
    GG, GT and TT, of each sample of a site.

    ``sites`` have ``ref``, ``alts`` (array), ``depth``, ``mq`` and ``samples``, an array of ``sample`` and ``pls`` (phred likelihoods in the order of
    VCF). Sites whose alleles are not single letters, whose reference is not A, C, G or T, of more than four alleles, without
    others, without samples or without depth are left out. A base that is no allele takes the likelihoods of the last allele that is
    no base (X); without one they are null. Depth is dealt to the samples in turn, each the rounded share of what is left and
    at least 1; samples whose likelihoods are all 0 have none.
    """
    base = F.col("ref").isin(*"ACGT") & F.size("alts").between(1, 3) & F.forall("alts", lambda a: F.length(a) == 1) & (F.col("depth") > 0)
    other = F.array_max(F.transform("alts", lambda a, i: F.when(~a.isin(*"ACGT"), i + 1)))
    allele = [F.when(F.col("ref") == b, 0).otherwise(F.coalesce(F.nullif(F.array_position("alts", b).cast("int"), F.lit(0)), other)) for b in "ACGT"]

    def likelihood(pls: Column, k: int, j: int) -> Column:
        a, b = F.col(f"_a{k}"), F.col(f"_a{j}")
        high = F.greatest(a, b)
        return F.when(a.isNotNull() & b.isNotNull(), F.get(pls, (high * (high + 1) / 2 + F.least(a, b)).cast("int")))

    def deal(state: Column, x: Column) -> Column:
        left = F.size("samples") - F.size(state["given"])
        share = F.greatest(F.floor(state["rest"] / left + 0.499), F.lit(1)).cast("long")
        given = F.when(F.forall(x["pls"], lambda v: v == 0), F.lit(0).cast("long")).otherwise(share)
        return F.struct((state["rest"] - given).alias("rest"), F.concat(state["given"], F.array(given)).alias("given"))

    start = F.struct(F.col("depth").cast("long").alias("rest"), F.array().cast("array<bigint>").alias("given"))
    dealt = sites.where(base).withColumns({f"_a{i}": a for i, a in enumerate(allele)}).withColumn("_given", F.aggregate("samples", start, deal, lambda s: s["given"]))
    row = lambda x, i: F.struct(x["sample"].alias("sample"), F.get("_given", i).alias("depth"), F.array(*[likelihood(x["pls"], k, j) for k in range(4) for j in range(k, 4)]).alias("likelihoods"))
    each = dealt.select("contig", "pos", "ref", "mq", F.inline(F.transform("samples", row)))
    return each.select("contig", "pos", "ref", "sample", "depth", "mq", "likelihoods")


def filtered(sites: DataFrame, *, window: int = 10, min_depth: int = 3, max_depth: int = 45, min_mq: int = 10) -> DataFrame:
    """Adds ``filter``, the first test that a site fails: d shallow, D deep, Q mapping quality, W an SNP within ``window`` of
    an indel, G an indel within ``window`` of a better one (by quality, then place, then site)."""
    cell = F.floor(F.col("pos") / window)
    indels = sites.where(is_indel()).select("contig", F.col("pos").alias("_p"), F.col("qual").alias("_q"), F.col("site").alias("_s"))
    spread = indels.withColumn("_c", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("_p") / window) + d)))
    met = sites.withColumn("_c", cell).join(spread, ["contig", "_c"]).where((F.abs(F.col("pos") - F.col("_p")) <= window) & (F.col("site") != F.col("_s")))
    better = (F.col("_q") > F.col("qual")) | ((F.col("_q") == F.col("qual")) & ((F.col("_p") < F.col("pos")) | ((F.col("_p") == F.col("pos")) & (F.col("_s") < F.col("site")))))
    near = met.where(~is_indel() | better).select("site").distinct().withColumn("_near", F.lit(True))
    code = F.when(F.col("depth") < min_depth, "d").when(F.col("depth") > max_depth, "D").when(F.col("mq") < min_mq, "Q").when(F.col("_near"), F.when(is_indel(), "G").otherwise("W")).otherwise("PASS")
    return sites.join(near, "site", "left").withColumn("filter", code).drop("_near")


def dense(sites: DataFrame, *, window: int, most: int) -> DataFrame:
    """SNPs with more than ``most`` SNPs within ``window`` bases about them.

    Each is counted in its cell, to which the SNPs up to ``window`` bases beyond its edges are lent.
    """
    size = max(window, 1 << 16)
    cell = lambda shift: F.floor((F.col("pos") + shift) / size)
    lent = sites.where(~is_indel()).withColumn("_own", cell(0)).withColumn("_cell", F.explode(F.array_distinct(F.array(cell(-window), cell(0), cell(window)))))
    w = Window.partitionBy("contig", "_cell").orderBy("pos").rangeBetween(-window, window)
    return lent.withColumn("n_near", F.count(F.lit(1)).over(w)).where((F.col("_cell") == F.col("_own")) & (F.col("n_near") > most)).drop("_own", "_cell")


def likelihoods(pile: DataFrame, *, keep: float = 0.83) -> DataFrame:
    """Phred likelihoods ``pl0`` to ``pl2`` of the genotypes of each site and sample, least one 0, at most 255.

    Errors of one strand and base depend on one another: the k-th best of them counts ``keep`` to the power k - 1. A
    heterozygous genotype halves each base's chance.
    """
    w = Window.partitionBy("contig", "pos", "sample", "base", "reverse").orderBy(F.desc("base_q"), "read_no", "ord", "map_q", "qpos")
    weighed = pile.where("not is_del").withColumn("_q", F.col("base_q") * F.pow(F.lit(keep), F.row_number().over(w) - 1))
    side = lambda test: F.sum(F.when(test, F.col("_q")).otherwise(0.0))
    is_ref = F.col("base") == F.col("ref")
    rows = weighed.groupBy("contig", "pos", "sample").agg(side(~is_ref).alias("a"), side(is_ref).alias("c"), (F.count(F.lit(1)) * 3.0103).alias("b"))
    low = F.least("a", "b", "c")
    return rows.select("contig", "pos", "sample", *(F.least(F.lit(255), F.floor(F.col(x) - low + 0.5)).cast("long").alias(f"pl{k}") for k, x in enumerate("abc")))


def _fisher(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact p-value of a table of two rows: all tables with these margins that are no more probable."""
    n1, m1, n = a + b, a + c, a + b + c + d
    choose = lambda p, q: lgamma(p + 1) - lgamma(q + 1) - lgamma(p - q + 1)
    at = lambda k: choose(m1, k) + choose(n - m1, n1 - k) - choose(n, n1)
    seen = at(a) + 1e-7
    return min(1.0, sum(exp(p) for k in range(max(0, n1 + m1 - n), min(n1, m1) + 1) if (p := at(k)) <= seen))


def _beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    value = 1.0  # from the last term of the fraction back to the first
    for i in range(120, 0, -1):
        m = i // 2
        step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = 1 + step / value
    return front / value


def _t_test(n1: int, s1: float, q1: float, n2: int, s2: float, q2: float) -> float:
    """One-sided p-value that the second mean is not below the first, from counts, sums and sums of squares; 1 where
    either has none or both have fewer than three together."""
    if min(n1, n2) < 1 or n1 + n2 < 3:
        return 1.0
    m1, m2 = s1 / n1, s2 / n2
    if m1 <= m2:
        return 1.0
    pooled = (q1 - n1 * m1 * m1 + q2 - n2 * m2 * m2) / (n1 + n2 - 2)
    if pooled <= 0:
        return 0.0
    t = (m1 - m2) / sqrt(pooled * (1 / n1 + 1 / n2))
    df = n1 + n2 - 2
    return 0.5 * _beta(df / (df + t * t), df / 2, 0.5)


def bias_p_values(sums: DataFrame) -> DataFrame:
    """Strand, base quality, mapping quality and end distance p-values of rows of ``anno16``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            n1, n2 = p["ref_fwd"] + p["ref_rev"], p["alt_fwd"] + p["alt_rev"]
            out = p[["contig", "pos", "sample"]].copy()
            out["p_strand"] = [_fisher(*map(int, r)) for r in p[["ref_fwd", "ref_rev", "alt_fwd", "alt_rev"]].to_numpy()]
            for name in ("bq", "mq", "end"):
                columns = (n1, p[f"{name}_ref"], p[f"{name}2_ref"], n2, p[f"{name}_alt"], p[f"{name}2_alt"])
                out[f"p_{name}"] = [_t_test(*r) for r in zip(*(c.tolist() for c in columns), strict=True)]
            yield out

    return sums.mapInPandas(run, "contig string, pos long, sample string, p_strand double, p_bq double, p_mq double, p_end double")
