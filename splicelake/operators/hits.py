"""Operators on alignment tables: selection, grading, pairing and reporting.

Hits have ``insert_id``, ``mate`` (1, 2; 0 unpaired), ``ord`` (a row's number in its insert), ``contig``, ``lft`` and ``rgt``
(half open, from 0), ``antisense_aln``, ``antisense_splice``, ``edit_dist``, ``as_score``. Every choice among equals ends in
columns that name the row, so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splicelake.functions import cigar

READ = ("insert_id", "mate")
#: Greatest penalty of the aligner's scoring.
MAX_PENALTY = 6


def with_right(hits: DataFrame) -> DataFrame:
    """Adds ``rgt`` to hits of one match, or of two about an intron."""
    return hits.withColumn("rgt", F.col("lft") + F.col("m1") + F.col("intron") + F.when(F.col("intron") > 0, F.col("m2")).otherwise(0))


def to_bed(sam: DataFrame) -> DataFrame:
    """Mapped alignments as BED rows of six columns."""
    strand = F.when(F.col("flag").bitwiseAND(16) > 0, "-").otherwise("+")
    return sam.where(F.col("flag").bitwiseAND(4) == 0).select(
        F.col("rname").alias("chrom"), F.col("pos").alias("bed_start"), cigar.right_end(F.col("pos"), F.col("ops")).alias("bed_end"), F.col("qname").alias("name"), F.col("mapq").alias("score"), strand.alias("strand")
    )


def tags(hits: DataFrame, *, library: str = "fr-unstranded", order: Sequence[str] = ("contig", "lft", "ord")) -> DataFrame:
    """Adds ``nh``, ``hi`` (from 0 in the order of ``order``), ``cc`` and ``cp`` (the read's next hit) and ``xs``: a spliced
    hit's strand, else that which a stranded library gives."""
    read = Window.partitionBy(*READ)
    place = read.orderBy(*order)
    following = F.lead("contig").over(place)
    forward = {"fr-firststrand": (F.col("mate") == 1) == F.col("antisense_aln"), "fr-secondstrand": (F.col("mate") == 1) != F.col("antisense_aln")}
    xs = F.when(F.col("intron") > 0, F.when(F.col("antisense_splice"), "-").otherwise("+"))
    if library in forward:
        xs = xs.otherwise(F.when(forward[library], "+").otherwise("-"))
    return hits.withColumns({
        "nh": F.count(F.lit(1)).over(read), "hi": F.row_number().over(place) - 1,
        "cc": F.when(following == F.col("contig"), "=").otherwise(following), "cp": F.lead("lft").over(place), "xs": xs,
    })


def mapq(hits: DataFrame) -> DataFrame:
    """Adds ``mapq``: 50 for a read's only hit, else floor(-10 log10(1 - 1 / n)) for n hits, which is 3, 1, 1, then 0."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*READ))
    return hits.withColumn("mapq", F.when(n == 1, 50).when(n == 2, 3).when(n <= 4, 1).otherwise(0))


def first_hit(hits: DataFrame, group: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each group."""
    return hits.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_k = 1").drop("_k")


def mate_fields(best: DataFrame) -> DataFrame:
    """``flag``, ``rnext``, ``pnext`` (from 1) and signed ``tlen`` of one hit a mate. The mate further left has the positive
    length, of equal ones the first mate; where one mate contains the other the outer extent counts."""
    other = best.select("insert_id", (3 - F.col("mate")).alias("mate"), *(F.col(c).alias(f"o_{c}") for c in ("contig", "lft", "rgt", "antisense_aln")))
    both = best.join(other, ["insert_id", "mate"], "left")
    there, same = F.col("o_contig").isNotNull(), F.coalesce(F.col("o_contig") == F.col("contig"), F.lit(False))
    end = F.greatest("rgt", "o_rgt")
    flag = (
        F.lit(1) + F.when(F.col("mate") == 1, 64).otherwise(128) + F.when(F.col("antisense_aln"), 16).otherwise(0)
        + F.when(~there, 8).when(F.col("o_antisense_aln"), 32).otherwise(0) + F.when(same & (F.col("antisense_aln") != F.col("o_antisense_aln")), 2).otherwise(0)
    )
    first = (F.col("lft") < F.col("o_lft")) | ((F.col("lft") == F.col("o_lft")) & (F.col("mate") == 1))
    tlen = F.when(~same, 0).when(first, end - F.col("lft")).otherwise(F.col("o_lft") - end).cast("long")
    return both.withColumns({"flag": flag.cast("int"), "rnext": F.when(~there, "*").when(same, "=").otherwise(F.col("o_contig")), "pnext": F.coalesce(F.col("o_lft") + 1, F.lit(0)), "tlen": tlen})


def group_multi(hits: DataFrame, *, min_score: int = -18, max_hits: int = 3) -> DataFrame:
    """Adds each read's ``fate``: ``multi`` (more than ``max_hits`` good hits), ``requeue`` (best score at the minimum) or
    ``keep``, and ``n_good``. Good hits score ``min_score`` - 10 or more and are within 2 of the best."""
    read = Window.partitionBy(*READ)
    best = F.max("as_score").over(read)
    good = (F.col("as_score") >= min_score - 10) & (F.col("as_score") >= best - 2)
    n_good = F.count_if(good).over(read)
    hits = hits.withColumn("_best", best).withColumn("n_good", n_good)
    return hits.withColumn("fate", F.when(F.col("n_good") > max_hits, "multi").when(F.col("_best") <= min_score, "requeue").otherwise("keep")).drop("_best")


def merge_dedup(*sets: DataFrame) -> DataFrame:
    """Union of SAM rows, one for each (read, place, operations, strand) and each XS; rows without XS only where none has it."""
    rows = sets[0]
    for more in sets[1:]:
        rows = rows.unionByName(more)
    place = ["qname", "rname", "pos", "cigar", "reverse"]
    known = F.max(F.col("xs").isNotNull()).over(Window.partitionBy(*place))
    return rows.withColumn("_known", known).where(F.col("xs").isNotNull() | ~F.col("_known")).drop("_known").dropDuplicates([*place, "xs"])


def within_limits(hits: DataFrame, *, edit_dist: int = 2, gap_len: int = 2, mismatches: int = 2) -> DataFrame:
    limits = {"edit_dist": edit_dist, "gap_len": gap_len, "mismatches": mismatches}
    for name, most in limits.items():
        if name in hits.columns:
            hits = hits.where(F.col(name) <= most)
    return hits


def best_of_read(hits: DataFrame, *, secondary: bool = False) -> DataFrame:
    """All hits that share a read's greatest score; with ``secondary`` all hits."""
    if secondary:
        return hits
    return hits.withColumn("_r", F.rank().over(Window.partitionBy(*READ).orderBy(F.desc("as_score")))).where("_r = 1").drop("_r")


def top_k(hits: DataFrame, k: int, *, seed: int = 0, tie: Sequence[str] | None = None, suppress: bool = False) -> DataFrame:
    """Up to ``k`` hits of each read by score, of equals those that a seeded hash picks (or ``tie`` columns). With
    ``suppress`` a read with more than ``k`` goes."""
    name = ["contig", "lft", "ord"]
    order = [*tie] if tie else [F.xxhash64(F.lit(seed), *READ, *name), *name]
    w = Window.partitionBy(*READ)
    hits = hits.withColumn("_k", F.row_number().over(w.orderBy(F.desc("as_score"), *order)))
    if suppress:
        hits = hits.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") <= k).drop("_n")
    return hits.where(F.col("_k") <= k).drop("_k")


def rescored(hits: DataFrame, juncs: DataFrame) -> DataFrame:
    """Adds ``new_score``. An intron among annotated junctions adds 2; one that was not observed costs the greatest penalty;
    an observed one costs 8 times min(depth / support + 0.5 where an extent is short, 1) with support of 5 or more, else 8,
    and 6 less where annotated ones match. ``juncs``: the junction key, ``supporting_hits``, extents, ``depth``, ``gtf``,
    ``gtf_match``."""
    keyed = hits.withColumns({"left": F.col("lft") + F.col("m1") - 1, "right": F.col("lft") + F.col("m1") + F.col("intron")})
    both = keyed.join(juncs.withColumnRenamed("antisense", "antisense_splice"), ["contig", "left", "right", "antisense_splice"], "left")
    short = F.least(F.floor((F.col("m1") + F.col("m2")) / 4), F.lit(10))
    few = F.when(F.least("left_extent", "right_extent") < short, 0.5).otherwise(0.0)
    share = F.when(F.col("supporting_hits") >= 5, F.least(F.col("depth") / F.col("supporting_hits") + few, F.lit(1.0))).otherwise(1.0)
    observed = F.floor((MAX_PENALTY + 2) * share) - F.when(F.col("gtf_match"), MAX_PENALTY).otherwise(0)
    change = F.when(F.col("intron") == 0, 0).when(F.col("gtf"), 2).when(F.col("supporting_hits").isNull(), -MAX_PENALTY).otherwise(-observed)
    return both.withColumn("new_score", F.col("as_score") + change)


def without_bad_junctions(hits: DataFrame, juncs: DataFrame) -> DataFrame:
    """Hits of which every intron is an accepted junction."""
    good = juncs.where("accepted").select("contig", "left", "right", F.col("antisense").alias("antisense_splice"))
    keyed = hits.withColumns({"left": F.col("lft") + F.col("m1") - 1, "right": F.col("lft") + F.col("m1") + F.col("intron")})
    spliced = keyed.where("intron > 0").join(good, ["contig", "left", "right", "antisense_splice"], "left_semi")
    return keyed.where("intron = 0").unionByName(spliced).drop("left", "right")


def unmapped(reads: DataFrame, hits: DataFrame) -> DataFrame:
    """Reads without a hit."""
    return reads.join(hits.select(*READ).distinct(), [*READ], "left_anti")


def primary(hits: DataFrame, *, seed: int = 0, tie: Sequence[str] | None = None) -> DataFrame:
    """Adds ``hi``, the place of a hit in its read by contig and place, and ``is_primary`` for one hit of the read."""
    name = ["contig", "lft", "ord"]
    w = Window.partitionBy(*READ)
    chosen = w.orderBy(*tie) if tie else w.orderBy(F.xxhash64(F.lit(seed), *READ, *name), *name)
    return hits.withColumn("hi", F.row_number().over(w.orderBy(*name)) - 1).withColumn("is_primary", F.row_number().over(chosen) == 1)


# pairs


def distances(l1: Column, r1: Column, l2: Column, r2: Column) -> tuple[Column, Column]:
    """Outer and inner distance of two hits; of one within the other its container's length and 0."""
    within = ((l1 <= l2) & (r1 >= r2)) | ((l2 <= l1) & (r2 >= r1))
    outer = F.greatest(r1, r2) - F.least(l1, l2)
    inner = F.when(within, 0).when(l1 < l2, l2 - r1).otherwise(l1 - r2)
    return outer, inner


def pairs(hits: DataFrame, *, most: int = 20, order: Sequence[str] = ("ord",)) -> DataFrame:
    """All combinations of the hits of both mates of an insert. Each side takes its first 2 ``most`` + 1 hits; columns of
    the second mate begin with ``b_``."""
    capped = hits.withColumn("_k", F.row_number().over(Window.partitionBy(*READ).orderBy(*order))).where(F.col("_k") <= 2 * most + 1).drop("_k")
    second = capped.where("mate = 2").select("insert_id", *(F.col(c).alias(f"b_{c}") for c in hits.columns if c != "insert_id"))
    return capped.where("mate = 1").join(second, "insert_id")


def is_discordant(p: DataFrame, *, min_dist: int) -> Column:
    """Different contigs, one strand, or mates that overlap or lie more than ``min_dist`` apart."""
    first_left = F.col("lft") < F.col("b_lft")
    apart = F.when(first_left, F.col("b_lft") - F.col("rgt")).otherwise(F.col("lft") - F.col("b_rgt"))
    return (F.col("contig") != F.col("b_contig")) | (F.col("antisense_aln") == F.col("b_antisense_aln")) | (apart < 0) | (apart > min_dist)


def graded(p: DataFrame, *, mean: int = 50, sd: int = 20, discordant: Column | None = None) -> DataFrame:
    """Adds ``inner_dist``, ``too_far``, ``too_close``, ``n_spliced``, ``opposite``, ``consistent`` and ``score``: the sum of
    both scores, less 6 for far mates (3 if by less than ``sd``), up to 3 for close ones, 6 for one strand, or 6 for
    discordant pairs alone."""
    _, inner = distances(*(F.col(c) for c in ("lft", "rgt", "b_lft", "b_rgt")))
    p = p.withColumn("inner_dist", inner)
    low, high = mean - sd, mean + sd
    spliced = (F.col("intron") > 0).cast("int") + (F.col("b_intron") > 0).cast("int")
    p = p.withColumns({
        "too_far": F.col("inner_dist") > high, "too_close": F.col("inner_dist") < low, "n_spliced": spliced,
        "opposite": F.col("antisense_aln") != F.col("b_antisense_aln"),
        "consistent": (spliced == 2) & (F.col("antisense_splice") == F.col("b_antisense_splice")),
    })
    far = F.when(F.col("inner_dist") - high < sd, MAX_PENALTY // 2).otherwise(MAX_PENALTY)
    close = F.least(F.lit(MAX_PENALTY // 2), F.floor((low - F.col("inner_dist")) / sd) + 1)
    normal = F.when(F.col("too_far"), far).when(F.col("too_close"), close).otherwise(0) + F.when(F.col("opposite"), 0).otherwise(MAX_PENALTY)
    penalty = normal if discordant is None else F.when(discordant, MAX_PENALTY).otherwise(normal)
    return p.withColumn("score", (F.col("as_score") + F.col("b_as_score") - penalty).cast("long"))


def best_pairs(p: DataFrame, k: int, *, seed: int = 0, tie: Sequence[str] | None = None) -> DataFrame:
    """Up to ``k`` pairs of an insert that share its greatest score."""
    name = ["contig", "lft", "ord", "b_contig", "b_lft", "b_ord"]
    w = Window.partitionBy("insert_id")
    order = [*tie] if tie else [F.xxhash64(F.lit(seed), "insert_id", *name), *name]
    p = p.withColumn("_r", F.rank().over(w.orderBy(F.desc("score")))).where("_r = 1")
    return p.withColumn("_k", F.row_number().over(w.orderBy(*order))).where(F.col("_k") <= k).drop("_r", "_k")


def is_concordant(p: DataFrame, *, max_intron: int) -> Column:
    return F.col("opposite") & (F.col("contig") == F.col("b_contig")) & (F.col("inner_dist") <= max_intron)


def mixed_report(hits: DataFrame, chosen: DataFrame) -> DataFrame:
    """The best hits of the mates of inserts without a chosen pair."""
    return best_of_read(hits.join(chosen.select("insert_id").distinct(), "insert_id", "left_anti"))


def summary(reads: DataFrame, hits: DataFrame, chosen: DataFrame, *, most: int) -> DataFrame:
    """One row: reads, mapped ones, those with several and with more than ``most`` hits, for either mate; pairs, discordant
    pairs, and the shares of mapped reads and of concordant pairs in percent."""
    per = hits.groupBy(*READ).agg(F.count(F.lit(1)).alias("n"))
    read = reads.select(*READ).join(per, [*READ], "left")
    count = lambda side, test: F.count_if((F.col("mate") == side) & test)
    columns = []
    for side in (1, 2):
        columns += [count(side, F.lit(True)).alias(f"input_{side}"), count(side, F.col("n").isNotNull()).alias(f"mapped_{side}"), count(side, F.coalesce(F.col("n"), F.lit(0)) > 1).alias(f"multi_{side}"), count(side, F.coalesce(F.col("n"), F.lit(0)) > most).alias(f"over_{side}")]
    columns.append(F.round(100.0 * F.count("n") / F.nullif(F.count(F.lit(1)), F.lit(0)), 4).alias("rate"))
    paired = chosen.groupBy("insert_id").agg(F.min("discordant").alias("bad"))
    pairs_row = paired.agg(F.count(F.lit(1)).alias("pairs"), F.count_if("bad").alias("discordant_pairs"), F.round(100.0 * F.count_if(~F.col("bad")) / F.nullif(F.count(F.lit(1)), F.lit(0)), 4).alias("concordant_rate"))
    return read.agg(*columns).join(pairs_row)


def unique_mapq(sam: DataFrame) -> DataFrame:
    """Each read's best hit; ``mapq`` is 250 times the share by which its score is above the second's, at most 250."""
    w = Window.partitionBy("qname").orderBy(F.desc("score"), "rname", "pos", "ord")
    second = F.lead("score").over(w)
    rows = sam.withColumn("_second", second).withColumn("_k", F.row_number().over(w)).where("_k = 1")
    share = (F.col("score") - F.col("_second")) / F.col("score")
    return rows.withColumn("new_mapq", F.when(F.col("_second").isNull() | (F.col("score") <= 0), 250).otherwise(F.least(F.lit(250), F.floor(250 * share + 0.5))).cast("long")).drop("_second", "_k")
