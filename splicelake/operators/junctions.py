"""Junctions, insertions and deletions: extraction from hits, evidence and filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splicelake.functions import cigar
from splicelake.operators import intervals as I

KEY = ("contig", "left", "right", "antisense")


def extract(hits: DataFrame) -> DataFrame:
    """One row an intron of hits with one: ``left`` the last base before it, ``right`` the first after it."""
    return hits.where("intron > 0").select(
        "insert_id", "contig", (F.col("lft") + F.col("m1") - 1).alias("left"), (F.col("lft") + F.col("m1") + F.col("intron")).alias("right"),
        F.col("antisense_splice").alias("antisense"), F.col("m1").alias("left_extent"), F.col("m2").alias("right_extent"), F.col("edit_dist").alias("splice_mms"),
    )


def extract_ops(sam: DataFrame) -> DataFrame:
    """One row an intron of alignments with ``ops``; extents are the lengths of the operations about it."""
    steps = sam.withColumn("_w", cigar.walk(F.col("pos"), F.col("ops")))
    each = steps.select("*", F.posexplode("_w").alias("_i", "_x")).where(F.col("_x.op").isin("N", "n"))
    near = lambda k: F.get("_w", F.col("_i") + k)["len"]
    strand = F.coalesce(F.col("xs") == "-", F.col("flag").bitwiseAND(16) > 0)
    return each.select(F.col("rname").alias("contig"), (F.col("_x.start") - 1).alias("left"), F.col("_x.end").alias("right"), strand.alias("antisense"), near(-1).cast("long").alias("left_extent"), near(1).cast("long").alias("right_extent"), F.col("nm").alias("splice_mms"))


def aggregate(juncs: DataFrame) -> DataFrame:
    """Evidence by junction: greatest extents, least mismatches, hits. Sums, minima and maxima, so partial results merge."""
    return juncs.groupBy(*KEY).agg(F.max("left_extent").alias("left_extent"), F.max("right_extent").alias("right_extent"), F.min("splice_mms").alias("min_splice_mms"), F.count(F.lit(1)).alias("supporting_hits"))


def merge(*sets: DataFrame) -> DataFrame:
    """Evidence of several sets of aggregated junctions."""
    rows = sets[0]
    for more in sets[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy(*KEY).agg(F.max("left_extent").alias("left_extent"), F.max("right_extent").alias("right_extent"), F.min("min_splice_mms").alias("min_splice_mms"), F.sum("supporting_hits").alias("supporting_hits"))


def accepted(*, anchor: int = 8, mismatches: int = 1, long_intron: int = 50_000) -> Column:
    """Anchors and mismatches within limits; long introns need two hits and anchors over 12."""
    low = F.least("left_extent", "right_extent")
    short = (F.col("right") - F.col("left") - 1 <= long_intron) | ((F.col("supporting_hits") >= 2) & (low > 12))
    return (low >= anchor) & (F.col("min_splice_mms") <= mismatches) & short


def shadowed(juncs: DataFrame, *, near: int = 8) -> DataFrame:
    """Junctions with a better supported one on the other strand of which one end is less than ``near`` bases away and the
    other end is within ``near`` too. Distances are absolute."""
    other = juncs.select(F.col("contig"), F.col("left").alias("o_left"), F.col("right").alias("o_right"), F.col("antisense").alias("o_antisense"), F.col("supporting_hits").alias("o_hits"))
    cell = lambda c: F.floor(F.col(c) / near)
    a = juncs.withColumn("_cell", cell("left"))
    b = other.withColumn("_cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: cell("o_left") + d)))
    met = a.join(b, ["contig", "_cell"]).where((F.abs(F.col("left") - F.col("o_left")) <= near) & (F.abs(F.col("right") - F.col("o_right")) <= near))
    met = met.where((F.abs(F.col("left") - F.col("o_left")) < near) | (F.abs(F.col("right") - F.col("o_right")) < near))
    return met.where((F.col("antisense") != F.col("o_antisense")) & (F.col("o_hits") > F.col("supporting_hits"))).select(*KEY).distinct()


def filtered(juncs: DataFrame, known: DataFrame) -> DataFrame:
    """Adds ``accepted``: annotated junctions always, others by the limits unless shadowed."""
    marked = juncs.join(known.select(*KEY).distinct().withColumn("_gtf", F.lit(True)), [*KEY], "left")
    bad = shadowed(juncs).withColumn("_shadow", F.lit(True))
    marked = marked.join(bad, [*KEY], "left")
    return marked.withColumn("accepted", F.coalesce("_gtf", accepted() & F.col("_shadow").isNull())).drop("_gtf", "_shadow")


def final(juncs: DataFrame, *, anchor: int = 8) -> DataFrame:
    return juncs.where((F.col("supporting_hits") > 0) & (F.least("left_extent", "right_extent") >= anchor))


#: Bases of a cell in which junctions are numbered.
CELL = 1 << 20


def bed(juncs: DataFrame) -> DataFrame:
    """Rows of a twelve-column track. Names number the junctions in the order of their key: in cells of a contig, with the
    number of junctions in the cells before, so that no task sorts all."""
    start, end = F.col("left") + 1 - F.col("left_extent"), F.col("right") + F.col("right_extent")
    cell = F.floor(F.col("left") / CELL).alias("_cell")
    before = F.coalesce(F.sum("_n").over(Window.orderBy("contig", "_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a cell
    cells = juncs.groupBy("contig", cell).agg(F.count(F.lit(1)).alias("_n")).select("contig", "_cell", before.alias("_before"))
    number = F.col("_before") + F.row_number().over(Window.partitionBy("contig", "_cell").orderBy(*KEY))
    return juncs.withColumn("_cell", cell).join(cells, ["contig", "_cell"]).select(
        F.col("contig").alias("chrom"), start.alias("bed_start"), end.alias("bed_end"), F.format_string("JUNC%08d", number).alias("name"), F.col("supporting_hits").alias("score"),
        F.when(F.col("antisense"), "-").otherwise("+").alias("strand"), F.concat_ws(",", "left_extent", "right_extent").alias("sizes"), F.concat(F.lit("0,"), (F.col("right") - start).cast("string")).alias("starts"),
    )


def from_bed(track: DataFrame) -> DataFrame:
    """Junctions of a twelve-column track."""
    sizes, starts = F.split("sizes", ","), F.split("starts", ",")
    return track.select(F.col("chrom").alias("contig"), (F.col("bed_start") + sizes[0].cast("long") - 1).alias("left"), (F.col("bed_start") + starts[1].cast("long")).alias("right"), (F.col("strand") == "-").alias("antisense"), F.col("score").alias("supporting_hits"))


def annotated(exons: DataFrame) -> DataFrame:
    """Introns between the exons of each transcript, once each."""
    w = Window.partitionBy("contig", "tx_id").orderBy("ex_start", "ex_end")
    following = exons.withColumn("right", F.lead("ex_start").over(w)).where(F.col("right") > F.col("ex_end"))
    return following.select("contig", (F.col("ex_end") - 1).alias("left"), "right", (F.col("strand") == "-").alias("antisense")).distinct()


def rescued_pairs(pairs: DataFrame, juncs: DataFrame, *, mean: int, sd: int) -> DataFrame:
    """Far pairs with a junction between the mates without which their distance fits: the first one by key gives ``new_dist``."""
    gap = pairs.where("too_far and contig = b_contig").withColumn("_from", F.least("rgt", "b_rgt")).withColumn("_to", F.greatest("lft", "b_lft"))
    introns = juncs.select("contig", "left", "right", "antisense", F.col("left").alias("_jl"), F.col("right").alias("_jr"))
    fits = F.expr(f"_from <= left and _to >= right and left - _from + _to - right between {mean - sd} and {mean + sd}")
    met = I.interval_join(I.Side(gap, "contig", "_from", "_to"), I.Side(introns, "contig", "_jl", "_jr"), test=fits)
    met = met.withColumn("new_dist", F.col("left") - F.col("_from") + F.col("_to") - F.col("right"))
    w = Window.partitionBy("insert_id", "ord", "b_ord").orderBy("left", "right", "antisense")
    return met.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def indels(sam: DataFrame, kind: str) -> DataFrame:
    """One row an insertion (``I``, with its bases) or deletion (``D``): ``left`` the last base before it."""
    steps = sam.withColumn("_w", cigar.walk(F.col("pos"), F.col("ops")))
    each = steps.select("*", F.posexplode("_w").alias("_i", "_x")).where(F.col("_x.op") == kind)
    near = lambda k: F.get("_w", F.col("_i") + k)["len"].cast("long")
    before = F.aggregate(F.filter(F.slice("_w", F.lit(1), F.col("_i")), lambda x: x["op"].isin("M", "I", "S")), F.lit(0), lambda a, x: a + x["len"])
    rows = each.select(F.col("rname").alias("contig"), (F.col("_x.start") - 1).alias("left"), F.col("_x.end").alias("right"), F.substring("seq", before + 1, F.col("_x.len")).alias("bases"), near(-1).alias("left_extent"), near(1).alias("right_extent"))
    return rows.drop("right") if kind == "I" else rows.drop("bases")


def indel_counts(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Evidence by insertion (contig, left, bases) or deletion (contig, left, right)."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("supporting_hits"), F.max("left_extent").alias("left_extent"), F.max("right_extent").alias("right_extent"))
