"""Coverage and pileup tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splicelake.operators import intervals as I

#: Bases of a bin of the two-level running sum.
BIN = 1 << 14


def events(blocks: DataFrame, *, contig: str = "contig", start: str = "start", end: str = "end") -> DataFrame:
    """Changes of depth: ``contig``, ``spot``, ``delta``; places where starts and ends cancel out are left out. Sums, so
    events of several sets merge."""
    both = blocks.select(F.col(contig).alias("contig"), F.inline(F.array(F.struct(F.col(start).alias("spot"), F.lit(1).alias("delta")), F.struct(F.col(end).alias("spot"), F.lit(-1).alias("delta")))))
    return both.groupBy("contig", "spot").agg(F.sum("delta").alias("delta")).where("delta != 0")


def depths(changes: DataFrame, *, cap: int | None = None) -> DataFrame:
    """Depth from each change on: ``contig``, ``spot``, ``depth``.

    A contig's changes are summed in bins: a window over the few bin totals gives each bin's start, a window inside the bin
    the rest, so no task sees a whole contig.
    """
    binned = changes.withColumn("_bin", F.floor(F.col("spot") / BIN))
    totals = binned.groupBy("contig", "_bin").agg(F.sum("delta").alias("_t"))
    start = F.coalesce(F.sum("_t").over(Window.partitionBy("contig").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum("delta").over(Window.partitionBy("contig", "_bin").orderBy("spot").rowsBetween(Window.unboundedPreceding, 0))
    found = binned.join(totals.select("contig", "_bin", start.alias("_start")), ["contig", "_bin"]).withColumn("depth", F.greatest(F.lit(0), F.col("_start") + within))
    if cap is not None:
        found = found.withColumn("depth", F.least(F.col("depth"), F.lit(cap)))
    return found.select("contig", "spot", F.col("depth").cast("long").alias("depth"))


def runs(depth: DataFrame) -> DataFrame:
    """Half-open runs of equal depth, those of depth 0 left out: ``contig``, ``start``, ``end``, ``depth``."""
    bins, inside = Window.partitionBy("contig").orderBy("_bin"), Window.partitionBy("contig", "_bin").orderBy("spot")
    binned = depth.withColumn("_bin", F.floor(F.col("spot") / BIN))
    # the last depth before each bin and the first change after it, from one row a bin
    last = binned.groupBy("contig", "_bin").agg(F.max_by("depth", "spot").alias("_d"))
    binned = binned.join(last.select("contig", "_bin", F.lag("_d").over(bins).alias("_carry")), ["contig", "_bin"])
    changed = binned.withColumn("_before", F.coalesce(F.lag("depth").over(inside), "_carry")).where("_before is null or _before != depth").drop("_before", "_carry")
    first = changed.groupBy("contig", "_bin").agg(F.min("spot").alias("_s"))
    changed = changed.join(first.select("contig", "_bin", F.lead("_s").over(bins).alias("_next")), ["contig", "_bin"])
    end = F.coalesce(F.lead("spot").over(inside), "_next")
    return changed.select("contig", F.col("spot").alias("start"), end.alias("end"), "depth").where("depth > 0 and end is not null")


def bedgraph(found: DataFrame, *, longest: int = 10_000_000) -> DataFrame:
    """Runs cut at ``longest`` bases."""
    parts = F.sequence("start", F.col("end") - 1, F.lit(longest).cast("long"))
    return found.withColumn("_s", F.explode(parts)).select("contig", F.col("_s").alias("start"), F.least(F.col("_s") + longest, "end").alias("end"), "depth")


def lookup(points: DataFrame, at: str, found: DataFrame) -> DataFrame:
    """Points with the depth there, 0 outside runs."""
    side = I.Side(found.select(F.col("contig"), F.col("start").alias("_rs"), F.col("end").alias("_re"), "depth"), "contig", "_rs", "_re")
    key = points.columns
    hit = I.point_join(points, "contig", at, side).select(*key, "depth")
    return points.join(hit, key, "left").withColumn("depth", F.coalesce("depth", F.lit(0).cast("long")))


def islands(found: DataFrame) -> DataFrame:
    """Covered stretches: runs that touch, joined."""
    return I.merged(found.select("contig", "start", "end"), "contig", "start", "end").drop("n")


def usable(base_q: int, map_q: int) -> Column:
    return (F.col("base_q") >= base_q) & (F.col("map_q") >= map_q) & ~F.col("is_del")


def capped(pile: DataFrame, most: int, *, tie: Sequence[str] | None = None) -> DataFrame:
    """Up to ``most`` reads of a sample at a place, those that a hash picks."""
    order = [*tie] if tie else [F.xxhash64("read_no", "ord"), "read_no", "ord"]
    w = Window.partitionBy("sample", "contig", "pos").orderBy(*order)
    return pile.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def symbol() -> Column:
    """A read's mark at a place: ``.`` or ``,`` where it agrees (by strand), else its base by case, ``*`` for a deletion;
    ``^`` and the mapping quality before the first base, ``$`` after the last, and the length of an indel that follows."""
    agrees = F.when(F.col("reverse"), ",").otherwise(".")
    base = F.when(F.col("is_del"), "*").when(F.col("base") == F.col("ref"), agrees).when(F.col("reverse"), F.lower("base")).otherwise(F.col("base"))
    first = F.when(F.col("qpos") == 0, F.concat(F.lit("^"), F.char(F.least(F.col("map_q") + 33, F.lit(126))))).otherwise("")
    last = F.when(F.col("qpos") == F.col("read_len") - 1, "$").otherwise("")
    indel = F.when(F.col("indel") > 0, F.concat(F.lit("+"), F.col("indel").cast("string"))).when(F.col("indel") < 0, F.col("indel").cast("string")).otherwise("")
    return F.concat(first, base, indel, last)


def pileup_text(pile: DataFrame) -> DataFrame:
    """One row a place: ``ref``, ``depth``, marks and qualities of its reads in the order of read and row. The caller bounds
    a place's reads (``capped``)."""
    row = F.struct("read_no", "ord", symbol().alias("s"), F.char(F.least(F.col("base_q") + 33, F.lit(126))).alias("q"))
    piled = pile.groupBy("contig", "pos", "ref").agg(F.array_sort(F.collect_list(row)).alias("_r"))
    return piled.select("contig", "pos", "ref", F.size("_r").alias("depth"), F.array_join("_r.s", "").alias("bases"), F.array_join("_r.q", "").alias("quals"))
