"""Interval joins and set operations on half-open intervals, without nested loops."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1000


@dataclass(frozen=True)
class Side:
    """Intervals of a table: the columns of contig, start and exclusive end. Column names of two sides must differ, but for
    those of the contig."""

    rows: DataFrame
    contig: str
    start: str
    end: str


def interval_join(left: Side, right: Side, *, test: Column | None = None, bin_size: int = BIN) -> DataFrame:
    """Pairs of intervals on one contig that overlap and pass ``test``.

    Both sides are sent to the bins that they touch and joined there by equality. A pair that meets in several bins counts
    in the first of them, where the later one of the two starts, so no distinct is needed. A hot contig is spread over its
    bins. Empty and null intervals join nothing.
    """

    def binned(side: Side, contig: str, low: str) -> DataFrame:
        bins = F.sequence(F.floor(F.col(side.start) / bin_size), F.floor((F.col(side.end) - 1) / bin_size))
        rows = side.rows.where(F.col(side.start) < F.col(side.end)).withColumn(contig, F.col(side.contig)).withColumn(low, F.floor(F.col(side.start) / bin_size))
        return rows.withColumn("_bin", F.explode(bins))

    a, b = binned(left, "_contig", "_low_a"), binned(right, "_contig", "_low_b")
    if right.contig in left.rows.columns:
        b = b.drop(right.contig)
    met = a.join(b, ["_contig", "_bin"]).where((F.col(left.start) < F.col(right.end)) & (F.col(right.start) < F.col(left.end)))
    met = met.where(F.col("_bin") == F.greatest("_low_a", "_low_b"))
    if test is not None:
        met = met.where(test)
    return met.drop("_contig", "_bin", "_low_a", "_low_b")


def point_join(points: DataFrame, contig: str, at: str, right: Side, *, bin_size: int = BIN) -> DataFrame:
    """Points and the intervals that hold them. Only intervals are sent to several bins."""
    bins = F.sequence(F.floor(F.col(right.start) / bin_size), F.floor((F.col(right.end) - 1) / bin_size))
    b = right.rows.where(F.col(right.start) < F.col(right.end)).withColumn("_contig", F.col(right.contig)).withColumn("_bin", F.explode(bins))
    if right.contig in points.columns:
        b = b.drop(right.contig)
    a = points.withColumn("_contig", F.col(contig)).withColumn("_bin", F.floor(F.col(at) / bin_size))
    return a.join(b, ["_contig", "_bin"]).where((F.col(right.start) <= F.col(at)) & (F.col(at) < F.col(right.end))).drop("_contig", "_bin")


#: Positions of a bin when a contig's rows are taken in order.
ORDERED_BIN = 1 << 16


def earlier(rows: DataFrame, contig: str, value: Column, name: str) -> DataFrame:
    """``rows``, which have ``_bin``, with ``name``: the greatest ``value`` in earlier bins of the contig, null in the first.

    Bins are summed up first, so the only window over a contig sees one row a bin.
    """
    w = Window.partitionBy(contig).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(contig, "_bin").agg(F.max(value).alias("_far"))
    return rows.join(per.select(contig, "_bin", F.max("_far").over(w).alias(name)), [contig, "_bin"])


def beside(rows: DataFrame, contig: str, at: str, value: Column, name: str, *, before: bool = False) -> DataFrame:
    """``rows`` with ``name``: the ``value`` of the contig's next row (or the one ``before``) in the order of ``value``, which must
    rise with ``at``; null in the last. Of each bin only one value is seen by contig."""
    step = F.lag if before else F.lead
    binned = rows.withColumns({"_bin": F.floor(F.col(at) / ORDERED_BIN), "_value": value})
    inner = step("_value").over(Window.partitionBy(contig, "_bin").orderBy("_value"))
    edge = (F.max if before else F.min)("_value").alias("_edge")
    edges = binned.groupBy(contig, "_bin").agg(edge).select(contig, "_bin", step("_edge").over(Window.partitionBy(contig).orderBy("_bin")).alias("_outer"))
    out = binned.withColumn("_inner", inner).join(edges, [contig, "_bin"])
    return out.withColumn(name, F.coalesce("_inner", "_outer")).drop("_bin", "_value", "_inner", "_outer")


def running(rows: DataFrame, contig: Sequence[str], at: str, order: Sequence[Column | str], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the contig's rows up to this one in an ``order`` that begins with ``at`` and
    has no ties. Bins are summed up first, so no window holds a contig. ``at`` and ``contig`` must not be null."""
    keys = list(contig)
    binned = rows.withColumns({"_bin": F.floor(F.col(at) / ORDERED_BIN), "_value": value})
    totals = binned.groupBy(*keys, "_bin").agg(F.sum("_value").alias("_total"))
    above = F.coalesce(F.sum("_total").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.sum("_value").over(Window.partitionBy(*keys, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = binned.withColumn("_inner", inner).join(totals.select(*keys, "_bin", above.alias("_above")), [*keys, "_bin"])
    return out.withColumn(name, F.col("_inner") + F.col("_above")).drop("_bin", "_value", "_inner", "_above")


def _at_places(rows: DataFrame, contig: str, at: Column, found: DataFrame) -> DataFrame:
    """``rows`` with the columns that ``found`` has for the place ``at`` (``_contig``, ``_at``, once each)."""
    own = rows.withColumns({"_own": F.col(contig), "_spot": at})
    return own.join(found, (F.col("_own") == F.col("_contig")) & (F.col("_spot") == F.col("_at")), "left").drop("_own", "_spot", "_contig", "_at")


def reaching(rows: DataFrame, contig: str, at: Column, right: Side, name: str) -> DataFrame:
    """``rows`` with ``name``: the furthest end of the intervals that start at the place ``at`` or before it; null without one.

    No pairs are made: places and starts with their furthest ends are put in order, in bins.
    """
    spots = rows.select(F.col(contig).alias("_contig"), at.alias("_at")).distinct().withColumn("_end", F.lit(None).cast("long"))
    starts = right.rows.where(F.col(right.start) < F.col(right.end)).select(F.col(right.contig).alias("_contig"), F.col(right.start).alias("_at"), F.col(right.end).cast("long").alias("_end"))
    both = spots.unionByName(starts).where("_contig is not null and _at is not null").groupBy("_contig", "_at").agg(F.max("_end").alias("_end")).withColumn("_bin", F.floor(F.col("_at") / BIN))
    inner = F.max("_end").over(Window.partitionBy("_contig", "_bin").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    found = earlier(both.withColumn("_inner", inner), "_contig", F.col("_end"), "_carry").select("_contig", "_at", F.greatest("_carry", "_inner").alias(name))
    return _at_places(rows, contig, at, found)


def matched(left: Side, right: Side, *, inside: bool = False, how: str = "semi") -> DataFrame:
    """Rows of ``left`` that overlap some interval of ``right``, or lie ``inside`` one; ``how`` "anti": the others. Empty and null
    intervals match nothing. An interval overlaps one if of those that start before its end some end behind its start."""
    at = F.col(left.start) if inside else F.col(left.end) - 1
    met = (F.col("_reach") >= F.col(left.end)) if inside else (F.col("_reach") > F.col(left.start))
    met = F.coalesce(met & (F.col(left.start) < F.col(left.end)), F.lit(False))
    return reaching(left.rows, left.contig, at, right, "_reach").where(met if how == "semi" else ~met).drop("_reach")


def depth_at(points: DataFrame, contig: str, at: str, right: Side, name: str) -> DataFrame:
    """``points`` with ``name``: the intervals that hold them, counted as starts less ends up to the place."""
    rows = right.rows.where(F.col(right.start) < F.col(right.end))
    edge = lambda c, n: F.struct(F.col(c).cast("long").alias("_at"), F.lit(n).cast("long").alias("_n"))
    edges = rows.select(F.col(right.contig).alias("_contig"), F.inline(F.array(edge(right.start, 1), edge(right.end, -1))))
    spots = points.select(F.col(contig).alias("_contig"), F.col(at).cast("long").alias("_at")).distinct().withColumn("_n", F.lit(0).cast("long"))
    both = spots.unionByName(edges).where("_contig is not null and _at is not null").groupBy("_contig", "_at").agg(F.sum("_n").alias("_n"))
    found = running(both, ["_contig"], "_at", ["_at"], F.col("_n"), name).select("_contig", "_at", name)
    return _at_places(points, contig, F.col(at), found).fillna(0, [name])


#: Aligned blocks that intervals are cut into: places of one size in the next, and sizes.
RADIX, LEVELS = 8, 9


def least_over(points: DataFrame, contig: str, at: str, right: Side, value: Column, name: str) -> DataFrame:
    """``points`` with ``name``: the least ``value`` of the intervals that hold them; null without one.

    No pairs are made: an interval is cut into the largest aligned blocks that lie in it, at most 14 of a size but for the
    largest, and each block keeps its least value; a point looks into the one block of each size that holds it.
    """
    low = lambda k: F.ceil(F.col("_s") / RADIX**k)
    high = lambda k: F.floor(F.col("_e") / RADIX**k)
    span = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))

    def blocks(k: int) -> Column:
        whole = span(low(k), high(k))
        if k < LEVELS - 1:
            a, b = low(k + 1), high(k + 1)  # these are in larger blocks
            whole = F.when(a < b, F.concat(span(low(k), RADIX * a), span(RADIX * b, high(k)))).otherwise(whole)
        return F.transform(whole, lambda i: F.struct(F.lit(k).alias("_k"), i.alias("_i")))

    rows = right.rows.where(F.col(right.start) < F.col(right.end)).select(F.col(right.contig).alias("_contig"), F.col(right.start).alias("_s"), F.col(right.end).alias("_e"), value.alias("_v"))
    nodes = rows.select("_contig", "_v", F.inline(F.flatten(F.array(*map(blocks, range(LEVELS)))))).groupBy("_contig", "_k", "_i").agg(F.min("_v").alias("_v"))
    spots = points.select(F.col(contig).alias("_contig"), F.col(at).alias("_at")).distinct()
    asked = spots.select("_contig", "_at", F.inline(F.array(*[F.struct(F.lit(k).alias("_k"), F.floor(F.col("_at") / RADIX**k).alias("_i")) for k in range(LEVELS)])))
    # sizes are guessed from before blocks are made, so they would be broadcast however many there are
    found = asked.join(nodes.hint("merge"), ["_contig", "_k", "_i"]).groupBy("_contig", "_at").agg(F.min("_v").alias(name))
    return _at_places(points, contig, F.col(at), found)


def merged(rows: DataFrame, contig: str, start: str, end: str, *, touching: bool = True) -> DataFrame:
    """Union of intervals: ``contig``, ``start``, ``end`` and ``n``, the rows in each.

    In bins of starts: what reaches into a bin is the furthest end of those before, and an interval that begins nothing new
    belongs to the last start that did. Only bin totals are seen by contig.
    """
    binned = earlier(rows.withColumn("_bin", F.floor(F.col(start) / BIN)), contig, F.col(end), "_carry")
    w = Window.partitionBy(contig, "_bin").orderBy(start, end)
    reach = F.greatest("_carry", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = reach.isNull() | ((F.col(start) > reach) if touching else (F.col(start) >= reach))
    opened = earlier(binned.withColumn("_new", F.when(new, F.col(start))), contig, F.col("_new"), "_open")
    own = F.max("_new").over(w.rangeBetween(Window.unboundedPreceding, 0))  # equal intervals come in any order here
    grouped = opened.withColumn("_island", F.coalesce(own, "_open"))
    return grouped.groupBy(contig, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_island")


def chopped(rows: DataFrame, contig: str, start: str, end: str, cut: tuple[int, int]) -> DataFrame:
    """Intervals less a range: what is left of it and what is right of it."""
    low, high = cut
    left = F.when(F.col(start) < low, F.struct(F.col(start).alias("s"), F.least(F.col(end), F.lit(low).cast("long")).alias("e")))
    right = F.when(F.col(end) > high, F.struct(F.greatest(F.col(start), F.lit(high).cast("long")).alias("s"), F.col(end).alias("e")))
    rest = rows.withColumn("_p", F.explode(F.array_compact(F.array(left, right))))
    return rest.withColumn(start, F.col("_p.s")).withColumn(end, F.col("_p.e")).drop("_p")


def sliced(rows: DataFrame, start: str, end: str, at: int) -> DataFrame:
    """Intervals that hold ``at`` inside become two."""
    whole = F.struct(F.col(start).alias("s"), F.col(end).alias("e"))
    parts = F.array(F.struct(F.col(start).alias("s"), F.lit(at).cast("long").alias("e")), F.struct(F.lit(at).cast("long").alias("s"), F.col(end).alias("e")))
    rest = rows.withColumn("_p", F.explode(F.when((F.col(start) < at) & (F.col(end) > at), parts).otherwise(F.array(whole))))
    return rest.withColumn(start, F.col("_p.s")).withColumn(end, F.col("_p.e")).drop("_p")


def _inside(begin: np.ndarray, end: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each pair of ``low`` and ``high`` the sum of ``n`` of the intervals that begin at ``low`` or later and end at ``high`` or before it.

    In the order of their begins these are all from a place on, which are blocks of sizes that double; each block is in the order of
    its ends, so time grows with intervals times the logarithm of their number.
    """
    order = np.argsort(begin, kind="stable")
    begin, n = begin[order], n[order]
    ends, rank = np.unique(end[order], return_inverse=True)
    top, width = np.searchsorted(ends, high, "right"), len(ends) + 1
    by_end, place = np.argsort(rank, kind="stable"), np.arange(len(begin))
    at, out = np.searchsorted(begin, low, "left"), np.zeros(len(low), np.int64)
    whole = at == 0
    out[whole] = np.concatenate([[0], np.cumsum(n[by_end])])[np.searchsorted(rank[by_end], top[whole], "left")]
    for level in range(len(begin).bit_length()):
        own = np.flatnonzero((at >> level & 1 == 1) & (at < len(begin)))
        block = place >> level
        held = by_end[np.argsort(block[by_end], kind="stable")]
        key, total = block[held] * width + rank[held], np.concatenate([[0], np.cumsum(n[held])])
        first = (at[own] >> level) * width
        out[own] += total[np.searchsorted(key, first + top[own], "left")] - total[np.searchsorted(key, first, "left")]
        at[own] += 1 << level
    return out


def nested(rows: DataFrame, key: str, contig: str, start: str, end: str, name: str) -> DataFrame:
    """``key`` of the intervals that others lie inside, with ``name``: how many those are, over all rows of a ``key``; rows of one key do not count for
    one another. Empty and null intervals and those of a null key neither hold nor lie in others.

    No pairs are made: equal intervals are counted first, those that hold others are sent to the bins they touch, the others to the bin
    they begin in, and each bin is counted for itself, in the order of begins and ends.
    """
    spots = [contig, start, end]
    own = rows.where((F.col(start) < F.col(end)) & F.col(key).isNotNull() & F.col(contig).isNotNull()).groupBy(key, *spots).agg(F.count(F.lit(1)).alias("_m"))
    distinct = own.groupBy(F.col(contig).alias("_c"), F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e")).agg(F.sum("_m").alias("_n"))
    at = lambda c: F.floor(c / BIN)
    outer = distinct.select("_c", "_s", "_e", F.explode(F.sequence(at(F.col("_s")), at(F.col("_e") - 1))).alias("_b"))
    inner = distinct.withColumn("_b", at(F.col("_s")))

    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        column = lambda t, c: t[c].to_numpy()
        n = _inside(*(column(right, c) for c in ("_s", "_e", "_n")), column(left, "_s"), column(left, "_e")) if right.num_rows else np.zeros(left.num_rows, np.int64)
        return left.select(["_c", "_s", "_e"]).append_column("_in", pa.array(n))

    met = outer.groupBy("_c", "_b").cogroup(inner.groupBy("_c", "_b")).applyInArrow(counted, "_c string, _s long, _e long, _in long")
    per = met.groupBy("_c", "_s", "_e").agg(F.sum("_in").alias("_in"))
    # what lies inside of the same key's rows, the row itself if no other
    lists = own.groupBy(key).agg(F.collect_list(F.struct(F.col(contig).alias("c"), F.col(start).alias("s"), F.col(end).alias("e"), F.col("_m").alias("m"))).alias("_x"))
    lies = lambda a, x: (x["c"] == a["c"]) & (x["s"] >= a["s"]) & (x["e"] <= a["e"])
    same = lambda a: F.aggregate(F.filter("_x", lambda x: lies(a, x)), F.lit(0).cast("long"), lambda n, x: n + x["m"])
    each = lists.select(key, F.inline(F.transform("_x", lambda a: F.struct(a["c"].alias("_oc"), a["s"].cast("long").alias("_os"), a["e"].cast("long").alias("_oe"), a["m"].alias("_m"), same(a).alias("_same")))))
    both = each.join(per, (F.col("_oc") == F.col("_c")) & (F.col("_os") == F.col("_s")) & (F.col("_oe") == F.col("_e")))
    return both.groupBy(key).agg(F.sum(F.col("_m") * (F.col("_in") - F.col("_same"))).alias(name)).where(F.col(name) > 0)


def split_at_bounds(side: Side) -> DataFrame:
    """Each interval cut at all starts and ends of its contig that lie inside it."""
    r = side.rows
    bounds = r.select(side.contig, F.explode(F.array(side.start, side.end)).alias("_s")).distinct()
    pieces = beside(bounds, side.contig, "_s", F.col("_s"), "_e").where("_e is not null")
    met = interval_join(side, Side(pieces, side.contig, "_s", "_e"))
    return met.withColumn(side.start, F.col("_s")).withColumn(side.end, F.col("_e")).drop("_s", "_e")


def distance(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Gap between two intervals; 0 if they touch or overlap."""
    return F.greatest(F.lit(0).cast("long"), s2 - e1, s1 - e2)
