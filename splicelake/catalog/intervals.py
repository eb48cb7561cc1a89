"""Interval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.catalog import register
from splicelake.operators import intervals as I
from splicelake.views import Tables

REGIONS = "SELECT o_orderkey, chrom, iv_begin AS r_begin, iv_end AS r_end FROM v_regions"


def left(t: Tables) -> I.Side:
    return I.Side(t.v_intervals, "chrom", "iv_begin", "iv_end")


def right(t: Tables) -> I.Side:
    return I.Side(t.v_regions.withColumnsRenamed({"iv_begin": "r_begin", "iv_end": "r_end"}), "chrom", "r_begin", "r_end")


ON = "v.chrom = r.chrom AND iv_begin < r_end AND r_begin < iv_end"
INSIDE = "v.chrom = r.chrom AND iv_begin >= r_begin AND iv_end <= r_end"


@register("iv_overlap_join", f"SELECT event_id, o_orderkey FROM v_intervals v JOIN ({REGIONS}) r ON {ON}")
def _(t: Tables) -> DataFrame:
    return I.interval_join(left(t), right(t)).select("event_id", "o_orderkey")


@register("iv_contain_join", f"SELECT event_id, o_orderkey FROM v_intervals v JOIN ({REGIONS}) r ON {INSIDE}")
def _(t: Tables) -> DataFrame:
    return I.interval_join(left(t), right(t), test=F.expr("iv_begin >= r_begin and iv_end <= r_end")).select("event_id", "o_orderkey")


@register("iv_exists", f"SELECT event_id FROM v_intervals v WHERE EXISTS (SELECT 1 FROM ({REGIONS}) r WHERE {ON})")
def _(t: Tables) -> DataFrame:
    return I.matched(left(t), right(t)).select("event_id")


@register("iv_remove_overlap", f"SELECT event_id FROM v_intervals v WHERE NOT EXISTS (SELECT 1 FROM ({REGIONS}) r WHERE {ON})")
def _(t: Tables) -> DataFrame:
    return I.matched(left(t), right(t), how="anti").select("event_id")


@register("iv_remove_envelop", f"SELECT event_id FROM v_intervals v WHERE NOT EXISTS (SELECT 1 FROM ({REGIONS}) r WHERE {INSIDE})")
def _(t: Tables) -> DataFrame:
    return I.matched(left(t), right(t), inside=True, how="anti").select("event_id")


@register(
    "iv_chop",
    """SELECT event_id, chrom, iv_begin, least(iv_end, 20000) AS iv_end FROM v_intervals WHERE iv_begin < 20000
    UNION ALL SELECT event_id, chrom, greatest(iv_begin, 20300), iv_end FROM v_intervals WHERE iv_end > 20300""",
)
def _(t: Tables) -> DataFrame:
    return I.chopped(t.v_intervals, "chrom", "iv_begin", "iv_end", (20000, 20300))


@register(
    "iv_slice",
    """SELECT event_id, chrom, iv_begin, CASE WHEN iv_begin < 20000 AND iv_end > 20000 THEN 20000 ELSE iv_end END AS iv_end FROM v_intervals
    UNION ALL SELECT event_id, chrom, CAST(20000 AS BIGINT), iv_end FROM v_intervals WHERE iv_begin < 20000 AND iv_end > 20000""",
)
def _(t: Tables) -> DataFrame:
    return I.sliced(t.v_intervals, "iv_begin", "iv_end", 20000)


@register(
    "iv_split_overlaps",
    """WITH b AS (SELECT chrom, iv_begin AS x FROM v_intervals UNION SELECT chrom, iv_end FROM v_intervals), p AS (SELECT chrom, x AS s, lead(x) OVER (PARTITION BY chrom ORDER BY x) AS e FROM b)
    SELECT event_id, s AS iv_begin, e AS iv_end FROM v_intervals v JOIN p ON p.chrom = v.chrom AND s >= iv_begin AND e <= iv_end""",
)
def _(t: Tables) -> DataFrame:
    return I.split_at_bounds(left(t)).select("event_id", "iv_begin", "iv_end")


@register("iv_nested", "SELECT a.event_id, count(*) AS n_children FROM v_intervals a JOIN v_intervals v ON a.chrom = v.chrom AND a.event_id <> v.event_id AND v.iv_begin >= a.iv_begin AND v.iv_end <= a.iv_end GROUP BY a.event_id")
def _(t: Tables) -> DataFrame:
    return I.nested(t.v_intervals, "event_id", "chrom", "iv_begin", "iv_end", "n_children")


A = "SELECT chrom, iv_begin, iv_end FROM v_intervals WHERE event_id % 3 < 2"
B = "SELECT chrom, iv_begin, iv_end FROM v_intervals WHERE event_id % 3 > 0"


def sets(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.v_intervals
    return tuple(rows.where(c).select("chrom", "iv_begin", "iv_end") for c in ("event_id % 3 < 2", "event_id % 3 > 0"))


@register("iv_union", f"{A} UNION {B}")
def _(t: Tables) -> DataFrame:
    a, b = sets(t)
    return a.union(b).distinct()


@register("iv_intersect", f"{A} INTERSECT {B}")
def _(t: Tables) -> DataFrame:
    a, b = sets(t)
    return a.intersect(b)


@register("iv_diff", f"{A} EXCEPT {B}")
def _(t: Tables) -> DataFrame:
    a, b = sets(t)
    return a.subtract(b)


@register("iv_symdiff", f"({A} EXCEPT {B}) UNION ({B} EXCEPT {A})")
def _(t: Tables) -> DataFrame:
    a, b = sets(t)
    return a.subtract(b).union(b.subtract(a))


@register("iv_add", f"{A} UNION SELECT chrom, iv_begin, iv_end FROM v_regions")
def _(t: Tables) -> DataFrame:
    return sets(t)[0].union(t.v_regions.select("chrom", "iv_begin", "iv_end")).distinct()


@register("iv_discard", f"SELECT event_id FROM v_intervals WHERE (chrom, iv_begin, iv_end) NOT IN (SELECT (chrom, iv_begin, iv_end) FROM v_intervals WHERE event_id % 3 = 0)")
def _(t: Tables) -> DataFrame:
    gone = t.v_intervals.where("event_id % 3 = 0").select("chrom", "iv_begin", "iv_end")
    return t.v_intervals.join(gone, ["chrom", "iv_begin", "iv_end"], "left_anti").select("event_id")


@register("iv_member", f"SELECT event_id FROM v_intervals WHERE (chrom, iv_begin, iv_end) IN (SELECT (chrom, iv_begin, iv_end) FROM v_intervals WHERE event_id % 3 = 0)")
def _(t: Tables) -> DataFrame:
    known = t.v_intervals.where("event_id % 3 = 0").select("chrom", "iv_begin", "iv_end").distinct()
    return t.v_intervals.join(known, ["chrom", "iv_begin", "iv_end"], "left_semi").select("event_id")


@register(
    "iv_distance",
    """SELECT event_id, CAST(greatest(0, iv_begin - prev_end, prev_begin - iv_end) AS BIGINT) AS gap FROM (SELECT *, lag(iv_begin) OVER w AS prev_begin, lag(iv_end) OVER w AS prev_end
    FROM v_intervals WINDOW w AS (PARTITION BY chrom ORDER BY iv_begin, iv_end, event_id)) WHERE prev_end IS NOT NULL""",
)
def _(t: Tables) -> DataFrame:
    rows = I.beside(t.v_intervals, "chrom", "iv_begin", F.struct("iv_begin", "iv_end", "event_id"), "_p", before=True).where("_p is not null")
    return rows.select("event_id", I.distance(F.col("_p.iv_begin"), F.col("_p.iv_end"), F.col("iv_begin"), F.col("iv_end")).alias("gap"))


@register("iv_begin_end", "SELECT chrom, min(iv_begin) AS first_begin, max(iv_end) AS last_end FROM v_intervals GROUP BY chrom")
def _(t: Tables) -> DataFrame:
    return t.v_intervals.groupBy("chrom").agg(F.min("iv_begin").alias("first_begin"), F.max("iv_end").alias("last_end"))


MERGED = """WITH m AS (SELECT *, CASE WHEN iv_begin > max(iv_end) OVER (PARTITION BY chrom ORDER BY iv_begin, iv_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM {0}),
  i AS (SELECT *, sum(f) OVER (PARTITION BY chrom ORDER BY iv_begin, iv_end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM m)
  SELECT chrom, min(iv_begin) AS iv_begin, max(iv_end) AS iv_end, count(*) AS n FROM i GROUP BY chrom, g"""


@register("iv_merge", MERGED.format("v_intervals"))
def _(t: Tables) -> DataFrame:
    return I.merged(t.v_intervals, "chrom", "iv_begin", "iv_end")
