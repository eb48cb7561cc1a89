"""Mixing sources to target weights by systematic sampling, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splicelake.llm.common import ranked

WEIGHTS, MOST, SEED = (5, 2, 1), 3, 1
#: Cells, by a hash of the key, that split one size class of one source: the highest bits of the key times an odd number.
SALTS, SPREAD = 512, 2654435761


def targets(sizes: DataFrame, *, source: str, size: str, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row a source: ``source``, ``_source_size``, ``_target``.

    Sources in code point order, null last, take ``weights`` in turn and share the whole size in proportion to them. No
    target is above ``most`` times its source's size; what is above is shared again by weight among the rest. That ends
    at one level: target = min(cap, level * weight). With sources in the order of cap / weight, each prefix that might be
    capped gives a level for the rest, and the true level is the greatest of these.

    The windows see one row a source.
    """
    per = sizes.groupBy(source).agg(F.sum(size).alias("_source_size"))
    place = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("_weight", weight).withColumn("_cap", (F.col("_source_size") * F.lit(most)).cast("double"))
    up = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col(source).asc_nulls_last())
    capped = F.coalesce(F.sum("_cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.partitionBy()
    per = per.withColumn("_level", (F.sum("_source_size").over(whole).cast("double") - capped) / left)
    return per.select(source, "_source_size", F.least("_cap", F.max("_level").over(whole) * F.col("_weight")).alias("_target"))


def mix(
    docs: DataFrame, *, key: str = "doc_id", source: str = "source", size: str = "size",
    weights: Sequence[float] = WEIGHTS, most: float = MOST, seed: int = SEED,
) -> DataFrame:
    """``docs`` with ``source_size`` and ``target`` of its source and ``copies``, the times that the mix takes it.

    Systematic sampling: each document of a source expects target / source size copies, so the prefix sum of these before
    the document of rank k is k times that rate. With one random offset added, a hash of ``seed`` and the source, a
    document is emitted once for each integer boundary that its interval crosses: floor or ceiling of the rate, never more
    than ``most`` rounded up. Documents stand in the order of size class (an eighth of a power of two or finer), hashed
    key, size, key. As
    classes follow one another, sampled sizes follow the source's sizes, and the words taken miss the target by little
    more than one large document. The order depends on the rows only, so reruns agree.

    A source with a third of all rows is ranked in cells of (size class, hashed key), with offsets from two levels of counts.

    ``size`` must be a long column. Null and negative sizes count as 0; a source of size 0 gives no copies. Null sources
    form a source. Null keys stand in the cell of their size. Equal rows are sampled as separate rows. The columns ``source_size``,
    ``target`` and ``copies`` are replaced if there; an empty table gives an empty one.
    """
    base = docs.drop("source_size", "target", "copies").withColumns({
        "_mix_size": F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)),
        "_mix_source": F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")),
    })
    spread = F.pmod(F.coalesce(F.col(key).cast("long"), F.col("_mix_size")), F.lit(1 << 31)) * F.lit(SPREAD)
    base = base.withColumn("_mix_salt", F.floor(F.pmod(spread, F.lit(1 << 32)) / F.lit((1 << 32) // SALTS)))
    base = base.withColumn("_mix_class", F.expr("length(bin(_mix_size)) * 8 + shiftright(_mix_size, greatest(length(bin(_mix_size)) - 3, 0))"))
    # "" stands for null and must come last, but targets() orders sources; it gets the real column
    goal = targets(base.select(source, "_mix_size"), source=source, size="_mix_size", weights=weights, most=most)
    goal = goal.select(F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("_mix_source"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"))
    placed = ranked(base, ["_mix_source"], ["_mix_class", "_mix_salt"], ["_mix_size", F.col(key).asc_nulls_first()], "_mix_rank")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_mix_source"))), 1, 12)
    offset = F.conv(digits, 16, 10).cast("double") / 16.0**12
    end = lambda k: F.floor(k.cast("double") * rate + offset)
    placed = placed.join(goal, "_mix_source").withColumn("copies", (end(F.col("_mix_rank") + 1) - end(F.col("_mix_rank"))).cast("long"))
    return placed.drop("_mix_size", "_mix_source", "_mix_salt", "_mix_class", "_mix_rank")


def emit(mixed: DataFrame) -> DataFrame:
    """One row for each copy that the mix takes."""
    return mixed.where("copies > 0").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("_mix_copy")
