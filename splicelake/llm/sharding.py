"""Sharding by rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicelake.llm.common import ranked

#: Cells into which each shard's rows are dealt to be numbered.
SLOT_CELLS = 1024


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard that scores highest for a key: ``-weight / ln(u)``, u in (0, 1) from a hash of key and shard.

    A shard's score depends on no other shard, so a new shard takes keys only into itself and a removed one gives up
    only its own. Shares are in proportion to the weights. Equal scores go to the higher shard.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("shards need positive weights")

    def score(shard: int, weight: float) -> Column:
        unit = (F.shiftrightunsigned(F.xxhash64(F.concat(key, F.lit(f":{shard}"))), 11).cast("double") + 0.5) * 2.0**-53
        return F.struct((-F.lit(float(weight)) / F.log(unit)).alias("score"), F.lit(shard).alias("shard"))

    scores = [score(i, w) for i, w in enumerate(weights)]
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]


def shard(
    docs: DataFrame, weights: Sequence[float], *, key: str = "doc_id", out: str = "shard", grown: str | None = None,
    grown_weight: float = 1.0, slot: str | None = None,
) -> DataFrame:
    """``docs`` with its shard under law ``key``: only the record's key and the weights decide.

    ``grown``: a column for the shard once one more shard (of ``grown_weight``) is there. ``slot``: a column that
    numbers a shard's rows from 0 without gaps, in an order that only the keys decide. Rows are numbered within cells
    of a shard and cells are offset by the counts before them, so that no task holds a shard.

    Null keys are one key of their own. Rows with equal keys share a shard and take neighbouring slots. Other columns,
    texts included, pass through whatever they hold; an empty table gives an empty one.
    """
    stable = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    found = docs.withColumn(out, rendezvous(stable, weights))
    if grown:
        found = found.withColumn(grown, rendezvous(stable, [*weights, grown_weight]))
    if slot:
        found = found.withColumn("_shard_hash", F.xxhash64(stable)).withColumn("_shard_cell", F.pmod(F.col("_shard_hash"), F.lit(SLOT_CELLS)))
        found = ranked(found, [out], ["_shard_cell"], ["_shard_hash", key], slot).drop("_shard_hash", "_shard_cell")
    return found
