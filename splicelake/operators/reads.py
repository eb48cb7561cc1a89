"""Preparation of reads and conversions between reads and alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splicelake.functions import sequence as S


def prepared(reads: DataFrame, *, least: int = 12) -> DataFrame:
    """Adds ``trash_code``; ids are given before, so mates stay together."""
    return reads.withColumn("trash_code", S.reject_code(F.col("seq"), least=least))


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """Reads of two files by their number; those beyond the shorter file are unpaired (mate 0)."""
    a = left.select("number", F.col("name").alias("left_name"), F.col("seq").alias("left_seq"))
    b = right.select("number", F.col("name").alias("right_name"), F.col("seq").alias("right_seq"))
    both = F.col("left_seq").isNotNull() & F.col("right_seq").isNotNull()
    return a.join(b, "number", "full").withColumn("mate_state", F.when(both, "paired").otherwise("unpaired"))


def names_agree(a: Column, b: Column, *, most: int = 2) -> Column:
    return (F.length(a) == F.length(b)) & (S.hamming(a, b) <= most)


def read_stats(reads: DataFrame) -> DataFrame:
    """Reads in and out and lengths for each side; too short reads count for no length."""
    long_enough = F.coalesce(F.col("trash_code"), F.lit("")) != "S"
    n = F.when(long_enough, F.length("seq"))
    return reads.groupBy("mate").agg(F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.count(F.lit(1)).alias("reads_in"), F.count_if(F.col("trash_code").isNull()).alias("reads_out"))


def segments(reads: DataFrame, size: int) -> DataFrame:
    """Reads cut into segments: length div ``size`` of them; a rest of min(size - 2, 20) or more is one more, a shorter one
    joins the last. ``segment`` is ``id|offset:number:total``."""
    n = F.length("seq")
    whole = F.floor(n / size).cast("int")
    rest = n - whole * size
    own = (rest >= min(size - 2, 20)) & (whole > 0)
    total = F.greatest(whole + own.cast("int"), F.lit(1))
    cut = reads.withColumn("_total", total).withColumn("num", F.explode(F.sequence(F.lit(0), F.col("_total") - 1)))
    length = F.when(F.col("num") == F.col("_total") - 1, n - F.col("num") * size).otherwise(size)
    return cut.select("read_id", "num", F.col("seq").substr(F.col("num") * size + 1, length).alias("seg_seq"), F.concat(F.col("read_id").cast("string"), F.lit("|"), (F.col("num") * size).cast("string"), F.lit(":"), F.col("num").cast("string"), F.lit(":"), F.col("_total").cast("string")).alias("segment"))


def segment_name(name: Column) -> list[Column]:
    """Read id, offset, number and total of a segment's name; ``/1`` and ``/2`` at its end are left out."""
    pattern = r"^(.*)\|(\d+):(\d+):(\d+)(?:/[12])?$"
    return [F.regexp_extract(name, pattern, k).cast("long").alias(n) for k, n in enumerate(("read_id", "offset", "num", "total"), 1)]


def from_alignments(sam: DataFrame, *, which: str = "unmapped", keep_failed: bool = False) -> DataFrame:
    """Reads of alignments as they were sequenced: ``which`` of unmapped, mapped, all; names get the mate's suffix."""
    flag = lambda bit: F.col("flag").bitwiseAND(bit) > 0
    rows = sam if which == "all" else sam.where(flag(4) if which == "unmapped" else ~flag(4))
    rows = rows if keep_failed else rows.where(~flag(512))
    suffix = F.when(flag(64), "/1").when(flag(128), "/2").otherwise("")
    return rows.select("ord", F.concat("qname", suffix).alias("name"), F.when(flag(16), S.revcomp(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), F.when(flag(16), F.reverse("qual")).otherwise(F.col("qual")).alias("qual"))


def numbered(text: DataFrame, per: int) -> DataFrame:
    """Lines of ``value`` with ``number``, the record of ``per`` lines that each is in, and ``line``, its place there.

    ``text`` has the ``file`` and the ``block`` (first byte of the split) that each line was read from. Lines are numbered
    within their block, after those of the blocks of the file before it; records begin anew with each file, files in the
    order of their names. A block's lines follow one another in a partition, however blocks are packed into partitions. One
    row a block is counted.
    """
    placed = text.select("file", "block", "value", F.monotonically_increasing_id().alias("_id"))
    blocks = placed.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.groupBy("file").agg(F.ceil(F.sum("_n") / per).alias("_records"))
    files = files.select("file", F.coalesce(F.sum("_records").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    blocks = blocks.select("file", "block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")).join(files, "file")
    at = F.col("_before") + F.col("_id") - F.col("_first")
    return placed.join(F.broadcast(blocks), ["file", "block"]).select("file", "value", (F.col("_base") + F.floor(at / per)).alias("number"), (at % per).alias("line"))
