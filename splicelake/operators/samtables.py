"""Operators on SAM tables: ``qname``, ``flag``, ``rname``, ``pos`` (from 0), ``mapq``, ``cigar``, mate fields, ``rg``, ``ord``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def has(bits: int) -> Column:
    return F.col("flag").bitwiseAND(bits) > 0


def view(sam: DataFrame, *, min_mapq: int = 0, require: int = 0, exclude: int = 0, groups: Sequence[str] = ()) -> DataFrame:
    """Rows by mapping quality, flags that must all be set, flags of which none may be, and read groups; rows without a
    read group pass."""
    rows = sam.where((F.col("mapq") >= min_mapq) & (F.col("flag").bitwiseAND(require) == require) & (F.col("flag").bitwiseAND(exclude) == 0))
    return rows.where(F.col("rg").isNull() | F.col("rg").isin(*groups)) if groups else rows


def subsample(sam: DataFrame, fraction: float, *, seed: int = 0) -> DataFrame:
    """Rows of a share of read names; mates stay together, and a larger share holds a smaller one's rows."""
    return sam.where(F.pmod(F.xxhash64(F.lit(seed), "qname"), F.lit(1 << 20)) < int(fraction * (1 << 20)))


def natural(name: Column, width: int = 12) -> Column:
    """A sort key by which numbers in names compare as numbers."""
    return F.array_join(F.transform(F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1)), lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, width, "0")).otherwise(x)), "")


def sorted_by(sam: DataFrame, by: str = "coordinate") -> DataFrame:
    """Rows sorted over ranges, so each file of a write is a range in order."""
    keys = ["rname", "pos", has(16)] if by == "coordinate" else [natural(F.col("qname")), F.col("flag").bitwiseAND(0xC0)]
    return sam.repartitionByRange(*keys).sortWithinPartitions(*keys)


def idxstats(sam: DataFrame, contigs: DataFrame) -> DataFrame:
    """Mapped and placed unmapped rows of each contig, and a row ``*`` for unplaced ones."""
    per = sam.groupBy("rname").agg(F.count_if(~has(4)).alias("mapped"), F.count_if(has(4)).alias("unmapped"))
    names = contigs.select("rname", "length").unionByName(contigs.sparkSession.createDataFrame([("*", 0)], "rname string, length long"))
    return names.join(per, "rname", "left").fillna(0, ["mapped", "unmapped"])


def flagstat(sam: DataFrame) -> DataFrame:
    """One row for rows that pass quality control and one for those that fail."""
    paired, mapped, mate = has(1), ~has(4), ~has(8)
    other = ~F.col("rnext").isin("=", "*") & (F.col("rnext") != F.col("rname"))
    count = lambda name, test: F.count_if(test).alias(name)
    return sam.groupBy(has(512).alias("failed")).agg(
        F.count(F.lit(1)).alias("total"), count("duplicates", has(1024)), count("mapped", mapped), count("paired", paired), count("read1", paired & has(64)), count("read2", paired & has(128)),
        count("proper", paired & has(2) & mapped), count("both_mapped", paired & mapped & mate), count("singletons", paired & mapped & ~mate),
        count("mate_elsewhere", paired & mapped & mate & other), count("mate_elsewhere_q5", paired & mapped & mate & other & (F.col("mapq") >= 5)),
    )


def rmdup_paired(sam: DataFrame) -> DataFrame:
    """Without duplicate pairs. Pairs on one contig with the same library, contig, place and length of the head read (that of
    positive length) are duplicates; the one of the greatest quality stays, of equal ones the least name. Other rows pass."""
    head = has(1) & ~has(4) & ~has(8) & (F.col("rnext") == "=") & (F.col("tlen") > 0)
    w = Window.partitionBy("rg", "rname", "pos", "tlen").orderBy(F.desc("qual_sum"), "qname", "ord")
    gone = sam.where(head).withColumn("_k", F.row_number().over(w)).where("_k > 1").select("qname").distinct()
    return sam.join(gone, "qname", "left_anti")


def rmdup_single(sam: DataFrame) -> DataFrame:
    """The mapped row of greatest quality at each library, contig, strand and five-prime end."""
    five = F.when(has(16), F.col("rgt")).otherwise(F.col("pos"))
    w = Window.partitionBy("rg", "rname", has(16), five).orderBy(F.desc("qual_sum"), "qname", "ord")
    return sam.where(~has(4)).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def capped_mapq(rows: DataFrame, *, most: int = 40) -> DataFrame:
    """Adds ``cap``, what the mismatches of an alignment leave of a mapping quality of ``most``, or -1 where they leave none.

    ``bases``, ``quals`` (characters from 33) and ``ref`` are of the aligned places without insertions and deletions;
    ``clipped`` is the sum of the qualities of soft-clipped bases and 13 for each hard-clipped one. Bases below quality 13
    and N on either side do not count; those that do are counted again beside the aligned length.
    """
    c = F.col
    letters = lambda name: F.split(F.upper(name), "")
    quals = F.transform(F.split("quals", ""), lambda x: F.ascii(x) - 33)
    places = F.zip_with(F.zip_with(letters("bases"), letters("ref"), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), quals, lambda p, q: F.struct(p["a"].alias("a"), p["b"].alias("b"), q.alias("q")))
    out = rows.withColumn("_good", F.filter(places, lambda x: (x["a"] != "N") & (x["b"] != "N") & (x["q"] >= 13)))
    out = out.withColumn("_bad", F.filter("_good", lambda x: (x["a"] != x["b"]) & (x["a"] != "=")))
    out = out.withColumns({"_n": F.length("bases") + F.size("_good"), "_mm": F.size("_bad"), "_q": F.aggregate("_bad", F.lit(0), lambda acc, x: acc + F.least(x["q"], F.lit(33)))})
    ways = F.when(c("_mm") > 0, F.aggregate(F.sequence(F.lit(1), F.greatest("_mm", F.lit(1))), F.lit(0.0), lambda acc, i: acc + F.ln(c("_n")) - F.ln(i))).otherwise(0.0)
    cost = c("_q") - 4.343 * ways + c("clipped") / 5
    left = F.sqrt((most - F.greatest(cost, F.lit(0.0))) / most) * most + 0.499
    return out.withColumn("cap", F.when(cost > most, -1).otherwise(left.cast("int"))).drop("_good", "_bad", "_n", "_mm", "_q")


def calmd(rows: DataFrame, *, equal: bool = False, most: int | None = None) -> DataFrame:
    """Adds ``nm`` and ``md``, edit distance and mismatch text of an alignment, and ``shown`` and ``shown_quals``, its bases and qualities:
    with ``equal`` bases that match are "=", and where ``nm`` is ``most`` or more they are N, of quality 0.

    ``bases`` and ``ref`` are the two texts of one length, with "-" in ``bases`` where some of ``ref`` are deleted and in ``ref`` where some are
    inserted; ``quals`` (characters from 33) are of the read's own bases. Case does not count, N matches nothing, "=" matches all.
    """
    pairs = F.zip_with(F.split("bases", ""), F.split("ref", ""), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    match = lambda p: ((F.upper(p["a"]) == F.upper(p["b"])) & (F.upper(p["a"]) != "N")) | (p["a"] == "=")
    own = lambda p: F.when(p["a"] == "-", "").when(match(p), "=").otherwise(p["a"])
    other = lambda p: F.when(p["b"] == "-", "").when(match(p), "=").otherwise(F.concat(F.when(p["a"] == "-", "^").otherwise(""), p["b"]))
    out = rows.withColumn("_pairs", F.filter(pairs, lambda p: p["a"] != ""))  # an empty text is split into one
    out = out.withColumns({"_own": F.array_join(F.transform("_pairs", own), ""), "_other": F.array_join(F.transform("_pairs", other), ""), "nm": F.size(F.filter("_pairs", lambda p: ~match(p)))})
    same = lambda x: F.length(F.regexp_extract(x, "^=*", 0)).cast("string")
    rest = lambda x: F.concat(F.when(F.contains(x, F.lit("^")), "^").otherwise(""), F.translate(x, "=^", ""))
    steps = F.transform(F.regexp_extract_all("_other", F.lit(r"=*(\^[^=^])+|=*[^=^]"), F.lit(0)), lambda x: F.concat(same(x), rest(x)))
    md = F.concat(F.array_join(steps, ""), F.length(F.regexp_extract("_other", "=*$", 0)).cast("string"))
    plain = F.col("_own") if equal else F.replace("bases", F.lit("-"), F.lit(""))
    gone = F.lit(False) if most is None else F.col("nm") >= most
    quals = F.array_join(F.zip_with(F.split("_own", ""), F.split("quals", ""), lambda x, q: F.when(x == "=", "!").otherwise(q)), "")
    shown = F.when(gone, F.replace("_own", F.lit("="), F.lit("N"))).otherwise(plain)
    return out.withColumns({"md": md, "shown": shown, "shown_quals": F.when(gone, quals).otherwise(F.col("quals"))}).drop("_pairs", "_own", "_other")


def fixmate(sam: DataFrame) -> DataFrame:
    """Mate contig, place, length and flags from the other read of the pair."""
    first = lambda bit: sam.where(has(bit) & ~has(256)).withColumn("_k", F.row_number().over(Window.partitionBy("qname").orderBy("ord"))).where("_k = 1").drop("_k")
    both = first(64).unionByName(first(128)).withColumn("_side", F.col("flag").bitwiseAND(64) > 0)
    other = both.select("qname", (~F.col("_side")).alias("_side"), F.col("rname").alias("m_rname"), F.col("pos").alias("m_pos"), F.col("rgt").alias("m_rgt"), F.col("flag").alias("m_flag"))
    rows = both.join(other, ["qname", "_side"], "left")
    same = F.coalesce(F.col("m_rname") == F.col("rname"), F.lit(False))
    five = F.when(has(16), F.col("rgt")).otherwise(F.col("pos"))
    m_five = F.when(F.col("m_flag").bitwiseAND(16) > 0, F.col("m_rgt")).otherwise(F.col("m_pos"))
    flag = F.col("flag").bitwiseAND(~(8 | 32)) + F.when(F.col("m_flag").isNull() | (F.col("m_flag").bitwiseAND(4) > 0), 8).otherwise(0) + F.when(F.col("m_flag").bitwiseAND(16) > 0, 32).otherwise(0)
    return rows.select("qname", "ord", flag.alias("flag"), F.when(F.col("m_rname").isNull(), "*").when(same, "=").otherwise(F.col("m_rname")).alias("rnext"), F.coalesce("m_pos", F.lit(0).cast("long")).alias("pnext"), F.when(same, m_five - five).otherwise(0).cast("long").alias("tlen"))
