"""Column functions on alignment operations: ``array<struct<op: string, len: int>>``.

Operations are those of SAM; a lower-case letter is the same operation walked towards smaller coordinates, and FF, FR, RF
and RR are fusions, whose ``len`` is the coordinate where the alignment goes on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORWARD, BACKWARD = ("M", "N", "D"), ("m", "n", "d")
FUSIONS = ("FF", "FR", "RF", "RR")
OPS = "array<struct<op:string,len:int>>"


def parse(text: Column, max_intron: int = 500_000) -> Column:
    """Operations of CIGAR text; ``=`` and ``X`` become ``M``. Null where the text is malformed, an operation has length
    0, or an intron is longer than ``max_intron``."""
    lengths = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)[MIDNSHP=X]"), F.lit(1)), lambda x: x.cast("int"))
    letters = F.transform(F.regexp_extract_all(text, F.lit(r"\d+([MIDNSHP=X])"), F.lit(1)), lambda x: F.when(x.isin("=", "X"), F.lit("M")).otherwise(x))
    ops = F.zip_with(letters, lengths, lambda op, n: F.struct(op.alias("op"), n.alias("len")))
    whole = text.rlike(r"^(\d+[MIDNSHP=X])+$")
    return F.when(whole & F.forall(ops, lambda x: (x["len"] > 0) & ~((x["op"] == "N") & (x["len"] > max_intron))), ops)


def to_text(ops: Column) -> Column:
    """CIGAR text; fusions print as ``F``."""
    return F.array_join(F.transform(ops, lambda x: F.concat(x["len"].cast("string"), F.when(x["op"].isin(*FUSIONS), F.lit("F")).otherwise(x["op"]))), "")


def _total(ops: Column, *letters: str) -> Column:
    return F.aggregate(F.filter(ops, lambda x: x["op"].isin(*letters)), F.lit(0).cast("long"), lambda a, x: a + x["len"])


def walk(left: Column, ops: Column) -> Column:
    """Each operation with the half-open reference range [``start``, ``end``) that it covers and ``part``, the number of
    fusions before it."""
    item = "struct<op:string,len:int,start:bigint,end:bigint,part:int>"
    zero = F.struct(left.cast("long").alias("at"), F.lit(0).alias("part"), F.array().cast(f"array<{item}>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        after = F.when(x["op"].isin(*FORWARD), a["at"] + x["len"]).when(x["op"].isin(*BACKWARD), a["at"] - x["len"]).when(x["op"].isin(*FUSIONS), x["len"].cast("long")).otherwise(a["at"])
        part = a["part"] + x["op"].isin(*FUSIONS).cast("int")
        moved = ~x["op"].isin(*FUSIONS)
        low, high = F.when(moved, F.least(a["at"], after)).otherwise(after), F.when(moved, F.greatest(a["at"], after)).otherwise(after)
        row = F.struct(x["op"].alias("op"), x["len"].alias("len"), low.alias("start"), high.alias("end"), part.alias("part"))
        return F.struct(after.alias("at"), part.alias("part"), F.concat(a["out"], F.array(row)).alias("out"))

    return F.aggregate(ops, zero, step, lambda a: a["out"])


def right_end(left: Column, ops: Column) -> Column:
    """Exclusive end of the walk; a fusion starts it anew at its coordinate."""
    return F.aggregate(
        ops, left.cast("long"),
        lambda a, x: F.when(x["op"].isin(*FORWARD), a + x["len"]).when(x["op"].isin(*BACKWARD), a - x["len"]).when(x["op"].isin(*FUSIONS), x["len"].cast("long")).otherwise(a),
    )


def read_length(ops: Column) -> Column:
    return _total(ops, "M", "m", "I", "i", "S")


def gap_length(ops: Column) -> Column:
    return _total(ops, "I", "i", "D", "d")


def aligned_length(ops: Column) -> Column:
    return _total(ops, "M", "m", "I", "i")


def is_spliced(ops: Column) -> Column:
    return F.exists(ops, lambda x: x["op"].isin("N", "n"))


def is_contiguous(ops: Column) -> Column:
    return (F.size(ops) == 1) & (F.element_at(ops, 1)["op"] == "M")


def longest_skip(ops: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.filter(ops, lambda x: x["op"].isin("N", "n")), lambda x: x["len"])), F.lit(0))


def gaps(left: Column, ops: Column) -> Column:
    """Introns: array of [``start``, ``end``)."""
    return F.transform(F.filter(walk(left, ops), lambda x: x["op"].isin("N", "n")), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def blocks(left: Column, ops: Column) -> Column:
    """Match blocks: array of [``start``, ``end``) and ``part``."""
    return F.transform(F.filter(walk(left, ops), lambda x: x["op"].isin("M", "m")), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["part"].alias("part")))


def fusion(left: Column, ops: Column) -> Column:
    """First fusion: ``dir``, ``left`` (last base before it) and ``right`` (first base after it), null without one."""
    steps = walk(left, ops)
    at = F.array_position(F.transform(steps, lambda x: x["op"].isin(*FUSIONS)), True).cast("int")
    before, now = F.element_at(steps, at - 1), F.element_at(steps, at)
    last = F.when(before["op"].isin(*BACKWARD), before["start"]).otherwise(before["end"] - 1)
    return F.when(at > 1, F.struct(now["op"].alias("dir"), last.alias("left"), now["start"].alias("right")))


def reverse(ops: Column, at: Column) -> Column:
    """The same alignment read from its other side: operations in reverse, letters in the other case, and a fusion of the
    opposite direction that leads to ``at``, the base where the alignment came from."""
    case = F.translate
    flip = lambda x: F.when(x["op"] == "FF", "RR").when(x["op"] == "RR", "FF").when(x["op"].isin("FR", "RF"), x["op"]).otherwise(case(x["op"], "MNDImndi", "mndiMNDI"))
    return F.transform(F.reverse(ops), lambda x: F.struct(flip(x).alias("op"), F.when(x["op"].isin(*FUSIONS), at.cast("int")).otherwise(x["len"]).alias("len")))


def is_valid(ops: Column, max_insertion: int = 3, max_deletion: int = 3, min_intron: int = 50) -> Column:
    """Starts and ends with a match, has a match on each side of any other operation, and keeps within the limits."""
    match = lambda x: x["op"].isin("M", "m")
    size = F.forall(ops, lambda x: F.when(x["op"].isin("I", "i"), x["len"] <= max_insertion).when(x["op"].isin("D", "d"), x["len"] <= max_deletion).when(x["op"].isin("N", "n"), x["len"] >= min_intron).otherwise(True))
    apart = F.forall(F.zip_with(F.slice(ops, 1, F.greatest(F.size(ops) - 1, F.lit(0))), F.slice(ops, 2, F.greatest(F.size(ops) - 1, F.lit(0))), lambda a, b: match(a) != match(b)), lambda x: x)
    return (F.size(ops) > 0) & match(F.element_at(ops, 1)) & match(F.element_at(ops, -1)) & apart & size


def partials(ops: Column) -> Column:
    """The operations before and after the first fusion: struct ``first``, ``second``; null without one."""
    at = F.array_position(F.transform(ops, lambda x: x["op"].isin(*FUSIONS)), True).cast("int")
    return F.when(at > 0, F.struct(F.slice(ops, F.lit(1), at - 1).alias("first"), F.slice(ops, at + 1, F.size(ops)).alias("second")))
