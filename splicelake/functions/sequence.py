"""Column functions on base and quality strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC letters in the order of their bit sets (A 1, C 2, G 4, T 8), from none to all.
IUPAC = "XACMGRSVTWYHKDBN"
#: Codes of the standard genetic code, first base slowest, in the order T, C, A, G.
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def revcomp(seq: Column) -> Column:
    """Reverse complement; anything but A, C, G, T becomes N."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGT]", "N"), "ACGT", "TGCA"))


def count(seq: Column, letters: str) -> Column:
    """Characters of ``seq`` among ``letters``."""
    return sum((F.length(seq) - F.length(F.replace(seq, F.lit(c))) for c in letters[1:]), F.length(seq) - F.length(F.replace(seq, F.lit(letters[0]))))


def to_phred33(qual: Column, offset: int = 64) -> Column:
    """Quality text of another offset at offset 33; null if a value is below the range."""
    low, high = offset, 126
    old = "".join(chr(c) for c in range(low, high + 1))
    new = "".join(chr(c - offset + 33) for c in range(low, high + 1))
    return F.when(~qual.rlike(f"[\\x00-\\x{low - 1:02x}]"), F.translate(qual, old, new))


def from_integers(text: Column) -> Column:
    """Quality text of space separated integers; negative ones are 0."""
    return F.array_join(F.transform(F.split(F.trim(text), " +"), lambda x: F.char(F.greatest(x.cast("int"), F.lit(0)) + 33)), "")


def reject_code(seq: Column, *, least: int = 12, color: bool = False) -> Column:
    """Why a read is left out: S short, c first colour unknown, L one base over 90 %, N a tenth or more unknown; else null."""
    n = F.length(seq)
    most = F.greatest(*[count(seq, c) for c in ("0123" if color else "ACGT")])
    code = F.when(n < least, "S")
    if color:
        code = code.when(F.substring(seq, 2, 1) == "4", "c")
    return code.when(most > 0.9 * n, "L").when(count(seq, "4" if color else "N") >= 0.1 * n, "N")


def hamming(a: Column, b: Column) -> Column:
    """Places where two texts of one length differ."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def to_colors(seq: Column) -> Column:
    """First base, then a colour for each pair of neighbours: the exclusive or of A 0, C 1, G 2, T 3; 4 for other bases."""
    code = lambda x: F.when(x == "A", 0).when(x == "C", 1).when(x == "G", 2).when(x == "T", 3)
    letters = F.split(seq, "")
    pairs = F.zip_with(F.slice(letters, F.lit(1), F.length(seq) - 1), F.slice(letters, F.lit(2), F.length(seq) - 1), lambda a, b: F.coalesce(code(a).bitwiseXOR(code(b)), F.lit(4)).cast("string"))
    return F.concat(F.substring(seq, 1, 1), F.array_join(pairs, ""))


def from_colors(text: Column) -> Column:
    """Bases of a first base and colours; N from an unknown colour on. The first base is kept."""
    bits = lambda x: F.when(x == "A", 0).when(x == "C", 1).when(x == "G", 2).when(x == "T", 3)
    step = lambda a, x: F.concat(a, F.coalesce(F.get(F.array(*map(F.lit, "ACGT")), bits(F.right(a, F.lit(1))).bitwiseXOR(x.cast("int"))), F.lit("N")))
    return F.aggregate(F.transform(F.split(F.substring(text, 2, 1 << 30), ""), lambda x: F.when(x.isin("0", "1", "2", "3"), x)), F.substring(text, 1, 1), step)


def iupac_bits(letter: Column) -> Column:
    """Bit set of an IUPAC letter in either case, null for others."""
    return F.element_at(F.create_map(*[x for i, c in enumerate(IUPAC) for x in (F.lit(c), F.lit(i))]), F.upper(letter))


def iupac_letter(bits: Column) -> Column:
    return F.get(F.array(*map(F.lit, IUPAC)), bits)


def translate(seq: Column) -> Column:
    """Protein of a coding sequence; codons with other letters are X, bases beyond the last whole codon are left out."""
    table = F.create_map(*[x for i, c in enumerate(AMINO) for x in (F.lit("".join("TCAG"[i >> s & 3] for s in (4, 2, 0))), F.lit(c))])
    starts = F.when(F.length(seq) >= 3, F.sequence(F.lit(1), F.length(seq) - 2, F.lit(3))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(starts, lambda i: F.coalesce(F.element_at(table, F.substring(seq, i, 3)), F.lit("X"))), "")
