"""Seams between segments: small indels, merged chains, ends placed across introns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.catalog import register
from splicelake.functions import cigar as C
from splicelake.functions.sequence import hamming
from splicelake.operators import seams as M
from splicelake.operators import sequences as Q
from splicelake.views import Tables

TILE = 512
PAIRS = """mm AS (SELECT *, hamming(substr(bases, 1, 25), r1) AS m1, hamming(substr(bases, 26, 25), r2) AS m2, hamming(substr(bases, 51, 25), r3) AS m3 FROM v_planted),
pr AS (SELECT contig, l1 AS l, l2 + 25 AS r, substr(bases, 1, 50) AS b, m1 + m2 AS e FROM mm UNION ALL SELECT contig, l2, l3 + 25, substr(bases, 26, 50), m2 + m3 FROM mm),
pg AS (SELECT pr.*, r - l - 50 AS o, substr(seq, CAST(l + 1 AS INTEGER), CAST(r - l AS INTEGER)) AS g FROM pr JOIN v_genome USING (contig))"""


def genome(t: Tables) -> DataFrame:
    return Q.tiles(t.v_genome, size=TILE)


def planted(t: Tables) -> DataFrame:
    """The planted reads with the mismatches of their segments."""
    wrong = {f"m{k}": hamming(F.substring("bases", 25 * k - 24, 25), F.col(f"r{k}")) for k in (1, 2, 3)}
    return t.v_planted.withColumns(wrong)


def indels(t: Tables) -> DataFrame:
    pair = lambda k: F.struct(F.col(f"l{k}").alias("left"), (F.col(f"l{k + 1}") + 25).alias("right"), F.substring("bases", 25 * k - 24, 50).alias("bases"), (F.col(f"m{k}") + F.col(f"m{k + 1}")).alias("edits"))
    return M.small_indels(planted(t).select("contig", F.inline(F.array(pair(1), pair(2)))), genome(t), size=TILE)


@register(
    "disc_small_del",
    f"""WITH {PAIRS}, s AS (SELECT *, unnest(range(1, 50)) AS i FROM pg WHERE o BETWEEN 1 AND 3),
    c AS (SELECT *, hamming(substr(translate(b, 'N', 'x'), 1, CAST(i AS INTEGER)), substr(g, 1, CAST(i AS INTEGER))) + hamming(substr(translate(b, 'N', 'x'), CAST(i + 1 AS INTEGER)), substr(g, CAST(i + o + 1 AS INTEGER))) AS wrong FROM s),
    w AS (SELECT contig, l, r, b, e, o, min(wrong * 100 + i) AS best FROM c GROUP BY ALL)
    SELECT contig, CAST(l + best % 100 - 1 AS BIGINT) AS l, CAST(l + best % 100 + o AS BIGINT) AS r, count(*) AS support FROM w WHERE best // 100 < e GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    return indels(t).where("bases = ''").select("contig", F.col("left").alias("l"), F.col("right").alias("r"), "support")


@register(
    "disc_small_ins",
    f"""WITH {PAIRS}, s AS (SELECT *, unnest(range(1, 50 + o)) AS i FROM pg WHERE o BETWEEN -3 AND -1),
    c AS (SELECT *, hamming(substr(translate(g, 'N', 'x'), 1, CAST(i AS INTEGER)), substr(b, 1, CAST(i AS INTEGER))) + hamming(substr(translate(g, 'N', 'x'), CAST(i + 1 AS INTEGER)), substr(b, CAST(i - o + 1 AS INTEGER))) AS wrong FROM s),
    w AS (SELECT contig, l, r, b, e, o, min(wrong * 100 + i) AS best FROM c GROUP BY ALL)
    SELECT contig, CAST(l + best % 100 - 1 AS BIGINT) AS l, substr(b, CAST(best % 100 + 1 AS INTEGER), CAST(-o AS INTEGER)) AS inserted, count(*) AS support FROM w WHERE best // 100 < e GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    return indels(t).where("bases != ''").select("contig", F.col("left").alias("l"), F.col("bases").alias("inserted"), "support")


def chains(t: Tables) -> DataFrame:
    part = lambda k: F.struct("contig", F.col(f"l{k}").alias("left"), F.lit(False).alias("back"), F.array(F.struct(F.lit("M").alias("op"), F.lit(25).alias("len"))).alias("ops"), F.col(f"m{k}").alias("mismatches"), F.lit(None).cast("string").alias("splice"), F.substring("bases", 25 * k - 24, 25).alias("seq"))
    return planted(t).select(F.concat_ws(":", "contig", "k").alias("chain_id"), F.array(part(1), part(2), part(3)).alias("parts"))


def introns(t: Tables) -> DataFrame:
    """Planted introns and deletions as breaks."""
    edge = (F.col("a") + 24 + F.col("d")).alias("left")
    strand = F.when(F.col("k") % 2 == 0, "+").otherwise("-").alias("splice")
    rows = t.v_planted.where("kind in ('N', 'D')").select(F.col("contig").alias("contig1"), edge, F.lit(False).alias("back1"), F.col("contig").alias("contig2"), (F.col("a") + 25 + F.col("d") + F.col("n")).alias("right"), F.lit(False).alias("back2"), strand)
    return rows


@register(
    "seg_merge_chain",
    """SELECT contig || ':' || k AS chain_id, contig, a AS l, CASE kind WHEN '=' THEN '75M' WHEN 'I' THEN (25 + d) || 'M' || n || 'I' || (50 - d - n) || 'M' ELSE (25 + d) || 'M' || n || kind || (50 - d) || 'M' END AS cigar,
    CAST(0 AS INTEGER) AS mismatches, CAST(CASE WHEN kind IN ('D', 'I') THEN n ELSE 0 END AS INTEGER) AS edit_dist, CASE WHEN kind = 'N' THEN CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END END AS splice FROM v_planted""",
)
def _(t: Tables) -> DataFrame:
    """Each planted read's segments, merged: the alignment that it was made from."""
    n = F.col("n").cast("int")
    inserted = F.substr(F.lit("TGCATGCA"), (1 + F.col("k") % 4).cast("int"), n)
    insertions = t.v_planted.where("kind = 'I'").select("contig", (F.col("a") + 24 + F.col("d")).alias("left"), inserted.alias("bases"))
    found = M.merged(chains(t), introns(t), insertions, genome(t), size=TILE)
    return found.select("chain_id", "contig", F.col("left").alias("l"), C.to_text(F.col("ops")).alias("cigar"), "mismatches", "edit_dist", "splice")


PLACED = """h AS (SELECT contig || ':' || k AS read_id, contig, a AS l, bases FROM v_planted WHERE kind = 'N' UNION ALL SELECT contig || ':' || k, contig, a + n, bases FROM v_planted WHERE kind = 'N'),
o AS (SELECT h.*, seq, hamming(bases, substr(seq, CAST(l + 1 AS INTEGER), 75)) AS e FROM h JOIN v_genome USING (contig)),
j AS (SELECT contig, a + 24 + d AS jl, a + 25 + d + n AS jr, CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END AS splice FROM v_planted WHERE kind = 'N' UNION SELECT contig, a + 25 + d + k % 3, a + 25 + d + n, '+' FROM v_planted WHERE kind = 'N'),
f AS (SELECT o.*, jl, jr, j.splice, l - (jr - jl - 1) AS nl, jl - l + (jr - jl - 1) + 1 AS b FROM o JOIN j ON o.contig = j.contig AND jr >= l AND jr < l + 75),
g AS (SELECT o.*, jl, jr, j.splice, l AS nl, jl - l + 1 AS b FROM o JOIN j ON o.contig = j.contig AND jl >= l AND jl < l + 75),
t AS (SELECT *, jr - jl - 1 AS n FROM (SELECT * FROM f UNION SELECT * FROM g) WHERE b > 0 AND b < 75 AND nl >= 0 AND nl + 75 + jr - jl - 1 <= length(seq)),
s AS (SELECT *, hamming(substr(bases, 1, CAST(b AS INTEGER)), substr(seq, CAST(nl + 1 AS INTEGER), CAST(b AS INTEGER))) + hamming(substr(bases, CAST(b + 1 AS INTEGER)), substr(seq, CAST(jr + 1 AS INTEGER), CAST(75 - b AS INTEGER))) AS ne FROM t)"""


@register(
    "realign_ends",
    f"""WITH {PLACED} SELECT read_id, contig, CAST(l AS BIGINT) AS l, '75M' AS cigar, CAST(e AS INTEGER) AS edit_dist, NULL AS splice FROM o
    UNION SELECT read_id, contig, CAST(nl AS BIGINT), b || 'M' || n || 'N' || (75 - b) || 'M', CAST(ne AS INTEGER), splice FROM s WHERE ne <= e""",
)
def _(t: Tables) -> DataFrame:
    """Planted reads with introns, placed whole on either exon, against their introns and ones that begin a little later."""
    rows = t.v_planted.where("kind = 'N'")
    ops = F.array(F.struct(F.lit("M").alias("op"), F.lit(75).alias("len"))).alias("ops")
    at = lambda place: rows.select(F.concat_ws(":", "contig", "k").alias("read_id"), "contig", place.alias("left"), ops, F.lit(None).cast("string").alias("splice"), F.col("bases").alias("seq"))
    hits = M.edit_distances(at(F.col("a")).unionByName(at(F.col("a") + F.col("n"))), genome(t), size=TILE)
    own = introns(t).where(F.col("right") - F.col("left") > 10).select(F.col("contig1").alias("contig"), "left", "right", "splice")
    later = rows.select("contig", (F.col("a") + 25 + F.col("d") + F.col("k") % 3).alias("left"), (F.col("a") + 25 + F.col("d") + F.col("n")).alias("right"), F.lit("+").alias("splice"))
    return M.realigned(hits, own.unionByName(later), genome(t), size=TILE).select("read_id", "contig", F.col("left").alias("l"), C.to_text(F.col("ops")).alias("cigar"), "edit_dist", "splice")
