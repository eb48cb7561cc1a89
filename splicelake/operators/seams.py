"""Seams between neighbouring segments of a read: small indels, chains merged into alignments, ends placed across introns.

A part is one segment's alignment as it is walked in the read's direction on the genome: struct of ``contig``, ``left`` (first
base), ``back`` (walked towards smaller places), ``ops``, ``mismatches``, ``splice`` (+, - or null) and ``seq`` (the read's bases
in that direction). Chains have ``chain_id`` and ``parts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splicelake.functions import cigar as C
from splicelake.functions.sequence import hamming, revcomp
from splicelake.operators import sequences as Q

#: Bases that a break may lie before or behind the seam of two segments.
BEFORE, BEHIND = 3, 4
#: Bases of the genome that are looked at on either side of a seam.
AROUND = 12
#: Mismatches of the bases that change sides, from which on a break is not taken.
TOO_MANY = 2


def best_split(text: Column, left: Column, right: Column) -> Column:
    """Where a text of n letters is best cut so that what is before agrees with ``left`` and the rest with ``right``, both of n
    letters too: struct ``at`` (1 to n - 1, the first of equal ones) and ``errors``. N agrees with nothing."""
    letters = lambda x: F.split(x, "")
    wrong = lambda a, b: ((a != b) | (a == "N") | (b == "N")).cast("int")
    before, after = F.zip_with(letters(text), letters(left), wrong), F.zip_with(letters(text), letters(right), wrong)
    all_after = F.aggregate(after, F.lit(0), lambda a, x: a + x)
    zero = F.struct(all_after.alias("run"), F.lit(0).alias("i"), F.lit(0).alias("at"), F.lit(1 << 30).alias("errors"))

    def step(a: Column, x: Column) -> Column:
        run, i = a["run"] + x, a["i"] + 1
        better = run < a["errors"]
        return F.struct(run.alias("run"), i.alias("i"), F.when(better, i).otherwise(a["at"]).alias("at"), F.when(better, run).otherwise(a["errors"]).alias("errors"))

    n = F.length(text)
    gained = F.slice(F.zip_with(before, after, lambda a, b: a - b), F.lit(1), F.greatest(n - 1, F.lit(0)))
    return F.aggregate(gained, zero, step, lambda a: F.struct(a["at"].alias("at"), a["errors"].alias("errors")))


def small_indels(pairs: DataFrame, tiled: DataFrame, *, size: int, max_insertion: int = 3, max_deletion: int = 3) -> DataFrame:
    """Insertions and deletions that neighbouring segments one to three bases too close or too far apart show, with their
    ``support``: ``contig``, ``left`` (last base before it), ``right`` (first base after it), ``bases`` (inserted, else empty).

    ``pairs`` has ``contig``, ``left`` (of the segment first on the genome), ``right`` (end of the other), ``bases`` (the read's
    bases of both, in the genome's direction) and ``edits`` (edit distances of both). The one place of the indel that leaves
    least mismatches is taken, the first of equal ones; the pair counts only if they are fewer than ``edits``.
    """
    n = F.length("bases")
    off = (F.col("right") - F.col("left") - n).cast("int")
    near = pairs.withColumns({"_n": n, "_off": off}).where(((off > 0) & (off <= max_deletion)) | ((off < 0) & (off >= -max_insertion))).where("left >= 0 and right - _n >= 0")
    spans = near.select("contig", "left", "right").distinct()
    spans = Q.fetch(spans, tiled, "contig", "left", "right", size=size, out="_ref").where(F.length("_ref") == F.col("right") - F.col("left"))
    met = near.join(spans, ["contig", "left", "right"])
    gone = F.col("_off") > 0
    text, short = F.when(gone, F.col("bases")).otherwise(F.col("_ref")), F.when(gone, F.col("_ref")).otherwise(F.col("bases"))
    by = F.abs("_off")
    first, last = F.substr(short, F.lit(1), F.length(text)), F.substr(short, by + 1, F.length(text))
    found = met.withColumn("_cut", best_split(text, first, last)).where(F.col("_cut.errors") < F.col("edits"))
    left = F.col("left") + F.col("_cut.at") - 1
    rows = found.select("contig", left.alias("left"), F.when(gone, left + by + 1).otherwise(left + 1).alias("right"), F.when(gone, "").otherwise(F.substr("bases", F.col("_cut.at") + 1, by)).alias("bases"))
    return rows.groupBy("contig", "left", "right", "bases").agg(F.count(F.lit(1)).alias("support"))


def _windows(seams: DataFrame, tiled: DataFrame, size: int) -> DataFrame:
    """``seams`` with ``_a1`` and ``_a2``: the genome about the end of the first part and the begin of the second, each in its
    part's direction, with the first base after the seam in the middle; N beyond contigs."""
    spans = seams.select(F.inline(F.array(*[F.struct(F.col(f"c{k}").alias("contig"), (F.col(f"p{k}") - AROUND).alias("from"), (F.col(f"p{k}") + AROUND + 1).alias("to")) for k in (1, 2)]))).distinct()
    spans = Q.fetch(spans, tiled, "contig", "from", "to", size=size, out="bases")
    missing = F.least(F.greatest(-F.col("from"), F.lit(0)), F.col("to") - F.col("from")).cast("int")
    spans = spans.select("contig", "from", F.rpad(F.concat(F.repeat(F.lit("N"), missing), "bases"), 2 * AROUND + 1, "N").alias("bases"))
    for k in (1, 2):
        one = spans.select(F.col("contig").alias(f"c{k}"), (F.col("from") + AROUND).alias(f"p{k}"), F.col("bases").alias("_b"))
        seams = seams.join(one, [f"c{k}", f"p{k}"]).withColumn(f"_a{k}", F.when(F.col(f"back{k}"), revcomp(F.substr("_b", F.lit(2), F.lit(2 * AROUND)))).otherwise(F.substr("_b", F.lit(1), F.lit(2 * AROUND)))).drop("_b")
    return seams


def _seams(chains: DataFrame) -> DataFrame:
    """One row a pair of neighbouring parts: the next place ``p1`` of the first and the first place ``p2`` of the second, and
    what is matched on either side."""
    pairs = F.zip_with(F.slice("parts", F.lit(1), F.size("parts") - 1), F.slice("parts", F.lit(2), F.size("parts") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = chains.where(F.size("parts") > 1).select("chain_id", F.posexplode(pairs).alias("seam", "_p"))
    matched = lambda ops, k: F.when(F.element_at(ops, k)["op"].isin("M", "m"), F.element_at(ops, k)["len"]).otherwise(0)
    rows = rows.select(
        "chain_id", "seam", F.col("_p.a.contig").alias("c1"), F.col("_p.b.contig").alias("c2"), F.col("_p.a.back").alias("back1"), F.col("_p.b.back").alias("back2"), C.right_end(F.col("_p.a.left"), F.col("_p.a.ops")).alias("p1"),
        F.col("_p.b.left").alias("p2"), matched(F.col("_p.a.ops"), -1).alias("room1"), matched(F.col("_p.b.ops"), 1).alias("room2"), F.right(F.col("_p.a.seq"), F.lit(AROUND)).alias("s1"), F.substring(F.col("_p.b.seq"), 1, AROUND).alias("s2"),
    )
    same = (F.col("c1") == F.col("c2")) & (F.col("back1") == F.col("back2"))
    return rows.withColumn("gap", F.when(same, F.when(F.col("back1"), F.col("p1") - F.col("p2")).otherwise(F.col("p2") - F.col("p1"))))


def _across(seams: DataFrame, breaks: DataFrame, max_deletion: int) -> DataFrame:
    """The break of each seam that lets fewest bases disagree, as ``op``, ``len``, ``grow`` and ``diff``."""
    sign = lambda k: F.when(F.col(f"back{k}"), -1).otherwise(1)
    flipped = breaks.select(F.col("contig2").alias("contig1"), F.col("right").alias("left"), (~F.col("back2")).alias("back1"), F.col("contig1").alias("contig2"), F.col("left").alias("right"), (~F.col("back1")).alias("back2"), "splice")
    both = breaks.select("contig1", "left", "back1", "contig2", "right", "back2", "splice").unionByName(flipped).distinct().select(F.col("contig1").alias("c1"), "left", "back1", F.col("contig2").alias("c2"), "right", "back2", "splice")
    tried = seams.withColumn("d", F.explode(F.sequence(F.lit(-BEFORE), F.lit(BEHIND)))).where((F.col("d") <= F.col("room2")) & (-F.col("d") <= F.col("room1")))
    tried = tried.withColumns({"left": F.col("p1") + sign(1) * (F.col("d") - 1), "right": F.col("p2") + sign(2) * F.col("d")})
    met = tried.join(both, ["c1", "left", "back1", "c2", "right", "back2"])
    n, ahead = F.abs("d"), F.col("d") > 0
    own = F.when(ahead, F.substr("s2", F.lit(1), n)).otherwise(F.right("s1", n))
    part = lambda a: F.when(ahead, F.substr(a, F.lit(AROUND + 1), n)).otherwise(F.substr(a, F.lit(AROUND + 1) - n, n))
    new, old = F.when(ahead, part("_a1")).otherwise(part("_a2")), F.when(ahead, part("_a2")).otherwise(part("_a1"))
    wrong = lambda x: F.when(n == 0, 0).otherwise(hamming(own, x))
    met = met.withColumn("_new", wrong(new)).where(F.col("_new") < TOO_MANY).withColumn("diff", F.col("_new") - wrong(old))
    first = Window.partitionBy("chain_id", "seam").orderBy("diff", F.least("left", "right"), F.greatest("left", "right"), F.asc_nulls_last("splice"))
    met = met.withColumn("_k", F.row_number().over(first)).where("_k = 1")
    side = lambda k: F.when(F.col(f"back{k}"), "R").otherwise("F")
    letter = F.when(F.col("gap") <= max_deletion, "D").otherwise("N")
    plain = F.col("gap").isNotNull() & F.col("_plain")
    op = F.when(plain, F.when(F.col("back1"), F.lower(letter)).otherwise(letter)).otherwise(F.concat(side(1), side(2)))
    length = F.when(plain, F.col("gap")).otherwise(F.col("right")).cast("int")
    strand = F.when(op.isin("N", "n"), F.col("splice"))
    return met.select("chain_id", "seam", op.alias("op"), length.alias("len"), F.col("d").alias("grow1"), (-F.col("d")).alias("grow2"), "diff", strand.alias("splice"))


def _inserted(seams: DataFrame, insertions: DataFrame) -> DataFrame:
    """The insertion of each seam of overlapping parts whose bases the read has, where there is just one."""
    tried = seams.withColumn("left", F.explode(F.sequence(F.col("p1") - 3, F.col("p2") + 4)))
    known = insertions.select(F.col("contig").alias("c1"), "left", "bases", (-F.length("bases")).cast("long").alias("gap")).distinct()
    met = tried.join(known, ["c1", "left", "gap"]).withColumns({"k": (F.col("p1") - F.col("left") - 1).cast("int"), "c": (F.col("left") - F.col("p2") + 1).cast("int"), "n": F.length("bases")})
    met = met.where("k <= room1 and c <= room2")
    zero = F.lit(0)
    k, c = F.greatest("k", zero), F.greatest("c", zero)
    tail, head = F.right("s1", k), F.substr("s2", F.lit(1), c)
    over_k, over_c = F.greatest(k - F.col("n"), zero), F.greatest(c - F.col("n"), zero)
    ref_k, ref_c = F.substr("_a1", F.lit(AROUND + 1) - k, k), F.substr("_a2", F.lit(AROUND + 1), c)
    agrees = (F.substr(tail, F.lit(1), F.least(k, F.col("n"))) == F.substr("bases", F.lit(1), F.least(k, F.col("n")))) & (F.right(head, F.least(c, F.col("n"))) == F.right("bases", F.least(c, F.col("n"))))
    wrong = lambda n, a, b: F.when(n == 0, 0).otherwise(hamming(a, b))
    old = wrong(k, tail, ref_k) + wrong(c, head, ref_c)
    new = wrong(over_k, F.right(tail, over_k), F.substr(ref_k, F.lit(1), over_k)) + wrong(over_c, F.substr(head, F.lit(1), over_c), F.right(ref_c, over_c))
    met = met.where(agrees).withColumns({"diff": new - old, "_many": F.count(F.lit(1)).over(Window.partitionBy("chain_id", "seam"))}).where("_many = 1")
    return met.select("chain_id", "seam", F.lit("I").alias("op"), F.col("n").alias("len"), (-F.col("k")).alias("grow1"), (F.col("k") - F.col("n")).alias("grow2"), "diff", F.lit(None).cast("string").alias("splice"))


def merged(chains: DataFrame, breaks: DataFrame, insertions: DataFrame, tiled: DataFrame, *, size: int, max_insertion: int = 3, max_deletion: int = 3, min_intron: int = 50, max_intron: int = 500_000) -> DataFrame:
    """Chains of parts as one alignment each: ``chain_id``, ``contig``, ``left``, ``ops``, ``mismatches``, ``edit_dist``, ``splice``.

    Parts that follow one another without a gap are put together. A gap is closed by one of the ``breaks`` (``contig1``,
    ``left``, ``back1``, ``contig2``, ``right``, ``back2``, ``splice``: introns and deletions on one contig, both sides forward, and
    fusions) that lies at most 3 bases before or 4 behind the seam on both sides alike: the one that leaves fewest
    mismatches among the bases that change sides, two of which it must not have. Of equal ones the least place counts, then
    strand +. Parts that overlap by up to ``max_insertion`` bases need an insertion (``contig``, ``left``, ``bases``) of that length
    that the read has; where two fit, the chain is given up. Gaps of more than ``max_intron``, other contigs or directions
    are fusions; a chain has one at most. Chains with a seam that nothing closes, with introns of both strands, or with an
    alignment that is not valid are left out. An overlap on a side that is walked backwards is not closed.

    Every candidate meets its seam by equality: a seam tries eight places, so neither dense breaks nor long introns make it
    slower.
    """
    seams = _seams(chains)
    plain = F.col("gap").isNotNull() & (F.col("gap") >= -max_insertion) & ((F.col("gap") <= max_deletion) | ((F.col("gap") >= min_intron) & (F.col("gap") <= max_intron)))
    seams = seams.withColumn("_plain", plain)
    seams = _windows(seams.where("gap is null or gap != 0"), tiled, size).unionByName(seams.where("gap = 0"), allowMissingColumns=True)
    overlap = (F.col("gap") < 0) & F.col("_plain")
    touching = seams.where("gap = 0").select("chain_id", "seam", F.lit(None).cast("string").alias("op"), F.lit(0).alias("len"), F.lit(0).alias("grow1"), F.lit(0).alias("grow2"), F.lit(0).alias("diff"), F.lit(None).cast("string").alias("splice"))
    apart = seams.where(~overlap | F.col("gap").isNull()).where("gap is null or gap != 0")
    closed = touching.unionByName(_across(apart, breaks, max_deletion)).unionByName(_inserted(seams.where(overlap & ~F.col("back1")), insertions))
    per = closed.groupBy("chain_id").agg(F.array_sort(F.collect_list(F.struct("seam", "op", "len", "grow1", "grow2", "diff", "splice"))).alias("_closed"))
    whole = chains.join(per, "chain_id", "left").withColumn("_closed", F.coalesce("_closed", F.array().cast(per.schema["_closed"].dataType)))
    whole = whole.where((F.size("_closed") == F.size("parts") - 1) & (F.size(F.filter("_closed", lambda x: x["op"].isin(*C.FUSIONS))) <= 1))

    grown = lambda x, n: F.struct(x["op"].alias("op"), (x["len"] + n).cast("int").alias("len"))
    drop = lambda ops: F.filter(ops, lambda x: (x["len"] > 0) | x["op"].isin(*C.FUSIONS))

    def put(acc: Column, x: Column) -> Column:
        """One more part behind its seam: the last and the first operation grow or shrink, and equal ones become one."""
        last, first, rest = F.element_at(acc, -1), F.element_at(x["ops"], 1), F.slice(x["ops"], F.lit(2), F.greatest(F.size(x["ops"]) - 1, F.lit(0)))
        body = F.slice(acc, F.lit(1), F.size(acc) - 1)
        joined = F.concat(body, F.array(F.struct(last["op"].alias("op"), (last["len"] + first["len"]).cast("int").alias("len"))), rest)
        between = F.array(F.struct(x["seam"]["op"].alias("op"), x["seam"]["len"].cast("int").alias("len")))
        opened = F.concat(drop(F.concat(body, F.array(grown(last, x["seam"]["grow1"])))), between, drop(F.concat(F.array(grown(first, x["seam"]["grow2"])), rest)))
        return F.when(x["seam"]["op"].isNull() & (last["op"] == first["op"]), joined).when(x["seam"]["op"].isNull(), F.concat(acc, x["ops"])).otherwise(opened)

    following = F.zip_with(F.slice("parts", F.lit(2), F.size("parts") - 1), F.col("_closed"), lambda p, s: F.struct(p["ops"].alias("ops"), s.alias("seam")))
    ops = F.aggregate(following, F.col("parts")[0]["ops"].cast(C.OPS), put)
    strands = F.array_distinct(F.filter(F.concat(F.transform("parts", lambda p: p["splice"]), F.transform("_closed", lambda s: s["splice"])), lambda x: x.isNotNull()))
    wrong = F.aggregate("parts", F.lit(0), lambda a, p: a + p["mismatches"].cast("int")) + F.aggregate("_closed", F.lit(0), lambda a, s: a + s["diff"].cast("int"))
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + C.read_length(p["ops"]))
    out = whole.select("chain_id", F.col("parts")[0]["contig"].alias("contig"), F.col("parts")[0]["left"].alias("left"), ops.alias("ops"), wrong.alias("mismatches"), strands.alias("_s"), length.alias("_n"))
    out = out.where((F.size("_s") <= 1) & (C.read_length(F.col("ops")) == F.col("_n")) & C.is_valid(F.col("ops"), max_insertion, max_deletion, min_intron))
    return out.select("chain_id", "contig", "left", "ops", "mismatches", (F.col("mismatches") + C.gap_length(F.col("ops"))).cast("int").alias("edit_dist"), F.get("_s", 0).alias("splice"))


def realigned(hits: DataFrame, juncs: DataFrame, tiled: DataFrame, *, size: int, most: int = 5) -> DataFrame:
    """``hits`` and, of each, the alignments with its first or last match placed across a known intron, if its edit distance
    is not worse: all columns, each row once.

    Hits have ``read_id``, ``contig``, ``left``, ``ops`` (walked forward), ``edit_dist``, ``splice`` and ``seq``; ``juncs`` have ``contig``,
    ``left``, ``right`` (last and first exon base) and ``splice``. The first match meets introns that end inside it, the last one
    those that begin inside it; an end with more than ``most`` of them stays as it is, and so do hits with a fusion. A new
    alignment has a match on both sides of the intron, begins at 0 or later, ends within the contig, and takes the intron's strand.
    Ends meet introns in bins of their places, so a long intron is met at its one end only.
    """
    columns = ["read_id", "contig", "left", "ops", "edit_dist", "splice", "seq"]
    plain = hits.select(*columns).distinct()
    able = plain.where(~F.exists("ops", lambda x: x["op"].isin(*C.FUSIONS, "m", "n", "d")))
    first, last = F.element_at("ops", 1), F.element_at("ops", -1)
    end = C.right_end(F.col("left"), F.col("ops"))
    ends = F.array(F.struct(F.lit("first").alias("which"), F.col("left").alias("from"), (F.col("left") + first["len"]).alias("to"), first["op"].alias("op")), F.struct(F.lit("last").alias("which"), (end - last["len"]).alias("from"), end.alias("to"), last["op"].alias("op")))
    sides = able.select(*columns, F.inline(ends)).where("op = 'M'").drop("op")
    cell = 256
    sides = sides.withColumn("_b", F.explode(F.sequence(F.floor(F.col("from") / cell), F.floor((F.col("to") - 1) / cell))))
    known = juncs.select("contig", F.col("left").alias("_jl"), F.col("right").alias("_jr"), F.col("splice").alias("_js")).distinct()
    either = F.array(F.struct(F.lit("first").alias("which"), F.col("_jr").alias("_at")), F.struct(F.lit("last").alias("which"), F.col("_jl").alias("_at")))
    known = known.select("contig", "_jl", "_jr", "_js", F.inline(either)).withColumn("_b", F.floor(F.col("_at") / cell))
    # ends of one read's hits with the same place and operations are one end
    met = sides.join(known, ["contig", "which", "_b"]).where("_at >= `from` and _at < `to`")
    met = met.withColumn("_many", F.count(F.lit(1)).over(Window.partitionBy(*columns, "which"))).where(F.col("_many") <= most)
    intron = (F.col("_jr") - F.col("_jl") - 1).cast("int")
    head = F.col("which") == "first"
    new_left = F.when(head, F.col("left") - intron).otherwise(F.col("left"))
    before = F.when(head, F.col("_jl") - new_left + 1).otherwise(F.col("_jl") - F.col("from") + 1).cast("int")
    after = (F.col("to") - F.col("from")).cast("int") - before
    op = lambda name, n: F.struct(F.lit(name).alias("op"), n.alias("len"))
    across = F.array(op("M", before), op("N", intron), op("M", after))
    rest = F.when(head, F.slice("ops", F.lit(2), F.greatest(F.size("ops") - 1, F.lit(0)))).otherwise(F.slice("ops", F.lit(1), F.greatest(F.size("ops") - 1, F.lit(0))))
    new_ops = F.when(head, F.concat(across, rest)).otherwise(F.concat(rest, across))
    tried = met.where((before > 0) & (after > 0) & (new_left >= 0)).select("read_id", "contig", new_left.alias("left"), new_ops.cast(C.OPS).alias("ops"), F.col("edit_dist").alias("_old"), F.col("_js").alias("splice"), "seq").distinct()
    scored = edit_distances(tried, tiled, size=size)
    better = scored.where(F.col("edit_dist") <= F.col("_old")).select(*columns)
    return plain.unionByName(better).distinct()


def edit_distances(hits: DataFrame, tiled: DataFrame, *, size: int) -> DataFrame:
    """Hits that lie within their contig, with ``edit_dist`` counted against the genome: mismatches of match blocks, and inserted
    and deleted bases."""
    blocks = F.filter(F.transform(C.walk(F.col("left"), F.col("ops")), lambda x: x), lambda x: x["op"] == "M")
    offsets = F.aggregate(F.col("ops"), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, x: F.struct((a["at"] + F.when(x["op"].isin("M", "I", "S"), x["len"]).otherwise(0)).cast("int").alias("at"), F.when(x["op"] == "M", F.concat(a["out"], F.array(a["at"]))).otherwise(a["out"]).alias("out")), lambda a: a["out"])
    key = [c for c in hits.columns if c != "edit_dist"]
    each = hits.select(*key).withColumn("_id", F.struct(*key)).withColumns({"_blocks": blocks, "_offsets": offsets})
    parts = each.select("contig", "_id", "seq", F.inline(F.zip_with("_blocks", "_offsets", lambda b, o: F.struct(b["start"].alias("_s"), b["end"].alias("_e"), o.alias("_o")))))
    spans = Q.fetch(parts.select("contig", "_s", "_e").distinct(), tiled, "contig", "_s", "_e", size=size, out="_ref")
    compared = parts.join(spans, ["contig", "_s", "_e"]).withColumn("_own", F.substr("seq", F.col("_o") + 1, (F.col("_e") - F.col("_s")).cast("int")))
    fits = F.length("_ref") == F.col("_e") - F.col("_s")
    per = compared.groupBy("_id").agg(F.sum(F.when(fits, hamming(F.col("_own"), F.col("_ref")))).alias("_wrong"), F.min(fits).alias("_fits")).where("_fits")
    return per.select("_id.*", (F.col("_wrong") + C.gap_length(F.col("_id.ops"))).cast("int").alias("edit_dist"))
