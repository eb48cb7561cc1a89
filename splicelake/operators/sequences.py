"""Sequence tables (``contig``, ``seq``): tiles, fetching, masks, composition."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from splicelake.functions import sequence as S
from splicelake.operators import intervals as I

TILE = 1 << 16


def _cut(seq: Column, size: int) -> Column:
    """The text in pieces of ``size`` characters, in one pass."""
    return F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def _overlapping(seq: Column, size: int, more: int) -> Column:
    """The same, each piece followed by the first ``more`` characters of those after it; ``more`` is at most ``size``."""
    parts = F.array(_cut(seq, size))
    return F.flatten(F.transform(parts, lambda p: F.transform(p, lambda x, i: F.concat(x, F.coalesce(F.substring(F.get(p, i + 1), 1, more), F.lit(""))))))


def tiles(genome: DataFrame, *, size: int = TILE) -> DataFrame:
    """``contig``, ``tile`` and that part of its sequence, in time by the sequence's length."""
    return genome.where(F.length("seq") > 0).select("contig", F.posexplode(_cut(F.col("seq"), size)).alias("tile", "seq"))


def fetch(ranges: DataFrame, tiled: DataFrame, contig: str, start: str, end: str, *, size: int = TILE, out: str = "bases") -> DataFrame:
    """``ranges`` with the bases of [``start``, ``end``), clipped to the contig; ranges outside have none.

    A range goes to the tiles it touches and joins them by number; its pieces are put together in order. Equal ranges are
    fetched once, whatever else their rows hold.
    """
    key = list(dict.fromkeys([contig, start, end]))
    low = F.greatest(F.col(start), F.lit(0))
    wanted = ranges.select(*key).distinct().where((low < F.col(end)) & (F.col(end) > 0)).withColumn("_tile", F.explode(F.sequence(F.floor(low / size), F.floor((F.col(end) - 1) / size))))
    part = tiled.select(F.col("contig").alias("_contig"), F.col("tile").cast("long").alias("_tile"), F.col("seq").alias("_seq"))
    met = wanted.join(part, (F.col(contig) == F.col("_contig")) & (wanted["_tile"] == part["_tile"]))
    begin = F.greatest(low - part["_tile"] * size, F.lit(0))
    piece = F.col("_seq").substr((begin + 1).cast("int"), (F.least(F.col(end) - part["_tile"] * size, F.lit(size)) - begin).cast("int"))
    pieces = met.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list(F.struct(part["_tile"].alias("t"), piece.alias("p"))))["p"], "").alias(out))
    return ranges.join(pieces, key, "left").withColumn(out, F.coalesce(out, F.lit("")))


def words(genome: DataFrame, width: int, *, size: int = 512) -> DataFrame:
    """Every place of a sequence with the ``width`` (up to ``size``) bases from there on: ``contig``, ``at`` (from 0), ``bases``.
    Sequences are cut into long tiles that overlap, dealt out, and cut again, so that long ones take time in proportion to
    their length and do not stay in one task."""
    far = genome.where(F.length("seq") >= width).select("contig", F.posexplode(_overlapping(F.col("seq"), TILE, width - 1)).alias("_t", "_far")).repartition("contig", "_t")
    near = far.select("contig", "_t", F.posexplode(_overlapping(F.col("_far"), size, width - 1)).alias("_u", "_part")).where(F.length("_part") >= width)
    # the last places of a long tile are the first ones of the next
    each = near.select("contig", "_t", "_u", "_part", F.explode(F.sequence(F.lit(0), F.length("_part") - width)).alias("_i")).where(F.col("_u") * size + F.col("_i") < TILE)
    return each.select("contig", (F.col("_t").cast("long") * TILE + F.col("_u") * size + F.col("_i")).alias("at"), F.substr("_part", F.col("_i") + 1, F.lit(width)).alias("bases"))


#: Bases of the words by which stretches of a read are dealt, the parts they are dealt into, and letters that k-mers are counted over.
DEALT_BY, PARTS, LETTERS = 6, 1 << 16, "ACGTN"


def extended(reads: DataFrame, width: int, reach: int) -> DataFrame:
    """The distinct words of ``width`` bases of ``reads`` (``seq``) with up to ``reach`` bases on either side: ``kmer``, ``left_ext``, ``right_ext``.

    A place and its surroundings are dealt by the word of DEALT_BY bases in them that hashes lowest. Neighbouring places mostly share
    it, so stretches of a read are shuffled, not a row a place, and equal rows still meet in one task.
    """
    around = width + 2 * reach - DEALT_BY + 1  # words in the surroundings of a place

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gap = "\0" * (width + reach + DEALT_BY)
        for batch in batches:
            for first in range(0, batch.num_rows, 8192):
                seqs = [x for x in batch.column(0).slice(first, 8192).to_pylist() if x is not None and len(x) >= width]
                if not seqs:
                    continue
                text = gap + gap.join(seqs) + gap
                letters = np.frombuffer(text.encode("latin-1", "replace"), np.uint8).astype(np.uint64)
                sizes = np.fromiter(map(len, seqs), np.int64, len(seqs))
                begins = np.cumsum(sizes + len(gap)) - sizes
                code = np.zeros(len(letters) - DEALT_BY + 1, np.uint64)
                for k in range(DEALT_BY):
                    code = (code << np.uint64(8)) | letters[k : k + len(code)]
                for k in (33, 29):  # scattered
                    code = (code ^ (code >> np.uint64(k))) * np.uint64(0x9E3779B97F4A7C15)
                low = (code >> np.uint64(32)).astype(np.int64)
                own = np.repeat(np.arange(len(seqs)), sizes - width + 1)  # the read of each place
                at = begins[own] + np.arange(len(own)) - np.repeat(np.cumsum(sizes - width + 1) - (sizes - width + 1), sizes - width + 1)
                ends = begins + sizes
                marks = np.zeros(len(low) + 1, np.int64)
                np.add.at(marks, begins, 1)
                np.add.at(marks, np.maximum(ends - DEALT_BY + 1, begins), -1)
                inside = np.cumsum(marks[:-1]) > 0
                low[~inside] = 1 << 32
                step, best = 1, low  # the least of each ``around`` words
                while 2 * step <= around:
                    best = np.minimum(best[:-step], best[step:])
                    step *= 2
                if step < around:
                    best = np.minimum(best[: len(best) - (around - step)], best[around - step :])
                key = best[at - reach]
                new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
                last = np.r_[new[1:], len(key)] - 1
                start = np.maximum(at[new] - reach, begins[own[new]])
                stop = np.minimum(at[last] + width + reach, ends[own[new]])
                pieces = pa.array([text[i:j] for i, j in zip(start.tolist(), stop.tolist(), strict=True)])
                columns = [pa.array((key[new] % PARTS).astype(np.int32)), pieces, pa.array((at[new] - start + 1).astype(np.int32)), pa.array((last - new + 1).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["_part", "_piece", "_i", "_n"])

    # a number of partitions that is given is not reduced by the stretches' few bytes
    dealt = reads.select("seq").mapInArrow(stretches, "_part int, _piece string, _i int, _n int").repartition(int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_part")
    each = dealt.select("_part", "_piece", F.explode(F.sequence(F.col("_i"), F.col("_i") + F.col("_n") - 1)).alias("_i"))
    left = F.substr("_piece", F.greatest(F.col("_i") - reach, F.lit(1)), F.least(F.col("_i") - 1, F.lit(reach)))
    rows = each.select("_part", F.substr("_piece", F.col("_i"), F.lit(width)).alias("kmer"), left.alias("left_ext"), F.substr("_piece", F.col("_i") + width, F.lit(reach)).alias("right_ext"))
    return rows.groupBy("_part", "kmer", "left_ext", "right_ext").agg(F.lit(1)).select("kmer", "left_ext", "right_ext")


def kmer_counts(reads: DataFrame, width: int) -> DataFrame:
    """How often each word of ``width`` (up to 10) bases is in ``reads`` (``seq``, of letters ACGTN): ``kmer`` and ``n``. A task counts in a table of all
    words that there may be."""
    if not 1 <= width <= 10:
        raise ValueError("k-mers have 1 to 10 bases")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(256, 255, np.uint8)
        number[np.frombuffer((LETTERS + "\n").encode(), np.uint8)] = range(len(LETTERS) + 1)
        table = np.zeros(len(LETTERS) ** width, np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, 8192):
                text = "\n".join(x for x in batch.column(0).slice(first, 8192).to_pylist() if x is not None)
                letters = number[np.frombuffer(text.encode(), np.uint8)]
                if (letters == 255).any():
                    raise ValueError(f"a read has letters other than {LETTERS}")
                if len(letters) < width:
                    continue
                places = len(letters) - width + 1
                code, whole = np.zeros(places, np.int32), np.ones(places, bool)
                for k in range(width):
                    x = letters[k : k + places]
                    code = code * len(LETTERS) + x
                    whole &= x < len(LETTERS)
                found, n = np.unique(code[whole], return_counts=True)
                table[found] += n
        found = np.flatnonzero(table)
        for first in range(0, len(found), 1 << 16):
            part = found[first : first + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(table[part])], ["_code", "_n"])

    summed = reads.select("seq").mapInArrow(counts, "_code long, _n long").groupBy("_code").agg(F.sum("_n").alias("n"))
    letter = lambda k: F.substr(F.lit(LETTERS), (F.floor(F.col("_code") / len(LETTERS) ** k) % len(LETTERS) + 1).cast("int"), F.lit(1))
    return summed.select(F.concat(*map(letter, reversed(range(width)))).alias("kmer"), "n")


def letters(genome: DataFrame) -> DataFrame:
    """One row a base: ``contig``, ``pos`` (from 0), ``base``."""
    return genome.where(F.length("seq") > 0).select("contig", F.posexplode(F.split("seq", "")).alias("pos", "base"))


def composition(genome: DataFrame) -> DataFrame:
    """Length, bases, and CpG pairs of each sequence."""
    counts = [S.count(F.col("seq"), c).cast("long").alias(f"n_{c.lower()}") for c in "ACGTN"]
    cpg = ((F.length("seq") - F.length(F.replace("seq", F.lit("CG")))) / 2).cast("long").alias("n_cpg")
    return genome.select("contig", F.length("seq").cast("long").alias("length"), *counts, cpg)


def masked(genome: DataFrame, regions: DataFrame, *, size: int = TILE) -> DataFrame:
    """Tiles with the bases inside regions (``contig``, ``start``, ``end``, disjoint) in lower case."""
    tiled = tiles(genome, size=size).withColumn("_ts", F.col("tile").cast("long") * size).withColumn("_te", F.col("_ts") + F.length("seq"))
    side = I.Side(regions.select("contig", F.col("start").alias("_rs"), F.col("end").alias("_re")), "contig", "_rs", "_re")
    met = I.interval_join(I.Side(tiled.select("contig", "tile", "_ts", "_te"), "contig", "_ts", "_te"), side)
    cut = met.groupBy("contig", "tile").agg(F.array_sort(F.collect_list(F.struct(F.greatest(F.col("_rs") - F.col("_ts"), F.lit(0)).alias("a"), (F.least("_re", "_te") - F.col("_ts")).alias("b")))).alias("_cut"))

    def lower(a: Column, x: Column) -> Column:
        before, inside = F.substr(F.col("seq"), a["at"] + 1, x["a"] - a["at"]), F.substr(F.col("seq"), x["a"] + 1, x["b"] - x["a"])
        return F.struct(F.concat(a["out"], before, F.lower(inside)).alias("out"), x["b"].alias("at"))

    ended = F.aggregate("_cut", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), lower, lambda a: F.concat(a["out"], F.substr(F.col("seq"), a["at"] + 1)))
    return tiled.join(cut, ["contig", "tile"], "left").select("contig", "tile", F.when(F.col("_cut").isNull(), F.col("seq")).otherwise(ended).alias("seq"))


def merge_iupac(a: Column, b: Column, *, how: str = "union") -> Column:
    """Two sequences of one length as one: union or intersection of the sets that their letters stand for; lower case
    where either is."""
    def one(x: Column, y: Column) -> Column:
        p, q = S.iupac_bits(x), S.iupac_bits(y)
        letter = S.iupac_letter(p.bitwiseOR(q) if how == "union" else p.bitwiseAND(q))
        return F.when((x != F.upper(x)) | (y != F.upper(y)), F.lower(letter)).otherwise(letter)

    return F.array_join(F.zip_with(F.split(a, ""), F.split(b, ""), one), "")


def apply_mask(seq: Column, mask: Column) -> Column:
    """Lower case where the mask has ``x``, as it is where ``X``, else the mask's letter."""
    return F.array_join(F.zip_with(F.split(seq, ""), F.split(mask, ""), lambda s, m: F.when(m == "x", F.lower(s)).when(m == "X", s).otherwise(m)), "")


def mutated(genome: DataFrame, changes: DataFrame, *, size: int = TILE) -> DataFrame:
    """Tiles of sequences with bases set at places: ``changes`` has ``contig``, ``pos`` (from 0) and ``base``, once a place.
    Changes meet the tile that they are in; a tile has ``size`` of them at most."""
    tile = F.floor(F.col("pos") / size).cast("int").alias("tile")
    per = changes.where("pos >= 0").groupBy("contig", tile).agg(F.map_from_entries(F.collect_list(F.struct((F.col("pos") % size).cast("int").alias("at"), "base"))).alias("_m"))
    new = F.array_join(F.transform(F.split("seq", ""), lambda x, i: F.coalesce(F.element_at("_m", i), x)), "")
    return tiles(genome, size=size).join(per, ["contig", "tile"], "left").select("contig", "tile", F.when(F.col("_m").isNull(), F.col("seq")).otherwise(new).alias("seq"))


def windows(contigs: DataFrame, size: int) -> DataFrame:
    """Equal windows; a rest of a tenth of the size or less joins the last one. ``length`` gives each contig's."""
    n = F.greatest(F.ceil((F.col("length") - 0.1 * size) / size), F.lit(1)).cast("long")
    cut = contigs.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return cut.select("contig", (F.col("_i") * size).alias("start"), F.when(F.col("_i") == F.col("_n") - 1, F.col("length")).otherwise((F.col("_i") + 1) * size).alias("end"))


def n_runs(genome: DataFrame, *, least: int = 10, size: int = TILE) -> DataFrame:
    """Runs of N of ``least`` bases or more: ``contig``, ``start``, ``end``. Runs are found in each tile; those that touch a
    tile's edge are put together over the tiles."""
    at = F.expr("filter(transform(split(seq, ''), (x, i) -> case when x = 'N' then i end), i -> i is not null)")
    tiled = tiles(genome, size=size).where(F.contains("seq", F.lit("N")))
    each = tiled.select("contig", "tile", F.posexplode(at).alias("_k", "_i")).withColumn("_g", F.col("_i") - F.col("_k"))  # places rise
    runs = each.groupBy("contig", "tile", "_g").agg((F.col("tile").cast("long") * size + F.min("_i")).alias("start"), (F.col("tile").cast("long") * size + F.max("_i") + 1).alias("end"))
    edge = (F.col("start") % size == 0) | (F.col("end") % size == 0)
    joined = I.merged(runs.where(edge).select("contig", "start", "end"), "contig", "start", "end")
    return runs.where(~edge).select("contig", "start", "end").unionByName(joined.select("contig", "start", "end")).where(F.col("end") - F.col("start") >= least)


def scored_cuts(runs: list[tuple[int, int]], *, least: int, penalty: int) -> list[tuple[int, int]]:
    """Stretches of a sequence that are mostly N, from its ``runs`` of N in order: a stretch ends where its score, one for each
    N less ``penalty`` for each other base, is highest before it falls below 0, and begins where the score backwards from
    there is. Those of ``least`` bases or more are given; the search goes on behind the end of each."""

    def furthest(order: Iterable[tuple[int, int]]) -> int:
        """Of runs as (bases, gap before), how many are gone through up to the highest score."""
        score = best = 0
        at = 0
        for k, (bases, gap) in enumerate(order):
            score -= penalty * gap
            if score < 0:
                break
            score += bases
            if score > best:
                best, at = score, k
        return at

    out, k = [], 0
    while k < len(runs):
        ahead = ((runs[i][1] - runs[i][0], runs[i][0] - runs[i - 1][1] if i > k else 0) for i in range(k, len(runs)))  # as far as it is asked for
        last = k + furthest(ahead)
        back = ((runs[i][1] - runs[i][0], runs[i + 1][0] - runs[i][1] if i < last else 0) for i in range(last, -1, -1))
        first = last - furthest(back)
        if runs[last][1] - runs[first][0] >= least:
            out.append((runs[first][0], runs[last][1]))
        k = last + 1
    return out


def n_stretches(genome: DataFrame, *, least: int = 1000, penalty: int = 10, size: int = TILE) -> DataFrame:
    """``contig``, ``start`` and ``end`` of stretches of ``least`` bases or more that are mostly N (see ``scored_cuts``).

    Runs of N are found in tiles. A gap that outweighs all N of its contig parts it, so that only runs which some stretch
    could join meet in one task, as two numbers each.
    """
    runs = n_runs(genome, least=1, size=size)
    weighed = I.running(runs, ["contig"], "start", ["start"], F.col("end") - F.col("start"), "_n")
    weighed = I.beside(weighed, "contig", "start", F.struct("start", "end"), "_p", before=True)
    totals = runs.groupBy("contig").agg(F.sum(F.col("end") - F.col("start")).alias("_all"))
    own = F.col("end") - F.col("start")
    # neither what lies before the gap nor what lies behind it can pay for it
    parted = penalty * (F.col("start") - F.col("_p.end")) > F.greatest(F.col("_n") - own, F.col("_all") - F.col("_n") + own)
    grouped = weighed.join(totals, "contig").withColumn("_new", F.when(parted, 1).otherwise(0))
    grouped = I.running(grouped.select("contig", "start", "end", "_new"), ["contig"], "start", ["start"], F.col("_new"), "_g")

    @pandas_udf("array<array<bigint>>")
    def cuts(starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([[list(map(int, c)) for c in scored_cuts(list(zip(map(int, s), map(int, e))), least=least, penalty=penalty)] for s, e in zip(starts, ends)])

    held = grouped.groupBy("contig", "_g").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_runs"))
    found = held.select("contig", F.explode(cuts("_runs.start", "_runs.end")).alias("_c"))
    return found.select("contig", F.get("_c", 0).alias("start"), F.get("_c", 1).alias("end"))
