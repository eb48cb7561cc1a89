"""Approximate nearest neighbours by cosine, from randomly rotated one-bit codes with error bounds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splicelake.llm.common import checkpointed, written
from splicelake.llm.graph import fresh

#: Neighbours of a query.
K = 5
#: Bits of a code, at least: rounded up to a multiple of 64 and to the components of a vector.
BITS = 512
#: Standard deviations of an estimate's error that the bounds allow. One true neighbour in some hundreds lies beyond.
DEVIATIONS = 3.0
#: Centres that vectors are coded about, vectors that they are fitted on at most (those that hash lowest), and rounds.
CENTRES, FITTED, ROUNDS = 64, 16_384, 8
#: Bytes of the queries that are broadcast at once.
QUERY_BYTES = 32 << 20
#: Estimates that a task holds at once.
HELD = 1 << 21
SEED = 11


def usable(vector: str) -> Column:
    """Whether the array has a component other than zero and none that is null or not finite."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda c: c != 0), F.lit(False))


def rotation(dim: int, bits: int, seed: int = SEED) -> np.ndarray:
    """A random rotation of ``bits`` dimensions, of which the first ``dim`` columns are used: (bits, dim), orthonormal columns."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dim)))[0].astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, on the vectors as they are; scaled first where squares overflow or vanish."""
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    with np.errstate(over="ignore", invalid="ignore", under="ignore", divide="ignore"):
        aa, bb = dot(a, a), dot(b, b)
        out = dot(a, b) / (np.sqrt(aa) * np.sqrt(bb))
    odd = (np.minimum(aa, bb) < 1e-250) | (np.maximum(aa, bb) > 1e250)
    if odd.any():
        out[odd] = dot(unit(a[odd]), unit(b[odd]))
    return out


def centres(sample: np.ndarray, n: int = CENTRES, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Means of groups of unit vectors."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    found = sample[np.random.default_rng(seed).permutation(len(sample))[: min(n, len(sample))]]
    for _ in range(rounds):
        own = np.argmax(sample @ found.T - (found**2).sum(1) / 2, axis=1)
        sums, sizes = np.zeros_like(found), np.bincount(own, minlength=len(found))
        np.add.at(sums, own, sample)
        found = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], found)
    return found


def encode(x: np.ndarray, middle: np.ndarray, turn: np.ndarray, deviations: float = DEVIATIONS) -> tuple[np.ndarray, ...]:
    """Of vectors: the centre, the packed bits, and the scalars shift, scale and slack.

    With r a unit vector less its centre c, o = r / |r|, s the signs of the rotated o (over the root of their number) and
    a = <s, o>, the estimate of <q, u> is <q, c> + shift + scale * <s, q>, where scale = |r| / a and
    shift = <r, c> - scale * <s, c>. Its error is below slack * |q - c|, but for one case in some hundreds.
    """
    u, bits = unit(x), len(turn)
    own = np.argmax(u @ middle.T - (middle**2).sum(1) / 2, axis=1)
    r = u - middle[own]
    length = np.sqrt((r * r).sum(1))
    turned = (r @ turn.T.astype(np.float64))
    signs = turned > 0
    s = np.where(signs, 1.0, -1.0) / np.sqrt(bits)
    a = np.where(length > 0, (turned * s).sum(1) / np.maximum(length, 1e-300), 1.0)
    scale = length / np.maximum(a, 1e-3)
    shift = (r * middle[own]).sum(1) - scale * (s * (middle @ turn.T.astype(np.float64))[own]).sum(1)
    slack = length * deviations * np.sqrt(np.maximum(1 - a * a, 0) / np.maximum(a * a, 1e-6) / max(bits - 1, 1)) + 1e-5
    return own, np.packbits(signs, axis=1), shift, scale, slack


def neighbours(vectors: DataFrame, is_query: Column, *, id_column: str = "vec_id", vector: str = "embedding", k: int = K, bits: int = BITS, deviations: float = DEVIATIONS) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``: of each row that ``is_query`` the ``k`` other rows of largest
    cosine (all, if fewer), equal ones by ascending id.

    Equal vectors are one: they are coded, searched and compared once, and the rows that hold them are told at the end, so
    copies are not paired. Vectors are coded about one of a few centres, fitted on a bounded sample; every vector is coded.
    Queries are broadcast in blocks of bounded size, and each task reads its share of the codes. An estimate and its error
    bound come from packed bits and scalars; only vectors whose upper bound reaches the k-th best cosine so far are compared
    exactly. Error bounds hold for all but a few in a thousand.

    Rows with a null id, a null, zero or not finite vector take no part; nor do vectors that have another number of
    components than most have (of equally frequent ones the larger counts). Rows equal in id and vector are one; rows that
    share an id only are different candidates, but never neighbours of each other. An empty table gives an empty one. Other
    columns are left out.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asked"))
    rows = rows.where(F.col("id").isNotNull() & usable("v")).select("id", F.transform("v", lambda c: c + F.lit(0.0)).alias("v"), F.coalesce("asked", F.lit(False)).alias("asked"))
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = sizes["dim"] if sizes else 1
    rows = rows.where(F.size("v") == dim)
    # a vector's name is the least id that holds it and a hash of it
    held = rows.groupBy("v").agg(F.min("id").alias("first"), F.max("asked").alias("asked"))
    held = written(held.select(F.monotonically_increasing_id().alias("name"), "v", "first", "asked"), "vectors")
    named = rows.withColumn("_h", F.xxhash64("v")).join(held.select(F.xxhash64("v").alias("_h"), "v", "name"), ["_h", "v"])
    members = checkpointed(named.select("name", "id", "asked").distinct())

    sample = held.select("v").orderBy(F.xxhash64("v")).limit(FITTED).collect()
    middle = centres(unit(np.array([r["v"] for r in sample]).reshape(-1, dim)) if sample else np.zeros((0, dim)))
    n_bits = -(-max(bits, dim) // 64) * 64
    code = spark.sparkContext.broadcast((middle, rotation(dim, n_bits)))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, turn = code.value
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, dim)
            own, packed, *scalars = encode(x, middle, turn, deviations)
            out = [batch.column(0), batch.column(2), pa.array(x.tobytes()[i : i + 8 * dim] for i in range(0, x.nbytes, 8 * dim)), pa.array(own), pa.array([p.tobytes() for p in packed], pa.binary()), *map(pa.array, scalars)]
            yield pa.record_batch(out, _INDEX)

    kinds = ("long", "long", "binary", "long", "binary", "double", "double", "double")
    index = written(held.select("name", "v", "first").mapInArrow(coded, ", ".join(f"{n} {t}" for n, t in zip(_INDEX, kinds, strict=True))), "index")

    asked = held.where("asked")
    blocks = max(1, -(-asked.count() * (8 * dim + 8 * k + 4 * n_bits) // QUERY_BYTES))
    found = []
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == b).select("name", "v").collect()
        if block:
            found.append(checkpointed(_searched(index, np.array([r["name"] for r in block]), np.array([r["v"] for r in block]), code, k + 1, n_bits)))
    near = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query long, name long, first long, score double")

    own_id = members.where("asked").select(fresh("name").alias("query"), F.col("id").alias("query_id"))
    holders = members.select("name", "id").distinct()
    holders = holders.withColumn("_k", F.row_number().over(Window.partitionBy("name").orderBy("id"))).where(F.col("_k") <= k + 1)
    pairs = near.join(holders.select(fresh("name").alias("name"), "id"), "name").select(fresh("query").alias("query"), "id", "score")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    pairs = checkpointed(pairs.withColumn("_k", best).where(F.col("_k") <= k + 1).select("query", "id", "score"))
    pairs = own_id.join(pairs, "query").where("id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


_INDEX = ["name", "first", "v", "centre", "code", "shift", "scale", "slack"]


def _searched(index: DataFrame, names: np.ndarray, queries: np.ndarray, code, k: int, n_bits: int) -> DataFrame:
    """``query``, ``name``, ``first`` and ``score``: the ``k`` best vectors of each query, by cosine, then the least id."""
    dim = queries.shape[1]
    asked = index.sparkSession.sparkContext.broadcast((names, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (names, q), (middle, turn) = asked.value, code.value
        u = unit(q).astype(np.float32)
        turned, to_middle = u @ turn.T / np.float32(np.sqrt(n_bits)), u @ middle.T.astype(np.float32)
        from_middle = np.sqrt(np.maximum(1 + (middle**2).sum(1) - 2 * to_middle, 0)).astype(np.float32)
        least = np.full(len(q), -np.inf)  # the k-th best cosine so far
        kept, of = np.zeros((3, 0), np.int64), np.zeros(0)  # query, first, name; cosine
        for batch in batches:
            name, first, own = (batch.column(i).to_numpy() for i in (0, 1, 3))
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float64).reshape(-1, dim)
            signs = np.unpackbits(np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, n_bits // 8), axis=1).astype(np.float32) * 2 - 1
            shift, scale, slack = (batch.column(i).to_numpy().astype(np.float32) for i in (5, 6, 7))
            step = max(1, HELD // max(len(name), 1))
            for a in range(0, len(q), step):
                part = slice(a, a + step)
                estimate = turned[part] @ signs.T * scale + shift + to_middle[part][:, own]
                error = from_middle[part][:, own] * slack
                floor = estimate - error
                if floor.shape[1] > k:
                    floor = np.partition(floor, -k, axis=1)[:, -k]
                    bar = np.maximum(floor, least[part])
                else:
                    bar = least[part]
                at, row = np.nonzero(estimate + error >= bar[:, None])
                for c in range(0, len(at), 1 << 16):
                    i, r = at[c : c + (1 << 16)] + a, row[c : c + (1 << 16)]
                    exact = cosine(q[i], x[r])
                    good = exact >= least[i]
                    i, r, exact = i[good], r[good], exact[good]
                    kept, of = np.concatenate([kept, np.stack([i, first[r], name[r]])], axis=1), np.concatenate([of, exact])
                    order = np.lexsort((kept[2], kept[1], -of, kept[0]))
                    kept, of = kept[:, order], of[order]
                    begin = np.searchsorted(kept[0], np.arange(len(q) + 1))
                    full = np.flatnonzero(np.diff(begin) >= k)
                    least[full] = of[begin[full] + k - 1]
                    stays = np.arange(kept.shape[1]) - begin[kept[0]] < k
                    kept, of = kept[:, stays], of[stays]
        yield pa.record_batch([pa.array(names[kept[0]]), pa.array(kept[2]), pa.array(kept[1]), pa.array(of)], ["query", "name", "first", "score"])

    each = index.mapInArrow(run, "query long, name long, first long, score double")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "first", "name"))
    return each.withColumn("_k", best).where(F.col("_k") <= k).drop("_k")
