"""Near-duplicate documents by SimHash fingerprints and pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.llm.common import checkpointed, written
from splicelake.llm.graph import components, fresh

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Blocks that a fingerprint is cut into. Pairs at DISTANCE bits or fewer agree in BLOCKS - DISTANCE of them at least.
BLOCKS = 7
#: Fingerprints with equal blocks up to which they are compared with one another.
COMPARED = 2048
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A 64-bit SimHash: a bit is 1 if it is 1 in over half the XXH64 hashes of the text's shingles, repeats included.

    Words are lower-cased (A-Z) and end at ASCII white space; shingles are joined by single spaces; fewer words than a
    shingle are one shingle; no words, zero.
    """
    words = (text or "").encode().translate(_FOLD).split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begin = [0, *ends[: n - 1].tolist()]
    h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begin, (ends[-n:] - 1).tolist(), strict=True)), np.uint64, n)
    ones = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``_fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "_fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, _fp long")


def _masks(blocks: int, distance: int) -> list[int]:
    """For each choice of blocks that may be the equal ones, a mask of their bits."""
    edges = np.linspace(0, 64, blocks + 1).round().astype(int).tolist()
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(block, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _grouped(prints: np.ndarray, nodes: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Links that join exactly what pairs at ``distance`` or less join."""
    left_prints, left_nodes = prints, nodes
    while len(left_prints) > 1:
        root, frontier = int(left_nodes[0]), [left_prints[0]]
        left_prints, left_nodes = left_prints[1:], left_nodes[1:]
        while frontier and len(left_prints):
            near = np.bitwise_count(left_prints ^ frontier.pop()) <= distance
            if near.any():
                yield from ((n, root) for n in left_nodes[near].tolist())
                frontier += list(left_prints[near])
                left_prints, left_nodes = left_prints[~near], left_nodes[~near]


def links(prints: DataFrame, *, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """``a`` and ``b``: links among the nodes of ``prints`` (``_fp``, distinct, and ``_node``) that connect exactly the
    nodes which chains of pairs at ``distance`` bits or fewer connect.

    Each fingerprint is sent to one key for every choice of blocks - distance blocks. With 7 blocks and distance 4 a key
    has 27 bits, so chance meetings stay few. Rows of a key come sorted to one task as a stream; up to 2048 are compared
    bit by bit and their links given as stars, not as pairs. Fingerprints of larger keys pass on: two of them at distance
    4 have a midpoint at distance 2 of both, so each is sent to the 2081 midpoints about it and joined to the least node
    of each. A midpoint has 2081 fingerprints about it at most, so no group is unbounded and no link is lost. Likewise
    for any even distance.
    """
    if distance % 2:
        raise ValueError("an even distance is needed, so that pairs have midpoints")
    masks = _masks(blocks, distance)
    keyed = prints.select("_fp", "_node", F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("_fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(masks)])).alias("_k")).select("_k.*", "_fp", "_node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, large = None, False
        held = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            choice, bits, prints, nodes = (c.to_numpy() for c in batch.columns)
            prints = prints.view(np.uint64)
            out: list[tuple[int, int]] = []
            passed: list[np.ndarray] = []
            new = np.flatnonzero((np.diff(choice) != 0) | (np.diff(bits) != 0)) + 1
            for a, b in zip([0, *new.tolist()], [*new.tolist(), len(bits)], strict=True):
                if (choice[a], bits[a]) != key:
                    if len(held[0]) > 1:
                        out += _grouped(*held, distance)
                    key, large, held = (choice[a], bits[a]), False, (prints[a:b], nodes[a:b])
                else:
                    held = np.concatenate([held[0], prints[a:b]]), np.concatenate([held[1], nodes[a:b]])
                if large or len(held[0]) > COMPARED:
                    passed.append(np.stack([held[1], held[0].view(np.int64)], 1))
                    large, held = True, (held[0][:0], held[1][:0])
            yield _links_batch(out, passed)
        yield _links_batch(list(_grouped(*held, distance)), [])

    placed = keyed.repartition("choice", "bits").sortWithinPartitions("choice", "bits", "_node")
    found = checkpointed(placed.mapInArrow(run, "a long, b long, passed boolean"))

    def about(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = _ball(distance // 2)
        for batch in batches:
            nodes, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            step = max(1, (1 << 19) // len(around))
            for at in range(0, len(nodes), step):
                middle = (prints[at : at + step, None] ^ around).ravel().view(np.int64)
                yield pa.record_batch([pa.array(middle), pa.array(np.repeat(nodes[at : at + step], len(around)))], ["middle", "node"])

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle_now = root = None
        for batch in batches:
            middle, node = (c.to_numpy() for c in batch.columns)
            new = np.flatnonzero(np.concatenate([[True], np.diff(middle) != 0]))
            roots = node[new]
            if middle[0] == middle_now:
                roots = np.concatenate([[root], roots[1:]])
            each = np.repeat(roots, np.diff(np.append(new, len(middle))))
            middle_now, root = middle[-1], each[-1]
            apart = each != node
            yield pa.record_batch([pa.array(node[apart]), pa.array(each[apart])], ["a", "b"])

    passed = found.where("passed").select("a", "b").distinct().mapInArrow(about, "middle long, node long")
    more = passed.repartition("middle").sortWithinPartitions("middle", "node").mapInArrow(star, "a long, b long")
    return found.where("not passed").select("a", "b").unionByName(more)


def _ball(radius: int) -> np.ndarray:
    """All words of 64 bits with ``radius`` ones or fewer."""
    bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
    ball = np.zeros(1, np.uint64)
    for _ in range(radius):
        ball = np.unique(np.concatenate([ball, (ball[:, None] ^ bit).ravel()]))
    return ball[np.bitwise_count(ball) <= radius]


def _links_batch(out: list[tuple[int, int]], passed: list[np.ndarray]) -> pa.RecordBatch:
    rows = np.concatenate([np.array(out, np.int64).reshape(-1, 2), *passed])
    flags = np.arange(len(rows)) >= len(out)
    return pa.record_batch([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(flags)], ["a", "b", "passed"])


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id``, the least doc_id that links reach.

    Equal fingerprints are one node, so copies are never paired. Null and empty texts have fingerprint zero and are
    linked like any others. Rows with a null doc_id link nothing themselves and take the component of their fingerprint,
    null if it has no other row. Rows of one doc_id are one node where they are the least of their fingerprint. Other
    columns are left out; an empty table gives an empty one.
    """
    prints = checkpointed(fingerprints(docs, shingle=shingle))
    nodes = checkpointed(prints.groupBy("_fp").agg(F.min("doc_id").alias("_node")))
    found = components(links(nodes.where("_node is not null"), distance=distance, blocks=blocks), "a", "b")
    named = nodes.join(found.withColumnRenamed("node", "_node"), "_node", "left")
    named = named.select(fresh("_fp").alias("_fp"), F.coalesce("root", "_node").alias("component_id"))
    digits = F.lower(F.lpad(F.hex("_fp"), 16, "0"))
    return prints.join(named, "_fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, *, shingle: int = SHINGLE, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the least doc_id, of several the least hash of the text,
    and of equal rows one. Rows with a null doc_id all stay, as nothing names them.

    Groups are of rows, not of doc_ids: rows of one doc_id with unlike texts are in groups of their own. Rows are named by
    their places in a table written for that, so that what stays is decided for each row. Null and empty texts are one
    group; other columns pass through; an empty table gives an empty one.
    """
    columns = docs.columns
    held = written(docs.withColumn("_dedup_row", F.monotonically_increasing_id()), "dedup")
    ours = held.where("doc_id is not null")
    prints = checkpointed(fingerprints(ours.select(F.col("_dedup_row").alias("doc_id"), "text"), shingle=shingle)).withColumnRenamed("doc_id", "_row")
    nodes = checkpointed(prints.groupBy("_fp").agg(F.min("_row").alias("_node")))
    found = components(links(nodes, distance=distance, blocks=blocks), "a", "b").withColumnRenamed("node", "_node")
    groups = nodes.join(found, "_node", "left").select(fresh("_fp").alias("_fp"), F.coalesce("root", "_node").alias("_group"))
    order = F.struct(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("t"), F.col("_dedup_row").alias("r"))
    named = ours.select(fresh("_dedup_row").alias("_row"), order.alias("_order")).join(prints, "_row").withColumn("_fp", fresh("_fp")).join(groups, "_fp")
    stays = checkpointed(named.groupBy("_group").agg(F.min("_order")["r"].alias("_dedup_row")).select("_dedup_row"))
    return ours.join(stays, "_dedup_row", "left_semi").unionByName(held.where("doc_id is null")).select(*columns)
