"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

A file set is a folder of two Parquet tables. ``ranks``: an id for each rank, the commonest id first. ``blocks``: runs of
documents in ascending order of doc_id, each with the control bytes (two bits an id: its number of data bytes less one,
four ids a byte, the first in the low bits) and the data bytes (little-endian ranks) of all its ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from splicelake.llm.common import shared_folder, written
from splicelake.llm.tokenizer import encoder

END_ID = 2
#: Ids after which a block ends.
BLOCK_IDS = 1 << 17
BLOCKS = "part int, start_in_part long, doc_ids array<long>, n_tokens array<long>, control binary, data binary"
#: Data bytes of the four ids of each control byte.
WIDTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes."""
    ranks = ranks.astype(np.uint32)
    width = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = width - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    each = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), each[np.arange(4) < width[:, None]].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The first ``n`` ranks. Widths come from a table by control byte."""
    width = WIDTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(width) - width
    held = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]).astype(np.uint32)
    ranks = held[at]
    for k in range(1, int(width.max(initial=1))):
        ranks |= np.where(width > k, held[at + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return ranks


def tokenized(docs: DataFrame, tokenizer: str, *, end_id: int = END_ID) -> DataFrame:
    """``doc_id`` and ``ids``: little-endian unsigned 16-bit where the vocabulary allows, else 32-bit."""
    narrow = encoder(tokenizer).vocabulary <= 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        for batch in batches:
            ids = [x.astype("<u2" if narrow else "<u4").tobytes() for x in words.documents(batch.column(1).to_pylist(), end_id)]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")


def write(docs: DataFrame, tokenizer: str, *, end_id: int = END_ID) -> str:
    """Writes a file set for ``docs`` (``doc_id``, ``text``) into a new folder of the shared one and returns its path.

    Texts are encoded once, into a table. Its id counts, at most one row a vocabulary entry, give the ranks. The table is
    then sorted over ranges of doc_id, and each range becomes a run of blocks.

    Null texts are empty ones and hold the end id alone. Null doc_ids come first. Rows of one doc_id follow one another,
    ordered by their ids. Other columns are left out. An empty table gives an empty file set.
    """
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    dtype = "<u2" if encoder(tokenizer).vocabulary <= 1 << 16 else "<u4"
    held = written(tokenized(docs, tokenizer, end_id=end_id), "tokenized")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype))
            total, more = (found, total) if len(found) > len(total) else (total, found)
            total[: len(more)] += more
        ids = np.flatnonzero(total)
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])

    found = held.select("ids").mapInArrow(counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    commonest = found.toPandas().sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.int64)
    spark.createDataFrame([(i, x) for i, x in enumerate(commonest.tolist())], "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(int(commonest.max(initial=0)) + 1, np.uint32)
    rank_of[commonest] = np.arange(len(commonest))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start = TaskContext.get().partitionId(), 0
        docs_in: list[int | None] = []
        ids: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            nonlocal start
            control, data = encode_ranks(rank_of[np.concatenate(ids)])
            out = pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.array([docs_in], pa.list_(pa.int64())), pa.array([[len(x) for x in ids]], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                ["part", "start_in_part", "doc_ids", "n_tokens", "control", "data"],
            )
            start += sum(map(len, ids))
            docs_in.clear()
            ids.clear()
            return out

        size = 0
        for batch in batches:
            for doc_id, held_ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs_in.append(doc_id)
                ids.append(np.frombuffer(held_ids, dtype))
                if (size := size + len(ids[-1])) >= BLOCK_IDS:
                    yield block()
                    size = 0
        if ids:
            yield block()

    held.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids").mapInArrow(blocks, BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks")
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a document of a file set: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids``
    (little-endian unsigned 32-bit integers).

    A block knows its start within its part; the starts of the parts, one row for each partition that was written, are
    broadcast.
    """
    ranks = spark.read.parquet(f"{path}/ranks").toPandas().sort_values("rank")  # at most the vocabulary
    id_of = ranks["id"].to_numpy(np.uint32)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    size = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    parts = blocks.select("part", size.alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.join(F.broadcast(parts.select("part", before.alias("before"))), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = np.array(row["n_tokens"], np.int64)
                ends = np.cumsum(n)
                ids = id_of[decode_ranks(row["control"], row["data"], int(ends[-1]))].astype("<u4")
                each = [ids[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.record_batch([pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array(each, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    placed = placed.select("doc_ids", (F.col("start_in_part") + F.col("before")).alias("start"), "n_tokens", "control", "data")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
