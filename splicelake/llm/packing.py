"""Best-fit packing of documents into sequences of fixed capacity by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from splicelake.llm.common import checkpointed
from splicelake.llm.tokenizer import encoder

CAPACITY, END_ID = 4096, 1
#: Pieces that one task packs. The sequences it leaves part-filled are few against those it fills.
GROUP_ROWS = 65_536
GROUP = "_pack_group"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of each document: its ids, then ``end_id``; cut only where longer than ``capacity``.

    ``docs`` needs ``doc_id`` and ``text``; null texts are empty ones and give the end id alone, null doc_ids pass
    through, repeated rows give repeated pieces, other columns are left out.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.documents(batch.column(1).to_pylist(), end_id), strict=True):
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    doc.append(doc_id)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.astype("<u4").tobytes()))
            yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, placed one by one in the order given.

    Open bins are counted by their level (filled part), which is by their residual gap. An item goes where the sum of the
    squared counts, full bins left out, becomes smallest; of equal choices to the fullest bin.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    chosen, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    n_bins = 0
    for i, s in enumerate(lengths.tolist()):
        if s == capacity:
            chosen[i], n_bins = n_bins, n_bins + 1
            continue
        # level h to level h + s: the squares change by 2 (count[h + s] - count[h] + 1), to a full bin by 1 - 2 count[h]
        change = 2 * (count[s:capacity] - count[: capacity - s] + 1)
        change[0] = 2 * count[s] + 1  # a new bin
        change[1:][count[1 : capacity - s] == 0] = np.iinfo(np.int64).max
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        if count[capacity - s] and 1 - 2 * count[capacity - s] <= change[best]:
            best = capacity - s
        if best:
            bin_id = open_bins[best].pop()
            count[best] -= 1
        else:
            bin_id, n_bins = n_bins, n_bins + 1
        chosen[i], offset[i] = bin_id, best
        if best + s < capacity:
            open_bins[best + s].append(bin_id)
            count[best + s] += 1
    return chosen, offset


def pack(parts: DataFrame, *, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``parts`` (``doc_id``, ``piece``, ``length`` and more) with ``sequence_id`` and ``offset``, which are replaced if there.

    Rows are dealt evenly, whatever their keys, into groups of about ``group_rows``; each group is packed by itself, the
    longest pieces first (of equal ones by doc_id, null last, and piece), and has sequence ids of its own. Lengths must lie
    from 1 to ``capacity``. Rows stay Arrow, so ids are kept as they are, null or large. Equal rows are packed each; an
    empty table gives an empty one.
    """
    parts = checkpointed(parts.drop("sequence_id", "offset"))  # dealt by place, so the places must hold
    groups = max(1, -(-parts.count() // group_rows))
    schema = StructType([*parts.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def place(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns([GROUP]).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = sum_of_squares(rows["length"].to_numpy().astype(np.int64), capacity)
        return rows.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offsets))

    dealt = parts.withColumn(GROUP, F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
    return dealt.groupBy(GROUP).applyInArrow(place, schema)
