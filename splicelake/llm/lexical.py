"""Ranked lexical search: each item's best documents, scored once for each class of documents that score alike."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from splicelake.llm.common import checkpointed, written

#: Documents that an item gets.
TOP = 50
#: Pairs of an item and a term that are searched at once; more items are searched block by block.
BLOCK_TERMS = 1 << 18
#: Scores, and summands of scores, that a task holds at once.
HELD = 1 << 21
#: ASCII letters, lower-cased, digits and all bytes of other characters; a space for the rest.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of characters beyond ASCII; A-Z lower-cased."""
    return (text or "").encode().translate(_FOLD).split()


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id`` and ``term``, each pair once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, t) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in set(terms(text))]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["item_id", "term"])

    return items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "item_id long, term binary").distinct()


def bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id``, ``n`` (terms with repeats) and ``tf``: the ids of the vocabulary's terms that the document holds,
    ascending, then their counts, as little-endian 32-bit integers."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = known.value
        for batch in batches:
            sizes, vectors = [], []
            for text in batch.column(1).to_pylist():
                found = terms(text)
                counts = Counter(found)
                held = sorted((index[t], counts[t]) for t in counts.keys() & index.keys())
                sizes.append(len(found))
                vectors.append(np.array(held, "<i4").T.tobytes())
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(vectors, pa.binary())], ["doc_id", "n", "tf"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, tf binary")


def search(docs: DataFrame, items: DataFrame, *, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score``: of each item the ``top`` documents of highest score.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. With N documents that have
    a term, L terms in them, n in a document and df documents that hold a term, the term weighs
    w = floor(1000 ln((2 N + 2) / (2 df + 1))), and a document that holds it tf times gets
    w * (10^9 tf div (1000 tf + 20 m)) for it, m = 50 + 50 n N div L. Equal scores go by ascending doc_id.

    Documents are cut down to the terms of the items. Those with equal counts of all these terms and equal m score alike
    for every item: they are one class, found by a hash and by the counts themselves, and scored once. Of an item's classes
    the ``top`` best, of equal ones those that hold the least doc_id, are enough, and so are the ``top`` least doc_ids of
    each. Items are searched in blocks of about ``block_terms`` terms, so what is broadcast is bounded.

    Null and empty texts score nowhere and do not count in N. Rows of one item_id (null is one) are one item with the terms
    of all; an item without terms or documents has no rows. Documents with a null doc_id come last among equal ones, and
    repeated rows are documents each. Other columns are left out; an empty table gives an empty one.
    """
    pairs = checkpointed(item_terms(items))
    blocks = max(1, -(-pairs.count() // block_terms))
    each = (pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect() for b in range(blocks))
    found = [_block(docs, block, top) for block in each if block]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def _block(docs: DataFrame, pairs: list[Row], top: int) -> DataFrame:
    spark = docs.sparkSession
    names = sorted({bytes(p["term"]) for p in pairs})
    items = sorted({p["item_id"] for p in pairs}, key=lambda i: (i is None, i))
    term_of, item_of = {t: i for i, t in enumerate(names)}, {x: i for i, x in enumerate(items)}
    held = written(bags(docs, term_of), "bags")
    n_docs, n_terms = held.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = F.expr(f"50 + cast((50 * cast(n as decimal(38, 0)) * {n_docs}) div {max(n_terms, 1)} as long)")
    held = held.where(F.octet_length("tf") > 0).select("doc_id", m.alias("m"), "tf").withColumn("bag", F.xxhash64("m", "tf"))
    classes = held.groupBy("bag", "m", "tf").agg(F.count(F.lit(1)).alias("members"), F.min("doc_id").alias("first"))
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "classes")

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names), np.int64)
        for batch in batches:
            for members, tf in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(tf.as_buffer(), "<i4")
                total[x[: len(x) // 2]] += members
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["term", "df"])

    df = np.zeros(len(names), np.int64)
    for r in classes.select("members", "tf").mapInArrow(holders, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    # the items of each term, one after another
    at = sorted((term_of[bytes(p["term"])], item_of[p["item_id"]]) for p in pairs)
    begin = np.searchsorted(np.array([t for t, _ in at], np.int64), np.arange(len(names) + 1))
    given = spark.sparkContext.broadcast((weight, begin, np.array([i for _, i in at], np.int64), np.array([i if i is not None else 0 for i in items], np.int64), np.array([i is None for i in items])))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, begin, item, ids, no_id = given.value
        n_items, last = len(ids), np.iinfo(np.int64).max
        least = np.ones(n_items, np.int64)  # scores that may still be among the best
        kept = np.zeros((4, 0), np.int64)  # item, score, first, class
        for batch in batches:
            ms, first, name = (batch.column(i).fill_null(last).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            vectors = [np.frombuffer(v.as_buffer(), "<i4").reshape(2, -1) for v in batch.column(1)]
            sums = np.cumsum([0, *(int((begin[v[0] + 1] - begin[v[0]]).sum()) for v in vectors)])
            a = 0
            while a < len(vectors):
                b = min(len(vectors), a + max(1, HELD // n_items), max(a + 1, int(np.searchsorted(sums, sums[a] + HELD, "right")) - 1))
                term, tf = np.concatenate(vectors[a:b], axis=1).astype(np.int64)
                row = np.repeat(np.arange(b - a), [v.shape[1] for v in vectors[a:b]])
                part = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * ms[a:b][row]))
                many = begin[term + 1] - begin[term]
                which = np.repeat(np.arange(len(term)), many)
                of = item[np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + begin[term][which]]
                score = np.zeros((b - a) * n_items, np.int64)
                np.add.at(score, row[which] * n_items + of, part[which])
                good = np.flatnonzero(score.reshape(-1, n_items) >= least)
                r, i = np.divmod(good, n_items)
                kept = np.concatenate([kept, np.stack([i, score[good], first[a:b][r], name[a:b][r]])], axis=1)
                kept = kept[:, np.lexsort((kept[3], kept[2], -kept[1], kept[0]))]
                starts = np.searchsorted(kept[0], np.arange(n_items + 1))
                place = np.arange(kept.shape[1]) - starts[kept[0]]
                full = np.flatnonzero(np.diff(starts) >= top)
                least[full] = kept[1, starts[full] + top - 1]
                kept = kept[:, place < top]
                a = b
        out = [pa.array(ids[kept[0]], mask=no_id[kept[0]]), pa.array(kept[1]), pa.array(kept[2], mask=kept[2] == last), pa.array(kept[3])]
        yield pa.record_batch(out, ["item_id", "score", "first", "class"])

    ranks = Window.partitionBy("item_id")
    scored = classes.select("m", "tf", "first", "class").mapInArrow(best, "item_id long, score long, first long, class long")
    scored = scored.withColumn("_k", F.row_number().over(ranks.orderBy(F.desc("score"), F.asc_nulls_last("first"), "class"))).where(F.col("_k") <= top)
    scored = checkpointed(scored.select("item_id", "score", "class"))
    wanted = checkpointed(classes.join(scored.select("class").distinct(), "class", "left_semi").select("class", "bag", "m", "tf"))
    members = held.join(wanted, ["bag", "m", "tf"]).select("class", "doc_id")
    members = members.withColumn("_k", F.row_number().over(Window.partitionBy("class").orderBy(F.asc_nulls_last("doc_id")))).where(F.col("_k") <= top)
    out = scored.join(members.select("class", "doc_id"), "class")
    rank = F.row_number().over(ranks.orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "class"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
