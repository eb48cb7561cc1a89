"""A bounded sample of labelled documents to fit a model on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int, only: Column | None = None) -> DataFrame:
    """``doc_id``, ``text``, ``_label`` and ``_order`` of up to ``rows`` documents, those whose ids hash lowest.

    ``rows`` bounds what is broadcast: a label and an id a row. Labels that are null are left out.
    """
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull())
    if only is not None:
        known = known.where(only)
    chosen = known.select(F.col("doc_id").cast("long"), F.col(target).cast("int").alias("_label"), F.xxhash64("doc_id").alias("_order"))
    chosen = chosen.orderBy("_order", "doc_id", "_label").limit(rows)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
