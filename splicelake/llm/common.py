"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names. Where none is set and all runs in one process, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table made by ``written``. What was computed from it must be written itself by then."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cell_offsets(df: DataFrame, group: Sequence[str], cells: Sequence[str]) -> DataFrame:
    """Rows of a group that precede each of its cells, as ``_before``.

    ``cells`` names one or more levels from coarse to fine. Each level is numbered by a window over the counts of one
    coarser cell, so no task sees more rows than one level has cells, however many rows the group has.
    """
    counts = df.groupBy(*group, *cells).agg(F.count(F.lit(1)).alias("_n"))
    if len(cells) == 1:
        return counts.select(*group, *cells, _running(group, cells[0]).alias("_before"))
    coarse, fine = cells[0], cells[1:]
    above = cell_offsets(df, group, [coarse]).withColumnRenamed("_before", "_above")
    within = counts.select(*group, *cells, _running([*group, coarse], *fine).alias("_within"))
    return within.join(above, [*group, coarse]).select(*group, *cells, (F.col("_above") + F.col("_within")).alias("_before"))


def _running(group: Sequence[str], *order: str) -> Column:
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("_n").over(w), F.lit(0))


def ranked(df: DataFrame, group: Sequence[str], cells: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Adds ``name``: the place from 0, without gaps, of each row in its group, in the order of ``cells``, then ``order``.

    The columns of ``group`` and ``cells`` must not be null.
    """
    keys = [*group, *cells]
    w = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.join(cell_offsets(df, group, cells), keys)
        .withColumn(name, F.col("_before") + F.row_number().over(w) - 1)
        .drop("_before")
    )
