"""Registered queries of the library and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from splicelake.catalog import ORACLES, QUERIES, alignments, coverage, discovery, fusions, haplotypes, hits, intervals, junctions, reads, samtables, seams, sequences, sources, variants

__all__ = ["ORACLES", "QUERIES", "alignments", "coverage", "discovery", "flagship", "fusions", "haplotypes", "hits", "intervals", "junctions", "reads", "samtables", "seams", "sequences", "sources", "variants"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supported introns, whether they are accepted, and their track rows."""
    return QUERIES["snk_junc_bed"](spark, sf_dir)
