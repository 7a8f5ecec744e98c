"""Mutations as a stream: each arriving mutation is joined with a static ancestry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_carriers(mutations: DataFrame, anc: DataFrame) -> DataFrame:
    """Append-mode stream of ``mut_id, position, leaf``. The join is stateless: the static
    side is the ancestry, so no watermark is needed and late rows are not lost."""
    a = anc.select("leaf", F.col("node").alias("_n"), "lft", "rgt")
    m = mutations.select("mut_id", "position", "child")
    return m.join(a, (F.col("child") == F.col("_n")) & (F.col("lft") <= F.col("position")) & (F.col("position") < F.col("rgt"))).select("mut_id", "position", "leaf")


def allele_counts(mutations: DataFrame, anc: DataFrame) -> DataFrame:
    """Running carrier counts per mutation (update or complete mode)."""
    return stream_carriers(mutations, anc).groupBy("mut_id").agg(F.count("*").alias("allele_count"))
