"""The data model: a genealogy is five DataFrames and a span.

Intervals are half-open. Every DataFrame is immutable; operators return new ones."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_SCHEMA = T.StructType([
    T.StructField("node_id", T.LongType()),
    T.StructField("height", T.DoubleType()),
    T.StructField("start", T.DoubleType()),
    T.StructField("stop", T.DoubleType()),
    T.StructField("is_sample", T.BooleanType()),
    T.StructField("name", T.StringType()),
])
EDGE_SCHEMA = T.StructType([
    T.StructField("lft", T.DoubleType()),
    T.StructField("rgt", T.DoubleType()),
    T.StructField("parent", T.LongType()),
    T.StructField("child", T.LongType()),
])
MUTATION_SCHEMA = T.StructType([
    T.StructField("mut_id", T.LongType()),
    T.StructField("position", T.DoubleType()),
    T.StructField("height", T.DoubleType()),
    T.StructField("site_id", T.LongType()),
    T.StructField("child", T.LongType()),
    T.StructField("parent", T.LongType()),
])

#: Flags of exported node tables.
NODE_IS_SAMPLE = 1
NODE_IS_NOT_SAMPLE = 0


@dataclass(frozen=True)
class Genealogy:
    """Nodes, edges and mutations over [start, end); offset and chromosome place it."""

    nodes: DataFrame
    edges: DataFrame
    mutations: DataFrame
    start: float
    end: float
    offset: int = 0
    chromosome: int = 1

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @property
    def span(self) -> float:
        return self.end - self.start

    @property
    def leaves(self) -> DataFrame:
        return self.nodes.where("is_sample").select(F.col("node_id").alias("leaf"))

    def with_(self, **changes) -> Genealogy:
        return replace(self, **changes)

    def set_offset(self, offset: int) -> Genealogy:
        if self.start != 0 or offset < 0:
            raise ValueError("an offset needs a span that starts at 0 and may not be negative")
        return replace(self, offset=int(offset))

    def set_chromosome(self, chromosome: int) -> Genealogy:
        if chromosome < 1:
            raise ValueError("a chromosome is 1 or more")
        return replace(self, chromosome=int(chromosome))


def from_rows(spark: SparkSession, nodes: list, edges: list, start: float, end: float, mutations: list = ()) -> Genealogy:
    """Small genealogies by hand: nodes (id, height[, is_sample]), edges (lft, rgt,
    parent, child), mutations (id, position, height, site, child, parent)."""
    n = [(int(x[0]), float(x[1]), float(start), float(end), bool(x[2]) if len(x) > 2 else x[1] == 0, None) for x in nodes]
    e = [(float(a), float(b), int(p), int(c)) for a, b, p, c in edges]
    m = [(int(i), float(x), None if h is None else float(h), s, int(c), int(p)) for i, x, h, s, c, p in mutations]
    return Genealogy(spark.createDataFrame(n, NODE_SCHEMA), spark.createDataFrame(e, EDGE_SCHEMA), spark.createDataFrame(m, MUTATION_SCHEMA), float(start), float(end))
