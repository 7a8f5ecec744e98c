"""Table-generating operators: random mutations and synthetic genealogies.

Random numbers are hashes of the seed and of what they are drawn for, so a result follows
the seed alone: no order of rows, partitioning or retry changes it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import MUTATION_SCHEMA, Genealogy
from ..storage import materialize
from .closure import carriers
from .intervals import stab_join
from .ordering import prefixes
from .statistics import edge_heights


#: Largest mean of a Poisson number that is drawn at once; larger ones are sums.
MEAN = 256.0


def _uniform(*keys: np.ndarray | int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the keys alone: a counter-based hash (the finaliser
    of a 64-bit mixer after each key), for all rows at once."""
    x = np.uint64(0)
    with np.errstate(over="ignore"):
        for k in keys:
            x = (x + np.asarray(k).astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _poisson(mean: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Poisson numbers by inversion of one uniform number each; means up to ``MEAN``."""
    n, p = np.zeros(len(mean), np.int64), np.exp(-mean)
    below = p.copy()
    left = np.flatnonzero(u >= below)
    while len(left):
        n[left] += 1
        p[left] *= mean[left] / n[left]
        below[left] += p[left]
        left = left[(u[left] >= below[left]) & (p[left] > 0)]
    return n


def _drawn(edges: DataFrame, rate: float, seed: int) -> DataFrame:
    """``position, height, child, parent``: Poisson counts by an edge's volume, uniform
    places. Draws are hashes of the seed, the edge and a counter, made for a batch of edges at
    once, so the result does not depend on partitioning."""
    schema = pa.schema([("position", pa.float64()), ("height", pa.float64()), ("child", pa.int64()), ("parent", pa.int64())])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {k: batch.column(k).to_numpy() for k in ("lft", "rgt", "child", "parent", "height_child", "height_parent")}
            mean = rate * (c["rgt"] - c["lft"]) * (c["height_parent"] - c["height_child"])
            parts = np.maximum(np.ceil(mean / MEAN), 1).astype(np.int64)
            edge = np.repeat(np.arange(len(mean)), parts)
            part = np.arange(len(edge)) - np.repeat(np.cumsum(parts) - parts, parts)
            key = [c["child"][edge], c["lft"][edge].view(np.int64), part]
            n = _poisson((mean / parts)[edge], _uniform(seed, *key, 0))
            for at in range(0, len(n), 4096):  # the draws of some parts at a time
                m = n[at : at + 4096]
                row = np.repeat(np.arange(at, at + len(m)), m)
                count = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m) + 1
                e, keys = edge[row], [k[row] for k in key]
                x = c["lft"][e] + _uniform(seed, *keys, count, 1) * (c["rgt"][e] - c["lft"][e])
                h = c["height_child"][e] + _uniform(seed, *keys, count, 2) * (c["height_parent"][e] - c["height_child"][e])
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (x, h, c["child"][e], c["parent"][e])], schema=schema)

    return edges.mapInArrow(draw, "position double, height double, child long, parent long")


def generate_mutations(g: Genealogy, rate: float, seed: int = 1) -> Genealogy:
    """Replaces the mutations by a Poisson process over the edges' volumes."""
    m = _drawn(edge_heights(g), rate, seed)
    m = m.select(F.xxhash64("position", "height", "child").alias("mut_id"), "position", "height", F.lit(None).cast("long").alias("site_id"), "child", "parent")
    return g.with_(mutations=m.select([f.name for f in MUTATION_SCHEMA]))


def mutation_map(g: Genealogy, anc: DataFrame, rate: float, seed: int = 1) -> DataFrame:
    """``position, leaves``: places of drawn mutations with the sorted leaves that carry
    them; of several at one place, all."""
    c = carriers(generate_mutations(g, rate, seed), anc)
    return c.groupBy("position").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))


def digest_uniform(*key: object):
    """A number in [0, 1) of 52 bits of the MD5 of the keys: the same in any retry, at any
    parallelism, and in SQL."""
    text = F.concat_ws("|", *[k if isinstance(k, Column) else F.lit(str(k)) for k in key])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / float(1 << 52)


def generate_exactly(g: Genealogy, count: int, seed: int = 1) -> Genealogy:
    """Replaces the mutations by exactly ``count``, edges chosen by volume: running sums of
    volumes in order of child and place, stabbed by uniform numbers."""
    e = edge_heights(g).withColumn("_v", (F.col("height_parent") - F.col("height_child")) * (F.col("rgt") - F.col("lft"))).where("_v > 0")
    e = prefixes(e, ["child", "lft"], {"_lo": F.col("_v")}).withColumn("_hi", F.col("_lo") + F.col("_v"))
    e = materialize(e.select("lft", "rgt", "child", "parent", "height_child", "height_parent", "_lo", "_hi"), "volumes")
    total = e.agg(F.max("_hi")).first()[0] or 0.0
    if not total:
        raise ValueError("a genealogy without volume carries no mutation")
    u, a, b = (digest_uniform(seed, F.col("id"), k) for k in "uxh")
    u = g.spark.range(count).select("id", (u * total).alias("u"), a.alias("_a"), b.alias("_b"))
    m = stab_join(u, e, "u", total, lft="_lo", rgt="_hi")
    return g.with_(mutations=m.select(F.col("id").alias("mut_id"), (F.col("lft") + F.col("_a") * (F.col("rgt") - F.col("lft"))).alias("position"), (F.col("height_child") + F.col("_b") * (F.col("height_parent") - F.col("height_child"))).alias("height"), F.lit(None).cast("long").alias("site_id"), "child", "parent"))


def caterpillar(spark: SparkSession, start: float, end: float, n_samples: int, n_trees: int) -> Genealogy:
    """Disjoint equal-width trees in which each leaf joins the last ancestor."""
    width = (end - start) / n_trees
    t = spark.range(n_trees).select(F.col("id").alias("t"), (F.lit(float(start)) + F.col("id") * width).alias("lft"), F.when(F.col("id") == n_trees - 1, F.lit(float(end))).otherwise(F.lit(float(start)) + (F.col("id") + 1) * width).alias("rgt"))
    inner = t.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n_samples - 1))))
    node = F.lit(n_samples).cast("long") + F.col("t") * (n_samples - 1) + F.col("k") - 1
    none = F.lit(None).cast("string").alias("name")
    leaves = spark.range(n_samples).select(F.col("id").alias("node_id"), F.lit(0.0).alias("height"), F.lit(float(start)).alias("start"), F.lit(float(end)).alias("stop"), F.lit(True).alias("is_sample"), none)
    nodes = leaves.union(inner.select(node, F.col("k").cast("double"), "lft", "rgt", F.lit(False), none))
    edges = inner.select("lft", "rgt", node.alias("parent"), F.explode(F.array(F.col("k").cast("long"), F.when(F.col("k") == 1, F.lit(0).cast("long")).otherwise(node - 1))).alias("child"))
    return Genealogy(nodes, edges, spark.createDataFrame([], MUTATION_SCHEMA), float(start), float(end))


def exponential(rate: float, seed: int):
    return -F.log1p(-F.rand(seed)) / F.lit(rate)

