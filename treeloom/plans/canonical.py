"""A deterministic genealogy over the driver tables.

Leaves are customers or suppliers, whole tables. Heights and breakpoints are integers,
so sums of volumes are exact in double and do not depend on their order."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import MUTATION_SCHEMA, Genealogy
from ..operators.ordering import numbered

LENGTH = 100.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def leaves(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    if kind == "customer":
        return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("leaf"), F.col("c_nationkey").cast("long").alias("nk"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("leaf"), F.col("s_nationkey").cast("long").alias("nk"))


def genealogy(spark: SparkSession, sf_dir: str, kind: str = "customer", multiplier: int = 37, shift: int = 1) -> Genealogy:
    """``kind``: which table gives the leaves; multiplier and shift make variants."""
    who = leaves(spark, sf_dir, kind)
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_regionkey").cast("long").alias("r"))
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("r"))
    d = lambda x: F.lit(float(x))

    def nodes(df, node, height, sample=False):
        return df.select(node.alias("node_id"), height.cast("double").alias("height"), d(0).alias("start"), d(LENGTH).alias("stop"), F.lit(sample).alias("is_sample"), F.lit(None).cast("string").alias("name"))

    def edges(df, lft, rgt, parent, child):
        return df.select(lft.cast("double").alias("lft"), rgt.cast("double").alias("rgt"), parent.alias("parent"), child.alias("child"))

    top = spark.range(1).select(F.lit(3000000).cast("long").alias("node"))
    n, r = F.col("n") + 1000000, F.col("r") + 2000000
    all_nodes = nodes(who, F.col("leaf"), F.lit(0), True).union(nodes(nation, n, F.col("n") + 1)).union(nodes(region, r, F.col("r") + 30)).union(nodes(top, F.col("node"), F.lit(40)))
    cut = F.col("leaf") * multiplier % 90 + 5
    other = (F.col("nk") + shift + F.col("leaf") % 3) % 25 + 1000000
    all_edges = (
        edges(who, d(0), cut, F.col("nk") + 1000000, F.col("leaf"))
        .union(edges(who, cut, d(LENGTH), other, F.col("leaf")))
        .union(edges(nation, d(0), d(60), r, n))
        .union(edges(nation, d(60), d(LENGTH), (F.col("r") + 1) % 5 + 2000000, n))
        .union(edges(region, d(0), d(LENGTH), F.lit(3000000).cast("long"), r))
    )
    if kind == "customer":
        o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("leaf"))
    else:  # whole part table, dealt round the suppliers
        size = who.agg(F.count("*").alias("size"))
        o = table(spark, sf_dir, "part").crossJoin(F.broadcast(size)).select(F.col("p_partkey").alias("key"), (F.col("p_partkey") * 7 % F.col("size")).alias("leaf"))
    at = (F.col("key") * 17 % 100 + F.col("key") % 8 / 8.0).cast("double")
    o = o.join(who, "leaf").select(F.col("key").alias("mut_id"), at.alias("position"), F.when(F.col("key") % 3 == 0, F.col("nk") + 1000000).otherwise(F.col("leaf")).alias("_child"))
    muts = o.join(all_edges, (F.col("_child") == F.col("child")) & (F.col("lft") <= F.col("position")) & (F.col("position") < F.col("rgt")))
    muts = muts.select("mut_id", "position", F.lit(None).cast("double").alias("height"), F.lit(None).cast("long").alias("site_id"), "child", "parent")
    return Genealogy(all_nodes, all_edges, muts, 0.0, LENGTH)


#: Levels and length of the deep genealogy.
DEEP_LEVELS = 200
DEEP_LENGTH = 65536.0


def deep_genealogy(spark: SparkSession, sf_dir: str) -> Genealogy:
    """Customers below a chain of ``DEEP_LEVELS`` nodes: each order moves its customer to
    another node of the chain at the order's position, so there are about as many
    breakpoints as orders, and each breaks all nodes of the chain above."""
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("leaf"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("leaf"), (F.col("o_orderkey") * 7919 % 65535 + 1).alias("x"))
    cuts = o.join(who, "leaf", "left_semi").union(who.select("leaf", F.lit(0).cast("long"))).distinct()
    rgt = F.coalesce(F.lead("x").over(Window.partitionBy("leaf").orderBy("x")), F.lit(int(DEEP_LENGTH)))
    moves = cuts.select("leaf", "x", rgt.alias("y"), ((F.col("leaf") * 31 + F.col("x") * 17) % DEEP_LEVELS + 4000000).alias("parent"))
    chain = spark.range(DEEP_LEVELS).select((F.col("id") + 4000000).alias("node"), (F.col("id") + 1).cast("double").alias("height"))
    d = lambda x: F.lit(float(x))
    edges = moves.select(F.col("x").cast("double").alias("lft"), F.col("y").cast("double").alias("rgt"), "parent", F.col("leaf").alias("child"))
    edges = edges.union(chain.where(f"height < {DEEP_LEVELS}").select(d(0), d(DEEP_LENGTH), F.col("node") + 1, F.col("node")))
    every = who.select("leaf", d(0).alias("height"), F.lit(True).alias("sample")).union(chain.select("node", "height", F.lit(False)))
    nodes = every.select(F.col("leaf").alias("node_id"), "height", d(0).alias("start"), d(DEEP_LENGTH).alias("stop"), F.col("sample").alias("is_sample"), F.lit(None).cast("string").alias("name"))
    return Genealogy(nodes, edges, spark.createDataFrame([], MUTATION_SCHEMA), 0.0, DEEP_LENGTH)


def binary_genealogy(spark: SparkSession, sf_dir: str) -> Genealogy:
    """Suppliers on a chain of nodes with two children each: the k-th joins at height k (the first
    two at 1), in one order on the first half of the span and in another on the second."""
    who = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("leaf"))
    n = who.count()
    if math.gcd(7, n) != 1:
        raise ValueError("the second order needs a number of suppliers that 7 does not divide")
    ranked = numbered(who, ["leaf"], "k")
    at = F.explode(F.array(F.struct(F.lit(0.0).alias("lft"), F.lit(50.0).alias("rgt"), F.col("k").alias("k")), F.struct(F.lit(50.0).alias("lft"), F.lit(100.0).alias("rgt"), ((F.col("k") * 7 + 3) % n).alias("k"))))
    edges = ranked.select("leaf", at.alias("x")).select("x.lft", "x.rgt", (F.greatest("x.k", F.lit(1).cast("long")) + 5000000).alias("parent"), F.col("leaf").alias("child"))
    chain = spark.range(1, n).select((F.col("id") + 5000000).alias("node"), F.col("id").cast("double").alias("height"))
    edges = edges.union(chain.where(f"height < {n - 1}").select(F.lit(0.0), F.lit(100.0), F.col("node") + 1, "node"))
    every = who.select("leaf", F.lit(0.0).alias("height"), F.lit(True).alias("sample")).union(chain.select("node", "height", F.lit(False)))
    nodes = every.select(F.col("leaf").alias("node_id"), "height", F.lit(0.0).alias("start"), F.lit(100.0).alias("stop"), F.col("sample").alias("is_sample"), F.lit(None).cast("string").alias("name"))
    return Genealogy(nodes, edges, spark.createDataFrame([], MUTATION_SCHEMA), 0.0, LENGTH)


def phenotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``individual, y``: integer cents of both customers of an individual together; null
    (masked) where a customer's number is divisible by eleven."""
    c = table(spark, sf_dir, "customer").select(F.expr("c_custkey div 2").alias("individual"), (F.col("c_custkey") % 11 == 0).alias("_masked"), F.round(F.col("c_acctbal") * 100).cast("long").alias("_cents"))
    return c.groupBy("individual").agg(F.when(~F.max("_masked"), F.sum("_cents").cast("double")).alias("y"))


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``site, position, leaf, dosage``: 25 sites (one per nation) by all suppliers;
    null where missing."""
    s = leaves(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("site"))
    both = s.crossJoin(F.broadcast(n))  # the nation table is fixed
    one = (F.col("nk") + F.col("site")) % 4 == 0
    missing = (F.col("leaf") * 3 + F.col("site")) % 7 == 0
    dosage = F.when(~missing, F.when(one | ((F.col("leaf") + F.col("site")) % 11 == 0), 1).otherwise(0))
    return both.select("site", (F.col("site") * 17 % 100 + 0.5).cast("double").alias("position"), "leaf", dosage.cast("long").alias("dosage"))
