"""Structural checks: each gives the rows that violate it, ``rule, id, x``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Genealogy
from .closure import roots
from .intervals import sweep
from .statistics import edge_heights


def _bad(rows: DataFrame, rule: str, node: str, x: str | None = None) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.col(node).cast("long").alias("id"), (F.lit(None).cast("double") if x is None else F.col(x)).alias("x"))


def node_heights(g: Genealogy) -> DataFrame:
    return _bad(g.nodes.where("height < 0 or (not is_sample and height <= 0)"), "node height", "node_id")


def node_spans(g: Genealogy) -> DataFrame:
    n = g.nodes.where((F.col("start") >= F.col("stop")) | (F.col("start") < g.start) | (F.col("stop") > g.end) | (F.col("is_sample") & ((F.col("start") != g.start) | (F.col("stop") != g.end))))
    return _bad(n, "node span", "node_id", "start")


def edge_rules(g: Genealogy) -> DataFrame:
    e = edge_heights(g).where("height_parent <= height_child or lft >= rgt")
    s = g.nodes.select(F.col("node_id").alias("_n"), "start", "stop")
    out = reduce(DataFrame.union, [_bad(g.edges.join(s, F.col(c) == F.col("_n")).where("lft < start or rgt > stop"), f"edge outside its {c}", c, "lft") for c in ("child", "parent")])
    return _bad(e, "edge order", "child", "lft").union(out)


def parents(g: Genealogy, strict: bool = False) -> DataFrame:
    """No place of a node has two parents; if strict, places without one are covered by
    exactly one root."""
    w = Window.partitionBy("child").orderBy("lft", "rgt")
    twice = g.edges.withColumn("_r", F.max("rgt").over(w.rowsBetween(Window.unboundedPreceding, -1))).where("lft < _r")
    out = _bad(twice, "two parents", "child", "lft")
    return out.union(root_rules(g)) if strict else out


def root_rules(g: Genealogy) -> DataFrame:
    """Roots partition the span."""
    cover = sweep(roots(g).withColumn("_one", F.lit(1)), ["_one"], {})
    two = _bad(cover.where("n_rows > 1").withColumn("_n", F.lit(-1)), "two roots", "_n", "lft")
    total = cover.where("n_rows > 0").agg(F.coalesce(F.sum(F.col("rgt") - F.col("lft")), F.lit(0.0)).alias("_len")).where(F.abs(F.col("_len") - g.span) > 1e-9 * g.span)
    return two.union(_bad(total.withColumn("_n", F.lit(-1)), "no root", "_n", "_len"))


def children(g: Genealogy, strict: bool = True) -> DataFrame:
    """Inner nodes have two children or more: overall, or (strict) wherever they have any."""
    if strict:
        few = sweep(g.edges.select(F.col("parent").alias("node"), "lft", "rgt"), ["node"], {}).where("n_rows < 2")
        return _bad(few, "fewer than two children", "node", "lft")
    few = g.edges.groupBy("parent").agg(F.count_distinct("child").alias("_k")).where("_k < 2")
    return _bad(few, "fewer than two children", "parent")


def unknown_ends(g: Genealogy) -> DataFrame:
    ids = g.nodes.select("node_id")
    return reduce(DataFrame.union, [_bad(g.edges.join(ids, F.col(c) == F.col("node_id"), "left_anti"), f"unknown {c}", c, "lft") for c in ("child", "parent")])


def childless(g: Genealogy) -> DataFrame:
    """Inner nodes without a child, and nodes without any edge."""
    inner = g.nodes.where("not is_sample").join(g.edges.select("parent").distinct(), F.col("node_id") == F.col("parent"), "left_anti")
    return _bad(inner, "no child", "node_id")


def mutation_rules(g: Genealogy) -> DataFrame:
    """Mutations lie in their edge's interval and, if known, height range."""
    e = edge_heights(g).select(F.col("child").alias("_c"), F.col("parent").alias("_p"), "lft", "rgt", "height_child", "height_parent")
    m = g.mutations.join(e, (F.col("child") == F.col("_c")) & (F.col("parent") == F.col("_p")) & (F.col("lft") <= F.col("position")) & (F.col("position") < F.col("rgt")), "left")
    return _bad(m.where("_c is null or height < height_child or height >= height_parent"), "mutation off its edge", "mut_id", "position")


def basic(g: Genealogy, strict: bool = True) -> DataFrame:
    return reduce(DataFrame.union, [node_heights(g), node_spans(g), edge_rules(g), parents(g, strict), unknown_ends(g), childless(g), mutation_rules(g)])


def require(g: Genealogy, strict: bool = True) -> None:
    """Raises with the first violations, if any."""
    found = basic(g, strict).limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r['rule']}: {r['id']} at {r['x']}" for r in found))
