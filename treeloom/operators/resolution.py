"""Comparison of trees after random resolution of polytomies or merging of branches.

Trees at stab positions are edge lists ``k, parent, child, height_child, height_parent``, changed
by joins on (tree, node)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import md5
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Genealogy
from ..storage import materialize
from .intervals import stab_join
from .statistics import edge_heights, met_at, nodes_at, sets_at

def trees_at(g: Genealogy, stabs: DataFrame) -> DataFrame:
    return stab_join(stabs, edge_heights(g), "x", g.span).select("k", "parent", "child", "height_child", "height_parent")


def draw(*key: object) -> int:
    """32 random bits of a key, the same wherever they are drawn (SQL has the digest too)."""
    return int(md5("|".join(map(str, key)).encode()).hexdigest()[:8], 16)


def split_ranges(size: int, *key: object) -> Iterator[tuple[int, int, int, int]]:
    """A random binary tree over places 0 to size - 1, as ranges (above, first, stop, cut): a range
    is cut at a place drawn from the key and its ends. Every place from 1 on is the cut of
    just one range, so the cut names it; ``above`` is the cut of the range it is part of (0
    at the top's halves); a single place has cut 0."""
    stack = [(-1, 0, size)]
    while stack:
        above, a, b = stack.pop()
        cut = a + 1 + draw(*key, a, b) % (b - a - 1) if b - a > 1 else 0
        if above >= 0:
            yield above, a, b, cut
        if cut:
            name = 0 if above < 0 else cut
            stack += [(name, a, cut), (name, cut, b)]


def _splitter(seed: int):
    schema = pa.schema([(c, pa.int64()) for c in ("k", "parent", "above", "first", "stop", "cut")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, parent, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = ((k, parent, above, a, b, cut) for above, a, b, cut in split_ranges(size, seed, k, parent))
                while part := list(islice(rows, 100_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part, strict=True)], schema=schema)

    return run


def _ordered(trees: DataFrame, seed: int) -> DataFrame:
    """Branches with ``_place`` in the random order of their parent's children and ``_m``, how many these are."""
    w = Window.partitionBy("k", "parent")
    order = w.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "k", "parent", "child")), "child")
    return trees.withColumns({"_place": F.row_number().over(order).cast("long") - 1, "_m": F.count("*").over(w)})


def _split(ordered: DataFrame, seed: int) -> DataFrame:
    """``k, parent, above, first, stop, cut``: the ranges (``split_ranges``) of the nodes with more than two children."""
    sizes = ordered.where("_m > 2 and _place = 0").select("k", "parent", "_m")
    return sizes.mapInArrow(_splitter(seed), "k long, parent long, above long, first long, stop long, cut long")


def resolve_randomly(trees: DataFrame, seed: int) -> DataFrame:
    """Every node with more than two children becomes a random binary tree of branches of
    no length; new nodes have negative ids.

    The children of a node are ordered by digests of (seed, tree, node, child); ranges of that
    order are cut at places that digests of their ends draw. Only a node's number of children
    is split in one place, never a tree; and the result depends on the seed alone, not on the order of rows."""
    d = materialize(_ordered(trees, seed), "ordered")
    split = _split(d, seed)
    named = lambda cut: F.when(F.col(cut) == 0, F.col("parent")).otherwise(-(F.col("parent") * (1 << 24) + F.col(cut)))
    split = materialize(split.select("k", F.col("parent").alias("_top"), named("above").alias("_up"), "first", "cut", named("cut").alias("_down")), "split")
    few = d.where("_m <= 2").select("k", "parent", "child", "height_child", "height_parent")
    key = (F.col("k") == F.col("_k")) & (F.col("parent") == F.col("_top"))
    leaves = d.where("_m > 2").join(split.where("cut = 0").withColumnRenamed("k", "_k"), key & (F.col("_place") == F.col("first")))
    leaves = leaves.select("k", F.col("_up").alias("parent"), "child", "height_child", "height_parent")
    tops = d.where("_m > 2 and _place = 0").select("k", "parent", "height_parent")
    inner = tops.join(split.where("cut > 0").withColumnRenamed("k", "_k"), key)
    inner = inner.select("k", F.col("_up").alias("parent"), F.col("_down").alias("child"), F.col("height_parent").alias("height_child"), "height_parent")
    return few.union(leaves).union(inner)


def merge_branches(trees: DataFrame, fraction: float, by: str = "smallest", seed: int = 1) -> DataFrame:
    """Removes, per tree, the first floor(fraction * count) inner branches, by rising
    relative length or at random: their children hang on the next node that stays."""
    if by not in ("smallest", "random"):
        raise ValueError("branches are merged by 'smallest' or 'random'")
    key = 1 - F.col("height_child") / F.col("height_parent") if by == "smallest" else F.xxhash64(F.lit(seed), "k", "child").cast("double")
    inner = trees.where("height_child > 0").withColumn("_key", key)
    w = Window.partitionBy("k").orderBy("_key", "child")
    inner = inner.withColumns({"_r": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy("k"))})
    gone = materialize(inner.where(F.col("_r") <= F.floor(F.lit(fraction) * F.col("_n"))).select("k", F.col("child").alias("gone"), F.col("parent").alias("up"), F.col("height_parent").alias("up_height")))
    left = trees.join(gone.select("k", F.col("gone").alias("child")), ["k", "child"], "left_anti")
    while True:
        hit = left.join(gone.withColumnRenamed("gone", "parent"), ["k", "parent"], "left")
        left = materialize(hit.select("k", F.coalesce("up", "parent").alias("parent"), "child", "height_child", F.coalesce("up_height", "height_parent").alias("height_parent"), F.col("up").isNotNull().alias("_moved")))
        moved = left.where("_moved")
        left = left.drop("_moved")
        if moved.isEmpty():
            return left


def tree_ancestors(trees: DataFrame, leaves: DataFrame) -> DataFrame:
    """``k, leaf, node, via, height, level``: level counts edges up from the leaf, ``via`` is
    the child on the way."""
    step = trees.select(F.col("k").alias("_k"), F.col("child").alias("_c"), "parent", "height_parent")
    front = trees.join(leaves, F.col("child") == F.col("leaf"), "left_semi").select("k", F.col("child").alias("leaf"), F.col("child").alias("node"), F.lit(None).cast("long").alias("via"), F.col("height_child").alias("height"), F.lit(0).alias("level"))
    every = [front]
    while True:
        if len(every) >= 64 and len(every) & (len(every) - 1) == 0 and len(every) > trees.count():
            raise ValueError("the edges form a cycle")
        # both sides grow with the trees: neither is broadcast, level after level
        up = front.join(step.hint("merge"), (F.col("k") == F.col("_k")) & (F.col("node") == F.col("_c")))
        front = materialize(up.select("k", "leaf", F.col("parent").alias("node"), F.col("_c").alias("via"), F.col("height_parent").alias("height"), (F.col("level") + 1).alias("level")))
        if front.isEmpty():
            return reduce(DataFrame.union, every)
        every.append(front)


def node_facts(up: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``k, leaf, node, via`` above the leaves, and ``k, node, depth, tmrca, size`` of their nodes."""
    top = up.groupBy("k", "leaf").agg(F.max("level").alias("_top"))
    size = up.groupBy("k", "node").agg(F.count("*").alias("size"))
    up = up.where("level > 0")
    depth = up.join(top, ["k", "leaf"]).groupBy("k", "node").agg(F.max(F.col("_top") - F.col("level")).alias("depth"), F.max("height").alias("tmrca"))
    return up.select("k", "leaf", "node", "via"), materialize(depth.join(size, ["k", "node"]), "facts")


def special_metrics(one: Genealogy, two: Genealogy, stabs: DataFrame, behaviour: str, fraction: float = 0.0, seed: int = 1) -> DataFrame:
    """``kc, tmrca_mse, split`` after the first genealogy's trees were changed:
    ``random_resolve`` (both genealogies), ``heuristic_merge`` or ``random_merge``."""
    first, second = trees_at(one, stabs), trees_at(two, stabs)
    if behaviour == "random_resolve":
        first, second = resolve_randomly(first, seed), resolve_randomly(second, seed + 1)
    elif behaviour in ("heuristic_merge", "random_merge"):
        if not 0 <= fraction <= 1:
            raise ValueError("a fraction lies between 0 and 1")
        first = merge_branches(first, fraction, "smallest" if behaviour == "heuristic_merge" else "random", seed)
    else:
        raise ValueError("unknown behaviour")
    met = met_at(*(node_facts(tree_ancestors(materialize(trees), g.leaves)) for trees, g in ((first, one), (second, two))))
    squares = {c: F.sum(F.pow(F.col(c) - F.col(f"{c}2"), 2) * F.col("n")) for c in ("depth", "tmrca", "size")}
    per = met.groupBy("k").agg(squares["depth"].alias("kc"), (squares["tmrca"] / F.sum("n")).alias("tmrca_mse"), (squares["size"] / F.sum("n")).alias("split"))
    return per.agg(F.avg("kc").alias("kc"), F.avg("tmrca_mse").alias("tmrca_mse"), F.avg("split").alias("split"))


def resolved_sets(trees: DataFrame, at: DataFrame, seed: int) -> DataFrame:
    """``k, h1, h2, n_desc, length``: leaf sets (by hash) of the branches that a random resolution
    (``resolve_randomly``) adds to the trees; their length is 0. ``at``: ``nodes_at`` of the trees.

    A new node stands over a range of its parent's children, in their random order. So its set is
    what the sets up to the range's end have beyond those up to its start, and no resolved tree is climbed."""
    below = at.select(F.col("k").alias("_k"), F.col("node").alias("_n"), "n_desc", "h1", "h2")
    d = _ordered(trees, seed).where("_m > 2").join(below.hint("merge"), (F.col("k") == F.col("_k")) & (F.col("child") == F.col("_n")), "left")
    run = Window.partitionBy("k", "parent").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = [F.coalesce(f("n_desc" if c == "_c" else c[1:]).over(run), F.lit(0)).alias(c) for c, f in (("_c", F.sum), ("_h1", F.bit_xor), ("_h2", F.bit_xor))]
    d = materialize(d.select("k", "parent", "_place", "_m", *upto), "ordered")
    new = materialize(_split(d, seed).where("cut > 0").select("k", "parent", "first", "stop"), "split")

    def before(column: str, n: str) -> DataFrame:
        """What the sets have up to the place before each of ``column``."""
        return d.select("k", "parent", (F.col("_place") + 1).alias(column), *[F.col(c).alias(f"{c}{n}") for c in ("_c", "_h1", "_h2")]).hint("merge")

    s = new.join(before("stop", "b"), ["k", "parent", "stop"]).join(before("first", "a"), ["k", "parent", "first"], "left")
    a, b = (lambda c: F.coalesce(f"{c}a", F.lit(0).cast("long"))), (lambda c: F.col(f"{c}b"))
    s = s.select("k", *[b(c).bitwiseXOR(a(c)).alias(c[1:]) for c in ("_h1", "_h2")], (b("_c") - a("_c")).alias("n_desc"), F.lit(0.0).alias("length"))
    return s.where("n_desc > 0")


def resolved_overlap(one: Genealogy, two: Genealogy, anc1: DataFrame, anc2: DataFrame, stabs: DataFrame, seeds: list[int], min_mac: int = 0, max_mac: int = 0) -> DataFrame:
    """``n1, n2, n_common, len1, len2, len_common`` summed over the seeds."""
    n = one.leaves.agg(F.count("*").alias("_n"))

    def given(g, anc):
        """What all seeds share: the trees, their nodes' sets, and the sets of their branches."""
        at = materialize(nodes_at(g, anc, stabs), "nodes")
        return materialize(trees_at(g, stabs), "trees"), at, materialize(sets_at(g, anc, stabs, at).select("k", "h1", "h2", "n_desc", "length"), "sets")

    def sets(trees, at, plain, seed):
        return plain.union(resolved_sets(trees, at, seed)).groupBy("k", "h1", "h2", "n_desc").agg(F.sum("length").alias("l"))

    parts, first, second = [], given(one, anc1), given(two, anc2)
    for seed in seeds:
        a, b = sets(*first, seed), sets(*second, seed + 1000003).select("k", "h1", "h2", F.col("n_desc").alias("_n2"), F.col("l").alias("l2"))
        m = a.join(b, ["k", "h1", "h2"], "full").crossJoin(F.broadcast(n)).withColumn("_c", F.coalesce("n_desc", "_n2"))
        mac = F.least(F.col("_c"), F.col("_n") - F.col("_c"))
        parts.append(m.where((mac >= min_mac) & (mac < (F.lit(max_mac) if max_mac else F.col("_n")))).select("l", "l2"))
    m, both = reduce(DataFrame.union, parts), F.col("l").isNotNull() & F.col("l2").isNotNull()
    return m.agg(F.count("l").alias("n1"), F.count("l2").alias("n2"), F.count_if(both).alias("n_common"), F.sum("l").alias("len1"), F.sum("l2").alias("len2"), F.sum(F.when(both, F.least("l", "l2"))).alias("len_common"))
