"""Sites against the changing tree: one pass over the genome in windows.

A window holds the values of its sites (``site, position, leaf, ...``) and the edges that meet it. A
task goes through the sites in order of position; edges that began and ended since the last site
change the parents of their children, and nothing else of the tree. Counts then run up the
levels of the tree (or values down), all nodes of a level at once. No ancestry is listed, for no
site; windows hold about ``SITE_ROWS`` values, at least one site."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Genealogy
from .statistics import edge_heights
from .windows import _dealer, path_ranks

#: Values of sites in a window.
SITE_ROWS = 200_000


class Trees:
    """The trees of a window, position by position. Nodes are numbered by id; ``parent`` is -1 at
    roots; ``levels`` lists the nodes that have an edge, children before parents."""

    def __init__(self, edges: pa.Table, leaves: np.ndarray) -> None:
        child, parent, self.lft, self.rgt, low, high = (edges.column(c).to_numpy() for c in ("child", "parent", "lft", "rgt", "height_child", "height_parent"))
        self.nodes = np.unique(np.concatenate([child, parent, leaves])) if len(child) else np.unique(leaves)
        self.child, self.up = np.searchsorted(self.nodes, child), np.searchsorted(self.nodes, parent)
        self.height = np.zeros(len(self.nodes))
        self.height[self.child], self.height[self.up] = low, high
        self.parent, self.until = np.full(len(self.nodes), -1), np.full(len(self.nodes), -np.inf)
        self.ins, self.outs, self.i, self.o = np.argsort(self.lft, kind="stable"), np.argsort(self.rgt, kind="stable"), 0, 0
        rank = path_ranks(self.child, self.up, np.ones(len(self.nodes), np.int64))
        order = np.argsort(rank, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(rank[order])) + 1) if len(order) else []

    def place(self, leaves: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.nodes, leaves)

    def move_to(self, x: float) -> None:
        """The tree at ``x``, which is not before the last one."""
        stop = self.i + np.searchsorted(self.lft[self.ins[self.i :]], x, "right")
        e = self.ins[self.i : stop]
        self.parent[self.child[e]], self.until[self.child[e]] = self.up[e], self.rgt[e]  # a child's last edge stays
        self.i = stop
        stop = self.o + np.searchsorted(self.rgt[self.outs[self.o :]], x, "right")
        e = self.outs[self.o : stop]
        e = e[self.until[self.child[e]] == self.rgt[e]]
        self.parent[self.child[e]] = -1
        self.o = stop

    def summed_up(self, counts: np.ndarray) -> np.ndarray:
        """Rows of ``counts`` (one for each node) added to all nodes above."""
        for level in self.levels:
            level = level[self.parent[level] >= 0]
            np.add.at(counts, self.parent[level], counts[level])
        return counts

    def handed_down(self, values: np.ndarray) -> np.ndarray:
        """Values added to all nodes below."""
        for level in reversed(self.levels):
            level = level[self.parent[level] >= 0]
            values[level] += values[self.parent[level]]
        return values


def over_sites(g: Genealogy, rows: DataFrame, answer: Callable[[Trees, int, float, pa.Table], dict | None], schema: str, ids: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """``answer`` of every site: columns of ``schema``, from the trees (moved to its position), the
    site, its position and its rows. ``ids``: the leaves that rows speak of."""
    n = rows.count() // SITE_ROWS
    found = rows.agg(F.percentile_approx("position", [k / n for k in range(1, n)], max(10_000, 20 * n)).alias("q")).first()["q"] if n > 1 else []
    borders = np.array(sorted({float(g.start), float(g.end), *[x for x in found or [] if g.start < x < g.end]}))
    edges = edge_heights(g).select("child", "parent", "lft", "rgt", "height_child", "height_parent")
    dealt = edges.mapInArrow(_dealer(borders), "win long, child long, parent long, lft double, rgt double, height_child double, height_parent double, starts boolean, ends boolean")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            win = np.searchsorted(borders[1:-1], batch.column("position").to_numpy(zero_copy_only=False), "right")
            yield pa.RecordBatch.from_arrays([pa.array(win), *batch.columns], names=["win", *batch.schema.names])

    def run(edges: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by([("position", "ascending"), ("site", "ascending")])
        trees, out = Trees(edges, ids(rows)), []
        site, position = rows.column("site").to_numpy(), rows.column("position").to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], (site[1:] != site[:-1]) | (position[1:] != position[:-1]), [True]])) if len(site) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            trees.move_to(position[a])
            got = answer(trees, int(site[a]), float(position[a]), rows.slice(a, b - a))
            if got is not None:
                out.append(pa.table({"site": np.full(len(next(iter(got.values()))), site[a]), "position": np.full(len(next(iter(got.values()))), position[a])} | got))
        return pa.concat_tables(out) if out else _no_rows(schema)

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = rows.mapInArrow(deal, f"win long, {types}")
    return dealt.groupBy("win").cogroup(placed.groupBy("win")).applyInArrow(run, f"site long, position double, {schema}")


def _no_rows(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}
    fields = [("site", pa.int64()), ("position", pa.float64()), *[(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]]
    return pa.schema(fields).empty_table()


def _leaves(rows: pa.Table) -> np.ndarray:
    return rows.column("leaf").to_numpy()


def _counted(trees: Trees, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Columns all, ones, zeros of each node, and of the site."""
    at, dosage = trees.place(_leaves(rows)), rows.column("dosage")
    counts = np.zeros((len(trees.nodes), 3), np.int64)
    one, zero = (np.asarray(dosage.to_numpy() == v, bool) for v in (1, 0))
    np.add.at(counts, at, np.stack([np.ones(len(at), bool), one, zero], axis=1).astype(np.int64))
    total = counts.sum(axis=0)
    return trees.summed_up(counts), total


def _node_counts(trees: Trees, site: int, position: float, rows: pa.Table) -> dict:
    counts, total = _counted(trees, rows)
    at = np.flatnonzero(counts[:, 0])
    up = trees.parent[at]
    root = up < 0
    above = lambda v: pa.array(v[up], mask=root)
    n, ones, zeros = counts.T
    whole = {k: np.full(len(at), t) for k, t in zip(("n", "ones", "zeros"), total, strict=True)}
    return {
        "node": trees.nodes[at], "parent": above(trees.nodes), "height_child": trees.height[at], "height_parent": above(trees.height),
        "n_desc": n[at], "n1": ones[at], "n0": zeros[at], "up_desc": above(n), "up_n1": above(ones), **whole,
    }


def site_nodes(g: Genealogy, genotypes: DataFrame) -> DataFrame:
    """Per site and node above its leaves: ``node, parent, height_child, height_parent`` (null above
    roots), ``n_desc`` leaves, ``n1`` carriers and ``n0`` known others below, ``up_desc, up_n1`` of the
    parent, and the site's ``n, ones, zeros``."""
    rows = genotypes.select(F.col("site").cast("long").alias("site"), F.col("position").cast("double").alias("position"), F.col("leaf").cast("long").alias("leaf"), F.coalesce(F.col("dosage").cast("int"), F.lit(-1)).alias("dosage"))
    return over_sites(g, rows, _node_counts, "node long, parent long, height_child double, height_parent double, n_desc long, n1 long, n0 long, up_desc long, up_n1 long, n long, ones long, zeros long", _leaves)


def _imputer(single_best: bool):
    def fill(trees: Trees, site: int, position: float, rows: pa.Table) -> dict:
        counts, (n, ones, zeros) = _counted(trees, rows)
        dosage = rows.column("dosage").to_numpy().astype(float)
        known = dosage >= 0
        if not ones or not zeros:
            filled = np.full(len(dosage), 1.0 if not zeros else 0.0)
        else:
            node = np.flatnonzero((trees.parent >= 0) & (counts[:, 1] + counts[:, 2] > 0))
            wrong = ones - counts[node, 1] + counts[node, 2]  # 1 below the branch, 0 elsewhere
            node, sign, cost = np.tile(node, 2), np.repeat([1.0, -1.0], len(node)), np.concatenate([wrong, ones + zeros - wrong])
            best = np.flatnonzero(cost == cost.min()) if len(cost) else np.zeros(0, int)
            node, sign = node[best], sign[best]
            size = trees.height[trees.parent[node]] - trees.height[node]
            if single_best and len(node):
                first = np.lexsort((-sign, trees.nodes[node], -size))[:1]
                node, sign, size = node[first], sign[first], size[first]
            weight = size / size.sum() if len(size) else size
            move = np.zeros(len(trees.nodes))
            np.add.at(move, node, sign * weight)
            filled = np.clip(weight[sign < 0].sum() + trees.handed_down(move)[trees.place(_leaves(rows))], 0.0, 1.0)
        return {"leaf": _leaves(rows), "dosage": np.where(known, dosage, filled)}

    return fill


def imputed(g: Genealogy, genotypes: DataFrame, single_best: bool = False) -> DataFrame:
    """``site, leaf, dosage`` of every row, nulls filled (see ``mapping.impute``)."""
    rows = genotypes.select(F.col("site").cast("long").alias("site"), F.col("position").cast("double").alias("position"), F.col("leaf").cast("long").alias("leaf"), F.coalesce(F.col("dosage").cast("int"), F.lit(-1)).alias("dosage"))
    return over_sites(g, rows, _imputer(single_best), "leaf long, dosage double", _leaves).select("site", "leaf", "dosage")


def _individuals(rows: pa.Table) -> np.ndarray:
    i = rows.column("individual").to_numpy()
    return np.concatenate([2 * i, 2 * i + 1])


def unphased(g: Genealogy, genotypes: DataFrame, place: Callable[..., list[int]]) -> DataFrame:
    """``site, position, child`` from ``place(children, parents, lengths, individuals, doses)`` on each
    site's tree."""
    def answer(trees: Trees, site: int, position: float, rows: pa.Table) -> dict | None:
        at = np.flatnonzero(trees.parent >= 0)
        up = trees.parent[at]
        found = place(trees.nodes[at].tolist(), trees.nodes[up].tolist(), (trees.height[up] - trees.height[at]).tolist(), rows.column("individual").to_pylist(), rows.column("dosage").to_pylist())
        return {"child": np.array(found, np.int64)} if found else None

    rows = genotypes.select(F.col("site").cast("long").alias("site"), F.col("position").cast("double").alias("position"), F.col("individual").cast("long").alias("individual"), F.coalesce(F.col("dosage").cast("int"), F.lit(-1)).alias("dosage"))
    return over_sites(g, rows, answer, "child long", _individuals)
