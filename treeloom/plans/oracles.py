"""DuckDB text of the canonical genealogy and of the relations derived from it."""

from __future__ import annotations


def genealogy(t: str, kind: str = "customer", multiplier: int = 37, shift: int = 1) -> str:
    """CTEs leafs, nodes, edges, muts, eh (edges with heights), anc; names end in ``t``."""
    leaf = "SELECT c_custkey::BIGINT AS leaf, c_nationkey::BIGINT AS nk FROM customer" if kind == "customer" else "SELECT s_suppkey::BIGINT AS leaf, s_nationkey::BIGINT AS nk FROM supplier"
    keys = "SELECT o_orderkey::BIGINT AS k, o_custkey::BIGINT AS leaf FROM orders" if kind == "customer" else f"SELECT p_partkey::BIGINT AS k, (p_partkey*7) % (SELECT count(*) FROM leafs{t}) AS leaf FROM part"
    return f"""
leafs{t} AS ({leaf}),
nodes{t} AS (
  SELECT leaf AS node_id, 0.0::DOUBLE AS height, true AS is_sample FROM leafs{t}
  UNION ALL SELECT 1000000 + n_nationkey, (1 + n_nationkey)::DOUBLE, false FROM nation
  UNION ALL SELECT 2000000 + r_regionkey, (30 + r_regionkey)::DOUBLE, false FROM region
  UNION ALL SELECT 3000000, 40.0::DOUBLE, false),
edges{t} AS (
  SELECT 0.0::DOUBLE AS lft, ((leaf*{multiplier}) % 90 + 5)::DOUBLE AS rgt, 1000000 + nk AS parent, leaf AS child FROM leafs{t}
  UNION ALL SELECT ((leaf*{multiplier}) % 90 + 5)::DOUBLE, 100.0::DOUBLE, 1000000 + (nk + {shift} + leaf % 3) % 25, leaf FROM leafs{t}
  UNION ALL SELECT 0.0, 60.0, 2000000 + n_regionkey, 1000000 + n_nationkey FROM nation
  UNION ALL SELECT 60.0, 100.0, 2000000 + (n_regionkey + 1) % 5, 1000000 + n_nationkey FROM nation
  UNION ALL SELECT 0.0, 100.0, 3000000, 2000000 + r_regionkey FROM region),
eh{t} AS (SELECT e.*, c.height AS hc, p.height AS hp FROM edges{t} e JOIN nodes{t} c ON c.node_id = e.child JOIN nodes{t} p ON p.node_id = e.parent),
mkeys{t} AS ({keys}),
muts{t} AS (
  SELECT m.k AS mut_id, m.position, e.child, e.parent
  FROM (SELECT q.k, ((q.k*17) % 100 + (q.k % 8)/8.0)::DOUBLE AS position, CASE WHEN q.k % 3 = 0 THEN 1000000 + l.nk ELSE q.leaf END AS c FROM mkeys{t} q JOIN leafs{t} l ON l.leaf = q.leaf) m
  JOIN edges{t} e ON e.child = m.c AND e.lft <= m.position AND m.position < e.rgt),
anc{t} AS (
  SELECT leaf, leaf AS node, NULL::BIGINT AS via, 0.0::DOUBLE AS lft, 100.0::DOUBLE AS rgt, 0 AS level FROM leafs{t}
  UNION ALL
  SELECT a.leaf, e.parent, e.child, greatest(a.lft, e.lft), least(a.rgt, e.rgt), a.level + 1
  FROM anc{t} a JOIN edges{t} e ON e.child = a.node AND e.lft < a.rgt AND a.lft < e.rgt)"""


def clades(t: str) -> str:
    return f"""
points{t} AS (SELECT DISTINCT node, x FROM (SELECT node, lft AS x FROM anc{t} UNION ALL SELECT node, rgt FROM anc{t})),
gaps{t} AS (SELECT node, x AS lft, lead(x) OVER (PARTITION BY node ORDER BY x) AS rgt FROM points{t}),
clades{t} AS (SELECT g.node, g.lft, g.rgt, count(*)::BIGINT AS n_desc FROM gaps{t} g JOIN anc{t} a ON a.node = g.node AND a.lft <= g.lft AND g.rgt <= a.rgt GROUP BY ALL)"""


def pieces(t: str) -> str:
    return clades(t) + f""",
pieces{t} AS (SELECT e.parent, e.child, greatest(c.lft, e.lft) AS lft, least(c.rgt, e.rgt) AS rgt, e.hc, e.hp, c.n_desc FROM clades{t} c JOIN eh{t} e ON e.child = c.node AND c.lft < e.rgt AND e.lft < c.rgt)"""


def sets(t: str) -> str:
    return clades(t) + f""",
sets{t} AS (SELECT c.node, c.lft, c.rgt, c.n_desc, string_agg(a.leaf::VARCHAR, ',' ORDER BY a.leaf) AS dsc FROM clades{t} c JOIN anc{t} a ON a.node = c.node AND a.lft <= c.lft AND c.rgt <= a.rgt GROUP BY ALL)"""


def carriers(t: str) -> str:
    return f"""
carr{t} AS (SELECT m.mut_id, m.position, a.leaf FROM muts{t} m JOIN anc{t} a ON a.node = m.child AND a.lft <= m.position AND m.position < a.rgt)"""


def pairs(t: str) -> str:
    """By the minimum over common ancestors on elementary intervals of each pair."""
    return f"""
shared{t} AS (SELECT a.leaf AS i, b.leaf AS j, a.node, greatest(a.lft, b.lft) AS lft, least(a.rgt, b.rgt) AS rgt, n.height
  FROM anc{t} a JOIN anc{t} b ON a.node = b.node AND a.leaf < b.leaf AND a.lft < b.rgt AND b.lft < a.rgt JOIN nodes{t} n ON n.node_id = a.node),
cuts{t} AS (SELECT DISTINCT i, j, x FROM (SELECT i, j, lft AS x FROM shared{t} UNION ALL SELECT i, j, rgt FROM shared{t})),
segs{t} AS (SELECT i, j, x AS lft, lead(x) OVER (PARTITION BY i, j ORDER BY x) AS rgt FROM cuts{t}),
pairs{t} AS (SELECT s.i, s.j, s.lft, s.rgt, min(h.height) AS height, arg_min(h.node, h.height) AS node FROM segs{t} s JOIN shared{t} h ON h.i = s.i AND h.j = s.j AND h.lft <= s.lft AND s.rgt <= h.rgt GROUP BY ALL)"""


def depths(t: str) -> str:
    return f"""
dep{t} AS (
  SELECT 3000000::BIGINT AS node, 0.0::DOUBLE AS lft, 100.0::DOUBLE AS rgt, 0::BIGINT AS depth
  UNION ALL
  SELECT e.child, greatest(d.lft, e.lft), least(d.rgt, e.rgt), d.depth + 1 FROM dep{t} d JOIN edges{t} e ON e.parent = d.node AND e.lft < d.rgt AND d.lft < e.rgt)"""


def facts(t: str) -> str:
    """Pairs with the depth and clade size of their ancestor."""
    return f"""
facts{t} AS (SELECT p.i, p.j, p.height, d.depth, c.n_desc, greatest(p.lft, d.lft, c.lft) AS lft, least(p.rgt, d.rgt, c.rgt) AS rgt
  FROM pairs{t} p JOIN dep{t} d ON d.node = p.node AND d.lft < p.rgt AND p.lft < d.rgt
  JOIN clades{t} c ON c.node = p.node AND c.lft < least(p.rgt, d.rgt) AND greatest(p.lft, d.lft) < c.rgt)"""


def stabs(k: int) -> str:
    return f"stabs AS (SELECT k, (k*0.6180339887498949::DOUBLE) % 1.0 * 100.0 AS x FROM range(1, {k + 1}) r(k))"


GENOTYPES = """
geno AS (SELECT n.n_nationkey::BIGINT AS site, ((n.n_nationkey*17) % 100 + 0.5)::DOUBLE AS position, s.leaf,
  CASE WHEN (s.leaf*3 + n.n_nationkey) % 7 = 0 THEN NULL WHEN (s.nk + n.n_nationkey) % 4 = 0 OR (s.leaf + n.n_nationkey) % 11 = 0 THEN 1 ELSE 0 END AS dosage FROM leafss s CROSS JOIN nation n)"""

KNOWN = "known AS (SELECT site, position, leaf, coalesce(dosage, 0) AS dosage FROM geno)"


def counts(source: str) -> str:
    return f"""
tot AS (SELECT site, count(*) FILTER (dosage = 1) AS ones, count(*) FILTER (dosage = 0) AS zeros, count(*) AS n FROM {source} GROUP BY site),
cnt AS (SELECT w.site, a.node, count(*) AS n_desc, count(*) FILTER (w.dosage = 1) AS n1, count(*) FILTER (w.dosage = 0) AS n0
  FROM {source} w JOIN ancs a ON a.leaf = w.leaf AND a.lft <= w.position AND w.position < a.rgt GROUP BY ALL),
pos AS (SELECT DISTINCT site, position FROM {source}),
tree AS (SELECT p.site, p.position, e.parent, e.child, e.hc, e.hp FROM pos p JOIN ehs e ON e.lft <= p.position AND p.position < e.rgt)"""


PHENOTYPES = """
pheno AS (SELECT c_custkey // 2 AS ind, CASE WHEN bool_and(c_custkey % 11 <> 0) THEN sum(round(c_acctbal*100)::BIGINT)::DOUBLE END AS y FROM customer GROUP BY 1),
ystat AS (SELECT avg(y) AS m, stddev_samp(y) AS s, count(y) AS n FROM pheno),
std AS (SELECT ind, (y - m)/s AS y FROM pheno, ystat WHERE y IS NOT NULL)"""


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts)


def deep(levels: int, length: float) -> str:
    """CTEs moves (leaf, lft, rgt, k) and runs (k, lft, rgt, n): the clades of the chain, from
    the moves that each of its nodes is above."""
    return f"""cuts AS (SELECT DISTINCT o_custkey AS leaf, (o_orderkey*7919) % 65535 + 1 AS x FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) UNION SELECT c_custkey, 0 FROM customer),
moves AS (SELECT leaf, x AS lft, coalesce(lead(x) OVER (PARTITION BY leaf ORDER BY x), {int(length)}) AS rgt, (leaf*31 + x*17) % {levels} AS k FROM cuts),
ends AS (SELECT unnest(range(k, {levels})) AS k, lft AS x, 1 AS s FROM moves UNION ALL SELECT unnest(range(k, {levels})), rgt, -1 FROM moves),
steps AS (SELECT k, x, sum(s) AS s FROM ends GROUP BY k, x),
runs AS (SELECT * FROM (SELECT k, x AS lft, lead(x) OVER w AS rgt, sum(s) OVER w AS n FROM steps WINDOW w AS (PARTITION BY k ORDER BY x)) WHERE n > 0)"""
