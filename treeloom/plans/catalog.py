"""One query per operator over the canonical genealogy, with its SQL.

``@query(sql)`` registers a function (spark, sf_dir) -> DataFrame; without SQL the
query is random or procedural and is tested by invariants or fixtures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import chi2_pvalue
from ..model import Genealogy
from ..storage import materialize
from ..operators import access, association, checks, closure, editing, export, mapping, relatedness, resolution, simulation, statistics
from ..operators.intervals import stab_join
from . import canonical
from . import oracles as o

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
STABS = 4
C, S, D = "c", "s", "d"

CUSTOMER = o.genealogy(C)
SUPPLIER = o.genealogy(S, "supplier")
SECOND = o.genealogy(D, "supplier", 53, 2)


def query(sql: str | None = None):
    def register(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are called {f.__name__}")
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def six(c: Column | str) -> Column:
    """Sums of doubles depend on their order in the last places."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def customers(spark, d) -> Genealogy:
    return canonical.genealogy(spark, d)


def suppliers(spark, d) -> Genealogy:
    return canonical.genealogy(spark, d, "supplier")


def second(spark, d) -> Genealogy:
    return canonical.genealogy(spark, d, "supplier", 53, 2)


def both(spark, d):
    one, two = suppliers(spark, d), second(spark, d)
    return one, two, closure.ancestry(one), closure.ancestry(two)


def points(spark, values, name="x") -> DataFrame:
    return spark.createDataFrame([(float(v),) for v in values], f"{name} double")


# ---- volumes and lineages ----------------------------------------------------------

@query(f"{o.with_(CUSTOMER)} SELECT sum((hp - hc)*(rgt - lft)) AS total_volume FROM ehc")
def total_volume(spark, d):
    return statistics.total_volume(customers(spark, d))


@query(f"{o.with_(CUSTOMER)} SELECT (k*10)::DOUBLE AS a, (k*10 + 10)::DOUBLE AS b, sum((hp - hc)*(least(rgt, k*10.0 + 10) - greatest(lft, k*10.0))) AS volume FROM ehc, range(0, 10) r(k) WHERE lft < k*10.0 + 10 AND k*10.0 < rgt GROUP BY k")
def local_volume(spark, d):
    regions = spark.createDataFrame([(10.0 * k, 10.0 * k + 10) for k in range(10)], "a double, b double")
    return statistics.local_volume(customers(spark, d), regions)


@query(f"{o.with_(CUSTOMER, o.pieces(C))} SELECT r.n AS n_desc, coalesce(sum((hp - hc)*(rgt - lft)), 0.0) AS volume FROM range(0, (SELECT count(*) + 1 FROM leafsc)) r(n) LEFT JOIN piecesc p ON p.n_desc = r.n GROUP BY r.n")
def afs_volume(spark, d):
    g = customers(spark, d)
    return statistics.frequency_spectrum(g)


@query(f"{o.with_(CUSTOMER, o.pieces(C))}, asked AS (SELECT x + 0.5 AS x, h FROM range(0, 100) r(x), (VALUES (0.0), (5.0), (15.0), (29.5), (31.0), (39.0), (40.0), (45.0)) v(h)) SELECT x::DOUBLE AS x, h::DOUBLE AS h, CASE WHEN n = 0 THEN 1 ELSE n END::BIGINT AS n FROM (SELECT a.x, a.h, count(p.child) AS n FROM asked a LEFT JOIN piecesc p ON p.lft <= a.x AND a.x < p.rgt AND p.hc <= a.h AND a.h < p.hp GROUP BY ALL)")
def num_lineages(spark, d):
    g = customers(spark, d)
    asked = spark.createDataFrame([(x + 0.5, h) for x in range(100) for h in (0.0, 5.0, 15.0, 29.5, 31.0, 39.0, 40.0, 45.0)], "x double, h double")
    return statistics.num_lineages(g, closure.clade_sums(g), asked)


# ---- accessors and lookups -----------------------------------------------------------

@query(f"{o.with_(CUSTOMER)} SELECT (SELECT count(*) FROM nodesc) AS num_nodes, (SELECT count(*) FROM leafsc) AS num_samples, (SELECT count(*) FROM edgesc) AS num_edges, (SELECT count(*) FROM mutsc) AS num_mutations, (SELECT count(DISTINCT position) FROM mutsc) AS num_sites")
def counts(spark, d):
    return access.counts(customers(spark, d))


@query(f"{o.with_(CUSTOMER)} SELECT DISTINCT x FROM (SELECT lft AS x FROM edgesc UNION ALL SELECT 0.0)")
def breakpoints(spark, d):
    return access.breakpoints(customers(spark, d))


@query(f"{o.with_(CUSTOMER)} SELECT 3000000::BIGINT AS node, 0.0::DOUBLE AS lft, 100.0::DOUBLE AS rgt")
def roots(spark, d):
    return closure.roots(customers(spark, d))


@query(f"{o.with_(CUSTOMER)} SELECT k::DOUBLE AS x, 3000000::BIGINT AS node FROM range(0, 100) r(k)")
def root_at(spark, d):
    return stab_join(points(spark, range(100)), closure.roots(customers(spark, d)), "x", canonical.LENGTH).select("x", "node")


@query(f"{o.with_(CUSTOMER)} SELECT leaf, (leaf % 100)::DOUBLE AS x, e.parent FROM leafsc JOIN edgesc e ON e.child = leaf AND e.lft <= leaf % 100 AND leaf % 100 < e.rgt")
def parent_edge_at(spark, d):
    g = customers(spark, d)
    return access.parent_edge_at(g, g.leaves.withColumn("x", (F.col("leaf") % 100).cast("double")), "leaf", "x").select("leaf", "x", "parent")


@query(f"{o.with_(CUSTOMER)} SELECT n.node_id, e.child FROM nodesc n JOIN edgesc e ON e.parent = n.node_id AND e.lft <= 62.5 AND 62.5 < e.rgt")
def children_at(spark, d):
    g = customers(spark, d)
    return access.children_at(g, g.nodes.select("node_id", F.lit(62.5).alias("x")), "node_id", "x").select("node_id", "child")


@query(f"{o.with_(CUSTOMER)} SELECT n.node_id, e.child, e.lft, e.rgt FROM nodesc n JOIN edgesc e ON e.parent = n.node_id AND e.lft < 30 AND 20 < e.rgt")
def children_overlap(spark, d):
    g = customers(spark, d)
    return access.children_overlap(g, g.nodes.select("node_id", F.lit(20.0).alias("a"), F.lit(30.0).alias("b")), "node_id", "a", "b").select("node_id", "child", "lft", "rgt")


@query(f"{o.with_(CUSTOMER)} SELECT (row_number() OVER (ORDER BY position) - 1)::BIGINT AS site, position, count(*) AS n_mut FROM mutsc GROUP BY position")
def mutation_sites(spark, d):
    return access.sites(customers(spark, d))


@query(f"{o.with_(CUSTOMER)} SELECT DISTINCT position FROM mutsc")
def site_positions(spark, d):
    return customers(spark, d).mutations.select("position").distinct()


_X = "asked AS (SELECT k*1.5 - 5 AS x FROM range(0, 80) r(k))"


def _asked(spark):
    return points(spark, [1.5 * k - 5 for k in range(80)])


@query(f"{o.with_(CUSTOMER, _X)} SELECT x::DOUBLE AS x, greatest((SELECT count(*) FROM mutsc m WHERE m.position < x) - 1, 0)::BIGINT AS idx FROM asked")
def idx_left_of(spark, d):
    return access.index_left_of(customers(spark, d), _asked(spark))


@query(f"{o.with_(CUSTOMER, _X)} SELECT x::DOUBLE AS x, least((SELECT count(*) FROM mutsc m WHERE m.position <= x), (SELECT count(*) FROM mutsc) - 1)::BIGINT AS idx FROM asked")
def idx_right_of(spark, d):
    return access.index_right_of(customers(spark, d), _asked(spark))


@query(f"{o.with_(CUSTOMER, _X)}, near AS (SELECT x, (SELECT max(position) FROM mutsc WHERE position < x) AS l, (SELECT min(position) FROM mutsc WHERE position >= x) AS r, (SELECT count(*) FROM mutsc WHERE position < x) AS k FROM asked) SELECT x::DOUBLE AS x, (CASE WHEN l IS NULL OR r - x <= x - l THEN k ELSE k - 1 END)::BIGINT AS idx FROM near")
def idx_closest(spark, d):
    return access.index_closest(customers(spark, d), _asked(spark))


@query(f"{o.with_(CUSTOMER)} SELECT mut_id, position, child, parent FROM mutsc WHERE position >= 20 AND position < 40")
def mutations_in_range(spark, d):
    return access.mutations_between(customers(spark, d), 20.0, 40.0).select("mut_id", "position", "child", "parent")


@query(f"{o.with_(CUSTOMER)} SELECT m.mut_id, c.height + (p.height - c.height)/2 AS midpoint_height FROM mutsc m JOIN nodesc c ON c.node_id = m.child JOIN nodesc p ON p.node_id = m.parent")
def midpoint_height(spark, d):
    return access.midpoint_heights(customers(spark, d))


@query(f"{o.with_(CUSTOMER)}, asked AS (SELECT leaf, ((leaf*17) % 100 + 0.25)::DOUBLE AS x FROM leafsc), hit AS (SELECT q.leaf, q.x, a.node, a.level FROM asked q JOIN ancc a ON a.leaf = q.leaf AND a.lft <= q.x AND q.x < a.rgt JOIN mutsc m ON m.child = a.node AND m.position - 0.001 <= q.x AND q.x < m.position + 0.001) SELECT leaf, x, arg_min(node, level) AS child FROM hit GROUP BY leaf, x")
def lowest_mutated_edge(spark, d):
    g = customers(spark, d)
    asked = g.leaves.select("leaf", (F.col("leaf") * 17 % 100 + 0.25).cast("double").alias("x"))
    return access.lowest_mutated_edge(g, closure.ancestry(g), asked)


# ---- closure, sweeps ------------------------------------------------------------------

@query(f"{o.with_(CUSTOMER)} SELECT leaf, node, lft, rgt, level FROM ancc")
def ancestry_closure(spark, d):
    return closure.ancestry(customers(spark, d)).select("leaf", "node", "lft", "rgt", "level")


@query(f"{o.with_(CUSTOMER)} SELECT DISTINCT node, x FROM (SELECT node, lft AS x FROM ancc UNION ALL SELECT node, rgt FROM ancc)")
def node_splits(spark, d):
    a = closure.ancestry(customers(spark, d))
    return a.select("node", F.explode(F.array("lft", "rgt")).alias("x")).distinct()


@query(f"{o.with_(CUSTOMER, o.clades(C))} SELECT * FROM cladesc")
def clades(spark, d):
    return closure.clade_sums(customers(spark, d))


@query(f"{o.with_(CUSTOMER, o.pieces(C))} SELECT p.parent, p.child, c.lft, c.rgt, p.n_desc, (p.hp - p.hc)*(c.rgt - c.lft) AS volume FROM piecesc p JOIN cladesc c ON c.node = p.parent AND p.lft <= c.lft AND c.rgt <= p.rgt")
def branches(spark, d):
    g = customers(spark, d)
    b = closure.branches(g, closure.clade_sums(g))
    return b.select("parent", "child", "lft", "rgt", "n_desc", closure.volume().alias("volume"))


_SETV = "SELECT md5(s.dsc) AS desc_md5, s.n_desc, sum((e.hp - e.hc)*(least(s.rgt, e.rgt) - greatest(s.lft, e.lft))) AS volume FROM setsc s JOIN ehc e ON e.child = s.node AND s.lft < e.rgt AND e.lft < s.rgt GROUP BY s.dsc, s.n_desc"


@query(f"{o.with_(CUSTOMER, o.sets(C))} {_SETV}")
def branch_volume_by_set(spark, d):
    g = customers(spark, d)
    return statistics.set_volumes(g, closure.ancestry(g)).select(F.md5("desc").alias("desc_md5"), "n_desc", "volume")


@query(f"{o.with_(SUPPLIER, o.sets(S))} SELECT md5(s.dsc) AS desc_md5, sum((e.hp - e.hc)*(least(s.rgt, e.rgt) - greatest(s.lft, e.lft))) AS volume FROM setss s JOIN ehs e ON e.child = s.node AND s.lft < e.rgt AND e.lft < s.rgt GROUP BY s.dsc")
def branch_volume_by_tree(spark, d):
    g = suppliers(spark, d)
    return statistics.set_volumes_by_tree(g, closure.ancestry(g), access.breakpoints(g)).select(F.md5("desc").alias("desc_md5"), "volume")


# ---- mutations --------------------------------------------------------------------------

@query(f"{o.with_(CUSTOMER, o.carriers(C))} SELECT mut_id, position, leaf FROM carrc")
def mutation_carriers(spark, d):
    g = customers(spark, d)
    return closure.carriers(g, closure.ancestry(g))


@query(f"{o.with_(CUSTOMER, o.carriers(C))} SELECT mut_id, leaf, 1::BIGINT AS dosage FROM carrc")
def genotype_long(spark, d):
    g = customers(spark, d)
    return access.genotype_rows(g, closure.ancestry(g))


@query(f"{o.with_(CUSTOMER, o.carriers(C))} SELECT mut_id, leaf // 2 AS individual, count(*) AS dosage FROM carrc GROUP BY ALL")
def genotype_diploid(spark, d):
    g = customers(spark, d)
    return access.genotype_rows(g, closure.ancestry(g), diploid=True)


@query(f"{o.with_(SUPPLIER, o.carriers(S))} SELECT m.mut_id, m.position, string_agg(CASE WHEN c.leaf IS NULL THEN '0' ELSE '1' END, '' ORDER BY l.leaf) AS genotype FROM mutss m CROSS JOIN leafss l LEFT JOIN carrs c ON c.mut_id = m.mut_id AND c.leaf = l.leaf GROUP BY ALL")
def mutations_matrix(spark, d):
    g = suppliers(spark, d)
    return access.matrix_lines(g, closure.ancestry(g))


@query(f"{o.with_(CUSTOMER, o.carriers(C))} SELECT position, count(*) AS allele_count FROM carrc GROUP BY position")
def allele_counts(spark, d):
    g = customers(spark, d)
    return access.allele_counts(g)


@query(f"{o.with_(CUSTOMER, o.carriers(C))}, af AS (SELECT position, count(*)/(SELECT count(*) FROM leafsc) AS f FROM carrc GROUP BY position) SELECT m.mut_id, m.position FROM mutsc m JOIN af USING (position) WHERE f BETWEEN 0.01 AND 0.2 OR 1 - f BETWEEN 0.01 AND 0.2")
def keep_within_maf(spark, d):
    g = customers(spark, d)
    return access.keep_within_maf(g, None, 0.01, 0.2).mutations.select("mut_id", "position")


# ---- pairs and comparison -----------------------------------------------------------------

@query(f"{o.with_(SUPPLIER, o.pairs(S))} SELECT i, j, node, height FROM pairss WHERE lft <= 50 AND 50 < rgt")
def mrca_pair(spark, d):
    g = suppliers(spark, d)
    return statistics.pairs_at_position(g, closure.ancestry(g), 50.0)


@query(f"{o.with_(SUPPLIER)}, want AS (SELECT leaf % 25 AS query, leaf FROM leafss), atx AS (SELECT leaf, node FROM ancs WHERE lft <= 50 AND 50 < rgt), hit AS (SELECT query, node, count(*) AS c FROM want JOIN atx USING (leaf) GROUP BY ALL), k AS (SELECT query, count(*) AS k FROM want GROUP BY query) SELECT h.query, arg_min(h.node, n.height) AS node FROM hit h JOIN k ON k.query = h.query AND k.k = h.c JOIN nodess n ON n.node_id = h.node GROUP BY h.query")
def mrca_set(spark, d):
    g = suppliers(spark, d)
    want = g.leaves.select((F.col("leaf") % 25).alias("query"), "leaf")
    return statistics.mrca_of_set(g, closure.ancestry(g), want, 50.0)


@query(f"{o.with_(SUPPLIER, o.pairs(S))} SELECT i, j, lft, rgt, height FROM pairss")
def pair_tmrca(spark, d):
    g = suppliers(spark, d)
    return closure.cut_pairs(closure.ancestry(g), g.nodes)  # the SQL cuts them so


_CMP = "p.i = q.i AND p.j = q.j AND p.lft < q.rgt AND q.lft < p.rgt"
_LEN = "(least(p.rgt, q.rgt) - greatest(p.lft, q.lft))"
_NP = "((SELECT count(*) FROM leafss)*((SELECT count(*) FROM leafss) - 1)/2)"


@query(f"{o.with_(SUPPLIER, o.pairs(S), SECOND, o.pairs(D))} SELECT round(sum((p.height - q.height)**2*{_LEN})/({_NP}*100.0), 6) AS tmrca_mse FROM pairss p JOIN pairsd q ON {_CMP}")
def tmrca_mse(spark, d):
    return statistics.tmrca_mse(*both(spark, d)).select(six("tmrca_mse").alias("tmrca_mse"))


_DEPP = "pd{t} AS (SELECT p.i, p.j, d.depth, greatest(p.lft, d.lft) AS lft, least(p.rgt, d.rgt) AS rgt FROM pairs{t} p JOIN dep{t} d ON d.node = p.node AND d.lft < p.rgt AND p.lft < d.rgt)"


@query(f"{o.with_(SUPPLIER, o.pairs(S), o.depths(S), _DEPP.format(t=S), SECOND, o.pairs(D), o.depths(D), _DEPP.format(t=D))} SELECT round(sum((p.depth - q.depth)**2*{_LEN})/100.0, 6) AS kc FROM pds p JOIN pdd q ON {_CMP}")
def kc_topology(spark, d):
    return statistics.kc_topology(*both(spark, d)).select(six("kc").alias("kc"))


_FACTS = (SUPPLIER, o.pairs(S), o.depths(S), o.clades(S), o.facts(S), SECOND, o.pairs(D), o.depths(D), o.clades(D), o.facts(D), o.stabs(STABS))
_AT = "FROM stabs x JOIN factss p ON p.lft <= x.x AND x.x < p.rgt JOIN factsd q ON q.i = p.i AND q.j = p.j AND q.lft <= x.x AND x.x < q.rgt"


@query(f"{o.with_(*_FACTS)} SELECT round(sum((p.depth - q.depth)**2)/{STABS}, 6) AS kc, round(sum((p.height - q.height)**2)/{_NP}/{STABS}, 6) AS tmrca_mse {_AT}")
def metrics_stab(spark, d):
    one, two, a, b = both(spark, d)
    return statistics.stab_metrics(one, two, a, b, closure.golden_stabs(one, STABS)).select(six("kc").alias("kc"), six("tmrca_mse").alias("tmrca_mse"))


@query(f"{o.with_(*_FACTS)} SELECT round(sum((p.n_desc - q.n_desc)**2)/{_NP}/{STABS}, 6) AS split {_AT}")
def split_size_stab(spark, d):
    one, two, a, b = both(spark, d)
    return statistics.stab_metrics(one, two, a, b, closure.golden_stabs(one, STABS)).select(six("split").alias("split"))


@query(f"{o.with_(*_FACTS)}, m AS (SELECT x.k, p.i, p.j, (p.depth - q.depth)**2/4.0 AS dd, ((p.height - q.height)/2)**2 AS hh {_AT}) SELECT round(sum(dd)/{STABS}, 6) AS kc, round(sum(hh)/{_NP}/{STABS}, 6) AS tmrca_mse FROM m")
def metrics_stab_average(spark, d):
    """Averages over (one, two) against (two, two)."""
    one, two, a, b = both(spark, d)
    r = statistics.averaged_stab_metrics([(one, a), (two, b)], [(two, b), (two, b)], closure.golden_stabs(one, STABS))
    return r.select(six("kc").alias("kc"), six("tmrca_mse").alias("tmrca_mse"))


@query(f"""{o.with_(*_FACTS)}, lam AS (SELECT unnest([0.0, 0.5, 1.0]) AS lam),
e AS (SELECT x.k, p.i, p.j, (p.depth - q.depth)::DOUBLE AS m, (40 - p.height) - (40 - q.height) AS t {_AT}
UNION ALL SELECT x.k, p.child, p.child, 0.0, p.hp - q.hp FROM stabs x JOIN ehs p ON p.lft <= x.x AND x.x < p.rgt AND p.child < 1000000 JOIN ehd q ON q.child = p.child AND q.lft <= x.x AND x.x < q.rgt)
SELECT lam::DOUBLE AS lam, round(sum(((1 - lam)*m + lam*t)**2)/{STABS}, 6) AS value FROM e, lam GROUP BY lam""")
def kc2_length(spark, d):
    one, two, a, b = both(spark, d)
    r = statistics.kc_lengths(one, two, a, b, closure.golden_stabs(one, STABS), [0.0, 0.5, 1.0])
    return r.select("lam", six("value").alias("value"))


@query(f"{o.with_(SUPPLIER, o.pairs(S), o.depths(S), _DEPP.format(t=S))} SELECT p.i, p.j, d.depth, p.height AS tmrca FROM pairss p JOIN deps d ON d.node = p.node AND d.lft <= 50 AND 50 < d.rgt WHERE p.lft <= 50 AND 50 < p.rgt")
def kc_tmrca_vectors(spark, d):
    g = suppliers(spark, d)
    return statistics.kc_tmrca_vectors(g, closure.ancestry(g), 50.0)


_SETS2 = (SUPPLIER, o.sets(S), SECOND, o.sets(D))


@query(f"{o.with_(*_SETS2)}, a AS (SELECT DISTINCT dsc FROM setss WHERE n_desc < (SELECT count(*) FROM leafss)), b AS (SELECT DISTINCT dsc FROM setsd WHERE n_desc < (SELECT count(*) FROM leafss)) SELECT (SELECT count(*) FROM a) AS n1, (SELECT count(*) FROM b) AS n2, (SELECT count(*) FROM a JOIN b USING (dsc)) AS n_common")
def overlap_full(spark, d):
    return statistics.overlap_full(*both(spark, d))


_STABSETS = "ss{t} AS (SELECT x.k, s.dsc, s.n_desc, sum(e.hp - e.hc) AS l FROM stabs x JOIN sets{t} s ON s.lft <= x.x AND x.x < s.rgt JOIN eh{t} e ON e.child = s.node AND e.lft <= x.x AND x.x < e.rgt GROUP BY ALL)"
_OV = (*_SETS2, o.stabs(STABS), _STABSETS.format(t=S), _STABSETS.format(t=D), "m AS (SELECT a.l AS l1, b.l AS l2 FROM sss a FULL JOIN ssd b ON a.k = b.k AND a.dsc = b.dsc)")


@query(f"{o.with_(*_OV)} SELECT count(l1) AS n1, count(l2) AS n2, count(*) FILTER (l1 IS NOT NULL AND l2 IS NOT NULL) AS n_common, sum(l1) AS len1, sum(l2) AS len2, sum(CASE WHEN l1 IS NOT NULL AND l2 IS NOT NULL THEN least(l1, l2) ELSE 0 END) AS len_common FROM m")
def overlap_stab(spark, d):
    one, two, a, b = both(spark, d)
    return statistics.overlap_stab(one, two, a, b, closure.golden_stabs(one, STABS))


@query(f"{o.with_(*_OV)}, t AS (SELECT count(l1) AS n1, count(l2) AS n2, count(*) FILTER (l1 IS NOT NULL AND l2 IS NOT NULL) AS nc, sum(l1) AS s1, sum(l2) AS s2, sum(CASE WHEN l1 IS NOT NULL AND l2 IS NOT NULL THEN least(l1, l2) END) AS sc FROM m), u AS (SELECT sum(CASE WHEN l1 IS NOT NULL AND l2 IS NOT NULL THEN least(l1, l2*s1/s2) END) AS ss FROM m, t) SELECT round((n1 + n2 - 2*nc)/(n1 + n2 - 2*{STABS}*(SELECT count(*) FROM leafss)), 6) AS scaled_robinson_foulds, round(nc/n1, 6) AS branch_recall, round(nc/n2, 6) AS branch_precision, round(sc/s1, 6) AS mutation_recall, round(sc/s2, 6) AS mutation_precision, round(1 - ss/s1, 6) AS total_variation FROM t, u")
def rf_total_variation(spark, d):
    one, two, a, b = both(spark, d)
    r = statistics.rf_total_variation(one, two, a, b, closure.golden_stabs(one, STABS))
    return r.select(*[six(c).alias(c) for c in r.columns])


@query(f"{o.with_(SUPPLIER, o.sets(S))} SELECT s.n_desc, sum(e.hp - e.hc) AS length, s.dsc AS leaves FROM setss s JOIN ehs e ON e.child = s.node AND e.lft <= 50 AND 50 < e.rgt WHERE s.lft <= 50 AND 50 < s.rgt GROUP BY ALL")
def stab_all_bitsets(spark, d):
    g = suppliers(spark, d)
    at = spark.createDataFrame([(1, 50.0)], "k long, x double")
    anc = closure.ancestry(g)
    return closure.with_members(statistics.sets_at(g, anc, at), anc).select("n_desc", "length", F.col("desc").alias("leaves"))


def _vectors(t: str, trees: str) -> str:
    """Depth, height and size at the lowest common node of each pair, tree by tree."""
    return f"""up{t} AS (SELECT k, child AS leaf, child AS node, hc AS height, 0 AS level FROM {trees} WHERE child < 1000000 UNION ALL SELECT u.k, u.leaf, e.parent, e.hp, u.level + 1 FROM up{t} u JOIN {trees} e ON e.k = u.k AND e.child = u.node),
low{t} AS (SELECT a.k, a.leaf AS i, b.leaf AS j, min(a.level) AS level FROM up{t} a JOIN up{t} b ON a.k = b.k AND a.node = b.node AND a.leaf < b.leaf GROUP BY ALL),
deep{t} AS (SELECT k, leaf, max(level) AS top FROM up{t} GROUP BY ALL),
size{t} AS (SELECT k, node, count(*) AS size FROM up{t} GROUP BY ALL),
vec{t} AS (SELECT l.k, l.i, l.j, d.top - l.level AS depth, u.height, s.size FROM low{t} l JOIN up{t} u ON u.k = l.k AND u.leaf = l.i AND u.level = l.level JOIN deep{t} d ON d.k = l.k AND d.leaf = l.i JOIN size{t} s ON s.k = l.k AND s.node = u.node)"""


_TREES = "tree{t} AS (SELECT x.k, e.parent, e.child, e.hc, e.hp FROM stabs x JOIN eh{t} e ON e.lft <= x.x AND x.x < e.rgt)"
_MERGED = """gone AS (SELECT k, child, parent, hp FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY 1 - hc/hp, child) AS r, count(*) OVER (PARTITION BY k) AS n FROM trees WHERE hc > 0) WHERE r <= floor(0.3::DOUBLE*n)),
hung AS (SELECT t.k, t.parent, t.child, t.hc, t.hp FROM trees t ANTI JOIN gone g ON g.k = t.k AND g.child = t.child UNION ALL SELECT h.k, g.parent, h.child, h.hc, g.hp FROM hung h JOIN gone g ON g.k = h.k AND g.child = h.parent),
merged AS (SELECT h.* FROM hung h ANTI JOIN gone g ON g.k = h.k AND g.child = h.parent)"""


@query(f"{o.with_(SUPPLIER, SECOND, o.stabs(STABS), _TREES.format(t=S), _TREES.format(t=D), _MERGED, _vectors(S, 'merged'), _vectors(D, 'treed'))}, per AS (SELECT p.k, sum((p.depth - q.depth)**2) AS kc, avg((p.height - q.height)**2) AS tm, avg((p.size - q.size)**2) AS sp FROM vecs p JOIN vecd q USING (k, i, j) GROUP BY p.k) SELECT round(avg(kc), 6) AS kc, round(avg(tm), 6) AS tmrca_mse, round(avg(sp), 6) AS split FROM per")
def kc_merge(spark, d):
    one, two = suppliers(spark, d), second(spark, d)
    r = resolution.special_metrics(one, two, closure.golden_stabs(one, STABS), "heuristic_merge", fraction=0.3)
    return r.select(*[six(c).alias(c) for c in r.columns])


def _resolved(name: str, trees: str, seed: int) -> str:
    """The trees with their polytomies split by digests: ordered children, ranges cut again and again."""
    return f"""ord{name} AS (SELECT *, row_number() OVER (PARTITION BY k, parent ORDER BY md5('{seed}|' || k || '|' || parent || '|' || child), child) - 1 AS place, count(*) OVER (PARTITION BY k, parent) AS m FROM {trees}),
cut{name} AS (SELECT k, parent, hp, -1 AS above, 0 AS a, m AS b FROM ord{name} WHERE m > 2 AND place = 0
  UNION ALL SELECT k, parent, hp, CASE WHEN above < 0 THEN 0 ELSE c END, CASE side WHEN 0 THEN a ELSE c END, CASE side WHEN 0 THEN c ELSE b END FROM (SELECT *, a + 1 + ('0x' || substr(md5('{seed}|' || k || '|' || parent || '|' || a || '|' || b), 1, 8))::BIGINT % (b - a - 1) AS c, unnest([0, 1]) AS side FROM cut{name} WHERE b - a > 1)),
own{name} AS (SELECT *, CASE WHEN b - a > 1 THEN a + 1 + ('0x' || substr(md5('{seed}|' || k || '|' || parent || '|' || a || '|' || b), 1, 8))::BIGINT % (b - a - 1) ELSE 0 END AS c FROM cut{name} WHERE above >= 0),
res{name} AS (SELECT k, parent, child, hc, hp FROM ord{name} WHERE m <= 2
  UNION ALL SELECT o.k, CASE WHEN above = 0 THEN o.parent ELSE -(o.parent*16777216 + above) END, o.child, o.hc, o.hp FROM ord{name} o JOIN own{name} w ON w.k = o.k AND w.parent = o.parent AND w.c = 0 AND w.a = o.place WHERE o.m > 2
  UNION ALL SELECT k, CASE WHEN above = 0 THEN parent ELSE -(parent*16777216 + above) END, -(parent*16777216 + c), hp, hp FROM own{name} WHERE c > 0)"""


_TREE_BOTH = (SUPPLIER, SECOND, o.stabs(STABS), _TREES.format(t=S), _TREES.format(t=D))


@query(f"{o.with_(*_TREE_BOTH, _resolved(S, 'trees', 5), _resolved(D, 'treed', 6), _vectors(S, 'ress').replace('child < 1000000', 'child BETWEEN 0 AND 999999'), _vectors(D, 'resd').replace('child < 1000000', 'child BETWEEN 0 AND 999999'))}, per AS (SELECT p.k, sum((p.depth - q.depth)**2) AS kc, avg((p.height - q.height)**2) AS tm, avg((p.size - q.size)**2) AS sp FROM vecs p JOIN vecd q USING (k, i, j) GROUP BY p.k) SELECT round(avg(kc), 6) AS kc, round(avg(tm), 6) AS tmrca_mse, round(avg(sp), 6) AS split FROM per")
def kc_random_resolve(spark, d):
    one, two = suppliers(spark, d), second(spark, d)
    r = resolution.special_metrics(one, two, closure.golden_stabs(one, STABS), "random_resolve", seed=5)
    return r.select(*[six(c).alias(c) for c in r.columns])


def _branch_sets(t: str, trees: str) -> str:
    """Leaf sets of a tree's branches with their lengths."""
    return f"""bup{t} AS (SELECT k, child AS leaf, child AS node FROM {trees} WHERE child BETWEEN 0 AND 999999 UNION ALL SELECT u.k, u.leaf, e.parent FROM bup{t} u JOIN {trees} e ON e.k = u.k AND e.child = u.node),
bset{t} AS (SELECT k, node, count(*) AS c, string_agg(leaf::VARCHAR, ',' ORDER BY leaf) AS dsc FROM bup{t} GROUP BY k, node),
blen{t} AS (SELECT s.k, s.dsc, s.c, sum(e.hp - e.hc) AS l FROM bset{t} s JOIN {trees} e ON e.k = s.k AND e.child = s.node GROUP BY ALL)"""


def _rf(seed: int) -> str:
    n, m = f"s{seed}", f"d{seed}"
    return f"{_resolved(n, 'trees', seed)}, {_resolved(m, 'treed', seed + 1000003)}, {_branch_sets(n, 'res' + n)}, {_branch_sets(m, 'res' + m)}"


_RF = " UNION ALL ".join(f"SELECT p.l, q.l AS l2, coalesce(p.c, q.c) AS c FROM blens{k} p FULL JOIN blend{k} q ON q.k = p.k AND q.dsc = p.dsc" for k in (1, 2))


@query(f"{o.with_(*_TREE_BOTH, _rf(1), _rf(2))}, every AS (SELECT e.*, least(c, n - c) AS mac, n FROM ({_RF}) e, (SELECT count(*) AS n FROM leafss)) SELECT count(l) AS n1, count(l2) AS n2, count(*) FILTER (l IS NOT NULL AND l2 IS NOT NULL) AS n_common, round(sum(l), 6) AS len1, round(sum(l2), 6) AS len2, round(sum(least(l, l2)) FILTER (l IS NOT NULL AND l2 IS NOT NULL), 6) AS len_common FROM every WHERE mac >= 0 AND mac < n")
def rf_resolve(spark, d):
    one, two, a, b = both(spark, d)
    r = resolution.resolved_overlap(one, two, a, b, closure.golden_stabs(one, STABS), [1, 2])
    return r.select("n1", "n2", "n_common", *[six(c).alias(c) for c in ("len1", "len2", "len_common")])


# ---- genotypes ------------------------------------------------------------------------------

_GENO = (SUPPLIER, o.GENOTYPES, o.KNOWN, o.counts("known"))


def _known(spark, d):
    return canonical.genotypes(spark, d).withColumn("dosage", F.coalesce("dosage", F.lit(0)))


_BEST = "best AS (SELECT c.site, min(least(t.ones - 2*c.n1 + c.n_desc, t.n - (t.ones - 2*c.n1 + c.n_desc))) AS dist FROM cnt c JOIN tot t USING (site) GROUP BY c.site), dist AS (SELECT site, (CASE WHEN t.ones <= 1 OR t.ones >= t.n - 1 THEN 0 ELSE b.dist END)::BIGINT AS distance FROM best b JOIN tot t USING (site))"


@query(f"{o.with_(*_GENO, _BEST)} SELECT site, distance FROM dist")
def mutation_best(spark, d):
    g = suppliers(spark, d)
    return mapping.mutation_best(g, _known(spark, d)).select("site", F.col("distance").cast("long").alias("distance"))


@query(f"{o.with_(*_GENO)} SELECT c.site, bool_or((n1 = n_desc AND n1 = ones) OR (n1 = 0 AND n_desc = n - ones) OR ones = 0 OR ones = n) AS matched FROM cnt c JOIN tot t USING (site) GROUP BY c.site")
def mutation_match(spark, d):
    g = suppliers(spark, d)
    return mapping.mutation_match(g, _known(spark, d))


@query(f"{o.with_(*_GENO, _BEST)} SELECT (CASE WHEN least(ones, zeros) >= 2 THEN 1 ELSE 0 END + CASE WHEN least(ones, zeros) >= 25 THEN 1 ELSE 0 END)::INT AS bin, count(*) AS n_sites, count(*) FILTER (distance > 0) AS n_wrong, sum(distance)::BIGINT AS distance FROM dist JOIN tot USING (site) GROUP BY 1")
def mutation_match_binned(spark, d):
    g = suppliers(spark, d)
    r = mapping.match_binned(g, _known(spark, d), [2, 25])
    return r.select("bin", "n_sites", "n_wrong", F.col("distance").cast("long").alias("distance"))


def _impute_sql(single: bool) -> str:
    pick = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY len DESC, node, sgn DESC) AS r FROM best0) WHERE r = 1)" if single else "best AS (SELECT * FROM best0)"
    return f"""{o.with_(SUPPLIER, o.GENOTYPES, o.counts("geno"))},
ways AS (SELECT c.site, c.node, t.hp - t.hc AS len, o.ones - c.n1 + c.n0 AS cost, 1.0 AS sgn FROM cnt c JOIN tot o USING (site) JOIN tree t ON t.site = c.site AND t.child = c.node WHERE c.n1 + c.n0 > 0
 UNION ALL SELECT c.site, c.node, t.hp - t.hc, o.zeros + c.n1 - c.n0, -1.0 FROM cnt c JOIN tot o USING (site) JOIN tree t ON t.site = c.site AND t.child = c.node WHERE c.n1 + c.n0 > 0),
best0 AS (SELECT w.* FROM ways w JOIN (SELECT site, min(cost) AS m FROM ways GROUP BY site) m ON m.site = w.site AND m.m = w.cost),
{pick},
wts AS (SELECT *, len/sum(len) OVER (PARTITION BY site) AS w FROM best),
base AS (SELECT site, sum(CASE WHEN sgn < 0 THEN w ELSE 0 END) AS b FROM wts GROUP BY site),
mv AS (SELECT w.site, a.leaf, sum(w.sgn*w.w) AS m FROM wts w JOIN pos p USING (site) JOIN ancs a ON a.node = w.node AND a.lft <= p.position AND p.position < a.rgt GROUP BY ALL)
SELECT g.site, g.leaf, round(coalesce(g.dosage::DOUBLE, CASE WHEN t.zeros = 0 THEN 1.0 WHEN t.ones = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, coalesce(b.b, 0) + coalesce(m.m, 0))) END::DOUBLE), 6) AS dosage
FROM geno g JOIN tot t USING (site) LEFT JOIN base b USING (site) LEFT JOIN mv m ON m.site = g.site AND m.leaf = g.leaf"""


@query(_impute_sql(False))
def impute_new(spark, d):
    g = suppliers(spark, d)
    return mapping.impute(g, canonical.genotypes(spark, d)).select("site", "leaf", six("dosage").alias("dosage"))


@query(_impute_sql(True))
def impute_old(spark, d):
    g = suppliers(spark, d)
    return mapping.impute(g, canonical.genotypes(spark, d), single_best=True).select("site", "leaf", six("dosage").alias("dosage"))


_MAP = "full_ AS (SELECT site, node FROM cnt WHERE n1 = n_desc), placed AS (SELECT t.site, t.position, t.child, t.parent FROM tree t JOIN full_ f ON f.site = t.site AND f.node = t.child WHERE NOT EXISTS (SELECT 1 FROM full_ g WHERE g.site = t.site AND g.node = t.parent))"


@query(f"{o.with_(*_GENO, _MAP)} SELECT site, position, child, parent FROM placed")
def map_genotypes_batch(spark, d):
    g = suppliers(spark, d)
    return mapping.map_parsimony(g, _known(spark, d))


@query(f"{o.with_(*_GENO, _MAP)} SELECT child, parent FROM placed WHERE site = 3")
def map_genotype(spark, d):
    """One site, given by its position."""
    g = suppliers(spark, d)
    return mapping.map_parsimony(g, _known(spark, d).where("site = 3")).select("child", "parent")


_FEW = """
known AS (SELECT n.n_nationkey::BIGINT AS site, ((n.n_nationkey*17) % 100 + 0.5)::DOUBLE AS position, s.leaf, ((s.leaf BETWEEN n.n_nationkey + 1 AND n.n_nationkey + 3) <> (n.n_nationkey % 2 = 1))::BIGINT AS dosage FROM leafss s CROSS JOIN nation n)"""


@query(f"""{o.with_(SUPPLIER, _FEW, o.counts("known"), _MAP)}, inv AS (SELECT c.site, c.node FROM cnt c JOIN tot t USING (site) WHERE c.n1 = 0 AND t.ones > 4 AND t.n - t.ones <= 4),
mid AS (SELECT c.site, c.node, t.n, (t.ones - 2*c.n1 + c.n_desc)/t.n AS penalty, e.hc FROM cnt c JOIN tot t USING (site) JOIN tree e ON e.site = c.site AND e.child = c.node
 WHERE t.ones > 4 AND t.n - t.ones > 4 AND c.n1/greatest(c.n_desc, t.ones) > 0.7 AND (t.n - t.ones - c.n_desc + c.n1)/greatest(t.n - c.n_desc, t.n - t.ones) > 0.7)
SELECT site, child, 0.0::DOUBLE AS penalty FROM placed JOIN tot USING (site) WHERE ones <= 4
UNION ALL SELECT t.site, t.child, 0.0 FROM tree t JOIN inv f ON f.site = t.site AND f.node = t.child WHERE NOT EXISTS (SELECT 1 FROM inv g WHERE g.site = t.site AND g.node = t.parent)
UNION ALL SELECT site, node, round(penalty, 6) FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY penalty, hc, node) AS r FROM mid WHERE penalty < 0.03) WHERE r = 1""")
def map_approximate(spark, d):
    """Three carriers at each even site, three others at each odd one."""
    g, q = suppliers(spark, d), canonical.genotypes(spark, d)
    three = F.col("leaf").between(F.col("site") + 1, F.col("site") + 3)
    q = q.withColumn("dosage", (three != (F.col("site") % 2 == 1)).cast("long"))
    return mapping.map_approximate(g, q).select("site", "child", six("penalty").alias("penalty"))


@query()
def map_diploid(spark, d):
    """Unphased genotypes: the sum over each pair of suppliers."""
    g = suppliers(spark, d)
    dose = _known(spark, d).groupBy("site", "position", F.expr("leaf div 2").alias("individual")).agg(F.sum("dosage").alias("dosage"))
    return mapping.map_diploid(g, dose)


# ---- matrices ---------------------------------------------------------------------------------

@query(f"{o.with_(SUPPLIER, o.pairs(S))} SELECT i, j, sum(height*(rgt - lft)) AS value FROM pairss GROUP BY i, j")
def distance_matrix(spark, d):
    g = suppliers(spark, d)
    return relatedness.tmrca_distance(g, closure.ancestry(g))


def _between(weight: str, scale: str, where: str = "true") -> str:
    """In or out of each branch, leaf by leaf: the definition."""
    return f"""w AS (SELECT row_number() OVER () AS b, child, lft, rgt, (hp - hc)*(rgt - lft)*{scale}*{weight} AS w FROM (SELECT *, least(n_desc, (SELECT count(*) FROM leafss) - n_desc)/(SELECT count(*) FROM leafss) AS maf FROM piecess) WHERE {where}),
below AS (SELECT w.b, w.w, a.leaf FROM w JOIN ancs a ON a.node = w.child AND a.lft <= w.lft AND w.rgt <= a.rgt),
diag AS (SELECT leaf, sum(w) AS a FROM below GROUP BY leaf),
off AS (SELECT p.leaf AS i, q.leaf AS j, sum(p.w) AS a FROM below p JOIN below q ON p.b = q.b AND p.leaf < q.leaf GROUP BY ALL),
dist AS (SELECT x.leaf AS i, y.leaf AS j, x.a + y.a - 2*coalesce(o.a, 0) AS value FROM diag x JOIN diag y ON x.leaf < y.leaf LEFT JOIN off o ON o.i = x.leaf AND o.j = y.leaf)"""


@query(f"{o.with_(SUPPLIER, o.pieces(S), _between('1.0', '0.5'))} SELECT i, j, round(value, 6) AS value FROM dist")
def distance_matrix_v2(spark, d):
    g = suppliers(spark, d)
    return relatedness.branch_distance(g, closure.ancestry(g)).select("i", "j", six("value").alias("value"))


def _bins_sql() -> str:
    parts = []
    for k, (lo, hi) in enumerate(((0, 0.02), (0.02, 0.1), (0.1, 2))):
        parts.append(f"SELECT {k}::INT AS bin, i, j, round(value, 6) AS value FROM ({o.with_(SUPPLIER, o.pieces(S), _between(f'CASE WHEN maf >= {lo} AND maf < {hi} THEN 1.0 ELSE 0.0 END', '1.0'))} SELECT * FROM dist)")
    return " UNION ALL ".join(parts)


@query(_bins_sql())
def distance_maf_bins(spark, d):
    g = suppliers(spark, d)
    return relatedness.branch_distance_bins(g, closure.ancestry(g), [0.0, 0.02, 0.1]).select("bin", "i", "j", six("value").alias("value"))


_DIP = "sq AS (SELECT i, j, value FROM dist UNION ALL SELECT j, i, value FROM dist UNION ALL SELECT leaf, leaf, 0.0 FROM leafss), dip AS (SELECT i // 2 AS i, j // 2 AS j, sum(value) AS value FROM sq GROUP BY 1, 2)"
_ALPHA = "CASE WHEN maf*(1 - maf) > 0 THEN 1/(maf*(1 - maf)) ELSE 0.0 END"


@query(f"{o.with_(SUPPLIER, o.pieces(S), _between(_ALPHA, '0.5'), _DIP)} SELECT i, j, round(value, 6) AS value FROM dip")
def exact_grm(spark, d):
    g = suppliers(spark, d)
    return relatedness.exact_relationship(g, closure.ancestry(g), centred=False).select("i", "j", six("value").alias("value"))


@query(f"""{o.with_(SUPPLIER, o.pieces(S), _between(_ALPHA, '0.5'), _DIP)}, rc AS (SELECT d.i, d.j, d.value - avg(d.value) OVER (PARTITION BY d.i) - avg(d.value) OVER (PARTITION BY d.j) + avg(d.value) OVER () AS value FROM dip d),
s AS (SELECT sum(value) FILTER (i = j) AS t, avg(value) AS m, count(DISTINCT i) AS n FROM rc) SELECT i, j, round(value*(n - 1)/(t - n*m), 6) AS value FROM rc, s""")
def grm_centered(spark, d):
    g = suppliers(spark, d)
    return relatedness.exact_relationship(g, closure.ancestry(g)).select("i", "j", six("value").alias("value"))


@query(f"""{o.with_(SUPPLIER, o.carriers(S))}, dose AS (SELECT m.mut_id, l.leaf // 2 AS i, count(c.leaf)::DOUBLE AS d FROM mutss m CROSS JOIN leafss l LEFT JOIN carrs c ON c.mut_id = m.mut_id AND c.leaf = l.leaf GROUP BY ALL),
st AS (SELECT mut_id, avg(d) AS m, var_samp(d) AS v, sum(d) AS k FROM dose GROUP BY mut_id), ok AS (SELECT *, CASE WHEN v > 0 THEN 1/v ELSE 1.0 END AS f FROM st WHERE k > 0 AND k < (SELECT count(*) FROM leafss) AND least(k, (SELECT count(*) FROM leafss) - k)/(SELECT count(*) FROM leafss) <= 0.5)
SELECT a.i, b.i AS j, round(sum(o.f*(a.d - o.m)*(b.d - o.m)), 6) AS value FROM ok o JOIN dose a USING (mut_id) JOIN dose b USING (mut_id) GROUP BY a.i, b.i""")
def grm_from_mutations(spark, d):
    g = suppliers(spark, d)
    return relatedness.mutation_relationship(g, closure.ancestry(g)).select("i", "j", six("value").alias("value"))


def _samples(spark, d):
    g = suppliers(spark, d)
    ids = g.leaves.select(F.expr("leaf div 2").alias("sample")).distinct()
    return ids.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select("k", "sample", ((F.col("sample") * 7 + F.col("k")) % 5 - 2).cast("double").alias("value"))


_DOSE = "dose AS (SELECT position, leaf // 2 AS sample, count(*) AS d FROM carrs GROUP BY ALL), af AS (SELECT position, count(*)/(SELECT count(*) FROM leafss) AS p FROM carrs GROUP BY position), op AS (SELECT DISTINCT k, leaf // 2 AS sample, (((leaf // 2)*7 + k) % 5 - 2)::DOUBLE AS value FROM leafss, range(0, 2) r(k))"


@query(f"{o.with_(SUPPLIER, o.carriers(S), _DOSE)} SELECT k::INT AS k, position, round(sum(d*value), 6) AS value FROM dose JOIN op USING (sample) GROUP BY ALL")
def matmul_mutations(spark, d):
    g = suppliers(spark, d)
    return relatedness.multiply(g, None, _samples(spark, d), "mutations", diploid=True).select("k", "position", six("value").alias("value"))


@query(f"{o.with_(SUPPLIER, o.carriers(S), _DOSE)} SELECT o.k::INT AS k, a.position, round(CASE WHEN a.p*(1 - a.p) > 0 THEN (2*a.p*(1 - a.p))**-0.5 ELSE 0.0 END*sum((coalesce(x.d, 0) - 2*a.p)*o.value), 6) AS value FROM af a CROSS JOIN op o LEFT JOIN dose x ON x.position = a.position AND x.sample = o.sample GROUP BY o.k, a.position, a.p")
def matmul_mutations_standard(spark, d):
    g = suppliers(spark, d)
    r = relatedness.multiply(g, None, _samples(spark, d), "mutations", standardise=True, alpha=-1.0, diploid=True)
    return r.select("k", "position", six("value").alias("value"))


def _site_matrix(spark, d):
    p = suppliers(spark, d).mutations.select("position").distinct()
    return p.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select("position", "k", ((F.col("position") * 8).cast("long") % (F.col("k") + 3) - 1).cast("double").alias("value"))


_SITE = "op2 AS (SELECT DISTINCT position, k, ((position*8)::BIGINT % (k + 3) - 1)::DOUBLE AS value FROM mutss, range(0, 2) r(k))"


@query(f"{o.with_(SUPPLIER, o.carriers(S), _SITE)} SELECT leaf AS sample, k::INT AS k, sum(d*value)::DOUBLE AS value FROM (SELECT position, leaf, count(*) AS d FROM carrs GROUP BY ALL) JOIN op2 USING (position) GROUP BY ALL")
def matmul_samples(spark, d):
    g = suppliers(spark, d)
    return relatedness.multiply(g, closure.ancestry(g), _site_matrix(spark, d), "samples")


@query(f"{o.with_(SUPPLIER, o.carriers(S), _DOSE, _SITE)}, every AS (SELECT DISTINCT leaf // 2 AS sample FROM leafss) SELECT e.sample, w.k::INT AS k, round(sum(w.value*CASE WHEN a.p*(1 - a.p) > 0 THEN (2*a.p*(1 - a.p))**-0.5 ELSE 0.0 END*(coalesce(x.d, 0) - 2*a.p)), 6) AS value FROM every e CROSS JOIN op2 w JOIN af a USING (position) LEFT JOIN dose x ON x.position = w.position AND x.sample = e.sample GROUP BY e.sample, w.k")
def matmul_samples_standard(spark, d):
    g = suppliers(spark, d)
    r = relatedness.multiply(g, closure.ancestry(g), _site_matrix(spark, d), "samples", standardise=True, alpha=-1.0, diploid=True)
    return r.select("sample", "k", six("value").alias("value"))


@query(f"{o.with_(SUPPLIER, o.carriers(S))}, ind AS (SELECT DISTINCT leaf // 2 AS i FROM leafss), op AS (SELECT i, k, ((i*3 + k) % 4 + 1)::DOUBLE AS w FROM ind, range(0, 2) r(k)), dose AS (SELECT m.mut_id, i.i, count(c.leaf) AS d FROM mutss m CROSS JOIN ind i LEFT JOIN carrs c ON c.mut_id = m.mut_id AND c.leaf // 2 = i.i GROUP BY ALL), mean AS (SELECT mut_id, avg(d) AS m FROM dose GROUP BY mut_id HAVING sum(d) > 0) SELECT mut_id, k::INT AS k, round(sum(w*(d - m)**2), 6) AS value FROM dose JOIN mean USING (mut_id) JOIN op ON op.i = dose.i GROUP BY ALL")
def weighted_sq_norm(spark, d):
    g = suppliers(spark, d)
    w = g.leaves.select(F.expr("leaf div 2").alias("individual")).distinct().withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    w = w.select("individual", "k", ((F.col("individual") * 3 + F.col("k")) % 4 + 1).cast("double").alias("value"))
    return relatedness.weighted_square_norm(g, closure.ancestry(g), w).select("mut_id", "k", six("value").alias("value"))


# ---- association ---------------------------------------------------------------------------------

_TEST = f"""{o.with_(CUSTOMER, o.clades(C), o.PHENOTYPES)},
inside AS (SELECT c.node, c.lft, c.rgt, a.leaf, a.leaf // 2 AS ind, s.y FROM cladesc c JOIN ancc a ON a.node = c.node AND a.lft <= c.lft AND c.rgt <= a.rgt LEFT JOIN std s ON s.ind = a.leaf // 2),
per AS (SELECT node, lft, rgt, ind, max(y) AS y, count(y) AS k FROM inside GROUP BY ALL),
cl AS (SELECT node, lft, rgt, sum(k) AS oc, coalesce(sum(k*y), 0) AS os, count(*) FILTER (k = 2) AS cross_ FROM per GROUP BY ALL),
t AS (SELECT cl.*, n, round(least(oc, 2*n - oc))::BIGINT AS mac, oc - oc*oc/n + 2*cross_ AS norm FROM cl, ystat),
u AS (SELECT * FROM t WHERE mac > 0)"""


@query(f"{_TEST} SELECT node, lft, rgt, mac, round(mac/(2*n), 9) AS maf, round(coalesce(os*os/nullif(norm, 0), 0), 6) AS chi2 FROM u")
def assoc_all(spark, d):
    g = customers(spark, d)
    r = association.associate_clades(closure.ancestry(g), canonical.phenotypes(spark, d))
    return r.select("node", "lft", "rgt", "mac", F.round("maf", 9).alias("maf"), six("chi2").alias("chi2"))


@query(f"{_TEST} SELECT node, lft, rgt, mac, round(coalesce((n - 2)/nullif((n - 1)*norm/nullif(os*os, 0) - 1, 0), 0)/1.5, 6) AS chi2 FROM u WHERE mac >= round(2*n*0.01)")
def assoc_careful(spark, d):
    g = customers(spark, d)
    r = association.associate_clades(closure.ancestry(g), canonical.phenotypes(spark, d), min_maf=0.01, calibration=1.5, careful=True)
    return r.select("node", "lft", "rgt", "mac", six("chi2").alias("chi2"))


@query()
def assoc_pvalues(spark, d):
    """The association file's rows, with short p-values."""
    g = customers(spark, d)
    return export.association_table(association.associate_clades(closure.ancestry(g), canonical.phenotypes(spark, d)), 1)


@query()
def assoc_mutation(spark, d):
    g = customers(spark, d)
    return association.associate_mutations(g, closure.ancestry(g), canonical.phenotypes(spark, d), [1e-5, 1e-3], seed=7)


def _trait(spark, d):
    c = canonical.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("leaf"), F.round(F.col("c_acctbal") * 100).cast("long").cast("double").alias("y"))


_HAP = f"""{o.with_(CUSTOMER, o.clades(C))}, y0 AS (SELECT c_custkey AS leaf, round(c_acctbal*100)::BIGINT::DOUBLE AS y FROM customer), st AS (SELECT avg(y) AS m, stddev_samp(y) AS s, count(*)::DOUBLE AS n FROM y0),
z AS (SELECT leaf, (y - m)/s AS y FROM y0, st),
hc AS (SELECT c.node, c.lft, c.rgt, c.n_desc, sum(z.y) AS os FROM cladesc c JOIN ancc a ON a.node = c.node AND a.lft <= c.lft AND c.rgt <= a.rgt JOIN z ON z.leaf = a.leaf GROUP BY ALL),
ht AS (SELECT node, lft, rgt, n_desc, (os/(sqrt(n_desc/n*(1 - n_desc/n)*n/(n - 1))*n))**2*(n - 2) AS chi2 FROM hc, st WHERE n_desc < n)"""


@query(f"{_HAP} SELECT round(h.chi2, 6) AS chi2, round(sum((e.hp - e.hc)*(least(h.rgt, e.rgt) - greatest(h.lft, e.lft))), 6) AS volume, h.node, h.lft AS start, h.rgt AS end FROM ht h JOIN ehc e ON e.child = h.node AND h.lft < e.rgt AND e.lft < h.rgt GROUP BY h.chi2, h.node, h.lft, h.rgt ORDER BY h.chi2 DESC, volume DESC LIMIT 20")
def assoc_haploid_topk(spark, d):
    g = customers(spark, d)
    r = association.haploid_top(g, closure.ancestry(g), _trait(spark, d), k=20)
    return r.select(six("chi2").alias("chi2"), six("volume").alias("volume"), "node", "start", "end")


@query(f"{_HAP}, cut AS (SELECT DISTINCT x FROM (SELECT lft AS x FROM ht UNION ALL SELECT rgt FROM ht)), seg AS (SELECT x AS a, lead(x) OVER (ORDER BY x) AS b FROM cut) SELECT s.a AS start, s.b AS end, round(max(h.chi2), 6) AS chi2 FROM seg s JOIN ht h ON h.lft <= s.a AND s.b <= h.rgt GROUP BY s.a, s.b")
def assoc_haploid_max(spark, d):
    g = customers(spark, d)
    return association.haploid_max(g, closure.ancestry(g), _trait(spark, d), compress=False).select("start", "end", six("chi2").alias("chi2"))


@query()
def null_min_p(spark, d):
    """Least p-value over all clades for eight random traits."""
    g = customers(spark, d)
    ids = g.leaves.select(F.expr("leaf div 2").alias("individual")).distinct().crossJoin(spark.range(8).withColumnRenamed("id", "seed"))
    y = (F.xxhash64("seed", "individual") / float(2**62)).alias("y")
    return association.null_model(closure.ancestry(g), ids.select("seed", "individual", y))


@query(f"{o.with_(o.PHENOTYPES)}, b AS (SELECT p.ind, p.y, -2*((p.ind*13) % 17)::DOUBLE AS blup FROM pheno p WHERE p.y IS NOT NULL) SELECT ind AS individual, round(y - avg(y) OVER () - (blup - avg(blup) OVER ()), 6) AS residual FROM b")
def residual_pheno(spark, d):
    """Centred phenotype minus centred predictor (minus twice an average score)."""
    p = canonical.phenotypes(spark, d).where("y is not null")
    b = association.predictor_of_scores(p.select("individual", (F.col("individual") * 13 % 17).cast("double").alias("average")), 1)
    return association.residual(p, b).select("individual", six("residual").alias("residual"))


@query(f"{_TEST}, b AS (SELECT CASE WHEN mac/(2*n) < 0.01 THEN 0 WHEN mac/(2*n) < 0.1 THEN 1 ELSE 2 END AS bin, coalesce(os*os/nullif(norm, 0), 0) AS chi2 FROM u) SELECT bin::INT AS bin, count(*) AS n_tests, round(max(chi2), 6) AS max_chi2 FROM b GROUP BY bin")
def assoc_by_maf_bin(spark, d):
    """Tests and best statistic per class of minor allele frequency."""
    g = customers(spark, d)
    r = association.associate_clades(closure.ancestry(g), canonical.phenotypes(spark, d))
    r = r.withColumn("bin", F.when(F.col("maf") < 0.01, 0).when(F.col("maf") < 0.1, 1).otherwise(2))
    return r.groupBy("bin").agg(F.count("*").alias("n_tests"), six(F.max("chi2")).alias("max_chi2"))


# ---- export -------------------------------------------------------------------------------------------

_INNER = "x AS (SELECT DISTINCT dsc, n_desc, lft, rgt FROM setss WHERE n_desc < (SELECT count(*) FROM leafss)), m AS (SELECT *, CASE WHEN lft <= max(rgt) OVER (PARTITION BY dsc ORDER BY lft, rgt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM x{w}), r AS (SELECT *, sum(nw) OVER (PARTITION BY dsc ORDER BY lft, rgt) AS run FROM m)"


@query(f"{o.with_(SUPPLIER, o.sets(S), _INNER.format(w=''))} SELECT dsc AS leaves, n_desc, min(lft) AS lft, max(rgt) AS rgt FROM r GROUP BY dsc, n_desc, run")
def bitset_extents(spark, d):
    g = suppliers(spark, d)
    return export.set_extents(g, closure.ancestry(g)).withColumnRenamed("desc", "leaves")


@query(f"{o.with_(SUPPLIER, o.sets(S), _INNER.format(w=' WHERE least(n_desc, (SELECT count(*) FROM leafss) - n_desc) BETWEEN 2 AND 30'))} SELECT dsc AS leaves, n_desc, min(lft) AS lft, max(rgt) AS rgt FROM r GROUP BY dsc, n_desc, run")
def bitset_runs(spark, d):
    g = suppliers(spark, d)
    return export.set_runs(g, closure.ancestry(g), 2, 30).withColumnRenamed("desc", "leaves")


@query(f"{o.with_(SUPPLIER, o.pieces(S))} SELECT p.parent, p.child, c.lft, c.rgt, (c.lft + c.rgt)/2 AS position, p.n_desc, round(p.n_desc/(SELECT count(*) FROM leafss), 9) AS af FROM piecess p JOIN cladess c ON c.node = p.parent AND p.lft <= c.lft AND c.rgt <= p.rgt")
def branch_export(spark, d):
    g = suppliers(spark, d)
    return export.branch_rows(g).select("parent", "child", "lft", "rgt", "position", "n_desc", F.round("af", 9).alias("af"))


@query(f"{o.with_(SUPPLIER, o.carriers(S))}, k AS (SELECT mut_id, count(*) AS k FROM carrs GROUP BY mut_id) SELECT m.mut_id, m.position, '1 SNP_' || m.mut_id || ' ' || trunc(m.position)::INT || ' 0 1 ' || string_agg(CASE WHEN c.leaf IS NULL THEN '0' ELSE '1' END, ' ' ORDER BY l.leaf) AS line FROM mutss m JOIN k USING (mut_id) CROSS JOIN leafss l LEFT JOIN carrs c ON c.mut_id = m.mut_id AND c.leaf = l.leaf WHERE k.k < (SELECT count(*) FROM leafss) GROUP BY m.mut_id, m.position")
def haps_export(spark, d):
    g = suppliers(spark, d)
    return export.haplotypes(g, closure.ancestry(g), min_maf=1e-9)


@query(f"{o.with_(SUPPLIER)} SELECT node_id AS id, is_sample::INT AS flags, height AS time FROM nodess")
def export_nodes(spark, d):
    return export.table_export(suppliers(spark, d))["nodes"]


# ---- editing ----------------------------------------------------------------------------------------------

_TRIM = "ce AS (SELECT greatest(lft, 30.0) AS lft, least(rgt, 70.0) AS rgt, parent, child FROM edgesc WHERE lft < 70 AND 30 < rgt), ids AS (SELECT n AS old, row_number() OVER (ORDER BY n) - 1 AS new FROM (SELECT child AS n FROM ce UNION SELECT parent FROM ce))"


@query(f"{o.with_(CUSTOMER, _TRIM)} SELECT i.new AS node_id, n.height, 0.0::DOUBLE AS start, 40.0::DOUBLE AS stop, n.is_sample FROM nodesc n JOIN ids i ON i.old = n.node_id")
def trim_nodes(spark, d):
    return editing.trim(customers(spark, d), 30.0, 70.0).nodes.drop("name")


@query(f"{o.with_(CUSTOMER, _TRIM)} SELECT e.lft - 30 AS lft, e.rgt - 30 AS rgt, p.new AS parent, c.new AS child FROM ce e JOIN ids p ON p.old = e.parent JOIN ids c ON c.old = e.child")
def trim_edges(spark, d):
    return editing.trim(customers(spark, d), 30.0, 70.0).edges


@query(f"{o.with_(CUSTOMER, _TRIM)} SELECT m.mut_id, m.position - 30 AS position, (row_number() OVER (ORDER BY m.position, m.mut_id) - 1)::BIGINT AS site_id, c.new AS child, p.new AS parent FROM mutsc m JOIN ids p ON p.old = m.parent JOIN ids c ON c.old = m.child WHERE m.position >= 30 AND m.position < 70")
def trim_mutations(spark, d):
    return editing.trim(customers(spark, d), 30.0, 70.0).mutations.drop("height")


@query()
def thread_sample(spark, d):
    """A new leaf threaded to supplier 0 and then to supplier 1; the edges after it."""
    g = editing.add_sample(suppliers(spark, d), 5000000, "new")
    return editing.thread_sample(g, 5000000, [0.0, 40.0], [0, 1], [0.5, 35.5], 6000000).edges


# ---- checks ---------------------------------------------------------------------------------------------

@query(f"{o.with_(CUSTOMER)} SELECT 'edge order' AS rule, child AS id, lft AS x FROM ehc WHERE hp <= hc UNION ALL SELECT 'no child', node_id, NULL FROM nodesc WHERE NOT is_sample AND node_id NOT IN (SELECT parent FROM edgesc)")
def check_basic(spark, d):
    return checks.basic(customers(spark, d), strict=False)


@query("SELECT 'no root' AS rule, 0::BIGINT AS id, 0.0::DOUBLE AS x WHERE false")
def check_roots(spark, d):
    return checks.root_rules(customers(spark, d))


@query(f"{o.with_(SUPPLIER)}, p AS (SELECT DISTINCT parent, x FROM (SELECT parent, lft AS x FROM edgess UNION ALL SELECT parent, rgt FROM edgess)), s AS (SELECT parent, x AS lft, lead(x) OVER (PARTITION BY parent ORDER BY x) AS rgt FROM p) SELECT 'fewer than two children' AS rule, s.parent AS id, s.lft AS x FROM s JOIN edgess e ON e.parent = s.parent AND e.lft <= s.lft AND s.rgt <= e.rgt GROUP BY s.parent, s.lft, s.rgt HAVING count(*) < 2")
def check_children(spark, d):
    return checks.children(suppliers(spark, d))


# ---- simulation ------------------------------------------------------------------------------------------

@query()
def generate_mutations(spark, d):
    return simulation.generate_mutations(suppliers(spark, d), 0.01, seed=11).mutations


def _exactly(count: int, seed: int) -> str:
    u = lambda k: f"('0x' || substr(md5('{seed}|' || id || '|{k}'), 1, 13))::BIGINT/4503599627370496.0::DOUBLE"
    return f"""vol AS (SELECT *, sum((hp - hc)*(rgt - lft)) OVER (ORDER BY child, lft) AS hi FROM ehs),
dr AS (SELECT id, {u('u')} * (SELECT max(hi) FROM vol) AS u, {u('x')} AS a, {u('h')} AS b FROM range(0, {count}) r(id)),
made AS (SELECT d.id AS mut_id, v.lft + d.a*(v.rgt - v.lft) AS position, v.hc + d.b*(v.hp - v.hc) AS height, v.child, v.parent FROM dr d JOIN vol v ON v.hi - (v.hp - v.hc)*(v.rgt - v.lft) <= d.u AND d.u < v.hi)"""


@query(f"{o.with_(SUPPLIER, _exactly(5000, 11))} SELECT mut_id, round(position, 9) AS position, round(height, 9) AS height, child, parent FROM made")
def generate_m_mutations(spark, d):
    m = simulation.generate_exactly(suppliers(spark, d), 5000, seed=11).mutations
    return m.select("mut_id", F.round("position", 9).alias("position"), F.round("height", 9).alias("height"), "child", "parent")


@query(f"{o.with_(SUPPLIER, _exactly(1000, 12))}, mc AS (SELECT m.mut_id, m.position, a.leaf FROM made m JOIN ancs a ON a.node = m.child AND a.lft <= m.position AND m.position < a.rgt), k AS (SELECT mut_id, count(*) AS k FROM mc GROUP BY mut_id), few AS (SELECT * FROM made JOIN k USING (mut_id) WHERE least(k, (SELECT count(*) FROM leafss) - k)/(SELECT count(*) FROM leafss) < 1), num AS (SELECT *, row_number() OVER (ORDER BY position, mut_id) - 1 AS idx FROM few) SELECT m.idx, round(m.position, 9) AS position, '1 SNP_' || m.mut_id || ' ' || trunc(m.position)::INT || ' 0 1 ' || string_agg(CASE WHEN c.leaf IS NULL THEN '0' ELSE '1' END, ' ' ORDER BY l.leaf) AS line FROM num m CROSS JOIN leafss l LEFT JOIN mc c ON c.mut_id = m.mut_id AND c.leaf = l.leaf GROUP BY m.idx, m.mut_id, m.position")
def haps_of_draws(spark, d):
    """Mutations drawn and told as haplotype lines in order of position."""
    g = suppliers(spark, d)
    found = export.drawn_haplotypes(g, closure.ancestry(g), simulation.generate_exactly(g, 1000, seed=12))
    return found.select("idx", F.round("position", 9).alias("position"), "line")


@query("SELECT (SELECT sum(CASE WHEN k = 1 THEN 2.0 ELSE k + 1.0 END) FROM range(1, (SELECT count(*) FROM nation)) r(k))::DOUBLE*(SELECT count(*) FROM supplier) AS total_volume")
def caterpillar_volume(spark, d):
    """Volume of a caterpillar tree of as many leaves as nations for each supplier: each
    joins two branches per height, over a length of one."""
    leaves, trees = (canonical.table(spark, d, t).count() for t in ("nation", "supplier"))
    return statistics.total_volume(simulation.caterpillar(spark, 0.0, float(trees), leaves, trees))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Genealogy-wide association with p-values."""
    g = customers(spark, d)
    r = association.associate_clades(materialize(closure.ancestry(g)), canonical.phenotypes(spark, d))
    return r.withColumn("p", chi2_pvalue("chi2")).orderBy(F.col("chi2").desc(), "node", "lft")
