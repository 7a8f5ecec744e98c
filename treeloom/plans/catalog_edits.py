"""Queries of the editing, export and lookup operators, with their SQL.

Importing this module registers them beside those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access, association, checks, closure, editing, export, intervals, mapping, statistics
from . import canonical
from . import oracles as o
from .catalog import _AT, _FACTS, _INNER, _NP, _TEST, CUSTOMER, STABS, SUPPLIER, C, S, both, customers, points, query, six, suppliers

# ---- editing ------------------------------------------------------------------------------

_GONE = "ed AS (SELECT * FROM edgess WHERE NOT (child < 1000000 AND child % 5 = 0 AND lft = 0))"
_NARROW = "ed AS (SELECT CASE WHEN child < 1000000 AND child % 3 = 0 AND lft = 0 THEN 1.0 ELSE lft END AS lft, CASE WHEN child < 1000000 AND child % 3 = 0 AND lft = 0 THEN rgt - 1 ELSE rgt END AS rgt, parent, child FROM edgess)"
_COVERED = "SELECT m.mut_id, m.position, m.child, m.parent FROM mutss m JOIN ed e ON e.child = m.child AND e.parent = m.parent AND e.lft <= m.position AND m.position < e.rgt"


def _without(spark, d):
    g = suppliers(spark, d)
    return editing.remove_edges(g, g.edges.where("child < 1000000 and child % 5 = 0 and lft = 0").select("child", "lft"))


def _narrowed(spark, d):
    g = suppliers(spark, d)
    e = g.edges.where("child < 1000000 and child % 3 = 0 and lft = 0")
    return editing.move_edge_ends(g, e.select("child", "lft", F.lit(1.0).alias("new_lft"), (F.col("rgt") - 1).alias("new_rgt")))


@query(f"{o.with_(SUPPLIER, _GONE)} SELECT lft, rgt, parent, child FROM ed")
def remove_edges(spark, d):
    return _without(spark, d).edges


@query(f"{o.with_(SUPPLIER, _GONE)} {_COVERED}")
def remove_edges_mutations(spark, d):
    return _without(spark, d).mutations.select("mut_id", "position", "child", "parent")


@query(f"{o.with_(SUPPLIER, _NARROW)} SELECT lft, rgt, parent, child FROM ed")
def move_edge_ends(spark, d):
    return _narrowed(spark, d).edges


@query(f"{o.with_(SUPPLIER, _NARROW)} {_COVERED}")
def move_edge_ends_mutations(spark, d):
    return _narrowed(spark, d).mutations.select("mut_id", "position", "child", "parent")


@query(f"{o.with_(SUPPLIER)} SELECT 10000000 + l.leaf AS mut_id, ((l.leaf*7) % 100 + 0.5)::DOUBLE AS position, 0.25::DOUBLE AS height, l.leaf AS child, e.parent FROM leafss l JOIN edgess e ON e.child = l.leaf AND e.lft <= (l.leaf*7) % 100 + 0.5 AND (l.leaf*7) % 100 + 0.5 < e.rgt")
def add_mutations(spark, d):
    g = suppliers(spark, d)
    m = g.leaves.select((F.col("leaf") + 10000000).alias("mut_id"), (F.col("leaf") * 7 % 100 + 0.5).cast("double").alias("position"), F.lit(0.25).alias("height"), F.col("leaf").alias("child"))
    return editing.add_mutations(editing.clear_mutations(g), m).mutations.drop("site_id")


@query(f"{o.with_(SUPPLIER)} SELECT mut_id, position FROM mutss WHERE position <> 34.25")
def remove_mutations_at_site(spark, d):
    return editing.remove_mutations_at_site(suppliers(spark, d), 34.25).mutations.select("mut_id", "position")


@query(f"{o.with_(SUPPLIER)} SELECT mut_id, position, parent FROM mutss WHERE child = 3 AND position >= 20 AND position < 100")
def edge_mutations(spark, d):
    return editing.edge_mutations(suppliers(spark, d), 3, 20.0, 100.0).select("mut_id", "position", "parent")


@query(f"{o.with_(SUPPLIER)} SELECT m.mut_id, m.position, m.child, m.parent, e.lft, e.rgt FROM mutss m JOIN edgess e ON e.child = m.child AND e.parent = m.parent AND e.lft <= m.position AND m.position < e.rgt")
def mutations_on_edges(spark, d):
    return editing.mutations_with_edges(suppliers(spark, d))


# ---- lookups --------------------------------------------------------------------------------

@query(f"{o.with_(CUSTOMER)} SELECT k*1.5 - 5 AS x, (SELECT min(position) FROM mutsc WHERE position >= k*1.5 - 5) AS position FROM (SELECT k::DOUBLE AS k FROM range(0, 80) r(k))")
def next_mutation(spark, d):
    return access.next_mutation(customers(spark, d), points(spark, [1.5 * k - 5 for k in range(80)]))


@query(f"{o.with_(CUSTOMER)} SELECT (row_number() OVER (ORDER BY position, mut_id) - 1)::BIGINT AS idx, mut_id, position FROM mutsc")
def ordered_mutations(spark, d):
    return access.ordered_mutations(customers(spark, d)).select("idx", "mut_id", "position")


@query(f"{o.with_(SUPPLIER)} SELECT n.node_id AS node, 62.5::DOUBLE AS x, a.leaf FROM nodess n JOIN ancs a ON a.node = n.node_id AND a.lft <= 62.5 AND 62.5 < a.rgt")
def leaves_at(spark, d):
    g = suppliers(spark, d)
    return access.leaves_at(closure.ancestry(g), g.nodes.select(F.col("node_id").alias("node"), F.lit(62.5).alias("x")))


@query(f"{o.with_(SUPPLIER, o.carriers(S))}, ix AS (SELECT mut_id, row_number() OVER (ORDER BY position, mut_id) - 1 AS i FROM mutss) SELECT c.mut_id, c.position, c.leaf FROM carrs c JOIN ix USING (mut_id) WHERE i >= 40 AND i < 160")
def carriers_between(spark, d):
    g = suppliers(spark, d)
    return access.carriers_between(g, closure.ancestry(g), first=40, last=160)


@query(f"""{o.with_(CUSTOMER)}, st AS (SELECT position, row_number() OVER (ORDER BY position) - 1 AS site FROM (SELECT DISTINCT position FROM mutsc)),
asked AS (SELECT leaf, (leaf*13) % 200 AS site FROM leafsc), q AS (SELECT leaf, site, position AS x FROM asked JOIN st USING (site)),
hit AS (SELECT q.leaf, q.site, a.node, a.level FROM q JOIN ancc a ON a.leaf = q.leaf AND a.lft <= q.x AND q.x < a.rgt WHERE EXISTS (SELECT 1 FROM mutsc m WHERE m.child = a.node AND m.position - 0.001 <= q.x AND q.x < m.position + 0.001))
SELECT leaf, site::BIGINT AS site, arg_min(node, level) AS child FROM hit GROUP BY ALL""")
def lowest_mutated_edge_by_site(spark, d):
    g = customers(spark, d)
    return access.lowest_mutated_edge_by_site(g, closure.ancestry(g), g.leaves.select("leaf", (F.col("leaf") * 13 % 200).alias("site")))


@query(f"{o.with_(CUSTOMER)} SELECT lft, rgt, parent, child FROM edgesc WHERE lft >= 10 AND rgt <= 100")
def edges_contained(spark, d):
    return intervals.contained(customers(spark, d).edges, 10.0, 100.0)


# ---- comparison -------------------------------------------------------------------------------

@query(f"{o.with_(SUPPLIER, o.sets(S))} SELECT count(DISTINCT s.dsc) AS n_sets, 0::BIGINT AS n_different, true AS identical FROM setss s JOIN ehs e ON e.child = s.node AND s.lft < e.rgt AND e.lft < s.rgt")
def identical_volumes(spark, d):
    g = suppliers(spark, d)
    return statistics.identical_volumes(g, closure.ancestry(g), access.breakpoints(g))


@query(f"{o.with_(*_FACTS)}, r AS (SELECT x.k, corr(p.depth, q.depth)**2 AS r {_AT} GROUP BY x.k) SELECT round(sum(r)/{STABS}, 6) AS kc FROM r")
def metrics_stab_r2(spark, d):
    one, two, a, b = both(spark, d)
    return statistics.stab_metrics(one, two, a, b, closure.golden_stabs(one, STABS), r2=True).select(six("kc").alias("kc"))


@query(f"{o.with_(*_FACTS)} SELECT round(sum((p.depth - q.depth)**2)/{STABS}, 6) AS kc2, round(sum((p.height - q.height)**2)/{_NP}/{STABS}, 6) AS tmrca_mse, round(sum((p.n_desc - q.n_desc)**2)/{_NP}/{STABS}, 6) AS sv2 {_AT}")
def kc2_tmrca_sv(spark, d):
    one, two, a, b = both(spark, d)
    return statistics.combined_stab_metrics(one, two, a, b, closure.golden_stabs(one, STABS)).select(*[six(c).alias(c) for c in ("kc2", "tmrca_mse", "sv2")])


# ---- genotypes --------------------------------------------------------------------------------

_NOISY = """near AS (SELECT n.n_nationkey::BIGINT AS site, ((n.n_nationkey*17) % 100 + 0.5)::DOUBLE AS position, l.leaf, 2000000 + n.n_nationkey % 5 AS top FROM leafss l CROSS JOIN nation n),
known AS (SELECT q.site, q.position, q.leaf, CASE WHEN (q.leaf*7 + q.site) % 61 = 0 THEN CASE WHEN a.leaf IS NULL THEN 1 ELSE 0 END ELSE CASE WHEN a.leaf IS NULL THEN 0 ELSE 1 END END AS dosage
 FROM near q LEFT JOIN ancs a ON a.leaf = q.leaf AND a.node = q.top AND a.lft <= q.position AND q.position < a.rgt)"""


@query(f"""{o.with_(SUPPLIER, _NOISY, o.counts("known"))},
mid AS (SELECT c.site, c.node, t.n, (t.ones - 2*c.n1 + c.n_desc)/t.n AS penalty, e.hc FROM cnt c JOIN tot t USING (site) JOIN tree e ON e.site = c.site AND e.child = c.node
 WHERE t.ones > 4 AND t.n - t.ones > 4 AND c.n1/greatest(c.n_desc, t.ones) > 0.7 AND (t.n - t.ones - c.n_desc + c.n1)/greatest(t.n - c.n_desc, t.n - t.ones) > 0.7)
SELECT site, node AS child, round(penalty, 6) AS penalty FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY penalty, hc, node) AS r FROM mid WHERE penalty < 0.03) WHERE r = 1""")
def map_approximate_noisy(spark, d):
    """Sites that mark a whole region's leaves, some of them wrongly."""
    g = suppliers(spark, d)
    anc = closure.ancestry(g)
    n = canonical.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("site"))
    q = g.leaves.crossJoin(F.broadcast(n)).withColumn("position", (F.col("site") * 17 % 100 + 0.5).cast("double"))  # the nation table is fixed
    a = anc.select(F.col("leaf").alias("_leaf"), "node", "lft", "rgt")
    q = q.join(a, (F.col("leaf") == F.col("_leaf")) & (F.col("node") == F.col("site") % 5 + 2000000) & (F.col("lft") <= F.col("position")) & (F.col("position") < F.col("rgt")), "left")
    have = F.col("_leaf").isNotNull()
    dosage = F.when((F.col("leaf") * 7 + F.col("site")) % 61 == 0, ~have).otherwise(have).cast("long")
    found = mapping.map_approximate(g, q.select("site", "position", "leaf", dosage.alias("dosage")))
    return found.where("penalty > 0 or site >= 0").select("site", "child", six("penalty").alias("penalty"))


# ---- association ------------------------------------------------------------------------------

@query(f"{_TEST} SELECT node || '_' || trunc(lft)::INT AS SNP, 1::INT AS CHR, trunc((lft + rgt)/2)::INT AS BP, trunc(lft)::INT AS START_BP, trunc(rgt)::INT AS END_BP, mac AS MAC, round(mac/(2*n), 9) AS MAF, round(coalesce(os*os/nullif(norm, 0), 0), 6) AS CHISQ, CASE WHEN os > 0 THEN 1 ELSE -1 END::INT AS SIGN FROM u")
def assoc_table(spark, d):
    """The association file without its p-values."""
    g = customers(spark, d)
    t = export.association_table(association.associate_clades(closure.ancestry(g), canonical.phenotypes(spark, d)), 1)
    return t.drop("P").withColumns({"MAF": F.round("MAF", 9), "CHISQ": six("CHISQ")})


@query(f"""{_TEST}, pc AS (SELECT e.parent, e.child, greatest(c.lft, e.lft) AS lft, least(c.rgt, e.rgt) AS rgt, e.hc, e.hp, c.lft AS cl, c.rgt AS cr FROM cladesc c JOIN ehc e ON e.child = c.node AND c.lft < e.rgt AND e.lft < c.rgt)
SELECT p.child, p.parent, q.lft, q.rgt, u.mac, round(coalesce(os*os/nullif(norm, 0), 0), 6) AS chi2, (p.hp - p.hc)*(q.rgt - q.lft) AS volume
FROM pc p JOIN cladesc q ON q.node = p.parent AND p.lft <= q.lft AND q.rgt <= p.rgt JOIN u ON u.node = p.child AND u.lft = p.cl AND u.rgt = p.cr""")
def assoc_mutation_all(spark, d):
    """Association of branches at a rate that samples them all."""
    g = customers(spark, d)
    r = association.associate_mutations(g, closure.ancestry(g), canonical.phenotypes(spark, d), [float("inf")])
    return r.select("child", "parent", "lft", "rgt", "mac", six("chi2").alias("chi2"), "volume")


@query(f"{_TEST}, b AS (SELECT unnest([0.0, 0.01, 0.1])::DOUBLE AS min_maf) SELECT b.min_maf, count(u.node) AS tests, round(max(coalesce(os*os/nullif(norm, 0), 0)), 6) AS max_chi2 FROM b JOIN u ON mac/(2*n) >= b.min_maf GROUP BY b.min_maf")
def assoc_from_frequency(spark, d):
    g = customers(spark, d)
    r = association.associate_clades(closure.ancestry(g), canonical.phenotypes(spark, d))
    return association.tests_from_frequency(r, [0.0, 0.01, 0.1]).select("min_maf", "tests", six("max_chi2").alias("max_chi2"))


@query(f"""{o.with_(CUSTOMER, o.clades(C))}, ind AS (SELECT DISTINCT leaf // 2 AS ind FROM leafsc), y0 AS (SELECT seed, ind, ((ind*31 + seed*17 + ind*ind*(seed + 1)) % 97)::DOUBLE AS y FROM ind, range(0, 3) r(seed)),
st AS (SELECT seed, avg(y) AS m, stddev_samp(y) AS s, count(*) AS n FROM y0 GROUP BY seed), z AS (SELECT y0.seed, ind, (y - m)/s AS y FROM y0 JOIN st USING (seed)),
per AS (SELECT c.node, c.lft, c.rgt, a.leaf // 2 AS ind, count(*) AS k FROM cladesc c JOIN ancc a ON a.node = c.node AND a.lft <= c.lft AND c.rgt <= a.rgt GROUP BY ALL),
cl AS (SELECT z.seed, node, lft, rgt, sum(k) AS oc, sum(k*z.y) AS os, count(*) FILTER (k = 2) AS cross_ FROM per JOIN z USING (ind) GROUP BY ALL),
t AS (SELECT cl.*, st.n, oc - oc*oc/st.n + 2*cross_ AS norm FROM cl JOIN st USING (seed))
SELECT seed::BIGINT AS seed, round(max(coalesce(os*os/nullif(norm, 0), 0)), 6) AS max_chi2 FROM t WHERE least(oc, 2*n - oc) > 0 GROUP BY seed""")
def null_max_chi2(spark, d):
    """Largest statistic over all clades for three stated traits."""
    g = customers(spark, d)
    ids = g.leaves.select(F.expr("leaf div 2").alias("individual")).distinct().crossJoin(F.broadcast(spark.range(3).withColumnRenamed("id", "seed")))
    y = ((F.col("individual") * 31 + F.col("seed") * 17 + F.col("individual") * F.col("individual") * (F.col("seed") + 1)) % 97).cast("double")
    return association.null_model(closure.ancestry(g), ids.select("seed", "individual", y.alias("y"))).select("seed", six("max_chi2").alias("max_chi2"))


# ---- export ---------------------------------------------------------------------------------------

@query(f"{o.with_(SUPPLIER)} SELECT lft, rgt, parent, child FROM edgess")
def export_edges(spark, d):
    return export.table_export(suppliers(spark, d))["edges"]


_ORDER = "(row_number() OVER (ORDER BY position, mut_id) - 1)::BIGINT"


@query(f"{o.with_(SUPPLIER)} SELECT {_ORDER} AS id, position, '0' AS ancestral_state FROM mutss")
def export_sites(spark, d):
    return export.table_export(suppliers(spark, d))["sites"]


@query(f"{o.with_(SUPPLIER)} SELECT {_ORDER} AS site, child AS node, NULL::DOUBLE AS time, '1' AS derived_state FROM mutss")
def export_mutations(spark, d):
    return export.table_export(suppliers(spark, d))["mutations"]


@query(f"{o.with_(SUPPLIER)} SELECT 'ID_1 ID_2 missing' AS value UNION ALL SELECT '0 0 0' UNION ALL SELECT DISTINCT (leaf // 2) || ' ' || (leaf // 2) || ' 0' FROM leafss")
def sample_lines(spark, d):
    return export.sample_lines(suppliers(spark, d))


_RUNS = _INNER.format(w=" WHERE least(n_desc, (SELECT count(*) FROM leafss) - n_desc) BETWEEN 2 AND 30")


@query(f"""{o.with_(SUPPLIER, o.sets(S), _RUNS)}, g AS (SELECT dsc, min(lft) AS lft, max(rgt) AS rgt FROM r GROUP BY dsc, n_desc, run), k AS (SELECT max(leaf) // 2 + 1 AS k FROM leafss)
SELECT lft, rgt, array_to_string(list_transform(range(0, k.k), lambda i: len(list_filter(string_split(dsc, ','), lambda x: x::BIGINT // 2 = i))), ' ') AS dosage FROM g, k""")
def dosage_lines(spark, d):
    g = suppliers(spark, d)
    k = g.leaves.agg(F.max("leaf")).first()[0] // 2 + 1
    return export.dosage_lines(export.set_runs(g, closure.ancestry(g), 2, 30), k).select("lft", "rgt", "dosage")


@query(f"""{o.with_(SUPPLIER)}, cut AS (SELECT DISTINCT x FROM (SELECT lft AS x FROM edgess UNION ALL SELECT rgt FROM edgess)), tr AS (SELECT x AS lft, lead(x) OVER (ORDER BY x) AS rgt FROM cut),
e AS (SELECT t.lft, t.rgt, e.parent, e.child FROM tr t JOIN edgess e ON e.lft <= t.lft AND t.lft < e.rgt WHERE t.rgt IS NOT NULL),
n AS (SELECT DISTINCT lft, child AS node FROM e WHERE child BETWEEN 1000000 AND 1999999), r AS (SELECT DISTINCT lft, child AS node FROM e WHERE child BETWEEN 2000000 AND 2999999),
nt AS (SELECT n.lft, n.node, CASE WHEN count(e.child) = 0 THEN n.node::VARCHAR ELSE '(' || string_agg(e.child::VARCHAR, ',' ORDER BY e.child) || ')' || n.node END AS t FROM n LEFT JOIN e ON e.lft = n.lft AND e.parent = n.node GROUP BY n.lft, n.node),
rt AS (SELECT r.lft, r.node, CASE WHEN count(e.child) = 0 THEN r.node::VARCHAR ELSE '(' || string_agg(nt.t, ',' ORDER BY e.child) || ')' || r.node END AS t FROM r LEFT JOIN e ON e.lft = r.lft AND e.parent = r.node LEFT JOIN nt ON nt.lft = e.lft AND nt.node = e.child GROUP BY r.lft, r.node)
SELECT e.lft, e.rgt, '(' || string_agg(rt.t, ',' ORDER BY e.child) || ')3000000' AS tree FROM e JOIN rt ON rt.lft = e.lft AND rt.node = e.child WHERE e.parent = 3000000 GROUP BY e.lft, e.rgt""")
def newick(spark, d):
    return export.newick(suppliers(spark, d))


# ---- checks -----------------------------------------------------------------------------------------

_BROKEN = "ed AS (SELECT lft, rgt, parent, child FROM edgess WHERE child <> 2000003 UNION ALL SELECT 0.0, 20.0, 3000000, 2000003 UNION ALL SELECT 40.0, 100.0, 3000000, 2000003)"


@query(f"""{o.with_(SUPPLIER, _BROKEN)}, cut AS (SELECT DISTINCT x FROM (SELECT lft AS x FROM ed UNION ALL SELECT rgt FROM ed)), seg AS (SELECT x AS lft, lead(x) OVER (ORDER BY x) AS rgt FROM cut),
top AS (SELECT DISTINCT s.lft, p.parent FROM seg s JOIN ed p ON p.lft <= s.lft AND s.rgt <= p.rgt WHERE NOT EXISTS (SELECT 1 FROM ed c WHERE c.child = p.parent AND c.lft <= s.lft AND s.rgt <= c.rgt)),
two AS (SELECT lft FROM top GROUP BY lft HAVING count(*) > 1) SELECT 'two roots' AS rule, -1::BIGINT AS id, min(lft) AS x FROM two HAVING count(*) > 0""")
def check_roots_broken(spark, d):
    """A genealogy with a region cut off its root between 20 and 40."""
    g = suppliers(spark, d)
    ends = spark.createDataFrame([(0.0, 20.0, 3000000, 2000003), (40.0, 100.0, 3000000, 2000003)], "lft double, rgt double, parent long, child long")
    return checks.root_rules(g.with_(edges=g.edges.where("child != 2000003").unionByName(ends)))
