"""Hand-made genealogies with known answers."""

import math

import numpy as np
import pytest

from treeloom.functions.scalars import chi2_pvalue, chi2_pvalue_text
from treeloom.model import from_rows
from treeloom.operators import access, association, checks, closure, editing, export, mapping, relatedness, simulation, statistics


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def threaded(spark, steps, end=100.0):
    """Samples 0, 1, ... threaded one after another: (starts, targets, heights)."""
    g = from_rows(spark, [(0, 0.0, True)], [], 0.0, end)
    node = len(steps) + 1
    for k, (starts, targets, heights) in enumerate(steps, 1):
        g = editing.thread_sample(editing.add_sample(g, k), k, starts, targets, heights, node)
        node += len(starts)
    return g


@pytest.fixture(scope="module")
def three(spark):
    return threaded(spark, [([0, 50], [0, 0], [3.14, 2.718]), ([0, 40], [1, 0], [5.0, 3.0])])


@pytest.fixture(scope="module")
def polytomy(spark):
    nodes = [(k, 0.0) for k in range(8)] + [(8, 1.0), (9, 1.3), (10, 1.7), (11, 2.0)]
    edges = [(0, 100, p, c) for p, kids in ((8, (0, 1, 2)), (9, (3, 4)), (10, (5, 6, 7)), (11, (8, 9, 10))) for c in kids]
    return from_rows(spark, nodes, edges, 0, 100)


def test_threading_gives_the_known_edges(three):
    assert rows(three.edges, "lft", "rgt", "parent", "child") == sorted([(0, 40, 3, 0), (40, 50, 6, 0), (50, 100, 4, 0), (0, 50, 3, 1), (50, 100, 4, 1), (0, 40, 5, 2), (40, 100, 6, 2), (0, 40, 5, 3), (50, 100, 6, 4), (40, 50, 3, 6)])
    assert checks.basic(three).count() == 0 and checks.children(three).count() == 0


def test_three_trees(three):
    a = closure.ancestry(three)
    assert a.count() == 16
    assert statistics.total_volume(three).first()[0] == pytest.approx(1054.3)
    spectrum = {r.n_desc: r.volume for r in statistics.frequency_spectrum(three, a).collect()}
    assert spectrum[1] == pytest.approx(964.4) and spectrum[2] == pytest.approx(89.9)
    assert [(r[0], r[1], pytest.approx(r[2])) for r in rows(relatedness.tmrca_distance(three, a), "i", "j", "value")] == [(0, 1, 292.9), (0, 2, 380.0), (1, 2, 381.4)]
    assert rows(closure.roots(three), "lft", "rgt", "node") == [(0, 40, 5), (40, 50, 3), (50, 100, 6)]


def test_newick(spark):
    g = threaded(spark, [([0, 40], [0, 0], [3.14, 2.718]), ([0, 50], [1, 0], [5.0, 1.0])])
    assert [r.value for r in export.newick_lines(g).collect()] == ["Tree in [0, 40): (2,(0,1)3)5", "Tree in [40, 50): (2,(0,1)4)5", "Tree in [50, 100): (1,(0,2)6)4"]


def test_comparison_of_four_sample_genealogies(spark):
    def build(h):
        return threaded(spark, [([0], [0], [10.0]), ([0], [1], [7.0]), ([0, 40], [2, 2], h)])

    one, two = build([3.0, 9.0]), build([8.0, 6.0])
    a, b = closure.ancestry(one), closure.ancestry(two)
    assert statistics.kc_topology(one, two, a, b).first()[0] == pytest.approx(2)
    assert statistics.tmrca_mse(one, two, a, b).first()[0] == pytest.approx(18.2 / 6)


def test_overlap_with_a_star(spark, three):
    star = from_rows(spark, [(0, 0.0), (1, 0.0), (2, 0.0), (3, 5.0)], [(0, 100, 3, c) for c in range(3)], 0, 100)
    a, b = closure.ancestry(three), closure.ancestry(star)
    got = statistics.overlap_stab(three, star, a, b, closure.golden_stabs(three, 1)).first()
    assert tuple(got) == (4, 3, 3, pytest.approx(8.718), pytest.approx(15), pytest.approx(8.436))
    assert tuple(statistics.overlap_full(three, star, a, b).first()) == (5, 3, 3)


def test_split_sizes(spark):
    one = from_rows(spark, [(k, 0.0) for k in range(4)] + [(4, 1.0), (5, 2.0), (6, 3.0)], [(0, 1, p, c) for p, c in ((4, 0), (4, 2), (5, 1), (5, 3), (6, 4), (6, 5))], 0, 1)
    two = from_rows(spark, [(k, 0.0) for k in range(4)] + [(4, 1.0), (5, 2.0), (6, 3.0)], [(0, 1, p, c) for p, c in ((4, 0), (4, 2), (5, 4), (5, 1), (6, 5), (6, 3))], 0, 1)
    got = statistics.stab_metrics(one, two, closure.ancestry(one), closure.ancestry(two), closure.golden_stabs(one, 1)).first()
    assert (got.kc, got.split) == (4, 1)


def test_lineages(spark, polytomy):
    want = {5.0: 1, 2.0: 1, 1.9: 3, 1.7: 3, 1.5: 5, 1.3: 5, 1.2: 6, 1.0: 6, 0.5: 8, 0.0: 8}
    asked = spark.createDataFrame([(50.0, h) for h in want], "x double, h double")
    got = statistics.num_lineages(polytomy, closure.clades(closure.ancestry(polytomy)), asked)
    assert {r.h: r.n for r in got.collect()} == want


def _geno(spark, sites):
    return spark.createDataFrame([(s, 50.0, k, v) for s, g in enumerate(sites) for k, v in enumerate(g)], "site long, position double, leaf long, dosage long")


def test_imputation(spark, polytomy):
    g = from_rows(spark, [(k, 0.0) for k in range(8)] + [(8, 1.0), (9, 1.0), (10, 1.0), (11, 2.0)], [(0, 100, p, c) for p, kids in ((8, (0, 1, 2)), (9, (3, 4)), (10, (5, 6, 7)), (11, (8, 9, 10))) for c in kids], 0, 100)
    n = None
    got = mapping.impute(g, _geno(spark, [[n, 1, n, 1, n, 0, 0, n], [1, 0, n, n, n, n, 0, n]]))
    by = {(r.site, r.leaf): r.dosage for r in got.collect()}
    assert [by[0, k] for k in range(8)] == [1, 1, 1, 1, 1, 0, 0, 0]
    assert [by[1, k] for k in range(8)] == [1, 0, 0, 0, 0, 0, 0, 0]
    h5 = [(k, 0.0) for k in range(7)] + [(7, 1.0), (8, 2.0), (9, 3.0), (10, 5.0), (11, 5.0), (12, 6.0)]
    e = [(0, 100, p, c) for c, p in ((2, 7), (3, 7), (1, 8), (7, 8), (4, 9), (5, 9), (0, 10), (8, 10), (6, 11), (9, 11), (10, 12), (11, 12))]
    g = from_rows(spark, h5, e, 0, 100)
    tie = _geno(spark, [[n, 1, 1, 1, 0, 0, 0]])
    assert mapping.impute(g, tie).where("leaf = 0").first().dosage == pytest.approx(0.4)
    assert mapping.impute(g, tie, single_best=True).where("leaf = 0").first().dosage == 0


def test_mapping(spark):
    g = from_rows(spark, [(k, 0.0) for k in range(4)] + [(4, 1.0), (5, 2.0), (6, 3.0)], [(0, 100, p, c) for p, c in ((4, 0), (4, 2), (5, 1), (5, 3), (6, 4), (6, 5))], 0, 100)
    a = closure.ancestry(g)
    got = mapping.map_parsimony(g, _geno(spark, [[1, 0, 1, 0], [1, 1, 0, 0], [0, 0, 0, 0], [1, 1, 1, 0]]))
    assert rows(got, "site", "child") == [(0, 4), (1, 0), (1, 1), (3, 1), (3, 4)]
    with pytest.raises(Exception, match="every leaf carries"):
        mapping.map_parsimony(g, _geno(spark, [[1, 1, 1, 1]])).collect()
    dose = spark.createDataFrame([(0, 50.0, 0, 1), (0, 50.0, 1, 0), (1, 50.0, 0, 2), (1, 50.0, 1, 2)][:2], "site long, position double, individual long, dosage long")
    assert len(mapping.map_diploid(g, dose).collect()) == 1
    want = spark.createDataFrame([(0, 0), (0, 2), (1, 0), (1, 1), (2, 3)], "query long, leaf long")
    assert rows(statistics.mrca_of_set(g, a, want, 50.0), "query", "node") == [(0, 4), (1, 6), (2, 3)]


def _by_sets(up, length, dosage):
    """Unphased placement with plain sets of leaves, as defined."""
    below = {}
    for v in (v for i in dosage for v in (2 * i, 2 * i + 1)):
        x = v
        while x is not None:
            below.setdefault(x, set()).add(v)
            x = up.get(x)
    hom, het = {v for v in below if v // 2 in dosage and v < 2 * len(dosage) and dosage[v // 2] == 2}, {i for i, d in dosage.items() if d == 1}

    def highest(x):
        while x in up and below[up[x]] <= hom | {2 * i + k for i in het for k in (0, 1)} and not any({2 * i, 2 * i + 1} <= below[up[x]] for i in het):
            x = up[x]
        return x

    found = []
    while hom:
        found.append(highest(min(hom)))
        hom = hom - below[found[-1]]
        het = het - {v // 2 for v in below[found[-1]]}
    while het:
        a, b = (highest(2 * min(het) + k) for k in (0, 1))
        found.append(a if (len(below[a]), length[a]) > (len(below[b]), length[b]) else b)
        het = het - {v // 2 for v in below[found[-1]]}
    return sorted(found)


def test_unphased_mapping_on_a_known_tree(spark):
    # fixed values: a tree of six leaves and the edges (child) each genotype may go to
    edges = ((7, 0), (7, 4), (6, 1), (6, 3), (8, 7), (8, 6), (9, 2), (9, 5), (10, 8), (10, 9))
    known = (([1, 2, 2], ([3, 7, 9], [4, 6, 9])), ([2, 0, 0], ([0, 1],)), ([1, 1, 1], ([5, 6], [0, 9], [2, 7])), ([0, 2, 2], ([3, 4, 9],)), ([2, 1, 1], ([8],)))
    g = from_rows(spark, [(k, 0.0) for k in range(6)] + [(6, 0.07), (7, 0.27), (8, 0.34), (9, 2.1), (10, 5.62)], [(0, 1, p, c) for p, c in edges], 0, 1)
    sites = [(s, 0.1 + 0.1 * s, i, d) for s, (dosage, _) in enumerate(known) for i, d in enumerate(dosage)]
    schema = "site long, position double, individual long, dosage long"
    run = lambda r: rows(mapping.map_diploid(g, spark.createDataFrame(r, schema)), "site", "child")
    got = run(sites)
    for s, (_, allowed) in enumerate(known):
        assert [c for k, c in got if k == s] in allowed
    for dosage, why in (([2, 2, 2], "every leaf carries"), ([2, 3, 0], "0, 1 or 2"), ([2, None, 0], "0, 1 or 2")):
        with pytest.raises(Exception, match=why):
            run([(0, 0.5, i, d) for i, d in enumerate(dosage)])


def test_unphased_mapping_follows_the_definition_on_random_trees():
    rng = np.random.default_rng(11)
    for _ in range(300):
        n = int(rng.integers(2, 9))
        live, up, length, fresh = list(range(2 * n)), {}, {}, 2 * n
        while len(live) > 1:
            part = rng.choice(len(live), size=min(len(live), int(rng.integers(2, 4))), replace=False)
            for k in part:
                up[live[k]], length[live[k]] = fresh, float(rng.integers(1, 4))
            live, fresh = [x for k, x in enumerate(live) if k not in part] + [fresh], fresh + 1
        dosage = {i: int(d) for i, d in enumerate(rng.choice(3, size=n, p=rng.dirichlet([1, 1, 1])))}
        if set(dosage.values()) == {2}:
            continue
        order = rng.permutation(len(up))
        kids = [list(up)[k] for k in order]
        got = mapping.place_unphased(kids, [up[c] for c in kids], [length[c] for c in kids], list(dosage), list(dosage.values()))
        assert got == _by_sets(up, length, dosage)


def test_hamming_distance_on_a_star(spark):
    star = from_rows(spark, [(k, 0.0) for k in range(8)] + [(8, 1.0)], [(0, 100, 8, c) for c in range(8)], 0, 100)
    got = mapping.mutation_best(star, _geno(spark, [[1, 1, 1, 1, 0, 0, 0, 0], [1, 1, 0, 0, 1, 1, 0, 0], [1, 0, 0, 0, 0, 0, 0, 0]]))
    assert rows(got, "site", "distance") == [(0, 3), (1, 3), (2, 0)]


def test_trimming(spark):
    g = threaded(spark, [([0, 60], [0, 0], [3.14, 2.718]), ([0, 30], [1, 0], [5.0, 3.0])])
    t = editing.trim(g, 30.0, 100.0)
    assert (t.nodes.count(), t.edges.count(), t.offset, t.end) == (6, 7, 30, 70.0)
    h = {r.node_id: r.height for r in t.nodes.collect()}
    assert [(r[0], h[r[1]]) for r in rows(closure.roots(t), "lft", "node")] == [(0, 3.14), (30, 3)] or [(r[0], h[r[1]]) for r in rows(closure.roots(t), "lft", "node")][0][1] == 3.14
    u = editing.trim(g, 20.0, 65.0)
    assert (u.nodes.count(), u.edges.count()) == (7, 10)
    with pytest.raises(ValueError):
        editing.trim(g, 50.0, 50.0)


def test_mutation_lookup(spark):
    g = from_rows(spark, [(0, 0.0), (1, 0.0), (2, 1.0)], [(0, 10, 2, 0), (0, 10, 2, 1)], 0, 10, [(k, x, None, None, 0, 2) for k, x in enumerate((1.0, 2.0, 2.0, 4.0))])
    p = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.0, 3.0, 9.0)], "x double")
    look = lambda f, **k: [r.idx for r in f(g, p, **k).orderBy("x").collect()]
    assert look(access.index_left_of) == [0, 0, 0, 2, 3]
    assert look(access.index_left_of, include_equal=True) == [0, 0, 2, 2, 3]
    assert look(access.index_right_of) == [0, 1, 3, 3, 3]
    assert look(access.index_right_of, include_equal=True) == [0, 0, 1, 3, 3]
    assert look(access.index_closest) == [0, 0, 1, 3, 3]
    with pytest.raises(ValueError):
        access.mutations_between(g, 2.0, 1.0)


def test_bad_structures(spark):
    bad = from_rows(spark, [(0, 0.0), (1, 0.0), (2, 1.0), (3, 0.5)], [(0, 10, 2, 0), (0, 10, 2, 1), (5, 8, 3, 0), (0, 5, 2, 9), (0, 10, 3, 2)], 0, 10, [(0, 20.0, None, None, 0, 2)])
    found = {r.rule for r in checks.basic(bad).collect()}
    assert {"two parents", "edge order", "unknown child", "mutation off its edge"} <= found
    with pytest.raises(ValueError):
        checks.require(bad)
    g = from_rows(spark, [(0, 0.0, True)], [], 0, 10)
    for starts, targets, heights in (([1.0], [0], [1.0]), ([0.0, 5.0], [0], [1.0]), ([0.0], [0], [0.0])):
        with pytest.raises(ValueError):
            editing.thread_sample(g, 1, starts, targets, heights, 5)


def test_matrix_products_equal_dense_ones(spark, three):
    g = simulation.generate_mutations(simulation.caterpillar(spark, 0, 10, 6, 4), 0.05, seed=3)
    a = closure.ancestry(g)
    muts = [r.mut_id for r in g.mutations.orderBy("position").collect()]
    dense = np.zeros((6, len(muts)))
    for r in closure.carriers(g, a).collect():
        dense[r.leaf, muts.index(r.mut_id)] += 1
    d = dense[::2] + dense[1::2]
    z = d - d.mean(0)
    sd = d.std(0, ddof=1)
    k = dense.sum(0)
    z = (z / np.where(sd == 0, 1, sd))[:, (k > 0) & (k < 6)]
    got = {(r.i, r.j): r.value for r in relatedness.mutation_relationship(g, a).collect()}
    assert np.allclose([[got[i, j] for j in range(3)] for i in range(3)], z @ z.T)
    at = [r.position for r in g.mutations.orderBy("position").collect()]
    entries = [(p, k, float(3 * n % 5 - k)) for n, p in enumerate(at) for k in (0, 1) if k == 0 or n < 2]
    matrix = spark.createDataFrame(entries, "position double, k int, value double")
    for diploid, table in ((False, dense), (True, d)):
        want = {(i, k): sum(table[i, at.index(p)] * v for p, kk, v in entries if kk == k) for i in range(len(table)) for k in (0, 1)}
        got = {(r.sample, r.k): r.value for r in relatedness.multiply_samples(g, a, matrix, diploid=diploid).collect()}
        assert all(want[x] == pytest.approx(got.get(x, 0.0)) for x in want) and set(got) <= set(want)
    low = relatedness.multiply_samples(g, a, matrix, region=(0.0, at[1])).where("k = 0").collect()
    assert {r.sample: r.value for r in low} == {i: dense[i, 0] * entries[0][2] for i in range(6) if dense[i, 0]}
    assert relatedness.multiply_samples(g, a, matrix.limit(0)).count() == 0
    w = spark.createDataFrame([(0, 0, 2.0), (2, 0, 1.0), (1, 1, 4.0)], "individual long, k int, value double")
    weight = np.array([[2.0, 0.0, 1.0], [0.0, 4.0, 0.0]])
    for centre in (True, False):
        got = {(r.mut_id, r.k): r.value for r in relatedness.weighted_square_norm(g, a, w, centre).collect()}
        want = weight @ (d - d.mean(0) * centre) ** 2
        assert len(got) == 2 * len(muts) and all(got[m, k] == pytest.approx(want[k, n]) for n, m in enumerate(muts) for k in (0, 1))
    with pytest.raises(ValueError):
        relatedness.multiply(g, a, None, axis="other")


def test_association_equals_regression(spark, polytomy):
    y = spark.createDataFrame([(0, 1.0), (1, None), (2, 3.0), (3, -2.0)], "individual long, y double")
    got = {r.node: r for r in association.associate_clades(closure.ancestry(polytomy), y).collect()}
    x = {8: [2, 0, 0], 9: [0, 1, 0], 10: [0, 1, 2]}  # individuals 0, 2, 3
    t = np.array([1.0, 3.0, -2.0])
    for node, dosage in x.items():
        r = np.corrcoef(dosage, t)[0, 1]
        assert got[node].chi2 == pytest.approx(2 * r * r)


def test_tails(spark):
    d = spark.createDataFrame([(0.0,), (3.84,), (50.0,), (5000.0,)], "x double").select("x", chi2_pvalue("x").alias("p"), chi2_pvalue_text("x").alias("t")).orderBy("x").collect()
    assert d[0].p == 1 and d[1].p == pytest.approx(0.05, abs=1e-3) and d[2].t == f"{math.erfc(5):.1E}"
    assert d[3].p == 0 and d[3].t.split("E")[1] == "-1088"


def test_simulated_mutations(spark):
    g = simulation.caterpillar(spark, 0, 100, 10, 5)
    assert checks.children(g).count() == 0 and checks.root_rules(g).count() == 0
    m = simulation.generate_exactly(g, 300, seed=2)
    assert m.mutations.count() == 300 and checks.mutation_rules(m).count() == 0
    p = simulation.generate_mutations(g, 0.1, seed=2)
    volume = statistics.total_volume(g).first()[0]
    assert checks.mutation_rules(p).count() == 0 and abs(p.mutations.count() - 0.1 * volume) < 5 * (0.1 * volume) ** 0.5
    assert rows(p.mutations, "mut_id") == rows(simulation.generate_mutations(g.with_(edges=g.edges.repartition(7)), 0.1, seed=2).mutations, "mut_id")
