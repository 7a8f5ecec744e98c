"""Edits, chunked building, rebuilding, matrix files, orderings and the workflow's helpers."""

import io
import math
import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from treeloom.model import NODE_SCHEMA, from_rows
from treeloom.operators import access, association, closure, editing, export, intervals, ordering, relatedness, resolution, simulation, statistics
from treeloom.sources import files

# four leaves; the tree changes at 5: leaf 2 moves from node 5 to node 4
NODES = [(0, 0), (1, 0), (2, 0), (3, 0), (4, 1), (5, 2.5), (6, 4)]
EDGES = [(0, 10, 4, 0), (0, 10, 4, 1), (0, 5, 5, 2), (0, 10, 5, 3), (5, 10, 6, 2), (0, 5, 6, 4), (5, 10, 5, 4), (0, 10, 6, 5)]
MUTATIONS = [(1, 1.0, 0.5, None, 0, 4), (2, 4.0, 2.0, None, 4, 6), (3, 6.0, 2.0, None, 4, 5), (4, 6.0, 1.0, None, 3, 5)]


@pytest.fixture(scope="module")
def four(spark):
    return from_rows(spark, NODES, EDGES, 0, 10, MUTATIONS)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_counts_from_the_bottom_up_are_those_of_the_ancestry(spark, four):
    anc = closure.ancestry(four)
    assert rows(closure.clade_sums(four)) == rows(closure.clades(anc))
    values = spark.createDataFrame([(0, 1.0, 2), (2, 10.0, 3), (3, 100.0, 4)], "leaf long, a double, b int")
    got = closure.clade_sums(four, values)
    want = closure.clades(anc.join(values, "leaf", "left"), {"a": F.coalesce("a", F.lit(0.0)), "b": F.coalesce("b", F.lit(0))})
    assert rows(got.select("node", "lft", "rgt", "n_desc", "a", F.col("b").cast("long"))) == rows(want)
    part = closure.clade_sums(four, region=(2.0, 7.0))
    assert rows(part) == rows(closure.clades(closure.ancestry(four, (2.0, 7.0))))
    # a sample that is a parent, too
    odd = from_rows(spark, [(0, 0), (1, 1, True), (2, 3)], [(0, 10, 1, 0), (0, 10, 2, 1)], 0, 10)
    assert rows(closure.clade_sums(odd)) == [(0, 0.0, 10.0, 1), (1, 0.0, 10.0, 2), (2, 0.0, 10.0, 2)]


def test_carrier_counts(four):
    got = {r.mut_id: r.n_desc for r in closure.carrier_counts(four, closure.clade_sums(four)).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 1}
    assert rows(access.allele_counts(four)) == [(1.0, 1), (4.0, 2), (6.0, 3)]
    assert rows(access.allele_counts(four, closure.ancestry(four))) == rows(access.allele_counts(four))


def test_hashes_of_sets_agree_with_their_ids(four):
    anc = closure.ancestry(four)
    ids = {(r.node, r.lft): r.desc for r in closure.clade_sets(closure.clades(anc), anc).collect()}
    by = {}
    for r in closure.clade_hashes(anc).collect():
        by.setdefault((r.h1, r.h2), set()).add(ids[r.node, r.lft])
    assert all(len(x) == 1 for x in by.values()) and len(by) == len(set(ids.values()))


def test_a_cycle_is_an_error(spark, monkeypatch):
    loop = from_rows(spark, [(0, 0), (1, 1), (2, 2)], [(0, 10, 1, 0), (0, 10, 2, 1), (0, 10, 1, 2)], 0, 10)
    monkeypatch.setattr(closure, "_bounded", lambda g, level: _raise() if level > 3 else None)
    for run in (closure.ancestry, closure.clade_sums_by_level):
        with pytest.raises(ValueError, match="cycle"):
            run(loop)


def _raise():
    raise ValueError("the edges form a cycle")


def test_edge_and_mutation_edits(spark, four):
    cut = editing.remove_edges(four, spark.createDataFrame([(4, 0.0)], "child long, lft double"))
    assert cut.edges.count() == 7 and rows(cut.mutations.select("mut_id")) == [(1,), (3,), (4,)]
    narrow = editing.move_edge_ends(four, spark.createDataFrame([(3, 0.0, 0.0, 6.0), (0, 0.0, 1.0, 10.0)], "child long, lft double, new_lft double, new_rgt double"))
    assert rows(narrow.mutations.select("mut_id")) == [(1,), (2,), (3,)]
    more = editing.add_edges(cut, four.edges.where("child = 4 and lft = 0"))
    assert rows(more.edges) == rows(four.edges)
    m = spark.createDataFrame([(9, 7.0, 2)], "mut_id long, position double, child long")
    assert rows(editing.add_mutations(editing.clear_mutations(four), m).mutations.select("mut_id", "child", "parent")) == [(9, 2, 6)]
    for bad in ((9, 7.0, 2, 5.0), (9, 7.0, 6, 5.0)):  # above its edge; no edge
        rowset = spark.createDataFrame([bad], "mut_id long, position double, child long, height double")
        with pytest.raises(PySparkException):
            editing.add_mutations(four, rowset).mutations.collect()
    assert rows(editing.remove_mutations_at_site(four, 6.0).mutations.select("mut_id")) == [(1,), (2,)]
    assert rows(editing.edge_mutations(four, 4, 5.0).select("mut_id")) == [(3,)]


def test_threading_sequences_and_rebuilding(spark, four):
    anc = closure.ancestry(four)
    got = rows(editing.threading_of(anc, four.nodes, 2, four.leaves.where("leaf != 2")))
    assert got == [(0.0, 5.0, 3, 2.5), (5.0, 10.0, 0, 4.0)]
    again = editing.rebuild_by_threading(four)
    want = rows(relatedness.tmrca_distance(four, anc))
    assert rows(relatedness.tmrca_distance(again, closure.ancestry(again))) == want
    assert rows(statistics.total_volume(again)) == rows(statistics.total_volume(four))


def test_building_from_arrays_and_chunks(spark):
    g = files.from_arrays(spark, 0, 10, [0, 0, 3], [True, True, False], [(0, 2), (1, 2)], [(0, 10), (0, 10)], reserved=5)
    assert rows(g.edges.select("child", "parent")) == [(0, 5), (1, 5)] and rows(g.nodes.select("node_id")) == [(0,), (1,), (5,)]
    for wrong in ({"is_sample": [True, False, True]}, {"reserved": 1}, {"edge_ranges": [(0, 10)]}):
        with pytest.raises(ValueError):
            files.from_arrays(**({"spark": spark, "start": 0, "end": 10, "heights": [0, 0, 3], "is_sample": [True, True, False], "edge_ids": [(0, 2), (1, 2)], "edge_ranges": [(0, 10), (0, 10)]} | wrong))
    g = files.header_only(spark, 0, 10, 7, 2)
    assert (g.nodes.count(), g.edges.count(), g.mutations.count(), g.offset, g.chromosome) == (0, 0, 0, 7, 2)
    node = lambda *ids: spark.createDataFrame([(i, float(i), 0.0, 10.0, i < 2, None) for i in ids], NODE_SCHEMA)
    g = files.append_nodes(files.append_nodes(g, node(0, 1)), node(2))
    for bad in (node(4), node(2), node(3, 3)):
        with pytest.raises(ValueError):
            files.append_nodes(g, bad)
    edge = lambda c, p: spark.createDataFrame([(0.0, 10.0, p, c)], "lft double, rgt double, parent long, child long")
    g = files.append_edges(g, edge(0, 2))
    with pytest.raises(ValueError):
        files.append_edges(g, edge(0, 9))
    with pytest.raises(ValueError):
        files.header_only(spark, 5, 5)


def test_matrix_files(spark, tmp_path):
    m = spark.createDataFrame([(i, j, float(10 * max(i, j) + min(i, j))) for i in range(3) for j in range(3)], "i long, j long, value double")
    export.write_matrix(m, 7, f"file://{tmp_path}/a")
    text = [r.value for r in spark.read.text(f"file://{tmp_path}/a.grm.gz").collect()]
    assert sorted(text) == sorted(f"{i + 1}\t{j + 1}\t7\t{10.0 * i + j}" for i in range(3) for j in range(i + 1))
    assert sorted(r.value for r in spark.read.text(f"file://{tmp_path}/a.grm.id").collect()) == ["1\t1", "2\t2", "3\t3"]
    export.write_matrix(m, 7, f"file://{tmp_path}/b", binary=True)
    for name, want in (("grm.bin", [10.0 * i + j for i in range(3) for j in range(i + 1)]), ("grm.N.bin", [7.0] * 6)):
        out = io.BytesIO()
        export.join_matrix(spark, f"file://{tmp_path}/b.{name}", out)
        assert list(struct.unpack("<6f", out.getvalue())) == want


def test_dumps(four):
    assert [r.value for r in export.node_lines(four).collect()][4] == "node 4 height 1.0 on [0.0, 10.0)"
    assert export.edge_lines(four).first().value == "edge 0 to 4 on [0.0, 10.0)"


def test_orderings_match_plain_lists(spark):
    x = np.random.default_rng(2).permutation(500)
    d = spark.createDataFrame([(int(k), int(k) % 7) for k in x], "x long, v long").repartition(5)
    got = {r.x: r for r in ordering.followed(ordering.preceded(ordering.prefixes(ordering.numbered(d, ["x"], "n"), ["x"], {"s": F.col("v")}), "x", "v", "before"), "x", "after").collect()}
    total = 0
    for k in range(500):
        r = got[k]
        assert (r.n, r.s, r.before, r.after) == (k, total, (k - 1) % 7 if k else None, k + 1 if k < 499 else None)
        total += k % 7
    assert ordering.numbered(d.limit(0), ["x"], "n").count() == 0 and ordering.followed(d.limit(0), "x", "after").count() == 0


def test_joins_of_intervals_match_all_pairs(spark):
    rng = np.random.default_rng(3)
    a = [(k, float(p), float(p + w)) for k, (p, w) in enumerate(zip(rng.integers(0, 90, 40), rng.integers(1, 30, 40)))]
    b = [(k, float(p), float(p + w)) for k, (p, w) in enumerate(zip(rng.integers(0, 90, 40), rng.integers(1, 30, 40)))]
    da, db = spark.createDataFrame(a, "i long, a double, b double"), spark.createDataFrame(b, "j long, lft double, rgt double")
    got = rows(intervals.overlap_join(da, db, 7.0).select("i", "j"))
    assert got == sorted([(i, j) for i, x, y in a for j, p, q in b if x < q and p < y], key=str)
    steps = spark.createDataFrame([(1, 0.0, 2.0, "p"), (1, 2.0, 5.0, "q"), (2, 1.0, 3.0, "r")], "n long, lft double, rgt double, v string")
    asked = spark.createDataFrame([(1, 0.0), (1, 2.0), (1, 5.0), (2, 0.5), (2, 2.9), (3, 1.0)], "n long, x double")
    assert rows(intervals.as_of(asked, steps, "n", "x").select("n", "x", "v")) == [(1, 0.0, "p"), (1, 2.0, "q"), (2, 2.9, "r")]


def test_log2_depths_and_merging_of_the_tree_at_one_place(spark, four):
    stab = spark.createDataFrame([(1, 2.0)], "k long, x double")
    wide = from_rows(spark, [(0, 0), (1, 0), (2, 0), (3, 0), (4, 1), (5, 4)], [(0, 10, 4, 0), (0, 10, 4, 1), (0, 10, 5, 2), (0, 10, 5, 3), (0, 10, 5, 4)], 0, 10)
    got = {(r.i, r.j): r.depth for r in statistics.pairs_at(wide, closure.ancestry(wide), stab, log2=True).collect()}
    assert got[0, 1] == pytest.approx(math.log2(3)) and all(v == 0 for k, v in got.items() if k != (0, 1))
    a, b = closure.ancestry(four), closure.ancestry(wide)
    plain = statistics.stab_metrics(four, wide, a, b, stab, r2=True, log2=True).first()
    one = {(r.i, r.j): r.depth for r in statistics.pairs_at(four, a, stab, log2=True).collect()}
    assert one[0, 1] == 1.0 and one[2, 3] == 1.0
    v = sorted(one)
    assert plain.kc == pytest.approx(np.corrcoef([one[k] for k in v], [got[k] for k in v])[0, 1] ** 2)
    # at 2 the inner branches are 4 (1 below 4) and 5 (2.5 below 4): the relatively shortest goes
    merged = resolution.merge_branches(resolution.trees_at(four, stab), 0.5)
    assert rows(merged.select("child", "parent")) == [(0, 4), (1, 4), (2, 6), (3, 6), (4, 6)]


def test_random_mutations_give_maps_and_matrices(spark, four):
    anc = closure.ancestry(four)
    found = simulation.mutation_map(four, anc, 0.5, seed=3).collect()
    assert found and all(r.leaves == sorted(set(r.leaves)) and 0 < len(r.leaves) < 4 for r in found)
    m = relatedness.monte_carlo_relationship(four, anc, 5.0, diploid=False)
    v = np.zeros((4, 4))
    for r in m.collect():
        v[r.i, r.j] = r.value
    assert np.allclose(v, v.T) and np.allclose(v.sum(axis=0), 0, atol=1e-9) and np.trace(v) == pytest.approx(3)


def test_association_of_mutations_is_the_same_in_any_partitioning(spark, four):
    y = spark.createDataFrame([(0, 1.0), (1, -2.0)], "individual long, y double")
    run = lambda g: rows(association.associate_mutations(g, closure.ancestry(g), y, [10.0], seed=4))
    first = run(four)
    assert first and first == run(four.with_(edges=four.edges.repartition(3)))
    t = export.mutation_association_table(association.associate_mutations(four, closure.ancestry(four), y, [10.0], seed=4), 1)
    assert t.columns[-4:] == ["MU_STAR", "HEIGHT_CHILD", "HEIGHT_PARENT", "BRANCH_VOL"] and t.count() == len(first)


def test_workflow_helpers(spark, four):
    y = spark.createDataFrame([(1, 4.0), (2, 8.0), (3, None), (4, 6.0)], "individual long, y double")
    b = association.predictor_of_scores(spark.createDataFrame([(1, 0.5), (2, 0.25), (4, 0.0), (9, 1.0)], "individual long, average double"), 2)
    assert rows(association.residual(y, b)) == [(1, -1.0), (2, 2.0), (4, -1.0)]
    log = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    assert association.inverted_calibration(log("a", "Calibration: none")) == 1.0
    assert association.inverted_calibration(log("AvgPro calibration 2.0 (x)", "Calibration factor 4.0 ok", "end of calibration")) == 0.25
    with pytest.raises(ValueError):
        association.inverted_calibration(log("nothing"))
    tested = spark.createDataFrame([(0.01, 1.0), (0.2, 9.0), (0.3, 4.0)], "maf double, chi2 double")
    got = {r.min_maf: (r.tests, r.max_chi2) for r in association.tests_from_frequency(tested, [0.0, 0.25, 0.5]).collect()}
    assert got == {0.0: (3, 9.0), 0.25: (1, 4.0), 0.5: (0, None)}
    results = spark.createDataFrame([("a", 0.0, 10, 0.1), ("b", 0.0, 30, 0.02)], "arg_id string, min_maf double, tests long, min_p double")
    assert rows(association.null_scaling(results, "a")) == [(0.0, 0.25, 0.02, 2)]
    null = spark.createDataFrame([(k / 100,) for k in range(1, 100)], "min_p double")
    t = association.genome_threshold(null, 0.5).first()
    assert t.lower <= t.threshold <= t.upper and t.threshold == pytest.approx(0.025, abs=0.01) and t.replicates == 99
    trait = {r.individual: r for r in association.example_trait(four, closure.ancestry(four), count=2, noise=0.0).collect()}
    assert {k: (r.dosage, r.y) for k, r in trait.items()} == {0: (2, 2.0), 1: (0, 0.0)}


def test_joined_steps_follow_the_value_kept(spark, four):
    """A step far from the one before, but near the value kept, begins nothing."""
    steps = [(0, 10, 3.36), (10, 20, 2.94), (20, 30, 3.6), (30, 40, 4.5), (40, 50, 4.1), (50, 60, 3.9)]
    clades = spark.createDataFrame([(float(a), float(b), v) for a, b, v in steps], "lft double, rgt double, chi2 double")
    original = association.haploid_clades
    association.haploid_clades = lambda anc, values: clades
    try:
        got = rows(association.haploid_max(four.with_(end=60.0), None, None, epsilon=0.5))
    finally:
        association.haploid_clades = original
    assert got == [(0.0, 30.0, 3.36), (30.0, 50.0, 4.5), (50.0, 60.0, 3.9)]
