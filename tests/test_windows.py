"""Genome windows, bins in levels, bitmap sets and tiles against plain definitions."""

import random
import time
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeloom.model import from_rows
from treeloom.operators import closure, gram, intervals, sets, windows


def genealogy(spark, seed, n=12, trees=9, ancient=False):
    """Random trees over n leaves; nodes live on through neighbouring trees, some leaves are inner."""
    rnd = random.Random(seed)
    heights = {i: 0.0 for i in range(n)} | {n + k: k + 1.0 for k in range(3 * n)}
    cuts = sorted({0.0, 100.0, *[float(rnd.randrange(1, 100)) for _ in range(trees)]})
    parents, edges = None, {}
    for a, b in zip(cuts, cuts[1:], strict=False):
        if parents is None:
            parents, free = {}, list(range(n))
            for k in range(n, 4 * n):
                if len(free) < 2:
                    break
                some = rnd.sample(free, min(len(free), rnd.randrange(2, 4)))
                for c in some:
                    parents[c] = k
                    free.remove(c)
                free.append(k)
        else:  # some lineages move to another, higher node that has a parent or is the root
            used = set(parents.values())
            for c in rnd.sample(sorted(parents), 3):
                higher = [p for p in used if heights[p] > heights[c]]
                parents[c] = rnd.choice(higher)
        for c, p in parents.items():
            edges.setdefault((c, p), []).append((a, b))
    rows = []
    for (c, p), spans in edges.items():
        spans.sort()
        now = list(spans[0])
        for a, b in spans[1:]:
            if a == now[1] and rnd.random() < 0.7:
                now[1] = b
            else:
                rows.append((*now, p, c))
                now = [a, b]
        rows.append((*now, p, c))
    nodes = [(i, h, i < n or (ancient and i in (n, n + 1))) for i, h in heights.items()]
    return from_rows(spark, nodes, rows, 0.0, 100.0)


def table(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize(("seed", "least", "ancient"), [(1, 10**6, False), (2, 1, False), (3, 7, True), (4, 3, True)])
def test_window_sums_match_levels_and_ancestry(spark, monkeypatch, seed, least, ancient):
    monkeypatch.setattr(windows, "WINDOW_EDGES", least)
    monkeypatch.setattr(windows, "borders_of", _borders(least))
    g = genealogy(spark, seed, ancient=ancient)
    values = g.leaves.select("leaf", (F.col("leaf") * 7 % 5).alias("v"), (F.col("leaf") / 4).alias("w")).where("leaf % 3 != 1")
    columns = ("node", "lft", "rgt", "n_desc")
    got = closure.clade_sums(g, values)
    assert table(got, *columns, "v", "w") == table(closure.clade_sums_by_level(g, values), *columns, "v", "w")
    assert table(got, *columns) == table(closure.clades(closure.ancestry(g)), *columns)
    part = (12.5, 61.0)
    assert table(closure.clade_sums(g, region=part), *columns) == table(closure.clades(closure.ancestry(g, part)), *columns)


def _borders(least):
    def borders(edges, start, end, n_edges, n_leaves):
        if least > 1000:
            return np.array([start, end])
        inside = [start + (end - start) * k / 8 for k in range(1, 8)] if least == 1 else [r[0] for r in edges.select("lft").distinct().collect()] + [33.25, 50.5]
        return np.array(sorted({start, end, *[x for x in inside if start < x < end]}))

    return borders


def test_cycles_are_found(spark):
    g = from_rows(spark, [(0, 0.0), (1, 1.0), (2, 2.0)], [(0, 10, 1, 0), (0, 10, 2, 1), (0, 10, 1, 2)], 0.0, 10.0)
    with pytest.raises(Exception, match="cycle"):
        closure.clade_sums(g).collect()


def test_no_edges(spark):
    g = from_rows(spark, [(0, 0.0), (1, 0.0)], [], 0.0, 10.0)
    assert table(closure.clade_sums(g), "node", "lft", "rgt", "n_desc") == [(0, 0.0, 10.0, 1), (1, 0.0, 10.0, 1)]


def _spans(rnd, n):
    out = []
    for k in range(n):
        size = rnd.choice([0.0, 0.001, 0.5, 3.0, 30.0, 100.0, 4.0**-3 * 100])
        at = rnd.choice([rnd.random() * 100, float(rnd.randrange(100)), 100 / 4**5 * rnd.randrange(4**5)])
        out.append((k, at, min(at + size, 130.0)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_levelled_joins_match_all_pairs(spark, seed):
    rnd = random.Random(seed)
    a, b = _spans(rnd, 300), _spans(rnd, 300)
    ends = [x for _, l, r in b for x in (l, r, np.nextafter(r, 0))]
    points = [(k, float(x)) for k, x in enumerate([rnd.random() * 110 - 5 for _ in range(200)] + ends)]
    x = spark.createDataFrame(a, "i int, a double, b double")
    y = spark.createDataFrame(b, "j int, lft double, rgt double")
    p = spark.createDataFrame(points, "k int, x double")
    want = sorted((k, j) for (k, v), (j, l, r) in product(points, b) if l <= v < r)
    assert table(intervals.stab_join(p, y, "x", 100.0), "k", "j") == want
    want = sorted((i, j) for (i, l, r), (j, s, t) in product(a, b) if l < t and s < r and l < r and s < t)
    assert table(intervals.overlap_join(x, y, 100.0), "i", "j") == want


def test_join_work_does_not_grow_with_length(spark):
    """What bins compare stays in proportion to the result for 10^5 points and intervals."""
    n = 100_000
    at = F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1e9 * 1000
    p = spark.range(n).select(F.col("id").alias("k"), at.alias("x"))
    for length in (0.001, 0.02, 0.5):
        y = spark.range(n).select(F.col("id").alias("j"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10**9)).alias("u")).select("j", (F.col("u") / 1e9 * 1000).alias("lft")).withColumn("rgt", F.col("lft") + length)
        met = intervals.stab_join(p, y, "x", 1000.0)
        found = met.count()
        assert 0.8 < found / (n * n * length / 1000) < 1.25
        homes = intervals._homes(y, 1000.0, "lft", "rgt")
        width = intervals._width(F.col("_level"), 1000.0)
        per_bin = homes.groupBy("_level", "_bin").agg(F.count("*").alias("c"), F.first(width).alias("w")).agg(F.sum(F.col("c") * F.col("w")) * n / 1000)
        assert per_bin.first()[0] < 12 * max(found, n)


def test_envelope(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(float(a), float(a + rnd.randrange(1, 40)), float(rnd.randrange(30))) for a in (rnd.randrange(100) for _ in range(120))]
    df = spark.createDataFrame(rows, "lft double, rgt double, value double")
    cuts = sorted({x for l, r, _ in rows for x in (l, r)})
    want = [(a, b, max(v for l, r, v in rows if l <= a and b <= r)) for a, b in zip(cuts, cuts[1:], strict=False) if any(l <= a and b <= r for l, r, _ in rows)]
    for inside in ([], [20.0, 20.5, 20.75, 90.0], [float(k) + 0.5 for k in range(100)], [float(k) for k in range(100)]):
        monkeypatch.setattr(windows, "borders_of", lambda *_, inside=inside: np.array([0.0, *[x for x in inside if x > 0], 200.0]))
        assert table(windows.upper_envelope(df, 0.0, 200.0), "lft", "rgt", "value") == want


def _family(rnd, n):
    return {s: {rnd.choice([rnd.randrange(-200, 700), 64 * rnd.randrange(9)]) for _ in range(rnd.randrange(1, 60))} for s in rnd.sample(range(12), n)}


def test_set_algebra(spark):
    rnd = random.Random(8)
    a, b = _family(rnd, 9), _family(rnd, 9)
    for s in list(a)[:3]:
        b[s] = set(list(a[s])[::2])
    rows = lambda f: spark.createDataFrame([(s, x) for s, m in f.items() for x in m for _ in range(2)] + [(99, None)], "name long, x long")
    names = spark.range(12).withColumnRenamed("id", "set")
    one, two = (sets.of_members(rows(f), "name", "x") for f in (a, b))

    def plain(df):
        out = {}
        for s, x in table(sets.members(df), "set", "id"):
            out.setdefault(s, set()).add(x)
        return out

    every = lambda how: {s: m for s in range(12) if (m := how(a.get(s, set()), b.get(s, set())))}
    assert plain(one) == a
    assert plain(sets.union(one, two)) == every(set.union)
    assert plain(sets.intersection(one, two)) == every(set.intersection)
    assert plain(sets.difference(one, two)) == every(set.difference)
    assert plain(sets.symmetric_difference(one, two)) == every(set.symmetric_difference)
    universe = spark.range(-64, 200)
    assert plain(sets.complement(one, names, universe, "id")) == {s: m for s in range(12) if (m := set(range(-64, 200)) - a.get(s, set()))}
    assert dict(table(sets.includes(one, two, names), "set", "includes")) == {s: a.get(s, set()) >= b.get(s, set()) for s in range(12)}
    assert dict(table(sets.equal(one, sets.union(one, sets.intersection(one, two)), names), "set", "equal")) == dict.fromkeys(range(12), True)
    assert dict(table(sets.equal(one, two, names), "set", "equal")) == {s: a.get(s, set()) == b.get(s, set()) for s in range(12)}
    assert dict(table(sets.sizes(one), "set", "n")) == {s: len(m) for s, m in a.items()}
    assert dict(table(sets.first(one), "set", "id")) == {s: min(m) for s, m in a.items()}
    assert dict(table(sets.listed(one), "set", "members")) == {s: ",".join(map(str, sorted(m))) for s, m in a.items()}
    asked = spark.createDataFrame([(s, x) for s in range(12) for x in (0, 64, 65, -1)], "set long, id long")
    assert table(sets.get(one, asked), "set", "id", "held") == sorted((s, x, x in a.get(s, set())) for s in range(12) for x in (0, 64, 65, -1))
    assert plain(sets.put(one, asked.withColumn("held", F.col("id") != 64))) == {s: m for s in range(12) if (m := (a.get(s, set()) | {0, 65, -1}) - {64})}
    assert len(set(table(sets.prints(one), "h1", "h2"))) == len({frozenset(m) for m in a.values()})
    grouped = lambda df: df.withColumn("g", F.col("set") % 3)
    groups = {g: [m for s, m in a.items() if s % 3 == g] for g in {s % 3 for s in a}}
    assert plain(sets.union_all(grouped(one), "g")) == {g: set.union(*m) for g, m in groups.items()}
    assert plain(sets.intersect_all(grouped(one), "g")) == {g: x for g, m in groups.items() if (x := set.intersection(*m))}
    positive = sets.of_members(rows({s: {x for x in m if 0 <= x < 130} | {3} for s, m in a.items()}), "name", "x")
    assert dict(table(sets.bit_strings(positive, 130), "set", "bits")) == {s: "".join("01"[k in m or k == 3] for k in range(130)) for s, m in a.items()}


@pytest.mark.parametrize(("tile", "partitions", "batch"), [(4, 1, 3), (5, 40, 1024), (64, 8, 2)])
def test_gram_by_tiles(spark, tile, partitions, batch):
    rng = np.random.default_rng(2)
    m = rng.integers(0, 3, (13, 50)) * (rng.random((13, 50)) < 0.4)
    w = rng.random(50)
    rows = [(c, r, float(m[r, c]), float(w[c])) for r in range(13) for c in range(50) if m[r, c]]
    df = spark.createDataFrame(rows, "column long, row long, value double, weight double")
    got = {(r["i"], r["j"]): r["dot"] for r in gram.weighted_gram(df, 13, partitions, tile, batch).collect()}
    want = (m * w) @ m.T
    assert len(got) == 169
    assert all(abs(got[i, j] - want[i, j]) < 1e-9 for i in range(13) for j in range(13))


def test_sites_meet_the_changing_tree(spark, monkeypatch):
    """Counts per node, imputation and unphased placement at sites of many trees, in one and in many windows."""
    from treeloom.operators import mapping, site_trees

    g = genealogy(spark, 5, ancient=True)
    rnd = random.Random(6)
    sites = [(s, float(x)) for s, x in enumerate([0.0, 99.5, *[rnd.randrange(200) / 2 for _ in range(25)]])]
    geno = [(s, x, leaf, rnd.choice([0, 1, 1, None])) for s, x in sites for leaf in range(12) if rnd.random() < 0.9]
    df = spark.createDataFrame(geno, "site long, position double, leaf long, dosage long")
    anc = [tuple(r) for r in closure.ancestry(g).select("leaf", "node", "lft", "rgt").collect()]
    want = {}
    for s, x, leaf, d in geno:
        for lf, node, a, b in anc:
            if lf == leaf and a <= x < b:
                c = want.setdefault((s, node), [0, 0, 0])
                c[0] += 1
                c[1] += d == 1
                c[2] += d == 0
    edges = {(r.child, r.lft, r.rgt): r.parent for r in g.edges.collect()}
    results = []
    for size in (10**6, 20):
        monkeypatch.setattr(site_trees, "SITE_ROWS", size)
        got = site_trees.site_nodes(g, df).collect()
        assert {(r.site, r.node): [r.n_desc, r.n1, r.n0] for r in got} == want and len(got) == len(want)
        where = dict(sites)
        for r in got:
            up = [p for (c, a, b), p in edges.items() if c == r.node and a <= where[r.site] < b]
            assert [r.parent] == (up or [None])
            if up:
                assert [r.up_desc, r.up_n1] == want[r.site, r.parent][:2]
        results.append(table(mapping.impute(g, df), "site", "leaf", "dosage"))
        pairs = df.groupBy("site", "position", (F.col("leaf") / 2).cast("long").alias("individual")).agg(F.coalesce(F.max("dosage"), F.lit(0)).alias("dosage"))
        results.append(table(mapping.map_diploid(g, pairs), "site", "child"))
    assert results[0] == results[2] and results[1] == results[3] and results[1]


def test_dense_sets_of_many_blocks(spark):
    """Sparse, full, negative and too large ids; one set has none below n, one ends in a full block."""
    n = 1_000_000
    want = {"a": {0, 63, 64, 9_999, n - 1}, "b": set(range(5, n, sets.WORD)), "c": {-5, n, n + 64}, "d": set(range(128, 192)), "e": {63}}
    df = spark.createDataFrame([(k, i) for k, v in want.items() for i in v], "set string, id long")
    s = sets.of_members(df, "set", "id")
    began = time.monotonic()
    got = {r["set"]: r["bits"] for r in sets.bit_strings(s, n).collect()}
    assert got == {k: "".join("1" if i in v else "0" for i in range(n)) for k, v in want.items()}
    assert {r["set"]: "".join(map(str, r["cells"])) for r in sets.dense(s, n).collect()} == got
    assert time.monotonic() - began < 40  # a look through all blocks for each bit takes minutes
    assert {r["set"]: r["bits"] for r in sets.bit_strings(s, 65).collect()}["a"] == "1" + "0" * 62 + "11"
