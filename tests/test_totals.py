"""Totals over overlapping intervals and nearest mutations, without a row for each pair."""

import random

import pytest
from pyspark.sql import functions as F

from treeloom.model import from_rows
from treeloom.operators import access, closure, intervals


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_totals_match_joins(spark, seed):
    rnd = random.Random(seed)
    some = lambda n, top: [(k, float(a), float(a + rnd.randint(0, 9))) for k, a in enumerate(rnd.randint(0, top) for _ in range(n))]
    e = spark.createDataFrame(some(60, 40), "id long, lft double, rgt double")
    s = spark.createDataFrame(some(60, 60) + [(60, -9.5, -2.0), (61, -5.0, 200.0), (62, 7.25, 7.5)], "k long, a double, b double")
    want = intervals.overlap_join(s, e, 100.0).groupBy("k").agg(F.count("*").alias("n"), F.sum(F.least("b", "rgt") - F.greatest("a", "lft")).alias("shared"))
    got = intervals.overlap_totals(s, e).select("k", "n", "shared")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    want = intervals.stab_join(s, e, "a", 100.0).groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
    got = intervals.held_totals(s, e, "a", {"n": F.lit(1), "ids": F.col("id")}).where("n > 0").select("k", "n", "ids")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_totals_of_many_overlaps(spark):
    """200000 spans, each over all of 200000 intervals: 40 billion pairs."""
    n = 200_000
    e = spark.range(n).select("id", (F.col("id") % 7).cast("double").alias("lft"), F.lit(20.0).alias("rgt"))
    s = spark.range(n).select(F.col("id").alias("k"), F.lit(10.0).alias("a"), (F.col("id") % 5 + 11).cast("double").alias("b"))
    r = intervals.overlap_totals(s, e).agg(F.min("n"), F.max("n"), F.sum("shared")).first()
    assert tuple(r) == (n, n, float(n) * n * 3)
    r = intervals.held_totals(s, e, "a", {"n": F.lit(1).cast("long"), "ids": F.col("id")}).agg(F.min("n"), F.max("ids")).first()
    assert tuple(r) == (n, n * (n - 1) // 2)


def test_lowest_mutated_edge_with_many_mutations(spark):
    """50000 mutations at one place above 50000 leaves: 2.5 billion matches. Ends of the
    neighbourhood are inclusive from below and exclusive above."""
    n = 50_000
    g = from_rows(spark, [(i, 0) for i in range(n)] + [(n, 1), (n + 1, 2)], [(0, 10, n, i) for i in range(n)] + [(0, 10, n + 1, n)], 0, 10)
    m = spark.range(n).select(F.col("id").alias("mut_id"), F.lit(5.0).alias("position"), F.lit(None).cast("double").alias("height"), F.lit(None).cast("long").alias("site_id"), F.lit(n).cast("long").alias("child"), F.lit(n + 1).cast("long").alias("parent"))
    g, near = g.with_(mutations=m), 0.25
    anc = closure.ancestry(g)
    assert access.lowest_mutated_edge(g, anc, g.leaves.withColumn("x", F.lit(5.0)), near=near).where(f"child = {n}").count() == n
    x = g.leaves.where("leaf < 4").withColumn("x", F.element_at(F.array(*map(F.lit, (4.5, 4.75, 5.0, 5.25))), (F.col("leaf") + 1).cast("int")))
    assert sorted(r.x for r in access.lowest_mutated_edge(g, anc, x, near=near).collect()) == [4.75, 5.0]
