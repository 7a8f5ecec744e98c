"""Placing genotypes on a genealogy, and imputing missing ones.

Genotypes are long: ``site, position, leaf, dosage`` with dosage 0, 1 or null. All
operators answer every site at once, in order of position against the changing tree (``site_trees``)."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Genealogy
from .site_trees import imputed, site_nodes, unphased


def map_parsimony(g: Genealogy, genotypes: DataFrame) -> DataFrame:
    """``site, position, child, parent``: a mutation above each maximal clade that only
    carriers inherit. A site that all leaves carry has no edge and is an error."""
    c = site_nodes(g, genotypes)
    bad = F.raise_error(F.lit("every leaf carries the allele: there is no edge to put it on")).cast("boolean")
    full = F.when(F.col("ones") == F.col("n"), bad).otherwise(F.col("n1") == F.col("n_desc"))
    return c.where(full & F.col("parent").isNotNull() & (F.col("up_n1") < F.col("up_desc"))).select("site", "position", F.col("node").alias("child"), "parent")


def map_mutations(g: Genealogy, genotypes: DataFrame) -> Genealogy:
    """The genealogy with a batch of sites mapped and added to its mutations."""
    m = map_parsimony(g, genotypes).select(F.xxhash64("site", "child").alias("mut_id"), "position", F.lit(None).cast("double").alias("height"), F.col("site").alias("site_id"), "child", "parent")
    return g.with_(mutations=g.mutations.unionByName(m))


def map_approximate(g: Genealogy, genotypes: DataFrame) -> DataFrame:
    """``site, child, penalty``: few carriers (up to 4) by parsimony, few non-carriers (up
    to 4) by parsimony of the complement, else the best single edge by the share of
    leaves it gets wrong, if below 0.03 and with overlaps above 0.7. The first of equals
    is the lowest node."""
    t = genotypes.groupBy("site").agg(F.count_if(F.col("dosage") == 1).alias("_ones"), F.count("*").alias("_n"))
    rare, common = t.where("_ones <= 4").select("site"), t.where("_ones > 4 and _n - _ones <= 4").select("site")
    middle = t.where("_ones > 4 and _n - _ones > 4").select("site")
    few = map_parsimony(g, genotypes.join(rare, "site", "left_semi")).select("site", "child", F.lit(0.0).alias("penalty"))
    turned = genotypes.join(common, "site", "left_semi").withColumn("dosage", 1 - F.col("dosage"))
    many = map_parsimony(g, turned).select("site", "child", F.lit(0.0).alias("penalty"))
    part = genotypes.join(middle, "site", "left_semi")
    c = site_nodes(g, part).where("parent is not null")
    wrong = (F.col("ones") - F.col("n1") + F.col("n_desc") - F.col("n1")) / F.col("n")
    fits = (F.col("n1") / F.greatest("n_desc", "ones") > 0.7) & ((F.col("n") - F.col("ones") - F.col("n_desc") + F.col("n1")) / F.greatest(F.col("n") - F.col("n_desc"), F.col("n") - F.col("ones")) > 0.7)
    best = c.withColumn("penalty", wrong).where(fits & (F.col("penalty") < 0.03))
    best = best.groupBy("site").agg(F.min(F.struct("penalty", "height_child", "node")).alias("b")).select("site", F.col("b.node").alias("child"), "b.penalty")
    return few.union(many).union(best)


def mutation_best(g: Genealogy, genotypes: DataFrame) -> DataFrame:
    """``site, distance``: least Hamming distance of any placement on one branch, either
    way round; 0 for at most one carrier or one non-carrier."""
    c = site_nodes(g, genotypes)
    wrong = F.col("ones") - F.col("n1") + F.col("n_desc") - F.col("n1")
    best = c.groupBy("site").agg(F.min(F.least(wrong, F.col("n") - wrong)).alias("_d"), F.max("ones").alias("_o"), F.max("n").alias("_n"))
    return best.select("site", F.when((F.col("_o") <= 1) | (F.col("_o") >= F.col("_n") - 1), 0).otherwise(F.col("_d")).alias("distance"))


def mutation_match(g: Genealogy, genotypes: DataFrame) -> DataFrame:
    """``site, matched``: whether a clade or its complement is exactly the carriers."""
    c = site_nodes(g, genotypes)
    same = (F.col("n1") == F.col("n_desc")) & (F.col("n1") == F.col("ones"))
    turned = (F.col("n1") == 0) & (F.col("n_desc") == F.col("n") - F.col("ones"))
    plain = (F.col("ones") == 0) | (F.col("ones") == F.col("n"))
    return c.groupBy("site").agg(F.bool_or(same | turned | plain).alias("matched"))


def match_binned(g: Genealogy, genotypes: DataFrame, thresholds: list[int]) -> DataFrame:
    """``bin, n_sites, n_wrong, distance`` by minor allele count; bin = number of
    thresholds that the count reaches."""
    best = mutation_best(g, genotypes)
    mac = genotypes.groupBy("site").agg(F.least(F.count_if(F.col("dosage") == 1), F.count_if(F.col("dosage") == 0)).alias("mac"))
    place = sum((F.when(F.col("mac") >= t, 1).otherwise(0) for t in thresholds), F.lit(0))
    return best.join(mac, "site").withColumn("bin", place).groupBy("bin").agg(F.count("*").alias("n_sites"), F.count_if(F.col("distance") > 0).alias("n_wrong"), F.sum("distance").alias("distance"))


def impute(g: Genealogy, genotypes: DataFrame, single_best: bool = False) -> DataFrame:
    """``site, leaf, dosage`` with nulls filled.

    Every branch is scored under both polarities by its mismatches; the best ones are
    weighted by branch length and added below (or taken off, if the derived state is 0).
    ``single_best`` takes the longest of them alone. Without a known 0 all are 1, without
    a known 1 all are 0."""
    return imputed(g, genotypes, single_best)


def place_unphased(children, parents, lengths, individuals, doses) -> list[int]:
    """The nodes above which one site's mutations fall, on one tree (its edges as parallel
    lists). Each node counts the leaves below it that may not carry the allele, and the
    heterozygotes with both leaves below; a leaf climbs while both counts are zero. A change
    walks one path to the root, so a site costs leaves times depth, and counts per node."""
    up, length = dict(zip(children, parents, strict=True)), dict(zip(children, lengths, strict=True))
    kids: dict[int, list[int]] = {}
    for c, p in up.items():
        kids.setdefault(p, []).append(c)
    dosage = dict(zip(individuals, doses, strict=True))
    if any(v not in (0, 1, 2) for v in dosage.values()):
        raise ValueError("unphased genotypes are 0, 1 or 2")
    leaves = {v for i in dosage for v in (2 * i, 2 * i + 1) if v in up or v in kids}
    free = {v for v in leaves if dosage[v // 2] > 0}
    het = {i for i in dosage if dosage[i] == 1}
    size, barred, doubles = Counter(), Counter(), Counter()

    def path(x):
        while x is not None:
            yield x
            x = up.get(x)

    for v in leaves:
        for x in path(v):
            size[x] += 1
            barred[x] += v not in free
    meet = {}
    for i in het:
        one = set(path(2 * i)) if {2 * i, 2 * i + 1} <= leaves else ()
        meet[i] = next((x for x in path(2 * i + 1) if x in one), None)
        doubles.update(path(meet[i]))

    def highest(x):
        while (y := up.get(x)) is not None and not barred[y] and not doubles[y]:
            x = y
        return x

    def take(x):
        if x not in up:
            raise ValueError("every leaf carries the allele: there is no edge to put it on")
        found.append(x)
        stack = [x]
        while stack:
            v = stack.pop()
            stack += kids.get(v, ())
            if v not in leaves:
                continue
            both = v // 2 in het
            for u in (v, v ^ 1) if both else (v,):
                if u in free:
                    free.discard(u)
                    barred.update(path(u))
            if both:
                het.discard(v // 2)
                doubles.subtract(path(meet[v // 2]))

    found: list[int] = []
    for v in sorted(leaves):
        if dosage[v // 2] == 2 and v in free:
            take(highest(v))
    for i in sorted(het):
        options = [highest(v) for v in (2 * i, 2 * i + 1) if v in leaves]
        if i in het and options:
            take(max(enumerate(options), key=lambda o: (size[o[1]], length.get(o[1], 0.0), o[0]))[1])
    return sorted(found)


def map_diploid(g: Genealogy, genotypes: DataFrame) -> DataFrame:
    """``site, position, child``: placement of unphased genotypes (``site, position,
    individual, dosage`` 0, 1, 2 over leaf pairs 2i, 2i + 1).

    Homozygotes first: maximal clades of their leaves and of heterozygotes' leaves, at
    most one of each pair; then each heterozygote not yet covered takes, of its two
    leaves, the one whose highest such clade has more carriers, then the longer branch,
    then the second leaf. Order within a site matters, so a site is one step; its tree is the
    one before with the edges changed in between. Other dosages, and a site that all leaves
    carry, are errors; leaves that the tree lacks are passed over."""
    return unphased(g, genotypes, place_unphased)
