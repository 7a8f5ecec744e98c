"""Clade and branch association with quantitative traits."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import chi2_pvalue, harrell_davis, harrell_davis_interval
from ..model import Genealogy
from ..storage import materialize
from .closure import branch_pieces, branches, carrier_counts, carriers, clades, volume
from .intervals import sweep
from .ordering import preceded, prefixes
from .windows import upper_envelope


def standardised(phenotypes: DataFrame) -> DataFrame:
    """``individual, y`` of the individuals with a value, mean 0 and sample variance 1."""
    p = phenotypes.where(F.col("y").isNotNull())
    s = p.agg(F.avg("y").alias("_m"), F.stddev_samp("y").alias("_s"))
    return p.crossJoin(F.broadcast(s)).select("individual", ((F.col("y") - F.col("_m")) / F.col("_s")).alias("y"))


def diploid_clades(anc: DataFrame, phenotypes: DataFrame) -> DataFrame:
    """Clades with ``one_count, one_sum`` over leaves with a phenotype, and ``cross``: the
    individuals with both leaves inside."""
    y = standardised(phenotypes).select(F.col("individual").alias("_i"), "y")
    a = anc.withColumn("individual", F.expr("leaf div 2")).join(y, F.col("individual") == F.col("_i"), "left")
    known = F.when(F.col("y").isNotNull(), 1).otherwise(0)
    sums = clades(a, {"one_count": known, "one_sum": F.coalesce("y", F.lit(0.0))})
    # both leaves of an individual under a node: overlap of the two ancestry rows
    h = a.where(F.col("y").isNotNull())
    one = h.where("leaf % 2 = 0").select("individual", "node", "lft", "rgt")
    two = h.where("leaf % 2 = 1").select(F.col("individual").alias("_i2"), F.col("node").alias("_n2"), F.col("lft").alias("_l"), F.col("rgt").alias("_r"))
    both = one.join(two, (F.col("individual") == F.col("_i2")) & (F.col("node") == F.col("_n2")) & (F.col("lft") < F.col("_r")) & (F.col("_l") < F.col("rgt")))
    ends = both.select("node", F.explode(F.array(F.struct(F.greatest("lft", "_l").alias("x"), F.lit(1).alias("d")), F.struct(F.least("rgt", "_r").alias("x"), F.lit(-1).alias("d")))).alias("p")).select("node", "p.x", "p.d")
    # the ends are ends of ancestry rows too, so one running sum over clades' starts does
    marks = sums.select("node", F.col("lft").alias("x"), F.lit(0).alias("d"), F.lit(1).alias("k")).union(ends.select("node", "x", "d", F.lit(0).alias("k")))
    run = Window.partitionBy("node").orderBy("x", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cross = marks.withColumn("cross", F.sum("d").over(run)).where("k = 1").select(F.col("node").alias("_n"), F.col("x").alias("_x"), "cross")
    return sums.join(cross, (F.col("node") == F.col("_n")) & (F.col("lft") == F.col("_x"))).drop("_n", "_x")


def _tested(rows: DataFrame, phenotypes: DataFrame, min_maf: float, max_maf: float, calibration: float, careful: bool) -> DataFrame:
    n = phenotypes.where(F.col("y").isNotNull()).agg(F.count("*").alias("n"))
    r = rows.crossJoin(F.broadcast(n))
    mac = F.round(F.least(F.col("one_count"), 2 * F.col("n") - F.col("one_count"))).cast("long")
    r = r.withColumn("mac", mac).where("mac > 0")
    if min_maf >= 0:
        r = r.where(F.col("mac") >= F.round(2 * F.col("n") * min_maf))
    if max_maf >= 0:
        r = r.where(F.col("mac") <= F.round(2 * F.col("n") * max_maf))
    norm = F.col("one_count") - F.col("one_count") * F.col("one_count") / F.col("n") + 2 * F.col("cross")
    square = F.col("one_sum") * F.col("one_sum")
    if careful:
        chi2 = F.try_divide(F.col("n") - 2, (F.col("n") - 1) * F.try_divide(norm, square) - 1)
    else:
        chi2 = F.try_divide(square, norm)
    return r.withColumn("chi2", F.coalesce(chi2, F.lit(0.0)) / calibration)


def associate_clades(anc: DataFrame, phenotypes: DataFrame, min_maf: float = -1, max_maf: float = -1, calibration: float = 1.0, careful: bool = False) -> DataFrame:
    """``node, lft, rgt, mac, maf, chi2, beta_positive`` of each clade interval."""
    r = _tested(diploid_clades(anc, phenotypes), phenotypes, min_maf, max_maf, calibration, careful)
    return r.select("node", "lft", "rgt", "mac", (F.col("mac") / (2 * F.col("n"))).alias("maf"), "chi2", (F.col("one_sum") > 0).alias("beta_positive"))


def associate_mutations(g: Genealogy, anc: DataFrame, phenotypes: DataFrame, rates: list[float], seed: int = 1, min_maf: float = -1, max_maf: float = -1, calibration: float = 1.0, careful: bool = False) -> DataFrame:
    """Branches on which a sampled mutation falls: ``mu_star`` is exponential with the
    branch's volume as rate, and a branch is tested if the largest rate exceeds it."""
    b = branches(g, diploid_clades(anc, phenotypes)).withColumn("volume", volume()).where("volume > 0")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "child", "parent", "lft", "rgt"), 11) / float(1 << 53)  # of the branch: the same in any retry
    star = -F.log1p(-draw) / F.col("volume")
    r = _tested(b.withColumn("mu_star", star).where(F.col("mu_star") < max(rates)), phenotypes, min_maf, max_maf, calibration, careful)
    return r.select("child", "parent", "lft", "rgt", "mac", (F.col("mac") / (2 * F.col("n"))).alias("maf"), "chi2", (F.col("one_sum") > 0).alias("beta_positive"), "mu_star", "height_child", "height_parent", "volume")


def max_per_rate(tested: DataFrame, rates: list[float]) -> DataFrame:
    r = tested.withColumn("mu", F.explode(F.array(*[F.lit(float(x)) for x in rates]))).where(F.col("mu") > F.col("mu_star"))
    return r.groupBy("mu").agg(F.max("chi2").alias("max_chi2"))


def haploid_clades(anc: DataFrame, values: DataFrame) -> DataFrame:
    """Clades below the root with ``chi2`` of a trait ``leaf, y`` of every leaf."""
    s = values.agg(F.count("*").alias("_k"), F.avg("y").alias("_m"), F.stddev_samp("y").alias("_s"))
    v = values.crossJoin(F.broadcast(s)).select(F.col("leaf").alias("_leaf"), ((F.col("y") - F.col("_m")) / F.col("_s")).alias("y"))
    c = clades(anc.join(v, F.col("leaf") == F.col("_leaf")), {"one_sum": F.col("y")}).crossJoin(F.broadcast(s.select(F.col("_k").cast("double").alias("n"))))
    p = F.col("n_desc") / F.col("n")
    beta = F.col("one_sum") / (F.sqrt(p * (1 - p) * F.col("n") / (F.col("n") - 1)) * F.col("n"))
    return c.where("n_desc < n").withColumn("chi2", beta * beta * (F.col("n") - 2)).select("node", "lft", "rgt", "n_desc", "chi2")


def haploid_top(g: Genealogy, anc: DataFrame, values: DataFrame, k: int = 0) -> DataFrame:
    """Clades by falling statistic with the volume above them and its mean position;
    the k best (all for 0)."""
    b = branch_pieces(g, haploid_clades(anc, values).withColumns({"start": F.col("lft"), "end": F.col("rgt")}))
    b = b.withColumn("_v", volume()).groupBy(F.col("child").alias("node"), "start", "end", "n_desc", "chi2", "height_child")
    r = b.agg(F.sum("_v").alias("volume"), (F.sum((F.col("lft") + F.col("rgt")) / 2 * F.col("_v")) / F.sum("_v")).alias("mean_position"))
    r = r.select("chi2", "volume", F.col("height_child").alias("height"), "start", "end", "mean_position", "n_desc", "node")
    order = [F.col(c).desc() for c in ("chi2", "volume", "height", "start", "end", "mean_position", "n_desc", "node")]
    return r.orderBy(*order).limit(k) if k else r


def _merge_steps(epsilon: float):
    """Steps of one chain in order: one that differs by more than ``epsilon`` from the value
    of the step kept last begins the next."""
    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("start", "end", "chi2")), strict=True))
        kept: list[list[float]] = []
        for start, end, value in rows:
            if kept and abs(value - kept[-1][2]) <= epsilon:
                kept[-1][1] = end
            else:
                kept.append([start, end, value])
        return pa.table([list(c) for c in zip(*kept, strict=True)], names=["start", "end", "chi2"])

    return merge


def haploid_max(g: Genealogy, anc: DataFrame, values: DataFrame, compress: bool = True, epsilon: float = 1e-8) -> DataFrame:
    """``start, end, chi2``: the largest statistic at each position as a step function
    (``windows.upper_envelope`` of the clades); steps that differ by no more than ``epsilon``
    from the value of the step that they would continue are joined. The last step reaches
    the end of the span."""
    c = haploid_clades(anc, values)
    s = upper_envelope(c.select("lft", "rgt", "chi2"), g.start, g.end, "chi2").select(F.col("lft").alias("start"), F.col("rgt").alias("end"), F.col("value").alias("chi2"))
    if not compress:
        return s
    # A step is within epsilon of the value kept before it, or is kept itself; so one that is over
    # twice epsilon from the step before surely is. Chains begin there; where all of a chain is
    # near its first value one step is left.
    s = preceded(materialize(s, "steps"), "start", "chi2", "_before")
    new = F.col("_before").isNull() | (F.abs(F.col("chi2") - F.col("_before")) > 2 * epsilon)
    m = prefixes(s.withColumn("_n", new.cast("long")), ["start"], {"_sum": F.col("_n")}).withColumn("_r", F.col("_sum") + F.col("_n")).drop("_before", "_sum", "_n")
    m = materialize(m, "chains")
    chains = m.groupBy("_r").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("chi2", "start").alias("chi2"), F.max(F.col("chi2")).alias("_hi"), F.min(F.col("chi2")).alias("_lo"))
    flat = (F.col("_hi") - F.col("chi2") <= epsilon) & (F.col("chi2") - F.col("_lo") <= epsilon)
    drifting = m.join(chains.where(~flat).select("_r"), "_r").groupBy("_r").applyInArrow(_merge_steps(epsilon), "start double, end double, chi2 double")
    return chains.where(flat).select("start", "end", "chi2").union(drifting)


def null_model(anc: DataFrame, phenotypes: DataFrame, at_once: int = 16) -> DataFrame:
    """``seed, max_chi2, min_p`` for many traits at once (``seed, individual, y``): the clades are
    swept once for ``at_once`` traits, with a sum and a count for each; the ancestry is
    not multiplied by the traits."""
    p = phenotypes.where("y is not null")
    s = materialize(p.groupBy("seed").agg(F.avg("y").alias("_m"), F.stddev_samp("y").alias("_s"), F.count("*").alias("n")), "traits")
    y = p.join(F.broadcast(s), "seed").select("seed", F.col("individual").alias("_i"), ((F.col("y") - F.col("_m")) / F.col("_s")).alias("y"))
    seeds = sorted(r["seed"] for r in s.select("seed").collect())  # the traits asked for
    a = anc.withColumn("individual", F.expr("leaf div 2"))
    two = a.where("leaf % 2 = 1").select(F.col("individual").alias("_i2"), F.col("node").alias("_n2"), F.col("lft").alias("_l"), F.col("rgt").alias("_r"))
    both = a.where("leaf % 2 = 0").join(two, (F.col("individual") == F.col("_i2")) & (F.col("node") == F.col("_n2")) & (F.col("lft") < F.col("_r")) & (F.col("_l") < F.col("rgt")))
    both = both.select("node", F.greatest("lft", "_l").alias("lft"), F.least("rgt", "_r").alias("rgt"), F.lit(1).alias("_both"))
    parts = []
    for k in range(0, len(seeds), at_once):
        some = seeds[k : k + at_once]
        wide = y.where(F.col("seed").isin(some)).groupBy("_i").agg(*[F.max(F.when(F.col("seed") == x, F.col("y"))).alias(f"v{j}") for j, x in enumerate(some)])
        values = {f"v{j}": F.coalesce(F.col(f"v{j}"), F.lit(0.0)) for j in range(len(some))} | {f"c{j}": F.col(f"v{j}").isNotNull().cast("int") for j in range(len(some))}
        # carriers of a clade and pairs of one individual are summed in the same sweep
        one = a.join(wide, F.col("individual") == F.col("_i")).select("node", "lft", "rgt", F.lit(0).alias("_both"), *[v.alias(n) for n, v in values.items()])
        c = sweep(one.unionByName(both, allowMissingColumns=True), ["node"], {"cross": F.col("_both")} | {n: F.coalesce(F.col(n), F.lit(0)) for n in values})
        traits = F.explode(F.array(*[F.struct(F.lit(x).alias("seed"), F.col(f"v{j}").alias("one_sum"), F.col(f"c{j}").alias("count")) for j, x in enumerate(some)]))
        r = c.select("cross", traits.alias("t")).select("cross", "t.*").join(F.broadcast(s.select(F.col("seed").alias("_seed"), "n")), F.col("seed") == F.col("_seed"))
        norm = F.col("count") - F.col("count") * F.col("count") / F.col("n") + 2 * F.col("cross")
        mac = F.least(F.col("count"), 2 * F.col("n") - F.col("count"))
        parts.append(r.where(mac > 0).groupBy("seed").agg(F.max(F.coalesce(F.try_divide(F.col("one_sum") * F.col("one_sum"), norm), F.lit(0.0))).alias("max_chi2")))
    best = reduce(DataFrame.union, parts) if parts else s.select("seed", F.lit(None).cast("double").alias("max_chi2"))
    return best.withColumn("min_p", chi2_pvalue("max_chi2"))



def residual(phenotypes: DataFrame, predictor: DataFrame) -> DataFrame:
    """``individual, residual``: centred phenotype less centred predictor (``individual,
    blup``), over the individuals that have both."""
    both = phenotypes.join(predictor.select(F.col("individual").alias("_i"), "blup"), F.col("individual") == F.col("_i")).where("y is not null and blup is not null")
    m = both.agg(F.avg("y").alias("_my"), F.avg("blup").alias("_mb"))
    return both.crossJoin(F.broadcast(m)).select("individual", (F.col("y") - F.col("_my") - (F.col("blup") - F.col("_mb"))).alias("residual"))


def predictor_of_scores(scores: DataFrame, n_sites: int) -> DataFrame:
    """``individual, blup`` from average scores (``individual, average``) over ``n_sites`` sites."""
    return scores.select("individual", (-2.0 * n_sites * F.col("average")).alias("blup"))


def inverted_calibration(lines: DataFrame) -> float:
    """The factor to divide by, from the lines (``value``) of a mixed model's log: 1 where
    just one tells of calibration, else one over the last number but one of the last line but
    one that does."""
    told = [r["value"].strip() for r in lines.where(F.col("value").contains("alibration")).select("value").collect()]
    if not told:
        raise ValueError("the log names no calibration factor")
    return 1.0 if len(told) == 1 else 1.0 / float(told[-2].split()[-2])


def tests_from_frequency(tested: DataFrame, min_mafs: list[float]) -> DataFrame:
    """``min_maf, tests, max_chi2, min_p``: for each bound the tests at or above it, all in
    one pass."""
    r = tested.withColumn("min_maf", F.explode(F.array(*[F.lit(float(x)) for x in min_mafs]))).where("maf >= min_maf")
    r = r.groupBy("min_maf").agg(F.count("*").alias("tests"), F.max("chi2").alias("max_chi2"))
    every = tested.sparkSession.createDataFrame([(float(x),) for x in min_mafs], "min_maf double")
    r = every.join(r, "min_maf", "left").select("min_maf", F.coalesce("tests", F.lit(0)).alias("tests"), "max_chi2")
    return r.withColumn("min_p", F.coalesce(chi2_pvalue("max_chi2"), F.lit(1.0)))


def null_scaling(results: DataFrame, null_id: str) -> DataFrame:
    """``min_maf, scaling, min_p, chunks`` over the results of all parts of a genome
    (``arg_id, min_maf, tests, min_p``): the share of the tests that fall in ``null_id``."""
    own = F.sum(F.when(F.col("arg_id") == null_id, F.col("tests")).otherwise(0))
    return results.groupBy("min_maf").agg(F.try_divide(own.cast("double"), F.sum("tests").cast("double")).alias("scaling"), F.min("min_p").alias("min_p"), F.count("*").alias("chunks"))


def genome_threshold(null: DataFrame, scaling: float, share: float = 0.05) -> DataFrame:
    """``threshold, lower, upper, replicates`` of the least p-values of null traits (``min_p``):
    the Harrell-Davis quantile and its interval, times the share of the genome."""
    p = [r["min_p"] for r in null.select("min_p").collect()]  # a row per replicate
    q, (low, high) = harrell_davis(p, share), harrell_davis_interval(p, share)
    return null.sparkSession.createDataFrame([(q * scaling, low * scaling, high * scaling, len(p))], "threshold double, lower double, upper double, replicates long")


def _normal(seed: Column, key: str) -> Column:
    """A standard normal draw of each (seed, key): the same in any retry."""
    draw = lambda k: (F.shiftrightunsigned(F.xxhash64(seed, F.lit(k), key), 11) + 1) / float((1 << 53) + 1)
    return F.sqrt(-2 * F.log(draw(1))) * F.cos(2 * F.pi() * draw(2))


def null_traits(g: Genealogy, replicates: int, seed: int = 1) -> DataFrame:
    """``seed, individual, y``: traits of chance alone, for ``null_model``."""
    who = g.leaves.select(F.expr("leaf div 2").alias("individual")).distinct()
    every = who.withColumn("seed", F.explode(F.sequence(F.lit(seed).cast("long"), F.lit(seed + replicates - 1).cast("long"))))
    return every.select("seed", "individual", _normal(F.col("seed"), "individual").alias("y"))


def example_trait(g: Genealogy, anc: DataFrame, count: int = 20, noise: float = 1.0, seed: int = 1) -> DataFrame:
    """``individual, dosage, y``: a noisy trait of the first mutation with ``count`` carriers."""
    per = carrier_counts(g, clades(anc)).where(F.col("n_desc") == count)
    chosen = per.groupBy().agg(F.min(F.struct("position", "mut_id"))["mut_id"].alias("_chosen"))
    m = g.mutations.join(F.broadcast(chosen), F.col("mut_id") == F.col("_chosen"), "left_semi")
    dose = carriers(g.with_(mutations=m), anc).groupBy(F.expr("leaf div 2").alias("_i")).agg(F.count("*").alias("dosage"))
    who = g.leaves.select(F.expr("leaf div 2").alias("individual")).distinct()
    normal = _normal(F.lit(seed), "individual")
    return who.join(dose, F.col("individual") == F.col("_i"), "left").select("individual", F.coalesce("dosage", F.lit(0)).alias("dosage"), (F.coalesce("dosage", F.lit(0)) + noise * normal).alias("y"))
