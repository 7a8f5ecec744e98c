"""Jobs: ``python -m treeloom JOB`` (also by spark-submit).

``associate, import, export, relationship`` work on a stored genealogy. The rest are the steps
round an association: ``calibration`` and ``residual`` before it; ``tests`` of its results,
``scaling`` over all parts of a genome, ``null`` traits and the ``threshold`` they give."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import association, closure, export, relatedness
from .sources import files


def associate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Tests every clade (rate 0) or sampled branches of a stored genealogy."""
    g = files.read_parquet(spark, a.genealogy)
    y = files.match_phenotypes(files.read_samples(spark, a.samples), files.read_phenotypes(spark, a.phenotypes))
    used = y.where(F.col("y").isNotNull()).count()
    low = a.min_mac / (2 * used) if a.min_mac else a.min_maf
    anc = closure.ancestry(g)
    if a.rate:
        rows = association.associate_mutations(g, anc, y, [a.rate], a.seed, low, a.max_maf, a.calibration, a.careful)
        export.write_table(export.mutation_association_table(rows, g.chromosome, a.prefix), a.out)
    else:
        rows = association.associate_clades(anc, y, low, a.max_maf, a.calibration, a.careful)
        export.write_table(export.association_table(rows, g.chromosome, a.prefix), a.out)


def import_(spark: SparkSession, a: argparse.Namespace) -> None:
    files.write_parquet(files.read_text_tables(spark, a.nodes, a.edges).set_chromosome(a.chromosome), a.out)


def export_(spark: SparkSession, a: argparse.Namespace) -> None:
    for name, table in export.table_export(files.read_parquet(spark, a.genealogy)).items():
        export.write_table(table, f"{a.out}/{name}", compressed=False)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Columns of a tab-separated table with a header, by name."""
    t = spark.read.csv(path, sep="\t", header=True)
    return t.select(*[F.col(c).cast(kind).alias(c) for c, kind in (x.split() for x in schema.split(", "))])


def relationship(spark: SparkSession, a: argparse.Namespace) -> None:
    """The relationship matrix: exact, or of mutations drawn at a rate."""
    g = files.read_parquet(spark, a.genealogy)
    anc = closure.ancestry(g)
    m = relatedness.monte_carlo_relationship(g, anc, a.rate, a.seed, a.alpha) if a.rate else relatedness.exact_relationship(g, anc, a.alpha)
    export.write_matrix(m, a.sites, a.out, a.binary)


def calibration(spark: SparkSession, a: argparse.Namespace) -> None:
    """The factor to divide statistics by, from a mixed model's log."""
    print(association.inverted_calibration(spark.read.text(a.log)))


def residual(spark: SparkSession, a: argparse.Namespace) -> None:
    """Phenotypes less the predictor of average scores (files of FID, IID, value)."""
    y = files.read_phenotypes(spark, a.phenotypes)
    scores = files.read_phenotypes(spark, a.scores).select(F.col("iid").alias("individual"), F.col("y").alias("average"))
    r = association.residual(y.select(F.col("iid").alias("individual"), "y"), association.predictor_of_scores(scores, a.sites))
    names = y.select(F.col("fid").alias("FID"), F.col("iid").alias("IID"))
    export.write_table(names.join(r, F.col("IID") == F.col("individual")).select("FID", "IID", F.col("residual").alias("RESIDUAL")), a.out, compressed=False)


def tests(spark: SparkSession, a: argparse.Namespace) -> None:
    """Tests and least p-value at or above each frequency, of one association's results."""
    t = _table(spark, a.results, "MAF double, CHISQ double").withColumnsRenamed({"MAF": "maf", "CHISQ": "chi2"})
    export.write_table(association.tests_from_frequency(t, a.min_mafs).select(F.lit(a.part).alias("arg_id"), "min_maf", "tests", "max_chi2", "min_p"), a.out, compressed=False)


def scaling(spark: SparkSession, a: argparse.Namespace) -> None:
    """The share of a genome's tests that fall in the part null traits are tested on."""
    t = _table(spark, a.tests, "arg_id string, min_maf double, tests long, min_p double")
    export.write_table(association.null_scaling(t, a.null_part), a.out, compressed=False)


def null(spark: SparkSession, a: argparse.Namespace) -> None:
    """Largest statistic and least p-value over all clades of traits of chance."""
    g = files.read_parquet(spark, a.genealogy)
    export.write_table(association.null_model(closure.ancestry(g), association.null_traits(g, a.replicates, a.seed)), a.out, compressed=False)


def threshold(spark: SparkSession, a: argparse.Namespace) -> None:
    """The genome-wide threshold of null traits' least p-values."""
    export.write_table(association.genome_threshold(_table(spark, a.null, "min_p double"), a.scaling, a.share), a.out, compressed=False)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="treeloom", description=__doc__)
    sub = p.add_subparsers(required=True)
    s = sub.add_parser("associate", help=associate.__doc__)
    for name in ("genealogy", "phenotypes", "samples", "out"):
        s.add_argument(f"--{name}", required=True)
    for name, default in (("min-mac", 0.0), ("min-maf", -1.0), ("max-maf", -1.0), ("calibration", 1.0), ("rate", 0.0)):
        s.add_argument(f"--{name}", type=float, default=default)
    s.add_argument("--seed", type=int, default=1)
    s.add_argument("--prefix", default="")
    s.add_argument("--careful", action="store_true")
    s.set_defaults(run=associate)
    s = sub.add_parser("import", help="text tables to the native format")
    for name in ("nodes", "edges", "out"):
        s.add_argument(f"--{name}", required=True)
    s.add_argument("--chromosome", type=int, default=1)
    s.set_defaults(run=import_)
    s = sub.add_parser("export", help="the native format to text tables")
    for name in ("genealogy", "out"):
        s.add_argument(f"--{name}", required=True)
    s.set_defaults(run=export_)
    steps = (
        (relationship, ("genealogy", "out"), {"rate": 0.0, "alpha": -1.0, "seed": 1234, "sites": 1}),
        (calibration, ("log",), {}), (residual, ("phenotypes", "scores", "out"), {"sites": 1}),
        (tests, ("results", "part", "out"), {}), (scaling, ("tests", "null-part", "out"), {}),
        (null, ("genealogy", "out"), {"replicates": 20, "seed": 1}), (threshold, ("null", "out"), {"scaling": 1.0, "share": 0.05}),
    )
    for step, needed, optional in steps:
        s = sub.add_parser(step.__name__, help=step.__doc__)
        for name in needed:
            s.add_argument(f"--{name}", required=True)
        for name, default in optional.items():
            s.add_argument(f"--{name}", type=type(default), default=default)
        if step is relationship:
            s.add_argument("--binary", action="store_true")
        if step is tests:
            s.add_argument("--min-mafs", type=float, nargs="+", default=[0.0])
        s.set_defaults(run=step)
    a = p.parse_args(argv)
    a.run(SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    main()
