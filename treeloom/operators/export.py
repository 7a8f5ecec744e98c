"""Text forms and sinks: trees, haplotypes, set extents, relationship matrices."""

from __future__ import annotations

import struct
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import chi2_pvalue_text
from ..model import NODE_IS_NOT_SAMPLE, NODE_IS_SAMPLE, Genealogy
from ..storage import materialize
from .access import carrier_lists, dense_text
from .closure import branches, clade_hashes, clade_sums, clades, roots, with_members
from .intervals import islands, stab_join
from .ordering import followed, numbered
from .statistics import edge_heights


def marginal_trees(g: Genealogy) -> DataFrame:
    """``lft, rgt`` between neighbouring breakpoints of the edges."""
    cuts = g.edges.select(F.explode(F.array("lft", "rgt")).alias("x")).distinct()
    return followed(cuts, "x", "rgt").select(F.col("x").alias("lft"), "rgt").where("rgt is not null")


def newick(g: Genealogy, lengths: bool = False) -> DataFrame:
    """``lft, rgt, tree`` of each marginal tree; children in order of id, branch lengths
    cut to whole numbers. Texts are built bottom up, one level of all trees at a time."""
    trees = marginal_trees(g).withColumnRenamed("lft", "a").withColumnRenamed("rgt", "b")
    e = materialize(stab_join(trees, edge_heights(g), "a", g.span).select("a", "b", "parent", "child", (F.col("height_parent") - F.col("height_child")).cast("long").alias("len")))
    inner = e.select("a", F.col("parent").alias("child"), F.lit(True).alias("_inner")).distinct()
    e = materialize(e.join(inner, ["a", "child"], "left"))
    tip = lambda text: F.struct("child", (F.concat(text, F.lit(":"), F.col("len").cast("string")) if lengths else text).alias("t"))
    # tips are listed once below their parents; only texts of inner nodes are joined level by level
    own = F.collect_list(F.when(F.col("_inner").isNull(), tip(F.col("child").cast("string"))))
    nodes = materialize(e.groupBy("a", "b", "parent").agg(F.count("_inner").alias("n"), own.alias("own")))
    named = lambda rows, kids: materialize(rows.select("a", "b", F.col("parent").alias("node"), F.concat(F.lit("("), F.array_join(F.sort_array(kids)["t"], ","), F.lit(")"), F.col("parent").cast("string")).alias("text")))
    done, ways = named(nodes.where("n = 0"), F.col("own")), e.where("_inner").select("a", "b", "parent", "child", "len")
    while True:
        up = ways.join(done.select("a", F.col("node").alias("child"), "text"), ["a", "child"]).groupBy("a", "b", "parent")
        up = up.agg(F.count("*").alias("have"), F.collect_list(tip(F.col("text"))).alias("more")).join(nodes.where("n > 0"), ["a", "b", "parent"]).where("have = n")
        up = named(up.join(done.select("a", F.col("node").alias("parent")), ["a", "parent"], "left_anti"), F.concat("own", "more"))
        if up.isEmpty():
            break
        done = done.unionByName(up)
    top = roots(g).select(F.col("node").alias("_n"), F.col("lft").alias("_l"), F.col("rgt").alias("_r"))
    out = done.join(top, (F.col("node") == F.col("_n")) & (F.col("_l") <= F.col("a")) & (F.col("a") < F.col("_r")))
    return out.select(F.col("a").alias("lft"), F.col("b").alias("rgt"), F.col("text").alias("tree"))


def newick_lines(g: Genealogy, lengths: bool = False) -> DataFrame:
    t = newick(g, lengths).orderBy("lft")
    return t.select(F.format_string("Tree in [%s, %s): %s", F.regexp_replace(F.col("lft").cast("string"), r"\.0$", ""), F.regexp_replace(F.col("rgt").cast("string"), r"\.0$", ""), "tree").alias("value"))


def _permuted(g: Genealogy, permutation: DataFrame) -> DataFrame:
    """``_a, _b`` of a table ``old, new``, shown to map samples onto themselves."""
    p = materialize(permutation.select(F.col("old").cast("long").alias("_a"), F.col("new").cast("long").alias("_b")), "permutation")
    sides = p.select(F.col("_a").alias("id"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(p.select("_b", F.lit(0), F.lit(1)))
    wrong = sides.groupBy("id").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("id is null or a != 1 or b != 1")
    strange = p.join(g.leaves, F.col("_a") == F.col("leaf"), "left_anti")
    if not wrong.isEmpty() or not strange.isEmpty():
        raise ValueError("a permutation maps the samples onto themselves")
    return p


def table_export(g: Genealogy, permutation: DataFrame | None = None) -> dict[str, DataFrame]:
    """Node, edge, site and mutation tables of a tree sequence: one site per mutation, edges
    by parent age. Needs a span from 0 and leaves 0 to n - 1. ``permutation``: a table
    ``old, new`` of samples that take other ids."""
    if g.start != 0:
        raise ValueError("tables start at position 0")
    flag = F.when(F.col("is_sample"), NODE_IS_SAMPLE).otherwise(NODE_IS_NOT_SAMPLE)
    nodes, edges, m = g.nodes, edge_heights(g), g.mutations
    if permutation is not None:
        p = _permuted(g, permutation)
        nodes = nodes.join(p, F.col("node_id") == F.col("_a"), "left").withColumn("node_id", F.coalesce("_b", "node_id")).drop("_a", "_b")
        edges = edges.join(p, F.col("child") == F.col("_a"), "left").withColumn("child", F.coalesce("_b", "child")).drop("_a", "_b")
        m = m.join(p, F.col("child") == F.col("_a"), "left").withColumn("child", F.coalesce("_b", "child")).drop("_a", "_b")
    m = numbered(m, ["position", "mut_id"], "site")
    return {
        "nodes": nodes.select(F.col("node_id").alias("id"), flag.alias("flags"), F.col("height").alias("time")),
        "edges": edges.orderBy("height_parent", "parent", "child", "lft").select("lft", "rgt", "parent", "child"),
        "sites": m.select(F.col("site").alias("id"), "position", F.lit("0").alias("ancestral_state")),
        "mutations": m.select("site", F.col("child").alias("node"), F.col("height").alias("time"), F.lit("1").alias("derived_state")),
        "metadata": g.spark.createDataFrame([(g.offset, g.chromosome)], "offset int, chromosome int"),
    }


def haplotypes(g: Genealogy, anc: DataFrame, min_maf: float = 0.0, max_maf: float = 1.0, min_time: float = 0.0, max_time: float = float("inf")) -> DataFrame:
    """``mut_id, position, line``: chromosome, id, place, alleles, then a 0 or 1 per leaf.
    Minor allele frequency in [min, max); known heights in [min, max)."""
    m = g.mutations.where(F.col("height").isNull() | ((F.col("height") >= min_time) & (F.col("height") < max_time)))
    have = carrier_lists(g.with_(mutations=m), anc).where(F.size("_have") > 0)
    k, n = F.size("_have"), F.col("_n")
    maf = F.least(k, n - k) / n
    flags = have.where((maf >= min_maf) & (maf < max_maf)).select("_muts", dense_text(F.col("_have"), n, " ").alias("_flags"))
    rows = flags.select(F.explode("_muts").alias("_m"), "_flags").select("_m.mut_id", "_m.position", "_flags")
    head = F.concat_ws(" ", F.lit(str(g.chromosome)), F.concat(F.lit("SNP_"), F.col("mut_id").cast("string")), (F.lit(g.offset) + F.col("position").cast("int")).cast("string"), F.lit("0"), F.lit("1"))
    return rows.select("mut_id", "position", F.concat(head, "_flags").alias("line"))


def drawn_haplotypes(g: Genealogy, anc: DataFrame, drawn: Genealogy) -> DataFrame:
    """``idx, position, line``: the haplotype lines of mutations drawn on ``g`` (``drawn``), numbered
    in order of position. Draws are dealt by ranges of positions, and each range's lines are
    put together where it lies: nothing is sorted as a whole."""
    return numbered(haplotypes(drawn, anc), ["position", "mut_id"], "idx").select("idx", "position", "line")


def write_drawn_haplotypes(g: Genealogy, anc: DataFrame, drawn: Genealogy, path: str) -> None:
    """The lines as text parts in order: the parts one after another, in order of their names, are
    the file sorted by position. The samples go beside them."""
    lines = drawn_haplotypes(g, anc, drawn)
    parts = int(g.spark.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(parts, "idx").sortWithinPartitions("idx").select("line").write.text(f"{path}.haps", compression="gzip")
    sample_lines(g).coalesce(1).write.text(f"{path}.samples")


def sample_lines(g: Genealogy) -> DataFrame:
    """The sample file that goes with haplotypes: two header lines, then a line per
    individual."""
    who = g.leaves.select(F.expr("leaf div 2").alias("i")).distinct()
    head = g.spark.createDataFrame([(-2, "ID_1 ID_2 missing"), (-1, "0 0 0")], "i long, value string")
    return head.union(who.select("i", F.format_string("%d %d 0", "i", "i"))).orderBy("i").select("value")


def set_extents(g: Genealogy, anc: DataFrame, joined: bool = True) -> DataFrame:
    """``desc, n_desc, lft, rgt``: where each leaf set below a root is a clade; touching
    extents made one if asked. The offset of the genealogy is always added."""
    n = g.leaves.agg(F.count("*").alias("_n"))
    s = clade_hashes(anc).crossJoin(F.broadcast(n)).where("n_desc < _n")
    s = s.groupBy("h1", "h2", "n_desc", "lft", "rgt").agg(F.min("node").alias("node"))
    s = _joined(s) if joined else s.withColumn("rep", F.struct("node", F.col("lft").alias("x")))
    return with_members(s, anc).select("desc", "n_desc", (F.col("lft") + g.offset).alias("lft"), (F.col("rgt") + g.offset).alias("rgt"))


def set_runs(g: Genealogy, anc: DataFrame, min_mac: int = 0, max_mac: int = 0) -> DataFrame:
    """``desc, n_desc, lft, rgt``: one row per run of a set with minor count in
    [min_mac, max_mac] (0: no limit); a run ends where a gap follows."""
    n = g.leaves.agg(F.count("*").alias("_n"))
    s = clade_hashes(anc).crossJoin(F.broadcast(n)).where("n_desc < _n")
    mac = F.least(F.col("n_desc"), F.col("_n") - F.col("n_desc"))
    s = s.where(mac >= min_mac) if min_mac else s
    s = s.where(mac <= max_mac) if max_mac else s
    return with_members(_joined(s), anc).select("desc", "n_desc", "lft", "rgt")


def _joined(s: DataFrame) -> DataFrame:
    """Runs of each set, with a place where the set is found."""
    place = s.groupBy("h1", "h2").agg(F.min(F.struct("node", F.col("lft").alias("x"))).alias("rep"))
    return islands(s.select("h1", "h2", "n_desc", "lft", "rgt"), ["h1", "h2", "n_desc"]).join(place, ["h1", "h2"])


def dosage_lines(runs: DataFrame, n_individuals: int) -> DataFrame:
    """Dosage of each individual in a run's set, as text."""
    leaves = F.transform(F.split("desc", ","), lambda x: x.cast("long"))
    dose = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n_individuals - 1).cast("long")), lambda i: F.size(F.filter(leaves, lambda x: F.floor(x / 2) == i)).cast("string"))
    return runs.select("desc", "lft", "rgt", F.array_join(dose, " ").alias("dosage"))


def branch_rows(g: Genealogy, anc: DataFrame | None = None) -> DataFrame:
    """``lft, rgt, position, height_child, height_parent, n_desc, af`` of every branch at
    its parent's intervals; position is the midpoint."""
    n = g.leaves.agg(F.count("*").alias("_n"))
    b = branches(g, clade_sums(g) if anc is None else clades(anc)).crossJoin(F.broadcast(n))
    return b.select("parent", "child", "lft", "rgt", ((F.col("lft") + F.col("rgt")) / 2).alias("position"), "height_child", "height_parent", "n_desc", (F.col("n_desc") / F.col("_n")).alias("af"))


def write_lines(lines: DataFrame, path: str, compressed: bool = True) -> None:
    lines.write.mode("overwrite").option("compression", "gzip" if compressed else "none").text(path)


def write_table(rows: DataFrame, path: str, compressed: bool = True) -> None:
    """Tab-separated with a header."""
    rows.write.mode("overwrite").csv(path, sep="\t", header=True, compression="gzip" if compressed else "none")


def lower_triangle(m: DataFrame, n_sites: int) -> DataFrame:
    """Lines of a lower-triangle matrix file: i, j (from 1), number of sites, value."""
    t = m.where("j <= i").orderBy("i", "j")
    return t.select(F.format_string("%d\t%d\t%d\t%s", (F.col("i") + 1).cast("long"), (F.col("j") + 1).cast("long"), F.lit(n_sites), F.col("value").cast("string")).alias("value"))


def triangle_bytes(m: DataFrame) -> DataFrame:
    """Binary form of the same, a row per i: 4-byte floats in order of j."""
    @F.pandas_udf("binary")
    def packed(rows: pd.Series) -> pd.Series:
        return rows.map(lambda v: struct.pack(f"<{len(v)}f", *v))

    t = m.where("j <= i").groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "value"))).alias("r"))
    return t.select("i", packed(F.col("r")["value"]).alias("data"))


def matrix_ids(m: DataFrame) -> DataFrame:
    """Lines of the id file that goes with a matrix: the row number, from 1, twice."""
    return m.select("i").distinct().orderBy("i").select(F.format_string("%d\t%d", F.col("i") + 1, F.col("i") + 1).alias("value"))


def write_matrix(m: DataFrame, n_sites: int, prefix: str, binary: bool = False) -> None:
    """A relationship matrix as ``prefix.grm.id`` with ``prefix.grm.gz``, or with
    ``prefix.grm.bin`` and ``prefix.grm.N.bin`` (rows i of 4-byte floats in Parquet, each a file's
    next bytes, since Spark writes folders; ``join_matrix`` puts them together)."""
    write_lines(matrix_ids(m), f"{prefix}.grm.id", compressed=False)
    if not binary:
        write_lines(lower_triangle(m, n_sites), f"{prefix}.grm.gz")
        return
    triangle_bytes(m).write.mode("overwrite").parquet(f"{prefix}.grm.bin")
    triangle_bytes(m.withColumn("value", F.lit(float(n_sites)))).write.mode("overwrite").parquet(f"{prefix}.grm.N.bin")


def join_matrix(spark: SparkSession, path: str, out: BinaryIO) -> None:
    """Write a binary matrix's rows, one after another, to an open file of the driver."""
    for row in spark.read.parquet(path).orderBy("i").toLocalIterator():
        out.write(bytes(row["data"]))


def node_lines(g: Genealogy) -> DataFrame:
    """A line per node in order of id, as a text dump."""
    n = g.nodes.orderBy("node_id")
    return n.select(F.format_string("node %d height %s on [%s, %s)%s", "node_id", F.col("height").cast("string"), F.col("start").cast("string"), F.col("stop").cast("string"), F.when(F.col("is_sample"), " sample").otherwise("")).alias("value"))


def edge_lines(g: Genealogy) -> DataFrame:
    """A line per edge in order of child and place."""
    e = g.edges.orderBy("child", "lft")
    return e.select(F.format_string("edge %d to %d on [%s, %s)", "child", "parent", F.col("lft").cast("string"), F.col("rgt").cast("string")).alias("value"))


def mutation_association_table(rows: DataFrame, chromosome: int, prefix: str = "") -> DataFrame:
    """The same columns from tested branches, with the drawn rate, heights and volume."""
    more = ("mu_star", "height_child", "height_parent", "volume")
    t = association_table(rows.withColumnRenamed("child", "node"), chromosome, prefix, more)
    return t.withColumnsRenamed({"mu_star": "MU_STAR", "height_child": "HEIGHT_CHILD", "height_parent": "HEIGHT_PARENT", "volume": "BRANCH_VOL"})


def association_table(rows: DataFrame, chromosome: int, prefix: str = "", more: tuple[str, ...] = ()) -> DataFrame:
    """Columns of an association file from tested clades, and those named in ``more``."""
    place = lambda c: F.col(c).cast("int")  # noqa: E731  truncates towards zero
    return rows.select(
        F.concat(F.lit(prefix), F.col("node").cast("string"), F.lit("_"), place("lft").cast("string")).alias("SNP"), F.lit(chromosome).alias("CHR"),
        ((F.col("lft") + F.col("rgt")) / 2).cast("int").alias("BP"), place("lft").alias("START_BP"), place("rgt").alias("END_BP"),
        F.col("mac").alias("MAC"), F.col("maf").alias("MAF"), F.col("chi2").alias("CHISQ"), chi2_pvalue_text("chi2").alias("P"), F.when(F.col("beta_positive"), 1).otherwise(-1).alias("SIGN"), *more,
    )

