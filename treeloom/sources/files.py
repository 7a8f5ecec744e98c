"""Readers and writers of genealogies and of the files that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EDGE_SCHEMA, MUTATION_SCHEMA, NODE_SCHEMA, Genealogy

VERSION = 2
_NODE_TEXT = "id long, is_sample int, time double, population string, individual string, metadata string"
_EDGE_TEXT = "lft double, rgt double, parent long, child long"
_HEADER = "arg_file_version int, start double, end double, offset int, chromosome int, num_nodes long, num_edges long, num_mutations long"


def from_tables(nodes: DataFrame, edges: DataFrame, mutations: DataFrame | None = None) -> Genealogy:
    """Tree-sequence style tables: nodes (id, is_sample, time), edges (lft, rgt, parent,
    child) and optionally mutations (position, node[, time]). The span is that of the
    edges; every node is given all of it."""
    span = edges.agg(F.min("lft").alias("a"), F.max("rgt").alias("b")).first()
    start, end = float(span["a"]), float(span["b"])
    n = nodes.select(F.col("id").cast("long").alias("node_id"), F.col("time").cast("double").alias("height"), F.lit(start).alias("start"), F.lit(end).alias("stop"), (F.col("is_sample").cast("int") == 1).alias("is_sample"), F.lit(None).cast("string").alias("name"))
    e = edges.select([F.col(f.name).cast(f.dataType) for f in EDGE_SCHEMA])
    spark = nodes.sparkSession
    g = Genealogy(n, e, spark.createDataFrame([], MUTATION_SCHEMA), start, end)
    if mutations is None:
        return g
    at = e.select(F.col("child").alias("_c"), F.col("parent").alias("_p"), "lft", "rgt")
    height = F.col("time").cast("double") if "time" in mutations.columns else F.lit(None).cast("double")
    m = mutations.withColumn("_h", height).join(at, (F.col("node") == F.col("_c")) & (F.col("lft") <= F.col("position")) & (F.col("position") < F.col("rgt")))
    return g.with_(mutations=m.select(F.xxhash64("position", "node").alias("mut_id"), F.col("position").cast("double").alias("position"), F.col("_h").alias("height"), F.lit(None).cast("long").alias("site_id"), F.col("_c").alias("child"), F.col("_p").alias("parent")))


def read_text_tables(spark: SparkSession, node_file: str, edge_file: str) -> Genealogy:
    """Tab-separated node and edge files with a header line."""
    nodes = spark.read.csv(node_file, sep="\t", header=True, schema=_NODE_TEXT)
    edges = spark.read.csv(edge_file, sep="\t", header=True, schema=_EDGE_TEXT, enforceSchema=True)
    return from_tables(nodes, edges)


def write_parquet(g: Genealogy, path: str, compression: str = "zstd", with_mutations: bool = True) -> None:
    """The native format: a folder with nodes, edges, mutations and a header."""
    g.nodes.write.mode("overwrite").option("compression", compression).parquet(f"{path}/nodes")
    g.edges.write.mode("overwrite").option("compression", compression).parquet(f"{path}/edges")
    m = g.mutations if with_mutations else g.mutations.limit(0)
    m.write.mode("overwrite").option("compression", compression).parquet(f"{path}/mutations")
    back = lambda part, schema: g.spark.read.schema(schema).parquet(f"{path}/{part}").count()
    row = (VERSION, g.start, g.end, g.offset, g.chromosome, back("nodes", NODE_SCHEMA), back("edges", EDGE_SCHEMA), back("mutations", MUTATION_SCHEMA))
    g.spark.createDataFrame([row], _HEADER).coalesce(1).write.mode("overwrite").parquet(f"{path}/header")


def validate(spark: SparkSession, path: str) -> list[str]:
    """What is wrong with a stored genealogy; every condition counts."""
    from pyspark.errors import AnalysisException

    wrong = []
    try:
        header = spark.read.parquet(f"{path}/header").collect()
    except AnalysisException:
        return ["no header"]
    if len(header) != 1 or header[0]["arg_file_version"] not in (1, VERSION):
        wrong.append("unknown version")
    for part, schema, count in (("nodes", NODE_SCHEMA, "num_nodes"), ("edges", EDGE_SCHEMA, "num_edges"), ("mutations", MUTATION_SCHEMA, "num_mutations")):
        try:
            found = spark.read.parquet(f"{path}/{part}")
        except AnalysisException:
            wrong.append(f"no {part}")
            continue
        if {(f.name, f.dataType) for f in found.schema} != {(f.name, f.dataType) for f in schema}:
            wrong.append(f"schema of {part}")
        elif header and found.count() != header[0][count]:
            wrong.append(f"number of {part}")
    return wrong


def read_parquet(spark: SparkSession, path: str) -> Genealogy:
    wrong = validate(spark, path)
    if wrong:
        raise ValueError(f"{path}: {', '.join(wrong)}")
    h = spark.read.parquet(f"{path}/header").first()
    read = lambda part, schema: spark.read.schema(schema).parquet(f"{path}/{part}")
    return Genealogy(read("nodes", NODE_SCHEMA), read("edges", EDGE_SCHEMA), read("mutations", MUTATION_SCHEMA), h["start"], h["end"], h["offset"], h["chromosome"])


def header_only(spark: SparkSession, start: float, end: float, offset: int = 0, chromosome: int = 1) -> Genealogy:
    """A genealogy with a span and no rows, to which chunks are appended."""
    if not start < end:
        raise ValueError("a span ends after it starts")
    return Genealogy(spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA), spark.createDataFrame([], MUTATION_SCHEMA), float(start), float(end), int(offset), int(chromosome))


def from_arrays(spark: SparkSession, start: float, end: float, heights: list[float], is_sample: list[bool], edge_ids: list[tuple[int, int]], edge_ranges: list[tuple[float, float]], reserved: int = -1) -> Genealogy:
    """A genealogy from arrays: samples come first; with ``reserved`` places for samples
    the ids of the other nodes move up behind them."""
    n = sum(is_sample)
    if list(is_sample) != [True] * n + [False] * (len(is_sample) - n):
        raise ValueError("samples come before other nodes")
    if len(heights) != len(is_sample) or len(edge_ids) != len(edge_ranges):
        raise ValueError("arrays of one table have one length")
    if reserved >= 0 and reserved < n:
        raise ValueError("fewer places are reserved than there are samples")
    shift = max(reserved, n) - n
    place = lambda k: int(k) + (shift if k >= n else 0)
    nodes = [(place(k), float(h), float(start), float(end), bool(s), None) for k, (h, s) in enumerate(zip(heights, is_sample, strict=True))]
    edges = [(float(a), float(b), place(p), place(c)) for (c, p), (a, b) in zip(edge_ids, edge_ranges, strict=True)]
    g = header_only(spark, start, end)
    return g.with_(nodes=spark.createDataFrame(nodes, NODE_SCHEMA), edges=spark.createDataFrame(edges, EDGE_SCHEMA))


def append_nodes(g: Genealogy, nodes: DataFrame) -> Genealogy:
    """A further chunk of nodes, whose ids go on where those before end."""
    have, more = g.nodes.count(), nodes.agg(F.count("*").alias("n"), F.count_distinct("node_id").alias("d"), F.min("node_id").alias("a"), F.max("node_id").alias("b")).first()
    if more["n"] and (more["a"] != have or more["b"] != have + more["n"] - 1 or more["d"] != more["n"]):
        raise ValueError("ids of a chunk of nodes go on where those before end")
    return g.with_(nodes=g.nodes.unionByName(nodes))


def append_edges(g: Genealogy, edges: DataFrame) -> Genealogy:
    """A further chunk of edges between nodes that are there."""
    known = g.nodes.select(F.col("node_id").alias("_n"))
    for end in ("child", "parent"):
        if not edges.join(known, F.col(end) == F.col("_n"), "left_anti").isEmpty():
            raise ValueError(f"an edge's {end} is no node")
    return g.with_(edges=g.edges.unionByName(edges))


def append(g: Genealogy, nodes: DataFrame | None = None, edges: DataFrame | None = None, mutations: DataFrame | None = None) -> Genealogy:
    """Further chunks of a genealogy, unchecked; what is missing stays."""
    return g.with_(
        nodes=g.nodes if nodes is None else g.nodes.unionByName(nodes),
        edges=g.edges if edges is None else g.edges.unionByName(edges),
        mutations=g.mutations if mutations is None else g.mutations.unionByName(mutations),
    )


def read_hdf5(spark: SparkSession, path: str) -> Genealogy:
    """The chunked HDF5 layout (versions 1 and 2), where h5py is installed."""
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("reading HDF5 needs h5py, which is not installed") from e
    with h5py.File(path, "r") as f:
        a = f.attrs
        version = int(a["arg_file_version"])
        if version not in (1, 2):
            raise ValueError("unknown version")
        start, end = (0.0, float(a["sequence_length"])) if version == 1 else (float(a["start"]), float(a["end"]))
        times, flags, ids, ranges = f["times"][:], f["flags"][:], f["edge_ids"][:], f["edge_ranges"][:]
        bounds = f["node_bounds"][:] if "node_bounds" in f else None
        nodes = [(k, float(t), *(map(float, bounds[k]) if bounds is not None else (start, end)), bool(s), None) for k, (t, s) in enumerate(zip(times, flags, strict=True))]
        edges = [(float(r[0]), float(r[1]), int(i[1]), int(i[0])) for i, r in zip(ids, ranges, strict=True)]
        m = f.get("mutations")
        muts = [] if m is None else list(zip(m["positions"][:], m["heights"][:], m["site_ids"][:], m["edge_ids"][:], strict=True))
        g = Genealogy(spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame(edges, EDGE_SCHEMA), spark.createDataFrame([], MUTATION_SCHEMA), start, end, int(a.get("offset", 0)), int(a.get("chromosome", 1)))
    if not muts:
        return g
    from ..operators.editing import add_mutations

    rows = [(k, float(p), None if h < 0 else float(h), None if s < 0 else int(s), int(e[0])) for k, (p, h, s, e) in enumerate(muts)]
    return add_mutations(g, spark.createDataFrame(rows, "mut_id long, position double, height double, site_id long, child long"))


def read_phenotypes(spark: SparkSession, path: str) -> DataFrame:
    """``fid, iid, y`` of a file of three columns with a header line; rows without a value go."""
    w = F.split(F.trim("value"), r"\s+")
    t = spark.read.text(path).where(F.size(w) >= 3)
    t = t.select(w[0].alias("fid"), w[1].alias("iid"), F.expr("try_cast(split(trim(value), '\\\\s+')[2] as double)").alias("y"))
    return t.where("y is not null")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """``row, sample`` of a sample file: two header lines, ids in the first column."""
    t = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("row", "line"))
    t = t.where((F.col("row") >= 2) & (F.trim("line") != ""))
    return t.select((F.col("row") - 2).alias("row"), F.split(F.trim("line"), r"\s+")[0].try_cast("long").alias("sample"))


def match_phenotypes(samples: DataFrame, phenotypes: DataFrame) -> DataFrame:
    """``individual, y``: a row per sample; null where there is no phenotype."""
    return samples.join(phenotypes.select(F.col("iid").cast("long").alias("_i"), "y"), F.col("sample") == F.col("_i"), "left").select(F.col("row").cast("long").alias("individual"), "y")
