"""Changing a genealogy: edits, trimming, and threading new samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import EDGE_SCHEMA, NODE_SCHEMA, Genealogy
from ..storage import materialize
from .closure import branches, clade_leasts
from .intervals import clip, islands, overlap, stab_join, subtract
from .ordering import followed, numbered


def add_edges(g: Genealogy, edges: DataFrame) -> Genealogy:
    return g.with_(edges=g.edges.unionByName(edges))


def remove_edges(g: Genealogy, keys: DataFrame) -> Genealogy:
    """``keys``: child and lft of the edges to drop; their mutations go too."""
    edges = g.edges.join(keys, ["child", "lft"], "left_anti").select(g.edges.columns)
    return keep_covered_mutations(g.with_(edges=edges))


def move_edge_ends(g: Genealogy, changes: DataFrame) -> Genealogy:
    """``child, lft, new_lft, new_rgt``: narrower edges; mutations outside are dropped."""
    e = g.edges.join(changes, ["child", "lft"], "left")
    e = e.select(F.coalesce("new_lft", "lft").alias("lft"), F.coalesce("new_rgt", "rgt").alias("rgt"), "parent", "child")
    return keep_covered_mutations(g.with_(edges=e))


def keep_covered_mutations(g: Genealogy) -> Genealogy:
    e = g.edges.select(F.col("child").alias("_c"), F.col("parent").alias("_p"), "lft", "rgt")
    at = (F.col("child") == F.col("_c")) & (F.col("parent") == F.col("_p")) & (F.col("lft") <= F.col("position")) & (F.col("position") < F.col("rgt"))
    return g.with_(mutations=g.mutations.join(e, at, "left_semi"))


def add_mutations(g: Genealogy, mutations: DataFrame) -> Genealogy:
    """``mut_id, position, child`` and optionally height and site_id; the parent is the
    edge's, found as of the position. A mutation without an edge, or with a height that is
    not on it, is an error."""
    for name, kind in (("height", "double"), ("site_id", "long")):
        if name not in mutations.columns:
            mutations = mutations.withColumn(name, F.lit(None).cast(kind))
    e = g.edges.select(F.col("child").alias("_c"), "parent", "lft", "rgt")
    m = mutations.drop("parent").join(e, (F.col("child") == F.col("_c")) & (F.col("lft") <= F.col("position")) & (F.col("position") < F.col("rgt")), "left")
    h = g.nodes.select(F.col("node_id").alias("_hn"), F.col("height").alias("_hh"))
    m = m.join(h, F.col("child") == F.col("_hn"), "left").withColumnRenamed("_hh", "_low").drop("_hn")
    m = m.join(h, F.col("parent") == F.col("_hn"), "left")
    off = (F.col("height") < F.col("_low")) | (F.col("height") > F.col("_hh"))
    wrong = F.when(F.col("parent").isNull(), "no edge at a mutation's position").when(off, "a mutation's height is not on its edge")
    parent = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("long")).otherwise(F.col("parent"))
    return g.with_(mutations=g.mutations.unionByName(m.select("mut_id", "position", "height", "site_id", "child", parent.alias("parent"))))


def mutations_with_edges(g: Genealogy) -> DataFrame:
    """``mut_id, position, child, parent, lft, rgt``: each mutation with its edge."""
    e = g.edges.select(F.col("child").alias("_c"), F.col("parent").alias("_p"), "lft", "rgt")
    at = (F.col("child") == F.col("_c")) & (F.col("parent") == F.col("_p")) & (F.col("lft") <= F.col("position")) & (F.col("position") < F.col("rgt"))
    return g.mutations.join(e, at).select("mut_id", "position", "child", "parent", "lft", "rgt")


def clear_mutations(g: Genealogy) -> Genealogy:
    return g.with_(mutations=g.mutations.limit(0))


def edge_mutations(g: Genealogy, child: int | None = None, start: float = float("-inf"), end: float = float("inf")) -> DataFrame:
    m = g.mutations.where((F.col("position") >= start) & (F.col("position") < end))
    return m if child is None else m.where(F.col("child") == child)


def remove_mutations_at_site(g: Genealogy, position: float) -> Genealogy:
    return g.with_(mutations=g.mutations.where(F.col("position") != position))


def trim(g: Genealogy, start: float, end: float) -> Genealogy:
    """The part on [start, end), shifted to begin at 0: edges are cut, nodes without an
    edge go, ids become dense in their old order, the offset moves, sites are renumbered."""
    if not g.start <= start < end <= g.end:
        raise ValueError("the range to keep must lie in the span")
    e = clip(g.edges, start, end)
    used = e.select(F.col("child").alias("_u")).union(e.select(F.col("parent").alias("_u"))).distinct()
    kept = g.nodes.join(used, F.col("node_id") == F.col("_u"), "left_semi")
    ids = numbered(kept.select(F.col("node_id").alias("_old")), ["_old"], "_new")
    nodes = clip(kept, start, end, "start", "stop").join(ids, F.col("node_id") == F.col("_old"))
    nodes = nodes.select(F.col("_new").alias("node_id"), "height", (F.col("start") - start).alias("start"), (F.col("stop") - start).alias("stop"), "is_sample", "name")
    up = ids.select(F.col("_old").alias("_po"), F.col("_new").alias("_pn"))
    edges = e.join(ids, F.col("child") == F.col("_old")).join(up, F.col("parent") == F.col("_po"))
    edges = edges.select((F.col("lft") - start).alias("lft"), (F.col("rgt") - start).alias("rgt"), F.col("_pn").alias("parent"), F.col("_new").alias("child"))
    m = g.mutations.where((F.col("position") >= start) & (F.col("position") < end))
    m = m.join(ids, F.col("child") == F.col("_old")).join(up, F.col("parent") == F.col("_po"))
    m = numbered(m, ["position", "mut_id"], "_k")
    m = m.select("mut_id", (F.col("position") - start).alias("position"), "height", F.col("_k").alias("site_id"), F.col("_new").alias("child"), F.col("_pn").alias("parent"))
    return Genealogy(nodes, edges, m, 0.0, float(end - start), g.offset + int(start), g.chromosome)


def add_sample(g: Genealogy, node_id: int, name: str | None = None, height: float = 0.0) -> Genealogy:
    """A new leaf that spans all; an ancient one if its height is above 0."""
    if height < 0:
        raise ValueError("a height is 0 or more")
    row = g.spark.createDataFrame([(int(node_id), float(height), g.start, g.end, True, name)], NODE_SCHEMA)
    return g.with_(nodes=g.nodes.unionByName(row))


def thread_sample(g: Genealogy, sample: int, starts: list[float], targets: list[int], heights: list[float], first_node: int) -> Genealogy:
    """Attach ``sample``: on each section a new node of the given height is spliced into
    the branch above the target leaf. Sections are consecutive, from ``starts`` to the next
    start or the end; the new nodes are numbered from ``first_node``.

    The edge above the target that spans the height is found by walking up section by
    section: a frontier of (section, node, interval) climbs while the parent is lower."""
    if not (len(starts) == len(targets) == len(heights)) or not starts or list(starts) != sorted(set(starts)) or starts[0] != g.start:
        raise ValueError("sections need increasing starts from the beginning, a target and a height each")
    if min(heights) <= 0:
        raise ValueError("heights are above 0")
    spark = g.spark
    bounds = [*starts[1:], g.end]
    sections = spark.createDataFrame([(first_node + k, int(t), float(h), float(a), float(b)) for k, (a, t, h, b) in enumerate(zip(starts, targets, heights, bounds, strict=True))], "new long, node long, h double, lft double, rgt double")
    hs = g.nodes.select(F.col("node_id").alias("_hn"), F.col("height").alias("_hh"))
    e = g.edges.join(hs, F.col("parent") == F.col("_hn")).select(F.col("child").alias("_c"), F.col("parent").alias("_p"), F.col("_hh").alias("_ph"), F.col("lft").alias("_l"), F.col("rgt").alias("_r"))
    front, spliced, rootward = sections, None, None
    while True:
        met = materialize(front.join(e, (F.col("node") == F.col("_c")) & (F.col("lft") < F.col("_r")) & (F.col("_l") < F.col("rgt"))).withColumns({"a": F.greatest("lft", "_l"), "b": F.least("rgt", "_r")}))
        if met.where("_ph = h").limit(1).count():
            raise ValueError("a section's height equals that of a node on its path")
        gaps = materialize(subtract(front.select("new", "node", "h", "lft", "rgt"), met.select("new", "node", "h", F.col("a").alias("lft"), F.col("b").alias("rgt")), ["new", "node", "h"]))
        rootward = gaps if rootward is None else rootward.unionByName(gaps)
        here = met.where("_ph > h")
        spliced = here if spliced is None else spliced.unionByName(here)
        front = met.where("_ph < h").select("new", F.col("_p").alias("node"), "h", F.col("a").alias("lft"), F.col("b").alias("rgt"))
        if front.isEmpty():
            break
    cuts = spliced.select(F.col("_c").alias("child"), F.col("_p").alias("parent"), F.col("a").alias("lft"), F.col("b").alias("rgt"), "new")
    # what the new nodes take over is cut out of the old edges
    left = subtract(g.edges.select("child", "parent", "lft", "rgt"), cuts.select("child", "parent", "lft", "rgt"), ["child", "parent"])
    below = cuts.select("lft", "rgt", F.col("new").alias("parent"), "child").union(rootward.select("lft", "rgt", F.col("new").alias("parent"), F.col("node").alias("child")))
    above = cuts.select("lft", "rgt", "parent", F.col("new").alias("child"))
    own = sections.select("lft", "rgt", F.col("new").alias("parent"), F.lit(int(sample)).cast("long").alias("child"))
    joined = islands(below.union(above).union(own).select("child", "parent", "lft", "rgt"), ["child", "parent"])
    edges = left.unionByName(joined).select([f.name for f in EDGE_SCHEMA])
    nodes = g.nodes.unionByName(sections.select(F.col("new").alias("node_id"), F.col("h").alias("height"), F.col("lft").alias("start"), F.col("rgt").alias("stop"), F.lit(False).alias("is_sample"), F.lit(None).cast("string").alias("name")))
    e2 = edges.select(F.col("child").alias("_c"), F.col("parent").alias("_np"), "lft", "rgt")
    m = g.mutations.join(e2, (F.col("child") == F.col("_c")) & (F.col("lft") <= F.col("position")) & (F.col("position") < F.col("rgt")), "left")
    m = m.select("mut_id", "position", "height", "site_id", "child", F.coalesce("_np", "parent").alias("parent"))
    return g.with_(nodes=materialize(nodes), edges=materialize(edges), mutations=m)


def threading_of(anc: DataFrame, nodes: DataFrame, sample: int, others: DataFrame) -> DataFrame:
    """``lft, rgt, cousin, height``: nearest relatives of a sample among ``others``, with
    runs of the same relative and height joined. Only the sample's own ancestry meets the
    others', on the node."""
    up = anc.where("level > 0")
    own = up.where(F.col("leaf") == sample).select(F.col("node").alias("_n"), F.col("via").alias("_v"), F.col("lft").alias("_l"), F.col("rgt").alias("_r"))
    rest = up.where(F.col("leaf") != sample).join(others.select("leaf"), "leaf", "left_semi")
    p = rest.join(own, (F.col("node") == F.col("_n")) & (F.col("via") != F.col("_v")) & (F.col("lft") < F.col("_r")) & (F.col("_l") < F.col("rgt")))
    p = p.join(nodes.select(F.col("node_id").alias("_id"), "height"), F.col("node") == F.col("_id"))
    p = materialize(p.select(F.col("leaf").alias("cousin"), F.greatest("lft", "_l").alias("lft"), F.least("rgt", "_r").alias("rgt"), "height"))
    ends = p.agg(F.min("lft").alias("a"), F.max("rgt").alias("b")).first()
    if ends["a"] is None:
        return p.select("lft", "rgt", "cousin", "height")
    cuts = p.select(F.col("lft").alias("x")).union(p.select(F.col("rgt").alias("x"))).distinct()
    seg = followed(cuts, "x", "b").where("b is not null").withColumnRenamed("x", "a")
    best = stab_join(seg, p, "a", ends["b"] - ends["a"]).groupBy("a", "b").agg(F.min(F.struct("height", "cousin")).alias("m"))
    return islands(best.select(F.col("a").alias("lft"), F.col("b").alias("rgt"), "m.cousin", "m.height"), ["cousin", "height"]).select("lft", "rgt", "cousin", "height")


def ended_lineages(g: Genealogy) -> DataFrame:
    """``leaf, cousin, node, height, lft, rgt``: where the lineage of a leaf ends.

    Leaves thread in order of id, each onto those before it. The lineage of a leaf goes up
    through all clades of which it is the least leaf; at the first node with a smaller one
    it joins that leaf's lineage, its nearest earlier relative (the least of them). So the
    least leaves of clades, swept once from the bottom up, hold the threading of all
    leaves: a lineage ends on each branch whose child has another least leaf than its parent."""
    least = materialize(clade_leasts(g), "least")
    b = branches(g, least.select("node", "lft", "rgt", "least"))
    top = least.select(F.col("node").alias("_n"), F.col("lft").alias("_l"), F.col("rgt").alias("_r"), F.col("least").alias("cousin"))
    met = b.join(top, (F.col("parent") == F.col("_n")) & (F.col("lft") == F.col("_l")) & (F.col("rgt") == F.col("_r"))).where("least != cousin")
    return met.select(F.col("least").alias("leaf"), "cousin", F.col("parent").alias("node"), F.col("height_parent").alias("height"), "lft", "rgt")


def threading_of_all(g: Genealogy) -> DataFrame:
    """``leaf, lft, rgt, cousin, height``: the threading of every leaf but the first onto those
    of smaller id, as ``threading_of`` gives it for one; runs of the same relative and height joined."""
    ended = ended_lineages(g).select("leaf", "cousin", "height", "lft", "rgt")
    return islands(ended, ["leaf", "cousin", "height"]).select("leaf", "lft", "rgt", "cousin", "height")


def rebuild_by_threading(g: Genealogy) -> Genealogy:
    """The genealogy again, as threading its leaves one after another in order of id would make
    it: a new node for each section of ``threading_of_all``, numbered after the leaves by
    leaf and place. A node of the genealogy is, where a lineage ends in it, that section's
    node; nodes that end no lineage (with one child) go. No leaf waits for another and
    nothing is read by the driver. Where several lineages end in one node a section would meet
    a node of its own height, which threading forbids."""
    ended = materialize(ended_lineages(g), "ended")
    if ended.groupBy("node", "lft", "rgt").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("a section's height equals that of a node on its path")
    sections = islands(ended.select("leaf", "cousin", "height", "lft", "rgt"), ["leaf", "cousin", "height"])
    last = g.leaves.agg(F.max("leaf").alias("_last"))
    sections = numbered(sections, ["leaf", "lft"], "_k").crossJoin(F.broadcast(last))
    sections = materialize(sections.withColumn("new", F.col("_last") + 1 + F.col("_k")).select("new", "leaf", "cousin", "height", "lft", "rgt"), "sections")
    own = sections.select("new", F.col("leaf").alias("_f"), F.col("lft").alias("_l"), F.col("rgt").alias("_r"))
    named = ended.join(own, (F.col("leaf") == F.col("_f")) & (F.col("_l") <= F.col("lft")) & (F.col("rgt") <= F.col("_r"))).select("node", "lft", "rgt", "new")
    # a node keeps its name over touching pieces of one section
    named = materialize(islands(named, ["node", "new"]), "named")
    first = g.nodes.select("node_id", "is_sample")
    e = g.edges.join(first, F.col("child") == F.col("node_id")).select("child", "parent", "lft", "rgt", "is_sample")
    p = named.select(F.col("node").alias("_n"), F.col("lft").alias("_l"), F.col("rgt").alias("_r"), F.col("new").alias("_new"))

    def renamed(rows: DataFrame, column: str, name: str) -> tuple[DataFrame, DataFrame]:
        """Pieces whose node has a name, and those whose node is passed over."""
        keys = [c for c in rows.columns if c not in ("lft", "rgt")]
        hit = rows.join(p, (F.col(column) == F.col("_n")) & overlap("lft", "rgt", "_l", "_r"))
        hit = materialize(hit.withColumns({"lft": F.greatest("lft", "_l"), "rgt": F.least("rgt", "_r"), name: F.col("_new")}).select(*rows.columns, name), "named")
        return hit, subtract(rows, hit.select(*keys, "lft", "rgt"), keys)

    leaf_edges = e.where("is_sample").select(F.col("child").alias("low"), F.col("parent").alias("at"), "lft", "rgt")
    inner, _ = renamed(e.where("not is_sample").select("child", "parent", "lft", "rgt"), "child", "low")
    front = leaf_edges.union(inner.select("low", F.col("parent").alias("at"), "lft", "rgt"))
    up = e.select(F.col("child").alias("_c"), F.col("parent").alias("_p"), F.col("lft").alias("_el"), F.col("rgt").alias("_er"))
    done, level = None, 0
    while True:
        here, passed = renamed(front, "at", "high")
        done = here if done is None else done.union(here)
        over = passed.join(up, (F.col("at") == F.col("_c")) & overlap("lft", "rgt", "_el", "_er"))
        front = materialize(over.select("low", F.col("_p").alias("at"), F.greatest("lft", "_el").alias("lft"), F.least("rgt", "_er").alias("rgt")), "passed")
        level += 1
        if front.isEmpty():
            break
    edges = islands(done.select(F.col("high").alias("parent"), F.col("low").alias("child"), "lft", "rgt"), ["parent", "child"]).select("lft", "rgt", "parent", "child")
    nodes = g.nodes.where("is_sample").select([f.name for f in NODE_SCHEMA]).unionByName(sections.select(F.col("new").alias("node_id"), "height", F.col("lft").alias("start"), F.col("rgt").alias("stop"), F.lit(False).alias("is_sample"), F.lit(None).cast("string").alias("name")))
    return g.with_(nodes=nodes, edges=materialize(edges, "edges"), mutations=g.mutations.limit(0))
