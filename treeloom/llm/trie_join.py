"""N-gram Jaccard join by prefix trees.

A document's set is its distinct ``WIDTH``-word shingles, as 64-bit hashes. Two documents
link when ``100 * intersection >= PERCENT * union``. The join is exact up to those hashes.

Which sets can link at all. With any global order, the first ``n - ceil(0.85 n) + k``
elements of two linked sets share ``k`` or more. Every set shows its first elements in
hash order (``examined``: about 22 % of it, with ``k`` about n / 16); a set of which fewer than
``k`` of them occur in another set has no partner. Only whether an element
is in one class or several is needed, so the shuffle carries a minimum and a maximum.
The few sets left are read whole, their elements counted, and ordered globally, rare
ones first; elements of one set only can match nothing and are kept as a number.
A set whose first ``n - ceil(0.85 n) + 1`` elements are all its own drops out; the others
may meet in blocks, one for each shared element of those prefixes.

Trie join. In a task the sets of a block form a path-compressed trie over the globally
ordered elements, common ones first, so that sets share the runs they have in common. A probe
walks the trie once: the overlap with a run is counted once for all sets below it, and a
subtree goes as soon as the overlap reached plus the elements that remain on either side
cannot reach the least overlap that its sets need. Subtrees whose sets are all in the
probe's component already are passed over, so groups of near copies cost no pair for
each two of them. Sets found to overlap enough are linked then and there: the trie holds whole sets.

Two rounds. First each set goes to one block, that of the most common element of its
prefix; larger blocks are cut in chunks, each with the block's first set. Then only
blocks that still hold several components are joined: every set outside the largest
component meets all others, in tiles of bounded size. Blocks of equal members count
once. Where very many different texts share the elements of their prefixes without being
linked, the number of tiles grows with the product of both sides.

Exact copies collapse before all this to one class by a 128-bit print of the set.

Defined results: a text without words has an empty set and links with nothing; rows that
repeat a doc_id are one document, linked if any of its texts is; null ids form one last
document, whose component is null unless another document is in it. An empty table gives
no rows; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, broadcast_if_small, materialize, public_id
from .shingles import shingle_sets
from .superminhash import components, set_print

WIDTH = 4
PERCENT = 85
#: Sets indexed in one tile, and sets that probe it.
CHUNK = 500
#: One element in so many is examined beyond the prefix.
SLACK = 16
#: Parts of a class of copies when the classes are too many to broadcast.
SPLITS = 16

_MIXED = object()


def least(n):
    """The smallest overlap that a set of n elements can have with a partner."""
    return (n * PERCENT + 99) // 100


def examined(n: int) -> int:
    return min(n, n - least(n) + 1 + n // SLACK)


class Trie:
    """Sets (lists in one global order) with their full sizes; finds the sets that overlap a
    probe enough and are not yet in its component."""

    def __init__(self) -> None:
        self.root = self._node([], 0)
        self.sizes: list[int] = []
        self.comps: list[int] = []
        self.names: list[int] = []
        self.parent: dict[int, int] = {}

    @staticmethod
    def _node(run: list[int], depth: int) -> dict:
        # depth: elements above the run; least size and most elements of the sets below; their component
        return {"run": run, "depth": depth, "kids": {}, "ends": [], "n": 1 << 62, "s": 0, "comp": None}

    def find(self, c: int) -> int:
        while (up := self.parent.get(c, c)) != c:
            self.parent[c] = c = self.parent.get(up, up)
        return c

    def insert(self, name: int, comp: int, n: int, tokens: list[int]) -> None:
        me, size, node, at = len(self.names), len(tokens), self.root, 0
        self.names.append(name)
        self.comps.append(comp)
        self.sizes.append(n)
        while True:
            node["n"], node["s"] = min(node["n"], n), max(node["s"], size)
            if node["comp"] is None:
                node["comp"] = comp
            elif node["comp"] is not _MIXED and self.find(node["comp"]) != self.find(comp):
                node["comp"] = _MIXED
            if at == size:
                node["ends"].append(me)
                return
            kid = node["kids"].get(tokens[at])
            if kid is None:
                kid = node["kids"][tokens[at]] = self._node(tokens[at:], at)
                kid.update(n=n, s=size, comp=comp)
                kid["ends"].append(me)
                return
            run, k = kid["run"], 1
            stop = min(len(run), size - at)
            while k < stop and run[k] == tokens[at + k]:
                k += 1
            if k < len(run):  # the run parts here
                upper = self._node(run[:k], at)
                upper.update(n=kid["n"], s=kid["s"], comp=kid["comp"])
                upper["kids"][run[k]] = kid
                kid["run"], kid["depth"] = run[k:], at + k
                node["kids"][tokens[at]] = kid = upper
            node, at = kid, at + k

    def probe(self, name: int, comp: int, n: int, tokens: list[int]) -> Iterator[int]:
        """Names of sets that the probe links with; their components become the probe's."""
        place = {t: i for i, t in enumerate(tokens)}
        size, mine = len(tokens), self.find(comp)
        stack = [(self.root, 0, 0)]
        while stack:
            node, both, used = stack.pop()
            if node["comp"] is None or (node["comp"] is not _MIXED and self.find(node["comp"]) == mine):
                continue
            # 100 * o >= P * (n + m - o)
            need, most, depth = -(-PERCENT * (n + node["n"]) // (100 + PERCENT)), node["s"], node["depth"]
            lost = False
            for t in node["run"]:
                i = place.get(t)
                depth += 1
                if i is None:
                    if both + most - depth < need:
                        lost = True
                        break
                else:
                    both, used = both + 1, i + 1
            if lost or both + min(size - used, most - depth) < need:
                continue
            for e in node["ends"]:
                if (100 + PERCENT) * both >= PERCENT * (n + self.sizes[e]) and self.find(self.comps[e]) != mine:
                    yield self.names[e]
                    self.parent[self.find(self.comps[e])] = mine
            stack.extend((kid, both, used) for kid in node["kids"].values())


_EXAMINED = pa.schema([("_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("tokens", pa.list_(pa.int64()))])


def _examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            n, f1, f2, tokens = [], [], [], []
            for s in shingle_sets(part.column("_text").to_pylist(), WIDTH):
                a, b = set_print(s)
                n.append(len(s))
                f1.append(a)
                f2.append(b)
                tokens.append(s[: examined(len(s))].view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], schema=_EXAMINED)


_SETS = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("tokens", pa.list_(pa.int64()))])


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of the rows whose print is the class's."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            rep, n, f1, tokens = [], [], [], []
            for i, want, s in zip(part.column("_id").to_pylist(), part.column("f1").to_pylist(), shingle_sets(part.column("_text").to_pylist(), WIDTH), strict=True):
                if len(s) and int(set_print(s)[0]) == want:
                    rep.append(i)
                    n.append(len(s))
                    f1.append(want)
                    tokens.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], schema=_SETS)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Roles of a set in a tile, in the order they are served.
INDEX, BOTH, PROBE = 0, 1, 2


def _join_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each tile; rows come sorted by block, tile and role."""
    now, trie, a, b = None, Trie(), [], []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("block", "tile", "role", "rep", "comp", "n")]
        lists = batch.column("toks")
        for k, (block, tile, role, rep, comp, n) in enumerate(zip(*columns, strict=True)):
            if now != (block, tile):
                now, trie = (block, tile), Trie()
            tokens = lists[k].as_py()
            if role != INDEX:
                for other in trie.probe(rep, comp, n, tokens):
                    a.append(min(rep, other))
                    b.append(max(rep, other))
            if role != PROBE:
                trie.insert(rep, comp, n, tokens)
        if len(a) >= 10000:
            yield pa.RecordBatch.from_pydict({"a": a, "b": b}, schema=_LINKS)
            a, b = [], []
    yield pa.RecordBatch.from_pydict({"a": a, "b": b}, schema=_LINKS)


def tile_links(rows: DataFrame) -> DataFrame:
    """Links ``a, b`` among rows ``block, tile, role, rep, comp, n, toks``."""
    dealt = rows.select("block", "tile", "role", "rep", "comp", "n", "toks").repartition("block", "tile").sortWithinPartitions("block", "tile", "role")
    return dealt.mapInArrow(_join_tiles, "a long, b long").where("a != b").distinct()


def _chunk(parts: Column) -> Column:
    return F.pmod(F.xxhash64("rep", "f1"), parts)


def _upto(last: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), last - 1))


def first_round(ranked: DataFrame, n_sets: int) -> DataFrame:
    """Links within one block for each set."""
    blocks = ranked.groupBy("pick").agg(F.count("*").alias("_size"), F.min(F.struct("rep", "f1")).alias("_lead"))
    large = blocks.where(F.col("_size") > CHUNK).select(F.col("pick").alias("_pick"), F.ceil(F.col("_size") / CHUNK).alias("_parts"), "_lead")
    d = ranked.join(broadcast_if_small(large, n_sets // CHUNK, 40), F.col("pick") == F.col("_pick"), "left")
    leads = F.coalesce(F.struct("rep", "f1") == F.col("_lead"), F.lit(False))
    one = F.when(F.col("_parts").isNull(), F.lit(0).cast("long")).otherwise(_chunk(F.col("_parts")))
    tiles = F.when(leads, F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).otherwise(F.array(one))
    return tile_links(d.select(F.col("pick").alias("block"), F.explode(tiles).alias("tile"), F.lit(BOTH).alias("role"), "rep", F.col("rep").alias("comp"), "n", "toks"))


def second_round(ranked: DataFrame, groups: DataFrame) -> DataFrame:
    """Links between components, of all blocks that hold several."""
    d = ranked.join(groups, F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "rep")).drop("node", "component")
    d = materialize(d, "ranked")
    slim = materialize(d.select("rep", "f1", "comp", F.explode("prefix").alias("t")), "prefixes")  # read twice
    sizes = slim.groupBy("t", "comp").agg(F.count("*").alias("size"), F.sum(F.xxhash64("rep", "f1").cast("decimal(38,0)")).alias("sig"))
    torn = sizes.groupBy("t").agg(F.max(F.struct("size", "comp")).alias("main"), F.sum("size").alias("m"), F.sum("sig").alias("sig"), F.count("*").alias("parts")).where("parts > 1")
    torn = torn.groupBy("m", "sig").agg(F.min(F.struct("t", "main")).alias("x"))  # equal members, one block
    torn = torn.select(F.col("x.t").alias("block"), F.col("x.main.comp").alias("main"), F.ceil(F.col("m") / CHUNK).alias("parts"), F.ceil((F.col("m") - F.col("x.main.size")) / CHUNK).alias("out_parts"))
    torn = materialize(torn, "torn")
    met = slim.join(torn, F.col("t") == F.col("block")).select("block", "main", "parts", "out_parts", F.col("rep").alias("_r"), F.col("f1").alias("_f"))
    met = d.select("rep", "f1", "comp", "n", "toks").join(met, (F.col("rep") == F.col("_r")) & (F.col("f1") == F.col("_f")))
    outside = F.col("comp") != F.col("main")
    own = ["rep", "comp", "n", "toks"]
    small = met.where("parts = 1").select("block", F.lit(0).cast("long").alias("tile"), F.when(outside, BOTH).otherwise(INDEX).alias("role"), *own)
    wide = met.where("parts > 1")
    number = lambda o, k: o * F.col("parts") + k
    index = wide.withColumn("_o", _upto(F.col("out_parts"))).select("block", number(F.col("_o"), _chunk(F.col("parts"))).alias("tile"), F.lit(INDEX).alias("role"), *own)
    probe = wide.where(outside).withColumn("_k", _upto(F.col("parts"))).select("block", number(_chunk(F.col("out_parts")), F.col("_k")).alias("tile"), F.lit(PROBE).alias("role"), *own)
    return tile_links(small.union(index).union(probe))


def suspects_of(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes of which enough examined elements are in other classes too."""
    seen = rows.where("n > 0").select("f1", F.explode("tokens").alias("t")).groupBy("t").agg(F.min("f1").alias("lo"), F.max("f1").alias("hi"))
    own = seen.where("lo = hi").groupBy(F.col("lo").alias("_f")).agg(F.count("*").alias("own"))
    size = F.least(F.col("n"), F.col("n") - F.expr(f"(n * {PERCENT} + 99) div 100") + 1 + F.expr(f"n div {SLACK}"))
    shared = size - F.coalesce("own", F.lit(0))
    return classes.join(own, F.col("f1") == F.col("_f"), "left").where(shared >= F.expr(f"((n * {PERCENT} + 99) div 100) div {SLACK} + 1")).select("rep", "n", "f1")


def ranked_sets(docs: DataFrame, suspects: DataFrame) -> DataFrame:
    """``rep, f1, n, toks, prefix, pick``: the whole sets, their shared elements in the global
    order (common ones first), the shared elements of the prefix, and the block of the first
    round."""
    want = broadcast_if_small(suspects.select(F.col("rep").alias("_want"), "f1"), suspects.count(), 24)
    sets = docs.join(want, F.col("_id") == F.col("_want")).select("_id", "f1", "_text").mapInArrow(_whole_sets, "rep long, n long, f1 long, tokens array<long>")
    sets = materialize(sets.dropDuplicates(["rep", "f1"]), "sets")
    tokens = sets.select("rep", "f1", "n", F.explode("tokens").alias("t"))
    shared = tokens.groupBy("t").agg(F.count("*").alias("c")).where("c > 1")
    held = tokens.join(shared, "t").groupBy("rep", "f1", "n").agg(F.sort_array(F.collect_list(F.struct("c", "t"))).alias("s"))
    # the set's own elements come first in the order, so they take the first places of the prefix
    room = F.col("n") - F.expr(f"(n * {PERCENT} + 99) div 100") + 1 - (F.col("n") - F.size("s"))
    held = held.where(room > 0).withColumn("first", F.slice("s", F.lit(1), room.cast("int")))
    top = F.element_at("first", -1)["c"]
    pick = F.filter("first", lambda x: x["c"] == top)[0]["t"]
    held = held.select("rep", "f1", "n", F.reverse(F.col("s.t")).alias("toks"), F.col("first.t").alias("prefix"), pick.alias("pick"))
    return materialize(held, "ranked")


def linked_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_id, n_shingles, component`` of each row."""
    d = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("_id"), F.col(text).alias("_text"))
    rows = materialize(d.mapInArrow(_examine, "_id long, n long, f1 long, f2 long, tokens array<long>"), "examined")
    classes = rows.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("_id").alias("rep"), F.max("_id").alias("top"))
    classes = materialize(classes, "classes")
    suspects = materialize(suspects_of(rows, classes), "suspects")
    ranked = ranked_sets(d, suspects)
    links = materialize(first_round(ranked, ranked.count()), "links")
    # one document under several texts holds its classes together
    several = rows.where("n > 0").groupBy("_id").agg(F.min("f1").alias("lo"), F.max("f1").alias("hi")).where("lo != hi").select("_id")
    several = rows.join(several, "_id").select("_id", "n", "f1", "f2").join(classes, ["n", "f1", "f2"]).where("_id != rep").select(F.least("_id", "rep").alias("a"), F.greatest("_id", "rep").alias("b")).distinct()
    links = materialize(links.union(several), "links")
    groups = components(links)
    more = materialize(second_round(ranked, groups), "links")
    if not more.isEmpty():
        groups = components(links.union(more))
    # every row learns the component of its class
    named = classes.join(groups, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep"))
    named = materialize(named.where("component != top or rep != top").select(F.col("n").alias("_n"), F.col("f1").alias("_f1"), F.col("f2").alias("_f2"), "component"), "named")
    same = (F.col("n") == F.col("_n")) & (F.col("f1") == F.col("_f1")) & (F.col("f2") == F.col("_f2"))
    n_named = named.count()
    if n_named * 48 <= 32 << 20:
        out = rows.join(F.broadcast(named), same, "left")
    else:  # a class may hold a third of all rows
        dealt = named.withColumn("_part", _upto(F.lit(SPLITS)))
        out = rows.join(dealt, same & (F.pmod(F.xxhash64("_id"), F.lit(SPLITS)) == F.col("_part")), "left")
    return out.select("_id", F.col("n").alias("n_shingles"), F.coalesce("component", "_id").alias("component"))


def jaccard_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row."""
    d = linked_groups(docs, doc_id, text)
    return d.select(public_id().alias("doc_id"), "n_shingles", public_id("component").alias("component_id"))
