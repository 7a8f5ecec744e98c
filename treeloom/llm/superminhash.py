"""Near-duplicate grouping: SuperMinHash signatures, banding, exact verification,
union-find.

Signatures. SuperMinHash gives every element a random permutation of the slots and
one fraction per rank; slot ``p(j)`` sees the value ``j + fraction``. The ranks of
an element are correlated, so no slot is served twice before all are served once,
which lowers the variance against independent minima. Values of rank ``j`` are
below ``j + 1``: once every slot holds less, later ranks cannot matter and the
element loop stops. Here ranks are the outer loop, over blocks of ``ELEMENTS`` elements
that share the values reached, so later blocks of a text stop after few ranks.

Candidates. Texts with equal shingle sets collapse first to one class, so thousands
of copies cost one signature. A class meets others in ``BANDS`` buckets of ``ROWS``
slots; a pair at similarity 0.75 misses all of them with probability 2.4e-5. In a
bucket each member is paired with one leader (the member with most company over all
its buckets), never with every other.
Buckets whose members are afterwards in different components are settled by an exact
prefix filter over their texts (``prefix_pairs``), so no link between components is
lost; large groups of mutual copies cost one pair per member and bucket, and passages
that many texts share cost nothing.

Verification. A pair is linked if its full shingle sets satisfy
``100 * intersection >= 75 * union``.

Grouping. Links are contracted to stars by union-find inside each partition, then
by alternating smallest-neighbour steps between partitions; every round is written
to the shared folder.

Defined results: a text without words is linked with nothing; rows that repeat a
doc_id are one document, linked if any of its texts is; null ids form one last
document, whose component is null unless another document is in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, broadcast_if_small, carried, materialize, public_id
from .shingles import WIDTH, mix, shingle_sets

BANDS, ROWS = 28, 4
SLOTS = BANDS * ROWS
PERCENT = 75
#: Elements served at once; pairs of one document that are verified in one part.
ELEMENTS = 4096
PART = 1000

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_PICK = np.uint64(0xA0761D6478BD642F)


def signature(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of distinct 64-bit element hashes; infinite without elements."""
    values = np.full(slots, np.inf)
    for at in range(0, len(elements), ELEMENTS):
        _serve(values, elements[at : at + ELEMENTS])
    return values


def _serve(values: np.ndarray, elements: np.ndarray) -> None:
    """Lower the slots' values by these elements, rank by rank, until no rank can matter."""
    slots, n, swaps = len(values), len(elements), None
    rows = np.arange(n)
    with np.errstate(over="ignore"):
        for j in range(slots):
            if values.max() < j:
                break
            seed = elements + _GOLD * np.uint64(j + 1)
            fraction = (mix(seed) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            served = j + ((mix(seed ^ _PICK) >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
            if j == 0:
                first = served
            else:
                if swaps is None:  # the swap of rank 0, made up for
                    swaps = np.tile(np.arange(slots, dtype=np.int16), (n, 1))
                    swaps[rows, first] = 0
                    swaps[rows, 0] = first
                other, served = served, swaps[rows, served].astype(np.int64)
                swaps[rows, other] = swaps[rows, j]
                swaps[rows, j] = served
            np.minimum.at(values, served, fraction + j)


def band_hashes(values: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    bits = values.view(np.uint64).reshape(bands, rows)
    with np.errstate(over="ignore"):
        h = np.arange(1, bands + 1, dtype=np.uint64) * _PICK
        for k in range(rows):
            h = mix(h * _GOLD + bits[:, k])
    return h


def set_print(elements: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of distinct hashes."""
    with np.errstate(over="ignore"):
        a = int(np.sum(mix(elements ^ _GOLD), dtype=np.uint64))
        b = int(np.sum(mix(elements + _PICK), dtype=np.uint64))
    return np.int64(np.uint64(a)), np.int64(np.uint64(b))


_FEATURES = pa.schema([("_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            n, f1, f2, bands = [], [], [], []
            for s in shingle_sets(part.column("_text").to_pylist()):
                a, b = set_print(s)
                n.append(len(s))
                f1.append(a)
                f2.append(b)
                bands.append(band_hashes(signature(s)).view(np.int64) if len(s) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], schema=_FEATURES)


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_id, n, f1, f2, bands``: set size, set print and band hashes of each row."""
    d = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("_id"), F.col(text).alias("_text"))
    return d.mapInArrow(_features, "_id long, n long, f1 long, f2 long, bands array<long>")


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            left = shingle_sets(part.column("text_a").to_pylist())
            for a, b in zip(left, shingle_sets(part.column("text_b").to_pylist()), strict=True):
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both > 0 and 100 * both >= PERCENT * (len(a) + len(b) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, n_pairs: int, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The pairs ``a, b`` whose texts are linked. Only texts that occur in pairs are
    moved; a class is read from the row that stands for it.

    A document that leads a large group is in many pairs. Each pair is dealt by that of its
    two that has more pairs, in parts of about ``PART`` by the other one's hash, and the
    leader's text is sent once to each part. The other side meets its text before,
    under a key that at most the square root of twice the pairs can share."""
    pairs = pairs.select("a", "b").distinct()
    ends = pairs.select(F.col("a").alias("_want")).union(pairs.select(F.col("b").alias("_want")))
    degree = materialize(ends.groupBy("_want").agg(F.count("*").alias("_deg")), "degrees")
    n_ends = min(degree.count(), 2 * n_pairs)
    d = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("_id"), F.col(text).alias("_text"))
    texts = d.join(broadcast_if_small(degree, n_ends, 24), F.col("_id") == F.col("_want")).where(F.length("_text") > 0).dropDuplicates(["_id", "_text"])
    many = degree.where(F.col("_deg") > PART)
    many = broadcast_if_small(many, 2 * n_pairs // PART, 24)
    led = pairs.join(many.select(F.col("_want").alias("_wa"), F.col("_deg").alias("_da")), F.col("a") == F.col("_wa"), "left")
    led = led.join(many.select(F.col("_want").alias("_wb"), F.col("_deg").alias("_db")), F.col("b") == F.col("_wb"), "left")
    more_b = F.coalesce("_db", F.lit(0)) > F.coalesce("_da", F.lit(0))
    led = led.select("a", "b", F.when(more_b, F.col("b")).otherwise(F.col("a")).alias("lead"), F.when(more_b, F.col("a")).otherwise(F.col("b")).alias("other"), F.greatest("_da", "_db").alias("_deg"))
    n_parts = lambda deg: F.coalesce(F.ceil(deg / PART), F.lit(1).cast("long"))
    led = led.select("a", "b", "lead", "other", F.pmod(F.xxhash64("other"), n_parts(F.col("_deg"))).alias("part"))
    others = texts.select(F.col("_id").alias("other"), F.col("_text").alias("text_b"))
    last = F.when(F.col("_deg") > PART, n_parts(F.col("_deg"))).otherwise(F.lit(1).cast("long")) - 1
    leads = texts.select(F.col("_id").alias("lead"), F.col("_text").alias("text_a"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    both = led.join(others, "other").join(leads, ["lead", "part"])
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_links, "a long, b long").distinct()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("rep", pa.int64()), ("comp", pa.int64()), ("tokens", pa.list_(pa.int64()))])
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            sets = [s.view(np.int64) for s in shingle_sets(part.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.list_(pa.int64()))], schema=schema)


def prefix_pairs(left: DataFrame, n_left: int, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Pairs ``a, b`` of texts of different components that may still be linked.

    Exact prefix filter: order a set's shingles by how many of these texts hold them.
    Two linked texts share a shingle among the first ``n - ceil(0.75 n) + 1`` of both.
    Shingles of one text only come first and meet nothing, so a text with enough of them
    has no candidate at all; shingles of passages that many texts share come last. The
    places of a shared shingle bound what a pair can still share. Per shingle, members
    of its largest component meet the others only."""
    want = broadcast_if_small(left.select(F.col("rep").alias("_want"), "comp"), n_left, 24)
    d = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("_id"), F.col(text).alias("_text")).where(F.length("_text") > 0)
    sets = d.join(want, F.col("_id") == F.col("_want")).select(F.col("_id").alias("rep"), "comp", "_text").mapInArrow(_sets, "rep long, comp long, tokens array<long>").where(F.size("tokens") > 0)
    sets = materialize(sets.withColumn("set", F.xxhash64("tokens")).dropDuplicates(["rep", "set"]), "sets")
    tokens = sets.select("rep", "comp", "set", F.size("tokens").alias("n"), F.explode("tokens").alias("t"))
    held = tokens.groupBy("t").agg(F.count("*").alias("c")).where("c > 1")
    shared = tokens.join(held, "t").groupBy("rep", "comp", "set", "n").agg(F.sort_array(F.collect_list(F.struct("c", "t"))).alias("s"))
    slots = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1 - (F.col("n") - F.size("s"))
    first = shared.where(slots > 0).select("rep", "comp", "n", (F.col("n") - F.size("s")).alias("own"), F.posexplode(F.slice("s", F.lit(1), slots.cast("int"))["t"]).alias("i", "t"))
    first = first.select("rep", "comp", "n", "t", (F.col("n") - F.col("own") - F.col("i")).alias("rest"))
    first = materialize(first, "prefixes")
    sizes = first.groupBy("t", "comp").agg(F.count("*").alias("size"))
    torn = sizes.groupBy("t").agg(F.max(F.struct("size", "comp"))["comp"].alias("main"), F.count("*").alias("parts")).where("parts > 1").select("t", "main")
    torn = materialize(first.join(torn, "t"), "torn")
    outside = torn.where("comp != main").select("t", F.col("rep").alias("x"), F.col("n").alias("n_x"), F.col("comp").alias("comp_x"), F.col("rest").alias("rest_x"))
    # at the first shingle that a pair shares, all further ones lie among the rest of both
    reach = (100 + PERCENT) * F.least("rest_x", "rest") >= PERCENT * (F.col("n_x") + F.col("n"))
    close = (F.col("comp") != F.col("comp_x")) & reach & (100 * F.least("n_x", "n") >= PERCENT * F.greatest("n_x", "n"))
    return outside.join(torn, "t").where(close).select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b")).distinct()


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a partition's links; a star for each of its trees."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x], x = top, up
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for at in range(0, len(nodes), 10000):
        part = nodes[at : at + 10000]
        yield pa.RecordBatch.from_pydict({"u": part, "v": [root(x) for x in part]}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of each node with a link."""
    stars = materialize(links.select("a", "b").mapInArrow(_contract, "u long, v long").where("u != v").distinct(), "stars")
    while True:
        # large star: what is greater than a node joins the node's smallest neighbour
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours join the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u")
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        after = materialize(small, "stars")
        changed = after.exceptAll(stars).limit(1).count() or stars.exceptAll(after).limit(1).count()
        stars = after
        if not changed:
            break
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_id, n_shingles, component`` of each row."""
    rows = materialize(features(docs, doc_id, text), "features")
    classes = rows.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("_id").alias("rep"), F.max("_id").alias("top"), F.first("bands").alias("bands"))
    classes = materialize(classes, "classes")
    shared = classes.where("rep != top").select(F.col("n").alias("cn"), F.col("f1").alias("c1"), F.col("f2").alias("c2"), "rep")
    # every row with the class that stands for its text
    same = (F.col("n") == F.col("cn")) & (F.col("f1") == F.col("c1")) & (F.col("f2") == F.col("c2"))
    placed = rows.select("_id", "n", "f1", "f2").join(shared, same, "left").select("_id", "n", F.coalesce("rep", "_id").alias("rep"))
    placed = materialize(placed, "placed")
    buckets = classes.select("rep", "n", F.posexplode("bands").alias("band", "hash"))
    full = buckets.groupBy("band", "hash").agg(F.count("*").alias("size")).where("size > 1")
    members = materialize(buckets.join(full, ["band", "hash"]), "members")
    # the member that shares most with the others of its buckets leads: near the middle of
    # a group of copies, so one star reaches most of them
    central = members.groupBy("rep").agg(F.sum("size").alias("weight")).select(F.col("rep").alias("_w"), "weight")
    led = members.join(central, F.col("rep") == F.col("_w")).groupBy("band", "hash").agg(F.max(F.struct("weight", (-F.col("rep")).alias("back"), F.col("n").alias("n_a"))).alias("lead"))
    led = led.select("band", "hash", (-F.col("lead.back")).alias("lead"), "lead.n_a")
    close = (100 * F.least("n_a", "n") >= PERCENT * F.greatest("n_a", "n")) & (F.col("lead") != F.col("rep"))
    pairs = members.join(led, ["band", "hash"]).where(close).select(F.least("lead", "rep").alias("a"), F.greatest("lead", "rep").alias("b"))
    pairs = materialize(pairs.distinct(), "pairs")
    links = materialize(verified(pairs, pairs.count(), docs, doc_id, text), "links")
    # one document under several texts holds its classes together
    several = placed.groupBy("_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a != b").select("a", F.col("_id").alias("b"))
    several = several.union(placed.where("_id != rep").join(several.select(F.col("b").alias("_id")), "_id", "left_semi").select(F.col("rep").alias("a"), F.col("_id").alias("b")))
    links = materialize(links.union(several), "links")
    groups = components(links)
    found = members.join(groups, F.col("rep") == F.col("node"), "left").select("band", "hash", "rep", F.coalesce("component", "rep").alias("comp"))
    mixed = found.groupBy("band", "hash").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo != _hi").select("band", "hash")
    left = materialize(found.join(mixed, ["band", "hash"], "left_semi").select("rep", "comp").distinct(), "torn")
    fresh = materialize(prefix_pairs(left, left.count(), docs, doc_id, text), "pairs")
    if n_fresh := fresh.count():
        more = materialize(verified(fresh, n_fresh, docs, doc_id, text), "links")
        if not more.isEmpty():
            groups = components(links.union(more))
    named = placed.join(groups, F.col("rep") == F.col("node"), "left")
    return named.select("_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row."""
    d = near_groups(docs, doc_id, text)
    return d.select(public_id().alias("doc_id"), "n_shingles", public_id("component").alias("component_id"), (F.col("_id") == F.col("component")).alias("kept"))


def kept_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, the smallest: its first row, unchanged."""
    lost = near_groups(docs, doc_id, text).where("_id != component").select(F.col("_id").alias("_lost")).distinct()
    d = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("_id"), carried(docs))
    return d.join(lost, F.col("_id") == F.col("_lost"), "left_anti").select("doc.*")
