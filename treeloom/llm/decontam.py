"""Benchmark decontamination by spaced-seed hashing.

A text's tokens (lower-cased runs of letters and digits) are hashed once; fixed
masks then hash windows of tokens in which the masked positions are ignored, so a
window still meets its counterpart when ignored tokens were substituted. Training
and benchmark hashes are joined; hits name a diagonal (the shift between document
and benchmark item), and around each diagonal the overlap is verified token by
token: a window of ``WINDOW`` aligned tokens with at most ``MISSES`` substitutions
(items shorter than the window must match over their length, with the same share
of substitutions).

The masks find every window of 13 tokens with up to two substitutions (shown by
enumeration in the tests) and every item of 10 to 12 with its one. Items of 8 and 9
tokens also meet by their first or last four tokens, one of which a single
substitution leaves whole. Items under ``MIN_SUBSTITUTED`` tokens, text without word
spaces among them, must match token for token: their seed is a mask over their whole
length. Seeds of such further masks are made only for lengths that the benchmark has.

The benchmark's seeds are broadcast only if their count proves them small. Otherwise
a Bloom filter of fixed size (``BLOOM_WORDS`` longs, made of the benchmark's seeds) drops
nearly all seeds of the corpus in the scan, and what is left is shuffled in ``SPLITS``
parts of each seed, so that a common phrase is no single task. Only hits leave the
scan: one row for each candidate diagonal. A row's tokens are cut into the slices
under its hits at once; no copy of all tokens is made for a hit.

Defined results: texts without a token match nothing on either side, nor do null ones;
repeated benchmark rows count as one item per item_id and text; items without an id are
found like others and told as one item, whose id is null; of several overlaps of a row
with an item the one with most equal tokens, then the first, is told.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, carried, let, materialize, public_id, row_key

#: Fixed masks of weight 6: 1 is compared, 0 is ignored.
MASKS = ("11011101", "101001111")
WINDOW = 13
MISSES = 2
#: Items under so many tokens must match token for token.
MIN_SUBSTITUTED = 8
#: Items under so many tokens also meet by this mask at their first and last tokens.
SHORT = 10
HALF = "1111"
#: MB of benchmark seeds or items that may be broadcast; longs of the Bloom filter; parts of a seed.
BROADCAST_MB = 32
BLOOM_WORDS = 1 << 19
SPLITS = 16


def tokens_of(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+", -1)
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def seed_hashes(hashes: Column, masks=MASKS, first: int = 0) -> Column:
    """Array of (position, hash) over all masks, numbered from ``first``."""
    def one(k: int, mask: str) -> Column:
        kept = [i for i, c in enumerate(mask) if c == "1"]
        last = F.size(hashes) - len(mask)
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda p: F.struct(p.alias("pos"), F.xxhash64(F.lit(k), *[F.get(hashes, p + i) for i in kept]).alias("seed")))

    return F.concat(*[one(k, mask) for k, mask in enumerate(masks, first)])


def item_seeds(items: DataFrame, masks, short: list[int]) -> DataFrame:
    """``item_id, _it, _n, _at, seed`` of each item: its windows under the masks, and for
    the lengths of ``short`` (those the benchmark has below ``SHORT``) the further seeds."""
    item, n = F.col("_item"), F.size("_item")
    whole = [k for k in short if k < MIN_SUBSTITUTED]
    exact = F.concat(F.array().cast("array<struct<pos:int,seed:bigint>>"), *[F.when(n == k, seed_hashes(item, ("1" * k,), len(masks) + k)).otherwise(F.array().cast("array<struct<pos:int,seed:bigint>>")) for k in whole])
    ends = F.filter(seed_hashes(item, (HALF,), len(masks)), lambda s: (s["pos"] == 0) | (s["pos"] == n - len(HALF)))
    seeds = F.when(n < MIN_SUBSTITUTED, exact).when(n < SHORT, F.concat(seed_hashes(item, masks), ends)).otherwise(seed_hashes(item, masks))
    rows = items.select("item_id", "_item", F.explode(seeds).alias("s"))
    return rows.select("item_id", F.xxhash64("_item").alias("_it"), n.alias("_n"), F.col("s.pos").alias("_at"), F.col("s.seed").alias("seed")).distinct()


def bloom_filter(seeds: DataFrame) -> Column:
    """The benchmark's seeds as one array of longs, two bits for each seed."""
    bits = seeds.select(F.explode(F.array(*_bits(F.col("seed")))).alias("bit"))
    words = bits.groupBy((F.col("bit") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    every = seeds.sparkSession.range(BLOOM_WORDS).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("bits"))
    words = words.union(every).groupBy("w").agg(F.bit_or("bits").alias("bits"))
    return words.agg(F.sort_array(F.collect_list(F.struct("w", "bits")))["bits"].alias("filter")).scalar()


def _bits(seed: Column) -> list[Column]:
    return [F.pmod(h, F.lit(BLOOM_WORDS * 64)) for h in (seed, F.xxhash64(seed))]


def may_hold(bloom: Column, seed: Column) -> Column:
    first, second = (F.expr("1L") == F.call_function("shiftright", F.get(bloom, (b / 64).cast("int")), (b % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) for b in _bits(seed))
    return first & second


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, misses: int = MISSES, masks=MASKS) -> DataFrame:
    """One row ``_id, _h, item_id, item_tokens, matched_tokens, start`` for each
    row and benchmark item that overlap: ``start`` is the token of the document
    under the item's first one (negative if the overlap starts inside the item)."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), tokens_of(F.col(item_text)).alias("_item")).where(F.size("_item") > 0).distinct()
    short = sorted(r[0] for r in items.select(F.size("_item").alias("n")).where(F.col("n") < SHORT).distinct().collect())  # at most SHORT - 1 lengths
    test = materialize(item_seeds(items, masks, short), "seeds")
    n_test = test.count()

    def seeds_of(tokens: Column) -> Column:
        found = [seed_hashes(tokens, masks)]
        if any(k >= MIN_SUBSTITUTED for k in short):
            found.append(seed_hashes(tokens, (HALF,), len(masks)))
        found += [seed_hashes(tokens, ("1" * k,), len(masks) + k) for k in short if k < MIN_SUBSTITUTED]
        return F.concat(*found)

    train = docs.select(*row_key(doc_id, text), tokens_of(F.col(text)).alias("_tokens"))
    train = train.select("_id", "_h", F.explode(let(F.col("_tokens"), seeds_of)).alias("s"))
    train = train.select("_id", "_h", F.col("s.pos").alias("pos"), F.col("s.seed").alias("seed"))
    if n_test * 64 <= BROADCAST_MB << 20:
        hits = train.join(F.broadcast(test), "seed")
    else:
        train = train.where(may_hold(bloom_filter(test), F.col("seed"))).withColumn("_part", F.pmod(F.xxhash64("_id", "pos"), F.lit(SPLITS)).cast("int"))
        hits = train.join(test.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1)))), ["seed", "_part"])
    hits = materialize(hits.select("_id", "_h", "item_id", "_it", "_n", (F.col("pos") - F.col("_at")).alias("shift")).distinct(), "hits")
    by_row = hits.groupBy("_id", "_h").agg(F.collect_list(F.struct("item_id", "_it", "_n", "shift")).alias("_hits"))
    by_row = by_row.select(F.col("_id").alias("_ci"), F.col("_h").alias("_ch"), "_hits")
    by_row = broadcast_if_small(by_row, hits.count(), 64, BROADCAST_MB)
    found = docs.select(*row_key(doc_id, text), F.col(text).alias("_text")).join(by_row, (F.col("_id") == F.col("_ci")) & (F.col("_h") == F.col("_ch")))
    found = found.withColumn("_tokens", tokens_of(F.col("_text")))
    under = F.transform("_hits", lambda x: F.struct(x["item_id"].alias("item_id"), x["_it"].alias("_it"), x["shift"].alias("shift"), F.slice("_tokens", F.greatest(x["shift"], F.lit(0)) + 1, x["_n"] + F.least(x["shift"], F.lit(0))).alias("_under")))
    found = found.select("_id", "_h", F.explode(under).alias("x")).select("_id", "_h", "x.*")
    items = items.select(F.col("item_id").alias("_ii"), F.xxhash64("_item").alias("_ti"), "_item")
    n_items = F.col("_item")
    pairs = found.join(broadcast_if_small(items, n_test, 64, BROADCAST_MB), (F.col("_it") == F.col("_ti")) & F.col("item_id").eqNullSafe(F.col("_ii"))).drop("_ii", "_ti")
    ahead = -F.least("shift", F.lit(0))  # tokens of the item before the document's first
    equal = F.transform(n_items, lambda h, j: F.coalesce((j >= ahead) & (F.get(F.col("_under"), j - ahead) == h), F.lit(False)).cast("int"))
    pairs = pairs.withColumn("_equal", equal)
    width = F.least(F.lit(window), F.size(n_items))
    need = width - F.when(F.size(n_items) < MIN_SUBSTITUTED, F.lit(0)).otherwise(F.floor(width * misses / window))

    def verified(eq: Column) -> Column:
        return F.exists(F.sequence(F.lit(1), F.size(n_items) - width + 1), lambda s: F.aggregate(F.slice(eq, s, width), F.lit(0), lambda a, x: a + x) >= need)

    pairs = pairs.where(verified(F.col("_equal")))
    pairs = pairs.select("_id", "_h", "item_id", F.size("_item").cast("long").alias("item_tokens"), F.aggregate("_equal", F.lit(0), lambda a, x: a + x).cast("long").alias("matched_tokens"), F.col("shift").cast("long").alias("start"))
    best = F.max(F.struct("matched_tokens", "item_tokens", (-F.col("start")).alias("back"))).alias("b")
    best = pairs.groupBy("_id", "_h", "item_id").agg(best)
    return best.select("_id", "_h", "item_id", "b.item_tokens", "b.matched_tokens", (-F.col("b.back")).alias("start"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``overlaps`` with the public document id."""
    return overlaps(docs, benchmark, **options).select(public_id().alias("doc_id"), "item_id", "item_tokens", "matched_tokens", "start")


def clean_documents(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that overlap no benchmark item, unchanged."""
    bad = overlaps(docs, benchmark, doc_id, text, **options).select(F.col("_id").alias("_bi"), F.col("_h").alias("_bh")).distinct()
    d = docs.select(*row_key(doc_id, text), carried(docs))
    return d.join(bad, (F.col("_id") == F.col("_bi")) & (F.col("_h") == F.col("_bh")), "left_anti").select("doc.*")
