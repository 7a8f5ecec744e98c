"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words; a document's expected number of
copies is its source's target over its source's size. The documents of a source
are put in a fixed order, expected copies are prefix-summed, one random offset
per source is added, and a document is emitted once for each integer that its
step of the prefix sum crosses. The order is by size class first, so that a
source's words stay near the target although copies are drawn per document.

The prefix sum needs no task that holds a source: ranks are the sum of four
exclusive prefixes, over size classes of a source (at most ``64 * 8`` rows), over the
groups of chunks of a class and the chunks of a group (at most ``GROUP`` rows each) and
inside one chunk. A row's chunk
comes from a digest of its id and text, so that neither ids in steps nor a shared
or missing id gather in one chunk. Only the list of sources (a row each) is ranked in one task.

Defined results: null text has size 0; a null source is a source of its own, the
last; a source of size 0 has target 0 and none of its documents is taken; rows
that repeat each get their own place in the order; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, WORD, carried, materialize

#: A power of 16, so that SQL can cut it from a digest.
CHUNKS = 4096
GROUP = 64
WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def size_class(size: Column) -> Column:
    """Eight classes per power of two, from integer arithmetic alone."""
    bits = F.length(F.bin(size)).cast("int")
    low = F.expr("shiftright(_size, greatest(length(bin(_size)) - 4, 0))").cast("int")
    return (bits * 16 + low).cast("int")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """``_source, source_size, target`` from ``_source, _size``.

    Water filling in closed form: with sources by rising cap over weight, those
    that stop at their cap are a prefix, and the level of the rest is what is left
    over their weights."""
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    s = s.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("_cap", (F.col("source_size") * cap).cast("double"))
    rising = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("_source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(every).cast("double")
    s = s.withColumn("_level", (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward))
    s = s.withColumn("_stops", F.col("_level") * F.col("_w") >= F.col("_cap"))
    s = s.withColumn("_water", F.max(F.when(~F.col("_stops"), F.col("_level"))).over(every))
    target = F.when(F.col("_stops"), F.col("_cap")).otherwise(F.col("_water") * F.col("_w"))
    return s.select("_source", "source_size", target.alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, cap: int = CAP, seed: str = SEED, carry: tuple[str, ...] | None = None) -> DataFrame:
    """``doc`` (the input columns named by ``carry``, None: all) with ``size, source_size,
    target, copies``: how often each row is taken. Deterministic for a seed."""
    d = docs.select(
        carried(docs, carry),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("_id"),
        F.col(source).cast("string").alias("_source"),
        word_count(F.col(text)).alias("_size"),
        F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text), F.lit("")))).alias("_tie"),
    )
    d = d.withColumns({"_class": size_class(F.col("_size")), "_chunk": (F.conv(F.substring("_tie", 1, 8), 16, 10).cast("long") % CHUNKS).cast("int")})
    chunk = ["_source", "_class", "_chunk"]
    counts = materialize(d.groupBy(*chunk).agg(F.count("*").alias("_n"), F.sum("_size").alias("_size")), "counts")
    counts = counts.withColumn("_group", (F.col("_chunk") / GROUP).cast("int"))
    per_source = source_targets(counts.select("_source", "_size"), weights, cap)
    groups = counts.groupBy("_source", "_class", "_group").agg(F.sum("_n").alias("_n"))
    classes = groups.groupBy("_source", "_class").agg(F.sum("_n").alias("_n"))

    def before(*keys: str):
        """Rows of the same keys but the last that come before."""
        w = Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_n").over(w), F.lit(0))

    classes = classes.select(F.col("_source").alias("_s"), F.col("_class").alias("_c"), before("_source", "_class").alias("_base"))
    groups = groups.select(F.col("_source").alias("_gs"), F.col("_class").alias("_gc"), F.col("_group").alias("_gg"), before("_source", "_class", "_group").alias("_in_class"))
    targets = per_source.withColumnRenamed("_source", "_t")
    starts = counts.withColumn("_off", before("_source", "_class", "_group", "_chunk"))
    starts = starts.join(groups, F.col("_source").eqNullSafe(F.col("_gs")) & (F.col("_class") == F.col("_gc")) & (F.col("_group") == F.col("_gg")))
    starts = starts.join(classes, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c")))
    starts = starts.join(targets, F.col("_source").eqNullSafe(F.col("_t")))
    starts = starts.select(F.col("_source").alias("_s"), F.col("_class").alias("_c"), F.col("_chunk").alias("_k"), (F.col("_base") + F.col("_in_class") + F.col("_off")).alias("_start"), "source_size", "target")
    placed = d.withColumn("_place", F.row_number().over(Window.partitionBy(*chunk).orderBy("_size", "_id", "_tie")))
    joined = placed.join(starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c")) & (F.col("_chunk") == F.col("_k")))
    rank = (F.col("_start") + F.col("_place")).cast("double")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.lit("|"), F.coalesce(F.col("_source"), F.lit("")))), 1, 5), 16, 10).cast("double") + 0.5) / 1048576.0
    crossed = F.floor(rate * rank + offset) - F.floor(rate * (rank - 1) + offset)
    copies = F.least(crossed, F.lit(cap)).cast("long")
    return joined.select("doc", F.col("_size").alias("size"), "source_size", "target", copies.alias("copies"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, with its own columns."""
    taken = mix(docs, doc_id, text, source, **options).where(F.col("copies") > 0)
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return taken.select("doc", again).select("doc.*")
