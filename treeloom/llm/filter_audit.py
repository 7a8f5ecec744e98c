"""Filter interaction audit by direct relational replay.

Filters that drop documents hide each other's work: what a filter removes depends on
those before it. Here each document's filter flags meet every order of the filters
(a broadcast table of n! rows: 120 for five), the first filter of the order that the
document fails is found, the order's steps are exploded, and all counts are conditional
sums with map-side combining. A task sends one row for each part, order and step that
it saw, whatever the number of documents, so a part with most documents is no large
task after the exchange either.

Duplicates are told by the SHA-256 of the whole text. The smallest id of each digest is a
map-side minimum; only digests of several rows meet the documents again, by broadcast where
their count proves them small, else with each digest in ``SPLITS`` parts.

Defined results: a null text is empty, has no words and fails the least number of words;
filters B and C compare 0 with 0 there and pass. A null part is the empty string, as is an
empty one. Rows without an id come after all ids (they are copies of any row of equal
text that has an id, not of each other) and have no label; rows that repeat an id are counted one
by one and are not copies of each other. Several labels of an id count as good (toxic)
if one of them says so. An empty table has no parts, hence no rows. Further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, WORD_SEPARATOR, broadcast_if_small, let, materialize

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 2
SYMBOLS = "[#$%&*|]"
#: Filters whose orders may be replayed: 720 orders at most.
MAX_FILTERS = 6
#: Parts of a digest's rows when the repeated digests are too many to broadcast.
SPLITS = 16
#: Bytes of repeated digests that may be broadcast.
BROADCAST_BYTES = 32 << 20


def text_flags(text: Column) -> dict[str, Column]:
    """Failures that a text shows by itself: A to D."""
    t = F.coalesce(text, F.lit(""))
    counts = let(F.filter(F.split(t, WORD_SEPARATOR, -1), lambda w: w != ""), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))
    return {
        "A": counts["n"] < MIN_WORDS,
        "B": 100 * counts["d"] < MIN_DISTINCT_PERCENT * counts["n"],
        "C": 100 * F.regexp_count(t, F.lit("[A-Z]")) > MAX_UPPER_PERCENT * F.length(t),
        "D": t.rlike(SYMBOLS),
    }


def flagged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``part``, the failures ``A`` to ``E``, ``good`` and ``toxic`` of each row."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(t, 256)).alias("_digest"), *[v.alias(k) for k, v in text_flags(F.col(text)).items()])
    d = materialize(d, "flags")  # no texts; read three times
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_lid"))
    marks = materialize(marks.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")), "labels")
    order = F.coalesce("_id", F.lit(NULL_ID))
    copies = d.groupBy("_digest").agg(F.min(order).alias("_first"), F.count("*").alias("_rows")).where("_rows > 1")
    copies = materialize(copies.select(F.col("_digest").alias("_cd"), "_first"), "copies")
    # rows without an id have no label and go to no common task
    named = d.where("_id is not null").join(broadcast_if_small(marks, marks.count(), 32), F.col("_id") == F.col("_lid"), "left").drop("_lid")
    d = named.unionByName(d.where("_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})).na.fill(False, ["good", "toxic"])
    n = copies.count()
    same = F.col("_digest") == F.col("_cd")
    if n * 96 <= BROADCAST_BYTES:
        d = d.join(F.broadcast(copies), same, "left")
    else:
        dealt = copies.withColumn("_split", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))))
        d = d.join(dealt, same & (F.pmod(F.xxhash64("_id", "part", "_digest"), F.lit(SPLITS)).cast("int") == F.col("_split")), "left")
    d = d.withColumn("E", F.coalesce(order > F.col("_first"), F.lit(False)))
    return d.select("part", *FILTERS, "good", "toxic")


def orders(spark: SparkSession, filters: Sequence[str]) -> DataFrame:
    """``filter_order, bits``: every order of the filters, and the bits of its steps' filters."""
    if not 0 < len(filters) <= MAX_FILTERS or len(set(filters)) != len(filters):
        raise ValueError(f"between one and {MAX_FILTERS} different filters can be replayed")
    numbered = list(enumerate(filters))
    every = [F.struct(F.lit("".join(f for _, f in o)).alias("filter_order"), F.array(*[F.lit(1 << k) for k, _ in o]).alias("bits")) for o in permutations(numbered)]
    return spark.range(1).select(F.explode(F.array(*every)).alias("o")).select("o.*")


def replay(flags: DataFrame, filters: Sequence[str] = FILTERS, part: str = "part", good: str = "good", toxic: str = "toxic") -> DataFrame:
    """One row per part, order and step with the counts; ``flags`` holds a boolean (true: fails,
    null: passes) for each filter, under its name."""
    every = orders(flags.sparkSession, filters)  # n! rows
    mask = sum((F.when(F.col(f), 1 << k).otherwise(0) for k, f in enumerate(filters)), F.lit(0))
    rows = flags.select(F.col(part).alias("part"), mask.alias("_mask"), F.col(good).alias("_good"), F.col(toxic).alias("_toxic"))
    met = rows.crossJoin(F.broadcast(every))
    fails = lambda bit: F.col("_mask").bitwiseAND(bit) != 0
    first = F.coalesce(*[F.when(fails(F.get("bits", F.lit(k))), k + 1) for k in range(len(filters))], F.lit(len(filters) + 1))
    steps = met.withColumn("_first", first).select("part", "filter_order", "_mask", "_first", "_good", "_toxic", F.posexplode("bits").alias("_k", "_bit"))
    step, here = F.col("_k") + 1, F.col("_first") == F.col("_k") + 1
    count = lambda c: F.count_if(c).cast("long")
    out = steps.groupBy("part", "filter_order", step.alias("step"), "_bit").agg(
        count(F.col("_first") > step).alias("kept"), count(here).alias("removed"), count(fails(F.col("_bit")) & (F.col("_first") < step)).alias("redundant"),
        count(F.col("_mask") == F.col("_bit")).alias("unique_fails"), count(here & F.col("_good")).alias("good_lost"), count(here & F.col("_toxic")).alias("toxic_lost"))
    out = materialize(out, "replay")
    shapley = out.groupBy("part", "_bit").agg(F.sum("removed").alias("shapley")).select(F.col("part").alias("_sp"), F.col("_bit").alias("_sb"), "shapley")
    return out.join(shapley, (F.col("part") == F.col("_sp")) & (F.col("_bit") == F.col("_sb"))).drop("_sp", "_sb", "_bit")


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """The replay of the five filters over ``docs``."""
    return replay(flagged(docs, labels, doc_id, text, part))
