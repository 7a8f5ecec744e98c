"""Line dedup: range-partitioned line hashes, streamed first occurrences, sparse
per-document bitmaps.

Keys (a line stripped and lower-cased) are hashed to 128 bits; text never leaves
the scan. Rows are dealt by range of the hash and sorted inside a range by hash,
document and position; the first row of a key names the document that keeps it,
and each later row of another document is dropped. Hashes are uniform, so ranges
of equal width are even without sampling.

Keys that hold more than an eighth of a partition's fair share of the rows would make
ranges uneven. There are at most ``8 n`` of them for ``n`` partitions; they are found
with a frequent items sketch over all rows and go another exact way: their first
document is a map-side combined minimum, joined back by broadcast of that bounded list.

Dropped positions return as words of 64 bits, only non-zero words kept: a sparse
bitmap whose complement is the keep bitmap. It meets the text in one shuffle, at every
size, that carries each text once; lines are split only after that.

Defined results: null or empty text is one empty line, never dropped; keys
shorter than ``min_chars`` stay; rows sharing a doc_id are one document for the
question who keeps a key; null ids form one last document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, carried, let, materialize, partitions, row_key, strip

#: A key is hot above this part of a partition's fair share of the rows.
HOT_PART = 8
#: Counters of the sketch for each hot key there may be: errors stay below a quarter of the share.
SKETCH = 16


def line_key(line: Column) -> Column:
    return ascii_lower(strip(line))


def line_rows(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """``_id, _h, pos, k1, k2`` of each line whose key is long enough."""
    d = docs.select(*row_key(doc_id, text), F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1).alias("_lines"))
    rows = d.select("_id", "_h", F.posexplode("_lines").alias("pos", "_line"))
    rows = rows.select("_id", "_h", "pos", line_key(F.col("_line")).alias("_key")).where(F.length("_key") >= min_chars)
    return rows.select("_id", "_h", "pos", F.xxhash64("_key").alias("k1"), F.xxhash64(F.lit("second"), "_key").alias("k2"))


def hot_keys(rows: DataFrame, n: int) -> list[int]:
    """First halves of the hashes that hold more than a fair share of the rows."""
    most = HOT_PART * max(n, 32)
    found = rows.agg(F.count("*").alias("rows"), F.expr(f"approx_top_k(k1, {most}, {min(SKETCH * most, 1_000_000)})").alias("top")).first()
    share = max(1000, found["rows"] // (HOT_PART * n))
    return [x["item"] for x in found["top"] or () if x["count"] > share]


def dropped_lines(rows: DataFrame) -> DataFrame:
    """``_id, _h, pos`` of each line that repeats a key of a smaller document."""
    spark, n = rows.sparkSession, partitions(rows.sparkSession)
    hot = hot_keys(rows, n)
    is_hot = F.col("k1").isin(hot) if hot else F.lit(False)
    range_id = F.shiftright((F.shiftright("k1", 32) + F.lit(1 << 31)) * F.lit(n), 32).cast("int")
    dealt = rows.where(~is_hot).withColumn("_range", range_id).repartitionById(n, "_range")
    ordered = Window.partitionBy("_range", "k1", "k2").orderBy("_id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    streamed = dealt.withColumn("_first", F.first("_id").over(ordered))
    dropped = streamed.where("_id != _first").select("_id", "_h", "pos")
    if hot:
        firsts = rows.where(is_hot).groupBy("k1", "k2").agg(F.min("_id").alias("_first"))
        again = rows.where(is_hot).join(F.broadcast(firsts), ["k1", "k2"])
        dropped = dropped.union(again.where("_id != _first").select("_id", "_h", "pos"))
    return dropped


def drop_bitmaps(dropped: DataFrame) -> DataFrame:
    """``_id, _h, _words``: the non-zero words of each row's bitmap."""
    words = dropped.distinct().groupBy("_id", "_h", F.expr("pos div 64").cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return words.groupBy("_id", "_h").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("_words"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """``doc`` (the input's columns), ``kept_text, n_lines, n_dropped`` and ``drop_words``
    (the sparse bitmap, null where nothing goes) of each row."""
    rows = materialize(line_rows(docs, doc_id, text, min_chars), "line_rows")  # hashes only; read three times
    bitmaps = drop_bitmaps(dropped_lines(rows)).select(F.col("_id").alias("_bi"), F.col("_h").alias("_bh"), "_words")
    d = docs.select(*row_key(doc_id, text), carried(docs), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    joined = d.join(bitmaps.hint("merge"), (F.col("_id") == F.col("_bi")) & (F.col("_h") == F.col("_bh")), "left")
    dense = F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("_words"))), lambda w: F.coalesce(F.element_at("_words", w), F.lit(0).cast("long")))

    def stays(bits: Column, i: Column) -> Column:
        word = F.coalesce(F.get(bits, (i / 64).cast("int")), F.lit(0).cast("long"))
        return (F.call_function("shiftright", word, (i % 64).cast("int")).bitwiseAND(F.lit(1).cast("long"))) == 0

    kept = let(dense, lambda bits: F.filter(F.split("_text", "\n", -1), lambda x, i: stays(bits, i)))
    n_dropped = F.aggregate(F.map_values("_words"), F.lit(0), lambda n, bits: n + F.bit_count(bits))
    return joined.select(
        "doc",
        F.when(F.col("_words").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        (F.length("_text") - F.length(F.translate("_text", "\n", "")) + 1).cast("long").alias("n_lines"),
        F.coalesce(n_dropped, F.lit(0)).cast("long").alias("n_dropped"),
        F.col("_words").alias("drop_words"),
    )
