"""Token counts from an exact histogram of encoded lengths.

Every whole text is encoded once; documents are then aggregated by their number of
tokens, with map-side combine, and nothing but (length, documents) is shuffled.
Suffix sums over the histogram answer, for every context limit, how many documents
reach it, how many tokens they hold and what is left if all are truncated there;
quantiles come from the same sums. Lengths in between change nothing but a linear
term, so ``at_limits`` answers any limit from the histogram alone.

The sums run in two levels, over spans of ``SPAN`` lengths and inside each span, so
no task reads the whole histogram.

Defined results: null and empty texts have 0 tokens and count as documents; strings
that look like special tokens are ordinary text; an empty table has no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Fixed value: how this vocabulary cuts a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPAN = 512

_encodings: dict[int, object] = {}


def load_encoding(ranks_file: bytes, pieces: str = PIECES):
    """The encoding of a rank file; loaded once in a process."""
    import tiktoken

    key = hash((ranks_file, pieces))
    if key not in _encodings:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks_file.splitlines())}
        _encodings[key] = tiktoken.Encoding("own", pat_str=pieces, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def token_lengths(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``n_tokens`` of each row. ``vocabulary`` is the path of a rank file, which is read by
    the driver and sent once to each executor; its size does not depend on the data."""
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(ranks.value)
        for batch in batches:
            counts = []
            for t in batch.column(0):
                t = t.as_py()
                counts.append(len(encoding.encode_ordinary(t)) if t else 0)
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], names=["n_tokens"])

    return docs.select(F.col(text).cast("string").alias("_text")).mapInArrow(encode, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """``context_limit, n_docs`` and the sums of each length that occurs:
    ``docs_reaching`` and ``tokens_reaching`` (of this length or more),
    ``truncated_total`` (tokens left if all are cut to this limit), ``tokens_cut``
    and ``quantile`` (share of documents of this length or less)."""
    h = materialize(lengths.groupBy(F.col("n_tokens").alias("context_limit")).agg(F.count("*").alias("n_docs")), "lengths")  # texts are encoded once
    h = h.withColumns({"n_tokens": F.col("context_limit") * F.col("n_docs"), "_span": F.expr(f"context_limit div {SPAN}")})
    spans = h.groupBy("_span").agg(F.sum("n_docs").alias("_d"), F.sum("n_tokens").alias("_t"))
    later = Window.orderBy(F.col("_span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spans = spans.select(
        F.col("_span").alias("_s"),
        F.coalesce(F.sum("_d").over(later), F.lit(0)).alias("_docs_later"),
        F.coalesce(F.sum("_t").over(later), F.lit(0)).alias("_tokens_later"),
        F.sum("_d").over(every).alias("_docs"),
        F.sum("_t").over(every).alias("_tokens"),
    )
    onward = Window.partitionBy("_span").orderBy(F.col("context_limit").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = h.withColumns({"_d": F.sum("n_docs").over(onward), "_t": F.sum("n_tokens").over(onward)}).join(spans, F.col("_span") == F.col("_s"))
    h = h.withColumns({"docs_reaching": F.col("_d") + F.col("_docs_later"), "tokens_reaching": F.col("_t") + F.col("_tokens_later")})
    left = F.col("_tokens") - F.col("tokens_reaching") + F.col("context_limit") * F.col("docs_reaching")
    h = h.withColumns({
        "truncated_total": left,
        "tokens_cut": F.col("_tokens") - left,
        "quantile": (F.col("_docs") - F.col("docs_reaching") + F.col("n_docs")) / F.col("_docs"),
    })
    return h.select("context_limit", "n_docs", "n_tokens", "docs_reaching", "tokens_reaching", "truncated_total", "tokens_cut", "quantile")


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """``limit, truncated_total`` for any context limits, all in one pass; nothing for an
    empty histogram."""
    sums = [F.struct(F.lit(int(x)).cast("long").alias("limit"), F.sum(F.least(F.lit(int(x)), "context_limit") * F.col("n_docs")).alias("truncated_total")) for x in dict.fromkeys(limits)]
    return histogram.agg(F.array(*sums).alias("_all")).select(F.explode("_all").alias("x")).select("x.*").where("truncated_total is not null")


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """``share, n_tokens``: the least length that a share of the documents does not exceed."""
    least = [F.struct(F.lit(float(x)).alias("share"), F.min(F.when(F.col("quantile") >= float(x), F.col("context_limit"))).alias("n_tokens")) for x in dict.fromkeys(shares)]
    return histogram.agg(F.array(*least).alias("_all")).select(F.explode("_all").alias("x")).select("x.*").where("n_tokens is not null")
