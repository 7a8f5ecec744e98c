"""Spelling variants: words at one edit from each other, grouped under their commonest form.

Words are maximal runs of letters, A-Z lower-cased. Of every 199th run of a document (by the
CRC-32 of id and run) one letter is dropped, as in the contract of the query; ``damaged``
is a parameter. A word counts once for each occurrence over the whole table: a task keeps
a bounded dictionary of counts and sends a row per word when it is full.

Pairs by even-partition pigeonhole. A word of length l is cut into two segments, of
``l div 2`` and the rest, and indexed under each. One edit leaves one of the segments whole,
so a probe of equal length shows its own segments, and a probe that is one longer the
segments of its length less one: the first at its place, the second shifted by one.
Equal keys are candidates; ``levenshtein`` with a bound of one verifies them, and
pairs found under both segments are told once.

A segment of more than ``HOT`` indexed words (an ending, say) would compare all with
all. In it the edit lies in the rest of the word, so the rest is cut in two by the same rule
and its halves extend the key; probes of such a segment are extended likewise. No pair is lost.

Forms. A word's form is the near word of largest count (ties: the smallest) if it has at least
``RATIO`` times the word's own. Counts grow along forms, so chains are short and end; roots
are found by doubling the steps, each round written to the shared folder.

Defined results: null and empty texts have no words; a null id is the empty text in the
digest; repeated rows count each time; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize

MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
DAMAGED = 199
#: Words of one segment beyond which its key is extended.
HOT = 50
#: Words that a task counts before it sends them on.
REMEMBER = 1 << 18

_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def counted(damaged: int = DAMAGED, min_length: int = MIN_LENGTH):
    """A function from batches of ``_id, _text`` to partial counts of words."""
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{min_length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("_id").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                if not text:
                    continue
                here = Counter(runs.findall(text.encode().lower().decode()))  # of bytes: A-Z alone
                start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in here.items():
                    h = crc32(run.encode(), start)
                    if h % damaged == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < min_length:
                            continue
                    held[run] += n
                if len(held) > REMEMBER:
                    yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())}, schema=_COUNTS)
                    held.clear()
        yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())}, schema=_COUNTS)

    return count


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of words of ``MIN_LENGTH`` letters or more."""
    d = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    parts = d.mapInArrow(counted(), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _cut(word: Column, size: Column, longer: int) -> list[tuple[Column, Column]]:
    """(segment, rest) of both segments of a text of ``size`` letters; ``longer``: 1 where the
    text has one letter more than what was indexed."""
    head = F.floor((size - longer) / 2).cast("int")
    tail = size - longer - head
    return [(F.substring(word, F.lit(1), head), F.substring(word, head + 1, size - head)), (F.substring(word, size - tail + 1, tail), F.substring(word, F.lit(1), size - tail))]


def _keys(words: DataFrame, longer: int) -> DataFrame:
    """``l, seg, key, rest`` and the word: the keys of words, as indexed (0) or as one longer (1)."""
    size = F.length("word")
    segments = [F.struct(F.lit(k).alias("seg"), key.alias("key"), rest.alias("rest")) for k, (key, rest) in enumerate(_cut(F.col("word"), size, longer))]
    return words.select("word", (size - longer).alias("l"), F.explode(F.array(*segments)).alias("s")).select("word", "l", "s.*")


def _halves(rows: DataFrame, longer: int) -> DataFrame:
    """Keys extended by the halves of the rest."""
    halves = [F.struct(F.lit(k).alias("half"), key.alias("more")) for k, (key, _) in enumerate(_cut(F.col("rest"), F.length("rest"), longer))]
    return rows.select("word", "l", "seg", "key", F.explode(F.array(*halves)).alias("x")).select("word", "l", "seg", "key", "x.*")


def near_pairs(words: DataFrame, hot: int = HOT) -> DataFrame:
    """``a, b``: every two words at one edit once; the shorter, or else the smaller, is ``a``."""
    index = materialize(_keys(words, 0), "index")
    probe = {0: index, 1: _keys(words, 1)}
    at = ["l", "seg", "key"]
    large = materialize(index.groupBy(*at).agg(F.count("*").alias("c")).where(F.col("c") > hot).drop("c"), "hot")
    large = broadcast_if_small(large, large.count(), 128)

    def met(indexed: DataFrame, probes: DataFrame, on: list[str], longer: int) -> DataFrame:
        both = indexed.withColumnRenamed("word", "a").join(probes.withColumnRenamed("word", "b"), on)
        both = both if longer else both.where("a < b")
        return both.select("a", "b").where(F.levenshtein("a", "b", 1) == 1)

    found = []
    for longer, rows in probe.items():
        found.append(met(index.join(large, at, "left_anti"), rows, at, longer))
        found.append(met(_halves(index.join(large, at, "left_semi"), 0), _halves(rows.join(large, at, "left_semi"), longer), [*at, "half", "more"], longer))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    return pairs.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: the last form reached."""
    steps = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = steps.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        after = materialize(steps.join(ahead, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "roots")
        steps = after.drop("moved")
        if after.where("moved").isEmpty():
            return steps


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word of ``word, n``."""
    words = materialize(words, "words")
    pairs = materialize(near_pairs(words), "pairs")
    both = pairs.union(pairs.select("b", "a")).toDF("word", "near")
    counts = words.select(F.col("word").alias("_w"), F.col("n").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("neg"), F.col("near")))
    best = both.join(counts, F.col("near") == F.col("_w")).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    d = words.join(best, "word", "left")
    has = -F.col("best.neg") >= ratio * F.col("n")
    d = materialize(d.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.neg")).alias("form_n")), "forms")
    ends = roots(d.where("form is not null")).select(F.col("word").alias("_w"), "root")
    return d.join(ends, F.col("word") == F.col("_w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``variants`` of the words of ``docs``."""
    return variants(vocabulary(docs, doc_id, text))
