"""Removal of repeated byte strings, exact, over a whole corpus.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere
else, in the same document or another. A single suffix array over a corpus is not
possible in bounded memory, so the work is cut without losing a repeat:

1. Every window of ``length`` bytes chooses an anchor by its content (its gram of
   least hash). Equal windows choose equal anchors at equal offsets, so windows only
   have to be compared under one anchor. Neighbouring windows share their anchor:
   a run of them with its bytes is a *segment*, hashed as a whole.
2. Anchors that occur once are dropped (counted with map-side combine). Segments that
   occur twice or more repeat in all their windows.
3. Anchors with different segments are decided on one copy of each different segment:
   blocks of whole anchors are put through a Burrows-Wheeler transform whose
   intervals are expanded breadth-first to the left; common prefixes appear by
   increasing value and the expansion stops at ``length`` (see ``bwt``). A segment
   that is alone with its content is itself the only place, so the result is a span
   of its document; the others are settled by step 2.
4. Anchors with more than ``HOT_SEGMENTS`` different segments would not fit a block.
   They go an exact other way (``hot_spans``): their windows are cut into cells of
   neighbouring offsets to the anchor, whose common core and whole content are hashed
   and counted with map-side combine, so no task holds the anchor; cells that differ
   in content under one core are cut finer, down to single windows.

Texts move only in steps 3 and at the end, joined by broadcast where the counted
rows prove the other side small, else shuffled.

Defined results: null text is empty; texts shorter than ``length`` keep all bytes;
rows that repeat are places of their own, so they remove each other's text; the
remaining bytes may be no valid UTF-8 and are therefore binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bwt
from .common import broadcast_if_small, materialize, partitions, public_id, row_key

LENGTH = 200
#: Bytes of a block, and different segments of an anchor that still go into blocks.
BLOCK = 1_200_000
HOT_SEGMENTS = 2000
#: Widths of the cells of such anchors, each dividing the one before; the last is 1.
CELLS = (64, 16, 4, 1)

_RUNS = "_id long, _h long, lo long, n int, a long, s long"
_SPANS = "_id long, _h long, b long, e long"


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(*row_key(doc_id, text), F.coalesce(F.col(text), F.lit("")).alias("_text"))


def window_runs(docs: DataFrame, doc_id: str, text: str, length: int) -> DataFrame:
    """A row per run of windows: first start, number of starts, anchor, segment."""
    schema = pa.schema([("_id", pa.int64()), ("_h", pa.int64()), ("lo", pa.int64()), ("n", pa.int32()), ("a", pa.int64()), ("s", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part, rows = batch.slice(at, 200), []
                for i, h, t in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    for lo, hi, a, s, _ in bwt.anchors(t.encode("utf-8", "surrogatepass"), length):
                        rows.append((np.full(len(lo), i), np.full(len(lo), h), lo, (hi - lo + 1).astype(np.int32), a.view(np.int64), s.view(np.int64)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], schema=schema)

    return _texts(docs, doc_id, text).where(F.octet_length("_text") >= length).mapInArrow(run, _RUNS)


def _segments(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, length: int) -> DataFrame:
    """Wanted runs (``_id, _h, lo, n, a, s``) with their bytes as ``seg``, once however
    often the row is repeated: what repeats with the row is settled by its hashes."""
    by_row = wanted.groupBy("_id", "_h").agg(F.collect_list(F.struct("lo", "n", "a", "s")).alias("_runs"))
    by_row = by_row.select(F.col("_id").alias("_wi"), F.col("_h").alias("_wh"), "_runs")
    d = _texts(docs, doc_id, text).join(by_row, (F.col("_id") == F.col("_wi")) & (F.col("_h") == F.col("_wh")))
    d = d.dropDuplicates(["_id", "_h"])
    cut = F.transform("_runs", lambda x: F.struct(x["lo"].alias("lo"), x["n"].alias("n"), x["a"].alias("a"), x["s"].alias("s"), F.substring(F.col("_bytes"), x["lo"].cast("int") + 1, x["n"] + (length - 1)).alias("seg")))
    d = d.withColumn("_bytes", F.encode("_text", "UTF-8")).withColumn("_cut", cut)
    return d.select("_id", "_h", F.explode("_cut").alias("x")).select("_id", "_h", "x.*")


def _spans_of(row: tuple, starts: np.ndarray, length: int) -> list[tuple[int, int, int, int]]:
    """Removed spans of consecutive repeated starts."""
    i, h, lo = row
    cut = np.flatnonzero(np.diff(starts) > 1)
    first, last = np.concatenate([starts[:1], starts[cut + 1]]), np.concatenate([starts[cut], starts[-1:]])
    return [(i, h, lo + int(x), lo + int(y) + length) for x, y in zip(first, last, strict=True)]


def block_spans(segments: DataFrame, length: int, block: int = BLOCK) -> DataFrame:
    """``_id, _h, b, e``: what repeats inside segments of equal anchors."""
    schema = pa.schema([("_id", pa.int64()), ("_h", pa.int64()), ("b", pa.int64()), ("e", pa.int64())])

    def solve(held: list) -> pa.RecordBatch:
        found = bwt.repeated_starts([x[4] for x in held], length)
        spans = [y for x, starts in zip(held, found, strict=True) if len(starts) for y in _spans_of(x[:3], starts, length)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*spans, strict=True) if spans else [[]] * 4)], schema=schema)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, anchor = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[3] != anchor and size >= block:  # close only between anchors
                    yield solve(held)
                    held, size = [], 0
                anchor = row[3]
                held.append(row)
                size += len(row[4]) + 1
        if held:
            yield solve(held)

    dealt = segments.select("_id", "_h", "lo", "a", "seg").repartition(4 * partitions(segments.sparkSession), "a").sortWithinPartitions("a")
    return dealt.mapInArrow(blocks, _SPANS)


def _hash64(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _cells(length: int, width: int):
    """Cuts parts (``seg`` holds the bytes of windows with offsets off - n + 1 to off) into
    cells of ``width`` offsets. All windows of a cell share its core; equal windows have
    equal offsets, so they lie in equal cells with equal cores."""
    schema = pa.schema([("_id", pa.int64()), ("_h", pa.int64()), ("lo", pa.int64()), ("n", pa.int32()), ("a", pa.int64()), ("off", pa.int64()), ("cell", pa.int64()), ("core", pa.int64()), ("content", pa.int64()), ("seg", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, h, lo, n, a, off, seg in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if off is None:
                    off = int(next(bwt.anchors(seg, length))[4][0])
                for cell in range(off // width, (off - n + 1) // width - 1, -1):
                    top, low = min(off, (cell + 1) * width - 1), max(off - n + 1, cell * width)
                    first, count = off - top, top - low + 1
                    part = seg[first : first + count + length - 1]
                    place = off - cell * width  # of the cell's last window; its first is width - 1 before
                    core = seg[place : place - width + 1 + length]
                    rows.append((i, h, lo + first, count, a, top, cell, _hash64(core), _hash64(b"%d %d " % (top, count) + part), part))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return cut


def hot_spans(segments: DataFrame, length: int) -> DataFrame:
    """The same for anchors beyond a block, by counting cells of windows."""
    parts, spans = segments.select("_id", "_h", "lo", "n", "a", F.lit(None).cast("long").alias("off"), "seg"), None
    keys = ["a", "cell", "core"]
    for width in CELLS:
        cells = materialize(parts.mapInArrow(_cells(length, width), "_id long, _h long, lo long, n int, a long, off long, cell long, core long, content long, seg binary"), "cells")
        contents = cells.groupBy(*keys, "content").agg(F.count("*").alias("c"), F.min(F.struct("_id", "_h", "lo")).alias("one"))
        contents = materialize(contents, "contents")
        twice = cells.drop("seg").join(contents.where("c > 1").select(*keys, "content"), [*keys, "content"])
        found = twice.select("_id", "_h", F.col("lo").alias("b"), (F.col("lo") + F.col("n") + (length - 1)).alias("e"))
        spans = found if spans is None else spans.union(found)
        mixed = contents.groupBy(*keys).agg(F.count("*").alias("k")).where("k > 1").select(*keys)
        # one copy of each content goes on; the others of it are settled
        again = contents.join(mixed, keys, "left_semi").select("a", "one.*")
        parts = cells.join(again, ["a", "_id", "_h", "lo"], "left_semi").select("_id", "_h", "lo", "n", "a", "off", "seg")
    return spans


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """``_id, _h, b, e``: byte spans to remove; they may overlap and repeat."""
    runs = window_runs(docs, doc_id, text, length)
    shared = materialize(runs.groupBy("a").agg(F.count("*").alias("c")).where("c > 1").select(F.col("a").alias("_sa")), "anchors")
    runs = materialize(runs.join(broadcast_if_small(shared, shared.count(), 24), F.col("a") == F.col("_sa")).drop("_sa"), "runs")
    rep = F.min(F.struct("_id", "_h", "lo", "n")).alias("rep")
    segments = materialize(runs.groupBy("a", "s").agg(F.count("*").alias("c"), rep), "segments")
    full = segments.where("c > 1").select(F.col("a").alias("_fa"), F.col("s").alias("_fs"))
    full = broadcast_if_small(full, full.count(), 32)
    whole = runs.join(full, (F.col("a") == F.col("_fa")) & (F.col("s") == F.col("_fs"))).select("_id", "_h", F.col("lo").alias("b"), (F.col("lo") + F.col("n") + (length - 1)).alias("e"))
    several = segments.groupBy("a").agg(F.count("*").alias("k")).where("k > 1").select(F.col("a").alias("_ma"), "k")
    wanted = materialize(segments.join(several, F.col("a") == F.col("_ma")).select("rep.*", "a", "s", "k"), "wanted")
    cold, hot = wanted.where(F.col("k") <= hot_segments), wanted.where(F.col("k") > hot_segments)
    spans = whole
    if not cold.isEmpty():
        spans = spans.union(block_spans(_segments(docs, cold, doc_id, text, length), length))
    if not hot.isEmpty():
        spans = spans.union(hot_spans(materialize(_segments(docs, hot, doc_id, text, length), "hot"), length))
    return spans


def merged(spans: DataFrame) -> DataFrame:
    """``_id, _h, _b, _e``: each row's spans in order, overlapping and touching ones made one."""
    schema = pa.schema([("_id", pa.int64()), ("_h", pa.int64()), ("_b", pa.list_(pa.int64())), ("_e", pa.list_(pa.int64()))])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begins, ends = [], []
            for b, e in zip(batch.column(2), batch.column(3), strict=True):
                b, e = b.values.to_numpy(), e.values.to_numpy()
                by = np.argsort(b, kind="stable")
                b, reach = b[by], np.maximum.accumulate(e[by])
                cut = np.flatnonzero(b[1:] > reach[:-1])
                begins.append(np.concatenate([b[:1], b[cut + 1]]))
                ends.append(np.concatenate([reach[cut], reach[-1:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(begins, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], schema=schema)

    lists = spans.groupBy("_id", "_h").agg(F.collect_list("b").alias("_b"), F.collect_list("e").alias("_e"))
    return lists.mapInArrow(join, "_id long, _h long, _b array<long>, _e array<long>")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, hot_segments: int = HOT_SEGMENTS, with_bytes: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each row and, if asked,
    ``kept``: the remaining bytes."""
    spans = repeated_spans(docs, doc_id, text, length, hot_segments)
    lists = materialize(merged(spans), "spans")
    size = lists.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("_b")), F.lit(0)).alias("spans")).first()
    lists = lists.select(F.col("_id").alias("_si"), F.col("_h").alias("_sh"), "_b", "_e")
    lists = broadcast_if_small(lists, 3 * size["rows"] + size["spans"], 24)
    d = _texts(docs, doc_id, text).join(lists, (F.col("_id") == F.col("_si")) & (F.col("_h") == F.col("_sh")), "left")
    d = d.select("_id", "_text", "_b", "_e")
    fields = [("_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    fields += [("kept", pa.binary())] * with_bytes
    out = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = []
                for i, t, begins, ends in zip(*(c.to_pylist() for c in batch.slice(at, 200).columns), strict=True):
                    data, kept, done = t.encode("utf-8", "surrogatepass"), [], 0
                    for b, e in zip(begins or (), ends or (), strict=True):
                        kept.append(data[done:b])
                        done = e
                    kept = b"".join([*kept, data[done:]])
                    rows.append((i, len(data), len(data) - len(kept), len(begins or ()), hashlib.sha256(kept).hexdigest(), kept))
                columns = list(zip(*rows, strict=True))[: len(fields)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, out.types, strict=True)], schema=out)

    types = "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    found = d.mapInArrow(cut, types)
    return found.select(public_id().alias("doc_id"), *found.columns[1:])
