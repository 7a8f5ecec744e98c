"""Numpy kernels of repeated-byte removal: content-chosen anchors, and common
prefixes by breadth-first interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .shingles import mix

GRAM = 32
#: Starts handled at once; positions inside a piece fit 24 bits.
PIECE = 1 << 20

_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_BASE_INVERSE = np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))
_PLACE = np.uint64((1 << 24) - 1)
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers modulo 2^64; those for a piece are kept."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE + 1024), base, dtype=np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[int(base)] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def _spans(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of [begin, end) from prefix sums, independent of the place."""
    return mix((prefix[end] - prefix[begin]) * powers(_BASE_INVERSE, len(prefix))[begin] + (end - begin).astype(np.uint64))


def anchors(data: bytes, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of window starts that choose the same anchor: arrays ``lo, hi`` (first
    and last start), ``anchor`` hash, ``segment`` hash and the anchor's place, piece by piece.

    A window of ``length`` bytes chooses its ``GRAM``-byte gram of least hash, the
    leftmost of equals, so equal windows choose equal anchors at equal offsets.
    The segment hash covers all bytes of the run's windows and the anchor's offset."""
    width = length - GRAM + 1
    for at in range(0, len(data) - length + 1, PIECE):
        part = np.frombuffer(data, dtype=np.uint8, count=min(PIECE + length - 1, len(data) - at), offset=at)
        with np.errstate(over="ignore"):
            prefix = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(part)), out=prefix[1:])
            n = len(part) - GRAM + 1
            grams = mix((prefix[GRAM:] - prefix[:n]) * powers(_BASE_INVERSE, n))
            least = (grams & ~_PLACE) | np.arange(n, dtype=np.uint64)
            span = 1
            while 2 * span <= width:
                least = np.minimum(least[: len(least) - span], least[span:])
                span *= 2
            if span < width:
                least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
            place = (least & _PLACE).astype(np.int64)
            lo = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
            hi = np.concatenate([lo[1:] - 1, [len(place) - 1]])
            anchor = place[lo]
            segment = mix(_spans(prefix, lo, hi + length) ^ (anchor - lo).astype(np.uint64))
        yield lo + at, hi + at, grams[anchor], segment, anchor + at


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of small non-negative integers that differ pairwise (each
    segment ends in a separator of its own), by prefix doubling from four symbols on.
    A round sorts (rank, rank of the second half, place) packed into one word."""
    n = len(text)
    bits = np.uint64(max(int(n).bit_length(), 1))
    if 3 * int(bits) > 64:
        raise ValueError("a block may hold 2 million symbols")
    size = int(text.max()) + 2
    first = np.zeros(n + 3, dtype=np.int64)
    first[:n] = text + 1
    span = 1
    key = first[:n]
    while span < 4 and (int(key.max()) + 1) * (size + 1) < 1 << (62 - int(bits)):
        key = key * size + first[span : n + span]
        span += 1
    if span == 3:  # the doubling below needs a power of two
        key, span = first[:n] * size + first[1 : n + 1], 2
    place = np.arange(n, dtype=np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    packed = (key.astype(np.uint64) << bits) | place
    while True:
        packed.sort()
        order = (packed & mask).astype(np.int64)
        high = packed >> bits
        fresh = np.zeros(n, dtype=np.int64)
        np.not_equal(high[1:], high[:-1], out=fresh[1:], casting="unsafe")
        ranks = np.cumsum(fresh)
        if ranks[-1] == n - 1:
            return order
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = ranks
        second = np.zeros(n, dtype=np.uint64)
        second[: n - span] = rank[span:] + np.uint64(1)
        packed = (((rank << bits) | second) << bits) | place
        span *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each place j of the suffix order whether suffixes j - 1 and j share at
    least ``least`` symbols.

    Breadth-first: an interval of the order holds the suffixes that begin with one
    string; the transform's symbols in it extend the string to the left, each to an
    interval of its own. Level by level, an interval's end that has no value yet gets
    the level as its common prefix; only such intervals are expanded further. After
    ``least`` levels the ends without a value are those that share ``least`` or more."""
    n = len(text)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    step = place[order - 1]  # the transform: where the suffix one symbol longer stands
    front = text[order].astype(np.int32)
    value = np.zeros(n + 1, dtype=bool)
    value[n] = True
    lo, hi = np.zeros(1, dtype=np.int64), np.full(1, n - 1, dtype=np.int64)
    for _ in range(least):
        if not len(lo):
            break
        width = hi - lo + 1
        starts = np.cumsum(width) - width
        inside = np.repeat(lo - starts, width) + np.arange(width.sum())
        owner = np.repeat(np.arange(len(lo)), width)
        packed = (step[inside].astype(np.uint64) << np.uint64(32)) | owner.astype(np.uint64)
        packed.sort()
        to = (packed >> np.uint64(32)).astype(np.int64)
        owner = (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
        symbol = front[to]
        cut = np.flatnonzero((owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut - 1, [len(to) - 1]])
        new = ~value[to[last] + 1]
        value[to[last] + 1] = True
        lo, hi = to[first[new]], to[last[new]]
    return ~value[:n]


def repeated_starts(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment the starts whose ``length`` bytes occur at another start of
    any of them."""
    sizes = np.array([len(s) for s in segments])
    ends = np.cumsum(sizes + 1)
    text = np.frombuffer(b"\0".join(segments) + b"\0", dtype=np.uint8).astype(np.int64) + len(segments)
    text[ends - 1] = np.arange(len(segments))
    order = suffix_array(text)
    shared = common_prefixes(text, order, length)
    shared[0] = False
    either = shared.copy()
    either[:-1] |= shared[1:]
    found = np.zeros(len(text), dtype=bool)
    found[order[either]] = True
    return [np.flatnonzero(found[e - n - 1 : e - 1]) for e, n in zip(ends, sizes, strict=True)]
