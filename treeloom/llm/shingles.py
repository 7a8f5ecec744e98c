"""Vectorised hashing of word shingles: 64-bit hashes of whole texts with numpy.

Words are maximal runs of bytes outside space and U+0009 to U+000D, A-Z lowered.
A word of up to seven bytes is told apart by its bytes and length in one 64-bit
integer, which a bijection mixes, so such words never collide; a longer word is
hashed by BLAKE2b. A shingle's hash chains five words, mixed after each.

Texts are hashed in pieces of bounded size that end between words, so the arrays in
use do not grow with a text; what grows is its set.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np

WIDTH = 5
#: Bytes hashed at once.
CHUNK = 1 << 20
#: Longer words that a worker remembers, and their greatest length.
REMEMBER = 1 << 18
MEMORABLE = 64

_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BREAK = re.compile(rb"[\x20\x09-\x0d]")
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)], dtype=np.uint64)
_known: dict[bytes, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser with full avalanche."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _long_word(word: bytes) -> int:
    found = _known.get(word)
    if found is None:
        found = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= MEMORABLE:
            if len(_known) >= REMEMBER:
                _known.clear()
            _known[word] = found
    return found


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in turn, and the number of words of each text."""
    raw = (b"\n".join(texts) + b"\n" + bytes(8)).lower()  # of bytes: A-Z alone
    data = np.frombuffer(raw, dtype=np.uint8)[:-8]
    space = _SPACE[data]
    inside = ~space
    first = inside.copy()
    first[1:] &= space[:-1]
    begin = np.flatnonzero(first)
    last = np.zeros_like(inside)
    last[1:] = space[1:] & inside[:-1]
    end = np.flatnonzero(last)
    size = end - begin
    eight = np.ndarray(len(data), dtype="<u8", buffer=raw, strides=(1,))  # the eight bytes from each place
    short = np.minimum(size, 7)
    with np.errstate(over="ignore"):
        hashes = mix((eight[begin] & _MASKS[short]) | (short.astype(np.uint64) << np.uint64(56)))
    big = np.flatnonzero(size > 7)
    if len(big):
        hashes[big] = np.fromiter((_long_word(raw[x:y]) for x, y in zip(begin[big].tolist(), end[big].tolist(), strict=True)), dtype=np.uint64, count=len(big))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(begin, bounds), prepend=0)


def _chained(hashes: np.ndarray, width: int) -> np.ndarray:
    n = max(len(hashes) - width + 1, 0)
    chained = np.full(n, width, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            chained = mix(chained * _STEP + hashes[k : k + n])
    return chained


def pieces(data: bytes, size: int) -> Iterator[bytes]:
    """``data`` cut between words, into pieces of about ``size`` bytes (a longer word stays whole)."""
    at = 0
    while len(data) - at > size:
        cut = _BREAK.search(data, at + size)
        if cut is None:
            break
        yield data[at : cut.start()]
        at = cut.start()
    yield data[at:]


def _long_set(data: bytes, width: int) -> np.ndarray:
    """The set of a text over ``CHUNK`` bytes, piece by piece."""
    tail, found, held, many = np.empty(0, np.uint64), [], 0, 1 << 18
    for piece in pieces(data, CHUNK):
        tail = np.concatenate([tail, word_hashes([piece])[0]])
        if len(tail) >= width:
            found.append(np.unique(_chained(tail, width)))
            held += len(found[-1])
            tail = tail[1 - width :]
            if held > many:  # merge when the set may have doubled
                found = [np.unique(np.concatenate(found))]
                held, many = len(found[0]), max(1 << 18, 2 * len(found[0]))
    if not found:
        return _chained(tail, len(tail)) if len(tail) else tail
    return np.unique(np.concatenate(found))


def shingle_sets(texts: Iterable[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes; a shorter text is one
    shingle, a text without words none."""
    held: list[bytes] = []
    size = 0
    for t in texts:
        data = t.encode("utf-8", "surrogatepass") if t else b""
        if held and size + len(data) > CHUNK:
            yield from _small_sets(held, width)
            held, size = [], 0
        if len(data) > CHUNK:
            yield _long_set(data, width)
            continue
        held.append(data)
        size += len(data)
    if held:
        yield from _small_sets(held, width)


def _small_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    hashes, counts = word_hashes(texts)
    chained, at = _chained(hashes, width), 0
    for c in counts:
        if c >= width:
            yield np.unique(chained[at : at + c - width + 1])
        elif c:
            yield _chained(hashes[at : at + c], int(c))
        else:
            yield np.empty(0, dtype=np.uint64)
        at += c
