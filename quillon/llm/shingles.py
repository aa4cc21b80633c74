"""Words and word shingles of many texts at once, as 64-bit hashes.

Words are runs of anything but ASCII white space, after lower-casing A-Z. A word's hash is a polynomial over random
64-bit values of its bytes, taken from running sums, so that numpy handles a whole chunk of texts in a few passes; words
beyond LONG bytes, among which texts can be built that share a polynomial modulo 2^64, are hashed by xxhash one by one.
Two different words or shingles share a hash with a probability of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

_RNG = np.random.default_rng(20_240_101)
_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of a word up to which its hash is a polynomial.
LONG = 128
#: Bytes of texts that are handled at once (a longer text by itself).
CHUNK = 1 << 17
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Running sums of a chunk, whose memory is used again: a worker gives the memory of large arrays back to the system at once.
_SUMS = np.zeros(2 * CHUNK, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * CHUNK)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the place of each word."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.zeros(len(b) + 2, bool)
    np.logical_not(_SPACE[b], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(len(b))
    sums = _SUMS[: len(b) + 1] if len(b) < len(_SUMS) else np.empty(len(b) + 1, np.uint64)
    sums[0] = 0
    np.take(_VALUES, b, out=sums[1:], mode="clip")
    np.multiply(sums[1:], up, out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts])
    for k in np.flatnonzero(ends - starts > LONG).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    return hashes, starts


def chunks(texts: Iterable[str | None]) -> Iterator[list[bytes]]:
    """Lowered texts in lists of about CHUNK bytes."""
    held, size = [], 0
    for text in texts:
        held.append(lowered(text))
        size += len(held[-1]) + 1
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _combined(h: np.ndarray, width: int) -> np.ndarray:
    n = len(h) - width + 1
    out = h[:n].copy()
    for k in range(1, width):
        out = mixed(out) + h[k : n + k]
    return mixed(out + np.uint64(width))


def shingle_sets(texts: Iterable[str | None], words: int) -> Iterator[np.ndarray]:
    """For each text the distinct shingles of so many words, in ascending order; of a shorter text its whole sequence as
    one, and none of a text without words."""
    for held in chunks(texts):
        hashes, starts = words_of(b"\n".join(held))
        ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in held]))
        whole = _combined(hashes, words) if len(hashes) >= words else np.zeros(0, np.uint64)
        first = 0
        for end in ends.tolist():
            n = end - first
            if n >= words:
                yield np.unique(whole[first : end - words + 1])
            elif n:
                yield _combined(hashes[first:end], n)
            else:
                yield np.zeros(0, np.uint64)
            first = end


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return next(shingle_sets([text], words))


def signature(shingles: np.ndarray) -> bytes:
    """128 bits of a whole set."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


class Frequencies:
    """Counts of the most frequent hashes. Hashes are spread evenly, so their leading bits find the few that one can equal."""

    #: Leading bits that are looked up: two places or more for each of the 2^19 hashes that callers take at most.
    LEADING = 20

    def __init__(self, values: np.ndarray, counts: np.ndarray) -> None:
        self.values, self.counts = values, counts
        sizes = np.bincount((values >> np.uint64(64 - self.LEADING)).astype(np.int64), minlength=1 << self.LEADING)
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)

    def of(self, hashes: np.ndarray, absent: int = 0) -> np.ndarray:
        out = np.full(len(hashes), absent, np.int64)
        leading = (hashes >> np.uint64(64 - self.LEADING)).astype(np.int64)
        at, end = self.first[leading], self.first[leading + 1]
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            same = self.values[at] == hashes[left]
            out[left[same]] = self.counts[at[same]]
            at = at + 1
            more = ~same & (at < end)
            left, at, end = left[more], at[more], end[more]
        return out
