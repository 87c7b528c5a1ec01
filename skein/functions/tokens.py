"""Words and n-grams of whole Arrow batches as 64-bit hashes, in numpy.

A batch of texts is one run of UTF-8 bytes with offsets. Its words are found and
hashed all at once: with a random 64-bit value for each byte and powers of an odd
number, a running sum gives the hash of any stretch of bytes as a difference,
shifted to a common place by the inverse power. The hash of a word depends on its
bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np

BLOCK = 1 << 18  # bytes of text handled at once; a longer text is a block of its own
KEPT = 1 << 21  # bytes for which powers are kept
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least. Those of ``KEPT`` at most are kept, longer ones are made for their text."""
    if _powers and len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    size = max(n, 2 * BLOCK)
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.ones(size, np.uint64)
        step, known = base, 1
        while known < size:  # doubles what is known
            m = min(known, size - known)
            with np.errstate(over="ignore"):
                p[known : known + m] = p[:m] * np.uint64(step)
            known, step = known + m, step * step & _MASK
        out.append(p)
    if size <= KEPT:
        _powers[:] = out
    return out[0], out[1]


BYTE_VALUE = np.random.default_rng(20240117).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of letters, digits and whatever isn't ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads a 64-bit hash over all its bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def blocks(texts, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows and the end) over a pyarrow string array; nulls are empty."""
    import pyarrow as pa

    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if offs is not None else np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        hi = min(hi, len(texts))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Words:
    """Words of a block: ``start`` and ``end`` bytes, ``bounds`` of the rows in them, ``hash``."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, member: np.ndarray = NOT_SPACE):
        n = len(data)
        raw = data.tobytes()
        low = np.frombuffer(raw.translate(LOWER.tobytes()), np.uint8)
        inside = np.frombuffer(raw.translate(member.tobytes()), bool)
        before, after = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[1:], before[0] = inside[:-1], False
            after[:-1], after[-1] = inside[1:], False
            cut = offs[1:-1]
            before[cut[cut < n]] = False
            after[cut[cut > 0] - 1] = False
        self.low, self.offs, self._inside = low, offs, inside
        self.start, self.end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.start, offs)
        power, self._inverse = _tables(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            value = BYTE_VALUE.take(low)
            value *= power[:n]
            np.cumsum(value, out=self._sums[1:])

    @cached_property
    def hash(self) -> np.ndarray:
        return self.stretch(self.start, self.end)

    def sums(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A number of the bytes in [start, end), lower-cased, whose high bits alone are spread."""
        with np.errstate(over="ignore"):
            return (self._sums[end] - self._sums[start]) * self._inverse[start]

    def so_far(self, most: int, factor: np.uint64) -> np.ndarray:
        """For each byte ``factor`` times ``sums`` of its word before it, of the last ``most`` bytes; 0 where none is before it."""
        n = len(self._inside)
        each = np.diff(self.start, prepend=0, append=n)
        with np.errstate(over="ignore"):
            out = self._sums[:n] - np.repeat(np.append(np.uint64(0), self._sums[self.start]), each)
            out *= np.repeat(np.append(factor, self._inverse[self.start] * factor), each)
            long = np.flatnonzero(self.end - self.start > most)
            for lo, hi in zip(self.start[long] + most + 1, np.minimum(self.end[long] + 1, n), strict=True):
                out[lo:hi] = self.sums(np.arange(lo, hi) - most, np.arange(lo, hi)) * factor
        none = np.empty(n, bool)
        np.logical_not(self._inside[:-1], out=none[1:])
        none[:1] = True
        none[self.offs[:-1][self.offs[:-1] < n]] = True
        out[none] = 0
        return out

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes in [start, end), lower-cased."""
        return mix(self.sums(start, end))


_STEP = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(64)]


def shingles(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of the runs of n words of each row; a row with fewer words has its whole sequence as one, without words none."""
    count = np.diff(bounds)
    if len(hashes) >= n:
        with np.errstate(over="ignore"):
            run = hashes[: len(hashes) - n + 1] * _STEP[0]
            for k in range(1, n):
                run = run + hashes[k : len(hashes) - n + 1 + k] * _STEP[k]
        run = mix(run)
    else:
        run = np.zeros(0, np.uint64)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(made)])
    first = np.repeat(bounds[:-1], made) + np.arange(out_bounds[-1]) - np.repeat(out_bounds[:-1], made)
    out = run[np.minimum(first, max(len(run) - 1, 0))] if len(run) else np.zeros(len(first), np.uint64)
    for row in np.flatnonzero((count > 0) & (count < n)):
        h = np.uint64(count[row])
        with np.errstate(over="ignore"):
            for k, w in enumerate(hashes[bounds[row] : bounds[row + 1]]):
                h = h + w * _STEP[k + n]
        out[out_bounds[row]] = mix(np.array([h]))[0]
    return out, out_bounds
