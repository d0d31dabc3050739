"""Words of many texts at once, as numpy arrays: where they lie, whose they are, and their hashes.

A hash is a polynomial of the characters modulo 2**64, read off running sums over a block of
text, and mixed with the length. Words of more than LONG characters, for which colliding pairs
can be constructed, are hashed by xxhash instead.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import xxhash

#: Characters hashed at once; a longer word is a block of its own.
BLOCK = 1 << 18
LONG = 200
_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)
_BASE = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S)) * _M1
    h = (h ^ (h >> _S)) * _M2
    return h ^ (h >> _S)


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive hashes."""
    h = hashes[: len(hashes) - n + 1].copy()
    for i in range(1, n):
        h = h * _P + hashes[i : len(hashes) - n + 1 + i]
    return mix(h + np.uint64(n))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each; the common length is kept."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    size = max(BLOCK + 1, n)
    made = [np.multiply.accumulate(np.concatenate((np.ones(1, dtype=np.uint64), np.full(size - 1, x, dtype=np.uint64)))) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    if size == BLOCK + 1:
        _POWERS[:] = made
    return made[0], made[1]


def run_hashes(codes: np.ndarray, value: Callable[[np.ndarray], np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of codes[start:end] for rising starts and ends; value gives an odd 64-bit number per code."""
    out = np.empty(len(starts), dtype=np.uint64)
    lo = 0
    while lo < len(starts):
        a = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, a + BLOCK, side="right")))
        b = int(ends[hi - 1])
        up, down = _powers(b - a + 1)
        sums = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(value(codes[a:b]) * up[: b - a], out=sums[1:])
        x, y = starts[lo:hi] - a, ends[lo:hi] - a
        out[lo:hi] = mix((sums[y] - sums[x]) * down[x] + (y - x).astype(np.uint64) * _P)
        lo = hi
    return out


class SpaceWords:
    """Words parted by ASCII white space, A-Z lower-cased. ``owner`` is the text of each word."""

    def __init__(self, texts: list[str | None]):
        raws = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
        self.bytes = b = np.frombuffer(b"\n".join(raws) + b"\n", dtype=np.uint8)
        inside = np.zeros(len(b) + 1, dtype=np.int8)
        inside[1:] = ~self._are(_SPACE)
        turn = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        begins = np.cumsum([0] + [len(r) + 1 for r in raws])
        self.counts = np.diff(np.searchsorted(self.starts, begins))
        self.owner = np.repeat(np.arange(len(texts)), self.counts)

    def _are(self, which: np.ndarray) -> np.ndarray:
        """Is each byte one of which (by byte value)?"""
        return np.frombuffer(self.bytes.tobytes().translate(which.tobytes()), dtype=bool)

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        out = run_hashes(self.bytes, _BYTES.__getitem__, self.starts, self.ends)
        for i in np.flatnonzero(self.ends - self.starts > LONG):
            out[i] = xxhash.xxh3_64_intdigest(self.bytes[self.starts[i] : self.ends[i]].tobytes())
        return out

    def having(self, which: np.ndarray, words: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Does a word, of all or of those asked for, have a byte of which (by byte value; no white space)?"""
        out = np.zeros(len(self.starts), dtype=bool)
        out[np.searchsorted(self.starts, np.flatnonzero(self._are(which)), side="right") - 1] = True
        return out[words]


@functools.cache
def letters() -> np.ndarray:
    """By code point: is it of the Unicode category L?"""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), dtype=bool, count=0x110000)


def _code_values(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) + _P) | np.uint64(1)


class LetterWords:
    """Words of letters of lower-cased texts. ``owner`` is the text of each word."""

    def __init__(self, texts: list[str | None]):
        lows = [(t or "").lower() for t in texts]
        self.codes = np.frombuffer("\n".join([*lows, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        inside = np.zeros(len(self.codes) + 1, dtype=np.int8)
        inside[1:] = letters()[self.codes]
        turn = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        begins = np.cumsum([0] + [len(t) + 1 for t in lows])
        self.counts = np.diff(np.searchsorted(self.starts, begins))
        self.owner = np.repeat(np.arange(len(texts)), self.counts)

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        return run_hashes(self.codes, _code_values, self.starts, self.ends)

    def grams(self, words: np.ndarray, orders: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, index into words, hash) of the n-grams of the given words. Above single letters a word
        wears boundary marks; one that is shorter than n with them is its own n-gram."""
        lo = 0
        size = self.ends[words] - self.starts[words] + 2
        upto = np.cumsum(size)
        while lo < len(words):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + BLOCK, side="right")))
            part, length = words[lo:hi], size[lo:hi]
            offset = np.cumsum(length) - length
            codes = np.full(int(length.sum()), ord("^"), dtype=np.uint32)
            codes[offset + length - 1] = ord("$")
            inner = length - 2
            step = np.arange(int(inner.sum())) - np.repeat(np.cumsum(inner) - inner, inner)
            codes[np.repeat(offset + 1, inner) + step] = self.codes[np.repeat(self.starts[part], inner) + step]
            for n in orders:
                number = inner if n == 1 else np.maximum(length - n + 1, 1)
                who = np.repeat(np.arange(len(part)), number)
                at = np.arange(len(who)) - np.repeat(np.cumsum(number) - number, number) + offset[who] + (n == 1)
                yield n, who + lo, run_hashes(codes, _code_values, at, np.minimum(at + n, (offset + length)[who]))
            lo = hi


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the counts of each."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts[order], first)


def found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and whether they are there."""
    if not len(table):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Directory:
    """A sorted table of hashes with the places where their leading bits begin, so that most keys take one
    or two comparisons. Hashes are spread evenly; where they are not, a binary search takes over."""

    def __init__(self, table: np.ndarray):
        bits = max(1, len(table).bit_length())
        self.table, self.shift = table, np.uint64(64 - bits)
        self.begins = np.searchsorted(table, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of keys in the table, and whether they are there."""
        if not len(self.table):
            return found(self.table, keys)
        last = len(self.table) - 1
        at = np.minimum(self.begins[keys >> self.shift], last)
        below = np.flatnonzero(self.table[at] < keys)
        for _ in range(6):
            if not len(below):
                break
            at[below] = np.minimum(at[below] + 1, last)
            below = below[(self.table[at[below]] < keys[below]) & (at[below] < last)]
        at[below] = found(self.table, keys[below])[0]
        return at, self.table[at] == keys
