"""Vectorised text primitives shared by the corpus operators.

Everything here works on a whole Arrow batch at once: the texts of a batch are
laid end to end as one array of code points, and words, hashes and suffix ranks
are computed by array arithmetic, never by a loop over characters.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(is a word character, lower-case code point) for every code point."""
    n = 0x110000
    word, lower = np.zeros(n, bool), np.arange(n, dtype=np.uint32)
    for c in range(n):
        if 0xD800 <= c <= 0xDFFF:
            continue
        s = chr(c)
        word[c] = s.isalnum() or s == "_"
        low = s.lower()
        if low != s and len(low) == 1:
            lower[c] = ord(low)
    return word, lower


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    up[1:], down[1:] = _BASE, _INVERSE
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points end to end, and where each text begins (one more than texts)."""
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer(joined, np.uint32), starts


class Words:
    """The words of a batch: maximal runs of letters, digits and underscores, lower-cased.

    ``start``/``end``: code point offsets in the batch; ``hash``: 64-bit hash of the
    lower-cased word; ``first``: index of each text's first word (one more than texts);
    ``doc``: the text of each word; ``base``: code point offset of each text.
    """

    def __init__(self, texts: list[str], hashes: bool = True):
        cp, self.base = codepoints(texts)
        word, lower = _tables()
        inside = np.zeros(len(cp) + 1, np.int8)
        inside[:-1] = word[cp]
        step = np.empty(len(cp) + 1, np.int8)
        step[0] = inside[0]
        np.subtract(inside[1:], inside[:-1], out=step[1:])
        # words end where their text ends, whatever the next text begins with
        cuts = self.base[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(cp))]
        cuts = cuts[np.append(True, cuts[1:] != cuts[:-1])] if len(cuts) else cuts
        glued = cuts[(inside[cuts - 1] == 1) & (inside[cuts] == 1)]
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if len(glued):
            start, end = np.sort(np.append(start, glued)), np.sort(np.append(end, glued))
        self.cp, self.start, self.end = cp, start, end
        self.first = np.searchsorted(start, self.base)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hash = self._hash(lower) if hashes else None

    def _hash(self, lower: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        step = 1 << 20
        with np.errstate(over="ignore"):
            lo = 0
            while lo < len(self.start):
                # a block of whole words, so that tables of powers stay small
                hi = max(lo + 1, int(np.searchsorted(self.end, self.start[lo] + step, "right")))
                a, b = int(self.start[lo]), int(self.end[hi - 1])
                up, down = _powers(1 << max(20, int(b - a).bit_length()))
                sums = np.zeros(b - a + 1, np.uint64)
                np.cumsum((lower[self.cp[a:b]].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=sums[1:])
                s, e = self.start[lo:hi] - a, self.end[lo:hi] - a
                h = (sums[e] - sums[s]) * down[s]
                out[lo:hi] = h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                lo = hi
        return mix(out)


def word_hash(word: str) -> int:
    return int(Words([word]).hash[0])


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within one text, and the index of each run's first word."""
    n = len(words.hash)
    if n < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            h *= np.uint64(0x100000001B3)
            h += words.hash[j : n - k + 1 + j]
            h ^= h >> np.uint64(29)
    at = np.flatnonzero(words.doc[: n - k + 1] == words.doc[k - 1 :])
    return mix(h[at]), at


def lazily(column) -> Iterator:
    """The values of an Arrow column, made a few at a time."""
    for k in range(0, len(column), 256):
        yield from column.slice(k, 256).to_pylist()


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def release() -> None:
    """Gives freed memory back: workers stay alive between tasks, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def bounded(ids: Iterable, texts: Iterable[str | None], limit: int) -> Iterator[tuple[list, list[str]]]:
    """Runs of whole texts with about ``limit`` code points; a longer text comes alone. Null is ''."""
    some: tuple[list, list[str]] = ([], [])
    size = 0
    for i, t in zip(ids, texts):
        t = t or ""
        if some[0] and size + len(t) > limit:
            yield some
            some, size = ([], []), 0
        some[0].append(i)
        some[1].append(t)
        size += len(t)
    if some[0]:
        yield some
    some = ([], [])
    release()


def _pack(hi: np.ndarray, lo: np.ndarray, n: int) -> np.ndarray | None:
    """(hi, lo, index) in one 64-bit word if it fits; plain sorts of such words are the fastest there are."""
    bits = max(1, int(n - 1).bit_length())
    wide = max(1, int(max(hi.max(initial=0), lo.max(initial=0))).bit_length())
    return None if 2 * wide + bits > 63 else (hi << (wide + bits)) | (lo << bits) | np.arange(n, dtype=np.int64)


def _argsort2(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Order by (hi, lo), ties by index."""
    n = len(hi)
    packed = _pack(hi, lo, n)
    if packed is None:
        return np.lexsort((lo, hi))
    packed.sort()
    return packed & ((1 << max(1, int(n - 1).bit_length())) - 1)


def suffix_ranks(symbols: np.ndarray, doc: np.ndarray, ends: np.ndarray, separate: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Prefix doubling over many texts at once.

    ``symbols``: non-negative ints; ``doc``: text of each position; ``ends``: end of each
    position's text. A suffix ends with its text, and ends sort first, earlier texts before
    later ones. ``separate``: each text's suffixes are ranked only among themselves.

    Yields, for depths d that double, (d, ranks, order, open): ``ranks`` are equal exactly for
    suffixes that share their first d symbols, and are places in the sorted order; ``open``:
    positions whose rank is shared. The last one is the suffix array. Later rounds sort only
    open positions.
    """
    n = len(symbols)
    if n == 0:
        return
    width = max(1, int(symbols.max() + 1).bit_length())
    top = max(1, int(doc.max()).bit_length()) if separate else 0
    depth = max(1, (62 - top) // width)
    depth = 1 << (depth.bit_length() - 1)
    key = symbols.astype(np.int64) + 1
    done = 1
    left = ends - np.arange(n)
    while done < depth:
        nxt = np.zeros(n, np.int64)
        nxt[: max(0, n - done)] = key[done:]
        nxt[left <= done] = 0
        key = (key << (width * done)) | nxt
        done *= 2
    if separate:
        key |= doc.astype(np.int64) << (width * depth)
    order = np.argsort(key)
    s = key[order]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    del key, s
    while True:
        alone = new & np.append(new[1:], True)
        places = np.flatnonzero(~alone)
        # a whole suffix that is no longer than the depth is told from its equals by its text
        yield depth, rank, order, order[places]
        if not len(places):
            return
        at = order[places]
        nxt = np.full(len(at), -1, np.int64)
        inside = left[at] > depth
        nxt[inside] = rank[at[inside] + depth]
        nxt[~inside] = -1
        over = ~inside
        if over.any():
            nxt[over] = doc[at[over]] - int(doc.max()) - 1
        nxt -= nxt.min()
        hi = group[places]
        perm = _argsort2(hi - hi.min(), nxt)
        at, hi, nxt = at[perm], hi[perm], nxt[perm]
        order[places] = at
        fresh = np.empty(len(at), bool)
        fresh[0] = True
        fresh[1:] = (hi[1:] != hi[:-1]) | (nxt[1:] != nxt[:-1])
        new[places] = fresh
        group[places] = np.maximum.accumulate(np.where(fresh, places, 0))
        rank = rank.copy()
        rank[at] = group[places]
        depth *= 2
