"""LM scoring with Brown's class-based bigrams.

P(w | v) = P(class(w) | class(v)) * P(w | class(w)); a text begins after a boundary that has a
class of its own. Words are the lower-cased runs of letters, digits and underscores.

Every word of the corpus has a count, a class and an emission of its own. Words are dealt by
their hash to parts, whose number follows the corpus; a batch of texts asks the parts for its
words by a shuffle, and no table of words is broadcast or collected. A word's number is its part
and its place there, frequent words first. There are ``CLASSES`` classes at any size.

Each part tells each other part of classes, a row for every two parts. So beyond ``_FEW`` parts
their number grows as the root of the corpus, and the rows in proportion to it, until a part has
as much text as memory allows: ``_MOST`` times ``_SHARE`` words. From there parts are as many more
as the corpus is larger.

Classes come from the exchange algorithm: each word moves to the class that raises the likelihood
of the corpus most, exactly reckoned against the class counts at hand. A pass visits the parts in
parallel against the same class counts; within a part frequent words go one by one, rare ones
``_TOGETHER`` at a time. After a pass the counts are made anew, and the best assignment so far is
kept. After ``_FREE`` passes a word may move only if a hash of it and the pass allows, which it
does for one in two: so words that would change places with each other don't, and passes go on
raising the likelihood however many parts there are.

Transitions are smoothed towards the class frequencies (weight ``PRIOR``), emissions by
``ADD`` for each word.

Defined results: a null or empty text, or one without words, has 0 words, log probability 0 and
a null perplexity; all texts are read whole; repeated rows count, and are scored, each; ties of
frequency fall to the smaller hash, ties of gain to the present class, then the smallest; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import cleared, fresh, kept_names, own, quoted, written
from .textops import Words, bounded, lazily, mix

#: Production parameters.
CLASSES, PASSES, PRIOR, ADD = 64, 5, 50.0, 0.5
#: Characters taken to words at once; words of a batch of texts; words of text for each part.
_BLOCK, _BATCH, _SHARE = 1_000_000, 2_000_000, 1_000_000
#: Parts beyond which their share grows; what it grows to, in _SHARE; pairs added up at once.
_FEW, _MOST, _UNITED = 48, 6, 1_000_000
#: Tasks of a shuffle at most; a task goes through its parts one by one.
_TASKS = 20_000
#: Words that stand more often are visited one by one; others so many together, in chunks of places.
_OFTEN, _TOGETHER, _CHUNK = 1_000, 1_000, 10_000
#: Passes in which all words may move; counts up to which gains are looked up.
_FREE, _SMALL = 2, 12

_KEYED = "part bigint, side bigint, blob binary"
_OWN, _ROWS = -1, -2


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))) if x.dtype.kind in "iu" else x


@cache
def _packer():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _dump(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from 0: no wider than they must be, byte place by byte place, compressed."""
    held = []
    for x in map(_narrow, arrays):
        held.append((x.dtype.str, x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()))
    return _packer()[0].compress(pickle.dumps(held, pickle.HIGHEST_PROTOCOL))


def _load(blob: bytes) -> list[np.ndarray]:
    out = []
    for kind, raw in pickle.loads(_packer()[1].decompress(blob)):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel())
    return out


def _wide(blob: bytes) -> list[np.ndarray]:
    return [x.astype(np.int64) for x in _load(blob)]


def _lean(blob: bytes) -> list[np.ndarray]:
    """Of 32 bits at most, or signed: what may be joined with others and counted."""
    return [x.astype(np.int64) if x.itemsize == 8 else x for x in _load(blob)]


def _along(steps: np.ndarray) -> np.ndarray:
    """The ascending numbers that the steps lead to."""
    x = np.cumsum(steps, dtype=np.int64)
    return x if len(x) and x[-1] >> 32 else x.astype(np.uint32)


def _rows(part: list, side: list, blob: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(side, pa.int64()), pa.array(blob, pa.binary())], ["part", "side", "blob"])


def _parts(words: int) -> int:
    share = min(max(_SHARE, math.isqrt(words * _SHARE // _FEW)), _MOST * _SHARE)
    return max(4, -(-words // share))


def _by_part(rows: DataFrame, parts: int, each, kind: str = _KEYED, in_turn: bool = True) -> DataFrame:
    """each(part, [(side, blob)]) for every part, all of whose rows come together. in_turn: parts
    are numbered from 0, and go to tasks in turn; others by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, some = None, []
        for batch in batches:
            for part, side, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "side", "blob"))):
                if part != now:
                    if some:
                        yield from each(now, some)
                    now, some = part, []
                some.append((side, blob))
        if some:
            yield from each(now, some)

    tasks = max(1, min(parts, _TASKS))
    dealt = rows.repartitionById(tasks, (F.col("part") % tasks).cast("int")) if in_turn else rows.repartition(tasks, "part")
    return dealt.sortWithinPartitions("part").mapInArrow(run, kind)


def _each_row(rows: DataFrame, each, kind: str = _KEYED) -> DataFrame:
    """each(part, side, blob) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from each(*(batch.column(c)[k].as_py() for c in ("part", "side", "blob")))

    return rows.select("part", "side", "blob").mapInArrow(run, kind)


def _split(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by part, and where each part's begin in it (one more than parts)."""
    order = np.argsort(part, kind="stable")
    return order, np.append(0, np.cumsum(np.bincount(part, minlength=parts)))


def _dealt(cut: np.ndarray, side, arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row for each part that has some of the arrays, which are in the order of parts."""
    some = np.flatnonzero(np.diff(cut))
    for lo in range(0, len(some), 1_000):
        few = some[lo : lo + 1_000].tolist()
        yield _rows(few, [side] * len(few), [_dump(*[x[cut[p] : cut[p + 1]] for x in arrays]) for p in few])


def _steps(x: np.ndarray) -> np.ndarray:
    """Steps between ascending numbers."""
    return np.diff(x, prepend=0)


# -- texts, words and pairs -------------------------------------------------------------------


def _batches(docs: DataFrame, text: str, only: list[str]) -> DataFrame:
    """By batch of texts. side _OWN: texts' numbers of words, the words as places among the batch's
    distinct ones, frequent ones first, and the hashes of those; _ROWS: the rows. n: words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        held: list[pa.RecordBatch] = []
        sizes: list[np.ndarray] = []
        hashes: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            coded = pa.array(np.concatenate(hashes)).dictionary_encode()
            h, at = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(-np.bincount(at, minlength=len(h)), kind="stable")
            place = np.empty(len(h), np.int64)
            place[order] = np.arange(len(h))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                for b in held:
                    stream.write_batch(b)
            blobs = [_dump(np.concatenate(sizes), place[at], h[order]), sink.getvalue().to_pybytes()]
            row = [pa.array([number] * 2, pa.int64()), pa.array([_OWN, _ROWS], pa.int64()), pa.array(blobs, pa.binary()), pa.array([len(at), 0], pa.int64())]
            return pa.RecordBatch.from_arrays(row, ["part", "side", "blob", "n"])

        words = 0
        for batch in batches:
            rest = batch.drop_columns([batch.schema.names[0]])
            for ids, some in bounded(range(batch.num_rows), lazily(batch.column(0)), _BLOCK):
                w = Words(some)
                if held and words + len(w.hash) > _BATCH:
                    yield out()
                    number, words = number + 1, 0
                    held.clear(), sizes.clear(), hashes.clear()
                held.append(rest.slice(ids[0], len(ids)))
                sizes.append(np.diff(w.first))
                hashes.append(w.hash)
                words += len(w.hash)
        if held:
            yield out()

    texts = docs.select(F.col(quoted(text)).alias("text_of_words"), *[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(only)])
    return texts.mapInArrow(cut, _KEYED + ", n bigint")


def _named(batches: DataFrame, parts: int) -> DataFrame:
    """By part. side _OWN: hashes and counts of the part's words, by place. Other sides: the places
    of a batch's words of the part."""

    def ask(batch: int, _: int, blob: bytes) -> Iterator[pa.RecordBatch]:
        _, at, h = _load(blob)
        order, cut = _split((h % np.uint64(parts)).astype(np.int64), parts)
        yield from _dealt(cut, batch, [h[order], np.bincount(at, minlength=len(h))[order]])

    def name(part: int, some: list) -> Iterator[pa.RecordBatch]:
        held = [(batch, *_load(blob)) for batch, blob in some]
        k, at = np.unique(np.concatenate([h for _, h, _ in held]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n for *_, n in held])).astype(np.int64)
        order = np.argsort(-n, kind="stable")
        place = np.empty(len(k), np.int64)
        place[order] = np.arange(len(k))
        yield _rows([part], [_OWN], [_dump(k[order], n[order])])
        lo = 0
        for batch, h, _ in held:
            yield _rows([part], [batch], [_dump(place[at[lo : lo + len(h)]])])
            lo += len(h)

    return _by_part(_each_row(batches.where(f"side = {_OWN}"), ask), parts, name)


def _answered(batches: DataFrame, count: int, answers: DataFrame, parts: int, each, kind: str) -> DataFrame:
    """each(numbers of words, the words as places, [part], [an answer's arrays for the batch's
    words], rows) for every batch. answers: by part, side the batch."""
    turned = answers.where("side >= 0").select(F.col("side").alias("part"), F.col("part").alias("side"), "blob")

    def run(_: int, some: list) -> Iterator[pa.RecordBatch]:
        of = dict(some)
        size, at, h = _load(of[_OWN])
        part = (h % np.uint64(parts)).astype(np.int64)
        order, cut = _split(part, parts)
        got: list[np.ndarray] = []
        for p, blob in some:
            if p >= 0:
                for k, x in enumerate(_load(blob)):
                    if k == len(got):
                        got.append(np.zeros(len(h), np.int64))
                    got[k][order[cut[p] : cut[p + 1]]] = x
        yield from each(size.astype(np.int64), at.astype(np.int64), part, got, of.get(_ROWS))

    return _by_part(batches.select("part", "side", "blob").union(turned), count, run, kind, in_turn=False)


def _before(now: np.ndarray, size: np.ndarray, boundary: int) -> np.ndarray:
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[(np.cumsum(size) - size)[size > 0]] = boundary
    return before


def _followers(batches: DataFrame, count: int, named: DataFrame, parts: int) -> DataFrame:
    """By part of the first word: steps of its place, part and place of the word that follows, how
    often. Of the boundary, which stands before each text's first word, by the part after the last."""

    def pairs(size, at, part, got, _) -> Iterator[pa.RecordBatch]:
        if not len(at):
            return
        order = np.lexsort((got[0], part))
        new = np.empty(len(order), np.int64)
        new[order] = np.arange(len(order))
        part, place, width = part[order], got[0][order], len(order) + 1
        now = new[at]
        k = _before(now, size, len(order)) * width + now
        k.sort()
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        n = np.diff(np.append(first, len(k)))
        a, b = np.divmod(k[first], width)
        edge = np.searchsorted(a, np.append(np.searchsorted(part, np.arange(parts + 1)), len(order) + 1))
        place = np.append(place, 0)
        some = np.flatnonzero(np.diff(edge)).tolist()
        for lo in range(0, len(some), 1_000):
            few = some[lo : lo + 1_000]
            yield _rows(few, [0] * len(few), [_dump(_steps(place[a[x:y]]), part[b[x:y]], place[b[x:y]], n[x:y]) for x, y in ((edge[p], edge[p + 1]) for p in few)])

    def merge(part: int, some: list) -> Iterator[pa.RecordBatch]:
        yield _rows([part], [0], [_linked(*_gathered(_placed(blob) for _, blob in some))])

    return _by_part(_answered(batches.where(f"side = {_OWN}"), count, named, parts, pairs, _KEYED), parts + 1, merge)


def _placed(blob: bytes) -> list[np.ndarray]:
    """Place, other part, other place, how often."""
    steps, *rest = _lean(blob)
    return [_along(steps), *rest]


def _gathered(pairs: Iterator[list[np.ndarray]]) -> list[np.ndarray]:
    """Equal pairs summed, of any number of lists by place. They are united whenever as many again
    have come, so what is held follows the different pairs, and not how often they come."""
    held, size, bound = [], 0, 4 * _UNITED
    for x in pairs:
        held.append(x)
        size += len(x[0])
        if size > bound:
            held = [_united(held)]
            size = len(held[0][0])
            bound = max(4 * _UNITED, 2 * size)
    return _united(held)


def _united(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Equal pairs summed; by place, other part and other place. A run of places at a time."""
    total = np.zeros(1 + max((int(x[0][-1]) for x in held if len(x[0])), default=0), np.int64)
    for x in held:
        of = np.bincount(x[0])
        total[: len(of)] += of
    total = np.cumsum(total)
    edge = np.unique(np.concatenate([[0], np.searchsorted(total, np.arange(_UNITED, total[-1], _UNITED)), [len(total)]]))
    cuts = [np.searchsorted(x[0], edge.astype(x[0].dtype)) for x in held]
    runs = [_summed(*(np.concatenate([x[k][c[j] : c[j + 1]] for x, c in zip(held, cuts)]) for k in range(4))) for j in range(len(edge) - 1)]
    return [np.concatenate(x) for x in zip(*runs)]


def _summed(a: np.ndarray, p: np.ndarray, b: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    least = int(a.min()) if len(a) else 0
    top, high, low = int(a.max(initial=0)) - least + 1, int(p.max(initial=0)) + 1, int(b.max(initial=0)) + 1
    kinds = a.dtype, p.dtype, b.dtype
    if top * high * low < 1 << 62:
        key = a.astype(np.int64)
        key -= least
        key *= high
        key += p
        key *= low
        key += b
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        a, b = np.divmod(key[first], high * low)
        a += least
        p, b = np.divmod(b, low)
    else:
        order = np.lexsort((b, p, a))
        a, p, b = a[order], p[order], b[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (p[1:] != p[:-1]) | (b[1:] != b[:-1])))
        a, p, b = a[first], p[first], b[first]
    n = n[order].astype(np.int64)
    n = np.add.reduceat(n, first) if len(first) else n
    return [*(x.astype(kind) for x, kind in zip((a, p, b), kinds)), n if n.max(initial=0) >> 32 else n.astype(np.uint32)]


def _linked(a: np.ndarray, p: np.ndarray, b: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs by place: steps of places, which of the distinct others, how often; the others' parts and places."""
    low = int(b.max(initial=0)) + 1
    coded = pa.array(p.astype(np.int64) * low + b).dictionary_encode()
    other, at = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(other)
    number = np.empty(len(other), np.uint32)
    number[order] = np.arange(len(other))
    p, b = np.divmod(other[order], low)
    return _dump(_steps(a), number[at], n, p, b)


def _turned(followers: DataFrame, parts: int) -> DataFrame:
    """As followers, by part of the second word, with the words that precede it."""

    def turn(part: int, _: int, blob: bytes) -> Iterator[pa.RecordBatch]:
        steps, at, n, p, b = _lean(blob)
        order = np.argsort(at, kind="stable")  # the others ascend by part and place
        a, at, n = _along(steps)[order], at[order], n[order]
        cut = np.append(0, np.cumsum(np.bincount(p[at], minlength=parts)))
        some = np.flatnonzero(np.diff(cut)).tolist()
        for lo in range(0, len(some), 1_000):
            few = some[lo : lo + 1_000]
            yield _rows(few, [part] * len(few), [_dump(_steps(b[at[cut[q] : cut[q + 1]]]), a[cut[q] : cut[q + 1]], n[cut[q] : cut[q + 1]]) for q in few])

    def merge(part: int, some: list) -> Iterator[pa.RecordBatch]:
        def placed(p: int, blob: bytes) -> list[np.ndarray]:
            b, a, n = _lean(blob)
            return [_along(b), np.full(len(a), p, np.min_scalar_type(p)), a, n]

        yield _rows([part], [1], [_linked(*_gathered(placed(*x) for x in some))])

    return _by_part(_each_row(followers, turn), parts, merge)


def _asked(linked: DataFrame, parts: int) -> DataFrame:
    """By part: steps of the places of its words whose classes another part needs on one side; side
    is twice that part, plus its side."""

    def ask(part: int, side: int, blob: bytes) -> Iterator[pa.RecordBatch]:
        if part == parts:
            return
        *_, p, b = _wide(blob)
        cut = np.searchsorted(p, np.arange(parts + 1))
        some = np.flatnonzero(np.diff(cut)).tolist()
        yield _rows(some, [part * 2 + side] * len(some), [_dump(_steps(b[cut[q] : cut[q + 1]])) for q in some])

    return _each_row(linked, ask)


# -- classes ----------------------------------------------------------------------------------


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def objective(m: np.ndarray) -> float:
    """Log likelihood of the classes, up to what doesn't depend on them."""
    return float(_xlogx(m).sum() - _xlogx(m.sum(1)).sum() - _xlogx(m.sum(0)).sum())

def exchange(words: np.ndarray, profile: np.ndarray, selves: np.ndarray, label: np.ndarray, m: np.ndarray, classes: int) -> np.ndarray:
    """One visit to each of the words. profile: words x 2 x classes + 1, how often each class
    follows (0) and precedes (1); selves: how often the word follows itself; label: their classes.
    m, the counts of class pairs, is changed. New classes."""
    label = label.copy()
    out, into = m.sum(1), m.sum(0)
    k = np.arange(classes)
    for w in range(len(words)):
        a, n = int(label[w]), float(selves[w])
        r, left = profile[w, 0].copy(), profile[w, 1].copy()
        rho, lam = r.sum(), left.sum()
        if not rho and not lam:
            continue
        # taken out of its class
        m[a] -= r
        m[:, a] -= left
        m[a, a] += n
        out[a] -= rho
        into[a] -= lam
        r[a] -= n
        left[a] -= n
        c, d = np.flatnonzero(r), np.flatnonzero(left)
        x, y = m[:classes][:, c], m[d][:, :classes]
        gain = (_xlogx(x + r[c]) - _xlogx(x)).sum(1) + (_xlogx(y + left[d][:, None]) - _xlogx(y)).sum(0)
        own = m[k, k]
        rk, lk = r[:classes], left[:classes]
        gain += _xlogx(own + rk + lk + n) - _xlogx(own + rk) - _xlogx(own + lk) + _xlogx(own)
        gain -= _xlogx(out[:classes] + rho) - _xlogx(out[:classes]) + _xlogx(into[:classes] + lam) - _xlogx(into[:classes])
        best = int(gain.argmax())
        if gain[best] <= gain[a] + 1e-9:
            best = a
        label[w] = best
        m[best] += r
        m[:, best] += left
        m[best, best] += n
        out[best] += rho
        into[best] += lam
    return label


def _looked_up(base: np.ndarray) -> np.ndarray:
    """[n - 1, c, k]: what _xlogx of base[k, c] gains by n more."""
    grown = _xlogx(base.T[None] + np.arange(_SMALL + 1)[:, None, None])
    return grown[1:] - grown[0]


def exchange_together(profile: np.ndarray, selves: np.ndarray, label: np.ndarray, m: np.ndarray, classes: int) -> np.ndarray:
    """As exchange, but all of the words are visited against the same m, which then gets their moves."""
    n, width = len(label), classes + 1
    at, k = np.arange(n), np.arange(classes)
    a, s = label.astype(np.int64), selves
    r, left = profile[:, 0].copy(), profile[:, 1].copy()
    rho, lam = r.sum(1), left.sum(1)
    r[at, a] -= s
    left[at, a] -= s
    gain = np.zeros((n, classes))
    for mine, theirs, base in ((r, profile[:, 1], m[:classes]), (left, profile[:, 0], m[:, :classes].T)):
        # base[k, c]: the counts of class k with c. Where a word has few of c that gain is looked
        # up; the word is taken out of its own class's row, and out of its class's column where
        # c is that. mine lacks what the word is beside itself, theirs has it, so that is taken
        # out of its cell once
        w, c = np.nonzero(mine)
        if not len(w):
            continue
        x, table = mine[w, c], _looked_up(base)
        part = table[np.minimum(x, _SMALL).astype(np.int64) - 1, c]
        large = np.flatnonzero(x > _SMALL)
        b = base[:, c[large]].T
        part[large] = _xlogx(b + x[large, None]) - _xlogx(b)
        own = np.flatnonzero(c == a[w])
        b = base[:, c[own]].T - theirs[w[own], :classes]
        part[own] = _xlogx(b + x[own, None]) - _xlogx(b)
        mine_class = base[a[w], c]
        mine_class[own] -= theirs[w[own], a[w[own]]]
        part[np.arange(len(w)), a[w]] = _xlogx(mine_class) - _xlogx(mine_class - x)
        first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        gain[w[first]] += np.add.reduceat(part, first)
    own = np.repeat(m[k, k][None], n, 0)
    own[at, a] -= r[at, a] + left[at, a] + s
    rk, lk = r[:, :classes], left[:, :classes]
    both = own + rk
    for_class = np.flatnonzero(((rk != 0) | (lk != 0)).ravel() | (s[:, None] != 0).repeat(classes, 1).ravel())
    o, b, l, t = own.ravel()[for_class], both.ravel()[for_class], lk.ravel()[for_class], s.repeat(classes)[for_class]
    gain.ravel()[for_class] += _xlogx(b + l + t) - _xlogx(b) - _xlogx(o + l) + _xlogx(o)
    for total, x in ((m.sum(1)[:classes], rho), (m.sum(0)[:classes], lam)):
        u, back = np.unique(x, return_inverse=True)
        cost = _xlogx(total + u[:, None]) - _xlogx(np.broadcast_to(total, (len(u), classes)))
        gain -= cost[back]
        gain[at, a] += cost[back, a] - (_xlogx(total[a]) - _xlogx(total[a] - x))
    best = gain.argmax(1)
    best = np.where(gain[at, best] <= gain[at, a] + 1e-9, a, best)
    go = np.flatnonzero(best != a)
    if len(go):
        gone, come = np.zeros((2, len(go), width))
        gone[np.arange(len(go)), a[go]] = come[np.arange(len(go)), best[go]] = 1
        m -= gone.T @ profile[go, 0] + profile[go, 1].T @ gone
        m += come.T @ r[go] + left[go].T @ come
        m[k, k] += s[go] @ gone[:, :classes] + s[go] @ come[:, :classes]
    return best


def _told(part: int, label: np.ndarray, some: list) -> Iterator[pa.RecordBatch]:
    """A part's labels, and to each part that asked the classes of the words it asked for."""
    yield _rows([part], [_OWN], [_dump(label)])
    asks = [(side, blob) for side, blob in some if side >= 0]
    for lo in range(0, len(asks), 1_000):
        few = asks[lo : lo + 1_000]
        yield _rows([side // 2 for side, _ in few], [part * 2 + side % 2 for side, _ in few], [_dump(label[np.cumsum(_wide(blob)[0])]) for _, blob in few])


def _begun(counted: DataFrame, asked: DataFrame, parts: int, classes: int) -> DataFrame:
    """First labels, and what parts tell each other of them."""

    def begin(part: int, some: list) -> Iterator[pa.RecordBatch]:
        ((_, n),) = [_load(blob) for side, blob in some if side == _OWN]
        yield from _told(part, (np.arange(len(n)) + part) % classes, some)  # frequent words first, one to each class in turn

    return _by_part(counted.union(asked), parts, begin)


def _profiles(linked: DataFrame, told: DataFrame, parts: int, classes: int) -> DataFrame:
    """By part: labels; steps of (place, side, class) and how often the class follows (0) and
    precedes (1) the word; places of words that follow themselves and how often."""
    width = classes + 1

    def profile(part: int, some: list) -> Iterator[pa.RecordBatch]:
        (label,) = [_wide(blob)[0] for side, blob in some if side == _OWN]
        size, sides, selves = len(label), [], (np.empty(0, np.int64),) * 2
        for side in (0, 1):
            held = [_lean(blob) for k, blob in some if k == side - 4]
            if not held:
                continue
            steps, at, n, p, b = held[0]
            a = _along(steps)
            got = [_load(blob)[0] for _, blob in sorted((k, blob) for k, blob in some if k >= 0 and k % 2 == side)]
            of = np.concatenate([*got, np.full(int((p == parts).sum()), classes, np.min_scalar_type(classes))])
            sides.append((side, a, of[at], n))
            if side == 0:
                me = np.flatnonzero((p[at] == part) & (b[at] == a))
                selves = a[me], n[me]
        keys, counts = [], []
        for lo in range(0, size, _CHUNK):
            total = np.zeros(_CHUNK * 2 * width)
            for side, a, of, n in sides:
                x, y = np.searchsorted(a, np.array([lo, min(size, lo + _CHUNK)], a.dtype))
                total += np.bincount(((a[x:y].astype(np.int64) - lo) * 2 + side) * width + of[x:y], n[x:y], len(total))
            cell = np.flatnonzero(total)
            keys.append(cell + lo * 2 * width)
            counts.append(total[cell].astype(np.int64))
        keys, counts = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, counts))
        yield _rows([part], [_OWN], [_dump(label, _steps(keys), counts, *selves)])

    statics = linked.where(f"part < {parts}").select("part", (F.col("side") - 4).alias("side"), "blob")
    return _by_part(statics.union(told), parts, profile)


def _matrix(profiles: DataFrame, width: int) -> np.ndarray:
    """Counts of class pairs: every word is preceded once each time it stands."""

    def count(_: int, __: int, blob: bytes) -> Iterator[pa.RecordBatch]:
        label, steps, n, *_ = _wide(blob)
        k = np.cumsum(steps)
        f = k // width % 2 == 1
        total = np.bincount(k[f] % width * width + label[k[f] // (2 * width)], n[f], width * width)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell].astype(np.int64))], ["cell", "n"])

    got = _each_row(profiles, count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    m = np.zeros(width * width)
    m[got["cell"].to_numpy()] = got["n"].to_numpy()
    return m.reshape(width, width)


def _moved(profiles: DataFrame, asked: DataFrame, m, turn: int, parts: int, classes: int) -> DataFrame:
    """Labels after a visit to each word, and what parts tell each other of them."""
    width = classes + 1

    def visit(part: int, some: list) -> Iterator[pa.RecordBatch]:
        (blob,) = [blob for side, blob in some if side == _OWN]
        label, steps, n, self_at, self_n = _wide(blob)
        k, now = np.cumsum(steps), m.value.copy()
        for lo in range(0, len(label), _CHUNK):
            hi = min(len(label), lo + _CHUNK)
            a, b = np.searchsorted(k, [lo * 2 * width, hi * 2 * width])
            profile = np.bincount(k[a:b] - lo * 2 * width, n[a:b], (hi - lo) * 2 * width).reshape(-1, 2, width)
            selves = np.zeros(hi - lo)
            f = (self_at >= lo) & (self_at < hi)
            selves[self_at[f] - lo] = self_n[f]
            may = mix((np.arange(lo, hi) * parts + part).astype(np.uint64) + np.uint64(turn << 48)) % np.uint64(2) >= np.uint64(turn >= _FREE)
            often = int((profile.sum((1, 2)) > _OFTEN).sum())  # places go by frequency
            one = np.flatnonzero(may[:often])
            label[lo + one] = exchange(one, profile[one], selves[one], label[lo + one], now, classes)
            rest = often + np.flatnonzero(may[often:])
            for x in range(0, len(rest), _TOGETHER):
                w = rest[x : x + _TOGETHER]
                label[lo + w] = exchange_together(profile[w], selves[w], label[lo + w], now, classes)
        yield from _told(part, label, some)

    return _by_part(profiles.union(asked), parts, visit)


def _transition(m: np.ndarray, prior: float) -> np.ndarray:
    share = (m.sum(0) + 1.0) / (m.sum(0) + 1.0).sum()
    return np.log((m + prior * share) / (m.sum(1, keepdims=True) + prior))


@dataclass
class Model:
    """words: by part, a row of hashes, counts and classes of the part's words."""

    words: DataFrame
    batches: DataFrame
    count: int  # of batches
    named: DataFrame
    parts: int
    transition: np.ndarray  # log, from class to class
    totals: np.ndarray  # of counts and what is added to them, by class
    add: float
    objectives: list[float]

    def scores(self, schema: T.StructType, n: str, p: str) -> DataFrame:
        """The rows of the table with words and log probability of each."""
        parts, add, last = self.parts, self.add, len(self.transition) - 1
        shared = self.batches.sparkSession.sparkContext.broadcast((self.transition, np.log(self.totals)))

        def answer(part: int, some: list) -> Iterator[pa.RecordBatch]:
            ((_, n, label),) = [_load(blob) for side, blob in some if side == _ROWS]
            asks = [(side, blob) for side, blob in some if side >= 0]
            for lo in range(0, len(asks), 1_000):
                few = [(side, _load(blob)[0]) for side, blob in asks[lo : lo + 1_000]]
                yield _rows([part] * len(few), [side for side, _ in few], [_dump(label[at], n[at]) for _, at in few])

        def add_up(size, at, part, got, rows) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(size))
            if len(at):
                label, n = got
                emission = np.log(n + add) - shared.value[1][label]
                now = label[at]
                each = shared.value[0][_before(now, size, last), now] + emission[at]
                some = np.flatnonzero(size)
                total[some] = np.add.reduceat(each, (np.cumsum(size) - size)[some])
            lo = 0
            for b in pa.ipc.open_stream(rows):
                hi = lo + b.num_rows
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(size[lo:hi]), pa.array(total[lo:hi])], [*b.schema.names, n_name, p_name])
                lo = hi

        n_name, p_name = n, p
        answers = _by_part(self.named.where("side >= 0").union(self.words), parts, answer)
        kind = T.StructType([*[T.StructField(f"c{k}", f.dataType) for k, f in enumerate(schema.fields)], T.StructField(n, T.LongType()), T.StructField(p, T.DoubleType())])
        return _answered(self.batches.select("part", "side", "blob"), self.count, answers, parts, add_up, kind).toDF(*schema.names, n, p)


def train(docs: DataFrame, text: str = "text", only: list[str] | None = None, classes: int = CLASSES, passes: int = PASSES, prior: float = PRIOR, add: float = ADD) -> Model:
    """The model of all documents and of every word in them."""
    sc = docs.sparkSession.sparkContext
    width = classes + 1
    batches = written(_batches(docs, text, docs.columns if only is None else only), "batches")
    count, words = batches.where(f"side = {_OWN}").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = _parts(words)
    named = written(_named(batches, parts), "named")
    counted = named.where(f"side = {_OWN}")
    followers = written(_followers(batches, count, named, parts), "followers")
    preceders = written(_turned(followers, parts), "preceders")
    linked = followers.union(preceders)
    asked = written(_asked(linked, parts), "asked")
    cleared(docs.sparkSession)
    told = written(_begun(counted, asked, parts, classes), "told")
    best_value, values = -np.inf, []
    for k in range(passes + 1):
        profiles = written(_profiles(linked, told, parts, classes), "profiles")
        m = _matrix(profiles, width)
        values.append(objective(m))
        over = [profiles]
        if values[-1] > best_value:
            over += [best] if k else []
            best, best_value, best_m = told, values[-1], m
        elif k < passes:
            over.append(told)
        if k < passes:
            told = written(_moved(profiles, asked, sc.broadcast(m), k, parts, classes), "told")
        cleared(docs.sparkSession, *over)
    cleared(docs.sparkSession, followers, preceders, asked)

    def classed(part: int, some: list) -> Iterator[pa.RecordBatch]:
        (h, n), (label,) = (next(_load(blob) for side, blob in some if side == s) for s in (_OWN, _ROWS))
        yield _rows([part], [_ROWS], [_dump(h, n, label)])

    labels = best.where(f"side = {_OWN}").select("part", F.lit(_ROWS).cast("bigint").alias("side"), "blob")
    kept = written(_by_part(counted.union(labels), parts, classed), "words")

    def sums(_: int, __: int, blob: bytes) -> Iterator[pa.RecordBatch]:
        _, n, label = _load(blob)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(np.bincount(label, n + add, width).astype(np.float64))], ["c", "n"])

    got = _each_row(kept, sums, "c bigint, n double").groupBy("c").agg(F.sum("n").alias("n")).toArrow()
    totals = np.ones(width)
    totals[got["c"].to_numpy()] = np.maximum(got["n"].to_numpy(), 1e-300)
    return Model(kept, batches, count, named, parts, _transition(best_m, prior), totals, add, values)


@kept_names
def perplexity(docs: DataFrame, text: str = "text", into: str = "lm", only: tuple[str, ...] | None = None, **how) -> DataFrame:
    """docs with one more struct column: n_words, log_prob, perplexity, by a model of docs itself.
    only: those of docs' columns that are wanted; no others are written beside the words."""
    n, p = fresh(docs, "n_words"), fresh(docs, "log_prob")
    rows = docs if only is None else docs.select(*[F.col(quoted(c)) for c in only])
    got = train(docs, text, only=rows.columns, **how).scores(rows.schema, n, p)
    made = F.struct(F.col(n).alias("n_words"), F.col(p).alias("log_prob"), F.when(F.col(n) > 0, F.exp(-F.col(p) / F.col(n))).alias("perplexity"))
    return got.select(*own(rows, into), made.alias(into))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return perplexity(docs, only=("doc_id",)).select("doc_id", "lm.n_words", "lm.log_prob", "lm.perplexity")
