"""Triangles of three pair relations, cell by cell, where the paths of two pairs are far more than
the pairs: no such path is moved or kept.

The vertices of each corner are cut into runs of ids. Pairs are packed into blocks by the runs of
their ends, written once and counted. A cell is a run of each corner with pairs on all three sides;
it gets the blocks of its sides and enumerates its paths alone, a stretch at a time. A block goes
to each cell that asks for it: where neighbours have ids near each other those are few, so that what
is moved follows the number of pairs; where they haven't, it grows by the power 1.5, as it must where
memory is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.pattern import Pattern
from ..plans.planner import Sizes, leaf
from ..sources.graph import Graph
from ..sources.shared import shared_path
from .pairs import pair, u

#: Paths from which on cells are used, and how many times the pairs they must be.
PATHS, TIMES = 20_000_000, 4
#: Pairs that a cell may have, pairs packed at a time, paths enumerated at a time.
CELL, PACK, STRETCH = 12_000_000, 1_000_000, 1_000_000
#: The most runs of a corner.
RUNS = 128

_BLOCKS = "of int, i int, j int, n bigint, blob binary"


def corners(p: Pattern, order: list[tuple[int, int]], sizes: Sizes) -> tuple[int, int, int] | None:
    """The corners of the triangle that an order of joins begins with, if it is one for cells."""
    some = sorted({n for k in order[:3] for n in k})
    if len(order) < 3 or len(some) != 3:
        return None
    (middle,) = set(order[0]) & set(order[1])
    n = [sizes.pair(p, *k) for k in order[:3]]
    paths = n[0] * n[1] / sizes.label(p.labels[middle])
    return (some[0], some[1], some[2]) if paths >= max(PATHS, TIMES * sum(n)) else None


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers that aren't negative, in as few bytes each as the largest needs."""
    kind = next(k for k in ("u1", "u2", "u4", "u8") if not len(x) or int(x.max()) < 1 << 8 * int(k[1]))
    return bytes([int(kind[1])]) + x.astype("<" + kind).tobytes()


def pack_block(a: np.ndarray, b: np.ndarray) -> bytes:
    """Pairs in order: steps of a, b from its least on."""
    low = int(b.min())
    return np.array([a[0], low], "<i8").tobytes() + _packed(np.diff(a).view(np.uint64)) + _packed(b.view(np.uint64) - np.uint64(low % (1 << 64)))


def unpack_block(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    first, low = np.frombuffer(blob, "<i8", 2)
    wide = blob[16]
    steps = np.frombuffer(blob, f"<u{wide}", n - 1, 17).astype(np.int64)
    at = 17 + wide * (n - 1)
    b = np.frombuffer(blob, f"<u{blob[at]}", n, at + 1).astype(np.int64) + low
    return np.concatenate([[first], first + np.cumsum(steps)]), b


def _packer(of: int, left: np.ndarray, right: np.ndarray):
    def blocks(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        i, j = np.searchsorted(left, a, "right"), np.searchsorted(right, b, "right")
        at = i * (len(right) + 1) + j
        by = np.lexsort((b, a, at))
        a, b, at = a[by], b[by], at[by]
        cut = np.flatnonzero(np.diff(at, prepend=-1))
        ends = np.append(cut[1:], len(at))
        i, j = np.divmod(at[cut], len(right) + 1)
        blobs = [pack_block(a[x:y], b[x:y]) for x, y in zip(cut, ends)]
        columns = [np.full(len(cut), of, np.int32), i.astype(np.int32), j.astype(np.int32), ends - cut]
        return pa.record_batch([*map(pa.array, columns), pa.array(blobs, pa.binary())], ["of", "i", "j", "n", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                n += batch.num_rows
            if n >= PACK:
                yield blocks(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield blocks(*map(np.concatenate, zip(*held)))

    return run


def plan_cells(counts: list[np.ndarray], runs: int, most: int) -> tuple[int, np.ndarray]:
    """How many coarse runs to make of the runs, so that the least is moved with no cell over the most
    pairs if that can be; and the cells, the largest first. counts: pairs by runs, of the three sides."""
    tried = []
    for k in sorted({max(1, round(runs / 1.25**s)) for s in range(32)}):
        at = np.arange(runs) * k // runs
        ab, bc, ac = (np.zeros((k, k), np.int64) for _ in range(3))
        for fine, coarse in zip(counts, (ab, bc, ac)):
            np.add.at(coarse, (at[:, None], at[None, :]), fine)
        load = ab[:, :, None] + bc[None, :, :] + ac[:, None, :]
        load[(ab[:, :, None] == 0) | (bc[None, :, :] == 0) | (ac[:, None, :] == 0)] = 0
        cells = np.argwhere(load)
        cells = cells[np.argsort(-load[tuple(cells.T)], kind="stable")]
        tried.append((int(load.max(initial=0)), int(load.sum()), k, cells))
    fit = [t for t in tried if t[0] <= most] or [min(tried, key=lambda t: t[0])]
    least = min(t[1] for t in fit)
    _, _, k, cells = max((t for t in fit if t[1] <= 1.25 * least), key=lambda t: t[2])  # the more cells, the more tasks
    return k, cells


def closed(left: tuple, right: tuple, close: tuple, stretch: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """x, y, z with (x, y) in left, (y, z) in right and (x, z) in close."""
    x, y = left
    by = np.lexsort((y, x))
    x, y = x[by], y[by]
    by = np.lexsort((right[1], right[0]))
    ry, rz = right[0][by], right[1][by]
    names, at = np.unique(np.concatenate([rz, close[1]]), return_inverse=True)
    rz, cz, wide = at[: len(rz)], at[len(rz) :], len(names)
    by = np.lexsort((cz, close[0]))
    cx, cz = close[0][by], cz[by]
    start = np.searchsorted(ry, y, "left")
    fan = np.searchsorted(ry, y, "right") - start
    keep = fan > 0
    x, y, start, fan = x[keep], y[keep], start[keep], fan[keep]
    ends = np.cumsum(fan)
    k = 0
    while k < len(x):
        upto = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + stretch, "right")))
        some = slice(k, upto)
        who = np.repeat(np.arange(k, upto), fan[some])
        z = rz[np.arange(ends[k] - fan[k], ends[upto - 1]) - np.repeat(ends[some] - fan[some] - start[some], fan[some])]
        lo, hi = np.searchsorted(cx, x[k], "left"), np.searchsorted(cx, x[upto - 1], "right")
        names_x, row = np.unique(cx[lo:hi], return_inverse=True)
        if len(names_x):
            at_x = np.minimum(np.searchsorted(names_x, x[some]), len(names_x) - 1)
            there = names_x[at_x] == x[some]
            key = np.repeat(at_x, fan[some]) * wide + z
            want = row * wide + cz[lo:hi]
            if len(names_x) * wide <= 32 << 20:
                table = np.zeros(len(names_x) * wide, bool)
                table[want] = True
                hit = table[key]
            else:
                hit = want[np.minimum(np.searchsorted(want, key), len(want) - 1)] == key
            hit &= np.repeat(there, fan[some])
            if hit.any():
                yield x[who[hit]], y[who[hit]], names[z[hit]]
        k = upto


def triangles_of(ab: tuple, bc: tuple, ac: tuple, stretch: int = STRETCH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """a, b, c with pairs on all three sides, from the corner with the fewest paths."""

    def paths(one: np.ndarray, other: np.ndarray) -> int:
        names, n = np.unique(one, return_counts=True)
        others, m = np.unique(other, return_counts=True)
        _, k, j = np.intersect1d(names, others, assume_unique=True, return_indices=True)
        return int(n[k] @ m[j])

    turned = lambda side: (side[1], side[0])
    best = min((paths(ab[1], bc[0]), 1), (paths(ab[0], ac[0]), 0), (paths(bc[1], ac[1]), 2))[1]
    if best == 1:
        yield from closed(ab, bc, ac, stretch)
    elif best == 0:
        for b, a, c in closed(turned(ab), ac, bc, stretch):
            yield a, b, c
    else:
        for a, c, b in closed(ac, turned(bc), ab, stretch):
            yield a, b, c


def _finder(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], []]
        for batch in batches:
            for side, n, blob in zip(*(c.to_pylist() for c in batch.columns)):
                held[side].append(unpack_block(blob, n))
        if all(held):
            sides = [tuple(map(np.concatenate, zip(*some))) for some in held]
            held.clear()
            for found in triangles_of(*sides):
                yield pa.record_batch([pa.array(x) for x in found], names)

    return run


def triangles(g: Graph, p: Pattern, a: int, b: int, c: int, sizes: Sizes) -> DataFrame:
    """(u<a>, u<b>, u<c>): what joining the three pair relations gives."""
    spark = g.vertices.sparkSession
    sides = [(a, b), (b, c), (a, c)]
    runs = int(min(RUNS, max(16, sum(sizes.pair(p, *k) for k in sides) // 3_000_000)))
    cuts: dict[int, np.ndarray] = {}
    for label in {p.labels[n] for n in (a, b, c)}:
        got = g.with_label(label).agg(F.percentile_approx("vid", [k / runs for k in range(1, runs)], 10_000)).collect()[0][0]
        cuts[label] = np.unique(np.array(got or [], np.int64))
    path = shared_path(spark, "blocks")
    alike = [(p.labels[x], p.loops.get(x), [str(e.renamed({x: 0})) for e in p.on_vertex(x)], leaf(p, x, y)) for x, y in sides]
    kind = [alike.index(k) for k in alike]  # sides that ask for the same share their blocks
    packed = [pair(g, p, x, y).select(u(x), u(y)).mapInArrow(_packer(k, cuts[p.labels[x]], cuts[p.labels[y]]), _BLOCKS) for k, (x, y) in enumerate(sides) if k in kind]
    reduce(DataFrame.unionByName, packed).write.parquet(path)
    blocks = spark.read.schema(_BLOCKS).parquet(path)
    counts = [np.zeros((runs, runs), np.int64) for _ in sides]
    for side, i, j, n in blocks.groupBy("of", "i", "j").agg(F.sum("n")).collect():
        counts[side][i, j] = n
    k, cells = plan_cells([counts[x] for x in kind], runs, CELL)
    names = [u(a), u(b), u(c)]
    schema = ", ".join(f"{x} bigint" for x in names)
    if not len(cells):
        return spark.createDataFrame([], schema)
    to = [(kind[side], int(cell[x]), int(cell[y]), side, at) for at, cell in enumerate(cells) for side, (x, y) in enumerate(((0, 1), (1, 2), (0, 2)))]
    coarse = lambda name: F.expr(f"{name} * {k} div {runs}").cast("int").alias(name)
    dealt = blocks.select("of", coarse("i"), coarse("j"), "n", "blob").join(F.broadcast(spark.createDataFrame(to, "of int, i int, j int, side int, cell int")), ["of", "i", "j"])
    return dealt.repartitionById(len(cells), F.col("cell")).select("side", "n", "blob").mapInArrow(_finder(names), schema)
