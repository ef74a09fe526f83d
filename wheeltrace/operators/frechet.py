"""Discrete Frechet distance between curves by boxes, bands and strips.

The distance is the smallest point distance d at which the cells of the distance matrix that are at most d
let a monotone path through from the first pair of points to the last.

* Boxes around blocks of points bound the distance of a pair and leave out the cells that no path at the upper bound can use:
  of each block row only a stretch of columns is left. Large blocks leave a band in which smaller ones are looked at, down to
  blocks of ``LEAST_BLOCK`` points, so the work follows the length of the curves times the width of what is left.
* A pair of which the boxes leave few cells is swept directly in one task.
* The rows of other pairs are cut into strips. In a narrow band a strip becomes a table of values: the least possible maximum from each
  cell above it to each cell of its last row. A task sweeps its strips side by side and composes their tables; what is left of a pair are a few tables.
* The band is wide if the curves begin or end far apart. Then the distance often is that of their first or last points: it cannot be less, and a
  path that takes the nearest next cell shows that it is not more.
* Other wide bands are searched over the candidate distances, a few at a time for all pairs in one job. For each candidate a strip becomes a map from the
  cells above it to the cells of its last row. Paths in the plane cannot pass each other without meeting, so what a cell reaches is an interval of the
  cells that anything reaches: two numbers a cell. Maps of neighbouring strips compose, so a pair is reduced by groups of strips. The result tells
  which candidates let a path through, and samples of the distances in between give the next candidates.

All ways give the same number. The number of jobs does not follow the length of the curves (that of the search follows the logarithm of the number of
distances, base ``CANDIDATES``). A task holds some strips of a curve and the stretch of the other that they can reach.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheeltrace.operators.ordered import dense_number, with_summary
from wheeltrace.session import materialize

BLOCKS = 1 << 17         # blocks of a curve at most
LEAST_BLOCK = 16         # points of a block at least
COARSE = 1024            # blocks of a curve of which all pairs are looked at
FINER = 4                # smaller blocks of a block
BAND_CELLS = 8_000_000   # pairs of smaller blocks that are looked at at once; beyond that the larger blocks stay
STRIP = 1024             # points of a strip, or one block if that is larger
CANDIDATES = 31          # distances tried in one job
SAMPLES = 16             # distances named by a strip between two candidates
FAN = 32                 # maps composed in one step
DIRECT_CELLS = 300_000_000   # a pair with so few cells left, and so few points, is one task and needs no search
DIRECT_POINTS = 1_000_000
ROOM = 3_000_000         # cells of a row times candidates that are worked on at once
WIDE = 1024              # columns of a row up to which a strip becomes a table of values
SIDE_BY_SIDE = 4096      # numbers of a column that are worked on at once
TOGETHER = 64            # strips of a pair in one task
WALK_POINTS = 4_000_000  # points of a pair of which one path is walked before a search
NOWHERE = np.int64(1) << 60


# --- bounds from boxes ------------------------------------------------------------------------------
def _box_distances(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distances between boxes (x0, y0, x1, y1), a little wider than exact."""
    lo, hi = [], []
    for a, b in ((0, 2), (1, 3)):
        gap = np.maximum(np.maximum(q[None, :, a] - p[:, None, b], p[:, None, a] - q[None, :, b]), 0)
        far = np.maximum(np.abs(q[None, :, b] - p[:, None, a]), np.abs(p[:, None, b] - q[None, :, a]))
        lo.append(gap)
        hi.append(far)
    return (lo[0] ** 2 + lo[1] ** 2) * (1 - 1e-12), (hi[0] ** 2 + hi[1] ** 2) * (1 + 1e-12)


def minimax(d: np.ndarray) -> float:
    """Least possible maximum along a monotone path through a matrix, by anti-diagonals."""
    n, m = d.shape
    before, last = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
    before[0] = -np.inf  # the step into the first cell
    for k in range(n + m - 1):
        i = np.arange(max(0, k - m + 1), min(n - 1, k) + 1)
        best = np.minimum(np.minimum(last[i], last[i + 1]), before[i])
        cur = np.full(n + 1, np.inf)
        cur[i + 1] = np.maximum(best, d[i, k - i])
        before, last = last, cur
    return float(last[n])


def band_minimax(px, py, qx, qy, a: np.ndarray, b: np.ndarray) -> float:
    """Least possible maximum of squared distances along a path inside a band: row i has the columns from a[i] up to b[i].

    Both borders never go back, so the cells of an anti-diagonal are neighbouring rows.
    """
    n, m = len(px), len(qx)
    rows = np.arange(n)
    first = np.searchsorted(rows + b, np.arange(n + m - 1), side="right")
    last_row = np.searchsorted(rows + a, np.arange(n + m - 1), side="right") - 1
    before, last, cur = (np.full(n + 3, np.inf) for _ in range(3))
    before[0] = -np.inf  # the step into the first cell
    for k, (i0, i1) in enumerate(zip(first.tolist(), last_row.tolist())):
        if i0 <= i1:
            q = slice(k - i1, k - i0 + 1)
            dx, dy = px[i0:i1 + 1] - qx[q][::-1], py[i0:i1 + 1] - qy[q][::-1]
            best = np.minimum(np.minimum(last[i0:i1 + 1], last[i0 + 1:i1 + 2]), before[i0:i1 + 1])
            np.maximum(best, dx * dx + dy * dy, out=cur[i0 + 1:i1 + 2])
            cur[i0] = cur[i1 + 2] = np.inf
        else:
            cur[i1:i0 + 2] = np.inf  # no cell of the band
        before, last, cur = last, cur, before
    return float(last[n])


def _spread(free: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Free cells of rows that given cells reach by going right; works on the last axis."""
    run = 2 * np.cumsum(~free, axis=-1)
    return free & (np.maximum.accumulate(run + (given & free), axis=-1) > run)


def _reached(free: np.ndarray) -> np.ndarray:
    """Cells that the first cell reaches."""
    out = np.zeros_like(free)
    given = np.zeros(free.shape[1], bool)
    given[0] = True
    for i in range(len(free)):
        out[i] = _spread(free[i], given)
        given = out[i].copy()
        given[1:] |= out[i, :-1]
    return out


def stretch(p: np.ndarray, q: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Bounds of the squared distance from boxes, and the first and last column block of every row block."""
    levels = [(p, q)]
    while max(len(levels[-1][0]), len(levels[-1][1])) > COARSE:
        levels.append(tuple(_larger(x) for x in levels[-1]))
    low, high = _box_distances(*levels.pop())
    bound = minimax(high)
    free = low <= bound
    on = _reached(free) & _reached(free[::-1, ::-1])[::-1, ::-1]
    least, j0, j1 = minimax(low), on.argmax(1), on.shape[1] - 1 - on[:, ::-1].argmax(1)
    while levels:
        p, q = levels.pop()
        a = np.repeat(j0 * FINER, FINER)[:len(p)]
        b = np.minimum(np.repeat((j1 + 1) * FINER, FINER)[:len(p)], len(q))
        if len(p) * int((b - a).max()) > BAND_CELLS:
            j0, j1 = a, b - 1
        else:
            finer, bound, j0, j1 = _within(p, q, a, b)
            least = max(least, finer)
    return least, bound, j0, j1


def _larger(boxes: np.ndarray) -> np.ndarray:
    """Boxes around ``FINER`` neighbours each."""
    at = np.arange(0, len(boxes), FINER)
    return np.concatenate([np.minimum.reduceat(boxes[:, :2], at), np.maximum.reduceat(boxes[:, 2:], at)], 1)


def _within(p: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Bounds and columns from the boxes of a band, whose row i has the columns from a[i] up to b[i]."""
    cols = a[:, None] + np.arange((b - a).max())
    out = cols >= b[:, None]
    at = np.minimum(cols, len(q) - 1)
    low, high = (np.zeros(cols.shape) for _ in range(2))
    for lo, hi in ((0, 2), (1, 3)):
        gap = np.maximum(np.maximum(q[at, lo] - p[:, None, hi], p[:, None, lo] - q[at, hi]), 0)
        low += gap * gap
        far = np.maximum(np.abs(q[at, hi] - p[:, None, lo]), np.abs(p[:, None, hi] - q[at, lo]))
        high += far * far
    low, high = np.where(out, np.inf, low * (1 - 1e-12)), np.where(out, np.inf, high * (1 + 1e-12))
    bound = _band_values(high, a, b)[-1, b[-1] - 1 - a[-1]]
    to = _band_values(low, a, b)
    # backwards: rows and columns are counted from the other end
    back = np.maximum((b - a)[:, None] - 1 - np.arange(cols.shape[1]), 0)
    away = np.take_along_axis(np.where(out, np.inf, low), back, 1)
    away[out] = np.inf
    away = _band_values(away[::-1], len(q) - b[::-1], len(q) - a[::-1])[::-1]
    on = (to <= bound) & (np.take_along_axis(away, back, 1) <= bound) & ~out
    return to[-1, b[-1] - 1 - a[-1]], bound, a + on.argmax(1), a + on.shape[1] - 1 - on[:, ::-1].argmax(1)


def _band_values(cost: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least possible maximum of the costs along a path to each cell of a band; cell (i, j) stands at [i, j - a[i]]."""
    n, width = cost.shape
    rows, steps = np.arange(n), np.arange(n + int(b[-1]) - 1)
    first = np.searchsorted(rows + b, steps, side="right")
    last_row = np.searchsorted(rows + a, steps, side="right") - 1
    base, cost, out = rows * (width - 1) - a, np.ascontiguousarray(cost).ravel(), np.full(n * width, np.inf)
    before, last, cur = (np.full(n + 3, np.inf) for _ in range(3))
    before[0] = -np.inf  # the step into the first cell
    for k, (i0, i1) in enumerate(zip(first.tolist(), last_row.tolist())):
        if i0 <= i1:
            at = base[i0:i1 + 1] + k
            best = np.minimum(np.minimum(last[i0:i1 + 1], last[i0 + 1:i1 + 2]), before[i0:i1 + 1])
            out[at] = cur[i0 + 1:i1 + 2] = np.maximum(best, cost[at])
            cur[i0] = cur[i1 + 2] = np.inf
        else:
            cur[i1:i0 + 2] = np.inf  # no cell of the band
        before, last, cur = last, cur, before
    return out.reshape(n, width)


# --- strips -----------------------------------------------------------------------------------------
def strip_map(px, py, qx, qy, a, b, above, limits, first: bool):
    """Maps of a strip at each limit: (lo, hi, live) over entries, entries and exits.

    ``a``, ``b`` are the columns of each row, ``above`` those of the row before the strip. ``lo`` and ``hi`` are the first and last
    column of the last row that an entry reaches (none: ``lo`` > ``hi``), ``live`` the columns that any entry reaches.
    """
    width, k = len(qx), len(limits)
    none, shift = width + 1, width + 3
    lim = np.asarray(limits)[:, None]
    lo, hi = np.full((k, width + 1), none, np.int64), np.full((k, width + 1), -1, np.int64)

    def squares(i):
        dx, dy = px[i] - qx[a[i]:b[i]], py[i] - qy[a[i]:b[i]]
        return dx * dx + dy * dy

    last = len(px) - 1
    for i in range(last, -1, -1):
        free = squares(i) <= lim
        s = slice(a[i], b[i])
        if i == last:
            low, high = np.where(free, np.arange(a[i], b[i]), none), np.where(free, np.arange(a[i], b[i]), -1)
        else:
            low = np.where(free, np.minimum(lo[:, s], lo[:, a[i] + 1:b[i] + 1]), none)
            high = np.where(free, np.maximum(hi[:, s], hi[:, a[i] + 1:b[i] + 1]), -1)
            lo[:, a[i + 1]:b[i + 1]], hi[:, a[i + 1]:b[i + 1]] = none, -1
        # going right: from the right end, a blocked cell starts anew
        run = np.cumsum(~free[:, ::-1], axis=1) * shift
        lo[:, s] = (np.minimum.accumulate(low[:, ::-1] - run, axis=1) + run)[:, ::-1]
        hi[:, s] = (np.maximum.accumulate(high[:, ::-1] + run, axis=1) - run)[:, ::-1]
    live = np.zeros((k, width + 1), bool)  # one place to the right, so that the cell before is at hand
    if first:
        out_lo, out_hi = lo[:, :1], hi[:, :1]
    else:
        s = slice(above[0], above[1])
        out_lo, out_hi = np.minimum(lo[:, s], lo[:, above[0] + 1:above[1] + 1]), np.maximum(hi[:, s], hi[:, above[0] + 1:above[1] + 1])
        live[:, above[0] + 1:above[1] + 1] = True
    for i in range(len(px)):
        given = live[:, a[i]:b[i]] | live[:, a[i] + 1:b[i] + 1]
        if first and i == 0:
            given[:, 0] = True
        else:
            prev = above if i == 0 else (a[i - 1], b[i - 1])
            live[:, prev[0] + 1:prev[1] + 1] = False
        live[:, a[i] + 1:b[i] + 1] = _spread(squares(i) <= lim, given)
    return out_lo, out_hi, live[:, a[last] + 1:b[last] + 1]


def between(px, py, qx, qy, a, b, edges, most: int = SAMPLES, held: int = 400_000) -> list[np.ndarray]:
    """Some of the distances of a strip in each interval (edge, next edge), all if there are few."""
    found, size = [], 0
    for i in range(len(px)):
        dx, dy = px[i] - qx[a[i]:b[i]], py[i] - qy[a[i]:b[i]]
        d = dx * dx + dy * dy
        d = d[(d > edges[0]) & (d < edges[-1])]
        found.append(d)
        size += len(d)
        if size > held:  # many are left: a part of them will do
            found = [thinned(np.unique(np.concatenate(found)), held // 8)]
            size = len(found[0])
    d = np.unique(np.concatenate(found)) if found else np.zeros(0)
    out = []
    for lo, hi in zip(edges[:-1], edges[1:]):
        out.append(thinned(d[np.searchsorted(d, lo, side="right"):np.searchsorted(d, hi, side="left")], most))
    return out


def thinned(values: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` evenly spread ones of sorted values."""
    if len(values) <= most:
        return values
    return values[np.linspace(0, len(values) - 1, most).astype(np.int64)]


def compose(f, g):
    """The map of two neighbouring strips; exits of ``f`` and entries of ``g`` are the same columns."""
    lo, hi, live_f = f
    glo, ghi, live_g = g
    k, mid = live_f.shape
    glo, ghi = np.where(live_f, glo, NOWHERE), np.where(live_f, ghi, -1)
    low, high = np.full(lo.shape, NOWHERE), np.full(hi.shape, -1, np.int64)
    live = np.zeros_like(live_g)
    for r in range(k):
        some = np.flatnonzero(lo[r] <= hi[r])
        if len(some):
            low[r, some] = _range(np.minimum, glo[r], lo[r, some], hi[r, some])
            high[r, some] = _range(np.maximum, ghi[r], lo[r, some], hi[r, some])
        on = np.flatnonzero(glo[r] <= ghi[r])
        edge = np.zeros(live_g.shape[1] + 1, np.int64)
        np.add.at(edge, glo[r, on], 1)
        np.add.at(edge, ghi[r, on] + 1, -1)
        live[r] = live_g[r] & (np.cumsum(edge)[:-1] > 0)
    return low, high, live


def _range(best, values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Best value of each range begin..end (inclusive), from tables of doubled ranges."""
    out, size = np.empty(len(begin), values.dtype), np.frexp(end - begin + 1)[1] - 1
    row, level = values, 0
    while True:
        own = size == level
        out[own] = best(row[begin[own]], row[end[own] - (1 << level) + 1])
        level += 1
        if level > size.max():
            return out
        row = best(row[:-(1 << (level - 1))], row[1 << (level - 1):])


# --- tables of values ---------------------------------------------------------------------------------
def strip_values(strips: list[tuple]) -> list[np.ndarray]:
    """Tables of strips: the least possible maximum of squared distances from each cell above to each cell of the last row.

    A strip is (px, py, qx, qy, a, b, above) like that of ``strip_map``; ``above`` of a first strip is (-1, 0), the step into the first cell.
    """
    out = [None] * len(strips)
    wide = [int((s[5] - s[4]).max()) for s in strips]
    order = sorted(range(len(strips)), key=lambda k: (len(strips[k][0]), wide[k], k))
    while order:
        # strips with as many rows, as many of them as there is room for
        some, most = [], 0
        for k in order:
            most = max(most, strips[k][6][1] - strips[k][6][0])
            if some and (len(strips[k][0]) != len(strips[some[0]][0]) or (len(some) + 1) * most > SIDE_BY_SIDE):
                break
            some.append(k)
        order = order[len(some):]
        for k, table in zip(some, _side_by_side([strips[k] for k in some])):
            out[k] = table
    return out


def _side_by_side(strips: list[tuple]) -> list[np.ndarray]:
    """Tables of strips with the same number of rows, swept row by row for all of them; the place of a number: column, strip, entry."""
    rows, n = len(strips[0][0]), len(strips)
    px, py, a, b = (np.stack([s[k] for s in strips], 1) for k in (0, 1, 4, 5))
    above = np.array([s[6] for s in strips], np.int64)
    width, entries, longest = int((b - a).max()), int((above[:, 1] - above[:, 0]).max()), max(len(s[2]) for s in strips)
    qx, qy = np.full((longest, n), np.inf), np.full((longest, n), np.inf)
    for k, s in enumerate(strips):
        qx[:len(s[2]), k], qy[:len(s[3]), k] = s[2], s[3]
    who, col = np.arange(n), np.arange(width)[:, None]
    moved = np.append(True, (a[1:] != a[:-1]).any(1) | (b[1:] != b[:-1]).any(1))
    # the row above: an entry is at its own cell
    prev, origin = np.repeat(np.where(np.eye(entries, dtype=bool), -np.inf, np.inf)[:, None], n, 1), above[:, 0]
    line, step = np.empty((width + 1, n, entries)), np.empty((width, n, entries))
    for i in range(rows):
        if moved[i]:
            # the values of the columns of this row and of the one before them
            at = a[i] - 1 - origin + np.arange(width + 1)[:, None]
            there = (at >= 0) & (at < len(prev))
            prev = prev[np.clip(at, 0, len(prev) - 1), who]
            prev[~there] = np.inf
            j = a[i] + col
            x, y = (np.where(j < b[i], q[np.minimum(j, longest - 1), who], np.inf) for q in (qx, qy))
        dx, dy = px[i] - x, py[i] - y
        d = (dx * dx + dy * dy)[:, :, None]
        np.minimum(prev[1:], prev[:-1], out=step)
        line[0] = np.inf
        for c in range(width):
            np.minimum(step[c], line[c], out=step[c])
            np.maximum(step[c], d[c], out=line[c + 1])
        prev, line = line, prev
        origin = a[i] - 1
    return [np.ascontiguousarray(prev[1:1 + s[5][-1] - s[4][-1], k, :s[6][1] - s[6][0]].T) for k, s in enumerate(strips)]


def compose_values(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The table of two neighbouring strips; exits of ``f`` and entries of ``g`` are the same columns."""
    return np.stack([np.maximum(row[:, None], g).min(0) for row in f])


# --- Spark ------------------------------------------------------------------------------------------
def _pages(curves: DataFrame, curve: str, pos: str, name: str, strip: int) -> DataFrame:
    """Points in pages: the blocks of a strip. A block has at least ``LEAST_BLOCK`` points, a curve at most ``BLOCKS`` blocks."""
    seq = dense_number(curves.select(curve, pos, "x", "y"), [curve], [pos], "_pos")
    n = seq.groupBy(curve).agg((F.max("_pos") + 1).alias("n"))
    size = F.greatest(F.lit(LEAST_BLOCK).cast("long"), F.ceil(F.col("n") / BLOCKS))
    n = n.select(curve, "n", size.alias("size")).withColumn("per", F.greatest(F.lit(1).cast("long"), F.expr(f"{strip} div size")))
    seq = with_summary(seq, n, [curve])
    b = seq.groupBy(curve, "n", "size", "per", F.expr("_pos div (size * per)").alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("_pos", "x", "y"))).alias("pts"))
    return materialize(b.select(
        F.col(curve).alias(name), "n", "size", "per", "page", F.col("pts.x").alias("x"), F.col("pts.y").alias("y")), "blocks")


def _outline(pages: DataFrame, name: str) -> DataFrame:
    """One row per curve with the boxes of its blocks."""
    blocks = F.sequence(F.lit(0), F.ceil(F.size("x") / F.col("size")).cast("int") - 1)
    size = F.col("size").cast("int")

    def of_blocks(best, c):
        return F.transform(blocks, lambda i: best(F.slice(c, i * size + 1, size)))

    boxes = [of_blocks(f, c).alias(a) for a, f, c in (("x0", F.array_min, "x"), ("y0", F.array_min, "y"), ("x1", F.array_max, "x"), ("y1", F.array_max, "y"))]
    out = pages.select(name, "n", "size", "per", F.struct("page", *boxes).alias("box")).groupBy(name).agg(
        *[F.first(c).alias(f"{name}{c}") for c in ("n", "size", "per")], F.sort_array(F.collect_list("box")).alias("b"))
    return out.select(name, *[f"{name}{c}" for c in ("n", "size", "per")], *[F.flatten(F.col(f"b.{c}")).alias(f"{name}{c}") for c in ("x0", "y0", "x1", "y1")])


def _plan(batches, direct: int):
    """Strips of each pair: row blocks, their columns, and bounds of the distance; a pair with few cells left is one strip."""
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            p, q = (np.stack([np.asarray(getattr(r, side + c)) for c in ("x0", "y0", "x1", "y1")], 1) for side in "pq")
            low, high, j0, j1 = stretch(p, q)
            whole = r.pn + r.qn <= DIRECT_POINTS and int((j1 - j0 + 1).sum()) * r.psize * r.qsize <= direct
            way = "whole" if whole else "values" if int((j1 - j0 + 1).max()) * r.qsize <= WIDE else "search"
            per = len(p) if whole else r.pper
            for s, i in enumerate(range(0, len(p), per)):
                e = min(i + per, len(p)) - 1
                before = (int(j0[i - 1]), int(j1[i - 1])) if i else (0, 0)
                q0, q1 = int(min(j0[i], before[0] if i else j0[i])), int(max(j1[e], before[1]))
                rows.append((r.p, r.q, s, i // r.pper, e // r.pper, j0[i:e + 1], j1[i:e + 1], *before, q0, q1, q0 // r.qper, q1 // r.qper,
                             r.psize, r.qsize, r.qper, r.pn, r.qn, low, high, way))
        yield pd.DataFrame(rows, columns=_PLAN)


_PLAN = ["p", "q", "s", "p0", "p1", "j0", "j1", "above0", "above1", "q0", "q1", "qp0", "qp1", "psize", "qsize", "qper", "pn", "qn", "low", "high", "way"]
_PLAN_TYPES = ("s long, p0 long, p1 long, j0 array<long>, j1 array<long>, above0 long, above1 long, q0 long, q1 long, qp0 long, qp1 long, "
               "psize long, qsize long, qper long, pn long, qn long, low double, high double, way string")


def _with_points(strips: DataFrame, pages: DataFrame, name: str, first: str, last: str) -> DataFrame:
    """Add the points of the pages from ``first`` to ``last`` of a curve."""
    need = strips.select("p", "q", "s", F.explode(F.sequence(first, last)).alias("page"))
    pts = need.join(pages.select(name, "page", "x", "y"), [name, "page"]).groupBy("p", "q", "s").agg(
        F.sort_array(F.collect_list(F.struct("page", "x", "y"))).alias("b"))
    pts = pts.select("p", "q", "s", F.flatten("b.x").alias(f"{name}x"), F.flatten("b.y").alias(f"{name}y"))
    return strips.join(pts, ["p", "q", "s"])


def _rows_of(r) -> tuple:
    """Points of a strip and the columns of its rows and of the row above, relative to its own stretch."""
    px, py, qx, qy = (np.asarray(v) for v in (r.px, r.py, r.qx, r.qy))
    block = np.arange(len(px)) // r.psize
    start = r.q0 * r.qsize
    own = slice(start - r.qp0 * r.qper * r.qsize, (r.q1 + 1 - r.qp0 * r.qper) * r.qsize)
    a = (np.asarray(r.j0)[block] * r.qsize - start).astype(np.int64)
    b = np.minimum((np.asarray(r.j1)[block] + 1) * r.qsize, r.qn).astype(np.int64) - start
    above = r.above0 * r.qsize - start, min((r.above1 + 1) * r.qsize, r.qn) - start
    return px, py, qx[own], qy[own], a.tolist(), b.tolist(), above


def _values(batches):
    """Tables of values of neighbouring strips, composed as far as they are at hand."""
    for pdf in batches:
        strips = []
        for r in pdf.itertuples(index=False):
            px, py, qx, qy, a, b, above = _rows_of(r)
            strips.append((px, py, qx, qy, np.asarray(a), np.asarray(b), above if r.s else (-1, 0)))
        rows = []
        for p, q, s, table in zip(pdf.p, pdf.q, pdf.s, strip_values(strips)):
            if rows and rows[-1][:2] == [p, q] and rows[-1][3] + 1 == s:
                rows[-1][3:] = [s, compose_values(rows[-1][4], table)]
            else:
                rows.append([p, q, s, s, table])
        yield pd.DataFrame([(p, q, s, len(t), t.ravel()) for p, q, s, _, t in rows], columns=["p", "q", "s", "entries", "values"])


def walk(px, py, qx, qy) -> float | None:
    """The squared distance if it is that of the first or of the last points: a path of nearest next cells stays within it."""
    def rest(x, y, xs, ys):
        dx, dy = np.asarray(xs) - x, np.asarray(ys) - y
        return float((dx * dx + dy * dy).max())

    n, m = len(px) - 1, len(qx) - 1
    least = max((px[k] - qx[l]) * (px[k] - qx[l]) + (py[k] - qy[l]) * (py[k] - qy[l]) for k, l in ((0, 0), (n, m)))
    i = j = 0
    x, y, u, v = px[0], py[0], qx[0], qy[0]
    while i < n and j < m:
        x1, y1, u1, v1 = px[i + 1], py[i + 1], qx[j + 1], qy[j + 1]
        both = (x1 - u1) * (x1 - u1) + (y1 - v1) * (y1 - v1)
        down = (x1 - u) * (x1 - u) + (y1 - v) * (y1 - v)
        right = (x - u1) * (x - u1) + (y - v1) * (y - v1)
        if both <= down and both <= right:
            i, j, x, y, u, v, d = i + 1, j + 1, x1, y1, u1, v1, both
        elif down <= right:
            i, x, y, d = i + 1, x1, y1, down
        else:
            j, u, v, d = j + 1, u1, v1, right
        if not d <= least:
            return None
    return least if rest(x, y, qx[j:], qy[j:]) <= least and rest(u, v, px[i:], py[i:]) <= least else None


def _walks(batches):
    """Distances of pairs that are settled by their ends."""
    for pdf in batches:
        found = [(r.p, r.q, walk(*(np.asarray(c, float).tolist() for c in (r.px, r.py, r.qx, r.qy)))) for r in pdf.itertuples(index=False)]
        yield pd.DataFrame([(p, q, float(np.sqrt(d))) for p, q, d in found if d is not None], columns=["p", "q", "frechet"])


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """The distance of a pair from the tables of all its strips."""
    out = None
    for r in pdf.sort_values("s").itertuples():
        table = np.asarray(r.values).reshape(r.entries, -1)
        out = table if out is None else compose_values(out, table)
    return pd.DataFrame([(pdf.p.iloc[0], pdf.q.iloc[0], float(np.sqrt(out[0, -1])))], columns=["p", "q", "frechet"])


def _direct(batches):
    """The distance of pairs that are one strip, cell by cell of what is left."""
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            px, py, qx, qy, a, b, _ = _rows_of(r)
            rows.append((r.p, r.q, float(np.sqrt(band_minimax(px, py, qx, qy, np.asarray(a), np.asarray(b))))))
        yield pd.DataFrame(rows, columns=["p", "q", "frechet"])


def _try(batches):
    """The maps of strips at the candidates of their pairs, and distances between the candidates."""
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            px, py, qx, qy, a, b, above = _rows_of(r)
            limits = np.asarray(r.limits)
            step = max(1, ROOM // max(1, len(qx)))
            parts = [strip_map(px, py, qx, qy, a, b, above, limits[k:k + step], r.s == 0) for k in range(0, len(limits), step)]
            lo, hi, live = (np.concatenate(x) for x in zip(*parts))
            # columns count from the first exit, as the next strip's entries do
            lo, hi = np.where(lo <= hi, lo - a[-1], NOWHERE), np.where(lo <= hi, hi - a[-1], -1)
            ends = between(px, py, qx, qy, a, b, np.concatenate([[r.low], limits, [r.high]]))
            rows.append((r.p, r.q, r.s, lo.ravel(), hi.ravel(), live.ravel(), ends, limits, r.low, r.high))
        yield pd.DataFrame(rows, columns=["p", "q", "s", "lo", "hi", "live", "ends", "limits", "low", "high"])


_MAP_TYPES = "s long, lo array<long>, hi array<long>, live array<boolean>, ends array<array<double>>, limits array<double>, low double, high double"


def _together(pdf: pd.DataFrame) -> pd.DataFrame:
    """Compose the maps of neighbouring strips."""
    pdf = pdf.sort_values("s")
    k = len(pdf.limits.iloc[0])
    shaped = [tuple(np.stack(getattr(r, c)).reshape(k, -1) if k else np.zeros((0, 1)) for c in ("lo", "hi", "live")) for r in pdf.itertuples()]
    out = shaped[0]
    for g in shaped[1:]:
        out = compose(out, g)
    ends = [thinned(np.unique(np.concatenate([np.asarray(e[i], float) for e in pdf.ends])), 4 * SAMPLES) for i in range(k + 1)]
    r = pdf.iloc[0]
    return pd.DataFrame([(r.p, r.q, r.s // FAN, *(x.ravel() for x in out), ends, r.limits, r.low, r.high)],
                        columns=["p", "q", "s", "lo", "hi", "live", "ends", "limits", "low", "high"])


def _narrow(batches):
    """The part of the search range that is left, and the next candidates."""
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            limits = np.asarray(r.limits, float)
            through = np.asarray(r.live, bool).reshape(len(limits), -1)[:, -1] if len(limits) else np.zeros(0, bool)
            k = int(np.argmax(through)) if through.any() else len(limits)
            high = float(limits[k]) if k < len(limits) else r.high
            low = float(limits[k - 1]) if k else r.low
            left = np.asarray(r.ends[k], float)
            rows.append((r.p, r.q, low, high, thinned(left, CANDIDATES)))
        yield pd.DataFrame(rows, columns=["p", "q", "low", "high", "limits"])


def frechet_discrete(
    left: DataFrame, right: DataFrame, curve: str = "run", pos: str = "seq", scenario: str | None = None, direct_cells: int | None = None,
) -> DataFrame:
    """Distance of every left curve to every right curve of its scenario: ``p, q, frechet``.

    Curves meet by an equi-join on ``scenario`` (one common scenario when not given): the pairs are
    the requested result, simulated x real runs of a route. Points are never paired by a join.
    """
    spark = left.sparkSession
    ids = f"p {dict(left.dtypes)[curve]}, q {dict(right.dtypes)[curve]}"
    strip, direct = STRIP, DIRECT_CELLS if direct_cells is None else direct_cells
    p, q = _pages(left, curve, pos, "p", strip), _pages(right, curve, pos, "q", strip)

    def outlines(pages, source, name):
        out = _outline(pages, name)
        if scenario is None:
            return out.withColumn("_scenario", F.lit(0))
        return out.join(source.select(F.col(curve).alias(name), F.col(scenario).alias("_scenario")).distinct(), name)

    parallel = spark.sparkContext.defaultParallelism
    pairs = outlines(p, left, "p").join(outlines(q, right, "q"), "_scenario").drop("_scenario").repartition(8 * parallel, "p", "q")
    plan = materialize(pairs.mapInPandas(lambda batches: _plan(batches, direct), f"{ids}, {_PLAN_TYPES}"), "plan")
    ways = {r.way: r.n for r in plan.groupBy("way").agg(F.count(F.lit(1)).alias("n")).collect()}

    def strips_of(way):
        strips = plan.where(F.col("way") == way).drop("low", "high", "way")
        return _with_points(_with_points(strips, p, "p", "p0", "p1"), q, "q", "qp0", "qp1")

    done = []
    if "whole" in ways:
        done.append(materialize(strips_of("whole").repartition(8 * parallel, "p", "q").mapInPandas(_direct, f"{ids}, frechet double"), "direct"))
    if "values" in ways:
        group = F.expr(f"s div {TOGETHER}")
        strips = strips_of("values").repartition(max(parallel, 4 * ways["values"] // TOGETHER), "p", "q", group).sortWithinPartitions("p", "q", "s")
        tables = strips.mapInPandas(_values, f"{ids}, s long, entries long, values array<double>")
        done.append(materialize(tables.groupBy("p", "q").applyInPandas(_chain, f"{ids}, frechet double"), "values"))
    if "search" in ways:
        plan = plan.where("way = 'search'")
        pairs = plan.where(F.col("pn") + F.col("qn") <= WALK_POINTS).groupBy("p", "q").agg(
            F.min("s").alias("s"), *[f(c).alias(c) for f, c in ((F.min, "p0"), (F.max, "p1"), (F.min, "qp0"), (F.max, "qp1"))])
        pairs = _with_points(_with_points(pairs, p, "p", "p0", "p1"), q, "q", "qp0", "qp1").repartition(8 * parallel, "p", "q")
        done.append(materialize(pairs.mapInPandas(_walks, f"{ids}, frechet double"), "ends"))
        plan = plan.join(F.broadcast(done[-1].select("p", "q")), ["p", "q"], "left_anti")
        if not plan.isEmpty():
            strips = _with_points(_with_points(plan.drop("low", "high", "way"), p, "p", "p0", "p1"), q, "q", "qp0", "qp1")
            done += _search(plan, materialize(strips.repartition(parallel, "p", "q", "s"), "strips"), ids)
    out = spark.createDataFrame([], f"{ids}, frechet double")
    for d in done:
        out = out.unionByName(d)
    return out


def _search(plan: DataFrame, strips: DataFrame, ids: str) -> list[DataFrame]:
    """Distances of pairs with wide bands, by a search over the candidates for all of them."""
    parallel, done = plan.sparkSession.sparkContext.defaultParallelism, []
    # both bounds may be reached: the range is open at its ends
    state = plan.where("s = 0").select("p", "q", (F.col("low") * (1 - 1e-12) - 1e-300).alias("low"), (F.col("high") * (1 + 1e-12) + 1e-300).alias("high"))
    step = (F.sqrt("high") - F.sqrt(F.greatest("low", F.lit(0.0)))) / (CANDIDATES + 1)
    even = F.transform(F.sequence(F.lit(1), F.lit(CANDIDATES)), lambda i: F.pow(F.sqrt(F.greatest("low", F.lit(0.0))) + i * step, 2))
    state = materialize(state.withColumn("limits", F.array_sort(F.array_distinct(F.filter(even, lambda v: (v > F.col("low")) & (v < F.col("high")))))), "range")
    most = plan.agg(F.max("s")).first()[0]
    levels, reach = 1, FAN
    while most is not None and reach <= most:
        levels, reach = levels + 1, reach * FAN
    done.append(state.where(F.size("limits") == 0).select("p", "q", F.sqrt("high").alias("frechet")))  # no number lies in between
    state = state.where(F.size("limits") > 0)
    while not state.isEmpty():
        maps = strips.join(state, ["p", "q"]).repartition(parallel, "p", "q", "s").mapInPandas(_try, f"{ids}, {_MAP_TYPES}")
        for _ in range(levels):
            maps = maps.groupBy("p", "q", F.floor(F.col("s") / FAN)).applyInPandas(_together, f"{ids}, {_MAP_TYPES}")
        after = materialize(maps.mapInPandas(_narrow, f"{ids}, low double, high double, limits array<double>"), "range")
        done.append(after.where(F.size("limits") == 0).select("p", "q", F.sqrt("high").alias("frechet")))
        state = after.where(F.size("limits") > 0)
    return done


def frechet_min(pairs: DataFrame, counts: DataFrame | None = None, min_points: int = 10) -> DataFrame:
    """Smallest distance per left curve and the curve it belongs to (first id wins ties).

    ``counts`` (``p, n``) drops left curves with fewer than ``min_points`` points.
    """
    if counts is not None:
        pairs = pairs.join(counts.where(F.col("n") >= min_points), "p", "left_semi")
    return pairs.groupBy("p").agg(F.min(F.struct("frechet", "q")).alias("_m")).select(
        "p", F.col("_m.frechet").alias("min_frechet"), F.col("_m.q").alias("vs")
    )


def downsample_curve(curves: DataFrame, curve: str, pos: str, max_points: int = 500) -> DataFrame:
    """Optional thinning to at most ``max_points`` evenly spread rows (off by default everywhere)."""
    n = curves.groupBy(curve).agg(F.count(F.lit(1)).alias("_n"))
    j = curves.join(n, curve)
    step = (F.col("_n") - 1) / (max_points - 1)
    k = F.ceil(F.col(pos) / step)
    picked = (F.floor(k * step) == F.col(pos)) & (k < max_points)
    return j.where((F.col("_n") <= max_points) | picked).drop("_n")
