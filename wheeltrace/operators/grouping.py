"""Order-dependent grouping of detections: first-fit clusters and the static-object tracker.

Both are greedy loops whose result depends on the order of the rows, so they are folds. A fold runs
once per recording while the recording is small. A recording with more rows than ``max_rows`` is
first cut into spatial components that cannot influence each other:

* first-fit: a member that joins lies closer than 2T to an earlier member (the centroid stays within
  T of the newest member), so groups linked at 2T never share a cluster;
* tracker: a track keeps the position of its last detection, so groups linked at T are independent.

Components are found on occupied grid cells, not on pairs of rows. For the tracker the cells also have a place in
time: no track lives across a gap of more than ``max_age + 1`` processed frames, so cells further apart than that are not
linked, and what stands at one place in two visits falls into two parts. A component that is still larger than
``max_rows`` is folded in ordered slices, written partitioned by slice, carrying only what is open from one slice to the
next: live tracks, and clusters that a later row can still reach. A cluster moves only when a row within the radius joins, so it
is finished once no later row lies in the cells around it. Every path gives the same rows as the plain loop.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wheeltrace.operators.ordered import counted, dense_number
from wheeltrace.session import materialize

MAX_ROWS = 250_000
SPOT = 48   # from so many detections of a frame in one cell on they are searched in the order of x
NEAR = 32   # detections on either side that are looked at first


# --- connected components on occupied cells -------------------------------------------------------
def cell_components(
    df: DataFrame, keys: Sequence[str], xy: tuple[str, str], link: float, time: str | None = None, span: int = 1,
) -> DataFrame:
    """Adds ``comp``: rows of one key closer than ``link`` always share it (it may merge more).

    With ``time`` (a whole number) only rows up to ``span`` apart in time are close.
    """
    keys = list(keys)
    h = link / 2
    cells = [F.floor(F.col(xy[0]) / h).alias("_cx"), F.floor(F.col(xy[1]) / h).alias("_cy"),
             (F.floor(F.col(time) / span) if time else F.lit(0).cast("long")).alias("_ct")]
    at = [*keys, "_cx", "_cy", "_ct"]
    placed = df.select("*", *cells)
    nodes = materialize(placed.select(*at).distinct().withColumn("_id", F.xxhash64(*at)), "cells")
    ahead = [(dx, dy, dt) for dx in range(3) for dy in range(-2, 3) for dt in ((-1, 0, 1) if time else (0,)) if (dx, dy, dt) > (0, 0, 0)]
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(dt).alias("dt")) for dx, dy, dt in ahead])
    reach = nodes.select(*at, F.col("_id").alias("u"), F.explode(steps).alias("d")).select(
        *keys, *[(F.col(c) + F.col(f"d.{d}")).alias(c) for c, d in (("_cx", "dx"), ("_cy", "dy"), ("_ct", "dt"))], "u")
    edges = reach.join(nodes.withColumnRenamed("_id", "v"), at).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).where("u <> v")
    stars = star_components(edges)
    label = nodes.join(stars.select(F.col("u").alias("_id"), F.col("v").alias("_root")), "_id", "left")
    label = counted(label.select(*at, F.coalesce("_root", "_id").alias("comp")))  # the rows stay where they are
    return placed.join(label, at).select(*df.columns, "comp")


def star_components(edges: DataFrame) -> DataFrame:
    """Edges (``u``, ``v``) from every node of a component to its smallest node, from any edges with ``u`` > ``v``.

    Alternating large-star / small-star contraction (Kiveris et al., 2014) until nothing changes. Each round only keeps the minimum per node (a partial aggregate) and joins it back; neighbour
    lists are never collected. The edge table is written every round.
    """
    cur = materialize(edges.distinct(), "edges")
    seen = None
    while True:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))
        )
        cur = materialize(small.where("u <> v").distinct(), "edges")
        mark = tuple(cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            return cur
        seen = mark


# --- fold driver ----------------------------------------------------------------------------------
def ordered_fold(
    items: DataFrame, run: str, order: Sequence[str], xy: tuple[str, str], link: float,
    fold: Callable, schema: str, frame: str | None = None, max_rows: int = MAX_ROWS,
    span: int = 1, centre: tuple[Column, Column] | None = None, radius: float = 0.0,
) -> DataFrame:
    """Run ``fold(state | None, ordered rows) -> state`` per recording, exactly, in bounded groups.

    ``schema`` is the state row, starting with ``run`` and ending with ``done boolean``: rows that are
    done leave the loop. ``frame`` names the column whose rows must stay in one slice; a state row lives on for ``span``
    frames after its last row. ``centre`` of a state row moves only when a row closer than ``radius`` comes. The result is written, so
    that those who read it twice (a sort samples first) do not fold twice.
    """
    order = list(order)
    sizes = items.groupBy(run).agg(F.count(F.lit(1)).alias("_n"))
    big = counted(sizes.where(F.col("_n") > max_rows).select(run))

    def whole(pdf):
        return fold(None, pdf.sort_values(order))

    if big.isEmpty():
        return materialize(items.groupBy(run).applyInPandas(whole, schema), "folded")
    small = items.join(big, run, "left_anti").groupBy(run).applyInPandas(whole, schema)
    large = materialize(cell_components(items.join(big, run, "left_semi"), [run], xy, link, frame, span), "parts")
    counts = large.groupBy(run, "comp").agg(F.count(F.lit(1)).alias("_n"))
    giant = counted(counts.where(F.col("_n") > max_rows).select(run, "comp"))

    def part(pdf):
        return fold(None, pdf.drop(columns="comp").sort_values(order))

    normal = large.join(giant, [run, "comp"], "left_anti").groupBy(run, "comp").applyInPandas(part, schema)
    out = small.unionByName(normal)
    if not giant.isEmpty():
        out = out.unionByName(
            _sliced(large.join(giant, [run, "comp"], "left_semi"), run, order, xy, fold, schema, frame, max_rows, centre, radius))
    return materialize(out, "folded")


def _sliced(items, run, order, xy, fold, schema, frame, max_rows, centre, radius) -> DataFrame:
    keys = [run, "comp"]
    pos = dense_number(items, keys, order, "_pos")
    if frame:
        head = pos.groupBy(*keys, frame).agg(F.min("_pos").alias("_head"))
        pos = pos.join(head, [*keys, frame])
    else:
        pos = pos.withColumn("_head", F.col("_pos"))
    pos = pos.withColumn("_slice", F.expr(f"_head div {max_rows}")).drop("_head", "_pos")
    pos = materialize(pos, "slices", partition_by=["_slice"])
    last = pos.agg(F.max("_slice")).first()[0]
    wide = f"{schema}, comp long"
    names = [c.strip().split()[0] for c in schema.split(",")]
    if centre:
        # the last slice that has a row in each cell, told to the cells around it
        cell = [F.floor(F.col(c) / radius).alias(n) for c, n in zip(xy, ("_cx", "_cy"))]
        seen = pos.groupBy(*keys, *cell).agg(F.max("_slice").alias("_until"))
        near = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
        seen = seen.select(*keys, "_cx", "_cy", "_until", F.explode(near).alias("d")).groupBy(
            *keys, (F.col("_cx") + F.col("d.dx")).alias("_cx"), (F.col("_cy") + F.col("d.dy")).alias("_cy")).agg(F.max("_until").alias("_until"))
        seen = materialize(seen, "seen")

    def step(key, state, rows):
        rows = rows.drop(columns=["comp", "_slice"]).sort_values(order)
        out = fold(state.drop(columns="comp") if len(state) else None, rows)
        return out.assign(comp=key[1])

    finished, state = [], None
    for k in range(last + 1):
        part = pos.where(F.col("_slice") == k).groupBy(*keys)
        if state is None:
            state = items.sparkSession.createDataFrame([], wide)
        after = state.groupBy(*keys).cogroup(part).applyInPandas(step, wide)
        if centre:
            at = [F.floor(c / radius).alias(n) for c, n in zip(centre, ("_cx", "_cy"))]
            after = after.select("*", *at).join(seen, [*keys, "_cx", "_cy"], "left")
            after = after.withColumn("done", F.coalesce(F.col("_until"), F.lit(-1)) <= k).select(*names, "comp")
        after = materialize(after, "state")
        finished.append(after.where("done"))
        state = after.where("not done")
    for done in finished:
        state = state.unionByName(done)
    return state.select(*names)


# --- first fit ------------------------------------------------------------------------------------
BOX = ("bx", "by", "bz", "bl", "bw", "bh", "byaw")


def _first_fit_fold(radius: float, run: str, sums: list[str], mins: list[str], lasts: list[str]):
    """Each row joins the first cluster whose weighted centroid is closer than ``radius``.

    Rows carry weighted sums; the centroid is (bx / w, by / w). Clusters are looked up by the grid
    cell of their centroid, which needs only the 3 x 3 cells around a row.
    """
    cols = [*sums, *mins, *lasts]
    ix, iy, iw = sums.index("bx"), sums.index("by"), sums.index("w")
    ns, nm = len(sums), len(mins)

    def fold(state, pdf):
        vals, firsts, runs, where, grid = [], [], [], [], {}

        def put(k):
            v = vals[k]
            cx, cy = v[ix] / v[iw], v[iy] / v[iw]
            cell = (int(cx // radius), int(cy // radius))
            where[k] = (cx, cy, cell)
            grid.setdefault(cell, []).append(k)

        if state is not None:
            state = state.sort_values("first_ord")
            for row in state[[*cols, "first_ord", run]].itertuples(index=False):
                vals.append(list(row[: len(cols)]))
                firsts.append(row[-2])
                runs.append(row[-1])
                where.append(None)
                put(len(vals) - 1)
        r2 = radius
        for row in pdf[[*cols, "ord", run]].itertuples(index=False):
            w = row[iw]
            px, py = row[ix] / w, row[iy] / w
            gx, gy = int(px // radius), int(py // radius)
            hit = -1
            for cx in (gx - 1, gx, gx + 1):
                for cy in (gy - 1, gy, gy + 1):
                    for k in grid.get((cx, cy), ()):
                        if hit < 0 or k < hit:
                            dx, dy = px - where[k][0], py - where[k][1]
                            if (dx * dx + dy * dy) ** 0.5 < r2:
                                hit = k
            if hit < 0:
                vals.append(list(row[: len(cols)]))
                firsts.append(row[-2])
                runs.append(row[-1])
                where.append(None)
                put(len(vals) - 1)
                continue
            v = vals[hit]
            for a in range(ns):
                v[a] += row[a]
            for a in range(ns, ns + nm):
                v[a] = min(v[a], row[a])
            for a in range(ns + nm, len(cols)):
                v[a] = row[a]
            grid[where[hit][2]].remove(hit)
            put(hit)
        out = pd.DataFrame(vals, columns=cols)
        out.insert(0, run, runs)
        out["first_ord"] = firsts
        out["done"] = False
        return out

    return fold


def first_fit(
    items: DataFrame, radius: float, run: str = "run", ord_: str = "ord", sums: Sequence[str] = (),
    mins: Sequence[str] = (), lasts: Sequence[str] = (), max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Greedy clusters of weighted rows in ``ord`` order.

    ``items`` needs ``bx, by`` (weighted sums), ``w`` > 0 and a unique ``ord`` per run. Returns one
    row per cluster with its summed, minimal and latest values and ``first_ord`` (creation order).
    """
    sums = list(dict.fromkeys(["bx", "by", "w", *sums]))
    types = dict(items.dtypes)
    cols = [*sums, *mins, *lasts]
    schema = ", ".join(
        [f"{run} {types[run]}", *[f"{c} {types[c]}" for c in cols], "first_ord long", "done boolean"]
    )
    rows = items.select(run, F.col(ord_).alias("ord"), *cols,
                        (F.col("bx") / F.col("w")).alias("_x"), (F.col("by") / F.col("w")).alias("_y"))
    fold = _first_fit_fold(radius, run, sums, list(mins), list(lasts))
    centre = F.col("bx") / F.col("w"), F.col("by") / F.col("w")
    return ordered_fold(rows, run, ["ord"], ("_x", "_y"), 2 * radius, fold, schema, max_rows=max_rows, centre=centre, radius=radius).drop("done")


# --- tracker --------------------------------------------------------------------------------------
_TRACK = ("first_frame", "first_det", "last_frame", "px", "py", "hits", "n_par", "n_perp", "w", *BOX)


class _Spot:
    """The many detections of a frame in one cell, in the order of x. Taken ones leave when they are half of them."""

    def __init__(self, ks: list[int], dets: list):
        x, y = np.array([dets[k][2] for k in ks], float), np.array([dets[k][3] for k in ks], float)
        self._keep(np.array(ks), x, y, np.argsort(x, kind="stable"))

    def _keep(self, k, x, y, at):
        self.k, self.x, self.y = k[at], x[at], y[at]
        self.gone, self.taken = np.zeros(len(self.k)), 0
        self.box = (self.x[0], self.x[-1], self.y.min(), self.y.max()) if len(self.k) else None

    def nearest(self, px: float, py: float, best: float, pick: int) -> tuple[float, int, int] | None:
        """(distance, number, place) of the nearest free detection, if it comes before ``pick`` at distance ``best``."""
        if self.box is None:
            return None
        x0, x1, y0, y1 = self.box
        if x0 - px > best or px - x1 > best or y0 - py > best or py - y1 > best:
            return None
        found, n = None, len(self.x)
        at = int(self.x.searchsorted(px))
        lo, hi = max(at - NEAR, 0), min(at + NEAR, n)
        spans = [(lo, hi)]
        for last in (False, True):
            for a, b in spans:
                if a >= b:
                    continue
                dx, dy = self.x[a:b] - px, self.y[a:b] - py
                d = np.sqrt(dx * dx + dy * dy) + self.gone[a:b]
                m = float(d.min())
                if m > best or (m == best and pick < 0):
                    continue
                same = np.flatnonzero(d == m)
                place = a + int(same[self.k[a:b][same].argmin()])
                k = int(self.k[place])
                if m < best or k < pick:
                    best, pick, found = m, k, (m, k, place)
            if not last:  # then all that are not farther by x alone
                reach = best * (1 + 1e-9)
                spans = [(int(self.x.searchsorted(px - reach)), lo), (hi, int(self.x.searchsorted(px + reach, "right")))]
        return found

    def take(self, place: int) -> None:
        self.gone[place] = np.inf
        self.taken += 1
        if 2 * self.taken >= len(self.k):
            self._keep(self.k, self.x, self.y, np.flatnonzero(self.gone == 0))


def _track_fold(radius: float, max_age: int, run: str):
    """Tracks take, in creation order, their nearest free detection of the frame.

    A track that was last hit in frame f still matches in frames up to f + max_age + 1. The detections of a frame lie in cells; a cell
    that holds many of them is searched by x from the track on, so the work does not grow with the square of what stands at one place.
    """
    keep = max_age + 1
    first, last, px, py, hits, npar, nperp, w0 = 0, 2, 3, 4, 5, 6, 7, 8

    def fold(state, pdf):
        live, dead = [], []
        run_id = None
        if state is not None:
            state = state.sort_values(["first_frame", "first_det"])
            run_id = state[run].iloc[0]
            live = [list(r) for r in state[list(_TRACK)].itertuples(index=False)]
        if len(pdf):
            run_id = pdf[run].iloc[0]
        cols = pdf[["frame", "det_idx", "x", "y", "par", "w", *BOX]]
        cur, dets = None, []

        def finish_frame():
            nonlocal live
            alive = []
            for t in live:
                (alive if t[last] + keep >= cur else dead).append(t)
            live = alive
            grid = {}
            for k, d in enumerate(dets):
                grid.setdefault((int(d[2] // radius), int(d[3] // radius)), []).append(k)
            for cell, ks in grid.items():
                if len(ks) > SPOT:
                    grid[cell] = _Spot(ks, dets)
            free = [True] * len(dets)
            for t in live:
                gx, gy = int(t[px] // radius), int(t[py] // radius)
                best, pick, spot, place = radius, -1, None, -1
                for cx in (gx, gx - 1, gx + 1):
                    for cy in (gy, gy - 1, gy + 1):
                        own = grid.get((cx, cy), ())
                        if type(own) is _Spot:
                            near = own.nearest(t[px], t[py], best, pick)
                            if near:
                                (best, pick, place), spot = near, own
                            continue
                        for k in own:
                            if free[k]:
                                dx, dy = dets[k][2] - t[px], dets[k][3] - t[py]
                                dist = sqrt(dx * dx + dy * dy)
                                if dist < best or (dist == best and pick > k >= 0):
                                    best, pick, spot = dist, k, None
                if pick >= 0:
                    if spot is not None:
                        spot.take(place)
                    d = dets[pick]
                    free[pick] = False
                    t[last], t[px], t[py] = cur, d[2], d[3]
                    t[hits] += 1
                    t[npar] += d[4]
                    t[nperp] += 1 - d[4]
                    for a in range(8):
                        t[w0 + a] += d[5 + a]
            for k, d in enumerate(dets):
                if free[k]:
                    live.append([cur, d[1], cur, d[2], d[3], 1, d[4], 1 - d[4], *d[5:13]])

        for row in cols.itertuples(index=False):
            if row[0] != cur:
                if cur is not None:
                    finish_frame()
                cur, dets = row[0], []
            dets.append(row)
        if cur is not None:
            finish_frame()
        out = pd.DataFrame(live + dead, columns=list(_TRACK))
        out.insert(0, run, run_id)
        out["done"] = [False] * len(live) + [True] * len(dead)
        return out

    return fold


def track_static(
    detections: DataFrame, last_frames: DataFrame, radius: float = 2.0, max_age: int = 15, min_hits: int = 4,
    run: str = "run", max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Confirmed tracks of static objects.

    ``detections``: ``run, frame`` (running number of the processed frame, empty frames included),
    ``det_idx, x, y`` (global), ``score, orient`` and a box ``bx..byaw``. ``last_frames``: ``run,
    last`` with the number of the last processed frame. Returns one row per confirmed track with
    score-weighted box sums, hits, orientation counts, ``archived``, ``archive_frame`` and ``ord``:
    live tracks first, then archived ones in archive order.
    """
    s = F.col("score")
    items = detections.select(
        run, F.col("frame").cast("long").alias("frame"), F.col("det_idx").cast("long").alias("det_idx"), "x", "y",
        (F.col("orient") == "parallel").cast("long").alias("par"), s.alias("w"),
        *[(F.col(b) * s).alias(b) for b in BOX],
    )
    types = dict(items.dtypes)
    schema = (
        f"{run} {types[run]}, first_frame long, first_det long, last_frame long, px double, py double, hits long, "
        "n_par long, n_perp long, w double, " + ", ".join(f"{b} double" for b in BOX) + ", done boolean"
    )
    raw = ordered_fold(items, run, ["frame", "det_idx"], ("x", "y"), radius, _track_fold(radius, max_age, run),
                       schema, frame="frame", max_rows=max_rows, span=max_age + 1)
    gone = F.col("last_frame") + max_age + 1
    tracks = (
        raw.drop("done").where(F.col("hits") >= min_hits).join(last_frames.select(run, "last"), run)
        .select("*", (gone <= F.col("last")).alias("archived"))
        .withColumn("archive_frame", F.when(F.col("archived"), gone).otherwise(F.lit(-1).cast("long")))
        .drop("last")
    )
    order = ["archived", "archive_frame", "first_frame", "first_det"]
    return dense_number(tracks, [run], order, "ord")


def cluster_tracks(tracks: DataFrame, radius: float = 1.8, run: str = "run", max_rows: int = MAX_ROWS) -> DataFrame:
    """First stage: tracks in confirmed order into first-fit clusters."""
    return first_fit(tracks, radius, run, "ord", [*BOX, "w", "hits", "n_par", "n_perp"], ["first_frame"],
                     max_rows=max_rows)


def merge_clusters(clusters: DataFrame, radius: float = 2.5, run: str = "run", max_rows: int = MAX_ROWS) -> DataFrame:
    """Second stage. A forward pass in which each cluster absorbs all later ones in reach is the same
    as first-fit: a row is tested against the earliest cluster in the state left by the rows before it.
    """
    return first_fit(clusters, radius, run, "first_ord", [*BOX, "w", "hits", "n_par", "n_perp"], ["first_frame"],
                     max_rows=max_rows)


def cluster_detections(
    detections: DataFrame, radius: float = 2.0, run: str = "run", order: Sequence[str] = ("frame", "det_idx"),
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Score-weighted first-fit clusters of single detections with circular yaw sums."""
    s = F.col("score")
    items = dense_number(detections, [run], list(order), "ord").select(
        run, "ord", *[(F.col(b) * s).alias(b) for b in BOX], s.alias("w"), F.lit(1).cast("long").alias("count"),
        (F.sin("byaw") * s).alias("yaw_sin"), (F.cos("byaw") * s).alias("yaw_cos"), s.alias("last_conf"),
    )
    return first_fit(items, radius, run, "ord", [*BOX, "w", "count", "yaw_sin", "yaw_cos"], (), ["last_conf"],
                     max_rows=max_rows)


def yaw_vote(detections: DataFrame, keys: Sequence[str], label: str = "orient") -> DataFrame:
    """Orientation label counts per track as a map."""
    n = detections.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(label, "_n")))).alias("votes"))
