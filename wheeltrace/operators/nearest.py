"""Nearest target lookup with packed bounding-box trees, exact at any distance.

Targets (path vertices, cameras, line segments) are sorted along a space-filling curve and packed into a static tree: the
boxes of ``FAN`` neighbours, the boxes of ``FAN`` of those, and so on, held as plain arrays. The curve has square cells, so that
the boxes of a long and narrow path stay short too. A batch of points goes down together: first each to the box of every level that
surely holds a target nearest by, which bounds its distance, then to all boxes within the bound, which the farthest corners of the
boxes met tighten. The pairs of points and boxes are taken up to ``PAIRS`` at once, whatever the shape of the data.

While the targets fit into ``BROADCAST_BYTES`` (counted) they are broadcast, and the points are read once where they are.
Beyond that they are written in ranges along the curve with one tree per range. A point visits the ranges that can hold its
nearest target, those whose least distance is within the least of the largest distances of all ranges of its key; visits of one
range are dealt to tasks of bounded size, and the best of a point's visits wins.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wheeltrace.operators.ordered import counted
from wheeltrace.session import materialize

FAN = 16
BROADCAST_BYTES = 64 << 20
RANGE_ROWS = 200_000      # targets of a range
VISIT_ROWS = 400_000      # points of a range in one task
CHUNK = 4096              # points that go down a tree together
PAIRS = 1 << 19           # pairs of points and boxes held at once (of a single point: all its boxes)


def vertex(x: str, y: str) -> dict[str, Column]:
    return {"x0": F.col(x), "y0": F.col(y)}


def segment(x0: str, y0: str, x1: str, y1: str) -> dict[str, Column]:
    return {"x0": F.col(x0), "y0": F.col(y0), "x1": F.col(x1), "y1": F.col(y1)}


def interleaved(x: np.ndarray, y: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """Place on a space-filling curve: the bits of both coordinates (31 each) in turn, at one scale for both."""
    out = np.zeros(len(x), np.int64)
    span = max(box[2] - box[0], box[3] - box[1])
    if not span > 0:
        return out
    for shift, v, lo in ((0, x, box[0]), (1, y, box[1])):
        k = np.clip(np.nan_to_num((v - lo) / span) * (2**31 - 1), 0, 2**31 - 1).astype(np.int64)
        for bits, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            k = (k | (k << bits)) & mask
        out |= k << shift
    return out


class PackedTree:
    """Boxes over targets given as arrays x0, y0 (and x1, y1 for segments) with their order numbers."""

    def __init__(self, x0, y0, x1, y1, order):
        ends = [np.asarray(v, float) for v in (x0, y0, x0 if x1 is None else x1, y0 if y1 is None else y1)]
        box = np.stack([np.minimum(ends[0], ends[2]), np.minimum(ends[1], ends[3]), np.maximum(ends[0], ends[2]), np.maximum(ends[1], ends[3])], 1)
        mid = (box[:, :2] + box[:, 2:]) / 2
        at = interleaved(mid[:, 0], mid[:, 1], (*mid.min(0), *mid.max(0)))
        self.rows = np.argsort(at, kind="stable")
        self.line = x1 is not None
        self.ends = [v[self.rows] for v in ends]
        self.order = np.asarray(order)[self.rows]
        self.levels = []
        box = box[self.rows]
        while True:
            pad = -len(box) % FAN
            if pad:  # places without a box are at no finite distance
                box = np.concatenate([box, np.tile([np.inf, np.inf, -np.inf, -np.inf], (pad, 1))])
            parts = box.reshape(-1, FAN, 4)
            box = np.concatenate([parts[:, :, :2].min(1), parts[:, :, 2:].max(1)], 1)
            self.levels.append(box)
            if len(box) == 1:
                break
        self.levels.reverse()

    @staticmethod
    def _gap(px, py, box):
        dx = np.maximum(np.maximum(box[..., 0] - px, px - box[..., 2]), 0)
        dy = np.maximum(np.maximum(box[..., 1] - py, py - box[..., 3]), 0)
        return dx * dx + dy * dy

    @staticmethod
    def _far(px, py, box):
        """Squared distance to the farthest corner: a box holds a target at most as far."""
        dx = np.maximum(np.abs(px - box[..., 0]), np.abs(px - box[..., 2]))
        dy = np.maximum(np.abs(py - box[..., 1]), np.abs(py - box[..., 3]))
        return (dx * dx + dy * dy) * (1 + 1e-9) + 1e-300

    def _exact(self, px, py, t):
        """Squared distance of points to targets."""
        x0, y0 = self.ends[0][t], self.ends[1][t]
        if not self.line:
            dx, dy = px - x0, py - y0
            return dx * dx + dy * dy
        ex, ey = self.ends[2][t] - x0, self.ends[3][t] - y0
        size = ex * ex + ey * ey
        u = np.divide((px - x0) * ex + (py - y0) * ey, size, out=np.zeros(len(size)), where=size > 0)
        u = np.maximum(0.0, np.minimum(1.0, u))
        dx, dy = px - (x0 + u * ex), py - (y0 + u * ey)
        return dx * dx + dy * dy

    def search(self, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distance and row of the nearest target of each point; of equally near ones the least order number."""
        parts = [self._part(px[i:i + CHUNK], py[i:i + CHUNK]) for i in range(0, len(px), CHUNK)]
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0), np.zeros(0, np.int64))

    def _children(self, level, who, node):
        kids = (node[:, None] * FAN + np.arange(FAN)).ravel()
        who = np.repeat(who, FAN)
        n = len(self.levels[level]) if level < len(self.levels) else len(self.order)
        real = kids < n
        return who[real], kids[real]

    def _part(self, px, py):
        n, depth = len(px), len(self.levels)
        # down to one box of every level: a bound
        node = np.zeros(n, np.int64)
        for level in range(1, depth):
            kids = np.minimum(node[:, None] * FAN + np.arange(FAN), len(self.levels[level]) - 1)
            node = kids[np.arange(n), self._far(px[:, None], py[:, None], self.levels[level][kids]).argmin(1)]
        who, t = self._children(depth, np.arange(n), node)
        bound = np.full(n, np.inf)
        np.minimum.at(bound, who, self._exact(px[who], py[who], t))
        bound = bound * (1 + 1e-9) + 1e-300
        best, row = np.full(n, np.inf), np.zeros(n, np.int64)
        todo = [(1, np.arange(n), np.zeros(n, np.int64))]
        while todo:
            level, who, node = todo.pop()
            if len(who) * FAN > PAIRS and who[0] != who[-1]:
                # too many at once: in two parts, a point in one of them
                at = who[len(who) // 2]
                cut = np.searchsorted(who, at) or np.searchsorted(who, at, "right")
                todo += [(level, who[cut:], node[cut:]), (level, who[:cut], node[:cut])]
                continue
            who, node = self._children(level, who, node)
            if level < depth:
                box = self.levels[level][node]
                np.minimum.at(bound, who, self._far(px[who], py[who], box))
                near = self._gap(px[who], py[who], box) <= bound[who]
                todo.append((level + 1, who[near], node[near]))
                continue
            d = self._exact(px[who], py[who], node)
            np.minimum.at(best, who, d)
            tie = d == best[who]
            who, t = who[tie], node[tie]
            first = np.lexsort((self.order[t], who))
            who, t = who[first], t[first]
            head = np.append(True, who[1:] != who[:-1])
            row[who[head]] = self.rows[t[head]]
        return best, row


def _numbers(col) -> np.ndarray:
    return np.asarray(col.to_numpy(zero_copy_only=False) if isinstance(col, pa.Array) else col.to_numpy(), float)


def _tree(t: pa.Table, line: bool) -> PackedTree:
    ends = [_numbers(t.column(c)) for c in ("_x0", "_y0", *(("_x1", "_y1") if line else ()))]
    order = t.column("_ord").to_numpy()
    return PackedTree(*ends, *([None, None] if not line else []), order)


class _Forest:
    """Trees of the keys of a broadcast table, each built when a point first asks for it."""

    def __init__(self, t: pa.Table, keys: int, line: bool):
        self.t, self.line, self.built = t, line, {}
        names, code = [], np.zeros(t.num_rows, np.int64)
        for k in range(keys):
            own = t.column(k).combine_chunks().dictionary_encode()
            at = own.indices.to_numpy()
            names.append((own.dictionary.to_pylist(), at))
            _, code = np.unique(code * len(own.dictionary) + at, return_inverse=True)
        by = np.argsort(code, kind="stable")
        cuts = np.flatnonzero(np.diff(code[by])) + 1
        self.rows = {tuple(values[at[rows[0]]] for values, at in names): rows for rows in np.split(by, cuts) if len(rows)}

    def get(self, key: tuple):
        if key not in self.built:
            rows = self.rows.get(key)
            self.built[key] = None if rows is None else (rows, _tree(self.t.take(pa.array(rows)), self.line))
        return self.built[key]


def nearest_target(
    points: DataFrame,
    targets: DataFrame,
    keys: Sequence[str],
    point_id: Sequence[str],
    xy: tuple[str, str],
    shape: dict[str, Column],
    order: str,
    payload: Sequence[str] = (),
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """Left-joins the nearest target of the same key; adds ``dist``, ``order`` and ``payload``.

    Equal distances go to the smallest ``order`` (a number). Points without coordinates or with a null key, and points of a key
    without targets, get NULLs. ``point_id`` identifies a point row; it is used only when the targets are too large to broadcast.
    """
    keys, line = list(keys), "x1" in shape
    ends = [c.cast("double").alias(f"_{n}") for n, c in shape.items()]
    # a payload that is a coordinate is held once
    given, kinds = {c._jc.toString(): f"_{n}" for n, c in shape.items()}, dict(targets.dtypes)
    held = [given.get(p, f"_p{i}") if kinds.get(p) == "double" else f"_p{i}" for i, p in enumerate(payload)]
    t = targets.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *ends, F.col(order).alias("_ord"),
                       *[F.col(p).alias(f"_p{i}") for i, p in enumerate(payload) if held[i] == f"_p{i}"])
    coords = ["_x0", "_y0", *(["_x1", "_y1"] if line else [])]
    usable = F.lit(True)
    for c in coords:
        usable = usable & F.col(c).isNotNull() & ~F.isnan(c)
    for i in range(len(keys)):
        usable = usable & F.col(f"_k{i}").isNotNull()
    t = t.where(usable)
    # counted bytes: eight for numbers, what they hold for others
    fixed = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp", "timestamp_ntz")
    size = F.sum(F.lit(0).cast("long"))
    for c, kind in t.dtypes:
        size = size + (F.count(F.lit(1)) * 8 if kind in fixed else F.coalesce(F.sum(F.length(F.col(c).cast("string"))), F.lit(0)) * 2)
    lim = t.agg(size.alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("_x0"), F.min("_y0"), F.max("_x0"), F.max("_y0")).first()
    types = {f.name: f.dataType for f in t.schema.fields}
    added = [T.StructField("dist", T.DoubleType()), T.StructField(order, types["_ord"]),
             *[T.StructField(p, types[h]) for p, h in zip(payload, held)]]
    if not lim["n"]:
        return points.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in added])
    limit = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    if lim["bytes"] <= limit:
        return _broadcast(points, t, keys, xy, line, added, held)
    return _by_ranges(points, t, keys, list(point_id), xy, line, added, held, lim)


def _broadcast(points, t, keys, xy, line, added, payload) -> DataFrame:
    held = points.sparkSession.sparkContext.broadcast(t.toArrow())
    names = [f.name for f in added]

    def run(batches):
        forest = _Forest(held.value, len(keys), line)
        for batch in batches:
            n = batch.num_rows
            px, py = (_numbers(batch.column(batch.schema.get_field_index(c))) for c in xy)
            dist, row = np.full(n, np.nan), np.full(n, -1)
            ok = ~(np.isnan(px) | np.isnan(py))
            if keys:
                own: dict[tuple, list[int]] = {}
                for i, key in enumerate(zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys))):
                    if ok[i]:
                        own.setdefault(key, []).append(i)
                groups = [(k, np.array(v)) for k, v in own.items()]
            else:
                groups = [((), np.flatnonzero(ok))]
            for key, idx in groups:
                found = forest.get(key)
                if found is not None and len(idx):
                    d, r = found[1].search(px[idx], py[idx])
                    dist[idx], row[idx] = np.sqrt(d), found[0][r]
            take = pa.array(row, mask=row < 0)
            cols = [pa.array(dist, mask=row < 0), *[forest.t.column(c).take(take).combine_chunks() for c in ("_ord", *payload)]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, *names])

    return points.mapInArrow(run, T.StructType([*points.schema.fields, *added]))


def _by_ranges(points, t, keys, point_id, xy, line, added, payload, lim) -> DataFrame:
    ks = [f"_k{i}" for i in range(len(keys))]
    box = tuple(lim[2:6])
    coords = ["_x0", "_y0", *(["_x1", "_y1"] if line else [])]

    def curve(batches):
        for b in batches:
            z = interleaved(_numbers(b.column(b.schema.get_field_index("_x0"))), _numbers(b.column(b.schema.get_field_index("_y0"))), box)
            yield b.append_column("_z", pa.array(z))

    placed = t.mapInArrow(curve, T.StructType([*t.schema.fields, T.StructField("_z", T.LongType())]))
    ranges = -(-lim["n"] // RANGE_ROWS)
    placed = placed.repartitionByRange(ranges, *ks, "_z").withColumn("_part", F.spark_partition_id())
    placed = materialize(placed.drop("_z"), "ranges")
    x1, y1 = ("_x1", "_y1") if line else ("_x0", "_y0")
    boxes = placed.groupBy(*ks, "_part").agg(
        F.min(F.least("_x0", x1)).alias("ax"), F.min(F.least("_y0", y1)).alias("ay"),
        F.max(F.greatest("_x0", x1)).alias("bx"), F.max(F.greatest("_y0", y1)).alias("by"))
    # one row per key: a join that moved the points would deal all points of a key to one task
    boxes = counted(boxes.groupBy(*ks).agg(F.collect_list(F.struct("_part", "ax", "ay", "bx", "by")).alias("_boxes")))
    px, py = F.col("_px"), F.col("_py")

    def gap(b):
        dx, dy = F.greatest(b["ax"] - px, px - b["bx"], F.lit(0.0)), F.greatest(b["ay"] - py, py - b["by"], F.lit(0.0))
        return dx * dx + dy * dy

    def far(b):
        dx, dy = F.greatest(F.abs(px - b["ax"]), F.abs(px - b["bx"])), F.greatest(F.abs(py - b["ay"]), F.abs(py - b["by"]))
        return dx * dx + dy * dy

    ids = [f"_i{i}" for i in range(len(point_id))]
    asked = points.select(*[F.col(c).alias(i) for c, i in zip(point_id, ids)], *[F.col(c).alias(k) for c, k in zip(keys, ks)],
                          F.col(xy[0]).cast("double").alias("_px"), F.col(xy[1]).cast("double").alias("_py"))
    asked = asked.where(px.isNotNull() & py.isNotNull())
    asked = asked.join(boxes, ks) if ks else asked.join(boxes.withColumn("_one", F.lit(0)), F.lit(0) == F.col("_one")).drop("_one")
    bound = F.array_min(F.transform("_boxes", far)) * (1 + 1e-9) + 1e-300
    asked = asked.withColumn("_bound", bound).select(
        *ids, *ks, "_px", "_py", F.explode(F.filter("_boxes", lambda b: gap(b) <= F.col("_bound"))).alias("_b"))
    asked = materialize(asked.select(*ids, *ks, "_px", "_py", F.col("_b._part").alias("_part")), "visits")
    salts = asked.groupBy(*ks, "_part").agg(F.ceil(F.count(F.lit(1)) / VISIT_ROWS).cast("int").alias("_salts"))
    salts = materialize(salts, "salts")
    group = [*ks, "_part", "_salt"]
    asked = asked.join(salts, [*ks, "_part"]).withColumn("_salt", F.pmod(F.xxhash64(*ids), F.col("_salts")).cast("int")).drop("_salts")
    there = placed.join(salts, [*ks, "_part"]).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    types = {f.name: f.dataType for f in asked.schema.fields}
    fields = [f"_f{i}" for i in range(len(payload) + 1)]
    schema = T.StructType([*[T.StructField(i, types[i]) for i in ids], T.StructField("_d2", T.DoubleType()),
                           *[T.StructField(n, f.dataType) for n, f in zip(fields, added[1:])]])

    def visit(own: pa.Table, at: pa.Table) -> pa.Table:
        if not own.num_rows or not at.num_rows:
            return schema_arrow(own, at)
        d, row = _tree(at, line).search(_numbers(own.column("_px")), _numbers(own.column("_py")))
        row = pa.array(row)
        return pa.table([*[own.column(i) for i in ids], pa.array(d), *[at.column(c).take(row) for c in ("_ord", *payload)]],
                        [*ids, "_d2", *fields])

    def schema_arrow(own, at):
        return pa.table([*[own.column(i).slice(0, 0) for i in ids], pa.array([], pa.float64()), *[at.column(c).slice(0, 0) for c in ("_ord", *payload)]],
                        [*ids, "_d2", *fields])

    best = asked.groupBy(*group).cogroup(there.groupBy(*group)).applyInArrow(visit, schema)
    best = best.groupBy(*ids).agg(F.min(F.struct("_d2", *fields)).alias("_best"))
    on = points.columns
    held = points.select(F.struct(*[F.col(f"`{c}`") for c in on]).alias("_row"), *[F.col(c).alias(i) for c, i in zip(point_id, ids)])
    out = held.join(best, ids, "left")
    return out.select("_row.*", F.sqrt("_best._d2").alias("dist"), *[F.col(f"_best.{n}").alias(f.name) for n, f in zip(fields, added[1:])])
