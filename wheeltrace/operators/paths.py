"""Path algebra: arc length, resampling, projection onto a path, tangents, lines and segments."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wheeltrace.functions.angles import TWO_PI, heading, rear_offset, wrap_rad
from wheeltrace.operators.nearest import nearest_target, segment, vertex
from wheeltrace.operators.ordered import (
    CHUNK_ROWS, dense_number, halo_window, neighbours, running, with_halo, with_summary,
)
from wheeltrace.operators.timesync import interp_series
from wheeltrace.session import materialize


def pose_variants(df: DataFrame, x, y, kinematic_yaw, odom_yaw, keep: Sequence[str]) -> DataFrame:
    """Each pose as four rows: centre and rear axle, for the kinematic and the odometry yaw."""
    rows = []
    for label, yaw in (("kinematic", kinematic_yaw), ("odom", odom_yaw)):
        rx, ry = rear_offset(x, y, yaw)
        for name, px, py in ((label, F.col(x), F.col(y)), (f"{label}_rear", rx, ry)):
            rows.append(F.struct(F.lit(name).alias("variant"), px.alias("x"), py.alias("y"), F.col(yaw).alias("yaw")))
    return df.select(*keep, F.inline(F.array(*rows)))


def arc_length(
    df: DataFrame, keys, pos: str, x: str = "x", y: str = "y", name: str = "s", rows: int = CHUNK_ROWS
) -> DataFrame:
    """Cumulative Euclidean step length, 0 at the first row."""
    step = neighbours(df, keys, pos, {"_px": (x, -1), "_py": (y, -1)}, rows, keep_chunk=True)
    dx, dy = F.col(x) - F.col("_px"), F.col(y) - F.col("_py")
    step = step.select(*df.columns, "_chunk", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)).alias("_ds"))
    return running(step, keys, pos, {name: ("sum", F.col("_ds"))}, rows).drop("_ds")


def resample_path(
    path: DataFrame, keys, pos: str, s: str = "s", x: str = "x", y: str = "y",
    spacing: float | None = 0.5, n: int | None = None,
) -> DataFrame:
    """Uniform stations along arc length: ``max(int(L / spacing) + 1, 2)`` of them, or exactly ``n``.

    Stations are spread evenly from 0 to L, so the real spacing is at least the nominal one.
    """
    keys = list(keys)
    total = path.groupBy(*keys).agg(F.max(s).alias("_len"))
    count = F.lit(n) if n else F.greatest(F.floor(F.col("_len") / spacing) + 1, F.lit(2))
    stations = (
        total.select(*keys, "_len", count.cast("long").alias("_n"))
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("idx"))
        .select(*keys, "idx", (F.when(F.col("idx") == F.col("_n") - 1, F.col("_len"))
                               .otherwise(F.col("idx") * (F.col("_len") / (F.col("_n") - 1)))).alias("_at"))
    )
    samples = path.select(*keys, F.col(pos).alias("_tie"), F.col(s).alias("_at"), F.col(x).alias("x"), F.col(y).alias("y"))
    out = interp_series(stations, samples, keys, "_at", ["x", "y"], tie="_tie")
    return out.withColumnRenamed("_at", "s")


def nearest_path_point(
    points: DataFrame, path: DataFrame, keys, point_id, xy=("x", "y"), path_xy=("x", "y"),
    idx: str = "idx", payload=("s",), **kw,
) -> DataFrame:
    """Nearest reference vertex of each point; the first vertex wins ties."""
    return nearest_target(points, path, keys, point_id, xy, vertex(*path_xy), idx, payload, **kw)


def monotone_progress(df: DataFrame, keys, pos: str, s: str = "s", name="progress", rows=CHUNK_ROWS) -> DataFrame:
    return running(df, keys, pos, {name: ("max", F.col(s))}, rows)


def strict_increase(df: DataFrame, keys, pos: str, progress: str = "progress", rows=CHUNK_ROWS) -> DataFrame:
    """Rows where progress rises; the first row is compared with -1."""
    out = neighbours(df, keys, pos, {"_prev": (progress, -1)}, rows)
    return out.where(F.col(progress) - F.coalesce("_prev", F.lit(-1.0)) > 0).drop("_prev")


def forward_tangent(path: DataFrame, keys, idx: str = "idx", x="x", y="y", rows=CHUNK_ROWS) -> DataFrame:
    """Step to the next vertex (the last vertex uses the previous step): ``tx``, ``ty``."""
    out = neighbours(path, keys, idx, {"_nx": (x, 1), "_ny": (y, 1), "_px": (x, -1), "_py": (y, -1)}, rows)
    return out.select(
        *path.columns,
        F.coalesce(F.col("_nx") - F.col(x), F.col(x) - F.col("_px")).alias("tx"),
        F.coalesce(F.col("_ny") - F.col(y), F.col(y) - F.col("_py")).alias("ty"),
    )


def signed_lateral(px, py, rx, ry, tx, ty) -> Column:
    """Signed offset from the tangent line; plain distance where the tangent vanishes."""
    dx, dy = F.col(px) - F.col(rx), F.col(py) - F.col(ry)
    norm = F.sqrt(F.col(tx) * F.col(tx) + F.col(ty) * F.col(ty))
    return F.when(norm > 1e-9, (F.col(tx) * dy - F.col(ty) * dx) / norm).otherwise(
        F.sqrt(dx * dx + dy * dy)
    )


def project_runs(
    runs: DataFrame, path: DataFrame, path_keys=(), run_keys=("run",), pos: str = "seq", rows=CHUNK_ROWS,
) -> DataFrame:
    """Nearest vertex, monotone progress and signed lateral offset of every run point.

    Adds ``idx``, ``dist``, ``s``, ``progress``, ``offset_m``. ``path`` needs ``idx, x, y, s``.
    """
    ref = forward_tangent(_keyed(path, path_keys), path_keys or ["_k"]).select(
        *(path_keys or ["_k"]), "idx", "s", F.col("x").alias("rx"), F.col("y").alias("ry"), "tx", "ty"
    )
    pts = _keyed(runs, path_keys)
    near = nearest_target(pts, ref, path_keys or ["_k"], [*run_keys, pos], ("x", "y"), vertex("rx", "ry"),
                        "idx", ("s", "rx", "ry", "tx", "ty"))
    near = near.select(
        *runs.columns, "idx", "dist", "s", signed_lateral("x", "y", "rx", "ry", "tx", "ty").alias("offset_m")
    )
    return monotone_progress(materialize(near, "projected"), run_keys, pos, rows=rows)


def _keyed(df: DataFrame, keys) -> DataFrame:
    return df if keys else df.withColumn("_k", F.lit(0))


def kinematic_yaw(
    df: DataFrame, keys, pos: str, x="x", y="y", lookahead: int = 5, name="yaw_deg", rows=CHUNK_ROWS
) -> DataFrame:
    """Heading towards the row ``lookahead`` ahead, clamped to the last row; the last row looks back.

    A standstill keeps the last valid heading, starting from 0.
    """
    w = halo_window(keys, pos)
    tail = w.rowsBetween(0, lookahead)  # ends at row i + lookahead, or at the last row of the key
    h = with_halo(df, keys, pos, lookahead, lookahead, rows)
    h = h.select(
        "*", F.last(F.struct(x, y, pos)).over(tail).alias("_to"),
        F.coalesce(F.lag(F.struct(x, y), lookahead).over(w), F.first(F.struct(x, y)).over(w)).alias("_back"),
    )
    h = h.where("_own").drop("_own")
    last_row = F.col("_to")[pos] == F.col(pos)
    head = F.when(
        last_row, heading(F.col("_back")[x], F.col("_back")[y], F.col(x), F.col(y))
    ).otherwise(heading(F.col(x), F.col(y), F.col("_to")[x], F.col("_to")[y]))
    h = h.select(*df.columns, "_chunk", head.alias("_head"))
    out = running(h, keys, pos, {name: ("last", F.col("_head"))}, rows)
    return out.select(*df.columns, F.coalesce(name, F.lit(0.0)).alias(name))


def dedupe_consecutive(df: DataFrame, keys, pos: str, x="x", y="y", eps=1e-4, rows=CHUNK_ROWS) -> DataFrame:
    """Drop rows within ``eps`` of the previous original row."""
    out = neighbours(df, keys, pos, {"_px": (x, -1), "_py": (y, -1)}, rows)
    dx, dy = F.col(x) - F.col("_px"), F.col(y) - F.col("_py")
    return out.where(F.col("_px").isNull() | (F.sqrt(dx * dx + dy * dy) > eps)).drop("_px", "_py")


def path_tangent(path: DataFrame, keys, idx="idx", x="x", y="y", rows=CHUNK_ROWS) -> DataFrame:
    """Unit tangent by central differences, one-sided at the ends: ``tx``, ``ty``."""
    out = neighbours(path, keys, idx, {"_nx": (x, 1), "_ny": (y, 1), "_px": (x, -1), "_py": (y, -1)}, rows)
    half = F.when(F.col("_nx").isNotNull() & F.col("_px").isNotNull(), 2.0).otherwise(1.0)
    gx = (F.coalesce("_nx", x) - F.coalesce("_px", x)) / half
    gy = (F.coalesce("_ny", y) - F.coalesce("_py", y)) / half
    out = out.select(*path.columns, gx.alias("_gx"), gy.alias("_gy"))
    norm = F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))
    norm = F.when(norm < 1e-8, F.lit(1.0)).otherwise(norm)
    return out.select(*path.columns, (F.col("_gx") / norm).alias("tx"), (F.col("_gy") / norm).alias("ty"))


def finite_rows(df: DataFrame, *cols: str) -> DataFrame:
    """Rows whose positions are present and finite."""
    keep = F.lit(True)
    for c in cols:
        keep = keep & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return df.where(keep)


def fit_path(
    poses: DataFrame, keys, order: Sequence[str], x="x", y="y", max_points: int = 500, n: int = 2000,
) -> DataFrame:
    """Clean, thin and resample a driven path to ``n`` stations with unit tangents.

    Finite rows -> no consecutive duplicates -> every k-th row so that about ``max_points`` remain ->
    no duplicates again -> ``n`` stations linear in arc length. A path left with three points keeps them as its
    stations; paths left with fewer than two points have no length and produce no row.
    """
    keys = list(keys)
    p = dense_number(finite_rows(poses, x, y), keys, order, "_pos")
    # what is left is numbered by counting along the positions, without another sort
    p = materialize(dedupe_consecutive(p.select(*keys, "_pos", x, y), keys, "_pos", x, y), "kept")
    p = running(p, keys, "_pos", {"_k": ("sum", F.lit(1))}).withColumn("_pos", F.col("_k") - 1).drop("_k")
    step = p.groupBy(*keys).agg(F.greatest(F.lit(1).cast("long"), F.expr(f"count(1) div {max_points}")).alias("_step"))
    thin = with_summary(p, step, keys).where(F.col("_pos") % F.col("_step") == 0)
    thin = thin.select(*keys, F.expr("_pos div _step").alias("_pos"), F.col(x).alias("x"), F.col(y).alias("y"))
    thin = materialize(dedupe_consecutive(thin, keys, "_pos"), "thin")
    thin = dense_number(thin.withColumnRenamed("_pos", "_old"), keys, ["_old"], "_pos").drop("_old")
    thin = materialize(arc_length(thin, keys, "_pos"), "thin")
    ends = materialize(thin.groupBy(*keys).agg(F.max("s").alias("_l"), F.count(F.lit(1)).alias("_n")).where(F.col("_l") > 1e-8), "ends")
    three = F.col("_n") == 3
    stations = resample_path(thin.join(ends.where(~three), keys, "left_semi"), keys, "_pos", n=n)
    own = thin.join(ends.where(three), keys, "left_semi").select(*keys, F.col("_pos").alias("idx"), "s", "x", "y")
    return path_tangent(materialize(stations.select(*keys, F.col("idx").cast("long").alias("idx"), "s", "x", "y").unionByName(own), "stations"), keys)


def side_and_orientation(
    cars: DataFrame, path: DataFrame, keys, car_id, x="x", y="y", yaw: str | None = "yaw", **kw
) -> DataFrame:
    """Side of the nearest path station and, given a yaw, orientation relative to its tangent."""
    ref = path.select(*keys, "idx", F.col("x").alias("_rx"), F.col("y").alias("_ry"),
                      F.col("tx").alias("_tx"), F.col("ty").alias("_ty"))
    near = nearest_target(cars, ref, keys, car_id, (x, y), vertex("_rx", "_ry"), "idx",
                        ("_rx", "_ry", "_tx", "_ty"), **kw)
    cross = F.col("_tx") * (F.col(y) - F.col("_ry")) - F.col("_ty") * (F.col(x) - F.col("_rx"))
    out = [F.when(cross > 0, "left").otherwise("right").alias("side")]
    if yaw:
        out.append(orientation_to(F.col(yaw), F.atan2("_ty", "_tx")).alias("orient"))
    return near.select(*cars.columns, F.col("idx").alias("path_idx"), *out)


def orientation_to(yaw: Column, path_angle: Column) -> Column:
    """parallel below 45 or above 135 degrees of wrapped difference, else perpendicular."""
    diff = F.abs(wrap_rad(yaw) - wrap_rad(path_angle))
    diff = F.when(diff > math.pi, TWO_PI - diff).otherwise(diff)
    return F.when((diff < math.pi / 4) | (diff > 3 * math.pi / 4), "parallel").otherwise("perpendicular")


def resample_lateral(
    projected: DataFrame, start: float | None, end: float | None, spacing: float = 0.5, run_keys=("run",),
    pos="seq", value="offset_m", rows=CHUNK_ROWS, segments: DataFrame | None = None,
) -> DataFrame:
    """Value at stations ``start, start + spacing, ... < end`` inside each run's own progress range.

    Adds ``station`` (its number) and ``at``. Stations outside the range produce no row, which plays
    the role of "missing". Stations are generated per run, so no range join is needed. ``segments`` (scenario
    columns out of ``run_keys``, ``start_m``, ``end_m``) gives every scenario its own start and end.
    """
    run_keys = list(run_keys)
    clean = strict_increase(projected, run_keys, pos, rows=rows)
    clean = clean.select(*run_keys, F.col("progress").alias("at"), F.col(value).alias("v"))
    span = clean.groupBy(*run_keys).agg(F.min("at").alias("_a"), F.max("at").alias("_b"))
    if segments is None:
        span = span.withColumns({"_s": F.lit(float(start)), "_e": F.lit(float(end))})
    else:
        of = [c for c in run_keys if c in segments.columns]
        span = span.join(segments.select(*of, F.col("start_m").alias("_s"), F.col("end_m").alias("_e")), of)
    total = F.greatest(F.ceil((F.col("_e") - F.col("_s")) / spacing), F.lit(0))
    first = F.greatest(F.floor((F.col("_a") - F.col("_s")) / spacing), F.lit(0))
    last = F.least(F.ceil((F.col("_b") - F.col("_s")) / spacing), total - 1)
    wanted = (
        span.where(first <= last)
        .select(*run_keys, "_a", "_b", "_s", F.explode(F.sequence(first, last)).alias("station"))
        .select("*", (F.col("_s") + F.col("station") * spacing).alias("at"))
        .where(F.col("at").between(F.col("_a"), F.col("_b")))
        .drop("_a", "_b", "_s")
    )
    out = interp_series(wanted, clean, run_keys, "at", ["v"], inside_only=True)
    return out.withColumnRenamed("v", value)


# --- lines given as rows of vertices --------------------------------------------------------------
def line_segments(vertices: DataFrame, keys, pos: str, x="x", y="y", rows=CHUNK_ROWS) -> DataFrame:
    """One row per segment with its start distance ``d0`` along the line and its length ``len``."""
    v = neighbours(arc_length(vertices, keys, pos, x, y, "d0", rows), keys, pos,
                   {"x1": (x, 1), "y1": (y, 1), "_d1": ("d0", 1)}, rows)
    return v.where(F.col("x1").isNotNull()).select(
        *keys, F.col(pos).alias("seg"), F.col(x).alias("x0"), F.col(y).alias("y0"), "x1", "y1", "d0",
        (F.col("_d1") - F.col("d0")).alias("len"),
    )


def line_substring(segments: DataFrame, start: Column, end: Column) -> DataFrame:
    """Clip every segment of a line to the distances [start, end] (swapped when reversed)."""
    a, b = F.least(start, end), F.greatest(start, end)
    d0, ln = F.col("d0"), F.col("len")
    hit = segments.where((d0 + ln >= a) & (d0 <= b) & (ln > 0))
    ua, ub = (F.greatest(a, d0) - d0) / ln, (F.least(b, d0 + ln) - d0) / ln
    ex, ey = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return hit.select(
        *[c for c in segments.columns if c not in ("x0", "y0", "x1", "y1", "d0", "len")],
        (F.col("x0") + ua * ex).alias("ax"), (F.col("y0") + ua * ey).alias("ay"),
        (F.col("x0") + ub * ex).alias("bx"), (F.col("y0") + ub * ey).alias("by"),
    )


def polyline_project(
    points: DataFrame, segments: DataFrame, keys, point_id, px="px", py="py"
) -> DataFrame:
    """Distance along the point's own line of the closest point on it, and that point."""
    near = nearest_target(
        points, segments, keys, point_id, (px, py), segment("x0", "y0", "x1", "y1"), "seg",
        ("x0", "y0", "x1", "y1", "d0", "len"),
    )
    ex, ey, ln = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("len")
    u = ((F.col(px) - F.col("x0")) * ex + (F.col(py) - F.col("y0")) * ey) / (ln * ln)
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(ln > 0, u).otherwise(0.0)))
    return near.select(*points.columns, "seg", "dist", "x0", "y0", "d0", "len", ex.alias("_ex"),
                       ey.alias("_ey"), u.alias("_u")).select(
        *points.columns, "seg", "dist", (F.col("d0") + F.col("_u") * F.col("len")).alias("along"),
        (F.col("x0") + F.col("_u") * F.col("_ex")).alias("cx"),
        (F.col("y0") + F.col("_u") * F.col("_ey")).alias("cy"),
    )


def offset_line(x0: str, y0: str, x1: str, y1: str, metres: float, side: str) -> list[Column]:
    """A one-segment line moved sideways by ``metres`` expressed in degrees of latitude.

    The degree length ignores the latitude, so east-west offsets are wider on the ground. Left is
    to the left of the drawing direction; the moved line keeps that direction on both sides. A line
    without length has no direction and gives NULL.
    """
    d = metres / 111320.0 * (1.0 if side == "left" else -1.0)
    ex, ey = F.col(x1) - F.col(x0), F.col(y1) - F.col(y0)
    ln = F.sqrt(ex * ex + ey * ey)
    ox, oy = F.try_divide(-ey, ln) * d, F.try_divide(ex, ln) * d
    return [F.col(x0) + ox, F.col(y0) + oy, F.col(x1) + ox, F.col(y1) + oy]
