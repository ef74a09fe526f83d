"""Fitting and checking alignments between coordinate frames; route splits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheeltrace.functions.angles import wrap_deg, wrap_rad
from wheeltrace.functions.geodesy import axis_angle
from wheeltrace.operators.nearest import nearest_target, vertex
from wheeltrace.operators.ordered import CHUNK_ROWS, attach, chunk_of, exact_percentile, with_summary
from wheeltrace.session import materialize


def yaw_agreement(df: DataFrame, keys, a_deg: str, b_deg: str) -> DataFrame:
    """Mean, population std and largest magnitude of the wrapped yaw difference."""
    d = df.select(*keys, wrap_deg(F.col(a_deg) - F.col(b_deg)).alias("_d"))
    return d.groupBy(*keys).agg(
        F.avg("_d").alias("mean_diff"), F.stddev_pop("_d").alias("std_diff"), F.max(F.abs("_d")).alias("max_diff")
    )


def axis_drift(df: DataFrame, keys, pos: str, x: str, y: str, offset: tuple, warn_deg: float = 0.1) -> DataFrame:
    """Change of the +x axis direction between the first and the middle row, with a warning flag."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ends = with_summary(df, n, keys).where((F.col(pos) == 0) | (F.col(pos) == F.expr("_n div 2")))
    a = axis_angle(ends.select(*keys, pos, x, y), x, y, "_a", offset)
    g = a.groupBy(*keys).agg(F.min_by("_a", pos).alias("_a0"), F.max_by("_a", pos).alias("_a1"))
    drift = wrap_deg(F.degrees(F.col("_a1") - F.col("_a0")))
    return g.select(*keys, F.degrees("_a0").alias("start_deg"), drift.alias("drift_deg"),
                    (F.abs(drift) >= warn_deg).alias("warn"))


def circular_mean(df: DataFrame, keys, angle: str) -> DataFrame:
    """Circular mean and population std of the wrapped residuals."""
    keys = list(keys)
    mean = df.groupBy(*keys).agg(F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle))).alias("mean"))
    res = with_summary(df, mean, keys).select(*keys, "mean", wrap_rad(F.col(angle) - F.col("mean")).alias("_r"))
    return res.groupBy(*keys).agg(F.first("mean").alias("mean"), F.stddev_pop("_r").alias("residual_std"))


def yaw_alignment(df: DataFrame, keys, src: str, dst: str) -> DataFrame:
    """Best of dst = +src + offset and dst = -src + offset by residual std; +1 wins ties."""
    keys = list(keys)
    signed = df.select(*keys, src, dst, F.explode(F.array(F.lit(1), F.lit(-1))).alias("yaw_sign"))
    diff = signed.select(*keys, "yaw_sign", wrap_rad(F.col(dst) - F.col("yaw_sign") * F.col(src)).alias("_d"))
    both = circular_mean(diff, [*keys, "yaw_sign"], "_d")
    best = F.min_by(F.struct("yaw_sign", F.col("mean").alias("yaw_offset"), "residual_std"),
                    F.struct("residual_std", -F.col("yaw_sign")))
    return both.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def similarity_fit(df: DataFrame, keys, src: Sequence[str], dst: Sequence[str], with_scale: bool = True) -> DataFrame:
    """Least-squares dst = scale * R * src + t in the plane, from one pass of mergeable moments.

    ``rms`` is the root mean square distance that remains; ``with_scale=False`` keeps the scale at 1. A key whose
    source points are all the same has no fit: its values are NULL.
    """
    keys = list(keys)
    (sx, sy), (tx, ty) = src, dst
    m = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate((sx, sy, tx, ty))],
        (F.var_pop(sx) + F.var_pop(sy)).alias("_var"), (F.var_pop(tx) + F.var_pop(ty)).alias("_vt"),
        (F.covar_pop(ty, sx) - F.covar_pop(tx, sy)).alias("_q"),
        (F.covar_pop(tx, sx) + F.covar_pop(ty, sy)).alias("_p"),
    )
    turn = F.sqrt(F.col("_q") * F.col("_q") + F.col("_p") * F.col("_p"))
    known = F.col("_var") > 0
    m = m.select("*", turn.alias("_turn"), F.when(known, F.atan2("_q", "_p")).alias("theta"),
                 F.when(known, F.try_divide(turn, F.col("_var")) if with_scale else F.lit(1.0)).alias("scale"))
    left = F.col("_vt") + F.col("scale") * F.col("scale") * F.col("_var") - 2 * F.col("scale") * F.col("_turn")
    c, s = F.cos("theta") * F.col("scale"), F.sin("theta") * F.col("scale")
    return m.select(
        *keys, "n", "scale", "theta",
        (F.col("_m2") - (c * F.col("_m0") - s * F.col("_m1"))).alias("t_x"),
        (F.col("_m3") - (s * F.col("_m0") + c * F.col("_m1"))).alias("t_y"), F.when(F.col("scale").isNotNull(), F.sqrt(F.greatest(left, F.lit(0.0)))).alias("rms"),
    )


def similarity_fit_nd(df: DataFrame, src: Sequence[str], dst: Sequence[str], with_scale: bool = True) -> dict:
    """The same in D dimensions for one data set: only the D x D moment matrix reaches the driver."""
    d = len(src)
    aggs = [F.avg(c) for c in (*src, *dst)]
    aggs += [F.var_pop(c) for c in src]
    aggs += [F.covar_pop(dst[i], src[j]) for i in range(d) for j in range(d)]
    row = list(df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first())
    mu_s, mu_t = np.array(row[:d]), np.array(row[d:2 * d])
    var, cov = sum(row[2 * d:3 * d]), np.array(row[3 * d:]).reshape(d, d)
    u, diag, vt = np.linalg.svd(cov)
    flip = np.ones(d)
    flip[-1] = np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0
    rot = u @ np.diag(flip) @ vt
    scale = float((diag * flip).sum() / var) if with_scale else 1.0
    return {"scale": scale, "rotation": rot.tolist(), "translation": (mu_t - scale * rot @ mu_s).tolist()}


JACOBI_SWEEPS = 8


def _turned(values: Column, cs: Column, p: Column, q: Column, columns: bool) -> Column:
    """A 4 x 4 matrix (by rows) with its columns (or rows) p and q turned into each other."""
    step = F.lit(1) if columns else F.lit(4)
    at = lambda k: k % 4 if columns else F.floor(k / 4).cast("int")
    c, s = cs["c"], cs["s"]
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.when(
        at(k) == p, c * F.get(values, k) - s * F.get(values, k + (q - p) * step)).when(
        at(k) == q, s * F.get(values, k - (q - p) * step) + c * F.get(values, k)).otherwise(F.get(values, k)))


def largest_eigenvector(matrix: Column) -> Column:
    """``value`` and ``vector`` of the largest eigenvalue of a symmetric 4 x 4 matrix (16 numbers), by Jacobi rotations."""
    pairs = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for _ in range(JACOBI_SWEEPS) for p in range(4) for q in range(p + 1, 4)])
    start = F.struct(matrix.alias("a"), F.array(*[F.lit(float(i % 5 == 0)) for i in range(16)]).alias("v"))

    def rotate(state, pair):
        a, p, q = state["a"], pair["p"], pair["q"]
        off = F.get(a, p * 4 + q)
        theta = (F.get(a, q * 5) - F.get(a, p * 5)) / (2 * off)
        t = F.when(off == 0, 0.0).otherwise(F.when(theta < 0, -1.0).otherwise(1.0) / (F.abs(theta) + F.sqrt(theta * theta + 1)))
        cosine = 1 / F.sqrt(t * t + 1)

        def turn(cs):
            half = F.transform(F.array(_turned(a, cs, p, q, True)), lambda b: _turned(b, cs, p, q, False))[0]
            return F.struct(half.alias("a"), _turned(state["v"], cs, p, q, True).alias("v"))

        return F.transform(F.array(F.struct(cosine.alias("c"), (t * cosine).alias("s"))), turn)[0]

    def pick(state):
        ranked = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct(F.get(state["a"], k * 5).alias("value"), (-k).alias("k"))))
        vector = F.transform(F.array(ranked), lambda best: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.get(state["v"], i * 4 - best["k"])))[0]
        return F.struct(ranked["value"].alias("value"), vector.alias("vector"))

    return F.aggregate(pairs, start, rotate, pick)


def similarity_fit_3d(df: DataFrame, keys, src: Sequence[str], dst: Sequence[str], with_scale: bool = True) -> DataFrame:
    """Least-squares dst = scale * R * src + t in space for every key, from one pass of mergeable moments.

    The rotation is the unit quaternion that belongs to the largest eigenvalue of a 4 x 4 matrix of the moments; a fixed number
    of Jacobi rotations finds it in columns, so any number of keys is one job. Returns the keys, ``n``, ``scale``,
    ``rotation`` (nine numbers by rows), ``translation`` and ``rms``. A key whose source points are all the same has no fit: NULL.
    """
    keys, axes = list(keys), range(3)
    m = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"_s{i}") for i, c in enumerate(src)], *[F.avg(c).alias(f"_d{i}") for i, c in enumerate(dst)],
        sum((F.var_pop(c) for c in src), F.lit(0.0)).alias("_var"), sum((F.var_pop(c) for c in dst), F.lit(0.0)).alias("_vd"),
        *[F.covar_pop(src[i], dst[j]).alias(f"_c{i}{j}") for i in axes for j in axes])
    c = lambda i, j: F.col(f"_c{i}{j}")
    upper = [[c(0, 0) + c(1, 1) + c(2, 2), c(1, 2) - c(2, 1), c(2, 0) - c(0, 2), c(0, 1) - c(1, 0)],
             [None, c(0, 0) - c(1, 1) - c(2, 2), c(0, 1) + c(1, 0), c(2, 0) + c(0, 2)],
             [None, None, c(1, 1) - c(0, 0) - c(2, 2), c(1, 2) + c(2, 1)],
             [None, None, None, c(2, 2) - c(0, 0) - c(1, 1)]]
    matrix = F.array(*[upper[min(i, j)][max(i, j)] for i in range(4) for j in range(4)])
    kept = [*keys, "n", "_var", "_vd", *[f"_{a}{i}" for a in "sd" for i in axes]]
    m = m.select(*kept, largest_eigenvector(matrix).alias("_e"))
    w, x, y, z = (F.col("_e.vector")[i] for i in range(4))
    rot = [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
           2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]
    known = F.col("_var") > 0
    scale = F.when(known, F.try_divide(F.col("_e.value"), F.col("_var")) if with_scale else F.lit(1.0))
    m = m.select(*kept, F.col("_e.value").alias("_turn"), scale.alias("scale"), F.when(known, F.array(*rot)).alias("rotation"))
    moved = [F.col(f"_d{i}") - F.col("scale") * sum((F.col("rotation")[3 * i + j] * F.col(f"_s{j}") for j in axes), F.lit(0.0)) for i in axes]
    left = F.col("_vd") + F.col("scale") * F.col("scale") * F.col("_var") - 2 * F.col("scale") * F.col("_turn")
    return m.select(*keys, "n", "scale", "rotation", F.when(F.col("scale").isNotNull(), F.array(*moved)).alias("translation"),
                    F.when(F.col("scale").isNotNull(), F.sqrt(F.greatest(left, F.lit(0.0)))).alias("rms"))


def alignment_report(matched: DataFrame, fit: DataFrame, yaw_fit: DataFrame, keys, src, dst, src_yaw, dst_yaw,
                     pitch, roll, z) -> DataFrame:
    """Position and yaw errors of a fit, mount angles (median, std) and mean height per key."""
    keys = list(keys)
    j = with_summary(matched, fit.join(yaw_fit, keys), keys)
    c, s = F.cos("theta") * F.col("scale"), F.sin("theta") * F.col("scale")
    ex = F.col(dst[0]) - (c * F.col(src[0]) - s * F.col(src[1]) + F.col("t_x"))
    ey = F.col(dst[1]) - (s * F.col(src[0]) + c * F.col(src[1]) + F.col("t_y"))
    err = F.sqrt(ex * ex + ey * ey)
    yerr = F.degrees(wrap_rad(F.col(dst_yaw) - (F.col("yaw_sign") * F.col(src_yaw) + F.col("yaw_offset"))))
    base = j.select(*keys, err.alias("e"), yerr.alias("ye"), F.col(pitch).alias("p"), F.col(roll).alias("r"), F.col(z).alias("z"))
    out = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("e").alias("pos_mean"), F.max("e").alias("pos_max"),
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("pos_rms"), F.avg(F.abs("ye")).alias("yaw_mean"),
        F.max(F.abs("ye")).alias("yaw_max"), F.stddev_pop("ye").alias("yaw_std"),
        F.stddev_pop("p").alias("pitch_std"), F.stddev_pop("r").alias("roll_std"), F.avg("z").alias("z_mean"),
    )
    for c_, src_ in (("pitch_median", pitch), ("roll_median", roll)):
        out = out.join(exact_percentile(matched, keys, src_, 0.5, c_), keys)
    return out


def frame_match(left: DataFrame, right: DataFrame, on: Sequence[str], min_matches: int = 3) -> tuple[DataFrame, DataFrame]:
    """(matched rows, left rows without a partner).

    All but the last column of ``on`` name the data set; one with fewer matches than ``min_matches`` is an error.
    """
    matched, keys = left.join(right, list(on)), list(on)[:-1]
    if keys:
        n = matched.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        few = left.select(*keys).distinct().join(n, keys, "left").where(F.coalesce("_n", F.lit(0)) < min_matches)
        names = [tuple(r) for r in few.select(*keys).limit(5).collect()]
        if names:
            raise ValueError(f"need at least {min_matches} matched frames for {names}")
    elif matched.limit(min_matches).count() < min_matches:
        raise ValueError(f"need at least {min_matches} matched frames")
    return matched, left.join(right, list(on), "left_anti")


def extent(df: DataFrame, keys, cols: Sequence[str], buffer: float = 0.0) -> DataFrame:
    """Min, max, range and centroid of each axis, with optionally buffered bounds."""
    aggs = []
    for c in cols:
        aggs += [(F.min(c) - buffer).alias(f"{c}_min"), (F.max(c) + buffer).alias(f"{c}_max"),
                 (F.max(c) - F.min(c)).alias(f"{c}_range"), F.avg(c).alias(f"{c}_mean")]
    return df.groupBy(*keys).agg(*aggs)


# --- route splits -----------------------------------------------------------------------------------
def split_ranges(frames: DataFrame, keys, frame: str, k: int, overlap: int) -> DataFrame:
    """One array of ``k`` forward-overlapping ranges per key, from the number of frames."""
    n = frames.groupBy(*keys).agg((F.max(frame) + 1).alias("_n"))
    step = F.expr(f"_n div {k}")
    ranges = F.array(*[
        F.struct(
            F.lit(i + 1).alias("split"), (step * i).alias("start"),
            (F.least((i + 1) * step + (overlap - 1), F.col("_n") - 1) if i < k - 1 else F.col("_n") - 1).alias("end"),
        ) for i in range(k)
    ])
    return n.select(*keys, "_n", F.when(step > 0, ranges).otherwise(
        F.raise_error(F.concat(F.lit("too many splits for frames: "), F.col("_n").cast("string")))).alias("_ranges"))


def split_assign(frames: DataFrame, keys, frame: str, k: int, overlap: int) -> DataFrame:
    """A row per split that contains the frame; the ranges travel as one small array per key."""
    j = with_summary(frames, split_ranges(frames, keys, frame, k, overlap), keys)
    f = F.col(frame)
    hit = F.filter("_ranges", lambda s: (s["start"] <= f) & (f <= s["end"]))
    return j.select(*frames.columns, F.explode(F.transform(hit, lambda s: s["split"])).alias("split"))


def split_overlap(frames: DataFrame, kept: DataFrame, keys, frame: str, k: int, overlap: int) -> DataFrame:
    """Overlap interval of each adjacent split pair and the number of ``kept`` frames inside."""
    keys = list(keys)
    r = split_ranges(frames, keys, frame, k, overlap)
    pairs = r.select(*keys, F.expr(
        "transform(slice(_ranges, 1, size(_ranges) - 1), (s, i) -> struct(s.split as split,"
        " greatest(s.start, _ranges[i + 1].start) as lo, least(s.end, _ranges[i + 1].end) as hi))").alias("_p"))
    f = F.col(frame)
    inside = with_summary(kept, pairs, keys).select(
        *keys, F.explode(F.filter("_p", lambda s: (s["lo"] <= f) & (f <= s["hi"]))).alias("s"))
    n = inside.groupBy(*keys, F.col("s.split").alias("split")).agg(F.count(F.lit(1)).alias("frames"))
    flat = pairs.select(*keys, F.inline("_p")).where("hi >= lo")
    return flat.join(n, [*keys, "split"], "left").na.fill(0, ["frames"])


def nearest_centroid(frames: DataFrame, splits: DataFrame, keys, x: str, y: str) -> DataFrame:
    """Split whose camera centroid is closest in the split's own frame (lowest split wins ties).

    ``splits`` (one row per split: keys, ``split``, ``cx, cy`` and a similarity ``a, b, tx, ty`` with
    x' = a x - b y + tx, y' = b x + a y + ty) is folded into one short array per key.
    """
    arr = splits.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("split", "cx", "cy", "a", "b", "tx", "ty"))).alias("_s"))
    px, py = F.col(x), F.col(y)

    def dist(s):
        dx = s["a"] * px - s["b"] * py + s["tx"] - s["cx"]
        dy = s["b"] * px + s["a"] * py + s["ty"] - s["cy"]
        return F.struct(F.sqrt(dx * dx + dy * dy).alias("d"), s["split"].alias("split"))

    best = F.array_min(F.transform("_s", dist))
    return with_summary(frames, arr, keys).select(*frames.columns, best.alias("_b")).select(
        *frames.columns, F.col("_b.split").alias("split"), F.col("_b.d").alias("centroid_dist"))


def coverage_distance(points: DataFrame, cameras: DataFrame, keys, point_id, xy, cam_xy, cam_z: str, cam_id: str, **kw) -> DataFrame:
    """Distance to the nearest training camera and its height, or the median height where none exists."""
    near = nearest_target(points, cameras, keys, point_id, xy, vertex(*cam_xy), cam_id, (cam_z,), **kw)
    med = exact_percentile(cameras, keys, cam_z, 0.5, "_med")
    out = with_summary(near, med, keys, "left") if keys else attach(near, med, keys)
    return out.select(*points.columns, "dist", cam_id, F.coalesce(cam_z, "_med").alias("lookup_z"))


def composed(maps: np.ndarray) -> np.ndarray:
    """Prefixes of maps (rows x states) that are applied one after the other, by doubling the reach in every step."""
    out, reach = maps.copy(), 1
    while reach < len(out):
        out[reach:] = np.take_along_axis(out[reach:], out[:-reach], 1)
        reach *= 2
    return out


def best_split(frames: DataFrame, splits: DataFrame, keys, pos: str, frame: str, initial: int = 0, rows: int = CHUNK_ROWS) -> DataFrame:
    """Sticky choice of a split for each step of a run.

    Keep the current split while it covers the frame; else the covering split that ends last; else
    the nearest range. A step either keeps the state or sets it to a value that depends on the frame
    alone: a map of states, and the same map twice is the map once. So only steps at which the map changes count, and
    their maps are composed by doubling. Chunks are summarised in parallel, their maps are composed per run in the same
    way, and chunks are replayed in parallel from their now known start state.
    """
    keys = list(keys)
    arr = splits.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("split", "min_frame", "max_frame"))).alias("_s"))
    base = with_summary(frames, arr, keys).select(
        *frames.columns, F.col("_s.min_frame").alias("_lo"), F.col("_s.max_frame").alias("_hi"),
        chunk_of(pos, rows).alias("_chunk")).repartition(*keys, "_chunk")
    types, cols = dict(frames.dtypes), frames.columns
    key_schema = ", ".join(f"{k} {types[k]}" for k in keys)

    def changes(pdf):
        """The changed maps (changes x states), and for every row the number of the last change."""
        lo, hi = np.asarray(pdf["_lo"].iloc[0]), np.asarray(pdf["_hi"].iloc[0])
        f = pdf[frame].to_numpy()[:, None]
        cover = (lo <= f) & (f <= hi)
        gap = np.where(f < lo, lo - f, np.where(f > hi, f - hi, 0))
        fallback = np.where(cover.any(axis=1), np.argmax(np.where(cover, hi, -1), axis=1), np.argmin(gap, axis=1))
        maps = np.where(cover, np.arange(cover.shape[1]), fallback[:, None])
        new = np.append(True, (maps[1:] != maps[:-1]).any(axis=1))
        return maps[new], np.cumsum(new) - 1

    def summarise(pdf):
        state = composed(changes(pdf.sort_values(pos))[0])[-1]
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), pdf["_chunk"].iloc[0], state]],
                            columns=[*keys, "_chunk", "_map"])

    def compose(pdf):
        pdf = pdf.sort_values("_chunk")
        after = composed(np.stack(pdf["_map"]))[:, initial]
        return pdf[[*keys, "_chunk"]].assign(_start=np.append(initial, after[:-1]))

    def replay(pdf):
        pdf = pdf.sort_values(pos)
        maps, at = changes(pdf)
        return pdf[cols].assign(split_idx=composed(maps)[:, int(pdf["_start"].iloc[0])][at])

    maps = base.groupBy(*keys, "_chunk").applyInPandas(summarise, f"{key_schema}, _chunk long, _map array<long>")
    starts = maps.groupBy(*keys).applyInPandas(compose, f"{key_schema}, _chunk long, _start long")
    out_schema = ", ".join(f"{c} {types[c]}" for c in cols) + ", split_idx long"
    return base.join(materialize(starts, "starts"), [*keys, "_chunk"]).groupBy(*keys, "_chunk").applyInPandas(replay, out_schema)


# --- set operations ---------------------------------------------------------------------------------
def frame_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def frame_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def missing_frames(truth: DataFrame, predicted: DataFrame, on: Sequence[str]) -> DataFrame:
    return truth.join(predicted, list(on), "left_anti")
