"""Detections: filters, corrections, box transforms, final cars."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wheeltrace.functions.angles import (
    apply_pose, apply_static, camera_chain, lidar_chain,
)
from wheeltrace.operators.grouping import BOX
from wheeltrace.operators.ordered import dense_number, exact_percentile
from wheeltrace.operators.paths import side_and_orientation


def filter_camera(df: DataFrame, min_score=0.28, label=0, max_depth=50.0) -> DataFrame:
    return df.where((F.col("score") >= min_score) & (F.col("label") == label) & (F.col("z") <= max_depth))


def filter_lidar(df: DataFrame, min_score=0.50, label=2, max_range=40.0) -> DataFrame:
    reach = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    return df.where((F.col("score") >= min_score) & (F.col("label") == label) & (reach <= max_range))


def correct_detection(df: DataFrame, x_scale=0.84, x_offset=0.0, y_offset=0.0, depth_scale=0.85, depth_offset=2.2) -> DataFrame:
    """Calibrated camera box centre and the score weighted down with the corrected depth."""
    out = df.select(
        *[c for c in df.columns if c not in "xyz"],
        (F.col("x") * x_scale + x_offset).alias("x"), (F.col("y") + y_offset).alias("y"),
        (F.col("z") * depth_scale - depth_offset).alias("z"),
    )
    return out.withColumn("weight", F.col("score") * (1.0 / (1.0 + F.col("z") / 20.0)))


def box_to_world(box: tuple, yaw, pose_quat: tuple, pose_trans: tuple) -> tuple[tuple, Column]:
    """Camera box centre and yaw in the world; the camera looks along z, so forward is (cos, 0, -sin)."""
    yaw = F.col(yaw) if isinstance(yaw, str) else yaw
    chain = camera_chain()
    centre = apply_pose(pose_quat, pose_trans, apply_static(chain, box))
    ahead = apply_static(chain, (F.cos(yaw), F.lit(0.0), -F.sin(yaw)), direction=True)
    d = apply_pose(pose_quat, pose_trans, ahead, direction=True)
    return centre, F.atan2(d[1], d[0])


def box_to_global(box: tuple, height, yaw, z_shift, pose_quat: tuple, pose_trans: tuple) -> tuple[tuple, Column]:
    """LiDAR box (bottom centre) to the global frame, again by its bottom, with yaw."""
    h, yaw = F.col(height), F.col(yaw)
    chain = lidar_chain()
    mid = (F.col(box[0]), F.col(box[1]), F.col(box[2]) - z_shift + h / 2)
    c = apply_pose(pose_quat, pose_trans, apply_static(chain, mid))
    ahead = apply_static(chain, (F.cos(yaw), F.sin(yaw), F.lit(0.0)), direction=True)
    d = apply_pose(pose_quat, pose_trans, ahead, direction=True)
    return (c[0], c[1], c[2] - h / 2), F.atan2(d[1], d[0])


def box_corners(x, y, z, length, width, height, yaw) -> Column:
    """Eight corners of a camera-frame box, turned about y."""
    x, y, z, ln, w, h, yaw = (F.col(c) if isinstance(c, str) else c for c in (x, y, z, length, width, height, yaw))
    signs = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
    out = []
    for sh in (-1, 1):
        for sl, sw in signs:
            a, b, c = ln / 2 * sl, w / 2 * sw, h / 2 * sh
            out.append(F.struct(
                (F.cos(yaw) * a + F.sin(yaw) * c + x).alias("x"), (b + y).alias("y"),
                (-F.sin(yaw) * a + F.cos(yaw) * c + z).alias("z"),
            ))
    return F.array(*out)


def pinhole(corners: Column, fx: float, fy: float, cx: float, cy: float) -> Column:
    """Pixel positions truncated to integers."""
    return F.transform(corners, lambda p: F.struct(
        (p["x"] / p["z"] * fx + cx).cast("int").alias("u"), (p["y"] / p["z"] * fy + cy).cast("int").alias("v")))


def visible_boxes(df: DataFrame, corners: str, k: tuple, size: tuple[int, int]) -> DataFrame:
    """Boxes entirely in front of the camera with at least one corner inside the image."""
    w, h = size
    out = df.where(F.forall(corners, lambda p: p["z"] > 0)).withColumn("pixels", pinhole(F.col(corners), *k))
    return out.where(F.exists("pixels", lambda p: (p["u"] >= 0) & (p["u"] < w) & (p["v"] >= 0) & (p["v"] < h)))


def finalise_cars(
    clusters: DataFrame, path: DataFrame, sensor: str, origin: tuple[float, float, float], run="run",
    min_count: int = 3, yaw_mode: str | None = None,
) -> DataFrame:
    """Mean box, confidence, side, orientation and id 1.. of each cluster.

    The camera averages yaw linearly (and keeps all clusters, ordered by first frame); the LiDAR
    averages it circularly, needs ``min_count`` members and keeps creation order.
    """
    camera = sensor == "camera"
    mode = yaw_mode or ("linear" if camera else "circular")
    count = "hits" if camera else "count"
    c = clusters if camera else clusters.where(F.col(count) >= min_count)
    w = F.col("w")
    yaw = F.col("byaw") / w if mode == "linear" else F.atan2("yaw_sin", "yaw_cos")
    cars = c.select(
        run, "first_ord", *(["first_frame"] if camera else []),
        *[(F.col(b) / w + o).alias(n) for b, n, o in zip(BOX[:3], "xyz", origin)],
        (F.col("bl") / w).alias("length"), (F.col("bw") / w).alias("width"), (F.col("bh") / w).alias("height"),
        yaw.alias("yaw"), F.col(count).alias("count"),
        (w / F.col(count) if camera else F.col("last_conf")).alias("conf"),
    )
    sided = side_and_orientation(cars, path, [run], [run, "first_ord"]).drop("path_idx")
    order = ["first_frame", "first_ord"] if camera else ["first_ord"]
    numbered = dense_number(sided, [run], order, "_n")
    return numbered.withColumn("id", F.col("_n") + 1).drop("_n", "first_ord")


def ground_shift(points: DataFrame, keys, z: str = "z", target=-1.73, dead_band=0.2) -> DataFrame:
    """5th percentile of height (linear interpolation) and the shift that brings it to ``target``."""
    g = exact_percentile(points, keys, z, 0.05, "ground")
    shift = target - F.col("ground")
    return g.withColumn("shift", F.when(F.abs(shift) > dead_band, shift).otherwise(F.lit(0.0)))


def voxel_downsample(points: DataFrame, keys, size=0.1, cols=("x", "y", "z"), extra=(), origin=(0.0, 0.0, 0.0)) -> DataFrame:
    """Mean point (and colour) of every occupied voxel, in one exact pass."""
    cell = [F.floor((F.col(c) - o) / size).alias(f"v{c}") for c, o in zip(cols, origin)]
    return points.groupBy(*keys, *cell).agg(*[F.avg(c).alias(c) for c in (*cols, *extra)], F.count(F.lit(1)).alias("n"))


def merge_clouds(first: DataFrame, *rest: DataFrame) -> DataFrame:
    for c in rest:
        first = first.unionByName(c)
    return first


