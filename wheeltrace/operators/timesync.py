"""Synchronising sensor streams by time: as-of interpolation, nearest pose, frame numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wheeltrace.functions.angles import quat_norm, quat_to_yaw, wrap_rad
from wheeltrace.operators.ordered import BROADCAST_HEADS, LARGE_BYTES, dense_number, neighbours, ordered_parts
from wheeltrace.session import materialize, size_in_bytes

QUAT = ("qx", "qy", "qz", "qw")


def asof_pair(
    events: DataFrame,
    poses: DataFrame,
    keys: Sequence[str],
    time: str,
    values: Sequence[str],
    pose_tie: str | None = None,
    equal: str = "before",
) -> DataFrame:
    """Attach the pose before and after each event: ``prev.<v>`` and ``next.<v>`` structs.

    Both sides are laid out in one time order that is cut into ranges, so a long recording is spread
    over many tasks. Inside a range the neighbours come from running windows; across ranges from one
    boundary pose per range. No range join, and no per-key task for the row-level data.

    Ties in time are ordered by ``pose_tie`` (or a hash), so that many rows with one time still spread.
    ``equal='before'`` makes a pose at the event's own time the previous one (interpolation);
    ``'after'`` makes it the next one (nearest-pose lookup by lower bound).
    """
    keys = list(keys)
    ev_cols = [c for c in events.columns if c not in keys and c != time]
    pose = F.struct(F.col(time).alias("t"), *[F.col(v) for v in values]).alias("_pose")
    pose_rank, event_rank = (0, 1) if equal == "before" else (1, 0)
    left = poses.select(
        *keys, time, F.lit(pose_rank).alias("_rank"),
        (F.col(pose_tie).cast("long") if pose_tie else F.xxhash64(*values)).alias("_tie"), pose,
    )
    right = events.select(
        *keys, time, F.lit(event_rank).alias("_rank"), (F.xxhash64(*ev_cols) if ev_cols else F.lit(0).cast("long")).alias("_tie"),
        F.struct(F.lit(True).alias("_event"), *ev_cols).alias("_ev"),
    )
    both = left.unionByName(right, allowMissingColumns=True)
    placed = ordered_parts(both, keys, [time, "_rank", "_tie"])
    is_pose = F.col("_pose").isNotNull()
    # positions first (a hash aggregate over two narrow columns), then the few poses they point to
    bounds = placed.groupBy(*keys, "_part").agg(
        F.max(F.when(is_pose, F.col("_mid"))).alias("_last"), F.min(F.when(is_pose, F.col("_mid"))).alias("_first")
    )
    fwd = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*keys).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    carry = bounds.select(
        *keys, "_part",
        F.last("_last", True).over(fwd).alias("_before"), F.last("_first", True).over(back).alias("_after"),
    )
    # only the poses that are carried meet the ranges: two per range and key at most
    wanted = carry.select(F.explode(F.array("_before", "_after")).alias("_mid")).where("_mid is not null").distinct()
    if size_in_bytes(placed) >= LARGE_BYTES:
        wanted = materialize(wanted, "wanted")
        if wanted.count() <= BROADCAST_HEADS:
            wanted = F.broadcast(wanted)
    ends = placed.where(is_pose).select("_mid", "_pose").join(wanted, "_mid", "left_semi")
    for at, name in (("_before", "_cprev"), ("_after", "_cnext")):
        carry = carry.join(ends.select(F.col("_mid").alias(at), F.col("_pose").alias(name)), at, "left")
    carry = carry.select(*keys, "_part", "_cprev", "_cnext")
    here = Window.partitionBy(*keys, "_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.repartition(*keys, "_part").join(carry, [*keys, "_part"]).select(
        *keys, time, "_ev",
        F.coalesce(F.last("_pose", True).over(here.orderBy("_mid")), F.col("_cprev")).alias("prev"),
        F.coalesce(F.last("_pose", True).over(here.orderBy(F.desc("_mid"))), F.col("_cnext")).alias("next"),
    )
    return out.where(F.col("_ev").isNotNull()).select(
        *keys, time, *[F.col(f"_ev.{c}").alias(c) for c in ev_cols], "prev", "next"
    )


def lerp(field: str, time: str) -> Column:
    """Linear interpolation between ``prev`` and ``next``, clamped to the end values."""
    p, n = F.col(f"prev.{field}"), F.col(f"next.{field}")
    a = (F.col(time) - F.col("prev.t")) / (F.col("next.t") - F.col("prev.t"))
    return (
        F.when(F.col("prev.t").isNull(), n)
        .when(F.col("next.t").isNull() | (F.col("prev.t") == F.col("next.t")), p)
        .otherwise(p + a * (n - p))
    )


def _lerp_yaw(time: str, wrap: str, field: str) -> Column:
    if wrap == "naive":
        return lerp(field, time)
    p, n = F.col(f"prev.{field}"), F.col(f"next.{field}")
    a = (F.col(time) - F.col("prev.t")) / (F.col("next.t") - F.col("prev.t"))
    return (
        F.when(F.col("prev.t").isNull(), n)
        .when(F.col("next.t").isNull(), p)
        .otherwise(wrap_rad(p + a * wrap_rad(n - p)))
    )


def interp_join(
    events: DataFrame, poses: DataFrame, keys=("bag",), time: str = "t_us",
    position=("tx", "ty", "tz"), pose_tie: str | None = None,
) -> DataFrame:
    """Pose at each event time: linear position, component-wise quaternion then normalised, yaw."""
    pair = asof_pair(events, poses, keys, time, [*position, *QUAT], pose_tie)
    base = list(events.columns)
    mid = pair.select(*base, *[lerp(c, time).alias(c) for c in (*position, *QUAT)])
    mid = mid.select("*", quat_norm(*QUAT).alias("_n"))
    mid = mid.select(*base, *position, *[(F.col(c) / F.col("_n")).alias(c) for c in QUAT])
    return mid.select("*", quat_to_yaw(*QUAT).alias("yaw"))


def interp_join_yaw_naive(
    events: DataFrame, poses: DataFrame, keys=("bag",), time: str = "t_us", position=("tx", "ty"),
    yaw: str = "yaw", wrap: str = "naive", pose_tie: str | None = None,
) -> DataFrame:
    """As ``interp_join`` for a pose that only has a yaw; ``wrap='shortest'`` goes through +-pi."""
    pair = asof_pair(events, poses, keys, time, [*position, yaw], pose_tie)
    return pair.select(
        *events.columns, *[lerp(c, time).alias(c) for c in position],
        _lerp_yaw(time, wrap, yaw).alias(yaw),
    )


def interp_series(
    events: DataFrame, samples: DataFrame, keys, time: str, values, tie: str | None = None,
    inside_only: bool = False,
) -> DataFrame:
    """Linear interpolation of any value columns; ``inside_only`` drops events out of range."""
    pair = asof_pair(events, samples, keys, time, list(values), tie)
    if inside_only:
        pair = pair.where(
            F.col("prev.t").isNotNull()
            & (F.col("next.t").isNotNull() | (F.col("prev.t") == F.col(time)))
        )
    return pair.select(*events.columns, *[lerp(v, time).alias(v) for v in values])


def nearest_pose_join(
    events: DataFrame, poses: DataFrame, keys=("bag",), time: str = "t_us", values=("tx", "ty", "tz"),
    pose_tie: str | None = None,
) -> DataFrame:
    """Pose closest in time; before the first -> first, after the last -> last, tie -> the later."""
    pair = asof_pair(events, poses, keys, time, list(values), pose_tie, equal="after")
    t = F.col(time)
    use_prev = F.col("next.t").isNull() | ((t - F.col("prev.t")) < (F.col("next.t") - t))
    pick = F.when(F.col("prev.t").isNotNull() & use_prev, F.col("prev")).otherwise(F.col("next"))
    return pair.select(*events.columns, pick.alias("_p")).select(
        *events.columns, F.col("_p.t").alias("pose_t"), *[F.col(f"_p.{v}").alias(v) for v in values]
    )


def number_frames(messages: DataFrame, keys=("bag",), order=("t_us", "event_id"), name="frame_id",
                  decodable: Column | None = None) -> DataFrame:
    """Dense ids in time order; messages that cannot be decoded take no number."""
    if decodable is not None:
        messages = messages.where(decodable)
    return dense_number(messages, keys, order, name)


def first_pose(poses: DataFrame, keys=("bag",), order=("t_us",), values=()) -> DataFrame:
    """Earliest row per recording, as an aggregate rather than a sort."""
    keep = list(values) or [c for c in poses.columns if c not in keys]
    if len(order) == 1:  # plain columns aggregate by hash, a struct would sort all rows
        return poses.groupBy(*keys).agg(*[F.min_by(c, order[0]).alias(c) for c in keep])
    return poses.groupBy(*keys).agg(
        F.min_by(F.struct(*keep), F.struct(*order)).alias("_p")
    ).select(*keys, "_p.*")


def previous_link(df: DataFrame, keys, pos: str, item: str, name: str = "previous") -> DataFrame:
    """Previous item in order; the first row links to itself."""
    out = neighbours(df, keys, pos, {"_prev": (item, -1)})
    return out.select(*df.columns, F.coalesce("_prev", item).alias(name))


def top_k_per_group(df: DataFrame, keys, order, k: int) -> DataFrame:
    """First k rows of each key for a report; Spark prunes to k rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topic_summary(messages: DataFrame, keys=("bag",), topic: str = "topic", kind: str = "msgtype", time: str = "t_us") -> DataFrame:
    """Per topic its message type, number of messages, first and last time; and the first and last time of the whole recording.

    Of several types of one topic the least by name is shown. Times are the least and the greatest, not those read first and last.
    """
    keys = list(keys)
    per = materialize(messages.groupBy(*keys, topic).agg(
        F.min(kind).alias(kind), F.count(F.lit(1)).alias("n"), F.min(time).alias("first_us"), F.max(time).alias("last_us")), "topics")
    whole = per.groupBy(*keys).agg(F.min("first_us").alias("start_us"), F.max("last_us").alias("end_us"))
    return per.join(whole, keys)
