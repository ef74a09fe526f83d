"""Run monitors: smoothing, stuck / fallen / out-of-coverage rules, outcome, switching, holding."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wheeltrace.operators.ordered import CHUNK_ROWS, chunk_of, neighbours, running


def ema_smooth(
    df: DataFrame, keys, pos: str, value: str, alpha: float = 0.85, limit: float = 9.0, name: str = "smooth",
    rows: int = 1024,
) -> DataFrame:
    """First value passes through, then alpha * previous + (1 - alpha) * value; clamped on output.

    A chunk's own part is one scaled running sum. The state on entering a chunk follows from the last states of
    the chunks before it, back to where alpha^distance takes any double to zero, so nothing is cut off.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    decay = -math.log(alpha)
    rows = max(1, min(rows, int(300 / decay)))
    back = math.ceil(1500 / (decay * rows)) + 1  # the largest double over the smallest is e^1455
    keys = list(keys)
    w = Window.partitionBy(*keys, "_chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    work = df.withColumn("_chunk", chunk_of(pos, rows)).repartition(*keys, "_chunk")
    k = F.col(pos) - F.col("_chunk") * rows  # 0 .. rows - 1
    gain = F.when(F.col(pos) == 0, F.lit(1.0)).otherwise(F.lit(1 - alpha))
    own = F.sum(gain * F.col(value) * F.pow(F.lit(alpha), -k)).over(w) * F.pow(F.lit(alpha), k)
    work = work.select("*", own.alias("_own_part"))
    ends = work.groupBy(*keys, "_chunk").agg(F.max_by("_own_part", pos).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(-back, -1)
    carry = F.aggregate(F.collect_list("_end").over(before), F.lit(0.0), lambda acc, x: acc * alpha ** rows + x)
    work = work.join(ends.select(*keys, "_chunk", carry.alias("_carry")), [*keys, "_chunk"])
    state = F.col("_carry") * F.pow(F.lit(alpha), k + 1) + F.col("_own_part")
    return work.select(*df.columns, F.greatest(F.least(state, F.lit(limit)), F.lit(-limit)).alias(name))


def streak(df: DataFrame, keys, pos: str, condition, name: str = "streak", rows: int = CHUNK_ROWS) -> DataFrame:
    """Number of consecutive rows, up to and including this one, for which ``condition`` holds."""
    base = df.select("*", F.coalesce(condition, F.lit(False)).alias("_hold"))
    out = running(base, keys, pos, {"_break": ("max", F.when(~F.col("_hold"), F.col(pos)))}, rows)
    return out.select(*[c for c in df.columns if c != "_chunk"], (F.col(pos) - F.coalesce("_break", F.lit(-1))).alias(name))


def stuck_monitor(df: DataFrame, keys, pos: str, xyz=("x", "y", "z"), step: float = 0.02, limit: int = 50, rows=CHUNK_ROWS) -> DataFrame:
    """First row at which the vehicle moved less than ``step`` for more than ``limit`` steps in a row."""
    prev = neighbours(df, keys, pos, {f"_p{c}": (c, -1) for c in xyz}, rows, keep_chunk=True)
    d2 = sum(((F.col(c) - F.col(f"_p{c}")) * (F.col(c) - F.col(f"_p{c}")) for c in xyz), F.lit(0.0))
    prev = prev.select(*keys, pos, "_chunk", F.sqrt(d2).alias("_move"))
    s = streak(prev, keys, pos, F.col("_move") < step, "_n", rows)
    return s.where(F.col("_n") > limit).groupBy(*keys).agg(F.min(pos).alias("stop_at"))


def fall_monitor(df: DataFrame, keys, pos: str, z: str = "z", floor: float = -0.5) -> DataFrame:
    return df.where(F.col(z) < floor).groupBy(*keys).agg(F.min(pos).alias("stop_at"))


def coverage_monitor(df: DataFrame, keys, pos: str, dist: str = "dist", limit: float = 0.15, frames: int = 30, rows=CHUNK_ROWS) -> DataFrame:
    """First row at which the distance exceeded ``limit`` for ``frames`` consecutive rows."""
    s = streak(df, keys, pos, F.col(dist) > limit, "_n", rows)
    return s.where(F.col("_n") >= frames).groupBy(*keys).agg(F.min(pos).alias("stop_at"))


REASONS = ("max_frames", "fell", "stuck", "out_of_coverage", "end_of_data")  # fixed values: order of the checks in a frame


def run_outcome(df: DataFrame, keys, pos: str, stops: dict[str, DataFrame], max_frames: int | None = None) -> DataFrame:
    """Reason and frame at which each run ends: the earliest rule, in checking order within a frame."""
    keys = list(keys)

    def tagged(d, reason):
        return d.select(*keys, F.struct(F.col("stop_at").alias("at"), F.lit(REASONS.index(reason)).alias("prio"), F.lit(reason).alias("reason")).alias("_e"))

    ends = df.groupBy(*keys).agg((F.max(pos) + 1).alias("stop_at"))
    every = tagged(ends, "end_of_data")
    if max_frames is not None:
        every = every.unionByName(tagged(ends.where(F.col("stop_at") > max_frames).withColumn("stop_at", F.lit(max_frames).cast("long")), "max_frames"))
    for reason, d in stops.items():
        every = every.unionByName(tagged(d, reason))
    return every.groupBy(*keys).agg(F.min("_e").alias("_m")).select(*keys, F.col("_m.reason").alias("reason"), F.col("_m.at").alias("stop_at"))


def switch_hysteresis(
    df: DataFrame, keys, pos: str, frame: str, candidate: str, initial: int = 0, delay: int = 50, name="active", rows=CHUNK_ROWS,
) -> DataFrame:
    """Active split when a candidate must persist ``delay`` frames before it is taken.

    Within a stretch of equal candidates the pending counter starts at the stretch's first frame
    (another candidate restarts it, the active one cancels it). So the active split is the candidate
    of the last row that lies ``delay`` or more frames into its stretch.
    """
    prev = neighbours(df, keys, pos, {"_pc": (candidate, -1)}, rows, keep_chunk=True)
    start = F.when(F.col("_pc").isNull() | (F.col("_pc") != F.col(candidate)), F.col(frame))
    prev = running(prev, keys, pos, {"_since": ("last", start)}, rows)
    held = F.when(F.col(frame) - F.col("_since") >= delay, F.col(candidate))
    out = running(prev, keys, pos, {name: ("last", held)}, rows)
    return out.select(*df.columns, F.coalesce(name, F.lit(initial)).alias(name))


def hold_last(df: DataFrame, keys, pos: str, frame: str, value: str, every: int = 3, name="held", rows=CHUNK_ROWS) -> DataFrame:
    """Value of the last frame on which a prediction was made (every n-th frame, counted from 1)."""
    fresh = F.when((F.col(frame) - 1) % every == 0, F.col(value))
    return running(df, keys, pos, {name: ("last", fresh)}, rows)
