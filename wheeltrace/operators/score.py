"""Scoring simulated drives against real ones: segment, completion, corridor, jitter, averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wheeltrace.operators.ordered import CHUNK_ROWS, dense_number, neighbours
from wheeltrace.operators.paths import arc_length, project_runs, resample_path
from wheeltrace.session import materialize


def longest_run(arcs: DataFrame, keys=(), run: str = "run", s: str = "s") -> DataFrame:
    """Run with the largest arc length per key; the first run wins ties."""
    per_run = arcs.groupBy(*keys, run).agg(F.max(s).alias("length"))
    best = F.min_by(F.struct(run, "length"), F.struct(-F.col("length"), F.col(run)))
    return per_run.groupBy(*keys).agg(best.alias("_b")).select(*keys, f"_b.{run}", "_b.length")


def scenario_segment(real: DataFrame, spacing: float = 0.5, run="run", pos="seq", rows=CHUNK_ROWS):
    """Common stretch of all real runs on the longest one.

    Returns ``(path, projected, segment)``: the reference path, the real runs projected onto it and
    a dict of scalars. Raises when the runs share no stretch.
    """
    arcs = materialize(arc_length(real, [run], pos, rows=rows), "arcs")
    best = longest_run(arcs, run=run).first()
    if best is None or best[run] is None:
        raise ValueError("no real runs")
    ref = arcs.where(F.col(run) == best[run])
    path = materialize(resample_path(ref, [run], pos, spacing=spacing).select("idx", "x", "y", "s"), "path")
    projected = materialize(project_runs(real, path, run_keys=(run,), pos=pos, rows=rows), "real")
    ends = projected.groupBy(run).agg(
        F.min_by("progress", pos).alias("first"), F.max_by("progress", pos).alias("last")
    )
    lim = ends.agg(F.max("first").alias("start"), F.min("last").alias("end")).first()
    if lim["end"] - lim["start"] <= 0:
        raise ValueError(f"no common segment: start {lim['start']:.1f} end {lim['end']:.1f}")
    segment = {
        "reference_run": best[run], "reference_length_m": best["length"], "start_m": lim["start"],
        "end_m": lim["end"], "length_m": lim["end"] - lim["start"], "spacing_m": spacing,
    }
    return path, projected, segment


def scenario_segments(real: DataFrame, keys, spacing: float = 0.5, run="run", pos="seq", rows=CHUNK_ROWS):
    """The same for every scenario (``keys``) in one job.

    Returns ``(path, projected, segments)``; ``segments`` is a table with one row per scenario that the other
    operators take in place of the dict. Raises when the runs of a scenario share no stretch.
    """
    keys = list(keys)
    arcs = materialize(arc_length(real, [*keys, run], pos, rows=rows), "arcs")
    best = materialize(longest_run(arcs, keys, run), "best")
    ref = arcs.join(best.select(*keys, run), [*keys, run], "left_semi")
    path = materialize(resample_path(ref, [*keys, run], pos, spacing=spacing).select(*keys, "idx", "x", "y", "s"), "path")
    projected = materialize(project_runs(real, path, keys, (*keys, run), pos, rows), "real")
    ends = projected.groupBy(*keys, run).agg(F.min_by("progress", pos).alias("first"), F.max_by("progress", pos).alias("last"))
    lim = ends.groupBy(*keys).agg(F.max("first").alias("start_m"), F.min("last").alias("end_m"))
    segments = materialize(best.join(lim, keys).select(
        *keys, F.col(run).alias("reference_run"), F.col("length").alias("reference_length_m"), "start_m", "end_m",
        (F.col("end_m") - F.col("start_m")).alias("length_m"), F.lit(spacing).alias("spacing_m")), "segments")
    bad = [tuple(r) for r in segments.where("not coalesce(length_m > 0, false)").select(*keys).limit(5).collect()]
    if bad:
        raise ValueError(f"no common segment for {bad}")
    return path, projected, segments


def with_segment(df: DataFrame, seg: dict | DataFrame) -> DataFrame:
    """Adds ``start_m``, ``end_m`` and ``length_m``: of the one scenario, or of each row's scenario."""
    names = ["start_m", "end_m", "length_m"]
    if isinstance(seg, dict):
        return df.withColumns({n: F.lit(float(seg[n])) for n in names})
    keys = [c for c in seg.columns if c in df.columns and c not in names]
    return df.join(seg.select(*keys, *names), keys)


def trim_to_segment(projected: DataFrame, seg: dict | DataFrame, progress: str = "progress") -> DataFrame:
    return with_segment(projected, seg).where(F.col(progress).between(F.col("start_m"), F.col("end_m"))).select(*projected.columns)


def completion(projected: DataFrame, seg: dict | DataFrame, keys=("run",), pos="seq", threshold=0.95, late_m=5.0) -> DataFrame:
    """Share of the segment reached, success flag, and whether the run starts late."""
    ends = with_segment(projected.groupBy(*keys).agg(
        F.min_by("progress", pos).alias("first"), F.max_by("progress", pos).alias("last")
    ), seg)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("last") - F.col("start_m")) / F.col("length_m")))
    return ends.select(
        *keys, share.alias("completion"), (share >= threshold).alias("success"),
        (F.col("first") > F.col("start_m") + late_m).alias("starts_late"),
    )


def corridor(stations: DataFrame, value: str = "offset_m", keys=()) -> DataFrame:
    """Lowest and highest lateral offset of the real runs per station (of each scenario in ``keys``)."""
    return stations.groupBy(*keys, "station").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def corridor_violation(
    stations: DataFrame, envelope: DataFrame, keys=("run",), value: str = "offset_m", min_stations: int = 10
) -> DataFrame:
    """Share of stations outside the envelope and mean excess, over all and over outside stations.

    Both sides meet by station and by the scenario columns that the envelope has.
    """
    on = [c for c in envelope.columns if c not in ("lo", "hi")]
    v = F.col(value)
    out = (v < F.col("lo")) | (v > F.col("hi"))
    excess = F.when(v < F.col("lo"), F.col("lo") - v).when(v > F.col("hi"), v - F.col("hi")).otherwise(0.0)
    j = stations.join(envelope, on).select(*keys, out.alias("out"), excess.alias("ex"))
    return j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("stations"),
        F.avg(F.col("out").cast("double")).alias("rate"),
        F.avg("ex").alias("mean_excess"),
        F.coalesce(F.avg(F.when(F.col("out"), F.col("ex"))), F.lit(0.0)).alias("mean_excess_out"),
    ).where(F.col("stations") >= min_stations)


def rate_of_change(
    df: DataFrame, keys, pos: str, value: str, time: str | None = None, dt: float | None = None,
    min_gap: float | None = None, max_gap: float | None = None, name="rate", ticks: float = 1.0, rows=CHUNK_ROWS,
) -> DataFrame:
    """Change per second between consecutive rows, with measured gaps in (min, max] or a fixed step.

    ``ticks`` per second of an integer clock: the difference is taken before it becomes a float. Rows at
    the same time as the row before have no rate (NULL).
    """
    cols = {"_pv": (value, -1), **({"_pt": (time, -1)} if time else {})}
    out = neighbours(df, keys, pos, cols, rows).where(F.col("_pv").isNotNull())
    gap: Column = (F.col(time) - F.col("_pt")) / ticks if time else F.lit(dt)
    if time and min_gap is not None:
        out = out.where((gap > min_gap) & (gap <= max_gap))
    return out.select(*df.columns, F.try_divide((F.col(value) - F.col("_pv")).cast("double"), gap.cast("double")).alias(name))


def steering_jitter(
    projected: DataFrame, seg: dict | DataFrame | None, keys: Sequence[str] = ("run",), pos="seq", steer="steer",
    time: str | None = None, subsample: int = 3, dt: float = 3 / 30, min_gap=0.05, max_gap=0.25,
    rows=CHUNK_ROWS,
) -> DataFrame:
    """Population std and maximum magnitude of the steering rate inside the segment.

    With ``time`` the measured gaps are used and gaps outside (min, max] are ignored; otherwise
    every ``subsample``-th row is taken with a fixed step ``dt``.
    """
    keys = list(keys)
    inside = projected if seg is None else trim_to_segment(projected, seg)
    use = [*keys, pos, steer, *([time] if time else [])]
    seq = dense_number(inside.where(F.col(steer).isNotNull()).select(*use), keys, [pos], "_pos")
    if time:
        rate = rate_of_change(seq, keys, "_pos", steer, time, min_gap=min_gap, max_gap=max_gap, rows=rows)
    else:
        thin = seq.where(F.col("_pos") % subsample == 0).withColumn("_pos", F.expr(f"_pos div {subsample}"))
        rate = rate_of_change(thin, keys, "_pos", steer, dt=dt, rows=rows)
    out = rate.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("gaps"), F.stddev_pop("rate").alias("jitter"), F.max(F.abs("rate")).alias("max_jitter")
    )
    return out.where(F.col("gaps") >= (2 if time else 1))


def method_averages(quality: DataFrame, jitter: DataFrame, method: str = "method", keys=()) -> DataFrame:
    """Per method (of each scenario in ``keys``): runs, mean distance, outside share and excess; mean and maximum jitter."""
    a = quality.groupBy(*keys, method).agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg("frechet"), 3).alias("avg_frechet_m"),
        F.round(F.avg("out_pct"), 1).alias("avg_out_pct"), F.round(F.avg("mean_excess"), 3).alias("avg_mean_excess_m"),
    )
    b = jitter.groupBy(*keys, method).agg(
        F.count(F.lit(1)).alias("jitter_runs"), F.round(F.avg("jitter"), 6).alias("avg_jitter"),
        F.round(F.max("max_jitter"), 6).alias("max_jitter"),
    )
    return a.join(b, [*keys, method], "full_outer")


CONDITIONS = ("sunny", "cloudy", "snowy")  # fixed values: column order of the report


def condition_matrix(
    completions: DataFrame, method="method", condition="condition", pct="completion_pct", threshold=95.0,
    conditions: Sequence[str] | None = None, most: int = 200,
) -> DataFrame:
    """Fail rate "f/n" and completion "avg - max - min" per method, one column pair per condition.

    Without ``conditions`` every name that occurs gets its columns (``most`` of them at most, else an error): first the
    usual ones in their order, then the others by name.
    """
    if conditions is None:
        found = [r[0] for r in completions.where(F.col(condition).isNotNull()).select(condition).distinct().limit(most + 1).collect()]
        if len(found) > most:
            raise ValueError(f"more than {most} conditions")
        conditions = [*CONDITIONS, *sorted(set(found) - set(CONDITIONS))]
    fail = F.format_string("%d/%d", F.sum((F.col(pct) < threshold).cast("long")), F.count(F.lit(1)))
    comp = F.format_string("%.0f - %.0f - %.0f", F.avg(pct), F.max(pct), F.min(pct))
    out = completions.groupBy(method).pivot(condition, list(conditions)).agg(
        fail.alias("fail"), comp.alias("completion")
    )
    return out.na.fill("---", [c for c in out.columns if c != method])
