"""End-to-end flows over many recordings, composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheeltrace.operators import detect, frechet, grouping, paths, scene, score, timesync
from wheeltrace.session import materialize
from wheeltrace.sources import sinks


def synchronise(frames: DataFrame, odometry: DataFrame, keys=("bag",), time: str = "t_us",
                decodable=None) -> DataFrame:
    """Number the sensor messages of each recording and give each the interpolated pose."""
    numbered = timesync.number_frames(frames, keys, (time, "event_id"), decodable=decodable)
    return timesync.interp_join(numbered, odometry, keys, time)


def parked_cars(detections: DataFrame, poses: DataFrame, sensor: str, origin: tuple, run: str = "run",
                last_frames: DataFrame | None = None, order=("t_us",)) -> DataFrame:
    """Global detections of a run to final cars with side and orientation along the driven path.

    LiDAR detections are clustered directly; camera detections are tracked, clustered and merged.
    """
    path = materialize(paths.fit_path(poses, [run], list(order)), "path")
    if sensor == "lidar":
        return detect.finalise_cars(materialize(grouping.cluster_detections(detections, run=run), "clusters"), path, sensor, origin, run)
    tracks = materialize(grouping.track_static(detections, last_frames, run=run), "tracks")
    merged = grouping.merge_clusters(materialize(grouping.cluster_tracks(tracks, run=run), "clusters"), run=run)
    return detect.finalise_cars(materialize(merged, "clusters"), path, sensor, origin, run)


def scene_document(cars: DataFrame, edges: DataFrame, keys, edge_id: str, tag_cols: dict, offset: tuple,
                   final: DataFrame, source: DataFrame, override: bool = True) -> DataFrame:
    """Parking lines beside the roads, spawn positions of the cars, merged into the stored documents."""
    lines = scene.parking_lines(edges, edge_id, tag_cols, override, extra=keys)
    spawns = scene.spawn_positions(cars, lines, keys, "cluster_id", offset, edge_id)
    per_map = spawns.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in spawns.columns if c not in keys])).alias("spawn_positions"))
    return scene.vehicle_doc_merge(final, source, keys, spawns=per_map)


def score_drives(real: DataFrame, sim: DataFrame, real_steering: DataFrame | None = None, threshold: float = 0.95,
                 spacing: float = 0.5, sim_every: int = 3, dt: float = 3 / 30, keys=()) -> dict:
    """All drive-quality results, of every scenario named by ``keys`` in one job (of one scenario without them).

    ``real``: ``run, seq, x, y`` (and ``t`` for steering). ``sim``: ``run, method, seq, x, y, steer``; a simulated drive is
    one (method, run), so methods may share run numbers. ``real_steering``: ``run, t, steer``. All have the ``keys``.
    Returns DataFrames ``segments, path, completion, quality, jitter, averages, document``; without ``keys`` also the
    ``segment`` as a dict. The projections onto the references are made once.
    """
    single, keys = not keys, list(keys) or ["scenario"]
    if single:
        real, sim = real.withColumn("scenario", F.lit(0)), sim.withColumn("scenario", F.lit(0))
        real_steering = None if real_steering is None else real_steering.withColumn("scenario", F.lit(0))
    shown = [] if single else keys
    # names of drives across scenarios; the parts are told apart by a mark that no name has
    drive = F.concat_ws("\u241f", *keys, F.coalesce("method", F.lit("")), "run")
    methods = materialize(sim.select(*keys, "method", "run", drive.alias("drive")).distinct(), "methods")
    real = real.withColumn("drive", F.concat_ws("\u241f", *keys, "run"))
    path, real_p, segments = score.scenario_segments(real.select(*keys, "run", "drive", "seq", "x", "y"), keys, spacing)
    each = (*keys, "drive")
    sim_p = materialize(paths.project_runs(sim.withColumn("drive", drive), path, keys, each), "sim")
    done = materialize(score.completion(sim_p, segments, each, threshold=threshold), "completion")
    named = done.join(methods, [*each]).select(*shown, "method", "run", *[c for c in done.columns if c not in each])
    good = sim_p.join(done.where("success").select("drive"), "drive", "left_semi")

    inside, real_in = score.trim_to_segment(good, segments), score.trim_to_segment(real_p, segments)
    if len(keys) > 1:
        inside, real_in = (d.withColumn("_of", F.concat_ws("\u241f", *keys)) for d in (inside, real_in))
    enough = inside.groupBy(F.col("drive").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    pairs = frechet.frechet_discrete(inside, real_in, "drive", scenario="_of" if len(keys) > 1 else keys[0])
    reals = real.select(F.col("drive").alias("q"), F.col("run").alias("min_frechet_vs")).distinct()
    closest = frechet.frechet_min(pairs, enough).withColumnRenamed("vs", "q").join(reals, "q").drop("q").withColumnRenamed("p", "drive")

    def stations(p):
        return materialize(paths.resample_lateral(p, None, None, spacing, each, segments=segments), "stations")

    outside = score.corridor_violation(stations(good), score.corridor(stations(real_p), keys=keys), ("drive",))
    quality = materialize(
        closest.join(outside, "drive").join(methods, "drive").select(
            *keys, "method", "run", F.col("min_frechet").alias("frechet"), "min_frechet_vs",
            (F.col("rate") * 100).alias("out_pct"), "mean_excess", "mean_excess_out"), "quality")

    jitter = score.steering_jitter(good, segments, each, subsample=sim_every, dt=dt).join(methods, [*each]).drop("drive")
    if real_steering is not None:
        poses = real.select(*keys, "run", "seq", "t", "x", "y")
        at = timesync.interp_series(real_steering, poses, [*keys, "run"], "t", ["x", "y"], "seq", inside_only=True)
        at = materialize(timesync.number_frames(at, [*keys, "run"], ("t",), "seq"), "steering")
        timed = score.steering_jitter(paths.project_runs(at, path, keys, (*keys, "run")), segments, (*keys, "run"), time="t")
        jitter = jitter.unionByName(timed.withColumn("method", F.lit("real_world")))
    jitter = materialize(jitter.select(*keys, "method", "run", "jitter", "max_jitter"), "jitter")
    averages = materialize(score.method_averages(quality, jitter, keys=keys), "averages")
    document = sinks.results_doc(
        segments, quality, averages.select(*keys, "method", "runs", "avg_frechet_m", "avg_out_pct", "avg_mean_excess_m").where("runs is not null"), jitter,
        averages.select(*keys, "method", F.col("jitter_runs").alias("runs"), "avg_jitter", "max_jitter").where("runs is not null"), keys)
    out = {"segments": segments, "path": path, "completion": named, "quality": quality, "jitter": jitter, "averages": averages, "document": document}
    if single:
        out = {k: d.drop("scenario") for k, d in out.items()}
        out["segment"] = out["segments"].first().asDict()
    return out
