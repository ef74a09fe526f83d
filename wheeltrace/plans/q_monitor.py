"""Queries: run monitors."""

from pyspark.sql import functions as F

from wheeltrace.operators import monitors as Mo
from wheeltrace.plans.derived import cte, derived
from wheeltrace.plans.registry import q, query, r, rounded

# a drive that creeps now and then, loses height at the end and drifts from the cameras
_DRIVE = """SELECT run, seq, seq + 1 AS frame, CASE WHEN seq % 400 >= 300 THEN 5e0 + 0.001e0*(seq % 400) ELSE x END AS x, CASE WHEN seq % 400 >= 300 THEN 0e0 ELSE y END AS y,
   CASE WHEN seq >= 1200 + 150*run THEN -1e0 ELSE 0e0 END AS z, CASE WHEN (seq + 40*run) % 700 < 20 + 5*run THEN 0.3e0 ELSE 0.05e0 END AS dist, steer, CAST(seq // 90 % 3 + CASE WHEN seq % 90 < 30 THEN 1 ELSE 0 END AS INT) AS cand FROM runs"""


def _drive(spark, sf):
    derived(spark, sf, "runs").createOrReplaceTempView("_wt_runs")
    return spark.sql(_DRIVE.replace("FROM runs", "FROM _wt_runs").replace("seq // 90", "seq div 90"))


@query("ema_smooth", "WITH RECURSIVE " + cte(f"SELECT bag, seq, {q('greatest(least(y, 9e0), -9e0)')} AS smooth FROM ema", "series", extra={
    "ema": "SELECT bag, seq, value*6*pi() AS y FROM series WHERE seq = 0 UNION ALL SELECT s.bag, s.seq, 0.85e0*e.y + (1 - 0.85e0)*(s.value*6*pi()) FROM ema e JOIN series s ON s.bag = e.bag AND s.seq = e.seq + 1"})[5:])
def ema_smooth(spark, sf):
    s = derived(spark, sf, "series").withColumn("v", F.expr("value*6*pi()"))
    return rounded(Mo.ema_smooth(s, ["bag"], "seq", "v"), "bag", "seq", smooth="smooth")


_MON = {
    "dr": _DRIVE,
    "mv": "SELECT *, sqrt((x - lag(x) OVER w)*(x - lag(x) OVER w) + (y - lag(y) OVER w)*(y - lag(y) OVER w) + (z - lag(z) OVER w)*(z - lag(z) OVER w)) < 0.02e0 AS still FROM dr WINDOW w AS (PARTITION BY run ORDER BY seq)",
    "st": "SELECT run, seq, seq - coalesce(max(CASE WHEN NOT coalesce(still, false) THEN seq END) OVER (PARTITION BY run ORDER BY seq), -1) AS k FROM mv",
    "stuck": "SELECT run, min(seq) AS stop_at FROM st WHERE k > 50 GROUP BY run",
    "fell": "SELECT run, min(seq) AS stop_at FROM dr WHERE z < -0.5e0 GROUP BY run",
    "cv": "SELECT run, seq, seq - coalesce(max(CASE WHEN NOT dist > 0.15e0 THEN seq END) OVER (PARTITION BY run ORDER BY seq), -1) AS k FROM dr",
    "cover": "SELECT run, min(seq) AS stop_at FROM cv WHERE k >= 30 GROUP BY run",
}


@query("stuck_monitor", cte("SELECT run, stop_at FROM stuck", "runs", extra=_MON))
def stuck_monitor(spark, sf):
    return Mo.stuck_monitor(_drive(spark, sf), ["run"], "seq")


@query("fall_monitor", cte("SELECT run, stop_at FROM fell", "runs", extra=_MON))
def fall_monitor(spark, sf):
    return Mo.fall_monitor(_drive(spark, sf), ["run"], "seq")


@query("coverage_monitor", cte("SELECT run, stop_at FROM cover", "runs", extra=_MON))
def coverage_monitor(spark, sf):
    return Mo.coverage_monitor(_drive(spark, sf), ["run"], "seq")


@query("run_outcome", cte("""SELECT run, arg_min(reason, stop_at*10 + p) AS reason, min(stop_at) AS stop_at FROM (
   SELECT run, max(seq) + 1 AS stop_at, 4 AS p, 'end_of_data' AS reason FROM dr GROUP BY run UNION ALL SELECT run, 340, 0, 'max_frames' FROM dr GROUP BY run HAVING max(seq) + 1 > 340
   UNION ALL SELECT run, stop_at, 1, 'fell' FROM fell UNION ALL SELECT run, stop_at, 2, 'stuck' FROM stuck UNION ALL SELECT run, stop_at, 3, 'out_of_coverage' FROM cover) GROUP BY run""", "runs", extra=_MON))
def run_outcome(spark, sf):
    d = _drive(spark, sf)
    stops = {"fell": Mo.fall_monitor(d, ["run"], "seq"), "stuck": Mo.stuck_monitor(d, ["run"], "seq"),
             "out_of_coverage": Mo.coverage_monitor(d, ["run"], "seq")}
    return Mo.run_outcome(d, ["run"], "seq", stops, max_frames=340)


_HYS = {
    "dr": _DRIVE,
    "ch": "SELECT *, CASE WHEN lag(cand) OVER w IS NULL OR lag(cand) OVER w <> cand THEN frame END AS st FROM dr WINDOW w AS (PARTITION BY run ORDER BY seq)",
    "si": "SELECT *, last_value(st IGNORE NULLS) OVER (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING) AS since FROM ch",
}


@query("switch_hysteresis", cte("SELECT run, seq, coalesce(last_value(CASE WHEN frame - since >= 50 THEN cand END IGNORE NULLS) OVER (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS active FROM si", "runs", extra=_HYS))
def switch_hysteresis(spark, sf):
    return Mo.switch_hysteresis(_drive(spark, sf), ["run"], "seq", "frame", "cand").select("run", "seq", "active")


@query("hold_last", cte(f"SELECT a.run, a.seq, {q('b.steer')} AS held FROM runs a JOIN runs b ON b.run = a.run AND b.seq = a.seq - a.seq % 3", "runs"))
def hold_last(spark, sf):
    d = _drive(spark, sf)
    return rounded(Mo.hold_last(d, ["run"], "seq", "frame", "steer"), "run", "seq", held="held")
