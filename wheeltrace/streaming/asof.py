"""As-of joins of two streams: the pose at every event's time, linear or nearest.

Poses and events of a recording share one ordered stream. The watermark tells which rows are complete; those are folded in order of
time. An event then waits for the next pose, which may be later than the watermark; when it comes the event leaves with the poses on
both sides. An event that has waited longer than ``patience`` behind the watermark leaves with the pose before it, as the batch
operators do behind the last pose. State is the last pose, the waiting events, and what the watermark has not passed.
Late rows are dropped by Spark and counted in ``numRowsDroppedByWatermark``.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheeltrace.functions.angles import quat_norm, quat_to_yaw
from wheeltrace.operators.timesync import QUAT
from wheeltrace.streaming.ordered import OrderedFold


def _at(t: int, prev, nxt, nearest: bool) -> list[float]:
    """Values at a time between two poses (time, values); a missing side leaves the other."""
    if prev is None or nxt is None:
        return (nxt or prev)[1]
    if prev[0] == nxt[0]:
        return prev[1]
    if nearest:
        return prev[1] if t - prev[0] < nxt[0] - t else nxt[1]
    a = (t - prev[0]) / (nxt[0] - prev[0])
    return [p + a * (n - p) for p, n in zip(prev[1], nxt[1])]


class AsofFold(OrderedFold):
    """Folds complete rows of a recording; ``rank_`` tells poses (0) from events (1), ``us_`` is the time in microseconds."""

    def __init__(self, key, time, columns, keep, values, nearest, patience_ms):
        super().__init__(key, time, ["us_", "rank_"], columns, None)
        self.keep, self.values, self.nearest, self.patience = keep, values, nearest, patience_ms

    def handleInputRows(self, key, rows, timerValues):
        def watched():
            for pdf in rows:
                if len(pdf):
                    # once more when the last of these events has waited long enough
                    latest = int(pdf[self.time].max().value // 1_000_000)
                    self.handle.registerTimer(latest + self.patience + 2)
                    yield pdf

        yield from super().handleInputRows(key, watched(), timerValues)

    def _drain(self, key, watermark):
        buffered = list(self.buffer.get())
        ready, rest = [r for r in buffered if r[0] <= watermark], [r for r in buffered if r[0] > watermark]
        prev, waiting = json.loads(self.state.get()[0]) if self.state.exists() else (None, [])
        if not ready and not waiting:
            return
        if ready:
            self.buffer.put(rest) if rest else self.buffer.clear()
        out = []
        pdf = pd.DataFrame(ready, columns=["_ms", self.time, *self.names]).sort_values(self.order)
        for row in pdf.to_dict("records"):
            t = int(row["us_"])
            what = json.loads(row["what_"])
            if row["rank_"] == 0:
                nxt = [t, what]
                # a pose at the very time of the last one replaces it for later events
                out += [(e, _at(e[0], prev, nxt, self.nearest)) for e in waiting]
                prev, waiting = nxt, []
            else:
                waiting.append([t, what])
        if prev is not None:
            gone = [e for e in waiting if e[0] // 1000 + self.patience < watermark]
            out += [(e, _at(e[0], prev, None, self.nearest)) for e in gone]
            waiting = waiting[len(gone):]
        self.state.update((json.dumps((prev, waiting)),))
        if out:
            yield pd.DataFrame([(key[0], e[0], *(e[1].get(c) for c in self.keep), *v) for e, v in out], columns=[self.key, "t_us", *self.keep, *self.values])


def asof_stream(
    events: DataFrame, poses: DataFrame, key: str, time: str, values: Sequence[str], keep: Sequence[str], nearest: bool = False,
    delay: str = "10 seconds", patience_seconds: float = 60.0,
) -> DataFrame:
    """``key, t_us``, the ``keep`` columns of every event and the ``values`` of the poses at its time.

    ``time`` is a timestamp of both streams, ``values`` are numbers, ``keep`` numbers or text. Before the first pose the first one counts, behind
    the last pose the last. ``nearest`` takes the closer pose, the later one of a tie.
    """
    keep, values = list(keep), list(values)
    kinds = dict(events.dtypes)
    us = F.unix_micros(time).alias("us_")
    # at one time a pose comes before the events; what a row carries travels as text, so that neither side has empty columns
    numbers = F.to_json(F.array(*[F.col(v).cast("double") for v in values]))
    left = poses.select(key, time, us, F.lit(0).alias("rank_"), numbers.alias("what_"))
    right = events.select(key, time, us, F.lit(1).alias("rank_"), F.to_json(F.struct(*keep)).alias("what_"))
    both = left.unionByName(right)
    fold = AsofFold(key, time, both.dtypes, keep, values, nearest, int(patience_seconds * 1000))
    schema = ", ".join([f"{key} {kinds[key]}", "t_us long", *[f"{c} {kinds[c]}" for c in keep], *[f"{v} double" for v in values]])
    return both.withWatermark(time, delay).groupBy(key).transformWithStateInPandas(
        statefulProcessor=fold, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def interp_stream(events: DataFrame, poses: DataFrame, key: str, time: str, keep: Sequence[str], position=("tx", "ty", "tz"), **options) -> DataFrame:
    """Streaming form of ``interp_join``: linear position, component-wise quaternion then normalised, yaw."""
    mid = asof_stream(events, poses, key, time, [*position, *QUAT], keep, **options).withColumn("_n", quat_norm(*QUAT))
    mid = mid.select(key, "t_us", *keep, *position, *[(F.col(c) / F.col("_n")).alias(c) for c in QUAT])
    return mid.withColumn("yaw", quat_to_yaw(*QUAT))
