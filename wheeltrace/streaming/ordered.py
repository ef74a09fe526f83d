"""Ordered stateful operators on streams.

Rows of a run may arrive out of order. Each run keeps the rows that are newer than the watermark; rows
at or below it are complete, so they are folded in order and leave the buffer. State per run is
therefore bounded by the watermark delay plus the operator's own small state. Rows older than the
watermark are dropped by Spark and counted in ``stateOperators[].numRowsDroppedByWatermark``.

The folds are the batch operators' rules as step functions ``(state, ordered rows) -> (state, rows)``.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedFold(StatefulProcessor):
    """Buffers a key's rows until the watermark passes them, then applies ``step`` in order."""

    def __init__(self, key: str, time: str, order: list[str], columns: list[tuple[str, str]], step: Callable):
        self.key, self.time, self.order, self.columns, self.step = key, time, order, columns, step

    def init(self, handle) -> None:
        self.handle = handle
        names = ", ".join(f"{n} {t}" for n, t in self.columns if n not in (self.key, self.time))
        self.names = [n for n, _ in self.columns if n not in (self.key, self.time)]
        self.buffer = handle.getListState("buffer", f"_ms long, _time timestamp, {names}")
        self.state = handle.getValueState("state", "text string")

    def handleInputRows(self, key, rows, timerValues):
        latest = 0
        for pdf in rows:
            ms = pdf[self.time].astype("datetime64[us]").astype("int64") // 1000
            latest = max(latest, int(ms.max()))
            self.buffer.appendList(
                [(int(m), t.to_pydatetime(), *r) for m, t, r in
                 zip(ms, pdf[self.time], pdf[self.names].itertuples(index=False, name=None))])
        self.handle.registerTimer(latest + 1)
        yield from self._drain(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._drain(key, timerValues.getCurrentWatermarkInMs())

    def _drain(self, key, watermark):
        held = list(self.buffer.get())
        ready = [r for r in held if r[0] <= watermark]
        if not ready:
            return
        rest = [r for r in held if r[0] > watermark]
        if rest:
            self.buffer.put(rest)
        else:
            self.buffer.clear()
        pdf = pd.DataFrame(ready, columns=["_ms", self.time, *self.names]).drop(columns="_ms")
        pdf.insert(0, self.key, key[0])
        pdf = pdf.sort_values(self.order).reset_index(drop=True)
        state = json.loads(self.state.get()[0]) if self.state.exists() else None
        state, out = self.step(state, pdf)
        self.state.update((json.dumps(state),))
        if out is not None and len(out):
            yield out

    def close(self) -> None:
        pass


def ordered_stream(
    df: DataFrame, key: str, time: str, order: list[str], step: Callable, schema: str, delay: str = "10 seconds",
) -> DataFrame:
    """Run ``step`` per key over the rows of a stream in order, once the watermark has passed them."""
    proc = OrderedFold(key, time, order, df.dtypes, step)
    return (
        df.withWatermark(time, delay).groupBy(key)
        .transformWithStateInPandas(statefulProcessor=proc, outputStructType=schema, outputMode="Append", timeMode="EventTime")
    )


# --- steps ------------------------------------------------------------------------------------------
def ema_step(value: str, keep: list[str], alpha: float = 0.85, limit: float = 9.0) -> Callable:
    def step(state, pdf):
        prev, out = state, []
        for v in pdf[value]:
            prev = float(v) if prev is None else alpha * prev + (1 - alpha) * float(v)
            out.append(max(min(prev, limit), -limit))
        return prev, pdf[keep].assign(smooth=out)

    return step


def streak_step(condition: Callable[[dict | None, dict], bool], keep: list[str], alarm: int) -> Callable:
    """Counts consecutive rows that meet ``condition(previous row, row)``; flags the first alarm."""

    def step(state, pdf):
        state = state or {"prev": None, "n": 0, "fired": False}
        hits = []
        cols = [c for c in pdf.columns if pd.api.types.is_numeric_dtype(pdf[c])]
        for i, row in enumerate(pdf[cols].to_dict("records")):
            state["n"] = state["n"] + 1 if condition(state["prev"], row) else 0
            state["prev"] = row
            if state["n"] >= alarm and not state["fired"]:
                state["fired"] = True
                hits.append(i)
        return state, pdf[keep].iloc[hits]

    return step


def stuck_step(keep: list[str], step_m: float = 0.02, limit: int = 50) -> Callable:
    def still(prev, row):
        return prev is not None and sum((row[c] - prev[c]) ** 2 for c in ("x", "y", "z")) ** 0.5 < step_m

    return streak_step(still, keep, limit + 1)


def coverage_step(keep: list[str], dist: float = 0.15, frames: int = 30) -> Callable:
    return streak_step(lambda prev, row: row["dist"] > dist, keep, frames)


def hysteresis_step(frame: str, candidate: str, keep: list[str], initial: int = 0, delay: int = 50) -> Callable:
    def step(state, pdf):
        cur, pending, since = state or (initial, None, 0)
        out = []
        for f, c in zip(pdf[frame], pdf[candidate]):
            f, c = int(f), int(c)
            if c == cur:
                pending = None
            elif pending != c:
                pending, since = c, f
            elif f - since >= delay:
                cur, pending = c, None
            out.append(cur)
        return (cur, pending, since), pdf[keep].assign(active=out)

    return step


def hold_step(frame: str, value: str, keep: list[str], every: int = 3) -> Callable:
    def step(state, pdf):
        held, out = state, []
        for f, v in zip(pdf[frame], pdf[value]):
            if (int(f) - 1) % every == 0:
                held = float(v)
            out.append(held)
        return held, pdf[keep].assign(held=out)

    return step


def tracker_step(run: str = "run", radius: float = 2.0, max_age: int = 15, min_hits: int = 4) -> Callable:
    """Static-object tracks: emits a confirmed track when it is archived; live tracks are the state.

    Rows need the columns of the batch tracker's items: ``frame, det_idx, x, y, par, w`` and the
    weighted box sums. Uses the same fold as the batch operator.
    """
    from wheeltrace.operators.grouping import _TRACK, _track_fold

    fold = _track_fold(radius, max_age, run)
    ints = ("first_frame", "first_det", "last_frame", "hits", "n_par", "n_perp")

    def step(state, pdf):
        before = None
        if state:
            before = pd.DataFrame(state, columns=[run, *_TRACK])
        after = fold(before, pdf)
        # a track whose age has run out by the last folded frame is archived
        gone = after["done"] | (after["last_frame"] + max_age + 1 <= pdf["frame"].max())
        out = after[gone & (after["hits"] >= min_hits)].drop(columns="done")
        live = after[~gone].drop(columns="done")
        rows = [[int(v) if c in ints or c == run else float(v) for c, v in zip(live.columns, r)]
                for r in live.itertuples(index=False, name=None)]
        return rows, out.reset_index(drop=True)

    return step
