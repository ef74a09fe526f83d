"""Ordered computation without ever putting a whole recording into one task.

A recording may hold a large share of all rows, so ``Window.partitionBy(bag)`` is not acceptable for
row-level work. Everything here cuts a key's ordered rows into chunks of bounded size first:

* ``dense_number`` gives exact 0-based positions using a range-partitioned sort.
* ``with_halo`` copies a few rows over chunk borders, so lag/lead windows run per chunk.
* ``running`` computes running sum / max / last-non-null: chunk totals, a window over the (few)
  chunk totals of each key, and a per-chunk running window on top of the carry.
* ``ordered_parts`` is the same idea for streams that have no dense position yet.

Key columns must not be NULL: the carry is attached with an equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wheeltrace.session import materialize, size_in_bytes

CHUNK_ROWS = 16384
LARGE_BYTES = 256 << 20       # from this size on it pays to count a summary before joining it
BROADCAST_HEADS = 2_000_000   # summaries of up to this many rows (four numbers each) are broadcast


def ordered_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """Range-partition and sort by ``keys + order``; adds ``_part`` and ``_mid``.

    ``_mid`` increases along the global order and ``_part`` is the range it fell into. The result is
    a written table: the range bounds are sampled, so two evaluations could otherwise disagree. Columns that only order the rows
    need not be written (``drop``).
    """
    cols = [*keys, *order]
    placed = (
        df.repartitionByRange(*[F.col(c) for c in cols])
        .sortWithinPartitions(*cols)
        .withColumn("_mid", F.monotonically_increasing_id())
        .drop(*drop)
    )
    return materialize(placed, "ordered").withColumn("_part", F.shiftright("_mid", 33))


def dense_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos", drop: Sequence[str] = (),
) -> DataFrame:
    """Add the exact 0-based position of each row within its key; columns to ``drop`` only order the rows."""
    keys = list(keys)
    placed = ordered_parts(df, keys, order, drop)
    heads = placed.groupBy(*keys, "_part").agg(
        F.min("_mid").alias("_head"), F.count(F.lit(1)).alias("_n")
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(
        *keys, "_part", "_head", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")
    )
    if size_in_bytes(placed) >= LARGE_BYTES:
        heads = materialize(heads, "heads")  # one row per range and key in it
        if heads.count() <= BROADCAST_HEADS:
            heads = F.broadcast(heads)  # the sorted rows stay where they are
    return (
        placed.join(heads, [*keys, "_part"])
        .withColumn(name, F.col("_mid") - F.col("_head") + F.col("_off"))
        .select(*[c for c in df.columns if c not in drop], name)
    )


def counted(small: DataFrame, most: int = BROADCAST_HEADS) -> DataFrame:
    """A summary that is broadcast if it has few rows: it is written and counted, so that the large side of a join need not move.

    With more rows it stays as it is, and the join decides.
    """
    small = materialize(small, "summary")
    return F.broadcast(small) if small.count() <= most else small


def with_summary(rows: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join rows with a summary per key; large rows stay where they are while the summary can be counted and broadcast.

    A join on the key alone would deal all rows of a recording to one task.
    """
    if size_in_bytes(rows) >= LARGE_BYTES:
        small = counted(small)
    return rows.join(small, list(keys), how)


def chunk_of(pos: str, rows: int) -> Column:
    return F.expr(f"cast(`{pos}` as bigint) div {rows}")


def with_halo(
    df: DataFrame, keys: Sequence[str], pos: str, before: int, after: int, rows: int = CHUNK_ROWS
) -> DataFrame:
    """Assign rows to chunks of ``rows`` positions and copy border rows to the neighbour chunk.

    The rows are distributed by key *and* chunk: data that arrives distributed by key alone would
    satisfy the window too, with all rows of a hot key in one task. Adds ``_chunk`` and ``_own`` (false for the copies, to be filtered after the window).
    """
    if max(before, after) > rows:
        raise ValueError("halo wider than a chunk")
    chunk, inside = chunk_of(pos, rows), F.expr(f"cast(`{pos}` as bigint) % {rows}")
    targets = [F.struct(chunk.alias("c"), F.lit(True).alias("own"))]
    if before:
        targets.append(
            F.when(
                inside >= rows - before,
                F.struct((chunk + 1).alias("c"), F.lit(False).alias("own")),
            )
        )
    if after:
        targets.append(
            F.when(
                (inside < after) & (chunk > 0),
                F.struct((chunk - 1).alias("c"), F.lit(False).alias("own")),
            )
        )
    out = df.withColumn("_t", F.explode(F.array_compact(F.array(*targets))))
    out = out.select(*df.columns, F.col("_t.c").alias("_chunk"), F.col("_t.own").alias("_own"))
    return out.repartition(*keys, "_chunk")


def halo_window(keys: Sequence[str], pos: str):
    return Window.partitionBy(*keys, "_chunk").orderBy(pos)


def drop_halo(df: DataFrame, *extra: str) -> DataFrame:
    return df.where("_own").drop("_own", "_chunk", *extra)


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    cols: dict[str, tuple[str, int]],
    rows: int = CHUNK_ROWS,
    keep_chunk: bool = False,
) -> DataFrame:
    """Lag (negative) and lead (positive) columns: ``{"x_prev": ("x", -1), ...}``.

    ``keep_chunk`` leaves ``_chunk`` in place, so that ``running`` goes on without another shuffle.
    """
    before = max([-k for _, k in cols.values() if k < 0], default=0)
    after = max([k for _, k in cols.values() if k > 0], default=0)
    w = halo_window(keys, pos)
    out = with_halo(df, keys, pos, before, after, rows)
    out = out.select(
        "*",
        *[
            (F.lag(src, -k) if k < 0 else F.lead(src, k)).over(w).alias(name)
            for name, (src, k) in cols.items()
        ],
    )
    return out.where("_own").drop("_own") if keep_chunk else drop_halo(out)


def running(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    specs: dict[str, tuple[str, Column]],
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Inclusive running values in ``pos`` order.

    ``specs`` maps an output name to ``(kind, column)`` with kind ``sum``, ``max`` or ``last``
    (last non-null value so far). The input is read twice, so pass something cheap or written.
    An input that kept its ``_chunk`` (same ``rows``) is already distributed.
    """
    keys = list(keys)
    kept = [c for c in df.columns if c != "_chunk"]
    placed = "_chunk" in df.columns
    work = df if placed else df.withColumn("_chunk", chunk_of(pos, rows))
    work = work.select("*", *[c.alias(f"_v{i}") for i, (_, c) in enumerate(specs.values())])
    aggs, carries, finals = [], [], []
    prev = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    run = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(pos)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    for i, (name, (kind, _)) in enumerate(specs.items()):
        v, t, c = f"_v{i}", f"_t{i}", f"_c{i}"
        if kind == "sum":
            aggs.append(F.sum(v).alias(t))
            carries.append(F.sum(t).over(prev).alias(c))
            val = F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.sum(v).over(run), F.lit(0))
        elif kind == "max":
            aggs.append(F.max(v).alias(t))
            carries.append(F.max(t).over(prev).alias(c))
            val = F.greatest(F.col(c), F.max(v).over(run))
        elif kind == "last":
            aggs.append(F.max_by(v, F.when(F.col(v).isNotNull(), F.col(pos))).alias(t))
            carries.append(F.last(t, ignorenulls=True).over(prev).alias(c))
            val = F.coalesce(F.last(v, ignorenulls=True).over(run), F.col(c))
        else:
            raise ValueError(kind)
        finals.append(val.alias(name))
    totals = work.groupBy(*keys, "_chunk").agg(*aggs)
    carry = totals.select(*keys, "_chunk", *carries)
    work = work if placed else work.repartition(*keys, "_chunk")
    return work.join(carry, [*keys, "_chunk"]).select(*kept, *finals)


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add per-key summary columns by an equi-join; without keys the single row becomes literals."""
    if keys:
        return df.join(small, list(keys))
    row = small.first()
    return df.select("*", *[F.lit(row[c]).cast(t).alias(c) for c, t in small.dtypes])


def stride_sample(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, pos: str | None = None
) -> DataFrame:
    """Every n-th row by position in sorted order; ``pos`` names an existing dense position."""
    if pos is not None:
        return df.where(F.col(pos) % n == 0)
    return dense_number(df, keys, order, "_pos").where(F.col("_pos") % n == 0).drop("_pos")


def exact_percentile(df: DataFrame, keys: Sequence[str], value: str, p: float, name: str) -> DataFrame:
    """Percentile with linear interpolation, by cumulative counts of the sorted distinct values.

    Equal values are counted before the shuffle, and no task holds all values of a key.
    """
    keys = list(keys)
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    rows = materialize(dense_number(n, keys, [value], "_pos"), "values")
    cum = running(rows, keys, "_pos", {"_cum": ("sum", F.col("_n"))})
    at = rows.groupBy(*keys).agg(((F.sum("_n") - 1) * p).alias("_at"))
    near = attach(cum, at, keys)
    lo = F.min(F.when(F.col("_cum") > F.floor("_at"), F.col(value))).alias("_lo")
    hi = F.min(F.when(F.col("_cum") > F.ceil("_at"), F.col(value))).alias("_hi")
    frac = F.max(F.col("_at") - F.floor("_at")).alias("_f")
    return near.groupBy(*keys).agg(lo, hi, frac).select(
        *keys, (F.col("_lo") + F.col("_f") * (F.col("_hi") - F.col("_lo"))).alias(name))
