"""Packing documents into token sequences by length patterns (operator 8).

Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the driver. Patterns of few
lengths that fill a sequence are enumerated, non-negative least squares fits how often to repeat each,
the repeats are rounded by largest remainder, and the residual counts are packed best-fit by length. The plan says for
every length which ranks go to which sequences and offsets; pieces, ranked within their length by a
distributed sort, look their place up.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheeltrace.llm.bpe import Tokenizer
from wheeltrace.llm.common import slices, table, tokenizer_path
from wheeltrace.llm.registry import query
from wheeltrace.operators.ordered import dense_number
from wheeltrace.session import materialize

CAPACITY = 4096
END_ID = 1
MAX_PATTERNS = 24_000
FULL = 0.995            # patterns that fill less of a sequence are left to best-fit
PART_CHARS = 1_000_000
BATCH_BYTES = 1_000_000
_BLANK = regex.compile(r"\s")


def text_parts(text: str, most: int = PART_CHARS) -> list[str]:
    """Cut a long text before white space, where words always end."""
    parts = []
    while len(text) > most:
        cut = _BLANK.search(text, most)
        if cut is None:
            break
        parts.append(text[:cut.start()])
        text = text[cut.start():]
    return [*parts, text]


def token_pieces(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: id, ``piece``, ``start``, ``length``, ``ids_crc32``.

    A document is its token ids and the end id. Null text counts as empty (one end id). Only longer documents are cut.
    """
    path = path or tokenizer_path()
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        tok = Tokenizer.load(path)
        for batch in (s for b in batches for s in slices(b, "text", BATCH_BYTES)):
            texts = batch.column(1).to_pylist()
            parts = [text_parts(t) if len(t) > PART_CHARS else [t] for t in texts]
            ids, n = tok.token_ids([p for ps in parts for p in ps])
            if any(len(p) > 1 for p in parts):
                n = np.add.reduceat(n, np.cumsum([0, *[len(p) for p in parts[:-1]]]))
            raw = ids.astype("<u4", copy=False)
            owner, piece, start, length, crc, at = [], [], [], [], [], 0
            for i, size in enumerate(n.tolist()):
                for p, a in enumerate(range(0, size + 1, capacity)):
                    b = min(a + capacity, size)
                    c = zlib.crc32(raw[at + a:at + b])
                    last = a + capacity > size
                    owner.append(i)
                    piece.append(p)
                    start.append(a)
                    length.append(b - a + last)
                    crc.append(zlib.crc32(end, c) if last else c)
                at += size
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def patterns(lengths: list[int], counts: list[int], capacity: int, most: int = MAX_PATTERNS) -> list[tuple[int, ...]]:
    """Short combinations of the given lengths that fill a sequence as far as possible."""
    have, rng, found = sorted(lengths), random.Random(1), {}

    def largest(room: int) -> int:
        i = bisect_right(have, room)
        return have[i - 1] if i else 0

    def add(parts):
        room = capacity - sum(parts)
        while room and len(parts) < 8 and (x := largest(room)):
            parts = (*parts, x)
            room -= x
        found.setdefault(tuple(sorted(parts, reverse=True)), None)

    for x in have:
        add((x,))
    per = max(1, most // max(1, len(have)) - 1)
    by = dict(zip(lengths, counts))
    cum = np.cumsum([by[x] for x in have])
    for x in reversed(have):
        for _ in range(per):
            if len(found) >= most:
                return list(found)
            parts, room = (x,), capacity - x
            while len(parts) < 4 and room >= have[0]:
                top = bisect_right(have, room)
                draw = rng.random() * cum[top - 1]
                y = have[min(int(np.searchsorted(cum, draw, side="right")), top - 1)]
                if len(parts) > 1 and rng.random() < 0.5:
                    break
                parts, room = (*parts, y), room - y
            add(parts)
    return list(found)


def fit_repeats(lengths: list[int], counts: list[int], found: list[tuple[int, ...]], rounds: int = 1500) -> np.ndarray:
    """Non-negative least squares: repeats x of the patterns with A x near the counts, by accelerated projected gradient."""
    at = {x: i for i, x in enumerate(lengths)}
    row = np.array([at[x] for p in found for x in p])
    col = np.repeat(np.arange(len(found)), [len(p) for p in found])
    weight = np.sqrt(np.array(lengths, float))[row]  # token mass counts
    goal = np.array(counts, float) * np.sqrt(np.array(lengths, float))
    scale = max(1.0, goal.max())
    goal = goal / scale
    ax = lambda x: np.bincount(row, weight * x[col], len(lengths))
    aty = lambda y: np.bincount(col, weight * y[row], len(found))
    v = np.ones(len(found))
    for _ in range(30):
        v = aty(ax(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(aty(ax(v))))
    x = y = np.zeros(len(found))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * aty(ax(y) - goal))
        if (y - new) @ (new - x) > 0:
            t = 1.0
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x * scale


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: equal sequences are kept as one group with a repeat count."""
    groups: dict[int, list] = {}
    rooms: list[int] = []

    def put(room, parts, n):
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((parts, n))

    for x in sorted(left, reverse=True):
        n = left[x]
        while n:
            i = bisect_left(rooms, x)
            if i == len(rooms):
                per = capacity // x
                if n >= per:
                    put(capacity - per * x, (x,) * per, n // per)
                    n %= per
                else:
                    put(capacity - n * x, (x,) * n, 1)
                    n = 0
                continue
            room = rooms[i]
            parts, m = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(i)
            used = min(n, m)
            put(room - x, (*parts, x), used)
            if m > used:
                put(room, parts, m - used)
            n -= used
    return [g for room in rooms for g in groups[room]]


def fitted_plan(left: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) placed by the fit; what remains of the histogram stays in ``left``."""
    plan: list[tuple[tuple[int, ...], int]] = []
    lengths = sorted(left)
    if not lengths:
        return plan
    counts = [left[x] for x in lengths]
    found = patterns(lengths, counts, capacity)
    fitted = fit_repeats(lengths, counts, found)
    full = [i for i, p in enumerate(found) if sum(p) >= FULL * capacity]

    def take(i, n):
        p = found[i]
        n = min([n, *[left[x] // p.count(x) for x in set(p)]])
        if n > 0:
            plan.append((p, n))
            for x in p:
                left[x] -= n

    # repeats are rounded down, fullest patterns first; then the largest remainders get one more while their pieces last
    for i in sorted(full, key=lambda i: (-sum(found[i]), -fitted[i], found[i])):
        take(i, int(fitted[i] + 1e-6))
    for i in sorted(full, key=lambda i: (int(fitted[i] + 1e-6) - fitted[i], -sum(found[i]), found[i])):
        take(i, 1)
    return plan


def plan_patterns(hist: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use up the histogram exactly: fitted patterns, then best-fit for the residual."""
    plan = [((capacity,), hist[capacity])] if hist.get(capacity) else []
    left = {x: n for x, n in hist.items() if n and x < capacity}
    plan += fitted_plan(left, capacity)
    return plan + best_fit({x: n for x, n in left.items() if n}, capacity)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` from 1 to ``capacity``."""
    pieces = materialize(pieces, "pieces")
    hist = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    key, low, seq, place = [], [], [], []
    used: dict[int, int] = {}
    base = 0
    for p, n in plan_patterns(hist, capacity):
        offset = 0
        for x in p:
            key.append(x)
            low.append(used.get(x, 0))
            seq.append(base)
            place.append(offset)
            used[x] = used.get(x, 0) + n
            offset += x
        base += n
    order = np.lexsort((low, key)) if key else np.zeros(0, np.int64)
    key, low, seq, place = (np.array(v, np.int64)[order] if len(v) else np.zeros(0, np.int64) for v in (key, low, seq, place))
    first = np.searchsorted(key, np.arange(capacity + 2))
    numbered = dense_number(pieces, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "rank")

    def run(batches):
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            at = np.zeros(len(length), np.int64)
            for x in np.unique(length):
                own = length == x
                at[own] = first[x] + np.searchsorted(low[first[x]:first[x + 1]], rank[own], side="right") - 1
            out = batch.drop_columns(["rank"])
            yield out.append_column("sequence_id", pa.array(seq[at] + rank - low[at])).append_column("offset", pa.array(place[at]))

    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return numbered.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack whole documents: one row per piece with its sequence and place.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null text is one end id; null and
    repeated ids are packed like others; an empty table gives an empty result; other columns are not read.
    """
    return pack_pieces(token_pieces(df, path, id_col, text_col, capacity, end_id), capacity)


@query("op8_packing")
def op8_packing(spark, sf_dir) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
