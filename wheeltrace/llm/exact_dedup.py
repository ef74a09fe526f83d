"""Exact dedup by a minimal perfect hash over the digests of history (operator 13).

The distinct digests of earlier documents are dealt to shards by their leading bits. Each shard is a
minimal perfect hash: digests that are alone at their place of a level's bit array stay there, the
others go on to the next level, and the rank of a digest's bit is its slot. A slot holds the full
digest and the locator of the winner (its id) with the number of copies. Later documents are looked up
by shard; a slot counts only if all bytes of its digest agree. Members are repeats of history, the
digests that are not in it are groups of their own. Texts never leave the scan: only digests travel, and
equal ones are combined before every shuffle, so that a group of copies of any size is one row a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wheeltrace.llm.common import fold, table
from wheeltrace.llm.registry import query
from wheeltrace.session import materialize

SHARD_DIGESTS = 40_000   # slots of a shard (about 3 MB)
GAMMA = 2.0              # bits of a level for each digest that reaches it
LEVELS = 40              # what is left after so many levels (practically nothing) is searched by value
BYTES = 32
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(text: str | Column) -> Column:
    """SHA-256 (32 bytes) of a text with A-Z in lower case; null counts as empty."""
    col = F.col(f"`{text}`") if isinstance(text, str) else text
    return F.unhex(F.sha2(F.translate(F.coalesce(col, F.lit("")), _UPPER, _UPPER.lower()), 256))


def _rows(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Digests as a matrix of bytes."""
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, BYTES)


def _place(d: np.ndarray, level: int, size: int) -> np.ndarray:
    """Places of digests in the bit array of a level."""
    h = d.view(np.uint64)
    x = h[:, 1] + h[:, 2] * np.uint64(2 * level + 1)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(29)
    return ((x >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


def _packed(bits: list[np.ndarray]) -> bytes:
    head = np.array([len(bits), *(len(b) for b in bits)], np.int64).tobytes()
    return head + b"".join(np.packbits(b).tobytes() for b in bits)


def _unpacked(raw: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8).tolist()
    at, out = 8 * (n + 1), []
    for s in sizes:
        out.append(np.unpackbits(np.frombuffer(raw, np.uint8, (s + 7) // 8, at), count=s).astype(bool))
        at += (s + 7) // 8
    return out


def perfect_hash(d: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The packed levels of a minimal perfect hash of distinct digests, and the slot of each of them.

    The few digests that no level could place take the last slots, in the order of their bytes.
    """
    d = np.ascontiguousarray(d)
    slot, left, bits, taken = np.empty(len(d), np.int64), np.arange(len(d)), [], 0
    while len(left) and len(bits) < LEVELS:
        size = max(8, int(GAMMA * len(left)))
        at = _place(d[left], len(bits), size)
        alone = np.bincount(at, minlength=size) == 1
        fits = alone[at]
        slot[left[fits]] = taken + (np.cumsum(alone) - 1)[at[fits]]
        taken += int(alone.sum())
        bits.append(alone)
        left = left[~fits]
    left = left[np.lexsort(d[left].T[::-1])]
    slot[left] = taken + np.arange(len(left))
    return _packed(bits), slot


def look_up(raw: bytes, slots: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Slot of each digest, -1 for nonmembers: every byte is compared with the digest in the slot."""
    d = np.ascontiguousarray(d)
    out, left, before = np.full(len(d), -1), np.arange(len(d)), 0
    for level, bits in enumerate(_unpacked(raw)):
        at = _place(d[left], level, len(bits))
        hit = bits[at]
        rank = np.cumsum(bits) - 1
        out[left[hit]] = before + rank[at[hit]]
        before += int(bits.sum())
        left = left[~hit]
    for k in range(before, len(slots)):
        out[left[(d[left] == slots[k]).all(1)]] = k
    known = np.flatnonzero(out >= 0)
    out[known[(slots[out[known]] != d[known]).any(1)]] = -1
    return out


def _shard(tag: str, n: int) -> Column:
    return F.pmod(F.conv(F.substring(F.hex(tag), 1, 15), 16, 10).cast("long"), F.lit(n)).cast("int")


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """Index of (tag, winner, copies), one row per distinct digest: a row per slot with its ``shard`` and ``slot``.

    The first slot of a shard carries the packed hash function in ``bits``.
    """
    kind = dict(history.dtypes)["winner"]

    def build(t: pa.Table) -> pa.Table:
        raw, slot = perfect_hash(_rows(t.column("tag")))
        order = np.argsort(slot)
        t = t.take(pa.array(order))
        bits = pa.array([raw, *[None] * (t.num_rows - 1)], pa.binary())
        return pa.table({"shard": t.column("shard"), "slot": pa.array(np.arange(t.num_rows)), "tag": t.column("tag"),
                         "winner": t.column("winner"), "copies": t.column("copies"), "bits": bits})

    dealt = history.select(_shard("tag", shards).alias("shard"), "tag", "winner", "copies")
    return dealt.groupBy("shard").applyInArrow(build, f"shard int, slot long, tag binary, winner {kind}, copies long, bits binary")


def match(index: DataFrame, later: DataFrame, shards: int) -> DataFrame:
    """Look later digests up: one row (tag, old_winner, old_copies, winner, copies) for every slot and every nonmember.

    ``later`` has one row (tag, winner, copies) per distinct digest; what does not apply is null.
    """
    kind = dict(later.dtypes)["winner"]

    def lookup(own: pa.Table, asked: pa.Table) -> pa.Table:
        own = own.take(pa.array(np.argsort(own.column("slot").to_numpy())))
        tags, n = _rows(own.column("tag")), own.num_rows
        slot = look_up(own.column("bits")[0].as_py(), tags, _rows(asked.column("tag"))) if n else np.full(asked.num_rows, -1)
        back = np.full(n, -1)
        back[slot[slot >= 0]] = np.flatnonzero(slot >= 0)
        new = np.flatnonzero(slot < 0)
        old_at = pa.array(np.append(np.arange(n), np.full(len(new), -1)), mask=np.append(np.zeros(n, bool), np.ones(len(new), bool)))
        at = np.append(back, new)
        new_at = pa.array(at, mask=at < 0)
        return pa.table({
            "tag": pa.chunked_array([*own.column("tag").chunks, *asked.column("tag").take(pa.array(new)).chunks], pa.binary()),
            "old_winner": own.column("winner").take(old_at), "old_copies": own.column("copies").take(old_at),
            "winner": asked.column("winner").take(new_at), "copies": asked.column("copies").take(new_at)})

    asked = later.select(_shard("tag", shards).alias("shard"), "tag", "winner", "copies")
    return index.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(
        lookup, f"tag binary, old_winner {kind}, old_copies long, winner {kind}, copies long")


def exact_duplicates(
    df: DataFrame, is_history: Column, id_col: str = "doc_id", text_col: str = "text", shard_digests: int = SHARD_DIGESTS,
) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``in_history``.

    Texts are equal if identical after lower-casing A-Z alone; null counts as empty. ``keep_id`` is the largest
    id of the group (a null id loses, a group of null ids keeps null), ``group_size`` its rows, ``kept`` marks
    the rows with that id: rows that repeat id and text are all marked, :func:`keep_last` leaves one of them.
    ``in_history`` tells whether the text occurs among the rows of ``is_history`` (null there: later rows); which
    rows those are changes no other column. Other columns are not read; an empty table gives an empty result.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), digest(text_col).alias("tag"), F.coalesce(is_history, F.lit(False)).alias("old"))
    rows = materialize(rows, "digests")
    per = [F.max("id").alias("winner"), F.count(F.lit(1)).alias("copies")]
    history = materialize(rows.where("old").groupBy("tag").agg(*per), "history")
    shards = max(1, -(-history.count() // shard_digests))
    index = materialize(build_index(history, shards), "index")
    later = rows.where("not old").groupBy("tag").agg(*per)
    found = match(index, later, shards).select(
        "tag", F.greatest("old_winner", "winner").alias("keep_id"),
        (F.coalesce("old_copies", F.lit(0)) + F.coalesce("copies", F.lit(0))).alias("group_size"), F.col("old_copies").isNotNull().alias("in_history"))
    # the rows of a large group meet its one row by a join that splits skewed partitions
    out = rows.join(materialize(found, "groups"), "tag")
    return out.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("tag")).alias("text_sha256"), "in_history")


def keep_last(df: DataFrame, is_history: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the largest id of each group of equal texts, all columns; of rows that repeat id and text one stays."""
    win = exact_duplicates(df, is_history, id_col, text_col).where("kept").select(
        F.col(id_col).alias("_id"), F.unhex("text_sha256").alias("_tag")).distinct()
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), digest(text_col).alias("tag"))
    on = F.col("id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag"))
    return held.join(win, on, "left_semi").dropDuplicates(["id", "tag"]).select("row.*")


@query("op13_exact_dedup", f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
""")
def op13_exact_dedup(spark, sf_dir) -> DataFrame:
    """Half of the ids (by hash) count as history, the other half comes later."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_duplicates(docs, fold("doc_id", 2) == 0).drop("in_history")
