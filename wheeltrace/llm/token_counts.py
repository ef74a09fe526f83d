"""Token counts by a compiled finite-state tokenizer (operator 1).

A long text is cut into chunks. Each chunk becomes a state map: what it does to any state in which it
may be entered. White space leads every state back to the start, so the map is finite: the stretch
before the first white space (to be run from the entering state), the tokens counted from there to
the last white space, and the open stretch after it, which is the state on leaving. Maps compose
associatively; a parallel prefix scan over a text's maps gives the count up to every chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheeltrace.llm.bpe import Tokenizer
from wheeltrace.llm.common import arrow_map, table, tokenizer_path
from wheeltrace.llm.registry import query

CHUNK_CHARS = 1 << 16
BATCH_CHARS = 1_000_000
_BLANK = regex.compile(r"\s")
_LAST_BLANK = regex.compile(r"(?r)\s")


@dataclass
class StateMap:
    """Effect of a chunk: ``head`` runs from the entering state; ``resets`` tells if it has a blank."""

    head: str
    count: int = 0
    tail: str = ""
    resets: bool = False


def state_maps(chunks: list[str], count) -> list[StateMap]:
    """Maps of chunks; ``count`` gives the token counts of a list of closed stretches."""
    maps, bodies, who = [], [], []
    for c in chunks:
        first = _BLANK.search(c)
        if first is None:
            maps.append(StateMap(c))
            continue
        last = _LAST_BLANK.search(c).start()
        who.append(len(maps))
        bodies.append(c[first.start():last])
        maps.append(StateMap(c[:first.start()], 0, c[last:], True))
    for i, n in zip(who, count(bodies)):
        maps[i].count = int(n)
    return maps


def _compose_all(pairs: list[tuple[StateMap, StateMap]], count) -> list[StateMap]:
    both = [i for i, (a, b) in enumerate(pairs) if a.resets and b.resets]
    bridge = dict(zip(both, count([pairs[i][0].tail + pairs[i][1].head for i in both])))
    out = []
    for i, (a, b) in enumerate(pairs):
        if i in bridge:
            out.append(StateMap(a.head, a.count + b.count + int(bridge[i]), b.tail, True))
        elif a.resets:
            out.append(StateMap(a.head, a.count, a.tail + b.head, True))
        else:
            out.append(StateMap(a.head + b.head, b.count, b.tail, b.resets))
    return out


def prefix_scan(maps: list[StateMap], count) -> list[StateMap]:
    """Composition of maps 0..i for every i, in a logarithmic number of vectorised rounds."""
    if len(maps) < 2:
        return list(maps)
    half = prefix_scan(_compose_all([(maps[i], maps[i + 1]) for i in range(0, len(maps) - 1, 2)], count), count)
    even = _compose_all([(half[i // 2 - 1], maps[i]) for i in range(2, len(maps), 2)], count)
    out = [maps[0]]
    for i in range(1, len(maps)):
        out.append(half[i // 2] if i % 2 else even[i // 2 - 1])
    return out


def text_counts(texts: list[str], tokenizer: Tokenizer, chunk_chars: int = CHUNK_CHARS) -> list[int]:
    """Token count of every text."""
    totals, near = [0] * len(texts), []
    room = 0

    def flush():
        for i, n in zip(near, tokenizer.token_counts([texts[i] for i in near])):
            totals[i] = int(n)
        near.clear()

    def count(parts):
        out, at = [], 0
        while at < len(parts):  # bounded calls, also for a text of many chunks
            end, size = at, 0
            while end < len(parts) and (end == at or size < BATCH_CHARS):
                size += len(parts[end])
                end += 1
            out.extend(tokenizer.token_counts(parts[at:end]))
            at = end
        return out

    for i, t in enumerate(texts):
        if len(t) <= chunk_chars:
            near.append(i)
            room += len(t)
            if room >= BATCH_CHARS:
                flush()
                room = 0
            continue
        maps = state_maps([t[a:a + chunk_chars] for a in range(0, len(t), chunk_chars)], count)
        whole = prefix_scan(maps, count)[-1]
        totals[i] = whole.count + int(sum(count([whole.head, whole.tail] if whole.resets else [whole.head])))
    flush()
    return totals


def count_tokens(
    df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """One row per input row: id, ``n_bytes`` (UTF-8) and ``n_tokens``.

    A null text counts as empty (0, 0). Ids are carried as they are: null and repeated ids give a row
    each; other columns are not read. An empty table gives an empty result.
    """
    path = path or tokenizer_path()
    rows = df.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("n_bytes", F.octet_length("text").cast("long"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = text_counts(batch.column(1).to_pylist(), Tokenizer.load(path), chunk_chars)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(np.array(n, np.int64))], ["id", "n_bytes", "n_tokens"])

    kind = dict(rows.dtypes)["id"]
    return arrow_map(rows, run, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


@query("op1_token_counts")
def op1_token_counts(spark, sf_dir, limit: int = 2048) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
