"""Benchmark decontamination by q-gram lemma filtering (operator 3).

Texts are compared as letters and digits in lower case with single blanks between. A passage that is
within e edits of a benchmark item of length m shares at least m - q + 1 - q * e of the item's q-grams with
it, all on diagonals that lie within e of each other. Shared q-grams are counted in diagonal bands of twice
the needed width that overlap by half, regions that reach the bound are kept, and a banded alignment
gives their exact number of edits.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wheeltrace.llm.common import slices, table
from wheeltrace.llm.registry import query
from wheeltrace.operators.ordered import counted
from wheeltrace.session import materialize
from wheeltrace.llm.words import DIGIT, LETTER, plain, tables

Q = 12
EDIT_RATE = 0.06       # edits allowed per character of an item
BLOCK_CHARS = 1_000_000  # benchmark text of one pass over the documents
FILTER_BITS = 22
_BASE = 0x9E3779B97F4A7C15


def normal_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of all texts in lower case, one blank for anything between; and the text index of each.

    Every text begins with a blank and is followed by the next one's.
    """
    kind, lower = tables()
    texts = [plain(t) for t in texts]
    codes = np.frombuffer(("\n" + "\n".join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    first = np.cumsum(lengths) - lengths
    codes = lower[codes]
    k = kind[codes]
    ink = (k == LETTER) | (k == DIGIT)
    keep = ink.copy()
    keep[1:] |= ink[:-1]  # one blank after each word
    keep[first] = True
    codes = np.where(ink, codes, 32)[keep]
    owner = np.repeat(np.arange(len(texts)), np.add.reduceat(keep, first)) if len(texts) else np.zeros(0, np.int64)
    # a blank right behind a text's first blank, or two in a row, cannot be told apart from one
    double = np.append(False, (codes[1:] == 32) & (codes[:-1] == 32) & (owner[1:] == owner[:-1]))
    return codes[~double], owner[~double]


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """64-bit hash of the q codes from each place on, built from powers of two."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    block, size = codes.astype(np.uint64) + np.uint64(1), 1
    out, done = None, 0
    left = q
    while left:
        if left & 1:
            part = block[done:done + n]
            shift = np.uint64(pow(_BASE, size, 1 << 64))
            out = part.copy() if out is None else out * shift + part
            done += size
        left >>= 1
        if left:
            block = block[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + block[size:]
            size *= 2
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


@dataclass
class ItemIndex:
    """Q-grams of a block of benchmark items, sorted by hash."""

    ids: list
    codes: list[np.ndarray]
    edits: np.ndarray
    need: np.ndarray
    grams: np.ndarray
    item: np.ndarray
    place: np.ndarray
    bits: np.ndarray
    q: int = Q

    @staticmethod
    def build(ids: list, texts: list[str], rate: float = EDIT_RATE, q: int = Q) -> ItemIndex:
        codes, grams, item, place = [], [], [], []
        for i, t in enumerate(texts):
            c = normal_codes([t])[0][1:]
            c = c[:-1] if len(c) and c[-1] == 32 else c
            codes.append(c)
            h = gram_hashes(c, q)
            grams.append(h)
            item.append(np.full(len(h), i))
            place.append(np.arange(len(h)))
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        grams, item, place = cat(grams, np.uint64), cat(item, np.int64), cat(place, np.int64)
        order = np.argsort(grams, kind="stable")
        m = np.array([len(c) for c in codes], np.int64)
        edits = np.minimum((m * rate).astype(np.int64), np.maximum(0, (m - q) // q))
        bits = np.zeros(1 << FILTER_BITS, bool)
        bits[(grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        return ItemIndex(ids, codes, edits, np.maximum(1, m - q + 1 - q * edits), grams[order], item[order], place[order], bits, q)

    def regions(self, codes: np.ndarray, owner: np.ndarray):
        """(text, item, first diagonal, last diagonal) of bands whose shared q-grams reach the bound."""
        h = gram_hashes(codes, self.q)
        at = np.flatnonzero(self.bits[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        at = at[owner[at] == owner[at + self.q - 1]]
        lo = np.searchsorted(self.grams, h[at], side="left")
        n = np.searchsorted(self.grams, h[at], side="right") - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        if not len(at):
            return (np.zeros(0, np.int64),) * 4
        hit = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        at = np.repeat(at, n)
        item, diagonal = self.item[hit], at - self.place[hit]
        width = 2 * self.edits[item] + 1
        band = np.floor_divide(diagonal, width)
        rows = np.stack([np.concatenate([owner[at]] * 2), np.concatenate([item] * 2), np.concatenate([band, band - 1])])
        found, count = np.unique(rows, axis=1, return_counts=True)
        found = found[:, count >= self.need[found[1]]]
        width = 2 * self.edits[found[1]] + 1
        return found[0], found[1], found[2] * width, (found[2] + 2) * width - 1


def align(codes: np.ndarray, begin: np.ndarray, end: np.ndarray, patterns: list[np.ndarray], low: np.ndarray, high: np.ndarray):
    """Least edits of each pattern against any passage within its diagonals, and where that passage ends.

    Row by row over all regions at once; cell k of a region is its diagonal low + k.
    """
    n, width = len(patterns), int((high - low).max()) + 1
    size = np.array([len(p) for p in patterns])
    grid = np.zeros((n, int(size.max())), np.uint32)
    for r, p in enumerate(patterns):
        grid[r, :len(p)] = p
    k = np.arange(width)
    valid = k[None] <= (high - low)[:, None]
    big = 1 << 20
    cost = np.where(valid, 0, big)
    best, stop = np.full(n, big), np.zeros(n, np.int64)
    for i in range(int(size.max())):
        at = low[:, None] + k[None] + i
        inside = (at >= begin[:, None]) & (at < end[:, None])
        same = inside & (codes[np.clip(at, 0, len(codes) - 1)] == grid[:, i:i + 1])
        step = np.minimum(cost + ~same, np.concatenate([cost[:, 1:], np.full((n, 1), big)], 1) + 1)
        step = np.where(valid, step, big)
        cost = np.minimum.accumulate(step - k, 1) + k  # a text character more
        cost = np.where(valid, cost, big)
        done = size == i + 1
        if done.any():
            last = cost[done].argmin(1)
            best[done] = cost[done][np.arange(done.sum()), last]
            stop[done] = low[done] + last + i + 1
    return best, stop


def find_items(texts: list[str], index: ItemIndex):
    """(text index, item index, edits) of every item found; the fewest edits of its regions."""
    codes, owner = normal_codes(texts)
    text, item, low, high = index.regions(codes, owner)
    if not len(text):
        return text, item, low
    n = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(n) - n
    edits = index.edits[item]
    out = []
    for at in range(0, len(text), 512):
        s = slice(at, at + 512)
        d, _ = align(codes, first[text[s]], (first + n)[text[s]], [index.codes[i] for i in item[s]], low[s] - edits[s], high[s] + edits[s])
        out.append(d)
    edit = np.concatenate(out)
    good = edit <= edits
    text, item, edit = text[good], item[good], edit[good]
    order = np.lexsort((edit, item, text))
    text, item, edit = text[order], item[order], edit[order]
    lead = np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1])) if len(text) else np.zeros(0, bool)
    return text[lead], item[lead], edit[lead]


def item_blocks(bench: DataFrame, id_col: str, text_col: str, block_chars: int):
    """The benchmark in blocks of about ``block_chars`` characters; one block is on the driver at a time."""
    items = bench.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_chars))
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield sorted(part.collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def find_leaks(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", rate: float = EDIT_RATE, q: int = Q, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, item_id, edits) of every benchmark item found in a document, whole or with few edits.

    An item of m normalised characters is found if a passage of the text is within the smaller of
    ``rate`` * m and (m - q) / q edits of it. Items shorter than q characters, and null items or texts, match nothing.
    Of repeated rows each distinct (document id, item id) pair is reported once, with the fewest edits. A benchmark of any
    size is matched in blocks, each in one pass over the documents.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    kinds = dict(rows.dtypes)["doc_id"], dict(bench.dtypes)[item_id_col]
    id_type = to_arrow_type(bench.schema[item_id_col].dataType)
    context = docs.sparkSession.sparkContext
    out = None
    # one block after the other: its index is broadcast, its finds are written, and the index goes
    for block in item_blocks(bench, item_id_col, item_text_col, block_chars):
        held = context.broadcast((ItemIndex.build([r[0] for r in block], [r[1] for r in block], rate, q), pa.array([r[0] for r in block], id_type)))

        def run(batches, held=held):
            index, ids = held.value
            for batch in (s for b in batches for s in slices(b, "text", 1_000_000)):
                text, item, edits = find_items(batch.column(1).to_pylist(), index)
                if len(text):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(text)), ids.take(pa.array(item)), pa.array(edits.astype(np.int32))],
                        ["doc_id", "item_id", "edits"])

        found = materialize(rows.mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, edits int"), "finds")
        held.unpersist()
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def remove_leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows in whose text no benchmark item is found, with all their columns; ids may be null or repeat."""
    # an item is found in a text whatever its id
    texts = docs.select(F.md5(text_col).alias("_leak"), F.col(text_col))
    leaks = find_leaks(texts, bench, "_leak", text_col, **options).select(F.col("doc_id").alias("_leak")).distinct()
    # few leaks are broadcast, so that the texts need not move to lose them
    leaks = counted(leaks)
    return docs.join(leaks, F.md5(docs[text_col]) == leaks["_leak"], "left_anti")


@query("op3_decontaminate")
def op3_decontaminate(spark, sf_dir) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
