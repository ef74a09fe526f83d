"""Spelling variants grouped by near words found in k-d trees over letter counts (operator 12).

A word is a point: how often each letter occurs in it. One inserted or deleted letter moves the point by one
(sum of absolute differences), one replaced letter by two at most, so near words of equal length lie within
two, those of the next length within one. For each length a k-d tree over the points of a bounded sample
cuts the space into cells; every word goes to its own cell and visits those of its length and of the next that
its range reaches. In a cell a k-d tree with tight boxes is searched for all visitors together: boxes out of range are
pruned, points in range are compared letter by letter in order. No pair leaves its cell, only each
word's number of near words and the best of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheeltrace.llm.common import table
from wheeltrace.llm.registry import query
from wheeltrace.session import materialize

MIN_LETTERS, MIN_COUNT, FACTOR = 6, 5, 5
DELETES = 199            # every so many (document, word) pairs lose a letter in the query
DIMS = 32                # a-z, and six for all other letters
CELL_WORDS = 20_000      # words of a cell of the outer tree
SAMPLE_PER_CELL = 64     # words that place the cuts; all words are indexed and searched
LEAF_WORDS = 48
PART_CHARS = 1_000_000
_RUN = re.compile("[a-zÀ-ÿ]+")
_BREAK = re.compile("[^a-zÀ-ÿ]")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _count_runs(text: str) -> Counter:
    """Runs of letters of a text with A-Z in lower case; long texts are cut between runs."""
    text = text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
    if len(text) <= PART_CHARS:
        return Counter(_RUN.findall(text))
    out, at = Counter(), 0
    while at < len(text):
        cut = _BREAK.search(text, at + PART_CHARS)
        end = cut.start() if cut else len(text)
        out.update(_RUN.findall(text, at, end))
        at = end
    return out


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS,
                min_count: int = MIN_COUNT, deletes: int = 0) -> DataFrame:
    """Words (runs of letters, A-Z in lower case) of at least ``min_letters`` that occur ``min_count`` times: (word, n).

    With ``deletes`` every (id, word) whose CRC-32 of ``<id>:<word>`` it divides loses the letter at that number modulo
    the length. Null texts have no words; a null id counts as an empty one.
    """
    rows = df.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        total: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                found = _count_runs(text)
                head = zlib.crc32((key.as_py() + ":").encode())
                for word, n in found.items():
                    if deletes and len(word) >= min_letters:
                        h = zlib.crc32(word.encode(), head)
                        if h % deletes == 0:
                            h %= len(word)
                            word = word[:h] + word[h + 1:]
                    if len(word) >= min_letters:
                        total[word] += n
                if len(total) > 200_000:
                    yield flush()
        if total:
            yield flush()

    part = rows.where("text is not null").mapInArrow(run, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


_DIM = np.zeros(256, np.uint8)
_DIM[:] = 26 + np.arange(256) % (DIMS - 26)
_DIM[97:123] = np.arange(26)


def letter_matrix(words: list[str], length: int) -> np.ndarray:
    """Codes of words of equal length (n x length)."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """How often each letter occurs (n x DIMS), at most 255 times."""
    n, length = codes.shape
    at = _DIM[codes].astype(np.int64) + (np.arange(n) * DIMS)[:, None]
    return np.minimum(np.bincount(at.ravel(), minlength=n * DIMS), 255).astype(np.uint8).reshape(n, DIMS)


class KdTree:
    """A k-d tree over letter counts; leaves hold up to ``leaf`` points or are equal points.

    ``tight`` boxes bound the points of a node; others bound the part of space it stands for.
    """

    def __init__(self, points: np.ndarray, leaf: int, tight: bool):
        self.order = np.arange(len(points))
        lo, hi, kids, spans = [], [], [], []
        todo = [(0, len(points), np.zeros(DIMS, np.uint8), np.full(DIMS, 255, np.uint8), None, 0)]
        self.cuts = {}
        while todo:
            begin, end, low, high, parent, side = todo.pop()
            own = points[self.order[begin:end]]
            me = len(kids)
            if parent is not None:
                kids[parent][side] = me
            lo.append(own.min(0) if tight and len(own) else low)
            hi.append(own.max(0) if tight and len(own) else high)
            kids.append([-1, -1])
            spans.append((begin, end))
            if end - begin <= leaf:
                continue
            best = None
            for d in np.argsort(-own.var(0, dtype=np.float32), kind="stable")[:4].tolist():
                col = own[:, d]
                mid = int(np.median(col))
                for cut in (mid - 1, mid):
                    n = int((col <= cut).sum())
                    if 0 < n < len(col) and (best is None or abs(2 * n - len(col)) < best[0]):
                        best = abs(2 * n - len(col)), d, cut, n
            if best is None:
                continue
            _, d, cut, n = best
            left = own[:, d] <= cut
            part = self.order[begin:end]
            self.order[begin:end] = np.concatenate([part[left], part[~left]])
            mid_high, mid_low = high.copy(), low.copy()
            mid_high[d], mid_low[d] = cut, cut + 1
            self.cuts[me] = d, cut
            todo.append((begin, begin + n, low, mid_high, me, 0))
            todo.append((begin + n, end, mid_low, high, me, 1))
        self.lo, self.hi, self.kids, self.spans = np.array(lo), np.array(hi), np.array(kids, np.int32), np.array(spans, np.int64)

    def reach(self, asked: np.ndarray, radius: int):
        """(leaf node, indices of ``asked`` points) for all leaves whose boxes are in range."""
        todo = [(0, np.arange(len(asked)))]
        while todo:
            node, idx = todo.pop()
            q = asked[idx]
            off = (np.maximum(self.lo[node], q) - q) + (q - np.minimum(self.hi[node], q))
            idx = idx[off.sum(1, dtype=np.uint16) <= radius]
            if not len(idx):
                continue
            if self.kids[node, 0] < 0:
                yield node, idx
            else:
                todo += [(int(k), idx) for k in self.kids[node]]

    def home(self, asked: np.ndarray) -> np.ndarray:
        """The leaf node each point belongs to by the cuts."""
        out, todo = np.zeros(len(asked), np.int64), [(0, np.arange(len(asked)))]
        while todo:
            node, idx = todo.pop()
            if self.kids[node, 0] < 0:
                out[idx] = node
                continue
            d, cut = self.cuts[node]
            left = asked[idx, d] <= cut
            todo += [(int(self.kids[node, 0]), idx[left]), (int(self.kids[node, 1]), idx[~left])]
        return out


def _unary(counts: np.ndarray) -> np.ndarray:
    """Counts up to four as runs of one bits (n x 2 words of 64): differing bits never exceed the distance."""
    four = ((1 << np.minimum(counts, 4).astype(np.uint64)) - np.uint64(1)) << (np.uint64(4) * (np.arange(DIMS, dtype=np.uint64) % np.uint64(16)))
    return np.stack([np.bitwise_or.reduce(four[:, :16], 1), np.bitwise_or.reduce(four[:, 16:], 1)], 1)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of ``a`` differ from rows of ``b`` by one replaced letter, or lack one letter if shorter by one."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    # equal letters from the front and from the back cover the shorter word
    n = a.shape[1]
    front = np.cumprod(a == b[:, :n], 1, dtype=np.uint8).sum(1, dtype=np.int64)
    back = np.cumprod((a == b[:, 1:])[:, ::-1], 1, dtype=np.uint8).sum(1, dtype=np.int64)
    return front + back >= n


def _search(tree: KdTree, point_bits, points, bits, counts, letters, radius, same):
    """Near (asked, point) index pairs, some at a time."""
    for leaf, idx in tree.reach(counts, radius):
        own = tree.order[slice(*tree.spans[leaf])]
        for at in range(0, len(idx), 4096):
            q = idx[at:at + 4096]
            off = np.bitwise_count(bits[q, 0][:, None] ^ point_bits[own, 0]) + np.bitwise_count(bits[q, 1][:, None] ^ point_bits[own, 1])
            i, j = np.nonzero(off <= radius)
            i, j = q[i], own[j]
            for k in range(0, len(i), 200_000):
                x, y = i[k:k + 200_000], j[k:k + 200_000]
                near = one_edit(letters[x], points[y])
                if near.any():
                    yield x[near], y[near]


POINT, SAME, SHORTER = 0, 1, 2


def _in_cell(t: pa.Table) -> pa.Table:
    """Near words between the points of a cell and its visitors: (word, n_near, best_n, best)."""
    kind = t.column("kind").to_numpy()
    length = t.column("length")[0].as_py()
    words, n = np.array(t.column("word").to_pylist(), object), t.column("n").to_numpy()
    at = np.flatnonzero(kind == POINT)
    found = []  # (word index, near count, index of the best near word)
    if len(at):
        points = letter_matrix(words[at].tolist(), length)
        counts = letter_counts(points)
        tree, bits = KdTree(counts, LEAF_WORDS, tight=True), _unary(counts)
        place = np.empty(len(words), np.int64)
        place[sorted(range(len(words)), key=lambda i: (-n[i], words[i]))] = np.arange(len(words))

        def best_of(size, rows, others):
            low = np.full(size, len(words))
            np.minimum.at(low, rows, place[others])
            return low

        for who, size in ((SAME, length), (SHORTER, length - 1)):
            asked = np.flatnonzero(kind == who) if who == SHORTER else np.flatnonzero(kind != SHORTER)
            if not len(asked):
                continue
            letters = letter_matrix(words[asked].tolist(), size)
            own = letter_counts(letters)
            near, low = np.zeros(len(words), np.int64), np.full(len(words), len(words))
            for x, y in _search(tree, bits, points, _unary(own), own, letters, 2 if who == SAME else 1, who == SAME):
                x, y = asked[x], at[y]
                near += np.bincount(x, minlength=len(words))
                low = np.minimum(low, best_of(len(words), x, y))
                if who == SHORTER:
                    near += np.bincount(y, minlength=len(words))
                    low = np.minimum(low, best_of(len(words), y, x))
            found.append((near, low))
    if not found:
        return pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "best_n": pa.array([], pa.int64()), "best": pa.array([], pa.string())})
    near, low = sum(f[0] for f in found), np.minimum.reduce([f[1] for f in found])
    by_place = np.argsort(place)
    got = np.flatnonzero(near)
    best = by_place[low[got]]
    return pa.table({"word": pa.array(words[got].tolist(), pa.string()), "n_near": pa.array(near[got]), "best_n": pa.array(n[best]), "best": pa.array(words[best].tolist(), pa.string())})


def _outer_trees(words: DataFrame, cell_words: int) -> dict[int, KdTree]:
    """Trees that cut the words of each frequent length into cells, from ``SAMPLE_PER_CELL`` words a cell."""
    sizes = words.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_words)
    trees = {}
    for length, n in sizes.collect():
        wanted = SAMPLE_PER_CELL * -(-n // cell_words)
        share = min(1.0, wanted / n)
        drawn = words.where((F.length("word") == length) & (F.pmod(F.xxhash64("word", F.lit("cut")), F.lit(1 << 20)) <= share * (1 << 20)))
        sample = [r.word for r in drawn.select("word").collect()]
        trees[length] = KdTree(letter_counts(letter_matrix(sample, length)), SAMPLE_PER_CELL, tight=False)
    return trees


def near_words(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """Words of (word, n) that have near words: (word, n_near, best_n, best), ``best`` the most frequent, ties the least."""
    trees = words.sparkSession.sparkContext.broadcast(_outer_trees(words, cell_words))

    def deal(batches):
        for batch in batches:
            all_words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            sizes = np.fromiter(map(len, all_words), np.int64, len(all_words))
            for length in np.unique(sizes).tolist():
                idx = np.flatnonzero(sizes == length)
                counts = letter_counts(letter_matrix([all_words[i] for i in idx], length))
                for size, radius in ((length, 2), (length + 1, 1)):
                    tree = trees.value.get(size)
                    if tree is None:
                        parts = [(0, np.arange(len(idx)))]
                        home = np.zeros(len(idx), np.int64)
                    else:
                        parts, home = tree.reach(counts, radius), tree.home(counts)
                    for cell, at in parts:
                        kind = np.where(home[at] == cell, POINT, SAME) if size == length else np.full(len(at), SHORTER)
                        who = idx[at]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(len(at), size, np.int32)), pa.array(np.full(len(at), cell, np.int32)), pa.array(kind.astype(np.int32)),
                            pa.array([all_words[i] for i in who], pa.string()), pa.array(n[who])], ["length", "cell", "kind", "word", "n"])

    dealt = words.select("word", "n").mapInArrow(deal, "length int, cell int, kind int, word string, n long")
    part = dealt.groupBy("length", "cell").applyInArrow(_in_cell, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return part.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def spelling_variants(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT,
    factor: int = FACTOR, deletes: int = 0, cell_words: int = CELL_WORDS,
) -> DataFrame:
    """One row per word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Words are those of :func:`word_counts`. Two words are near if one replaced, inserted or deleted letter makes one
    the other. ``form`` is the near word of largest count (ties: the least by code points) if it occurs at least
    ``factor`` times as often, else null; ``root`` is where following forms ends, the word itself without a form.
    Null and empty texts have no words, repeated rows count each, other columns are not read, an empty table gives an empty
    result.
    """
    words = materialize(word_counts(df, id_col, text_col, min_letters, min_count, deletes), "words")
    near = words.join(near_words(words, cell_words), "word", "left")
    is_form = F.col("best_n") >= factor * F.col("n")
    near = materialize(near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "near")
    root = near.where("form is not null").select("word", F.col("form").alias("root"))
    # counts rise by the factor at each step, so the chains are short: every round doubles the steps taken
    most = near.agg(F.max("n")).first()[0] or 0
    steps, reached = 1, min_count
    while reached * factor <= most and factor > 1:
        reached, steps = reached * factor, steps + 1
    for _ in range(max(steps - 1, 0).bit_length()):
        root = materialize(root, "root")
        after = root.select(F.col("word").alias("root"), F.col("root").alias("far"))
        root = root.join(after, "root", "left").select("word", F.coalesce("far", "root").alias("root"))
    return near.join(root, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@query("op12_spelling_variants")
def op12_spelling_variants(spark, sf_dir) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"), deletes=DELETES)
