"""Near-duplicate join on word n-grams by banded MinHash with exact verification (operator 6).

Every different text gets a signature of minimum hashes in bands. Texts that agree in the first places of a band
meet; how many places is fixed by the threshold and the wanted recall. (In place of a forest of prefix tries: the
recall is wanted for every pair at one threshold, which gives one depth for all texts; see README.) Texts that meet
and whose whole signatures agree well enough are brought together, and the exact likeness of their shingle sets decides.

Large groups are cut into blocks, and every pair of blocks is a task of its own, so no group is
gathered whole, no pair of texts leaves its task, and no candidate is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheeltrace.llm.common import components, slices, table
from wheeltrace.llm.registry import query
from wheeltrace.llm.words import SPACE, hashes, tables
from wheeltrace.session import materialize

WORDS = 5
THRESHOLD = 0.8
TREES, DEPTH = 16, 6
RECALL = 0.9999
SLACK = 0.2          # candidates may fall this far below the threshold by their signatures (about five deviations)
BLOCK = 512          # texts of a block


def band_rows(trees: int = TREES, depth: int = DEPTH, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The most rows of a band at which two texts at the threshold meet in some band with the target recall."""
    d = depth
    while d > 1 and 1 - (1 - threshold ** d) ** trees < recall:
        d -= 1
    return d


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word shingle and its text index, in order; words are separated by white space.

    A text of fewer words has one shingle of all of them, a text without words none.
    """
    kind, _ = tables()
    codes = np.frombuffer(("\n" + "\n".join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    ink = kind[codes] != SPACE
    edge = np.diff(ink.astype(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    owner = np.searchsorted(np.cumsum(lengths) - lengths, start, side="right") - 1
    h = hashes(codes, start, stop)
    if not len(h):
        return h, owner
    n = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(n) - n
    full = np.flatnonzero(np.arange(len(h)) + words <= (first + n)[owner])
    short = np.flatnonzero((n > 0) & (n < words))
    mult = np.uint64(0xD6E8FEB86659FD93)
    mixed = np.zeros(len(full), np.uint64)
    for j in range(words):
        mixed = mixed * mult + h[full + j]
    few = np.array([_fold(h[first[i]:first[i] + n[i]], mult) for i in short], np.uint64)
    out, who = np.concatenate([mixed, few]), np.concatenate([owner[full], short])
    order = np.argsort(who, kind="stable")
    out, who = out[order], who[order]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x9FB21C651E98DF25)
    out ^= out >> np.uint64(28)
    return out, who


def _fold(h: np.ndarray, mult: np.uint64) -> np.uint64:
    x = 0
    for v in h.tolist():
        x = (x * int(mult) + v) & 0xFFFFFFFFFFFFFFFF
    return np.uint64(x)


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(3)
    return rng.integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def signatures(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum hashes of each text (texts x size), and which texts have words."""
    h, owner = shingles(texts)
    out = np.zeros((len(texts), size), np.uint32)
    if len(h):
        at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        a, b = _multipliers(size)
        for k in range(size):
            v = (((h ^ b[k]) * a[k]) >> np.uint64(32)).astype(np.uint32)
            out[owner[at], k] = np.minimum.reduceat(v, at)
    has = np.zeros(len(texts), bool)
    has[owner] = True
    return out, has


def band_keys(sig: np.ndarray, trees: int, depth: int, prefix: int) -> np.ndarray:
    """Key of the first rows of every band (texts x bands)."""
    parts = sig.reshape(len(sig), trees, depth)[:, :, :prefix].astype(np.uint64)
    key = np.broadcast_to(np.arange(1, trees + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(prefix):
        key = (key ^ parts[:, :, j]) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")


def _signed(docs: DataFrame, trees: int, depth: int) -> DataFrame:
    """(doc_id, tag, sig) of every row; ``sig`` is null for texts without words."""

    def run(batches):
        for batch in (s for b in batches for s in slices(b, "text", 500_000)):
            sig, has = signatures(batch.column(2).to_pylist(), trees * depth)
            raw = pa.array([s.tobytes() if k else None for s, k in zip(sig, has)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), raw], ["doc_id", "tag", "sig"])

    rows = docs.select("doc_id", F.unhex(F.md5("text")).alias("tag"), "text")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, tag binary, sig binary")


def _by_group(batches, work):
    """Call ``work(table)`` with whole groups: rows come sorted by the first three columns."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if held is not None:
            t = pa.concat_tables([held, t])
        key = np.stack([t.column(i).to_numpy() for i in range(3)])
        cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0))
        if not len(cut):
            held = t
            continue
        out = work(t.slice(0, int(cut[-1]) + 1))
        held = t.slice(int(cut[-1]) + 1)
        if out is not None:
            yield out
    if held is not None:
        out = work(held)
        if out is not None:
            yield out


def _group_bounds(t: pa.Table) -> np.ndarray:
    key = np.stack([t.column(i).to_numpy() for i in range(3)])
    return np.append(np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0))), t.num_rows)


def _blocked(rows: DataFrame, group: str, counts: DataFrame, block: int) -> DataFrame:
    """Deal every row of a group to the pairs of blocks it takes part in: adds ``i``, ``j`` and ``own`` block.

    ``counts`` (group, n) has the sizes; a group of up to ``block`` rows is one pair (0, 0).
    """
    nb = F.ceil(F.col("n") / block).cast("int")
    rows = rows.join(counts, group).withColumn("nb", nb)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("n", "nb", "other")


def _min_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each connected component of the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = new[new[label]]
        if (new == label).all():
            break
        label = new
    return label


def _pairs(begin: int, end: int, own: np.ndarray, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a group; between two blocks only pairs across them."""
    if not cross:
        a, b = np.triu_indices(end - begin, 1)
        return a + begin, b + begin
    left, right = np.flatnonzero(own == own.min()), np.flatnonzero(own != own.min())
    return np.repeat(left, len(right)) + begin, np.tile(right, len(left)) + begin


def _links(t: pa.Table, least: float) -> pa.RecordBatch | None:
    """Spanning links of the texts of each group whose signatures agree in at least ``least`` of their places."""
    bounds = _group_bounds(t)
    node = t.column("node").to_numpy()
    own = t.column("own").to_numpy()
    cross = t.column("i").to_numpy() != t.column("j").to_numpy()
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(t.num_rows, -1)
    left, right, room = [], [], 0
    got_a, got_b = [], []

    def flush():
        nonlocal room
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            for at in range(0, len(a), 100_000):
                x, y = a[at:at + 100_000], b[at:at + 100_000]
                near = (sig[x] == sig[y]).mean(1) >= least
                got_a.append(x[near])
                got_b.append(y[near])
        left.clear()
        right.clear()
        room = 0

    for s, e in zip(bounds[:-1], bounds[1:]):
        if e - s < 2:
            continue
        a, b = _pairs(s, e, own[s:e], bool(cross[s]))
        left.append(a)
        right.append(b)
        room += len(a)
        if room > 400_000:
            flush()
    flush()
    if not got_a:
        return None
    label = _min_labels(t.num_rows, np.concatenate(got_a), np.concatenate(got_b))
    far = np.flatnonzero((label != np.arange(t.num_rows)) & (node[label] != node))
    if not len(far):
        return None
    return pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[label[far]])], ["a", "b"])


def _verify(t: pa.Table, num: int, den: int) -> pa.RecordBatch | None:
    """Exact links inside each group: (node, n_links, root) of every linked text."""
    bounds = _group_bounds(t)
    out_node, out_n, out_root = [], [], []
    for s, e in zip(bounds[:-1], bounds[1:]):
        part = t.slice(s, e - s)
        node, which = np.unique(part.column("node").to_numpy(), return_index=True)  # repeated rows once
        if len(node) < 2:
            continue
        own = part.column("own").to_numpy()[which]
        cross = part.column("i")[0].as_py() != part.column("j")[0].as_py()
        texts = part.column("text").take(pa.array(which)).to_pylist()
        h, owner = shingles(texts)
        # distinct shingles of each text, numbered over the group
        code = np.unique(h, return_inverse=True)[1].astype(np.int64)
        both = np.unique(owner.astype(np.int64) * (code.max() + 1) + code) if len(code) else np.zeros(0, np.int64)
        width = int(code.max()) + 1 if len(code) else 1
        owner, code = both // width, both % width
        size = np.bincount(owner, minlength=len(node))
        df = np.bincount(code, minlength=width)
        keep = df[code] > 1
        owner, code = owner[keep], code[keep]
        used, code = np.unique(code, return_inverse=True)
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        shared = np.zeros((len(node), len(node)), np.float32)
        step = max(256, 8_000_000 // len(node))
        for at in range(0, len(used), step):  # counts of shared shingles, some columns at a time
            lo, hi = np.searchsorted(code, [at, at + step])
            m = np.zeros((len(node), min(step, len(used) - at)), np.float32)
            m[owner[lo:hi], code[lo:hi] - at] = 1
            shared += m @ m.T
        # shared / union >= num / den, in whole numbers
        near = shared.astype(np.int64) * (num + den) >= num * (size[:, None] + size[None, :])
        near &= (size[:, None] > 0) & (size[None, :] > 0)
        np.fill_diagonal(near, False)
        if cross:
            near &= own[:, None] != own[None, :]
        n = near.sum(1)
        linked = np.flatnonzero(n)
        if not len(linked):
            continue
        a, b = np.nonzero(near)
        label = _min_labels(len(node), a, b)
        out_node.append(node[linked])
        out_n.append(n[linked])
        out_root.append(node[label[linked]])
    if not out_node:
        return None
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(x).astype(np.int64)) for x in (out_node, out_n, out_root)], ["node", "n_links", "root"])


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = (4, 5),
    trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK,
) -> DataFrame:
    """One row per input row: id, ``class_id``, ``n_links``, ``n_copies``, ``is_first``, ``text_md5``.

    Two texts are linked if the Jaccard likeness of their sets of five-word shingles reaches the threshold
    (a fraction); equal texts are copies. ``class_id`` is the smallest id of the texts connected by links and
    copies, ``n_links`` the number of different texts linked to the row's text, ``n_copies`` the number of rows
    with the same text, ``is_first`` marks the row whose id is the class id (repeated rows all have it).
    A null text is alone in its class; texts without words equal each other as copies only. Null ids are
    carried, and never a class id if the class has another. An empty table gives an empty result.
    """
    num, den = threshold
    docs = _texts(df, id_col, text_col)
    rows = materialize(_signed(docs, trees, depth), "signed")
    texts = rows.groupBy("tag").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"), F.first("sig").alias("sig"))
    texts = materialize(texts.withColumn("node", F.monotonically_increasing_id()), "texts")

    prefix = band_rows(trees, depth, num / den, recall)

    def keyed(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
            keys = band_keys(sig, trees, depth, prefix).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), trees)), pa.array(keys)], ["node", "key"])

    signed = texts.where("sig is not null").select("node", "sig")
    keys = materialize(signed.mapInArrow(keyed, "node long, key long"), "keys")
    met = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "met")
    dealt = _blocked(keys, "key", met, 2 * block).join(signed, "node")
    dealt = dealt.select("key", "i", "j", "own", "node", "sig").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    least = num / den - SLACK
    links = dealt.mapInArrow(lambda b: _by_group(b, lambda t: _links(t, least)), "a long, b long")
    near = components(links)

    sizes = materialize(near.groupBy("comp").agg(F.count(F.lit(1)).alias("n")), "sizes")
    parts = materialize(_blocked(near, "comp", sizes, block), "parts")
    parts = parts.join(texts.select("node", F.col("tag").alias("_tag"), "first_id"), "node")
    body = docs.select("doc_id", F.unhex(F.md5("text")).alias("tag"), "text")
    parts = body.join(parts, (F.col("tag") == F.col("_tag")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    parts = parts.select("comp", "i", "j", "own", "node", "text").repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    found = parts.mapInArrow(lambda b: _by_group(b, lambda t: _verify(t, num, den)), "node long, n_links long, root long")
    found = materialize(found, "links")
    label = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    count = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    label = label.join(count, "node", "left")
    known = texts.select("node", "tag", "first_id", "n_copies").join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    known = materialize(known, "known")
    classes = materialize(known.groupBy("comp").agg(F.min("first_id").alias("class_id")), "classes")
    known = known.join(classes, "comp").select("tag", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    known = materialize(known, "classed")
    out = rows.select("doc_id", "tag").join(known, "tag").select(
        "doc_id", "class_id", "n_links", "n_copies", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("is_first"),
        F.lower(F.hex("tag")).alias("text_md5"))
    alone = df.where(F.col(f"`{text_col}`").isNull()).select(F.col(f"`{id_col}`").alias("doc_id"))
    alone = alone.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), F.lit(True).alias("is_first"), F.lit(None).cast("string").alias("text_md5"))
    return out.unionByName(alone).withColumnRenamed("doc_id", id_col)


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class, with all columns of the input; repeated rows are one document.

    Documents with a null text belong to no class and stay.
    """
    first = near_duplicates(df, id_col, text_col, **options).where("is_first and text_md5 is not null")
    first = first.select(F.col(id_col).alias("_id"), F.col("text_md5").alias("_md5")).distinct()
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.md5(F.col(f"`{text_col}`")).alias("md5"))
    kept = held.where("md5 is not null").join(first, F.col("id").eqNullSafe(F.col("_id")) & (F.col("md5") == F.col("_md5")), "left_semi")
    kept = kept.dropDuplicates(["id", "md5"]).select("row.*")
    return kept.unionByName(held.where("md5 is null").select("row.*"))


@query("op6_ngram_join")
def op6_ngram_join(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
