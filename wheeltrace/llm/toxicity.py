"""Toxicity by a convolutional text classifier (operator 2).

A word is the sum of the embeddings of its hashed features (the word, and its first four, five and six
letters). Filters of several widths slide over the words of the whole text, the largest response of
each filter goes to a logistic output. The weights are trained in numpy on a bounded sample of labelled
texts. All other labelled texts outside the held-out fold, of any length, calibrate the scores so that 0.5
separates best, and set a threshold for every language with labels for the additional flag. Labels, language,
source and id are no inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheeltrace.llm.common import fold, slices, table
from wheeltrace.llm.registry import query
from wheeltrace.llm.words import LETTER, WordTable, hashes, plain, split, tables
from wheeltrace.operators.ordered import counted

SAMPLE = 1500        # training texts per label at most
SAMPLE_CHARS = 12_000  # longer texts are not in the training sample
WIDTHS = (1, 2, 3)
FILTERS = 8
DIM = 8
PREFIXES = (4, 5, 6)
VOCABULARY = 60_000
DROPPED = 0.5        # share of words left out in each training step
LEAST_TEXTS = 4      # a feature is learned if so many training texts have it
LEAST_OWN = 5        # a language with fewer texts of a label borrows the rest from all languages


def word_features(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of every letter word (whole, then prefixes; 0 where there is none) and its text index."""
    kind, _ = tables()
    codes, start, stop, owner = split([plain(t) for t in texts])
    keep = kind[codes[start]] == LETTER if len(start) else np.zeros(0, bool)
    start, stop, owner = start[keep], stop[keep], owner[keep]
    out = [hashes(codes, start, stop)]
    for n in PREFIXES:
        long = np.flatnonzero(stop - start > n)
        h = np.zeros(len(start), np.uint64)
        h[long] = hashes(codes, start[long], start[long] + n) * np.uint64(2 * n + 1)
        out.append(h)
    return out, owner


@dataclass
class ToxicityModel:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    emb: np.ndarray = field(default_factory=lambda: np.zeros((1, DIM), np.float32))  # row 0: unknown features
    filters: np.ndarray = field(default_factory=lambda: np.zeros((DIM, 0), np.float32))  # all widths side by side
    filter_bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    out: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = -10.0
    slope: float = 1.0
    thresholds: dict = field(default_factory=dict)
    _table: WordTable | None = None

    def rows(self, features: list[np.ndarray]) -> np.ndarray:
        """Embedding row of each feature of each word; 0 where it was not learned."""
        if self._table is None:
            self._table = WordTable(max(1024, len(self.keys)))
            self._table.put(self.keys, np.arange(1, len(self.keys) + 1))
        return np.stack([np.maximum(self._table.get(h), 0) for h in features], 1)

    def responses(self, rows: np.ndarray, owner: np.ndarray, emb=None) -> np.ndarray:
        """Filter responses at every word, for the windows that begin there and stay in the text."""
        e = (self.emb if emb is None else emb)[rows].sum(1)
        z = e @ self.filters
        f = len(self.filter_bias) // len(WIDTHS)
        out = np.empty((len(rows), len(self.filter_bias)), np.float32)
        col = 0
        for k, w in enumerate(WIDTHS):
            own = z[:, col:col + f].copy()
            for j in range(1, w):
                if len(rows) > j:
                    same = owner[j:] == owner[:-j]
                    own[:-j] += z[j:, col + j * f:col + (j + 1) * f] * same[:, None]
            out[:, k * f:(k + 1) * f] = own + self.filter_bias[k * f:(k + 1) * f]
            col += w * f
        return out

    def logits(self, texts: list[str]) -> np.ndarray:
        if not len(self.out):
            return np.full(len(texts), self.bias)
        features, owner = word_features(texts)
        # a text without words has the filters' answer to unknown words
        pooled = np.maximum(np.repeat(self.filter_bias[None], len(texts), 0), 0)
        if len(owner):
            r = np.maximum(self.responses(self.rows(features), owner), 0)
            at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            pooled[owner[at]] = np.maximum.reduceat(r, at, axis=0)
        return (pooled @ self.out + self.bias) * self.slope

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -30, 30)))


def sample(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE, most: int = SAMPLE_CHARS) -> DataFrame:
    """(toxic, lang, text, doc_id) of at most ``per_label`` texts of each label, by the hash of the id."""
    known = _known(labels)
    # twice as many ids: some texts are longer than the training sample takes
    ids = [known.where(F.col("toxic") == k).orderBy(F.xxhash64(F.col("doc_id").cast("string"))).limit(2 * per_label) for k in (0, 1)]
    chosen = F.broadcast(ids[0].unionByName(ids[1]).dropDuplicates(["doc_id"]))  # at most 4 * per_label ids
    found = docs.select("doc_id", "text", "lang").join(chosen, "doc_id").where(F.length("text") <= most)
    parts = [found.where(F.col("toxic") == k).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "text").limit(per_label) for k in (0, 1)]
    return parts[0].unionByName(parts[1]).select("toxic", "lang", "text", "doc_id")


def _known(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out fold."""
    return labels.where((fold("doc_id") != 0) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")


def train(texts: list[str], toxic: list[int], langs: list[str | None], epochs: int = 8, rate: float = 0.05, others=None) -> ToxicityModel:
    """Fit on the given texts; every fifth text calibrates. One label alone gives a constant score.

    ``others`` gives further texts that calibrate: from the fitted model their (lang, toxic, logit, how many).
    """
    y_all = np.array(toxic, float)
    if not len(texts) or y_all.min() == y_all.max():
        return ToxicityModel(bias=10.0 if len(texts) and y_all[0] == 1 else -10.0)
    rng = np.random.default_rng(11)
    features, owner = word_features(texts)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    mixed = rng.permutation(len(texts))
    held, used = mixed[::5], mixed[np.arange(len(mixed)) % 5 != 0]
    in_use = np.zeros(len(texts), bool)
    in_use[used] = True
    pairs = np.concatenate([h[in_use[owner]] for h in features])
    who = np.tile(owner[in_use[owner]], len(features))
    keys, code = np.unique(pairs, return_inverse=True)
    seen = np.unique(code.astype(np.int64) * len(texts) + who) // len(texts)
    n = np.bincount(seen, minlength=len(keys))
    n[keys == 0] = 0
    good = np.flatnonzero(n >= min(LEAST_TEXTS, max(1, len(used) // 20)))
    good = np.sort(good[np.argsort(-n[good], kind="stable")[:VOCABULARY]])
    f, columns = FILTERS, FILTERS * sum(WIDTHS)
    m = ToxicityModel(
        keys[good], rng.normal(0, 0.05, (len(good) + 1, DIM)).astype(np.float32),
        rng.normal(0, 0.4, (DIM, columns)).astype(np.float32), np.zeros(f * len(WIDTHS), np.float32),
        rng.normal(0, 0.3, f * len(WIDTHS)).astype(np.float32), 0.0)
    m.emb[0] = 0
    rows = m.rows(features)
    adam = {k: [np.zeros_like(getattr(m, k)), np.zeros_like(getattr(m, k))] for k in ("filters", "filter_bias", "out")}
    adagrad = np.full(len(m.emb), 1e-4)
    steps = 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(used), max(1, len(used) // 16)):
            batch = batch[first[batch + 1] > first[batch]]
            if not len(batch):
                continue
            at = np.concatenate([np.arange(first[i], first[i + 1]) for i in batch])
            r, o, y = rows[at] * (rng.random((len(at), 1)) > DROPPED), owner[at], y_all[batch]
            size = first[batch + 1] - first[batch]
            begin = np.cumsum(size) - size
            z = m.responses(r, o)
            best = np.stack([b + z[b:b + s].argmax(0) for b, s in zip(begin, size)])
            top = np.take_along_axis(z, best, 0)
            pooled = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip(pooled @ m.out + m.bias, -30, 30)))
            g = (p - y) / len(batch)
            d_out, d_bias = pooled.T @ g, g.sum()
            d_top = g[:, None] * m.out[None] * (top > 0)
            d_filters, col = np.zeros_like(m.filters), 0
            moved, change = [], []
            for k, w in enumerate(WIDTHS):
                for j in range(w):
                    pos = best[:, k * f:(k + 1) * f] + j
                    inside = pos < (begin + size)[:, None]
                    word = np.minimum(pos, len(at) - 1)
                    grad = d_top[:, k * f:(k + 1) * f] * inside
                    e = m.emb[r[word]].sum(2)  # texts x filters x dim
                    part = slice(col + j * f, col + (j + 1) * f)
                    d_filters[:, part] = np.einsum("tf,tfd->df", grad, e)
                    moved.append(word.ravel())
                    change.append((grad[:, :, None] * m.filters[:, part].T[None]).reshape(-1, DIM))
                col += w * f
            steps += 1
            for k, d in (("filters", d_filters), ("filter_bias", d_top.sum(0)), ("out", d_out + 1e-3 * m.out)):
                a, b = adam[k]
                a += 0.1 * (d - a)
                b += 0.001 * (d * d - b)
                setattr(m, k, (getattr(m, k) - 0.02 * (a / (1 - 0.9 ** steps)) / (np.sqrt(b / (1 - 0.999 ** steps)) + 1e-8)).astype(np.float32))
            m.bias -= 0.2 * float(d_bias)
            ids = r[np.concatenate(moved)]
            delta = np.repeat(np.concatenate(change), ids.shape[1], 0)
            unique, back = np.unique(ids.ravel(), return_inverse=True)
            total = np.stack([np.bincount(back, delta[:, d], len(unique)) for d in range(DIM)], 1)
            adagrad[unique] += (total ** 2).mean(1)
            m.emb[unique] -= (rate * total / np.sqrt(adagrad[unique])[:, None]).astype(np.float32)
            m.emb[0] = 0
    z = np.round(m.logits([texts[i] for i in held]), 3)
    rows = [(langs[i], y_all[i], v, 1) for i, v in zip(held, z)]
    _calibrate(m, rows + (others(m) if others else []))
    return m


def _threshold(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Logit that separates the labels with the fewest errors of both kinds, in the middle of its gap; ``n`` rows each."""
    z, at = np.unique(z, return_inverse=True)
    bad, good = np.bincount(at, n * y, len(z)), np.bincount(at, n * (1 - y), len(z))
    wrong = np.cumsum(np.append(0, bad)) / bad.sum() + (good.sum() - np.cumsum(np.append(0, good))) / good.sum()
    i = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    i = i[len(i) // 2]
    return float(z[0] - 1 if i == 0 else z[-1] + 1 if i == len(z) else (z[i - 1] + z[i]) / 2)


def _calibrate(m: ToxicityModel, rows: list[tuple]) -> None:
    """Bias, slope and the thresholds of the languages from (lang, toxic, logit, how many) of texts that were not fitted."""
    langs = np.array([r[0] for r in rows], object)
    y, z, n = (np.array([r[k] for r in rows], float) for k in (1, 2, 3))
    if not len(y) or y.min() == y.max():
        return
    cut = _threshold(z, y, n)
    m.bias -= cut
    z = z - cut
    order = np.argsort(np.abs(z), kind="stable")
    total = np.cumsum(n[order])
    spread = np.abs(z)[order][np.searchsorted(total, total[-1] / 2)]
    m.slope = float(3 / max(spread, 1e-3))
    size = np.array([n[y == 0].sum(), n[y == 1].sum()])
    for lang in sorted({x for x in langs if x}):
        own = langs == lang
        have = np.array([n[own & (y == k)].sum() for k in (0, 1)])
        lent = np.maximum(LEAST_OWN - have, 0) / size  # weight of a text of any language
        t = _threshold(z, y, n * (own + lent[y.astype(int)]))
        m.thresholds[lang] = float(1 / (1 + np.exp(-np.clip(t * m.slope, -10, 10))))


def score(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """One row per input row: id, ``score``, ``predicted`` (1 if the score is 0.5 or more).

    With ``lang_col`` also ``flagged``: the score reaches the threshold calibrated for the row's language (0.5 where none was
    set, or the language is null); no language is an input of the score. The whole text is read; a null or empty text has the score of a
    text without known words. Ids may be null or repeat; other columns are not read.
    """
    lang = F.col(f"`{lang_col}`").cast("string") if lang_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), lang.alias("lang"))

    def run(batches):
        for batch in (s for b in batches for s in slices(b, "text", 700_000)):
            s = model.scores([t or "" for t in batch.column(1).to_pylist()]).astype(float)
            limit = np.array([model.thresholds.get(x, 0.5) for x in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(s >= limit)], ["id", "score", "predicted", "flagged"])

    kind = dict(rows.dtypes)["id"]
    out = rows.mapInArrow(run, f"id {kind}, score double, predicted int, flagged boolean").withColumnRenamed("id", id_col)
    return out if lang_col else out.drop("flagged")


def train_on(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> ToxicityModel:
    """Model from the labelled documents outside the held-out fold: a sample is fitted, all others calibrate."""
    spark = docs.sparkSession
    rows = sample(docs, labels, per_label).collect()  # a bounded number of bounded texts
    rows.sort(key=lambda r: (r[2], r[0]))
    text = F.xxhash64("text").alias("_text")
    kinds = dict(docs.dtypes)

    def others(model):
        taken = spark.createDataFrame([(r[3], r[2]) for r in rows], f"doc_id {kinds['doc_id']}, text string").select("doc_id", text).distinct()
        known = counted(_known(labels).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct())
        left = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(F.col("text").isNotNull()).join(known, "doc_id")
        left = left.select("*", text).join(F.broadcast(taken), ["doc_id", "_text"], "left_anti").select("text", "lang", "toxic")
        counts = left.mapInArrow(lambda batches: _logits(model, batches), "lang string, toxic int, z double").groupBy("lang", "toxic", "z").count()
        return [tuple(r) for r in counts.collect()]  # logits in steps of 0.001

    return train([r[2] for r in rows], [r[0] for r in rows], [r[1] for r in rows], others=others)


def _logits(model: ToxicityModel, batches):
    for batch in (s for b in batches for s in slices(b, "text", 700_000)):
        z = np.round(model.logits(batch.column(0).to_pylist()), 3)
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(z.astype(float))], ["lang", "toxic", "z"])


@query("op2_toxicity")
def op2_toxicity(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train_on(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model, lang_col="lang")
    return out.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", "predicted", "flagged")
