"""Language identification by averaged hashed subword embeddings (operator 7).

A text is the mean of the embeddings of its subwords (pairs and triples of letters with word borders,
whole words), hashed into buckets; a linear softmax on it gives the language. Embeddings and weights
are trained by stochastic gradient descent in numpy on a bounded sample of labelled passages; a held
back part of the sample sets the temperature of the scores and how familiar the subwords of a text must be.
As the mean is linear, the tasks add up bucket scores of the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wheeltrace.llm.common import fold, slices, table
from wheeltrace.llm.registry import query
from wheeltrace.llm.words import ngram_buckets, plain
from wheeltrace.session import materialize

SAMPLE = 600          # training passages per language at most
PASSAGE = 1500        # code points of a training passage at most
BITS = 15
REJECTED = 0.002      # share of the calibration pieces that may be rejected
PIECES = (40, 120, 400, PASSAGE)  # calibration pieces have so many code points
LEAST_SCORE = 0.35    # of more than two languages none is named below this
SPREAD = 4             # deviations below the mean that pieces may lie at least
SURE = 0.95           # a text of unfamiliar subwords stays if its language is this clear
MARGIN = 0.05         # further room below the least familiar pieces
ROOM = 0.75           # share of the room down to the negatives that is left to clean texts
BROADCAST_DRAWS = 1_000_000
BROADCAST_LANGUAGES = 10_000
UNKNOWN = "und"


@dataclass
class LanguageModel:
    names: list[str]
    scores: np.ndarray  # bucket scores: embedding times weights
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0
    familiar: np.ndarray | None = None  # log of each bucket's share in each language
    known_from: tuple[np.ndarray, np.ndarray] | None = None  # least familiarity, by the log of the number of subwords
    negatives_rejected: float = 0.0  # share of the calibration negatives that are rejected

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean subword scores, and the number of subwords (0: no letter)."""
        mean, n = self._sums(texts, self.scores)
        return mean + self.bias, n

    def _sums(self, texts: list[str], columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = int(self.scores.shape[0]).bit_length() - 1
        bucket, owner = ngram_buckets([plain(t) for t in texts], bits)
        n = np.bincount(owner, minlength=len(texts))
        total = np.stack([np.bincount(owner, columns[bucket, k], len(texts)) for k in range(columns.shape[1])], 1)
        return total / np.maximum(n, 1)[:, None], n

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities, number of subwords, and whether the text is rejected, from one reading of the texts."""
        k = len(self.names)
        columns = self.scores if self.familiar is None else np.hstack([self.scores, self.familiar])
        mean, n = self._sums(texts, columns)
        p = self._softmax(mean[:, :k] + self.bias)
        gone = p.max(1) < self.reject_below
        if self.known_from is not None:
            strange = mean[:, k:].max(1) < np.interp(np.log(np.maximum(n, 1)), *self.known_from)
            gone |= strange & (p.max(1) < SURE)
        return p, n, gone | (n == 0)

    def probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        z, n = self.logits(texts)
        return self._softmax(z), n

    def _softmax(self, z: np.ndarray) -> np.ndarray:
        z = z / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def passages(df: DataFrame, usable: Column, per_group: int = SAMPLE, most: int = PASSAGE) -> DataFrame:
    """(lang, passage): at most ``per_group`` passages of at most ``most`` code points of each language.

    Rows are chosen by the hash of their id, and a passage begins at a place drawn by that hash.
    """
    keyed = df.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", F.xxhash64(F.col("doc_id").cast("string")).alias("draw"))
    best = Window.partitionBy("lang").orderBy("draw")
    # the hashes that come into question first, by each language's count, so that no text is sorted and few hashes meet in a task
    counts = materialize(keyed.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    if counts.count() <= BROADCAST_LANGUAGES:
        counts = F.broadcast(counts)  # else the join would deal all hashes out by language
    place = F.col("draw") / F.lit(2.0 ** 64) + 0.5
    chosen = keyed.select("lang", "draw").join(counts, "lang").where(place * F.col("n") <= 2 * per_group + 100)
    chosen = chosen.withColumn("r", F.row_number().over(best)).where(F.col("r") <= per_group)
    chosen = materialize(chosen.select("draw").distinct(), "chosen")
    if chosen.count() <= BROADCAST_DRAWS:
        chosen = F.broadcast(chosen)
    at = F.pmod("draw", F.greatest(F.length("text") - most, F.lit(1))) + 1
    out = keyed.join(chosen, "draw", "left_semi").select("lang", "draw", F.substring("text", at.cast("int"), F.lit(most)).alias("passage"))
    return out.withColumn("r", F.row_number().over(best)).where(F.col("r") <= per_group).select("lang", "passage")


def _fit(texts: list[str], langs: list[str], bits: int = BITS, dim: int = 12, epochs: int = 8, rate: float = 1.0,
         use: np.ndarray | None = None) -> LanguageModel:
    """Fit embeddings and softmax to the passages of the indices ``use`` (all that have letters)."""
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros((1 << bits, 0)), np.zeros(0))
    y = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(7)
    bucket, owner = ngram_buckets([plain(t) for t in texts], bits)
    order = np.argsort(owner, kind="stable")
    bucket, first = bucket[order], np.searchsorted(owner[order], np.arange(len(texts) + 1))
    size = np.diff(first)
    used = np.flatnonzero(size > 0)
    if use is not None:
        used = np.intersect1d(used, use)
    bags = [np.unique(bucket[first[i]:first[i + 1]], return_counts=True) for i in range(len(texts))]
    emb = rng.normal(0, 0.1, (1 << bits, dim))
    w, b = rng.normal(0, 0.1, (dim, len(names))), np.zeros(len(names))
    share = np.bincount(y[used], minlength=len(names)) / max(1, len(used))
    balance = np.minimum(1 / np.maximum(share * len(names), 1e-9), 10)  # languages count alike
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(used):  # the subwords of one passage are distinct: plain indexing updates them
            ids, n = bags[i]
            part = n / size[i]
            mean = part @ emb[ids]
            z = mean @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= balance[y[i]]
            back = w @ p
            w -= step * np.outer(mean, p)
            b -= step * p
            emb[ids] -= step * np.outer(part, back)
    model = LanguageModel(names, (emb @ w).astype(np.float32), b)
    who = np.repeat(np.arange(len(texts)), size)
    mine = np.isin(who, used)
    seen = np.bincount(bucket[mine] * len(names) + y[who[mine]], minlength=len(names) << bits).reshape(-1, len(names))
    model.familiar = np.log((seen + 0.1) / (seen.sum(0) + 0.1 * len(seen))).astype(np.float32)
    return model


def _pieces(text: str, rng: np.random.Generator) -> list[str]:
    """Pieces of a passage in several lengths, from places drawn anew."""
    out = []
    for n in PIECES:
        at = int(rng.integers(0, max(1, len(text) - n + 1)))
        out.append(text[at:at + n])
    return out


def _shuffled(text: str, rng: np.random.Generator) -> str:
    """The letters of a text in any order, its words as long as before."""
    letters = [c for c in text if c.isalpha()]
    mixed = iter(rng.permutation(len(letters)).tolist())
    return "".join(letters[next(mixed)] if c.isalpha() else c for c in text)


def train(texts: list[str], langs: list[str], bits: int = BITS, dim: int = 12, epochs: int = 8, rate: float = 1.0,
          rejected: float = REJECTED) -> LanguageModel:
    """Fit the model; every fifth passage calibrates it.

    The temperature is the likeliest one for held back passages. A text is rejected if its subwords are less familiar (mean log
    share in the language where they are most frequent) than all but the share ``rejected`` of held back pieces of its
    length that are named rightly, and its score is not sure (clean texts with words of their own should stay). How well that works is measured on negatives: pieces with their letters shuffled, and held back pieces of a
    language judged by a model that has not seen it.
    """
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros((1 << bits, 0)), np.zeros(0))
    rng = np.random.default_rng(11)
    y = np.array([names.index(x) for x in langs])
    mixed = rng.permutation(len(texts))
    held, used = mixed[::5], mixed[np.arange(len(mixed)) % 5 != 0]
    fit = dict(bits=bits, dim=dim, rate=rate)
    model = _fit(texts, langs, epochs=epochs, use=used if len(used) else mixed, **fit)
    z, n = model.logits([texts[i] for i in held])
    z, own = z[n > 0], y[held][n > 0]
    if not len(z):
        return model
    best = None
    for t in np.geomspace(0.2, 5, 40):  # temperature by likelihood
        q = z / t
        loss = (np.log(np.exp(q - q.max(1, keepdims=True)).sum(1)) + q.max(1) - q[np.arange(len(q)), own]).mean()
        if best is None or loss < best[0]:
            best = loss, t
    model.temperature = float(best[1])
    model.reject_below = LEAST_SCORE if len(names) > 2 else 0.0
    pieces = [(p, y[i]) for i in held for p in _pieces(texts[i], rng)]
    p, n = model.probabilities([x for x, _ in pieces])
    right = [x for (x, k), best, m in zip(pieces, p.argmax(1), n) if best == k and m]
    if not right:
        return model
    mean, n = model._sums(right, model.familiar)
    mean, size = mean.max(1), np.log(n)
    edges = np.quantile(size, np.linspace(0, 1, len(PIECES) + 1))
    at, least = [], []
    for k in range(len(PIECES)):
        own = (size >= edges[k]) & (size <= edges[k + 1])
        at.append(float(size[own].min()))
        # few pieces say little about so small a share: then as far down as their spread suggests
        low = min(np.quantile(mean[own], rejected, method="lower"), mean[own].mean() - SPREAD * mean[own].std())
        least.append(float(low) - MARGIN)
    model.known_from = np.array(at), np.maximum.accumulate(least)
    strange = [(model, [_shuffled(texts[i][:400], rng) for i in held])]
    for k in range(len(names)) if len(names) > 2 else ():
        others = used[y[used] != k]
        part = _fit([texts[i] for i in others], [langs[i] for i in others], epochs=1, **fit)
        part.temperature, part.reject_below = model.temperature, model.reject_below
        strange.append((part, [texts[i][:400] for i in held[y[held] == k]]))
    # most of the room between clean pieces and negatives is left to the clean ones
    below = []
    for m, x in strange:
        if x:
            mean, n = m._sums(x, m.familiar)
            below.append((mean.max(1) - np.interp(np.log(np.maximum(n, 1)), *model.known_from))[n > 0])
    room = float(np.quantile(np.concatenate(below), 0.95)) if sum(map(len, below)) else 0.0
    model.known_from = model.known_from[0], model.known_from[1] + ROOM * min(room, 0.0)
    for m, _ in strange:
        m.known_from = model.known_from
    gone = np.concatenate([m.judge(x)[2] for m, x in strange if x])
    model.negatives_rejected = float(gone.mean())
    return model


def annotate(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All columns of the input and ``lang_pred``, ``score``, ``rejected``; one row per input row.

    The whole text is read. A null text, or one without a letter, is ``und`` with score 0 and rejected,
    as is every text when no language was learned. Input columns of these three names are replaced.
    """
    added = ["lang_pred", "score", "rejected"]
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in added])
    names = np.array([*model.names, UNKNOWN], object)
    most = max(100_000, 2_000_000 // max(4, len(model.names)))

    def run(batches):
        for batch in (s for b in batches for s in slices(b, text_col, most)):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            best, score = np.full(len(texts), len(model.names)), np.zeros(len(texts))
            gone = np.ones(len(texts), bool)
            if model.names:
                p, n, gone = model.judge(texts)
                best, score = np.where(n > 0, p.argmax(1), best), np.where(n > 0, p.max(1), 0.0)
            new = [pa.array(names[best], pa.string()), pa.array(score), pa.array(gone)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *added])

    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("rejected", T.BooleanType())])
    return rows.mapInArrow(run, schema)


def keep_identified(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows whose language is not rejected, with the columns of the input."""
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    return annotate(held, model).where("not rejected").select("row.*")


def train_on(docs: DataFrame, per_group: int = SAMPLE) -> LanguageModel:
    """Model from the labelled documents outside the held-out fold."""
    rows = passages(docs, fold("doc_id") != 0, per_group).collect()  # a few hundred passages per language
    rows.sort(key=lambda r: (r[0], r[1]))
    return train([r[1] for r in rows], [r[0] for r in rows])


@query("op7_language_id")
def op7_language_id(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = annotate(docs.select("doc_id", "text"), train_on(docs))
    return out.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
