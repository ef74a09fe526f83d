"""Spelling variants against plain loops over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wheeltrace.llm import spelling as S


def plain_counts(rows, deletes):
    out = Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if deletes and h % deletes == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_variants(rows, deletes=0):
    n = plain_counts(rows, deletes)
    form, n_near = {}, {}
    for a in n:
        close = [b for b in n if b != a and near(a, b)]
        n_near[a] = len(close)
        best = min(close, key=lambda b: (-n[b], b), default=None)
        form[a] = best if best is not None and n[best] >= 5 * n[a] else None
    out = set()
    for a in n:
        root = a
        while form[root] is not None:
            root = form[root]
        out.add((a, form[a], root, n[a], n_near[a], n[form[a]] if form[a] else None))
    return out


def fixture(rng, words=60, docs=120):
    letters = "abcdeéÿß"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(words // 3)]
    pool = list(stems)
    for w in stems:
        for _ in range(2):
            k = rng.randrange(len(w))
            pool.append(rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k + 1:], w[:k] + rng.choice(letters) + w[k:]]))
    weights = [rng.choice([1, 1, 8, 60]) for _ in pool]
    mixed = [w.upper() if w.isascii() and rng.random() < 0.1 else w for w in rng.choices(pool, weights, k=40 * docs)]
    return [(i, rng.choice([" ", ", ", "-", "9"]).join(mixed[40 * i:40 * i + 40])) for i in range(docs)]


@pytest.mark.parametrize("cell", [20_000, 9])
def test_variants_equal_all_pairs(docs, cell):
    rows = fixture(random.Random(cell)) + [(900, None), (None, "ÀÉÎõüß " * 6), (901, ""), (901, "9 . ×÷×÷×÷ " * 5), (902, "Chain " * 3)]
    rows += [(910 + i, " ".join(["wander"] * 625 + ["wandar"] * 25 + ["wondar"] * 5 + ["wander"])) for i in range(5)]
    df = docs(rows, ["word", "n"])
    got = S.spelling_variants(df, deletes=3, cell_words=cell).collect()
    want = plain_variants(rows, 3)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert sum(w[1] is not None for w in want) > 5


def test_roots_follow_chains(docs):
    rows = [(1, " ".join(["wander"] * 3200 + ["wandar"] * 640 + ["wondar"] * 125 + ["wondarr"] * 25 + ["wondrrr"] * 5))]
    got = {r.word: (r.form, r.root) for r in S.spelling_variants(docs(rows)).collect()}
    assert got == {"wander": (None, "wander"), "wandar": ("wander", "wander"), "wondar": ("wandar", "wander"),
                   "wondarr": ("wondar", "wander"), "wondrrr": ("wondarr", "wander")}


def test_long_texts_and_ties(docs):
    text = " ".join(["aaaaaab"] * 5 + ["aaaaaac"] * 5 + ["aaaaaa"] * 1 + ["z" * 300] * 6) + " aaaaaa" * 199_999
    got = {r.word: (r.form, r.n_near, r.n) for r in S.spelling_variants(docs([(1, text), (1, text)])).collect()}
    assert got == {"aaaaaab": ("aaaaaa", 2, 10), "aaaaaac": ("aaaaaa", 2, 10), "aaaaaa": (None, 2, 400_000), "z" * 300: (None, 0, 12)}
    assert S.spelling_variants(docs([])).count() == 0
    assert S.spelling_variants(docs([(1, None), (2, "short words")])).count() == 0


def test_cuts_inside_long_texts(monkeypatch):
    text = "One-two three " * 50 + "x" * 500 + " End"
    whole = S._count_runs(text)
    monkeypatch.setattr(S, "PART_CHARS", 7)
    assert S._count_runs(text) == whole


def test_range_search_misses_no_pair():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abcd") for _ in range(7)) for _ in range(800)})
    letters = S.letter_matrix(words, 7)
    counts = S.letter_counts(letters)
    tree, bits = S.KdTree(counts, 5, tight=True), S._unary(counts)
    got = set()
    for x, y in S._search(tree, bits, letters, bits, counts, letters, 2, True):
        got |= set(zip(x.tolist(), y.tolist()))
    d = (letters[:, None] != letters[None]).sum(2)
    assert got == set(zip(*(v.tolist() for v in np.nonzero(d == 1))))
    seen = sum(len(idx) for _, idx in tree.reach(counts, 2))
    assert seen < len(words) * len(tree.kids) / 4  # most boxes are pruned
