"""Line dedup, near-duplicate join, fingerprints and decontamination against plain loops."""

import hashlib
import random
from collections import defaultdict

import pytest

from wheeltrace.llm import decontaminate, ngram_join
from wheeltrace.llm.fingerprints import (
    add_sketch, containment, distinct_shingles, fingerprint_documents, merge_parts, merged, resemblance, with_following)
from wheeltrace.llm.line_dedup import dedup_lines

from pyspark.sql import functions as F

from wheeltrace.session import materialize

RNG = random.Random(8)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 6))) for _ in range(400)]


def prose(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def near_groups(rng, groups=12, copies=6, n=150):
    rows, k = [], 0
    for _ in range(groups):
        base = prose(rng, n)
        for c in range(copies):
            w = list(base)
            for _ in range(c):
                w[rng.randrange(n)] = rng.choice(WORDS)
            rows.append((k, " ".join(w)))
            k += 1
    return rows


def shingle_set(text):
    w = text.split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_classes(rows):
    texts = defaultdict(list)
    for i, t in rows:
        texts[t].append(i)
    keys = list(texts)
    sets = [shingle_set(t) for t in keys]
    root, links = list(range(len(keys))), [0] * len(keys)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for k, t in enumerate(keys):
        groups[find(k)] += texts[t]
    return {(i, t): (min(groups[find(k)]), links[k], len(texts[t])) for k, t in enumerate(keys) for i in texts[t]}


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates_equal_all_pairs(docs, block):
    rows = near_groups(random.Random(1)) + [(900, ""), (901, ""), (902, "a b"), (903, "a b"), (904, "a b c"), (3, "again other text"), (905, "one")]
    got = ngram_join.near_duplicates(docs(rows, ["node", "comp"]), block=block).collect()
    want = plain_classes(rows)
    by_md5 = {(i, hashlib.md5(t.encode()).hexdigest()): v for (i, t), v in want.items()}
    assert len(got) == len(rows)
    for r in got:
        assert (r.class_id, r.n_links, r.n_copies) == by_md5[r.doc_id, r.text_md5]
    assert sum(v[1] for v in want.values()) > 20


def test_near_duplicates_odd_rows(docs):
    rows = [(1, None), (2, None), (None, "x y z"), (4, "x y z"), (5, "p q"), (5, "p q"), (6, "w " * 60_000)]
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.is_first) for r in ngram_join.near_duplicates(docs(rows)).collect()), key=str)
    assert got == sorted([(1, 1, 0, True), (2, 2, 0, True), (None, 4, 0, False), (4, 4, 0, True), (5, 5, 0, True), (5, 5, 0, True), (6, 6, 0, True)], key=str)
    assert ngram_join.near_duplicates(docs([])).count() == 0
    kept = ngram_join.keep_first(docs(rows, ["row", "md5"]))
    assert kept.columns == ["doc_id", "text", "row", "md5"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5, 6]


def test_chains_contract_in_few_rounds(spark, monkeypatch):
    from wheeltrace.llm import common
    from wheeltrace.operators import grouping

    rounds = []
    monkeypatch.setattr(grouping, "materialize", lambda df, name: rounds.append(name) or materialize(df, name))
    edges = [(k, k + 1) for k in range(1000)] + [(5000, 5000), (7000, 6000)]
    got = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.comp for r in got} == {**dict.fromkeys(range(1001), 0), 6000: 6000, 7000: 6000} and len(got) == 1003
    assert len(rounds) < 15
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_of_a_band_follow_the_recall():
    assert ngram_join.band_rows(16, 6, 0.8, 0.9999) == 3
    assert ngram_join.band_rows(16, 6, 0.8, 0.5) == 6
    assert ngram_join.band_rows(1, 6, 0.8, 0.9999) == 1


def plain_whole_runs(rows, min_words):
    """Lines left when every run of enough words that equals one earlier run is deleted, found by comparing all runs."""
    seen, left = set(), {}
    for i, t in sorted(rows):
        lines = [(k, x.strip(" ")) for k, x in enumerate(t.split("\n")) if x.strip(" ")]
        gone = set()
        for a in range(len(lines)):
            new = []
            for b in range(a, len(lines)):
                run = tuple(x for _, x in lines[a:b + 1])
                if sum(len(x.split(" ")) for x in run) >= min_words:
                    if run in seen:
                        gone |= set(range(lines[a][0], lines[b][0] + 1))
                    new.append(run)
            seen |= set(new)
        left[i] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
    return left


def test_line_dedup_equals_plain_loops(docs):
    rng = random.Random(2)
    pool = [" ".join(prose(rng, rng.randint(1, 15))) for _ in range(40)]
    passage = [" ".join(prose(rng, 20)) for _ in range(4)]
    rows = []
    for i in range(60):
        lines = [rng.choice(pool) if rng.random() < 0.4 else " ".join(prose(rng, rng.randint(1, 12))) for _ in range(rng.randint(0, 14))]
        if rng.random() < 0.5:
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = passage[:rng.randint(1, 4)]
        if rng.random() < 0.3:
            lines.insert(rng.randrange(len(lines) + 1), "  ")
        rows.append((i, "\n".join(lines)))
    got = {r.doc_id: (r.text, r.removed_lines) for r in dedup_lines(docs(rows), min_words=30).collect()}
    want = plain_whole_runs(rows, 30)
    assert {i: t for i, (t, _) in got.items()} == want
    assert sum(n > 0 for _, n in got.values()) > 15


def test_line_dedup_leaves_new_runs_of_frequent_lines(docs):
    rng = random.Random(6)
    frequent = [" ".join(prose(rng, 6)) for _ in range(20)]
    rows = [(i, "\n".join(rng.choice(frequent) for _ in range(20))) for i in range(120)]
    got = {r.doc_id: r.text for r in dedup_lines(docs(rows)).collect()}
    assert got == plain_whole_runs(rows, 40) == dict(rows)
    # copies of whole pieces, also of a piece whose fingerprint has an earlier place in other surroundings
    for i in range(120, 160):
        source = dict(rows)[rng.randrange(i)].split("\n")
        a = rng.randrange(10)
        piece = source[a:a + rng.randint(5, 10)]
        rows.append((i, "\n".join([rng.choice(frequent), "", *piece[:3], " ", *piece[3:], rng.choice(frequent), " ".join(prose(rng, rng.randint(1, 50)))])))
    got = {r.doc_id: r.text for r in dedup_lines(docs(rows)).collect()}
    assert got == plain_whole_runs(rows, 40)
    assert 10 < sum(got[i] != t for i, t in rows) < 40


def test_line_dedup_keeps_first_and_clean(docs):
    passage = " ".join(f"w{i}" for i in range(55))
    rows = [(1, f"own start\n{passage}\nown end"), (2, passage), (3, f"other\n{passage}"), (4, "short line\nshort line"), (5, "other"), (None, passage), (7, None), (4, "short line\nshort line")]
    got = dedup_lines(docs(rows, ["doc", "gone", "removed_lines"]))
    assert got.columns == ["doc_id", "text", "doc", "gone", "removed_lines"]
    out = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert out == sorted([(1, "own start\nown end"), (2, ""), (3, "other"), (4, "short line\nshort line"), (4, "short line\nshort line"), (5, "other"),
                          (None, passage), (7, None)], key=str)
    assert dedup_lines(docs([])).count() == 0


def test_line_dedup_words_by_all_white_space(docs):
    words = [f"w{i}" for i in range(50)]
    forms = ["\t".join(words), "\u00a0".join(words), "\u3000".join(words), "".join(chr(0x4E00 + i) for i in range(50)), "".join(chr(0x0E01 + i % 40) for i in range(50))]
    for k, form in enumerate(forms):
        got = {r.doc_id: r.text for r in dedup_lines(docs([(1, f"own {k}\n{form}\nend"), (2, f"other\n\u00a0{form}\r\nlast")])).collect()}
        assert got == {1: f"own {k}\n{form}\nend", 2: "other\nlast"}, k
    lines = [" ".join(words[i:i + 10]) for i in range(0, 50, 10)]
    got = {r.doc_id: r.text for r in dedup_lines(docs([(1, "\n".join(lines)), (2, "\r\n".join(lines) + "\r\nnew\r")])).collect()}
    assert got[2] == "new\r"
    few = [(1, "two" + " " * 41 + "words"), (2, "x\ntwo" + " " * 41 + "words"), (3, "Introduction" * 4), (4, "y\n" + "Introduction" * 4)]
    assert {r.doc_id: r.text for r in dedup_lines(docs(few)).collect()} == dict(few)


def test_fingerprints_follow_the_contract(docs):
    rng = random.Random(3)
    rows = [(10 * i, " ".join(prose(rng, rng.choice([0, 2, 30, 200])))) for i in range(70)] + [(9999, None), (10**12, "ä" * 10), (5, "same text here"), (6, "same text here")]
    got = {r.doc_id: r for r in fingerprint_documents(docs(rows, ["sketch", "edited"])).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 3
        edited = t[:len(t) - m] + nxt[:m]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), i
        assert len(got[i].sketch) == min(128, len(shingle_set(t)))
    assert got[5].sketch == got[6].sketch
    assert fingerprint_documents(docs([])).count() == 0
    assert [r.edited_sha256 for r in fingerprint_documents(docs([(1, "abc")])).collect()] == [hashlib.sha256(b"aba").hexdigest()]


def test_fingerprints_repeated_and_null_ids(docs):
    rows = [(1, "a b c"), (1, "a b c"), (1, "d e f"), (None, "x"), (None, "x")]
    assert fingerprint_documents(docs(rows)).count() == 5


def test_following_in_bounded_buckets(docs):
    rng = random.Random(9)
    rows = [(i, " ".join(prose(rng, 3))) for i in range(1000)] + [(10**15, "far"), (-10**15, "low"), (-2**63, "least")]
    rows += [(None, f"null {i}") for i in range(300)] + [(7, f"seven {i}") for i in range(300)] + [(50, "same")] * 500 + [(None, "none")] * 300
    near = with_following(docs(rows), "doc_id", "text", rows=32, copies=64)
    sizes = near.groupBy("_bucket", "_salt").count().collect()
    assert sum(r["count"] for r in near.where("_own").groupBy().count().collect()) == len(rows)
    assert max(r["count"] for r in sizes) < 32 + 1 + 2 * 64 and len(sizes) > len(rows) // 64
    got = defaultdict(list)
    for r in fingerprint_documents(docs(rows)).collect():
        got[r.doc_id].append(r.edited_sha256)
    hashes = {r.text: r.h for r in docs(rows).select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    want = defaultdict(list)
    for k, (i, t) in enumerate(order):
        m = len(t) // 3
        want[i].append(hashlib.sha256((t[:len(t) - m] + order[(k + 1) % len(order)][1][:m]).encode()).hexdigest())
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}


def test_sketch_estimates(docs):
    rng = random.Random(4)
    base = prose(rng, 600)
    rows = [(1, " ".join(base)), (2, " ".join(base[:450] + prose(rng, 150))), (3, " ".join(base[:300]))]
    df = add_sketch(docs(rows), "text", "s")
    s = {r.doc_id: r for r in df.collect()}
    both = df.where("doc_id = 1").select(F.col("s").alias("a")).join(df.where("doc_id <> 1").select("doc_id", F.col("s").alias("b"), "text"))
    for r in both.select("doc_id", "text", resemblance(F.col("a"), F.col("b")).alias("r"), containment(F.col("b"), F.col("a")).alias("c"),
                         F.size(merged(F.col("a"), F.col("b"))).alias("n")).collect():
        x, y = shingle_set(rows[0][1]), shingle_set(r.text)
        assert abs(r.r - len(x & y) / len(x | y)) < 0.15 and abs(r.c - len(x & y) / len(y)) < 0.15 and r.n == 128
    count = df.select("doc_id", distinct_shingles(F.col("s")).alias("n")).collect()
    assert all(abs(r.n / len(shingle_set(dict(rows)[r.doc_id])) - 1) < 0.3 for r in count)
    whole = merge_parts(df.select(F.lit(1).alias("k"), "s"), ["k"], "s").first().s
    assert whole == sorted({v for r in s.values() for v in r.s})[:128]


def edits_within(pattern, text):
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        cur = [i]
        for j, e in enumerate(text, 1):
            cur.append(min(prev[j - 1] + (c != e), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


def test_leaks_equal_full_alignment(docs):
    rng = random.Random(5)
    items = [(k, " ".join(prose(rng, rng.randint(12, 40)))) for k in range(12)]
    rows = []
    for i in range(60):
        k = rng.randrange(12)
        s = list(items[k][1])
        for _ in range(rng.randint(0, len(s) // 14)):
            at = rng.randrange(len(s))
            how = rng.choice("sid")
            if how == "d":
                del s[at]
            else:
                s[at:at + (how == "s")] = rng.choice("abcdefgh")
        rows.append((i, " ".join([*prose(rng, rng.randint(0, 60)), "".join(s).upper(), *prose(rng, rng.randint(0, 60))])))
    bench = docs(items).withColumnRenamed("doc_id", "item_id")
    for size in (1_000_000, 300):  # one block of items, and several
        got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_leaks(docs(rows), bench, block_chars=size).collect()}
        want = {}
        for i, t in rows:
            for k, item in items:
                m = len(item)
                e = min(int(m * decontaminate.EDIT_RATE), (m - 12) // 12)
                d = edits_within(item, " ".join(t.lower().split()))
                if d <= e:
                    want[i, k] = d
        assert got == want
    assert 20 < len(want) < 60


def test_leaks_odd_rows(docs):
    item = "the quick brown fox jumps over the lazy dog again and again"
    bench = docs([(1, item), (2, None), (3, "tiny"), (4, ""), (1, item)]).withColumnRenamed("doc_id", "item_id")
    rows = [(1, None), (2, ""), (3, item), (None, f"x {item.upper()}!"), (5, "tiny"), (6, "word " * 50_000 + item), (3, item)]
    got = sorted(((r.doc_id, r.item_id, r.edits) for r in decontaminate.find_leaks(docs(rows, ["item_id", "edits"]), bench).collect()), key=str)
    assert got == sorted([(3, 1, 0), (None, 1, 0), (6, 1, 0)], key=str)
    kept = decontaminate.remove_leaks(docs(rows, ["_x"]), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 5]
    assert decontaminate.find_leaks(docs([]), bench).count() == 0
    assert decontaminate.find_leaks(docs(rows), bench.limit(0)).count() == 0


def test_leaks_go_row_by_row(docs):
    item = "the quick brown fox jumps over the lazy dog again and again"
    bench = docs([(1, item)]).withColumnRenamed("doc_id", "item_id")
    rows = [(None, f"x {item}"), (None, "clean text"), (None, None), (4, item), (4, "other clean text"), (4, None), (5, item), (6, "clean text")]
    kept = decontaminate.remove_leaks(docs(rows, ["_x"]), bench)
    assert kept.columns == ["doc_id", "text", "_x"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(None, "clean text"), (None, None), (4, "other clean text"), (4, None), (6, "clean text")], key=str)
