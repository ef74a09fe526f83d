"""Conversation repair against an exhaustive search, exact dedup against plain groups."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wheeltrace.llm import conversations as C
from wheeltrace.llm import exact_dedup as X

GOOD = re.compile(r"(s?(ua)+)?")


def every_repair(kinds, most_inserts=2):
    """Best (cost, audit) by trying all edits of every turn with inserts before, between and behind them."""
    best = None
    gaps = [x for k in range(most_inserts + 1) for x in product("ua", repeat=k)]
    options = []
    for k in kinds:
        own = [("D", 2, "")]
        if k != "#":
            more = 5 if k.isupper() else 0
            own += [("K", more, k.lower()), ("R", 1 + more, "u"), ("R", 1 + more, "a")]
        options.append(own)
    for between in product(gaps, repeat=len(kinds) + 1):
        if sum(map(len, between)) > 3:
            continue
        for chosen in product(*options):
            roles, audit, cost = "", "", 0
            for i, g in enumerate(between):
                roles, audit, cost = roles + "".join(g), audit + "I" * len(g), cost + 5 * len(g)
                if i < len(chosen):
                    e, c, r = chosen[i]
                    roles, audit, cost = roles + r, audit + e, cost + c
            if GOOD.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def test_search_equals_all_repairs():
    rng = random.Random(4)
    for kinds in ["", *"suaxSUAX#", *("".join(rng.choice("ssuuuaaaxSUA#") for _ in range(rng.choice([2, 3, 3, 4]))) for _ in range(60))]:
        assert C.search.__wrapped__(kinds)[:2] == every_repair(kinds), kinds


def by_table(kinds):
    """Best (cost, audit) of each state turn by turn."""
    best = {0: (0, "")}

    def insert(b):
        for _ in range(2):
            for s, (c, a) in list(b.items()):
                t = C.AFTER[C.NEXT_ROLE[s]]
                b[t] = min(b.get(t, (1 << 40, "")), (c + 5, a + "I"))
        return b

    for k in kinds:
        nxt = {}
        for s, (c, a) in insert(best).items():
            for e, d, t in C._steps(k, s):
                nxt[t] = min(nxt.get(t, (1 << 40, "")), (c + d, a + e))
        best = nxt
    best = insert(best)
    return min(best[s] for s in (0, 3) if s in best)


def test_search_of_long_conversations():
    rng = random.Random(5)
    for n in (30, 200, 512):
        for _ in range(6):
            kinds = "".join(rng.choice("suuuaaaxSUUAA##") for _ in range(n))
            assert C.search.__wrapped__(kinds)[:2] == by_table(kinds)
    began = time.time()
    for kinds in ("U" * 512, "u" * 512, "x" * 512, "#" * 512, "s" * 512, "uA" * 256):
        assert C.search.__wrapped__(kinds)[:2] == by_table(kinds)
    assert time.time() - began < 20


def test_blocks_give_the_same(monkeypatch):
    rng = random.Random(6)
    for _ in range(40):
        turns = [(i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "no", " ", f"Word {i}.", f"cut {i}"])) for i in range(rng.randint(1, 40))]
        got = []
        for size in (512, 7, 1):
            monkeypatch.setattr(C, "BLOCK_TURNS", size)
            c = C._Conversation()
            for t in turns:
                c.add(*t)
            got.append(c.report())
        assert got[0] == got[1] == got[2]
        lines = C._lines(got[0][6], C.START, [t[1:] for t in turns])
        assert got[0][7] == hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in lines).encode()).hexdigest()


SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                       T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("edit", T.StringType())])


def test_conversations_odd_rows(spark):
    rows = [
        (1, 0, "user", "Hi.", "x"), (1, 1, "assistant", "Hello!", "x"),
        (2, None, "user", "Who?", "x"), (2, 5, "user", "Who?", "x"), (2, 9, "assistant", "Me", "x"),
        (3, 0, None, "Text.", "x"), (None, 0, "user", "Hi.", "x"), (None, 3, "assistant", "\t\n ", "x"),
        (4, 0, "user", None, "x"), (5, 1, "user", "Same.", "x"), (5, 1, "user", "Same.", "x"), (5, 1, "assistant", "An.", "x"),
        (6, 0, "user", "w " * 200_000 + ".", "x"), (7, None, "system", "A.", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: r for r in C.repair_conversations(df).collect()}
    assert len(got) == 8

    def sha(*lines):
        return hashlib.sha256("\n".join(lines).encode()).hexdigest()

    def brief(i):
        r = got[i]
        return r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256

    assert brief(1) == (0, 0, 0, 0, 0, 0, "KK", sha("user:Hi.", "assistant:Hello!"))
    assert brief(2) == (3, 0, 1, 1, 1, 6, "DDD", sha(""))
    assert brief(3) == (0, 0, 0, 0, 0, 2, "D", sha(""))
    assert brief(None) == (2, 1, 0, 0, 0, 4, "DD", sha(""))
    assert brief(4) == (0, 0, 0, 0, 0, 0, "", sha(""))
    assert brief(5) == (0, 0, 1, 0, 1, 4, "RRD", sha("user:An.", "assistant:Same."))
    assert brief(6)[5:7] == (2, "D") and brief(7)[5:7] == (2, "D")
    turns = C.repaired_turns(df).where("conv_id = 1").orderBy("place").collect()
    assert [(t.place, t.edit, t.turn, t.role, t.text) for t in turns] == [(0, "K", 0, "user", "Hi."), (1, "K", 1, "assistant", "Hello!")]
    empty = spark.createDataFrame([], SCHEMA)
    assert C.repair_conversations(empty).count() == C.repaired_turns(empty).count() == 0


def test_inserted_turns_are_written(spark):
    rows = [(1, 0, "user", "A.", "x"), (1, 1, "assistant", "B.", "x"), (1, 2, "user", "C.", "x"), (1, 4, "user", "D.", "x"), (1, 5, "assistant", "E.", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    r = C.repair_conversations(df).first()
    assert (r.cost, r.audit, r.gaps, r.illegal) == (2, "KKDKK", 1, 1)
    turns = C.repaired_turns(df).orderBy("place").collect()
    digest = hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in turns).encode()).hexdigest()
    assert digest == r.repaired_sha256 and [t.turn for t in turns] == [0, 1, 4, 5]


def test_faults_follow_the_hash(spark):
    rows = [(c, t, "assistant", "One. Two!", "x") for c in range(40) for t in range(5)] + [(None, 1, "a", "b", "x"), (7, None, None, None, "x")]
    got = defaultdict(list)
    for r in C.damaged(spark.createDataFrame(rows, SCHEMA)).collect():
        got[r.conv_id, r.turn].append((r.role, r.text))
    for c, t, role, text, _ in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        role, text = role or " ", text or " "
        fault = zlib.crc32(key.encode()) % 20
        want = {0: [(role, None)], 1: [(role, "")], 2: [(role, re.sub("[.!?]", "", text))], 3: [(role, text)] * 2, 4: [("user", text)]}
        assert got[c, t] == want.get(fault, [(role, text)])


def test_perfect_hash_is_minimal_and_exact():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 100, 5000):
        d = rng.integers(0, 256, (n, 32), np.uint8)
        raw, slot = X.perfect_hash(d)
        assert sorted(slot.tolist()) == list(range(n))
        slots = np.empty_like(d)
        slots[slot] = d
        assert (X.look_up(raw, slots, d) == slot).all()
        other = rng.integers(0, 256, (2000, 32), np.uint8)
        assert (X.look_up(raw, slots, other) == -1).all()
        near = d.copy()
        near[:, 31] ^= 1  # differs in one bit that no hash reads
        assert (X.look_up(raw, slots, near) == -1).all()


def test_digests_that_no_level_places(monkeypatch):
    d = np.zeros((40, 32), np.uint8)
    d[:, 0] = np.arange(40)  # all hash alike
    raw, slot = X.perfect_hash(d)
    slots = np.empty_like(d)
    slots[slot] = d
    assert sorted(slot.tolist()) == list(range(40)) and (X.look_up(raw, slots, d) == slot).all()


@pytest.mark.parametrize("history", ["true", "false", "doc_id % 3 = 0", "doc_id < 20"])
def test_exact_duplicates_equal_plain_groups(docs, history):
    rng = random.Random(3)
    texts = [None, "", "A b", "a B", "ÄB", "äB", "äb", "x" * 70_000, "X" * 70_000, "tab\t", "tab"]
    rows = [(i, rng.choice(texts)) for i in range(60)] + [(None, "alone"), (None, "A b"), (5, "twice"), (5, "twice")]
    got = X.exact_duplicates(docs(rows, ["tag", "old", "keep_id"]), F.expr(history), shard_digests=3).collect()
    groups = defaultdict(list)
    low = str.maketrans(X._UPPER, X._UPPER.lower())
    for i, t in rows:
        groups[(t or "").translate(low)].append(i)
    sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    assert len(got) == len(rows)
    assert sorted((r.doc_id for r in got), key=str) == sorted((i for i, _ in rows), key=str)
    for r in got:
        ids = sha[r.text_sha256]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)
    kept = X.keep_last(docs(rows, ["row"]), F.expr(history))
    assert kept.columns == ["doc_id", "text", "row"] and kept.count() == len(groups)


def test_exact_duplicates_of_nothing(docs):
    assert X.exact_duplicates(docs([]), F.lit(True)).count() == 0
