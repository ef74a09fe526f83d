"""Token counts and packing against the tokenizer library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer as Library

from tests.conftest import SF
from wheeltrace.llm.bpe import Tokenizer
from wheeltrace.llm.common import tokenizer_path
from wheeltrace.llm.common import table
from wheeltrace.llm.packing import best_fit, fitted_plan, pack_documents, plan_patterns, token_pieces
from wheeltrace.llm.token_counts import count_tokens, prefix_scan, state_maps, text_counts

ODD = [
    "", " ", "it's don't we're 'sun ''s !'s I'll they've'd 's's 'm", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "<|endoftext|>",
    "İstanbul ΣΑΣ Straße é é", "123 ½ ²③ ٣", "日本語のテキスト 中文", "😀😀👍🏽 a😀b", "a" * 500, "the" * 300, "́abc",
    "%%%%!!!'''", "x‍y ﻿ z\x00w", "ﬁ ① ﷺ Ⅷ ẞ"]


@pytest.fixture(scope="module")
def library():
    return Library.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(0)
    letters = "aàbcdeéinorstu' !.,'\n\t1İß<|>日😀Σσs"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(600)] + [
        "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 60))) for _ in range(800)]


def test_ids_equal_the_library(library, texts):
    tok = Tokenizer(tokenizer_path())
    ids, n = tok.token_ids(texts)
    at = np.cumsum(n) - n
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert e.ids == ids[at[i]:at[i] + n[i]].tolist(), texts[i]


def test_small_caches_are_emptied_not_wrong(library, texts):
    tok = Tokenizer(tokenizer_path(), cache_words=64)
    tok.transducer.max_states = 500
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert tok.token_counts(texts).tolist() == want
    assert tok.token_ids(texts)[1].tolist() == want


@pytest.mark.parametrize("chunk", [1, 7, 64])
def test_chunks_compose(library, texts, chunk):
    tok = Tokenizer.load(tokenizer_path())
    some = texts[:120]
    want = [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]
    assert text_counts(some, tok, chunk) == want


def test_scan_gives_every_prefix(library):
    tok = Tokenizer.load(tokenizer_path())
    count = lambda parts: tok.token_counts(parts).tolist() if parts else []
    text = "one two threefour  five-six seven" * 3
    chunks = [text[a:a + 5] for a in range(0, len(text), 5)]
    for k, m in enumerate(prefix_scan(state_maps(chunks, count), count)):
        whole = m.count + sum(count([m.head, m.tail]) if m.resets else count([m.head]))
        assert whole == len(library.encode("".join(chunks[:k + 1]), add_special_tokens=False).ids)


def test_count_tokens_rows(docs, library):
    rows = [(1, None), (1, "a b"), (None, "é x"), (2, ""), (2, ""), (3, "word " * 40_000)]
    got = count_tokens(docs(rows, ["n_tokens", "id"])).collect()
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert count_tokens(docs([])).count() == 0


def _check_packing(rows, library, got):
    want = Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for p, a in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[a:a + 4096], "<u4")
            want[i, p, a, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    return len(places)


def test_pack_odd_rows(docs, library):
    rows = [(1, None), (1, "a b"), (None, "é x"), (2, ""), (2, ""), (3, "word and " * 9000), (4, "x " * 4095), (5, "x " * 4096), (6, "<|endoftext|>b")]
    got = pack_documents(docs(rows, ["rank", "length"])).collect()
    assert _check_packing(rows, library, got) <= 8
    assert pack_documents(docs([])).count() == 0


def test_pack_table(spark, library):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    got = pack_documents(table).collect()
    n = _check_packing(rows, library, got)
    assert n <= -(-sum(r.length for r in got) // 4096) * 1.02 + 1


def test_plan_uses_the_histogram_up():
    rng = random.Random(4)
    hist = Counter(min(4096, int(rng.lognormvariate(6.3, 1))) or 1 for _ in range(3000))
    hist = {k: v * 50 for k, v in hist.items()}
    plan, used = plan_patterns(hist), Counter()
    for p, n in plan:
        assert sum(p) <= 4096 and n > 0
        for x in p:
            used[x] += n
    assert used == Counter(hist)
    assert sum(n for _, n in plan) <= 1.005 * sum(k * v for k, v in hist.items()) / 4096 + 1
    assert sum(n for _, n in best_fit({4000: 3, 96: 2, 90: 5}, 4096)) == 3 + 1


def test_fitted_patterns_place_most_pieces(spark):
    """Also where lengths hardly repeat; and no more sequences than the tokens need."""
    pieces = token_pieces(table(spark, "/root/testdata/sf0.01", "documents"))
    hist = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    short = sum(n for x, n in hist.items() if x < 4096)
    left = {x: n for x, n in hist.items() if x < 4096}
    placed = sum(len(p) * n for p, n in fitted_plan(left))
    assert placed >= short / 2 and placed + sum(left.values()) == short
    assert sum(n for _, n in plan_patterns(hist)) == -(-sum(x * n for x, n in hist.items()) // 4096)
