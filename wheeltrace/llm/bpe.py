"""Byte-pair word tokenisation compiled into a deterministic transducer.

The word is read symbol by symbol (a byte, or a byte that ends the word). After each prefix the
transducer knows the last token of that prefix's tokenisation: of all vocabulary entries that end
here exactly one may follow the last token at the place where it starts. A state therefore holds
the longest suffix that can still grow into a token, and, for each of its suffixes of that kind, the
last token and the relative token count at the place where it starts. Transitions carry the number
of tokens emitted (it may be 0 or negative where a prefix splits more finely), so the sum along a
word is its token count. States are compiled when first reached; a word end leads back to the start.
"""

from __future__ import annotations

import json
from array import array
from collections import deque
from struct import pack

import numpy as np

from wheeltrace.llm.words import WordTable, hashes, plain, split

START = -1
ZERO = 1 << 15
INF = 1 << 60
_LOADED: dict[str, Tokenizer] = {}


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(c): b for b, c in [*zip(kept, kept), *zip(rest, range(256, 256 + len(rest)))]}


class Transducer:
    """Lazily compiled automaton over the symbols 0..255 (inside a word) and 256..511 (word end)."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = "</w>", max_states: int = 150_000):
        letters = byte_letters()

        def symbols(token: str) -> tuple[int, ...]:
            ends = token.endswith(suffix) and token != suffix
            out = [letters[c] for c in (token[:-len(suffix)] if ends else token)]
            if ends:
                out[-1] += 256
            return tuple(out)

        self.rank: dict[int, int] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.made: dict[int, int] = {}
        spelled = {}
        for token, i in vocab.items():
            body = token[:-len(suffix)] if token.endswith(suffix) and token != suffix else token
            if len(body) == 1 and body in letters:
                spelled[i] = symbols(token)
        for r, pair in enumerate(merges):
            a, b = pair if isinstance(pair, (list, tuple)) else pair.split(" ")
            i, x, y = vocab[a + b], vocab[a], vocab[b]
            self.rank[x << 20 | y] = r
            self.left[i], self.right[i], self.made[i] = x, y, r
            spelled[i] = symbols(a + b)
        self._trie(spelled)
        self.lengths = np.zeros(max(spelled) + 1, np.int64)
        self.lengths[list(spelled)] = [len(w) for w in spelled.values()]
        self._spines: dict[tuple[int, bool], list[int]] = {}
        self.max_states = max_states
        self._reset()

    def _trie(self, spelled):
        self.next, self.token, depth = [{}], [START], [0]
        for i, word in spelled.items():
            v = 0
            for s in word:
                w = self.next[v].get(s)
                if w is None:
                    w = self.next[v][s] = len(self.next)
                    self.next.append({})
                    self.token.append(START)
                    depth.append(depth[v] + 1)
                v = w
            self.token[v] = i
        self.depth, self.fail = depth, [0] * len(depth)
        queue = deque(self.next[0].values())
        while queue:
            v = queue.popleft()
            for s, w in self.next[v].items():
                f = self.fail[v]
                while f and s not in self.next[f]:
                    f = self.fail[f]
                self.fail[w] = self.next[f].get(s, 0)
                queue.append(w)

    def _spine(self, token: int, right: bool) -> list[int]:
        """The parts at the token's right (or left) edge, smallest first."""
        got = self._spines.get((token, right))
        if got is None:
            side, got = (self.right if right else self.left), [token]
            while got[-1] in side:
                got.append(side[got[-1]])
            got.reverse()
            self._spines[token, right] = got
        return got

    def fits(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border when ``a`` is followed by ``b``.

        Parts at the border appear in the order of their merges. A crossing merge happens if it comes
        before both the merge that takes the left part away (equal ones go left to right) and the one
        that takes the right part away.
        """
        key = a << 20 | b
        got = self._fits.get(key)
        if got is None:
            xs, ys, i, j, got = self._spine(a, True), self._spine(b, False), 0, 0, True
            while True:
                nx = self.made[xs[i + 1]] if i + 1 < len(xs) else INF
                ny = self.made[ys[j + 1]] if j + 1 < len(ys) else INF
                r = self.rank.get(xs[i] << 20 | ys[j], INF)
                if r < nx and r <= ny and r < INF:
                    got = False
                    break
                if nx == INF and ny == INF:
                    break
                if nx <= ny:
                    i += 1
                else:
                    j += 1
            self._fits[key] = got
        return got

    def _reset(self):
        self._ways: dict[tuple[int, int], tuple] = {}
        self._fits: dict[int, bool] = {}
        self._states: list[bytes] = []
        self._known: dict[bytes, int] = {}
        self._moves = WordTable(1 << 16)
        self._next = np.zeros(1 << 16, np.int32)
        self._last = np.zeros(1 << 16, np.int32)
        self._step = np.zeros(1 << 16, np.int32)
        self._state(pack("<2q", 0, (START + 1) << 16 | ZERO))

    def _state(self, state: bytes) -> int:
        """Number of a state: its node, and (last token + 1, relative count) of each place, packed."""
        i = self._known.get(state)
        if i is None:
            i = self._known[state] = len(self._states)
            self._states.append(state)
        return i

    def _way(self, v: int, s: int) -> tuple[int, list, list]:
        """Where a node goes with a symbol, the tokens that end there, and what of the state lives on.

        Places are given by their index in the state of the old node, whose suffixes come longest first.
        """
        got = self._ways.get((v, s))
        if got is None:
            index, u = {}, v
            while True:
                index[self.depth[u]] = len(index)
                if not u:
                    break
                u = self.fail[u]
            w = v
            while w and s not in self.next[w]:
                w = self.fail[w]
            w = u = self.next[w][s]
            tokens, kept = [], []
            while u:
                place = index[self.depth[u] - 1]
                if self.token[u] != START:
                    tokens.append((self.token[u], place))
                kept.append(place)
                u = self.fail[u]
            got = self._ways[v, s] = w, tokens, kept
        return got

    def _compile(self, state: int, s: int) -> tuple[int, int, int]:
        """The transition of a state for a symbol: next state, last token, tokens emitted."""
        values = memoryview(self._states[state]).cast("q")
        w, tokens, kept = self._way(values[0], s)
        for token, place in tokens:
            before = (values[place + 1] >> 16) - 1
            if before == START or self.fits(before, token):
                break
        else:
            raise ValueError("the merges do not form a proper dictionary")
        step = (values[place + 1] & 0xFFFF) - ZERO + 1
        if s >= 256:
            return 0, token, step
        # counts are relative to the newest place; they differ by less than the longest token
        live = array("q", (w, *(values[k + 1] - step for k in kept), (token + 1) << 16 | ZERO))
        return self._state(live.tobytes()), token, step

    def _move(self, key: np.ndarray) -> np.ndarray:
        """Index of the transition of each (state, symbol); missing ones are compiled."""
        mixed = (key.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        got = self._moves.get(mixed)
        new = np.flatnonzero(got < 0)
        if len(new):
            fresh, where, back = np.unique(mixed[new], return_index=True, return_inverse=True)
            made = [self._compile(k >> 9, k & 511) for k in key[new[where]].tolist()]
            n = self._moves.size
            while n + len(fresh) > self._moves.limit:
                self._moves = self._moves.larger()
                self._next, self._last, self._step = (np.concatenate([x, np.zeros_like(x)]) for x in (self._next, self._last, self._step))
            self._next[n:n + len(fresh)], self._last[n:n + len(fresh)], self._step[n:n + len(fresh)] = zip(*made)
            self._moves.put(fresh, np.arange(n, n + len(fresh)))
            got[new] = n + back
        return got

    def _run(self, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Run words (flat symbols, sizes) in step: their token counts, last token of every prefix, word starts."""
        if len(self._states) > self.max_states:
            self._reset()
        start = np.cumsum(size) - size
        order = np.argsort(-size, kind="stable")
        at, state = start[order], np.zeros(len(size), np.int64)
        total = np.zeros(len(size), np.int64)
        last = np.zeros(len(symbols), np.int32)
        ascending = np.sort(size)
        for k in range(int(size.max()) if len(size) else 0):
            n = len(size) - int(np.searchsorted(ascending, k, side="right"))  # words longer than k come first
            move = self._move(state[:n] << 9 | symbols[at[:n] + k])
            last[at[:n] + k] = self._last[move]
            total[:n] += self._step[move]
            state[:n] = self._next[move]
        counts = np.empty_like(total)
        counts[order] = total
        return counts, last, start

    def counts(self, symbols: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Number of tokens of each word: the sum of what its transitions emit."""
        return self._run(symbols, size)[0]

    def ids(self, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words, read back from the last tokens of their prefixes; and the counts."""
        counts, last, start = self._run(symbols, size)
        first = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.uint32)
        word, left, place = np.arange(len(size)), size.copy(), first + counts - 1
        while len(word):
            token = last[start[word] + left[word] - 1]
            out[place[word]] = token
            place[word] -= 1
            left[word] -= self.lengths[token]
            word = word[left[word] > 0]
        return out, counts


class Tokenizer:
    """Word splitting, the compiled transducer, and bounded caches over many texts."""

    def __init__(self, path: str, cache_words: int = 1 << 19):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.transducer = Transducer(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.counts = WordTable(cache_words)
        self.places = WordTable(cache_words)
        self._clear_ids()

    @staticmethod
    def load(path: str) -> Tokenizer:
        """One tokenizer per process and file."""
        if path not in _LOADED:
            _LOADED[path] = Tokenizer(path)
        return _LOADED[path]

    def _clear_ids(self):
        self.places.clear()
        self.store = np.zeros(1 << 20, np.uint32)
        self.first = np.zeros(self.places.limit + 1, np.int64)
        self.filled, self.words = 0, 0

    def _pieces(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Texts cut at special strings: parts, their texts, and (place, id) of the specials."""
        if not any("<|" in t for t in texts):
            return [plain(t) for t in texts], np.arange(len(texts)), np.zeros(0, np.int64), np.zeros(0, np.int64)
        parts, owner, special, after = [], [], [], []
        for i, t in enumerate(texts):
            while True:
                cut = min(((p, s) for s in self.special if (p := t.find(s)) >= 0), default=None)
                parts.append(plain(t if cut is None else t[:cut[0]]))
                owner.append(i)
                if cut is None:
                    break
                special.append(self.special[cut[1]])
                after.append(len(parts) - 1)
                t = t[cut[0] + len(cut[1]):]
        return parts, np.array(owner), np.array(after, np.int64), np.array(special, np.int64)

    @staticmethod
    def _symbols(codes, start, stop) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the words, the last of each marked as a word end, and their sizes."""
        size = stop - start
        begin = np.cumsum(size) - size
        taken = codes[np.arange(int(size.sum())) + np.repeat(start - begin, size)]
        raw = taken.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        width = 1 + (taken > 0x7F).astype(np.int64) + (taken > 0x7FF) + (taken > 0xFFFF)
        size = np.add.reduceat(width, begin)
        symbols = np.frombuffer(raw, np.uint8).astype(np.int64)
        symbols[np.cumsum(size) - 1] += 256
        return symbols, size

    def token_counts(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        parts, owner, after, _ = self._pieces(texts)
        codes, start, stop, part = split(parts)
        h = hashes(codes, start, stop)
        n = self.counts.get(h)
        new = np.flatnonzero(n < 0)
        if len(new):
            unique, where, back = np.unique(h[new], return_index=True, return_inverse=True)
            rep = new[where]
            got = self.transducer.counts(*self._symbols(codes, start[rep], stop[rep]))
            n[new] = got[back]
            if self.counts.size + len(unique) > self.counts.limit:
                self.counts.clear()
            self.counts.put(unique[:self.counts.limit], got[:self.counts.limit])
        total = np.bincount(owner[part], n, len(texts)).astype(np.int64)
        return total + np.bincount(owner[after], minlength=len(texts)).astype(np.int64)

    def token_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        parts, owner, after, special = self._pieces(texts)
        codes, start, stop, part = split(parts)
        h = hashes(codes, start, stop)
        place = self.places.get(h)
        new = np.flatnonzero(place < 0)
        if len(new):
            unique, where, back = np.unique(h[new], return_index=True, return_inverse=True)
            if self.words + len(unique) > self.places.limit:
                self._clear_ids()  # the words of this batch alone are kept
                unique, where, back = np.unique(h, return_index=True, return_inverse=True)
                new = np.arange(len(h))
                if len(unique) > self.places.limit:  # rare: halve the batch
                    half = len(texts) // 2
                    a, b = self.token_ids(texts[:half]), self.token_ids(texts[half:])
                    return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
            rep = new[where]
            flat, sizes = self.transducer.ids(*self._symbols(codes, start[rep], stop[rep]))
            while self.filled + len(flat) > len(self.store):
                self.store = np.concatenate([self.store, np.zeros_like(self.store)])
            self.store[self.filled:self.filled + len(flat)] = flat
            ends = self.filled + np.cumsum(sizes)
            self.first[self.words] = self.filled
            self.first[self.words + 1:self.words + 1 + len(rep)] = ends
            value = np.arange(self.words, self.words + len(rep))
            self.places.put(unique, value)
            place[new] = value[back]
            self.filled, self.words = int(ends[-1]), self.words + len(rep)
        begin, size = self.first[place], self.first[place + 1] - self.first[place]
        if len(special):  # a special string is one more word behind its part
            at = np.searchsorted(part, after, side="right")
            base = self.filled
            while base + len(special) > len(self.store):
                self.store = np.concatenate([self.store, np.zeros_like(self.store)])
            self.store[base:base + len(special)] = special
            begin = np.insert(begin, at, base + np.arange(len(special)))
            size = np.insert(size, at, 1)
            part = np.insert(part, at, after)
        total = int(size.sum())
        where = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(total)
        return self.store[where], np.bincount(owner[part], size, len(texts)).astype(np.int64)
