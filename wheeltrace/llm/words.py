"""Vectorised word splitting of many texts at once (numpy, inside tasks).

``Splitter`` reproduces the normaliser and pre-tokeniser of a lower-casing word BPE: NFC, lower case,
white space dropped, then letters | one digit | other signs, with the English contractions
``'s 't 're 've 'm 'll 'd`` as words of their own. ``WordTable`` is a bounded open-addressing cache
from 64-bit word hashes to integers.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import regex

SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
_TABLES: tuple[np.ndarray, np.ndarray] | None = None
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-case form of every code point, built once per process."""
    global _TABLES
    if _TABLES is None:
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        codes = np.frombuffer(every.encode("utf-32-le"), np.uint32)
        kind = np.full(0x110000, OTHER, np.uint8)
        for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT), (r"\s+", SPACE)):
            for m in regex.finditer(pattern, every):
                kind[codes[m.start()]:codes[m.end() - 1] + 1] = value
        lower = np.arange(0x110000, dtype=np.uint32)
        for c in every:
            low = c.lower()
            if low != c and len(low) == 1:
                lower[ord(c)] = ord(low)
        kind[0xD800:0xE000] = OTHER
        _TABLES = kind, lower
    return _TABLES


def plain(text: str) -> str:
    """NFC, and the one letter whose lower case has two code points written out."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "İ" in text:
            text = text.replace("İ", "i̇")
    return text


def split(texts: list[str]):
    """Words of all texts: (lower-case codes, start, end, text index) of each word."""
    kind, lower = tables()
    # a blank before each text keeps words of neighbouring texts apart
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    codes = np.frombuffer(("\n" + "\n".join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32) if texts else np.zeros(0, np.uint32)
    codes = lower[codes]
    k = kind[codes]
    begin = np.empty(len(k), bool)
    begin[:1] = True
    begin[1:] = (k[1:] != k[:-1]) | (k[1:] == DIGIT)
    quote = np.flatnonzero(codes == 39)
    if len(quote):
        quote = quote[(quote > 0) & (quote + 1 < len(codes))]
        quote = quote[k[quote - 1] != OTHER]
        nxt = codes[quote + 1]
        after = codes[np.minimum(quote + 2, len(codes) - 1)]
        one = np.isin(nxt, [ord(c) for c in "stmd"])
        two = ((nxt == ord("r")) | (nxt == ord("v"))) & (after == ord("e")) | (nxt == ord("l")) & (after == ord("l"))
        two &= quote + 2 < len(codes)
        size = np.where(one, 2, np.where(two, 3, 0))
        quote, size = quote[size > 0], size[size > 0]
        begin[quote] = True
        begin[quote + 1] = False
        long = quote[size == 3]
        begin[long + 2] = False
        end = quote + size
        end = end[end < len(codes)]
        begin[end] = True
    at = np.flatnonzero(begin)
    stop = np.append(at[1:], len(codes))
    word = k[at] != SPACE
    at, stop = at[word], stop[word]
    first = np.cumsum(lengths) - lengths
    return codes, at, stop, np.searchsorted(first, at, side="right") - 1


def hashes(codes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each word; words are given in order and do not overlap."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = stop - start
    power = np.cumprod(np.full(int(size.max()) + 1, _BASE, np.uint64), dtype=np.uint64)
    # positions of the codes inside their words
    total = int(size.sum())
    begin = np.cumsum(size) - size
    inside = np.arange(total, dtype=np.int64) - np.repeat(begin, size)
    taken = codes if total == len(codes) else codes[inside + np.repeat(start, size)]
    h = np.add.reduceat((taken.astype(np.uint64) + np.uint64(1)) * power[inside], begin)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h[h == 0] = 1
    return h


class WordTable:
    """Cache from word hash to a non-negative integer; emptied when ``limit`` words are stored."""

    def __init__(self, limit: int = 1 << 20):
        self.bits = max(10, (2 * limit - 1).bit_length())
        self.limit = limit
        self.clear()

    def clear(self):
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.zeros(1 << self.bits, np.int32)
        self.size = 0

    def larger(self) -> WordTable:
        """A table of twice the size with the same entries."""
        out = WordTable(2 * self.limit)
        used = np.flatnonzero(self.keys)
        out.put(self.keys[used], self.values[used])
        return out

    def get(self, h: np.ndarray) -> np.ndarray:
        """Value of each hash, -1 where it is not stored."""
        mask = np.uint64((1 << self.bits) - 1)
        slot = (h & mask).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == h, self.values[slot], -1)
        open_ = np.flatnonzero((key != h) & (key != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(mask)
            key = self.keys[slot[open_]]
            hit = key == h[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
        return out

    def put(self, h: np.ndarray, values: np.ndarray) -> None:
        """Store new, distinct hashes; the caller clears a table that would grow over ``limit``."""
        mask = (1 << self.bits) - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = self.keys[slot[left]] == 0
            who, place = left[free], slot[left[free]]
            self.keys[place] = h[who]
            self.values[place] = values[who]
            left = left[self.keys[slot[left]] != h[left]]
            slot[left] = (slot[left] + 1) & mask
        self.size += len(h)


def ngram_buckets(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of all letter words: pairs and triples of letters with word borders, and whole words.

    Returns buckets and the text index of each, in three blocks; a text without letters has none.
    """
    kind, _ = tables()
    codes, start, stop, owner = split(texts)
    letters = kind[codes[start]] == LETTER if len(start) else np.zeros(0, bool)
    start, stop, owner = start[letters], stop[letters], owner[letters]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = stop - start
    begin = np.cumsum(size + 1) - size  # one border before each word, one at the end
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    stream = np.zeros(int(size.sum()) + len(size) + 1, np.uint32)
    stream[inside + np.repeat(begin, size)] = codes[inside + np.repeat(start, size)]
    who = np.append(np.repeat(owner, size + 1), owner[-1])
    two = stream[:-1] * np.uint32(0x85EBCA6B) + stream[1:] * np.uint32(0xC2B2AE35) + np.uint32(1)
    three = two[:-1] * np.uint32(0x27D4EB2F) + stream[2:] * np.uint32(0x165667B1)
    inner = stream[1:-1] != 0
    shift = np.uint32(32 - bits)

    def bucket(h, salt):
        h = h ^ np.uint32(salt)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        h = (h ^ (h >> np.uint32(12))) * np.uint32(0x297A2D39)
        return (h >> shift).astype(np.int64)

    whole = hashes(codes, start, stop)
    whole = (whole >> np.uint64(32)).astype(np.uint32)
    return (np.concatenate([bucket(two, 0x51ED270B), bucket(three[inner], 0x2545F491), bucket(whole, 0x9E3779B9)]),
            np.concatenate([who[:-1], who[1:-1][inner], owner]))
