"""Main text of web pages by a recurrent block labeller (operator 5).

A page becomes a sequence of leaf blocks (text between block-level tags). Each block is described by
hashed vectors of its tag path (tags, classes, ids, roles) and of its words and a few text figures. A
bidirectional LSTM in numpy reads the whole sequence and labels every block as main text or not.

There are no labelled pages, so a teacher labels a bounded sample: blocks inside article or main
elements are main text unless a navigation, notice, comment or similar container is in between. The
training pages are varied (containers renamed, dropped and inserted) so that the network also
knows containers that the sample lacks and relies on text and context where tags say nothing.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheeltrace.llm.common import slices, table
from wheeltrace.llm.registry import query
from wheeltrace.llm.words import hashes, plain, split

SAMPLE = 300           # pages the labeller is trained on, at most
SAMPLE_CHARS = 60_000  # longer pages are not in the training sample
PATH_BUCKETS, WORD_BUCKETS = 1024, 1024
PATH_DIM, WORD_DIM, FIGURES = 16, 8, 7
HIDDEN = 16
PATH_ENDS = 16         # elements of a path that count from either end

# fixed values: element classes of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript svg iframe object title math canvas audio video".split())
TEXT_ONLY = frozenset("style title".split())  # of RAW: never hold tags
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split())
# words in tags, classes, ids and roles that tell the teacher that a container is not main text
ASIDE = frozenset(
    "nav menu header footer aside sidebar form button select option textarea fieldset dialog ad ads advert advertisement adverts banner "
    "cookie cookies consent notice alert promo newsletter subscribe signup comment comments reply replies respond discussion share sharing "
    "social related recommended breadcrumb breadcrumbs pagination pager popup modal toolbar navigation navbar sponsor sponsored widget tags "
    "copyright login search hidden complementary contentinfo".split())
MAIN = frozenset("article main".split())

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")  # possessive: never goes back
TAG_CHARS = 8192       # within so many characters a > in quotes does not end a tag; in longer ones the first > does
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    path: tuple  # of elements, each a tuple of tokens
    linked: float  # share of the characters inside links


def _element(tag: str, attributes: str) -> tuple[str, ...]:
    """Tokens of an element: its tag, and the words of its class, id and role."""
    out = [tag]
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "none" in value):
                out.append(".hidden")
            elif name in ("class", "id", "role"):
                out.extend("." + w for w in _WORD.findall(value))
    return tuple(out)


def _next_tag(page: str, at: int, last: int) -> tuple[int, int, bool, str | None, str] | None:
    """The next tag or comment from a place on: (start, end, closing, name or None, attributes).

    ``last`` is the place of the last > of the page: after a < behind it the rest is text, and a comment
    without an end runs to the end. No character is read again and again, whatever is left open.
    """
    at = page.find("<", at)
    while at >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            return at, len(page) if end < 0 else end + 3, False, None, ""
        if at > last:
            return None
        if page[at + 1] in "!?":
            return at, page.find(">", at) + 1, False, None, ""
        m = _NAME.match(page, at + 1)
        if m:
            end = _QUOTED.match(page, m.end(), m.end() + TAG_CHARS).end()
            if not page.startswith(">", end):
                end = page.find(">", m.end())
            return at, end + 1, bool(m[1]), m[2].lower(), page[m.end():end]
        at = page.find("<", at + 1)
    return None


def _raw_end(page: str, tag: str, at: int) -> int | None:
    """The place behind the end tag of a dropped element."""
    m = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
    end = page.find(">", m.end()) if m else -1
    return end + 1 if end >= 0 else None


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page, in page order; empty ones are left out.

    A head is no container, as its end tag may be left out: only the title, styles and scripts in it are dropped. A dropped
    element without an end tag ends at once (style and title at the next tag), but a script runs to the end of the page.
    The time is linear in the page, however malformed it is.
    """
    out: list[Block] = []
    stack: list[tuple[str, ...]] = []
    parts: list[str] = []
    links = [0, 0]  # depth of links, characters inside them
    at, n, last = 0, len(page), page.rfind(">")
    opened: Counter = Counter()  # tags on the stack
    open_ended: set[str] = set()  # tags without an end tag from here on

    def add(text: str):
        if text:
            parts.append(text)
            if links[0]:
                links[1] += len(text)

    def close():
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = entities.unescape(text)
            size = len(text)
            text = " ".join(text.split())
            if text:
                path = stack if len(stack) <= 2 * PATH_ENDS else [*stack[:PATH_ENDS], *stack[-PATH_ENDS:]]
                out.append(Block(text, tuple(path), min(1.0, links[1] / max(1, size))))
            parts.clear()
        links[1] = 0

    while at < n:
        found = _next_tag(page, at, last)
        if found is None:
            add(page[at:])
            break
        start, end, closing, tag, attributes = found
        add(page[at:start])
        at = end
        if tag is None:
            continue
        if closing:
            if tag == "a" and links[0]:
                links[0] -= 1
            if tag in INLINE:
                continue
            close()
            while opened[tag]:  # what it closes with it
                inner = stack.pop()[0]
                opened[inner] -= 1
                if inner == tag:
                    break
            continue
        if tag in RAW:
            close()
            if not attributes.endswith("/"):
                end = None if tag in open_ended else _raw_end(page, tag, at)
                if end is not None:
                    at = end
                    continue
                open_ended.add(tag)
                if tag == "script":
                    at = n
                elif tag in TEXT_ONLY:
                    following = page.find("<", at)
                    at = n if following < 0 else following
            continue
        if tag == "head":
            close()
            continue
        if tag in INLINE:
            if tag == "br":
                add(" ")
            elif tag == "a":
                links[0] += 1
            continue
        close()
        links[0] = 0
        while stack and stack[-1][0] == "p" or stack and tag in ("li", "dt", "dd", "option", "tr", "td", "th") and stack[-1][0] == tag:
            opened[stack.pop()[0]] -= 1
        if tag not in VOID and not attributes.endswith("/"):
            stack.append(_element(tag, attributes))
            opened[tag] += 1
    close()
    return out


def teacher(block: Block, has_main: bool) -> int:
    """1 main text, 0 not, -1 unknown."""
    names = {t.lstrip(".") for e in block.path for t in e}
    if names & ASIDE:
        return 0
    if has_main:
        return 1 if any(e[0] in MAIN or ".main" in e for e in block.path) else -1
    words = block.text.count(" ") + 1
    return 1 if words >= 20 and block.linked < 0.3 else -1


def _bucket(token: str, buckets: int) -> int:
    return zlib.crc32(token.encode()) % buckets


def path_buckets(path: tuple) -> list[int]:
    """Buckets of the tokens of a path; those of the innermost element also count on their own."""
    tokens = {t for e in path for t in e}
    inner = {"<" + t for t in path[-1]} if path else set()
    return [_bucket(t, PATH_BUCKETS) for t in sorted(tokens | inner)]


def features(pages: list[list[Block]]):
    """Inputs of all blocks: path buckets and words (as ragged lists), figures, and the page lengths."""
    flat = [b for p in pages for b in p]
    known: dict[tuple, list[int]] = {}
    paths = []
    for b in flat:
        if b.path not in known:
            known[b.path] = path_buckets(b.path)
        paths.append(known[b.path])
    codes, start, stop, owner = split([plain(b.text) for b in flat])
    word = (hashes(codes, start, stop) >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS
    n_words = np.bincount(owner, minlength=len(flat))
    chars = np.array([len(b.text) for b in flat], float)
    ends = np.array([b.text[-1] in ".!?:;\"" for b in flat], float)
    linked = np.array([b.linked for b in flat])
    place = np.concatenate([np.arange(len(p)) / max(1, len(p)) for p in pages]) if flat else np.zeros(0)
    first = np.concatenate([np.arange(len(p)) == 0 for p in pages]) if flat else np.zeros(0)
    figures = np.stack([np.log1p(chars) / 8, np.log1p(n_words) / 6, linked, ends, place, first, n_words < 8], 1) if flat else np.zeros((0, FIGURES))
    return paths, word, owner, figures, [len(p) for p in pages]


class Labeller:
    """Bidirectional LSTM over the blocks of a page with a logistic output for every block."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        d, h = PATH_DIM + WORD_DIM + FIGURES, HIDDEN
        init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"path": rng.normal(0, 0.3, (PATH_BUCKETS, PATH_DIM)), "word": rng.normal(0, 0.1, (WORD_BUCKETS, WORD_DIM))}
        for side in "fb":
            self.p |= {f"x{side}": init(d, 4 * h), f"h{side}": init(h, 4 * h), f"c{side}": np.repeat([0.0, 1.0, 0.0, 0.0], h)}
        self.p |= {"o": init(2 * h + d, 1)[:, 0], "ob": np.zeros(1)}

    def inputs(self, paths, word, owner, figures):
        """Vector of every block, and what its gradient needs."""
        n = len(paths)
        flat = np.array([b for p in paths for b in p], np.int64)
        who = np.repeat(np.arange(n), [len(p) for p in paths])
        vec = np.zeros((n, PATH_DIM + WORD_DIM + FIGURES))
        for k in range(PATH_DIM):
            vec[:, k] = np.bincount(who, self.p["path"][flat, k], n)
        count = np.maximum(np.bincount(owner, minlength=n), 1)
        for k in range(WORD_DIM):
            vec[:, PATH_DIM + k] = np.bincount(owner, self.p["word"][word, k], n) / count
        vec[:, PATH_DIM + WORD_DIM:] = figures
        return vec, (flat, who, count)

    def _run(self, x, mask, side):
        """One direction over padded pages (pages x time x inputs); keeps what the gradient needs."""
        n, steps, _ = x.shape
        h = c = np.zeros((n, HIDDEN))
        pre = x @ self.p[f"x{side}"] + self.p[f"c{side}"]
        kept = []
        out = np.zeros((n, steps, HIDDEN))
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = pre[:, t] + h @ self.p[f"h{side}"]
            s = 1 / (1 + np.exp(-np.clip(z[:, :3 * HIDDEN], -30, 30)))
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN:2 * HIDDEN], s[:, 2 * HIDDEN:]
            g = np.tanh(z[:, 3 * HIDDEN:])
            m = mask[:, t, None]
            new = f * c + i * g
            tc = np.tanh(new)
            kept.append((t, h, c, i, f, o, g, tc, m))
            c = np.where(m, new, 0)
            h = np.where(m, o * tc, 0)
            out[:, t] = h
        return out, kept

    def _back(self, x, kept, d_out, side, grad):
        n = len(x)
        dh, dc = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        d_pre = np.zeros((*x.shape[:2], 4 * HIDDEN))
        for t, h, c, i, f, o, g, tc, m in reversed(kept):
            dh = (dh + d_out[:, t]) * m
            dc = dc * m + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
            d_pre[:, t] = dz
            grad[f"h{side}"] += h.T @ dz
            dh = dz @ self.p[f"h{side}"].T
            dc = dc * f
        grad[f"x{side}"] += np.einsum("ntd,ntk->dk", x, d_pre)
        grad[f"c{side}"] += d_pre.sum((0, 1))
        return d_pre @ self.p[f"x{side}"].T

    @staticmethod
    def _pad(vec, sizes):
        steps = max(sizes)
        x = np.zeros((len(sizes), steps, vec.shape[1]))
        mask = np.arange(steps)[None] < np.array(sizes)[:, None]
        x[mask] = vec
        return x, mask

    def probabilities(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Probability of main text for every block; pages of like length run together."""
        out: list = [np.zeros(0)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            end, room = at, 0
            while end < len(order) and (end == at or len(pages[order[end]]) * (end + 1 - at) <= 20_000):
                end += 1
            part = [pages[i] for i in order[at:end]]
            paths, word, owner, figures, sizes = features(part)
            x, mask = self._pad(self.inputs(paths, word, owner, figures)[0], sizes)
            both = np.concatenate([self._run(x, mask, "f")[0], self._run(x, mask, "b")[0], x], 2)
            z = both @ self.p["o"] + self.p["ob"][0]
            for k, i in enumerate(order[at:end]):
                out[i] = 1 / (1 + np.exp(-np.clip(z[k, :sizes[k]], -30, 30)))
            at = end
        return out

    def step(self, pages, labels, adam, rate):
        """One gradient step; labels of -1 do not count."""
        paths, word, owner, figures, sizes = features(pages)
        vec, (flat, who, count) = self.inputs(paths, word, owner, figures)
        x, mask = self._pad(vec, sizes)
        y = np.full(mask.shape, -1)
        y[mask] = np.concatenate(labels)
        fw, kf = self._run(x, mask, "f")
        bw, kb = self._run(x, mask, "b")
        both = np.concatenate([fw, bw, x], 2)
        prob = 1 / (1 + np.exp(-np.clip(both @ self.p["o"] + self.p["ob"][0], -30, 30)))
        use = y >= 0
        dz = np.where(use, prob - y, 0) / max(1, use.sum())
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["o"] = np.einsum("ntd,nt->d", both, dz)
        grad["ob"] = np.array([dz.sum()])
        d_both = dz[:, :, None] * self.p["o"]
        dx = d_both[:, :, 2 * HIDDEN:].copy()
        dx += self._back(x, kf, d_both[:, :, :HIDDEN], "f", grad)
        dx += self._back(x, kb, d_both[:, :, HIDDEN:2 * HIDDEN], "b", grad)
        dv = dx[mask]
        for k in range(PATH_DIM):
            grad["path"][:, k] = np.bincount(flat, dv[who, k], PATH_BUCKETS)
        for k in range(WORD_DIM):
            grad["word"][:, k] = np.bincount(word, (dv[:, PATH_DIM + k] / count)[owner], WORD_BUCKETS)
        adam["t"] += 1
        for k, g in grad.items():
            a, b = adam.setdefault(k, [np.zeros_like(g), np.zeros_like(g)])
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            self.p[k] = self.p[k] - rate * (a / (1 - 0.9 ** adam["t"])) / (np.sqrt(b / (1 - 0.999 ** adam["t"])) + 1e-8)


_FRAMES = [("nav",), ("header",), ("footer",), ("aside",), ("form",), ("section",), ("ul",), ("div",)]


def _vary(page: list[Block], labels: list[int], pool: list[str], prose: list[str], rng: random.Random, most: int = 48):
    """A varied training page: containers renamed or dropped, further containers put in, long pages cut to a window."""
    if len(page) > most:
        at = rng.randrange(len(page) - most + 1)
        page, labels = page[at:at + most], labels[at:at + most]
    rename = rng.random()
    main = rng.choice([("article",), ("main",), ("div", ".content"), ("div", ".post"), ("section", ".story"), ("div", ".entry"), ("div", ".main"), ("div",)])
    aside = sorted(ASIDE - {"hidden"})
    names: dict[tuple, tuple] = {}

    def swap(e: tuple, label: int) -> tuple:
        if label == 1 and e[0] in MAIN and rename < 0.5:
            return main
        if label == 0 and {t.lstrip(".") for t in e} & ASIDE and rename > 0.3:
            if e not in names:
                names[e] = rng.choice([*[("div", "." + rng.choice(aside))] * 3, ("section", "." + rng.choice(aside)), *_FRAMES[:5]])
            return names[e]
        return e

    out = [(Block(b.text, tuple(swap(e, y) for e in b.path), b.linked), y) for b, y in zip(page, labels)]
    base = (("html",), ("body",))
    for _ in range(rng.randint(0, 3)):
        frame = rng.choice([*[("div", "." + rng.choice(aside))] * 3, ("aside",), ("form",), ("header",), ("footer",), ("section", "." + rng.choice(aside))])
        inside = rng.random() < 0.4 and any(y == 1 for _, y in out)
        where = rng.choice([i for i, (_, y) in enumerate(out) if y == 1]) + 1 if inside else rng.choice([0, len(out), rng.randrange(len(out) + 1)])
        outer = out[where - 1][0].path[:-1] if inside else base
        leaf = rng.choice([("p",), ("li",), ("div",), ("span",)])
        source = prose if prose and rng.random() < 0.5 else pool or prose
        if not source:
            break
        new = [(Block(rng.choice(source), (*outer, frame, leaf), rng.choice([0.0, 0.0, 1.0])), 0) for _ in range(rng.randint(1, 5))]
        out[where:where] = new
    return [b for b, _ in out], np.array([y for _, y in out])


def train(pages: list[str], epochs: int = 14, batch: int = 16, rate: float = 0.01, seed: int = 5) -> Labeller:
    """Fit the labeller to what the teacher says about the given pages and varied forms of them."""
    model, rng = Labeller(seed), random.Random(seed)
    known = []
    for p in pages:
        found = blocks(p)
        has_main = any(e[0] in MAIN for b in found for e in b.path)
        if found:
            known.append((found, [teacher(b, has_main) for b in found]))
    if not known:
        return model
    pool = [b.text for f, y in known for b, k in zip(f, y) if k == 0][:2000]
    prose = [b.text for f, y in known for b, k in zip(f, y) if k == 1][:2000]
    adam = {"t": 0}
    for epoch in range(epochs):
        rng.shuffle(known)
        for at in range(0, len(known), batch):
            varied = [_vary(f, y, pool, prose, rng) if rng.random() < 0.7 else (f[:48], np.array(y[:48])) for f, y in known[at:at + batch]]
            model.step([v[0] for v in varied], [v[1] for v in varied], adam, rate * (1 - 0.8 * epoch / epochs))
    return model


def train_on(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", most: int = SAMPLE) -> Labeller:
    """Labeller from a bounded sample of the pages, chosen by the hash of their id."""
    usable = pages.where(F.length(html_col).between(1, SAMPLE_CHARS)).select(F.col(html_col).alias("html"), F.xxhash64(F.col(id_col).cast("string")).alias("draw"))
    chosen = usable.select("draw").distinct().orderBy("draw").limit(most)  # hashes alone, so that no page is sorted or sent
    rows = usable.join(F.broadcast(chosen), "draw", "left_semi").select("html").limit(most).collect()  # a bounded number of bounded pages
    rows.sort()
    return train([r[0] for r in rows])


def extract(pages: DataFrame, model: Labeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, ``text`` (main blocks joined by an empty line), ``n_chars`` (code points).

    The whole page is read. Null or empty html, and pages without main text, give an empty text. Ids and urls
    may be null or repeat; other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def run(batches):
        for batch in (s for b in batches for s in slices(b, "html", 2_000_000)):
            found = [blocks(p) for p in batch.column(2).to_pylist()]
            texts = ["\n\n".join(b.text for b, p in zip(f, prob) if p >= 0.5) for f, prob in zip(found, model.probabilities(found))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long").withColumnRenamed("id", id_col)


@query("op5_html_text")
def op5_html_text(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train_on(pages))
