"""WARC archives, page text, toxicity and language: round trips, hand-made pages, held-out accuracy."""

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from wheeltrace.llm import html_text, langid, toxicity, warc
from wheeltrace.llm.common import table

WIDE = "/root/testdata/sf0.01"


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame(rows, "page_id long, url string, html string")


# --- archives -------------------------------------------------------------------------------------
def test_loser_tree_merges():
    rng = random.Random(1)
    for k in (1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randrange(40) for _ in range(rng.randrange(12))) for _ in range(k)]
        tagged = [[(x, i, j) for j, x in enumerate(r)] for i, r in enumerate(runs)]
        got = list(warc.LoserTree(tagged, lambda r: r[0]))
        assert got == sorted(r for run in tagged for r in run)
    assert list(warc.LoserTree([], lambda r: r)) == []


def test_archives_round_trip(spark, pages, tmp_path):
    long = "ä" * 700
    rows = [(1, "http://b.example.org/x", long), (2, "http://b.example.org/x", long), (3, "https://A.example.org:80/y?q=1", "short"), (4, None, "short"),
            (5, "http://c.example.org", None), (6, "http://c.example.org\r\nWARC-Type: fake", "x\r\n\r\nWARC/1.1\r\n\r\n"), (None, "http://n", long), (2, "http://b.example.org/x", long)]
    df = pages(rows).withColumn("digest", F.lit("clash"))
    folder = str(tmp_path / "w")
    warc.write_warc(df, folder, file_records=2)
    raw = [zlib.decompressobj(31).decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("*.gz"))]
    assert len(raw) >= 4
    stored = [(f["WARC-Type"], f["WARC-Record-ID"], b) for data in raw for f, b, _, _ in warc.records(data)]
    assert Counter(t for t, _, _ in stored) == {"response": 6, "revisit": 2}
    assert all(b.count(b"\xc3\xa4") == (700 if t == "response" and i == "<urn:page:2>" else 0) for t, i, b in stored)
    index = warc.merge_runs(warc.capture_runs(spark, folder)).orderBy("seq").collect()
    assert [(r.urlkey, r.ts, r.page_id or "") for r in index] == sorted((r.urlkey, r.ts, r.page_id or "") for r in index)
    seen = Counter()
    for r in index:
        seen[r.urlkey] += 1
        assert r.capture_no == seen[r.urlkey]
    by = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index), key=str)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        late = len(data) >= 1000 and i != 2
        want.append((None if i is None else str(i), len(data), hashlib.sha1(data).hexdigest(), "revisit" if late else "response", "2" if late else None))
    assert by == sorted(want, key=str)


def test_archives_of_nothing(pages):
    assert warc.archive_pages(pages([])).count() == 0


def test_url_keys():
    assert warc.url_key("http://www.B.example.org:80/Path?x=1") == "org,example,b,www)/Path?x=1"
    assert warc.url_key("plain") == "plain)/" and warc.url_key("") == ")/"


# --- page text ------------------------------------------------------------------------------------
def test_blocks_of_odd_markup():
    page = ("<!DOCTYPE html><head><title>no</title></head><body><script>var t='</p><p>no';</script><!-- <p>no</p> --><style>p{}</style>"
            "<p class=\"lead big\">one &amp; <b>two<br>three</b>&nbsp;&#233;<p>next<ul><li>a<li><a href='x>y'>b</a></ul><div hidden>h</div> tail &lt;3 <p></p>")
    got = html_text.blocks(page)
    assert [b.text for b in got] == ["one & two three é", "next", "a", "b", "h", "tail <3"]
    assert got[0].path[-1] == ("p", ".lead", ".big") and got[3].linked == 1 and got[0].linked == 0
    assert "hidden" in {t.lstrip(".") for t in got[4].path[-1]}
    assert html_text.blocks("") == [] and html_text.blocks("<p") == html_text.blocks("<p") and [b.text for b in html_text.blocks("just text")] == ["just text"]
    deep = html_text.blocks("<div>" * 5000 + "deep" + "</div>" * 5000)
    assert [b.text for b in deep] == ["deep"] and len(deep[0].path) == 2 * html_text.PATH_ENDS


def test_blocks_after_missing_end_tags():
    texts = lambda page: [b.text for b in html_text.blocks(page)]
    head = "<html><head><meta charset=utf-8><title>no</title><style>p{}</style><script>var t='<p>no';</script>"
    for page in (head + "<body><article><p>kept</p></article>", head + "<article><p>kept</p></article>", head + "</head><body><article><p>kept</p></article>"):
        assert texts(page) == ["kept"]
        assert [e[0] for e in html_text.blocks(page)[0].path] == [e for e in ("html", "body", "article", "p") if e != "body" or "<body>" in page]
    for tag in sorted(html_text.RAW - {"script"}):
        assert texts(f"<p>first</p><{tag}><article><p>kept</p></article><p>last") == ["first", "kept", "last"], tag
        assert texts(f"<p>first</p><{tag}>dropped</{tag}><p>last") == ["first", "last"], tag
    assert texts("<p>a</p><style>p{} <p>b</p><title>t <p>c") == ["a", "b", "c"] and texts("<p>a</p><style>p{}") == ["a"]
    assert texts("<p>a</p><script>'<p>no</p>'") == ["a"]


def test_malformed_pages_take_linear_time():
    m = 1_000_000
    for page in ("<b" * (m // 2), "<" + "x" * m, '<p title="x ' * (m // 12), "<p title='x " * (m // 12) + ">", '<p a="' + "x'<p>" * (m // 50), "<!-" * (m // 3),
                 "<script>" + "</script " * (m // 9), "<div>" * (m // 50) + "</x>" * (m // 8), "<noscript>" * (m // 20), "<a '><a \"><a " * (m // 12)):
        began = time.time()
        html_text.blocks(page)
        assert time.time() - began < 2, page[:20]


def test_tags_without_their_quotes():
    texts = lambda page: [b.text for b in html_text.blocks(page)]
    assert texts('<p title="a > b">one</p><p>two') == ["one", "two"]
    assert texts("<p title='never closed>one</p><p>it's two</p>") == []  # the quote ends in the next paragraph, as browsers read it
    assert texts('<p title="never closed>one</p><p>two</p>') == ["one", "two"]
    assert texts("<p>5 < 6 and 7 <8") == ["5 < 6 and 7 <8"]
    assert texts('<img src="data:' + "A" * 50_000 + '">one') == ["one"]
    assert texts("<p>one</p><p class") == ["one", "<p class"]
    assert texts("one<!-- open <p>two") == ["one"]


def test_main_text_of_written_pages(spark, pages):
    """Pages and their texts written by hand; the labeller is trained on the given table."""
    story = ["The harbour was quiet when the first boats came in, and the fishermen carried their nets ashore.",
             "Later that morning the market opened & the whole town gathered to hear what had been caught overnight.",
             "Nobody remembered a better season, and the old captain said that the next one would be better still."]
    plain = "".join(f"<p>{x.replace('&', '&amp;')}</p>" for x in story)
    made = [
        f"<html><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav><article>{plain}</article><footer><p>Copyright by the town</p></footer></body></html>",
        f"<html><head><title>No</title><body><header><h3>Site name</h3></header><main>{plain.replace('gathered', '<b>gathered</b>')}</main><aside><p>Related: more boats</p></aside>",
        f"<html><body><div class='cookie-notice'><p>We use cookies on this site.</p></div><article>{plain}<div class='comments'><p>Great story, thank you!</p></div></article><form><label>Mail</label></form></body></html>",
        f"<html><body><article><p title=\"open>{story[0]}</p>{plain.split('</p>', 1)[1]}</article><script>var a='<p>x</p>'</script></body></html>",
    ]
    want = "\n\n".join(story)
    model = html_text.train_on(table(spark, WIDE, "pages"))
    rows = [(k, f"http://e.org/{k}", page) for k, page in enumerate(made)] + [(9, "u", None), (10, "u", "<nav><a href='/'>Home</a></nav>")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(pages(rows), model).collect()}
    for k in range(len(made)):
        assert got[k] == (want, len(want)), k
    assert got[9] == ("", 0) and got[10] == ("", 0)


def test_gradient_is_right():
    """The step's gradient against differences of the loss."""
    pages = [html_text.blocks("<article><h1>t</h1><p>some words here.</p></article><footer>x y</footer>"), html_text.blocks("<nav>a</nav><p>b c d</p>")]
    labels = [np.array([1, 1, 0]), np.array([0, -1])]
    model = html_text.Labeller(2)

    def loss():
        p = np.concatenate(model.probabilities(pages))
        y = np.concatenate(labels)
        return -np.mean(np.log(np.where(y == 1, p, 1 - p))[y >= 0])

    adam = {"t": 0}
    before = {k: v.copy() for k, v in model.p.items()}
    model.step(pages, labels, adam, 0.0)  # moments hold a tenth of the gradient
    for name in ("xf", "hb", "cb", "o", "path", "word"):
        grad = adam[name][0] * 10
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        for sign in (1, -1):
            model.p = {k: v.copy() for k, v in before.items()}
            model.p[name][at] += sign * 1e-5
            up = loss() if sign == 1 else up
            down = loss()
        assert (up - down) / 2e-5 == pytest.approx(grad[at], rel=1e-3), name


def test_main_text_of_the_table(spark):
    df = table(spark, WIDE, "pages")
    model = html_text.train_on(df)
    got = {r.page_id: r for r in html_text.extract(df, model).collect()}
    for page_id, page in [(r.page_id, r.html) for r in df.collect()]:
        want = "\n\n".join(b.text for b in html_text.blocks(page) if any(e[0] == "article" for e in b.path))
        assert got[page_id].text == want and got[page_id].n_chars == len(want)
    prose = " ".join(got[max(got)].text.split()[:60])
    shell = ("<html><body><div class='top-menu'><ul><li><a href=x>One</a></li><li><a>Two</a></li></ul></div><div id=cookie-banner>We use cookies.</div>{}"
             "<aside><p>Most read this week</p></aside><form>Search <input></form><footer>imprint</footer></body></html>")
    for frame in ("<main><h1>A title</h1><p>{0}</p><p>{0}</p></main>", "<article><h1>A title</h1><p>{0}</p><p>{0}</p></article>"):
        page = html_text.blocks(shell.format(frame.format(prose)))
        assert [b.text for b, p in zip(page, model.probabilities([page])[0]) if p >= 0.5] == ["A title", prose, prose]


def test_page_rows(spark, pages):
    rows = [(1, "u", None), (1, None, ""), (None, "v", "<article><p>kept text of the page, quite long.</p></article>"), (2, "w", "<nav>menu</nav>"), (2, "w", "<nav>menu</nav>")]
    df = pages(rows).withColumn("text", F.lit("clash"))
    model = html_text.train_on(table(spark, SF, "pages"))
    got = html_text.extract(df, model).collect()
    assert Counter((r.page_id, r.url, r.text, r.n_chars) for r in got) == Counter(
        {(1, "u", "", 0): 1, (1, None, "", 0): 1, (None, "v", "kept text of the page, quite long.", 34): 1, (2, "w", "", 0): 2})
    assert html_text.extract(pages([]), html_text.train_on(pages([]))).count() == 0


# --- toxicity -------------------------------------------------------------------------------------
def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents").select("doc_id", "text", "lang"), table(spark, sf, "labels")
    model = toxicity.train_on(docs, labels)
    held = toxicity.fold("doc_id") == 0
    known = docs.join(labels.where(held).select("doc_id", "toxic"), "doc_id")
    got = toxicity.score(known, model).join(known.select("doc_id", "toxic"), "doc_id").collect()
    s, y = np.array([r.score for r in got]), np.array([r.toxic for r in got])
    rank = s.argsort().argsort() + 1
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert len(got) > 700 and auc > 0.93
    assert all(r.predicted == (r.score >= 0.5) for r in got)
    assert (s[y == 1] >= 0.5).mean() > 0.8 and (s[y == 0] < 0.5).mean() > 0.95
    assert set(model.thresholds) <= {"de", "en", "es", "fr"} and model.thresholds
    flagged = toxicity.score(known, model, lang_col="lang").join(known.select("doc_id", "toxic", "lang"), "doc_id").collect()
    for lang in sorted(model.thresholds):  # the thresholds hold on rows that set none of them
        own = [r for r in flagged if r.lang == lang]
        assert np.mean([r.flagged == (r.toxic == 1) for r in own]) > 0.85, lang
    assert all(r.flagged == (r.score >= model.thresholds.get(r.lang, 0.5)) for r in flagged)


def test_toxicity_rows(docs, spark):
    model = toxicity.train(["you vile fool " + "word " * 20, "kind words here " + "word " * 20] * 30, [1, 0] * 30, ["en"] * 60)
    got = toxicity.score(docs([(1, None), (None, ""), (3, "vile fool"), (3, "vile fool"), (4, "kind words " * 40_000)], ["score", "id"]), model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.predicted for r in got}
    assert by[3] == 1 and by[4] == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    empty = toxicity.train_on(docs([(1, "a")]).withColumn("lang", F.lit("en")), labels)
    assert [r.predicted for r in toxicity.score(docs([(1, "a")]), empty).collect()] == [0]
    assert toxicity.score(docs([]), model).count() == 0


def test_toxicity_calibrates_on_all_labelled_texts(spark, monkeypatch):
    """Every labelled text outside the held-out fold is fitted or calibrates, long ones too; each language gets a threshold."""
    say = {0: "kind words about the garden", 1: "you vile rotten fool"}
    rows = [(i, say[i % 2] + f" number {i}" * (2000 if i % 50 < 2 else 1), "xx" if i % 100 == 7 else "en", i % 2) for i in range(400)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "_calibrate", lambda m, found, run=toxicity._calibrate: seen.extend(found) or run(m, found))
    model = toxicity.train_on(docs, labels, per_label=30)
    open_rows = docs.where(toxicity.fold("doc_id") != 0).count()
    fitted = 60 - 60 // 5
    assert sum(r[3] for r in seen) == open_rows - fitted
    assert set(model.thresholds) == {"en", "xx"}
    got = toxicity.score(docs, model, lang_col="lang").join(labels, "doc_id").collect()
    assert all(r.predicted == r.toxic and r.flagged == (r.toxic == 1) for r in got)


# --- language -------------------------------------------------------------------------------------
def test_language_on_held_out_rows(spark):
    df = table(spark, WIDE, "documents").select("doc_id", "text", "lang")
    model = langid.train_on(df)
    got = langid.annotate(df, model).where(langid.fold("doc_id") == 0).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert sum(r.rejected for r in got) <= 1
    assert all(0 <= r.score <= 1 for r in got)


def test_strange_languages_are_rejected(spark):
    df = table(spark, WIDE, "documents").select("doc_id", "text", "lang")
    rows = sorted((r.lang, r.passage) for r in langid.passages(df, langid.fold("doc_id") != 0).collect())
    model = langid.train([p for _, p in rows], [lang for lang, _ in rows])
    assert model.negatives_rejected > 0.4  # the others are named surely, and clean texts with words of their own must stay
    held = [r for r in df.where((langid.fold("doc_id") == 0) & F.col("lang").isNotNull()).collect()]
    rng = np.random.default_rng(3)
    clean = [r.text for r in held if len(r.text) > 60]
    assert np.mean(model.judge(clean)[2]) < 0.01
    assert np.mean(model.judge([langid._shuffled(t, rng) for t in clean])[2]) > 0.25
    shares = []
    for out in sorted({lang for lang, _ in rows}):  # a language left out
        part = langid.train([p for lang, p in rows if lang != out], [lang for lang, _ in rows if lang != out])
        own, other = [r.text for r in held if r.lang == out and len(r.text) > 200], [r.text for r in held if r.lang != out and len(r.text) > 60]
        shares.append(np.mean(part.judge(own)[2]))
        assert np.mean(part.judge(other)[2]) < 0.02, out
    assert np.mean(shares) > 0.3 and max(shares) > 0.6


def test_language_rows(docs):
    texts = ["the cat and the house with them", "der hund und die katze mit dem"] * 60
    model = langid.train(texts, ["en", "de"] * 60)
    rows = [(1, None), (2, ""), (3, "123 !! --"), (None, "the house and them"), (5, "die katze und der hund"), (5, "die katze und der hund"), (6, "the cat and " * 30_000)]
    got = langid.annotate(docs(rows, ["score", "rejected"]), model)
    assert got.columns == ["doc_id", "text", "lang_pred", "score", "rejected"]
    out = Counter((r.doc_id, r.lang_pred, r.rejected) for r in got.collect())
    assert out == Counter({(1, "und", True): 1, (2, "und", True): 1, (3, "und", True): 1, (None, "en", False): 1, (5, "de", False): 2, (6, "en", False): 1})
    kept = langid.keep_identified(docs(rows, ["row", "lang_pred"]), model)
    assert kept.columns == ["doc_id", "text", "row", "lang_pred"] and kept.count() == 4
    none = langid.train([], [])
    assert [r.lang_pred for r in langid.annotate(docs([(1, "a")]), none).collect()] == ["und"]
    assert langid.annotate(docs([]), model).count() == 0
