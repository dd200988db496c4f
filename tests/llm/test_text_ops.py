"""Row-wise operators: BPE, HTML, quality, language."""

import hashlib
import random
import struct
import sys

import pytest
from pyspark.sql import functions as F

from vhist.llm import bpe, html_text, language, quality

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path(bpe.RANKS))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_like_the_library(ranks, library):
    codec, r = bpe.Codec(ranks, public_tokenizers.PATTERN), random.Random(5)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEéèñß ABC漢字かな🎉123́\n\t's   "
    tokens = list(ranks)
    for n in range(1200):
        text = "".join(r.choice(alphabet[: r.choice([3, 8, 26, 60])]) for _ in range(r.randrange(120)))
        if n % 3 == 0:
            text += b"".join(r.choice(tokens) for _ in range(5)).decode("utf-8", "replace")
        ids = codec.encode(text)
        assert ids == library.encode_ordinary(text), text
        assert codec.decode(ids) == text
    for text in ("ab" * 30_000, "zqxjkv" * 5_000, " " * 5_000, "é" * 9_000):
        assert codec.encode(text) == library.encode_ordinary(text)


def test_utf8_machine(ranks):
    """Any bytes, cut anywhere, against the whole decoded at once; and tokens that cut characters."""
    r = random.Random(8)
    pool = "aé漢🎉\u07ff\u0800\uffff\U0010ffff".encode()
    odd = [b"\x80", b"\xc0\xaf", b"\xe0\x9f\xbf", b"\xed\xa0\x80", b"\xf0\x8f\xbf\xbf", b"\xf4\x90\x80\x80", b"\xf8", b"\xff", b"\xe2\x82", b"\xf0\x9f\x8e"]
    for _ in range(3000):
        data = b"".join(r.choice([pool, pool[: r.randrange(len(pool))], r.choice(odd), bytes([r.randrange(256)])]) for _ in range(r.randrange(6)))
        machine, out, at = bpe.Utf8(), b"", 0
        while at < len(data):
            step = r.randrange(1, 5)
            out += machine.feed(data[at : at + step])
            at += step
            assert not out or out.decode()
        assert (out + machine.end()).decode() == data.decode("utf-8", "replace")
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    bytewise = [ranks[bytes([b])] for b in "né漢🎉 x".encode()]
    assert codec.decode(bytewise) == "né漢🎉 x" and codec.decode(bytewise[:2] + bytewise[-1:]) == "n\ufffdx"
    ids = [r.choice(list(ranks.values())) for _ in range(9000)]
    assert codec.decode(ids) == b"".join(codec.bytes[i] for i in ids).decode("utf-8", "replace")


def test_full_tables_change_nothing(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    monkeypatch.setattr(bpe, "MAX_PIECES", 5)
    monkeypatch.setattr(bpe, "MAX_WORDS", 3)
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    text = "thntblere ofonedsh inthat " * 400 + "thntblereofonedsh" * 2000
    assert codec.encode(text) == library.encode_ordinary(text)


def test_new_words_are_read_together(ranks):
    """words not met before cost no Python calls each. (41 calls a word when each went through the transducer alone, 1 since.)"""
    codec, r = bpe.Codec(ranks, public_tokenizers.PATTERN), random.Random(3)
    texts = [" ".join("".join(r.choices(["th", "nd", "bl", "er", "of"], k=r.randrange(6, 9))) for _ in range(20_000)) for _ in range(3)]
    for text in texts[:2]:
        codec.encode(text)
    calls = [0]

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        codec.encode(texts[2])
    finally:
        sys.setprofile(None)
    assert calls[0] < 5 * 20_000


@pytest.mark.parametrize("small", [False, True])
def test_texts_encoded_together(ranks, library, monkeypatch, small):
    """texts that share words, odd spaces, long pieces, empty ones; and the smallest groups and tables."""
    if small:
        for name, value in (("CHUNK", 30), ("ABREAST", 16), ("MAX_PIECES", 2), ("SHORT", 8), ("MAX_STATES", 3), ("MAX_WORDS", 2)):
            monkeypatch.setattr(bpe, name, value)
    codec, r = bpe.Codec(ranks, public_tokenizers.PATTERN), random.Random(9)
    parts = ["the", "of", "ofthe", "été", "漢字", "🎉", "it's", "x\n", "\n", " ", "  ", "\u00a0", "\u3000", "\x1c", "\x85", "7", "&&&", "qzx" * 120, "é" * 200, ""]
    texts = [r.choice([" ", "", "  "]).join(r.choices(parts, k=r.randrange(9))) for _ in range(1500)] + ["", " ", "  a", "a ", " a", "\n a", "a \n"]
    got = [ids.tolist() for group in bpe.chunks(iter(texts)) for ids in codec.encode_all(group)]
    assert got == [library.encode_ordinary(text) for text in texts]
    assert [codec.decode(ids) for ids in got] == texts


def test_token_that_merges_do_not_reach():
    """a piece that is a token is this token, whatever its bytes would be merged to."""
    own = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"abc": 257, b"ab": 258, b" abcd": 259}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={})
    codec, text = bpe.Codec(own, public_tokenizers.PATTERN), "abcd abcd abcde ab xabcd abcd"
    assert codec.encode(text) == library.encode_ordinary(text) and 259 in codec.encode(text)


def test_bpe_rows(spark, ranks, library):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (1, "Hello world", "x"), (None, "é", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.bpe_round_trip(docs, public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN, keep_ids=True).collect()
    for (doc, text, _), x in zip(rows, out):
        ids = library.encode_ordinary(text or "")
        assert (x.doc_id, x.n_tokens, x.ids, x.decoded) == (doc, len(ids), ids, text or "")
        assert x.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    broken = spark.sql("SELECT 1L AS doc_id, CAST(X'41FF42' AS STRING) AS text")
    assert bpe.bpe_round_trip(broken, public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN, keep_ids=True).first().decoded == "A\ufffdB"
    assert bpe.bpe_round_trip(docs.limit(0), public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>site</header><nav><a href=x>menu</a></nav>
<div class="cookie-notice"><p>We use cookies and this is a rather long text about it.</p></div>
<article><h1>Head &amp; line</h1><p>A first   paragraph
with some words in it.<br>And more.<p>Short.<aside>side</aside><script>var t="</p>";</script>
<div class="comments"><p>Reader comment that is long enough to look like text.</p></div></article>
<form><input><p>subscribe</p></form><footer>foot</footer></body></html>"""


def test_html(spark):
    want = "Head & line\nA first paragraph with some words in it. And more.\nShort."
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "plain &lt;text", "x"), (5, "u", "<p>" + "word " * 40_000, "x")]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [x.text for x in out[:4]] == [want, "", "", "plain <text"]
    assert [x.n_chars for x in out] == [len(want), 0, 0, 11, 199_999]
    chunked = html_text.CHUNK
    html_text.CHUNK = 7
    try:
        assert html_text.main_text(PAGE) == want
    finally:
        html_text.CHUNK = chunked


TEXT = "Some words of a story that goes on for a while, with a comma and no link in it at all. "


@pytest.mark.parametrize(
    "html, want",
    [
        # Neither article nor main: the ratio alone finds the element; its short lines and heading stay.
        ("<div><a href=a>One</a> <a href=b>Two</a></div><div><h1>Head</h1><p>{t}{t}</p><p>Short.</p><p>{t}</p></div><div><a href=c>More of this</a><p>Tiny</p></div>", "Head\n{tt}\nShort.\n{t}"),
        # Directly in the body, between unnamed menus.
        ("<body><div><a href=a>One</a></div><h1>Head</h1><p>{t}</p><p>Short.</p><p>{t}</p><p>End.</p><div><p>x</p></div></body>", "Head\n{t}\nShort.\n{t}\nEnd."),
        # A heading before the region; a list and a quote in it; a cell is no region of its own.
        ("<body><h1>Head</h1><div><p>{t}</p><ul><li>one<li>two</ul><blockquote><p>{t}{t}</p></blockquote><table><tr><td>cell</table></div>", "Head\n{t}\none\ntwo\n{tt}\ncell"),
        # Misleading names.
        ('<div class="layout has-sidebar"><article><p>{t}</p></article><div class="sidebar"><p>{t}</p></div></div>', "{t}"),
        ('<div id="page-with-comments"><div><p>{t}</p></div><div class=comments><p>{t}{t}</p></div></div>', "{t}"),
        ('<section class="social-policy"><main><p>{t}</p><p>a</p></main></section>', "{t}\na"),
        ('<div class="menu"><p>{t}</p><p>Short.</p></div>', "{t}\nShort."),
        # Noise in noise, and comments that are articles.
        ('<main><h1>H</h1><p>Hi.</p><div class=comments><article class="comment"><p>{t}</p><div class=ad>{t}</div></article></div></main>', "H\nHi."),
        ('<article><p>{t}</p></article><section id="comments"><article><p>{t}</p></article></section><footer><p>{t}</p></footer>', "{t}"),
        # Advert and heading of equal length, one short paragraph.
        ('<body><nav><a href=a>menu</a></nav><div class="ad">{t}</div><article><h1>Head</h1><p>Hi.</p></article><footer>{t}</footer>', "Head\nHi."),
        ("<ul><li><a href=a>only links</a></ul>", ""),
        ("<article><p>&eacute;&#8212;&nbsp;x\ty</p><svg><text>no</text></svg><p>b<span class=share-button>no</span><button>no</button>c</p><pre>a\n b</pre></article>", "\u00e9\u2014 x y\nbc\na b"),
    ],
)
def test_html_regions(html, want):
    fill = lambda x: x.replace("{tt}", (TEXT + TEXT).strip()).replace("{t}{t}", TEXT + TEXT).replace("{t}", TEXT.strip())
    assert html_text.main_text(fill(html)) == fill(want)


def test_html_ratio_decides(monkeypatch):
    """Smoothing and clustering against a plain version; without the ratio results differ on every page here."""
    import math

    r = random.Random(3)
    for _ in range(40):
        made = [(r.randrange(300), r.randrange(1, 4), r.choice([0, 0, 0, 1, 2])) for _ in range(r.randrange(1, 30))]
        lines = [html_text.Line("x" * n, tags, 0, mark, 0, False) for n, tags, mark in made]
        out = [0.0] * len(made)
        for mark in (0, 1, 2):
            own = [k for k, x in enumerate(made) if x[2] == mark]
            for p, k in enumerate(own):
                near = [(math.exp(-(d**2) / 2), made[own[min(max(p + d, 0), len(own) - 1)]]) for d in range(-3, 4)]
                out[k] = sum(w * n / t for w, (n, t, _) in near) / sum(w for w, _ in near) * (0.001 if mark else 1)
        mean = sum(out) / len(out)
        std = math.sqrt(sum((x - mean) ** 2 for x in out) / len(out))
        limit = min(max(std, max(out) / 10), max(out) / 3)
        want = [x >= limit and max(out) > 0 for x in out]
        sure = [abs(x - limit) > 1e-9 for x in out]
        got = html_text.seeds_of(lines, 1.0)
        assert all(a == b for a, b, s in zip(got, want, sure) if s)
        runs = []
        for mark in (0, 1, 2):
            before = None
            for k in [k for k, x in enumerate(made) if x[2] == mark]:
                if got[k]:
                    if before is not None and runs and runs[-1][-1] == before:
                        runs[-1].append(k)
                    else:
                        runs.append([k])
                before = k if got[k] else None
        assert sorted(html_text.clusters_of(got, [x[2] for x in made])) == sorted((x[0], x[-1]) for x in runs)
    before = html_text.main_text(PAGE)
    monkeypatch.setattr(html_text, "seeds_of", lambda lines, sigma: [True] * len(lines))
    assert html_text.main_text(PAGE) != before


def test_html_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, "u", "<p>a", "x")]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")).collect()
    assert len(out) == 3 and out[0] == out[1] and out[2].text == "a"
    assert html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string").limit(0)).count() == 0
    broken = spark.sql("SELECT 1L AS page_id, 'u' AS url, CAST(X'3C703E41FF' AS STRING) AS html")
    assert html_text.extract(broken).first().text == "A\ufffd"


def test_quality(spark):
    r = random.Random(1)
    words = ["the", "river", "and", "stone", "of", "light", "under", "trees", "walks", "home"]
    good = [(i, " ".join(r.choice(words) for _ in range(40)) + ".", 1) for i in range(150)]
    bad = [(i, " ".join(r.choice(words) + "$$$" for _ in range(40)), 0) for i in range(150, 300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad] + [(900, None), (901, ""), (None, "the river")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in good + bad] + [(900, None), (None, 1), (5, 7)], "doc_id long, label int")
    weights, bias = quality.train(docs, labels.where("doc_id % 3 <> 1 OR doc_id IS NULL"))
    out = {x.doc_id: x for x in quality.score(docs.withColumn("score", F.lit("old")), weights, bias).collect()}
    held = [(i, y) for i, _, y in good + bad if i % 3 == 1]
    assert sum((out[i].score >= 0.5) == y for i, y in held) / len(held) > 0.97
    assert len(out) == 303 and out[900].score == out[901].score and 0 <= out[900].score <= 1
    odd = docs.limit(2).unionByName(docs.limit(1)).selectExpr("doc_id", "text", "'x' AS _text", "1 AS row", "2 AS score")
    assert [(x._text, x.row) for x in quality.score(odd, weights, bias).collect()] == [("x", 1)] * 3
    assert quality.score(odd.limit(0), weights, bias).count() == 0
    weights, bias = quality.train(docs, labels.limit(0))
    assert bias == 0 and not weights.any()


def test_language(spark):
    base = {"en": "the and that with from this they were have been", "de": "der und nicht mit einer auch werden sich über schön"}
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(base[lang].split()) for _ in range(12)), lang) for i in range(200) for lang in [("en", "de")[i % 2]]]
    docs = spark.createDataFrame(rows + [(1000, None, "en"), (1001, "123 !?", "de"), (1002, "the the", None)], "doc_id long, text string, lang string")
    learned = language.prototypes(docs.where("doc_id < 100 AND lang IS NOT NULL"))
    out = {x.doc_id: x for x in language.identify(docs, learned).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang in rows)
    assert [(out[i].lang_pred, out[i].score) for i in (1000, 1001)] == [("und", 0.0)] * 2 and out[1002].lang_pred == "en"
    assert all(0 <= x.score <= 1 for x in out.values())
    assert language.prototypes(docs.limit(0)) == {} and language.identify(docs, {}).first().lang_pred == "und"
    # Beyond the bound prototypes stay a table, with the same results; repeated rows, a very long text, extra columns.
    more = docs.unionByName(docs.where("doc_id < 3")).unionByName(docs.where("doc_id = 0").withColumn("text", F.expr("repeat(concat(text, ' '), 20000)"))).withColumn("row", F.lit("x"))
    as_table = language.prototypes(docs.where("doc_id < 100 AND lang IS NOT NULL"), max_langs=1)
    key = lambda frame: sorted((x.doc_id, x.lang_pred, round(x.score, 4)) for x in frame.collect())
    want = key(language.identify(more, learned))
    assert len(want) == 207 and want == key(language.identify_in_blocks(more, as_table, block=1)) == key(language.identify(more, as_table))
    assert language.identify(docs.limit(0), learned).count() == 0


def test_quality_forgets_codecs():
    """A worker that encoded texts doesn't keep the codec's caches while it learns or scores."""
    import public_tokenizers

    from vhist.llm import bpe
    from vhist.llm.common import forget_codecs

    forget_codecs()
    assert bpe.codec_for(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN).encode("some words")
    assert bpe.codec_for.cache_info().currsize == 1
    forget_codecs()
    assert bpe.codec_for.cache_info().currsize == 0
    assert bpe.codec_for(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN).decode([]) == ""
