"""Operators over pages and vectors against plain versions, and over odd input."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from riskspark.llm import html_crf, langid, mips, warc
from riskspark.llm.html_blocks import leaf_blocks

TEXT = {
    "en": "the quick brown fox and the lazy dog were there with this and that of the morning",
    "de": "der schnelle braune fuchs und der faule hund waren nicht mit dieser und jener für einen morgen",
}


def _page(lang, i, tail=""):
    return (
        f'<html lang="{lang}"><head><title>t</title><script>x="</p>"</script></head><body><nav><ul><li><a href=/a>Menu {i}</a></li></ul></nav>'
        f"<article><h1>Head {i}</h1><p>{TEXT[lang]} &amp; more\n  {i}</p><p><b>{TEXT[lang]}<br><p>{TEXT[lang]} end.</p></article>"
        f"<footer>&copy; host</footer></body>{tail}"
    )


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"https://www.h{i % 3}.example.{'de' if i % 2 else 'com'}/x", _page("de" if i % 2 else "en", i), "t", 1) for i in range(60)]
    rows += [(60, None, None, None, None), (61, "no address", "", "t", 1), (62, "http://h0.example.com", "<p>a<", "t", 1), (1, *rows[1][1:]), (None, "http://x.de/", "&amp<table><td>q", None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string, lang long").repartition(3)


def test_main_text(pages):
    got = html_crf.extract_main_text(pages, html_crf.train(pages), keep=["page_id", "url", "html"]).collect()
    assert len(got) == pages.count()
    for r in got:
        assert r.n_chars == len(r.text)
        if r.page_id is not None and r.page_id < 60:
            lang = "de" if r.page_id % 2 else "en"
            assert r.text == f"Head {r.page_id}\n{TEXT[lang]} & more {r.page_id}\n{TEXT[lang]}\n{TEXT[lang]} end."
    assert {r.text for r in got if not r.html} == {""}


def test_main_text_without_sectioning_markup():
    model = html_crf.fit(html_crf.training_pages([_page("en", i) for i in range(120)]))
    for name in ("content", "post", "entry"):
        page = f'<div class="menu"><a href=/>Home</a></div><div class="{name}"><p>{TEXT["en"]} one.</p><p>{TEXT["en"]} two.</p></div><div class="comments"><p>{TEXT["en"]} no.</p></div>'
        assert html_crf.main_text(model, page) == f"{TEXT['en']} one.\n{TEXT['en']} two."


_NAV, _FOOT = "<nav><ul><li><a href=/a>Menu</a></li></ul></nav>", "<footer>&copy; host</footer>"
_START = f"<h1>Head</h1><p>{TEXT['en']} one.</p>"


@pytest.fixture(scope="module")
def page_model():
    return html_crf.fit(html_crf.training_pages([_page("de" if i % 2 else "en", i) for i in range(120)]))


@pytest.mark.parametrize(
    ("part", "lines"),
    [
        (f"<ul><li>{TEXT['en']} a.</li><li>short item</li></ul>", [f"{TEXT['en']} a.", "short item"]),
        (f"<ol><li><p>{TEXT['en']}</p></li></ol>", [TEXT["en"]]),
        ("<pre>for x in y:\n  print(x)</pre>", ["for x in y: print(x)"]),
        ("<table><thead><tr><th>Name</th></tr></thead><tbody><tr><td>a</td><td>12</td></tr></tbody></table>", ["Name", "a", "12"]),
        (f"<dl><dt>Term</dt><dd>{TEXT['en']}</dd></dl>", ["Term", TEXT["en"]]),
        ("<figure><img src=x><figcaption>A caption here</figcaption></figure>", ["A caption here"]),
        (f"<section class='comments'><article class='comment'><p>{TEXT['en']} no.</p></article></section>", []),
    ],
)
def test_main_text_keeps_all_of_an_article(page_model, part, lines):
    page = f"<html><body>{_NAV}<article>{_START}{part}<p>{TEXT['en']} two.</p></article>{_FOOT}</body></html>"
    assert html_crf.main_text(page_model, page).split("\n") == ["Head", f"{TEXT['en']} one.", *lines, f"{TEXT['en']} two."]


@pytest.mark.parametrize("tag", ["article", "main"])
def test_names_of_the_body_say_nothing_of_a_block(page_model, tag):
    page = f'<html class="menu"><body class="single has-sidebar header-fixed">{_NAV}<{tag}>{_START}</{tag}>{_FOOT}</body></html>'
    assert html_crf.main_text(page_model, page) == f"Head\n{TEXT['en']} one."


def test_title_in_a_header(page_model):
    page = f"<html><body><header><p>My site</p></header>{_NAV}<article><header><h1>Title</h1></header><p>{TEXT['en']} one.</p></article></body></html>"
    assert html_crf.main_text(page_model, page) == f"Title\n{TEXT['en']} one."
    assert html_crf.markup_labels(leaf_blocks(page)) == [0, 0, 1, 1]


def test_training_takes_equal_pages_once(pages):
    once, often = html_crf.train(pages), html_crf.train(pages.union(pages).union(pages))
    assert np.array_equal(once.weights, often.weights)


def test_viterbi_finds_the_best_labels():
    rng = np.random.default_rng(3)
    model = html_crf.Crf(rng.normal(size=(html_crf.BUCKETS, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    feats = [list(rng.integers(0, html_crf.BUCKETS, 4)) for _ in range(7)]
    emit = [model.weights[f].sum(0) for f in feats]

    def total(labels):
        return model.start[labels[0]] + sum(e[k] for e, k in zip(emit, labels, strict=True)) + sum(model.moves[a, b] for a, b in zip(labels, labels[1:]))

    best = max(([int(b) for b in f"{n:07b}"] for n in range(128)), key=total)
    assert html_crf.viterbi(model, feats) == best


def test_blocks_of_broken_markup():
    texts = lambda page: [b.text for b in leaf_blocks(page)]
    assert texts("<p>a<!-- x --> b<p>c<script>no</script>d") == ["a b", "c", "d"]
    assert texts("<p>1 < 2 &lt; 3<p title='>'>x<div") == ["1 < 2 < 3", "x"]
    assert texts("<!-- never closed <p>a") == [] and texts(None) == [] and texts("<" * 2000) == ["<" * 2000]


@pytest.mark.parametrize("tag", ["video", "audio", "object", "svg", "canvas", "select", "template"])
def test_blocks_behind_unclosed_elements(tag):
    texts = lambda page: [b.text for b in leaf_blocks(page)]
    assert texts(f"<body><p>a</p><{tag}><article><p>b</p></article></body>") == ["a", "b"]
    assert texts(f"<div><{tag}></div><p>b</p><{tag}>no<b>no</b><p>no</p></{tag}>c") == ["b", "c"]
    assert texts(f"<{tag}><p>b</p><{tag}>no</{tag}>c") == ["b", "c"]
    assert texts(f"<div>a<{tag}>no<{tag}>no</{tag}>no</{tag}>b</div>") == ["a", "b"]
    assert leaf_blocks(f"<main><{tag}><p>b")[0].path == leaf_blocks("<main><p>b")[0].path


def test_blocks_keep_formulas():
    page = "<article><p>so <math><mrow><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></mrow></math>, then</p><p>b</p></article>"
    assert [b.text for b in leaf_blocks(page)] == ["so x = 1 2, then", "b"]
    assert [b.text for b in leaf_blocks("<p>a <math><mi>x<p>b")] == ["a x", "b"]


def test_language_fusion(pages, spark):
    docs = spark.createDataFrame([(i, TEXT[k] + f" {i}", k) for i in range(40) for k in TEXT] + [(None, None, None)], "doc_id long, text string, lang string")
    got = langid.identify(pages, langid.train(docs)).collect()
    assert len(got) == pages.count()
    for r in got:
        assert r.lang in TEXT and 0 < r.confidence <= 1
        if r.page_id is not None and r.page_id < 60:
            assert r.lang == ("de" if r.page_id % 2 else "en")
    assert {r.host for r in got if r.url is None} == {""}
    none = langid.identify(pages, langid.train(docs.where("false"))).collect()
    assert len(none) == len(got) and {r.lang for r in none} == {None}


def test_warc_records(pages):
    responses = warc.responses_from_pages(pages)
    got = warc.derivatives(responses, as_bytes=True).collect()
    source = {r.record_id: r for r in responses.collect()}
    assert len(got) == 2 * pages.count()
    for r in got:
        payload = source[r.refers_to].payload or ""
        assert r.source_payload_digest == "sha256:" + hashlib.sha256(payload.encode()).hexdigest()
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        head, _, rest = bytes(r.warc).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and f"WARC-Refers-To: {r.refers_to}".encode() in head
        assert rest[: r.content_length] == r.block.encode() and rest[r.content_length :] == b"\r\n\r\n"
        if r.record_type == "conversion":
            assert r.block == "\n".join(b.text for b in leaf_blocks(payload))
        else:
            assert "http-header-content-type: text/html; charset=utf-8\r\n" in r.block


def test_top_products_equal_all_pairs(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 7) for _ in range(8)], "x") for i in range(400)]
    rows += [(400 + i, list(rows[5][1]), "x") for i in range(20)]  # ties
    rows += [(500, None, None), (501, [1.0, None] + [0.0] * 6, "x"), (502, [float("nan")] * 8, "x"), (503, [float("inf")] * 8, "x"), (504, [], "x"), (505, [0.0] * 8, "x"), (None, [1.0] * 8, "x"), (550, [1.0, 2.0], "x"), (506, [1e12] * 8, "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = mips.top_products(frame, F.col("vec_id") % 50 == 0, block=64, query_block=4).collect()
    usable = {i: [int(np.floor(256 * x)) for x in v] for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q, v in usable.items():
        if q % 50 == 0:
            scored = sorted((-max(min(sum(a * b for a, b in zip(v, w, strict=True)), 2**63 - 1), -(2**63)), i) for i, w in usable.items() if i != q and len(w) == len(v))
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:5])}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want
    assert mips.top_products(frame.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_no_pages(spark, pages):
    empty = pages.where("false")
    assert html_crf.extract_main_text(empty, html_crf.train(empty)).count() == 0
    assert warc.derivatives(warc.responses_from_pages(empty)).count() == 0
