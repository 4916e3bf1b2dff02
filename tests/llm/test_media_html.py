import hashlib
import random
import re
import time
import zlib
from html import unescape

import numpy as np
import pytest

from basalt.llm import tiff
from basalt.llm.html_text import extract_main_text, main_text, op10_html_text
from basalt.llm.tiff import media_digest, op6_tiff_media, read_pages, text_media

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("compression", sorted(tiff.ENCODE))
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("cell", [None, (16, 16), (64, 32)])
def test_tiff_round_trip(compression, predictor, cell):
    rng = np.random.default_rng(5)
    for order in "<>":
        for samples in (1, 3):
            for high in (2, 256):
                images = [rng.integers(0, high, (h, 50, samples), dtype=np.uint8) for h in (1, 37, 90)]
                back = list(tiff.pages(tiff.write(images, compression, predictor, cell, 8, order)))
                assert len(back) == 3 and all((a == b).all() for a, b in zip(images, back, strict=True))


def test_tiff_predictor_keeps_samples_apart():
    image = np.random.default_rng(6).integers(0, 256, (9, 20, 3), dtype=np.uint8)
    (back,) = tiff.pages(tiff.write([image], tiff.DEFLATE, 2))
    assert (back == image).all()


def test_packbits_and_lzw():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 127, 128, 129, 300, 20_000):
        for kinds in (1, 2, 256):
            data = bytes(rng.randrange(kinds) for _ in range(n))
            assert tiff.packbits_decode(tiff.packbits_encode(data)) == data
            assert tiff.lzw_decode(tiff.lzw_encode(data)) == data
    # a published example of PackBits
    packed = bytes.fromhex("FE AA 02 80 00 2A FD AA 03 80 00 2A 22 F7 AA".replace(" ", ""))
    assert tiff.packbits_decode(packed) == bytes.fromhex("AA AA AA 80 00 2A AA AA AA AA 80 00 2A 22 AA AA AA AA AA AA AA AA AA AA".replace(" ", ""))


def test_broken_media(spark):
    good = tiff.write([np.zeros((4, 8, 1), np.uint8)] * 2)
    loop = bytearray(good)
    rows = [(1, good), (2, None), (3, b"no tiff"), (4, good[: len(good) - 6]), (5, b"")]
    out = read_pages(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert [(r.doc_id, r.page) for r in out if r.error is None and r.doc_id == 1] == [(1, 0), (1, 1)]
    assert {r.doc_id for r in out if r.error is not None} == {3, 4, 5} and loop
    assert read_pages(spark.createDataFrame([], "doc_id long, media binary")).count() == 0


def test_op6_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op6_tiff_media(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])


def test_op6_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x" * 64, "c"), (None, "y" * 700_000, "d"), (4, "é" * 33, "e"), (4, "é" * 33, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    out = media_digest(text_media(docs)).collect()
    assert sorted((r.n_bytes, r.payload_bytes) for r in out) == [(0, 64), (0, 64), (64, 64), (66, 128), (66, 128), (700_000, 700_032)]
    assert len({r.media_sha256 for r in out}) == 4
    assert media_digest(text_media(docs.limit(0))).count() == 0


def test_op10_takes_articles_whole(spark):
    html = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op10_html_text(spark, SF).collect()
    assert len(rows) == len(html)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
        blocks = (" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body>
<header class="site-header"><h2>Site name, with, commas</h2></header><div id="cookie-notice">We use cookies, you know, and so on, and on.</div>
<nav><a href=/>Home</a> <a href=/x>More</a></nav>
<div class="layout"><div id="content"><h1>A title</h1><p>First &amp; best <b>para</b>graph,
 with   space&#33;<p>Second, one &lt;tag&gt;.<ul><li>one</li><li>two, and more</li></ul><pre>a
b</pre><blockquote>Quoted.</blockquote><form><input value=x><label>Mail</label></form><script>if (a<b) "</p>"</script></div>
<aside class="sidebar"><p>Links, links, links and other long text that isn't the article at all.</p></aside></div>
<section class="comments"><p>I think, that this, is a comment, with many, commas, and so on and so forth.</p></section>
<footer>&copy; me</footer></body></html>"""


def test_main_text_of_a_page_without_article():
    assert main_text(PAGE).split("\n") == ["A title", "First & best paragraph, with space!", "Second, one <tag>.", "one", "two, and more", "a b", "Quoted."]


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b", "a\nb"), ("<p>a &lt b &nbsp; c &unknown; &#x41;</p>", "a < b c &unknown; A"), ("<!-- <p>no</p> --><p>yes", "yes"),
    ("<div><p>x</div></p></span><p>y", "x\ny"), ("<p>a<br>b<br><br>c</p>", "a b\nc"), ("<nav>menu</nav>", ""), ("<p>2 < 3 and <3</p>", "2 < 3 and <3"), ("<p hidden>no</p><p>yes</p>", "yes"), ("<script>x", ""),
    ("<div class='layout has-sidebar'><article><p>in</p></article><div class=sidebar>out</div></div>", "in"), ("<div id=comments><article><p>A reply, it is.</p></article></div><p>Text, really.</p>", "Text, really."),
])
def test_main_text_cases(html, text):
    assert main_text(html) == text


def test_deep_and_long_pages():
    assert main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert main_text("<article>" + "<p>word, word</p>" * 20_000 + "</article>").count("\n") == 19_999


def test_op10_edges(spark):
    pages = spark.createDataFrame([(None, None, None, "q"), (1, "u", "<p>a</p>", "q"), (1, "u", "<p>a</p>", "q")], "page_id long, url string, html string, text string")
    assert sorted(r.n_chars for r in extract_main_text(pages).collect()) == [0, 1, 1]
    assert extract_main_text(pages.limit(0)).count() == 0


TEXT = "<p>A long paragraph, with commas, that says something of the matter at hand.</p>" * 3


@pytest.mark.parametrize(("html", "after"), [
    ("<article class='post hentry category-social tag-privacy'>{}</article>", 0),
    ("<div id=content class='has-sidebar'>{}</div><div class=sidebar><a href=/>Links</a></div>", 0),
    ("<article>{}<h2 id='related-work'>Related work</h2><section id=discussion><p>So we say.</p></section></article>", 2),
    ("<form id=aspnetForm><div class=search>{}</div><input></form><p class=cookie-notice>Cookies, more and more of them.</p>", 0),
    ("<nav class=menu>menu</nav><div class=comments>{}</div>", 0),
    ("<div id=page>{}<div id=comments class=comments-area>{}{}</div><div class=share-buttons>Share it, now.</div></div>", 0),
])
def test_names_cost_no_text(html, after):
    lines = main_text(html.replace("{}", TEXT)).split("\n")
    assert len(lines) == 3 + after and all(x.startswith("A long paragraph") for x in lines[:3])


@pytest.mark.parametrize("html", [
    "<article><h1>Title</h1><div class=body>{}</div></article>",
    "<main><h1>Title</h1><div class=body>{}</div></main>",
    "<body><h1>Title</h1><div class=body>{}</div></body>",
    "<article><section><h2>Title</h2>{}</section><section><p>short</p></section><section><p>Short, too</p></section></article>",
    "<div><article><h1>Title</h1>{}</article><article><p>short</p></article><article><p>Short, too</p></article></div>",
    "<div id=content><section><h2>Title</h2>{}</section><section><p>short</p></section><section><p>Short, too</p></section></div><p>(c)</p>",
])
def test_long_parts_cost_no_short_ones(html):
    for times in (1, 40):
        lines = main_text(f"<ul><li><a href=/>Home</a></ul>{html.replace('{}', TEXT * times)}").split("\n")
        assert lines[0] == "Title" and len(lines) == 1 + 3 * times + 2 * html.count("<p>Short")


@pytest.mark.parametrize("html", [
    "<body><form id='aspnetForm'>{nav}<div>{}</div></form></body>",
    "<div class='content with-sidebar'>{}</div>{nav}",
    "<div class='post comments-closed'>{}</div>{nav}",
    "<article><p class='alert'>Take care, of this.</p>{}<div class='privacy'><p>Privacy, as a topic.</p></div></article>{nav}",
    "<div><section>{}</section><section>{}</section></div>{nav}",
    "<div><p title=\"oops>Hello, said the world.</p>{}</div>",
    "<div>{nav}<div>{}</div><div>{}</div></div>",
])
def test_articles_of_many_shapes(html):
    nav = "<nav><a href=/>Home</a></nav><div class=sidebar><a href=/y>Side</a></div><footer>Footer</footer>"
    lines = main_text(html.replace("{nav}", nav).replace("{}", TEXT)).split("\n")
    extra = [t for t in ("Take care, of this.", "Privacy, as a topic.", "Hello, said the world.") if t in html]
    assert sorted(lines) == sorted([re.sub("<[^>]*>", "", TEXT.split("</p>")[0])] * (3 * html.count("{}")) + extra)


LONG = "<p>Words of prose, and more of it here, that go on for a while.</p>" * 8


@pytest.mark.parametrize(("html", "kept", "gone"), [
    ("<div>{}</div><div><p>The last of the paragraphs, in a part of its own.</p></div>", "The last of the paragraphs, in a part of its own.", None),
    ("<div class=lead>Prices fell again.</div><div>{}</div>", "Prices fell again.", None),
    ("<div>{}</div><div><p>Short tail.</p></div>", "Short tail.", None),
    ("<div>{}</div><ul><li>First</li><li>Second</li></ul>", "Second", None),
    ("<div>{}</div><table><tr><td>a</td><td>1</td></tr></table>", "a 1", None),
    ("<article>{}<p class='social'>Bees are social animals, and live in hives.</p></article>", "Bees are social animals, and live in hives.", None),
    ("<article>{}<p>Press <button>Start</button> to begin.</p></article>", "Press Start to begin.", None),
    ("<article>{}<p>All of it. <button>Share</button></p></article>", "All of it.", "Share"),
    ("<p>Tiny paragraph.</p><div class='footer-text'>Copyright</div>", "Tiny paragraph.", "Copyright"),
    ("<ul><li><a href=/>Home</a></ul><div>{}</div><div>(c) Us. All rights reserved.</div>", None, "rights"),
    ("<ul><li><a href=/>Home</a></ul><div>{}</div>", None, "Home"),
    ("<div>{}</div><p class='social'><a href=/s>Share it with friends, now.</a></p>", None, "friends"),
])
def test_siblings_without_anything_against_them_stay(html, kept, gone):
    lines = main_text(f"<html><body>{html.replace('{}', LONG)}</body></html>").split("\n")
    assert kept is None or kept in lines
    assert gone is None or not any(gone in x for x in lines)
    assert sum(x.startswith("Words of prose") for x in lines) == 8 * html.count("{}")


@pytest.mark.parametrize("seed", range(12))
def test_made_pages(seed):
    """Pages built from known parts, against the parts."""
    rng = random.Random(seed)
    words = "river stone cloud light house water grass small early north green paper".split()
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(6, 30))).capitalize() + ", " + rng.choice(words) + "."
    said, body = [], []
    for _ in range(rng.randrange(5, 40)):
        kind, text = rng.choice(["p", "p", "p", "p", "blockquote", "h2", "li"]), sentence()
        said.append(text)
        inner = text.replace(" ", "\n  ", 1).replace(rng.choice(words), "<b>\\g</b>", 0)
        body.append(f"<ul><li>{inner}</li></ul>" if kind == "li" else f"<{kind}>{inner}</{kind}>")
        if rng.random() < 0.2:
            body.append(rng.choice(["<script>var a = '<p>no</p>';</script>", "<style>p { }</style>", "<form><input><label>Mail</label></form>", "<div class='share-buttons'><a href=/>Share</a></div>", "<!-- <p>no</p> -->", "<aside><p>Beside, the text.</p></aside>"]))
    open_, shut = rng.choice([("<article>", "</article>"), ("<main><div>", "</div></main>"), ("<div class='post-body'>", "</div>"), ("<div id=content><div>", "</div></div>")])
    menu = "<nav><ul><li><a href=/>Home</a></li><li><a href=/a>About, us</a></li></ul></nav>"
    junk = "<div class=sidebar><p>Other, things, to read, here.</p></div><section class=comments><p>I, for one, disagree, with it.</p></section><footer><p>(c) us, and others.</p></footer>"
    html = f"<html><head><title>T</title></head><body><header><h1>Site</h1></header>{menu}<div class=wrap>{open_}{''.join(body)}{shut}</div>{junk}</body></html>"
    assert main_text(html).split("\n") == said


@pytest.mark.parametrize("part", ["<div>text here, ", "<b>text ", "<p title=\"oops>text", "</i><i><b>text", "<article>text", "<ul><li>text"])
def test_time_grows_with_the_page(part):
    began = time.process_time()
    assert main_text(part * 50_000).count("text") == 50_000
    assert time.process_time() - began < 20
