import gzip
import hashlib
import io
import math
from pathlib import Path

import pytest

from basalt.llm import sentence_pieces as sp
from basalt.llm import warc
from basalt.llm.warc import OP1_SQL, op1_warc
from tests.oracle import same

SF = "/root/testdata/sf0.01"


def test_op1_matches_sql(spark):
    same(op1_warc(spark, SF), OP1_SQL, SF)


PAGES = [(5, "http://www.b.com:80/x?y#z", "<p>é</p>", "a"), (3, "https://b.com/x?y", "<p>é</p>", "a"), (9, None, None, "a"), (None, "http://b.com/x?y", "<p>é</p>", "a"), (7, "ftp://[bad", "", "a"), (3, "https://b.com/x?y", "<p>é</p>", "a"), (8, "http://a.b.com/\r\nX: 1", "z" * 900_000, "a"), (None, "u", "q", "a"), (None, "u", "q", "a")]


@pytest.fixture
def written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_CAPTURES", 2)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, payload string")
    a, i = str(tmp_path / "archives"), str(tmp_path / "index")
    warc.write_archives(pages, a)
    warc.write_index(spark, a, i)
    return pages, a, i


@pytest.mark.parametrize("directory", [10**6, 0])
def test_archives_come_back(spark, written, directory):
    pages, a, i = written
    found = warc.lookup(warc.keys_of(pages), i, directory)
    out = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.payload) for r in warc.read_records(found, a).collect()), key=str)
    p = "<p>é</p>".encode()
    assert out == sorted([(5, 9, "revisit", 3, None), (3, 9, "response", None, p), (3, 9, "response", None, p), (None, 9, "revisit", 3, None), (9, 0, "revisit", 7, None), (7, 0, "response", None, b""), (8, 900_000, "response", None, b"z" * 900_000), (None, 1, "response", None, b"q"), (None, 1, "response", None, b"q")], key=str)
    only = warc.lookup(spark.createDataFrame([("com,b)/x?y",), ("com,zz)/",), ("",)], "key string"), i, directory)
    assert sorted(r.key for r in only.collect()) == ["", *["com,b)/x?y"] * 4]


def test_archives_are_plain_gzip(written):
    _, a, _ = written
    records = [gzip.decompress(p.read_bytes()) for p in Path(a).glob("part-*")]
    assert sum(r.count(b"WARC/1.1\r\n") for r in records) == len(PAGES)
    assert not any(b"\r\nX: 1" in r for r in records)


def test_small_payloads_are_responses(spark, tmp_path):
    pages = spark.createDataFrame(PAGES[:2], "page_id long, url string, html string, x string")
    warc.write_archives(pages, str(tmp_path / "a"), min_bytes=100)
    warc.write_index(spark, str(tmp_path / "a"), str(tmp_path / "i"))
    out = warc.read_records(warc.lookup(warc.keys_of(pages), str(tmp_path / "i")), str(tmp_path / "a")).collect()
    assert {r.record_type for r in out} == {"response"}
    assert all(hashlib.sha1(r.payload).digest() for r in out)


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "a"))
    warc.write_index(spark, str(tmp_path / "a"), str(tmp_path / "i"))
    assert warc.read_records(warc.lookup(warc.keys_of(pages), str(tmp_path / "i")), str(tmp_path / "a")).count() == 0


@pytest.mark.parametrize("span", [1, 7, 64, 1 << 14])
def test_members_of_a_stream(span):
    records = [b"WARC/1.1 a", b"b" * 5000, b"", bytes(range(256)) * 40, b"last"]
    parts = [warc.gzip_member(x) for x in records] + [warc.EMPTY]
    found = list(warc.members(io.BytesIO(b"".join(parts)), span))
    starts = [sum(map(len, parts[:k])) for k in range(len(parts))]
    assert found == [(starts[k], len(parts[k]), x) for k, x in enumerate(records) if x]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(b"".join(parts)[:-30]), span))


def test_index_is_the_same_where_files_come_whole(spark, written, tmp_path, monkeypatch):
    _, a, i = written
    monkeypatch.setattr(warc, "reachable", lambda path: False)
    warc.write_index(spark, a, str(tmp_path / "whole"))
    assert warc.lookup(warc.keys_of(written[0]), i).exceptAll(warc.lookup(warc.keys_of(written[0]), str(tmp_path / "whole"))).count() == 0
    assert spark.read.parquet(str(tmp_path / "whole")).selectExpr("sum(captures)").first()[0] == len(PAGES)


def test_url_keys():
    assert warc.url_key("HTTP://WWW.Example.com:80/a/B?c#d") == "com,example)/a/B?c"
    assert warc.url_key("https://u@m.x.org:8443") == "org,x,m:8443)/"
    assert warc.url_key(None) == ""


def viterbi(text: str, v: sp.Vocabulary) -> tuple[float, list[int]]:
    """Best path over a whole text, without words: score and ids. Ties go to the longer last piece."""
    s = " " + text.replace(sp.SPACE, " ")
    ids = {p: i for i, (p, u) in enumerate(zip(v.pieces, v.usable, strict=True)) if u}
    best = [(0.0, [])] + [None] * len(s)
    for end in range(1, len(s) + 1):
        options = []
        for start in range(max(0, end - v.longest), end):
            piece = s[start:end]
            if piece in ids:
                options.append((best[start][0] + v.scores[ids[piece]], -start, [ids[piece]]))
            elif end == start + 1:
                options.append((best[start][0] + v.unknown_score, -start, [v.first_byte + b for b in piece.encode()]))
        top = max(options, key=lambda x: x[:2])
        best[end] = (top[0], best[-top[1]][1] + top[2])
    return best[-1]


def path_score(ids: list[int], v: sp.Vocabulary) -> float:
    score, k = 0.0, 0
    while k < len(ids):
        if v.usable[ids[k]]:
            score, k = score + v.scores[ids[k]], k + 1
        else:  # bytes of one character
            first = ids[k] - v.first_byte
            k += 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            score += v.unknown_score
    return score


def test_encoding_is_the_best_path(spark):
    v = sp.Vocabulary.load()
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 5 = 0").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in sp.encode(docs).collect():
        score, ids = viterbi(texts[r.doc_id], v)
        assert len(r.ids) == r.n_pieces and r.round_trip
        assert r.ids == ids or math.isclose(path_score(r.ids, v), score, rel_tol=1e-12)


@pytest.mark.parametrize("words", [sp.BROADCAST_BYTES, 0])
def test_pieces_edges(spark, monkeypatch, words):
    monkeypatch.setattr(sp, "ROW_LETTERS", 5)
    monkeypatch.setattr(sp, "FOLD_BLOCK", 3)
    monkeypatch.setattr(sp, "STEP", 2000)
    v = sp.Vocabulary.load()
    texts = {1: "", 2: None, 3: "☃ snow 😀 \t", 4: "\n\n a\n", 5: "  two  spaces ", 6: "x" * 300, 7: "word, " * 3000, 8: "a ▁b", 9: "été\x00"}
    docs = spark.createDataFrame([*[(k, t, "n") for k, t in texts.items()], (9, texts[9], "n"), (None, "a", "n")], "doc_id long, text string, n_pieces string")
    out = sp.encode(docs, broadcast_bytes=words)
    rows = out.collect()
    assert len(rows) == 11
    for r in rows:
        text = "a" if r.doc_id is None else texts[r.doc_id]
        assert r.ids == (viterbi(text, v)[1] if text else []), r.doc_id
        assert r.round_trip and r.n_pieces == len(r.ids)
    back = {r.doc_id: r.text for r in sp.decode(out).collect()}
    assert all(back[k] == (t or "").replace("▁", " ") for k, t in texts.items())
    assert sp.encode(docs.limit(0), broadcast_bytes=words).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [0, 1, -5, 10**6, 3 + 0xFF])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in sp.decode(odd).collect()} == {1: None, 2: "�"}


LONG_WORDS = ["a" * 200_000, "the" * 20_000, "-=" * 20_000, "日本語の文章" * 3000, "Zm9vYmFyIGJheg" * 4000, "\U0001f600é" * 5000]


@pytest.mark.parametrize("text", LONG_WORDS, ids=range(len(LONG_WORDS)))
def test_very_long_words(spark, text):
    v = sp.Vocabulary.load()
    row = sp.encode(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.round_trip and row.ids == best_ids(text, v)


def best_ids(text: str, v: sp.Vocabulary) -> list[int]:
    """As viterbi(), with back pointers instead of whole paths, for long texts."""
    s = " " + text
    ids = {p: i for i, (p, u) in enumerate(zip(v.pieces, v.usable, strict=True)) if u}
    best, back = [0.0] + [-math.inf] * len(s), [0] * (len(s) + 1)
    for end in range(1, len(s) + 1):
        for start in range(max(0, end - v.longest), end):
            score = v.scores[ids[s[start:end]]] if s[start:end] in ids else v.unknown_score if end == start + 1 else -math.inf
            if best[start] + score > best[end]:
                best[end], back[end] = best[start] + score, start
    out, end = [], len(s)
    while end:
        piece = s[back[end] : end]
        out.append([ids[piece]] if piece in ids else [v.first_byte + b for b in piece.encode()])
        end = back[end]
    return [i for part in reversed(out) for i in part]
