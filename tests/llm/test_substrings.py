import random
import re

import numpy as np
import pytest

from basalt.llm import substring_dedup as sd
from basalt.llm import terms
from basalt.llm.shingles import hash_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_brute_force(rows, width):
    """(id, text) -> spans of words that go, from the definition."""
    order = lambda i: (i is None, i or 0)
    found = {}
    words = [(order(i), WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            found[k] = min(found.get(k, (i, p)), (i, p))
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - width + 1):
            if found[tuple(w[p : p + width])] < (i, p):
                gone |= set(range(p, p + width))
        out.append((w, gone))
    return out


def check(spark, rows, width):
    docs = spark.createDataFrame([(n, i, t) for n, (i, t) in enumerate(rows)], "row long, doc_id long, text string").repartition(5)
    got = {r.row: r for r in sd.remove_repeats(docs, width, keep=("row",)).collect()}
    assert len(got) == len(rows)
    for n, (w, gone) in enumerate(by_brute_force(rows, width)):
        r = got[n]
        assert (r.n_words, r.n_removed, r.kept) == (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)), (n, rows[n])
        assert sorted(k for s in r.spans for k in range(s.start, s.end)) == sorted(gone)


@pytest.mark.parametrize("width", [2, 6, 20])
def test_against_brute_force(spark, width):
    rng = random.Random(width)
    vocabulary = ["ab", "Ab", "é", "x", "y", "z"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(width, 4 * width))] for _ in range(6)]
    rows = []
    for i in range(80):
        words = []
        for _ in range(rng.randrange(5)):
            passage = rng.choice(passages)
            a = rng.randrange(len(passage))
            words += passage[a : a + rng.randrange(1, 5 * width)] + [rng.choice(vocabulary + [str(rng.random())]) for _ in range(rng.randrange(4))]
        rows.append((rng.choice([i, i - 100, 1 << 40]) if i % 7 else 7, rng.choice([" ", "\n", "\t "]).join(words)))
    check(spark, rows, width)


def test_cases(spark):
    line = " ".join(f"w{k}" for k in range(25))
    rows = [
        (None, line), (None, line), (None, "before " + line), (3, line + " after"), (3, line + " after"), (3, "one more " + line), (-5, None), (9, ""), (9, " \n"), (10, "few words"),
        (11, "a " * 500), (12, "b a " * 300), (13, "a " * 100 + "c"), (14, "a b c " * 50), (15, line + " " + line), (16, "x" * 300_000), (17, "é" * 30 + " " + line), (18, line.replace("w3", "W3")),
    ]
    check(spark, rows, 20)
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert sd.remove_repeats(spark.createDataFrame([(None, None)], "doc_id long, text string")).first().n_words == 0


def test_ids_far_apart_take_decimals(spark):
    line = " ".join(f"w{k}" for k in range(30))
    check(spark, [((1 << 63) - 1, line), (-(1 << 63), line), (0, "x " + line), (None, line)], 20)


def test_hot_passages_and_columns_to_keep(spark):
    line = " ".join(f"common{k}" for k in range(30))
    rows = [(i, f"own{i} " * 3 + line + f" own{i}" * 3 if i % 3 == 0 else " ".join(f"t{i}w{k}" for k in range(40))) for i in range(600)]
    check(spark, rows, 20)
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, spans string")
    with pytest.raises(ValueError, match="spans"):
        sd.remove_repeats(docs, keep=("spans",))
    assert sd.remove_repeats(docs).columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept"]


def test_hashes_of_words_in_pieces(monkeypatch):
    texts = [b"", b"one two  three", "zwölf Boxkämpfer\tjagen".encode(), b"x" * 900 + b" y " + b"z " * 500, b"\xff \xfe"]
    whole, owner = terms.hashed(texts)
    assert np.array_equal(whole[owner == 1], hash_words(b"one two  three")[0])
    monkeypatch.setattr(terms, "PIECE", 64)
    cut, of = terms.hashed(texts)
    assert np.array_equal(whole, cut) and np.array_equal(owner, of)
    assert [len(x) for x in (np.flatnonzero(of == k) for k in range(5))] == [len(t.split()) for t in texts]
    same = terms.hashed([b"Abc-DEF 12", b"abc def!12"], terms.LETTERS, terms.LOWER)[0]
    assert np.array_equal(same[:3], same[3:]) and len(same) == 6


def test_least_of_windows():
    values = np.array([5, 3, 3, 9, 1, 7, 1, 8], np.uint64)
    for width in range(1, 9):
        want = [k + int(np.argmin(values[k : k + width])) for k in range(len(values) - width + 1)]
        assert sd.leftmost_least(values, width).tolist() == want
