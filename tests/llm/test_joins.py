import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from basalt.llm import embedding_dedup as ed
from basalt.llm import ngram_join as nj
from basalt.llm import shingles as sh
from basalt.llm.embedding_dedup import dedup_vectors, op8_embedding_dedup
from basalt.llm.ngram_join import op7_shingle_join, shingle_components

SF = "/root/testdata/sf0.01"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, width):
    w = WORD.findall((text or "").encode().lower())
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def by_brute_force(texts: dict, width: int, percent: int) -> dict:
    sets = {k: shingles(t, width) for k, t in texts.items()}
    up = {k: k for k in texts}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            p, q = sets[a], sets[b]
            if p and q and 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)):
                n = len(p & q)
                if 100 * n >= percent * (len(p) + len(q) - n) and top(a) != top(b):
                    x, y = sorted((top(a), top(b)))
                    up[y] = x
    return {k: (len(sets[k]), top(k)) for k in texts}


def test_shingle_sets_are_exact():
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "B", "b", "É", "é", "x" * 9, " ", "\x85"]) for _ in range(rng.randrange(40))) for _ in range(200)] + ["", " \t\n", "one", "one two three", "a\x0bb\x0cc\rd e"]
    for width in (1, 4, 5):
        sets = sh.shingle_sets([t.encode() for t in texts], width)
        assert [len(s) for s in sets] == [len(shingles(t, width)) for t in texts]
    seen = {}
    for t, s in zip(texts, sets, strict=True):
        assert seen.setdefault(frozenset(shingles(t, 5)), s.tobytes()) == s.tobytes()


def test_long_texts_are_hashed_whole(monkeypatch):
    texts = [b" ".join(b"w%d" % (i % 97) for i in range(3000)), b"x" * 5000 + b" y", b"short"]
    whole = sh.shingle_sets(texts, 4)
    monkeypatch.setattr(sh, "PIECE", 100)
    assert all((a == b).all() for a, b in zip(whole, sh.shingle_sets(texts, 4), strict=True))


def test_op7_matches_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = by_brute_force(texts, 4, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op7_shingle_join(spark, SF).collect()} == want


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_families_match_brute_force(spark, monkeypatch, width, percent):
    """Families of near copies around a text, chains, copies, and a passage that all share; groups small and large."""
    monkeypatch.setattr(nj, "SMALL", 3)
    monkeypatch.setattr(nj, "BLOCK", 7)
    monkeypatch.setattr(nj, "HOT", 12, raising=False)
    rng = random.Random(width)
    word = lambda: f"w{rng.randrange(400)}"
    passage = [word() for _ in range(25)]
    texts = {}

    def add(words):
        texts[len(texts)] = " ".join(words)

    for _ in range(4):
        base = [word() for _ in range(80)]
        for _ in range(40):
            copy = list(base)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(80)] = word()
            add(copy)
        for _ in range(12):  # a chain drifts away from where it began
            base[rng.randrange(80)] = word()
            add(base)
    for _ in range(60):
        add([word() for _ in range(rng.randrange(30))] + passage)
    for _ in range(40):
        add(word() for _ in range(rng.randrange(8)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_components(docs, width, percent).collect()}
    assert got == by_brute_force(texts, width, percent)


def test_op7_edges(spark):
    same = "one two three four five six seven"
    rows = [(5, same, "a"), (3, same.upper(), "b"), (None, same, "c"), (5, same, "a"), (7, None, "d"), (8, "", "e"), (None, " ", "f"), (9, "é x", "g"), (2, "É x", "h"), (11, "word " * 200_000, "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_shingles string")
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in shingle_components(docs).collect()), key=str)
    assert out == sorted([(5, 4, 3), (3, 4, 3), (None, 4, 3), (5, 4, 3), (7, 0, 7), (8, 0, 8), (None, 0, None), (9, 1, 9), (2, 1, 2), (11, 1, 11)], key=str)
    assert shingle_components(docs.limit(0)).count() == 0


def vectors_by_brute_force(rows, least):
    ids = [r[0] for r in rows]
    good = [k for k, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for i in good:
        for j in good:
            if i != j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= least:
                    links[i].add(j)
    comp = {}
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        comp[k] = min(ids[x] for x in seen)
    return sorted((ids[k], len(links[k]), comp[k]) for k in range(len(rows)))


def test_op8_recall(spark, monkeypatch):
    """Trees with several upper levels and small leaves, against brute force."""
    monkeypatch.setattr(ed, "BRANCH", 60)
    rng = np.random.default_rng(8)
    rows = []
    for label in (1, 2):
        for c in rng.normal(size=(150, 32)):
            for _ in range(rng.integers(1, 5)):
                rows.append((len(rows), (c + rng.normal(size=32) * 0.22).tolist(), label))
    want = vectors_by_brute_force([(i, np.float32(v).astype(float).tolist(), lab) for i, v, lab in rows], 0.93)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in dedup_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), leaf=24).collect())
    found, true = sum(x[1] for x in got), sum(x[1] for x in want)
    assert true > 200 and found >= 0.97 * true and all(a[1] <= b[1] for a, b in zip(got, want, strict=True))


def test_op8_whole_table(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = op8_embedding_dedup(spark, SF).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == vectors_by_brute_force(rows, 0.93)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_op8_edges(spark):
    v = [1.0, 0.0, 2.0]
    rows = [(4, v, 1, "x"), (2, v, 1, "x"), (9, v, 2, "x"), (8, v, None, "x"), (1, None, 1, "x"), (3, [0.0, 0.0, 0.0], 1, "x"), (5, [1.0, float("nan"), 0.0], 1, "x"), (6, [float("inf"), 1.0, 1.0], 1, "x"), (7, [1.0, None, 2.0], 1, "x"), (10, [], 1, "x"), (11, [2.0, 0.0, 4.0], 1, "x"), (4, v, 1, "x"), (12, [1.0, 0.0], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, kept string")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in dedup_vectors(df).collect())
    assert got == [(1, 0, 1), (2, 3, 2), (3, 0, 3), (4, 3, 2), (4, 3, 2), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 0, 10), (11, 3, 2), (12, 0, 12)]
    assert dedup_vectors(df.limit(0)).count() == 0


def test_op8_deep_trees(spark, monkeypatch):
    """Branches of at most 9 of 1200 vectors: seven levels and more above, in several rounds."""
    monkeypatch.setattr(ed, "BRANCH", 9)
    monkeypatch.setattr(ed, "LEVELS", 3)
    monkeypatch.setattr(ed, "ROUTED", 300)
    rng = np.random.default_rng(9)
    rows = [(0, v, 1) for c in rng.normal(size=(600, 24)) for v in (c, c + rng.normal(size=24) * 0.25)]
    rows = [(i, np.float32(v).astype(float).tolist(), lab) for i, (_, v, lab) in enumerate(rows)]
    want = vectors_by_brute_force(rows, 0.93)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in dedup_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), leaf=6).collect())
    true, found = sum(x[1] for x in want), sum(x[1] for x in got)
    assert true > 500 and found >= 0.9 * true and all(a[1] <= b[1] for a, b in zip(got, want, strict=True))


def test_op8_sizes_of_doubles_and_branches_that_nothing_parts(spark, monkeypatch):
    monkeypatch.setattr(ed, "BRANCH", 16)
    rng = np.random.default_rng(3)
    base = rng.normal(size=8)
    rows = [(i, (base * s).tolist(), 1) for i, s in enumerate([1e-200, 1e200, 1.0, 5e-324 * 2**40])]
    rows += [(10 + i, (base + np.where(np.arange(8) == i % 8, 1e-14 * (i // 8), 0)).tolist(), 1) for i in range(60)]
    rows += [(100 + i, v.tolist(), 1) for i, v in enumerate(rng.normal(size=(40, 8)))]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in dedup_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), leaf=8).collect())
    assert [g for g in got if g[0] < 100] == [(i, 63, 0) for i, _, _ in rows[:64]]
    assert len(got) == 104


def test_op8_splits_as_deep_as_spilled_branches_need_in_one_round(spark, monkeypatch):
    """A split leaves 58 % on a side: three levels leave 88 of 450 vectors, more than 60, so that all were routed again."""
    made, write = [], ed.materialise
    monkeypatch.setattr(ed, "BRANCH", 60)
    monkeypatch.setattr(ed, "materialise", lambda df, name: made.append(name) or write(df, name))
    rng = np.random.default_rng(10)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.repeat(rng.normal(size=(225, 16)), 2, axis=0) + rng.normal(size=(450, 16)) * 0.1)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in dedup_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), leaf=24).collect())
    assert made.count("routed") == 1
    assert got == vectors_by_brute_force(rows, 0.93)


def test_op8_vectors_are_taken_as_arrays():
    """Taking a branch's vectors from Arrow cost three times as much as comparing them; it's a fraction of making Python objects."""
    x = np.random.default_rng(5).normal(size=(8000, 64)).astype(np.float32)
    column = pa.chunked_array([pa.array(list(x[:5000]), pa.list_(pa.float32())), pa.array(list(x[4000:]), pa.list_(pa.float32()))[1000:]])
    began = time.thread_time()
    lists = column.to_pylist()
    slow, began = time.thread_time() - began, time.thread_time()
    got = ed.unit(column)
    assert time.thread_time() - began < slow / 2
    wide = np.array(lists, np.float64)
    assert got.shape == wide.shape and np.allclose(got, wide / np.linalg.norm(wide, axis=1)[:, None], rtol=1e-14, atol=0)


@pytest.mark.parametrize("least", [0.3, 0.8, 0.93, 0.999])
def test_op8_leaves_connect_what_their_links_do(least):
    """Families, chains and lone rows: each row but the first of its component once, with that first."""
    rng = np.random.default_rng(6)
    turn = np.linspace(0, 3, 40)[rng.permutation(40)]
    chain = np.stack([np.cos(turn), np.sin(turn), 0 * turn], 1)
    for x in (chain, *(rng.normal(size=(n, 3)) for n in (1, 2, 7, 30, 90))):
        x = x / np.linalg.norm(x, axis=1)[:, None]
        want = vectors_by_brute_force([(i, v.tolist(), 1) for i, v in enumerate(x)], least)
        first, row = ed.spanning(x, least)
        assert sorted(zip(row.tolist(), first.tolist(), strict=True)) == [(i, c) for i, _, c in want if i != c]


@pytest.mark.parametrize("hot", [3, 10_000])
@pytest.mark.parametrize(("width", "percent"), [(4, 85), (2, 60)])
def test_templates_match_brute_force(spark, monkeypatch, hot, width, percent):
    """Texts of a few templates, alike but mostly below the bound, and texts put together from shared passages."""
    monkeypatch.setattr(nj, "HOT", hot, raising=False)
    rng = random.Random(hot)
    word = lambda: f"w{rng.randrange(300)}"
    texts = {i: f"your parcel has left our store and will be with you on day {i}" for i in range(80)}
    passages = [" ".join(word() for _ in range(12)) for _ in range(6)]
    for k in range(80, 200):
        texts[k] = " ".join(rng.choice(passages) for _ in range(rng.randrange(1, 6))) + (f" {word()}" if k % 3 else "")
    for k in range(200, 240):
        texts[k] = " ".join(word() for _ in range(rng.randrange(6)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_components(docs, width, percent).collect()}
    assert got == by_brute_force(texts, width, percent)
