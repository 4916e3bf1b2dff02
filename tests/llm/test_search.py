import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from basalt.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_brute_force(docs, queries, k=10):
    """{(item, text): [(doc, score)]} from the definition, of lists of (id, text)."""
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    some = sum(1 for _, c in counts if c)
    all_ = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * some + 2) / (2 * n + 1))) for t, n in df.items()}
    out = {}
    for item, text in {*queries}:
        scores = []
        for i, c in counts:
            m = 10 + 90 * sum(c.values()) * some // max(1, all_)
            s = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms_of(text)) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out[item, text] = [(x[3], -x[0]) for x in sorted(scores, key=lambda x: x[:3])[:k]]
    return out


def check(spark, docs, queries, k=10):
    d = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], "doc_id long, text string, term int, place int").repartition(6)
    q = spark.createDataFrame([(i, t, "x") for i, t in queries], "item_id long, text string, qid string").repartition(3)
    got = {}
    for r in ls.search(ls.build_index(d), q, k).collect():
        got.setdefault(r.item_id, []).append((r.rank, r.doc_id, r.score))
    want = {}
    for (item, _), rows in by_brute_force(docs, queries, k).items():
        want.setdefault(item, []).extend((n, *x) for n, x in enumerate(rows, 1))
    assert {i: sorted(r, key=str) for i, r in got.items()} == {i: sorted(r, key=str) for i, r in want.items() if r}


def test_against_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(3000)]
    docs = [(i if i % 9 else None, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40, 300])))) for i in range(700)]
    docs += [(3000 + i % 4, docs[5][1]) for i in range(12)] + [(5000, " ".join(words))]  # ties, repeated ids and rows
    queries = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 8, 60])))) for i in range(80)]
    check(spark, docs, [*queries, queries[0], (81, docs[5][1])])


def test_cases(spark):
    docs = [(1, None), (2, ""), (3, " .,-\x7f "), (4, "Straße straße STRASSE"), (5, "one ONE One1 un-o"), (6, "été 北京 été"), (None, "one"), (None, "one"), (7, "x" * 300_000 + " one"), (8, "a " * 200_000 + "rare"), (9, "one")]
    queries = [(1, "ONE?"), (2, None), (3, ""), (4, "straße"), (5, "北京-été"), (None, "rare one"), (None, "uno un"), (6, "nowhere"), (6, "x" * 300_000), (7, "one " * 1000)]
    check(spark, docs, queries)
    check(spark, docs, queries, k=1)
    check(spark, [], queries)
    check(spark, docs, [])
    check(spark, [(1, None)], [(1, "one")])


def test_hot_word_and_many_queries(spark):
    rng = random.Random(2)
    docs = [(i, f"the the of {rng.choice('abc')} w{rng.randrange(50)} " + ("the " * (i % 7))) for i in range(2000)]
    check(spark, docs, [(i, f"the w{i % 60} {'abc'[i % 3]}") for i in range(150)])


@pytest.mark.parametrize("block", [1, 4, 128])
def test_blocks_skip_and_lose_nothing(monkeypatch, block):
    monkeypatch.setattr(ls, "BLOCK", block)
    monkeypatch.setattr(ls, "FIRST_LOOK", 4)
    rng = random.Random(block)
    words = [f"w{int(rng.paretovariate(0.5)) % 5000}" for _ in range(4000)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(60))) for _ in range(900)] + [""]
    texts[300] = " ".join(words[:25])
    some, all_ = sum(1 for t in texts if t), sum(len(t.split()) for t in texts)
    term, n, blocks, data = ls.postings_of([t.encode() for t in texts], some, all_)
    assert [len(b) // 12 for b in blocks.to_pylist()] == [-(-int(x) // block) for x in n]
    rows = {int(t): (b, d) for t, b, d in zip(term, blocks.to_pylist(), data.to_pylist(), strict=True)}
    holds = {int(t): int(x) for t, x in zip(term, n, strict=True)}
    opened = told = 0
    for query in [" ".join(words[:25]), *(" ".join(rng.sample(words, 6)) for _ in range(30))]:
        hashes = {int(h) for h in ls.hashed([query.encode()], ls.LETTERS, ls.LOWER)[0]}
        weights = {h: math.floor(1000 * math.log((2 * some + 2) / (2 * holds[h] + 1))) for h in hashes & holds.keys()}
        mine = [ls.Postings(w, *rows[h]) for h, w in weights.items()]
        if not mine:
            continue
        total = np.zeros(len(texts), np.int64)
        for t in mine:
            for b in range(len(t.last)):
                where, gain = ls.Postings(t.weight, np.stack([t.last, t.top // t.weight, t.end], 1).astype("<i4").tobytes(), t.data).block(b)
                assert where[-1] == t.last[b] and gain.max() == t.top[b]
                total[where] += gain
        want = [x for x in np.lexsort((np.arange(len(total)), -total))[:10] if total[x] > 0]
        places, scores = ls.best_of(mine, 10)
        assert places.tolist() == want and scores.tolist() == total[want].tolist()
        opened, told = opened + sum(len(t.open) for t in mine), told + sum(len(t.last) for t in mine)
    assert block == 128 or opened < 0.9 * told


def test_pack(monkeypatch):
    rng = random.Random(3)
    for values in ([], [0], [127, 128, 16383, 16384, 10**6, 2**40], [rng.randrange(1 << rng.randrange(1, 50)) for _ in range(2000)]):
        data, ends = ls.pack(np.array(values, np.int64))
        assert ls.unpack(data).tolist() == values and len(ends) == len(values)
