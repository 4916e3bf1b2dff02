import collections
import zlib

import numpy as np
import pyarrow as pa
import pytest

from basalt.llm import chars
from basalt.llm import language_id as li
from basalt.llm import toxicity as tox
from basalt.llm.language_id import fit_languages, identify, op2_language_id
from basalt.llm.toxicity import fit_toxicity, op5_toxicity, score_toxicity

SF = "/root/testdata/sf0.1"


def test_language_held_out_accuracy(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op2_language_id(spark, SF).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang_pred == docs[r.doc_id] for r in held) > 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(not r.accepted for r in rows) < 0.001 * len(rows)


def test_kneser_ney_sums_to_one():
    model = li.train(["the cat sat on the mat and the hat"] * 12 + ["le chat est sur la table"] * 12, ["en"] * 12 + ["fr"] * 12)
    symbols = np.arange(len(model["alphabet"]) + 2, dtype=np.uint64)
    for history in ((0, 0, 0), (2, 3, 4), (1, 1, 1)):
        g = np.zeros(len(symbols), np.uint64)
        for x in history:
            g = (g << np.uint64(16)) | np.uint64(x)
        for one in model["models"]:
            p = np.exp(li.log_probs(one, (g << np.uint64(16)) | symbols).astype(float)).sum()
            assert np.isclose(p, 1, atol=1e-5)


def test_models_hold_what_their_languages_have():
    """Memory follows each language's own n-grams; no language is left out, and a text of any of them is told."""
    rng = np.random.default_rng(5)
    words = {f"l{k:03d}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 8))) for _ in range(30)] for k in range(260)}
    texts = [(" ".join(rng.choice(w, 30)), lang) for lang, w in words.items() for _ in range(10)]
    model = li.train([t for t, _ in texts], [lang for _, lang in texts])
    assert model["langs"] == sorted(words)
    held = [sum(len(t.keys) for t in one["tables"].values()) for one in model["models"]]
    assert max(held) < 4 * 30 * 9 + 27 and not any(hasattr(t, "order") for t in model["models"][0]["tables"].values())
    asked = {lang: " ".join(rng.choice(w, 20)) for lang, w in words.items()}
    assert li.decide(model, *li.sums(model, list(asked.values()))[:3])[0] == list(asked)


def test_training_reads_bounded_letters(spark, monkeypatch):
    rows = [(i, ("the cat sat on the mat " if i % 2 else "le chat est sur la table ") * (400 if i % 10 < 2 else 1), ("fr", "en")[i % 2], "a") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    monkeypatch.setattr(li, "TRAIN_LETTERS", 2 * 3000)
    model = fit_languages(docs)
    assert model["langs"] == ["en", "fr"]
    assert all(r.lang_pred == r.lang for r in identify(docs, model, keep=("doc_id", "lang")).collect())


def test_junk_held_back_opens_no_gate():
    words = {"en": "the and with house from weather children water there going because morning small street found their", "fr": "les avec maison pour enfants matin petite rue trouver leur parce que nous allons dans toujours", "de": "und mit haus wetter kinder wasser gehen weil morgen kleine strasse finden ihre nicht immer durch"}
    rng = np.random.default_rng(2)
    texts = {k: [" ".join(rng.choice(w.split(), 40)) for _ in range(60)] for k, w in words.items()}
    for k in texts:
        texts[k][14] = "xq zkvjw qqxz wvkx jzzq " * 3  # the fifth of each five is held back
    model = li.train([t for k in texts for t in texts[k]], [k for k in texts for _ in texts[k]])
    foreign = ["bugün hava çok güzel ve çocuklarla birlikte yüzmek için plaja gidiyoruz çünkü parlıyor", "dzisiaj jest piekna pogoda idziemy na plaze zeby poplywac swieci slonce"]
    asked = [" ".join(rng.choice(f.split(), 40)) for f in foreign] + [" ".join(rng.choice(w.split(), 40)) for w in words.values()]
    assert li.decide(model, *li.sums(model, asked)[:3])[3].tolist() == [False, False, True, True, True]


def test_language_edges(spark):
    text = ["the cat sat on the mat and it was there", "le chat est sur la table et il dort"]
    rows = [(i, text[i % 2] + " x" * (i % 3), ("en", "fr")[i % 2], "a") for i in range(200)]
    odd = [(None, None, None, "b"), (300, "", "en", "b"), (301, "12 !? 34", None, "b"), (302, "Привет как дела мой друг и брат", None, "b"), (303, text[1] * 50_000, "fr", "b")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    out = {r.doc_id: r for r in identify(docs, fit_languages(docs)).collect()}
    assert len(out) == 205
    for k in (None, 300, 301):
        assert out[k].lang_pred == "und" and out[k].score == 0 and not out[k].accepted
    assert not out[302].accepted and out[303].lang_pred == "fr"
    assert all(out[i].lang_pred == ("en", "fr")[i % 2] for i in range(200))
    nothing = docs.limit(0)
    assert identify(nothing, fit_languages(nothing)).count() == 0
    assert {r.lang_pred for r in identify(docs, fit_languages(nothing)).collect()} == {"und"}


def test_toxicity_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op5_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def worst_slowly(text: str, table: np.ndarray) -> float:
    """The same score word by word, in plain Python."""
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    logits = []
    for w in words:
        padded, total = [0, *map(ord, w), 0], []
        for k in tox.GRAMS:
            for i in range(len(padded) - k + 1):
                h = 0
                for j, c in enumerate(padded[i : i + k]):
                    h = c if j == 0 else (h * int(tox.P) + c) & 0xFFFFFFFFFFFFFFFF
                total.append(table[((h ^ (k - 1)) * int(tox.MIX) & 0xFFFFFFFFFFFFFFFF) >> (64 - tox.BUCKET_BITS)])
        logits.append(sum(total) / len(total) if total else 0.0)
    windows = [logits[i : i + tox.WINDOW] for i in range(len(logits))]
    return max((sum(w) / len(w) for w in windows), default=-np.inf)


def test_toxicity_scores_like_brute_force():
    table = np.random.default_rng(1).normal(size=1 << tox.BUCKET_BITS)
    texts = ["A bad, bad cat!", "", "x", "Ünïcode wörds 123 and_more", "one two three four five six seven"]
    assert np.allclose(tox.worst(texts, table), [worst_slowly(t, table) for t in texts])


def test_toxicity_edges(spark):
    rng = np.random.default_rng(3)
    words = ["tree", "river", "stone", "cloud", "grass", "light", "house", "water"]
    rows = [(i, " ".join(rng.choice(words, 30)) + (" awful scumbag" if i % 4 == 0 else ""), "x") for i in range(600)]
    docs = spark.createDataFrame([*rows, (700, None, "x"), (701, "", "x"), (702, "tree " * 300_000 + "scumbagg", "x"), (None, "river", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = fit_toxicity(docs, labels)
    out = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    assert len(out) == 604
    assert [out[k].predicted for k in (700, 701, None, 702)] == [0, 0, 0, 1]
    assert sum(out[i].predicted == int(i % 4 == 0) for i in range(600)) > 590
    empty = fit_toxicity(docs, labels.limit(0))
    assert {r.predicted for r in score_toxicity(docs, empty).collect()} == {0}
    assert score_toxicity(docs.limit(0), model).count() == 0


LONG = ["A bad, bad cat! " * 40, "word", "", "ab1cd2 ef_gh  \n ij-kl " * 30 + "tail", None, "x" * 500 + " yes no", "éa b " * 99, "one two three four", "\t \n" * 300 + "z"]


@pytest.mark.parametrize("size", [7, 50, 333])
def test_pieces_read_like_the_whole(size):
    table = np.random.default_rng(1).normal(size=1 << tox.BUCKET_BITS)
    model = li.train(["the bad cat sat on a mat"] * 12 + ["le chat est sur la table"] * 12, ["en"] * 12 + ["fr"] * 12)
    whole, found, last = tox.worst([x or "" for x in LONG], table), tox.Worst(len(LONG), table), None
    sums = [np.zeros((len(LONG), 2)), np.zeros(len(LONG)), np.zeros(len(LONG))]
    steps = list(chars.steps(pa.array(LONG), size))
    assert len(steps) > 5 and ["".join(p for r, ps, _ in steps for r, p in zip(r, ps, strict=True) if r == k) for k in range(len(LONG))] == [x or "" for x in LONG]
    for rows, parts, goes_on in steps:
        found.feed(rows, parts, goes_on)
        *out, last = li.sums(model, parts, last if goes_on else None)
        for a, b in zip(sums, out, strict=True):
            np.add.at(a, rows, b)
    assert np.allclose(found.result(), whole)
    for a, b in zip(sums, li.sums(model, [x or "" for x in LONG]), strict=False):
        assert np.allclose(a, b, rtol=1e-5)


def test_a_word_before_changes_no_window():
    table = np.random.default_rng(5).normal(size=1 << tox.BUCKET_BITS)
    scores = tox.worst(["vile nasty scum good", "good vile nasty scum good", "good good vile nasty scum good"], table)
    alone = tox.worst(["vile nasty scum"], table)[0]
    assert (scores >= alone - 1e-9).all()


@pytest.mark.parametrize(("texts", "labels"), [(["", " "], [0, 1]), (["", "word"], [1, 0]), ([], []), (["a", "b"], [1, 1]), (["a b c d", "e"], [0, 1]), (["?", "!", "a"], [0, 1, 1])])
def test_training_rows_without_words(texts, labels):
    model = tox.train(texts, np.array(labels, int))
    assert np.isfinite([model["scale"], model["shift"], model["floor"]]).all()


def kneser_ney_slowly(texts: dict, alphabet: list[int]) -> dict:
    """Probability of (history, symbol) by language, with dictionaries."""
    number = {c: i + 2 for i, c in enumerate(alphabet)}
    counts = {}
    for lang, own in texts.items():
        top = collections.Counter()
        for t in own:
            s = [0, 0, 0] + [number.get(ord(c), 1) if c.isalpha() else 0 for c in " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split())] + [0]
            top.update(tuple(s[i - 3 : i + 1]) for i in range(3, len(s)))
        counts[lang] = {4: top}
        for k in (3, 2, 1):
            counts[lang][k] = collections.Counter(g[1:] for g in counts[lang][k + 1])
    seen = {k: {g for c in counts.values() for g in c[k]} for k in (1, 2, 3)}

    def p(lang, history, w):
        k, c = len(history) + 1, counts[lang][len(history) + 1]
        low = 1 / (len(alphabet) + 2) if k == 1 else p(lang, history[1:], w)
        if k > 1 and history not in seen[k - 1]:
            return low
        of = [n for g, n in c.items() if g[:-1] == history]
        if not of:
            return low
        n1, n2 = (sum(n == x for n in c.values()) for x in (1, 2))
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        return max(0, c[(*history, w)] - d) / sum(of) + d * len(of) / sum(of) * low

    return p


def test_kneser_ney_is_that_of_dictionaries():
    texts = {"en": ["the cat sat on the mat, and the hat", "a rat"] * 4 + ["that is that"], "fr": ["le chat est sur la table", "le rat"] * 4 + ["où est le"]}
    model = li.train([t for own in texts.values() for t in own], [k for k, own in texts.items() for _ in own])
    p = kneser_ney_slowly({k: own for k, own in texts.items()}, [int(x) for x in model["alphabet"]])
    size = len(model["alphabet"]) + 2
    rng = np.random.default_rng(0)
    for _ in range(300):
        g = rng.integers(0, size, 4) if rng.random() < 0.3 else np.array([0, 0, *rng.integers(0, size, 2)])
        packed = np.zeros(1, np.uint64)
        for x in g:
            packed = (packed << np.uint64(16)) | np.uint64(x)
        got = np.array([np.exp(float(li.log_probs(one, packed)[0])) for one in model["models"]])
        assert np.allclose(got, [p(lang, tuple(int(x) for x in g[:3]), int(g[3])) for lang in model["langs"]], rtol=1e-4)


def test_languages_tie_by_name():
    text = ["same words here and there again"] * 10
    model = li.train(text + text, ["b"] * 10 + ["a"] * 10)
    assert li.decide(model, *li.sums(model, text[:1])[:3])[0] == ["a"]


def test_columns_kept_may_not_clash(spark):
    docs = spark.createDataFrame([(1, "text", 0.5)], "doc_id long, text string, score double")
    with pytest.raises(ValueError, match="score"):
        score_toxicity(docs, tox.train([], np.zeros(0, int)), keep=("doc_id", "score"))
    with pytest.raises(ValueError, match="score"):
        identify(docs, li.train([], []), keep=("Score",))
