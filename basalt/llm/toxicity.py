"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character 3- to 6-grams, its ends marked, hashed into buckets; each bucket has
an embedding. Words average their buckets, windows of `WINDOW` words average their words, and a softmax
of two classes reads that average. A window begins at every word, and a text is as toxic as its worst one,
so a few words in a long text count in full wherever they stand, and a misspelling never seen shares most
of its n-grams with the word it hides. The last windows of a text hold the words that are left.
Training follows the worst window of each text, embeddings and softmax together.

Since the softmax is linear, scoring needs one number a bucket, the difference of its two logits.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.chars import runs, steps
from basalt.llm.common import frugal, hash_fold, known

BUCKET_BITS, DIM, WINDOW, GRAMS = 20, 8, 3, (3, 4, 5, 6)
#: Learning rate, and what each bucket's sum of squared gradients begins with: rare n-grams move little.
RATE, DAMP = 1.0, 1e-3
#: Labelled rows that training reads at most: toxic, clean.
TRAIN_ROWS = (1200, 2400)
P, MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def grams(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, word) of each n-gram, (part of each word)."""
    codes, part, _ = runs(parts, digits=True, lead=1)
    n = len(codes)
    zero = codes == 0
    at = np.where(zero, np.arange(n), n)
    after = np.minimum.accumulate(at[::-1])[::-1]
    after = np.append(after[1:], n)  # the first 0 behind each place
    word = np.cumsum(zero) - 1  # a word's grams begin at the 0 before it at the earliest
    filled = np.zeros(word[-1] + 1, bool)
    filled[word[~zero]] = True
    number = np.cumsum(filled) - 1
    h, buckets, words = codes.copy(), [], []
    for k in range(1, min(max(GRAMS), n)):
        h = h[: n - k] * P + codes[k:]
        if k + 1 in GRAMS:
            fits = np.flatnonzero((np.arange(n - k) + k <= after[: n - k]) & filled[word[: n - k]])
            buckets.append((((h[fits] ^ np.uint64(k)) * MIX) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
            words.append(number[word[fits]].astype(np.int32))
    nothing = [np.zeros(0, np.int32)]
    return np.concatenate(buckets or nothing), np.concatenate(words or nothing), part[np.flatnonzero(zero)][filled]


def word_logits(parts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(logit, part) of each word."""
    bucket, word, part = grams(parts)
    return np.bincount(word, table[bucket], len(part)) / np.maximum(1, np.bincount(word, minlength=len(part))), part


class Worst:
    """The largest window logit of each row of a batch, fed with parts of texts; -inf without words."""

    def __init__(self, rows: int, table: np.ndarray):
        self.table, self.top, self.last = table, np.full(rows, -np.inf), [np.zeros(0)] * rows

    def feed(self, rows: list[int], parts: list[str], goes_on: bool) -> None:
        rows = np.array(rows)
        logit, part = word_logits(parts, self.table)
        own = rows[part]
        if goes_on:  # windows that began in the piece before
            tail = self.last[rows[0]]
            logit, own = np.append(tail, logit), np.append(np.full(len(tail), rows[0]), own)
        if len(logit) >= WINDOW:
            full = own[WINDOW - 1 :] == own[: 1 - WINDOW]
            mean = sum(logit[k : len(logit) - WINDOW + 1 + k] for k in range(WINDOW)) / WINDOW
            np.maximum.at(self.top, own[: 1 - WINDOW][full], mean[full])
        first, end = np.searchsorted(own, rows), np.searchsorted(own, rows, side="right")
        for row, a, b in zip(rows.tolist(), first.tolist(), end.tolist(), strict=True):
            self.last[row] = logit[max(a, b - WINDOW + 1) : b]

    def result(self) -> np.ndarray:
        rest = [max((x[k:].mean() for k in range(len(x))), default=-np.inf) for x in self.last]
        return np.maximum(self.top, rest)


def worst(parts: list[str], table: np.ndarray) -> np.ndarray:
    found = Worst(len(parts), table)
    found.feed(list(range(len(parts))), parts, False)
    return found.result()


def train(texts: list[str], labels: np.ndarray, epochs: int = 16, seed: int = 7, batch: int = 512) -> dict:
    """The model: table (a logit a bucket), scale and shift that make a text's worst logit a probability.

    Windows are laid end to end for training. Each epoch takes the two worst of each text, and of clean ones some drawn at random; the first
    epochs only draw for toxic texts, to find what sets them apart. A fifth of the texts is left for calibration.
    """
    rng = np.random.default_rng(seed)
    positive, n = int(labels.sum()), len(labels)
    model = {"table": np.zeros(1 << BUCKET_BITS, np.float32), "scale": 1.0, "shift": -4.0, "floor": 0.0}
    if not positive or positive == n:
        model["shift"] = 4.0 if positive else -4.0
        return model
    texts = [t or "" for t in texts]
    ids: dict[str, int] = {}
    spelt, begin, size, part, at_word = [], [], [], [], 0
    for doc, text in enumerate(texts):
        codes, _, _ = runs([text], digits=True, lead=1)
        words = [ids.setdefault(w, len(ids)) for w in codes.astype(np.uint32).tobytes().decode("utf-32-le").replace("\0", " ").split()]
        spelt.append(np.array(words, np.int32))
        laid = np.arange(0, len(words), WINDOW)
        begin.append(at_word + laid)
        size.append(np.minimum(WINDOW, len(words) - laid).astype(np.int32))
        part.append(np.full(len(laid), doc, np.int32))
        at_word += len(words)
    word, begin, size, part = (np.concatenate(x) for x in (spelt, begin, size, part))
    if len(set(labels[np.unique(part)].tolist())) < 2:  # words on one side at most: nothing to learn from
        return model
    vocabulary, found = list(ids), []
    for k in range(0, len(vocabulary), 4096):
        b, w, _ = grams(vocabulary[k : k + 4096])
        order = np.argsort(w, kind="stable")
        found.append((b[order], w[order] + np.int32(k)))
    bucket, of_word = (np.concatenate(x) for x in zip(*found, strict=True))
    count = np.bincount(of_word, minlength=len(ids))
    at = np.append(0, np.cumsum(count))

    n_words = len(ids)
    del ids, vocabulary, found

    def logits(table: np.ndarray) -> np.ndarray:
        per_word = np.zeros(n_words)
        for k in range(0, n_words, 1 << 16):  # in parts, for the memory
            a, b = at[k], at[min(k + (1 << 16), n_words)]
            per_word[k : k + (1 << 16)] = np.bincount(of_word[a:b] - k, table[bucket[a:b]], min(1 << 16, n_words - k))
        per_word /= np.maximum(count, 1)
        total = np.append(0, np.cumsum(per_word[word]))
        return (total[begin + size] - total[begin]) / size

    first = np.searchsorted(part, np.arange(n + 1))
    has = np.flatnonzero(first[1:] > first[:-1])
    rng.shuffle(has)
    held, has = has[: len(has) // 5], has[len(has) // 5 :]
    share = 0.5 * len(has) / np.maximum(1, np.bincount(labels[has], minlength=2))

    e = rng.normal(0, 0.02, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    u = rng.normal(0, 0.5, (DIM, 2))
    bias, seen, seen_u = np.zeros(2), np.full(1 << BUCKET_BITS, DAMP), np.full((DIM, 2), 1e-3)
    batch = min(batch, max(32, len(has) // 4))
    for epoch in range(max(epochs, min(4 * epochs, 20_000 // len(has)))):
        logit = logits(e @ (u[:, 1] - u[:, 0]))
        chosen, of = [], []
        for doc in rng.permutation(has):
            a, b = first[doc], first[doc + 1]
            worst_two = a + np.argsort(logit[a:b])[-2:]
            drawn = rng.integers(a, b, 3)
            picked = set(rng.integers(a, b, 10) if epoch < 6 else worst_two) if labels[doc] else {*worst_two, *drawn}
            chosen += picked
            of += [doc] * len(picked)
        chosen, of = np.array(chosen), np.array(of)
        each = np.bincount(of, minlength=n)
        for k in range(0, len(chosen), batch):
            ws, docs = chosen[k : k + batch], of[k : k + batch]
            y = labels[docs]
            places = np.concatenate([np.arange(begin[w], begin[w] + size[w]) for w in ws])
            row, words = np.repeat(np.arange(len(ws)), size[ws]), word[places]
            spans = count[words]
            v = np.repeat(1.0 / (np.maximum(spans, 1) * size[ws][row]), spans)
            row = np.repeat(row, spans)
            b = bucket[np.arange(spans.sum()) + np.repeat(at[words] - np.append(0, np.cumsum(spans)[:-1]), spans)]
            ev = e[b] * v[:, None]
            mean = np.stack([np.bincount(row, ev[:, d], len(ws)) for d in range(DIM)], 1)
            z = mean @ u + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - np.eye(2)[y]) * (share[y] / np.sqrt(each[docs]))[:, None]
            back = g @ u.T
            touched, place = np.unique(b, return_inverse=True)
            de = np.stack([np.bincount(place, back[row, d] * v, len(touched)) for d in range(DIM)], 1)
            seen[touched] += (de**2).sum(1)
            e[touched] -= (RATE * de / np.sqrt(seen[touched])[:, None]).astype(np.float32)
            du = mean.T @ g
            seen_u += du**2
            u -= 0.05 * du / np.sqrt(seen_u)
            bias -= 0.02 * g.mean(0)
    model["table"] = e @ (u[:, 1] - u[:, 0]).astype(np.float32)
    doc = np.flatnonzero(first[1:] > first[:-1])
    top = np.concatenate([worst([texts[i] for i in doc[k : k + 64]], model["table"]) for k in range(0, len(doc), 64)])
    model["floor"] = float(np.median(top[labels[doc] == 0]))
    fit = np.isin(doc, held) if min(labels[held].sum(), len(held) - labels[held].sum()) >= 10 else np.ones(len(doc), bool)
    model["scale"], model["shift"] = calibrate(top[fit], labels[doc][fit])
    return model


def calibrate(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic fit of labels by logits with smoothed targets, so that separable classes give finite slopes."""
    positive, negative = y.sum(), len(y) - y.sum()
    goal = np.where(y == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    centre, spread = logit.mean(), logit.std() + 1e-9
    x = np.stack([(logit - centre) / spread, np.ones(len(y))], 1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - goal) + 1e-3 * w)
        w -= np.clip(step, -2, 2)
    return float(w[0] / spread), float(w[1] - w[0] * centre / spread)


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: tuple[int, int] = TRAIN_ROWS) -> dict:
    """Train on at most `rows` toxic and clean labelled rows, those first by a hash of their id.

    Rows of the held-out fold, null texts and null labels are never read; an id with several labels
    counts as toxic if any is. Training runs in one task over that bounded sample.
    """
    spark = docs.sparkSession
    marked = labels.where((hash_fold() != 0) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = marked.where("toxic = 0").orderBy(*order).limit(rows[1]).union(marked.where("toxic = 1").orderBy(*order).limit(rows[0]))
    sample = (
        docs.select("doc_id", "text").where(F.col("text").isNotNull())
        .join(F.broadcast(picked), "doc_id")  # at most sum(rows) ids
        .orderBy(F.xxhash64("doc_id"), "doc_id", F.md5(F.col("text").cast("binary"))).limit(sum(rows))
        .select("text", "toxic")
    )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            marks += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, np.array(marks, int)))], pa.binary())], names=["model"])

    found = sample.coalesce(1).mapInArrow(frugal(fit), "model binary").collect()  # one row of fixed size
    return pickle.loads(found[0][0]) if found else train([], np.zeros(0, int))


def score_toxicity(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns, score (0 to 1) and predicted (1 if score >= 0.5) for every whole text.

    Null texts and texts without words score as an ordinary clean text. Nothing but the text is read.
    Repeated rows score alike. Empty table: no rows. A long text is read in pieces, whose windows go on over the
    cuts, so it scores as the whole would. `keep` must not name an output column.
    """
    known(keep, "score", "predicted")
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast({**model, "table": model["table"].astype(np.float32)})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = Worst(batch.num_rows, m["table"])
            for rows, parts, goes_on in steps(batch.column(batch.num_columns - 1)):
                found.feed(rows, parts, goes_on)
            top = found.result()
            top[np.isneginf(top)] = m["floor"]
            s = 1 / (1 + np.exp(-np.clip(m["scale"] * top + m["shift"], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    kept = docs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", score double, predicted int"
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(frugal(score), schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """score_toxicity over all documents, learned from labels not held out; its cases hold. Null ids are a fold of their own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select("doc_id", (hash_fold() == 0).alias("held_out"), "score", "predicted")
