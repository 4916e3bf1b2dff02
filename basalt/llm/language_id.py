"""Language identification by interpolated Kneser-Ney character models, one for each language.

A model of order 4 is trained for each language: absolute discounts, continuation counts below the top
order, a uniform distribution at the bottom. It holds a sorted array of hashed n-grams for each order, its own ones
only, so memory grows with what each language has, not with n-grams times languages. All share one vocabulary,
so texts are spelt once, and distinct n-grams are looked up in one model after the other. A text gets the language of the lowest cross-entropy per character. Texts whose cross-entropy
is far from what the language's own held-back texts showed are rejected (accepted = false).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm.chars import runs, steps
from basalt.llm.common import frugal, hash_fold, known

ORDER = 4
#: Labelled rows of each language that training reads at most, and of all together as long as each has its LEAST_ROWS.
TRAIN_ROWS, TRAIN_TOTAL, LEAST_ROWS = 600, 20_000, 10
#: Letters of all the texts that training reads, shared out evenly; a language's first text counts however long it is.
TRAIN_LETTERS = 64 << 20
#: Languages up to which their shares are broadcast; of more, rows meet them by a shuffle.
SHARES = 100_000
#: Letters told apart, the most frequent ones of the training texts; an n-gram is packed 16 bits a letter.
LETTERS = (1 << 16) - 2
MIX = np.uint64(0x9E3779B97F4A7C15)  # odd, so that the hash of a packed n-gram is one to one
#: How sharply differences of cross-entropy (nats a character) turn into a score.
SHARPNESS = 20.0
#: Rejection lies this many times beyond the spread seen in calibration, plus a margin in nats a character.
REJECT_TIMES, REJECT_MARGIN = 2.0, 0.35
#: The share of held-back texts taken as usual ones, and of texts of other languages at which they are said to begin.
USUAL, FOREIGN = 0.9, 0.1
#: The share of the way to texts of other languages that is never rejected.
OPEN = 0.3


def spell(codes: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Numbers of characters: 0 for the gap between words, from 2 as in the alphabet, 1 for others."""
    at = np.minimum(np.searchsorted(alphabet, codes), len(alphabet) - 1)
    return np.where(codes == 0, 0, np.where(alphabet[at] == codes, at + 2, 1)).astype(np.uint64)


def packed(symbols: np.ndarray, k: int) -> np.ndarray:
    """The k-gram that ends at each place, 16 bits a symbol; places before ORDER - 1 lead in and are left out."""
    n = len(symbols) - (ORDER - 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out << np.uint64(16)) | symbols[ORDER - k + j : ORDER - k + j + n]
    return out


def suffix(grams: np.ndarray, k: int) -> np.ndarray:
    return grams & np.uint64((1 << (16 * k)) - 1)


class Table:
    """A sorted array of hashes with a directory by their first bits, so that a search takes a few steps."""

    def __init__(self, grams: np.ndarray):
        hashes = grams * MIX
        self.order = np.argsort(hashes)
        self.keys = hashes[self.order]
        self.shift = np.uint64(64 - max(4, len(grams).bit_length() + 2))
        tops = np.arange(1 << int(64 - self.shift), dtype=np.uint64) << self.shift
        self.begin = np.searchsorted(self.keys, tops).astype(np.int32)
        self.longest = int(np.max(np.diff(np.append(self.begin, len(grams))), initial=0))

    def find(self, grams: np.ndarray) -> np.ndarray:
        """The place of each in the array, -1 where there is none."""
        h = grams * MIX
        at = self.begin[h >> self.shift]
        last = len(self.keys) - 1
        for _ in range(self.longest):
            at += self.keys[np.minimum(at, last)] < h
        at = np.minimum(at, last)
        return np.where(self.keys[at] == h, at, -1)


def kneser_ney(stream: np.ndarray, size: int) -> dict:
    """The model of a language by its 4-grams: tables[k], logp[k] (of each k-gram) and gamma[k] (what a k-gram as context leaves to shorter ones)."""
    counts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    grams, c = np.unique(stream, return_counts=True)
    for k in range(ORDER, 0, -1):
        counts[k] = grams, c.astype(float)
        grams, c = np.unique(suffix(grams, k - 1), return_counts=True)  # the kinds of longer n-grams that end so
    tables, probs, gammas = {}, {}, {}
    for k in range(1, ORDER + 1):
        grams, c = counts[k]
        tables[k] = Table(grams)
        grams, c = grams[tables[k].order], c[tables[k].order]
        n1, n2 = np.sum(c == 1), np.sum(c == 2)
        discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        contexts = 1 if k == 1 else len(tables[k - 1].keys)
        shorter = np.full(len(grams), 1.0 / size) if k == 1 else probs[k - 1][tables[k - 1].find(suffix(grams, k - 1))]
        ctx = np.zeros(len(grams), int) if k == 1 else tables[k - 1].find(grams >> np.uint64(16))
        known = ctx >= 0  # a context that isn't an n-gram itself (the lead-in) is left to shorter ones
        total, kinds = np.bincount(ctx[known], c[known], contexts), np.bincount(ctx[known], minlength=contexts)
        leave = np.where(total > 0, discount * kinds / np.maximum(total, 1e-300), 1.0)
        probs[k] = np.where(known, np.maximum(c - discount, 0) / np.maximum(total[ctx], 1e-300), 0.0) + np.where(known, leave[ctx], 1.0) * shorter
        gammas[k - 1] = leave
    for table in tables.values():
        del table.order
    return {"size": size, "tables": tables, "logp": {k: np.log(probs[k]).astype(np.float32) for k in tables}, "gamma": {k: np.log(gammas[k]).astype(np.float32) for k in gammas}}


def log_probs(one: dict, grams: np.ndarray, k: int = ORDER) -> np.ndarray:
    """Log probability, in the model of one language, of the last symbol of each k-gram."""
    if k == 0:
        return np.full(len(grams), -np.log(one["size"]), np.float32)
    at = one["tables"][k].find(grams)
    out = one["logp"][k][at]
    missing = np.flatnonzero(at < 0)
    if len(missing):
        rest = grams[missing]
        low = log_probs(one, suffix(rest, k - 1), k - 1)
        if k == 1:
            low = low + one["gamma"][0]
        else:
            ctx = one["tables"][k - 1].find(rest >> np.uint64(16))
            low = low + np.where(ctx >= 0, one["gamma"][k - 1][ctx], 0)
        out[missing] = low
    return out


def sums(model: dict, parts: list[str], before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sum of log probabilities by language, characters, letters) of each part, and the last codes, for a part that goes on."""
    codes, part, first = runs(parts, digits=False, lead=ORDER - 1, before=before)
    symbols = spell(codes, model["alphabet"])
    # the symbol at place i + ORDER - 1 has row i; the lead-in of each part isn't predicted
    part = part[ORDER - 1 :]
    own = np.ones(len(part), bool)
    for j in range(ORDER - 1):
        at = first + j - (ORDER - 1)
        own[at[at >= 0]] = False
    kinds, of = np.unique(packed(symbols, ORDER)[own], return_inverse=True)
    total = np.stack([np.bincount(part[own], log_probs(one, kinds)[of], len(parts)) for one in model["models"]], 1)
    return total, np.bincount(part[own], minlength=len(parts)), np.bincount(part[own & (symbols[ORDER - 1 :] > 0)], minlength=len(parts)), codes[1 - ORDER :]


def train(texts: list[str], langs: list[str]) -> dict:
    """The model of labelled texts; a fifth of each language is held back to calibrate rejection."""
    if not texts:
        return {"langs": []}
    order = np.arange(len(texts))
    streams, alphabet = {}, []
    each = {}
    for lang in sorted(set(langs)):
        own = [i for i in order if langs[i] == lang]
        fit = [texts[i] for n, i in enumerate(own) if n % 5 != 4 or len(own) < 10]
        codes, _, first = runs(fit, digits=False, lead=ORDER - 1)
        each[lang] = (codes, first, [texts[i] for n, i in enumerate(own) if n % 5 == 4] or fit)
        alphabet.append(np.unique(codes[codes > 0], return_counts=True))
    letters, of = np.unique(np.concatenate([a for a, _ in alphabet]), return_inverse=True)
    if not len(letters):
        return {"langs": []}
    times = np.bincount(of, np.concatenate([n for _, n in alphabet]))
    letters = np.sort(letters[np.argsort(-times, kind="stable")[:LETTERS]]).astype(np.uint64)
    for lang, (codes, first, _) in each.items():
        grams = packed(spell(codes, letters), ORDER)
        own = np.ones(len(grams), bool)
        for j in range(ORDER - 1):
            at = first + j - (ORDER - 1)
            own[at[at >= 0]] = False
        streams[lang] = grams[own]
    names, size = sorted(streams), len(letters) + 2
    model = {"langs": names, "size": size, "alphabet": letters, "models": [kneser_ney(streams.pop(x), size) for x in names]}
    centre, reach = [], []
    held = [sums(model, each[lang][2])[:2] for lang in model["langs"]]
    for j, (total, n) in enumerate(held):
        some = n > 0
        h = -total[some, j] / n[some] if some.any() else np.array([np.log(model["size"])])
        weight = n[some] if some.any() else np.ones(1)
        centre.append(np.average(h, weights=np.minimum(weight, 1000)))  # one long text is no more usual than others
        own = (h - centre[-1]) * np.sqrt(weight / (weight + 50.0))
        limit = lambda x: max(0.0, x) * REJECT_TIMES + REJECT_MARGIN
        # a held-back text may be junk or mislabelled, so the worst of them counts only up to where texts of other languages begin
        foreign = [(-t[m > 0, j] / m[m > 0] - centre[-1]) * np.sqrt(m[m > 0] / (m[m > 0] + 50.0)) for k, (t, m) in enumerate(held) if k != j]
        foreign = np.concatenate(foreign) if foreign else np.zeros(0)
        unlike = np.quantile(foreign, FOREIGN) if len(foreign) else np.log(model["size"]) - centre[-1]
        # and few held-back texts may lie close together by chance: a part of the way to other languages is always open
        reach.append(max(min(limit(own.max()), max(limit(np.quantile(own, USUAL)), unlike)), OPEN * unlike))
    return model | {"centre": np.array(centre), "reach": np.array(reach)}


def decide(model: dict, total: np.ndarray, n: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, cross-entropy, accepted) of each text."""
    und = (letters == 0) | (not model["langs"])
    if not model["langs"]:
        nothing = np.zeros(len(n))
        return ["und"] * len(n), nothing, nothing, ~und
    h = -total / np.maximum(n, 1)[:, None]
    best = np.argmin(h, axis=1)
    rows = np.arange(len(n))
    score = 1 / np.exp(-SHARPNESS * (h - h[rows, best][:, None])).sum(1)
    over = (h[rows, best] - model["centre"][best]) * np.sqrt(n / (n + 50.0))
    return ["und" if u else model["langs"][b] for u, b in zip(und, best, strict=True)], np.where(und, 0.0, score), np.where(und, 0.0, h[rows, best]), ~und & (over <= model["reach"][best])


def fit_languages(docs: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """Train on at most `rows` texts of each language, those first by a hash of their id.

    Rows of the held-out fold, null languages and null texts are never read. Languages are counted over
    all rows; a threshold on the hash then leaves about `rows` of each, and a window cuts to the bound.
    Every language is learned, of at most TRAIN_TOTAL rows over their number, but LEAST_ROWS, and TRAIN_LETTERS over
    their number. So the models grow with the number of languages, but not with rows or texts. Repeated rows count as often; texts of a hash go by their own. No rows: no languages.
    """
    labelled = docs.where((hash_fold() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    spot = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1) / F.lit(float(1 << 63))
    common = labelled.groupBy("lang").count()
    languages = max(1, common.count())
    rows = min(rows, max(LEAST_ROWS, TRAIN_TOTAL // languages))
    shares = common.select("lang", (1.3 * rows / F.col("count")).alias("share"))
    shares = F.broadcast(shares) if languages <= SHARES else shares
    in_lang = Window.partitionBy("lang").orderBy("spot", "doc_id", "key")
    sample = (
        labelled.select("doc_id", "lang", "text", spot.alias("spot")).join(shares, "lang").where("spot < share or share >= 1")
        .withColumn("key", F.xxhash64("text")).withColumn("nth", F.row_number().over(in_lang)).where(F.col("nth") <= rows)
        .withColumn("letters", F.sum(F.char_length("text").cast("long")).over(in_lang.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .where((F.col("nth") == 1) | (F.col("letters") <= TRAIN_LETTERS // languages))
        .select("lang", "text", "spot", "key")
    )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: (r[0], r[2], r[3]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([r[1] for r in rows], [r[0] for r in rows]))], pa.binary())], names=["model"])

    found = sample.coalesce(1).mapInArrow(frugal(fit), "model binary").collect()  # one row; n-grams of a bounded sample
    return pickle.loads(found[0][0]) if found else train([], [])


def identify(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns, lang_pred, score (0 to 1), entropy (nats a character), accepted for every whole text.

    Null texts and texts without letters: `und`, score 0, not accepted. Only the text is read. Ties go to
    the language first in order. Repeated rows come out alike. Empty table: no rows. If nothing could be
    learned, all are `und`. A long text is read in pieces, the context of each carried from the one before, which
    gives what the whole would. `keep` must not name an output column.
    """
    known(keep, "lang_pred", "score", "entropy", "accepted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            size = batch.num_rows
            total, n, letters = np.zeros((size, max(1, len(m["langs"])))), np.zeros(size), np.zeros(size)
            if m["langs"]:
                last = None
                for rows, parts, goes_on in steps(batch.column(batch.num_columns - 1)):
                    a, b, c, last = sums(m, parts, last if goes_on else None)
                    np.add.at(total, rows, a)
                    np.add.at(n, rows, b)
                    np.add.at(letters, rows, c)
            lang, score, entropy, accepted = decide(m, total, n, letters)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score), pa.array(entropy), pa.array(accepted)], names=[*keep, "lang_pred", "score", "entropy", "accepted"])

    kept = docs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", lang_pred string, score double, entropy double, accepted boolean"
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(frugal(run), schema)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """identify over all documents, learned from those not held out; its cases hold. Null ids are a fold of their own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit_languages(docs)).select("doc_id", (hash_fold() == 0).alias("held_out"), "lang_pred", "score", "accepted")
