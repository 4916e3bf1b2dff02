"""Removal of passages that repeat, by compaction of a de Bruijn graph of words.

An edge of the graph is a window of `width` words, its ends are the windows' first and last width - 1 words.
Consecutive edges are compacted before anything is shuffled: a path is a run of windows that share their
minimizer (the least hash among their `KMER`-word parts, the leftmost of equal ones). Equal windows have equal
minimizers, so what repeats always meets under one minimizer, and a minimizer found once in all texts tells that
none of its windows repeats. Joins in Spark then go from coarse to fine:

* minimizers found more than once are kept, and counted by aggregates of constant size;
* paths are joined with the first coordinate of their kind (minimizer and words). A path that isn't the first of
  its kind goes whole;
* where paths of different kinds share a minimizer the graph branches. The first path of each such kind, one
  for all its copies, is taken apart into edges, which are joined with their first coordinates in turn.

Coordinates (document, word) say which edges go; in each document the words under them are cut. So the work on
single windows is done once for each distinct passage, not for each of its copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import drop, frugal, known, materialise
from basalt.llm.shingles import mix
from basalt.llm.terms import by_bytes, hashed

#: Words of a window that is looked for, and of the parts that minimizers are taken from.
WIDTH, KMER = 20, 6
#: Bytes of texts worked on at a time.
SLICE = 1 << 22
STEP, BACK = np.uint64(0xD6E8FEB86659FD93), np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


class Spans:
    """Hashes of any span of words of texts laid end to end, in constant time each."""

    def __init__(self, words: np.ndarray):
        self.down = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(words), BACK)))
        up = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(words), STEP)))
        self.total = np.append(np.uint64(0), np.cumsum(words * up[:-1], dtype=np.uint64))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values the place of the least one, the leftmost of equal ones."""
    at, size = np.arange(len(values)), 1
    while size < width:
        shift = min(size, width - size)
        a, b = at[:-shift], at[shift:]
        at = np.where(values[a] <= values[b], a, b)
        size += shift
    return at


class Paths:
    """The paths of some texts: of which text, first window, windows, times repeated end to end, hash of words, minimizer."""

    def __init__(self, texts: list[bytes], width: int):
        words, owner = hashed(texts)
        self.first = np.searchsorted(owner, np.arange(len(texts) + 1))
        if len(words) < width:
            self.text = self.start = self.length = self.times = np.zeros(0, np.int64)
            self.kind = self.least = np.zeros(0, np.uint64)
            return
        self.spans = Spans(words)
        k = min(KMER, width)
        place = np.arange(len(words) - k + 1)
        parts = self.spans.of(place, place + k)
        at = leftmost_least(parts, width - k + 1)
        whole = owner[: len(at)] == owner[width - 1 :]
        fresh = np.append(True, (at[1:] != at[:-1]) | ~whole[:-1])
        start = np.flatnonzero(whole & fresh)
        end = np.append(np.flatnonzero(~whole | fresh), len(at))
        end = end[np.searchsorted(end, start, side="right")]
        kind = self.spans.of(start, end + width - 1)
        # the same path again and again, end to end, is told once: texts that repeat a few words without end
        same = (start[1:] == end[:-1]) & (kind[1:] == kind[:-1]) & (owner[start[1:]] == owner[start[:-1]])
        head = np.flatnonzero(np.append(True, ~same)) if len(start) else np.zeros(0, np.int64)
        self.text, self.length, self.kind, self.least = owner[start[head]], (end - start)[head], kind[head], parts[at[start[head]]]
        self.times = np.diff(np.append(head, len(start)))
        self.start = start[head] - self.first[self.text]


def texts_in(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """Slices (a, b, texts) of a batch, of bounded size."""
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    for a, b in by_bytes(sizes, SLICE):
        yield a, b, batch.column(column).slice(a, b - a).to_pylist()


def minimizers(docs: DataFrame, width: int) -> DataFrame:
    """least, n, low, high: minimizers, how often a task met them, and the least and greatest hash of their paths' words there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in texts_in(batch, 0):
                p = Paths(texts, width)
                order = np.lexsort((p.kind.view(np.int64), p.least))
                least, kind = p.least[order], p.kind.view(np.int64)[order]
                head = np.flatnonzero(np.append(True, least[1:] != least[:-1])) if len(least) else np.zeros(0, np.int64)
                n = np.add.reduceat(p.times[order], head) if len(head) else head
                yield pa.RecordBatch.from_arrays([signed(least[head]), pa.array(n), pa.array(kind[head]), pa.array(kind[np.append(head[1:], len(least)) - 1] if len(head) else kind)], names=["least", "n", "low", "high"])

    return docs.select("text").mapInArrow(frugal(run), "least bigint, n bigint, low bigint, high bigint")


def paths(docs: DataFrame, width: int) -> DataFrame:
    """base, tid, start, length, times, kind, least of every path of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, texts in texts_in(batch, 2):
                p = Paths(texts, width)
                which = pa.array(p.text + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(which), batch.column(1).take(which), pa.array(p.start), pa.array(p.length.astype(np.int32)), pa.array(p.times), signed(p.kind), signed(p.least)],
                    names=["base", "tid", "start", "length", "times", "kind", "least"],
                )

    kind = docs.schema["base"].dataType.simpleString()
    return docs.select("base", "tid", "text").mapInArrow(frugal(run), f"base {kind}, tid bigint, start bigint, length int, times bigint, kind bigint, least bigint")


def edges(docs: DataFrame, width: int) -> DataFrame:
    """base, tid, start, least, edge: each window of the paths told (an array of start, length, least) of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in texts_in(batch, 2):
                words, owner = hashed(texts)
                first, spans = np.searchsorted(owner, np.arange(len(texts) + 1)), Spans(words)
                told = batch.column(3).slice(a, b - a)
                text = np.repeat(np.arange(b - a), pc.list_value_length(told).to_numpy())
                flat = told.flatten()
                start, length, least = (flat.field(x).to_numpy() for x in ("start", "length", "least"))
                ends = np.cumsum(length)
                row = np.repeat(np.arange(len(text)), length)
                place = np.arange(len(row)) - (ends - length)[row] + start[row]
                at = place + first[text[row]]
                which = pa.array(text[row] + a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), pa.array(place), pa.array(least[row]), signed(spans.of(at, at + width))], names=["base", "tid", "start", "least", "edge"])

    kind = docs.schema["base"].dataType.simpleString()
    return docs.select("base", "tid", "text", "told").mapInArrow(frugal(run), f"base {kind}, tid bigint, start bigint, least bigint, edge bigint")


def cut(docs: DataFrame, width: int, texts: bool, carried: str) -> DataFrame:
    """The columns carried, n_words, n_removed, kept_sha256, spans (first word and word after the last of what went) and, if asked for, kept, from text and marks."""
    names = [c for c in docs.columns if c not in ("text", "marks")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = batch.select(names)
            for a, b in by_bytes(pc.binary_length(batch.column("text")).to_pylist(), SLICE):
                counts, gone, digests, spans, kept = [], [], [], [], []
                for text, marks in zip(batch.column("text").slice(a, b - a).to_pylist(), batch.column("marks").slice(a, b - a), strict=True):
                    words = text.split()  # of bytes: at ASCII white space
                    counts.append(len(words))
                    span = []
                    if marks.is_valid and len(marks.values):
                        start, end = (marks.values.field(x).to_numpy() for x in ("start", "until"))
                        over = np.zeros(len(words) + 1, np.int64)
                        np.add.at(over, start, 1)
                        np.add.at(over, end + width - 1, -1)
                        edge = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(over[:-1]) > 0, [0]))))
                        span = edge.reshape(-1, 2).tolist()
                    at, left = 0, []
                    for x, y in span:
                        left += words[at:x]
                        at = y
                    left = left + words[at:] if span else words
                    rest = b" ".join(left)
                    gone.append(len(words) - len(left))
                    digests.append(hashlib.sha256(rest).hexdigest())
                    spans.append([{"start": x, "end": y} for x, y in span])
                    kept.append(rest)
                made = [pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                made += [pa.array(kept, pa.binary()).cast(pa.string())] if texts else []
                yield pa.RecordBatch.from_arrays([*told.slice(a, b - a).columns, *made], names=[*names, "n_words", "n_removed", "kept_sha256", "spans", *["kept"] * texts])

    return docs.mapInArrow(frugal(run), f"{carried}, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>" + ", kept string" * texts)


def coordinates(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A number for the first word of each document, in order of id, null last, that leaves room for all words of the longest text.

    A long where that is enough, else a decimal.
    """
    low, high, most = docs.agg(F.min(F.col(id_col).cast("bigint")), F.max(F.col(id_col).cast("bigint")), F.max(F.octet_length(text_col))).first()
    low, high, room = low or 0, high or 0, (most or 0) // 2 + 2
    kind = "bigint" if (high - low + 2) * room < 1 << 62 else "decimal(38,0)"
    number = lambda x: F.lit(x).cast(kind) if kind == "bigint" else F.lit(str(x)).cast(kind)
    wide = lambda x: x.cast(kind if kind == "bigint" else "decimal(20,0)")
    nth = F.coalesce(wide(F.col(id_col).cast("bigint")) - number(low), number(high - low + 1))
    return (nth * F.lit(room).cast("bigint" if kind == "bigint" else "decimal(17,0)")).cast(kind)


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), texts: bool = True) -> DataFrame:
    """doc_id, the columns to keep, n_words, n_removed, kept_sha256, spans, and with `texts` the kept text, of every document.

    Words are runs of anything but ASCII white space, unchanged. A word goes if some window of `width` words over it also
    starts earlier: in a document of smaller id, or in the same document at an earlier word. Windows are judged on the
    input. Kept words are joined by one space; spans are the words that went, [start, end).

    Null and empty texts have no words, and those of fewer than `width` words lose none. A null id comes after all
    others. Ties: of rows with one id (fully repeated ones, several with null) none precedes the other at an equal word,
    so equal rows come out alike, once each. Very long texts are taken whole. Empty table: no rows. Columns that aren't
    named in `keep` are dropped; one named like a result is an error.
    """
    known(keep, "doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept", "base", "tid", "text", "marks")
    if width < 2:
        raise ValueError("a window has two words at least")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    docs = docs.select(F.col(id_col).alias("doc_id"), *keep, coordinates(docs, id_col, text_col).alias("base"), text.alias("text")).withColumn("tid", F.xxhash64("text"))

    met = minimizers(docs, width).groupBy("least").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    met = materialise(met.where("n > 1").select("least", (F.col("low") != F.col("high")).alias("branches")), "minimizers")
    place = (F.col("base") + F.col("start")).cast(docs.schema["base"].dataType)
    seen = materialise(paths(docs, width).join(met, "least").withColumn("place", place), "paths")
    drop(met)
    kinds = seen.groupBy("least", "kind").agg(F.min("place").alias("first_place"))
    judged = seen.join(kinds, ["least", "kind"])
    own = F.col("place") == F.col("first_place")
    until = F.col("start") + F.col("length") * F.col("times")
    again = judged.where(~own | (F.col("times") > 1)).select("base", "tid", F.when(own, F.col("start") + F.col("length")).otherwise(F.col("start")).alias("start"), until.alias("until"))
    heads = judged.where(own & F.col("branches")).select("base", "tid", "start", "length", "least")

    told = heads.groupBy("base", "tid").agg(F.collect_set(F.struct("start", "length", "least")).alias("told"))  # of one text
    apart = materialise(edges(docs.join(told, ["base", "tid"]), width), "edges")
    twice = apart.withColumn("place", place).groupBy("least", "edge").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first_place")).where("n > 1")
    single = apart.join(twice, ["least", "edge"]).where(place != F.col("first_place")).select("base", "tid", "start", (F.col("start") + 1).alias("until"))

    marks = materialise(again.union(single), "marks")
    drop(seen, apart)
    marks = marks.groupBy("base", "tid").agg(F.collect_set(F.struct("start", "until")).alias("marks"))  # of one text
    with_marks = docs.join(marks, ["base", "tid"], "left").drop("base", "tid")
    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in with_marks.schema if f.name not in ("text", "marks"))
    return cut(with_marks, width, texts, carried)


def op11_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """remove_repeats over all documents, windows of 20 words; its cases hold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs, texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("spans").cast("long").alias("n_spans"))


OP11_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w
), repeats AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS nth FROM starts) WHERE nth > 1
), gone AS (
  SELECT DISTINCT doc_id, i + j AS i FROM repeats, (SELECT unnest(range(0, 20)) AS j)
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w
), marked AS (
  SELECT words.*, gone.i IS NULL AS stays FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.i = words.i
), turned AS (
  SELECT *, NOT stays AND coalesce(lag(stays) OVER (PARTITION BY doc_id ORDER BY i), true) AS opens FROM marked
), told AS (
  SELECT doc_id, count(*) FILTER (NOT stays) AS n_removed, count(*) FILTER (opens) AS n_spans, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (stays), '')) AS kept_sha256 FROM turned GROUP BY 1
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans FROM w LEFT JOIN told ON told.doc_id = w.doc_id
"""
