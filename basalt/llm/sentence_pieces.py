"""SentencePiece encoding and decoding: a relational lattice folded by Viterbi.

The distinct words of all texts become a table. Every substring up to the longest piece is a row; an
equi-join with the piece table leaves the edges of each word's lattice, grouped by word, and Spark's
higher-order `aggregate` folds them from left to right, keeping the best path to each place. The path of
the highest sum of scores wins, at ties the one whose last piece is longer. Characters that no piece
covers become their bytes. Texts are then encoded by looking their words up.

Words end where no piece goes across: between two bytes that stand side by side in no piece. The fold takes
one step an edge, in order of their ends, block of places after block. It holds the scores of as many places
as the longest piece has letters, and of each place the edge that leads there. A second fold from right to
left reads the path. A run of one letter, say, is one word however long; its edges lie in one row.

The vocabulary is read from a model file, whose path is a parameter.
A path needs log probabilities to add up. A model trained by merges has ranks instead; its pieces then
score -ln(1 + id), by Zipf's law, since ids follow rank.
"""

from __future__ import annotations

import contextlib
import math
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.common import frugal, give_back, known, materialise
from basalt.llm.shingles import byte_codes, mix, powers

#: The model file; a setting of the environment.
MODEL = os.environ.get("BASALT_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
SPACE = "▁"
#: Bytes of text taken at a time.
STEP = 1 << 18
#: Bytes of text for each partition of the word table.
LATTICE_BYTES = 4 << 20
#: Bytes of the word table up to which it is broadcast; larger tables are joined in the cluster.
BROADCAST_BYTES = 128 << 20
#: Letters of a row whose substrings are taken, and places of a block in the fold.
ROW_LETTERS, FOLD_BLOCK = 1024, 256


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with spaces for the space mark, scores and kinds, and the first of 256 byte pieces."""

    pieces: list[str]
    scores: list[float]
    usable: list[bool]
    first_byte: int
    longest: int
    unknown_score: float

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        pieces, scores = [m.id_to_piece(i).replace(SPACE, " ") for i in range(n)], [m.get_score(i) for i in range(n)]
        usable = [not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) for i in range(n)]
        own = [p for p, u in zip(pieces, usable, strict=True) if u]
        if any(" " in p.lstrip(" ") for p in own):
            raise ValueError("a piece goes across words")
        first_byte = next((i for i in range(n) if m.is_byte(i)), -1)
        if first_byte < 0:
            raise ValueError("the vocabulary has no byte pieces")
        if all(s <= 0 and s == int(s) for s in scores):  # ranks of merges, no log probabilities: read them by Zipf's law
            scores = [-math.log(i + 1) for i in range(n)]
        return Vocabulary(pieces, scores, usable, first_byte, max(map(len, own)), min(scores) - 10)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(p, float(s), i) for i, (p, s, u) in enumerate(zip(self.pieces, self.scores, self.usable, strict=True)) if u]
        return spark.createDataFrame(rows, "piece string, score double, id int")

    def joints(self) -> np.ndarray:
        """For each two bytes: may a word go on from the first to the second? Only inside a piece or a character."""
        held = np.zeros((256, 256), bool)
        for piece, use in zip(self.pieces, self.usable, strict=True):
            if use:
                b = np.frombuffer(piece.encode(), np.uint8)
                held[b[:-1], b[1:]] = True
        held[:, 0x80:0xC0] = True
        return held


def segments(texts: list[bytes], held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first byte, end, text number, hash) of each word; each text begins with a space. Texts are joined by newlines, whose words aren't given."""
    joined = b"".join(b" %b\n" % t for t in texts)
    data = np.frombuffer(joined, np.uint8)
    last = np.cumsum([len(t) + 2 for t in texts]) - 1  # the newlines between texts
    start = np.append(True, ~held[data[:-1], data[1:]])
    start[last] = True
    start[last[:-1] + 1] = True
    first = np.flatnonzero(start)
    end = np.append(first[1:], len(data))
    owner = np.searchsorted(last, first)
    own = first != last[owner]
    first, end, owner = first[own], end[own], owner[own]
    up, down = powers(1 << max(16, len(data).bit_length()))
    total = np.append(np.uint64(0), np.cumsum(byte_codes()[data] * up[: len(data)], dtype=np.uint64))
    return data, first, end, owner, mix((total[end] - total[first]) * down[first])


def packs(batch: pa.RecordBatch, column: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """(rows, texts) of about STEP bytes; the space mark is a space. A longer text comes in parts.

    Parts are cut before the space that begins a word. That space is left out, since each text given to
    segments() begins with one.
    """
    rows, texts, size = [], [], 0
    for row, value in enumerate(batch.column(column)):
        text = (value.as_py() or b"").replace(SPACE.encode(), b" ")
        at = 0
        while at < len(text):
            end = text.find(b" ", at + STEP) if len(text) - at > STEP else -1
            while end > 0 and text[end - 1] == 32:
                end = text.find(b" ", end + 1)
            rows.append(row)
            texts.append(text[at:] if end < 0 else text[at:end])
            at = len(text) if end < 0 else end + 1
            size += len(texts[-1])
            if size >= STEP:
                yield rows, texts
                rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def distinct_words(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """key (hash), at, own, letters: every word of the texts once, dealt by key to partitions whose lattices fit in memory.

    A long word comes in rows of ROW_LETTERS letters of its own, the first at letter `at`, each with the letters
    behind that a piece may reach.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    held, reach = vocabulary.joints(), vocabulary.longest - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)
        for batch in batches:
            for _, texts in packs(batch, 0):
                data, first, end, _, key = segments(texts, held)
                key, at = np.unique(key, return_index=True)
                place = np.minimum(np.searchsorted(seen, key), max(0, len(seen) - 1))
                new = seen[place] != key if len(seen) else np.ones(len(key), bool)
                key, at = key[new], at[new]
                seen = np.sort(np.concatenate([seen, key]), kind="stable")
                raw = data.tobytes()
                words = [raw[a:b].decode() for a, b in zip(first[at].tolist(), end[at].tolist(), strict=True)]
                rows = [(k, i, min(ROW_LETTERS, len(w) - i), w[i : i + ROW_LETTERS + reach]) for k, w in zip(key.view(np.int64).tolist(), words, strict=True) for i in range(0, len(w), ROW_LETTERS)]
                columns = zip(*rows, strict=True) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["key", "at", "own", "letters"])

    dealt = docs.select("text").mapInArrow(frugal(run), "key bigint, at int, own int, letters string").repartition(max(8, int(total // LATTICE_BYTES)), "key")
    return dealt.groupBy("key", "at").agg(F.first("own").alias("own"), F.first("letters").alias("letters"))


def encode_words(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """key, ids of each word (key, at, own, letters): the lattice, its join with the pieces, and the fold."""
    pieces = vocabulary.table(words.sparkSession)
    ends = F.expr(f"sequence(start + 1, least(start + {vocabulary.longest}, char_length(letters)))")
    edges = (
        words.select("key", "at", "letters", F.explode(F.expr("sequence(0, own - 1)")).alias("start"))
        .select("key", "at", "letters", "start", F.explode(ends).alias("end"))
        .select("key", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end"), F.expr("substring(letters, start + 1, end - start)").alias("piece"))
        .join(F.broadcast(pieces), "piece", "left")  # the vocabulary, of fixed size
        .where(F.col("id").isNotNull() | (F.col("end") == F.col("start") + 1))
    )
    # code: of a piece, its id and number of letters; of a letter that no piece covers, minus its bytes and their number
    as_bytes = F.expr("-(cast(conv(hex(cast(piece as binary)), 16, 10) as bigint) * 8 + octet_length(piece))")
    code = F.when(F.col("id").isNull(), as_bytes).otherwise(F.col("id").cast("bigint") * 256 + F.col("end") - F.col("start"))
    edge = F.struct("end", "start", F.coalesce("score", F.lit(vocabulary.unknown_score)).alias("score"), code.alias("code"))
    blocks = edges.select("key", F.expr(f"cast((end - 1) div {FOLD_BLOCK} as int)").alias("block"), edge.alias("edge")).groupBy("key", "block").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    lattice = blocks.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("block", "edges"))).alias("blocks"))
    # at: the place whose edges come; top, by: its best score and the code of its best edge; past: the scores of places before,
    # last first; codes: by of each place of the block. What a step returns is copied, so only a block's codes go along.
    cost = "if(e.start = t.at, t.top, t.past[t.at - 1 - e.start]) + e.score"
    begun = "named_struct('at', s.at, 'top', s.top, 'by', 0L, 'past', s.past, 'codes', cast(array() as array<bigint>))"
    forward = f"""
        aggregate(blocks, named_struct('at', 0, 'top', 0D, 'past', cast(array() as array<double>), 'codes', cast(array() as array<array<bigint>>)), (s, b) ->
          aggregate(b.edges, {begun}, (t, e) ->
            if(e.end > t.at,
              named_struct('at', e.end, 'top', {cost}, 'by', e.code, 'past', concat(array(t.top), slice(t.past, 1, {vocabulary.longest - 1})), 'codes', if(t.by = 0, t.codes, concat(t.codes, array(t.by)))),
              if({cost} > t.top, named_struct('at', t.at, 'top', {cost}, 'by', e.code, 'past', t.past, 'codes', t.codes), t)),
            t -> named_struct('at', t.at, 'top', t.top, 'past', t.past, 'codes', concat(s.codes, array(concat(t.codes, array(t.by)))))),
          s -> s.codes)
    """
    # from the last place to the first: an edge's letters are skipped, then the next one counts
    backward = """
        aggregate(reverse(codes), named_struct('skip', 0, 'path', cast(array() as array<array<bigint>>)), (s, b) ->
          aggregate(reverse(b), named_struct('skip', s.skip, 'path', cast(array() as array<bigint>)), (t, c) ->
            if(t.skip > 0, named_struct('skip', t.skip - 1, 'path', t.path), named_struct('skip', if(c < 0, 0, cast(c % 256 as int) - 1), 'path', concat(t.path, array(c)))),
            t -> named_struct('skip', t.skip, 'path', concat(s.path, array(t.path)))),
          s -> reverse(flatten(s.path)))
    """
    spelt = f"if(c < 0, transform(sequence(cast(-c % 8 as int) - 1, 0, -1), k -> cast(shiftright(-c div 8, 8 * k) & 255 as int) + {vocabulary.first_byte}), array(cast(c div 256 as int)))"
    return lattice.select("key", F.expr(forward).alias("codes")).select("key", F.expr(backward).alias("path")).select("key", F.expr(f"flatten(transform(path, c -> {spelt}))").alias("ids"))


class Lookup:
    """The word table as arrays: sorted hashes, where each word's ids begin, and all ids."""

    def __init__(self, key: np.ndarray, size: np.ndarray, flat: np.ndarray):
        begin = (np.cumsum(size, dtype=np.int64) - size).astype(np.int32)
        order = np.argsort(key)
        self.key, self.begin, self.flat = key[order], begin[order], flat
        self.size = size[order].astype(np.uint16 if np.max(size, initial=0) < 1 << 16 else np.int32)

    @staticmethod
    def of(packed: pa.Table, kinds: tuple) -> Lookup:
        """From rows of packed_words()."""
        return Lookup(*(np.frombuffer(b"".join(x.as_buffer() for x in column), kind) for column, kind in zip(packed.columns, kinds, strict=True)))

    def directory(self) -> tuple[np.ndarray, int, np.uint64]:
        shift = np.uint64(64 - max(4, len(self.key).bit_length() + 1))
        tops = np.arange(1 << int(64 - shift), dtype=np.uint64) << shift
        begin = np.searchsorted(self.key, tops).astype(np.int32)
        return begin, int(np.max(np.diff(np.append(begin, len(self.key))), initial=0)), shift

    def find(self, key: np.ndarray, directory: tuple) -> np.ndarray:
        begin, longest, shift = directory
        at, last = begin[key >> shift], len(self.key) - 1
        for _ in range(longest):
            at += self.key[np.minimum(at, last)] < key
        at = np.minimum(at, last)
        if len(self.key) == 0 or (self.key[at] != key).any():
            raise ValueError("a word isn't in the table")
        return at

    def ids(self, key: np.ndarray, directory: tuple) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, number of ids of each word)."""
        at = self.find(key, directory)
        size = self.size[at].astype(np.int64)
        return self.flat[spread(self.begin[at].astype(np.int64), size)].astype(np.int32), size


PACKED = pa.schema([("key", pa.binary()), ("size", pa.binary()), ("flat", pa.binary())])


def packed_words(kinds: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (key, ids) as bytes of arrays, a row a batch: a third less than lists, and the driver only strings them together."""
    for batch in batches:
        ids = batch.column(1)
        columns = batch.column(0).to_numpy().view(np.uint64), ids.value_lengths().to_numpy(), ids.flatten().to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([c.astype(kind).tobytes()], pa.binary()) for c, kind in zip(columns, kinds, strict=True)], schema=PACKED)


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each begin, `size` numbers."""
    ends = np.cumsum(size, dtype=np.int64)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def piece_bytes(vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, length, all bytes) of what each id stands for; control pieces stand for nothing."""
    raw = [p.encode() if u else bytes((i - vocabulary.first_byte,)) if 0 <= i - vocabulary.first_byte < 256 else b"" for i, (p, u) in enumerate(zip(vocabulary.pieces, vocabulary.usable, strict=True))]
    size = np.array([len(x) for x in raw], np.int64)
    return np.cumsum(size) - size, size, np.frombuffer(b"".join(raw), np.uint8)


def encode_batch(batch: pa.RecordBatch, column: int, lookup: Lookup, directory: tuple, held: np.ndarray, spell: tuple, first_byte: int, with_ids: bool) -> list[pa.Array]:
    """n_pieces, n_bytes_pieces, ids_crc32, round_trip and, if wanted, ids of each row."""
    rows = batch.num_rows
    n, by_byte, crc, same = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.ones(rows, bool)
    kept: list = [np.zeros(0, np.int32)] * rows if with_ids else []
    first, length, letters = spell
    for at, texts in packs(batch, column):
        data, _, _, owner, key = segments(texts, held)
        ids, size = lookup.ids(key, directory)
        bounds = np.append(0, np.cumsum(np.bincount(owner, size, len(texts)).astype(np.int64)))
        decoded = letters[spread(first[ids], length[ids])].tobytes()
        ends = np.append(0, np.cumsum(length[ids]))[bounds]
        single = (ids >= first_byte) & (ids < first_byte + 256)
        raw, fallback = ids.astype("<i4").tobytes(), np.append(0, np.cumsum(single))[bounds]
        for j, (row, text) in enumerate(zip(at, texts, strict=True)):
            a, b = int(bounds[j]), int(bounds[j + 1])
            n[row] += b - a
            by_byte[row] += fallback[j + 1] - fallback[j]
            crc[row] = zlib.crc32(raw[4 * a : 4 * b], int(crc[row]))
            same[row] &= decoded[ends[j] + 1 : ends[j + 1]] == text
            if with_ids:
                kept[row] = np.concatenate([kept[row], ids[a:b]])
    out = [pa.array(n), pa.array(by_byte), pa.array(crc), pa.array(same)]
    return [*out, pa.array(kept, pa.list_(pa.int32()))] if with_ids else out


NAMES = ["n_pieces", "n_byte_pieces", "ids_crc32", "round_trip"]
TYPES = "n_pieces bigint, n_byte_pieces bigint, ids_crc32 bigint, round_trip boolean"


def encode(docs: DataFrame, model: str = MODEL, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True, broadcast_bytes: int | None = None) -> DataFrame:
    """The `keep` columns, n_pieces, n_byte_pieces (pieces that spell a byte), ids_crc32 (of the ids as
    32-bit little-endian numbers), round_trip (decoding gives the text, a space mark in it counting as a
    space), and ids, for every whole text.

    Null and empty texts: no ids. Repeated rows come out alike. Empty table: no rows. The word table is
    broadcast only up to `broadcast_bytes`; beyond, texts and the words they hold meet by a shuffle.
    Columns not kept are dropped; `keep` must not name an output column.
    """
    known(keep, *NAMES, "ids")
    spark = docs.sparkSession
    vocabulary = Vocabulary.load(model)
    joints, spell = vocabulary.joints(), piece_bytes(vocabulary)
    kinds = np.uint64, np.int32, np.uint16 if len(vocabulary.pieces) <= 1 << 16 else np.int32
    columns = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema[:-1]) + ", " + TYPES + (", ids array<int>" if with_ids else "")
    names = [*keep, *NAMES, *["ids"] * with_ids]
    words = distinct_words(columns.select(F.col("__text").alias("text")), vocabulary)
    coded = materialise(encode_words(words, vocabulary), "coded")  # edges stay where their word is
    size = coded.agg(F.count(F.lit(1)) * 14 + F.coalesce(F.sum(F.size("ids")), F.lit(0)) * 4).first()[0]
    if size <= (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        shared = spark.sparkContext.broadcast(Lookup.of(coded.select("key", "ids").mapInArrow(partial(packed_words, kinds), "key binary, size binary, flat binary").toArrow(), kinds))
        give_back()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lookup = shared.value
            directory = lookup.directory()
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *encode_batch(batch, batch.num_columns - 1, lookup, directory, joints, spell, vocabulary.first_byte, with_ids)], names=names)
            del lookup, directory
            with contextlib.suppress(AttributeError):  # workers live on and would keep the table; it is read from its file again if need be
                del shared._value

        return columns.mapInArrow(frugal(run), schema)

    # texts are dealt out by a hash to shares of a bounded number of bytes, and each share gets the words it holds
    total = columns.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    shares = max(1, int(total // (16 << 20)))
    dealt = columns.withColumn("__share", F.pmod(F.xxhash64(*keep, "__text", F.monotonically_increasing_id()), F.lit(shares)).cast("int"))
    dealt = materialise(dealt, "dealt")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in packs(batch, 0):
                share = np.array(batch.column(1).take(pa.array(at)).to_pylist(), np.int64)
                _, _, _, owner, key = segments(texts, joints)
                pairs = np.unique(np.stack([share[owner], key.view(np.int64)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].astype(np.int32)), pa.array(pairs[:, 1])], names=["__share", "key"])

    wanted = dealt.select("__text", "__share").mapInArrow(frugal(held), "__share int, key bigint").distinct().join(coded, "key").select("__share", "key", "ids")

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        lookup = Lookup.of(pa.Table.from_batches(packed_words(kinds, right.select(["key", "ids"]).to_batches()), PACKED), kinds)
        directory = lookup.directory()
        out = [pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *encode_batch(b, len(keep), lookup, directory, joints, spell, vocabulary.first_byte, with_ids)], names=names) for b in left.to_batches()]
        return pa.Table.from_batches(out)

    return dealt.groupBy("__share").cogroup(wanted.groupBy("__share")).applyInArrow(together, schema)


def decode(coded: DataFrame, model: str = MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns and text: the bytes of all ids in a row, without the space at the start.

    Null ids: null text. Control pieces stand for nothing, ids out of range too; bytes that aren't UTF-8
    become the replacement character.
    """
    first, length, letters = piece_bytes(Vocabulary.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value in batch.column(batch.num_columns - 1).to_pylist():
                if value is None:
                    texts.append(None)
                    continue
                ids = np.array([i for i in value if i is not None and 0 <= i < len(first)], np.int64)
                texts.append(letters[spread(first[ids], length[ids])].tobytes().decode("utf-8", "replace").removeprefix(" "))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])

    kept = coded.select(*keep)
    return coded.select(*keep, "ids").mapInArrow(frugal(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", text string")


def op3_sentence_pieces(spark, sf_dir: str) -> DataFrame:
    """encode over all documents, without the ids themselves; its cases hold."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
