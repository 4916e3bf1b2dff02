"""TIFF media columns: walk image directories, decode strips or tiles, emit one row per page.

Reads classic TIFF of either byte order, 8-bit samples, chunky, strips or tiles, stored plain or by
PackBits, LZW or deflate, with or without horizontal differencing. The writer makes the same kinds.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import materialise

# Fixed values of the format: compression codes, and tag numbers.
PLAIN, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_SIZES = 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES = 284, 317, 322, 323, 324, 325
FIELD = {1: "B", 3: "H", 4: "I"}


def packbits_decode(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more bytes as runs, the rest as literals."""
    out, i, literal = bytearray(), 0, 0

    def flush(end: int) -> None:
        for a in range(literal, end, 128):
            out.append(min(128, end - a) - 1)
            out.extend(data[a : min(a + 128, end)])

    while i < len(data):
        j = i + 1
        while j < len(data) and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i >= 3:
            flush(i)
            out += bytes((257 - (j - i), data[i]))
            literal = j
        i = j
    flush(len(data))
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first, widened one code early; 256 clears, 257 ends."""
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, last = list(base), 9, None
    out, bits, held = bytearray(), 0, 0
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = list(base), 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("LZW code out of range")
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out += entry
        last = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    codes: list[tuple[int, int]] = [(256, 9)]
    table: dict[bytes, int] = {bytes((i,)): i for i in range(256)}
    next_code, width, w = 258, 9, b""
    for i in range(len(data)):
        grown = w + data[i : i + 1]
        if grown in table:
            w = grown
            continue
        codes.append((table[w], width))
        table[grown] = next_code
        next_code += 1
        w = data[i : i + 1]
        if next_code == 4094:
            codes.append((256, width))
            table, next_code, width = {bytes((k,)): k for k in range(256)}, 258, 9
        else:
            width = next_code.bit_length()
    if w:
        codes.append((table[w], width))
        width = max(width, (next_code + 1).bit_length())
    codes.append((257, min(12, width)))
    held = "".join(format(c, f"0{n}b") for c, n in codes)
    held += "0" * (-len(held) % 8)
    return int(held, 2).to_bytes(len(held) // 8, "big")


DECODE = {PLAIN: bytes, PACKBITS: packbits_decode, LZW: lzw_decode, DEFLATE: zlib.decompress, DEFLATE_OLD: zlib.decompress}
ENCODE = {PLAIN: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 1)}


def directories(data: bytes) -> Iterator[dict[int, tuple[int, ...]]]:
    """The tags of each image directory, in chain order; a chain that loops is an error."""
    if len(data) < 8 or data[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF")
    order = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise ValueError("image directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind in FIELD:
                form = f"{order}{count}{FIELD[kind]}"
                where = at + 10 + 12 * k
                if struct.calcsize(form) > 4:
                    (where,) = struct.unpack_from(order + "I", data, where)
                tags[tag] = struct.unpack_from(form, data, where)
        yield tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def pages(data: bytes) -> Iterator[np.ndarray]:
    """The samples of each page, an array of height x width x samples."""
    for tags in directories(data):
        one = lambda tag, default: tags.get(tag, (default,))[0]  # noqa: E731, B023
        w, h, spp = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
        if set(tags.get(BITS, (1,))) != {8} or one(PLANAR, 1) != 1:
            raise ValueError("only chunky 8-bit samples are read")
        decode, predictor = DECODE.get(one(COMPRESSION, PLAIN)), one(PREDICTOR, 1)
        if decode is None or predictor not in (1, 2):
            raise ValueError("unknown compression or predictor")
        if TILE_OFFSETS in tags:
            cw, ch = one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)
            offsets, sizes = tags[TILE_OFFSETS], tags[TILE_SIZES]
        else:
            cw, ch = w, min(one(STRIP_ROWS, h), h)
            offsets, sizes = tags[STRIP_OFFSETS], tags[STRIP_SIZES]
        across = -(-w // cw)
        out = np.empty((h, w, spp), np.uint8)
        for k, (offset, size) in enumerate(zip(offsets, sizes, strict=True)):
            y, x = k // across * ch, k % across * cw
            rows = ch if TILE_OFFSETS in tags else min(ch, h - y)
            cell = np.frombuffer(decode(data[offset : offset + size]), np.uint8, rows * cw * spp).reshape(rows, cw, spp)
            if predictor == 2:
                cell = np.cumsum(cell, axis=1, dtype=np.uint8)
            out[y : y + rows, x : x + cw] = cell[: h - y, : w - x]
        yield out


def write(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, cell: tuple[int, int] | None = None, strip_rows: int = 1024, order: str = "<") -> bytes:
    """A TIFF with a page for each image (height x width x samples); cell: (height, width) of tiles, else strips."""
    parts, at, link, tail, head = [], 8, None, 0, bytearray((b"II*\0" if order == "<" else b"MM\0*") + bytes(4))

    def put(block: bytes) -> int:
        nonlocal at
        here = at
        parts.append(block + bytes(len(block) % 2))
        at += len(parts[-1])
        return here

    for image in images:
        h, w, spp = image.shape
        ch, cw = cell or (strip_rows, w)
        offsets, sizes = [], []
        for y in range(0, h, ch):
            for x in range(0, w, cw):
                block = image[y : y + ch, x : x + cw]
                if cell and block.shape[:2] != cell:
                    block = np.pad(block, ((0, ch - block.shape[0]), (0, cw - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.uint8(0)).astype(np.uint8)
                packed = ENCODE[compression](block.tobytes())
                offsets.append(put(packed))
                sizes.append(len(packed))
        tags = [(WIDTH, "I", [w]), (HEIGHT, "I", [h]), (BITS, "H", [8] * spp), (COMPRESSION, "H", [compression]), (PHOTOMETRIC, "H", [1]), (SAMPLES, "H", [spp]), (PREDICTOR, "H", [predictor])]
        tags += [(TILE_WIDTH, "I", [cw]), (TILE_HEIGHT, "I", [ch]), (TILE_OFFSETS, "I", offsets), (TILE_SIZES, "I", sizes)] if cell else [(STRIP_OFFSETS, "I", offsets), (STRIP_ROWS, "I", [ch]), (STRIP_SIZES, "I", sizes)]
        entries = b""
        for tag, kind, values in sorted(tags):
            value = struct.pack(f"{order}{len(values)}{kind}", *values)
            entries += struct.pack(f"{order}HHI", tag, {"H": 3, "I": 4}[kind], len(values)) + (value.ljust(4, b"\0") if len(value) <= 4 else struct.pack(f"{order}I", put(value)))
        here = put(struct.pack(f"{order}H", len(tags)) + entries + bytes(4))
        # the link to this directory lies in the head or at the end of the directory before
        if link is None:
            struct.pack_into(f"{order}I", head, 4, here)
        else:
            parts[link] = parts[link][:tail] + struct.pack(f"{order}I", here) + parts[link][tail + 4 :]
        link, tail = len(parts) - 1, 2 + 12 * len(tags)
    return bytes(head) + b"".join(parts)


PAGE_SCHEMA = "page int, width int, height int, samples_per_pixel int, samples binary, error string"


def read_pages(media: DataFrame, column: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per page: the `keep` columns, page (from 0), width, height, samples_per_pixel, samples, error.

    Null media: no rows. Media that can't be read: the pages before the fault, then a row with page
    null and the error. Ties and repeated rows: each is read for itself. Empty table: no rows.
    """
    kept = media.select(*keep)
    names = [*keep, "page", "width", "height", "samples_per_pixel", "samples", "error"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", " + PAGE_SCHEMA

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = row.pop("__media")
                if data is None:
                    continue
                found, k, error = [], 0, None
                try:
                    for k, image in enumerate(pages(data)):
                        h, w, spp = image.shape
                        found.append([*row.values(), k, w, h, spp, image.tobytes(), None])
                except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                    error = str(e) or type(e).__name__
                if error is not None:
                    found.append([*row.values(), None, None, None, None, None, error])
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), [*[batch.schema.field(n).type for n in keep], *[pa.int32()] * 4, pa.binary(), pa.string()], strict=True)], names=names)

    return media.select(*keep, F.col(column).alias("__media")).mapInArrow(decode, schema)


def text_image(payload: bytes, width: int = 64, page_rows: int = 4096) -> list[np.ndarray]:
    """The payload, a multiple of width, as pages of one-sample rows."""
    flat = np.frombuffer(payload, np.uint8).reshape(-1, width, 1)
    return [flat[y : y + page_rows] for y in range(0, len(flat), page_rows)]


class Digest:
    """Digests of a document's pages, added one by one."""

    def __init__(self):
        self.sha, self.tail, self.size, self.pages, self.rows, self.width, self.sums = hashlib.sha256(), b"", 0, 0, 0, 0, np.zeros(3, np.int64)

    def add(self, samples: bytes, width: int, rows: int) -> None:
        x = np.frombuffer(samples, np.uint8).reshape(rows, -1)
        self.sha.update(samples)
        self.tail = (self.tail + samples[-64:])[-64:]
        self.size, self.pages, self.rows, self.width = self.size + len(samples), self.pages + 1, self.rows + rows, width
        self.sums += [x.sum(dtype=np.int64), np.square(x, dtype=np.int64).sum(), np.abs(np.diff(x.astype(np.int16), axis=1)).sum(dtype=np.int64)]

    def feature(self) -> str:
        """Pages, width, rows, mean, mean square and mean step along rows of the decoded samples."""
        mean, square, step = self.sums / max(1, self.size)
        return f"pages={self.pages};width={self.width};rows={self.rows};mean={mean:.6f};square={square:.6f};step={step:.6f}"


MEDIA_SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def stored_form(data: bytes) -> dict:
    """How a text is stored, by its own hash: most as deflate strips, some as differenced tiles, PackBits or LZW."""
    kind = zlib.crc32(data) % 32
    if kind < 4:
        return {"compression": DEFLATE, "predictor": 2, "cell": (64, 64)}
    return {"compression": {4: LZW, 5: PACKBITS}.get(kind, DEFLATE)}


def text_media(docs: DataFrame, compression: int | None = None, width: int = 64) -> DataFrame:
    """doc_id, n_bytes, media: each whole text (null: empty) as the samples of a TIFF, padded with zeros to rows of `width`.

    Stored as stored_form() says, or all by one compression. Null ids are carried. Very long texts take several
    pages. Equal texts are stored alike, repeated rows each for itself. Empty table: no rows. Other columns are dropped.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            step = 256
            for i in range(0, len(texts), step):
                ids = batch.column(0).slice(i, step)
                media, sizes = [], []
                for text in texts.slice(i, step):
                    data = text.as_py()
                    sizes.append(len(data))
                    form = stored_form(data) if compression is None else {"compression": compression}
                    media.append(write(text_image(data.ljust(max(1, -(-len(data) // width)) * width, b"\0"), width), **form))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("bigint"), text.alias("text")).mapInArrow(encode, "doc_id bigint, n_bytes bigint, media binary")


def media_digest(media: DataFrame) -> DataFrame:
    """Read stored media (doc_id, n_bytes, media) back page by page and digest them (see MEDIA_SCHEMA).

    Equal media give equal values; rows stay rows. Null media: no row. Media that can't be read are an error.
    The pages of a row follow each other in one task, so nothing is shuffled. Empty table: no rows.
    """
    stored = media.select(F.struct("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")).alias("about"), "media")
    about = ["doc_id", "n_bytes", "media_bytes", "media_sha256"]
    read = read_pages(stored, keep=("about",)).select(*[f"about.{c}" for c in about], "page", "width", "height", "samples", "error")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found, out = None, Digest(), []

        def end() -> None:
            if held is not None:
                out.append((held[0], held[1], found.size, found.sha.hexdigest(), zlib.crc32(found.tail), held[2], held[3], found.feature()))

        def rows() -> pa.RecordBatch:
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in MEDIA_SCHEMA.split(", ")])

        for batch in batches:
            small = batch.drop_columns(["samples"]).to_pylist()
            for row, samples in zip(small, batch.column("samples"), strict=True):
                if row["error"] is not None:
                    raise ValueError(f"a stored text can't be read: {row['error']}")
                if row["page"] == 0:
                    end()
                    held, found = tuple(row[c] for c in about), Digest()
                found.add(samples.as_py(), row["width"], row["height"])
            yield rows()
        end()
        yield rows()

    return read.mapInArrow(digest, MEDIA_SCHEMA)


def op6_tiff_media(spark, sf_dir: str) -> DataFrame:
    """text_media of all documents, stored, then read back by media_digest; their cases hold."""
    return media_digest(materialise(text_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media"))
