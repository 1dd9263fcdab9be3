"""TIFF media columns: directories walked, strips and tiles decoded, one row per page.

The reader takes classic and big TIFF of either byte order, walks the chain of
image directories, decodes uncompressed, PackBits, LZW and deflate strips or
tiles, undoes the horizontal and the floating-point predictor and emits one row per
page. The writer
stores bytes losslessly as 8-bit grey samples, 576 to a row, over as many pages
as are needed.

Defined results: null media has no page rows; media that cannot be read has one
row with page -1 (or the number of the directory that can't be read) and the
reason in `error`, null pixels; the pages before it stand. A chain of directories
that turns back on itself ends with such a row. A page whose samples can't be
decoded has such a row in its place, and the pages after it follow. Samples are of
1, 2, 4 (one byte each in pixels), 8, 16, 32 or 64 bits, whole or floating (from 16
bits on), together or in planes of their own; others, other predictors and other
compressions are such errors, and so is a header that asks for more samples than
its strips can hold. Repeated rows give repeated pages; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_work, slices, texts_of, tuned

WIDTH = 576
PAGE_ROWS = 64
STRIP_ROWS = 32
TILE = (288, 32)
#: Bytes of texts or media that are taken up together.
SLICE_BYTES = 2 << 20

#: Fixed values of the format: compression schemes, sizes of field types, tag numbers.
NONE, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
#: Bytes that a byte makes at most: a 12-bit code stands for fewer than 3,840, a deflate bit for 258 / 2, a PackBits pair for 128.
MOST_MADE = {LZW: 2_560, DEFLATE: 1_032, DEFLATE_OLD: 1_032, PACKBITS: 64}
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
TYPE_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}
IMAGE_WIDTH, IMAGE_LENGTH, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION = 256, 257, 258, 259, 262, 270
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, FILL_ORDER, SAMPLE_FORMAT = 322, 323, 324, 325, 266, 339
FLOATS = 3
#: Each byte with its bits the other way round.
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
#: What a directory or page that is not as it should be raises.
BAD = (ValueError, struct.error, zlib.error, IndexError, TypeError, MemoryError)


class Page(NamedTuple):
    page: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    description: str | None
    pixels: bytes | None
    error: str | None


PAGE_SCHEMA = "page int, width int, height int, samples int, bits int, compression int, predictor int, description string, pixels binary, error string"


def packbits_encode(data: bytes) -> bytes:
    out, at = [], 0

    def literal(end: int) -> None:
        for x in range(at, end, 128):
            piece = data[x : min(end, x + 128)]
            out.append(bytes((len(piece) - 1,)) + piece)

    for run in re.finditer(rb"(.)\1{2,127}", data, re.DOTALL):
        literal(run.start())
        out.append(bytes((257 - (run.end() - run.start()), data[run.start()])))
        at = run.end()
    literal(len(data))
    return b"".join(out)


def packbits_decode(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        elif n > 128:
            out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2
        else:
            at += 1
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; a width grows one entry early, as the format has it."""
    single = {bytes((i,)): i for i in range(256)}
    table, width, following = dict(single), 9, 258
    bits, held = 256, 9
    out = bytearray()
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        bits = bits << width | table[word]
        held += width
        table[longer] = following
        following += 1
        word = data[i : i + 1]
        if following == 4095:
            bits, held = bits << 12 | 256, held + 12
            table, width, following = dict(single), 9, 258
        elif following >> width:
            width += 1
        if held >= 512:
            keep = held & 7
            out += (bits >> keep).to_bytes(held >> 3, "big")
            bits, held = bits & ((1 << keep) - 1), keep
    if word:
        bits, held = bits << width | table[word], held + width
        if (following + 1) >> width and width < 12:
            width += 1
    bits, held = bits << width | 257, held + width
    pad = -held % 8
    return bytes(out + (bits << pad).to_bytes((held + pad) >> 3, "big"))


def lzw_decode(data: bytes) -> bytes:
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, bits, held = list(base), 9, 0, 0
    out: list[bytes] = []
    previous = b""
    for byte in data:
        bits = bits << 8 | byte
        held += 8
        if held < width:
            continue
        held -= width
        code = bits >> held
        bits &= (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            table, width, previous = list(base), 9, b""
            continue
        if previous:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = previous + previous[:1]
            else:
                raise ValueError("an LZW code beyond the table")
            table.append(previous + entry[:1])
            if len(table) + 1 >> width and width < 12:
                width += 1
        else:
            entry = table[code]
        out.append(entry)
        previous = entry
    return b"".join(out)


def compress(data: bytes, scheme: int) -> bytes:
    return {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 4), PACKBITS: packbits_encode}[scheme](data)


def decompress(data: bytes, scheme: int, size: int) -> bytes:
    """The first `size` bytes of the decoded data; fewer are an error."""
    if scheme == NONE:
        out = data
    elif scheme == LZW:
        out = lzw_decode(data)
    elif scheme in (DEFLATE, DEFLATE_OLD):
        out = zlib.decompressobj().decompress(data, size)
    elif scheme == PACKBITS:
        out = packbits_decode(data)
    else:
        raise ValueError(f"compression {scheme}")
    if len(out) < size:
        raise ValueError(f"{len(out)} of {size} bytes in a strip or tile")
    return out[:size]


def undo_predictor(samples: np.ndarray, predictor: int) -> np.ndarray:
    """samples: rows x columns x samples of a pixel."""
    return np.cumsum(samples, axis=1, dtype=samples.dtype) if predictor == 2 else samples


def undo_float_predictor(raw: np.ndarray, across: int, together: int, size: int) -> np.ndarray:
    """Rows of bytes, differenced and sorted by their significance, as big-endian samples: rows x columns x samples of a pixel."""
    rows = len(raw)
    whole = np.cumsum(raw.reshape(rows, -1, together), axis=1, dtype=np.uint8).reshape(rows, size, across * together)
    return np.ascontiguousarray(whole.transpose(0, 2, 1)).view(f">f{size}").reshape(rows, across, together)


def unpacked(raw: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The first n samples of 1, 2 or 4 bits of each row of bytes, one a byte."""
    split = np.unpackbits(raw, axis=1).reshape(len(raw), -1, bits)
    return (split @ (1 << np.arange(bits - 1, -1, -1))).astype(np.uint8)[:, :n]


class _Reader:
    def __init__(self, data: bytes):
        self.data = data
        self.order = {b"II": "<", b"MM": ">"}.get(data[:2], "")
        if not self.order or len(data) < 8:
            raise ValueError("no TIFF header")
        magic = self.number("H", 2)
        if magic not in (42, 43):
            raise ValueError("no TIFF header")
        self.big = magic == 43
        self.first = self.number("Q", 8) if self.big else self.number("I", 4)

    def number(self, code: str, at: int) -> int:
        return struct.unpack_from(self.order + code, self.data, at)[0]

    def directory(self, at: int) -> tuple[dict[int, tuple | bytes], int]:
        """Tag values, and the place of the next directory (0: none)."""
        head, entry, inline = (8, 20, 8) if self.big else (2, 12, 4)
        place, count_code = ("Q", "Q") if self.big else ("I", "I")
        n = self.number("Q" if self.big else "H", at)
        if at + head + n * entry > len(self.data):
            raise ValueError("a directory runs beyond the end")
        tags: dict[int, tuple | bytes] = {}
        for k in range(n):
            e = at + head + k * entry
            tag, kind, count = self.number("H", e), self.number("H", e + 2), self.number(count_code, e + 4)
            size = TYPE_SIZE.get(kind, 0) * count
            start = e + entry - inline
            if size > inline:
                start = self.number(place, start)
            if not size or start + size > len(self.data):
                continue
            if kind in TYPE_CODE:
                tags[tag] = struct.unpack_from(f"{self.order}{count}{TYPE_CODE[kind]}", self.data, start)
            else:
                tags[tag] = self.data[start : start + size]
        return tags, self.number(place, at + head + n * entry)

    def page(self, number: int, tags: dict) -> Page:
        one = lambda tag, default=None: tags.get(tag, (default,))[0]
        width, height = one(IMAGE_WIDTH), one(IMAGE_LENGTH)
        if not width or not height:
            raise ValueError("no width or height")
        samples, bits, scheme, predictor = one(SAMPLES, 1), one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
        planar = one(PLANAR, 1)
        floats, turned = one(SAMPLE_FORMAT, 1) == FLOATS, one(FILL_ORDER, 1) == 2
        if bits not in (1, 2, 4, 8, 16, 32, 64) or planar not in (1, 2) or len(set(tags.get(BITS, (bits,)))) > 1 or (floats and bits < 16):
            raise ValueError(f"{bits} bits a sample, planes {planar}, format {one(SAMPLE_FORMAT, 1)}")
        if predictor not in (1, 2, 3) or (predictor == 2 and (bits < 8 or floats)) or (predictor == 3 and not floats):
            raise ValueError(f"predictor {predictor} on {bits} bits, format {one(SAMPLE_FORMAT, 1)}")
        kind = np.dtype("u1") if bits <= 8 else np.dtype(f"{self.order}{'f' if floats else 'u'}{bits // 8}")
        tiled = TILE_OFFSETS in tags
        across, down = (one(TILE_WIDTH), one(TILE_LENGTH)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
        if not across or not down:
            raise ValueError("a tile or strip without extent")
        offsets, counts = (tags.get(TILE_OFFSETS), tags.get(TILE_COUNTS)) if tiled else (tags.get(STRIP_OFFSETS), tags.get(STRIP_COUNTS))
        per_row = -(-width // across)
        of_plane = per_row * -(-height // down)
        planes, together = (samples, 1) if planar == 2 else (1, samples)
        needed = of_plane * planes
        row_bytes = -(-across * together * bits // 8)
        if offsets is None or counts is None or min(len(offsets), len(counts)) < needed:
            raise ValueError("too few strips or tiles")
        if any(o < 8 or o + c > len(self.data) for o, c in zip(offsets[:needed], counts[:needed], strict=True)):
            raise ValueError("a strip or tile lies outside the file")
        # a byte makes at most so many with each compression, so what a header can ask for is bounded by the file
        if needed * down * row_bytes > MOST_MADE.get(scheme, 1) * sum(counts[:needed]) + (1 << 20):
            raise ValueError("more samples than the strips or tiles can hold")
        out = np.empty((height, width, samples), kind.newbyteorder("="))
        for k in range(needed):
            plane, place = divmod(k, of_plane)
            y, x = place // per_row * down, place % per_row * across
            rows = down if tiled else min(down, height - y)
            stored = self.data[offsets[k] : offsets[k] + counts[k]]
            data = np.frombuffer(decompress(stored.translate(REVERSED) if turned else stored, scheme, rows * row_bytes), np.uint8)
            if predictor == 3:
                block = undo_float_predictor(data.reshape(rows, row_bytes), across, together, bits // 8)
            else:
                raw = unpacked(data.reshape(rows, row_bytes), bits, across * together) if bits < 8 else data.view(kind).astype(out.dtype, copy=False)
                block = undo_predictor(raw.reshape(rows, across, together), predictor)
            out[y : y + rows, x : x + across, plane : plane + together] = block[: height - y, : width - x]
        text = tags.get(DESCRIPTION)
        description = text.split(b"\0")[0].decode("utf-8", "replace") if isinstance(text, bytes) else None
        return Page(number, width, height, samples, bits, scheme, predictor, description, out.tobytes(), None)


def read_pages(data: bytes) -> Iterator[Page]:
    """The pages, in the order of their directories, an error's row for each that can't be decoded; ends with one if the chain can't be followed."""
    number, bad = -1, (0, 0, 0, 0, 0, 0, None, None)
    try:
        reader = _Reader(data)
        at, seen = reader.first, set()
        while at:
            number += 1
            if at in seen:
                raise ValueError("the chain of directories turns back")
            seen.add(at)
            tags, at = reader.directory(at)
            try:
                page = reader.page(number, tags)
            except BAD as error:
                page = Page(number, *bad, f"{type(error).__name__}: {error}"[:200])
            yield page
    except BAD as error:
        yield Page(number, *bad, f"{type(error).__name__}: {error}"[:200])


def layout_of(payload: bytes) -> tuple[int, int, bool]:
    """(compression, predictor, tiled) by the payload's checksum: most are deflate strips, and each kind occurs."""
    k = zlib.crc32(payload) % 16
    if k < 2:
        return LZW, 1 + k, False
    if k < 4:
        return PACKBITS, 1, k == 3
    return (DEFLATE, 1 + (k == 4), True) if k < 8 else (DEFLATE, 1, False)


def write_tiff(payload: bytes, description: str = "", layout: tuple[int, int, bool] | None = None, page_rows: int = PAGE_ROWS) -> bytes:
    """payload (a positive multiple of WIDTH bytes) as a little-endian TIFF with one sample a byte."""
    scheme, predictor, tiled = layout or layout_of(payload)
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    parts: list[bytes] = [b"II*\0\0\0\0\0"]
    size, link = 8, 4
    links: list[tuple[int, int]] = []

    def put(piece: bytes) -> int:
        nonlocal size
        piece += b"\0" * (len(piece) % 2)
        parts.append(piece)
        size += len(piece)
        return size - len(piece)

    across, down = TILE if tiled else (WIDTH, STRIP_ROWS)
    for first in range(0, len(image), page_rows):
        page = image[first : first + page_rows]
        height = len(page)
        if tiled and height % down:
            page = np.vstack([page, np.full((-height % down, WIDTH), 255, np.uint8)])
        offsets, counts = [], []
        for y in range(0, len(page), down):
            for x in range(0, WIDTH, across):
                block = page[y : y + down, x : x + across]
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.uint8(0))
                data = compress(block.tobytes(), scheme)
                counts.append(len(data))
                offsets.append(put(data))
        tags: list[tuple[int, int, tuple | bytes]] = [(IMAGE_WIDTH, 4, (WIDTH,)), (IMAGE_LENGTH, 4, (height,)), (BITS, 3, (8,)), (COMPRESSION, 3, (scheme,)), (PHOTOMETRIC, 3, (1,))]
        if description and not first:
            tags.append((DESCRIPTION, 2, description.encode() + b"\0"))
        if tiled:
            tags += [(SAMPLES, 3, (1,)), (PREDICTOR, 3, (predictor,)), (TILE_WIDTH, 4, (across,)), (TILE_LENGTH, 4, (down,)), (TILE_OFFSETS, 4, tuple(offsets)), (TILE_COUNTS, 4, tuple(counts))]
        else:
            tags += [(STRIP_OFFSETS, 4, tuple(offsets)), (SAMPLES, 3, (1,)), (ROWS_PER_STRIP, 4, (down,)), (STRIP_COUNTS, 4, tuple(counts)), (PREDICTOR, 3, (predictor,))]
        entries = []
        for tag, kind, value in tags:
            raw = value if isinstance(value, bytes) else struct.pack(f"<{len(value)}{TYPE_CODE[kind]}", *value)
            field = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", put(raw))
            entries.append(struct.pack("<HHI", tag, kind, len(value)) + field)
        at = put(struct.pack("<H", len(entries)) + b"".join(entries) + b"\0\0\0\0")
        links.append((link, at))
        link = at + 2 + 12 * len(entries)
    out = bytearray(b"".join(parts))
    for where, at in links:
        struct.pack_into("<I", out, where, at)
    return bytes(out)


def padded(text: str) -> bytes:
    """The text in UTF-8 and bytes 255 up to a positive multiple of WIDTH."""
    data = text.encode()
    return data + b"\xff" * (-len(data) % WIDTH or (0 if data else WIDTH))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each whole text (null: empty) as a TIFF whose description says its bytes."""
    source = tuned(docs).select(F.col(id_col), F.col(text_col))

    def store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("tiff")
        for batch in slices(batches, SLICE_BYTES, 1):
            media = [write_tiff(padded(t), f"bytes={len(t.encode())}") for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], ["id", "media"])

    return source.mapInArrow(store, f"id {source.schema[0].dataType.simpleString()}, media binary").withColumnRenamed("id", id_col)


def tiff_pages(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per page: the id and PAGE_SCHEMA."""
    source = tuned(media).select(F.col(id_col), F.col(media_col))
    names = ["id", *Page._fields]

    def pages(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_BYTES, 1):
            found: list[Page] = []
            owners: list[int] = []
            for k, data in enumerate(batch.column(1).to_pylist()):
                if data is not None:
                    own = list(read_pages(data))
                    found += own
                    owners += [k] * len(own)
            columns = [batch.column(0).take(pa.array(owners, pa.int64()))]
            kinds = [pa.int32()] * 7 + [pa.string(), pa.binary(), pa.string()]
            columns += [pa.array([p[i] for p in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(pages, f"id {source.schema[0].dataType.simpleString()}, {PAGE_SCHEMA}").withColumnRenamed("id", id_col)


def feature_of(pixels: np.ndarray, pages: int) -> str:
    """Exact whole-number features of the samples."""
    counts = np.bincount(pixels, minlength=256)
    change = int(np.abs(np.diff(pixels.astype(np.int16))).sum())
    return f"pages={pages};sum={int(counts @ np.arange(256))};kinds={int((counts > 0).sum())};mode={int(counts.argmax())};change={change}"


def media_digests(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per medium: lengths, digests and features of the payload that its pages hold."""
    source = tuned(media).select(F.col(id_col), F.col(media_col))
    fields = [("n_bytes", pa.int64(), "long"), ("payload_bytes", pa.int64(), "long"), ("payload_sha256", pa.string(), "string"), ("tail_crc32", pa.int64(), "long"), ("media_bytes", pa.int64(), "long"), ("media_sha256", pa.string(), "string"), ("feature", pa.string(), "string"), ("n_pages", pa.int32(), "int")]

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_BYTES, 1):
            rows = []
            for data in batch.column(1).to_pylist():
                pages = list(read_pages(data or b""))
                errors = [p.error for p in pages if p.error]
                if errors:
                    rows.append((None, None, None, None, len(data or b""), hashlib.sha256(data or b"").hexdigest(), errors[0], len(pages) - len(errors)))
                    continue
                payload = b"".join(p.pixels for p in pages)
                said = re.fullmatch(r"bytes=(\d+)", pages[0].description or "")
                rows.append((int(said[1]) if said else None, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(np.frombuffer(payload, np.uint8), len(pages)), len(pages)))
            columns = [batch.column(0), *(pa.array([r[i] for r in rows], kind) for i, (_, kind, _) in enumerate(fields))]
            yield pa.RecordBatch.from_arrays(columns, ["id", *(n for n, _, _ in fields)])

    schema = f"id {source.schema[0].dataType.simpleString()}, " + ", ".join(f"{n} {k}" for n, _, k in fields)
    return source.mapInArrow(digest, schema).withColumnRenamed("id", id_col)
