"""Media columns: TIFF files to rows of pages, and back.

``read_pages`` walks a file's image directories, fetches strips or tiles, undoes PackBits,
LZW or deflate and the horizontal predictor, and gives one page per directory. ``write_tiff``
makes such files. ``pages`` is the DataFrame form: one row per page of a column of files.

Limits are those of the data: 8-bit samples, chunky layout, 1 to 4 samples a pixel, either
byte order, classic TIFF. Directories that form a loop end the walk. A file that is damaged
gives one row with its error, page null; null and empty files give no row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larkspur.llm.common import small_batches, steps, table

# Tags, compressions and the predictor of TIFF 6.0 and its deflate supplement.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
RAW, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
SIZES = {1: (1, "B"), 3: (2, "H"), 4: (4, "I")}
CLEAR, END, FIRST, MAX_BITS = 256, 257, 258, 12


@dataclass
class Page:
    index: int
    pixels: np.ndarray  # height, width, samples
    compression: int
    predictor: int
    tiled: bool


def packbits(data: bytes) -> bytes:
    """Literal runs of up to 128 bytes, and runs of at least 3 equal bytes as pairs."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    lengths = np.diff(np.append(starts, len(a)))
    out, at = bytearray(), 0

    def literal(lo: int, hi: int) -> None:
        for i in range(lo, hi, 128):
            part = data[i : min(i + 128, hi)]
            out.append(len(part) - 1)
            out.extend(part)

    for k in np.flatnonzero(lengths >= 3):
        lo, n = int(starts[k]), int(lengths[k])
        literal(at, lo)
        for left in range(n, 0, -128):
            part = min(left, 128)
            out.extend((257 - part & 255, data[lo]) if part > 1 else (0, data[lo]))
        at = lo + n
    literal(at, len(data))
    return bytes(out)


def unpackbits(data: bytes) -> bytes:
    out, i = [], 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out.append(data[i + 1 : i + 2 + n])
            i += 2 + n
        elif n > 128:
            out.append(data[i + 1 : i + 2] * (257 - n))
            i += 2
        else:
            i += 1
    return b"".join(out)


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: most significant bit first, codes widen one code early."""
    bits, held, out = 0, 0, bytearray()

    def put(code: int, width: int) -> None:
        nonlocal bits, held
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    known = {bytes([k]): k for k in range(256)}
    width, following, run = 9, FIRST, b""
    put(CLEAR, width)
    for k in range(len(data)):
        longer = run + data[k : k + 1]
        if longer in known:
            run = longer
            continue
        put(known[run], width)
        known[longer] = following
        following += 1
        if following == (1 << MAX_BITS) - 1:
            put(CLEAR, width)
            known = {bytes([k]): k for k in range(256)}
            width, following = 9, FIRST
        elif following == 1 << width:
            width += 1
        run = data[k : k + 1]
    if run:
        put(known[run], width)
        if following + 1 == 1 << width and width < MAX_BITS:
            width += 1
    put(END, width)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def unlzw(data: bytes) -> bytes:
    out, table, width, held, bits, before = [], [], 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == CLEAR:
            table, width, before = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if code == END:
            break
        if code < len(table):
            entry = table[code]
        elif before and code == len(table):
            entry = before + before[:1]
        else:
            raise ValueError("LZW code out of range")
        out.append(entry)
        if before and len(table) < 1 << MAX_BITS:
            table.append(before + entry[:1])
        before = entry
        if len(table) + 1 >= 1 << width and width < MAX_BITS:
            width += 1
    return b"".join(out)


PACK = {RAW: bytes, LZW: lzw, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: packbits, OLD_DEFLATE: lambda b: zlib.compress(b, 1)}
UNPACK = {RAW: bytes, LZW: unlzw, DEFLATE: zlib.decompress, PACKBITS: unpackbits, OLD_DEFLATE: zlib.decompress}


def write_tiff(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, rows_per_strip: int = 0, order: str = "<") -> bytes:
    """A TIFF of one directory per image (height, width[, samples]) of 8-bit samples; tiles are (height, width)."""
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for image in images:
        image = image if image.ndim == 3 else image[:, :, None]
        h, w, s = image.shape
        if tile:
            th, tw = tile
            padded = np.zeros((-(-h // th) * th, -(-w // tw) * tw, s), np.uint8)
            padded[:h, :w] = image
            blocks = [padded[y : y + th, x : x + tw] for y in range(0, padded.shape[0], th) for x in range(0, padded.shape[1], tw)]
        else:
            rows = rows_per_strip or h
            blocks = [image[y : y + rows] for y in range(0, h, rows)]
        offsets, counts = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate((block[:, :1], block[:, 1:] - block[:, :-1]), axis=1)
            packed = PACK[compression](np.ascontiguousarray(block).tobytes())
            offsets.append(len(out))
            counts.append(len(packed))
            out += packed + b"\0" * (len(packed) % 2)
        entries = [(WIDTH, [w]), (HEIGHT, [h]), (BITS, [8] * s), (COMPRESSION, [compression]), (PHOTOMETRIC, [2 if s >= 3 else 1]), (SAMPLES, [s]), (PLANAR, [1]), (PREDICTOR, [predictor])]
        entries += [(TILE_WIDTH, [tile[1]]), (TILE_HEIGHT, [tile[0]]), (TILE_OFFSETS, offsets), (TILE_COUNTS, counts)] if tile else [(STRIP_OFFSETS, offsets), (ROWS_PER_STRIP, [rows]), (STRIP_COUNTS, counts)]
        body = bytearray()
        entries.sort()
        for tag, values in entries:
            kind = 3 if tag in (BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, PREDICTOR) else 4
            size, letter = SIZES[kind]
            raw = struct.pack(f"{order}{len(values)}{letter}", *values)
            if len(raw) > 4:
                at = len(out)
                out += raw
                raw = struct.pack(order + "I", at)
            body += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + body
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def read_pages(data: bytes) -> list[Page]:
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("no TIFF header")
    pages, seen, at = [], set(), struct.unpack_from(order + "I", data, 4)[0]
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind in SIZES:
                size, letter = SIZES[kind]
                where = at + 10 + 12 * k
                if size * count > 4:
                    where = struct.unpack_from(order + "I", data, where)[0]
                tags[tag] = struct.unpack_from(f"{order}{count}{letter}", data, where)
        pages.append(_page(len(pages), tags, data))
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
    return pages


def _page(index: int, tags: dict, data: bytes) -> Page:
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    w, h, s = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    compression, predictor = one(COMPRESSION, RAW), one(PREDICTOR, 1)
    if not w or not h or set(tags.get(BITS, (8,))) != {8} or one(PLANAR, 1) != 1 or compression not in UNPACK or predictor not in (1, 2):
        raise ValueError("a layout that is not read")
    tiled = TILE_OFFSETS in tags
    bh, bw = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(ROWS_PER_STRIP, h), h), w)
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    across = -(-w // bw)
    pixels = np.zeros((-(-h // bh) * bh, across * bw, s), np.uint8)
    for k, (offset, count) in enumerate(zip(offsets, counts, strict=True)):
        raw = np.frombuffer(UNPACK[compression](data[offset : offset + count]), np.uint8)
        y, x = k // across * bh, k % across * bw
        rows = bh if tiled else min(bh, h - y)
        block = raw[: rows * bw * s].reshape(rows, bw, s)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        pixels[y : y + rows, x : x + bw] = block
    return Page(index, pixels[:h, :w], compression, predictor, tiled)


PAGES = "page int, width int, height int, samples int, compression int, predictor int, tiled boolean, pixels binary, error string"


def pages(files: DataFrame, id_col: str = "id", file_col: str = "file") -> DataFrame:
    """One row per page of each file: the id, the page's place and shape, and its samples."""
    small_batches(files.sparkSession)
    picked = files.select(files[id_col].alias("id"), files[file_col].alias("file"))
    schema = f"id {picked.schema['id'].dataType.simpleString()}, {PAGES}"
    names = [x.split()[0] for x in PAGES.split(", ")]

    def rows(batches):
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not data:
                    continue
                try:
                    found = [(p.index, p.pixels.shape[1], p.pixels.shape[0], p.pixels.shape[2], p.compression, p.predictor, p.tiled, p.pixels.tobytes(), None) for p in read_pages(data)]
                except (ValueError, KeyError, IndexError, struct.error, zlib.error) as error:
                    found = [(None,) * 8 + (str(error)[:200],)]
                if found:
                    yield pa.RecordBatch.from_pydict({"id": pa.array([key] * len(found), batch.schema.field(0).type)} | {n: pa.array(v, kind) for n, v, kind in zip(names, zip(*found, strict=True), KINDS, strict=True)})

    return picked.mapInArrow(rows, schema)


KINDS = [pa.int32()] * 6 + [pa.bool_(), pa.binary(), pa.string()]

QUERY = "op9_tiff_pages"
SIDE = 64
PAGE_ROWS = 128


def stored(payload: bytes) -> bytes:
    """A payload of a positive multiple of 64 bytes as a TIFF of 64 samples a row.

    Its CRC alone chooses, whatever the size: LZW strips, PackBits strips, deflate tiles with the
    horizontal predictor, or deflate strips without or with it. A page holds PAGE_ROWS rows.
    """
    image = np.frombuffer(payload, np.uint8).reshape(-1, SIDE)
    images = [image[lo : lo + PAGE_ROWS] for lo in range(0, len(image), PAGE_ROWS)]
    kind = zlib.crc32(payload) % 5
    if kind == 0:
        return write_tiff(images, LZW, rows_per_strip=64)
    if kind == 1:
        return write_tiff(images, PACKBITS, rows_per_strip=64)
    if kind == 2:
        return write_tiff(images, DEFLATE, predictor=2, tile=(64, 64))
    return write_tiff(images, DEFLATE, predictor=kind - 2, rows_per_strip=64)


def feature(found: list[Page]) -> str:
    """Pages, coding, sum, extremes and the share of distinct samples, from the decoded samples."""
    samples = np.concatenate([p.pixels.reshape(-1) for p in found])
    counts = np.bincount(samples, minlength=256)
    seen = np.flatnonzero(counts)
    total = int(counts @ np.arange(256))
    return f"pages={len(found)};coding={found[0].compression}/{found[0].predictor}/{int(found[0].tiled)};mean={total / len(samples):.4f};min={seen[0]};max={seen[-1]};distinct={len(seen)}"


MEDIA = pa.schema([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("pages", pa.int32())])


def media_row(text: str) -> tuple:
    raw = text.encode()
    media = stored(raw + b"\0" * ((-len(raw)) % SIDE or (0 if raw else SIDE)))
    found = read_pages(media)
    back = b"".join(p.pixels.tobytes() for p in found)
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-SIDE:]), len(media), hashlib.sha256(media).hexdigest(), feature(found), len(found)


def op9_tiff_pages(spark, sf_dir):
    """Every text stored as a TIFF and read back; null texts are empty, equal texts give equal rows."""
    small_batches(spark)

    def rows(batches):
        for batch in steps(batches):
            found = [media_row(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), MEDIA, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *MEDIA.names])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages int")
