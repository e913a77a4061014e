import hashlib
import zlib

import numpy as np
import pytest

from larkspur.llm import tiff


@pytest.mark.parametrize("data", [b"", b"a", b"aaa", b"abc" * 200, bytes(range(256)) * 40, b"\0" * 5000, np.random.default_rng(1).integers(0, 256, 9000, dtype=np.uint8).tobytes(), np.random.default_rng(2).integers(0, 3, 40000, dtype=np.uint8).tobytes()])
def test_codecs_round_trip(data):
    assert tiff.unpackbits(tiff.packbits(data)) == data
    assert tiff.unlzw(tiff.lzw(data)) == data


@pytest.mark.parametrize("compression", [tiff.RAW, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS, tiff.OLD_DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_files_round_trip(compression, predictor, tile, order):
    rng = np.random.default_rng(3)
    images = [rng.integers(0, 9, (37, 50, 3), dtype=np.uint8), rng.integers(0, 256, (5, 7, 1), dtype=np.uint8)]
    data = tiff.write_tiff(images, compression, predictor, tile, rows_per_strip=10, order=order)
    found = tiff.read_pages(data)
    assert [p.pixels.tolist() for p in found] == [i.tolist() for i in images]


def test_pages_rows(spark):
    image = np.arange(64, dtype=np.uint8).reshape(8, 8)
    loop = bytearray(tiff.write_tiff([image]))
    loop[-4:] = loop[4:8]
    files = [(1, tiff.write_tiff([image, image])), (2, b"junk that is no file"), (3, None), (4, b""), (5, bytes(loop)), (6, tiff.write_tiff([image])[:60])]
    rows = tiff.pages(spark.createDataFrame([(a, b, "x") for a, b in files], "id long, file binary, page string")).collect()
    by = {}
    for r in rows:
        by.setdefault(r["id"], []).append(r)
    assert [len(by.get(k, [])) for k in range(1, 7)] == [2, 1, 0, 0, 1, 1]
    assert by[1][1]["page"] == 1 and bytes(by[1][1]["pixels"]) == image.tobytes() and by[2][0]["error"] and by[6][0]["error"]


@pytest.mark.parametrize("text", ["", "a", "x" * 64, "é" * 3000, "word " * 40, "lorem ipsum " * 9000])
def test_media_row(text):
    n, size, sha, crc, media, _, _, _ = tiff.media_row(text)
    raw = text.encode()
    whole = raw + b"\0" * (-len(raw) % 64 if raw else 64)
    assert (n, size, sha, crc) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
    assert tiff.media_row(text) == tiff.media_row(text) and media > 0


@pytest.mark.parametrize("size", [64, 256, 320, 8128, 8192, 8256, 200_000])
def test_every_coding_is_used_at_every_size(size):
    rng, codings = np.random.default_rng(size), {}
    size -= size % 64
    for _ in range(60):
        payload = rng.integers(97, 123, size, dtype=np.uint8).tobytes()
        found = tiff.read_pages(tiff.stored(payload)) if len(codings) < 5 else []
        if found:
            assert b"".join(p.pixels.tobytes() for p in found) == payload
            assert [len(p.pixels) for p in found[:-1]] == [tiff.PAGE_ROWS] * (len(found) - 1) and 0 < len(found[-1].pixels) <= tiff.PAGE_ROWS
            codings[found[0].compression, found[0].predictor, found[0].tiled] = zlib.crc32(payload) % 5
    assert codings == {(tiff.LZW, 1, False): 0, (tiff.PACKBITS, 1, False): 1, (tiff.DEFLATE, 2, True): 2, (tiff.DEFLATE, 1, False): 3, (tiff.DEFLATE, 2, False): 4}
