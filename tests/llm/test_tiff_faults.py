"""Faulty TIFF files give error rows after their good pages, and stop nothing; every codec has its share."""

import collections
import struct
import zlib

import numpy as np
import pytest

from harborline.llm import media_tiff as M


def patched(data: bytes, tag: int, value: int, page: int = 0) -> bytes:
    """data with the one value of a tag of a page replaced."""
    out, at = bytearray(data), struct.unpack_from("<I", data, 4)[0]
    for _ in range(page):
        at = struct.unpack_from("<I", data, at + 2 + 12 * struct.unpack_from("<H", data, at)[0])[0]
    for i in range(struct.unpack_from("<H", data, at)[0]):
        if struct.unpack_from("<H", data, at + 2 + 12 * i)[0] == tag:
            struct.pack_into("<I", out, at + 2 + 12 * i + 8, value)
            return bytes(out)
    raise KeyError(tag)


GOOD = [np.arange(40, dtype=np.uint8).reshape(8, 5), np.ones((6, 4), np.uint8)]


@pytest.mark.parametrize("tile", [None, (16, 16)])
def test_declared_geometry_is_checked(spark, tile):
    good = M.write_tiff(GOOD, M.PACKBITS, strip_rows=8, tile=tile)
    faults = [(M.WIDTH, 0), (M.HEIGHT, 0), (M.WIDTH, 1 << 31), (M.HEIGHT, 1 << 31), (M.SAMPLES, 0), (M.SAMPLES, 1 << 30), (M.COMPRESSION, 7), (M.BITS, 16)]
    faults += [(M.TILE_WIDTH, 0), (M.TILE_HEIGHT, 0), (M.TILE_WIDTH, 1 << 31)] if tile else [(M.ROWS, 0), (M.ROWS, 1)]
    rows = [(i, bytearray(patched(good, *f))) for i, f in enumerate(faults)] + [(99, bytearray(good))]
    got = M.pages(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert all(r.error for r in got if r.doc_id != 99) and {r.doc_id for r in got} == {r[0] for r in rows}
    assert [(r.width, r.height) for r in got if r.doc_id == 99] == [(5, 8), (4, 6)]


def test_pages_before_a_fault_are_kept(spark):
    data = patched(M.write_tiff(GOOD, M.LZW), M.ROWS, 0, page=1)
    got = M.pages(spark.createDataFrame([(1, bytearray(data))], "doc_id long, media binary")).collect()
    assert [(r.page, r.width, bool(r.error)) for r in got] == [(0, 5, False), (None, None, True)]
    assert bytes(got[0].pixels) == GOOD[0].tobytes()


def test_lzw_codes_beyond_the_table_are_errors():
    bits = "".join(f"{c:09b}" for c in (256, 65, 400, 257))
    with pytest.raises(ValueError):
        M.unlzw(int(bits.ljust(40, "0"), 2).to_bytes(5, "big"))


def test_bombs_stop_at_the_declared_size():
    image = np.zeros((4, 4), np.uint8)
    data = M.write_tiff([image], M.DEFLATE)
    bomb = zlib.compress(b"\0" * 10_000_000)
    data = patched(patched(data + bomb, M.STRIPS, len(data)), M.STRIP_SIZES, len(bomb))
    assert (next(M.read_tiff(data)).pixels == image).all()


def test_codecs_share_payloads_of_every_size():
    rng = np.random.default_rng(4)
    for n in (64, 640, 64_000):
        kinds = collections.Counter(next(M.directories(M.as_tiff(rng.integers(97, 123, n, np.uint8).tobytes(), M.Settings())))[M.COMPRESSION][0] for _ in range(90))
        assert set(kinds) == {M.LZW, M.PACKBITS, M.DEFLATE} and min(kinds.values()) > 12
