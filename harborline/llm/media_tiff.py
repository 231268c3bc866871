"""TIFF media columns: one row per page of each image.

`pages` walks the chain of image directories of every media value, decodes PackBits, LZW or deflate strips
and tiles, undoes horizontal prediction and emits one row per page; a value that is no readable
TIFF gives a row with an error after the rows of the pages before the fault.  `stored` writes payloads as TIFF: 64
samples a row, 8 bits each, pages of bounded height, so a value of any length is decoded a page at a time.
The compression is chosen by the payload's CRC-32: a third of all different payloads, of whatever size, are LZW
tiles, a third PackBits strips, a third deflate strips with prediction.

What a file declares is checked against its length before memory is taken: no decoder makes more than `GAIN`
bytes of one.  Samples in planes of their own and other bit depths than 8 are errors.

Edge cases: null and empty texts are a payload of 64 zero bytes; null media gives one row with an
error; equal texts give equal values; other columns are ignored; repeated rows are kept.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from harborline.llm.common import table

#: Fixed values of the format: tags, compressions, sizes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_SIZES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, PLANAR = 317, 322, 323, 324, 325, 284
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Most bytes that a byte of compressed data can stand for (LZW: 12 bits for an entry of under 4096 bytes).
GAIN = 4096
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


@dataclass(frozen=True)
class Settings:
    row: int = 64  # samples of a row
    page_rows: int = 4096
    strip_rows: int = 256
    tile_rows: int = 64


@dataclass
class Page:
    number: int
    compression: int
    predictor: int
    pixels: np.ndarray  # rows x (width * samples), uint8


def packbits(data: bytes) -> bytes:
    """Runs of three or more as (1 - n, byte), the rest as literals of at most 128 bytes."""
    a = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, int)
    size = np.diff(np.append(edge, len(a)))
    out, literal = [], 0
    at = 0

    def flush(upto: int) -> None:
        for i in range(literal, upto, 128):
            part = data[i : min(i + 128, upto)]
            out.append(bytes([len(part) - 1]) + part)

    for at, n in zip(edge[size >= 3].tolist(), size[size >= 3].tolist(), strict=True):
        flush(at)
        for i in range(0, n, 128):
            k = min(128, n - i)
            out.append(bytes([(257 - k) & 255, data[at]]) if k > 1 else bytes([0, data[at]]))
        literal = at + n
    flush(len(data))
    return b"".join(out)


def unpackbits(data: bytes) -> bytes:
    out, i = [], 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out.append(data[i + 1 : i + 2 + n])
            i += n + 2
        elif n > 128:
            out.append(data[i + 1 : i + 2] * (257 - n))
            i += 2
        else:
            i += 1
    return b"".join(out)


CLEAR, END, FIRST, TOP = 256, 257, 258, 4094
_START = [bytes([i]) for i in range(256)] + [b"", b""]


def code_widths(n: int) -> np.ndarray:
    """Bits of the first n codes after a clear code: both sides' tables grow by one entry a code, and widths change one code early."""
    return np.clip(np.frexp(np.arange(FIRST, FIRST + n))[1], 9, 12)


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first, one code early, a clear code first and an end code last."""
    segments, codes, known, size = [], [CLEAR], {}, FIRST
    w = data[0] if data else None
    for b in data[1:]:
        x = w << 8 | b
        longer = known.get(x)
        if longer is not None:
            w = longer
            continue
        codes.append(w)
        known[x] = size
        size += 1
        if size == TOP:
            segments.append(codes)
            codes, known, size = [CLEAR], {}, FIRST
        w = b
    segments.append(codes if w is None else [*codes, w])
    segments[-1].append(END)
    flat = np.array([c for x in segments for c in x])
    # a clear code has the width that follows the codes before it; the first one has 9 bits
    widths = np.concatenate([np.append(9 if not i else 12, code_widths(len(x) - 1)) for i, x in enumerate(segments)])
    places = np.arange(11, -1, -1)
    bits = (flat[:, None] >> places & 1).astype(np.uint8)
    return np.packbits(bits[places < widths[:, None]]).tobytes()


def _codes(data: np.ndarray, at: int) -> np.ndarray:
    """The codes from bit `at` up to the next clear or end code (that included), or as many as one table takes."""
    n = min((len(data) * 8 - at) // 9, 1 << 12)
    widths = code_widths(max(n, 0))
    begin = at + np.cumsum(widths) - widths
    fits = begin + widths <= len(data) * 8
    begin, widths = begin[fits], widths[fits]
    padded = np.append(data, np.zeros(4, np.uint8)).astype(np.int64)
    byte = begin >> 3
    value = padded[byte] << 16 | padded[byte + 1] << 8 | padded[byte + 2]
    codes = value >> (24 - (begin & 7) - widths) & ((1 << widths) - 1)
    stop = np.flatnonzero((codes == CLEAR) | (codes == END))
    return codes[: stop[0] + 1] if len(stop) else codes


def unlzw(data: bytes) -> bytes:
    out: list[bytes] = []
    body, at, old = np.frombuffer(data, np.uint8), 0, b""
    known = list(_START)
    while True:
        codes = _codes(body, at)
        at += int(code_widths(len(codes)).sum())
        for code in codes.tolist():
            if code == CLEAR or code == END:
                break
            if code < len(known):
                entry = known[code]
            elif code == len(known) and old:
                entry = old + old[:1]
            else:
                raise ValueError("LZW code beyond the table")
            if old and len(known) < 1 << 12:
                known.append(old + entry[:1])
            out.append(entry)
            old = entry
        if not len(codes) or codes[-1] == END:
            return b"".join(out)
        if codes[-1] == CLEAR:
            known, old = list(_START), b""
        else:  # a table that stays full: its codes go on in 12 bits
            raise ValueError("LZW data without a clear code")


_PACK = {NONE: lambda x: x, LZW: lzw, DEFLATE: lambda x: zlib.compress(x, 1), PACKBITS: packbits}


def inflate(data: bytes, size: int) -> bytes:
    return zlib.decompressobj().decompress(data, max(1, size))


#: (bytes, samples expected) -> samples.
_UNPACK = {
    NONE: lambda x, _: x, LZW: lambda x, _: unlzw(x), DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: lambda x, _: unpackbits(x),
}


def write_tiff(images: list[np.ndarray], compression: int, predictor: int = 1, strip_rows: int = 256, tile: tuple[int, int] | None = None) -> bytes:
    """Grey 8-bit pages as a little-endian TIFF."""
    out, at_link = bytearray(struct.pack("<2sHI", b"II", 42, 0)), 4
    for image in images:
        h, w = image.shape
        if tile:
            th, tw = tile
            full = np.zeros((-(-h // th) * th, -(-w // tw) * tw), np.uint8)
            full[:h, :w] = image
            parts = [full[y : y + th, x : x + tw] for y in range(0, full.shape[0], th) for x in range(0, full.shape[1], tw)]
        else:
            parts = [image[y : y + strip_rows] for y in range(0, h, strip_rows)]
        places, sizes = [], []
        for p in parts:
            if predictor == 2:
                p = np.diff(p, axis=1, prepend=np.zeros((len(p), 1), np.uint8))
            body = _PACK[compression](np.ascontiguousarray(p).tobytes())
            places.append(len(out))
            sizes.append(len(body))
            out += body
        out += b"\0" * (len(out) % 2)
        fields = [(WIDTH, [w]), (HEIGHT, [h]), (BITS, [8]), (COMPRESSION, [compression]), (PHOTOMETRIC, [1]), (SAMPLES, [1]), (PREDICTOR, [predictor])]
        fields += [(TILE_WIDTH, [tile[1]]), (TILE_HEIGHT, [tile[0]]), (TILES, places), (TILE_SIZES, sizes)] if tile else [(STRIPS, places), (ROWS, [strip_rows]), (STRIP_SIZES, sizes)]
        entries = []
        for tag, values in sorted(fields):
            if len(values) == 1:
                entries.append(struct.pack("<HHII", tag, 4, 1, values[0]))
            else:
                entries.append(struct.pack("<HHII", tag, 4, len(values), len(out)))
                out += struct.pack(f"<{len(values)}I", *values)
        out[at_link : at_link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        at_link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(data: bytes) -> Iterator[dict[int, list[int]]]:
    """The fields of each page along the directory chain; ValueError for what can't be read."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at:
        if at in seen or at + 2 > len(data):
            raise ValueError("broken chain of directories")
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        fields: dict[int, list[int]] = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind not in (1, 3, 4):
                continue
            size = TYPE_SIZE[kind] * count
            place = at + 10 + 12 * i
            if size > 4:
                place = struct.unpack_from(order + "I", data, place)[0]
            fields[tag] = list(struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", data, place))
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
        yield fields


def read_tiff(data: bytes) -> Iterator[Page]:
    """The pages in the order of the directory chain; ValueError for what can't be read, after the pages before it."""
    for number, fields in enumerate(directories(data)):
        one = lambda tag, default=None: fields.get(tag, [default])[0]  # noqa: E731, B023
        w, h, samples, compression, predictor = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
        if not w or not h or not samples or set(fields.get(BITS, [1])) != {8} or compression not in _UNPACK or predictor not in (1, 2):
            raise ValueError("unsupported page")
        if samples > 1 and one(PLANAR, 1) != 1:
            raise ValueError("samples in planes of their own")
        if TILES in fields:
            pw, ph, places, sizes = one(TILE_WIDTH), one(TILE_HEIGHT), fields[TILES], fields[TILE_SIZES]
        else:
            pw, ph, places, sizes = w, min(h, one(ROWS, h)), fields[STRIPS], fields[STRIP_SIZES]
        if not pw or not ph:
            raise ValueError("strips or tiles without rows or columns")
        down, across = -(-h // ph), -(-w // pw)
        if len(places) != down * across or len(sizes) != len(places):
            raise ValueError("too few or too many strips or tiles")
        if down * ph * across * pw * samples > GAIN * len(data):
            raise ValueError("a page larger than the data can hold")
        pixels = np.zeros((down * ph, across * pw * samples), np.uint8)
        for k, (a, size) in enumerate(zip(places, sizes, strict=True)):
            y, x = k // across * ph, k % across * pw * samples
            rows = ph if TILES in fields else min(ph, h - y)
            n = rows * pw * samples
            part = np.frombuffer(_UNPACK[compression](data[a : a + size], n), np.uint8, n).reshape(rows, pw, samples)
            if predictor == 2:
                part = np.cumsum(part, axis=1, dtype=np.uint8)
            pixels[y : y + rows, x : x + pw * samples] = part.reshape(rows, -1)
        yield Page(number, compression, predictor, pixels[:h, : w * samples])


def pages(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """key, page, width, height, compression, predictor, pixels (binary), error: one row per page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    if data is None:
                        raise ValueError("no media")
                    for p in read_tiff(data):
                        rows.append((k, p.number, p.pixels.shape[1], p.pixels.shape[0], p.compression, p.predictor, p.pixels.tobytes(), None))
                except (ValueError, KeyError, TypeError, struct.error, zlib.error, IndexError) as e:
                    rows.append((k, None, None, None, None, None, None, str(e)))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            types = [b.column(0).type, *[pa.int32()] * 5, pa.binary(), pa.string()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[key, "page", "width", "height", "compression", "predictor", "pixels", "error"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, media).mapInArrow(run, f"`{key}` {kind}, page int, width int, height int, compression int, predictor int, pixels binary, error string")


def as_tiff(payload: bytes, s: Settings) -> bytes:
    image = np.frombuffer(payload, np.uint8).reshape(-1, s.row)
    images = [image[i : i + s.page_rows] for i in range(0, len(image), s.page_rows)]
    kind = zlib.crc32(payload) % 3
    if kind == 0:
        return write_tiff(images, LZW, tile=(s.tile_rows, s.row))
    if kind == 1:
        return write_tiff(images, PACKBITS, strip_rows=s.strip_rows)
    return write_tiff(images, DEFLATE, predictor=2, strip_rows=s.strip_rows)


def stored(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_bytes, media: every whole text (doc_id, text) as a TIFF of its zero-padded UTF-8 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                texts = [(t or "").encode() for t in some.column("text").to_pylist()]
                media = [as_tiff(t + b"\0" * (s.row - len(t) if not t else -len(t) % s.row), s) for t in texts]
                yield pa.record_batch([some.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def described(data: bytes) -> tuple[int, str, int, str, int]:
    """Payload bytes, SHA-256, CRC-32 of the last 64 bytes, feature and pages of a TIFF, a page at a time.

    The feature: pages, rows, mean sample, and a 64-bit hash of block means against their mean, over the rows of all pages.
    """
    rows = sum(fields[HEIGHT][0] for fields in directories(data))
    blocks = np.array_split(np.arange(rows), min(8, rows))
    edges = [int(b[0]) for b in blocks] + [rows]
    sums, samples = np.zeros((len(blocks), 8), np.int64), np.zeros((len(blocks), 1), np.int64)
    sha, size, tail, at, n = hashlib.sha256(), 0, b"", 0, 0
    for page in read_tiff(data):
        x, body = page.pixels, page.pixels.tobytes()
        sha.update(body)
        size, tail, n = size + len(body), (tail + body[-64:])[-64:], n + 1
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            part = x[max(a - at, 0) : max(b - at, 0)]
            if len(part):
                sums[k] += part.reshape(len(part), 8, -1).sum(axis=(0, 2), dtype=np.int64)
                samples[k] += part.size // 8
        at += len(x)
    means = sums / samples
    bits = np.resize(means > means.mean(), 64)
    return size, sha.hexdigest(), zlib.crc32(tail), f"{n}:{rows}:{int(sums.sum()) / size:.4f}:{np.packbits(bits).tobytes().hex()}", n


def digests(media: DataFrame) -> DataFrame:
    """What is read back from the stored form (doc_id, n_bytes, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pages"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
        for b in batches:
            rows = []
            for k, n, data in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                size, sha, tail, feature, n_pages = described(data)
                rows.append((k, n, size, sha, tail, len(data), hashlib.sha256(data).hexdigest(), feature, n_pages))
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, [b.column("doc_id").type, *types], strict=True)], names=names)

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages int")


def op4_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(stored(table(spark, sf_dir, "documents")))
