"""Operator 4: TIFF images in a media column.

Reading walks the chain of image directories, of either byte order, decodes strips or tiles stored plain or by PackBits, LZW or
deflate, undoes the horizontal predictor, and gives one row a page. Writing makes baseline grey images of 8-bit samples,
a page for at most PAGE_ROWS rows, so the memory for a page is bounded, and a file may have any number of pages.

The query stores the bytes of each text as the samples of such a file, reads the file back page by page, and derives its columns
from what it has read: nothing of the original bytes goes past the file.

Features are taken page by page in one pass over the decoded samples: a histogram of 16 levels, the mean, and the bits of an
8 x 8 grid over the rows that lie above the mean of the grid.

Samples of 1, 8 and 16 bits are read, in chunky or planar order; 1-bit samples are given as a byte each, 0 or 1, as they are stored.

Defined results: null text is stored as the empty text, 64 zero bytes; a file that isn't TIFF, is damaged or cut off, or declares more samples than its
bytes can hold (by the greatest ratio of each compression) or than MOST in one page, gives the pages before the fault and then a row with a message in the
column `error`; a null file gives no row; texts of any length are stored whole; repeated rows give repeated rows; a null doc_id stays null; an empty table gives
an empty table. Other columns are not read.
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
from pyspark.sql import functions as F

from .common import table

WIDTH = 64
#: Rows of a page (4 MiB at 64 columns), and of a strip.
PAGE_ROWS = 1 << 16
STRIP_ROWS = 1 << 12

#: Bytes of samples that a page may have: what a reader holds at once.
MOST = 1 << 30

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: No data of these compressions grows by more than this.
_RATIO = {NONE: 1, LZW: 4096, DEFLATE: 1040, OLD_DEFLATE: 1040, PACKBITS: 64}
#: Bytes of a value of each field type of TIFF 6.0, and its struct letter.
_TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d")}


class TiffError(ValueError):
    pass


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    pixels: np.ndarray  # (height, width, samples), uint8 or uint16


def unpackbits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def packbits(data: bytes) -> bytes:
    """Runs of three or more as a run, anything else as literals."""
    a = np.frombuffer(data, dtype=np.uint8)
    if not len(a):
        return b""
    edge = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    sizes = np.diff(np.append(edge, len(a)))
    out, literal = bytearray(), 0
    for at, n in zip(edge[sizes >= 3].tolist(), sizes[sizes >= 3].tolist(), strict=True):
        _literals(out, data[literal:at])
        for lo in range(0, n, 128):
            k = min(128, n - lo)
            out += bytes((257 - k if k > 1 else 0, data[at]))
        literal = at + n
    _literals(out, data[literal:])
    return bytes(out)


def _literals(out: bytearray, data: bytes) -> None:
    for lo in range(0, len(data), 128):
        part = data[lo : lo + 128]
        out.append(len(part) - 1)
        out += part


def unlzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, first bit highest; the width grows one code early, as TIFF writers do."""
    out, known = bytearray(), [bytes((i,)) for i in range(256)] + [b"", b""]
    bits = held = 0
    width, before = 9, b""
    for byte in data:
        held = held << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 256:
            del known[258:]
            width, before = 9, b""
            continue
        if code == 257:
            break
        if code < len(known):
            piece = known[code]
        elif code == len(known) and before:
            piece = before + before[:1]
        else:
            raise TiffError("LZW code out of range")
        out += piece
        if before:
            known.append(before + piece[:1])
        before = piece
        if len(out) >= size:
            break
        width = 9 if len(known) < 511 else 10 if len(known) < 1023 else 11 if len(known) < 2047 else 12
    return bytes(out)


def lzw(data: bytes) -> bytes:
    known, out, held, bits, width = {bytes((i,)): i for i in range(256)}, bytearray(), 256, 9, 9
    count, run = 258, b""

    def put(code: int) -> None:
        nonlocal held, bits
        held = held << width | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    while bits >= 8:
        bits -= 8
        out.append(held >> bits & 255)
    held &= (1 << bits) - 1
    for i in range(len(data)):
        longer = run + data[i : i + 1]
        if longer in known:
            run = longer
            continue
        put(known[run])
        known[longer] = count
        count += 1
        run = longer[-1:]
        if count == 4094:
            put(256)
            known = {bytes((k,)): k for k in range(256)}
            count, width = 258, 9
        else:
            width = 9 if count < 512 else 10 if count < 1024 else 11 if count < 2048 else 12
    if run:
        put(known[run])
        count += 1
        width = 9 if count < 512 else 10 if count < 1024 else 11 if count < 2048 else 12
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def expand(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        out = data[:size]
    elif compression in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    elif compression == PACKBITS:
        out = unpackbits(data, size)
    elif compression == LZW:
        out = unlzw(data, size)
    else:
        raise TiffError(f"compression {compression}")
    if len(out) < size:
        raise TiffError("cut off")
    return out[:size]


def compress(data: bytes, compression: int) -> bytes:
    return {NONE: bytes, DEFLATE: lambda x: zlib.compress(x, 1), PACKBITS: packbits, LZW: lzw}[compression](data)


def pages(blob: bytes) -> Iterator[Page]:
    """Pages of a file, one at a time."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(blob[:2]))
    try:
        if order is None or struct.unpack_from(f"{order}H", blob, 2)[0] != 42:
            raise TiffError("not TIFF")
        (at,), number, seen = struct.unpack_from(f"{order}I", blob, 4), 0, set()
        while at:
            if at in seen:
                raise TiffError("directories form a circle")
            seen.add(at)
            fields = {}
            (n,) = struct.unpack_from(f"{order}H", blob, at)
            for k in range(n):
                tag, kind, count = struct.unpack_from(f"{order}HHI", blob, at + 2 + 12 * k)
                if kind not in _TYPES:
                    continue
                size, letter = _TYPES[kind]
                spot = at + 10 + 12 * k
                if size * count > 4:
                    (spot,) = struct.unpack_from(f"{order}I", blob, spot)
                fields[tag] = struct.unpack_from(f"{order}{count * len(letter)}{letter[0]}", blob, spot)
            yield _page(blob, order, fields, number)
            (at,) = struct.unpack_from(f"{order}I", blob, at + 2 + 12 * n)
            number += 1
    except TiffError:
        raise
    except struct.error as e:
        raise TiffError("cut off") from e
    except zlib.error as e:
        raise TiffError("damaged deflate data") from e
    except (ValueError, IndexError, OverflowError, MemoryError) as e:
        raise TiffError(f"damaged: {e}") from e


def _page(blob: bytes, order: str, fields: dict, number: int) -> Page:
    def one(tag: int, default: int | None = None) -> int:
        if tag not in fields and default is None:
            raise TiffError(f"no field {tag}")
        return fields[tag][0] if tag in fields else default

    width, height, samples = one(256), one(257), one(277, 1)
    bits, compression, predictor, planar = one(258, 1), one(259, 1), one(317, 1), one(284, 1)
    if bits not in (1, 8, 16) or len(set(fields.get(258, (1,)))) > 1 or planar not in (1, 2) or predictor not in (1, 2) or bits == 1 and predictor == 2:
        raise TiffError(f"{fields.get(258, (1,))} bits, planar configuration {planar}, predictor {predictor}")
    if compression not in _RATIO:
        raise TiffError(f"compression {compression}")
    tiled = 324 in fields
    high, wide = (one(323), one(322)) if tiled else (min(one(278, height), height), width)
    if min(width, height, samples, high, wide) < 1:
        raise TiffError("no samples")
    planes, each = (samples, 1) if planar == 2 else (1, samples)
    across, down = -(-width // wide), -(-height // high)
    places, sizes = (fields[324], fields.get(325, ())) if tiled else (fields.get(273, ()), fields.get(279, ()))
    if not sizes and across * down * planes == 1 and compression == NONE:
        sizes = (height * -(-width * samples * bits // 8),)
    if min(len(places), len(sizes)) < across * down * planes:
        raise TiffError("cut off")
    if height * width * samples * (2 if bits == 16 else 1) > MOST or high * wide * each * (2 if bits == 16 else 1) > MOST:
        raise TiffError("page too large")
    boxes = [(y * high, x * wide, high if tiled else min(high, height - y * high), wide) for y in range(down) for x in range(across)]
    lines = -(-wide * each * bits // 8)  # bytes of a line of a box
    for (_, _, h, _), place, size in zip(boxes * planes, places, sizes, strict=False):
        if place + size > len(blob) or h * lines > _RATIO[compression] * size + 64:
            raise TiffError("cut off")
    kind = np.dtype(np.uint16).newbyteorder(order) if bits == 16 else np.dtype(np.uint8)
    out = np.zeros((height, width, samples), dtype=kind.newbyteorder("="))
    for k, ((y, x, h, w), place, size) in enumerate(zip(boxes * planes, places, sizes, strict=False)):
        raw = expand(bytes(blob[place : place + size]), compression, h * lines)
        if bits == 1:
            box = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(h, lines), axis=1)[:, : w * each].reshape(h, w, each)
        else:
            box = np.frombuffer(raw, dtype=kind).reshape(h, w, each).astype(out.dtype, copy=False)
        if predictor == 2:
            box = np.cumsum(box, axis=1, dtype=out.dtype)
        plane = slice(None) if planar == 1 else slice(k // len(boxes), k // len(boxes) + 1)
        part = out[y : y + h, x : x + w, plane]
        part[...] = box[: part.shape[0], : part.shape[1]]
    return Page(number, width, height, samples, bits, compression, predictor, out)


def write(payload: bytes, compression: int = DEFLATE, predictor: int = 1, order: str = "<", tile: int = 0) -> bytes:
    """A file of 8-bit grey pages of WIDTH columns that hold the payload, whose length must be a multiple of WIDTH.

    tile: side of square tiles, a multiple of 16, instead of strips.
    """
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    out = bytearray(struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for top in range(0, len(rows), PAGE_ROWS):
        page = rows[top : top + PAGE_ROWS]
        if tile:
            grid = np.zeros((-(-len(page) // tile) * tile, -(-WIDTH // tile) * tile), dtype=np.uint8)
            grid[: len(page), :WIDTH] = page
            boxes = [grid[y : y + tile, x : x + tile] for y in range(0, grid.shape[0], tile) for x in range(0, grid.shape[1], tile)]
        else:
            boxes = [page[y : y + STRIP_ROWS] for y in range(0, len(page), STRIP_ROWS)]
        places, sizes = [], []
        for box in boxes:
            if predictor == 2:
                box = np.diff(box, axis=1, prepend=np.zeros((len(box), 1), dtype=np.uint8))
            data = compress(np.ascontiguousarray(box).tobytes(), compression)
            places.append(len(out))
            sizes.append(len(data))
            out += data
        fields = [(256, 4, [WIDTH]), (257, 4, [len(page)]), (258, 3, [8]), (259, 3, [compression]), (262, 3, [1]), (277, 3, [1]), (284, 3, [1]), (317, 3, [predictor])]
        fields += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, places), (325, 4, sizes)] if tile else [(273, 4, places), (278, 4, [min(STRIP_ROWS, len(page))]), (279, 4, sizes)]
        body = b""
        entries = []
        for tag, kind, values in sorted(fields):
            data = struct.pack(f"{order}{len(values)}{_TYPES[kind][1]}", *values)
            if len(data) > 4:
                entries.append((tag, kind, len(values), struct.pack(f"{order}I", len(out) + len(body))))
                body += data
            else:
                entries.append((tag, kind, len(values), data.ljust(4, b"\0")))
        out += body + bytes(len(out + body) % 2)
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(entries)) + b"".join(struct.pack(f"{order}HHI", *e[:3]) + e[3] for e in entries)
        link = len(out)
        out += bytes(4)
    return bytes(out)


class Feature:
    """Histogram, mean and grid of samples that come page by page."""

    def __init__(self) -> None:
        self.levels, self.sums = np.zeros(16, dtype=np.int64), []

    def add(self, pixels: np.ndarray) -> None:
        self.levels += np.bincount(pixels.ravel() >> (4 if pixels.dtype == np.uint8 else 12), minlength=16)
        flat = pixels.reshape(len(pixels), -1)
        columns = np.linspace(0, flat.shape[1], 9).astype(int)[:-1]
        self.sums.append(np.add.reduceat(flat.astype(np.int64), columns, axis=1))

    def text(self) -> str:
        rows = np.concatenate(self.sums) if self.sums else np.zeros((1, 8), dtype=np.int64)
        edges = np.linspace(0, len(rows), 9).astype(int)
        total = np.concatenate([np.zeros((1, 8), dtype=np.int64), np.cumsum(rows, axis=0)])
        grid = (total[edges[1:]] - total[edges[:-1]]) / np.maximum(edges[1:] - edges[:-1], 1)[:, None]
        mark = np.packbits((grid > grid.mean()).ravel()).tobytes().hex()
        share = self.levels * 255 // max(1, int(self.levels.sum()))
        return f"{bytes(share.tolist()).hex()}:{mark}"


def tiff_pages(media: DataFrame, column: str = "media") -> DataFrame:
    """A row for each page of each file: the other columns are not kept but for `id`, which names the file.

    media(id, <column> binary) -> id, page, width, height, samples, bits, compression, predictor, pixels, error.
    """
    ddl = "id long, page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *[pa.int32()] * 7, pa.binary(), pa.string()]
        names = [f.split(" ")[0] for f in ddl.split(", ")]
        for b in batches:
            for key, blob in zip(b.column(0), b.column(1), strict=True):
                if not blob.is_valid:
                    continue
                found: Iterator[tuple] = ((p.number, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.pixels.tobytes(), None) for p in pages(blob.as_py()))
                while True:
                    try:
                        row = next(found, None)
                    except TiffError as e:
                        row, found = (*[None] * 8, str(e)), iter(())
                    if row is None:
                        break
                    yield pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip([key.as_py(), *row], kinds, strict=True)], names)

    return media.select(F.col("id").cast("long"), F.col(column).cast("binary")).mapInArrow(run, ddl)


def store(docs: DataFrame, compression: int = DEFLATE, predictor: int = 1) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, media: the text in UTF-8, filled with zero bytes to whole rows, as an image file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                raw = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column(1)]
                media = [write(x.ljust(max(1, -(-len(x) // WIDTH)) * WIDTH, b"\0"), compression, predictor) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], type=pa.int64()), pa.array(media, type=pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def digest(media: DataFrame) -> DataFrame:
    """store()'s rows -> what reading the files gives: sizes, hashes and features of the samples, page after page."""
    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in ddl.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part, rows = b.slice(lo, 64), []
                for x in part.column(2):
                    blob = x.as_buffer().to_pybytes()
                    size, sha, tail, feature, count = 0, hashlib.sha256(), b"", Feature(), 0
                    for page in pages(blob):
                        data = page.pixels.tobytes()
                        sha.update(data)
                        size, tail, count = size + len(data), (tail + data)[-64:] if len(data) < 64 else data[-64:], count + 1
                        feature.add(page.pixels)
                    rows.append((size, sha.hexdigest(), zlib.crc32(tail), len(blob), hashlib.sha256(blob).hexdigest(), feature.text(), count))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(list(c), type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    return media.mapInArrow(run, ddl)


def op4_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(store(table(spark, sf_dir, "documents"), DEFLATE, predictor=2))
