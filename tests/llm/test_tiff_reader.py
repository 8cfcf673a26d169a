"""Files that others write, and files that lie."""

import struct
import time

import numpy as np
import pytest

from tidelog.llm import tiff


def build(fields, data, order="<"):
    """A file of one directory; fields: (tag, type, values). Strip offsets are counted from the data, which begins at byte 8."""
    body, entries, at = b"", [], 8 + len(data)
    for tag, kind, values in sorted(fields):
        raw = struct.pack(f"{order}{len(values)}{tiff._TYPES[kind][1]}", *values)
        if len(raw) > 4:
            entries.append((tag, kind, len(values), struct.pack(f"{order}I", at + len(body))))
            body += raw
        else:
            entries.append((tag, kind, len(values), raw.ljust(4, b"\0")))
    out = struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, at + len(body)) + data + body
    return out + struct.pack(f"{order}H", len(entries)) + b"".join(struct.pack(f"{order}HHI", *e[:3]) + e[3] for e in entries) + bytes(4)


def plain(width, height, data, **more):
    f = {256: (4, [width]), 257: (4, [height]), 258: (3, [8]), 259: (3, [1]), 273: (4, [8]), 278: (4, [height]), 279: (4, [len(data)])} | {int(k[1:]): v for k, v in more.items()}
    return build([(t, k, v) for t, (k, v) in f.items()], data)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
def test_one_bit(order, compression):
    pixels = np.random.default_rng(1).integers(0, 2, (9, 13), dtype=np.uint8)
    strips = [tiff.compress(np.packbits(pixels[y : y + 4], axis=1).tobytes(), compression) for y in (0, 4, 8)]
    at = np.cumsum([8, *map(len, strips)]).tolist()
    blob = build([(256, 3, [13]), (257, 3, [9]), (259, 3, [compression]), (273, 4, at[:3]), (278, 3, [4]), (279, 4, [len(s) for s in strips])], b"".join(strips), order)
    (page,) = tiff.pages(blob)
    assert page.bits == 1 and (page.pixels[..., 0] == pixels).all()


@pytest.mark.parametrize("bits", [8, 16])
def test_planes(bits):
    kind = np.dtype("<u2") if bits == 16 else np.dtype("u1")
    pixels = np.random.default_rng(2).integers(0, 1 << bits, (7, 5, 3)).astype(kind)
    strips = [pixels[y : y + 4, :, c].tobytes() for c in range(3) for y in (0, 4)]
    at = np.cumsum([8, *map(len, strips)]).tolist()
    fields = [(256, 3, [5]), (257, 3, [7]), (258, 3, [bits] * 3), (273, 4, at[:6]), (277, 3, [3]), (278, 3, [4]), (279, 4, [len(s) for s in strips]), (284, 3, [2])]
    (page,) = tiff.pages(build(fields, b"".join(strips)))
    assert (page.pixels == pixels).all()


LIES = {
    "too many rows for its bytes": plain(64, 1 << 30, bytes(64)),
    "a strip that is not there": plain(64, 4, bytes(256), _278=(4, [2])),
    "tiles without width": plain(64, 1, bytes(64), _322=(4, [0]), _323=(4, [16]), _324=(4, [8]), _325=(4, [64])),
    "no columns": plain(0, 4, bytes(64)),
    "a strip behind the end": plain(64, 1, bytes(64), _273=(4, [1 << 31])),
    "two widths of samples": plain(64, 1, bytes(128), _258=(3, [8, 16]), _277=(3, [2])),
    "rows beyond all memory": plain((1 << 32) - 1, (1 << 32) - 1, bytes(64), _259=(3, [5])),
    "tiny tiles of a huge page": plain(1 << 31, 1 << 31, bytes(64), _322=(4, [1]), _323=(4, [1]), _324=(4, [8]), _325=(4, [64])),
    "unknown compression": plain(64, 1, bytes(64), _259=(3, [7])),
    "deflate that is none": plain(64, 1, b"x" * 64, _259=(3, [8])),
    "a count beyond the file": plain(64, 1, bytes(64))[:-20],
}


@pytest.mark.parametrize("name", LIES)
def test_lies_are_reported(name):
    began = time.time()
    with pytest.raises(tiff.TiffError):
        list(tiff.pages(LIES[name]))
    assert time.time() - began < 1


def test_any_damage_is_an_error_row(spark):
    """Every byte of a small file replaced or cut: pages or an error, never a failed task."""
    good, rng, rows = bytearray(tiff.write(bytes(range(64)) * 3, tiff.LZW)), np.random.default_rng(3), []
    for i in range(len(good)):
        bad = bytearray(good)
        bad[i] = int(rng.integers(0, 256))
        rows += [(2 * i, bytes(bad)), (2 * i + 1, bytes(good[:i]))]
    rows += [(10_000 + i, blob) for i, blob in enumerate(LIES.values())]
    got = tiff.tiff_pages(spark.createDataFrame(rows, "id long, media binary")).collect()
    assert {r.id for r in got if r.error} >= {10_000 + i for i in range(len(LIES))} and all(r.error or r.pixels is not None for r in got)
