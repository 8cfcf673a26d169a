import hashlib
import zlib

import numpy as np
import pytest

from tidelog.llm import tiff


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("tile", [0, 16, 48])
def test_round_trip(compression, predictor, order, tile):
    rng = np.random.default_rng(3)
    for n in (64, 64 * 33, 64 * 700):
        for x in (rng.integers(0, 256, n, dtype=np.uint8), np.repeat(rng.integers(0, 4, n // 16 + 1, dtype=np.uint8), 16)[:n], np.zeros(n, dtype=np.uint8)):
            blob = tiff.write(x.tobytes(), compression, predictor, order, tile)
            assert b"".join(p.pixels.tobytes() for p in tiff.pages(blob)) == x.tobytes()


def test_pages(spark, monkeypatch):
    monkeypatch.setattr(tiff, "PAGE_ROWS", 10)
    blob = tiff.write(bytes(range(64)) * 35)
    d = spark.createDataFrame([(1, blob, 5), (2, None, 6), (3, b"nonsense", 7), (4, blob[:200], 8), (5, b"", 9)], "id long, media binary, page int")
    got = tiff.tiff_pages(d).collect()
    assert [(r.page, r.height) for r in got if r.id == 1] == [(0, 10), (1, 10), (2, 10), (3, 5)]
    assert {r.id for r in got if r.error} == {3, 4, 5}
    assert tiff.tiff_pages(d.limit(0)).count() == 0


def test_circular_directories():
    blob = bytearray(tiff.write(bytes(64)))
    at = int.from_bytes(blob[4:8], "little")
    n = int.from_bytes(blob[at : at + 2], "little")
    blob[at + 2 + 12 * n : at + 6 + 12 * n] = blob[4:8]
    with pytest.raises(tiff.TiffError):
        list(tiff.pages(bytes(blob)))


def want(text):
    raw = (text or "").encode()
    payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


def test_query(spark, sf, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = tiff.op4_tiff(spark, sf).collect()
    assert len(got) == len(texts)
    assert all((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == want(texts[r.doc_id]) for r in got)


def test_odd_rows(spark, odd, none):
    got = tiff.digest(tiff.store(odd)).collect()
    assert sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want(r.text) for r in odd.collect())
    same = {(r.media_sha256, r.feature) for r in got if r.doc_id in (1, 4)}
    assert len(same) == 1 and tiff.digest(tiff.store(none)).count() == 0
