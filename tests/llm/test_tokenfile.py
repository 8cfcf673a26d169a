import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidelog.llm import tokenfile


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenfile.vocabulary_path())


def want(library, rows):
    out, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def got(frame):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in frame.collect()), key=lambda r: r[1])


def test_query(spark, sf, docs, library):
    assert got(tokenfile.op8_tokenfile(spark, sf)) == want(library, [(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("block", [1, 1 << 18])
def test_odd_rows(spark, odd, none, library, block):
    assert got(tokenfile.read(tokenfile.write(odd, block=block))) == want(library, [(r.doc_id, r.text) for r in odd.collect()])
    assert tokenfile.read(tokenfile.write(none)).count() == 0


def test_the_same_ids_as_the_library(library):
    rnd, ids = random.Random(5), tokenfile.Ids(tokenfile.vocabulary_path())
    letters = "abcABC    \n\n\t\x1c\x1d\x85\xa0 ßİΣσςéÉ́ñ1²½٣'’sdllre.!?&<|>日本語😀​\u0000ǅﬁK"
    for t in ["".join(rnd.choice(letters) for _ in range(rnd.randrange(50))) for _ in range(2000)] + ["", "<|endoftext|>", "x <|endoftext|>y", "a  ", "\n\n"]:
        assert ids.of(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_codes():
    rng = np.random.default_rng(1)
    for n, limit in ((1, 16), (2, 16), (300, 9), (5000, 13), (40, 30)):
        counts = (rng.pareto(0.3, n) * 10 + 1).clip(1, 1e12).astype(np.int64)
        lengths = tokenfile.code_lengths(counts, limit)
        assert lengths.max() <= limit and sum(2.0 ** -int(x) for x in lengths) <= 1
        codes = tokenfile.canonical(lengths)
        words = sorted(f"{int(c):0{int(k)}b}" for c, k in zip(codes, lengths, strict=True))
        assert all(not b.startswith(a) for a, b in zip(words, words[1:], strict=False))
    with pytest.raises(ValueError):
        tokenfile.code_lengths(np.ones(20, dtype=np.int64), 4)


def test_best_lengths_without_a_limit():
    """Package-merge with room to spare costs what Huffman's algorithm costs."""
    import heapq

    counts = np.random.default_rng(2).integers(1, 1000, 200)
    heap = counts.tolist()
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    assert int((counts * tokenfile.code_lengths(counts, 30).astype(np.int64)).sum()) == cost


def test_pack_and_unpack():
    rng = np.random.default_rng(3)
    ids = (rng.pareto(1.0, 20_000) * 20).clip(0, 3000).astype(np.int64)
    counts = np.array([0, 1, 255, 256, 257, 0, 5000, len(ids) - 5769])
    lengths = tokenfile.code_lengths(np.bincount(ids), 14)
    bits, place, checkpoints = tokenfile.pack(ids, counts, tokenfile.canonical(lengths), lengths)
    offsets = np.concatenate([c + 8 * p for c, p in zip(checkpoints, place, strict=False)])
    assert (tokenfile.Decoder(lengths).unpack(bits, offsets, counts) == ids).all()
