import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidelog.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary_path())


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def got(rows):
    return [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows]


def test_query(spark, sf, docs, library):
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = bpe.op7_bpe(spark, sf).collect()
    assert len(rows) == len(texts) and got(rows) == [want(library, texts[r.doc_id]) for r in rows]


def test_odd_rows(spark, odd, none, library):
    assert sorted(got(bpe.encode(odd).collect())) == sorted(want(library, r.text) for r in odd.collect())
    assert bpe.encode(none).count() == 0
    one = bpe.encode(odd.where("doc_id = 1"), texts=True).first()
    assert list(np.frombuffer(one.ids, "<u4")) == library.encode(odd.where("doc_id = 1").first().text, add_special_tokens=False).ids


def test_any_characters(library):
    rnd, m = random.Random(5), bpe.WordBpe(bpe.vocabulary_path())
    letters = "abcABC  \n\t\x1c\x1d\x85\xa0 ßİΣσςéÉ́ñ1²½٣'’sdllre.!?&<|>日本語😀​\u0000ǅﬁK,,.. "
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(50))) for _ in range(1500)] + ["<|endoftext|>", "x<|startoftext|> y<|ENDOFTEXT|>", "a" * 3000, "ab" * 4000, "the" * 500 + "!" * 900]
    for t, (ids, decoded) in zip(texts, m.encode_batch(texts), strict=True):
        e = library.encode(t, add_special_tokens=False).ids
        assert list(np.frombuffer(ids, "<u4")) == e and decoded.decode() == library.decode(e, skip_special_tokens=False)


def test_a_full_cache_changes_nothing(library, monkeypatch, docs):
    monkeypatch.setattr(bpe, "CACHE", 50)
    m, texts = bpe.WordBpe(bpe.vocabulary_path()), [r.text or "" for r in docs.limit(20).collect()]
    for lo in range(0, 20, 5):
        for t, (ids, _) in zip(texts[lo : lo + 5], m.encode_batch(texts[lo : lo + 5]), strict=True):
            assert list(np.frombuffer(ids, "<u4")) == library.encode(t, add_special_tokens=False).ids


def test_long_words_alone(library):
    """Words beyond the trees of many rows, against the library and against those trees."""
    import time

    rnd, m = random.Random(3), bpe.WordBpe(bpe.vocabulary_path())
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(n)) for n in (513, 600, 1024, 5000, 32_000)] + ["a" * 3000, "the" * 700]
    for w in words:
        ids = np.frombuffer(m.encode_words([w.encode()])[0], dtype="<u4").tolist()
        assert ids == library.encode(w, add_special_tokens=False).ids
        if len(w) < 6000:
            assert m._trees([w.encode()], 1 << (len(w.encode()) - 1).bit_length())[0] == m._tree(w.encode())
    began = time.process_time()
    m.encode_words([words[4].encode()])
    assert time.process_time() - began < 2
