"""Operator 7: BPE encoding and decoding, merges found by a segment tree over the ranks of adjacent pairs.

The tokenizer file gives the vocabulary, merges and white-space rules of a word-end BPE: NFC, white space to one space, lower case,
split into words, bytes as printable characters, the last one marked as the end of a word.

Encoding a word: the leaves of a segment tree hold, for each symbol, the rank of the pair that it forms with its right
neighbour, and the position. A node holds the smaller of its children, so the root is the leftmost pair of lowest rank. A merge joins
the pair, unlinks the right symbol, and updates three leaves and their paths: O(log n) a merge, until the root holds no
pair. Words are encoded many at once, a tree in each row of an array; long words, which are rare, one by one in plain lists. A word of any
length is encoded whole.

A text is a sequence of words between white space, so encoded pieces are kept in a bounded cache for each Python worker,
which saves repeated work and changes no result.

Decoding looks up the strings of the ids and joins them with a space, as a tokenizer without a decoder does.

Defined results: null text is the empty text, with no ids; special tokens written in the text become their ids, as in the library;
repeated rows give repeated rows; a null doc_id stays null; ties between pairs of one rank go to the left one; an empty table gives an empty table. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOCABULARY = "word_bpe_49k.json"
#: Pieces and words kept by each Python worker; beyond it the cache starts anew.
CACHE = 300_000
#: Leaves of a tree from which on a word is encoded alone.
LONG = 1 << 9
#: Symbols in the trees encoded at once.
SYMBOLS = 1 << 20

_NONE = np.int64(1) << 62
#: White space of the tokenizer's patterns; str.split() takes these and the four below.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")

_MARKS = re.compile(r"(?:[\W_]|^)[,.][ \n]")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def printable_bytes() -> list[str]:
    """The character that stands for each byte: itself if it is printable in Latin-1, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        chars = printable_bytes()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.last = np.array([vocab[c + self.end] for c in chars], dtype=np.int64)
        self.width = max(vocab.values()) + 1
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        key = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.pair_key, self.pair_rank = key[order], order.astype(np.int64)
        self.pair_id = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)  # by rank
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.ranks: dict[int, int] | None = None  # of pairs, for long words
        self.text = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.bytes_of = {i: t.encode() for i, t in self.text.items()}
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._clear()

    def _clear(self) -> None:
        """Special tokens stand in the cache under a name with a space, which no piece has."""
        self.ids = {f" {t}": i.to_bytes(4, "little") for t, i in self.special.items()}
        self.strings = {f" {t}": t.encode() for t in self.special}
        self.blank: set[str] = set()

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, _NONE where they don't merge."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where((self.pair_key[at] == key) & (a >= 0) & (b >= 0), self.pair_rank[at], _NONE)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, given as its bytes (at least one), as little-endian unsigned 32-bit integers."""
        out = [b""] * len(words)
        sizes = np.array([len(w) for w in words])
        leaves = 1 << np.maximum(1, np.ceil(np.log2(np.maximum(sizes, 1))).astype(int))
        for i in np.flatnonzero(leaves >= LONG).tolist():
            out[i] = self._tree(words[i])
        for n in np.unique(leaves[leaves < LONG]):
            which = np.flatnonzero(leaves == n)
            step = max(1, SYMBOLS // int(n))
            for lo in range(0, len(which), step):
                some = which[lo : lo + step].tolist()
                for k, ids in zip(some, self._trees([words[i] for i in some], int(n)), strict=True):
                    out[k] = ids
        return out

    def _tree(self, word: bytes) -> bytes:
        """One long word: the same tree in plain lists; a path is updated only as far as its smallest pair changes."""
        n, none = len(word), 1 << 62
        size = 1 << (n - 1).bit_length()
        if self.ranks is None:
            self.ranks = dict(zip(self.pair_key.tolist(), self.pair_rank.tolist(), strict=True))
        ranks, width, ids = self.ranks, self.width, self.pair_id.tolist()
        sym = self.inner[np.frombuffer(word, dtype=np.uint8)].tolist()
        sym[-1] = int(self.last[word[-1]])
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]  # n: no right neighbour, -1: no left one
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = ranks.get(sym[i] * width + sym[i + 1])
            if r is not None:
                tree[size + i] = r * size + i
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int) -> None:
            """The leaf of symbol i, and its path."""
            j = after[i]
            r = ranks.get(sym[i] * width + sym[j]) if j < n and sym[i] >= 0 else None
            node = size + i
            tree[node] = none if r is None else r * size + i
            node >>= 1
            while node:
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    return
                tree[node] = least
                node >>= 1

        while tree[1] < none:
            rank, at = divmod(tree[1], size)
            right = after[at]
            sym[at], sym[right], after[at] = ids[rank], -1, after[right]
            if after[at] < n:
                before[after[at]] = at
            put(right)
            put(at)
            if before[at] >= 0:
                put(before[at])
        return np.array([s for s in sym if s >= 0], dtype="<u4").tobytes()

    def _trees(self, words: list[bytes], n: int) -> list[bytes]:
        rows, size = len(words), np.array([len(w) for w in words])
        codes = np.zeros((rows, n), dtype=np.int64)
        inside = np.arange(n) < size[:, None]
        codes[inside] = np.frombuffer(b"".join(words), dtype=np.uint8)
        sym = np.where(inside, self.inner[codes], -1)
        sym[np.arange(rows), size - 1] = self.last[codes[np.arange(rows), size - 1]]
        after = np.where(np.arange(1, n + 1) < size[:, None], np.arange(1, n + 1), n)  # n: no right neighbour
        before = np.broadcast_to(np.arange(-1, n - 1), (rows, n)).copy()  # -1: no left neighbour
        tree = np.full((rows, 2 * n), _NONE, dtype=np.int64)
        ranks = self.rank(sym, np.concatenate([sym[:, 1:], np.full((rows, 1), -1)], axis=1))
        tree[:, n:] = np.where(ranks < _NONE, ranks * n + np.arange(n), _NONE)
        level = n
        while level > 1:  # parents from children
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        row = np.flatnonzero(tree[:, 1] < _NONE)
        while len(row):
            rank, at = np.divmod(tree[row, 1], n)
            right = after[row, at]
            beyond = after[row, right]
            sym[row, at] = self.pair_id[rank]
            sym[row, right] = -1
            after[row, at] = beyond
            has = beyond < n
            before[row[has], beyond[has]] = at[has]
            left = before[row, at]
            # the leaves of the merged symbol, of its left neighbour, and of the symbol that is gone
            leaf = np.full(len(row), _NONE)
            r = self.rank(sym[row, at], np.where(has, sym[row, np.minimum(beyond, n - 1)], -1))
            tree[row, n + at] = np.where(r < _NONE, r * n + at, leaf)
            tree[row, n + right] = _NONE
            some = left >= 0
            r = self.rank(sym[row[some], left[some]], sym[row[some], at[some]])
            tree[row[some], n + left[some]] = np.where(r < _NONE, r * n + left[some], _NONE)
            for where, x in ((row, at), (row, right), (row[some], left[some])):
                node = (n + x) >> 1
                while len(node) and node[0] >= 1:
                    tree[where, node] = np.minimum(tree[where, 2 * node], tree[where, 2 * node + 1])
                    node = node >> 1
            row = row[tree[row, 1] < _NONE]
        here = sym >= 0
        flat = sym[here].astype("<u4").tobytes()
        ends = [0, *(4 * np.cumsum(here.sum(axis=1))).tolist()]
        return [flat[lo:hi] for lo, hi in zip(ends, ends[1:], strict=False)]

    def split(self, piece: str) -> list[str]:
        """Words of a run without white space; the first two cases are short cuts of the pattern."""
        if piece.isalpha():
            return [piece]
        if piece[-1] in ".,;:!?" and piece[:-1].isalpha():
            return [piece[:-1], piece[-1]]
        return self.word.findall(piece)

    def learn(self, new: set[str]) -> None:
        """Encode pieces (runs without white space) that the cache lacks."""
        split = [(p, self.split(p)) for p in new]
        # a word of a piece is a piece of its own with the same ids, so words are kept in the same place
        lacking = list({w for _, ws in split for w in ws if w not in self.ids})
        for w, ids in zip(lacking, self.encode_words([w.encode("utf-8", "surrogatepass") for w in lacking]), strict=True):
            self.ids[w], self.strings[w] = ids, self.decode(np.frombuffer(ids, dtype="<u4"))
        for p, ws in split:
            if ws != [p]:
                self.ids[p], self.strings[p] = b"".join([self.ids[w] for w in ws]), b" ".join([self.strings[w] for w in ws])
                if not ws:
                    self.blank.add(p)

    def runs(self, text: str) -> list[str]:
        """The text as normalised pieces, and special tokens as they stand in the cache."""
        parts = self.split_special.split(text) if self.split_special and any(s in text for s in self.special) else [text]
        out: list[str] = []
        for part in parts:
            if part in self.special:
                out.append(f" {part}")
                continue
            t = unicodedata.normalize("NFC", part)
            t = t.replace("Σ", "σ").lower()  # a sigma at a word's end isn't special in the library
            if any(o in t for o in _ODD):
                out += [p for p in _SPACE.split(t) if p]
            elif _MARKS.search(t):
                out += t.split()
            else:  # a mark after a letter and before white space is a word of its own: pieces without it repeat more often
                out += t.replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ").split()
        return out

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Of each text: ids as little-endian unsigned 32-bit integers, and what they decode to in UTF-8."""
        if len(self.ids) > CACHE:
            self._clear()
        runs = [self.runs(t) for t in texts]
        self.learn(set().union(*runs).difference(self.ids))
        for r in runs:
            if self.blank:
                r = [p for p in r if p not in self.blank]
            yield b"".join(map(self.ids.__getitem__, r)), b" ".join(map(self.strings.__getitem__, r))

    def decode(self, ids: np.ndarray) -> bytes:
        return b" ".join(map(self.bytes_of.__getitem__, ids.tolist()))


_models: dict[str, WordBpe] = {}


def model(path: str) -> WordBpe:
    if path not in _models:
        _models[path] = WordBpe(path)
    return _models[path]


def encode(docs: DataFrame, path: str | None = None, texts: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256; with `texts` also ids (binary) and decoded.

    path: the tokenizer file, found on every executor; the installed one if none is given.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    if texts:
        fields += [("ids", pa.binary()), ("decoded", pa.string())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path or vocabulary_path())
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rows = list(m.encode_batch([x or "" for x in part.column(1).to_pylist()]))
                columns = [part.column(0), [len(i) // 4 for i, _ in rows], [hashlib.sha256(i).hexdigest() for i, _ in rows], [hashlib.sha256(t).hexdigest() for _, t in rows]]
                if texts:
                    columns += [[i for i, _ in rows], [t.decode() for _, t in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if isinstance(c, list) else c for c, f in zip(columns, schema, strict=True)], schema=schema)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if texts else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ddl)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
