"""Operator 8: token ids in a binary format: canonical length-limited Huffman codes, decoded by table.

Format. A data set is a folder of Parquet files, so that it can be written and read through any store of Spark and a lost
executor leaves no half-written file. Each row is one block, which can be decoded alone:

  part, block   place of the block: parts in order of doc_id, blocks in order within their part
  start         ids of all documents before the block
  doc_ids       of its documents, in order
  counts        ids of each of them
  lengths       code length of each id below len(lengths), 0 if unused: the canonical code follows from these (deflated bytes)
  offsets       checkpoints: the bit at which every CHECKPOINT-th id of a document begins
  bits          the codes, first bit highest; each document begins at a byte

Codes: the ids of all documents are counted, each task handing on one row an id; the counts of at most the vocabulary meet on
the driver, where package-merge gives the best code of at most LIMIT bits. Codes of one length are in order of id.

Documents are coded where they lie, so what is sorted by doc_id are the codes and not the ids. Blocks hold whole documents and end with
the first document at which they have BLOCK ids, so a task holds one block at a time. Encoding puts codes into words of 64 bits without a
loop over ids. Decoding starts at all checkpoints of a block at once: each lane looks up LIMIT bits in a table that gives the id
and its length.

Tokens are those of the tokenizers library with the tokenizer file. They are computed by tiktoken from the vocabulary and ranks in that file,
which is several times faster and gives the same ids (the tests compare them); texts that name a special token go to the library itself.

Defined results: null text is the empty text, whose only id is the end id; special tokens written in a text become their ids, as in the
library; rows without doc_id come last; repeated doc_ids keep rows of their own, in order of their ids; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .bpe import printable_bytes
from .common import keep, table

VOCABULARY = "byte_bpe_50k.json"
END = 0
LIMIT = 16
BLOCK = 1 << 18
CHECKPOINT = 256

#: The pattern of the byte-level pre-tokenizer, in a form that doesn't backtrack, and for texts in which no two white-space characters meet.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
_SINGLE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
_RUNS = re.compile(r"\s\s")
_OTHER = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]


def _meet(text: str) -> bool:
    """Whether two white-space characters may meet; substring tests first, as they are many times faster than the pattern."""
    if any(c in text for c in _OTHER):
        return bool(_RUNS.search(text))
    return "  " in text or "\n\n" in text or " \n" in text or "\n " in text
#: Ids of a part of the files, which one task writes.
PART = 1 << 26
BLOCKS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("lengths", pa.binary()), ("offsets", pa.list_(pa.int64())), ("bits", pa.binary())])


class Ids:
    """Ids of texts as the tokenizers library gives them, as little-endian unsigned 16-bit integers: the vocabulary must have at most 65,536."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        byte = {c: b for b, c in enumerate(printable_bytes())}
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocab = self.library.get_vocab(with_added_tokens=False)
        with open(path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        made = [vocab[a + b] for a, b in (m if isinstance(m, list) else m.split(" ") for m in merges)]
        if any(x >= y for x, y in zip(made, made[1:], strict=False)):
            raise ValueError("ids must rise in the order of the merges")
        if max(self.library.get_vocab(with_added_tokens=True).values()) >= 1 << 16:
            raise ValueError("ids must be below 65,536")
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
        self.any, self.single = (tiktoken.Encoding("ids", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (_PATTERN, _SINGLE))

    def of(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u2")
        return (self.any if _meet(text) else self.single).encode_to_numpy(text).astype("<u2")


_ids: dict[str, Ids] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokens(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids (little-endian unsigned 16-bit integers, the end id last), counts (null).

    The last rows of each task hold its counts of ids instead: ids null, counts pairs of 64-bit integers.
    """
    names = ["doc_id", "ids", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = path or vocabulary_path()
        if where not in _ids:
            _ids[where] = Ids(where)
        total = np.zeros(1 << 16, dtype=np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                found = [np.append(_ids[where].of(x or ""), np.uint16(end)) for x in part.column(1).to_pylist()]
                total += np.bincount(np.concatenate(found), minlength=1 << 16)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in found], type=pa.binary()), pa.nulls(len(found), pa.binary())], names)
        used = np.flatnonzero(total)
        if len(used):
            pairs = np.stack([used, total[used]], axis=1).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([pairs], type=pa.binary())], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary, counts binary")


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Package-merge: lengths of the best prefix code of at most `limit` bits; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    # At each level the list is the leaves merged with pairs of the list below. Going back down, the first n items of a level
    # are taken; the leaves among them get one bit more, and its pairs take twice as many items of the level below.
    level, kinds = weight, []
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weight, pairs])
        at = np.argsort(both, kind="stable")
        kinds.append(at < len(weight))
        level = both[at]
    take, depth = 2 * (len(used) - 1), np.zeros(len(used), dtype=np.int64)
    for leaf in reversed(kinds):
        n = int(leaf[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    depth[:take] += 1
    lengths[order] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: by length, then by id; each the one before plus one, shifted to its length."""
    codes = np.zeros(len(lengths), dtype=np.uint32)
    order = np.flatnonzero(lengths)
    order = order[np.argsort(lengths[order], kind="stable")]
    if len(order):
        top = int(lengths[order[-1]])
        step = np.left_shift(np.uint64(1), (top - lengths[order]).astype(np.uint64))
        begin = np.cumsum(step) - step  # as numbers of `top` bits
        codes[order] = (begin >> (top - lengths[order]).astype(np.uint64)).astype(np.uint32)
    return codes


def pack(ids: np.ndarray, counts: np.ndarray, codes: np.ndarray, lengths: np.ndarray, every: int = CHECKPOINT) -> tuple[bytes, np.ndarray, list[np.ndarray]]:
    """Documents of `counts` ids, one after the other -> their bits, first bit highest; the byte at which each begins, and the end; and of
    each document the bits from its beginning at which every `every`-th id begins."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    last = np.cumsum(counts)
    bits = np.diff(np.append(0, np.append(0, ends)[last]))
    place = np.append(0, np.cumsum(-(-bits // 8)))
    shift = place[:-1] * 8 - (np.cumsum(bits) - bits)  # from a gapless stream to documents at whole bytes
    begin = ends - size + np.repeat(shift, counts)
    words = np.zeros(int(place[-1]) // 8 + 2, dtype=np.uint64)
    word, room = begin >> 6, 64 - (begin & 63) - size  # room < 0: the code goes on in the next word
    code = codes[ids].astype(np.uint64)
    left = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    if len(ids):
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        words[word[first]] = np.bitwise_or.reduceat(left, first)
    over = np.flatnonzero(room < 0)
    words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)  # at most one code enters a word
    checkpoints = [begin[e - n : e : every] - 8 * p for n, e, p in zip(counts.tolist(), last.tolist(), place.tolist(), strict=False)]
    return words.byteswap().tobytes()[: int(place[-1])], place, checkpoints


class Decoder:
    """Table-driven decoder of one canonical code."""

    def __init__(self, lengths: np.ndarray):
        self.top = max(1, int(lengths.max(initial=0)))
        used = np.flatnonzero(lengths)
        used = used[np.argsort(lengths[used], kind="stable")]
        span = np.left_shift(1, self.top - lengths[used].astype(np.int64))
        self.id, self.size = np.zeros(1 << self.top, dtype=np.uint32), np.ones(1 << self.top, dtype=np.int64)
        self.id[: span.sum()], self.size[: span.sum()] = np.repeat(used, span), np.repeat(lengths[used], span)

    def unpack(self, bits: bytes, offsets: np.ndarray, counts: np.ndarray, every: int = CHECKPOINT) -> np.ndarray:
        """The ids of documents of `counts` ids, each checkpoint a lane of its own."""
        raw = np.frombuffer(bits + bytes(8), dtype=np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]  # 32 bits from each byte on
        lanes = -(-counts // every)
        size = np.full(int(lanes.sum()), every, dtype=np.int64)
        some = counts > 0
        size[np.cumsum(lanes)[some] - 1] = (counts - (lanes - 1) * every)[some]
        out = np.zeros((len(size), every), dtype="<u4")
        order = np.argsort(-size, kind="stable")  # lanes that end leave at the end of the list
        at, left = offsets[order].astype(np.int64), np.searchsorted(-size[order], -np.arange(every), side="left")
        for k in range(int(size.max(initial=0))):
            at = at[: left[k]]
            look = (window[at >> 3] >> (32 - self.top - (at & 7)).astype(np.uint32)) & np.uint32((1 << self.top) - 1)
            out[order[: left[k]], k] = self.id[look]
            at = at + self.size[look]
        return out[np.arange(every) < size[:, None]]


def count_ids(staged: DataFrame) -> DataFrame:
    """tokens() -> id, n over all documents; reads the counts of the tasks only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                pairs = np.frombuffer(x.as_buffer(), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["id", "n"])

    return staged.select("counts").where("counts is not null").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def bounds(staged: DataFrame, parts: int) -> np.ndarray:
    """At most parts - 1 doc_ids that cut the documents in ranges of about the same number."""
    shares = [i / parts for i in range(1, parts)]
    if not shares:
        return np.zeros(0, dtype=np.int64)
    found = staged.where("ids is not null").agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0]
    return np.unique(np.array(found or [], dtype=np.int64))


def write(docs: DataFrame, name: str = "blocks", path: str | None = None, end: int = END, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """Encode the documents, write the blocks to the shared folder, and return them as read back."""
    spark = docs.sparkSession
    staged = keep(tokens(docs, path, end), "tokens", compression="zstd")
    found = count_ids(staged).toPandas()  # a row for each id of the vocabulary at most
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, dtype=np.int64)
    counts[found["id"]] = found["n"]
    lengths = code_lengths(counts, limit)
    codes, header = canonical(lengths), zlib.compress(lengths.tobytes(), 9)

    # parts of at most about PART ids, however many there are
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(counts.sum()) // PART))
    cuts = bounds(staged, n)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                some = b.slice(lo, 64)
                raw = [x.as_buffer() for x in some.column(1)]
                count = np.array([x.size // 2 for x in raw])
                ids = np.frombuffer(b"".join(raw), dtype="<u2")
                bits, place, checkpoints = pack(ids, count, codes, lengths)
                part = np.searchsorted(cuts, some.column(0).fill_null(np.iinfo(np.int64).max).to_numpy())
                columns = [pa.array(part.astype(np.int32)), some.column(0), pa.array(count.astype(np.int32)), pa.array([c.astype("<i4").tobytes() for c in checkpoints], type=pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([bits[x:y] for x, y in zip(place.tolist(), place[1:].tolist(), strict=False)], type=pa.binary())], ["part", "doc_id", "n", "offsets", "bits"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = number = 0

        def flush() -> pa.RecordBatch:
            base = np.cumsum([0, *(len(h["bits"]) for h in held)])
            offsets = np.concatenate([np.frombuffer(h["offsets"], dtype="<i4").astype(np.int64) + 8 * at for h, at in zip(held, base, strict=False)])
            row = [held[0]["part"], number, 0, [h["doc_id"] for h in held], [h["n"] for h in held], header, offsets, b"".join(h["bits"] for h in held)]
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, BLOCKS, strict=True)], schema=BLOCKS)

        for b in batches:
            for row in b.to_pylist():
                held.append(row)
                size += row["n"]
                if size >= block:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    coded = staged.where("ids is not null").select("doc_id", "ids").mapInArrow(encode, "part int, doc_id long, n int, offsets binary, bits binary")
    dealt = coded.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", F.col("doc_id").isNull(), "doc_id", "bits")
    blocks = keep(dealt.mapInArrow(gather, from_arrow_schema(BLOCKS)), name)
    # Where each block starts: sums of the parts, then the blocks of a part.
    sizes = blocks.select("part", "block", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("size"))
    parts = sizes.groupBy("part").agg(F.sum("size").alias("size")).select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("base"))
    within = F.sum("size").over(Window.partitionBy("part").orderBy("block")) - F.col("size")
    starts = sizes.select("part", "block", within.alias("within")).join(parts, "part").select("part", "block", (F.col("base") + F.col("within")).alias("at"))
    return blocks.join(starts, ["part", "block"]).withColumn("start", F.col("at")).drop("at")


def read(blocks: DataFrame, ids: bool = False) -> DataFrame:
    """Blocks -> doc_id, start, n_tokens, ids_crc32, and the ids themselves if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, decoder = b"", None
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                start, counts, lengths, offsets, bits = (row.column(k)[0] for k in (1, 2, 3, 4, 5))
                if lengths.as_py() != known or decoder is None:
                    known = lengths.as_py()
                    decoder = Decoder(np.frombuffer(zlib.decompress(known), dtype=np.uint8))
                n = counts.values.to_numpy().astype(np.int64)
                flat = decoder.unpack(bits.as_py(), offsets.values.to_numpy(), n).tobytes()
                ends = np.cumsum(n)
                each = [flat[4 * (e - k) : 4 * e] for k, e in zip(n.tolist(), ends.tolist(), strict=True)]
                out = [row.column(0)[0].values, pa.array(start.as_py() + ends - n), pa.array(n), pa.array([zlib.crc32(x) for x in each], type=pa.int64())]
                yield pa.RecordBatch.from_arrays([*out, *([pa.array(each, type=pa.binary())] if ids else [])], ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids])

    columns = blocks.select("doc_ids", "start", "counts", "lengths", "offsets", "bits")
    return columns.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if ids else ""))


def op8_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents")))
