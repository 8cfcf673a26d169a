"""Operator 2: language identification by a byte convolutional network trained in numpy.

Network: bytes of the lower-cased text in windows of `WINDOW`; filters of several widths over one-hot bytes, so a filter is a
table of one weight for each offset and byte; rectified maximum over the window; a softmax over the languages seen in training.
The maximum makes the gradient reach one position for each filter, so training takes seconds on the driver.

Training: texts and labels of a bounded sample, at most about PER_LANG documents a language (a documented parameter), chosen
by a hash of doc_id among documents that have a language and are not held out (crc32 of doc_id as text, mod 4, is not 2).
Each gives SAMPLES windows from anywhere in its text. lang, source and doc_id are never inputs of a prediction.

Prediction: every window of the whole text is classified; probabilities are averaged by the bytes that the windows hold, so
the language of most of a mixed text wins.

Defined results: `und` with score 0 if the text is null or has no letter, or if there was nothing to learn from; a null
doc_id is not held out and not learned from; repeated rows give repeated rows; an empty table gives an empty table; texts of any length are
read whole; other columns are not read. Ties go to the first language by name. A language none of whose documents is in the sample is not
learned; each label counts its documents, so rare ones are sampled whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WINDOW = 128
WIDTHS = (2, 3, 4, 5)
FILTERS = 8
PER_LANG = 800
SAMPLES = 4
EPOCHS = 12
UNKNOWN = "und"
#: Share of the softmax below which assign() rejects a document: of several languages none then stands out.
MIN_SCORE = 0.3


@dataclass
class ByteCnn:
    """conv[k]: weights at offset k of the filters wider than k, the widest filters first; (256, filters)."""

    langs: list[str]
    conv: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    @classmethod
    def fresh(cls, langs: list[str], seed: int = 7) -> ByteCnn:
        rng = np.random.default_rng(seed)
        wider = [sum(FILTERS for w in WIDTHS if w > k) for k in range(max(WIDTHS))]
        return cls(langs, [rng.normal(0, 0.1, (256, n)).astype(np.float32) for n in wider], np.zeros(wider[0], np.float32), rng.normal(0, 0.2, (wider[0], len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))

    def responses(self, x: np.ndarray) -> np.ndarray:
        """Windows of bytes (n, WINDOW) -> (n, positions, filters); a filter may reach into the padding of zero bytes."""
        n, length = x.shape
        pad = np.zeros((n, length + len(self.conv) - 1), dtype=np.uint8)
        pad[:, :length] = x
        out = self.conv[0][pad[:, :length]]
        for k in range(1, len(self.conv)):
            out[..., : self.conv[k].shape[1]] += self.conv[k][pad[:, k : k + length]]
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        pooled = self.responses(x).max(axis=1) + self.bias
        return np.maximum(pooled, 0) @ self.dense + self.dense_bias

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy, in the order conv, bias, dense, dense_bias; a maximum passes its gradient to one position."""
        rows, filters = np.arange(len(x)), np.arange(len(self.bias))
        resp = self.responses(x)
        at = resp.argmax(axis=1)  # (n, filters)
        pooled = np.take_along_axis(resp, at[:, None, :], axis=1)[:, 0] + self.bias
        hidden = np.maximum(pooled, 0)
        z = hidden @ self.dense + self.dense_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[rows, y] -= 1
        p /= len(x)
        back = (p @ self.dense.T) * (pooled > 0)
        pad = np.zeros((len(x), x.shape[1] + len(self.conv)), dtype=np.uint8)
        pad[:, : x.shape[1]] = x
        grads = []
        for k, w in enumerate(self.conv):
            f = w.shape[1]
            cell = pad[rows[:, None], at[:, :f] + k].astype(np.int64) * f + filters[:f]
            grads.append(np.bincount(cell.ravel(), back[:, :f].ravel(), minlength=256 * f).reshape(256, f))
        return [*grads, back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 128, seed: int = 11) -> None:
        rng, params = np.random.default_rng(seed), [*self.conv, self.bias, self.dense, self.dense_bias]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                some = order[lo : lo + batch]
                step += 1
                for i, g in enumerate(self.gradients(x[some], y[some])):
                    m[i] += 0.1 * (g - m[i])
                    v[i] += 0.001 * (g * g - v[i])
                    rate = 0.01 / (1 - 0.9**step)
                    params[i] -= (rate * m[i] / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8) + 1e-5 * params[i]).astype(np.float32)

    def predict(self, texts: list[str | None], chunk: int = 128) -> tuple[list[str], list[float]]:
        raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
        count = np.array([-(-len(r) // WINDOW) for r in raw])
        sums = np.zeros((len(texts), len(self.langs)))
        if count.sum():
            joined = b"".join(r.ljust(int(n) * WINDOW, b"\0") for r, n in zip(raw, count, strict=True))
            x = np.frombuffer(joined, dtype=np.uint8).reshape(-1, WINDOW)
            z = np.concatenate([self.logits(x[i : i + chunk]) for i in range(0, len(x), chunk)])
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            owner = np.repeat(np.arange(len(texts)), count)
            filled = np.full(len(x), WINDOW, dtype=np.float64)
            ends = np.cumsum(count)[count > 0] - 1
            sizes = np.array([len(r) for r in raw])[count > 0]
            filled[ends] = sizes - (count[count > 0] - 1) * WINDOW
            np.add.at(sums, owner, p * filled[:, None])
            sums[count > 0] /= sizes[:, None]
        best = sums.argmax(axis=1)
        known = [t is not None and any(map(str.isalpha, t)) for t in texts]
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], [float(min(1.0, sums[i, b])) if k else 0.0 for i, (b, k) in enumerate(zip(best, known, strict=True))]


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_lang: int = PER_LANG) -> ByteCnn | None:
    """docs(doc_id, text, lang) -> a network, or None if no row can be learned from."""
    rows = docs.select("doc_id", "lang", "text").where("lang is not null and text is not null and doc_id is not null").where(~held_out())
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))  # a row a language, as the network has a class a language
    drawn = rows.join(F.broadcast(counts), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1_000_000)) < F.least(F.lit(1.0), per_lang / F.col("n")) * 1_000_000)
    room = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    cuts = F.array(*[F.substring("text", F.pmod(F.xxhash64("doc_id", F.lit(i)), room).cast("int") + 1, F.lit(WINDOW)) for i in range(SAMPLES)])
    found = drawn.select("doc_id", "lang", F.explode(F.array_distinct(cuts)).alias("cut")).toPandas().sort_values(["doc_id", "lang", "cut"])
    langs = sorted(found["lang"].unique())
    if not langs:
        return None
    x = np.zeros((len(found), WINDOW), dtype=np.uint8)
    for i, t in enumerate(found["cut"]):
        b = t.lower().encode("utf-8", "replace")[:WINDOW]
        x[i, : len(b)] = np.frombuffer(b, dtype=np.uint8)
    net = ByteCnn.fresh(langs)
    net.fit(x, found["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy())
    return net


def identify(docs: DataFrame, net: ByteCnn | None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, lang_pred, score."""
    if net is None:
        return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                lang, score = net.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def assign(docs: DataFrame, net: ByteCnn | None) -> DataFrame:
    """docs with lang as the network predicts it, without the rows that it rejects: those that are `und`, and those whose score is below MIN_SCORE.

    All other columns stay as they came. Without a network (nothing to learn from) lang stays too, and only rows without a letter go.
    """
    columns = docs.schema
    place = {c: i for i, c in enumerate(docs.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = part.column(place["text"]).to_pylist()
                if net is None:
                    yield part.filter(pa.array([t is not None and any(map(str.isalpha, t)) for t in texts], type=pa.bool_()))
                    continue
                lang, score = net.predict(texts)
                part = part.set_column(place["lang"], b.schema.field(place["lang"]), pa.array(lang, type=b.schema.field(place["lang"]).type))
                yield part.filter(pa.array([k != UNKNOWN and s >= MIN_SCORE for k, s in zip(lang, score, strict=True)], type=pa.bool_()))

    return docs.mapInArrow(run, columns)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
