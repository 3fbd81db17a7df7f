"""Operator 8, language identification with error-correcting output codes.

Each language gets a codeword of +1 and -1. One binary logistic classifier for
each code position predicts that bit from hashed byte n-grams (1 to 3 bytes,
ASCII case folded, ASCII non-letters as spaces; square roots of shares).
Decoding is loss-weighted: a language's loss is the sum over bits of the
logistic loss of its bit, weighted by how well that classifier told that
language's training texts; the nearest codeword wins, ``ambiguous`` says that
the second is nearer than ``MARGIN`` to it. The score is the winner's share of
exp(-loss * ``SHARPNESS``).

The classifiers are fitted here on at most ``SAMPLE`` texts of each language
(smallest hash of id, at most ``SAMPLE_CHARS`` characters); every document is
then predicted whole, in the tasks, without a shuffle.

Edge cases: a null text or one without a letter is ``und`` with score 0; rows of
null language teach nothing; with one language all letters are that language;
with none all is ``und``. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat, parts

SAMPLE, SAMPLE_CHARS = 300, 100_000
BITS = 13  # of the n-gram hash
MARGIN, SHARPNESS = 0.1, 8.0

_FOLD = np.full(256, 32, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: all two-part splits of up to 7 languages, else random rows far apart."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        splits = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(splits, np.int8).T
    bits, best, far = 10 * int(np.ceil(np.log2(n))), None, -1
    for seed in range(50):
        code = np.random.default_rng(seed).choice(np.array([1, -1], np.int8), (n, bits))
        apart = (bits - code.astype(int) @ code.T.astype(int)) // 2 + bits * np.eye(n, dtype=int)
        useful = (np.abs(code.sum(axis=0)) < n).all()
        if useful and apart.min() > far:
            best, far = code, apart.min()
    return best


def features(column: pa.Array) -> np.ndarray:
    """Square roots of n-gram shares, one row a text."""
    buf, offs = flat(column)
    n, size = len(offs) - 1, 1 << BITS
    b = _FOLD[buf].astype(np.uint32)
    doc = np.repeat(np.arange(n, dtype=np.int64) << BITS, np.diff(offs))
    out = np.zeros(n << BITS, np.float32)
    code = np.zeros(len(b), np.uint32)
    for k in (1, 2, 3):
        if len(b) < k:
            break
        code = b if k == 1 else (code[: len(b) - k + 1] << np.uint32(8)) | b[k - 1 :]
        cell = ((code + np.uint32(k << 24)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        own = doc[: len(cell)] == doc[k - 1 :]
        out += np.bincount(doc[: len(cell)][own] + cell[own], minlength=n << BITS)
    out = np.sqrt(out.reshape(n, size))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # (features + 1) x bits
    trust: np.ndarray  # languages x bits, rows sum to 1

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each text."""
        letters = np.array([t is not None and any(map(str.isalpha, t)) for t in column.to_pylist()], bool)
        if not self.langs:
            return ["und"] * len(column), np.zeros(len(column)), np.zeros(len(column), bool)
        margin = features(column) @ self.weights[:-1] + self.weights[-1]
        loss = np.einsum("lb,nlb->nl", self.trust, np.logaddexp(0, -margin[:, None, :] * self.code[None]))
        best = loss.argmin(axis=1)
        share = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * SHARPNESS)
        score = np.where(letters, share.max(axis=1) / share.sum(axis=1), 0.0)
        ranked = np.sort(loss, axis=1)
        close = (ranked[:, 1] - ranked[:, 0] < MARGIN) if loss.shape[1] > 1 else np.zeros(len(loss), bool)
        names = [self.langs[i] if ok else "und" for i, ok in zip(best.tolist(), letters.tolist(), strict=True)]
        return names, score, close & letters


def fit(texts: list[str], langs: list[str], steps: int = 150, rate: float = 0.05, l2: float = 1e-4) -> Model:
    names = sorted(set(langs))
    code = codewords(len(names))
    if len(names) < 2:
        weights = np.zeros(((1 << BITS) + 1, code.shape[1]), np.float32)
        weights[-1] = 4.0
        return Model(names, code, weights, np.ones_like(code, float))
    x = np.concatenate([features(pa.array(texts[i : i + 64], pa.string())) for i in range(0, len(texts), 64)])
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    label = np.searchsorted(names, langs)
    y = code[label].astype(np.float32)
    each = 1.0 / np.bincount(label)[label][:, None].astype(np.float32) / len(names)  # languages weigh alike
    w, m, v = (np.zeros((x.shape[1], code.shape[1]), np.float32) for _ in range(3))
    for step in range(1, steps + 1):
        grad = x.T @ (each * -y / (1 + np.exp(np.clip(y * (x @ w), -30, 30)))) + l2 * w
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        w -= rate * 4 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    right = (y * (x @ w) > 0).astype(float)
    trust = np.stack([right[label == i].mean(axis=0) for i in range(len(names))]) + 1e-3
    return Model(names, code, w, trust / trust.sum(axis=1, keepdims=True))


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """Fit on at most ``sample`` texts of each language; the driver holds about twice as many."""
    rows = docs.filter(F.col(lang).isNotNull() & (F.length(text) > 0) & (F.length(text) <= chars)).select(F.xxhash64(F.coalesce(F.col(id).cast("string"), F.lit("")), F.lit("op8")).alias("h"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return fit([], [])
    # of n rows, the share with a small hash gives about 2 * sample rows
    unit = 1 << 20
    cut = F.when(F.lit(False), F.lit(0))
    for r in counts:
        cut = cut.when(F.col("lang") == r["lang"], F.lit(min(unit, -(-2 * sample * unit // r["count"]))))
    some = rows.filter(F.pmod(F.col("h"), F.lit(unit)) < cut).collect()
    some = sorted(some, key=lambda r: (r["lang"], r["h"] % unit, r["h"], r["text"]))
    picked = [r for _, own in itertools.groupby(some, key=lambda r: r["lang"]) for r in itertools.islice(own, sample)]
    return fit([r["text"] for r in picked], [r["lang"] for r in picked])


def predictions(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, lang_pred, score, ambiguous of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^13 rows x bits: its size does not grow with the documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, text, 1 << 19):
            for at in range(0, batch.num_rows, 128):
                rows = batch.slice(at, 128)
                names, score, close = shared.value.predict(rows.column(text))
                yield pa.RecordBatch.from_arrays([rows.column(id), pa.array(names, pa.string()), pa.array(score), pa.array(close)], names=[id, "lang_pred", "score", "ambiguous"])

    fields = [docs.schema[id], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    return docs.select(id, text).mapInArrow(run, T.StructType(fields))
