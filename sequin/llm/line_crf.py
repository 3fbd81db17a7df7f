"""Operator 4, quality rules by line labelling.

A linear-chain conditional random field labels every line that has a word as
content or boilerplate; the share of words in content lines decides retention,
beside two counting rules. The field is fitted here: emission weights over the
line features below, start and transition weights, by gradient ascent on the
exact conditional likelihood (forward and backward recursions over the whole
sample at once). Its labels come from ``labels``: all lines of a document of
quality 1 are content, of quality 0 boilerplate. The sample holds at most
``SAMPLE`` documents of each quality, those with the smallest hash of the id
among texts of at most ``SAMPLE_CHARS`` characters; it is all the driver sees.
Every document is then labelled whole, by Viterbi decoding in the tasks; rows
never shuffle.

Edge cases: a null text has no word and fails the base rule; without labels of
both kinds all lines count as content; a document that ``labels`` gives twice
takes the lower quality; extra columns are ignored or, by ``keep``, kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import give_back, flat, parts

SAMPLE, SAMPLE_CHARS = 1000, 100_000
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_CONTENT = 50, 50, 0.5
SYMBOLS = b"#*$%&|<>"

_EDGES = np.array([0.0, 0.02, 0.08, 0.2, 0.5])  # of shares: 0, up to 0.02, ...
_RATIOS = ("upper", "symbol", "bar", "digit", "bang", "repeat", "punct")
_LENGTHS = 8
_FLAGS = ("stop", "capital", "long")
N_FEATURES = 1 + len(_RATIOS) * (len(_EDGES) + 1) + _LENGTHS + len(_FLAGS)


def _is(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _LETTER = _is(bytes(range(65, 91))), _is(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC3, 0xF5)))
_TABLES = {"upper": _UPPER, "symbol": _is(SYMBOLS), "bar": _is(b"|"), "digit": _is(b"0123456789"), "bang": _is(b"!"), "punct": _is(b".,;:?'\"()-")}
_HEAD = ~_is(bytes(range(0x80, 0xC0)))  # first bytes of code points


@dataclass
class Lines:
    """Lines with a word of many texts, in order, and the counts of the texts."""

    doc: np.ndarray
    n_words: np.ndarray
    features: np.ndarray  # active features of each line, one column a group
    counts: dict[str, np.ndarray]


def _sums(flag: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    run = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=run[1:])
    return run[hi] - run[lo]


def _distinct(key: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    _, at = np.unique(W.mix(key ^ W.mix(doc.astype(np.uint64) + np.uint64(1))), return_index=True)
    return np.bincount(doc[at], minlength=n)


def read_lines(column: pa.Array) -> Lines:
    """Lines, features and base counts of a column of texts."""
    buf, offs = flat(column)
    n = len(offs) - 1
    start, end, doc = W.spans(buf, offs)
    n_words = np.bincount(doc, minlength=n)
    counts = {"n_words": n_words}
    space = W.IS_SPACE[buf]
    counts["word_chars"] = _sums(_HEAD[buf] & ~space, offs[:-1], offs[1:])
    counts["n_symbols"] = _sums(_TABLES["symbol"][buf], offs[:-1], offs[1:])
    # words in windows of three that the text has twice
    h = W.hashes(buf, start, end)
    repeated = np.zeros(len(h), bool)
    if len(h) > 2:
        same = doc[:-2] == doc[2:]
        at = np.flatnonzero(same)
        key = W.mix(W.mix(W.mix(h[at]) + h[at + 1]) + h[at + 2]) ^ W.mix(doc[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key)
        ranked = key[order]
        equal = np.zeros(len(at) + 1, bool)
        equal[1:-1] = ranked[1:] == ranked[:-1]
        twice = at[order[equal[1:] | equal[:-1]]]
        for i in range(3):
            repeated[twice + i] = True
    counts["n_repeat_words"] = np.bincount(doc[repeated], minlength=n)
    # lines
    breaks = np.flatnonzero(buf == 10)
    lo = np.unique(np.concatenate([offs[:-1], breaks + 1]))
    lo = lo[lo < len(buf)]
    marks = np.unique(np.concatenate([offs, breaks]))
    hi = np.where(buf[lo] == 10, lo, marks[np.searchsorted(marks, lo, "right")]) if len(lo) else lo
    inner = np.searchsorted(offs, lo, "right") - 1  # document of the line
    of_word = np.searchsorted(lo, start, "right") - 1
    words_of = np.bincount(of_word, minlength=len(lo))
    some = np.flatnonzero(words_of)
    lo, hi, inner, words_of = lo[some], hi[some], inner[some], words_of[some]
    number = np.zeros(int(some[-1]) + 1 if len(some) else 0, np.int64)
    number[some] = np.arange(len(some))
    of_word = number[of_word] if len(of_word) else of_word
    counts["n_dup_lines"] = np.bincount(inner, minlength=n) - _distinct(W.hashes(buf, lo, hi), inner, n)
    # features
    chars = np.maximum(_sums(~space, lo, hi), 1)
    share = {k: _sums(t[buf], lo, hi) / chars for k, t in _TABLES.items()}
    share["upper"] = _sums(_UPPER[buf], lo, hi) / np.maximum(_sums(_LETTER[buf], lo, hi), 1)
    again = np.zeros(len(h), bool)
    if len(h) > 1:
        again[1:] = (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])
    share["repeat"] = np.bincount(of_word[again], minlength=len(lo)) / words_of
    groups, at = [np.zeros(len(lo), np.int64)], 1
    for k in _RATIOS:
        groups.append(at + np.searchsorted(_EDGES, share[k], "left"))
        at += len(_EDGES) + 1
    groups.append(at + np.minimum(np.log2(words_of + 1).astype(np.int64), _LENGTHS - 1))
    at += _LENGTHS
    off = -1  # no such feature: the weight row behind the last is 0
    tail = buf[np.maximum(hi - 1, 0)] if len(lo) else buf[:0]
    head = buf[lo] if len(lo) else buf[:0]
    for flag in (tail == ord("."), _UPPER[head], chars > 12 * words_of):
        groups.append(np.where(flag, at, off))
        at += 1
    return Lines(inner, words_of, np.stack(groups, axis=1), counts)


@dataclass
class Field:
    emit: np.ndarray  # (N_FEATURES + 1, 2), the last row 0
    start: np.ndarray  # (2,)
    move: np.ndarray  # (2, 2)

    def scores(self, lines: Lines) -> np.ndarray:
        return self.emit[lines.features].sum(axis=1)


def _layout(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the documents' runs, longest first, and the order of documents."""
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    length = np.diff(np.r_[first, len(doc)])
    order = np.argsort(-length, kind="stable")
    return first[order], length[order], order


def viterbi(field: Field, lines: Lines) -> np.ndarray:
    """The best label (1: content) of every line, all documents step by step together."""
    emit = field.scores(lines)
    first, length, _ = _layout(lines.doc)
    best = np.zeros((len(emit), 2))
    back = np.zeros((len(emit), 2), np.int8)
    labels = np.zeros(len(emit), np.int8)
    if not len(emit):
        return labels
    best[first] = emit[first] + field.start
    alive = [int(np.searchsorted(-length, -t, "left")) for t in range(int(length[0]) + 1)]  # longer than t
    for t in range(1, int(length[0])):
        at = first[: alive[t]] + t
        options = best[at - 1][:, :, None] + field.move
        back[at] = options.argmax(axis=1)
        best[at] = options.max(axis=1) + emit[at]
    last = first + length - 1
    labels[last] = best[last].argmax(axis=1)
    for t in range(int(length[0]) - 1, 0, -1):
        at = first[: alive[t]] + t
        labels[at - 1] = back[at, labels[at]]
    return labels


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def fit(lines: Lines, labels: np.ndarray, steps: int = 120, rate: float = 0.15, l2: float = 1e-4) -> Field:
    """Gradient ascent (Adam) on the mean conditional log-likelihood of the lines' labels."""
    field = Field(np.zeros((N_FEATURES + 1, 2)), np.zeros(2), np.zeros((2, 2)))
    if len(np.unique(labels)) < 2:
        field.emit[0, 1] = 1.0
        return field
    first, length, _ = _layout(lines.doc)
    alive = [int(np.searchsorted(-length, -t, "left")) for t in range(int(length[0]) + 1)]
    gold_emit = np.zeros((N_FEATURES + 1, 2))
    for g in range(lines.features.shape[1]):
        np.add.at(gold_emit, (lines.features[:, g], labels), 1)
    gold_start = np.bincount(labels[first], minlength=2).astype(float)
    inside = lines.doc[1:] == lines.doc[:-1]
    gold_move = np.zeros((2, 2))
    np.add.at(gold_move, (labels[:-1][inside], labels[1:][inside]), 1)
    size, state = len(first), None
    for step in range(1, steps + 1):
        emit = field.scores(lines)
        fwd, bwd = np.zeros_like(emit), np.zeros_like(emit)
        fwd[first] = emit[first] + field.start
        for t in range(1, int(length[0])):
            at = first[: alive[t]] + t
            fwd[at] = _lse(fwd[at - 1][:, :, None] + field.move, 1) + emit[at]
        for t in range(int(length[0]) - 1, 0, -1):
            at = first[: alive[t]] + t
            bwd[at - 1] = _lse(field.move[None] + (emit[at] + bwd[at])[:, None, :], 2)
        z = np.repeat(_lse(fwd[first + length - 1], 1)[np.argsort(first)], length[np.argsort(first)])
        p = np.exp(fwd + bwd - z[:, None])
        pair = np.exp(fwd[:-1][inside][:, :, None] + field.move + (emit + bwd)[1:][inside][:, None, :] - z[1:][inside][:, None, None])
        g_emit = gold_emit.copy()
        for g in range(lines.features.shape[1]):
            for y in (0, 1):
                g_emit[:, y] -= np.bincount(lines.features[:, g] % (N_FEATURES + 1), p[:, y], N_FEATURES + 1)
        g_emit[-1] = 0
        grads = [g_emit / size, (gold_start - p[first].sum(axis=0)) / size, (gold_move - pair.sum(axis=0)) / size]
        params = [field.emit, field.start, field.move]
        state = state or [(np.zeros_like(x), np.zeros_like(x)) for x in params]
        for x, g, (m, v) in zip(params, grads, state, strict=True):
            g = g - l2 * x
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        field.emit[-1] = 0
    return field


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Field:
    """Fit the field on at most ``sample`` documents of each quality."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_quality"))
    order = [F.xxhash64("_id"), F.col("_id")]
    chosen = known.filter("_quality = 0").orderBy(*order).limit(sample).unionByName(known.filter("_quality = 1").orderBy(*order).limit(sample))
    # the chosen ids are at most 2 * sample rows, whatever the tables' sizes
    rows = docs.join(F.broadcast(chosen), F.col(id) == F.col("_id")).filter(F.length(text) <= chars).select(F.col("_id"), F.col("_quality"), F.col(text).alias("_text")).collect()
    first: dict = {}
    for r in sorted(rows, key=lambda r: (r["_id"], r["_text"])):
        first.setdefault(r["_id"], r)  # a repeated id counts once
    lines = read_lines(pa.array([r["_text"] for r in first.values()], pa.string()))
    quality = np.array([r["_quality"] for r in first.values()], np.int64)
    field = fit(lines, quality[lines.doc] if len(first) else np.zeros(0, np.int64))
    del rows, first, lines
    give_back()
    return field


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(field: Field, column: pa.Array) -> dict[str, np.ndarray]:
    """Counts, content_share, base_failed and kept of each text."""
    lines = read_lines(column)
    n = len(column)
    out = {k: lines.counts[k] for k in _COUNTS}
    content = np.bincount(lines.doc, lines.n_words * viterbi(field, lines), n)
    out["content_share"] = content / np.maximum(out["n_words"], 1)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    out["kept"] = ~out["base_failed"] & (out["content_share"] >= MIN_CONTENT)
    return out


def decisions(docs: DataFrame, field: Field, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, the counts, content_share, base_failed, kept of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, text):
            got = judge(field, batch.column(text))
            yield pa.RecordBatch.from_arrays([batch.column(id), *map(pa.array, got.values())], names=[id, *got])

    numbers = [T.StructField(k, T.LongType()) for k in _COUNTS]
    rest = [T.StructField("content_share", T.DoubleType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    return docs.select(id, text).mapInArrow(run, T.StructType([docs.schema[id], *numbers, *rest]))


def keep(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, text):
            yield batch.filter(pa.array(judge(field, batch.column(text))["kept"]))

    return docs.mapInArrow(run, docs.schema)
