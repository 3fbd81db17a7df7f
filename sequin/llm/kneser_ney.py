"""Operator 3, scoring by an interpolated modified Kneser-Ney bigram model.

Counting is a Spark job in two shuffles of packed arrays. Tasks count the
distinct (left, right) word pairs of their texts and deal them to a grid of
shards, by left word along one side and right word along the other, so that a
word that makes up a third of the corpus is still spread over a whole side.
A shard merges the counts of its pairs (the shuffle carries each pair at most
once a task buffer) and emits, per left word, total and numbers of right words
seen once, twice and more often, and per right word the number of different
left words and the total; those meet once more by word.

The model is sorted arrays of 64-bit hashes with their values, one .npy file a
shard in the shared folder. Scoring workers map the files into memory and look
up all words of a batch by binary search; only touched pages are resident.

Model: with D1, D2, D3+ from the counts of counts n1..n4,
p(w|v) = (c(vw) - D)/c(v.) + (D1 N1 + D2 N2 + D3 N3+)(v)/c(v.) * p(w), where p(w)
is the same over numbers of different left words, interpolated with 1/(V+1).
A text's words are lower-cased (A-Z), the first follows a start mark, one end
mark follows the last.

Edge cases: a null or empty text is one end mark; without training texts each
token has probability 1/(V+1) = 1; counts of counts that leave a discount
undefined give 0.5, 1 and 1.5. Rows are scored one by one, so repeated ids and
extra columns do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from . import words as W
from .common import file_system, flat, load_array, parts, save_array, stored

#: Pairs that a task holds before it deals them out, which bounds its memory.
BUFFER = 3_000_000
START, END = np.uint64(0x5EED5EED5EED5EED), np.uint64(0xE0D0E0D0E0D0E0D0)
_U = np.uint64


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left word, right word and text of every token, the end marks included."""
    buf, offs = flat(column)
    n = len(offs) - 1
    buf = W.LOWER[buf]
    start, end, doc = W.spans(buf, offs)
    count = np.bincount(doc, minlength=n) + 1
    right = np.full(len(doc) + n, END, _U)
    ends = np.cumsum(count) - 1
    inner = np.ones(len(right), bool)
    inner[ends] = False
    right[inner] = W.hashes(buf, start, end)
    left = np.empty_like(right)
    left[1:] = right[:-1]
    left[np.r_[0, ends[:-1] + 1] if n else ends] = START
    return left, right, np.repeat(np.arange(n), count)


def _side(word: np.ndarray, grid: int) -> np.ndarray:
    return ((word >> _U(32)) * _U(grid) >> _U(32)).astype(np.int64)


def pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return W.mix(W.mix(left) + right)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal sorted keys, and one past the last."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return first, np.r_[first, len(keys)]


def _packed(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def _deal(left: np.ndarray, right: np.ndarray, grid: int) -> Iterator[tuple]:
    """The distinct pairs with counts, one row a shard: left words with their run lengths, right words, counts."""
    order = np.lexsort((right, left))
    left, right = left[order], right[order]
    first = np.flatnonzero(np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
    count = np.diff(np.r_[first, len(left)]).astype(np.uint32)
    left, right = left[first], right[first]
    shard = _side(left, grid) * grid + _side(right, grid)
    order = np.argsort(shard, kind="stable")
    at = np.searchsorted(shard[order], np.arange(grid * grid + 1))
    for s in np.flatnonzero(np.diff(at)):
        own = order[at[s] : at[s + 1]]
        runs, ends = _groups(left[own])
        yield (int(s), *_packed(left[own][runs], np.diff(ends).astype(np.uint32)), right[own].tobytes(), *_counts(count[own]))


def _counts(count: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as bytes, 255 standing for the next of the large ones."""
    large = count >= 255
    return np.where(large, 255, count).astype(np.uint8).tobytes(), count[large].astype(np.uint64).tobytes()


def _uncounted(small: bytes, large: bytes) -> np.ndarray:
    out = np.frombuffer(small, np.uint8).astype(np.uint64)
    out[out == 255] = np.frombuffer(large, np.uint64)
    return out


def _discounts(n: list[int]) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more."""
    n1, n2, n3, n4 = n
    out = [0.0, 0.5, 1.0, 1.5]
    if n1 and n2 and n3 and n4:
        y = n1 / (n1 + 2 * n2)
        own = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        out[1:] = [x if 0 < x <= k else out[k] for k, x in enumerate(own, 1)]
    return np.array(out)


def _of_counts(count: np.ndarray) -> list[int]:
    return [int((count == k).sum()) for k in (1, 2, 3, 4)]


@dataclass
class Model:
    """Where the arrays are, and the few numbers that all words share."""

    folder: str
    grid: int
    pair_discount: np.ndarray
    word_discount: np.ndarray
    n_pairs: int  # distinct
    word_types: list[int]  # words with 1, 2, 3 or more different left words
    train_tokens: int
    n_types: int

    def _file(self, kind: str, shard: int) -> np.ndarray:
        """A sorted array of the model; a file stays mapped while the worker lives."""
        name = f"{self.folder}/{kind}-{shard}.npy"
        if name not in _mapped:
            _mapped[name] = load_array(name)
        return _mapped[name]

    def _find(self, kind: str, values: tuple[str, ...], shard: np.ndarray, key: np.ndarray) -> list[np.ndarray]:
        """The values of each key (0 if absent), shard by shard."""
        out = [np.zeros(len(key)) for _ in values]
        order = np.lexsort((key, shard))
        ranked = shard[order]
        first, ends = _groups(ranked)
        for lo, hi in zip(first, ends[1:], strict=True):
            s, own = int(ranked[lo]), order[lo:hi]
            keys = self._file(f"{kind}-key", s)
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, key[own]), len(keys) - 1)
            hit = keys[at] == key[own]
            for o, v in zip(out, values, strict=True):
                o[own[hit]] = self._file(f"{kind}-{v}", s)[at[hit]]
        return out

    def score(self, column: pa.Array) -> dict[str, np.ndarray]:
        """n_tokens, n_known, base_score and score of each text."""
        left, right, doc = tokens(column)
        n = len(column)
        word, back = np.unique(right, return_inverse=True)
        prior, backwards = np.unique(left, return_inverse=True)
        pair, both = np.unique(pair_key(left, right), return_index=True)
        of_pair = np.searchsorted(pair, pair_key(left, right))
        seen, kinds = self._find("word", ("count", "kinds"), _side(word, self.grid), word) if self.train_tokens else [np.zeros(len(word))] * 2
        total, rest = self._find("left", ("count", "rest"), _side(prior, self.grid), prior) if self.train_tokens else [np.zeros(len(prior))] * 2
        shard = _side(left[both], self.grid) * self.grid + _side(right[both], self.grid)
        (count,) = self._find("pair", ("count",), shard, pair) if self.train_tokens else [np.zeros(len(pair))]
        v = self.n_types
        base = np.log10((seen + 0.5) / (self.train_tokens + 0.5 * (v + 1)))[back]
        unigram = np.full(len(word), 1.0 / (v + 1))
        if self.n_pairs:
            spare = float(self.word_discount[1:] @ np.array(self.word_types)) / self.n_pairs
            unigram = np.maximum(kinds - self.word_discount[np.minimum(kinds, 3).astype(int)], 0) / self.n_pairs + spare / (v + 1)
        known = total[backwards] > 0
        c, t = count[of_pair], np.maximum(total, 1)[backwards]
        p = np.where(known, np.maximum(c - self.pair_discount[np.minimum(c, 3).astype(int)], 0) / t + rest[backwards] * unigram[back], unigram[back])
        return {
            "n_tokens": np.bincount(doc, minlength=n),
            "n_known": np.bincount(doc[seen[back] > 0], minlength=n),
            "base_score": np.bincount(doc, base, n),
            "score": np.bincount(doc, np.log10(p), n),
        }


_mapped: dict[str, np.ndarray] = {}


def train(docs: DataFrame, text: str = "text") -> Model:
    """Count the texts and write the model's arrays."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "op3-model")
    # shards in proportion to the input's splits, so that a shard's size does not grow with the input
    grid = max(2, math.isqrt(4 * max(1, docs.rdd.getNumPartitions())))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(_deal(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), grid))
            held.clear()
            for at in range(0, len(rows), 64):
                cols = zip(*rows[at : at + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32()] + [pa.binary()] * 5, strict=True)], names=["shard", "left", "run", "right", "small", "large"])

        for batch in parts(batches, text):
            left, right, _ = tokens(batch.column(text))
            held.append((left, right))
            size += len(left)
            if size >= BUFFER:
                yield from flush()
                size = 0
        if size:
            yield from flush()

    pairs = docs.select(text).mapInArrow(count, "shard int, left binary, run binary, right binary, small binary, large binary")

    def merge(key: tuple, tables: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        left = np.concatenate([np.repeat(np.frombuffer(a, _U), np.frombuffer(b, np.uint32)) for a, b in zip(tables["left"].to_pylist(), tables["run"].to_pylist(), strict=True)])
        right = np.concatenate([np.frombuffer(x, _U) for x in tables["right"].to_pylist()])
        number = np.concatenate([_uncounted(a, b) for a, b in zip(tables["small"].to_pylist(), tables["large"].to_pylist(), strict=True)])
        order = np.lexsort((right, left))
        left, right, number = left[order], right[order], number[order]
        first = np.flatnonzero(np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
        number = np.add.reduceat(number, first)
        left, right = left[first], right[first]
        keys = pair_key(left, right)
        order = np.argsort(keys)
        save_array(f"{folder}/pair-key-{shard}.npy", keys[order])
        save_array(f"{folder}/pair-count-{shard}.npy", number[order].astype(np.min_scalar_type(int(number.max()))))
        runs, _ = _groups(left)
        few = [np.add.reduceat(x, runs) for x in (number, number == 1, number == 2, number >= 3)]
        order = np.argsort(right, kind="stable")
        starts, ends = _groups(right[order])
        by_right = [np.diff(ends), np.add.reduceat(number[order], starts)]
        rows = [
            ("left", shard // grid, left[runs].tobytes(), [x.astype(np.min_scalar_type(int(x.max()))) for x in few]),
            ("word", shard % grid, right[order][starts].tobytes(), [x.astype(np.min_scalar_type(int(x.max()))) for x in by_right]),
        ]
        return pa.table(
            {
                "kind": [r[0] for r in rows],
                "side": pa.array([r[1] for r in rows], pa.int32()),
                "keys": pa.array([r[2] for r in rows], pa.binary()),
                "values": pa.array([[x.tobytes() for x in r[3]] for r in rows], pa.list_(pa.binary())),
                "widths": pa.array([[x.dtype.itemsize for x in r[3]] for r in rows], pa.list_(pa.int32())),
                "facts": pa.array([[len(keys), *_of_counts(number)], None], pa.list_(pa.int64())),
            }
        )

    merged = stored(pairs.groupBy("shard").applyInArrow(merge, "kind string, side int, keys binary, values array<binary>, widths array<int>, facts array<bigint>"), "op3-counts")
    facts = merged.filter(F.col("facts").isNotNull()).agg(*[F.coalesce(F.sum(F.get("facts", F.lit(i))), F.lit(0)) for i in range(5)]).first()
    pair_discount = _discounts(list(facts)[1:])

    def join(key: tuple, tables: pa.Table) -> pa.Table:
        kind, side = key[0].as_py(), key[1].as_py()
        keys = np.concatenate([np.frombuffer(x, _U) for x in tables["keys"].to_pylist()])
        columns = []
        for i in range(4 if kind == "left" else 2):
            columns.append(np.concatenate([np.frombuffer(v[i], f"u{w[i]}").astype(np.uint64) for v, w in zip(tables["values"].to_pylist(), tables["widths"].to_pylist(), strict=True)]))
        order = np.argsort(keys, kind="stable")
        starts, _ = _groups(keys[order])
        columns = [np.add.reduceat(c[order], starts) for c in columns]
        save_array(f"{folder}/{kind}-key-{side}.npy", keys[order][starts])
        if kind == "left":
            save_array(f"{folder}/left-count-{side}.npy", columns[0].astype(np.min_scalar_type(int(columns[0].max()))))
            save_array(f"{folder}/left-rest-{side}.npy", sum(d * c for d, c in zip(pair_discount[1:], columns[1:], strict=True)) / columns[0])
            out = [0] * 8
        else:
            kinds, total = columns
            save_array(f"{folder}/word-kinds-{side}.npy", kinds.astype(np.min_scalar_type(int(kinds.max()))))
            save_array(f"{folder}/word-count-{side}.npy", total.astype(np.min_scalar_type(int(total.max()))))
            out = [int(total.sum()), len(kinds), *_of_counts(kinds), int((kinds >= 3).sum()), int((kinds == 2).sum())]
        return pa.table({"facts": pa.array([out], pa.list_(pa.int64()))})

    sides = stored(merged.groupBy("kind", "side").applyInArrow(join, "facts array<bigint>"), "op3-words")
    total, types, k1, k2, k3, k4, k3_more, _ = sides.agg(*[F.coalesce(F.sum(F.get("facts", F.lit(i))), F.lit(0)) for i in range(8)]).first()
    # shards without a pair have no file
    _fill(folder, grid)
    return Model(folder, grid, pair_discount, _discounts([k1, k2, k3, k4]), int(facts[0]), [k1, k2, k3_more], int(total), int(types))


def _fill(folder: str, grid: int) -> None:
    """Empty key arrays for shards and sides that no pair fell into (small corpora)."""
    fs, base = file_system(folder)
    have = {f.base_name for f in fs.get_file_info(FileSelector(base, allow_not_found=True))}
    for kind, n in (("pair", grid * grid), ("left", grid), ("word", grid)):
        for i in range(n):
            if f"{kind}-key-{i}.npy" not in have:
                save_array(f"{folder}/{kind}-key-{i}.npy", np.zeros(0, _U))


def scores(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_tokens, n_known, base_score, score of every document; perplexity is 10^(-score / n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, text, 1 << 22):
            got = model.score(batch.column(text))
            yield pa.RecordBatch.from_arrays([batch.column(id), *map(pa.array, got.values())], names=[id, *got])

    fields = [docs.schema[id], T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
    return docs.select(id, text).mapInArrow(run, T.StructType(fields))
