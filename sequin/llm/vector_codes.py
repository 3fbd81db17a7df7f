"""Operator 12, product codes of vectors, with LAESA pivots in the search of entries.

Components become integers floor(4096 x); a vector is cut into 8 equal parts,
each with a codebook of 16 entries that six rounds of integer k-means move.

* Per part, ``PIVOTS`` of the first entries, far from one another, stay fixed as
  pivots. The distances of every part to its pivots are computed once and stored
  beside the integers in the shared folder.
* A round computes the distances of the pivots to the entries. By the triangle
  inequality |d(x, p) - d(p, e)| is a lower bound of d(x, e). A part tries the
  entries in the order of their bounds, with exact integer distances, and stops
  at the first bound above the best distance. Bounds allow for the rounding of
  the stored distances, so no entry that could win or tie is pruned.
* A round's result is sums and counts: each task sends at most 128 rows, which
  are added up by entry. The driver sees 128 rows a round and hands the new
  codebooks (128 entries) to the tasks.

Edge cases: rows whose vector is null or holds a null, NaN or infinite component
are dropped; so are rows whose vector has another length than that of the
smallest vec_id (null vec_ids come last, equal ones go by their vectors). That
length must divide into 8 parts, and |x| may be 2^14 at most: sums are 64-bit
integers; both are errors that say so. Fewer than 16 rows give as many entries.
Repeated rows are coded each. Without rows the result is empty. Null labels are
one label. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import salted_lookup, stored

PARTS, ENTRIES, ROUNDS, SCALE, PIVOTS = 8, 16, 6, 4096, 4
LARGEST = 1 << 14
#: Relative room for the rounding of stored distances (32-bit floats).
ROOM = 2.0**-21


@dataclass
class Codebooks:
    """``entries``: parts x entries x width, integers; ``pivots``: parts x pivots x width."""

    entries: np.ndarray
    pivots: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integers(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """vec_id, label, v: the usable rows, with integer components."""
    x = F.col(vector).cast("array<double>")
    finite = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    large = F.raise_error(F.concat(F.lit(f"a component beyond {LARGEST} in vector "), F.coalesce(F.col(id).cast("string"), F.lit("(null)"))))
    whole = F.when(F.exists(x, lambda c: F.abs(c) > LARGEST), large.cast("array<int>")).otherwise(F.transform(x, lambda c: F.floor(c * scale).cast("int")))
    return rows.filter(finite).select(F.col(id).alias("vec_id"), F.col(label).alias("label"), whole.alias("v"))


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x - y) ** 2).sum(axis=-1)


def pivots_of(entries: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Of each part's first entries the ``n`` farthest apart, greedily, from the first on."""
    out = []
    for book in entries:
        chosen = [0]
        near = _squared(book, book[0])
        while len(chosen) < min(n, len(book)):
            chosen.append(int(near.argmax()))
            near = np.minimum(near, _squared(book, book[chosen[-1]]))
        out.append(book[chosen])
    return np.array(out)


def nearest(x: np.ndarray, from_pivots: np.ndarray, book: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry (ties: the lower) of each row of ``x``, its squared distance, and the
    number of exact distances that were computed. ``from_pivots``: rows x pivots."""
    n, k = len(x), len(book)
    between = np.sqrt(_squared(pivots[:, None], book[None]).astype(float))  # pivots x entries
    bound = np.zeros((n, k))
    for p in range(len(pivots)):
        d = from_pivots[:, p, None].astype(float)
        np.maximum(bound, np.abs(d - between[p]) - (d + between[p]) * ROOM, out=bound)
    bound *= bound
    order = np.argsort(bound, axis=1, kind="stable")
    best, which, tried = np.full(n, np.iinfo(np.int64).max), np.full(n, k), 0
    at = np.arange(n)
    for r in range(k):
        e = order[at, r]
        go = bound[at, e] <= best[at]
        at, e = at[go], e[go]
        if not len(at):
            break
        tried += len(at)
        d = _squared(x[at], book[e])
        won = (d < best[at]) | ((d == best[at]) & (e < which[at]))
        best[at[won]], which[at[won]] = d[won], e[won]
    return which, best, tried


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1, width)


def _with_pivots(usable: DataFrame, pivots: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), np.int64, pivots.shape[2]) if batch.num_rows else np.zeros((0, *pivots.shape[::2]), np.int64)
            far = np.sqrt(_squared(x[:, :, None], pivots[None]).astype(float)).astype(np.float32)
            flat = far.reshape(-1)
            each = pivots.shape[0] * pivots.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * each), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "far"])

    return usable.mapInArrow(run, T.StructType([*usable.schema.fields, T.StructField("far", T.ArrayType(T.FloatType()))]))


def _assigned(batch: pa.RecordBatch, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts, entries and squared distances of a batch: rows x parts (x width)."""
    parts, _, width = books.entries.shape
    x = _matrix(batch.column("v"), np.int64, width)
    far = _matrix(batch.column("far"), np.float32, books.pivots.shape[1])
    found = [nearest(x[:, p], far[:, p], books.entries[p], books.pivots[p]) for p in range(parts)]
    return x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _moved(table: DataFrame, books: Codebooks) -> np.ndarray:
    """The entries after a round."""
    parts, k, width = books.entries.shape
    shared = table.sparkSession.sparkContext.broadcast(books)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * k, width), np.int64), np.zeros(parts * k, np.int64)
        for batch in batches:
            if batch.num_rows:
                x, which, _ = _assigned(batch, shared.value)
                slot = (which + np.arange(parts) * k).reshape(-1)
                np.add.at(sums, slot, x.reshape(-1, width))
                counts += np.bincount(slot, minlength=parts * k)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], names=["slot", "n", "s"])

    partial = table.select("v", "far").mapInArrow(local, "slot int, n long, s array<long>")
    total = partial.groupBy("slot").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(width)]).alias("s"))
    out = books.entries.copy().reshape(-1, width)
    for r in total.collect():  # one row an entry at most
        out[r["slot"]] = np.floor_divide(np.array(r["s"], np.int64), r["n"])
    shared.unpersist()
    return out.reshape(parts, k, width)


def train(usable: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks] | None:
    """The stored table (integers and distances to the pivots) and the codebooks after the
    rounds; None without rows."""
    first = [r["v"] for r in usable.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()]
    if not first:
        return None
    size = len(first[0])
    if size % parts or not size:
        raise ValueError(f"vectors of {size} components have no {parts} equal parts")
    usable = usable.filter(F.size("v") == size)
    if any(len(v) != size for v in first):
        first = [r["v"] for r in usable.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()]
    start = np.array(first, np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    pivots = pivots_of(start)
    table = stored(_with_pivots(usable, pivots), "op12-vectors")
    books = Codebooks(start, pivots)
    for _ in range(rounds):
        books = Codebooks(_moved(table, books), pivots)
    return table, books


def encode(table: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code, error of a stored table."""
    shared = table.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, which, far = _assigned(batch, shared.value)
                codes = [bytes(row).hex() for row in which.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes), pa.array(far.sum(1))], names=["vec_id", "label", "code", "error"])

    own = T.StructType([table.schema["vec_id"], table.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return table.mapInArrow(run, own)


def _present(column: Column) -> Column:
    return F.when(column.isNull(), "").otherwise(F.concat(F.lit("v"), column.cast("string")))


def codes(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable row."""
    usable = integers(rows, id, vector, label)
    trained = train(usable)
    if trained is None:
        nothing = usable.filter("false")
        return nothing.select(F.col("vec_id").alias(id), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    table, books = trained
    coded = stored(encode(table, books).withColumn("lk", _present(F.col("label"))), "op12-codes")
    by_label = coded.groupBy("lk").agg(F.sum("error").alias("label_error"))
    # a label may hold any share of the rows: its rows are spread before they meet the sum
    out = salted_lookup(coded, by_label, ["lk"], F.concat_ws("|", "vec_id", "code"))
    return out.select(F.col("vec_id").alias(id), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
