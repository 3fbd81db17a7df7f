"""Operator 9, exact dedup: two passes with a Bloom filter of hashes seen twice.

Texts are equal when identical after lower-casing A-Z; a null text counts as
empty. Pass 1 notes for each row k cells of a filter with two bit planes (seen
once, seen twice or more). Pass 2 asks whether all cells of a row were seen
twice: a row with a cell of its own has no copy and passes straight through;
only the others (every true copy, and a few unlucky rows) shuffle, as
(digest, id) without text. The filter has ``CELLS_PER_ROW`` cells a row, at
least 2^12 and at most ``2**max_bits`` (32 MB for the plane that is broadcast),
so its size is bounded; beyond that more rows shuffle, the result is the same.

Edge cases: of equal texts the row with the largest id stays (a null id is
smaller than any other); rows with equal text and equal id are told apart by
their place, one stays. An empty table gives an empty result. Extra columns are
ignored by ``decisions`` and kept by ``keep``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import parts, salted_lookup, stored

CELLS_PER_ROW = 16
K = 4
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))  # A-Z to a-z


def _digests(column: pa.Array) -> list[bytes]:
    return [hashlib.sha256((x or b"").translate(_FOLD)).digest() for x in column.cast(pa.large_binary()).to_pylist()]


def with_digest(docs: DataFrame, text: str, out: str) -> DataFrame:
    """The rows with the SHA-256 (32 bytes) of their normalised text in ``out``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, text):
            digests = pa.array(_digests(batch.column(text)), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, digests], names=[*batch.schema.names, out])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(out, T.BinaryType())]))


def _cells(digests: list[bytes], bits: int) -> np.ndarray:
    """K cell numbers for each digest, from separate 8-byte words of it."""
    words = np.frombuffer(b"".join(digests), np.dtype("<u8")).reshape(-1, 4)[:, :K]
    return (words >> np.uint64(64 - bits)).astype(np.int64)


def _plane(bits: int) -> np.ndarray:
    return np.zeros(1 << (bits - 3), np.uint8)


def _set(plane: np.ndarray, cells: np.ndarray) -> None:
    np.bitwise_or.at(plane, cells >> 3, (1 << (cells & 7)).astype(np.uint8))


def _get(plane: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (plane[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 > 0


def seen_twice(digests: DataFrame, column: str, bits: int) -> np.ndarray:
    """Pass 1: the plane of cells that were noted at least twice, merged as a tree."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = _plane(bits), _plane(bits)
        for batch in batches:
            if batch.num_rows:
                cells, count = np.unique(_cells(batch.column(column).to_pylist(), bits), return_counts=True)
                again = cells[(count > 1) | _get(once, cells)]
                _set(twice, again)
                _set(once, cells)
        packed = [pa.array([zlib.compress(p.tobytes(), 1)], pa.binary()) for p in (once, twice)]
        yield pa.RecordBatch.from_arrays(packed, names=["once", "twice"])

    def merge(a: tuple[bytes, bytes], b: tuple[bytes, bytes]) -> tuple[bytes, bytes]:
        a1, a2, b1, b2 = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (*a, *b))
        return zlib.compress((a1 | b1).tobytes(), 1), zlib.compress((a2 | b2 | (a1 & b1)).tobytes(), 1)

    planes = digests.select(column).mapInArrow(local, "once binary, twice binary").rdd.map(lambda r: (bytes(r[0]), bytes(r[1])))
    if planes.getNumPartitions() == 0:
        return _plane(bits)
    _, twice = planes.treeReduce(merge, depth=3)
    return np.frombuffer(zlib.decompress(twice), np.uint8)


def flag_repeated(rows: DataFrame, column: str, twice: np.ndarray, bits: int, out: str, text: str | None = None) -> DataFrame:
    """Pass 2: whether a row may have a copy (never false for one that has).

    With ``text`` the digest is made on the way, in the same worker, and added as ``column``.
    """
    shared = rows.sparkSession.sparkContext.broadcast(twice)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, text) if text else batches:
            if batch.num_rows:
                digests = _digests(batch.column(text)) if text else batch.column(column).to_pylist()
                more = {column: pa.array(digests, pa.binary())} if text else {}
                more[out] = pa.array(_get(shared.value, _cells(digests, bits)).all(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, *more.values()], names=[*batch.schema.names, *more])

    fields = [T.StructField(column, T.BinaryType())] if text else []
    return rows.mapInArrow(add, T.StructType([*rows.schema.fields, *fields, T.StructField(out, T.BooleanType())]))


def _filter(hashed: DataFrame, max_bits: int) -> tuple[np.ndarray, int]:
    bits = min(max_bits, max(12, (hashed.count() * CELLS_PER_ROW).bit_length()))
    return seen_twice(hashed, "digest", bits), bits


def decisions(docs: DataFrame, id: str = "doc_id", text: str = "text", max_bits: int = 28) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, digest (bytes)."""
    hashed = stored(with_digest(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), "text", "digest").select("id", "digest", F.monotonically_increasing_id().alias("uid")), "op9-digests")
    twice, bits = _filter(hashed, max_bits)
    flagged = stored(flag_repeated(hashed, "digest", twice, bits, "maybe"), "op9-flagged")
    alone = flagged.filter(~F.col("maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    maybe = flagged.filter("maybe")
    groups = maybe.groupBy("digest").agg(F.max(F.struct("id", "uid")).alias("last"), F.count("*").alias("group_size"))
    copies = salted_lookup(maybe, groups, ["digest"], F.col("uid")).select("id", F.col("last.id").alias("keep_id"), "group_size", (F.col("uid") == F.col("last.uid")).alias("kept"), "digest")
    return alone.unionByName(copies).withColumnRenamed("id", id)


def keep(docs: DataFrame, id: str = "doc_id", text: str = "text", max_bits: int = 28) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows without a repeated digest pass straight through; of the others the text
    shuffles once, by (digest, id), which spreads a large group of copies.
    """
    names = docs.columns
    hashed = stored(with_digest(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), "text", "digest").select("id", "digest"), "op9-digests")
    twice, bits = _filter(hashed, max_bits)
    last = flag_repeated(hashed, "digest", twice, bits, "maybe").filter("maybe").groupBy("digest").agg(F.max("id").alias("_id")).withColumnRenamed("digest", "_d")
    flagged = flag_repeated(docs, "_digest", twice, bits, "_maybe", text)
    alone = flagged.filter(~F.col("_maybe")).select(*names)
    maybe = flagged.filter("_maybe")
    stay = maybe.join(last, (F.col("_digest") == F.col("_d")) & F.col(id).eqNullSafe(F.col("_id")), "left_semi")
    one = Window.partitionBy("_digest", id).orderBy(*[F.col(c) for c in names if c not in (id, text)], F.lit(0))
    return alone.unionByName(stay.withColumn("_n", F.row_number().over(one)).filter("_n = 1").select(*names))
