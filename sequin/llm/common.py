"""What several operators share: scratch tables, row-wise Arrow work, links to files."""

from __future__ import annotations

import ctypes
import gc
import os
import shutil
import tempfile
from collections.abc import Iterable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: The contract's words: runs of anything but ASCII white space.
SPACES = r"[\x20\x09-\x0D]"
NON_SPACES = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to a fresh table in the shared folder and read it back (lineage is cut)."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def spent(*tables: DataFrame) -> None:
    """Delete ``stored`` tables that no later step reads: what was made of them is itself stored."""
    for t in tables:
        spark = t.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(t.scratch)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def settle(spark: SparkSession) -> None:
    """Between large steps: let go of what finished plans hold.

    Spark removes the shuffle files of a plan when the driver's collector finds the plan
    unreachable, which with a large heap may be long after its result was stored."""
    give_back()
    spark._jvm.System.gc()


def give_back() -> None:
    """Hand memory that this process has freed back to the system.

    After work on the driver (training on a sample, say) the allocators of Arrow and
    of C keep what was freed, beside the JVM's heap, as long as the driver lives."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not with this C library


def id_mod(col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n (null id: as empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def word_count(text: Column) -> Column:
    """Number of words of a text (null: 0), without a Python worker."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACES}+|{SPACES}+$", "")
    return F.when(F.length(bare) == 0, F.lit(0)).otherwise(F.size(F.split(bare, f"{SPACES}+"))).cast("long")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only (null: empty)."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def salted_lookup(rows: DataFrame, facts: DataFrame, key: list[str], spread: Column, salts: int = 64) -> DataFrame:
    """Inner join of many ``rows`` per key with the one row per key of ``facts``.

    The rows of a key are spread over ``salts`` join keys and the fact is copied
    only to the salts that the key's rows really use, so a key with a third of
    all rows is split and a key with two rows is copied at most twice.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    used = salted.groupBy(*key, "_salt").agg(F.lit(1).alias("_one")).drop("_one")
    return salted.join(used.join(facts, key), [*key, "_salt"]).drop("_salt")


# --- Arrow batches in Python workers -------------------------------------------------


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and n + 1 offsets (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def parts(batches: Iterable[pa.RecordBatch], text: str, size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with at most ``size`` bytes of text, one row at least.

    No row is cut: this bounds the temporary arrays of vectorised work, not the work.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text).cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(lengths), 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
            yield batch.slice(at, to - at)
            at = to


# --- files in the shared folder ------------------------------------------------------


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path below the shared folder, and the path on it."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return pafs.LocalFileSystem(), parsed.path
    return pafs.FileSystem.from_uri(uri)


def mappable(uri: str) -> str:
    """A path that this worker can map into memory.

    A shared folder mounted as files is mapped in place; from another store the
    file is fetched once into the worker's own temporary folder.
    """
    fs, path = file_system(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return path
    local = os.path.join(tempfile.gettempdir(), f"fetched-{os.getpid()}-{uri.replace('/', '_')[-120:]}")
    if not os.path.exists(local):
        with fs.open_input_stream(path) as source, open(f"{local}.part", "wb") as target:
            shutil.copyfileobj(source, target)
        os.replace(f"{local}.part", local)
    return local


def save_array(uri: str, array: np.ndarray) -> None:
    """Write one .npy file; a repeated task writes the same bytes under the same name."""
    fs, path = file_system(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{os.getpid()}-{os.urandom(4).hex()}.part"
    with fs.open_output_stream(part) as target:
        np.lib.format.write_array(target, np.ascontiguousarray(array), allow_pickle=False)
    fs.move(part, path)


def load_array(uri: str) -> np.ndarray:
    array = np.load(mappable(uri), mmap_mode="r", allow_pickle=False)
    return array
