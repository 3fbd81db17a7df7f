"""Session helpers: a tuned local session for tests/bench, and the shared folder.

On a cluster the session comes from the caller; nothing here overrides what the
cluster already set. The shared folder is the one named by ``spark.checkpoint.dir``
(or ``SparkContext.setCheckpointDir``); a private temporary folder is only used
when the session runs in local mode and no folder was configured.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings that matter for this workload at any scale: adaptive execution so the
# number of reducers, join strategy and skewed partitions are decided from the
# measured shuffle sizes, not from estimates.
ADAPTIVE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "sequin") -> SparkSession:
    """A local session for tests and the bench; the UI stays off."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "16g")
    )
    for key, value in ADAPTIVE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read and write (``spark.checkpoint.dir``).

    Read from the session first. Only a local-mode session without one gets a
    fresh private folder (tests); a cluster without the setting is an error,
    because a machine-local folder is not visible to the other executors.
    """
    sc = spark.sparkContext
    configured = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: point it at a folder shared by all executors"
        )
    folder = tempfile.mkdtemp(prefix="sequin-ckpt-", dir="/tmp")
    sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unique path below the shared folder for an intermediate table."""
    return os.path.join(shared_dir(spark), "sequin", f"{label}-{uuid.uuid4().hex}")


def pinned(df: DataFrame, label: str, keys: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Write an intermediate to the shared folder and read it back: its plan is a scan, its
    rows are the same for every reader, a lost executor costs nothing.

    With `keys` the table is bucketed and sorted by them, one file a bucket (`buckets`: the
    session's shuffle partitions), so that a join on the keys neither exchanges nor sorts it.
    The files stay until `remove` (`Mining.close`)."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if not keys:
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
        _paths.append((path, None))
        return out
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{label}_{uuid.uuid4().hex}".replace("-", "_")
    df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    _paths.append((path, name))
    return spark.table(name)


def remove(spark: SparkSession, mark: int) -> None:
    """Delete the pinned tables made since `mark` (`pinned_count`)."""
    made, _paths[mark:] = _paths[mark:], []
    for path, name in made:
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def pinned_count() -> int:
    return len(_paths)


#: Pinned tables: their folders and, if bucketed, their names.
_paths: list[tuple[str, str | None]] = []

#: Tables persisted since the start, in order; ``release`` takes them back.
_kept: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Persist an intermediate that is read more than once (on disk: no heap pressure)."""
    _kept.append(df.persist(StorageLevel.DISK_ONLY))
    return df


def kept_since(mark: int) -> list[DataFrame]:
    return _kept[mark:]


def kept_count() -> int:
    return len(_kept)


def release(tables: list[DataFrame]) -> None:
    """Unpersist; a table that is read again is computed again."""
    for df in tables:
        if any(df is x for x in _kept):
            _kept[:] = [x for x in _kept if x is not df]
            if df.sparkSession.sparkContext._jsc is not None:
                df.unpersist()
