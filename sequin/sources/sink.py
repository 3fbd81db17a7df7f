"""Write a result table to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write `df` (parquet by default); Spark writes each task's part atomically."""
    df.write.mode(mode).format(fmt).save(path)
