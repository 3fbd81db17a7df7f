"""Presence by bitmaps of series: J5 and A7 without a row per (set, series).

The series of each class are numbered from 1, so that a series is a bit of a
block of 2^15. Per (shapelet, class, block) two bitmaps say which series have a
row and which have an empty one (a veto). A set is found where some row is and
no veto: with the shapelets' bitmaps or-ed, the number is the bits of the first
less the bits of the second, as a veto is a row, too. Memory and shuffle are 4 KB
at most for 32,768 series, whatever the number of sets that match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.fixture import rank_within
from .evaluate import SET_KEY, confusion


def series_numbers(dataset: DataFrame) -> DataFrame:
    """(T_name, class_d, n): the series of a class numbered from 1 by name, without one task
    per class."""
    return rank_within(dataset.select("T_name", "class_d").distinct(), "class_d", ["T_name"]).withColumnRenamed("_rank", "n")


def shapelet_bitmaps(tmap: DataFrame, numbers: DataFrame) -> DataFrame:
    """(S_class, S_name, class_d, block, rows, vetoes): the index. `vetoes` is NULL where
    there are none."""
    n = numbers.select(F.col("T_name").alias("_t"), F.col("class_d").alias("_c"), "n")
    met = tmap.join(n, (F.col("T_name") == F.col("_t")) & F.col("class_d").eqNullSafe(F.col("_c")))
    bit = F.bitmap_bit_position("n")
    vetoes = F.bitmap_construct_agg(F.when(F.col("vetoed") == 1, bit))
    return met.groupBy("S_class", "S_name", "class_d", F.bitmap_bucket_number("n").alias("block")).agg(
        F.bitmap_construct_agg(bit).alias("rows"), F.when(F.max("vetoed") == 1, vetoes).alias("vetoes")
    )


def set_counts(seqs: DataFrame, index: DataFrame) -> DataFrame:
    """(S_class, set_key, tp, n_found) of every set with a row somewhere, by bit counts."""
    names = F.array_sort(F.transform("steps", lambda x: x["S_name"]))
    items = seqs.select(*SET_KEY, names.alias("names")).distinct().select(*SET_KEY, F.explode("names").alias("S_name"))
    blocks = index.join(items, ["S_class", "S_name"])
    merged = blocks.groupBy(*SET_KEY, "class_d", "block").agg(
        F.bitmap_count(F.bitmap_or_agg("rows")).alias("n_rows"), F.bitmap_count(F.bitmap_or_agg("vetoes")).alias("n_vetoed")
    )
    n = F.col("n_rows") - F.coalesce("n_vetoed", F.lit(0))
    return merged.groupBy(*SET_KEY).agg(
        F.sum(F.when(F.col("class_d") == F.col("S_class"), n).otherwise(0)).alias("tp"), F.sum(n).alias("n_found")
    )


def bitmap_confusion(seqs: DataFrame, index: DataFrame, dataset: DataFrame) -> DataFrame:
    """A7/A8 (presence) per name set, as `evaluate.presence_confusion`, from the index."""
    sets = seqs.select(*SET_KEY).distinct()
    return confusion(sets.join(set_counts(seqs, index), SET_KEY, "left").fillna(0, ["tp", "n_found"]), SET_KEY, dataset)
