"""Series catalogue and shapelet occurrences derived from the `events` table.

Each user is one multivariate series `u_<user_id>`; each event type is one
dimension; the event's position is its rank within the user's events ordered by
(ts, event_id). A shapelet is an (event type, value band) pair; it occurs in a
series at the positions of the user's events of that type in that band.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir

# Fixed values of the fixture (they must match the oracle's SQL):
#   dimension: event type; value band: floor(value / 50); all of them that the data has
#   shapelet classes by band: 2 and 3 normal, every other abnormal
#   planted series class: normal if the user has a click in band 2 and a view in band 2,
#   else abnormal
#   shapelet name: 'shp-' || event_type || '-' || band; series name: 'u_' || user_id
BAND_WIDTH = 50
NORMAL_BANDS = [2, 3]
CLASSES = ["abnormal", "normal"]
PLANTED_BAND = 2
PLANTED_TYPES = ["click", "view"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _series_name(user_id) -> F.Column:
    return F.concat(F.lit("u_"), F.col(user_id).cast("string"))


def _band() -> F.Column:
    return F.floor(F.col("value") / BAND_WIDTH).cast("int")


def rank_within(df: DataFrame, key: str, order: list[str], chunks: int | None = None) -> DataFrame:
    """Adds `_rank` (1-based) = row_number() over (partition by key order by order),
    computed without sending one key's rows to one task.

    Rows are range-partitioned on (key, *order), so a key holding a large share of
    the rows is spread over several chunks; the chunk id is pinned by a reliable
    checkpoint (range bounds come from a sample and must not change on recompute).
    Each row's rank = its rank within (key, chunk) + the sizes of the key's
    earlier chunks (a per-key running sum over at most `chunks` rows). Chunks
    default to max(shuffle partitions, input splits)."""
    spark = df.sparkSession
    shared_dir(spark)  # the checkpoint goes to the shared folder
    # At least one chunk per input split (planning only, no job), so a chunk
    # stays near `spark.sql.files.maxPartitionBytes` however large the table.
    n = chunks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
    ranged = df.repartitionByRange(n, key, *order).withColumn("_chunk", F.spark_partition_id()).checkpoint()
    local = ranged.withColumn(
        "_local", F.row_number().over(Window.partitionBy(key, "_chunk").orderBy(*order))
    )
    sizes = ranged.groupBy(key, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    return local.join(offsets, [key, "_chunk"]).select(
        *df.columns, (F.col("_off") + F.col("_local")).alias("_rank")
    )


def event_positions(events: DataFrame) -> DataFrame:
    """(T_name, S_dimension, band, pos): one row per event; pos = 0-based rank of
    the event among its user's events by (ts, event_id)."""
    cols = events.select("user_id", "ts", "event_id", "event_type", "value")
    ranked = rank_within(cols, "user_id", ["ts", "event_id"])
    return ranked.select(
        _series_name("user_id").alias("T_name"),
        F.col("event_type").alias("S_dimension"),
        _band().alias("band"),
        (F.col("_rank") - 1).cast("bigint").alias("pos"),
    )


def series_catalogue(events: DataFrame) -> DataFrame:
    """(T_name, class_d): one row per user, with the planted class."""
    flags = [
        F.max(((F.col("event_type") == t) & (_band() == PLANTED_BAND)).cast("int")).alias(f"has_{t}")
        for t in PLANTED_TYPES
    ]
    planted = F.lit(True)
    for t in PLANTED_TYPES:
        planted = planted & (F.col(f"has_{t}") == 1)
    return (
        events.groupBy("user_id")
        .agg(*flags)
        .select(
            _series_name("user_id").alias("T_name"),
            F.when(planted, F.lit("normal")).otherwise(F.lit("abnormal")).alias("class_d"),
        )
    )


def shapelet_catalogue(events: DataFrame) -> DataFrame:
    """(S_name, S_dimension, S_class, band): every (event type, band) that the data has."""
    kinds = events.select(F.col("event_type").alias("S_dimension"), _band().alias("band")).filter("band IS NOT NULL").distinct()
    return kinds.select(
        F.concat_ws("-", F.lit("shp"), "S_dimension", F.col("band").cast("string")).alias("S_name"),
        "S_dimension",
        F.when(F.col("band").isin(NORMAL_BANDS), "normal").otherwise("abnormal").alias("S_class"),
        "band",
    )


def occurrences(events: DataFrame, dataset: DataFrame) -> DataFrame:
    """One row per (shapelet, series in the catalogue), the record of the reference's
    input: `ix` = sorted positions, [] if the shapelet never occurs there."""
    positions = (
        event_positions(events)
        .groupBy("T_name", "S_dimension", "band")
        .agg(F.array_sort(F.collect_list("pos")).alias("ix"))
    )
    # one row: types x bands, however many events there are
    catalogue = shapelet_catalogue(events).agg(F.collect_list(F.struct("S_name", "S_dimension", "S_class", "band"))).scalar()
    pairs = dataset.select("T_name", F.explode(catalogue).alias("s")).select("T_name", "s.*")
    # both sides have as many rows as the result, but the plan takes the pairs for a catalogue's
    # size and would broadcast them where a filter makes this an inner join
    return pairs.join(positions.hint("merge"), ["T_name", "S_dimension", "band"], "left").select(
        "S_name",
        F.lit("events").alias("S_origin"),
        "S_dimension",
        "S_class",
        "T_name",
        F.concat(F.lit("["), F.coalesce(F.array_join("ix", ", "), F.lit("")), F.lit("]")).alias("T_indice"),
        F.coalesce("ix", F.array().cast("array<bigint>")).alias("ix"),
        F.lit(0.0).alias("gain"),
        F.array(
            (F.col("band") * BAND_WIDTH).cast("double"), ((F.col("band") + 1) * BAND_WIDTH).cast("double")
        ).alias("sub_sequence"),
        F.create_map(F.col("T_name"), F.lit(0.0)).alias("distance"),
    )


def fixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(dataset, occ) for the scale-factor folder `sf_dir`."""
    events = read_table(spark, sf_dir, "events")
    dataset = series_catalogue(events)
    return dataset, occurrences(events, dataset)
