"""Step 0, encoding: projection, occurrence filter, class join, per-series and
per-shapelet collections, one shapelet per dimension (P1, F1, J1, A1, A2, V1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import first_index, first_token, min_as_text

# Positions of a (shapelet, series) pair are looked up in blocks of this many.
POSITION_BLOCK = 65536

OCC_KEY = ["S_class", "S_dimension", "S_name"]


def project_occurrence_sql(occ: DataFrame) -> DataFrame:
    """S4 + P1 through SQL text: the occurrence table is bound as a view and
    queried with `spark.sql` (Spark parses, analyses and optimises it)."""
    return occ.sparkSession.sql(
        "SELECT S_dimension, S_name, S_class, T_name, T_indice FROM {occ}", occ=occ
    )


def occurring_only_sql(occ: DataFrame) -> DataFrame:
    """S4 + F1 through SQL text: `T_indice != '[]'` on a view of the table."""
    return occ.sparkSession.sql(
        "SELECT S_dimension, S_name, S_class, T_name, T_indice FROM {occ} WHERE T_indice != '[]'", occ=occ
    )


def occurring_only(occ: DataFrame) -> DataFrame:
    """rows whose position list is not empty (`T_indice != '[]'`)."""
    return occ.filter(F.size("ix") > 0)


def join_class_left(occ: DataFrame, dataset: DataFrame) -> DataFrame:
    """Occurrences left-join the catalogue, keeping the catalogue's `T_name`
    (NULL when the series is not catalogued) and its class."""
    o, d = occ.alias("o"), dataset.alias("d")
    return o.join(d, F.col("o.T_name") == F.col("d.T_name"), "left").select(
        "o.S_dimension", "o.S_name", "o.S_class", "o.T_indice", "o.ix", F.col("d.T_name"), "d.class_d"
    )


def encode_series(occurring: DataFrame) -> DataFrame:
    """A1: per (S_class, T_name), the occurring shapelets, sorted.

    Duplicate rows of one shapelet are first reduced to one
    tuple (dimension, name, first position, rows, positions listed), so the
    list per series is bounded by the number of shapelets of the class, not by
    the length of the series."""
    per_shapelet = occurring.groupBy("S_class", "T_name", "S_dimension", "S_name").agg(
        F.min(first_index("ix")).alias("first"),
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.size("ix")).cast("bigint").alias("n_pos"),
    )
    item = F.struct("S_dimension", "S_name", "first", "n_rows", "n_pos")
    return per_shapelet.groupBy("S_class", "T_name").agg(
        F.count(F.lit(1)).alias("n_shapelets"),
        F.array_sort(F.collect_list(item)).alias("shapelets"),
    )


def shapelet_series_map(occ: DataFrame, dataset: DataFrame) -> DataFrame:
    """A2 in long form: one row per (shapelet, catalogued series), fixed width.

    Duplicate rows of a pair are merged:
    `vetoed` = some row lists no position (the reference's "x" marker),
    `present` = some row lists positions, `n_pos` = positions listed, `pmin` /
    `pmax` = smallest / largest position, `pmin_text` = smallest position
    compared as text. Series missing from the catalogue drop out (the
    reference's NULL key). The positions themselves stay in
    `position_blocks`, so no row grows with the length of a series.
    """
    joined = occ.select(*OCC_KEY, "T_name", "ix").join(dataset.select("T_name", "class_d"), "T_name")
    return joined.groupBy(*OCC_KEY, "T_name", "class_d").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max((F.size("ix") == 0).cast("int")).alias("vetoed"),
        F.max((F.size("ix") > 0).cast("int")).alias("present"),
        F.sum(F.size("ix")).cast("bigint").alias("n_pos"),
        F.min(F.array_min("ix")).alias("pmin"),
        F.max(F.array_max("ix")).alias("pmax"),
        F.min(min_as_text("ix")).alias("pmin_text"),
    )


def position_blocks(occ: DataFrame, dataset: DataFrame, block: int = POSITION_BLOCK) -> DataFrame:
    """Positions of each (shapelet, catalogued series) in blocks of `block`
    consecutive positions: (S_class, S_name, T_name, blk, pos, after), where
    `pos` holds the block's positions (sorted, distinct, at most `block`) and
    `after` is the smallest position in any later block.

    A chain only ever asks from a position that a shapelet of the class has in
    the series, so a shapelet has the blocks (also empty ones) that any shapelet
    of its class occupies there, up to its own last: "smallest position >= p" is
    one lookup at block p div `block`: min of `pos` >= p, else `after`. Their
    number follows the positions listed, not the largest of them."""
    key = ["S_class", "S_name", "T_name"]
    listed = occ.filter(F.size("ix") > 0).select(*key, F.explode("ix").alias("p"))
    listed = listed.join(dataset.select("T_name"), "T_name", "left_semi")
    blocks = listed.groupBy(*key, F.floor(F.col("p") / block).alias("blk")).agg(
        F.array_sort(F.array_distinct(F.collect_list("p"))).alias("pos")
    )
    occupied = blocks.select("S_class", "T_name", "blk").distinct()
    asked = (
        blocks.groupBy(*key)
        .agg(F.max("blk").alias("last"))
        .join(occupied, ["S_class", "T_name"])
        .filter(F.col("blk") <= F.col("last"))
        .select(*key, "blk")
        .join(blocks, [*key, "blk"], "left")
        .withColumn("pos", F.coalesce("pos", F.array().cast("array<bigint>")))
    )
    later = Window.partitionBy(*key).orderBy("blk").rowsBetween(1, Window.unboundedFollowing)
    return asked.withColumn("after", F.min(F.array_min("pos")).over(later))


def shapelet_name_order(occurring: DataFrame) -> DataFrame:
    """Name and order (first listed position) of each occurring row."""
    return occurring.select(
        "S_class",
        "T_name",
        "S_dimension",
        F.col("S_name").alias("shapelet_name"),
        first_index("ix").alias("shapelet_order"),
    )


def pick_per_dimension(occurring: DataFrame, text: Column | None = None) -> DataFrame:
    """V1: per (S_class, T_name, S_dimension) keep one shapelet: the smallest
    (order, name) — a deterministic form of the reference's first arrival.

    `min(struct)` aggregates partially before the shuffle, so a series with many
    shapelets in one dimension never gathers them in one task. Of the position
    list only `head` goes on, by default the text before its first comma.
    """
    text = first_token("T_indice") if text is None else text
    best = F.min(F.struct(first_index("ix").alias("ord"), F.col("S_name"), text.alias("head")))
    return (
        occurring.groupBy("S_class", "T_name", "S_dimension")
        .agg(best.alias("p"))
        .select("S_class", "T_name", "S_dimension", "p.S_name", "p.ord", "p.head")
    )


def series_tuples(occurring: DataFrame) -> DataFrame:
    """A1 in long form: the tuples (S_dimension, T_indice, gain, S_name, S_class) that
    a (S_class, T_name) gathers, one row each, with how often it is listed."""
    return occurring.groupBy("S_class", "T_name", "S_dimension", "S_name", "T_indice", "gain").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def shapelet_tuples(joined: DataFrame) -> DataFrame:
    """A2 in long form: the pairs (T_name, T_indice) that a (S_dimension, S_name,
    S_class) gathers, one row each, with how often it is listed. Takes J1's rows:
    `T_name` is NULL for a series that is not in the catalogue."""
    return joined.groupBy("S_dimension", "S_name", "S_class", "T_name", "T_indice").agg(
        F.count(F.lit(1)).alias("n_rows")
    )
