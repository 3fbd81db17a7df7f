"""Step 1, enumeration: all non-empty subsets of the per-dimension picks of a
series, each ordered by position (V2-V8, A5, A10)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import LIST, sequence_id

# Subsets are made in runs of at most 2^16 from one row.
LOW_BITS = 16
MOST_DIMENSIONS = 62


def _binomials(k_max: int) -> Column:
    """C(n, k) for n to 62 and k to `k_max`, flat by n (a folded constant)."""
    rows = [math.comb(n, k) for n in range(MOST_DIMENSIONS + 1) for k in range(k_max + 1)]
    return F.split(F.lit(",".join(map(str, rows))), ",").cast("array<bigint>")


def _unranked(d: Column, k: Column, rank: Column, k_max: int) -> Column:
    """The mask of the subset of `k` among `d` picks with the given rank, in the order of
    masks: the highest pick is the largest i with C(i, k) <= rank, and so on down."""
    table = _binomials(k_max)

    def next_pick(acc: Column, i: Column) -> Column:
        below = F.get(table, (i * (k_max + 1) + acc["k"]).cast("int"))
        taken = (acc["k"] > 0) & (below <= acc["rank"])
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), i.cast("int"))
        return F.struct(
            F.when(taken, acc["k"] - 1).otherwise(acc["k"]).alias("k"),
            F.when(taken, acc["rank"] - below).otherwise(acc["rank"]).alias("rank"),
            F.when(taken, acc["mask"] + bit).otherwise(acc["mask"]).alias("mask"),
        )

    start = F.struct(k.cast("int").alias("k"), rank.alias("rank"), F.lit(0).cast("bigint").alias("mask"))
    return F.aggregate(F.sequence(d - 1, F.lit(0), F.lit(-1)), start, next_pick, lambda acc: acc["mask"])


def _runs(ranges: DataFrame, low_bits: int) -> DataFrame:
    """The ranges [lo, hi) cut into runs of 2^low_bits at most, level by level, so that no
    array is longer than a run."""
    step = 1 << 62
    while step > 1 << low_bits:
        step = max(step >> low_bits, 1 << low_bits)
        ranges = ranges.filter("lo < hi").withColumn("lo", F.explode(F.sequence("lo", F.col("hi") - 1, F.lit(step))))
        ranges = ranges.withColumn("hi", F.least("hi", F.col("lo") + step))
    return ranges


def enumerate_sequences(picks: DataFrame, max_len: int | None = None, low_bits: int = LOW_BITS) -> DataFrame:
    """V2/V3/V4: one row per (S_class, source T_name, subset of picks).

    The picks of a series (at most one per dimension) are gathered into a sorted
    array, each subset is a bit mask (BIGINT) over it. The masks 1 to 2^d - 1 are
    cut into runs of 2^`low_bits`, which are dealt out over the tasks and stream
    out there; `filter` keeps the chosen picks, in (order, name) order. With
    `max_len` only the subsets of at most that size are made: for each size k the
    ranks 0 to C(d, k) - 1 are cut into runs, and a rank's subset is found from
    binomial coefficients. Up to 62 dimensions; more are an error.

    Columns: S_class, T_name, mask, steps array<struct<ord, S_name, S_dimension,
    head>>, n_steps, names (shapelet keys in order), ords, set_key (keys
    sorted), sid (series and names); see `functions.identity`.
    """
    step = F.struct("ord", "S_name", "S_dimension", "head")
    per_series = picks.groupBy("S_class", "T_name").agg(F.array_sort(F.collect_list(step)).alias("picks"))
    wide = F.raise_error(F.concat(F.lit(f"more than {MOST_DIMENSIONS} dimensions in series "), F.coalesce("T_name", F.lit("(null)"))))
    d = F.when(F.size("picks") > MOST_DIMENSIONS, wide.cast("int")).otherwise(F.size("picks"))
    ranges = per_series.select("S_class", "T_name", "picks", d.alias("d"))
    if max_len is None:
        ranges = ranges.select("*", F.lit(0).alias("k"), F.lit(1).cast("bigint").alias("lo"), F.expr("shiftleft(1L, d)").alias("hi"))
    else:
        k_max = max(1, min(max_len, MOST_DIMENSIONS))
        ranges = ranges.withColumn("k", F.explode(F.sequence(F.lit(1), F.least("d", F.lit(k_max))))).filter(F.lit(max_len) > 0)
        ranges = ranges.select("*", F.lit(0).cast("bigint").alias("lo"), F.get(_binomials(k_max), F.col("d") * (k_max + 1) + F.col("k")).alias("hi"))
    runs = _runs(ranges, low_bits).repartition("S_class", "T_name", "k", "lo")
    seqs = runs.withColumn("mask", F.explode(F.sequence("lo", F.col("hi") - 1)))
    if max_len is not None:
        seqs = seqs.withColumn("mask", _unranked(F.col("d"), F.col("k"), F.col("mask"), k_max))
    chosen = F.expr("filter(picks, (x, i) -> (shiftright(mask, i) & 1) = 1)")
    seqs = seqs.select("S_class", "T_name", "mask", chosen.alias("steps"))
    names = F.transform("steps", lambda x: x["S_name"])
    return seqs.select(
        "S_class",
        "T_name",
        "mask",
        "steps",
        F.size("steps").alias("n_steps"),
        F.array_join(names, LIST).alias("names"),
        F.array_join(F.transform("steps", lambda x: x["ord"].cast("string")), ",").alias("ords"),
        F.array_join(F.array_sort(names), LIST).alias("set_key"),
        sequence_id(F.col("T_name"), F.array_join(names, LIST)).alias("sid"),
    )


def sequence_items(seqs: DataFrame) -> DataFrame:
    """V6/V7/V8: one row per (sequence, step); `step` is 0-based."""
    return seqs.select("S_class", "sid", "names", "set_key", "n_steps", F.posexplode("steps").alias("step", "s")).select(
        "S_class",
        "sid",
        "names",
        "set_key",
        "n_steps",
        F.col("step").cast("int").alias("step"),
        "s.S_name",
        "s.S_dimension",
        "s.ord",
    )


def order_sequence(seqs: DataFrame) -> DataFrame:
    """V3: the order of a sequence by numeric first position (ours) next to the
    reference's literal key, the text before the first comma of `T_indice`."""
    literal = F.array_sort(
        F.transform("steps", lambda x: F.struct(x["head"].alias("k"), x["S_name"].alias("n")))
    )
    return seqs.select(
        "S_class",
        "sid",
        "names",
        F.array_join(F.transform(literal, lambda x: x["n"]), LIST).alias("names_literal"),
    )


def distinct_sequences(seqs: DataFrame) -> DataFrame:
    """Distinct ordered sequences of a class, with how many series gave them."""
    return seqs.groupBy("S_class", "names", "set_key", "n_steps").agg(F.count(F.lit(1)).alias("n_sources"))


def class_sequences(seqs: DataFrame) -> DataFrame:
    """A5/V5: per class, the sequences gathered (as counts: the reference's one
    row per class holding every sequence is never built)."""
    return seqs.groupBy("S_class").agg(
        F.count(F.lit(1)).alias("n_sequences"),
        F.countDistinct("T_name").alias("n_sources"),
        F.max("n_steps").alias("max_steps"),
        F.sum("n_steps").cast("bigint").alias("total_steps"),
    )


def class_sequence_rows(seqs: DataFrame) -> DataFrame:
    """A5/V5 flattened, A12: the sequences that the series of a class gather, one row
    for each different one (shapelets and orders), with how many series gave it."""
    return seqs.groupBy("S_class", "names", "ords", "n_steps").agg(F.count(F.lit(1)).alias("n_sources"))


def sequence_count_by_class(seqs: DataFrame) -> DataFrame:
    """Distinct ordered sequences and distinct name sets per class."""
    return seqs.groupBy("S_class").agg(
        F.count(F.lit(1)).alias("n_sequences"),
        F.countDistinct("names").alias("n_ordered"),
        F.countDistinct("set_key").alias("n_sets"),
    )
