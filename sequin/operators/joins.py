"""Joining sequence items to the rows of shapelets or sets per series.

The items grow with the number of distinct sequences, the rows with the number
of series; the keys are shapelets or sets, so one key may hold many rows. The
choice between a broadcast of the items and a shuffle, and the split of a hot
key's partition, are left to adaptive execution, which measures bytes at run
time. Where it is off, or a key is known to be hot, ``salts`` spreads every key
over that many tasks, with as many copies of the items.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_bounded(
    large: DataFrame, small: DataFrame, keys: list[str], spread_by: list[str], salts: int | None = None
) -> DataFrame:
    """Inner join of `large` and `small` on `keys`; `spread_by` are columns of `large`
    that differ between the rows of a key (e.g. the series) and feed the salt."""
    if salts is None:
        return large.join(small, keys)
    salted_large = large.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    salted_small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_large.join(salted_small, [*keys, "_salt"]).drop("_salt")


# Rows of a dealt join that one task makes.
TASK_ROWS = 1_000_000


def join_dealt(
    large: DataFrame,
    small: DataFrame,
    keys: list[str],
    spread_by: list[str],
    rows: int = TASK_ROWS,
    counted: DataFrame | None = None,
    weight: Column | None = None,
) -> DataFrame:
    """Inner join whose result is far larger than its sides, dealt by the rows it makes.

    Adaptive execution deals tasks by the bytes read, which say nothing of a product. Here
    both sides are counted by key: the tasks are as many as the result needs at about `rows`
    each, and a key that makes more is cut into chunks of `large` (by `spread_by`), each
    with a copy of the key's rows of `small`. The list of such keys is no longer than that
    of the tasks. Both sides are read twice, or `counted` in place of `large`: a table with
    about as many rows of each key that costs less to make. `weight`: the rows that a row of
    `small` stands for."""
    n = (large if counted is None else counted).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    m = small.groupBy(*keys).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_m"))
    made = n.join(m, keys).withColumn("_rows", F.col("_n") * F.col("_m"))
    known = made.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("all"), F.count_if(F.col("_rows") > rows).alias("hot")).first()
    parts = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(parts, math.ceil(known["all"] / rows))
    if known["hot"]:
        hot = made.filter(F.col("_rows") > rows).select(*keys, F.least("_n", F.ceil(F.col("_rows") / rows)).alias("_chunks"))
        chunks = F.coalesce("_chunks", F.lit(1))
        large = large.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread_by), chunks)).drop("_chunks")
        small = small.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1))).drop("_chunks")
        keys = [*keys, "_salt"]
    return large.repartition(tasks, *keys).join(small.repartition(tasks, *keys), keys).drop("_salt")


# What is gathered in one row of a run, about.
RUN = 1000


def gathered_runs(rows: DataFrame, keys: list[str], columns: list[str], run: int = RUN, weight: Column | None = None) -> DataFrame:
    """(keys, members): the rows of a key as arrays of `columns`, cut by hash so that an array
    holds about `run` rows, or what they weigh; what only differs in `columns` is then made
    once for each array."""
    n = rows.groupBy(*keys).agg(F.ceil((F.count(F.lit(1)) if weight is None else F.sum(weight)) / run).alias("_runs"))
    cut = rows.join(n, keys).withColumn("_run", F.pmod(F.xxhash64(*columns), F.col("_runs")))
    return cut.groupBy(*keys, "_run").agg(F.collect_list(F.struct(*columns)).alias("members")).drop("_run")


def indexed_runs(rows: DataFrame, keys: list[str], columns: list[str], run: int = RUN, weight: Column | None = None) -> DataFrame:
    """(keys, members, parts): runs of rows that have an array `parts` of what their result is
    put together from. `parts` has the different ones of a run; a member has the `columns`
    and, as `f`, the places of its own, so that a part is worked out once for all of them."""
    runs = gathered_runs(rows, keys, [*columns, "parts"], run, weight)
    runs = runs.withColumn("parts", F.array_distinct(F.flatten(F.transform("members", lambda m: m["parts"]))))
    place = lambda p: (F.array_position("parts", p) - 1).cast("int")
    member = lambda m: F.struct(*[m[c].alias(c) for c in columns], F.transform(m["parts"], place).alias("f"))
    return runs.withColumn("members", F.transform("members", member))


# Parts of a member, at most, that are read one by one in compiled code; more go by a loop.
COMPILED_PARTS = 8


def parts_of(values: str, most: int) -> list[Column] | Column:
    """A member's entries of `values` (an array beside `f`): with at most so many parts a column
    for each, NULL beyond the last, else an array."""
    if most > COMPILED_PARTS:
        return F.transform("f", lambda k: F.get(values, k))
    return [F.get(values, F.get("f", F.lit(j))) for j in range(max(most, 1))]
