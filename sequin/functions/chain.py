"""Greedy in-order match of a sequence inside one series.

Steps arrive as an array of `struct<step, pos>` sorted by step. The first step
takes its smallest position; every later step takes its smallest position that
is >= the previous one. If a step has none the sequence is not found.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered_chain(steps: Column) -> Column:
    """-> struct<ok boolean, cur bigint, tas array<bigint>>; `tas` holds one position per step."""
    start = F.struct(
        F.lit(True).alias("ok"),
        F.lit(None).cast("bigint").alias("cur"),
        F.array().cast("array<bigint>").alias("tas"),
    )

    def step(acc: Column, x: Column) -> Column:
        nxt = F.when(acc["cur"].isNull(), F.array_min(x["pos"])).otherwise(
            F.array_min(F.filter(x["pos"], lambda p: p >= acc["cur"]))
        )
        ok = acc["ok"] & nxt.isNotNull()
        return F.when(
            ok,
            F.struct(F.lit(True).alias("ok"), nxt.alias("cur"), F.concat(acc["tas"], F.array(nxt)).alias("tas")),
        ).otherwise(F.struct(F.lit(False).alias("ok"), acc["cur"].alias("cur"), acc["tas"].alias("tas")))

    return F.aggregate(steps, start, step)
