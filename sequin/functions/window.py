"""Time-window expressions: prefixing, sorting, re-ranking, first index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefix_indices(order: Column, ix: Column) -> Column:
    """Every position p of a shapelet with order o becomes the text `"o_p"`."""
    return F.transform(ix, lambda p: F.concat_ws("_", order.cast("string"), p.cast("string")))


def window_entry(order: Column, position: Column) -> Column:
    return F.concat_ws("_", order.cast("string"), position.cast("string"))


def prefixed(positions: Column, prefix: Column) -> Column:
    """V11 on positions joined by commas: the prefix before each, still joined."""
    return F.concat(prefix, F.replace(positions, F.lit(","), F.concat(F.lit(","), prefix)))


def entry_position(entry: Column) -> Column:
    """`"o_p"` -> p."""
    return F.substring_index(entry, "_", -1).cast("bigint")


def first_of_window(entries: Column) -> Column:
    """V12 + V14, literal: sort the `"o_p"` texts and keep p of the first one."""
    return entry_position(F.array_min(entries))


def rerank(entries: Column) -> Column:
    """Replace each order by its dense rank (0-based) among the orders present.

    Ranks follow text order of the order tokens, as the sorted window does.
    """
    orders = F.array_sort(F.array_distinct(F.transform(entries, lambda e: F.split(e, "_").getItem(0))))
    return F.transform(
        F.array_sort(entries),
        lambda e: F.concat_ws(
            "_",
            (F.array_position(orders, F.split(e, "_").getItem(0)) - 1).cast("string"),
            F.split(e, "_").getItem(1),
        ),
    )
