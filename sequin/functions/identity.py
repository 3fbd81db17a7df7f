"""Keys of shapelets, sequences and sets as text that never mixes two of them up.

A shapelet of a class is identified by (name, dimension). Inside the plans it is
one text, name and dimension with a unit separator between; lists are joined by
a record separator. Control characters inside names are escaped, so any name may
hold ``+ > | _`` or the separators. Keys sort by name, then dimension. Queries
render them as plain text in their last projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ESCAPE, LIST, ITEM = "\x1d", "\x1e", "\x1f"
_CODES = ((ESCAPE, ESCAPE + "A"), (LIST, ESCAPE + "B"), (ITEM, ESCAPE + "C"))


def protect(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for raw, code in _CODES:
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def unprotect(text: Column) -> Column:
    for raw, code in reversed(_CODES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def shapelet_key(name: Column, dimension: Column) -> Column:
    return F.concat(protect(name), F.lit(ITEM), protect(dimension))


def key_name(key: Column) -> Column:
    return unprotect(F.substring_index(key, ITEM, 1))


def key_dimension(key: Column) -> Column:
    return unprotect(F.substring_index(key, ITEM, -1))


def render_names(keys: Column, sep: str) -> Column:
    """A joined list of keys as names joined by ``sep``."""
    return F.array_join(F.transform(F.split(keys, LIST), key_name), sep)


def sequence_id(series: Column, keys: Column) -> Column:
    return F.concat(protect(series), F.lit(LIST), keys)


def render_sequence_id(sid: Column) -> Column:
    """``series|name>name``."""
    parts = F.split(sid, LIST, 2)
    return F.concat(unprotect(F.get(parts, 0)), F.lit("|"), render_names(F.get(parts, 1), ">"))


def items(keys: Column) -> Column:
    """A joined list of keys as array<struct<S_dimension, S_name>>."""
    one = lambda k: F.struct(key_dimension(k).alias("S_dimension"), key_name(k).alias("S_name"))
    return F.transform(F.split(keys, LIST), one)
