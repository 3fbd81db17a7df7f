"""Column expressions over occurrence position lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DISTANCES, INDICES, VALUES


def parse_indices(text: Column | str) -> Column:
    """`"[0, 5]"` -> [0, 5]; `"[]"` -> [] (the shapelet is absent from the series)."""
    return F.from_json(text, INDICES)


def _raw(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def _checked(raw: Column, parsed: Column, unreadable: Column, what: str, kind: str) -> Column:
    return F.when(unreadable, F.raise_error(complaint(raw, what)).cast(kind)).otherwise(parsed)


def complaint(raw: Column, what: str) -> Column:
    return F.concat(F.lit(f"unreadable {what}: "), F.coalesce(raw, F.lit("(none)")))


def unreadable_indices(text: Column | str) -> Column:
    """Whether a position list is no list of whole numbers."""
    ix = parse_indices(_raw(text))
    return _raw(text).isNull() | ix.isNull() | F.exists(ix, lambda p: p.isNull())


def unreadable_number(text: Column | str) -> Column:
    return _raw(text).try_cast("double").isNull()


def unreadable_values(text: Column | str) -> Column:
    values = parse_values(_raw(text))
    return _raw(text).isNull() | values.isNull() | F.exists(values, lambda v: v.isNull())


def unreadable_distances(text: Column | str) -> Column:
    found = parse_distances(_raw(text))
    return _raw(text).isNull() | found.isNull() | F.exists(F.map_values(found), lambda v: v.isNull())


def checked_indices(text: Column | str) -> Column:
    """As `parse_indices`; a list that is no list of whole numbers is an error that shows it."""
    return _checked(_raw(text), parse_indices(_raw(text)), unreadable_indices(text), "position list", INDICES)


def checked_number(text: Column | str, what: str) -> Column:
    """A DOUBLE; a text that is no number is an error that shows it."""
    return _checked(_raw(text), _raw(text).try_cast("double"), unreadable_number(text), what, "double")


def checked_values(text: Column | str) -> Column:
    return _checked(_raw(text), parse_values(_raw(text)), unreadable_values(text), "value list", VALUES)


def checked_distances(text: Column | str) -> Column:
    return _checked(_raw(text), parse_distances(_raw(text)), unreadable_distances(text), "distances", DISTANCES)


def parse_values(text: Column | str) -> Column:
    return F.from_json(text, VALUES)


def parse_distances(text: Column | str) -> Column:
    """Python-style map literal with single-quoted keys -> map<string,double>."""
    return F.from_json(text, DISTANCES, {"allowSingleQuotes": "true"})


def render_indices(ix: Column | str) -> Column:
    """[0, 5] -> `"[0, 5]"`, the text form of the input files."""
    return F.concat(F.lit("["), F.array_join(ix, ", "), F.lit("]"))


def first_index(ix: Column | str) -> Column:
    """First listed position (the shapelet's order in its source series); NULL when absent."""
    return F.get(F.col(ix) if isinstance(ix, str) else ix, 0)


def first_token(text: Column | str) -> Column:
    """Literal order key of the reference: the text before the first comma, e.g. `"[10"`."""
    return F.split(text, ",").getItem(0)


def join_ints(arr: Column | str, sep: str = ",") -> Column:
    """Array of ints -> `"1,4,5"` ('' for an empty array): the form the oracle compares."""
    return F.coalesce(F.array_join(arr, sep), F.lit(""))


def min_as_text(ix: Column | str) -> Column:
    """Smallest position when positions are compared as text (`"10"` < `"2"`)."""
    return F.array_min(F.transform(ix, lambda p: p.cast("string")))
