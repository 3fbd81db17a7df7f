"""Column-level building blocks; every one is a native Spark expression."""

from .chain import ordered_chain
from .indices import (
    checked_distances,
    checked_indices,
    checked_number,
    checked_values,
    complaint,
    first_index,
    first_token,
    join_ints,
    min_as_text,
    parse_distances,
    parse_indices,
    parse_values,
    render_indices,
    unreadable_distances,
    unreadable_indices,
    unreadable_number,
    unreadable_values,
)
from .window import entry_position, first_of_window, prefix_indices, prefixed, rerank, window_entry

__all__ = [
    "checked_distances",
    "checked_indices",
    "checked_number",
    "checked_values",
    "complaint",
    "entry_position",
    "first_index",
    "first_of_window",
    "first_token",
    "join_ints",
    "min_as_text",
    "ordered_chain",
    "parse_distances",
    "parse_indices",
    "parse_values",
    "prefix_indices",
    "prefixed",
    "render_indices",
    "rerank",
    "unreadable_distances",
    "unreadable_indices",
    "unreadable_number",
    "unreadable_values",
    "window_entry",
]
