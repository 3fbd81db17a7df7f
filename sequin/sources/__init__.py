"""Sources and sinks: the text formats, the events-derived fixture, table sink."""

from .fixture import fixture, occurrences, read_table, series_catalogue
from .sink import write_table
from .text import (
    accepted,
    read_dataset,
    read_occurrences,
    read_wrapped_occurrences,
    rejected,
    type_occurrences,
    write_dataset_text,
    write_occurrences_text,
    write_wrapped_occurrences,
)

__all__ = [
    "accepted",
    "fixture",
    "occurrences",
    "read_dataset",
    "read_occurrences",
    "read_table",
    "read_wrapped_occurrences",
    "rejected",
    "series_catalogue",
    "type_occurrences",
    "write_dataset_text",
    "write_occurrences_text",
    "write_table",
    "write_wrapped_occurrences",
]
