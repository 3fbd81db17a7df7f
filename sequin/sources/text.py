"""The `;`-separated text formats of the series catalogue and the
shapelet occurrences (positional, no header, no quoting)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import (
    checked_distances,
    checked_indices,
    checked_number,
    checked_values,
    complaint,
    parse_distances,
    parse_indices,
    parse_values,
    render_indices,
    unreadable_distances,
    unreadable_indices,
    unreadable_number,
    unreadable_values,
)

# The committed job output wraps each line as `(e,(<nine fields>,None))`.
WRAPPED_LINE = r"^\(.,\((.*),None\)\)$"

# What a reader does with a line that it cannot read.
FAIL, REPORT = "fail", "report"
REPORT_COLUMNS = ["file", "line", "reject"]


def _parts(text_schema, body: F.Column) -> tuple[F.Column, F.Column]:
    """The `;`-separated fields of a line, and whether they are too few."""
    parts = F.split(body, ";", -1)
    return parts, F.coalesce(F.size(parts) < len(text_schema.fields), F.lit(True))


def _few(text_schema, line: F.Column) -> F.Column:
    return F.concat(F.lit(f"fewer than {len(text_schema.fields)} fields in line: "), line)


def _named(text_schema, parts: F.Column) -> list[F.Column]:
    return [F.get(parts, i).alias(f.name) for i, f in enumerate(text_schema.fields)]


def _lines(spark: SparkSession, path: str, bad: str) -> DataFrame:
    if bad not in (FAIL, REPORT):
        raise ValueError(f"bad lines either {FAIL} or {REPORT}, not {bad!r}")
    lines = spark.read.text(path)
    lines = lines.select(F.col("value").alias("line"), *([F.col("_metadata.file_path").alias("file")] if bad == REPORT else []))
    return lines.filter(F.length("line") > 0)


def _read(lines: DataFrame, text_schema, body: F.Column, unwrapped: F.Column, bad: str) -> DataFrame:
    """Text columns of the lines; `reject` names what is wrong with a line as a whole."""
    parts, few = _parts(text_schema, body)
    form = F.concat(F.lit("no wrapped record in line: "), F.col("line"))
    wrong = F.when(unwrapped, form).when(few, _few(text_schema, F.col("line")))
    if bad == REPORT:
        return lines.select("file", "line", wrong.alias("reject"), *_named(text_schema, F.when(~unwrapped, parts)))
    whole = F.when(unwrapped | few, F.raise_error(wrong).cast("array<string>")).otherwise(parts)
    return lines.select(*_named(text_schema, whole))


def read_dataset(spark: SparkSession, path: str, bad: str = FAIL) -> DataFrame:
    """`T_name;class` lines -> (T_name, class_d). `bad`: see `read_occurrences`."""
    return _read(_lines(spark, path, bad), schema.DATASET_TEXT, F.col("line"), F.lit(False), bad)


def type_occurrences(raw: DataFrame) -> DataFrame:
    """Nine text columns -> typed occurrence table (adds `ix`). A field that cannot be
    read is an error that shows it; fields that a query does not use are not parsed."""
    return raw.select(
        "S_name",
        "S_origin",
        "S_dimension",
        "S_class",
        "T_name",
        "T_indice",
        checked_indices("T_indice").alias("ix"),
        checked_number("gain", "gain").alias("gain"),
        checked_values("sub_sequence").alias("sub_sequence"),
        checked_distances("distance").alias("distance"),
    )


def _reported(raw: DataFrame) -> DataFrame:
    """As `type_occurrences`, NULL for what cannot be read; `reject` names the first such field."""
    wrong = [
        (unreadable_indices("T_indice"), complaint(F.col("T_indice"), "position list")),
        (unreadable_number("gain"), complaint(F.col("gain"), "gain")),
        (unreadable_values("sub_sequence"), complaint(F.col("sub_sequence"), "value list")),
        (unreadable_distances("distance"), complaint(F.col("distance"), "distances")),
    ]
    return raw.select(
        "S_name",
        "S_origin",
        "S_dimension",
        "S_class",
        "T_name",
        "T_indice",
        F.when(~unreadable_indices("T_indice"), parse_indices("T_indice")).alias("ix"),
        F.col("gain").try_cast("double").alias("gain"),
        F.when(~unreadable_values("sub_sequence"), parse_values("sub_sequence")).alias("sub_sequence"),
        F.when(~unreadable_distances("distance"), parse_distances("distance")).alias("distance"),
        "file",
        "line",
        F.coalesce("reject", *[F.when(found, text) for found, text in wrong]).alias("reject"),
    )


def read_occurrences(spark: SparkSession, path: str, bad: str = FAIL) -> DataFrame:
    """Nine `;`-separated fields per line -> typed occurrence table.

    `bad="fail"`: a line or a used field that cannot be read ends the query with an error
    that shows it. `bad="report"`: every line gives a row, with its `file`, the `line` and
    `reject` (NULL where all of it was read); see `accepted` and `rejected`. Files are read
    in Spark's splits."""
    raw = _read(_lines(spark, path, bad), schema.OCCURRENCE_TEXT, F.col("line"), F.lit(False), bad)
    return _reported(raw) if bad == REPORT else type_occurrences(raw)


def read_wrapped_occurrences(spark: SparkSession, path: str, bad: str = FAIL) -> DataFrame:
    """The committed sample format: strip `(e,(` ... `,None))`, then as S2."""
    body = F.regexp_extract("line", WRAPPED_LINE, 1)
    raw = _read(_lines(spark, path, bad), schema.OCCURRENCE_TEXT, body, ~F.col("line").rlike(WRAPPED_LINE), bad)
    return _reported(raw) if bad == REPORT else type_occurrences(raw)


def accepted(read: DataFrame) -> DataFrame:
    """The rows of a reported reading that were read whole, without the report's columns."""
    return read.filter(F.col("reject").isNull()).drop(*REPORT_COLUMNS)


def rejected(read: DataFrame) -> DataFrame:
    """(file, line, reject) of the lines of a reported reading that were not."""
    return read.filter(F.col("reject").isNotNull()).select(*REPORT_COLUMNS)


def write_dataset_text(dataset: DataFrame, path: str, mode: str = "overwrite") -> None:
    dataset.select(F.concat_ws(";", "T_name", "class_d").alias("value")).write.mode(mode).text(path)


def occurrence_lines(occ: DataFrame, *more: F.Column) -> DataFrame:
    """Typed occurrences -> one text line each, in the input format (and other columns)."""
    sub = F.concat(
        F.lit("["),
        F.array_join(F.transform("sub_sequence", lambda v: v.cast("string")), ", "),
        F.lit("]"),
    )
    dist = F.concat(
        F.lit("{"),
        F.array_join(
            F.transform(
                F.map_entries("distance"),
                lambda e: F.concat(F.lit("'"), e["key"], F.lit("': "), e["value"].cast("string")),
            ),
            ", ",
        ),
        F.lit("}"),
    )
    return occ.select(
        F.concat_ws(
            ";",
            "S_name",
            "S_origin",
            "S_dimension",
            "S_class",
            "T_name",
            render_indices("ix"),
            F.col("gain").cast("string"),
            sub,
            dist,
        ).alias("value"),
        *more,
    )


def write_occurrences_text(occ: DataFrame, path: str, mode: str = "overwrite") -> None:
    occurrence_lines(occ).write.mode(mode).text(path)


def write_wrapped_occurrences(occ: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One wrapped record per line, as the committed output has them; the key before the
    record is the line's fifth character."""
    wrapped = F.concat(F.lit("("), F.substring("value", 5, 1), F.lit(",("), F.col("value"), F.lit(",None))"))
    occurrence_lines(occ).select(wrapped.alias("value")).write.mode(mode).text(path)
