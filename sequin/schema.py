"""Schemas of the canonical tables (see README: data model)."""

from pyspark.sql import types as T

# Text formats: `;`-separated, positional, no header, no quoting.
DATASET_TEXT = T.StructType(
    [
        T.StructField("T_name", T.StringType()),
        T.StructField("class_d", T.StringType()),
    ]
)

OCCURRENCE_TEXT = T.StructType(
    [
        T.StructField("S_name", T.StringType()),
        T.StructField("S_origin", T.StringType()),
        T.StructField("S_dimension", T.StringType()),
        T.StructField("S_class", T.StringType()),
        T.StructField("T_name", T.StringType()),
        T.StructField("T_indice", T.StringType()),
        T.StructField("gain", T.StringType()),
        T.StructField("sub_sequence", T.StringType()),
        T.StructField("distance", T.StringType()),
    ]
)

# Types of the list fields; an empty `T_indice` means not present.
INDICES = "array<bigint>"
VALUES = "array<double>"
DISTANCES = "map<string,double>"
