"""Unit cases for the column functions (worked examples of FIXTURES.md §4)."""

from pyspark.sql import functions as F

from sequin.functions import (
    entry_position,
    first_index,
    first_of_window,
    ordered_chain,
    parse_distances,
    parse_indices,
    prefix_indices,
    render_indices,
    rerank,
)


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def test_first_index(spark):
    assert one(spark, first_index(parse_indices(F.lit("[7, 12]")))) == 7
    assert one(spark, first_index(parse_indices(F.lit("[]")))) is None


def test_parse_and_render(spark):
    assert one(spark, parse_indices(F.lit("[0, 5]"))) == [0, 5]
    assert one(spark, parse_indices(F.lit("[]"))) == []
    assert one(spark, render_indices(parse_indices(F.lit("[0, 5]")))) == "[0, 5]"
    assert one(spark, render_indices(parse_indices(F.lit("[]")))) == "[]"
    assert one(spark, parse_distances(F.lit("{'one.csv': 0.0, 'x.csv': 1.5}"))) == {"one.csv": 0.0, "x.csv": 1.5}


def test_sort_window(spark):
    arr = F.array(*[F.lit(x) for x in ["52_4", "51_1", "53_3", "53_5"]])
    assert one(spark, F.array_sort(arr)) == ["51_1", "52_4", "53_3", "53_5"]


def test_rerank(spark):
    arr = F.array(*[F.lit(x) for x in ["51_1", "52_4", "53_3", "53_5"]])
    assert one(spark, rerank(arr)) == ["0_1", "1_4", "2_3", "2_5"]


def test_filter_by_order_and_strip(spark):
    arr = F.array(*[F.lit(x) for x in ["0_1", "1_4", "2_3", "2_5"]])
    picked = F.filter(arr, lambda e: F.split(e, "_").getItem(0) == "2")
    assert one(spark, picked) == ["2_3", "2_5"]
    assert one(spark, F.transform(picked, entry_position)) == [3, 5]


def test_prefix(spark):
    assert one(spark, prefix_indices(F.lit(5), F.array(F.lit(1), F.lit(2)))) == ["5_1", "5_2"]


def test_first_of_window_is_text_order(spark):
    # "1_10" < "1_9" as text: the literal behaviour keeps 10
    arr = F.array(F.lit("1_9"), F.lit("1_10"))
    assert one(spark, first_of_window(arr)) == 10
    # order 12 sorts before order 1 ("12_" < "1_" because '2' < '_')
    arr = F.array(F.lit("1_0"), F.lit("12_3"))
    assert one(spark, first_of_window(arr)) == 3


def _steps(*lists):
    return F.array(
        *[
            F.struct(F.lit(i).alias("step"), F.array(*[F.lit(p) for p in ps]).cast("array<bigint>").alias("pos"))
            for i, ps in enumerate(lists)
        ]
    )


def test_chain_found(spark):
    # TAS [1, 4], next [3, 5] -> found, [1, 4, 5]
    r = one(spark, ordered_chain(_steps([1], [4], [3, 5])))
    assert r["ok"] and r["tas"] == [1, 4, 5]


def test_chain_equal_positions_allowed(spark):
    r = one(spark, ordered_chain(_steps([2], [2, 9])))
    assert r["ok"] and r["tas"] == [2, 2]


def test_chain_not_found(spark):
    r = one(spark, ordered_chain(_steps([6], [1, 5])))
    assert not r["ok"]


def test_chain_numeric_order_beyond_nine(spark):
    r = one(spark, ordered_chain(_steps([9], [10, 2])))
    assert r["ok"] and r["tas"] == [9, 10]
