"""Plans and shuffles that have to hold on larger tables."""

import os

import pytest

from sequin.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def physical(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_occurrences_broadcast_neither_pairs_nor_positions(spark):
    # the pairs of all series and shapelets look as small as the catalogue that they are made of
    plan = physical(QUERIES["occurring_only"](spark, SF))
    assert "BroadcastHashJoin [T_name" not in plan and "SortMergeJoin [T_name" in plan


def test_a_dealt_join_has_the_rows_of_the_join_and_cuts_hot_keys(spark):
    from pyspark.sql import functions as F

    from sequin.operators.joins import join_dealt

    large = spark.range(300).select(F.when(F.col("id") < 200, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), F.col("id").alias("a"))
    small = spark.range(60).select(F.when(F.col("id") < 20, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 9)).alias("k"), F.col("id").alias("b"))
    dealt = join_dealt(large, small, ["k"], ["a"], rows=100)
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, large.join(small, "k").collect()))
    tasks = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 20 and max(r["count"] for r in tasks) < 1000  # the hot key alone makes 4000


def two_classes(spark):
    """A series catalogued under two classes, two shapelets that share an order."""
    from pyspark.sql import functions as F

    from sequin.plans.queries import Mining

    occ = [("s1", "d1", [3, 10, 2]), ("s2", "d2", [2, 30]), ("s3", "d3", [11])]
    oc = spark.createDataFrame(occ, "S_name string, S_dimension string, ix array<bigint>")
    oc = oc.withColumns({"S_class": F.lit("c"), "T_name": F.lit("t"), "T_indice": F.lit("[0]"), "ix": F.sort_array("ix")})
    return Mining.from_tables(spark.createDataFrame([("t", "c"), ("t", "e")], "T_name string, class_d string"), oc)


def test_windows_list_an_entry_once_and_in_text_order(spark):
    from sequin.operators import evaluate

    m = two_classes(spark)
    windows = {r.ords: r.window for r in evaluate.sequence_profile(m.seqs, m.hits, m.blocks).collect()}
    assert windows["2,2,11"] == ["11_11", "2_10", "2_2", "2_2", "2_3", "2_30"]
    ranked = {r.ords: r.window for r in evaluate.reranked_windows(m.seqs, m.hits, m.tmap, m.blocks).collect()}
    assert ranked["2,2,11"] == ["0_11", "1_10", "1_2", "2_2", "1_3", "2_30"]
    firsts = {r.ords: r.first_entry for r in evaluate.first_entries(m.seqs, m.hits, m.tmap).collect()}
    assert firsts["2,2,11"] == "11_11" and firsts["2,2"] == "2_10"
    m.close()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["sequence_profile", "rerank_window", "tas_first_index", "verdict_profile", "sequence_profile_vetoed"])
def test_no_row_of_a_window_is_shuffled(spark, name):
    # what lies above the join of variants and series neither groups nor exchanges its rows
    plan = physical(QUERIES[name](spark, SF)).splitlines()
    top = [x for x in plan[: next(i for i, x in enumerate(plan) if "Join [S_class" in x)]]
    assert not any("Exchange" in x or "Aggregate" in x for x in top)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["presence_matrix", "sequence_hits", "sequence_profile_vetoed"])
def test_rows_of_series_are_dealt_by_the_rows_made(spark, name):
    # tasks as many as asked for, not as few as the bytes read would need
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["tas_combine", "verdict_ordered", "ordered_match", "accurate_ordered"])
def test_no_state_of_the_ordered_search_is_shuffled(spark, name):
    # the series' lists meet the sequences that are handed to every task; what is exchanged is counts
    from sequin import session

    before = session.pinned_count()
    plan = physical(QUERIES[name](spark, SF))
    assert plan.count("Generate inline") >= 5
    assert not any("ordered-states" in p or "ordered-blocks" in p for p, _ in session._paths[before:])


@pytest.mark.parametrize("gathered", [0, 4, 10])
@pytest.mark.parametrize("seed", [2, 11])
def test_long_series_beside_short_ones(spark, monkeypatch, seed, gathered):
    # series with more positions than a row may gather are looked up by block, the others are not
    from sequin.operators import evaluate
    from tests.test_semantics import check, random_case

    dataset, occ = random_case(seed)
    monkeypatch.setattr(evaluate, "GATHERED", gathered)
    check(spark, dataset, occ)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["verdict_presence", "verdict_full", "accurate_sequences", "preview_verdict", "sequence_accuracy", "confusion_counts"])
def test_sequences_look_up_their_verdict_and_are_not_shuffled(spark, name):
    plan = physical(QUERIES[name](spark, SF))
    above = plan.split("InMemoryTableScan")[0]  # of the sequences
    assert "BroadcastHashJoin" in above and "SortMergeJoin" not in above and "Aggregate" not in above
    # of an occurrence only what is read is kept
    assert "sub_sequence" not in plan and "distance" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_item_rows_are_dealt_and_not_grouped(spark):
    plan = physical(QUERIES["join_sequence_occurrence_rows"](spark, SF)).splitlines()
    top = plan[: next(i for i, x in enumerate(plan) if "Join [S_class" in x)]
    assert not any("Exchange" in x or "Aggregate" in x for x in top)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_windows_gather_no_lists(spark):
    plan = physical(QUERIES["sequence_profile_windows"](spark, SF))
    assert "collect_list(struct" not in plan.split("InMemoryTableScan")[0]


def made_per_row(spark, name) -> str:
    """What a query works out for each row of its result, above the join that makes the rows."""
    plan = physical(QUERIES[name](spark, SF)).splitlines()
    top = plan[: next(i for i, x in enumerate(plan) if "Join [S_class" in x)]
    return "".join(top[: max((i for i, x in enumerate(top) if "Generate inline" in x), default=len(top))])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_entries_of_a_veto_are_made_once_for_all_sets_of_a_run(spark):
    made = made_per_row(spark, "sequence_profile_vetoed")
    assert "concat_ws" in made and "lambda" not in made and "sort_array" not in made


@pytest.mark.parametrize("seed", [3, 6, 8])
def test_vetoed_windows_by_loop_and_in_short_runs(spark, monkeypatch, seed):
    from sequin.operators import factorised, joins
    from sequin.plans.queries import Mining
    from tests.test_semantics import frames, random_case

    m = Mining.from_tables(*frames(spark, *random_case(seed)))
    rows = lambda text: sorted(map(tuple, factorised.vetoed_windows(m.seqs, m.windows, m.profiles, m.keyed, text=text).collect()))
    want = rows(False)
    assert want and all(w == sorted(w) and "x" in w for *_, w in want)
    monkeypatch.setattr(joins, "COMPILED_PARTS", 1)
    monkeypatch.setattr(factorised, "SET_RUN", 2)
    assert rows(False) == want
    assert rows(True) == [(*key, ",".join(w)) for *key, w in want]
    m.close()


def mined(spark, seed):
    from sequin.plans.queries import Mining
    from tests.test_semantics import frames, random_case

    return Mining.from_tables(*frames(spark, *random_case(seed)))


def same_by_loop_and_in_short_runs(monkeypatch, rows) -> None:
    """`rows(text)` does not depend on the length of a run nor on how the parts are read."""
    from sequin.operators import evaluate, joins

    want = rows(False)
    for short in ("VARIANT_RUN", "RUN"):
        monkeypatch.setattr(evaluate, short, 2)
    assert rows(False) == want != []
    monkeypatch.setattr(joins, "COMPILED_PARTS", 1)
    assert [(*key, ",".join(w)) if isinstance(w, list) else (*key, w) for *key, w in want] == rows(True)


def of_variants(df, last):
    return sorted(map(tuple, df.select("S_class", "names", "ords", "T_name", last).collect()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_entries_of_a_prefix_are_made_once_for_all_variants_of_a_run(spark):
    made = made_per_row(spark, "sequence_profile")
    assert "concat_ws" in made and "lambda" not in made and "sort_array" not in made


def test_windows_by_loop_and_in_short_runs(spark, monkeypatch):
    from sequin.operators import evaluate

    m = mined(spark, 5)
    same_by_loop_and_in_short_runs(monkeypatch, lambda text: of_variants(evaluate.sequence_profile(m.seqs, m.hits, m.blocks, text=text), "window"))
    m.close()



@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_ranked_entries_are_made_once_for_all_variants_of_a_run(spark):
    made = made_per_row(spark, "rerank_window")
    assert "concat_ws" in made and "lambda" not in made and "sort_array" not in made


def test_ranked_windows_by_loop_and_in_short_runs(spark, monkeypatch):
    from sequin.operators import evaluate

    m = mined(spark, 5)
    same_by_loop_and_in_short_runs(monkeypatch, lambda text: of_variants(evaluate.reranked_windows(m.seqs, m.hits, m.tmap, m.blocks, text=text), "window"))
    m.close()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_first_entries_are_made_once_for_all_variants_of_a_run(spark):
    made = made_per_row(spark, "tas_first_index")
    assert "coalesce" in made and "lambda" not in made and "array_min" not in made


def test_first_entries_by_loop_and_in_short_runs(spark, monkeypatch):
    from sequin.operators import evaluate

    m = mined(spark, 5)
    windows = of_variants(evaluate.sequence_profile(m.seqs, m.hits, m.blocks), "window")
    firsts = lambda _: of_variants(evaluate.first_entries(m.seqs, m.hits, m.tmap), "first_entry")
    assert firsts(False) == [(*key, w[0]) for *key, w in windows]
    same_by_loop_and_in_short_runs(monkeypatch, firsts)
    m.close()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_a_window_is_made_once_for_all_sequences_of_a_variant(spark):
    made = made_per_row(spark, "verdict_profile")
    assert "Generate inline(sources" in made and "lambda" not in made and "sort_array" not in made


def test_windows_beside_verdicts_by_loop_and_in_short_runs(spark, monkeypatch):
    from sequin.operators import evaluate

    m = mined(spark, 5)
    windows = {tuple(key): w for *key, w in of_variants(evaluate.sequence_profile(m.seqs, m.hits, m.blocks), "window")}
    series = {}
    for key in windows:
        series.setdefault(key[:3], []).append(key[3])
    want = sorted((r.S_class, r.sid, t, windows[r.S_class, r.names, r.ords, t]) for r in m.seqs.collect() for t in series.get((r.S_class, r.names, r.ords), []))

    def rows(text):
        made = evaluate.verdict_profile(m.keyed_verdicts, m.seqs, m.hits, m.blocks, text=text)
        return sorted(map(tuple, made.select("S_class", "sid", "T_name", "window").collect()))

    assert rows(False) == want
    same_by_loop_and_in_short_runs(monkeypatch, rows)
    m.close()
