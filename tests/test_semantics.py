"""Verdicts against the plain-Python model on hand-made and random inputs."""

import itertools
import random

import pytest
from pyspark.sql import types as T

from sequin.operators import evaluate, sequences
from sequin.plans.queries import Mining, plain
from tests import model

OCC_SCHEMA = T.StructType(
    [
        T.StructField("S_name", T.StringType()),
        T.StructField("S_dimension", T.StringType()),
        T.StructField("S_class", T.StringType()),
        T.StructField("T_name", T.StringType()),
        T.StructField("T_indice", T.StringType()),
        T.StructField("ix", T.ArrayType(T.LongType())),
    ]
)


def frames(spark, dataset, occ):
    ds = spark.createDataFrame(sorted(dataset.items()), "T_name string, class_d string")
    rows = [(r["S_name"], r["S_dimension"], r["S_class"], r["T_name"], model.render(r["ix"]), r["ix"]) for r in occ]
    return ds, spark.createDataFrame(rows, OCC_SCHEMA)


def spark_verdicts(spark, dataset, occ, salts=None):
    ds, oc = frames(spark, dataset, occ)
    m = Mining.from_tables(ds, oc, salts)
    pres = {}
    for r in m.verdict_presence().collect():
        things = tuple((i.S_dimension, i.S_name) for i in r["items"])
        series = r.sid[: len(r.sid) - len("|" + ">".join(n for _, n in things))]
        assert r.sid == series + "|" + ">".join(n for _, n in things)
        assert (r.S_class, series, things) not in pres
        pres[r.S_class, series, things] = (r.tp, r.fn, r.fp, r.tn, r.accuracy, list(r.tas))
    ordd = {}
    for r in m.verdict_ordered().collect():
        things = tuple((i.S_dimension, i.S_name) for i in r["items"])
        assert r.names == ">".join(n for _, n in things) and (r.S_class, things) not in ordd
        ordd[r.S_class, things] = (r.tp, r.fn, r.fp, r.tn, r.accuracy, list(r.tas))
    m.close()
    return pres, ordd


def row(name, dim, cls, t, ix):
    return {"S_name": name, "S_dimension": dim, "S_class": cls, "T_name": t, "ix": ix}


# t6 is catalogued but has no shapelet row at all
EDGE_DATASET = {"t1": "c_a", "t2": "c_a", "t3": "c_b", "t4": "c_b", "t5": "c_a", "t6": "c_b"}
EDGE_OCC = [
    # s1 occurs twice in t1 (duplicate rows), and in t2 next to an empty row
    row("s1", "d1", "c_a", "t1", [3]),
    row("s1", "d1", "c_a", "t1", [1, 12]),
    row("s1", "d1", "c_a", "t2", [4]),
    row("s1", "d1", "c_a", "t2", []),
    row("s1", "d1", "c_a", "t3", [0]),
    # s2 in the same dimension as s1: only one of them is kept per series
    row("s2", "d1", "c_a", "t1", [1]),
    row("s2", "d1", "c_a", "t4", [2]),
    # s3: positions >= 10 (text vs number order); no row at all for t3
    row("s3", "d2", "c_a", "t1", [10, 11]),
    row("s3", "d2", "c_a", "t2", [9]),
    row("s3", "d2", "c_a", "t4", []),
    row("s3", "d2", "c_a", "t5", [2]),
    # s4 shares its first position with s1 in t1 (tied lead)
    row("s4", "d3", "c_a", "t1", [1, 30]),
    row("s4", "d3", "c_a", "t2", [0]),
    row("s4", "d3", "c_a", "t5", [5]),
    # a shapelet row whose series is not catalogued: a source, never a target
    row("s4", "d3", "c_a", "t9", [7]),
    row("s1", "d1", "c_a", "t9", [2]),
    # the other class, class name with '_'
    row("b1", "d1", "c_b", "t3", [5]),
    row("b1", "d1", "c_b", "t4", [6, 8]),
    row("b2", "d2", "c_b", "t3", [2]),
    row("b2", "d2", "c_b", "t4", [1]),
    row("b2", "d2", "c_b", "t1", []),
]


def check(spark, dataset, occ, **kw):
    pres, ordd = spark_verdicts(spark, dataset, occ, **kw)
    want_p = model.verdict_presence(dataset, occ)
    want_o = model.verdict_ordered(dataset, occ)
    assert pres == want_p
    assert ordd == want_o
    return pres, ordd


def test_edge_cases(spark):
    pres, ordd = check(spark, EDGE_DATASET, EDGE_OCC)
    n = len(EDGE_DATASET)
    for v in list(pres.values()) + list(ordd.values()):
        assert sum(v[:4]) == n
    # an ordered match is also a presence match of the same name set
    for (cls, things), v in ordd.items():
        assert v[0] + v[2] <= max(p[0] + p[2] for (c, _, own), p in pres.items() if (c, own) == (cls, things))


def test_salted_join_path(spark):
    check(spark, EDGE_DATASET, EDGE_OCC, salts=3)


def test_row_order_does_not_matter(spark):
    shuffled = EDGE_OCC[:]
    random.Random(7).shuffle(shuffled)
    assert spark_verdicts(spark, EDGE_DATASET, shuffled) == spark_verdicts(spark, EDGE_DATASET, EDGE_OCC)


def random_case(seed):
    rnd = random.Random(seed)
    classes = ["a", "b_x"]
    series = [f"T{i}" for i in range(rnd.randint(3, 6))]
    dataset = {t: rnd.choice(classes) for t in series if rnd.random() < 0.9}
    dims = [f"d{i}" for i in range(rnd.randint(1, 4))]
    occ = []
    for k in range(rnd.randint(3, 8)):
        name, dim, cls = f"s{k}", rnd.choice(dims), rnd.choice(classes)
        for t in series:
            r = rnd.random()
            if r < 0.15:
                continue  # no row (R8)
            reps = 2 if rnd.random() < 0.15 else 1  # duplicate rows
            for _ in range(reps):
                ix = [] if rnd.random() < 0.3 else sorted(rnd.sample(range(15), rnd.randint(1, 3)))
                occ.append(row(name, dim, cls, t, ix))
    return dataset, occ


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_against_model(spark, seed):
    dataset, occ = random_case(seed)
    check(spark, dataset, occ)


def test_subset_count(spark):
    ds, oc = frames(spark, EDGE_DATASET, EDGE_OCC)
    m = Mining.from_tables(ds, oc)
    per_source = {
        (r.S_class, r.T_name): r.n for r in m.seqs.groupBy("S_class", "T_name").count().withColumnRenamed("count", "n").collect()
    }
    picks = {(r.S_class, r.T_name): r.d for r in m.picks.groupBy("S_class", "T_name").count().withColumnRenamed("count", "d").collect()}
    assert per_source == {k: 2**d - 1 for k, d in picks.items()}


def test_mask_levels(spark):
    occ = [row(f"s{k}", f"d{k}", "c", "t1", [k]) for k in range(6)]
    ds, oc = frames(spark, {"t1": "c"}, occ)
    m = Mining.from_tables(ds, oc)
    want = {(r["mask"], r.names) for r in sequences.enumerate_sequences(m.picks).collect()}
    assert len(want) == 63
    assert {(r["mask"], r.names) for r in sequences.enumerate_sequences(m.picks, low_bits=2).collect()} == want


def test_many_dimensions(spark):
    # no limit on dimensions: 25 of them, subsets of at most two
    occ = [row(f"s{k}", f"d{k}", "c", "t1", [k]) for k in range(25)]
    ds, oc = frames(spark, {"t1": "c"}, occ)
    m = Mining.from_tables(ds, oc)
    assert sequences.enumerate_sequences(m.picks, max_len=2).count() == 25 + 300


@pytest.mark.parametrize("d,max_len,rows", [(50, 2, 1275), (62, 2, 1953), (62, 1, 62), (3, 9, 7), (3, 0, 0), (20, 19, 2**20 - 2)])
def test_short_subsets_of_wide_series(spark, d, max_len, rows):
    occ = [row(f"s{k:02}", f"d{k}", "c", "t1", [k]) for k in range(d)]
    ds, oc = frames(spark, {"t1": "c"}, occ)
    m = Mining.from_tables(ds, oc)
    got = sequences.enumerate_sequences(m.picks, max_len=max_len, low_bits=16 if rows > 9999 else 3).select("mask", "names")
    if rows > 9999:
        assert got.distinct().count() == rows
        return
    got = plain(got).collect()
    want = {sum(1 << k for k in c) for n in range(1, min(d, max_len) + 1) for c in itertools.combinations(range(d), n)}
    assert len(got) == rows and {r["mask"] for r in got} == want
    assert all(r.names == ">".join(f"s{k:02}" for k in range(d) if r["mask"] >> k & 1) for r in got)


def test_a_series_of_too_many_dimensions_is_an_error(spark):
    occ = [row(f"s{k}", f"d{k}", "c", "t1", [k]) for k in range(63)]
    ds, oc = frames(spark, {"t1": "c"}, occ)
    with pytest.raises(Exception, match="more than 62 dimensions in series t1"):
        sequences.enumerate_sequences(Mining.from_tables(ds, oc).picks, max_len=2).collect()


def test_no_row_holds_more_than_a_run(spark):
    from pyspark.sql import functions as F

    wide = spark.createDataFrame([(0, 1 << 22)], "lo bigint, hi bigint")
    runs = sequences._runs(wide, 8)
    got = runs.agg(F.count("*"), F.max(F.expr("hi - lo")), F.sum(F.expr("hi - lo")), F.min("lo"), F.max("hi")).first()
    assert tuple(got) == (1 << 14, 256, 1 << 22, 0, 1 << 22)
    assert {len(r.s) for r in wide.select(F.expr("sequence(lo, hi - 1, shiftleft(1L, 14))").alias("s")).collect()} == {256}


SHARED_NAMES = [
    row("s1", "d1", "c", "t1", [0]),
    row("s1", "d2", "c", "t1", [2]),
    row("s2", "d3", "c", "t1", [5]),
    row("s1", "d1", "c", "t2", [1]),
    row("s1", "d2", "c", "t2", [2]),
    row("s2", "d3", "c", "t2", [8]),
]


def test_a_name_on_two_dimensions(spark):
    pres, ordd = check(spark, {"t1": "c", "t2": "c"}, SHARED_NAMES)
    d1, d2, d3 = ("d1", "s1"), ("d2", "s1"), ("d3", "s2")
    assert ordd["c", (d1,)][0] == 2 and ordd["c", (d1, d2)] == (2, 0, 0, 0, 1.0, [1, 2])
    assert ordd["c", (d1, d2, d3)] == (2, 0, 0, 0, 1.0, [1, 2, 8])


def test_a_lead_that_is_absent_beside_a_shared_name(spark):
    occ = [row("s0", "d0", "c", "t1", [0]), row("s1", "d1", "c", "t1", [1]), row("s1", "d1", "c", "t2", [2]), row("s1", "d2", "c", "t2", [3])]
    pres, _ = check(spark, {"t1": "c", "t2": "c"}, occ)
    assert pres["c", "t1", (("d0", "s0"), ("d1", "s1"))][5] == [2]


def test_separators_inside_names(spark):
    occ = [row("a+b", "d0", "c", "t1", [0]), row("a", "d1", "c", "t2", [0]), row("b", "d2", "c", "t2", [1]), row("x>y|z_", "d3", "c", "t1", [4]), row("x\x1ey\x1f\x1d", "d4", "c", "t2", [4])]
    pres, _ = check(spark, {"t1": "c", "t2": "c"}, occ)
    assert pres["c", "t1", (("d0", "a+b"),)][:2] == (1, 1)


@pytest.mark.parametrize("seed", [4, 5])
def test_random_shared_names(spark, seed):
    rnd = random.Random(seed)
    dataset, occ = random_case(seed)
    names = ["s", "s+s", "s>s", "s|_"]
    kinds = {r["S_name"]: rnd.choice(names) for r in occ}
    # one shapelet per (class, dimension, name); a name may come back on other dimensions
    check(spark, dataset, [dict(r, S_name=kinds[r["S_name"]]) for r in occ])


def test_large_positions(spark):
    far = 3_000_000_000
    occ = [row("s1", "d1", "c", "t1", [1]), row("s2", "d2", "c", "t1", [far])]
    _, ordd = check(spark, {"t1": "c"}, occ)
    assert ordd["c", (("d1", "s1"), ("d2", "s2"))][5] == [1, far]


def test_presence_matrix_flags(spark):
    ds, oc = frames(spark, EDGE_DATASET, EDGE_OCC)
    m = Mining.from_tables(ds, oc)
    rows = {(r.set_key, r.T_name): (r.found, r.complete) for r in plain(m.matrix.filter("S_class = 'c_a'")).collect()}
    assert rows[("s1", "t2")] == (False, False)  # R9: an empty row vetoes
    assert rows[("s1", "t1")] == (True, True)
    assert rows[("s1+s3", "t3")] == (True, False)  # R8: s3 has no row in t3


def test_chain_across_small_blocks(spark):
    # blocks of 4 positions: lookups must fall through empty blocks via `after`
    from sequin.functions.identity import items
    from sequin.operators import encode

    dataset, occ = random_case(11)
    occ = [dict(r, ix=[p * 3 for p in r["ix"]]) for r in occ]  # spread positions over many blocks
    ds, oc = frames(spark, dataset, occ)
    m = Mining.from_tables(ds, oc)
    blocks = encode.position_blocks(m.keyed, m.dataset, block=4)
    got = evaluate.ordered_match(m.seqs, m.tmap, blocks, block=4)
    got = got.withColumn("items", items(got["names"]))
    got = {(r.S_class, tuple((i.S_dimension, i.S_name) for i in r["items"]), r.T_name): list(r.tas) for r in got.collect()}
    want = model.verdict_ordered(dataset, occ)
    assert {(c, n) for c, n, _ in got} <= set(want)
    for (c, n), v in want.items():
        own = [t for (c2, n2, t) in got if (c2, n2) == (c, n) and dataset[t] == c]
        other = [t for (c2, n2, t) in got if (c2, n2) == (c, n) and dataset[t] != c]
        assert (len(own), len(other)) == (v[0], v[2])
        chains = [got[c, n, t] for t in own]
        assert [max(p) for p in zip(*chains)] == v[5]


def test_rank_within_hot_key(spark):
    # one key holds most rows: the distributed rank equals row_number()
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from sequin.sources.fixture import rank_within

    df = spark.range(0, 5000).select(
        F.when(F.col("id") % 10 < 8, F.lit(1)).otherwise(F.col("id") % 7).alias("k"),
        (F.col("id") * 7919 % 5000).alias("t"),
        F.col("id").alias("e"),
    )
    got = rank_within(df, "k", ["t", "e"], chunks=16)
    want = df.withColumn("_rank", F.row_number().over(Window.partitionBy("k").orderBy("t", "e")))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_occurrences_cover_all_events(spark):
    from pyspark.sql import functions as F

    from sequin.sources import occurrences, read_table, series_catalogue

    events = read_table(spark, "/root/testdata/sf0.001", "events")
    occ = occurrences(events, series_catalogue(events))
    assert occ.agg(F.sum(F.size("ix"))).first()[0] == events.filter("value IS NOT NULL").count()


def test_queries_release_what_they_persist(spark):
    import gc

    from sequin.plans.queries import QUERIES

    spark.catalog.clearCache()
    for name in ("verdict_presence", "ordered_match", "sequence_hits"):
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert df.count() > 0
        del df
    gc.collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_blocks_follow_the_positions_listed(spark):
    # one far position adds few blocks, and the chain still reaches it
    from sequin.operators import encode

    far = 2_000_000_000
    occ = [row("s1", "d1", "c", "t1", [1, far]), row("s2", "d2", "c", "t1", [5, far + 9]), row("s3", "d3", "c", "t1", [3])]
    ds, oc = frames(spark, {"t1": "c"}, occ)
    m = Mining.from_tables(ds, oc)
    blocks = encode.position_blocks(m.keyed, m.dataset)
    assert blocks.count() == 5  # two blocks for s1 and s2, s3 ends in the first
    _, ordd = check(spark, {"t1": "c"}, occ)
    assert ordd["c", (("d1", "s1"), ("d3", "s3"), ("d2", "s2"))][5] == [1, 3, 5]


def test_profiles_join_series_that_agree(spark):
    from pyspark.sql import functions as F

    dataset = {f"t{i}": ("c" if i % 2 else "d") for i in range(40)}
    occ = [row("s1", "d1", "c", t, [i, i + 3]) for i, t in enumerate(dataset)]
    occ += [row("s2", "d2", "c", t, [] if i % 4 == 0 else [i + 1]) for i, t in enumerate(dataset)]
    ds, oc = frames(spark, dataset, occ)
    m = Mining.from_tables(ds, oc)
    assert m.profiles.select("profile").distinct().count() == 2
    assert m.profile_hits.count() == 3 + 1  # all three sets where both occur, s1 alone where s2 is vetoed
    found = m.matrix.filter("found").groupBy("set_key").agg(F.count("*").alias("n")).collect()
    assert sorted(r.n for r in found) == [30, 30, 40]
    check(spark, dataset, occ)


def test_profile_of_a_series_catalogued_twice(spark):
    # two classes for one series: cells double in both, profiles stay apart from others
    occ = [row("s1", "d1", "c", "t1", [1]), row("s2", "d2", "c", "t1", []), row("s1", "d1", "c", "t2", [2])]
    _, oc = frames(spark, {"t1": "c"}, occ)
    ds = spark.createDataFrame([("t1", "c"), ("t1", "d"), ("t2", "c")], "T_name string, class_d string")
    m = Mining.from_tables(ds, oc)
    assert m.profiles.select("T_name", "profile").distinct().count() == 2
    assert m.hits.count() == 3


def test_pivot_over_given_series(spark):
    dataset, occ = random_case(3)
    ds, oc = frames(spark, dataset, occ)
    m = Mining.from_tables(ds, oc)
    names = sorted(dataset)[:2]
    cells = {(r.S_class, r.S_name, r.T_name): r.present for r in m.tmap.collect()}
    rows = evaluate.pivot_presence(m.tmap, names, "T_name").collect()
    assert len(rows) == len({k[:2] for k in cells})
    for r in rows:
        assert [r[n] for n in names] == [cells.get((r.S_class, r.S_name, n), 0) for n in names]


def test_tuples_keep_lists_gain_and_repeats(spark):
    from pyspark.sql import functions as F

    from sequin.operators import encode

    occ = [row("s1", "d1", "c", "t1", [4, 2]), row("s1", "d1", "c", "t1", [4, 2]), row("s1", "d1", "c", "t9", [])]
    ds, oc = frames(spark, {"t1": "c"}, occ)
    gained = encode.occurring_only(oc).withColumn("gain", F.lit(0.5))
    got = {(r.T_name, r.T_indice, r.gain, r.n_rows) for r in encode.series_tuples(gained).collect()}
    assert got == {("t1", "[4, 2]", 0.5, 2)}
    pairs = {(r.T_name, r.T_indice, r.n_rows) for r in encode.shapelet_tuples(encode.join_class_left(oc, ds)).collect()}
    assert pairs == {("t1", "[4, 2]", 2), (None, "[]", 1)}


@pytest.mark.parametrize("seed,least", [(1, 0.6), (2, 0.75), (3, 0.5), (9, 0.9), (12, 0.0)])
def test_threshold_inside_the_search(spark, seed, least):
    dataset, occ = random_case(seed)
    ds, oc = frames(spark, dataset, occ)
    m = Mining.from_tables(ds, oc)
    want = {k: v for k, v in model.verdict_ordered(dataset, occ).items() if v[4] >= least}
    got = {(r.S_class, tuple((i.S_dimension, i.S_name) for i in r["items"])): (r.tp, r.fn, r.fp, r.tn, r.accuracy, list(r.tas)) for r in m.accurate_ordered(least).collect()}
    assert got == want
    m.close()


def test_the_threshold_ends_branches(spark):
    # class c is half of all series: s1 is found in them all, s2 in one of them, so nothing grows from
    # s2 (s2>s1, s2>s3, s2>s1>s3)
    dataset = {f"t{i}": "c" if i < 10 else "d" for i in range(20)}
    occ = [row("s1", "d1", "c", t, [5]) for t in list(dataset)[:10]]
    occ += [row("s2", "d2", "c", "t0", [1]), row("s3", "d3", "c", "t0", [7])]
    ds, oc = frames(spark, dataset, occ)
    m = Mining.from_tables(ds, oc)
    every = m.ordered().matches.count()
    found = evaluate.search_accurate(m.seqs, m.dataset, m.tmap, m.blocks, 0.8)
    assert every == 10 + 1 + 1 + 4 and found.matches.count() == 10 + 1 + 1 + 1
    assert [r.names for r in m.accurate_ordered(0.8).collect()] == ["s1"]
    m.close()


def test_sequences_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "BROADCAST_SEQUENCES", 0)
    check(spark, EDGE_DATASET, EDGE_OCC)
    check(spark, EDGE_DATASET, EDGE_OCC, salts=3)


def test_blocks_are_bucketed_for_the_lookup(spark):
    """A round exchanges its states alone: the bucketed table of blocks is scanned as it lies."""
    from pyspark.sql import functions as F

    from sequin.session import pinned

    left = spark.range(1000).select((F.col("id") % 7).alias("shp"), F.col("id").alias("ser"), (F.col("id") % 3).alias("blk"))
    table = pinned(left.withColumn("after", F.col("ser") + 1), "bucketed-test", ["shp", "ser", "blk"], 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = left.join(table, ["shp", "ser", "blk"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        assert joined.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_close_removes_what_was_pinned(spark):
    import os

    from sequin import session

    ds, oc = frames(spark, EDGE_DATASET, EDGE_OCC)
    m = Mining.from_tables(ds, oc)
    before = session.pinned_count()
    m.verdict_ordered().collect()
    made = [p.removeprefix("file:") for p, _ in session._paths[before:]]
    assert made and all(os.path.isdir(p) for p in made)
    m.close()
    assert session.pinned_count() == before and not any(os.path.exists(p) for p in made)


def test_pivot_of_position_lists(spark):
    occ = [row("s1", "d1", "c", "a.b c`d", [4, 2]), row("s1", "d1", "c", "a.b c`d", []), row("s1", "d1", "c", "t2", [7]), row("s2", "d2", "c", "t3", [1])]
    _, oc = frames(spark, {"t2": "c"}, occ)
    wide = evaluate.pivot_positions(oc, ["a.b c`d", "t2", "t_none"], {"a.b c`d": "x", "t2": "y_z", "t_none": "w"})
    assert wide.columns == ["S_class", "S_dimension", "S_name", "a.b c`d_x", "t2_y_z", "t_none_w"]
    got = {r.S_name: tuple(r)[3:] for r in wide.collect()}
    assert got == {"s1": (["4, 2", "x"], ["7"], []), "s2": ([], [], [])}


@pytest.mark.parametrize("seed", [3, 6])
def test_long_windows_are_the_arrays(spark, seed):
    dataset, occ = random_case(seed)
    ds, oc = frames(spark, dataset, occ)
    m = Mining.from_tables(ds, oc)
    rows = {}
    for r in evaluate.window_entries(m.seqs, m.hits, m.blocks, chunks=7).collect():
        rows.setdefault((r.S_class, r.names, r.ords, r.T_name), []).append((r.place, r.entry, f"{r['rank']}_{r.p}"))
    key = lambda r: (r.S_class, r.names, r.ords, r.T_name)
    windows = {key(r): list(r.window) for r in evaluate.sequence_profile(m.seqs, m.hits, m.blocks).collect()}
    ranked = {key(r): list(r.window) for r in evaluate.reranked_windows(m.seqs, m.hits, m.tmap, m.blocks).collect()}
    assert {k: [e for _, e, _ in sorted(v)] for k, v in rows.items()} == windows
    assert {k: [e for _, _, e in sorted(v)] for k, v in rows.items()} == ranked
    assert all([p for p, _, _ in sorted(v)] == list(range(len(v))) for v in rows.values())
    m.close()


def test_a_long_window_is_sorted_by_many_tasks(spark):
    """300,000 entries of one (variant, series): no task holds the window, no array is longer than a block."""
    from pyspark.sql import functions as F

    n = 150_000
    wide = spark.range(2).select(F.format_string("s%d", "id").alias("S_name"), F.format_string("d%d", "id").alias("S_dimension"), F.lit("c").alias("S_class"), F.lit("t").alias("T_name"), F.expr(f"transform(sequence(0, {n - 1}), x -> 2L * x + id)").alias("ix"))
    ds = spark.createDataFrame([("t", "c")], "T_name string, class_d string")
    m = Mining.from_tables(ds, wide.withColumn("T_indice", F.lit("[0]")))
    entries = evaluate.window_entries(m.seqs.filter("n_steps = 2"), m.hits.filter(F.col("set_key").contains("\x1e")), m.blocks, chunks=16)
    pinned = entries.withColumn("task", F.spark_partition_id()).persist()
    assert pinned.count() == 2 * n and pinned.select("place").distinct().count() == 2 * n
    texts = sorted([f"0_{2 * x}" for x in range(n)] + [f"1_{2 * x + 1}" for x in range(n)])
    some = {r.place: r.entry for r in pinned.filter("place % 997 = 0").collect()}
    assert all(texts[k] == e for k, e in some.items()) and len(some) > 200
    pinned.unpersist()
    m.close()
