"""Factorised joins, windows with the veto marker and bitmap counts against plain Python."""

import collections

import pytest
from pyspark.sql import functions as F

from sequin.functions.identity import items
from sequin.operators import bitmaps, evaluate, factorised
from sequin.plans.queries import Mining, plain
from tests import model
from tests.test_semantics import EDGE_DATASET, EDGE_OCC, frames, random_case, row

CASES = [(EDGE_DATASET, EDGE_OCC), random_case(3), random_case(8)]


def mining(spark, dataset, occ, salts=None):
    return Mining.from_tables(*frames(spark, dataset, occ), salts)


def by_set(df):
    """Rows with `things`: the (dimension, name) pairs of the set, by name."""
    named = df.withColumn("things", items(F.col("set_key")))
    return [(tuple((i.S_dimension, i.S_name) for i in r["things"]), r) for r in named.collect()]


@pytest.mark.parametrize("case", range(3))
@pytest.mark.parametrize("salts", [None, 3])
def test_items_joined_to_their_series(spark, case, salts):
    dataset, occ = CASES[case]
    m = mining(spark, dataset, occ, salts)
    flat = collections.Counter()
    for s in model.enumerate_sequences(occ):
        for (dim, name), order in s["steps"]:
            flat[s["S_class"], dim, name, order] += 1
    rows = collections.defaultdict(list)
    for r in occ:
        if r["T_name"] in dataset:
            rows[r["S_class"], r["S_dimension"], r["S_name"]].append((r["T_name"], model.render(r["ix"])))
    want = collections.Counter()
    for (cls, dim, name, order), n in flat.items():
        for t, ix in rows.get((cls, dim, name), [(None, None)]):
            want[cls, dim, name, order, n, t, ix] += 1
    got = factorised.expand_items(m.item_cells, m.profiles, m.keyed, salts).withColumn("i", items(F.col("S_name")))
    assert collections.Counter((r.S_class, r.i[0].S_dimension, r.i[0].S_name, r.ord, r.n_items, r.T_name, r.T_indice) for r in got.collect()) == want
    # the factors give the number of (item of a sequence, series) pairs without expanding them
    pairs = sum(n * len({t for t, _ in rows.get(k[:3], [])}) for k, n in flat.items())
    cells = m.item_cells.collect()
    assert sum(r.n_items * r.n_series for r in cells) == pairs
    assert {(r.S_class, r.n_items) for r in cells if r.profile is None} == {(k[0], n) for k, n in flat.items() if k[:3] not in rows}
    m.close()


def test_an_item_without_a_catalogued_series_stays(spark):
    m = mining(spark, {"t1": "c"}, [row("s1", "d1", "c", "t9", [1])])
    cells = m.item_cells.collect()
    assert [(r.n_items, r.n_series, r.profile) for r in cells] == [(1, 0, None)]
    assert [(r.T_name, r.T_indice) for r in factorised.expand_items(m.item_cells, m.profiles, m.keyed).collect()] == [(None, None)]
    m.close()


def pair_windows(dataset, occ):
    """{(class, set, series): (marker, shape, entries)} as the reference's aggregate fills it."""
    cells = collections.defaultdict(list)
    for r in occ:
        if r["T_name"] in dataset:
            cells[r["S_class"], (r["S_dimension"], r["S_name"]), r["T_name"]].append(r["ix"])
    out = {}
    for s in model.enumerate_sequences(occ):
        things = tuple(sorted(s["items"], key=lambda i: (i[1], i[0])))
        for t in dataset:
            lists = [cells.get((s["S_class"], i, t), []) for i in things]
            if any(lists):
                shape = "".join("x" if any(not ix for ix in own) else "p" if own else "-" for own in lists)
                entries = sorted(e for k, own in enumerate(lists) for ix in own for e in ([f"{k}_{p}" for p in ix] or ["x"]))
                out[s["S_class"], things, t] = ("x" if "x" in shape else "", shape, entries)
    return out


@pytest.mark.parametrize("case", range(3))
def test_windows_of_all_series_with_the_marker(spark, case):
    dataset, occ = CASES[case]
    m = mining(spark, dataset, occ)
    want = pair_windows(dataset, occ)
    sequences = collections.Counter((s["S_class"], tuple(sorted(s["items"], key=lambda i: (i[1], i[0])))) for s in model.enumerate_sequences(occ))
    got = by_set(m.windows)
    assert sum(r.n_sequences * r.n_series for _, r in got) == sum(sequences[c, things] for c, things, _ in want)
    for things, r in got:
        assert r.n_sequences == sequences[r.S_class, things]
        assert want[r.S_class, things, r.first_series][:2] == (r.marker, r["shape"])
        assert r.n_present == sum(x == "p" for x in r["shape"]) or "x" in r["shape"]
    series = collections.Counter((c, things, w[:2]) for (c, things, _), w in want.items())
    made = collections.Counter()
    for things, r in got:
        made[r.S_class, things, (r.marker, r["shape"])] += r.n_series
    assert made == series
    vetoed = {(r.S_class, things, r.T_name): r.window for things, r in by_set(factorised.vetoed_windows(m.seqs, m.windows, m.profiles, m.keyed))}
    assert vetoed == {k: w[2] for k, w in want.items() if w[0] == "x"}
    # beside the verdicts: every sequence meets all rows of its set
    joined = factorised.verdict_windows(m.keyed_verdicts, m.seqs, m.windows)
    assert sum(r.n_series for r in joined.collect()) == sum(sequences[c, things] for c, things, _ in want)
    m.close()


@pytest.mark.parametrize("case", range(3))
def test_bitmap_counts(spark, case):
    m = mining(spark, *CASES[case])
    key = ["S_class", "set_key", "tp", "fn", "fp", "tn", "accuracy"]
    want = evaluate.presence_confusion(m.seqs, m.profile_hits, m.profiles, m.dataset).select(*key)
    got = bitmaps.bitmap_confusion(m.seqs, m.bitmap_index, m.dataset).select(*key)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    m.close()


def test_bitmaps_of_many_series(spark):
    """Two blocks of series in a class; vetoes in one of them; nothing per series after the index."""
    n = 40_000
    ds = spark.range(n).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("T_name"), F.when(F.col("id") % 50 == 0, "d").otherwise("c").alias("class_d"))
    one = lambda name, ix: spark.range(n).select(F.lit(name).alias("S_name"), F.lit(name).alias("S_dimension"), F.lit("c").alias("S_class"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("T_name"), ix.alias("ix"))
    here = F.array(F.col("id"))
    none = F.array().cast("array<bigint>")
    occ = one("a", F.when(F.col("id") % 3 == 0, here).otherwise(none)).filter("T_name <> 't3'").union(one("b", F.when(F.col("id") % 2 == 0, here).otherwise(none)).filter("T_name in ('t0', 't1', 't2')"))
    m = Mining.from_tables(ds, occ.withColumn("T_indice", F.lit("")))
    index = m.bitmap_index.persist()
    assert index.filter("class_d = 'c' AND S_name like 'a%'").count() == 2
    seqs = spark.createDataFrame([("c", k, [(None, n_, None, None) for n_ in k.split("+")], len(k.split("+"))) for k in ("a\x1fa", "b\x1fb", "a\x1fa+b\x1fb")], "S_class string, set_key string, steps array<struct<ord: bigint, S_name: string, S_dimension: string, head: string>>, n_steps int")
    counts = bitmaps.set_counts(seqs, index)
    plan = counts._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert "T_name" not in plan
    got = {r.set_key: (r.tp, r.n_found) for r in counts.collect()}
    a = {i for i in range(n) if i % 3 == 0 and i != 3}
    veto_a = {i for i in range(n) if i % 3 and i != 3}
    b, veto_b = {0, 2}, {1}
    both = (a | b) - veto_a - veto_b
    own = lambda s: sum(i % 50 != 0 for i in s)
    assert got == {"a\x1fa": (own(a), len(a)), "b\x1fb": (own(b), len(b)), "a\x1fa+b\x1fb": (own(both), len(both))}
    index.unpersist()
    m.close()


def test_a_name_of_the_set_is_shown_plain(spark):
    m = mining(spark, *CASES[0])
    assert {r.set_key for r in plain(m.windows).collect()} >= {"s1", "s1+s3"}
    m.close()
