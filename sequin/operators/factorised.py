"""Relations of items or sets with series in factorised form.

The series of a class whose cells agree share a profile (`evaluate.series_profiles`).
What the reference writes once for each (sequence, series) is kept here once for
each (distinct item or set, profile), with two factors: how many sequences and how
many series stand behind the row. The flat rows are made on request only, by
joining the series of the profiles back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prefixed
from ..functions.identity import LIST
from ..session import keep
from .evaluate import SET_KEY, distinct_sets, most_steps
from .joins import indexed_runs, join_bounded, join_dealt, parts_of

ABSENT, PRESENT, VETOED = "-", "p", "x"

# Sets that are gathered in one row, about, and more than a series may list shapelets.
SET_RUN = 256
PLACES = 1 << 32


def profile_sizes(profiles: DataFrame) -> DataFrame:
    """(S_class, profile, n_series, first_series): a profile's series counted; the smallest
    name stands for the profile where it has to be shown."""
    return profiles.groupBy("S_class", "profile").agg(
        F.count(F.lit(1)).alias("n_series"), F.min("T_name").alias("first_series")
    )


def distinct_items(seqs: DataFrame) -> DataFrame:
    """(S_class, S_name, ord, n_items): the distinct sequence items, with the number of
    sequence steps that each stands for."""
    steps = seqs.select("S_class", F.explode("steps").alias("s"))
    return steps.groupBy("S_class", F.col("s.S_name").alias("S_name"), F.col("s.ord").alias("ord")).agg(
        F.count(F.lit(1)).alias("n_items")
    )


def item_cells(items: DataFrame, cells: DataFrame, sizes: DataFrame, salts: int | None = None) -> DataFrame:
    """J2, factorised: the distinct items left-join the cells of their shapelet.

    One row per (item, profile): n_items x n_series rows of the flat join. An item
    whose shapelet has no row in any catalogued series keeps one row with a NULL
    profile and n_series 0."""
    sized = cells.drop("own_first").join(sizes, ["S_class", "profile"])
    met = join_bounded(sized, items, ["S_class", "S_name"], ["profile"], salts)
    alone = items.join(cells.select("S_class", "S_name").distinct(), ["S_class", "S_name"], "left_anti")
    return met.unionByName(alone.withColumn("n_series", F.lit(0).cast("bigint")), allowMissingColumns=True)


def expand_items(
    joined: DataFrame,
    profiles: DataFrame,
    keyed: DataFrame,
    salts: int | None = None,  # not used: the join measures its keys
    shown: Callable[[DataFrame], DataFrame] = lambda items: items,
) -> DataFrame:
    """J2, flat: a row per (distinct item, occurrence row of its shapelet in a catalogued
    series), with the row's position list; T_name is NULL where there is none.

    The occurrence rows carry the profile of their series and meet the items of a cell in
    the last join, dealt by the rows it makes (a hot cell is cut, so no salts are asked
    for): no row per (item, series) is shuffled. `joined` is read more than once (keep it);
    `shown` may render its items, before their rows are joined."""
    met = joined.filter(F.col("profile").isNotNull()).select("S_class", F.col("S_name").alias("_key"), "profile", "S_name", "ord", "n_items")
    # a series catalogued under two classes has one profile row for each; its occurrences count once
    series = profiles.select("S_class", "profile", "T_name").distinct()
    rows = keyed.select("S_class", F.col("S_name").alias("_key"), "T_name", "T_indice").join(series, ["S_class", "T_name"])
    flat = join_dealt(rows, shown(met), ["S_class", "_key", "profile"], ["T_name"]).select("S_class", "S_name", "ord", "n_items", "T_name", "T_indice")
    alone = shown(joined.filter(F.col("profile").isNull()).select("S_class", "S_name", "ord", "n_items"))
    return flat.unionByName(alone, allowMissingColumns=True)


def profile_windows(seqs: DataFrame, cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """A3 with its marker, factorised: one row per (name set, profile) with a row for one
    of its shapelets, vetoed profiles too.

    `shape` has a letter for each shapelet of the set, by name: present, vetoed (the
    reference's "x" entry) or without a row; `marker` is "x" where any is vetoed.
    `n_sequences` x `n_series` sums to all (sequence, series) pairs with a row."""
    sets = distinct_sets(seqs)
    numbered = sets.select(*SET_KEY, "set_size", F.posexplode("set_names").alias("i", "S_name"))
    # far more rows than are read: dealt by the rows made, so that no task groups most of them
    joined = join_dealt(cells.drop("own_first"), keep(numbered), ["S_class", "S_name"], ["profile"])
    # a bit for each place: a set has one shapelet a dimension, 62 at most
    bit = lambda c: F.bit_or(F.when(c, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("i"))).otherwise(F.lit(0).cast("bigint")))
    found = joined.groupBy(*SET_KEY, "set_size", "profile").agg(
        F.sum("present").cast("int").alias("n_present"),
        F.max("vetoed").alias("any_veto"),
        bit(F.lit(True)).alias("rows"),
        bit(F.col("vetoed") == 1).alias("vetoes"),
    )
    has = lambda bits, i: F.call_function("shiftright", F.col(bits), i).bitwiseAND(F.lit(1).cast("bigint")) == 1
    letter = lambda i: F.when(has("vetoes", i), VETOED).when(has("rows", i), PRESENT).otherwise(ABSENT)
    letters = F.transform(F.sequence(F.lit(0), F.col("set_size") - 1), letter)
    counts = seqs.groupBy(*SET_KEY).agg(F.count(F.lit(1)).alias("n_sequences"))
    return (
        found.join(counts, SET_KEY)
        .join(sizes, ["S_class", "profile"])
        .withColumn("shape", F.array_join(letters, ""))
        .withColumn("marker", F.when(F.col("any_veto") == 1, VETOED).otherwise(""))
        .drop("rows", "vetoes")
    )


def vetoed_windows(
    seqs: DataFrame,
    windows: DataFrame,
    profiles: DataFrame,
    keyed: DataFrame,
    shown: Callable[[DataFrame], DataFrame] = lambda sets: sets,
    text: bool = False,
) -> DataFrame:
    """A3 for the series that `sequence_profile` leaves out: a row per (set, series) with a
    veto, expanded from the dictionary; `window` holds an "x" for each empty row of the
    set's shapelets there and "name_position" for every position, sorted as text; with
    `text`, joined by commas.

    The order prefix of a window differs by variant; here the shapelet's place among the
    set's names stands for it, so that a row serves all variants of the set. The entries
    of a shapelet share a prefix and "x" sorts last, so a window is its shapelets' sorted
    positions in a row. The lists of a series are gathered once, sorted and joined there,
    and the windows made beside the joined rows, which are not shuffled. The series of a
    profile have rows for the same shapelets: where a set's lists lie among a series' is
    told once for each profile. `shown` may render the sets, before their series are joined."""
    rows = keyed.select("S_class", "T_name", "S_name", "ix").repartition("S_class", "T_name")
    cells = rows.groupBy("S_class", "T_name", "S_name").agg(
        F.sort_array(F.flatten(F.collect_list(F.col("ix").cast("array<string>")))).alias("texts"),
        F.count_if(F.size("ix") == 0).cast("int").alias("n_empty"),
    )
    marks = F.array_join(F.array_repeat(F.lit(VETOED), F.col("n_empty")), ",")
    cell = F.struct("S_name", F.nullif(F.array_join("texts", ","), F.lit("")).alias("texts"), F.nullif(marks, F.lit("")).alias("marks"))
    listed = F.sort_array(F.collect_list(cell))
    per_series = cells.groupBy("S_class", "T_name").agg(listed.alias("listed"))
    # a series catalogued under two classes has a profile row for each
    catalogued = profiles.select("S_class", "profile", "T_name").distinct()
    series = keep(catalogued.join(per_series, ["S_class", "T_name"]))
    names = series.groupBy("S_class", "profile").agg(F.max(F.transform("listed", lambda c: c["S_name"])).alias("names"))
    barred = windows.filter(F.col("marker") == VETOED).select(*SET_KEY, "set_size", "profile").join(names, ["S_class", "profile"])
    # a part: the shapelet's place in the set and in the series' lists (0: none) in one number, by the place as text
    number = lambda x, i: i.cast("bigint") * PLACES + F.array_position("names", x)
    by_text = F.array_sort(F.transform(F.split("set_key", LIST), lambda x, i: F.struct(F.concat(i.cast("string"), F.lit("_")).alias("o"), number(x, i).alias("n"))))
    sets = barred.select(*SET_KEY, "set_size", "profile", F.transform(by_text, lambda x: x["n"]).alias("parts"))
    runs = indexed_runs(shown(sets), ["S_class", "profile"], ["set_key", "set_size"], SET_RUN)
    bare = series.withColumn("listed", F.transform("listed", lambda c: F.struct(c["texts"].alias("texts"), c["marks"].alias("marks"))))
    w = join_dealt(bare, keep(runs), ["S_class", "profile"], ["T_name"], weight=F.size("members"))
    of = lambda n: F.get("listed", (n % PLACES - 1).cast("int"))
    entry = lambda n: prefixed(of(n)["texts"], F.concat(F.floor(n / PLACES).cast("string"), F.lit("_")))
    made = w.select("S_class", "T_name", F.transform("parts", entry).alias("entries"), F.transform("parts", lambda n: of(n)["marks"]).alias("marks"), "members")
    made = made.select("S_class", "T_name", "entries", "marks", F.inline("members"))
    most = most_steps(seqs)
    entries, marks = ([c] if isinstance(c, Column) else c for c in (parts_of("entries", most), parts_of("marks", most)))
    window = F.concat_ws(",", *entries, *marks)
    return made.select(*SET_KEY, "set_size", "T_name", (window if text else F.split(window, ",")).alias("window"))


def verdict_windows(verdicts: DataFrame, seqs: DataFrame, windows: DataFrame) -> DataFrame:
    """X5 with the factorised profile column: per sequence its accuracy and TAS beside the
    (profile, marker, shape) rows of its set, vetoed ones too."""
    v = verdicts.select("S_class", "sid", "accuracy", "tas").join(seqs.select("S_class", "sid", "set_key"), ["S_class", "sid"])
    return v.join(windows.drop("n_sequences", "any_veto"), SET_KEY)
