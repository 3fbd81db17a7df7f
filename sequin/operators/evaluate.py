"""Step 2, evaluation: test sequences against every catalogued series, count
TP/FN/FP/TN, accuracy and the time-window array TAS (J2-J5, A3, A6-A9, F2-F4,
V11-V16).

Two semantics (see README, "Semantics"):

* presence — what the reference computes: a sequence matches a series when no
  shapelet of it is marked absent there ("[]" row) and at least one has
  positions; TAS is the position of the smallest "order_position" text.
* ordered — what its comments describe: the shapelets must occur in sequence
  order (greedy chain, each next position >= the previous one).

Both evaluate each distinct name set / ordered sequence once and join back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import entry_position, prefixed, window_entry
from ..functions.identity import LIST
from ..session import keep, pinned
from ..sources.fixture import rank_within
from .encode import POSITION_BLOCK
from .joins import RUN, gathered_runs, indexed_runs, join_bounded, join_dealt, parts_of

SET_KEY = ["S_class", "set_key"]


def distinct_sets(seqs: DataFrame) -> DataFrame:
    """Distinct name sets: (S_class, set_key, set_size, set_names), told from the key alone."""
    names = F.split("set_key", LIST)
    return seqs.select(*SET_KEY).distinct().select(*SET_KEY, F.size(names).alias("set_size"), names.alias("set_names"))


def set_items(sets: DataFrame) -> DataFrame:
    return sets.select(*SET_KEY, "set_size", F.explode("set_names").alias("S_name"))


def series_profiles(tmap: DataFrame) -> DataFrame:
    """(S_class, T_name, class_d, profile): series whose cells for the shapelets of
    S_class agree (which have a row, which are present, which vetoed) share a profile,
    so a set is found in all of them or in none. `profile` is the number of cells and
    128 bits over them: fixed width, a hash aggregation with a partial step."""
    bits = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "S_name", "present", "vetoed"))
    return (
        tmap.groupBy("S_class", "T_name", "class_d")
        .agg(F.count(F.lit(1)).alias("n"), bits("a").alias("a"), bits("b").alias("b"))
        .select("S_class", "T_name", "class_d", F.struct("n", "a", "b").alias("profile"))
    )


def profile_cells(tmap: DataFrame, profiles: DataFrame) -> DataFrame:
    """(S_class, S_name, profile, present, vetoed, own_first): one cell for each shapelet of a
    profile; `own_first` is the largest, over the profile's series of the own class, of the
    shapelet's smallest position as text."""
    t, p = tmap.alias("t"), profiles.alias("p")
    same = (F.col("t.S_class") == F.col("p.S_class")) & (F.col("t.T_name") == F.col("p.T_name"))
    cells = t.join(p, same & F.col("t.class_d").eqNullSafe(F.col("p.class_d"))).select("t.*", "p.profile")
    own_first = F.max(F.when(F.col("class_d") == F.col("S_class"), F.col("pmin_text").cast("bigint")))
    return cells.groupBy("S_class", "S_name", "profile").agg(
        F.max("present").alias("present"), F.max("vetoed").alias("vetoed"), own_first.alias("own_first")
    )


def profile_matrix(seqs: DataFrame, cells: DataFrame, salts: int | None = None) -> DataFrame:
    """Per (name set, profile) that has a row for one of its shapelets:
    shapelets with positions, shapelets marked absent, and the two verdicts
    `found` (presence) and `complete` (every shapelet has positions, none absent;
    necessary for an ordered match). Only fixed-width aggregates: the group-by
    stays a hash aggregation with a map-side partial step."""
    items = set_items(distinct_sets(seqs))
    joined = join_bounded(cells.drop("own_first"), items, ["S_class", "S_name"], ["profile"], salts)
    return (
        joined.groupBy(*SET_KEY, "set_size", "profile")
        .agg(F.sum("present").cast("int").alias("n_present"), F.max("vetoed").alias("any_veto"))
        .withColumn("found", (F.col("any_veto") == 0) & (F.col("n_present") >= 1))
        .withColumn("complete", (F.col("any_veto") == 0) & (F.col("n_present") == F.col("set_size")))
    )


def by_series(matrix: DataFrame, profiles: DataFrame, salts: int | None = None) -> DataFrame:
    """The rows of a profile matrix for each series of the profile."""
    return join_bounded(profiles, matrix, ["S_class", "profile"], ["T_name"], salts).drop("profile")


def dealt_by_series(matrix: DataFrame, profiles: DataFrame) -> DataFrame:
    """The same where the result has a row for each series: dealt by the rows it makes. Both
    tables are read twice (keep them)."""
    return join_dealt(profiles, matrix, ["S_class", "profile"], ["T_name"]).drop("profile")


def presence_matrix(seqs: DataFrame, tmap: DataFrame, salts: int | None = None) -> DataFrame:
    """The profile matrix for every series with a cell."""
    profiles = series_profiles(tmap)
    return by_series(profile_matrix(seqs, profile_cells(tmap, profiles), salts), profiles, salts)


def pivot_presence(tmap: DataFrame, values: list[str], column: str = "class_d") -> DataFrame:
    """One row per shapelet and one column for each of `values` (classes, or names of
    series with `column="T_name"`): in how many of its series the shapelet is present."""
    pivoted = tmap.groupBy("S_class", "S_name").pivot(column, values).agg(F.sum("present"))
    return pivoted.select("S_class", "S_name", *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("bigint").alias(v) for v in values])


def pivot_positions(occ: DataFrame, series: list[str], classes: dict[str, str] | None = None) -> DataFrame:
    """J4 as the reference fills it: one row per shapelet and one column for each of `series`,
    an array with the position list of each of its rows there ("x" for an empty list; no row,
    no entry), sorted as text. With `classes` a column is named `series_class`.

    For a list of series that a caller gives: their rows alone are grouped, and a cell holds
    what one series lists. Names may hold dots, blanks or backticks."""
    text = F.when(F.col("T_indice") == "[]", "x").otherwise(F.expr("substring(T_indice, 2, length(T_indice) - 2)"))
    asked = occ.filter(F.col("T_name").isin(series)).select("S_class", "S_dimension", "S_name", "T_name", text.alias("cell"))
    cells = asked.groupBy("S_class", "S_dimension", "S_name", "T_name").agg(F.array_sort(F.collect_list("cell")).alias("cell"))
    wide = cells.groupBy("S_class", "S_dimension", "S_name").pivot("T_name", series).agg(F.first("cell"))
    every = occ.select("S_class", "S_dimension", "S_name").distinct()
    wide = every.join(wide, ["S_class", "S_dimension", "S_name"], "left")
    quoted = lambda t: F.col("`" + t.replace("`", "``") + "`")
    named = lambda t: f"{t}_{classes[t]}" if classes else t
    return wide.select("S_class", "S_dimension", "S_name", *[F.coalesce(quoted(t), F.array().cast("array<string>")).alias(named(t)) for t in series])


def class_totals(dataset: DataFrame) -> DataFrame:
    """Series per class (one row per class)."""
    return dataset.groupBy(F.col("class_d").alias("S_class")).agg(F.count(F.lit(1)).alias("n_class"))


def confusion(hit_counts: DataFrame, keys: list[str], dataset: DataFrame) -> DataFrame:
    """From per-sequence `tp` (hits of its own class) and `n_found` (all
    hits) derive fn, fp, tn against the whole catalogue; A8: accuracy."""
    total = dataset.select(F.count(F.lit(1))).scalar()
    out = (
        hit_counts.join(class_totals(dataset), "S_class", "left")
        .withColumn("n_class", F.coalesce("n_class", F.lit(0)))
        .select(
            *keys,
            F.col("tp").cast("bigint").alias("tp"),
            (F.col("n_class") - F.col("tp")).cast("bigint").alias("fn"),
            (F.col("n_found") - F.col("tp")).cast("bigint").alias("fp"),
            (total - F.col("n_class") - (F.col("n_found") - F.col("tp"))).cast("bigint").alias("tn"),
        )
    )
    return out.withColumn("accuracy", ((F.col("tp") + F.col("tn")) / F.nullif(total, F.lit(0))).cast("double"))


def presence_confusion(seqs: DataFrame, hits: DataFrame, profiles: DataFrame, dataset: DataFrame) -> DataFrame:
    """Per name set: tp, fn, fp, tn, accuracy (presence). A profile counts once, with
    the number of its series."""
    sizes = profiles.groupBy("S_class", "profile").agg(
        F.count_if(F.col("class_d") == F.col("S_class")).alias("own"), F.count(F.lit(1)).alias("n")
    )
    counts = hits.join(sizes, ["S_class", "profile"]).groupBy(*SET_KEY).agg(F.sum("own").alias("tp"), F.sum("n").alias("n_found"))
    sets = seqs.select(*SET_KEY).distinct()
    return confusion(sets.join(counts, SET_KEY, "left").fillna(0, ["tp", "n_found"]), SET_KEY, dataset)


def variant_items(seqs: DataFrame) -> DataFrame:
    """Distinct (names, orders) variants, one row per step."""
    variants = seqs.select(*SET_KEY, "names", "ords", "n_steps", "steps").dropDuplicates(["S_class", "names", "ords"])
    return variants.select(*SET_KEY, "names", "ords", "n_steps", F.explode("steps").alias("s")).select(
        *SET_KEY, "names", "ords", "n_steps", "s.S_name", "s.ord"
    )


def _found_pairs(matrix: DataFrame, own_class_only: bool) -> DataFrame:
    pairs = matrix.filter("found")
    if own_class_only:
        pairs = pairs.filter(F.col("class_d") == F.col("S_class"))
    return pairs.select(*SET_KEY, "T_name", "class_d")


def _window_steps(seqs, matrix, own_class_only, salts) -> DataFrame:
    return join_bounded(_found_pairs(matrix, own_class_only), variant_items(seqs), SET_KEY, ["T_name"], salts)


def _variants(seqs: DataFrame) -> DataFrame:
    """The distinct (names, orders) of a set, with their steps as the windows need them.

    `groups` has one entry for each "order_" prefix `o`, in the text order of the prefixes:
    the steps `at` with that order, by name, each with its place `i` in the set's key and the
    places (bits of `before`) of the steps that rank before it by (order text, name)."""
    variants = seqs.select(*SET_KEY, "names", "ords").distinct()
    texts = F.zip_with(F.split("names", LIST), F.split("ords", ","), lambda n, o: F.struct(o.alias("o"), n.alias("n")))
    place = lambda x: (F.array_position(F.split("set_key", LIST), x["n"]) - 1).cast("int")
    steps = F.transform(F.array_sort(texts), lambda x: F.struct(F.concat(x["o"], F.lit("_")).alias("o"), place(x).alias("i")))
    out = variants.withColumn("_steps", steps)
    before = lambda r: _bits(F.transform(F.slice("_steps", F.lit(1), r), lambda y: y["i"]))
    ranked = F.transform("_steps", lambda x, r: F.struct(x["o"].alias("o"), x["i"].alias("i"), before(r).alias("before")))
    out = out.withColumns({"_steps": ranked, "_prefixes": F.array_sort(F.array_distinct(F.transform("_steps", lambda x: x["o"])))})
    at = lambda o: F.transform(F.filter("_steps", lambda x: x["o"] == o), lambda x: F.struct(x["i"].alias("i"), x["before"].alias("before")))
    groups = F.transform("_prefixes", lambda o: F.struct(o.alias("o"), at(o).alias("at")))
    return out.select(*SET_KEY, "names", "ords", groups.alias("groups"))


def _bits(places: Column) -> Column:
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i)
    return F.aggregate(places, F.lit(0).cast("bigint"), lambda acc, i: acc + bit(i))


# Variants that are gathered in one row, about.
VARIANT_RUN = 256


def _in_runs(variants: DataFrame, part: Callable[[Column], Column], columns: list[str], run: int | None = None, weight: Column | None = None) -> DataFrame:
    """The variants of a set in runs; of a step group an entry of the window needs its `part`."""
    return indexed_runs(variants.withColumn("parts", F.transform("groups", part)), SET_KEY, columns, run or VARIANT_RUN, weight)


def _position_texts(blocks: DataFrame) -> DataFrame:
    """(S_class, T_name, S_name, value): the positions of a cell as one text, in text order."""
    rows = blocks.filter(F.size("pos") > 0).repartition("S_class", "T_name")
    texts = F.flatten(F.collect_list(F.col("pos").cast("array<string>")))
    return rows.groupBy("S_class", "T_name", "S_name").agg(F.array_join(F.sort_array(texts), ",").alias("value"))


def _with_values(
    runs: DataFrame, matrix: DataFrame, cells: DataFrame, own_class_only: bool, weight: Column | None = None
) -> DataFrame:
    """The runs of variants joined to the series where their set is found; `listed` has the
    value of each shapelet's cell there, in the order of the set's key, NULL without one;
    `present` has the bits of those that are not NULL.

    The values of a (set, series) are gathered once, in one row, and every variant is made
    beside them: no row per (variant, series) is shuffled, nor per (variant, series, step).
    `weight`: the rows made of a run, as many as its members by default. `runs` is kept."""
    per_series = cells.groupBy("S_class", "T_name").agg(F.map_from_entries(F.collect_list(F.struct("S_name", "value"))).alias("listed"))
    found = _found_pairs(matrix, own_class_only).select(*SET_KEY, "T_name")
    # a series catalogued under two classes has a pair for each
    pairs = found.repartition("S_class", "T_name").distinct()
    values = F.transform(F.split("set_key", LIST), lambda x: F.col("listed")[x])
    valued = pairs.join(per_series, ["S_class", "T_name"]).select(*SET_KEY, "T_name", values.alias("listed"))
    here = F.filter(F.sequence(F.lit(0), F.size("listed") - 1), lambda i: F.get("listed", i).isNotNull())
    valued = valued.withColumn("present", _bits(here))
    return join_dealt(valued, keep(runs), SET_KEY, ["T_name"], counted=found, weight=F.size("members") if weight is None else weight)


def _made(rows: DataFrame, seqs: DataFrame, entry: Callable[[Column], Column]) -> tuple[DataFrame, list[Column] | Column]:
    """A row per variant from the joined runs, and what the groups of its steps give there, in
    order (`joins.parts_of`): `entry` of each part, made once for all variants of the run."""
    made = rows.select("S_class", "T_name", F.size("listed").alias("n_shapelets"), F.transform("parts", entry).alias("entries"), "members")
    return made.select("S_class", "T_name", "n_shapelets", "entries", F.inline("members")), parts_of("entries", most_steps(seqs))


def most_steps(seqs: DataFrame) -> int:
    return seqs.agg(F.max("n_steps")).first()[0] or 0


def _of(place: Column) -> Column:
    return F.get("listed", place)


def _texts_of(value: Column) -> Column:
    return F.split(value, ",")


def _prefix_part(g: Column) -> Column:
    return F.struct(g["o"].alias("o"), F.transform(g["at"], lambda x: x["i"]).alias("at"))


def _prefix_entries(g: Column) -> Column:
    """The entries of a prefix: the positions of its shapelet, in text order already. Only
    steps that share an order have theirs sorted together."""
    here = F.filter(g["at"], lambda i: _of(i).isNotNull())
    mixed = F.array_join(F.sort_array(F.flatten(F.transform(here, lambda i: _texts_of(_of(i))))), ",")
    return prefixed(F.when(F.size(g["at"]) == 1, _of(F.get(g["at"], F.lit(0)))).otherwise(F.nullif(mixed, F.lit(""))), g["o"])


def _rank_entries(at: Column) -> Column:
    """The same with ranks for prefixes: the number of steps present that rank before."""
    prefix = lambda x: F.concat(F.bit_count(x["before"].bitwiseAND(F.col("present"))).cast("string"), F.lit("_"))
    entry = lambda x, r, p: F.struct(p.alias("p"), r.alias("r"), F.concat(prefix(x), p).alias("e"))
    here = F.filter(at, lambda x: _of(x["i"]).isNotNull())
    mixed = F.sort_array(F.flatten(F.transform(here, lambda x, r: F.transform(_texts_of(_of(x["i"])), lambda p: entry(x, r, p)))))
    one = F.get(at, F.lit(0))
    return F.when(F.size(at) == 1, prefixed(_of(one["i"]), prefix(one))).otherwise(F.nullif(F.array_join(F.transform(mixed, lambda x: x["e"]), ","), F.lit("")))


def _window(entries: list[Column] | Column, text: bool) -> Column:
    """The groups' entries as one window; those that are NULL have none."""
    window = F.concat_ws(",", *entries) if isinstance(entries, list) else F.concat_ws(",", entries)
    return (window if text else _texts_of(window)).alias("window")


def sequence_profile(
    seqs: DataFrame,
    matrix: DataFrame,
    blocks: DataFrame,
    own_class_only: bool = False,
    shown: Callable[[DataFrame], DataFrame] = lambda variants: variants,
    text: bool = False,
) -> DataFrame:
    """The time window of a (variant, series where its set is
    found): every position p of every shapelet as the text "order_p" (order = the
    shapelet's first position in the source series), sorted as text, and the
    number of shapelets of the sequence. As in the reference, a window is one
    array: it grows with what the sequence's shapelets list in one series.
    With `text` it is its entries joined by commas. `shown` may render the
    variants, before their series are joined.

    Windows sort by prefix first, so the entries of a prefix are made once for all
    variants of a run that have it, and a window puts them in a row."""
    runs = _in_runs(shown(_variants(seqs)), _prefix_part, ["names", "ords"])
    w, entries = _made(_with_values(runs, matrix, _position_texts(blocks), own_class_only), seqs, _prefix_entries)
    return w.select("S_class", "names", "ords", "T_name", "n_shapelets", _window(entries, text))


def reranked_windows(
    seqs: DataFrame,
    matrix: DataFrame,
    tmap: DataFrame,
    blocks: DataFrame,
    own_class_only: bool = False,
    shown: Callable[[DataFrame], DataFrame] = lambda variants: variants,
    text: bool = False,
) -> DataFrame:
    """The window with each order replaced by its rank (0-based, text order,
    equal orders of different shapelets by name) among the shapelets present in
    the series; entries keep the order of the "order_p" texts. `text` and the way
    windows are made: as in `sequence_profile`."""
    runs = _in_runs(shown(_variants(seqs)), lambda g: g["at"], ["names", "ords"])
    w, entries = _made(_with_values(runs, matrix, _position_texts(blocks), own_class_only), seqs, _rank_entries)
    return w.select("S_class", "names", "ords", "T_name", _window(entries, text))


def window_entries(
    seqs: DataFrame,
    matrix: DataFrame,
    blocks: DataFrame,
    own_class_only: bool = False,
    salts: int | None = None,
    chunks: int | None = None,
) -> DataFrame:
    """A3/V12/V13 in long form: one row per entry of a (variant, series) window, with its
    `place` in the text order of the entries (from 0) and the shapelet's `rank`.

    The rows are dealt by range of (variant, series, entry) and numbered by chunk, so a
    window of any length is sorted by as many tasks as it fills; no array is longer than a
    block. Equal entries of different shapelets go by rank. A rank compares the orders of
    the sequence's own shapelets present, at most one a dimension."""
    pair = ["S_class", "names", "ords", "T_name"]
    steps = _window_steps(seqs, matrix, own_class_only, salts)
    listed = blocks.filter(F.size("pos") > 0).select("S_class", "S_name", "T_name", "pos")
    present = steps.join(listed.select("S_class", "S_name", "T_name").distinct(), ["S_class", "S_name", "T_name"])
    by_order = Window.partitionBy(*pair).orderBy(F.col("ord").cast("string"), "S_name")
    ranked = present.withColumn("rank", F.row_number().over(by_order) - 1)
    rows = ranked.join(listed, ["S_class", "S_name", "T_name"]).withColumn("p", F.explode("pos"))
    rows = rows.select(F.struct(*pair).alias("pair"), "rank", "p", window_entry(F.col("ord"), F.col("p")).alias("entry"))
    placed = rank_within(rows, "pair", ["entry", "rank", "p"], chunks)
    return placed.select(*[F.col(f"pair.{c}").alias(c) for c in pair], (F.col("_rank") - 1).cast("bigint").alias("place"), "entry", "rank", "p")


def first_entries(
    seqs: DataFrame,
    matrix: DataFrame,
    tmap: DataFrame,
    own_class_only: bool = False,
    shown: Callable[[DataFrame], DataFrame] = lambda variants: variants,
) -> DataFrame:
    """The smallest "order_p" text per (variant, series), computed from
    each shapelet's smallest position-as-text (no window is materialised): that of
    the first prefix with a shapelet present."""
    present = tmap.filter("present = 1").repartition("S_class", "T_name")
    cells = present.groupBy("S_class", "T_name", "S_name").agg(F.min("pmin_text").alias("value"))
    runs = _in_runs(shown(_variants(seqs)), _prefix_part, ["names", "ords"])
    least = lambda g: F.concat(g["o"], F.array_min(F.transform(g["at"], _of)))
    w, entries = _made(_with_values(runs, matrix, cells, own_class_only), seqs, least)
    first = F.coalesce(*entries) if isinstance(entries, list) else F.get(F.filter(entries, lambda e: e.isNotNull()), F.lit(0))
    return w.select("S_class", "names", "ords", "T_name", first.alias("first_entry"))


def _lead_key(x: F.Column) -> F.Column:
    # "o_p" texts compare first on "o_" ('_' sorts after every digit).
    return F.concat(x["ord"].cast("string"), F.lit("_"))


def with_leads(seqs: DataFrame) -> DataFrame:
    """The sequences with their lead shapelets: those whose order text is the smallest,
    i.e. whose positions open the sorted window when present."""
    lead = F.array_min(F.transform("steps", _lead_key))
    leads = F.transform(F.filter("steps", lambda x: _lead_key(x) == F.col("_lead")), lambda x: x["S_name"])
    return seqs.withColumn("_lead", lead).withColumn("leads", leads).drop("_lead")


def _first_position_max(pairs: DataFrame, items: DataFrame, tmap: DataFrame, salts: int | None) -> DataFrame:
    """General path: per variant, max over `pairs` of the first window position."""
    steps = join_bounded(pairs, items, SET_KEY, ["T_name"], salts)
    cells = tmap.filter("present = 1").select("S_class", "S_name", "T_name", "pmin_text")
    firsts = (
        steps.join(cells, ["S_class", "S_name", "T_name"])
        .groupBy("S_class", "names", "ords", "T_name")
        .agg(F.min(window_entry(F.col("ord"), F.col("pmin_text"))).alias("first_entry"))
    )
    return firsts.groupBy("S_class", "names", "ords").agg(F.max(entry_position(F.col("first_entry"))).alias("tas_p"))


# Rows of a table, at most, that is handed to every task to be looked up; more are shuffled.
LOOKUP_ROWS = 500_000


def _lookup(rows: DataFrame) -> DataFrame:
    """A kept table that sequences look up, handed to every task where it is counted small:
    adaptive execution would shuffle the sequences before it knows."""
    kept = keep(rows)
    return F.broadcast(kept) if kept.count() <= LOOKUP_ROWS else kept


def lead_tas(seqs: DataFrame, hits: DataFrame, cells: DataFrame, salts: int | None = None) -> DataFrame:
    """(S_class, set_key, lead, lead_p): the largest, over the own-class series where every
    shapelet of the set is present, of the smallest position-as-text of its shapelet `lead`."""
    complete = hits.filter("complete").select(*SET_KEY, "profile")
    lead_cells = join_bounded(complete, set_items(distinct_sets(seqs)).drop("set_size"), SET_KEY, ["profile"], salts)
    return (
        lead_cells.join(cells.select("S_class", "S_name", "profile", "own_first"), ["S_class", "S_name", "profile"])
        .groupBy(*SET_KEY, F.col("S_name").alias("lead"))
        .agg(F.max("own_first").alias("lead_p"))
    )


def general_tas(led: DataFrame, hits: DataFrame, profiles: DataFrame, tmap: DataFrame, salts: int | None = None) -> DataFrame | None:
    """(S_class, names, ords, any_p): the largest first window position of the variants over
    the own-class series that `lead_tas` leaves out: those where some shapelet of the set has
    no row, and all of them for tied leads. Only those variants are gathered; None without any."""
    own = profiles.filter(F.col("class_d") == F.col("S_class"))
    tied = led.filter(F.size("leads") > 1)
    partial_hits = hits.filter(~F.col("complete"))
    firsts = []
    if not partial_hits.isEmpty():
        partly = by_series(partial_hits, own, salts).select(*SET_KEY, "T_name")
        some = led.join(partial_hits.select(*SET_KEY).distinct(), SET_KEY, "left_semi")
        firsts.append(_first_position_max(partly, variant_items(some), tmap, salts))
    if not tied.isEmpty():
        any_ = by_series(hits.join(tied.select(*SET_KEY).distinct(), SET_KEY, "left_semi"), own, salts)
        firsts.append(_first_position_max(any_.select(*SET_KEY, "T_name"), variant_items(tied), tmap, salts))
    if not firsts:
        return None
    every = firsts[0] if len(firsts) == 1 else firsts[0].unionByName(firsts[1])
    return every.groupBy("S_class", "names", "ords").agg(F.max("tas_p").alias("any_p"))


def with_presence_tas(
    seqs: DataFrame, hits: DataFrame, profiles: DataFrame, cells: DataFrame, tmap: DataFrame, salts: int | None = None
) -> DataFrame:
    """A9 (presence): the sequences with `tas_p`, the max over matched own-class series of
    the first window position; one element, as the reference's live branch gives.

    Where every shapelet of the set is present in the series and the variant has
    a single lead shapelet, the first window position is that shapelet's
    smallest position-as-text, so the max only depends on (set, lead): it is
    computed once per (set, shapelet) from the profiles' cells and looked up by the
    sequences. Tied leads and partly present series take the general path."""
    led = with_leads(seqs)
    single = F.when(F.size("leads") == 1, F.get("leads", F.lit(0)))
    rows = led.select(*SET_KEY, "sid", "names", "ords", "n_steps", single.alias("lead"))
    rows = rows.join(_lookup(lead_tas(seqs, hits, cells, salts)), [*SET_KEY, "lead"], "left")
    general = general_tas(led, hits, profiles, tmap, salts)
    if general is not None:
        rows = rows.join(_lookup(general), ["S_class", "names", "ords"], "left").withColumn("lead_p", F.greatest("lead_p", "any_p"))
    return rows.withColumnRenamed("lead_p", "tas_p").drop("lead", "any_p")


def verdict_presence(
    seqs: DataFrame,
    dataset: DataFrame,
    tmap: DataFrame,
    profiles: DataFrame,
    cells: DataFrame,
    hits: DataFrame,
    salts: int | None = None,
) -> DataFrame:
    """One verdict per (S_class, source series, subset): counts, accuracy, TAS.
    `hits`: the found rows of the profile matrix."""
    conf = _lookup(presence_confusion(seqs, hits, profiles, dataset))
    return (
        with_presence_tas(seqs, hits, profiles, cells, tmap, salts)
        .join(conf, SET_KEY)
        .select(
            "S_class",
            "sid",
            "names",
            "ords",
            "n_steps",
            "tp",
            "fn",
            "fp",
            "tn",
            "accuracy",
            F.when(F.col("tas_p").isNull(), F.array().cast("array<bigint>"))
            .otherwise(F.array(F.col("tas_p")))
            .alias("tas"),
        )
    )


# ---------------------------------------------------------------- ordered --


def ordered_sequences(seqs: DataFrame) -> DataFrame:
    """Distinct ordered sequences (ruling: the reference keeps duplicates): (S_class, names,
    n_steps, prefix, S_name), told from the names alone; `S_name` is the last shapelet."""
    keys = F.split("names", LIST)
    prefix = F.array_join(F.slice(keys, F.lit(1), F.size(keys) - 1), LIST)
    return seqs.select("S_class", "names").distinct().select(
        "S_class", "names", F.size(keys).alias("n_steps"), prefix.alias("prefix"), F.element_at(keys, -1).alias("S_name")
    )


# Sequences that are handed to every task when a match is extended; more are shuffled.
BROADCAST_SEQUENCES = 500_000

# Positions that the shapelets of a class may list in a series for its matches to be made
# beside them; a longer series is looked up block by block.
GATHERED = 4096

# Series whose matches one task makes.
TASK_SERIES = 2000


@dataclass
class Ordered:
    """The search for ordered matches: `sequences` (seq, S_class, names, n_steps), `matches`
    (seq, T_name, class_d, own, tas); `own`: the series is of the sequence's class. `rounds`:
    steps of the longest sequence. `bounded`: the sequences may be handed to every task."""

    sequences: DataFrame
    matches: DataFrame
    rounds: int
    bounded: bool

    def named(self, shown: Callable[[DataFrame], DataFrame] = lambda sequences: sequences) -> DataFrame:
        """(S_class, names, n_steps, T_name, class_d, tas): the matches with their names.
        `shown` may render the sequences, before their matches are joined."""
        sequences = shown(self.sequences)
        named = self.matches.join(F.broadcast(sequences) if self.bounded else sequences, "seq")
        return named.select("S_class", "names", "n_steps", "T_name", "class_d", "tas")

    def combined(self) -> DataFrame:
        """(S_class, names, n_steps, tp, n_found, tas) of every sequence, `tas` NULL
        without a match; aggregated by number, named afterwards."""
        tas = combine_tas(self.matches, ["seq"], self.rounds)
        return self.sequences.join(tas, "seq", "left").drop("seq").fillna(0, ["tp", "n_found"])


def _gathered(cells: DataFrame, blocks: DataFrame, n_series: int) -> DataFrame:
    """(T_name, class_d, own, by_place): one row per (class, series) with the positions of its
    cells, kept and dealt by number of rows, as each makes many matches."""
    listed = blocks.filter(F.size("pos") > 0).select("S_class", "S_name", "T_name", "pos")
    met = cells.join(listed, ["S_class", "S_name", "T_name"])
    tasks = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_series // TASK_SERIES))
    key = ["S_class", "T_name", "class_d", "own"]
    dealt = met.select(*key, "shp", "place", "pos").repartition(tasks, "S_class", "T_name")
    lists = dealt.groupBy(*key, "shp", "place").agg(F.flatten(F.collect_list("pos")).alias("pos"))
    by_place = F.map_from_entries(F.collect_list(F.struct("place", F.struct("shp", "pos"))))
    return keep(lists.groupBy(*key).agg(by_place.alias("by_place")).drop("S_class"))


def _first_states(gathered: DataFrame) -> DataFrame:
    """The matches of one step, with the lists of their series by place."""
    listed = F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("by_place"))), lambda i: F.col("by_place")[i]["pos"])
    firsts = F.transform(F.map_values("by_place"), lambda e: F.struct(e["shp"].alias("seq"), F.array_min(e["pos"]).alias("cur")))
    # an outer generator: the plain one would be given a filter that makes its array a second time
    rows = gathered.select("T_name", "class_d", "own", listed.alias("listed"), F.inline_outer(firsts))
    return rows.select("seq", "T_name", "class_d", "own", "cur", F.array("cur").alias("tas"), "listed", F.lit(True).alias("new"))


def _grown_beside(state: DataFrame, added: DataFrame) -> DataFrame:
    """The states and, `new`, those that they grow into: made beside the series' lists, with
    the extensions (two numbers each) handed to every task; no state is shuffled."""
    ways = added.groupBy("seq").agg(F.collect_list(F.struct(F.col("longer").alias("seq"), "place")).alias("_ways"))
    reached = lambda w: F.array_min(F.filter(F.get("listed", w["place"]), lambda p: p >= F.col("cur")))
    grown = F.transform("_ways", lambda w: F.struct(w["seq"].alias("seq"), reached(w).alias("cur"), F.lit(True).alias("new")))
    grown = F.filter(grown, lambda x: x["cur"].isNotNull())
    itself = F.array(F.struct("seq", "cur", F.lit(False).alias("new")))
    every = F.concat(itself, F.coalesce(grown, F.slice(itself, 1, 0)))
    out = state.drop("new").join(F.broadcast(ways), "seq", "left").withColumn("_every", every)
    out = out.select("T_name", "class_d", "own", "tas", "listed", F.inline_outer("_every"))
    return out.withColumns({"tas": F.when(F.col("new"), F.concat("tas", F.array("cur"))).otherwise(F.col("tas")), "listed": F.when(F.col("new"), F.col("listed"))})


def search_ordered(
    seqs: DataFrame,
    tmap: DataFrame,
    blocks: DataFrame,
    salts: int | None = None,
    block: int = POSITION_BLOCK,
    bound: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> Ordered:
    """The ordered sequences found in each series, with their chain `tas`
    (step 1 = smallest position, each later step = smallest position >= the
    previous one).

    Every prefix of an enumerated sequence is one itself, so the matches of
    length k are the states from which those of length k + 1 grow: each match
    meets the sequences that add one shapelet. Prefixes are shared, a pair that
    fails is never seen again. A vetoed pair has no cell.

    The positions of a (class, series) are gathered once, in one row, and its states
    are made beside them, round by round in one pass (`_grown_beside`): only what the
    series list is shuffled, never a state. Where that row would hold more than
    `GATHERED` positions, or the sequences are too many to hand to every task, a state
    meets the added shapelet's block of the position reached, which holds the smallest
    position >= it or names the one after: no list is longer than a block; the blocks
    are bucketed by the key of the lookup, so that a round exchanges its states alone,
    and each round's states are pinned. Sequences and shapelets (the sequences of one
    step) are numbered once, in tables pinned in the shared folder.
    `bound(states, sequences)` may say which sequences (seq) are worth extending."""
    numbered = pinned(ordered_sequences(seqs).withColumn("seq", F.monotonically_increasing_id()), "ordered-sequences")
    known = numbered.agg(F.count(F.lit(1)).alias("n"), F.max("n_steps").alias("longest")).first()
    bounded, rounds = known["n"] <= BROADCAST_SEQUENCES, known["longest"] or 0
    series = pinned(tmap.select("T_name", "class_d").distinct().withColumn("ser", F.monotonically_increasing_id()), "ordered-series")

    by_name = Window.partitionBy("S_class").orderBy("S_name")  # one row a shapelet
    single = numbered.filter("n_steps = 1").select("S_class", "S_name", F.col("seq").alias("shp"), (F.row_number().over(by_name) - 1).alias("place"))
    parents = numbered.select("S_class", F.col("names").alias("prefix"), F.col("seq").alias("parent"))
    longer = numbered.filter("n_steps > 1").join(single, ["S_class", "S_name"]).join(parents, ["S_class", "prefix"])
    longer = pinned(longer.select("parent", "seq", "shp", "place", "n_steps"), "ordered-extensions")
    own = F.coalesce(F.col("class_d") == F.col("S_class"), F.lit(False)).alias("own")
    present = tmap.filter("present = 1 AND vetoed = 0").join(single, ["S_class", "S_name"])
    cells = present.select("S_class", "S_name", "T_name", "class_d", "shp", "place", own, "pmin")

    series_key = ["S_class", "T_name"]
    if bounded:
        long = blocks.groupBy(*series_key).agg(F.sum(F.size("pos")).alias("n")).filter(F.col("n") > GATHERED).select(*series_key)
        long = pinned(long, "ordered-long")
        has_long = not long.isEmpty()
        short = cells.join(long, series_key, "left_anti") if has_long else cells
        near = _first_states(_gathered(short.drop("pmin"), blocks, series.count()))
    else:
        long, has_long, near = None, True, None
    if has_long:
        s = series.select(F.col("T_name").alias("_t"), F.col("class_d").alias("_c"), "ser")
        far_cells = cells if long is None else cells.join(long, series_key, "left_semi")
        far_cells = far_cells.join(s, (F.col("T_name") == F.col("_t")) & F.col("class_d").eqNullSafe(F.col("_c")))
        far_cells = pinned(far_cells.select("S_class", "S_name", "T_name", "shp", "ser", "own", "pmin"), "ordered-cells")
        key = ["shp", "ser", "blk"]
        lookup = blocks.join(far_cells.select("S_class", "S_name", "T_name", "shp", "ser"), ["S_class", "S_name", "T_name"]).select(*key, "pos", "after")
        lookup = pinned(lookup, "ordered-blocks", key)
        state = far_cells.select(F.col("shp").alias("seq"), "ser", "own", F.col("pmin").alias("cur"), F.array("pmin").alias("tas"))
        far = state

    for k in range(2, rounds + 1):
        added = longer.filter(F.col("n_steps") == k).select(F.col("parent").alias("seq"), F.col("seq").alias("longer"), "shp", "place")
        if bound is not None:
            states = [x.select("seq", "own") for x in ([near.filter("new")] if bounded else []) + ([state] if has_long else [])]
            states = states[0] if len(states) == 1 else states[0].unionByName(states[1])
            # read by the later rounds, too, which make the earlier states again
            added = pinned(added.join(bound(states, numbered), "seq", "left_semi"), "ordered-worth")
        if bounded:
            near = _grown_beside(near, added)
        if not has_long:
            continue
        if bounded:
            probe = state.join(F.broadcast(added), "seq")
        else:
            probe = join_bounded(state, added, ["seq"], ["ser"], salts)
        probe = probe.withColumn("blk", F.floor(F.col("cur") / block))
        reached = F.coalesce(F.array_min(F.filter("pos", lambda p: p >= F.col("cur"))), F.col("after"))
        grown = (
            probe.join(lookup, key)
            .withColumn("cur", reached)
            .filter(F.col("cur").isNotNull())
            .select(F.col("longer").alias("seq"), "ser", "own", "cur", F.concat("tas", F.array("cur")).alias("tas"))
        )
        state = pinned(grown, "ordered-states")  # read by the next round and by the result
        far = far.unionByName(state)

    columns = ["seq", "T_name", "class_d", "own", "tas"]
    parts = ([near.select(*columns)] if bounded else []) + ([far.join(series, "ser").select(*columns)] if has_long else [])
    matches = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return Ordered(numbered.select("seq", "S_class", "names", "n_steps"), matches, rounds, bounded)


def ordered_match(
    seqs: DataFrame,
    tmap: DataFrame,
    blocks: DataFrame,
    salts: int | None = None,
    block: int = POSITION_BLOCK,
) -> DataFrame:
    """(S_class, names, n_steps, T_name, class_d, tas), see `search_ordered`."""
    return search_ordered(seqs, tmap, blocks, salts, block).named()


def combine_tas(matches: DataFrame, keys: list[str], width: int) -> DataFrame:
    """A9 (ordered): position-wise max of the chains of matched own-class series, with
    the numbers of matches of the own class (`tp`) and of all (`n_found`). `width`:
    steps of the longest sequence. One maximum for each step, so a hash aggregation
    with a partial step that neither explodes nor gathers the chains."""
    steps = [F.max(F.when(F.col("own"), F.get("tas", F.lit(i)))).alias(f"_{i}") for i in range(width)]
    return matches.groupBy(*keys).agg(F.count_if("own").alias("tp"), F.count(F.lit(1)).alias("n_found"), *steps).select(
        *keys,
        "tp",
        "n_found",
        F.filter(F.array(*[f"_{i}" for i in range(width)]).cast("array<bigint>"), lambda p: p.isNotNull()).alias("tas"),
    )


def _ordered_verdicts(found: Ordered, dataset: DataFrame) -> DataFrame:
    keys = ["S_class", "names"]
    none = F.array().cast("array<bigint>")
    counts = found.combined().withColumn("tas", F.coalesce("tas", none))
    return confusion(counts, [*keys, "n_steps", "tas"], dataset).select(
        *keys, "n_steps", "tp", "fn", "fp", "tn", "accuracy", "tas"
    )


def verdict_ordered(
    seqs: DataFrame, dataset: DataFrame, tmap: DataFrame, blocks: DataFrame, salts: int | None = None
) -> DataFrame:
    """One verdict per (S_class, ordered names)."""
    return _ordered_verdicts(search_ordered(seqs, tmap, blocks, salts), dataset)


def search_accurate(
    seqs: DataFrame, dataset: DataFrame, tmap: DataFrame, blocks: DataFrame, least: float, salts: int | None = None
) -> Ordered:
    """The search with F3's threshold inside (branch and bound).

    A match of an extension is one of its prefix, too, so an extension has at most the
    prefix's tp, and at most all series of other classes as tn. Where that falls short
    of `least`, the prefix is not extended. The matches of every sequence that was
    reached are complete."""
    total = dataset.count()
    others = dataset.groupBy(F.col("class_d").alias("S_class")).agg((F.lit(total) - F.count(F.lit(1))).alias("others"))

    def bound(state: DataFrame, numbered: DataFrame) -> DataFrame:
        own = state.groupBy("seq").agg(F.count_if("own").alias("tp"))
        best = F.col("tp") + F.coalesce("others", F.lit(total))
        met = own.join(numbered.select("seq", "S_class"), "seq").join(others, "S_class", "left")
        return met.filter(best / F.lit(max(total, 1)) >= least).select("seq")

    return search_ordered(seqs, tmap, blocks, salts, bound=bound)


def accurate_ordered(
    seqs: DataFrame, dataset: DataFrame, tmap: DataFrame, blocks: DataFrame, least: float, salts: int | None = None
) -> DataFrame:
    """F3 (ordered): the verdicts with an accuracy of at least `least`. A sequence that was
    not reached counts as unmatched, which is below `least`, too."""
    found = search_accurate(seqs, dataset, tmap, blocks, least, salts)
    return _ordered_verdicts(found, dataset).filter(F.col("accuracy") >= least)


def confusion_per_sequence(seqs: DataFrame, hits: DataFrame, profiles: DataFrame, dataset: DataFrame) -> DataFrame:
    """A7/A8 (presence): counts and accuracy per (S_class, source series, subset), without TAS."""
    return seqs.select(*SET_KEY, "sid", "n_steps").join(_lookup(presence_confusion(seqs, hits, profiles, dataset)), SET_KEY)


def verdict_profile(
    verdicts: DataFrame,
    seqs: DataFrame,
    matrix: DataFrame,
    blocks: DataFrame,
    shown: Callable[[DataFrame], DataFrame] = lambda verdicts: verdicts,
    text: bool = False,
) -> DataFrame:
    """X5 with its profile column, in long form: one row per (sequence, series it is
    found in), the time window as `window` beside the sequence's accuracy and TAS.
    `shown` may render the verdicts, before their series are joined; `text`: as in
    `sequence_profile`.

    A window is made once for all sequences of a variant (the source series that gave
    it), which are gathered in runs."""
    variant = ["S_class", "names", "ords"]
    v = verdicts.select("S_class", "sid", "names", "ords", "accuracy", "tas")
    sources = gathered_runs(pinned(shown(v), "verdicts"), variant, ["sid", "accuracy", "tas"]).withColumnRenamed("members", "sources")
    runs = _in_runs(_variants(seqs).join(sources, variant), _prefix_part, ["names", "ords", "sources"], RUN, F.size("sources"))
    weight = F.aggregate("members", F.lit(0), lambda n, m: n + F.size(m["sources"]))
    w, entries = _made(_with_values(runs, matrix, _position_texts(blocks), False, weight), seqs, _prefix_entries)
    rows = w.select("S_class", "names", "ords", "T_name", "n_shapelets", _window(entries, text), "sources")
    return rows.select("S_class", F.inline("sources"), "names", "ords", "T_name", "n_shapelets", "window")
