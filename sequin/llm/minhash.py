"""Operator 2, near-duplicates by MinHash and a multi-index Hamming join.

A document is its set of distinct 5-word shingles (A-Z lower-cased; a shorter
text is one shingle). Documents with 100 * |A and B| >= percent * |A or B| are
linked and the smallest id of a connected component stays. ``percent`` is 85 for
the query op2 and the pipeline's stage. Figures below are for 85.

* Equal sets are one class from the start, so copies are never paired.
* A class has a signature of ``SYMBOLS`` minima of ``b`` = 16 bits each; the
  distance of two signatures is the number of symbols that differ. At the
  threshold a symbol differs with probability 0.15; more than ``RADIUS`` = 23 of
  64 differ with probability 9e-6. ``chunks_for`` takes the least radius that
  leaves out at most 1e-5: at 80 it is 29, by 15 chunks, and leaves out 1.2e-6.
* Multi-index join: signatures are split into ``CHUNKS`` = 12 chunks. By
  pigeonhole, of 23 errors some chunk has at most one (12 * 2 > 23). Allowed
  chunk errors are enumerated by leaving out each symbol of a chunk in turn: the
  64 keys (chunk, symbol left out, hash of the rest). Two signatures within the
  radius share a key, without exception.
* Links are confirmed on the full sets, in rounds. First each class meets one
  leader of its keys, the class whose keys are the most shared: the original of
  a large group of near copies, which thereby becomes one component and is never
  paired out. Then, as only links between components matter, every pair of
  classes that shares a key and lies in different components is looked at, if it
  can have the overlap at all: two sets whose overlap is large enough share one
  of the rarest members of either (the prefix filter: of n members the
  n - ceil(0.85 n) + 1 rarest of the larger set, n - ceil(1.7 / 1.85 n) + 1 of
  the smaller, with room for the overlap behind the first one they share), where
  the pair is met. What passes the size and distance bounds is confirmed.
  Rarity is read from a table of ``COUNTERS`` counters, a bounded broadcast; any
  order is correct, a good one leaves fewer pairs.
* Components: alternating large-star and small-star steps until nothing changes.

Texts that pass a filter of the classes with a shared key shuffle once, to meet
their class; only their sets are kept, in the shared folder, for the rounds.

Edge cases: a null text, or one without words, has no shingle, links with
nothing and is its own component; a null id never is the smallest, and of a
component of null ids alone the text with the least hash stays; rows that repeat
id and text belong to one class and stay or go alike; of an id with several texts
``keep`` drops those that are near copies, not the others; an empty table gives
no row.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import flat, parts, salted_lookup, settle, spent, stored

WORDS, PERCENT = 5, 85
SYMBOLS = 64
#: Probability, at most, that a pair at the threshold lies beyond the radius.
MISS = 1e-5


def chunks_for(percent: int) -> int:
    """The least number of chunks whose radius, 2 * chunks - 1, misses a pair at ``percent`` with at most ``MISS``."""
    q = 1 - percent / 100
    for chunks in range(1, SYMBOLS // 2 + 1):
        if sum(math.comb(SYMBOLS, k) * q**k * (1 - q) ** (SYMBOLS - k) for k in range(2 * chunks, SYMBOLS + 1)) <= MISS:
            return chunks
    raise ValueError(f"{SYMBOLS} symbols cannot find pairs at {percent} %")


CHUNKS = chunks_for(PERCENT)
RADIUS = 2 * CHUNKS - 1
_U = np.uint64

_odd = W.mix(np.arange(1, SYMBOLS + 1, dtype=_U) * _U(0xA24BAED4963EE407))
_MULTIPLY = (_odd >> _U(32)).astype(np.uint32) | np.uint32(1)
_ADD = _odd.astype(np.uint32)
#: Cells, at most, of the filter of the texts that are needed again: 2^25 bits.
FILTER_BITS = 25
#: Members of a set that its rows hold, to meet another set once.
HEAD = 8
#: Classes of one signature, at most, that stand beside a leader.
TWINS = 16
#: Counters of shingles by which rarity is judged (4 MB).
COUNTERS = 1 << 20


def shingle_sets(column: pa.Array, size: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    buf, offs = flat(column)
    buf = W.LOWER[buf]
    start, end, doc = W.spans(buf, offs)
    h = W.hashes(buf, start, end)
    n = len(offs) - 1
    bound = np.searchsorted(doc, np.arange(n + 1))
    rolled = h
    for k in range(1, size):
        rolled = W.mix(rolled[: max(len(h) - k, 0)]) + h[k:]
    rolled = W.mix(rolled)
    out = []
    for lo, hi in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        if hi - lo >= size:
            out.append(np.unique(rolled[lo : hi - size + 1]))
        elif hi > lo:
            whole = np.array([hi - lo], _U)
            for k in range(lo, hi):
                whole = W.mix(whole + h[k : k + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, _U))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """``SYMBOLS`` 16-bit symbols of a non-empty set."""
    x = (shingles >> _U(32)).astype(np.uint32)
    low = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        low = np.minimum(low, (x[at : at + 2048, None] * _MULTIPLY + _ADD).min(axis=0))
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def chunk_keys(signatures: np.ndarray, chunks: int = CHUNKS) -> np.ndarray:
    """For each row of symbols its ``SYMBOLS`` keys: the chunk without one symbol."""
    chunk_of = np.arange(SYMBOLS) * chunks // SYMBOLS
    place = W.mix(np.arange(SYMBOLS, dtype=_U) + _U(77))
    each = W.mix(signatures.astype(_U) + place)
    whole = np.zeros((len(signatures), chunks), _U)
    np.add.at(whole, (slice(None), chunk_of), each)
    return W.mix((whole[:, chunk_of] - each) ^ place)


def _set_hash(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set: sums of two mixes of its members."""
    with np.errstate(over="ignore"):
        a, b = W.mix(shingles).sum(dtype=_U), W.mix(shingles ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U)
    return int(np.array(a).view(np.int64)), int(np.array(b).view(np.int64))


def signatures(docs: DataFrame, id: str, text: str) -> DataFrame:
    """id, t (hash of the text: with the id, the row), n (set size), s1, s2 (hash of the set), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            sets = shingle_sets(batch.column("text"))
            hashed = [_set_hash(s) for s in sets]
            sig = [signature(s).tobytes() if len(s) else b"" for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("t"), pa.array(list(map(len, sets)), pa.int64()), pa.array([x for x, _ in hashed], pa.int64()), pa.array([x for _, x in hashed], pa.int64()), pa.array(sig, pa.binary())],
                names=["id", "t", "n", "s1", "s2", "sig"],
            )

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("t"))
    more = [T.StructField("t", T.LongType()), T.StructField("n", T.LongType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), T.StructField("sig", T.BinaryType())]
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], *more]))


def keys(classes: DataFrame, chunks: int = CHUNKS) -> DataFrame:
    """key, node: the multi-index entries of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
                key = chunk_keys(sig, chunks).view(np.int64).ravel()
                node = np.repeat(part.column("node").to_numpy(), SYMBOLS)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node)], names=["key", "node"])

    return classes.select("node", "sig").mapInArrow(run, "key long, node long")


def _cell(bits: int) -> Column:
    return F.pmod(F.xxhash64("id", "t"), F.lit(1 << bits))


def _maybe(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose (id, t) may be among the needed ones: a filter of one bit a
    cell, gathered as bitmaps of 2^15 cells, of 2^``FILTER_BITS`` cells at most (4 MB)."""
    bits = min(FILTER_BITS, max(15, (8 * needed.count()).bit_length()))
    cell = _cell(bits)
    maps = needed.groupBy(F.floor(cell / 32768).cast("int").alias("block")).agg(F.bitmap_construct_agg(cell % 32768).alias("bits"))
    plane = np.zeros(1 << (bits - 3), np.uint8)
    for r in maps.collect():  # at most 2^(FILTER_BITS - 15) rows of 4 KB
        plane[r["block"] * 4096 : (r["block"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(plane)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("cell").to_numpy()
            yield batch.filter(pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0))

    return texts.withColumn("cell", cell).mapInArrow(run, T.StructType([*texts.schema.fields, T.StructField("cell", T.LongType())])).drop("cell")


def _sets(docs: DataFrame, needed: DataFrame, id: str, text: str) -> DataFrame:
    """node, shingles (bytes of sorted hashes) for the classes in ``needed`` (node, id, t, s1, s2).

    Only texts that pass a filter of the needed rows shuffle; (id, t) tells texts of one id,
    or of none, apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in parts(batches, "text"):
            nodes, out = [], []
            for node, s1, s2, own in zip(*(batch.column(c).to_pylist() for c in ("node", "s1", "s2")), shingle_sets(batch.column("text")), strict=True):
                if node != last and _set_hash(own) == (s1, s2):  # rows may repeat id and text
                    nodes.append(node)
                    out.append(own.tobytes())
                    last = node
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(out, pa.binary())], names=["node", "shingles"])

    texts = _maybe(docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("t")), needed)
    n = needed.withColumnsRenamed({"id": "_id", "t": "_t"})
    met = texts.join(n, texts["id"].eqNullSafe(n["_id"]) & (texts["t"] == n["_t"])).select("node", "s1", "s2", "text")
    return met.mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def near(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) whose sizes allow a link and whose signatures are within the radius."""
    radius = 2 * chunks_for(percent) - 1
    own = classes.select("node", "n", "sig")
    a, b = own.toDF("a", "n_a", "sig_a"), own.toDF("b", "n_b", "sig_b")
    met = pairs.join(a, "a").join(b, "b").filter((F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for c in ("sig_a", "sig_b"))
            close = pa.array((x != y).sum(axis=1) <= radius)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(close), batch.column("b").filter(close)], names=["a", "b"])

    return met.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs that are linked, by their full sets. A class in many pairs is spread over salts."""
    left, right = sets.toDF("a", "x"), sets.toDF("b", "y")
    met = salted_lookup(salted_lookup(pairs, left, ["a"], F.col("b"), 16), right, ["b"], F.col("a"), 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_py(), _U) for c in ("x", "y"))
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[at] == y).sum())
                out.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(out, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    return met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def rarity(sets: DataFrame) -> np.ndarray:
    """How many of the sets have a shingle of each counter."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for x in batch.column("shingles").to_pylist():
                np.add.at(counts, _counter(np.frombuffer(x, _U)), 1)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(counts.astype(np.uint32).tobytes(), 1)], pa.binary())], names=["counts"])

    def add(a: bytes, b: bytes) -> bytes:
        x, y = (np.frombuffer(zlib.decompress(z), np.uint32) for z in (a, b))
        return zlib.compress((x + np.minimum(y, ~x)).tobytes(), 1)

    tables = sets.select("shingles").mapInArrow(local, "counts binary").rdd.map(lambda r: bytes(r[0]))
    if not tables.getNumPartitions():
        return np.zeros(COUNTERS, np.uint32)
    return np.frombuffer(zlib.decompress(tables.treeReduce(add, depth=3)), np.uint32)


def _counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles & _U(COUNTERS - 1)).astype(np.int64)


def prefixes(sets: DataFrame, counts: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """node, n, token, place: the rarest members of each set, in order; ``short`` marks those that count as the smaller set."""
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, raw in zip(batch.column("node").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                x = np.frombuffer(raw, _U)
                n = len(x)
                long = n - -(-percent * n // 100) + 1
                short = n - -(-2 * percent * n // (100 + percent)) + 1
                token = x[np.lexsort((x, shared.value[_counter(x)]))[:long]].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(long, node)), pa.array(np.full(long, n)), pa.array(token), pa.array(np.arange(long) < short), pa.array(np.arange(long))], names=["node", "n", "token", "short", "place"])

    return sets.select("node", "shingles").mapInArrow(run, "node long, n long, token long, short boolean, place long")


def rare_members(open_: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rarest members of the sets in ``open_`` that sets of several components have.

    ``open_``: node, root, keys (its keys that lie in several components). A row holds 32
    bits of each of its set's keys and the first ``HEAD`` such members of its set.
    """
    own = sets.join(open_.select("node"), "node", "left_semi")
    tokens = prefixes(own, rarity(own), percent).join(open_.select("node", "root"), "node")
    held = tokens.groupBy("token").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 != r2").select("token")
    # a set's prefix has some 15 % of its members
    own = tokens.join(held, "token").groupBy("node", "n", "root").agg(F.array_sort(F.collect_list(F.struct("place", "token", "short"))).alias("all"))
    head = lambda some: F.transform(F.slice(some, 1, HEAD), lambda x: x["token"])
    # 32 bits of a key: that two sets share one is asked to leave pairs out, not to let them in
    short_keys = F.transform("keys", lambda k: F.hash(k))
    own = own.join(open_.select("node", short_keys.alias("keys")), "node")
    own = own.select("node", "n", "root", "keys", head(F.col("all")).alias("head_x"), head(F.filter("all", lambda x: x["short"])).alias("head_y"), F.explode("all").alias("t"))
    return own.select("node", "n", "root", "keys", "head_x", "head_y", "t.token", "t.place", "t.short")


def across(open_: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of classes in different components that share a key and could have the overlap.

    A pair is met at the first rare member that both sets have (``rare_members``). Only
    pairs without a common member among the first ``HEAD`` may be met more than once.
    """
    tokens = stored(rare_members(open_, sets, percent), "op2-tokens")
    settle(open_.sparkSession)
    side = lambda rows, s: rows.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "root", "keys", "place")], f"head_{s}")
    x, y = side(tokens, "x"), side(tokens.filter("short"), "y")
    met_before = F.array_intersect("head_x", "head_y")  # in the order of the first
    once = (F.size(met_before) == 0) | (F.get(met_before, F.lit(0)) == x["token"])
    larger = (F.col("n_x") > F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("node_x") > F.col("node_y")))
    sizes = F.col("n_y") * 100 >= F.col("n_x") * percent
    # from their first common member on, the sets must have room for the overlap
    room = F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y")) * (100 + percent) >= (F.col("n_x") + F.col("n_y")) * percent
    met = x.join(y, (x["token"] == y["token"]) & (F.col("root_x") != F.col("root_y")) & larger & sizes & room & once & F.arrays_overlap("keys_x", "keys_y"))
    pairs = stored(met.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct(), "op2-pairs")
    spent(tokens)
    settle(open_.sparkSession)
    return pairs


def twins(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) with, instead of a, each of up to ``TWINS`` other classes of a's signature."""
    same = Window.partitionBy("sig").orderBy("s1", "s2")
    few = classes.select("sig", "s1", "s2", "node").withColumn("_i", F.row_number().over(same)).filter(F.col("_i") <= TWINS + 1)
    leaders = pairs.select("a").distinct().join(classes.select(F.col("node").alias("a"), "sig"), "a")
    beside = leaders.join(few.select("sig", F.col("node").alias("twin")), "sig").filter("twin != a").select("a", "twin")
    return pairs.join(beside, "a").filter("twin != b").select(F.col("twin").alias("a"), "b")


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) for the nodes of ``links`` (a, b)."""
    edges = stored(links.filter("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "op2-edges")
    mark = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    while mark[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above u move to the least of u's surroundings
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small star: u and its neighbours below move to the least of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        below = large.join(least, "hi").filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        before, edges = edges, stored(below.union(least.select("hi", F.col("m").alias("lo"))).distinct(), "op2-edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        spent(before)
        if now == mark:
            break
        mark = now
    roots = edges.groupBy("hi").agg(F.min("lo").alias("root")).select(F.col("hi").alias("node"), "root")
    return roots.union(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).join(roots.select("node"), "node", "left_anti").distinct())


def decisions(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept."""
    return _decided(docs, id, text, percent).drop("_t")


def _decided(docs: DataFrame, id: str, text: str, percent: int) -> DataFrame:
    """The decisions with ``_t``, the hash of the text."""
    signed = stored(signatures(docs, id, text), "op2-signatures")
    classes = stored(
        signed.filter("n > 0")
        .groupBy("s1", "s2")
        .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t")).alias("row"), F.min("t").alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig"))
        .select("s1", "s2", "row.id", "row.t", "least", "n", "sig", F.monotonically_increasing_id().alias("node")),
        "op2-classes",
    )
    entries = keys(classes, chunks_for(percent))
    many = entries.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    shared = stored(entries.join(many, "key"), "op2-shared")  # the keys that two classes or more have
    settle(docs.sparkSession)
    needed = shared.select("node").distinct().join(classes.select("node", "id", "t", "s1", "s2"), "node")
    sets = stored(_sets(docs, needed, id, text), "op2-sets")
    settle(docs.sparkSession)

    # round 1: every class with one leader, the one of most of its keys
    popular = shared.groupBy("node").agg(F.sum("m").alias("popular"))
    ranked = shared.select("key", "node").join(popular, "node")
    leaders = ranked.groupBy("key").agg(F.max(F.struct("popular", "node")).alias("top")).select("key", F.col("top.node").alias("leader"))
    votes = shared.select("key", "node").join(leaders, "key").filter("leader != node").groupBy("node", "leader").agg(F.count("*").alias("m"))
    first = votes.groupBy("node").agg(F.max(F.struct("m", "leader")).alias("best")).select(F.col("best.leader").alias("a"), F.col("node").alias("b"))
    first = stored(first, "op2-first")
    led = stored(confirmed(near(first, classes, percent), sets, percent), "op2-links")
    rest = twins(first.join(led, ["a", "b"], "left_anti"), classes)
    beside = stored(confirmed(near(rest, classes, percent), sets, percent), "op2-links")
    spent(first)
    links = led.union(beside)
    found = stored(components(links), "op2-components")
    settle(docs.sparkSession)

    # round 2: pairs within a key and between components
    placed = shared.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 != r2").select("key")
    # a class has at most SYMBOLS keys
    open_ = stored(placed.join(mixed, "key").groupBy("node", "root").agg(F.collect_set("key").alias("keys")), "op2-open")
    spent(shared, found)
    pairs = across(open_, sets, percent)
    spent(open_)
    more = stored(confirmed(near(pairs, classes, percent), sets, percent), "op2-links")
    spent(pairs, sets)
    roots = components(links.union(more))
    spent(led, beside, more)
    settle(docs.sparkSession)

    groups = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = groups.groupBy("root").agg(F.min("id").alias("component_id"), F.min("least").alias("least"))
    named = groups.select("s1", "s2", "root").join(least, "root").select("s1", "s2", "component_id", "least")
    # the salt takes the text, too: rows of null id spread
    linked = salted_lookup(signed.filter("n > 0"), named, ["s1", "s2"], F.struct("id", "t")).select("id", "t", "n", "component_id", "least")
    alone = signed.filter("n = 0").select("id", "t", "n", F.col("id").alias("component_id"), F.col("t").alias("least"))
    out = linked.unionByName(alone)
    kept = F.col("id").eqNullSafe(F.col("component_id")) & (F.col("id").isNotNull() | (F.col("t") == F.col("least")))
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), F.col("t").alias("_t"))


def keep(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents that stay, with all their columns."""
    gone = _decided(docs, id, text, percent).filter(~F.col("kept")).select(F.col(id).alias("_id"), "_t").distinct()
    return docs.join(gone, F.col(id).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_t")), "left_anti")
