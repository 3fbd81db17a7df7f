"""Operator 1, mixing sources to target weights, with DataFrame functions only.

* Targets: sources take the weights in turn (code point order, null last) and
  share the total by weight; no target exceeds ``max_passes`` times its source,
  the excess goes to the others by weight. The fixed point is
  ``min(max_passes * size, level * weight)``; the level follows from running
  sums over the sources in order of ``size / weight``.
* Documents of a source are shuffled by the MD5 of seed and id and laid end to
  end; the source's stream repeats up to ``max_passes`` times and is cut into
  blocks of ``block`` words, at its target the last time.
* Schedule: slot n is the point ``n * phi mod 1`` (in whole numbers modulo
  2^31). The point falls into one source's share of the cumulative targets; the
  slot's rank among the source's slots is the number of the block it takes. The
  points deal slots by share, to within a few: the last blocks of a source that
  its points do not reach, and all blocks of a source too small for any, take
  slots numbered on after the schedule, so that every source meets its target.
* Slots join blocks on (source, block). Running sums and ranks work in chunks
  (of the hash, of the slot numbers), so no source is one task's work.

Edge cases: a null text has size 0 and takes nothing; a null id or source is a
value of its own; rows that repeat an id are separate documents (identical rows
are interchangeable); an empty table, or one without words, gives targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, word_count

#: 2^31 / golden ratio, made odd: n * STEP mod 2^31 runs through all 2^31 points.
STEP, POINTS = 1327217885, 1 << 31
#: Cells of the unit interval by which slots find their source.
CELLS = 4096
#: Slots whose ranks are taken together.
SLOT_CHUNK = 512
BLOCK = 256
MAX_PASSES = 3


def sizes(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 1) -> DataFrame:
    """id, source, size and shuffle key of every document (the only read of the texts)."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))))
    return docs.select(F.col(id).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), key.alias("key"))


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_passes: int = MAX_PASSES) -> DataFrame:
    """One row per source: source, source_size, weight, target, from, to (share of the total).

    The windows run over the list of sources, one short row each.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    each = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight).withColumn("ceiling", F.col("source_size") * F.lit(float(max_passes)))
    order = [F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.col("total") - F.col("full")) / (F.col("weights") - F.col("used"))
    each = (
        each.withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("weights", F.sum("weight").over(every))
        .withColumn("full", F.coalesce(F.sum("ceiling").over(before), F.lit(0.0)))
        .withColumn("used", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", level)
    )
    # the sources before the first that its level does not fill are at their ceiling
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("ceiling"), F.struct(F.col("used"), F.col("level")))).over(every)
    each = each.withColumn("target", F.least(F.col("ceiling"), first["level"] * F.col("weight")))
    share = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("target").over(share)
    return each.select("source", "source_size", "weight", "target", ((upto - F.col("target")) / F.col("total")).alias("from"), (upto / F.col("total")).alias("to"))


def _running(df: DataFrame, by: list[str], chunk: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """``out``: sum of ``value`` over the earlier rows of ``by``, in order of (chunk, order)."""
    earlier = Window.partitionBy(*by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    chunks = df.groupBy(*by, chunk).agg(F.sum(value).alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inner = Window.partitionBy(*by, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    same = [local[c].eqNullSafe(chunks[c]) for c in (*by, chunk)]
    joined = local.join(chunks, same)
    return joined.select(*[local[c] for c in df.columns], (F.col("_base") + F.col("_in")).alias(out))


def streams(sized: DataFrame) -> DataFrame:
    """Every document with its start in its source's shuffled stream.

    The chunk is the first three hex digits of the MD5: 4,096 equal parts of a source.
    """
    chunked = sized.withColumn("chunk", F.substring("key", 1, 3))
    return _running(chunked, ["source"], "chunk", [F.col("key"), F.col("id"), F.col("size")], F.col("size"), "start").drop("chunk")


def schedule(shares: DataFrame, slots: int) -> DataFrame:
    """n, source, block: which block of which source slot n takes."""
    spark = shares.sparkSession
    point = (F.col("n") % POINTS * STEP) % POINTS / F.lit(float(POINTS))
    points = spark.range(slots).withColumnRenamed("id", "n").withColumn("at", point).withColumn("cell", F.floor(F.col("at") * CELLS))
    some = shares.filter(F.col("to") > F.col("from")).select("source", "from", "to")
    cells = F.sequence(F.floor(F.col("from") * CELLS), F.least(F.floor(F.col("to") * CELLS), F.lit(CELLS).cast("long")))
    hit = points.join(some.withColumn("cell", F.explode(cells)), "cell").filter((F.col("at") >= F.col("from")) & (F.col("at") < F.col("to")))
    chunked = hit.select("n", "source", F.floor(F.col("n") / SLOT_CHUNK).alias("chunk"))
    return _running(chunked, ["source"], "chunk", [F.col("n")], F.lit(1), "block").drop("chunk")


def slot_count(total: int, sources: int, block: int = BLOCK) -> int:
    """Slots to draw: a twentieth and 32 a source more than the blocks, so that few are left to ``missing``;
    slots beyond a source's last block find no block."""
    return -(-total * 21 // (20 * block)) + 32 * sources


def missing(slots: DataFrame, shares: DataFrame, first: int, block: int = BLOCK) -> DataFrame:
    """n, source, block: the blocks that a source's target has beyond its slots, numbered on from ``first``."""
    got = slots.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("got"))
    need = shares.select("source", F.ceil(F.floor(F.col("target") + 0.5) / block).alias("need"))
    met = need.join(got, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "need", F.coalesce("got", F.lit(0)).alias("got"))
    # one short row a source, as in targets
    before = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    short = met.filter("got < need").withColumn("base", F.coalesce(F.sum(F.col("need") - F.col("got")).over(before), F.lit(0)))
    each = short.withColumn("block", F.explode(F.sequence("got", F.col("need") - 1)))
    return each.select((F.lit(first) + F.col("base") + F.col("block") - F.col("got")).alias("n"), "source", "block")


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), block: int = BLOCK, seed: int = 1, max_passes: int = MAX_PASSES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix as (documents, targets, pieces).

    documents: id, source, size, key, start. pieces: n (slot), source, block, start (of
    the document), pass, offset (first word in the document), words; in order of n and
    of (pass, start, offset) they are the mixed stream.
    """
    placed = stored(streams(stored(sizes(docs, id, text, source, seed), "op1-sizes")), "op1-streams")
    shares = stored(targets(placed, weights, max_passes), "op1-targets")
    total = shares.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*")).first()
    count = slot_count(total[0], total[1], block) if total[0] else 0
    slots = stored(schedule(shares, count), "op1-slots")
    slots = slots.unionByName(missing(slots, shares, count, block))
    # the share of a source is one row a source; every document meets the row of its own source
    goals = shares.select(F.col("source").alias("_s"), "source_size", F.floor(F.col("target") + 0.5).alias("goal"))
    used = placed.filter("size > 0").join(goals, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    begin, end = F.col("pass") * F.col("source_size") + F.col("start"), F.least(F.col("begin") + F.col("size"), F.col("goal"))
    runs = used.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max_passes - 1)))).withColumn("begin", begin).filter("begin < goal").withColumn("end", end)
    blocks = F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))
    cut = runs.withColumn("block", F.explode(blocks))
    first = F.greatest(F.col("begin"), F.col("block") * block)
    cut = cut.select("source", "block", "start", "pass", (first - F.col("begin")).alias("offset"), (F.least(F.col("end"), (F.col("block") + 1) * block) - first).alias("words"))
    s = slots.select("n", F.col("source").alias("_s"), F.col("block").alias("_b"))
    pieces = cut.join(s, cut["source"].eqNullSafe(s["_s"]) & (cut["block"] == s["_b"])).drop("_s", "_b")
    return placed, shares, pieces


def taken(placed: DataFrame, shares: DataFrame, pieces: DataFrame) -> DataFrame:
    """Documents with their source's size and target and the words the mix takes of them."""
    sums = pieces.groupBy(F.col("source").alias("_s"), F.col("start").alias("_a")).agg(F.sum("words").alias("taken"))
    met = placed.join(sums, placed["source"].eqNullSafe(sums["_s"]) & (placed["start"] == sums["_a"]) & (placed["size"] > 0), "left").drop("_s", "_a")
    goals = shares.select(F.col("source").alias("_s"), "source_size", "target")
    return met.join(goals, met["source"].eqNullSafe(goals["_s"])).drop("_s").withColumn("taken", F.coalesce(F.col("taken"), F.lit(0)))


def repeat(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixed documents with all their columns: each as often as the mix takes it, to the nearest whole."""
    every = taken(*mix(docs, id, text, source, **options))
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(0)).cast("int")
    # rows that agree in id, source and size (repeated rows) share a list of copies and take one each
    row_key = lambda a, b, n: F.xxhash64(F.coalesce(a.cast("string"), F.lit("")), a.isNull(), F.coalesce(b, F.lit("")), b.isNull(), n)
    lists = every.groupBy(row_key(F.col("id"), F.col("source"), F.col("size")).alias("_k")).agg(F.sort_array(F.collect_list(copies)).alias("_copies"))
    keyed = docs.withColumn("_k", row_key(F.col(id), F.col(source), word_count(F.col(text))))
    met = keyed.join(lists, "_k").withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(F.xxhash64(text))))
    out = met.withColumn("_each", F.explode(F.array_repeat(F.lit(0), F.get("_copies", F.col("_n") - 1))))
    return out.select(*docs.columns)
