"""Operator 7, line dedup by overlapping windows, with DataFrame functions only.

Every window of ``WIDTH`` consecutive lines (split at \\n) is hashed from the
hashes of its lines, 128 bits in all. A window whose hash occurs more than once
in all texts is repeated; all its occurrences but the first, in order of
(id, MD5 of the text, line), cover their lines, and covered lines are removed. Overlapping
windows merge, so a repeated passage of any length goes as a whole.

Counting combines before its shuffle, so a window in a third of all documents
is one partial row a task; later occurrences find their window's first by a
salted join. The text shuffles once, to meet the covered line numbers.

Edge cases: a null text stays null and has no line; a text of fewer lines than a
window has none; windows of blank lines only are no passage and stay; rows that
repeat both id and text are one document and come out alike; other rows of one
id are documents of their own; a null id counts as the smallest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted_lookup, stored

WIDTH = 3


def _windows(text: Column, width: int) -> Column:
    """The windows of a text: line number, two hashes."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(F.trim(x)) > 0).alias("some")))

    def window(at: Column, lines: Column) -> Column:
        own = [F.get(lines, at + i) for i in range(width)]
        some = own[0]["some"]
        for x in own[1:]:
            some = some | x["some"]
        return F.struct(at.alias("line"), F.xxhash64(*[x["h"] for x in own]).alias("h1"), F.xxhash64(*[x["h"] for x in reversed(own)], F.lit(width)).alias("h2"), some.alias("some"))

    # the lines are hashed once: as the only element of an array they are bound to a variable
    each = F.flatten(F.transform(F.array(lines), lambda l: F.when(F.size(l) >= width, F.transform(F.sequence(F.lit(0), F.size(l) - width), lambda i: window(i, l)))))
    return F.filter(each, lambda w: w["some"])


def covered_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """id, text_hash, lines: the numbers (from 0) of the lines to remove; documents that lose none are absent."""
    rows = docs.select(F.col(id).alias("id"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("text_hash"), F.explode(_windows(F.col(text), width)).alias("w")).select("id", "text_hash", "w.line", "w.h1", "w.h2")
    rows = stored(rows, "op7-windows")
    place = F.struct("id", "text_hash", "line")
    firsts = rows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first != last").drop("last")
    later = salted_lookup(rows, firsts, ["h1", "h2"], place).filter(~place.eqNullSafe(F.col("first")))
    lines = F.array_distinct(F.flatten(F.collect_set(F.transform(F.array(*[F.lit(i) for i in range(width)]), lambda i: F.col("line") + i))))
    return later.groupBy("id", "text_hash").agg(lines.alias("lines"))


def drop_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """The input's rows with ``text`` less its covered lines, and n_lines and n_removed."""
    covered = covered_lines(docs, id, text, width).select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("lines").alias("_lines"))
    met = docs.join(covered, F.col(id).eqNullSafe(F.col("_id")) & (F.unhex(F.md5(F.col(text).cast("binary"))) == F.col("_hash")), "left")
    lines = F.split(F.col(text), "\n", -1)
    # the split text is the only element of an array, so that it is bound to a variable and made once
    kept = lambda l: F.transform(F.array_except(F.sequence(F.lit(0), F.size(l) - 1), "_lines"), lambda i: F.get(l, i))
    less = F.when(F.col("_lines").isNull(), F.col(text)).otherwise(F.array_join(F.flatten(F.transform(F.array(lines), kept)), "\n"))
    n_lines = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    n_removed = F.coalesce(F.size("_lines"), F.lit(0)).cast("long")
    return met.select(*[less.alias(text) if c == text else F.col(c) for c in docs.columns], n_lines.alias("n_lines"), F.when(F.col("_lines").isNull(), F.lit(0)).otherwise(n_removed).cast("long").alias("n_removed"))
