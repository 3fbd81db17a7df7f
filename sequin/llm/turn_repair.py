"""Operator 11, repair of damaged conversations: rank-convergence parallel Viterbi.

A conversation's rows are edited (Keep, Rerole, Delete, Insert) so that the role
initials read ``(s?(ua)+)?`` at the least cost. Four states say what came last:
nothing, s, u, a. From each state one role can be inserted or reroled to, so an
audit (the edits' initials) fixes the whole repair.

* A conversation is cut into chunks of at most ``CHUNK`` rows, in order of turn;
  rows are dealt by range, so a conversation with a third of all rows spreads
  over many tasks. Equal rows of a turn are one row with a count.
* Backward costs (edits from here to the end, one number a state) run through a
  chunk from its right end. A chunk that is not its conversation's last starts
  from a speculative vector of zeros. Fix-up passes give each chunk its right
  neighbour's result and rerun it until its vectors differ from those of the
  run before only by a constant; what is left of there stands. The passes end
  once none has changed. Rows that never converge (roles all unknown, say) keep
  the difference for ever: after ``PASSES`` a sweep over the chunks' 4 x 4 cost
  matrices, one short row a chunk, finishes them exactly.
* Vectors are kept up to a constant, so few different ones occur and a step is
  looked up by (vector, row code). The stitched backward costs then drive a
  forward trace, which takes the least letter among the cheapest edits.

``repaired_sha256`` is one digest of the whole repaired text, which has to be
read in order: the rows of a conversation in several chunks stream, sorted,
through one task that holds a chunk at a time.

Edge cases: a null role or text counts as one space (an unknown role, a blank
text), a null turn comes first; a null conv_id is one conversation. Rows of one
turn go by role, then text (code points). A conversation without rows after the
damage has zeros, an empty audit and the digest of the empty text. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import stored

CHUNK, CHUNK_CHARS, PASSES = 4096, 1 << 20, 6
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an insert or a rerole, and its role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The state after a kept row, by role class (s, u, a, any other) and state.
KEPT = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
END = (0, 2 * INSERT, INSERT, 0)
SPECULATIVE = (0, 0, 0, 0)
OK, CUT, GONE = range(3)  # nothing to mend; truncated; has to be deleted
_SPACES = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}


# --- the automaton -------------------------------------------------------------------

Vector = tuple[int, int, int, int]
_steps: dict[tuple[Vector, int], tuple[Vector, tuple]] = {}


def code(role: str, fault: int) -> int:
    return max("sua".find(role[:1]), -1) % 4 + 4 * fault if role else 3 + 4 * fault


def _options(state: int, row: int) -> list[tuple[str, int, int]]:
    """What may become of a row in a state: (letter, cost, next state), letters ascending."""
    kind, fault = row % 4, row // 4
    out = [("D", DELETE, state)]
    if fault != GONE:
        more = TRUNCATED if fault == CUT else 0
        if state in KEPT[kind]:
            out.append(("K", more, KEPT[kind][state]))
        out.append(("R", REROLE + more, NEXT[state]))
    return out


def step(after: Vector, row: int) -> tuple[Vector, tuple]:
    """Backward over one row: the costs before it (less the first of them), and for each
    state the least of the cheapest edits up to and with the row: (letters, cost, next)."""
    done = _steps.get((after, row))
    if done is None:
        here = [min(cost + after[to] for _, cost, to in _options(s, row)) for s in range(4)]
        for _ in range(2):  # at most two inserts help
            here = [min(here[s], INSERT + here[NEXT[s]]) for s in range(4)]
        edits = []
        for s in range(4):
            at, letters, paid = s, "", 0
            while True:
                fits = {x: (cost, to) for x, cost, to in _options(at, row) if cost + after[to] == here[at]}
                if "D" not in fits and INSERT + here[NEXT[at]] == here[at]:
                    at, letters, paid = NEXT[at], letters + "I", paid + INSERT
                    continue
                x = min(fits)
                edits.append((letters + x, paid + fits[x][0], fits[x][1]))
                break
        done = _steps[after, row] = tuple(c - here[0] for c in here), tuple(edits)
    return done


def backward(codes: bytes, right: Vector) -> Vector:
    for row in reversed(codes):
        right = step(right, row)[0]
    return right


def fixed(codes: bytes, old: Vector, new: Vector, left: Vector) -> Vector:
    """The left vector for a new right one, given the run from the old one: reruns the
    chunk until the two runs' vectors differ only by a constant."""
    for row in reversed(codes):
        if old == new:
            return left
        old, new = step(old, row)[0], step(new, row)[0]
    return new


def trace(codes: bytes, right: Vector, state: int) -> tuple[list[tuple[str, int, int]], int]:
    """The least of the cheapest edits of each row from the given state, and the state after."""
    edits = []
    for row in reversed(codes):
        right, choice = step(right, row)
        edits.append(choice)
    out = []
    for choice in reversed(edits):
        out.append(choice[state])
        state = out[-1][2]
    return out, state


def matrix(codes: bytes) -> list[list[int]]:
    """Cost from each state before the chunk to each state after it."""
    far = 1 << 40
    columns = []
    for s in range(4):
        v = [0 if x == s else far for x in range(4)]
        for row in reversed(codes):
            v = [min(cost + v[to] for _, cost, to in _options(x, row)) for x in range(4)]
            for _ in range(2):
                v = [min(v[x], INSERT + v[NEXT[x]]) for x in range(4)]
        columns.append(v)
    return [[columns[s][x] for s in range(4)] for x in range(4)]


# --- damage and rows -------------------------------------------------------------------


def damage(rows: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, n: the damaged rows, equal ones as one row with their number.

    A dropped row leaves a row with n = 0, so that its conversation stays known.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(id), F.lit(":"), said(turn)).cast("binary")) % 20
    told = F.when(kind < 2, "").when(kind == 2, F.regexp_replace(said(text), "[.!?]", "")).otherwise(said(text))
    damaged = rows.select(
        F.col(id).alias("conv_id"),
        F.when(kind != 0, F.col(turn)).cast("long").alias("turn"),
        F.when(kind == 0, "").when(kind == 4, "user").otherwise(said(role)).alias("role"),
        told.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"),
    )
    return damaged.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def faults(rows: DataFrame) -> DataFrame:
    """Adds ``fault``: blank, duplicate (of an earlier turn), truncated or none; the
    further copies of a row within its turn are duplicates, too."""
    end = F.rtrim(F.col("text"), F.lit(_SPACES))
    rows = rows.withColumn("blank", F.length(end) == 0).withColumn("cut", ~F.right(end, F.lit(1)).isin(".", "!", "?"))
    rows = rows.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    keys = {"_role": "role", "_digest": "digest"}
    # a struct keeps null turns first; only (conversation, text) pairs of several turns go on
    seen = rows.filter("n > 0 AND NOT blank").groupBy(F.struct("conv_id").alias("_conv"), *[F.col(c).alias(k) for k, c in keys.items()])
    seen = seen.agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    same = F.struct("conv_id") == F.col("_conv")
    for k, c in keys.items():
        same = same & (F.col(k) == F.col(c))
    rows = rows.join(seen, same, "left")
    later = F.col("times").isNotNull() & ~F.struct("turn").eqNullSafe(F.col("first"))
    return rows.select("conv_id", "turn", "role", "text", "n", F.when(F.col("blank"), "blank").when(later, "duplicate").when(F.col("cut"), "truncated").otherwise("").alias("fault"))


# --- chunks ----------------------------------------------------------------------------

_CHUNK_FIELDS = "part int, chunk int, whole boolean, codes binary, counts array<long>, roles array<string>, texts array<string>, t_first long, t_last long, n_turns long, i_first string, i_last string, blank long, duplicate long, truncated long, illegal long"


class _Open:
    """The chunk that a task is filling."""

    def __init__(self, conv, fresh: bool, size: int):
        self.conv, self.fresh, self.size, self.chars = conv, fresh, size, 0  # fresh: the conversation began in it, after another one
        self.codes, self.counts, self.roles, self.texts = bytearray(), [], [], []
        self.turns: list = [None, None, 0]
        self.initials: list = [None, None]
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}

    def add(self, turn, role: str, text: str, n: int, fault: str) -> None:
        if n == 0:
            return
        gone = fault in ("blank", "duplicate")
        self.codes.append(code(role, GONE if gone else CUT if fault else OK))
        self.counts.append(n)
        if not gone:
            self.roles.append(role)
            self.texts.append(text)
            self.chars += len(text)
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]
        initial = role[:1]
        if self.initials[0] is None:
            self.initials[0] = initial
        else:
            self.count["illegal"] += self.initials[1] + initial not in _LEGAL
        self.initials[1] = initial
        self.count["illegal"] += n - 1
        self.count["duplicate"] += n if fault == "duplicate" else 0 if fault == "blank" else n - 1
        if fault in ("blank", "truncated"):
            self.count[fault] += n if fault == "blank" else 1

    def full(self) -> bool:
        return len(self.codes) >= self.size or self.chars >= CHUNK_CHARS

    def row(self, part: int, chunk: int, whole: bool) -> tuple:
        return self.conv, part, chunk, whole, bytes(self.codes), self.counts, self.roles, self.texts, *self.turns, *self.initials, *self.count.values()


def _chunker(schema: pa.Schema, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, now, held, weight = TaskContext.get().partitionId(), 0, None, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for conv, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is not None and (conv != now.conv or now.full()):
                    held.append(now.row(part, chunk, now.fresh and conv != now.conv))
                    weight, chunk, now = weight + now.chars + 9 * len(now.codes), chunk + 1, _Open(conv, conv != now.conv, size)
                    if weight >= 1 << 21:
                        yield out()
                        held, weight = [], 0
                now = now or _Open(conv, False, size)
                now.add(*rest)
        if now is not None:
            held.append(now.row(part, chunk, False))
        if held:
            yield out()

    return run


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def chunks(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunk table of rows with their faults. ``whole``: surely all of a conversation;
    the others may go on in the neighbouring partitions."""
    ranged = rows.select("conv_id", "turn", "role", "text", "n", "fault")
    ranged = ranged.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
    own = T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL(_CHUNK_FIELDS).fields])
    return ranged.mapInArrow(_chunker(_arrow(own), size), own)


# --- fix-up passes -----------------------------------------------------------------------


def stitched(slim: DataFrame, passes: int = PASSES) -> DataFrame:
    """``slim``: ck, part, chunk, codes of conversations in several chunks. Returns ck, part,
    chunk, right: the stitched backward costs after each chunk, up to a constant."""
    order = Window.partitionBy("ck").orderBy("part", "chunk")
    numbered = slim.select("ck", "part", "chunk", "codes", F.row_number().over(order).alias("i"), (F.lead("part").over(order).isNull()).alias("last"))
    names = ["ck", "part", "chunk", "codes", "i", "right", "left", "moved"]
    fields = "ck string, part int, chunk int, codes binary, i int, right array<long>, left array<long>, moved boolean"
    types = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                right = END if x["last"] else SPECULATIVE
                out.append((x["ck"], x["part"], x["chunk"], x["codes"], x["i"], right, backward(x["codes"], right), True))
            yield table(out)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                old, left = tuple(x["right"]), tuple(x["left"])
                new = tuple(x["given"]) if x["given"] else old
                now = fixed(x["codes"], old, new, left)
                out.append((x["ck"], x["part"], x["chunk"], x["codes"], x["i"], new, now, now != left))
            yield table(out)

    state = stored(numbered.mapInArrow(first, fields), "op11-pass")
    for _ in range(passes):
        # one neighbour a chunk: an equi-join without a hot key
        given = state.select("ck", (F.col("i") - 1).alias("i"), F.col("left").alias("given"))
        state = stored(state.join(given, ["ck", "i"], "left").mapInArrow(again, fields), "op11-pass")
        if state.filter("moved").isEmpty():
            return state.select("ck", "part", "chunk", "right")
    return _swept(state)


def _swept(state: DataFrame) -> DataFrame:
    """The right vectors by matrices: one short row a chunk, in order, through one task a conversation."""
    plain = "ck string, part int, chunk int, i int, m array<long>"

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sum(matrix(c), []) for c in batch.column("codes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("ck", "part", "chunk", "i")] + [pa.array(rows, pa.list_(pa.int64()))], names=["ck", "part", "chunk", "i", "m"])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, v = None, END
        for batch in batches:
            rights = []
            for ck, m in zip(batch.column("ck").to_pylist(), batch.column("m").to_pylist(), strict=True):
                if ck != conv:
                    conv, v = ck, END
                rights.append([c - v[0] for c in v])
                v = [min(m[4 * x + s] + v[s] for s in range(4)) for x in range(4)]
                v = [c - v[0] for c in v]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("ck", "part", "chunk")] + [pa.array(rights, pa.list_(pa.int64()))], names=["ck", "part", "chunk", "right"])

    ordered = state.select("ck", "part", "chunk", "i", "codes").mapInArrow(matrices, plain).repartition("ck").sortWithinPartitions("ck", F.col("i").desc())
    return ordered.mapInArrow(sweep, "ck string, part int, chunk int, right array<long>")


# --- results -------------------------------------------------------------------------------

_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Repair:
    """One conversation, its chunks in order."""

    def __init__(self, conv):
        self.conv, self.state, self.cost, self.audit, self.digest, self.empty = conv, START, 0, [], hashlib.sha256(), True
        self.count = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.turns, self.initial = [None, None, 0], None

    def say(self, role: str, text: str) -> None:
        self.digest.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.empty = False

    def add(self, x: dict, right: Vector) -> None:
        for k in self.count:
            self.count[k] += x[k]
        if x["t_first"] is not None:
            self.turns[2] += x["n_turns"] - (self.turns[1] == x["t_first"])
            self.turns = [x["t_first"] if self.turns[0] is None else self.turns[0], x["t_last"], self.turns[2]]
        if x["i_first"] is not None:
            if self.initial is not None:
                self.count["illegal"] += self.initial + x["i_first"] not in _LEGAL
            self.initial = x["i_last"]
        said = zip(x["roles"], x["texts"], strict=True)
        edits, end = trace(x["codes"], right, self.state)
        for row, n, (letters, cost, to) in zip(x["codes"], x["counts"], edits, strict=True):
            for _ in letters[:-1]:
                self.state = NEXT[self.state]
                self.say(ROLE[self.state], "")
            if row // 4 != GONE:
                role, text = next(said)
                if letters[-1] != "D":
                    self.say(role if letters[-1] == "K" else ROLE[to], text)
            self.state = to
            self.audit.append(letters + "D" * (n - 1))
            self.cost += cost + DELETE * (n - 1)
        assert self.state == end

    def row(self) -> tuple:
        while self.state not in (START, ASSISTANT):
            self.state = NEXT[self.state]
            self.say(ROLE[self.state], "")
            self.audit.append("I")
            self.cost += INSERT
        first, last, n = self.turns
        gaps = 0 if first is None else last - first + 1 - n
        return self.conv, gaps, *self.count.values(), self.cost, "".join(self.audit), self.digest.hexdigest()


def _combiner(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, held, weight = None, None, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):  # one chunk's text at a time
                x = batch.slice(i, 1).to_pylist()[0]
                if now is None or x["ck"] != key:
                    if now is not None:
                        held.append(now.row())
                        weight += 200 + len(held[-1][-2])
                        if weight >= 1 << 20:
                            yield out()
                            held, weight = [], 0
                    now, key = _Repair(x["conv_id"]), x["ck"]
                now.add(x, tuple(x["right"]))
        if now is not None:
            held.append(now.row())
        if held:
            yield out()

    return run


def repair(rows: DataFrame, id: str = "conv_id", passes: int = PASSES, size: int = CHUNK) -> DataFrame:
    """One row per conversation of rows with their faults (see ``faults``): conv_id, gaps,
    blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    key = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string")))
    table = stored(chunks(rows, size).withColumn("ck", key), "op11-chunks")
    own = T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL(_RESULT).fields])
    combine = _combiner(_arrow(own))
    alone = table.filter("whole").withColumn("right", F.array(*[F.lit(c).cast("long") for c in END]))
    rest = table.filter("NOT whole")
    rights = stitched(rest.select("ck", "part", "chunk", "codes"), passes)
    rest = rest.join(rights, ["ck", "part", "chunk"]).repartition("ck").sortWithinPartitions("ck", "part", "chunk")
    return alone.mapInArrow(combine, own).unionByName(rest.mapInArrow(combine, own)).withColumnRenamed("conv_id", id)
