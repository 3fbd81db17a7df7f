"""Operator 6, byte-level BPE by a public vocabulary: encoding and decoding.

Pre-tokenisation works on whole batches without a regular expression. Each code
point becomes a class, with the one character of lookahead that the pattern
needs folded in (an apostrophe that opens a contraction, the last of a run of
white space before other text). A class stands for a function from the state
before the character to the state after it; functions compose associatively, so
the states before all characters come from one scan: rows of ``_ROW`` functions
are composed column by column, the rows' totals by the same scan, and so on.
Whether a token starts at a character is a table of (state before, class).

The slices between starts go through a cache of merged pieces (bounded, emptied
when full), misses through pair merging by rank with a heap, which gives the
same merges as a scan for the lowest rank. ``encode`` keeps the tokens' byte
offsets if asked for, ``digests`` makes none; ``decode`` joins the tokens' bytes
and needs nothing else.

Edge cases: a null or empty text has no token and decodes to nothing; special
tokens are ordinary text; any text decodes to its own UTF-8 bytes. Extra columns
are kept; repeated rows are encoded alike.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import parts

# Letters and numbers of Unicode 16.0 that Python's 15.1 tables do not have yet.
_NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
    (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
    (0x1E5F0, 0x1E5F0),
)
_NEW_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)

# Classes of characters. GAP, LAST_GAP: white space, the latter last in a run before other text;
# LAST_SPACE: the same and a plain space, which joins the next token. SHORT, LONG: an apostrophe that
# would open a contraction of one or two letters. The FIRST_ twin of a class opens a text.
LETTER, NUMBER, OTHER, GAP, LAST_GAP, LAST_SPACE, SHORT, LONG = range(8)
_CLASSES = 8
# States after a character. JOIN: after a space that joins; ONE, TWO: so many letters of a
# contraction to come; DONE: at the end of a contraction; CLEAR: nothing goes on.
CLEAR, JOIN, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_GAP, ONE, TWO, DONE = range(9)
_STATES = 9


def _step(state: int, kind: int) -> tuple[int, bool]:
    """State after a character, and whether a token starts at it."""
    if kind == LETTER:
        if state in (ONE, TWO):
            return (DONE if state == ONE else ONE), False
        return IN_LETTERS, state not in (JOIN, IN_LETTERS)
    if kind == NUMBER:
        return IN_NUMBERS, state not in (JOIN, IN_NUMBERS)
    if kind in (SHORT, LONG) and state not in (JOIN, IN_OTHER):
        return (ONE if kind == SHORT else TWO), True
    if kind in (OTHER, SHORT, LONG):
        return IN_OTHER, state not in (JOIN, IN_OTHER)
    if kind == GAP:
        return IN_GAP, state != IN_GAP
    return (JOIN if kind == LAST_SPACE else CLEAR), True


@cache
def _machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function of each class, composition table, value of each function, starts).

    Functions are numbered as they arise from composing those of the classes; a text's
    first character has a constant function, as it forgets the state before.
    """
    own = [tuple(_step(s, c)[0] for s in range(_STATES)) for c in range(_CLASSES)]
    own += [(f[CLEAR],) * _STATES for f in own]
    functions = list(dict.fromkeys([tuple(range(_STATES)), *own]))
    number = {f: i for i, f in enumerate(functions)}
    table: dict[tuple[int, int], int] = {}
    grown = True
    while grown:
        grown = False
        for i, f in enumerate(functions):
            for j, g in enumerate(functions):
                if (i, j) not in table:
                    both = tuple(g[x] for x in f)  # f, then g
                    if both not in number:
                        number[both] = len(functions)
                        functions.append(both)
                        grown = True
                    table[i, j] = number[both]
        grown = grown or len(table) < len(functions) ** 2
    n = len(functions)
    compose = np.array([[table[i, j] for j in range(n)] for i in range(n)], np.uint16).ravel()
    starts = np.array([[c >= _CLASSES or _step(s, c % _CLASSES)[1] for c in range(2 * _CLASSES)] for s in range(_STATES)], bool)
    return np.array([number[f] for f in own], np.uint16), compose, np.array(functions, np.uint8), starts.ravel()


_ROW = 32


def _scan(f: np.ndarray, compose: np.ndarray, n: int) -> np.ndarray:
    """Before each element, the composition of all earlier ones (0 is the identity)."""
    if len(f) <= _ROW:
        out = np.zeros(len(f), np.uint16)
        for i in range(1, len(f)):
            out[i] = compose[int(out[i - 1]) * n + int(f[i - 1])]
        return out
    rows = -(-len(f) // _ROW)
    grid = np.zeros((_ROW, rows), np.uint16)  # one column per row of the text: steps are contiguous
    padded = np.zeros(rows * _ROW, np.uint16)
    padded[: len(f)] = f
    grid[:] = padded.reshape(rows, _ROW).T
    upto = np.empty((_ROW + 1, rows), np.uint16)
    upto[0] = 0
    for i in range(_ROW):
        upto[i + 1] = compose[upto[i].astype(np.uint32) * n + grid[i]]
    before = _scan(upto[_ROW], compose, n).astype(np.uint32) * n
    out = compose[before[None, :] + upto[:_ROW]]
    return out.T.ravel()[: len(f)]


@cache
def _kinds() -> np.ndarray:
    """LETTER, NUMBER, OTHER or GAP of every code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))[0]
        if c in "LN":
            kinds[cp] = LETTER if c == "L" else NUMBER
    for spans, kind in ((_NEW_LETTERS, LETTER), (_NEW_NUMBERS, NUMBER)):
        for lo, hi in spans:
            kinds[lo : hi + 1] = kind
    spaces = [cp for cp in range(0x3001) if chr(cp).isspace() and not 0x1C <= cp <= 0x1F]
    kinds[spaces] = GAP
    return kinds


def starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Whether a token starts at each code point; ``firsts``: places where a text begins."""
    n = len(points)
    kind = _kinds()[points]
    first = np.zeros(n + 3, bool)
    first[firsts] = True
    first[n:] = True
    # white space before other text of the same text
    gap = kind == GAP
    last = np.zeros(n, bool)
    last[:-1] = gap[:-1] & ~gap[1:] & ~first[1:n]
    kind[last] = LAST_GAP
    kind[last & (points == 0x20)] = LAST_SPACE
    # contractions: an apostrophe and s, t, m or d, or re, ve or ll
    at = np.flatnonzero(points == 0x27)
    ahead = np.concatenate([points, np.zeros(2, points.dtype)])
    a, b = np.where(first[at + 1], 0, ahead[at + 1]), 0
    b = np.where(first[at + 1] | first[at + 2], 0, ahead[at + 2])
    kind[at[np.isin(a, [ord(x) for x in "stmd"])]] = SHORT
    long = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    kind[at[long]] = LONG
    kind[firsts] += _CLASSES
    of_class, compose, values, begins = _machine()
    before = values[_scan(of_class[kind], compose, len(values)), CLEAR]
    return begins[before.astype(np.uint16) * (2 * _CLASSES) + kind]


class Vocabulary:
    """The ranks of a tiktoken file; pieces are merged once and kept while there is room."""

    def __init__(self, ranks: dict[bytes, int], room: int = 200_000):
        self.ranks, self.room = ranks, room
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.cached: dict[bytes, bytes] = {}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a piece: neighbours of the lowest rank merge first, the leftmost of equals."""
        ranks, n = self.ranks, len(piece)
        if n < 48:  # short: look for the lowest rank each time
            cuts = list(range(n + 1))
            rank = [ranks.get(piece[i : i + 2], 1 << 60) for i in range(n - 1)]
            while rank:
                low = min(rank)
                if low == 1 << 60:
                    break
                i = rank.index(low)
                del cuts[i + 1], rank[i]
                if i < len(rank):
                    rank[i] = ranks.get(piece[cuts[i] : cuts[i + 2]], 1 << 60)
                if i:
                    rank[i - 1] = ranks.get(piece[cuts[i - 1] : cuts[i + 1]], 1 << 60)
            return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]
        after, before = list(range(1, n + 2)), list(range(-1, n))  # linked starts of parts
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        dead = bytearray(n + 1)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i]
            if dead[i] or j >= n or after[j] != end:
                continue  # one of the two has grown since
            dead[j] = 1
            after[i] = end
            if end < n:
                before[end] = i
                if (r := ranks.get(piece[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def ids(self, piece: bytes) -> bytes:
        """Little-endian 32-bit ids of a piece, from the cache."""
        found = self.cached.get(piece)
        if found is None:
            whole = self.ranks.get(piece)
            ids = [whole] if whole is not None else self.merge(piece)
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(piece) <= 64:  # a long piece hardly comes back
                if len(self.cached) >= self.room:
                    self.cached.clear()
                self.cached[piece] = found
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; boundaries are found for all texts at once."""
        some = [t for t in texts if t]
        if not some:
            return [np.zeros(0, "<u4") for _ in texts]
        joined = "".join(some)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        firsts = np.cumsum([0, *map(len, some[:-1])])
        begin = np.flatnonzero(starts(points, firsts))
        width = np.ones(len(points), np.int64)
        for least in (0x80, 0x800, 0x10000):
            width += points >= least
        at = np.concatenate([[0], np.cumsum(width)])
        data, cuts = joined.encode(), [*at[begin].tolist(), int(at[-1])]
        out, ids = [], self.ids
        known = self.cached.get
        bounds = [*np.searchsorted(begin, firsts).tolist(), len(begin)]
        done = iter(zip(bounds, bounds[1:], strict=False))
        for t in texts:
            if not t:
                out.append(np.zeros(0, "<u4"))
                continue
            lo, hi = next(done)
            pieces = [data[a:b] for a, b in zip(cuts[lo:hi], cuts[lo + 1 : hi + 1], strict=True)]
            out.append(np.frombuffer(b"".join([known(p) or ids(p) for p in pieces]), "<u4"))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offsets of the tokens, and the length last."""
        return np.cumsum([0, *(len(self.bytes_of[i]) for i in ids.tolist())])


def _lists(coded: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, coded)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*coded, np.zeros(0, "<u4")]).astype(np.int32)))


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file installed on every worker, read once a process."""
    if path not in _loaded:
        _loaded[path] = Vocabulary.read(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", offsets: str | None = None) -> DataFrame:
    """``docs`` with the ids of their texts, and the tokens' byte offsets if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in parts(batches, text):
            coded = voc.encode(batch.column(text).to_pylist())
            more = [_lists(coded)]
            if offsets:
                more.append(pa.array([voc.offsets(x) for x in coded], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, ids, *([offsets] if offsets else [])])

    more = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(offsets, T.ArrayType(T.LongType()))] if offsets else [])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the bytes of their ids (null: nothing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in batches:
            back = [voc.decode(np.asarray(x or [], np.int64)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary())], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.BinaryType())]))


def digests(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", ids: str | None = None) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 (and the ids, if named): encoding and decoding in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in parts(batches, text):
            coded = voc.encode(batch.column(text).to_pylist())
            columns = [
                batch.column(id),
                pa.array([len(x) for x in coded], pa.int64()),
                pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in coded], pa.string()),
                pa.array([hashlib.sha256(voc.decode(x)).hexdigest() for x in coded], pa.string()),
            ]
            if ids:
                columns.append(_lists(coded))
            yield pa.RecordBatch.from_arrays(columns, names=[id, "n_tokens", "ids_sha256", "decoded_sha256", *([ids] if ids else [])])

    fields = [docs.schema[id], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return docs.select(id, text).mapInArrow(run, T.StructType([*fields, *([T.StructField(ids, T.ArrayType(T.IntegerType()))] if ids else [])]))
