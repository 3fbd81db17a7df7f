"""Operator 13, token ids in binary shards: a wavelet matrix per shard.

A shard is one file with the ids of consecutive documents. Its ids are held as a
wavelet matrix: for each bit of an id, from the highest, one plane with that bit
of every id, after which the ids are parted stably by it. Planes are cut into
blocks, each compressed on its own; a directory at the end of the file has the
blocks' places and the ones before each of them. So one token, a count or the
places of an id are found from a few blocks:

* ``Shard.access(i)``: the id at a place.
* ``Shard.rank(id, i)``, ``Shard.count(id, lo, hi)``: occurrences up to a place, in a range.
* ``Shard.select(id, k)``, ``Shard.occurrences(id)``: the k-th place, all places.
* ``Shard.tokens()``: all ids, one pass over the planes backwards.

``write`` deals the documents by range of doc_id, encodes them in their tasks and
writes shards of some ``SHARD_TOKENS`` ids (a document is never split); only a
manifest row a shard goes on. ``read`` opens every shard again, one task a
shard, and gives one row a document; ``occurrences`` looks an id up in all
shards. Tasks name files of their own, so a repeated or doubled task does no harm:
only the shards that the manifest names are read.

A document's ids are those of the tokenizers library, then the end id (see
``Encoder`` for what is encoded once only).

Edge cases: a null or empty text has the end id alone. Null doc_ids come first;
rows of one doc_id go by the hash of their text, and equal rows are written
each. An empty table has no shard and no row. Extra columns are ignored.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import scratch_path
from .common import file_system, parts, stored

SHARD_TOKENS, END_ID = 1 << 22, 1
BLOCK_BITS = 1 << 18
MAGIC = b"WAVEMTX1"
#: Pieces that a worker keeps with their ids, and the longest that it keeps.
KEPT_PIECES, KEPT_BYTES = 1 << 20, 64


# --- ids ---------------------------------------------------------------------------------


#: Normaliser and pre-tokeniser of the tokenizers whose simple pieces are cut here.
_KNOWN_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: A piece of these characters alone is in NFC, has no white space, and is lowered alike
#: everywhere: printable ASCII, Latin-1 and Latin Extended-A and -B without the dotted I.
_SIMPLE = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]+")


def _byte_letters() -> dict[int, str]:
    """The letters of the byte level: printable bytes stand for themselves, the others
    for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, as the tokenizers library gives them.

    Where the tokenizer drops white space (a normaliser of NFC, white space to one space
    and lower case, and one splitting pattern), texts are cut at ASCII white space and
    each different piece is encoded once. A simple piece is lowered and split here, and
    the library's merges alone run over its words; any other piece goes through the whole
    library, as do whole texts where the tokenizer is of another kind."""

    def __init__(self, path: str, by_word: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.bits = max(1, (max(self.library.get_vocab(with_added_tokens=True).values(), default=1)).bit_length())
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        norms = (own.get("normalizer") or {}).get("normalizers", [])
        steps = (own.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = by_word and [n["type"] for n in norms] == _KNOWN_NORMALIZERS and norms[1]["pattern"] == {"Regex": "\\s+"} and norms[1]["content"] == " "
        self.by_word = self.by_word and [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
        self.by_word = self.by_word and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"] and not own.get("post_processor")
        self.pieces: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        if self.by_word:
            self.split = regex.compile(steps[0]["pattern"]["Regex"]).findall
            self.special = {t["content"][0] for t in own.get("added_tokens", [])}
            self.marks = {x.encode() for x in ".,;:!?" if x not in self.special}
            self.letters = _byte_letters()
            bare = {k: v for k, v in own.items() if k not in ("normalizer", "pre_tokenizer", "added_tokens")}
            self.merges = Tokenizer.from_str(json.dumps(bare | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []})).model

    def _whole(self, texts: list[bytes]) -> list[bytes]:
        found = self.library.encode_batch_fast([x.decode("utf-8", "replace") for x in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _cut(self, piece: bytes) -> list[bytes] | None:
        """The lowered words of a simple piece, in UTF-8; None for any other piece."""
        if piece.isalpha():  # of bytes: ASCII letters alone
            return [piece.lower()]
        if piece[:-1].isalpha() and piece[-1:] in self.marks:
            return [piece[:-1].lower(), piece[-1:]]
        text = piece.decode("utf-8", "replace")
        if not self.special.isdisjoint(text) or not _SIMPLE.fullmatch(text):
            return None
        return [w.encode() for w in ([text.lower()] if text.isalpha() else self.split(text.lower()))]

    def _learn(self, new: list[bytes]) -> None:
        """Adds the ids of pieces that were not seen before."""
        words, pieces, whole = self.words, self.pieces, []
        if len(pieces) + len(new) > KEPT_PIECES:
            pieces.clear()
            words.clear()
        for piece in new:
            cut = self._cut(piece)
            if cut is None:
                whole.append(piece)
                continue
            for w in cut:
                if w not in words:
                    found = self.merges.tokenize(w.decode() if w.isalpha() else w.decode("latin-1").translate(self.letters))
                    words[w] = struct.pack(f"<{len(found)}I", *[t.id for t in found])
            pieces[piece] = b"".join([words[w] for w in cut])
        if whole:
            pieces.update(zip(whole, self._whole(whole), strict=True))

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        if not self.by_word:
            return self._whole(texts)
        cut = [x.split() for x in texts]  # of bytes: at ASCII white space alone
        found = [list(map(self.pieces.get, own)) for own in cut]
        new = {x for own, ids in zip(cut, found, strict=True) if None in ids for x, i in zip(own, ids, strict=True) if i is None}
        if new:
            self._learn(list(new))
            for own, ids in zip(cut, found, strict=True):
                if None in ids:
                    ids[:] = [self.pieces[x] if i is None else i for x, i in zip(own, ids, strict=True)]
        out = list(map(b"".join, found))
        for x in new:
            if len(x) > KEPT_BYTES:
                del self.pieces[x]
        return out


@lru_cache(2)
def encoder(path: str, by_word: bool) -> Encoder:
    """One encoder a worker, with what it learnt, for all its tasks."""
    return Encoder(path, by_word)


# --- one shard ---------------------------------------------------------------------------


def build(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    """The planes, highest bit first, packed eight to a byte."""
    v = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    planes = []
    for b in range(bits - 1, -1, -1):
        one = (v & v.dtype.type(1 << b)) != 0
        planes.append(np.packbits(one, bitorder="little"))
        v = np.concatenate([v[~one], v[one]])
    return planes


def _compressor():
    import zstandard

    return zstandard.ZstdCompressor(level=1)


def save(uri: str, ids: np.ndarray, bits: int, doc_ids: list[int | None], ends: np.ndarray) -> None:
    """Write a shard. ``ends``: the number of ids up to each document's end."""
    fs, path = file_system(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    pack, block = _compressor(), BLOCK_BITS // 8
    places, ones, zeros, at = [], [], [], 16
    with fs.open_output_stream(path, compression=None) as out:
        out.write(MAGIC + struct.pack("<II", bits, BLOCK_BITS))
        for plane in build(ids, bits):
            before = 0
            for k in range(0, len(plane), block):
                part = plane[k : k + block]
                data = pack.compress(part.tobytes())
                out.write(data)
                places.append(at)
                ones.append(before)
                at += len(data)
                before += int(np.bitwise_count(part).sum())
            zeros.append(len(ids) - before)
        places.append(at)
        directory = io.BytesIO()
        known = np.array([i is not None for i in doc_ids], bool)
        for array in (np.array([len(ids)], np.int64), np.array(places, np.int64), np.array(ones, np.int64), np.array(zeros, np.int64), np.array([i or 0 for i in doc_ids], np.int64), known, np.asarray(ends, np.int64)):
            np.lib.format.write_array(directory, array, allow_pickle=False)
        data = pack.compress(directory.getvalue())
        out.write(data)
        out.write(struct.pack("<QQ", at, len(data)) + MAGIC)


class Shard:
    """A shard's file; blocks are read when asked for, a few are kept."""

    def __init__(self, uri: str, kept_blocks: int = 64):
        import zstandard

        fs, path = file_system(uri)
        self.file, self._unpack = fs.open_input_file(path), zstandard.ZstdDecompressor()
        size = self.file.size()
        if size < 40 or self.file.read_at(8, 0) != MAGIC or self.file.read_at(8, size - 8) != MAGIC:
            raise ValueError(f"no shard, or a cut one: {uri}")
        self.bits, self.block_bits = struct.unpack("<II", self.file.read_at(8, 8))
        at, length = struct.unpack("<QQ", self.file.read_at(16, size - 24))
        directory = io.BytesIO(self._unpack.decompress(self.file.read_at(length, at)))
        n, self.places, ones, self.zeros, ids, known, ends = (np.lib.format.read_array(directory, allow_pickle=False) for _ in range(7))
        self.n = int(n[0])
        self.blocks = -(-self.n // self.block_bits)
        self.ones = ones.reshape(self.bits, self.blocks)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self.ends = ends
        self._block = lru_cache(kept_blocks)(self._read)

    def __enter__(self) -> Shard:
        return self

    def __exit__(self, *_) -> None:
        self._block.cache_clear()
        self.file.close()

    def _read(self, plane: int, k: int) -> np.ndarray:
        i = plane * self.blocks + k
        data = self.file.read_at(int(self.places[i + 1] - self.places[i]), int(self.places[i]))
        return np.frombuffer(self._unpack.decompress(data), np.uint8)

    def _ones(self, plane: int, i: int) -> int:
        """Ones of a plane before place i."""
        if i >= self.n:
            return self.n - int(self.zeros[plane])
        k, rest = divmod(i, self.block_bits)
        block = self._block(plane, k)
        full = int(np.bitwise_count(block[: rest >> 3]).sum())
        return int(self.ones[plane, k]) + full + (int(block[rest >> 3]) & ((1 << (rest & 7)) - 1)).bit_count() if rest & 7 else int(self.ones[plane, k]) + full

    def _bit(self, plane: int, i: int) -> int:
        k, rest = divmod(i, self.block_bits)
        return int(self._block(plane, k)[rest >> 3]) >> (rest & 7) & 1

    def _place(self, plane: int, bit: int, j: int) -> int:
        """The place of the j-th (from 0) zero or one of a plane."""
        before = self.ones[plane] if bit else np.arange(self.blocks) * self.block_bits - self.ones[plane]
        k = int(np.searchsorted(before, j, "right")) - 1
        inside = np.unpackbits(self._block(plane, k), bitorder="little")[: self.n - k * self.block_bits]
        return k * self.block_bits + int(np.flatnonzero(inside == bit)[j - int(before[k])])

    def _span(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the ids of [lo, hi) that equal ``token`` stand after the last plane."""
        for p in range(self.bits):
            a, b = self._ones(p, lo), self._ones(p, hi)
            lo, hi = (int(self.zeros[p]) + a, int(self.zeros[p]) + b) if token >> (self.bits - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def _unknown(self, token: int) -> bool:
        return token < 0 or token >> self.bits > 0

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for p in range(self.bits):
            bit, a = self._bit(p, i), self._ones(p, i)
            token = token << 1 | bit
            i = int(self.zeros[p]) + a if bit else i - a
        return token

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id among the places [lo, hi)."""
        lo, hi = max(lo, 0), self.n if hi is None else min(hi, self.n)
        if self._unknown(token) or lo >= hi:
            return 0
        a, b = self._span(token, lo, hi)
        return b - a

    def rank(self, token: int, i: int) -> int:
        return self.count(token, 0, i)

    def select(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of an id."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._span(token, 0, self.n)[0] + k
        for p in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - p) & 1
            at = self._place(p, bit, at - int(self.zeros[p]) * bit)
        return at

    def _plane(self, p: int) -> np.ndarray:
        packed = np.concatenate([self._read(p, k) for k in range(self.blocks)]) if self.blocks else np.zeros(0, np.uint8)
        return np.unpackbits(packed, count=self.n, bitorder="little").view(bool)

    def occurrences(self, token: int) -> np.ndarray:
        """All places of an id, ascending."""
        if not self.count(token):
            return np.zeros(0, np.int64)
        at = np.arange(*self._span(token, 0, self.n))
        for p in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - p) & 1
            at = np.flatnonzero(self._plane(p) == bool(bit))[at - int(self.zeros[p]) * bit]
        return at

    def tokens(self) -> np.ndarray:
        """All ids: from the last plane on, each plane puts its zeros and ones back in place."""
        v = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for p in range(self.bits - 1, -1, -1):
            one, z = self._plane(p), int(self.zeros[p])
            before = np.empty_like(v)
            before[~one] = v[:z]
            before[one] = v[z:] | v.dtype.type(1 << (self.bits - 1 - p))
            v = before
        return v


# --- the table of documents ----------------------------------------------------------------


def write(docs: DataFrame, tokenizer: str, folder: str, id: str = "doc_id", text: str = "text", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, by_word: bool = True) -> DataFrame:
    """Write the shards below ``folder``; returns the manifest: path, part, shard, n_docs,
    n_tokens, start (ids in earlier shards), in order of (part, shard)."""
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("digest", F.xxhash64("text")).repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest").drop("digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder, part = encoder(tokenizer, by_word), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        bits = max(own_encoder.bits, end_id.bit_length())
        held, ids, n, done = [], [], 0, []

        def close() -> None:
            nonlocal held, ids, n
            uri = f"{folder}/part-{part:06d}-{len(done):05d}-{uuid.uuid4().hex}.wm"
            ends = np.cumsum([len(x) // 4 for x in ids])
            save(uri, np.frombuffer(b"".join(ids), "<u4"), bits, held, ends)
            done.append((uri, part, len(done), len(held), n))
            held, ids, n = [], [], 0

        for batch in parts(batches, "text"):
            texts = [x or b"" for x in batch.column("text").cast(pa.large_binary()).to_pylist()]
            for i, own in zip(batch.column("doc_id").to_pylist(), own_encoder.ids(texts), strict=True):
                held.append(i)
                ids.append(own + end)
                n += len(own) // 4 + 1
                if n >= shard_tokens:
                    close()
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done, strict=True) if done else [[]] * 5, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["path", "part", "shard", "n_docs", "n_tokens"])

    manifest = stored(rows.mapInArrow(run, "path string, part int, shard int, n_docs long, n_tokens long"), "op13-manifest")
    # one row a task, then one row a shard of a task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = manifest.groupBy("part").agg(F.sum("n_tokens").alias("all")).select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(tasks, "part").select("path", "part", "shard", "n_docs", "n_tokens", (F.col("base") + F.col("inside")).alias("start"))


def _each_shard(manifest: DataFrame, columns: list[str]) -> DataFrame:
    """One task a shard."""
    return manifest.select(*columns).repartition(max(1, manifest.count()))


def read(manifest: DataFrame, kind: T.DataType | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (``with_ids``) ids, little-endian 32-bit, of every
    document, from the files."""
    names, types = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names, types = (names, types) if with_ids else (names[:4], types[:4])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with Shard(path) as shard:
                    ids, held, weight, lo = shard.tokens(), [], 0, 0
                    for i, hi in zip(shard.doc_ids, shard.ends.tolist(), strict=True):
                        own = ids[lo:hi].astype("<u4").tobytes()
                        held.append((i, start + lo, hi - lo, zlib.crc32(own), own)[: len(names)])
                        weight, lo = weight + (len(own) if with_ids else 64), hi
                        if weight >= 1 << 21:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                            held, weight = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    rows = _each_shard(manifest, ["path", "start"]).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    return rows.withColumn("doc_id", F.col("doc_id").cast(kind)) if kind is not None else rows


def occurrences(manifest: DataFrame, token: int) -> DataFrame:
    """doc_id, place (in the document) of every occurrence of an id, from the planes of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with Shard(path) as shard:
                    at = shard.occurrences(token)
                    doc = np.searchsorted(shard.ends, at, "right")
                    starts = np.concatenate([[0], shard.ends[:-1]])
                    yield pa.RecordBatch.from_arrays([pa.array([shard.doc_ids[d] for d in doc], pa.int64()), pa.array(at - starts[doc] if len(at) else at, pa.int64())], names=["doc_id", "place"])

    return _each_shard(manifest, ["path"]).mapInArrow(run, "doc_id long, place long")


def round_trip(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Write the shards of all documents and read them back (see ``read``)."""
    spark: SparkSession = docs.sparkSession
    manifest = write(docs, tokenizer, scratch_path(spark, "op13-shards"), id, text)
    return read(manifest, docs.schema[id].dataType, with_ids).withColumnRenamed("doc_id", id)
