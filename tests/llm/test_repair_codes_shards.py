"""Operators 11 to 13 against brute force, on small tables with edge rows."""

import collections
import hashlib
import heapq
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sequin.llm import turn_repair, vector_codes, wavelet
from sequin.llm.queries import word_vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]")

# --- 11 ------------------------------------------------------------------------------


def damaged(rows):
    """rows: (conv_id, turn, role, text), as plain Python."""
    said = lambda v: " " if v is None else str(v)
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", said(text)) if kind == 2 else said(text)
        row = (turn, "user" if kind == 4 else said(role), text)
        out[conv] += [] if kind == 0 else [row] * (1 + (kind == 3))
    for v in out.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def mended(rows):
    """Least (cost, audit, repaired text) over all edits, by Dijkstra over (row, state)."""
    seen, gone, cut, counts = set(), [], [], collections.Counter()
    for _, role, text in rows:
        marks = WORD.findall(text)
        kind = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[kind] += 1
        gone.append(kind in ("blank", "duplicate"))
        cut.append(3 * (kind == "truncated"))
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, last, said = heapq.heappop(heap)
        if at == len(rows) and last in ("", "a"):
            break
        if (at, last) in done:
            continue
        done.add((at, last))
        for role in ("user", "assistant"):
            if role[0] in allowed[last]:
                heapq.heappush(heap, (cost + 3, audit + "I", at, role[0], said + (f"{role}:",)))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, last, said))
            if not gone[at]:
                if role[:1] and role[:1] in allowed[last]:
                    heapq.heappush(heap, (cost + cut[at], audit + "K", at + 1, role[0], said + (f"{role}:{text}",)))
                for new in ("user", "assistant"):
                    if new[0] in allowed[last]:
                        heapq.heappush(heap, (cost + 3 + cut[at], audit + "R", at + 1, new[0], said + (f"{new}:{text}",)))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.IntegerType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), *[T.StructField(n, T.StringType()) for n in ("n", "fault", "ck", "part", "first", "times")]])
EDGE_TURNS = [
    (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 0, "user", "Hi."),
    (2, None, None, None), (2, None, "user", "null turn."), (2, 5, "assistant", "late."),
    (None, 0, "user", "no id."), (None, 1, "assistant", "yes!"), (None, None, "assistant", "no turn?"),
    (3, 0, "", "no role."), (3, 1, "umpire", "a role of u."), (3, 2, "Assistant", "capital."),
    (4, 0, "system", "alone."), (5, 0, "assistant", " \t\n"), (6, 0, "user", "é."), (6, 3, "assistant", "x" * 70_000 + ". \n"),
    (7, 1, "user", "tie b."), (7, 1, "user", "tie a."), (7, 1, "assistant", "tie c"),
]


def turns(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], TURNS)


def repaired(table, **more):
    rows = turn_repair.repair(turn_repair.faults(turn_repair.damage(table)), **more).collect()
    return {r[0]: tuple(r)[1:] for r in rows}, len(rows)


def wild(rnd, n, roles):
    return [(rnd.choice(roles), rnd.choice(["a.", "b", "c!", "d?", "e", " ", "f f."]) + rnd.choice(["", f"{rnd.random()}.", f" {rnd.random()}"])) for _ in range(n)]


@pytest.mark.parametrize("size,passes", [(4096, 6), (3, 40), (2, 1)])
def test_repair_is_the_cheapest(spark, size, passes):
    rnd = random.Random(size)
    rows = list(EDGE_TURNS)
    for conv in range(10, 60):
        rows += [(conv, t + rnd.choice([0, 0, 0, 1]), *x) for t, x in enumerate(wild(rnd, rnd.randrange(1, 12), ["user", "assistant", "system", "tool"]))]
    rows += [(99, t, *x) for t, x in enumerate(wild(rnd, 300, ["user", "assistant"]))]  # one long conversation, over many partitions
    rows += [(98, t, "tool", f"never converges {t}.") for t in range(90)]
    got, n = repaired(turns(spark, rows).repartition(5), size=size, passes=passes)
    want = damaged(rows)
    assert n == len(want) == len(got)
    for conv, own in want.items():
        assert got[conv] == mended(own), conv


def test_repair_of_a_hot_row_and_of_none(spark):
    rows = [(1, 7, "user", "the same.")] * 500 + [(2, t, "user", "again.") for t in range(200)]
    got, _ = repaired(turns(spark, rows), size=16)
    assert got == {c: mended(r) for c, r in damaged(rows).items()}
    assert repaired(turns(spark, rows[:0])) == ({}, 0)
    dropped = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired(turns(spark, [(dropped, 0, "user", "gone.")]))[0] == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_speculative_vectors_converge():
    """A rerun chunk stops where its vectors differ from the first run's by a constant."""
    rnd = random.Random(5)
    for _ in range(300):
        codes = bytes(turn_repair.code(rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice([0, 0, 1, 2])) for _ in range(rnd.randrange(1, 40)))
        right = turn_repair.backward(bytes(rnd.randrange(12) for _ in range(5)), turn_repair.END)
        left = turn_repair.backward(codes, turn_repair.SPECULATIVE)
        assert turn_repair.fixed(codes, turn_repair.SPECULATIVE, right, left) == turn_repair.backward(codes, right)
        m = turn_repair.matrix(codes)
        swept = [min(m[x][s] + right[s] for s in range(4)) for x in range(4)]
        assert tuple(c - swept[0] for c in swept) == turn_repair.backward(codes, right)


# --- 12 ------------------------------------------------------------------------------

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in ("v", "far", "code", "error", "lk", "_salt")]])


def coded(rows):
    """rows: (vec_id, vector, label) that are usable; plain k-means with Python integers."""
    whole = lambda v: [math.floor(4096 * float(np.float32(c))) for c in v]
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, whole(r[1])))
    ints = [whole(r[1]) for r in rows]
    w = len(ints[0]) // 8
    books = [[v[p * w : (p + 1) * w] for v in ints[:16]] for p in range(8)]
    far = lambda x, e: sum((a - b) ** 2 for a, b in zip(x, e))
    assign = lambda: [[min((far(v[p * w : (p + 1) * w], e), i) for i, e in enumerate(books[p])) for p in range(8)] for v in ints]
    for _ in range(6):
        groups = collections.defaultdict(list)
        for v, own in zip(ints, assign()):
            for p, (_, e) in enumerate(own):
                groups[p, e].append(v[p * w : (p + 1) * w])
        for (p, e), xs in groups.items():
            books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    out = [(r[0], "".join(f"{e:02x}" for _, e in own), sum(d for d, _ in own), r[2]) for r, own in zip(rows, assign())]
    per = collections.Counter()
    for _, _, error, label in out:
        per[label] += error
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, per[label], digest) for i, c, e, label in out), key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, *["x"] * 6) for i, v, label in rows], VECTORS)


@pytest.mark.parametrize("n,width", [(5, 8), (16, 16), (120, 32)])
def test_vector_codes(spark, n, width):
    rnd = random.Random(n)
    vector = lambda: [rnd.choice([rnd.uniform(-1, 1), 0.0, -0.5, 1e-6, -1e-6]) for _ in range(width)]
    rows = [(3 * i, vector(), rnd.choice([None, 1, 2, 2, 2])) for i in range(n)]
    rows += [rows[0], (rows[1][0], vector(), 1), (None, vector(), 7), (None, rows[2][1], None), (-1, [-1000.0] * width, 1)]
    bad = [(1, None, 1), (4, [None] * width, 1), (7, [float("nan")] * width, 1), (10, [float("inf")] + [0.0] * (width - 1), 2), (100_000, [0.0] * 3, 1), (100_001, [], 1)]
    got = vector_codes.codes(vectors(spark, rows + bad).repartition(4)).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == coded(rows)


def test_vector_codes_without_rows_and_out_of_range(spark):
    none = vector_codes.codes(vectors(spark, [(1, None, 1)]))
    assert none.count() == 0 and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(Exception, match="a component beyond"):
        vector_codes.codes(vectors(spark, [(1, [1e30] * 8, 1)])).collect()
    with pytest.raises(ValueError, match="no 8 equal parts"):
        vector_codes.codes(vectors(spark, [(1, [1.0] * 9, 1)]))


def test_pivots_prune_without_loss():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4096, 4096, (16, 8))
    x = centres[rng.integers(0, 16, 2000)] + rng.integers(-200, 200, (2000, 8))
    book = np.concatenate([centres[:15], centres[:1]])  # one entry twice: ties
    pivots = vector_codes.pivots_of(book[None])[0]
    far = np.sqrt(((x[:, None] - pivots) ** 2).sum(-1).astype(float)).astype(np.float32)
    which, best, tried = vector_codes.nearest(x, far, book, pivots)
    every = ((x[:, None] - book) ** 2).sum(-1)
    assert (which == every.argmin(1)).all() and (best == every.min(1)).all()
    assert tried < 0.5 * every.size  # most of the exact distances are never computed


# --- 13 ------------------------------------------------------------------------------

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *[T.StructField(n, T.StringType()) for n in ("digest", "part", "path", "start", "n_tokens", "ids")]])
EDGE_TEXTS = [
    None, "", " \t\n", "It's  what we'll see: don't! Über-GRÖSSE 123 4\x1f5 6 7 ́x", "<|endoftext|> a<|startoftext|>b", "Σίσυφος ΟΔΟΣ ΟΔΟΣ", "é ́e\ņc", "日本語 テキスト 🙂🙂 \U0001f468‍\U0001f469",
    "x" * 5000, "word " * 3000, "İstanbul ﬁ ǅ",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_vocabulary_path())


@pytest.mark.parametrize("n,bits", [(0, 4), (1, 1), (1000, 5), (600_000, 16), (5000, 17)])
def test_shard_answers(tmp_path, n, bits):
    rng = np.random.default_rng(n + bits)
    ids = (rng.zipf(1.3, n) % (1 << bits)).astype(np.uint32)
    wavelet.save(f"file://{tmp_path}/a.wm", ids, bits, [5, None], np.array([n // 3, n]))
    with wavelet.Shard(f"file://{tmp_path}/a.wm") as shard:
        assert (shard.tokens() == ids).all() and shard.doc_ids == [5, None] and shard.n == n
        for i in rng.integers(0, n, 20) if n else []:
            assert shard.access(int(i)) == ids[i]
        for token in {0, 1, int(ids[-1]) if n else 0, (1 << bits) - 1, 1 << bits, -1}:
            at = np.flatnonzero(ids == token) if token >= 0 else np.zeros(0, int)
            assert (shard.occurrences(token) == at).all() and shard.count(token) == len(at)
            lo, hi = n // 5, n - n // 7
            assert shard.count(token, lo, hi) == ((at >= lo) & (at < hi)).sum() and shard.rank(token, hi) == (at < hi).sum()
            for k in {0, len(at) // 2, len(at) - 1} if len(at) else ():
                assert shard.select(token, k) == at[k]
        with pytest.raises(IndexError):
            shard.access(n)
        with pytest.raises(IndexError):
            shard.select(0, n + 1)


def test_a_cut_shard_is_an_error(tmp_path):
    wavelet.save(str(tmp_path / "a.wm"), np.arange(1000), 10, [1], np.array([1000]))
    whole = (tmp_path / "a.wm").read_bytes()
    (tmp_path / "b.wm").write_bytes(whole[:-30])
    with pytest.raises(ValueError, match="cut"):
        wavelet.Shard(str(tmp_path / "b.wm"))


def test_encoder_is_the_library(library, spark):
    whole = wavelet.Encoder(word_vocabulary_path(), by_word=False)
    encoder = wavelet.Encoder(word_vocabulary_path())
    texts = [t or "" for t in EDGE_TEXTS] + [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert encoder.by_word and not whole.by_word
    want = [np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes() for text in texts]
    raw = [text.encode() for text in texts]
    assert encoder.ids(raw) == want == encoder.ids(raw) == whole.ids(raw)
    assert all(len(k) <= wavelet.KEPT_BYTES for k in encoder.pieces)
    assert [encoder.ids([x])[0] for x in raw] == want


def test_every_simple_character(library):
    """Alone, doubled, between letters and after an apostrophe, in both cases."""
    encoder = wavelet.Encoder(word_vocabulary_path())
    texts = [f"{a}{chr(c)}{b}" for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000 for a, b in (("", ""), ("A", "z"), ("1'", "S"))]
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert encoder.ids([x.encode() for x in texts]) == want


def test_words_are_forgotten_and_learnt_again(library, monkeypatch):
    monkeypatch.setattr(wavelet, "KEPT_PIECES", 50)
    encoder = wavelet.Encoder(word_vocabulary_path())
    rnd = random.Random(3)
    for _ in range(30):
        texts = [" ".join(f"w{rnd.randrange(200)}-{rnd.randrange(9)}é" for _ in range(20)) for _ in range(3)]
        assert encoder.ids([x.encode() for x in texts]) == [np.array(library.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


@pytest.mark.parametrize("shard_tokens", [1, 50, 1 << 22])
def test_shards_round_trip(spark, library, tmp_path, shard_tokens):
    rows = [(i * 7 % 40 - 3, t) for i, t in enumerate(EDGE_TEXTS * 3)] + [(None, "no id"), (None, "no id"), (None, None), (5, "same id"), (5, "same id"), (1 << 40, "large id")]
    table = spark.createDataFrame([(*r, *["x"] * 6) for r in rows], DOCS).repartition(6)
    manifest = wavelet.write(table, word_vocabulary_path(), f"file://{tmp_path}/shards", shard_tokens=shard_tokens)
    got = sorted(map(tuple, wavelet.read(manifest).collect()), key=lambda r: r[1])
    hashed = lambda t: 42 if t is None else int.from_bytes(xxhash.xxh64_digest(t.encode(), 42), "big", signed=True)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed(r[1])))
    start = 0
    for (i, text), row in zip(order, got, strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert row == (i, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)
    token = int(np.frombuffer(got[-1][4], "<u4")[0])
    want = collections.Counter((r[0], k) for r in got for k, t in enumerate(np.frombuffer(r[4], "<u4")) if t == token)
    assert collections.Counter(map(tuple, wavelet.occurrences(manifest, token).collect())) == want
    assert manifest.agg(F.sum("n_docs")).scalar() is not None and sum(r.n_docs for r in manifest.collect()) == len(rows)


def test_shards_of_an_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    back = wavelet.round_trip(empty, word_vocabulary_path())
    assert back.count() == 0 and dict(back.dtypes) == {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
