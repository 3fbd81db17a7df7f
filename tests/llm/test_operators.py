"""The training-data operators against brute force, on small tables with edge rows."""

import collections
import hashlib
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sequin.llm import bpe, chat, ecoc, exact_dedup, kneser_ney, line_crf, line_windows, minhash, mixing, warc
from sequin.llm.common import salted_lookup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        # names that the operators use inside
        *[T.StructField(n, T.StringType()) for n in ("size", "key", "id", "digest", "n", "node", "_k", "block", "start")],
    ]
)
VOCABULARY = pytest.importorskip("public_tokenizers")


def docs(spark, rows):
    """rows: (doc_id, text, lang, source)."""
    return spark.createDataFrame([(*r, *["x"] * 9) for r in rows], DOCS)


def said(n, seed=0, words=400):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(["alpha", "beta", "Gamma", "delta", "rho", "tau", "mu"]) + str(rnd.randrange(words)) for _ in range(n))


EDGE = [
    (1, None, "en", "b"),
    (2, "", "en", "b"),
    (3, "Same Text here", "en", None),
    (4, "same text HERE", "de", "a"),
    (4, "same text HERE", "de", "a"),
    (None, "same text here", None, "a"),
    (6, "  \t\n ", "en", "c"),
    (7, "É same", "en", "c"),
    (8, "é same", "en", "c"),
    (9, "one\ntwo\nthree\nfour\n" * 40, "fr", "c"),
    (10, said(30_000), "en", "d"),
]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def test_salted_lookup_is_an_inner_join(spark):
    rows = spark.range(200).select((F.col("id") % 5).alias("k"), F.col("id").alias("v"))
    facts = spark.createDataFrame([(0, "a"), (1, "b"), (9, "z")], "k long, f string")
    got = salted_lookup(rows, facts, ["k"], F.col("v"), 4).select("k", "v", "f")
    assert sorted(got.collect()) == sorted(rows.join(facts, "k").select("k", "v", "f").collect())


# --- 9 -------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [3, 12, 28])
def test_exact_dedup(spark, bits):
    rows = EDGE + [(100 + i, f"copy {i % 7}", "en", "hot") for i in range(300)] + [(1000 + i, f"only {i}", "en", "x") for i in range(200)]
    table = docs(spark, rows).repartition(4)
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").translate(LOWER)].append(-1 if i is None else i)
    # 2^3 cells hold no information: all rows shuffle, the result is the same
    got = exact_dedup.decisions(table, max_bits=bits).collect()
    want = sorted((-1 if i is None else i, max(groups[(t or "").translate(LOWER)]), len(groups[(t or "").translate(LOWER)]), hashlib.sha256((t or "").translate(LOWER).encode()).digest()) for i, t, *_ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.keep_id is None else r.keep_id, r.group_size, bytes(r.digest)) for r in got) == want
    assert collections.Counter(bytes(r.digest) for r in got if r.kept) == collections.Counter({hashlib.sha256(k.encode()).digest(): 1 for k in groups})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact_dedup.keep(table, max_bits=bits)
    assert kept.columns == table.columns
    assert sorted((r.text or "").translate(LOWER) for r in kept.collect()) == sorted(groups)


# --- 2 -------------------------------------------------------------------------------


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    low = {}
    for a, (i, *_) in enumerate(rows):
        r = find(a)
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return [(i, len(sets[a]), low.get(find(a))) for a, (i, *_) in enumerate(rows)]


def test_near_dedup(spark):
    rnd = random.Random(5)
    rows = list(EDGE)
    for g in range(12):
        base = said(rnd.choice([6, 40, 120, 300]), g).split()
        for c in range(15):  # edits from none to too many, in chains
            text = base[:]
            for _ in range(rnd.randrange(6)):
                text[rnd.randrange(len(text))] = f"new{rnd.randrange(10**6)}"
            if rnd.random() < 0.3:
                base = text
            rows.append((1000 + 100 * g + c, " ".join(text), "en", "s"))
    rows = [r for r in rows if r[0] != 4] + [EDGE[3], EDGE[4]]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    table = docs(spark, rows).repartition(5)
    got = minhash.decisions(table)
    assert sorted((key((r.doc_id, r.n_shingles, r.component_id)) for r in got.collect())) == sorted(key(r) for r in components(rows))
    kept = minhash.keep(table)
    assert kept.columns == table.columns
    # the rows of null id: a copy of a document goes
    assert {r.doc_id for r in kept.collect()} == {i for i, _, c in components(rows) if i == c} - {None}


def test_near_copies_of_null_id_leave_one(spark):
    base = said(100, 77).split()
    rows = [(None, " ".join([*base[:50], f"w{i}", *base[51:]]), "en", "s") for i in range(40)] + [(None, said(60, 500 + i), "en", "s") for i in range(20)] + [(None, None, "en", "s"), (7, said(80, 900), "en", "s")]
    table = docs(spark, rows).repartition(4)
    got = minhash.decisions(table).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == 1 + 20 + 1 + 1
    left = [r.text for r in minhash.keep(table).collect()]
    assert len(left) == 23 and sum(t in {r[1] for r in rows[:40]} for t in left) == 1


def test_a_text_meets_its_class_by_id_and_text(spark):
    """Many rows of one id do not multiply: a row of the sets for each class."""
    rows = [(None, said(30, i), "en", "s") for i in range(200)]
    table = docs(spark, rows)
    signed = minhash.signatures(table, "doc_id", "text")
    needed = signed.select(F.monotonically_increasing_id().alias("node"), "id", "t", "s1", "s2").cache()
    assert minhash._maybe(table.select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("t")), needed.limit(10)).count() < 40
    assert minhash._sets(table, needed, "doc_id", "text").count() == 200


def test_pairs_come_once(spark):
    """Two near sets share many keys and rare members, and are met at the first of these."""
    base = said(200, 31).split()
    rows = [(i, " ".join(f"e{i}x{k}" if k == 20 * i + 10 else w for k, w in enumerate(base)), "en", "s") for i in range(6)]
    signed = minhash.signatures(docs(spark, rows), "doc_id", "text")
    classes = signed.withColumn("node", F.col("id")).cache()
    keyed = minhash.keys(classes).groupBy("node").agg(F.collect_set("key").alias("keys")).withColumn("root", F.col("node"))
    sets = minhash._sets(docs(spark, rows), classes.select("node", "id", "t", "s1", "s2"), "doc_id", "text")
    pairs = [tuple(r) for r in minhash.across(keyed, sets).collect()]
    shared = {r.node: set(r["keys"]) for r in keyed.collect()}
    assert len(pairs) == len(set(pairs)) == len({frozenset(p) for p in pairs})
    assert {frozenset(p) for p in pairs} == {frozenset((a, b)) for a in shared for b in shared if a < b and shared[a] & shared[b]}


def test_keys_meet_whatever_the_errors():
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 1 << 16, (300, minhash.SYMBOLS), dtype=np.uint16)
    other = sig.copy()
    for row in other:
        at = rng.choice(minhash.SYMBOLS, minhash.RADIUS, replace=False)
        row[at] ^= rng.integers(1, 1 << 16, len(at), dtype=np.uint16)
    a, b = minhash.chunk_keys(sig), minhash.chunk_keys(other)
    assert all(set(x) & set(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))
    assert not any(set(x) & set(y) for x, y in zip(a.tolist(), np.roll(b, 1, axis=0).tolist(), strict=True))


def test_an_id_of_two_texts_loses_only_the_copy(spark):
    one, two = said(60, 401), said(60, 402)
    rows = [(1, one, "en", "s"), (5, one + " more", "en", "s"), (5, two, "en", "s"), (6, None, "en", "s")]
    left = minhash.keep(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.text or "") for r in left) == [(1, one), (5, two), (6, "")]


def test_near_dedup_at_80_percent(spark):
    """Pairs between 80 and 85 % are near copies at 80 alone."""
    rows, share = [], {}
    for g in range(30):
        base = said(150, 300 + g).split()
        text = base[:]
        for k in range(1 + g % 6):  # each edit costs five shingles of 146
            text[20 * k + 10] = f"new{g}x{k}"
        rows += [(10 * g, " ".join(base), "en", "s"), (10 * g + 1, " ".join(text), "en", "s")]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        share[10 * g + 1] = 100 * len(a & b) / len(a | b)
    table = docs(spark, rows)
    assert sum(80 <= s < 85 for s in share.values()) >= 5 and sum(s < 80 for s in share.values()) >= 5
    for percent in (80, 85):
        gone = {r.doc_id for r in minhash.decisions(table, percent=percent).collect() if not r.kept}
        assert gone == {i for i, s in share.items() if s >= percent}
        assert {r.doc_id for r in minhash.keep(table, percent=percent).collect()} == {r[0] for r in rows} - gone


def test_radius_and_keys_follow_the_percent():
    assert [minhash.chunks_for(p) for p in (80, 85)] == [15, 12] and minhash.chunks_for(85) == minhash.CHUNKS
    rng = np.random.default_rng(4)
    sig = rng.integers(0, 1 << 16, (300, minhash.SYMBOLS), dtype=np.uint16)
    other = sig.copy()
    for row in other:
        at = rng.choice(minhash.SYMBOLS, 29, replace=False)
        row[at] ^= rng.integers(1, 1 << 16, len(at), dtype=np.uint16)
    a, b = minhash.chunk_keys(sig, 15), minhash.chunk_keys(other, 15)
    assert all(set(x) & set(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))


def test_a_group_of_thousands_stays_linear(spark):
    base = said(150, 9).split()
    rows = [(0, " ".join(base), "en", "s")]
    for i in range(1, 1500):
        text = base[:]
        text[i % 150] = f"edit{i}"
        rows.append((i, " ".join(text), "en", "s"))
    got = minhash.decisions(docs(spark, rows)).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_a_leader_with_the_signature_of_the_original(spark, monkeypatch):
    """Near copies are linked with the original alone; twelve others have its signature."""
    base = said(150, 9).split()
    edited = lambda *places: " ".join(f"new{i}x{places}".replace(" ", "") if i in places else w for i, w in enumerate(base))
    signed = lambda text: minhash.signature(minhash.shingle_sets(pa.array([text]))[0]).tobytes()
    same, rnd = [], random.Random(3)
    while len(same) < 12:
        text = " ".join(base[:k] + [f"w{rnd.randrange(10**9)}"] + base[k + 1 :]) if (k := rnd.randrange(12, 138)) else ""
        if signed(text) == signed(" ".join(base)):
            same.append(text)
    copies = [edited(10 + i % 60, 80 + i // 5) for i in range(300)]
    rows = [(i, text, "en", "s") for i, text in enumerate([" ".join(base), *same, *copies])]
    met, across = [], minhash.across
    monkeypatch.setattr(minhash, "across", lambda *a: met.append(across(*a).persist()) or met[0])
    table = docs(spark, rows).repartition(7)
    got = minhash.decisions(table).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((i, c) for i, _, c in components(rows))
    assert {r.component_id for r in got} == {0} and met[0].count() < 300


# --- 1 -------------------------------------------------------------------------------


def test_targets_are_the_fixed_point_of_resharing(spark):
    sizes = {"a": 100, "b": 5, "c": 1000, "d": 0, "e": 40, None: 7}
    got = {r.source: r for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    names = ["a", "b", "c", "d", "e", None]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    want, full = {}, set()
    while True:  # share by weight, stop at three times, share the excess again
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        want = {s: 3 * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in open_) for s in names}
        more = {s for s in open_ if want[s] > 3 * sizes[s]}
        if not more:
            break
        full |= more
    for s in names:
        assert got[s].target == pytest.approx(want[s]) and got[s].source_size == sizes[s]


def test_mix(spark):
    rows = EDGE + [(100 + i, said(1 + i % 90, i), "en", "hot" if i % 3 else f"s{i % 4}") for i in range(400)]
    table = docs(spark, rows)
    placed, shares, pieces = mixing.mix(table, block=16)
    every = mixing.taken(placed, shares, pieces).collect()
    assert len(every) == len(rows)
    assert sorted(r["size"] for r in every) == sorted(len(WORD.findall(t or "")) for _, t, *_ in rows)
    for s in shares.collect():
        own = [r.taken for r in every if r.source == s.source]
        assert abs(sum(own) - s.target) <= 1
    assert all(0 <= r.taken <= 3 * r["size"] for r in every)
    # a source's blocks come in turn, each once, and a slot takes one block
    slots = pieces.groupBy("n").agg(F.sum("words").alias("w"), F.countDistinct(F.coalesce("source", F.lit("-")), "block").alias("k")).collect()
    assert all(r.k == 1 and r.w <= 16 for r in slots)
    again = mixing.taken(*mixing.mix(table.repartition(7), block=16)).collect()
    assert sorted((r.id or -1, r["size"], r.taken) for r in every) == sorted((r.id or -1, r["size"], r.taken) for r in again)
    mixed = mixing.repeat(table, block=16)
    assert mixed.columns == table.columns
    counts = collections.Counter(r.doc_id for r in mixed.collect())
    want = collections.Counter()
    for r in every:
        want[r.id] += math.floor(r.taken / r["size"] + 0.5) if r["size"] else 0
    assert counts == +want


def test_mix_leaves_no_small_source_out(spark):
    """One hot source beside sources of 10 to 1,000 words: each takes its target, to the word."""
    sizes = [10, 20, 40, 60, 80, 100, 130, 160, 200, 230, 256, 257, 300, 400, 500, 512, 600, 700, 800, 1000]
    rows = [(i, said(5_000, i), "en", "hot") for i in range(80)]
    for k, size in enumerate(sizes):
        whole = said(size, 1000 + k).split()
        rows += [(1000 + 100 * k + i, " ".join(whole[i * 50 : (i + 1) * 50]), "en", f"tiny{k:02}") for i in range(-(-size // 50))]
    table = docs(spark, rows)
    placed, shares, pieces = mixing.mix(table)
    sums = {r.source: r.words for r in mixing.taken(placed, shares, pieces).groupBy("source").agg(F.sum("taken").alias("words")).collect()}
    want = {r.source: math.floor(r.target + 0.5) for r in shares.collect()}
    assert len(want) == 1 + len(sizes) and all(0 < want[f"tiny{k:02}"] <= 3 * n for k, n in enumerate(sizes))
    assert sums == want
    # a slot takes one block of one source, and a block one slot
    slots = pieces.select("n", "source", "block").distinct()
    assert slots.count() == slots.select("n").distinct().count() == slots.select("source", "block").distinct().count()


# --- 5 -------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", r"<\/s> <\\/s> [\INST]", "<<s>> [[SYS]] [/ROLE] [TEXT]", "", None, "plain \\ text\n<s", "[", "<"]
    turns = [(1, 0, "system", "be kind"), (1, 1, "user", nasty[0]), (1, 2, "assistant", nasty[0]), (None, 0, "user", "no id"), (3, 0, "assistant", "first"), (3, 1, "tool [TEXT]</s>", nasty[2]), (4, None, None, None), (5, 0, "user", "twice"), (5, 0, "user", "twice")]
    turns += [(10 + i, k, ("user", "assistant")[k % 2], t) for i in range(len(nasty)) for k, t in enumerate((nasty[i:] + nasty[:i])[:4])]
    table = spark.createDataFrame([(*t, "x", "y") for t in turns], "conv_id long, turn long, role string, text string, formatted string, segments string")
    got = {r.conv_id: r for r in chat.format_chat(table).withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    want = collections.defaultdict(list)
    for c, k, role, text in turns:
        want[c].append((-1 if k is None else k, role or "", text or ""))
    for c, own in want.items():
        own.sort()
        assert [(t.role, t.text) for t in got[c].back] == [(r, t) for _, r, t in own]
        assert [t.loss for t in got[c].back] == [r == "assistant" for _, r, _ in own]
        assert got[c].formatted == "".join(s.text for s in got[c].segments)
        assert sum(s.loss for s in got[c].segments) == sum(r == "assistant" for _, r, _ in own)
    assert got[1].valid and got[10].valid and not got[3].valid and not got[4].valid and not got[5].valid
    assert chat.format_chat(table.limit(0)).count() == 0


def test_template_refuses_strings_that_could_arise_across_turns():
    with pytest.raises(ValueError):
        chat.Template(other=chat.Role("<<x>>", "</x>")).controls()


# --- 6 -------------------------------------------------------------------------------


def test_bpe_is_tiktokens(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = VOCABULARY.path("byte_bpe_multi_50k.tiktoken")
    voc = bpe.Vocabulary.read(path)
    voc.room = 50  # the cache is emptied again and again
    enc = tiktoken.Encoding("own", pat_str=VOCABULARY.PATTERN, mergeable_ranks=voc.ranks, special_tokens={})
    rnd = random.Random(2)
    bits = ["'", "s", "t", "re", "ve", "ll", "'s", "r", "v", "l", " ", "  ", "\n", "\t", "\r\n", "1", "½", "É", "!", "<|endoftext|>", " ", "　", "漢", "\x1c", "😀", "́", "Ⅷ", "Ᲊ", "\U00013460", "\U00016130", ""]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(40))) for _ in range(3000)]
    texts += ["a" * 3000, "ab" * 2000, " " * 500, "!" * 777, "x\n" * 300, "", None]
    for t, ids in zip(texts, voc.encode(texts), strict=True):
        assert enc.encode_ordinary(t or "") == ids.tolist()
        assert voc.decode(ids) == (t or "").encode()
        assert voc.offsets(ids)[-1] == len((t or "").encode())
    table = docs(spark, EDGE)
    got = bpe.decode(bpe.encode(table, path, offsets="at"), path).collect()
    assert len(got) == len(EDGE)
    for r in got:
        assert r.ids == enc.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
        assert [bytes(r.decoded)[a:b] for a, b in zip(r["at"], r["at"][1:], strict=False)] == [voc.bytes_of[i] for i in r.ids]
    assert bpe.digests(table.limit(0), path).count() == 0


def test_bpe_classes_are_the_patterns():
    tiktoken = pytest.importorskip("tiktoken")
    # merges of a letter, digit or mark with the next byte show whether a character joins it
    ranks = {bytes([i]): i for i in range(256)}
    for pair in (bytes([f, b]) for f in b"a1!" for b in range(256)):
        ranks.setdefault(pair, len(ranks))
    enc = tiktoken.Encoding("probe", pat_str=VOCABULARY.PATTERN, mergeable_ranks=ranks, special_tokens={})
    kinds = bpe._kinds()
    rnd = random.Random(1)
    points = {p for span in (*bpe._NEW_LETTERS, *bpe._NEW_NUMBERS) for p in span} | set(range(0x3100)) | set(rnd.sample(range(0x3100, 0x20000), 4000))
    for p in points:
        if unicodedata.category(chr(p)) == "Cs":
            continue
        joins = [enc.encode_ordinary(f + chr(p))[0] > 255 for f in "a1!"]
        assert joins == [kinds[p] == k for k in (bpe.LETTER, bpe.NUMBER, bpe.OTHER)], hex(p)


# --- 7 -------------------------------------------------------------------------------


def test_line_windows(spark):
    rnd = random.Random(4)
    passage = [f"shared line {i}" for i in range(6)]
    rows = list(EDGE)
    for i in range(60):
        lines = [rnd.choice(["a", "b", "", "c"]) if rnd.random() < 0.4 else f"line {i} {k}" for k in range(rnd.randrange(12))]
        at = rnd.randrange(len(lines) + 1)
        rows.append((100 + i, "\n".join(lines[:at] + (passage[rnd.randrange(3) :] if i % 2 else []) + lines[at:]), "en", "s"))
    rows = [r for r in rows if r[0] != 4] + [EDGE[3]]
    rows += [(None, "\n".join(passage)), (None, "x\n" + "\n".join(passage)), (None, "x\n" + "\n".join(passage)), (None, "own\nlines\nhere")]
    rows += [(500, "p\nq\nr\ns"), (500, "0\np\nq\nr"), (501, "t\nu\nv"), (502, "t\nu\nv\nw"), (502, "t\nu\nv\nw")]
    rows = [(i, t, "en", "s") for i, t, *_ in rows]
    order = lambda i, t: (i is not None, i or 0, hashlib.md5(t.encode()).hexdigest())
    places = collections.defaultdict(set)
    for i, t, *_ in rows:
        if t is not None:
            x = t.split("\n")
            for k in range(len(x) - 2):
                if any(y.strip(" ") for y in x[k : k + 3]):
                    places[tuple(x[k : k + 3])].add((order(i, t), k))
    gone = collections.defaultdict(set)
    for own in places.values():
        for place, k in sorted(own)[1:]:
            gone[place] |= {k, k + 1, k + 2}
    want = collections.Counter()
    for i, t, *_ in rows:
        lost = gone[order(i, t)] if t is not None else set()
        x = [] if t is None else t.split("\n")
        want[i, len(x), len(lost), None if t is None else "\n".join(y for k, y in enumerate(x) if k not in lost)] += 1
    got = line_windows.drop_lines(docs(spark, rows).withColumnRenamed("n", "lines"))
    assert collections.Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got.collect()) == want


# --- 4 -------------------------------------------------------------------------------


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    triples = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def test_line_counts():
    rnd = random.Random(6)
    texts = [None if k % 17 == 0 else "".join(rnd.choice(["a", "b ", "\n", "\t", "é|", "# ", "a a a b ", "\n\n", "A B C\n", "\x0b", "\x85"]) for _ in range(k % 40)) for k in range(2000)]
    got = line_crf.read_lines(pa.array(texts, pa.string())).counts
    assert list(zip(*[got[k].tolist() for k in line_crf._COUNTS], strict=True)) == [counts(t) for t in texts]


def test_viterbi_is_the_best_path_and_the_gradient_finds_the_labels():
    rnd = random.Random(8)
    clean = ["The quick story goes on here.", "And then it ends, quietly.", "A plain line of words."]
    junk = ["BUY!! NOW!! BUY!! NOW!!", "a | b | c | d | e", "x### y$$$ z%%%"]
    texts = ["\n".join(rnd.choice(clean if k % 2 else junk) for _ in range(rnd.randint(1, 6))) for k in range(200)]
    lines = line_crf.read_lines(pa.array(texts))
    field = line_crf.fit(lines, lines.doc % 2, steps=60)
    got = line_crf.viterbi(field, lines)
    assert (got == lines.doc % 2).mean() > 0.98
    emit = field.scores(lines)
    for d in range(30):  # all paths of short texts
        at = np.flatnonzero(lines.doc == d)
        paths = [[(p >> k) & 1 for k in range(len(at))] for p in range(1 << len(at))]
        value = lambda y: field.start[y[0]] + sum(emit[i, k] for i, k in zip(at, y, strict=True)) + sum(field.move[a, b] for a, b in zip(y, y[1:], strict=False))
        assert value(got[at].tolist()) == pytest.approx(max(map(value, paths)))


def test_quality_rules(spark):
    table = docs(spark, EDGE)
    labels = spark.createDataFrame([(10, 1, 0), (9, 0, 0), (9, 1, 0), (None, 0, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    field = line_crf.train(table, labels)
    got = line_crf.decisions(table, field).collect()
    assert [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got] == [(i, *counts(t)) for i, t, *_ in EDGE]
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    kept = line_crf.keep(table, field)
    assert kept.columns == table.columns and [r.doc_id for r in kept.collect()] == [r.doc_id for r in got if r.kept]
    none = line_crf.train(table, labels.limit(0))
    assert all(r.kept != r.base_failed for r in line_crf.decisions(table, none).collect())
    assert line_crf.decisions(table.limit(0), none).count() == 0


def test_held_out_quality(spark):
    path = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    field = line_crf.train(table, labels.filter("doc_id % 2 = 0"))
    got = line_crf.decisions(table, field).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").collect()
    assert len(got) > 50 and sum(r.kept == (r.quality == 1) for r in got) >= 0.98 * len(got)


# --- 8 -------------------------------------------------------------------------------


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 8, 20):
        code = ecoc.codewords(n)
        assert code.shape[0] == n and len({tuple(r) for r in code.tolist()}) == n
        assert all(len(set(c)) == 2 for c in code.T.tolist())


def test_language_id(spark):
    path = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{path}/documents.parquet")
    model = ecoc.train(table.filter("doc_id % 2 = 0"), sample=60)
    got = ecoc.predictions(table, model).join(table.select("doc_id", "lang"), "doc_id").filter("doc_id % 2 = 1").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.98 * len(got) and all(0 <= r.score <= 1 for r in got)
    edge = ecoc.predictions(docs(spark, [*EDGE, (11, "12 !! 34", "en", "a")]), model).collect()
    assert [r.lang_pred == "und" for r in edge] == [not any(c.isalpha() for c in t or "") for _, t, *_ in [*EDGE, (11, "12 !! 34", "en", "a")]]
    assert {r.score for r in edge if r.lang_pred == "und"} == {0.0}
    one = ecoc.train(docs(spark, EDGE).filter("lang = 'de'"))
    assert {r.lang_pred for r in ecoc.predictions(docs(spark, EDGE), one).collect()} == {"de", "und"}
    nothing = ecoc.train(docs(spark, EDGE).limit(0))
    assert {r.lang_pred for r in ecoc.predictions(docs(spark, EDGE), nothing).collect()} == {"und"}


def plain_margins(model, text):
    """The classifiers' margins of a text, n-gram by n-gram."""
    folded = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in (text or "").encode())
    cells = collections.Counter()
    for k in (1, 2, 3):
        for at in range(len(folded) - k + 1):
            gram = int.from_bytes(folded[at : at + k], "big") + (k << 24)
            cells[(gram * 2654435761 % 2**32) >> (32 - ecoc.BITS)] += 1
    norm = max(math.sqrt(sum(cells.values())), 1e-9)
    return [sum(math.sqrt(n) / norm * float(model.weights[c, b]) for c, n in cells.items()) + float(model.weights[-1, b]) for b in range(model.code.shape[1])]


def test_language_decoding_is_the_plain_one(spark):
    """Margins, loss-weighted decoding, score, ambiguity and the trust weights, one by one."""
    rnd = random.Random(8)
    letters = {"aa": "abcde fg", "bb": "efghij k", "cc": "ijklma é", "dd": "öüäbcd e", "ee": "aeiou xy"}
    texts = [("".join(rnd.choice(own) for _ in range(rnd.randrange(20, 90))), lang) for lang, own in letters.items() for _ in range(25)]
    model = ecoc.fit([t for t, _ in texts], [lang for _, lang in texts], steps=12)
    assert model.langs == sorted(letters)
    right = {lang: [0.0] * model.code.shape[1] for lang in letters}
    for t, lang in texts:
        for b, margin in enumerate(plain_margins(model, t)):
            right[lang][b] += margin * model.code[model.langs.index(lang), b] > 0
    for i, lang in enumerate(model.langs):
        share = [n / 25 + 1e-3 for n in right[lang]]
        assert np.allclose(model.trust[i], [x / sum(share) for x in share], atol=0.06)  # a margin of nearly 0 may round
    rows = [(i, "".join(rnd.choice("abcdefghijklmxy öüä") for _ in range(rnd.randrange(1, 40))), "x", "s") for i in range(60)] + EDGE[:-1]
    got = {(r.doc_id, i): r for i, r in enumerate(ecoc.predictions(docs(spark, rows).coalesce(1), model).collect())}
    seen = set()
    for (i, t, *_), r in zip(rows, got.values(), strict=True):
        margins = plain_margins(model, t)
        loss = [sum(float(w) * math.log1p(math.exp(-m * int(c))) for w, m, c in zip(model.trust[k], margins, model.code[k])) for k in range(5)]
        first, second = sorted(loss)[:2]
        known = any(c.isalpha() for c in t or "")
        weights = [math.exp(-(x - first) * ecoc.SHARPNESS) for x in loss]
        assert r.lang_pred == (model.langs[loss.index(first)] if known else "und") or second - first < 1e-5
        assert math.isclose(r.score, 1 / sum(weights) if known else 0.0, abs_tol=1e-4)
        assert r.ambiguous == (known and second - first < ecoc.MARGIN) or abs(second - first - ecoc.MARGIN) < 1e-5
        seen.add((r.lang_pred, r.ambiguous))
    assert len({a for a, _ in seen}) >= 4 and {b for _, b in seen} == {True, False}


# --- 3 -------------------------------------------------------------------------------


def test_kneser_ney_is_the_plain_model(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "BUFFER", 500)  # several shares of a partition's counts
    rnd = random.Random(3)
    rows = EDGE[:-1] + [(100 + i, " ".join(f"W{int(rnd.paretovariate(0.7)) % 80}" for _ in range(rnd.randrange(60))), "en", "s") for i in range(150)]
    rows.append((500, "The " * 400 + "end", "en", "s"))
    table = docs(spark, rows).repartition(3)
    train = [t for i, t, *_ in rows if (zlib.crc32(str(i).encode()) if i is not None else 0) % 5 != 1]
    model = kneser_ney.train(table.filter(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 1))
    pairs = collections.Counter()
    for t in train:
        w = [*words(t), None]
        pairs.update(zip(["<s> "] + w[:-1], w))
    kinds, uni, right = collections.Counter(), collections.Counter(), collections.defaultdict(collections.Counter)
    for (a, b), c in pairs.items():
        kinds[b] += 1
        uni[b] += c
        right[a][b] = c

    def discounts(values):
        n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
        assert all(n)
        y = n[0] / (n[0] + 2 * n[1])
        own = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        return [0, *(x if 0 < x <= k else (0.5, 1.0, 1.5)[k - 1] for k, x in enumerate(own, 1))]

    d2, d1, v, n = discounts(pairs.values()), discounts(kinds.values()), len(uni), sum(uni.values())

    def p(a, b):
        low = max(kinds[b] - d1[min(kinds[b], 3)], 0) / len(pairs) + sum(d1[min(c, 3)] for c in kinds.values()) / len(pairs) / (v + 1)
        if a not in right:
            return low
        own, total = right[a], sum(right[a].values())
        return max(own[b] - d2[min(own[b], 3)], 0) / total + sum(d2[min(c, 3)] for c in own.values()) / total * low

    assert (model.train_tokens, model.n_types, model.n_pairs) == (n, v, len(pairs))
    assert sum(p("w1", b) for b in uni) + p("w1", "never seen") == pytest.approx(1)
    want = {}
    for i, t, *_ in rows:
        w = [*words(t), None]
        want[i] = (len(w), sum(uni[x] > 0 for x in w), sum(math.log10((uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), sum(math.log10(p(a, b)) for a, b in zip(["<s> "] + w[:-1], w)))
    got = kneser_ney.scores(table, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.n_known) == want[r.doc_id][:2]
        assert (r.base_score, r.score) == pytest.approx(want[r.doc_id][2:])


def test_kneser_ney_without_training_texts(spark):
    model = kneser_ney.train(docs(spark, EDGE).limit(0))
    got = kneser_ney.scores(docs(spark, EDGE), model).collect()
    assert all(r.score == 0 and r.n_known == 0 for r in got)


# --- 10 ------------------------------------------------------------------------------


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    rnd = random.Random(1)
    big = "".join(rnd.choice("<p>é \r\n") for _ in range(200_000))
    pages = [(1, "http://a/1", "x" * 1000), (2, "http://a/2", "x" * 1000), (2, "http://a/2", "x" * 1000), (3, None, "x" * 999), (4, "u\r\nv", "x" * 999), (5, "u", None), (6, "u", ""), (7, "u", big), (8, "u", big + "!"), (9, "u", big), (None, "u", "x" * 1000), (10, "u", "WARC/1.1\r\n\r\n")]
    table = spark.createDataFrame([(*p, "z", "z") for p in pages], "page_id long, url string, html string, digest string, bytes string").repartition(3)
    chunks = warc.round_trip(table).collect()
    by = collections.defaultdict(list)
    for r in sorted(chunks, key=lambda r: r.chunk):
        by[r.record_id].append(r)
    assert len(by) == len(pages)
    got = []
    for own in by.values():
        assert [r.chunk for r in own] == list(range(len(own))) and [r.last for r in own] == [False] * (len(own) - 1) + [True]
        data = b"".join(bytes(r.data) for r in own)
        at = 0
        for r in own:
            at += len(r.data)
            assert len(r.data) <= warc.CHUNK and r.bytes_so_far == at and r.sha1_so_far == hashlib.sha1(data[:at]).hexdigest()
        got.append((own[0].page_id, own[0].record_type, own[0].refers_to, own[0].stated_digest, data.decode() if own[0].record_type == "response" else None))
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = []
    seen = set()
    for i, _, t in pages:
        same = [j for j, _, u in pages if u == t and j is not None]
        first = len((t or "").encode()) < 1000 or (i == max(same) and (i, t) not in seen)
        seen.add((i, t))
        want.append((None if i is None else str(i), "response" if first else "revisit", None if first else str(max(same)), sha(t), (t or "") if first else None))
    order = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=order) == sorted(want, key=order)
    # a revisit names a response's record, of the same payload
    heads = {k: own[0] for k, own in by.items()}
    for r in heads.values():
        if r.record_type == "revisit":
            of = heads[r.refers_to_record]
            assert (of.record_type, of.page_id, of.stated_digest) == ("response", r.refers_to, r.stated_digest)
        else:
            assert r.refers_to_record is None
    assert warc.round_trip(table.limit(0)).count() == 0


def test_payloads_leave_as_chunk_rows(spark):
    pages = [(1, "u", "é" * 100), (2, "u", "a" * 50), (3, "u", None), (4, "u", "b" * 49)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"digest": F.lit("x"), "bytes": F.octet_length(F.coalesce("html", F.lit(""))).cast("long"), "record_type": F.when(F.col("page_id") == 2, "revisit").otherwise("response"), "refers_to": F.lit(None).cast("long")})
    got = collections.defaultdict(list)
    for r in warc.chunk_rows(rows, 49).collect():
        got[r.page_id].append((r.chunk, r["last"], bytes(r.data)))
    whole = ("é" * 100).encode()
    assert got[1] == [(k, k == 4, whole[49 * k : 49 * k + 49]) for k in range(5)]
    assert got[2] == [(0, True, b"")] and got[3] == [(0, True, b"")] and got[4] == [(0, True, b"b" * 49)]
