"""The registered queries against their SQL twins, and the pipeline stage by stage."""

import collections
import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from sequin.llm import line_crf, mixing
from sequin.llm.oracle import ORACLE
from sequin.llm.queries import QUERIES, vocabulary_path
from tests.llm.test_operators import LOWER, components

SF_DIR = "/root/testdata/sf0.001"


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    clean = lambda v: round(v, 6) if isinstance(v, float) else int(v) if isinstance(v, bool) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=str)


def test_registered():
    names = {f"op{n}_" for n in range(1, 14)}
    assert {q.split("_")[0] + "_" for q in QUERIES} == names
    assert set(QUERIES) | {"pipeline"} <= set(E.queries())
    assert set(ORACLE) <= set(E.oracle_sql()) and "pipeline" not in E.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    df = QUERIES[name](spark, SF_DIR)
    cur = con.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(cols, cur.fetchall())


def test_queries_without_sql(spark):
    n = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    for name in sorted(set(QUERIES) - set(ORACLE)):
        assert QUERIES[name](spark, SF_DIR).count() == n


def test_pipeline_stage_by_stage(spark):
    """Each stage on what the stage before kept, against brute force; then the whole run."""
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    quality, exact, near, mix, tokens = [f for _, f in corpus_pipeline.STAGES]
    seen = [docs]
    for stage in (quality, exact, near, mix):
        out = stage(spark, seen[-1], SF_DIR)
        assert out.columns == docs.columns
        path = f"{spark.sparkContext.getCheckpointDir()}/test-{len(seen)}-{id(out)}"
        out.write.parquet(path)
        seen.append(spark.read.parquet(path))
    first, good, single, apart, mixed = [[tuple(r) for r in d.select("doc_id", "text", "source").collect()] for d in seen]
    kept = {r.doc_id for r in line_crf.decisions(docs, line_crf.train(docs, labels)).collect() if r.kept}
    assert sorted(r[0] for r in good) == sorted(kept)
    last = {}
    for i, t, _ in good:
        last[t.translate(LOWER)] = max(i, last.get(t.translate(LOWER), -1))
    assert sorted(r[0] for r in single) == sorted(last.values())
    assert sorted(r[0] for r in apart) == sorted(i for i, _, c in components(single) if i == c)
    assert set(r[0] for r in mixed) <= set(r[0] for r in apart) and dict((i, t) for i, t, _ in mixed).items() <= dict((i, t) for i, t, _ in apart).items()
    want = collections.Counter()
    for r in mixing.taken(*mixing.mix(seen[3])).collect():
        want[r.id] += math.floor(r.taken / r["size"] + 0.5) if r["size"] else 0
    assert collections.Counter(r[0] for r in mixed) == +want
    from sequin.llm.bpe import Vocabulary

    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=Vocabulary.read(vocabulary_path()).ranks, special_tokens={})
    got = tokens(spark, seen[4], SF_DIR).collect()
    texts = {i: t for i, t, _ in mixed}
    assert len(got) == len(mixed) and all(list(r.ids) == enc.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in got)
    whole = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(r.ids_sha256 for r in whole.collect()) == sorted(r.ids_sha256 for r in got)
    assert whole.select(F.col("doc_id")).count() == len(mixed)
