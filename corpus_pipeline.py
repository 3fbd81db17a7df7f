"""A training corpus from ``documents``: five stages, each one of the operators of ``sequin.llm``.

Each function takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``. The driver, or
``run``, writes each result as Parquet and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sequin.llm import queries as _q

STAGES = [
    ("quality_rules", _q.stage_quality),
    ("exact_dedup", _q.stage_exact),
    ("near_dedup", _q.stage_near),
    ("mix_sources", _q.stage_mix),
    ("byte_bpe", _q.stage_tokens),
]

#: Labelling by a trained model and byte-pair merging have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _q.run_stages(spark, sf_dir, STAGES)
