"""The registered queries of the operators: thin columns over each operator's results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, ecoc, exact_dedup, kneser_ney, line_crf, line_windows, minhash, mixing, turn_repair, vector_codes, warc, wavelet
from .common import id_mod, settle, stored, table


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def word_vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.taken(*mixing.mix(table(spark, sf_dir, "documents")))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.decisions(table(spark, sf_dir, "documents"))


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_mod("doc_id", 5) == 1
    model = kneser_ney.train(docs.filter(~held_out))
    return kneser_ney.scores(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = line_crf.train(docs, table(spark, sf_dir, "labels"))
    return line_crf.decisions(docs, field)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = chat.Template()
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = dict(turns.dtypes)
    # the contract's own conversation of control strings
    own = spark.range(2).select(F.lit(-1).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    done = chat.format_chat(turns.unionByName(own), template)
    back = done.select("conv_id", "formatted", "valid", chat.read_back(F.col("formatted"), template).alias("turns"), F.filter("segments", lambda s: s["loss"]).alias("trained"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join(F.transform("trained", lambda s: chat.unescape(s["text"], template)), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op7_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_windows.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_mod("doc_id", 4) == 2
    model = ecoc.train(docs.filter(~held_out))
    return ecoc.predictions(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.decisions(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = warc.round_trip(table(spark, sf_dir, "pages")).filter("last")
    response = F.col("record_type") == "response"
    return last.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.when(response, F.col("bytes_so_far")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(response, F.col("sha1_so_far")).otherwise(F.col("stated_digest")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op11_repair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(turn_repair.faults(turn_repair.damage(table(spark, sf_dir, "conversations"))))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(table(spark, sf_dir, "embeddings"))


def op13_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wavelet.round_trip(table(spark, sf_dir, "documents"), word_vocabulary_path())
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


# --- the pipeline's stages: (spark, docs, sf_dir) to documents, the last to tokens ------
# each lets go of its predecessor's finished plans first


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_crf.keep(docs, line_crf.train(docs, table(spark, sf_dir, "labels")))


def stage_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    return exact_dedup.keep(docs)


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    return minhash.keep(docs)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    return mixing.repeat(docs)


def stage_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    return bpe.digests(docs, vocabulary_path(), ids="ids")


def run_stages(spark: SparkSession, sf_dir: str, stages: list[tuple[str, Callable]]) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in stages[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return stages[-1][1](spark, docs, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mix_sources, op2_minhash_near_dedup, op3_kneser_ney, op4_quality_rules, op5_chat_format, op6_byte_bpe, op7_line_windows, op8_language_id, op9_exact_dedup, op10_warc, op11_repair_turns, op12_vector_codes, op13_wavelet_shards)
}
