"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statutory.llm import alignment, chat, chosenpath, decontaminate, html, language, lines, media, packing, repeats, simhash, toxicity, whitening
from statutory.llm.common import id_hash_remainder, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = id_hash_remainder("doc_id", 5) == 0
    model = toxicity.train_on(documents, labels, ~held_out)
    return toxicity.score_documents(documents, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted", "spans"
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = media.media_features(media.with_media(table(spark, sf_dir, "documents")))
    return features.withColumn("feature", F.lower(F.hex("cosine_hash"))).drop("cosine_hash")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_report(table(spark, sf_dir, "pages"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_report(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_report(chat.with_control_conversation(table(spark, sf_dir, "conversations")))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(table(spark, sf_dir, "documents"), id_hash_remainder("doc_id", 4) == 2)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_embeddings(table(spark, sf_dir, "embeddings"))


def op13_chosenpath(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.near_duplicate_sets(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_decontaminate,
        op3_lines,
        op4_packing,
        op5_media,
        op6_html,
        op7_repeats,
        op8_chat,
        op9_language,
        op10_simhash,
        op11_alignment,
        op12_whitening,
        op13_chosenpath,
    )
}

ORACLES: dict[str, str] = {"op2_decontaminate": decontaminate.CONTAMINATION_SQL, "op8_chat": chat.CHAT_SQL}
