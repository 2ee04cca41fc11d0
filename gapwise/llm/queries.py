"""Registered queries of the training-data operators, each over its whole table with the default parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gapwise.llm import conversation, decontaminate, html_text, langid, mixing, near, packing, phrases, pii, quality, repetition, url_filter, warc
from gapwise.llm.common import table
from gapwise.plans.registry import query


@query("op1_jaccard_join")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    found = near.similar_classes(table(spark, sf, "documents"))
    return found.select(found["id"].alias("doc_id"), "class_id", "n_links", "n_texts")


@query("op2_mix_sources", mixing.mix_sql())
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"))


@query("op3_warc_round_trip")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_main_text")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(table(spark, sf, "pages"))


@query("op5_repetition_rules")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return repetition.rules(table(spark, sf, "documents"))


@query("op6_decontaminate", decontaminate.find_sql())
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.find(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op7_url_filter", url_filter.judge_sql())
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge(table(spark, sf, "pages"))


@query("op8_language")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return langid.learn_and_identify(table(spark, sf, "documents"))


@query("op9_quality")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return quality.learn_and_score(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op10_personal_data")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return pii.report(pii.find(table(spark, sf, "documents")))


@query("op11_conversation_repair")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return conversation.repair(conversation.damage(table(spark, sf, "conversations")))


@query("op13_sequence_packing")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"))


@query("op12_phrase_collocations", phrases.mine_sql())
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.mine(table(spark, sf, "documents"))
