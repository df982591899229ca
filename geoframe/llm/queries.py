"""The queries opN_<name> of this subpackage with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoframe.llm import byte_bpe, chat_format, embedding_dedup, filter_audit, language_id, license_scan, ngram_join, pii, quality, source_mix, topk_search, turn_repair, url_filter
from geoframe.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(license_scan.scan(table(spark, sf_dir, "documents")))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk_search.quantized(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk_search.search(rows.where("id % 100 = 0"), rows)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    return source_mix.mix(docs)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = language_id.predict(docs, language_id.fit(docs))
    return told.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.predict(docs, *quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", language_id.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


#: A conversation whose texts are control strings of another template, beside those of the table.
STEERING = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame(STEERING, "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.read_back(chat_format.reconstruct(chat_format.log_of(rows)))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(table(spark, sf_dir, "documents")))


#: The rules of the query op11; what they do not judge is judged by outcomes: a page is bad if the label of its id says quality 0.
URL_RULES = [url_filter.Rule(*r) for r in (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).cast("int").alias("bad"))
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES, labels)


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repaired(turn_repair.damaged(table(spark, sf_dir, "conversations")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_topk_search, op3_ngram_join, op4_source_mix, op5_language_id, op6_embedding_dedup, op7_byte_bpe, op8_quality, op9_chat_format, op10_pii, op11_url_filter, op12_turn_repair, op13_filter_audit)}

ORACLES: dict[str, str] = {"op1_license_scan": license_scan.oracle_sql(), "op2_topk_search": topk_search.oracle_sql(), "op3_ngram_join": ngram_join.oracle_sql(), "op4_source_mix": source_mix.oracle_sql(), "op6_embedding_dedup": embedding_dedup.oracle_sql(), "op9_chat_format": chat_format.oracle_sql(STEERING), "op10_pii": pii.oracle_sql(), "op11_url_filter": url_filter.oracle_sql(URL_RULES), "op12_turn_repair": turn_repair.oracle_sql(), "op13_filter_audit": filter_audit.oracle_sql()}
