"""The corpus pipeline: STAGES applied to documents one after another, each written as Parquet and read again.

Languages are told and rejected documents go; of near copies one document stays; personal data is masked; sources are interleaved
to target weights, so that the files hold the rows in the order of the mix; texts become byte-level BPE ids.

Defined results: null and empty texts, and texts without a letter, have no language and go in the first stage; given to a later stage they stay (each a
document of its own), have nothing to mask, and no ids. Null ids, sources and counts stay null, and a null source is mixed as the source ''. Of repeated rows
one stays in near_copies; elsewhere each is a row of its own. Texts of any length are taken whole. Columns other than those of documents go in each stage's first
step, whatever their names. An empty table gives an empty table in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoframe.llm import byte_bpe, language_id, ngram_join, pii, source_mix
from geoframe.llm.common import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is told with enough confidence."""
    docs = docs.select(*COLUMNS)
    return language_id.kept(docs, language_id.fit(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of 5-word shingles of similarity 0.8 or more: the one of the smallest id."""
    return ngram_join.keep_one(docs.select(*COLUMNS))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked by its kind; n_chars follows the text."""
    out = pii.mask(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in the order of the mix, within and across the files."""
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return source_mix.mix(docs.select(*COLUMNS), files=files).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and digests of the ids and of what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = docs.select(F.struct("doc_id", "lang", "source").alias("row"), "text")
    out = byte_bpe.encode_and_decode(rows, path, public_tokenizers.PATTERN, "row")
    return out.select("row.*", F.size("ids").cast("long").alias("n_tokens"), "ids", byte_bpe.digest(F.col("ids")).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES = [("language", language), ("near_copies", near_copies), ("private", private), ("mixture", mixture), ("tokens", tokens)]
#: The first stage's model and the last one's merges are beyond SQL: tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
