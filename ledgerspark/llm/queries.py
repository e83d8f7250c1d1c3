"""The registered queries of the text operators: each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import lm_scoring, quality
from ledgerspark.llm.bpe import encode_decode
from ledgerspark.llm.common import bounded_batches, documents
from ledgerspark.llm.credentials import find_credentials
from ledgerspark.llm.decontaminate import decontaminate, digests
from ledgerspark.llm.fingerprints import with_edits
from ledgerspark.llm.jaccard_join import jaccard_components
from ledgerspark.llm.language import fit, held_out, identify, train_rows
from ledgerspark.llm.line_dedup import dedup_lines
from ledgerspark.llm.pii import replace_entities


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return find_credentials(documents(spark, sf_dir))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return digests(decontaminate(documents(spark, sf_dir).select("doc_id", "text"), benchmark))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality.classify(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return with_edits(documents(spark, sf_dir))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the session's spark.ledgerspark.surrogate.key; without one, that of synthetic test data."""
    key = spark.conf.get("spark.ledgerspark.surrogate.key", "for synthetic data only")
    return replace_entities(documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return jaccard_components(documents(spark, sf_dir).select("doc_id", "text"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return encode_decode(documents(spark, sf_dir), tokenizer_path())


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), fit(train_rows(docs)))
    return found.select(found["doc_id"].cast("long"), held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = lm_scoring.train(docs.where(~lm_scoring.held_out()))
    scored = lm_scoring.score(docs, model)
    return scored.select("doc_id", lm_scoring.held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(F.col("doc_id").cast("long"), "n_lines", "n_removed", "emptied", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_decontaminate, op3_quality, op4_fingerprint, op5_pii_surrogates, op6_jaccard_join, op7_bpe, op8_language, op9_lm_score, op10_line_dedup)}


def oracle_sql() -> dict[str, str]:
    return {}
