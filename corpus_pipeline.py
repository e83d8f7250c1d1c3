"""Corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a
DataFrame; all but the last return the columns of documents, whatever they are named: results never clash with them.

Edge cases: language ID drops null and empty texts and those without a letter, and whatever no centroid comes near. The later stages
keep such rows: null and empty texts have no lines, links, windows or tokens. Very long texts are worked on
whole. Repeated rows get the same decision; of equal texts line dedup keeps the one with the least doc_id (a tie keeps both), and
short ones are left to the Jaccard join. Rows without doc_id count as the last and are never dropped as duplicates. Empty
tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm.bpe import encode_decode
from ledgerspark.llm.common import bounded_batches, documents, free_names, named, written
from ledgerspark.llm.decontaminate import RESULTS, decontaminate
from ledgerspark.llm.jaccard_join import jaccard_components
from ledgerspark.llm.language import fit, identify, train_rows
from ledgerspark.llm.line_dedup import dedup_lines
from ledgerspark.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no language's centroids come near, and those without a letter, go."""
    bounded_batches(spark)
    model = fit(train_rows(docs.select("doc_id", "text", "lang")))
    found = identify(docs, model, keep=True)
    return found.where(~F.col(free_names(docs.columns, ("lang_pred", "score", "rejected"))["rejected"])).select(*named(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that an earlier place has are cut out; documents of which nothing is left go."""
    names = free_names(docs.columns, ("n_lines", "n_removed", "emptied"))
    found = dedup_lines(docs).where(~F.col(names["emptied"]))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col(names["n_removed"]) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(*named(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays; rows without doc_id stay."""
    bounded_batches(spark)
    groups = jaccard_components(docs.select("doc_id", "text"))
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*named(docs))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents, by the rule of hit words, go; others stay as they are."""
    bounded_batches(spark)
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~F.col(free_names(docs.columns, RESULTS)["contaminated"])).select(*named(docs))


def bpe_coding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of what is left: their number and the digests of ids and of the decoded text."""
    bounded_batches(spark)
    return encode_decode(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_coding", bpe_coding),
]

#: SQL can't express the centroids, the winnowed hashes or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), spark)
    return STAGES[-1][1](spark, docs, sf_dir)
