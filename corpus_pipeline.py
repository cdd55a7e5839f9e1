"""A corpus-cleaning pipeline of five of the training-data operators.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.

1. quality: documents that the classifier rejects go.
2. lines: lines that an earlier line matches go from the texts; documents stay, n_chars follows.
3. near_duplicates: of each group of documents that a Jaccard similarity of 0.8 or more on five-word shingles connects, the one
   with the smallest id stays. Fingerprints propose pairs, which are verified; what they miss is joined exactly.
4. decontamination: documents contaminated with benchmark passages go.
5. tokens: doc_id, n_tokens, ids (array<int>) and decoded text of what is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm._spark import stored
from paperloom.llm.bpe import bpe_encode
from paperloom.llm.decontamination import decontaminate
from paperloom.llm.line_dedup import drop_repeated_lines
from paperloom.llm.quality_classifier import is_held_out, keep_good, train_quality
from paperloom.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.5 or more; null and empty texts have the score of the prior. All columns and repeated rows stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~is_held_out("doc_id"))
    return keep_good(docs, train_quality(docs, labels))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line matches; n_chars follows. A null text stays null, identical rows lose the
    same lines, rows without an id are compared with nothing."""
    kept = drop_repeated_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id, rows without an id last; null and blank texts are one group."""
    return drop_near_duplicates(docs, shingle=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lies in windows of the benchmark; null texts have no words and stay."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of every document; a null text has no tokens. Repeated rows stay."""
    import public_tokenizers

    coded = bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"), carry=["doc_id"])
    return coded.select("doc_id", F.size("__ids").cast("long").alias("n_tokens"), F.col("__ids").alias("ids"), F.col("__decoded").alias("decoded"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: The stages are not expressible in SQL: a trained model, components of a graph and a tokenizer. tests/llm/test_pipeline.py
#: compares each with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, from the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
