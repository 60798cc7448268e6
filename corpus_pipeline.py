"""The corpus pipeline: documents to token files in five stages.

Each stage works on all that its predecessor kept and is written as Parquet before the next one reads it. All but the last return the columns of documents, and others that are
there, whatever their names. Null and empty texts, null and repeated ids, repeated rows and empty tables are as the stages' operators say; no stage crashes on them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rillflow.llm import dac, decontaminate, mixing, ngram_join, quality_classifier
from rillflow.llm.common import written

#: Documents below this probability of good quality are rejected.
LEAST_SCORE = 0.5
#: Near copies: this share of common shingles, in percent, of so many words.
PERCENT, SHINGLE = 80, 5


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier does not reject; an empty text is judged by the bias alone."""
    return quality_classifier.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), LEAST_SCORE)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of near copies; documents without words, and such as only share an id or have none, all stay."""
    return ngram_join.one_of_each(docs, percent=PERCENT, size=SHINGLE)


def decontaminate_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item; documents without words stay."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources: every document once at least, no source more than twice."""
    return mixing.mixed(docs, max_repeat=2.0)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files and returns what is read back from them, one row for each copy of a document."""
    return dac.token_output(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", classify), ("n-gram Jaccard join", deduplicate), ("benchmark decontamination", decontaminate_), ("source mixing", mix), ("token output", tokenize)]
#: The first stage is a trained model, which SQL cannot express; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
