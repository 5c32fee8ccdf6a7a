"""From documents to a training mixture: quality rules, near-duplicates, benchmark passages, personal data, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from objcat.llm import decontamination, mixing, near, pii, rules
from objcat.llm.common import table
from objcat.session import staged

# Shares of the mixture, as in the query of that operator.
WEIGHTS, REST, SEED = {"src0": 0.2, "src1": 0.1, "src2": 0.1}, 0.6, 7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base limits or the learned list reject go."""
    return rules.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: fingerprints of five-word or four-word shingles, or 0.8 of the five-word shingles themselves."""
    return near.one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars is counted again."""
    return pii.clean(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks, in one global random order."""
    return mixing.mix(docs, WEIGHTS, REST, seed=SEED)


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("personal data", personal_data),
    ("mixing", mixture),
]

# Learned rules, fingerprints and trees have no form in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
