"""A corpus pipeline over `documents`: rules, perplexity, near-duplicates, packing. Each stage reads what the one before wrote."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ephyra.llm.common import discard, materialize, table
from ephyra.llm.packing import pack
from ephyra.llm.quality_classifier import quality_classifier, trusted_rows
from ephyra.llm.quality_rules import quality_rules
from ephyra.llm.simhash import dedup

#: Near-duplicates: sets of five-word shingles with a similarity of 0.8 or more.
SHINGLE, SIMILARITY = 5, 0.8
LENGTH = 1024


#: What the operators read. All other columns pass through under names that no operator has.
READ = ("doc_id", "text", "lang", "source")


def keeping(stage):
    """A stage that returns the columns of its documents, whatever they are called."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        private = [c if c in READ else f"__kept{i}__" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*private), sf_dir).select(*private).toDF(*docs.columns)

    return run


@keeping
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, as they are."""
    return quality_rules(docs).where("kept")


@keeping
def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is within their language's limit."""
    trusted = trusted_rows(docs, table(spark, sf_dir, "labels"))
    return quality_classifier(docs, trusted).where("kept")


@keeping
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the least doc_id."""
    return dedup(docs, SHINGLE, SIMILARITY)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces, with their ids, of all documents in sequences of LENGTH tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), LENGTH)


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("simhash_dedup", near_duplicates), ("packing", packing)]

#: Models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs, last = materialize(stage(spark, docs, sf_dir)), docs
        discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
