"""A corpus from raw documents to token ids: five stages, each over all that its predecessor kept.

Edge cases: null and empty texts fail the quality rules and go; rows with a
null doc_id are documents of their own, equal ones alike, up to the token
stage; repeated rows are copies, of which one stays; an empty table gives an
empty result; columns beyond those of documents are kept up to the token stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyloom.llm import decontaminate, mixing, ngram_join, quality_rules, token_output
from skyloom.llm.common import dropped, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy of the quality rules."""
    return quality_rules.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-word shingles link at a similarity of 0.75."""
    return ngram_join.deduplicated(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, written in the binary format and read back."""
    return token_output.digests(docs)


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", benchmark_free),
    ("mixing", mixture),
    ("token_output", token_ids),
]

#: The token stage has no SQL form; tests/llm compares the whole with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
