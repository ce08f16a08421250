"""The corpus pipeline: quality, near copies, benchmark passages, source weights, shards.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heronry.llm.classifier import accepted, trained
from heronry.llm.decontamination import decontaminated
from heronry.llm.mixing import mix, mixed_texts
from heronry.llm.ngram_join import one_of_each
from heronry.llm.runtime import forgotten, table, written
from heronry.llm.sharding import shard


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score under 0.3 go."""
    return accepted(docs, trained(docs, table(spark, sf_dir, "labels")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles at Jaccard 0.8 the smallest doc_id stays."""
    return one_of_each(docs, 5, 80, 100)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents drawn to the source weights; one that is drawn twice is there twice."""
    return mixed_texts(docs, mix(docs, whole=True))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards 0 to 23 over virtual slots."""
    return shard(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The classifier and the alignment can't be expressed in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each is written once, and deleted when the next one is."""
    docs, held = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        forgotten(*held)
        held = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
