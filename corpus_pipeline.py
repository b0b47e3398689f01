"""A corpus pipeline over ``documents``: five stages, each an operator whose decisions take effect.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next stage's docs. All but
the last return the columns of ``documents``.

1. toxicity: documents that the classifier rejects go.
2. neardup: one document of each group of near-duplicates stays (five words, 0.8).
3. decontam: documents with a full window of a benchmark item, or windows of two short ones, go.
4. secrets: secrets in the text are replaced; every document stays.
5. sentencepiece: scores and piece ids of the N-best segmentations of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from swathly.llm import decontam, nbest, neardup, secrets, toxicity
from swathly.llm.common import discard, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask_secrets(docs)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nbest.nbest_ids(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("neardup", drop_near_duplicates),
    ("decontam", drop_contaminated),
    ("secrets", mask_secrets),
    ("sentencepiece", segment),
]

#: The classifier's weights and the lattice search are beyond SQL; tests compare each stage with a brute-force version (the classifier's with windows taken one by one).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``; what each returns is written to the shared folder, and deleted once the next stage is written, too."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        last, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        if k:
            discard(last)
    return docs
