"""The corpus pipeline: toxic documents go, one document of each near-duplicate class stays, documents that hold test
items go, personal data is marked out, and sources are mixed to their weights.

Each stage works on all that its predecessor kept, and returns the columns of documents; other columns are carried on,
whatever their names. The last one returns a row for each document that the mix takes, with `copies`, the times that it is
taken; a column of that name goes on as copies_in.

Null and empty texts aren't toxic, alike, contaminated or private: they stay, with size 0, which the mix takes or leaves
by hash. Documents without doc_id are no one's near duplicates; of rows with one doc_id that with the least text stays.
Texts may have any length. Without labels of both classes nothing is toxic; without documents nothing comes out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from semiflow.llm import decontaminate, mixing, neardup, pii, toxicity
from semiflow.llm.common import cut, table

#: No SQL can express the learned stages; tests compare them with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mark_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mark_personal_data),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
