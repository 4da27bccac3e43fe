"""The corpus pipeline over ``documents``: what a training run would read, in five stages.

1. quality classifier: documents that it rejects go
2. exact dedup: of equal texts the smallest doc_id stays
3. near dedup: of every near-duplicate class the smallest doc_id stays
4. source mix: documents are repeated or left out until the sources have their shares
5. packing: the mix as token pieces in sequences

Every stage is judged on its own input and works on all that the one before it
kept. A stage's rows are written to the shared checkpoint folder and read again,
so that a lost executor costs the running stage only.

Cases: what each stage does with nulls, empty and very long texts, repeated rows,
empty tables and extra columns is stated in its module; the first four return
the columns of the documents that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from migtrack.llm import bin_packing, exact_dedup, near_dedup, quality_rules, source_mix
from migtrack.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept_documents(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bin_packing.pack(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

#: The classifier, the near-duplicate classes and the packing are beyond SQL; the tests hold run()
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
