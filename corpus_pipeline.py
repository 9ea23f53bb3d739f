"""The training-data pipeline: five stages, each an operator of ``tradewatch.llm`` over all rows
that the stage before kept, written as Parquet in between.

Order: quality rules drop bad documents, SimHash keeps one document of each near-duplicate group,
contaminated documents go, sources are mixed to their target weights (a document may then occur
twice), and the mixture is encoded into token blocks, whose digest per document is the result.
All stages but the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradewatch.llm import decontaminate, mixing, quality, simhash, token_blocks
from tradewatch.llm.common import table, written
from tradewatch.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judge(docs).filter("kept").select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = decontaminate.with_verdict(docs, table(spark, sf_dir, "benchmark"))
    return judged.filter("NOT contaminated").select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(mixing.mix(docs)).select(*docs.columns)


def token_id_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_blocks.encode_and_read_back(docs, tokenizer_path(), known_words=400_000)


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", simhash_near_dedup),
          ("benchmark_decontamination", benchmark_decontamination), ("source_mixing", source_mixing),
          ("token_id_output", token_id_output)]

#: Fingerprints, EM and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
