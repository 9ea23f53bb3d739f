"""Shared helpers of the training-data operators: tables, written intermediate results and
the word rules that several operators have in common."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewatch.session import ensure_checkpoint_dir

#: ASCII space and \t \n \v \f \r; ``bytes.split()`` and ``bytes.lower()`` use the same rules.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back: lineage is cut, each
    task's result is kept by Spark's commit protocol, and a lost executor costs nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sorted_side(df: DataFrame) -> DataFrame:
    """A side of a join that is shuffled and sorted and never broadcast, so the driver does not hold it. For sides whose
    rows are more than the planner sees: exploded ones, and written columns that Parquet stores in few bytes."""
    return df.hint("merge")


def word_count(text) -> F.Column:
    """Number of white-space separated words of a text column (NULL: 0)."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")
