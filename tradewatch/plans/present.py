"""Presentation step of registered queries: doubles rounded to a fixed scale so results
compare across engines (floating sums depend on the order of addition)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE = 6


def finish(df: DataFrame, scale: int = SCALE) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # + 0.0 turns a rounded negative zero into zero
            cols.append((F.round(F.col(f.name), scale) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
