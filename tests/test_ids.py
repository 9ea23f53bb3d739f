"""Ids and case numbers stay distinct past their padded width; keys with NULL parts do not collide."""

from pyspark.sql import functions as F

from tradewatch.functions.text import pad, pad_id
from tradewatch.plans.alerts import _h
from tradewatch.streaming.feeds import read_output


def test_ids_beyond_the_padded_width_stay_distinct(spark):
    df = spark.createDataFrame([(1,), (999_999,), (1_000_001,), (1_000_002,), (100_000,), (None,)], "k long")
    got = [r.x for r in df.select(pad_id("ENT", "k").alias("x")).collect()]
    assert got == ["ENT000001", "ENT999999", "ENT1000001", "ENT1000002", "ENT100000", None]
    numbers = [r.x for r in spark.range(99_998, 100_004).select(pad(F.col("id"), 5).alias("x")).collect()]
    assert numbers == ["99998", "99999", "100000", "100001", "100002", "100003"]


def test_a_null_part_gives_a_null_key(spark):
    r = spark.sql("SELECT 'a' AS x, CAST(NULL AS STRING) AS y").select(_h(F.col("x"), F.col("y")).alias("n"), _h(F.col("x")).alias("k")).first()
    assert r.n is None and r.k is not None


def test_a_missing_output_is_empty_and_a_broken_one_fails(spark, tmp_path):
    import pytest

    schema = spark.range(1).schema
    assert read_output(spark, str(tmp_path / "none"), schema).count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        read_output(spark, str(tmp_path / "bad"), schema).count()
