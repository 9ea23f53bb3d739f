"""Plan-level guards for the scale properties: no nested-loop or cartesian joins, look-back
filters and column pruning reaching the Parquet scan, time slices in window partitions."""

import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")


def plan(spark, name):
    df = E.queries()[name](spark, SF)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("name", ["rule_sanctioned", "rule_mixer", "rule_wash_trades", "entity_onchain_stats",
                                  "case_detail_transfers", "kris", "kri_cards", "alerts_unified"])
def test_no_nested_loop_or_cartesian_join(spark, name):
    p = plan(spark, name)
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p


def test_lookback_reaches_scan_and_columns_are_pruned(spark):
    p = plan(spark, "rule_structuring")
    assert "GreaterThanOrEqual(ts,2024-01-01T00:00)" in p
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in p
    p = plan(spark, "rule_sanctioned")
    assert "GreaterThanOrEqual(l_shipdate,2001-07-02T00:00)" in p


def test_rolling_windows_partition_by_time_bucket(spark):
    p = plan(spark, "trade_rolling_24h")
    assert "_rp_bucket" in p and "Window" in p


@pytest.mark.parametrize("name", ["harmonise_trades", "harmonise_orders_latest", "harmonise_balances_latest", "harmonise_transfers",
                                  "onchain_amounts", "onchain_dead_letters", "dlq_split"])
def test_payloads_are_parsed_once(spark, name):
    assert plan(spark, name).count("from_json") == 1


@pytest.mark.parametrize("name", ["harmonise_transfers", "harmonise_orders_latest", "harmonise_balances_latest"])
def test_payloads_are_made_once(spark, name):
    """A filter on the payload, pushed below the parse, made every payload a second time."""
    assert plan(spark, name).count("StructsToJsonEvaluator") == 1


def test_model_reads_features_that_were_computed_once(spark):
    p = plan(spark, "ml_score")
    assert "lineitem" not in p and "events" not in p
