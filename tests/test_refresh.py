"""Stores across refreshes, partition pruning, raw amounts, feed envelopes and rule tolerances."""

from dataclasses import replace
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tradewatch.params import DEFAULT_RULES
from tradewatch.plans import cases as CA
from tradewatch.plans import features as FE
from tradewatch.plans import governance as GV
from tradewatch.plans import harmonise as H
from tradewatch.plans import reports as RP
from tradewatch.plans import rules as R
from tradewatch.plans.pipeline import since_part
from tradewatch.sources import raw as RAW
from tradewatch.streaming import feeds as ST

ENVELOPE = "_record_id string, _load_ts timestamp_ntz, _source string, _partition_key string, payload string"


@pytest.mark.parametrize("part,kept", [("day", 31), ("month", 1)])
def test_partition_filter_reaches_the_scan(spark, tmp_path, part, kept):
    days = spark.sql("SELECT explode(sequence(date'2023-06-01', date'2024-01-31')) AS d").select(
        F.to_date(F.date_trunc(part, "d")).alias(part), "d").distinct()
    days.write.partitionBy(part).parquet(str(tmp_path / "t"))
    out = since_part(spark.read.parquet(str(tmp_path / "t")), part, "2024-01-31 12:00:00", 30)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull({part}" in plan
    n = out.select(F.to_date(F.date_trunc(part, "d"))).distinct().count()
    assert n == kept


def test_raw_amounts_and_their_dead_letters(spark):
    t = datetime(2024, 1, 1)
    payloads = ['{"tx_hash":"a","value_raw":"12345","decimals":2}', '{"tx_hash":"b","value_raw":"0xff","decimals":2}',
                '{"tx_hash":"c","value_raw":"' + "9" * 41 + '","decimals":2}', '{"tx_hash":"d","value_raw":"1","value_decimal":7.5}',
                '{"tx_hash":"e","value_raw":"5"}', '{"tx_hash":"f","value_raw":"1","decimals":40}', '{"tx_hash":"g"}', '{"tx_h']
    raw = spark.createDataFrame([(str(n), t, "s", "k", p) for n, p in enumerate(payloads)], ENVELOPE)
    assert rows(H.parse_onchain(raw), "tx_hash", "value_decimal") == [("a", 123.45), ("d", 7.5), ("e", None), ("g", None)]
    dead = RAW.dead_letters(raw, "ONCHAIN_RAW", RAW.ONCHAIN_PAYLOAD, RAW.unusable_amount())
    assert [r["error_message"] for r in dead.orderBy("raw_payload").collect()] == ["MALFORMED_JSON"] + ["TYPE_MISMATCH"] * 3


def test_stored_feeds_give_the_same_rows(spark, tmp_path):
    tx = lambda n, **f: '{"tx_hash":"%s","event_id":"%s","chain":"c","from_address":"A","ingested_at":"%s"}' % (
        f.get("tx", n), n, f.get("at", "2024-01-01 00:00:00"))
    payloads = [tx("1"), tx("2"), tx("2", at="2024-01-02 00:00:00"), tx("2", at="never"), tx("3"), tx("3"), tx("3", tx="2"), "{"]
    raw = spark.createDataFrame([(str(n), datetime(2024, 1, 1), "s", "k", p) for n, p in enumerate(payloads)], ENVELOPE)
    raw.write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    wallets = spark.createDataFrame([("a", "c", True, False, 9.0)], "wallet_address string, chain string, is_sanctioned boolean, is_mixer boolean, risk_score double")
    out = H.harmonise_transfers(H.parse_onchain(raw), wallets, stored=True)
    assert rows(out, "raw_record_id") == [("0",), ("2",), ("5",), ("6",)]
    assert {str(r) for r in out.collect()} == {str(r) for r in H.harmonise_transfers(H.parse_onchain(raw), wallets).collect()}
    trades = raw.withColumn("payload", F.regexp_replace("payload", '"tx_hash"', '"account_id":"u","trade_id"'))
    trades = H.parse_trades(trades)
    out = H.harmonise_trades(trades, stored=True)
    assert rows(out, "raw_record_id") == [("0",), ("5",), ("6",)]
    assert {str(r) for r in out.collect()} == {str(r) for r in H.harmonise_trades(trades).collect()}


def test_trade_features_joins_by_trade_id_in_one_go(spark):
    start = datetime(2024, 1, 1)
    trades = spark.createDataFrame([("t1", "o1", "u1", "w", True, "V", "A-B", "A", "B", "BUY", 2.0, 3.0, 6.0, start)],
                                   "trade_id string, order_id string, account_id string, wallet_id string, is_maker boolean, venue string, trading_pair string, base_asset string, "
                                   "quote_asset string, side string, price double, quantity double, quote_qty double, trade_ts timestamp_ntz")
    orders = spark.createDataFrame([], "order_id string, account_id string, venue string, trading_pair string, state string, event_ts timestamp_ntz")
    plan = FE.trade_features(trades, orders, "2024-01-01 12:00:00")._jdf.queryExecution().analyzed().toString()
    joined = [line for line in plan.splitlines() if "Join LeftOuter, (account_id" in line or "Join LeftOuter, (trade_id" in line]
    assert "account_id" in joined[0] and all("trade_id" in line for line in joined[1:3])


def test_links_replace_the_open_alerts_only(spark):
    alerts = spark.createDataFrame([("a1", "e1", "OPEN", None, 0), ("a2", "e2", "OPEN", None, 0), ("a3", "e1", "CLOSED", "c0", 0)],
                                   "alert_id string, entity_id string, status string, case_id string, x int")
    alerts = alerts.withColumn("updated_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    opened = spark.createDataFrame([("e1", "c1")], "entity_id string, case_id string")
    out = CA.with_links(alerts, CA.link_alerts(alerts, opened, "2024-01-02 00:00:00"))
    assert rows(out, "alert_id", "status", "case_id") == [("a1", "IN_REVIEW", "c1"), ("a2", "OPEN", None), ("a3", "CLOSED", "c0")]
    assert out.columns == alerts.columns


def test_kafka_envelope_keeps_ids_over_replays(spark):
    rec = spark.createDataFrame([("t", 0, 5, datetime(2024, 1, 1), bytearray(b"k"), bytearray(b'{"a":1}')),
                                 ("t", 0, 6, datetime(2024, 1, 1), None, None)],
                                "topic string, partition int, offset long, timestamp timestamp, key binary, value binary")
    a, b = ST.kafka_envelope(rec).collect(), ST.kafka_envelope(rec).collect()
    assert [r["_record_id"] for r in a] == [r["_record_id"] for r in b] and len({r["_record_id"] for r in a}) == 2
    assert (a[0]["payload"], a[0]["_partition_key"], a[1]["payload"]) == ('{"a":1}', "k", None)
    assert set(ST.kafka_envelope(rec).columns) == {f.name for f in RAW.ENVELOPE.fields}


def test_tags_count_the_values_they_cover(spark):
    df = spark.createDataFrame([("e1", "Ann"), ("e2", None)], "entity_id string, full_name string")
    got = rows(GV.tag_coverage(GV.tag_columns(df)), "column_name", "tag", "n_values")
    assert ("full_name", "PII", 1) in got and ("entity_id", "REGULATORY", 2) in got and len(got) == 5


@pytest.mark.parametrize("tolerance", [0.05, 1.0, 3.0])
def test_wash_tolerance_of_any_size(spark, tolerance):
    trades = spark.createDataFrame(
        [("b1", "BUY", 10.0, 0), ("s1", "SELL", 10.2, 60), ("s2", "SELL", 25.0, 90), ("s3", "SELL", 0.5, 120)],
        "trade_id string, side string, quantity double, at int")
    trades = trades.selectExpr("trade_id", "side", "quantity", "'a' AS account_id", "'w' AS wallet_id", "'X/Y' AS trading_pair",
                               "100D AS price", "timestamp_ntz'2024-01-30 00:00:00' + make_dt_interval(0, 0, 0, at) AS trade_ts")
    p = replace(DEFAULT_RULES, wash_qty_pct=tolerance)
    want = {("b1", s) for s, q in (("s1", 10.2), ("s2", 25.0), ("s3", 0.5)) if abs(10 - q) / 10 < tolerance}
    assert set(rows(R.wash_trades(trades, "2024-01-31 00:00:00", p), "buy_trade_id", "sell_trade_id")) == want


def test_health_check_of_a_written_table_shuffles_hashes_of_wide_keys(spark, tmp_path):
    keys = ["chain", "tx_hash", "event_id"]
    data = [("a", "t1", "e1"), ("a", "t1", "e1"), ("a", "t1", "e1"), ("a", "t1", None), ("a", None, "t1"), ("a", None, "t1"),
            (None, None, None), (None, None, None), ("b", "t2", "e2"), ("b", "t2", "e3")]
    schema = "chain string, tx_hash string, event_id string"
    for name, given in (("full", data), ("none", []), ("single", data[-2:]), ("pairs", data[:3] * 2)):
        spark.createDataFrame(given, schema).write.parquet(f"{tmp_path}/{name}")
        table = spark.read.parquet(f"{tmp_path}/{name}")
        plain = RP.health_check({"t": (table, keys, 3)}).collect()
        by_hash = RP.health_check({"t": (table, keys, 3)}, stored=("t",))
        assert by_hash.collect() == plain and by_hash.dtypes == RP.health_check({"t": (table, keys, 3)}).dtypes
        assert plain[0].row_count == len(given) and plain[0].duplicate_keys == len(given) - len(set(given))
    plan = by_hash._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "Cross" not in plan
