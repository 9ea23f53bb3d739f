"""Streaming forms: watermark semantics and agreement with batch."""

import os
import tempfile
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tradewatch.streaming import feeds as ST

T = datetime(2024, 1, 1, 10, 0, 0)
SCHEMA = ("trade_id string, account_id string, wallet_id string, venue string, trading_pair string, side string, "
          "price double, quantity double, quote_qty double, trade_ts timestamp_ntz")


def _write(spark, folder, name, data):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("overwrite").parquet(os.path.join(folder, name))


def _tr(i, acc, side, secs, venue="V0", quote=100.0, price=100.0):
    return (str(i), acc, "W" + acc, venue, "BTC-USDT", side, price, 1.0, quote, T + timedelta(seconds=secs))


def _stream(spark, folder):
    schema = spark.createDataFrame([], SCHEMA).schema
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").parquet(folder))


def _run_batches(spark, df, folder, batches, name, mode="append"):
    """Feed files one micro-batch at a time and return the sink contents."""
    src = os.path.join(folder, "src")
    out = os.path.join(folder, "out_" + name)
    ck = os.path.join(folder, "ck_" + name)
    q = None
    for n, data in enumerate(batches):
        _write(spark, src, f"b{n:03d}", data)
        q = (df(_stream(spark, src)).writeStream.format("parquet").outputMode(mode).option("path", out)
             .option("checkpointLocation", ck).trigger(availableNow=True).start())
        q.awaitTermination()
    try:
        return spark.read.parquet(out)
    except Exception:  # noqa: BLE001
        return None


def test_dedup_across_batches_within_watermark(spark):
    folder = tempfile.mkdtemp(prefix="tw-stream-")

    def q(s):
        return ST.dedup_within_watermark(s.withColumn("_et", ST.event_time("trade_ts")), ["trade_id"], "_et",
                                         "1 hour").drop("_et")

    out = _run_batches(spark, q, folder, [[_tr(1, "A", "BUY", 0), _tr(2, "A", "BUY", 10)],
                                          [_tr(1, "A", "BUY", 20), _tr(3, "A", "BUY", 4 * 3600)],
                                          [_tr(2, "A", "BUY", 30)]], "dedup")
    ids = sorted(r.trade_id for r in out.collect())
    # trade 1 is a duplicate inside the watermark; trade 2 arrives again after the watermark
    # moved past it (event time 3 h 50 min behind the max) and is dropped as late data
    assert ids == ["1", "2", "3"]


def test_window_late_row_inside_and_outside_watermark(spark):
    folder = tempfile.mkdtemp(prefix="tw-stream-")

    def q(s):
        return ST.cross_venue_windows(s, "1 hour", "10 minutes")

    batches = [
        [_tr(1, "A", "BUY", 0, "V0", 3000.0), _tr(2, "A", "BUY", 60, "V1", 1000.0)],
        [_tr(3, "A", "BUY", 3600 + 5 * 60, "V0", 10.0)],                    # watermark -> 10:55
        [_tr(4, "A", "BUY", 120, "V2", 2000.0)],                            # late but inside: counts
        [_tr(5, "B", "BUY", 7200 + 30 * 60, "V0", 1.0)],                    # watermark -> 12:20, closes 10:00
        [_tr(6, "A", "BUY", 180, "V3", 9000.0)],                            # behind the watermark: dropped
        [_tr(7, "B", "BUY", 5 * 3600, "V0", 1.0)],
    ]
    out = _run_batches(spark, q, folder, batches, "xv").collect()
    assert [(r.account_id, r.venues_count, r.total_volume) for r in out] == [("A", 3, 6000.0)]


def test_wash_join_partner_first_or_last(spark):
    folder = tempfile.mkdtemp(prefix="tw-stream-")

    def q(s):
        return ST.wash_pairs_stream(s, 600, "15 minutes")

    batches = [[_tr(1, "A", "SELL", 100)], [_tr(2, "A", "BUY", 0)],          # partner arrived first
               [_tr(3, "B", "BUY", 0)], [_tr(4, "B", "SELL", 300)],           # partner arrives later
               [_tr(5, "C", "BUY", 0)], [_tr(6, "C", "SELL", 600)]]           # 600 s apart: no pair
    out = _run_batches(spark, q, folder, batches, "wash")
    assert sorted((r.buy_trade_id, r.sell_trade_id) for r in out.collect()) == [("2", "1"), ("3", "4")]


def test_stream_equals_batch_structuring(spark):
    folder = tempfile.mkdtemp(prefix="tw-stream-")
    data = [_tr(i, "A", "BUY", i * 60, quote=8000.0) for i in range(4)] + \
           [_tr(10 + i, "B", "BUY", i * 60, quote=9000.0) for i in range(2)] + \
           [_tr(99, "Z", "BUY", 3 * 86400)]
    out = _run_batches(spark, lambda s: ST.structuring_windows(s, "1 hour"), folder, [data], "st")
    assert [(r.account_id, r.below_threshold_count) for r in out.collect()] == [("A", 4)]


def test_latest_state_folds_across_batches(spark):
    from tradewatch.plans import cases as CA
    from tradewatch.plans import harmonise as H

    folder = tempfile.mkdtemp(prefix="tw-stream-")
    schema = ("order_id string, account_id string, wallet_id string, venue string, trading_pair string, "
              "side string, order_type string, state string, price double, orig_qty double, filled_qty double, "
              "event_ts timestamp_ntz, ingest_ts timestamp_ntz, raw_record_id string")

    def o(oid, state, secs, rid):
        ts = T + timedelta(seconds=secs)
        return (oid, "A", "WA", "V0", "BTC-USDT", "BUY", "LIMIT", state, 100.0, 2.0, 1.0, ts, ts, rid)

    src = os.path.join(folder, "src")
    base = os.path.join(folder, "state")
    batches = [[o("1", "PARTIAL_FILL", 0, "r1"), o("2", "FILLED", 0, "r2")],
               [o("1", "FILLED", 60, "r3"), o("2", "CANCELLED", -60, "r4")]]   # order 2: older event
    empty = H.harmonise_orders(spark.createDataFrame([], schema))
    seen = []
    for n, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(os.path.join(src, f"b{n}"))
        stream = (spark.readStream.schema(spark.createDataFrame([], schema).schema)
                  .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(src))
        store = ST.latest_state_stream(stream, "orders", CA.newest_orders, empty.schema, ["order_id"], base=base, compact_every=1 + n)
        seen.append({r.order_id: r.state for r in store.read().collect()})
    assert store.n_rows("rows", 1) == 2 and os.path.exists(f"{store.path}/compact/upto=1/_SUCCESS")
    assert seen[0] == {"1": "PARTIAL_FILL", "2": "FILLED"}
    assert seen[1] == {"1": "FILLED", "2": "FILLED"}      # restarted query continued from the state
