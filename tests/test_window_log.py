"""Windows as mergeable partials: late rows kept, corrections, open windows, batches that run again."""

import tempfile
from datetime import datetime, timedelta

from conftest import rows
from pyspark.sql import functions as F

from tradewatch.streaming import window_log as WL

T = datetime(2024, 1, 1, 10, 0, 0)
SCHEMA = "trade_id string, trading_pair string, price double, quote_qty double, trade_ts timestamp_ntz"


def _tr(i, minutes, price=100.0, quote=10.0, pair="P"):
    return (str(i), pair, price, quote, None if minutes is None else T + timedelta(minutes=minutes))


BATCHES = [
    [_tr(1, 0, 100.0), _tr(2, 30, 110.0), _tr(3, 61)],           # seen 11:01, bound 10:51
    [_tr(4, 45, 90.0), _tr(5, 130)],                             # 10 o'clock still open: on time; bound 12:00
    [_tr(6, 50, 120.0), _tr(7, 59, pair="Q"), _tr(8, 131), _tr(9, None)],   # 10 o'clock closed: late
    [],
]


def _log(spark, spec=None, base=None):
    spec = spec or WL.price_spike_spec()
    schema = spark.createDataFrame([], SCHEMA).schema
    return WL.WindowLog(spark, base or tempfile.mkdtemp(prefix="tw-wlog-"), spec, schema, "10 minutes")


def _feed(spark, log, batches=BATCHES):
    for n, data in enumerate(batches):
        log.add(spark.createDataFrame(data, SCHEMA), n)
    return log


def _whole(spark, spec):
    every = spark.createDataFrame([r for b in BATCHES for r in b], SCHEMA)
    return rows(spec.partials(spec.placed(every)))


def test_late_rows_corrections_and_whole(spark):
    log = _feed(spark, _log(spark))
    assert rows(log.windows().drop("closed")) == _whole(spark, log.spec)
    assert {r.trade_id for r in log.late_rows().collect()} == {"6", "7", "9"}
    fixed = {r.trading_pair: (r.correction, r.max_price, r.total_volume) for r in log.corrections().collect()}
    assert fixed == {"P": ("UPDATE", 120.0, 40.0), "Q": ("INSERT", 100.0, 10.0)}
    # what was reported on time, with the corrections in place of it, is the whole
    ids = ["trading_pair", "window_start", "window_end"]
    kept = log.on_time().join(log.corrections().select(*ids), ids, "left_anti")
    assert rows(kept.unionByName(log.corrections().drop("correction"))) == _whole(spark, log.spec)
    closed = {r.window_start.hour: r.closed for r in log.windows().filter("trading_pair = 'P'").collect()}
    assert closed == {10: True, 11: True, 12: False}


def test_batch_that_runs_again_and_compaction(spark):
    log = _feed(spark, _log(spark))
    before = rows(log.windows()), rows(log.late_rows(), "trade_id"), rows(log.corrections())
    log.add(spark.createDataFrame(BATCHES[1], SCHEMA), 1)       # as after a failure: divided as the first time
    log.add(spark.createDataFrame(BATCHES[2], SCHEMA), 2)
    assert (rows(log.windows()), rows(log.late_rows(), "trade_id"), rows(log.corrections())) == before
    log.compact(2)
    assert (rows(log.windows()), rows(log.late_rows(), "trade_id"), rows(log.corrections())) == before


def test_overlapping_windows_keep_a_late_row_once(spark):
    p = WL.price_spike_spec()
    spec = WL.WindowSpec(p.keys, "1 hour", p.partial, p.merge, slide="30 minutes")
    log = _feed(spark, _log(spark, spec))
    assert rows(log.windows().drop("closed")) == _whole(spark, spec)
    ids = [r.trade_id for r in log.late_rows().collect()]
    assert len(ids) == len(set(ids)) and {"6", "7", "9"} <= set(ids)


def test_no_rows_at_all(spark):
    log = _log(spark)
    assert log.windows().count() == 0 and log.corrections().count() == 0
    log.add(spark.createDataFrame([], SCHEMA), 0)
    assert log.windows().count() == 0 and log.late_rows().count() == 0


def test_partials_merge_in_any_grouping(spark):
    spec = WL.cross_venue_spec("1 hour")
    n = F.col("id")
    t = spark.range(500).select(
        (n % 3).cast("string").alias("account_id"), F.lit("w").alias("wallet_id"), F.lit("P").alias("trading_pair"),
        F.when(n % 7 > 0, F.concat(F.lit("V"), (n % 4).cast("string"))).alias("venue"), (n % 11).cast("double").alias("price"),
        n.cast("double").alias("quote_qty"), (F.lit(T).cast("timestamp_ntz") + F.make_dt_interval(mins=n.cast("int"))).alias("trade_ts"))
    one = spec.merged(spec.partials(spec.placed(t)))
    parts = [spec.partials(spec.placed(t.filter(n % 5 == k))) for k in range(5)]
    two = spec.merged(parts[0].unionByName(parts[1]))
    for p in parts[2:]:
        two = spec.merged(two.unionByName(p))
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0
