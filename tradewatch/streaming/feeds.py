"""Structured Streaming forms of the time-based operators.

Every stream reads a file source (Kafka in production: same transformations), declares a
watermark on event time so state stays bounded, and writes through a sink with a
checkpoint in the shared checkpoint folder (exactly-once file sink, or ``foreachBatch``
with idempotent per-batch writes). ``availableNow`` processes everything present and stops,
which is how scheduled refreshes (every 5/10/30 minutes) run; ``processingTime`` keeps a
query running.

Window aggregates use append mode: a window is written once the watermark passes its end,
so late rows within the watermark still count and later ones are dropped (T13).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tradewatch.functions.timefn import epoch_seconds
from tradewatch.operators.logstore import LogStore
from tradewatch.params import DEFAULT_RULES, RuleParams
from tradewatch.plans import harmonise as H
from tradewatch.session import checkpoint_dir
from tradewatch.sources import adapters as A
from tradewatch.sources import raw as RAW


# ----------------------------------------------------------------------------- sources


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A driver table read as a stream (file source; the schema is taken from the batch
    reader once, streams never infer)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    # a glob keeps the parent folder as the source root when the table is a single file
    return r.parquet(path[:-1] + "[" + path[-1] + "]")


def kafka_stream(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None, **options: str) -> DataFrame:
    """A feed's topic as envelopes. Needs the Kafka source package on the cluster."""
    r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options)
    if max_offsets:
        r = r.option("maxOffsetsPerTrigger", max_offsets)
    return kafka_envelope(r.load())


def kafka_envelope(records: DataFrame) -> DataFrame:
    """Envelopes of Kafka records. The record id names the record's place in the log, so a
    replay gives the same ids; a record without a value has a NULL payload (a dead letter)."""
    place = F.concat_ws(":", "topic", F.col("partition").cast("string"), F.col("offset").cast("string"))
    return records.select(
        F.sha2(place, 256).alias("_record_id"), F.col("timestamp").cast("timestamp_ntz").alias("_load_ts"),
        F.lit("kafka").alias("_source"), F.lit("STREAM").alias("_ingest_method"),
        F.col("key").cast("string").alias("_partition_key"), F.lit(None).cast("string").alias("_file_name"),
        F.col("value").cast("string").alias("payload"))


def event_time(c: str) -> Column:
    """Watermarks need TIMESTAMP; the tables hold TIMESTAMP_NTZ in UTC (same instant)."""
    return F.col(c).cast("timestamp")


# ----------------------------------------------------------------------------- sinks


def run_to_parquet(df: DataFrame, name: str, mode: str = "append", trigger: dict | None = None,
                   wait: bool = True) -> tuple[str, StreamingQuery]:
    """Write a stream to a Parquet folder under the shared checkpoint folder (file sink:
    exactly-once through its commit log). Returns (output path, query)."""
    spark = df.sparkSession
    base = checkpoint_dir(spark, name)
    out, ck = f"{base}/out", f"{base}/_checkpoint"
    w = df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", ck)
    w = w.trigger(**(trigger or {"availableNow": True}))
    q = w.start()
    if wait:
        q.awaitTermination()
    return out, q


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the folder is there, in whatever store it lives; errors of the store are raised."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_output(spark: SparkSession, path: str, schema) -> DataFrame:
    """The written rows; no rows if the stream has not written its folder yet. Any other
    failure is raised."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def ntz(df: DataFrame) -> DataFrame:
    """TIMESTAMP columns back to TIMESTAMP_NTZ (UTC wall time) for output."""
    from pyspark.sql import types as T
    return df.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name)
                       if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in df.schema.fields])


# ----------------------------------------------------------------------------- T1 parse + DLQ


def split_batches(raw: DataFrame, source_table: str, name: str, trigger: dict | None = None) -> tuple[str, str]:
    """Parse each micro-batch once and write valid rows and dead letters to two
    folders. Each batch writes ``batch_id=<n>`` sub-folders with overwrite, so a retried
    batch replaces its own output (idempotent)."""
    spark = raw.sparkSession
    base = checkpoint_dir(spark, name)
    good, bad = f"{base}/valid", f"{base}/dead_letters"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        dlq = RAW.dead_letters(batch, source_table, RAW.TRADE_PAYLOAD)
        H.parse_trades(batch).write.mode("overwrite").parquet(f"{good}/batch_id={batch_id}")
        dlq.write.mode("overwrite").parquet(f"{bad}/batch_id={batch_id}")
        batch.unpersist()

    q = (raw.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/_checkpoint")
         .trigger(**(trigger or {"availableNow": True})).start())
    q.awaitTermination()
    return good, bad


# ----------------------------------------------------------------------------- T2 / T11 dedup


def dedup_within_watermark(df: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """First row per key; state for a key is kept until the watermark passes."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


# ----------------------------------------------------------------------------- T4-T6 windows


def cross_venue_windows(trades: DataFrame, unit: str = "1 minute", delay: str = "10 minutes",
                        p: RuleParams = DEFAULT_RULES) -> DataFrame:
    """T4: tumbling windows per (account, wallet, pair) with the venue count as the size of
    the venue set (streaming rejects COUNT(DISTINCT))."""
    t = trades.withColumn("_et", event_time("trade_ts")).withWatermark("_et", delay)
    g = t.groupBy(F.window("_et", unit).alias("w"), "account_id", "wallet_id", "trading_pair").agg(
        F.size(F.collect_set("venue")).cast("long").alias("venues_count"),
        F.sum("quote_qty").alias("total_volume"),
        (F.max("price") - F.min("price")).alias("price_spread"))
    g = g.filter((F.col("venues_count") >= p.xv_min_venues) & (F.col("total_volume") > p.xv_min_volume))
    return g.select("account_id", "wallet_id", "trading_pair", F.col("w.start").alias("window_start"),
                    F.col("w.end").alias("window_end"), "venues_count", "total_volume", "price_spread")


def price_spike_windows(trades: DataFrame, delay: str = "10 minutes", p: RuleParams = DEFAULT_RULES) -> DataFrame:
    """T5: hourly price range and volume per pair; suspect hours only."""
    t = trades.withColumn("_et", event_time("trade_ts")).withWatermark("_et", delay)
    g = t.groupBy(F.window("_et", "1 hour").alias("w"), "trading_pair").agg(
        F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.sum("quote_qty").alias("total_volume"))
    g = g.withColumn("price_range_pct", F.try_divide(F.col("max_price") - F.col("min_price"),
                                                     F.nullif(F.col("min_price"), F.lit(0.0))))
    g = g.filter((F.col("price_range_pct") > p.pump_range_pct) & (F.col("total_volume") > p.pump_hour_volume))
    return g.select("trading_pair", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "min_price", "max_price", "price_range_pct", "total_volume")


def structuring_windows(trades: DataFrame, delay: str = "1 hour", p: RuleParams = DEFAULT_RULES) -> DataFrame:
    """Daily windows per (account, wallet) with the below-threshold count and volume."""
    t = trades.withColumn("_et", event_time("trade_ts")).withWatermark("_et", delay)
    band = F.col("quote_qty").between(p.st_low, p.st_high)
    g = t.groupBy(F.window("_et", "1 day").alias("w"), "account_id", "wallet_id").agg(
        F.count(F.when(band, F.lit(1))).alias("below_threshold_count"),
        F.sum(F.when(band, F.col("quote_qty")).otherwise(F.lit(0.0))).alias("below_threshold_volume"),
        F.sum("quote_qty").alias("total_daily_volume"))
    g = g.filter((F.col("below_threshold_count") >= p.st_min_count) & (F.col("below_threshold_volume") > p.st_min_volume))
    return g.select("account_id", "wallet_id", F.col("w.start").alias("trade_date"), "below_threshold_count",
                    "below_threshold_volume", "total_daily_volume")


def sliding_volume(trades: DataFrame, length: str = "24 hours", slide: str = "5 minutes",
                   delay: str = "10 minutes") -> DataFrame:
    """Sliding-window approximation of the rolling features (exact row frames stay batch)."""
    t = trades.withColumn("_et", event_time("trade_ts")).withWatermark("_et", delay)
    g = t.groupBy(F.window("_et", length, slide).alias("w"), "account_id", "trading_pair").agg(
        F.count(F.lit(1)).alias("trade_count"), F.sum("quote_qty").alias("volume_usd"),
        F.avg("price").alias("avg_price"))
    return g.select("account_id", "trading_pair", F.col("w.start").alias("window_start"),
                    F.col("w.end").alias("window_end"), "trade_count", "volume_usd", "avg_price")


# ----------------------------------------------------------------------------- T8 stream-stream join


def wash_pairs_stream(trades: DataFrame, band_seconds: int = 600, delay: str = "15 minutes",
                      p: RuleParams = DEFAULT_RULES) -> DataFrame:
    """BUY x SELL of one account and pair whose times are less than ``band_seconds``
    apart (second boundaries). Both sides are watermarked and the join carries a time-range
    condition, so each side's state only holds the last band + watermark of trades. As in
    the batch rule, a log-quantity bucket joins only buys and sells of similar size;
    negative buy quantities (every sell qualifies) take a plain second join."""
    from tradewatch.plans.rules import _qty_bucket_range

    cols = ["trade_id", "account_id", "wallet_id", "trading_pair", "price", "quantity", "trade_ts"]
    buys = trades.filter(F.col("side") == "BUY").select(*cols)
    sells = trades.filter(F.col("side") == "SELL").select(*cols)

    def join(b: DataFrame, s: DataFrame, bucketed: bool) -> DataFrame:
        b = b.withColumn("_bt", event_time("trade_ts")).withWatermark("_bt", delay).alias("b")
        s = s.withColumn("_st", event_time("trade_ts")).withWatermark("_st", delay).alias("s")
        lo = F.col("b._bt") - F.expr(f"INTERVAL {band_seconds} SECONDS")
        hi = F.col("b._bt") + F.expr(f"INTERVAL {band_seconds} SECONDS")
        secs = epoch_seconds(F.col("s.trade_ts")) - epoch_seconds(F.col("b.trade_ts"))
        cond = ((F.col("b.account_id") == F.col("s.account_id")) & (F.col("b.trading_pair") == F.col("s.trading_pair"))
                & (F.col("s._st") >= lo) & (F.col("s._st") <= hi) & (F.abs(secs) < band_seconds)
                & (F.col("b.trade_id") != F.col("s.trade_id")))
        if bucketed:
            cond = cond & (F.col("b._qb") == F.col("s._qb"))
        j = b.join(s, cond, "inner")
        pdiff = F.try_divide(F.abs(F.col("b.price") - F.col("s.price")), F.nullif(F.col("b.price"), F.lit(0.0)))
        qdiff = F.try_divide(F.abs(F.col("b.quantity") - F.col("s.quantity")), F.nullif(F.col("b.quantity"), F.lit(0.0)))
        j = j.filter((pdiff < p.wash_price_pct) & (qdiff < p.wash_qty_pct))
        return j.select(
            F.col("b.account_id").alias("account_id"), F.col("b.wallet_id").alias("wallet_id"),
            F.col("b.trading_pair").alias("trading_pair"), F.col("b.trade_id").alias("buy_trade_id"),
            F.col("s.trade_id").alias("sell_trade_id"), F.col("b.price").alias("buy_price"),
            F.col("s.price").alias("sell_price"), pdiff.alias("price_diff_pct"),
            secs.cast("long").alias("seconds_apart"))

    first, last, own = _qty_bucket_range(p.wash_qty_pct)
    bucketed = join(buys.filter(F.col("quantity") > 0).withColumn("_qb", F.explode(F.sequence(first, last))),
                    sells.filter(F.col("quantity") > 0).withColumn("_qb", own), True)
    negative = join(buys.filter(F.col("quantity") < 0), sells, False)
    return bucketed.unionByName(negative)


# ----------------------------------------------------------------------------- T9 sessions


def burst_sessions(trades: DataFrame, gap: str = "1 hour", delay: str = "0 seconds") -> DataFrame:
    """Trading sessions per account (a new session after a gap of ``gap``)."""
    t = trades.withColumn("_et", event_time("trade_ts")).withWatermark("_et", delay)
    g = t.groupBy(F.session_window("_et", gap).alias("s"), "account_id").agg(
        F.count(F.lit(1)).alias("trade_count"), F.sum("quote_qty").alias("volume_usd"))
    return g.select("account_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                    "trade_count", "volume_usd")


# ----------------------------------------------------------------------------- T10 stream-static


def flag_transfers(transfers_stream: DataFrame, wallets: DataFrame) -> DataFrame:
    """Counterparty flags from the (static) wallet master joined to each transfer."""
    return H.harmonise_transfers(transfers_stream, wallets, dedup=False)


def transfers_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On-chain events as a stream: line items stream, orders static (stream-static join)."""
    li = table_stream(spark, sf_dir, "lineitem")
    return A.transfers_parsed(li, A.table(spark, sf_dir, "orders"))


# ----------------------------------------------------------------------------- T3 latest state


def latest_state_stream(events: DataFrame, name: str, fold, schema, keys: list[str], trigger: dict | None = None,
                        base: str | None = None, compact_every: int = 16) -> LogStore:
    """Keep a latest-state table (orders, balances) current from a stream.

    Every micro-batch is folded to the newest row of each of its keys and appended as a delta: it writes as many rows
    as it has keys, whatever the state holds. Reading folds the deltas with the newest compaction. A trigger of its own,
    every ``compact_every`` batches, writes the folded state as a new base; batches are only read from then on
    if they are newer. A batch that runs again replaces its own delta, and a job that dies between a delta and a
    compaction loses nothing: the deltas stay. Returns the store; ``read()`` gives the state.
    """
    base = base or checkpoint_dir(events.sparkSession, name)
    store = LogStore(events.sparkSession, f"{base}/state", schema, keys, fold=fold)

    def step(batch: DataFrame, batch_id: int) -> None:
        store.append(fold(batch), batch_id)
        if (batch_id + 1) % compact_every == 0:
            store.compact(batch_id)

    q = (events.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/_checkpoint")
         .trigger(**(trigger or {"availableNow": True})).start())
    q.awaitTermination()
    return store
