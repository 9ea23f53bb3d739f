"""Windows kept as mergeable partials: open windows are visible, late rows are kept and corrected.

An append-mode window aggregate shows a window once the watermark has passed it, and drops what comes later. Here
every micro-batch reduces its rows to one partial per (key, window) and appends them to a ``LogStore``, so a batch writes
as many rows as it touches windows and nothing is held as state between batches. Reading merges the partials: open
windows show what has arrived, closed ones are final but for corrections.

Late rows are rows of windows that were closed when their batch began: the window's end is not after the largest
event time of the batches before, less the delay. They go to a folder of their own (the side output) and to
partials of their own, so three views come from the same files: what was reported on time, the corrections, and
the whole. The bound of a batch is read from what the batches before it committed, so a batch that runs again after
a failure divides its rows the same way and replaces its own folders.

Rows without an event time belong to no window; they are kept in the side output.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewatch.operators.logstore import LogStore
from tradewatch.params import DEFAULT_RULES, RuleParams
from tradewatch.session import checkpoint_dir


@dataclass(frozen=True)
class WindowSpec:
    """``partial`` reduces rows, ``merge`` reduces partials of the same names; ``merge`` must not depend on
    the order or the grouping of the partials. ``slide`` makes the windows overlap."""

    keys: Sequence[str]
    length: str
    partial: dict[str, Column]
    merge: dict[str, Column]
    time: str = "trade_ts"
    slide: str | None = None
    window: tuple[str, str] = field(default=("window_start", "window_end"))

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows with the start and end of their window (one copy for each window if they overlap)."""
        start, end = self.window
        w = F.window(self.time, self.length, self.slide or self.length)
        timed = rows.filter(F.col(self.time).isNotNull()).withColumn("_w", w)
        return timed.withColumn(start, F.col("_w.start")).withColumn(end, F.col("_w.end")).drop("_w")

    def partials(self, placed: DataFrame) -> DataFrame:
        return placed.groupBy(*self.keys, *self.window).agg(*[c.alias(n) for n, c in self.partial.items()])

    def merged(self, partials: DataFrame) -> DataFrame:
        return partials.groupBy(*self.keys, *self.window).agg(*[c.alias(n) for n, c in self.merge.items()])


class WindowLog:
    """The stores of one windowed stream below ``base``: partials on time and late, late rows, progress."""

    PROGRESS = T.StructType([T.StructField("batch", T.LongType()), T.StructField("newest", T.TimestampNTZType())])

    def __init__(self, spark: SparkSession, base: str, spec: WindowSpec, rows: T.StructType, delay: str):
        self.spark, self.spec, self.delay = spark, spec, delay
        partial = spec.partials(spec.placed(spark.createDataFrame([], rows))).schema
        ids = [*spec.keys, *spec.window]
        self.on_time_log = LogStore(spark, f"{base}/on_time", partial, ids, fold=spec.merged)
        self.late_log = LogStore(spark, f"{base}/late", partial, ids, fold=spec.merged)
        self.rows_log = LogStore(spark, f"{base}/late_rows", rows, [])
        self.progress = LogStore(spark, f"{base}/progress", self.PROGRESS, ["batch"])

    def bound(self, before: int | None = None) -> Column:
        """Windows that end by this time are closed for batch ``before`` (default: for the next one)."""
        seen = self.progress.read(None if before is None else before - 1).agg(F.max("newest").alias("newest"))
        return F.lit(seen.head()["newest"]).cast("timestamp_ntz") - F.expr(f"INTERVAL {self.delay}")

    def add(self, rows: DataFrame, batch: int) -> None:
        """One micro-batch. The progress is written last: until then the batch counts as not run."""
        spec, rows = self.spec, rows.persist()
        try:
            placed = spec.placed(rows)
            late = F.coalesce(F.col(spec.window[1]) <= self.bound(batch), F.lit(False))
            self.on_time_log.append(spec.partials(placed.filter(~late)), batch)
            self.late_log.append(spec.partials(placed.filter(late)), batch)
            # windows close in the order of their ends: a row is late if its earliest window is, and kept once
            earliest = F.col(spec.window[0]) + F.expr(f"INTERVAL {spec.length}") <= F.col(spec.time) + F.expr(f"INTERVAL {spec.slide or spec.length}")
            side = placed.filter(late & earliest).select(*rows.columns)
            untimed = rows.filter(F.col(spec.time).isNull())
            self.rows_log.append(side.unionByName(untimed), batch)
            self.progress.append(rows.agg(F.lit(batch).cast("long").alias("batch"),
                                          F.max(spec.time).cast("timestamp_ntz").alias("newest")), batch)
        finally:
            rows.unpersist()

    def compact(self, upto: int) -> None:
        """Merge the partials of all batches so far; a step of its own, safe to repeat."""
        self.on_time_log.compact(upto)
        self.late_log.compact(upto)

    def windows(self) -> DataFrame:
        """All windows from all rows that came, late ones too; ``closed`` tells whether new rows would be late."""
        both = self.on_time_log.read().unionByName(self.late_log.read())
        closed = F.coalesce(F.col(self.spec.window[1]) <= self.bound(), F.lit(False))
        return self.spec.merged(both).withColumn("closed", closed)

    def on_time(self) -> DataFrame:
        """The windows as reported when they closed."""
        return self.spec.merged(self.on_time_log.read())

    def late_rows(self) -> DataFrame:
        return self.rows_log.read()

    def corrections(self) -> DataFrame:
        """New values of the windows that late rows changed. ``correction`` is UPDATE for a window reported
        on time, INSERT for one that no row had reached by then."""
        start, ids = self.spec.window[0], [*self.spec.keys, *self.spec.window]
        late = self.late_log.read().withColumn("_late", F.lit(True))
        both = self.on_time_log.read().withColumn("_late", F.lit(False)).unionByName(late)
        aggs = [c.alias(n) for n, c in self.spec.merge.items()]
        g = both.groupBy(*ids).agg(*aggs, F.bool_or("_late").alias("_any"), F.bool_and("_late").alias("_all"))
        kind = F.when(F.col("_all"), F.lit("INSERT")).otherwise(F.lit("UPDATE"))
        return g.filter(F.col("_any") & F.col(start).isNotNull()).withColumn("correction", kind).drop("_any", "_all")


def run(stream: DataFrame, name: str, spec: WindowSpec, delay: str, base: str | None = None,
        trigger: dict | None = None, compact_every: int = 16) -> WindowLog:
    """Feed a stream into its window log and wait for the trigger's end."""
    base = base or checkpoint_dir(stream.sparkSession, name)
    log = WindowLog(stream.sparkSession, base, spec, stream.schema, delay)

    def step(batch: DataFrame, batch_id: int) -> None:
        log.add(batch, batch_id)
        if (batch_id + 1) % compact_every == 0:
            log.compact(batch_id)

    q = (stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/_checkpoint")
         .trigger(**(trigger or {"availableNow": True})).start())
    q.awaitTermination()
    return log


# ----------------------------------------------------------------------------- the windows of the rules


def structuring_spec(p: RuleParams = DEFAULT_RULES) -> WindowSpec:
    """Daily counts and sums inside the amount band."""
    band = F.col("quote_qty").between(p.st_low, p.st_high)
    return WindowSpec(
        ("account_id", "wallet_id"), "1 day",
        {"below_threshold_count": F.count(F.when(band, F.lit(1))),
         "below_threshold_volume": F.sum(F.when(band, F.col("quote_qty")).otherwise(F.lit(0.0))),
         "total_daily_volume": F.sum("quote_qty")},
        {c: F.sum(c) for c in ("below_threshold_count", "below_threshold_volume", "total_daily_volume")})


def structuring_hits(windows: DataFrame, p: RuleParams = DEFAULT_RULES) -> DataFrame:
    return windows.filter((F.col("below_threshold_count") >= p.st_min_count) & (F.col("below_threshold_volume") > p.st_min_volume))


def price_spike_spec(length: str = "1 hour") -> WindowSpec:
    """T5: price range and volume of a pair."""
    return WindowSpec(("trading_pair",), length,
                      {"min_price": F.min("price"), "max_price": F.max("price"), "total_volume": F.sum("quote_qty")},
                      {"min_price": F.min("min_price"), "max_price": F.max("max_price"), "total_volume": F.sum("total_volume")})


def price_spike_hits(windows: DataFrame, p: RuleParams = DEFAULT_RULES) -> DataFrame:
    spread = F.try_divide(F.col("max_price") - F.col("min_price"), F.nullif(F.col("min_price"), F.lit(0.0)))
    return windows.withColumn("price_range_pct", spread).filter(
        (F.col("price_range_pct") > p.pump_range_pct) & (F.col("total_volume") > p.pump_hour_volume))


def cross_venue_spec(length: str = "1 minute") -> WindowSpec:
    """T4: venues, volume and price range of an account, wallet and pair."""
    return WindowSpec(("account_id", "wallet_id", "trading_pair"), length,
                      {"venues": F.collect_set("venue"), "total_volume": F.sum("quote_qty"),
                       "low": F.min("price"), "high": F.max("price")},
                      {"venues": F.array_sort(F.array_distinct(F.flatten(F.collect_list("venues")))),
                       "total_volume": F.sum("total_volume"), "low": F.min("low"), "high": F.max("high")})


def cross_venue_hits(windows: DataFrame, p: RuleParams = DEFAULT_RULES) -> DataFrame:
    w = (windows.withColumn("venues_count", F.size("venues").cast("long")).withColumn("price_spread", F.col("high") - F.col("low"))
         .drop("venues", "low", "high"))
    return w.filter((F.col("venues_count") >= p.xv_min_venues) & (F.col("total_volume") > p.xv_min_volume))
