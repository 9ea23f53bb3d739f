"""Raw feeds: JSON envelope schema, file ingest, enrichment and the dead-letter split.

Every feed is an envelope of lineage columns plus one JSON payload (schema on read). The
payload is parsed once with the feed's schema (``from_json``, PERMISSIVE with a corrupt
record column); rows that do not parse go to the dead-letter output instead of failing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENVELOPE = T.StructType([
    T.StructField("_record_id", T.StringType(), False),
    T.StructField("_load_ts", T.TimestampNTZType(), False),
    T.StructField("_source", T.StringType(), False),
    T.StructField("_ingest_method", T.StringType(), False),
    T.StructField("_partition_key", T.StringType(), True),
    T.StructField("_file_name", T.StringType(), True),
    T.StructField("payload", T.StringType(), False),
])

DLQ_COLUMNS = ["_dlq_id", "_load_ts", "source_table", "_source", "_partition_key",
               "raw_payload", "error_message", "retry_count", "resolved"]


def _s(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


def _d(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


# Payload schemas of the feeds (schema on read; unknown keys are ignored).
TRADE_PAYLOAD = T.StructType(
    _s("event_type", "trade_id", "order_id", "account_id", "wallet_id", "venue", "trading_pair",
       "base_asset", "quote_asset", "side")
    + _d("price", "quantity", "quote_qty", "fee")
    + _s("fee_currency") + [T.StructField("is_maker", T.BooleanType())] + _s("timestamp"))
ORDER_PAYLOAD = T.StructType(
    _s("event_type", "order_id", "account_id", "wallet_id", "venue", "trading_pair", "side", "order_type", "state")
    + _d("price", "orig_qty", "filled_qty") + _s("timestamp"))
BALANCE_PAYLOAD = T.StructType(
    _s("event_type", "account_id", "asset") + _d("available", "locked", "total") + _s("change_type", "timestamp"))
ONCHAIN_PAYLOAD = T.StructType(
    _s("event_id", "chain") + [T.StructField("block_number", T.LongType())]
    + _s("block_timestamp", "tx_hash", "from_address", "to_address", "value_raw") + _d("value_decimal")
    + _s("token_address", "token_symbol") + [T.StructField("decimals", T.IntegerType())] + _s("event_type")
    + [T.StructField("gas_used", T.LongType())] + _d("gas_price_gwei") + _s("ingested_at", "environment"))
LOG_PAYLOAD = T.StructType(_s("timestamp", "level", "service", "message"))

CORRUPT = "_corrupt"
NO_PAYLOAD = "_no_payload"


def parse(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Add ``p`` = payload parsed with ``schema``. Text that is not JSON, or whose typed fields do
    not convert (e.g. a non-numeric price), sets ``p._corrupt`` to the raw text instead of failing
    the job. The parse is the output of a one-row generator: a plain projection would be copied into
    each of the many references to ``p`` and parse every payload as often. ``_no_payload`` comes out of it
    too: a filter on ``payload`` itself would be pushed below the generator into the step that makes the
    payload, and every payload would be made twice."""
    full = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = F.from_json(F.col("payload"), full, opts)
    return raw.select(*[c for c in raw.columns if c not in ("p", NO_PAYLOAD)], F.inline(F.array(F.struct(
        parsed.alias("p"), F.col("payload").isNull().alias(NO_PAYLOAD)))))


def _is_bad(unusable: Column | None) -> Column:
    bad = F.col(NO_PAYLOAD) | F.col(f"p.{CORRUPT}").isNotNull()
    return bad if unusable is None else bad | F.coalesce(unusable, F.lit(False))


def scaled_amount() -> Column:
    """Token amount of an on-chain payload: the scaled amount it carries, else the raw integer
    amount over 10 ** decimals in decimal arithmetic (18-decimal amounts overflow LONG). NULL
    where the text is no number or the result has too many digits."""
    unit = F.pow(F.lit(10), F.col("p.decimals")).try_cast("decimal(38,0)")
    raw_amount = F.col("p.value_raw").try_cast("decimal(38,0)")
    return F.coalesce(F.col("p.value_decimal"), F.try_divide(raw_amount, unit).cast("double"))


def unusable_amount() -> Column:
    """A raw amount is given and no number can be read from it."""
    no_number = F.col("p.value_raw").try_cast("decimal(38,0)").isNull()
    return (F.col("p.value_decimal").isNull() & F.col("p.value_raw").isNotNull()
            & (no_number | (F.col("p.decimals").isNotNull() & scaled_amount().isNull())))


def valid(raw: DataFrame, schema: T.StructType, unusable: Column | None = None) -> DataFrame:
    """Rows whose payload parses and is not ``unusable``; ``p`` holds the typed payload struct."""
    return parse(raw, schema).filter(~_is_bad(unusable)).drop(NO_PAYLOAD)


def dead_letters(raw: DataFrame, source_table: str, schema: T.StructType, unusable: Column | None = None) -> DataFrame:
    """Rows whose payload does not parse or is ``unusable`` (a condition on ``p``), in the
    dead-letter shape (S10)."""
    bad = parse(raw, schema).filter(_is_bad(unusable))
    return bad.select(
        F.sha2(F.concat(F.lit(source_table + ":"), F.col("_record_id")), 256).alias("_dlq_id"),
        F.col("_load_ts"),
        F.lit(source_table).alias("source_table"),
        F.col("_source"),
        F.col("_partition_key"),
        F.col("payload").alias("raw_payload"),
        F.when(F.try_parse_json(F.col("payload")).isNull(), F.lit("MALFORMED_JSON"))
         .otherwise(F.lit("TYPE_MISMATCH")).alias("error_message"),
        F.lit(0).alias("retry_count"),
        F.lit(False).alias("resolved"),
    )


def field(path: str, dtype: str | None = None) -> Column:
    """Typed payload field (the schema already fixed its type)."""
    c = F.col(f"p.{path}")
    return c.cast(dtype) if dtype else c


def ts_field(path: str) -> Column:
    """Tolerant time parse of a payload text field (NULL on failure), as TIMESTAMP_NTZ."""
    return F.try_to_timestamp(F.col(f"p.{path}")).cast("timestamp_ntz")


def read_json_files(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False) -> DataFrame:
    """JSON files with an explicit schema (no inference). ``multiline=True`` reads files
    whose top level is an array (each element becomes a row); otherwise one object per line.
    Malformed records keep their text in ``_corrupt`` (PERMISSIVE) instead of failing the
    read, and the object path is kept for lineage (S8)."""
    full = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    df = (spark.read.schema(full).option("multiLine", multiline).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", CORRUPT).json(path))
    return df.withColumn("_file_name", F.col("_metadata.file_path"))


def enrich(df: DataFrame, source: str, method: str, key_col: str | None = None) -> DataFrame:
    """Envelope enrichment (S9): deterministic record id (hash of the payload and file),
    load time, source and method. ``uuid()`` is avoided so replays give the same ids."""
    payload = F.to_json(F.struct(*[F.col(c) for c in df.columns if not c.startswith("_")]))
    return df.select(
        F.sha2(F.concat_ws("|", payload, F.coalesce(F.col("_file_name"), F.lit(""))), 256).alias("_record_id")
        if "_file_name" in df.columns else F.sha2(payload, 256).alias("_record_id"),
        F.current_timestamp().cast("timestamp_ntz").alias("_load_ts"),
        F.lit(source).alias("_source"),
        F.lit(method).alias("_ingest_method"),
        (F.col(key_col).cast("string") if key_col else F.lit(None).cast("string")).alias("_partition_key"),
        (F.col("_file_name") if "_file_name" in df.columns else F.lit(None).cast("string")).alias("_file_name"),
        payload.alias("payload"),
    )


def write_feed(df: DataFrame, path: str, partition_cols: tuple[str, ...] = ("event_date",)) -> None:
    """Append raw rows partitioned by event day (partition pruning for look-backs)."""
    out = df
    if "event_date" in partition_cols and "event_date" not in df.columns:
        out = df.withColumn("event_date", F.to_date(F.col("_load_ts")))
    out.write.mode("append").partitionBy(*partition_cols).parquet(path)


def export_jsonl(feeds: dict[str, DataFrame], path: str) -> None:
    """All feeds into one JSON-lines output (S12); columns missing in a feed are NULL."""
    it = iter(feeds.items())
    name, first = next(it)
    u = first.withColumn("_feed", F.lit(name))
    for name, df in it:
        u = u.unionByName(df.withColumn("_feed", F.lit(name)), allowMissingColumns=True)
    u.write.mode("overwrite").json(path)
