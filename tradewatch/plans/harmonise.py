"""Raw -> typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewatch.operators.state import merge_upsert
from tradewatch.operators.windows import latest_by, latest_by_stored
from tradewatch.sources.raw import (BALANCE_PAYLOAD, LOG_PAYLOAD, ONCHAIN_PAYLOAD, ORDER_PAYLOAD, TRADE_PAYLOAD,
                                   field, scaled_amount, ts_field, unusable_amount, valid)

TRADE_COLUMNS = ["trade_id", "order_id", "account_id", "wallet_id", "venue", "trading_pair",
                 "base_asset", "quote_asset", "side", "price", "quantity", "quote_qty", "fee",
                 "fee_currency", "is_maker", "trade_ts", "trade_date", "ingest_ts",
                 "source_system", "raw_record_id"]


def parse_trades(raw: DataFrame) -> DataFrame:
    v = valid(raw, TRADE_PAYLOAD)
    ts = ts_field("timestamp")
    return v.select(
        field("trade_id", "string").alias("trade_id"),
        field("order_id", "string").alias("order_id"),
        field("account_id", "string").alias("account_id"),
        field("wallet_id", "string").alias("wallet_id"),
        field("venue", "string").alias("venue"),
        field("trading_pair", "string").alias("trading_pair"),
        field("base_asset", "string").alias("base_asset"),
        field("quote_asset", "string").alias("quote_asset"),
        field("side", "string").alias("side"),
        field("price", "double").alias("price"),
        field("quantity", "double").alias("quantity"),
        field("quote_qty", "double").alias("quote_qty"),
        field("fee", "double").alias("fee"),
        field("fee_currency", "string").alias("fee_currency"),
        field("is_maker", "boolean").alias("is_maker"),
        ts.alias("trade_ts"),
        F.date_trunc("day", ts).cast("timestamp_ntz").alias("trade_date"),
        F.col("_load_ts").alias("ingest_ts"),
        F.col("_source").alias("source_system"),
        F.col("_record_id").alias("raw_record_id"),
    )


def harmonise_trades(parsed: DataFrame, mode: str = "latest", stored: bool = False) -> DataFrame:
    """Typed trades with required keys. ``mode='latest'``: one row per trade_id (latest
    ingest, then record id); ``mode='distinct'``: distinct rows as in the reference.
    ``stored``: the raw feed is a written table, which is read twice rather than shuffled whole."""
    t = parsed.filter(F.col("trade_id").isNotNull() & F.col("account_id").isNotNull())
    if mode == "distinct":
        return t.distinct()
    newest = latest_by_stored if stored else latest_by
    return newest(t, ["trade_id"], ["ingest_ts", "raw_record_id"]).select(*TRADE_COLUMNS)


def parse_orders(raw: DataFrame) -> DataFrame:
    v = valid(raw, ORDER_PAYLOAD)
    return v.select(
        field("order_id", "string").alias("order_id"),
        field("account_id", "string").alias("account_id"),
        field("wallet_id", "string").alias("wallet_id"),
        field("venue", "string").alias("venue"),
        field("trading_pair", "string").alias("trading_pair"),
        field("side", "string").alias("side"),
        field("order_type", "string").alias("order_type"),
        field("state", "string").alias("state"),
        field("price", "double").alias("price"),
        field("orig_qty", "double").alias("orig_qty"),
        field("filled_qty", "double").alias("filled_qty"),
        ts_field("timestamp").alias("event_ts"),
        F.col("_load_ts").alias("ingest_ts"),
        F.col("_record_id").alias("raw_record_id"),
    )


def harmonise_orders(parsed: DataFrame) -> DataFrame:
    """Latest state per order_id (D11): newest event time; an unparsable time never wins;
    ties broken by record id. Adds fill_ratio = filled / orig (NULL when orig is 0)."""
    o = parsed.filter(F.col("order_id").isNotNull()).withColumn(
        "fill_ratio", F.try_divide(F.coalesce(F.col("filled_qty"), F.lit(0.0)),
                                   F.nullif(F.col("orig_qty"), F.lit(0.0))))
    cols = ["order_id", "account_id", "wallet_id", "venue", "trading_pair", "side", "order_type",
            "state", "price", "orig_qty", "filled_qty", "fill_ratio", "event_ts", "ingest_ts",
            "raw_record_id"]
    return latest_by(o.select(*cols), ["order_id"], ["event_ts", "raw_record_id"])


def parse_balances(raw: DataFrame) -> DataFrame:
    v = valid(raw, BALANCE_PAYLOAD)
    return v.select(
        field("account_id", "string").alias("account_id"),
        field("asset", "string").alias("asset"),
        field("available", "double").alias("available"),
        field("locked", "double").alias("locked"),
        field("change_type", "string").alias("change_type"),
        ts_field("timestamp").alias("snapshot_ts"),
        F.col("_load_ts").alias("ingest_ts"),
        F.col("_record_id").alias("raw_record_id"),
    )


def harmonise_balances(parsed: DataFrame) -> DataFrame:
    """Latest balance per (account, asset); total = available + locked (NULL as 0)."""
    b = parsed.filter(F.col("account_id").isNotNull() & F.col("asset").isNotNull())
    b = b.select(
        "account_id", "asset", "available", "locked",
        (F.coalesce(F.col("available"), F.lit(0.0)) + F.coalesce(F.col("locked"), F.lit(0.0))).alias("total"),
        "change_type", "snapshot_ts", "ingest_ts", "raw_record_id",
    )
    return latest_by(b, ["account_id", "asset"], ["snapshot_ts", "raw_record_id"])


def parse_onchain(raw: DataFrame) -> DataFrame:
    v = valid(raw, ONCHAIN_PAYLOAD, unusable_amount())
    return v.select(
        field("event_id", "string").alias("event_id"),
        field("chain", "string").alias("chain"),
        field("block_number", "long").alias("block_number"),
        ts_field("block_timestamp").alias("block_ts"),
        field("tx_hash", "string").alias("tx_hash"),
        field("from_address", "string").alias("from_address"),
        field("to_address", "string").alias("to_address"),
        field("value_raw", "string").alias("value_raw"),
        scaled_amount().alias("value_decimal"),
        field("token_address", "string").alias("token_address"),
        field("token_symbol", "string").alias("token_symbol"),
        field("decimals", "int").alias("decimals"),
        field("event_type", "string").alias("event_type"),
        ts_field("ingested_at").alias("ingested_at"),
        F.col("_record_id").alias("raw_record_id"),
    )


def parse_logs(raw: DataFrame) -> DataFrame:
    """Service log lines: level in capitals, unparsable times NULL."""
    return valid(raw, LOG_PAYLOAD).select(
        ts_field("timestamp").alias("log_ts"), F.upper(F.col("p.level")).alias("level"), field("service").alias("service"),
        field("message").alias("message"), F.col("_load_ts").alias("ingest_ts"), F.col("_record_id").alias("raw_record_id"))


def flagged_wallets(wallets: DataFrame) -> DataFrame:
    """Sanctioned or mixer wallets, one row per (address, chain) (trap: duplicate wallet
    rows for one address would multiply transfers)."""
    f = wallets.filter((F.col("is_sanctioned") == F.lit(True)) | (F.col("is_mixer") == F.lit(True)))
    return f.groupBy("wallet_address", "chain").agg(
        F.bool_or(F.coalesce(F.col("is_sanctioned"), F.lit(False))).alias("is_sanctioned"),
        F.bool_or(F.coalesce(F.col("is_mixer"), F.lit(False))).alias("is_mixer"),
        F.max("risk_score").alias("risk_score"),
    )


def harmonise_transfers(parsed: DataFrame, wallets: DataFrame,
                        dedup: bool = True, stored: bool = False) -> DataFrame:
    """Typed transfers with counterparty risk (D13): lower-cased addresses, risk score of a
    flagged end, category SANCTIONS before MIXER, sanctioned-counterparty flag.

    Both look-ups of flagged wallets are left joins, sized at run time. ``dedup`` keeps one row
    per (chain, tx_hash, event_id) (latest ingest); a stream calls it with ``dedup=False`` and
    de-duplicates on its own if it has to. ``stored``: the raw feed is a written table, which is
    read twice rather than shuffled whole.
    """
    t = parsed.filter(F.col("tx_hash").isNotNull() & F.col("chain").isNotNull()).select(
        "event_id", "chain", "block_number", "block_ts", "tx_hash",
        F.lower("from_address").alias("from_address"), F.lower("to_address").alias("to_address"),
        "value_raw", "value_decimal", F.lower("token_address").alias("token_address"),
        "token_symbol", "decimals", "event_type", "ingested_at", "raw_record_id",
    )
    if dedup:  # before the look-ups, which add one row for each row
        # the hash first: a sort that starts with one of a few chains compares whole rows
        newest = latest_by_stored if stored else latest_by
        t = newest(t, ["tx_hash", "event_id", "chain"], ["ingested_at", "raw_record_id"])
    flagged = flagged_wallets(wallets)
    wf = flagged.select(F.col("wallet_address").alias("from_address"), "chain",
                        F.col("is_sanctioned").alias("_f_sanc"), F.col("is_mixer").alias("_f_mix"),
                        F.col("risk_score").alias("_f_risk"))
    wt = flagged.select(F.col("wallet_address").alias("to_address"), "chain",
                        F.col("is_sanctioned").alias("_t_sanc"), F.col("is_mixer").alias("_t_mix"),
                        F.col("risk_score").alias("_t_risk"))
    j = t.join(wf, on=["from_address", "chain"], how="left").join(wt, on=["to_address", "chain"], how="left")
    return j.select(
        "event_id", "chain", "block_number", "block_ts", "tx_hash", "from_address", "to_address",
        "value_raw", "value_decimal", "token_address", "token_symbol", "decimals", "event_type",
        F.coalesce(F.col("_f_risk"), F.col("_t_risk")).alias("risk_score"),
        F.when((F.col("_f_sanc") == F.lit(True)) | (F.col("_t_sanc") == F.lit(True)), F.lit("SANCTIONS"))
         .when((F.col("_f_mix") == F.lit(True)) | (F.col("_t_mix") == F.lit(True)), F.lit("MIXER"))
         .alias("risk_category"),
        (F.coalesce(F.col("_f_sanc"), F.lit(False)) | F.coalesce(F.col("_t_sanc"), F.lit(False)))
        .alias("is_sanctioned_counterparty"),
        "ingested_at", "raw_record_id",
    )


def discover_wallets(transfers: DataFrame) -> DataFrame:
    """Addresses seen on chain (D14): first/last seen and number of appearances, from both
    ends of every transfer (a self-transfer counts twice, as UNION ALL does)."""
    ends = transfers.select(
        F.explode(F.array(F.col("from_address"), F.col("to_address"))).alias("wallet_address"),
        "chain", "block_ts")
    ends = ends.filter(F.col("wallet_address").isNotNull() & (F.length("wallet_address") > 0))
    return ends.groupBy("wallet_address", "chain").agg(
        F.min("block_ts").alias("first_seen_ts"),
        F.max("block_ts").alias("last_seen_ts"),
        F.count(F.lit(1)).alias("tx_count"),
    )


def sync_wallets(wallets: DataFrame, found: DataFrame, as_of: str) -> DataFrame:
    """Upsert discovered wallets into the wallet master (M1): id md5(address::chain); new
    addresses are inserted as UNKNOWN from WALLET_DISCOVERY, known ones get last_seen_ts."""
    now = F.lit(as_of).cast("timestamp_ntz")
    src = found.select(
        F.md5(F.concat(F.col("wallet_address"), F.lit("::"), F.col("chain"))).alias("wallet_id"),
        "wallet_address", "chain", F.lit("UNKNOWN").alias("wallet_type"),
        "first_seen_ts", "last_seen_ts",
    )
    defaults = {
        "is_exchange_wallet": F.lit(False), "is_mixer": F.lit(False), "is_sanctioned": F.lit(False),
        "is_high_risk": F.lit(False), "created_at": now, "updated_at": now,
        "source_system": F.lit("WALLET_DISCOVERY"),
    }
    return merge_upsert(
        wallets, src, ["wallet_id"],
        update={"last_seen_ts": F.col("src.last_seen_ts"), "updated_at": now},
        insert=defaults,
    )


# ----------------------------------------------------------------------------- relation edges

EDGE_COLUMNS = ["relation_id", "from_entity_type", "from_id", "relation_type", "to_entity_type", "to_id",
                "confidence", "evidence_type", "valid_from", "valid_to", "created_by", "created_at"]


def owner_edges(wallets: DataFrame) -> DataFrame:
    """OWNS edges entity -> wallet from the wallet master (the relation table's shape:
    typed node ids at both ends, validity interval, confidence 1.0)."""
    w = wallets.filter(F.col("owner_entity_id").isNotNull())
    return w.select(
        F.md5(F.concat_ws("|", F.col("owner_entity_id"), F.lit("OWNS"), F.col("wallet_id"))).alias("relation_id"),
        F.lit("ENTITY").alias("from_entity_type"), F.col("owner_entity_id").alias("from_id"),
        F.lit("OWNS").alias("relation_type"), F.lit("WALLET").alias("to_entity_type"),
        F.col("wallet_id").alias("to_id"), F.lit(1.0).alias("confidence"),
        F.lit("KYC_DOCUMENT").alias("evidence_type"), F.col("created_at").alias("valid_from"),
        F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit("SYSTEM").alias("created_by"),
        F.col("created_at"))


def active_edges(edges: DataFrame) -> DataFrame:
    """Currently valid edges (``valid_to IS NULL``)."""
    return edges.filter(F.col("valid_to").isNull())
