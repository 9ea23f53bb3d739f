"""Domain tables derived from the driver's Parquet tables.

The driver ships TPC-H-like tables plus an ``events`` table. These adapters map them onto
the surveillance data model (trades, orders, balances, on-chain transfers, wallets,
entities, account map, alert and case stores for the reports). Every mapping is a plain
projection or join, so its work grows with the input tables.

Fixed values: the mapping rules below are part of the test contract (the DuckDB oracle
derives the same tables with the same rules).
  trades    <- events (event_type <> 'error'); as of 2024-01-31 00:00:00
  orders    <- events (all; error = CANCELLED); order_id = event_id div 2
  balances  <- events
  transfers <- lineitem JOIN orders; as of 2001-08-01 00:00:00
  wallets   <- customer (owned, 'c' + custkey) and supplier (un-owned, 's' + suppkey),
               one row per chain; sanctioned: suppkey mod 7 = 3, mixer: suppkey mod 5 = 2
  entities  <- customer; account_map: ACC + n <-> ENT + n
  alerts    <- events (report fixtures); cases <- orders (report fixtures)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewatch.functions.text import pad, pad_id

TRADES_AS_OF = "2024-01-31 00:00:00"
ONCHAIN_AS_OF = "2001-08-01 00:00:00"
CASES_AS_OF = "2001-08-01 00:00:00"

# Trading pairs by event_id mod 3, sides by event type, chains by line parity.
PAIRS = ["BTC-USDT", "ETH-USDT", "SOL-USDT"]
BASES = ["BTC", "ETH", "SOL"]
BUY_EVENTS = ["click", "view"]
CHAINS = ["ethereum", "polygon"]
KYC_BY_SEGMENT = {"AUTOMOBILE": "TIER_1", "BUILDING": "TIER_2", "FURNITURE": "TIER_3",
                  "HOUSEHOLD": "TIER_2", "MACHINERY": "TIER_1"}
CHANGE_TYPE_BY_EVENT = {"click": "TRADE", "view": "DEPOSIT", "purchase": "WITHDRAWAL",
                        "signup": "FEE", "error": "LIQUIDATION"}
ALERT_TYPE_BY_EVENT = {"click": "WASH_TRADE", "view": "PUMP_AND_DUMP", "purchase": "STRUCTURING",
                       "signup": "CROSS_EXCHANGE_ARBITRAGE", "error": "MIXER_EXPOSURE"}
SEVERITY_BY_MOD4 = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
ALERT_STATUS_BY_MOD3 = ["OPEN", "IN_REVIEW", "CLOSED"]
CASE_STATE_BY_STATUS = {"O": "OPEN", "P": "IN_REVIEW", "F": "CLOSED"}
PRIORITY_BY_ORDER_PRIORITY = {"1-URGENT": "CRITICAL", "2-HIGH": "HIGH", "3-MEDIUM": "MEDIUM"}

TS_TEXT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(values: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + F.lit(1)).cast("int"))


def _map(mapping: dict[str, str], col: Column, default) -> Column:
    expr = F.lit(default)
    for k, v in reversed(list(mapping.items())):
        expr = F.when(col == F.lit(k), F.lit(v)).otherwise(expr)
    return expr


def account_of(user_id: Column) -> Column:
    return pad_id("ACC", user_id)


def entity_of(key: Column) -> Column:
    return pad_id("ENT", key)


# --------------------------------------------------------------------------- trades


def _trade_columns(e: DataFrame) -> list[Column]:
    eid = F.col("event_id")
    quote_qty = F.col("value") * F.lit(100)
    return [
        eid.cast("string").alias("trade_id"),
        F.expr("event_id div 2").cast("string").alias("order_id"),
        account_of(F.col("user_id")).alias("account_id"),
        F.concat(F.lit("W"), F.col("user_id").cast("string")).alias("wallet_id"),
        F.concat(F.lit("V"), (eid % 4).cast("string")).alias("venue"),
        _pick(PAIRS, eid % 3).alias("trading_pair"),
        _pick(BASES, eid % 3).alias("base_asset"),
        F.lit("USDT").alias("quote_asset"),
        F.when(F.col("event_type").isin(*BUY_EVENTS), F.lit("BUY")).otherwise(F.lit("SELL")).alias("side"),
        (F.lit(100) * (F.lit(1) + (eid % 11) / F.lit(1000))).alias("price"),
        (F.lit(10) * (F.lit(1) + (eid % 5) / F.lit(100))).alias("quantity"),
        quote_qty.alias("quote_qty"),
        (F.col("value") * F.lit(0.1)).alias("fee"),
        F.lit("USDT").alias("fee_currency"),
        (F.col("event_type") == F.lit("purchase")).alias("is_maker"),
    ]


def trades(events: DataFrame) -> DataFrame:
    """Typed trades (the harmonised table) straight from ``events``."""
    e = events.filter(F.col("event_type") != F.lit("error"))
    return e.select(
        *_trade_columns(e),
        F.col("ts").alias("trade_ts"),
        F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("trade_date"),
        (F.col("ts") + F.expr("INTERVAL 2 SECONDS")).alias("ingest_ts"),
        F.when(F.col("event_id") % 2 == 0, F.lit("kinesis")).otherwise(F.lit("s3")).alias("source_system"),
        F.concat(F.lit("T"), F.col("event_id").cast("string")).alias("raw_record_id"),
    )


def arrival_batch(days: int = 8) -> Column:
    """Number of the batch that an event arrives with: each holds ``days`` days, and events with
    event_id mod 10 = 0 come three days late."""
    held = F.when(F.col("event_id") % 10 == 0, F.lit(3)).otherwise(F.lit(0))
    return F.floor((F.unix_date(F.to_date("ts")) + held) / F.lit(days)).cast("int")


def _envelope(rec_prefix: str, e: DataFrame, payload: Column, partition_key: Column,
              feed: str, lag_seconds: int) -> DataFrame:
    eid = F.col("event_id")
    return e.select(
        F.concat(F.lit(rec_prefix), eid.cast("string")).alias("_record_id"),
        (F.col("ts") + F.expr(f"INTERVAL {lag_seconds} SECONDS")).alias("_load_ts"),
        F.when(eid % 2 == 0, F.lit("kinesis")).otherwise(F.lit("s3")).alias("_source"),
        F.when(eid % 2 == 0, F.lit("STREAM")).otherwise(F.lit("FILE")).alias("_ingest_method"),
        partition_key.alias("_partition_key"),
        F.when(eid % 2 == 1, F.concat(F.lit(f"{feed}/"), F.date_format("ts", "yyyy/MM/dd"),
                                      F.lit("/part-0.json"))).alias("_file_name"),
        payload.alias("payload"),
        eid.alias("_event_id"),
    )


def _corrupt(payload: Column) -> Column:
    """Dead letters: events with event_id mod 97 = 0 carry a truncated JSON text."""
    return F.when(F.col("event_id") % 97 == 0,
                  F.substring(payload, 1, 20)).otherwise(payload)


def _ts_text(ts: Column) -> Column:
    """Payload time text; event_id mod 89 = 0 carries an unparsable time."""
    return F.when(F.col("event_id") % 89 == 0, F.lit("not-a-time")).otherwise(F.date_format(ts, TS_TEXT))


def trades_raw(events: DataFrame) -> DataFrame:
    """Raw trade envelopes: JSON payload text, dead letters, bad times and replayed records
    (event_id mod 53 = 0 is delivered twice, the replay 60 s later with its own record id)."""
    e = events.filter(F.col("event_type") != F.lit("error"))
    body = F.to_json(F.struct(F.lit("trade").alias("event_type"), *_trade_columns(e),
                              _ts_text(F.col("ts")).alias("timestamp")))
    raw = _envelope("T", e, _corrupt(body), account_of(F.col("user_id")), "trades", 2)
    replay = (raw.filter(F.col("_event_id") % 53 == 0)
              .withColumn("_record_id", F.concat(F.col("_record_id"), F.lit("-r")))
              .withColumn("_load_ts", F.col("_load_ts") + F.expr("INTERVAL 60 SECONDS")))
    return raw.unionByName(replay).drop("_event_id")


# --------------------------------------------------------------------------- orders / balances


def _order_columns(e: DataFrame) -> list[Column]:
    eid = F.col("event_id")
    orig = F.lit(10) * (F.lit(1) + (eid % 5) / F.lit(100))
    cancelled = F.col("event_type") == F.lit("error")
    return [
        F.expr("event_id div 2").cast("string").alias("order_id"),
        account_of(F.col("user_id")).alias("account_id"),
        F.concat(F.lit("W"), F.col("user_id").cast("string")).alias("wallet_id"),
        F.concat(F.lit("V"), (eid % 4).cast("string")).alias("venue"),
        _pick(PAIRS, eid % 3).alias("trading_pair"),
        F.when(F.col("event_type").isin(*BUY_EVENTS), F.lit("BUY")).otherwise(F.lit("SELL")).alias("side"),
        F.when(eid % 2 == 0, F.lit("LIMIT")).otherwise(F.lit("MARKET")).alias("order_type"),
        F.when(cancelled, F.lit("CANCELLED")).otherwise(F.lit("FILLED")).alias("state"),
        (F.lit(100) * (F.lit(1) + (eid % 11) / F.lit(1000))).alias("price"),
        orig.alias("orig_qty"),
        F.when(cancelled, F.lit(0.0)).otherwise(orig).alias("filled_qty"),
    ]


def orders(events: DataFrame) -> DataFrame:
    """Typed order events (before the latest-per-order step)."""
    return events.select(
        *_order_columns(events),
        F.col("ts").alias("event_ts"),
        (F.col("ts") + F.expr("INTERVAL 1 SECONDS")).alias("ingest_ts"),
        F.concat(F.lit("O"), F.col("event_id").cast("string")).alias("raw_record_id"),
    )


def orders_raw(events: DataFrame) -> DataFrame:
    body = F.to_json(F.struct(F.lit("order").alias("event_type"), *_order_columns(events),
                              F.date_format("ts", TS_TEXT).alias("timestamp")))
    return _envelope("O", events, body, account_of(F.col("user_id")), "orders", 1).drop("_event_id")


def _balance_columns(e: DataFrame) -> list[Column]:
    eid = F.col("event_id")
    return [
        account_of(F.col("user_id")).alias("account_id"),
        _pick(BASES, eid % 3).alias("asset"),
        F.col("value").alias("available"),
        F.round(F.col("value") * F.lit(0.05), 4).alias("locked"),
        _map(CHANGE_TYPE_BY_EVENT, F.col("event_type"), "TRADE").alias("change_type"),
    ]


def balances_raw(events: DataFrame) -> DataFrame:
    body = F.to_json(F.struct(F.lit("balance").alias("event_type"), *_balance_columns(events),
                              F.date_format("ts", TS_TEXT).alias("timestamp")))
    return _envelope("B", events, body, account_of(F.col("user_id")), "balances", 1).drop("_event_id")


# --------------------------------------------------------------------------- on-chain


def _transfer_columns(lineitem: DataFrame, orders_t: DataFrame) -> DataFrame:
    li = lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                         "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    o = orders_t.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    j = li.join(o, on="l_orderkey", how="inner")
    tx = F.md5(F.concat_ws(
        "|",
        F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"),
        F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string"),
        F.col("l_quantity").cast("decimal(18,2)").cast("string"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string"),
        F.col("l_shipdate").cast("date").cast("string"),
    ))
    return j.select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("event_id"),
        F.when(F.col("l_linenumber") % 2 == 0, F.lit("ethereum")).otherwise(F.lit("polygon")).alias("chain"),
        F.col("l_orderkey").alias("block_number"),
        F.col("l_shipdate").alias("block_ts"),
        tx.alias("tx_hash"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("from_address"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("to_address"),
        F.round(F.col("l_extendedprice") * F.lit(100)).cast("long").cast("string").alias("value_raw"),
        F.col("l_extendedprice").alias("value_decimal"),
        F.when(F.col("l_returnflag") == F.lit("N"), F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("0xTOKEN"), F.col("l_returnflag"))).alias("token_address"),
        F.col("l_returnflag").alias("token_symbol"),
        F.lit(2).alias("decimals"),
        F.when(F.col("l_linestatus") == F.lit("F"), F.lit("transfer")).otherwise(F.lit("swap")).alias("event_type"),
        (F.col("l_shipdate") + F.expr("INTERVAL 30 SECONDS")).alias("ingested_at"),
        F.concat(F.lit("X"), tx).alias("raw_record_id"),
    )


def transfers_parsed(lineitem: DataFrame, orders_t: DataFrame) -> DataFrame:
    """On-chain events as typed columns (what parsing the raw feed yields)."""
    return _transfer_columns(lineitem, orders_t)


def onchain_raw(lineitem: DataFrame, orders_t: DataFrame, faults: bool = False) -> DataFrame:
    """Raw on-chain envelopes. With ``faults``, blocks divisible by 41 carry only the raw amount,
    those divisible by 82 one that is no number, and those divisible by 97 a truncated payload."""
    t = _transfer_columns(lineitem, orders_t)
    block = F.col("block_number")
    if faults:
        t = (t.withColumn("value_decimal", F.when(block % 41 != 0, F.col("value_decimal")))
             .withColumn("value_raw", F.when(block % 82 == 0, F.lit("0xff")).otherwise(F.col("value_raw"))))
    cols = [c for c in t.columns if c not in ("raw_record_id",)]
    body = F.to_json(F.struct(
        *[F.col(c) for c in cols if c not in ("block_ts", "ingested_at")],
        F.date_format("block_ts", TS_TEXT).alias("block_timestamp"),
        F.date_format("ingested_at", TS_TEXT).alias("ingested_at"),
        F.lit("test").alias("environment"),
    ))
    return t.select(
        F.col("raw_record_id").alias("_record_id"),
        F.col("ingested_at").alias("_load_ts"),
        F.lit("s3").alias("_source"),
        F.lit("FILE").alias("_ingest_method"),
        F.concat_ws(":", F.col("chain"), F.col("tx_hash")).alias("_partition_key"),
        F.lit(None).cast("string").alias("_file_name"),
        (F.when(block % 97 == 0, F.substring(body, 1, 8)).otherwise(body) if faults else body).alias("payload"),
    )


def logs_raw(events: DataFrame) -> DataFrame:
    """Raw service log envelopes: one line per event, with truncated payloads and bad times."""
    body = F.to_json(F.struct(
        _ts_text(F.col("ts")).alias("timestamp"),
        F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("info")).alias("level"),
        F.concat(F.lit("svc-"), (F.col("event_id") % 4).cast("string")).alias("service"),
        F.concat_ws(" ", F.col("event_type"), F.col("user_id").cast("string")).alias("message")))
    return _envelope("L", events, _corrupt(body), F.col("event_type"), "logs", 3).drop("_event_id")


# --------------------------------------------------------------------------- masters


def wallets(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    chains = F.explode(F.array(*[F.lit(c) for c in CHAINS]))
    seed_ts = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    c = customer.select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("wallet_address"),
        chains.alias("chain"),
        entity_of(F.col("c_custkey")).alias("owner_entity_id"),
        F.lit("EOA").alias("wallet_type"),
        F.lit(False).alias("is_exchange_wallet"),
        F.lit(False).alias("is_mixer"),
        F.lit(False).alias("is_sanctioned"),
        F.lit(None).cast("double").alias("risk_score"),
        F.lit(None).cast("string").alias("label"),
    )
    k = F.col("s_suppkey")
    sanctioned = k % 7 == 3
    mixer = k % 5 == 2
    s = supplier.select(
        F.concat(F.lit("s"), k.cast("string")).alias("wallet_address"),
        chains.alias("chain"),
        F.lit(None).cast("string").alias("owner_entity_id"),
        F.when(k % 3 == 0, F.lit("CONTRACT")).otherwise(F.lit("EOA")).alias("wallet_type"),
        (k % 11 == 0).alias("is_exchange_wallet"),
        mixer.alias("is_mixer"),
        sanctioned.alias("is_sanctioned"),
        F.when(sanctioned, F.lit(95.0)).when(mixer, F.lit(80.0)).otherwise(F.lit(None).cast("double")).alias("risk_score"),
        F.when(mixer, F.concat(F.lit("mixer-"), (k % 3).cast("string")))
         .when(sanctioned, F.concat(F.lit("sdn-"), k.cast("string"))).alias("label"),
    )
    u = c.unionByName(s)
    return u.select(
        F.md5(F.concat(F.col("wallet_address"), F.lit("::"), F.col("chain"))).alias("wallet_id"),
        "wallet_address", "chain", "owner_entity_id", "wallet_type", "is_exchange_wallet",
        "is_mixer", "is_sanctioned",
        (F.col("is_mixer") | F.col("is_sanctioned")).alias("is_high_risk"),
        "risk_score", "label",
        F.lit(None).cast("string").alias("cluster_id"),
        F.lit(None).cast("timestamp_ntz").alias("first_seen_ts"),
        F.lit(None).cast("timestamp_ntz").alias("last_seen_ts"),
        seed_ts.alias("created_at"), seed_ts.alias("updated_at"),
        F.lit("SEED").alias("source_system"),
    )


def entities(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    sanctions = k % 97 == 0
    bal = F.col("c_acctbal")
    return customer.select(
        entity_of(k).alias("entity_id"),
        F.col("c_name").alias("full_name"),
        F.date_add(F.lit("1950-01-01").cast("date"), (k % 18000).cast("int")).alias("date_of_birth"),
        F.col("c_nationkey").cast("string").alias("nationality"),
        F.col("c_nationkey").cast("string").alias("country_of_residence"),
        F.concat(F.lit("user"), k.cast("string"), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("+1 555 "), F.lpad((k % 10000).cast("string"), 4, "0")).alias("phone"),
        _map(KYC_BY_SEGMENT, F.col("c_mktsegment"), "UNVERIFIED").alias("kyc_tier"),
        F.when(sanctions, F.lit("CRITICAL")).when(bal < 0, F.lit("HIGH"))
         .when(bal < 1000, F.lit("MEDIUM")).otherwise(F.lit("LOW")).alias("aml_risk_rating"),
        (k % 50 == 0).alias("pep_flag"),
        sanctions.alias("sanctions_flag"),
        F.lit(False).alias("adverse_media_flag"),
        F.when(F.col("c_nationkey") % 3 == 0, F.lit("INSTITUTIONAL")).otherwise(F.lit("INDIVIDUAL")).alias("account_type"),
        F.timestamp_add("HOUR", k, F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")).alias("onboarded_at"),
        F.lit("ACTIVE").alias("status"),
    )


def account_map(customer: DataFrame) -> DataFrame:
    return customer.select(account_of(F.col("c_custkey")).alias("account_id"),
                           entity_of(F.col("c_custkey")).alias("entity_id"))


# --------------------------------------------------------------------------- report stores


def alerts_store(events: DataFrame) -> DataFrame:
    """Alert store for the reports: one alert per event."""
    eid = F.col("event_id")
    return events.select(
        eid.cast("string").alias("alert_id"),
        entity_of(F.col("user_id")).alias("entity_id"),
        F.concat(F.lit("W"), F.col("user_id").cast("string")).alias("wallet_id"),
        _map(ALERT_TYPE_BY_EVENT, F.col("event_type"), "WASH_TRADE").alias("alert_type"),
        _pick(SEVERITY_BY_MOD4, eid % 4).alias("severity"),
        F.concat(F.lit("event "), F.col("event_type")).alias("reason"),
        F.round(F.col("value") / F.lit(500), 4).alias("ml_fraud_probability"),
        _pick(ALERT_STATUS_BY_MOD3, eid % 3).alias("status"),
        F.lit(None).cast("string").alias("case_id"),
        F.col("ts").alias("detected_at"),
        F.md5(eid.cast("string")).alias("dedup_hash"),
    )


def cases_store(orders_t: DataFrame) -> DataFrame:
    """Case store for the reports: one case per order, for the entity numbered like the
    order (so some entities have open cases, some only closed ones, most none)."""
    k = F.col("o_orderkey")
    state = _map(CASE_STATE_BY_STATUS, F.col("o_orderstatus"), "OPEN")
    prio = _map(PRIORITY_BY_ORDER_PRIORITY, F.col("o_orderpriority"), "LOW")
    created = F.col("o_orderdate")
    closed = state == F.lit("CLOSED")
    sla = (F.when(prio == "CRITICAL", 4).when(prio == "HIGH", 24).when(prio == "MEDIUM", 72).otherwise(168))
    return orders_t.select(
        F.concat(F.lit("C"), k.cast("string")).alias("case_id"),
        F.concat(F.lit("CASE-"), F.date_format(created, "yyyyMMdd"), F.lit("-"),
                 pad(k, 5)).alias("case_ref"),
        entity_of(k).alias("entity_id"),
        state.alias("state"),
        prio.alias("priority"),
        F.concat(F.lit("order "), k.cast("string")).alias("title"),
        F.round((k % 100) / F.lit(100), 2).alias("peak_ml_probability"),
        prio.alias("composite_severity"),
        F.when(k % 5 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("analyst_"), (k % 5).cast("string"))).alias("assigned_to"),
        F.timestamp_add("HOUR", sla, created).alias("due_by"),
        (k % 7 == 0).alias("sla_breached"),
        F.when(closed, F.when(k % 4 == 0, F.lit("FALSE_POSITIVE")).otherwise(F.lit("TRUE_POSITIVE"))).alias("resolution_type"),
        created.alias("created_at"),
        created.alias("updated_at"),
        F.when(closed, F.timestamp_add("HOUR", k % 200, created)).alias("closed_at"),
        F.lit("SEED").alias("created_by"),
    )


def case_actions(orders_t: DataFrame) -> DataFrame:
    """Analyst actions for the report cases: state changes on every 10th order's case, a
    later second change on every 20th, a narrative on every 40th, and actions on unknown
    cases for every 500th."""
    k = F.col("o_orderkey")
    d = F.col("o_orderdate")
    base = orders_t.select("o_orderkey", "o_orderdate")
    first = base.filter(k % 10 == 0).select(
        F.concat(F.lit("A"), k.cast("string")).alias("action_id"),
        F.concat(F.lit("C"), k.cast("string")).alias("case_id"),
        F.lit("STATE_CHANGE").alias("action"),
        F.when(k % 30 == 0, F.lit("FALSE_POSITIVE")).when(k % 30 == 10, F.lit("ESCALATED"))
         .otherwise(F.lit("CLOSED")).alias("new_state"),
        F.concat(F.lit("analyst_"), (k % 7).cast("string")).alias("analyst"),
        F.lit(None).cast("string").alias("narrative"),
        F.timestamp_add("DAY", F.lit(1), d).alias("action_ts"),
    )
    second = base.filter(k % 20 == 0).select(
        F.concat(F.lit("B"), k.cast("string")).alias("action_id"),
        F.concat(F.lit("C"), k.cast("string")).alias("case_id"),
        F.lit("STATE_CHANGE").alias("action"),
        F.lit("SAR_FILED").alias("new_state"),
        F.concat(F.lit("analyst_"), (k % 7).cast("string")).alias("analyst"),
        F.lit(None).cast("string").alias("narrative"),
        F.timestamp_add("DAY", F.lit(2), d).alias("action_ts"),
    )
    narrative = base.filter(k % 40 == 0).select(
        F.concat(F.lit("N"), k.cast("string")).alias("action_id"),
        F.concat(F.lit("C"), k.cast("string")).alias("case_id"),
        F.lit("NARRATIVE").alias("action"),
        F.lit(None).cast("string").alias("new_state"),
        F.lit("copilot").alias("analyst"),
        F.concat(F.lit("Narrative for case C"), k.cast("string")).alias("narrative"),
        F.timestamp_add("DAY", F.lit(3), d).alias("action_ts"),
    )
    unknown = base.filter(k % 500 == 0).select(
        F.concat(F.lit("U"), k.cast("string")).alias("action_id"),
        F.concat(F.lit("C-missing-"), k.cast("string")).alias("case_id"),
        F.lit("STATE_CHANGE").alias("action"),
        F.lit("CLOSED").alias("new_state"),
        F.lit("analyst_x").alias("analyst"),
        F.lit(None).cast("string").alias("narrative"),
        F.timestamp_add("DAY", F.lit(1), d).alias("action_ts"),
    )
    every = first.unionByName(second).unionByName(narrative).unionByName(unknown)
    told = F.col("action") == "NARRATIVE"
    return every.withColumn("summary", F.when(told, F.concat(F.lit("Summary of "), F.col("case_id")))).withColumn(
        "recommended_action", F.when(told, F.when(F.col("case_id").endswith("00"), F.lit("FILE_SAR")).otherwise(F.lit("CONTINUE_MONITORING"))))
