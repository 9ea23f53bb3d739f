"""DuckDB definitions of the domain tables that the Spark adapters derive.

Each constant is a CTE body over the driver's views (events, customer, supplier, orders,
lineitem). ``with_(...)`` assembles a WITH clause from the names a query needs.
"""

from __future__ import annotations

TRADES_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
ONCHAIN_AS_OF = "TIMESTAMP '2001-08-01 00:00:00'"

ACC = "'ACC' || lpad(CAST(user_id AS VARCHAR), greatest(6, length(CAST(user_id AS VARCHAR)))::INTEGER, '0')"
PAIR = "CASE event_id % 3 WHEN 0 THEN 'BTC-USDT' WHEN 1 THEN 'ETH-USDT' ELSE 'SOL-USDT' END"
BASE = "CASE event_id % 3 WHEN 0 THEN 'BTC' WHEN 1 THEN 'ETH' ELSE 'SOL' END"
SIDE = "CASE WHEN event_type IN ('click', 'view') THEN 'BUY' ELSE 'SELL' END"
PRICE = "100 * (1 + (event_id % 11) / 1000)"
QTY = "10 * (1 + (event_id % 5) / 100)"

CTES: dict[str, str] = {}

CTES["trades"] = f"""
SELECT CAST(event_id AS VARCHAR) AS trade_id,
       CAST(event_id // 2 AS VARCHAR) AS order_id,
       {ACC} AS account_id,
       'W' || CAST(user_id AS VARCHAR) AS wallet_id,
       'V' || CAST(event_id % 4 AS VARCHAR) AS venue,
       {PAIR} AS trading_pair,
       {BASE} AS base_asset,
       'USDT' AS quote_asset,
       {SIDE} AS side,
       {PRICE} AS price,
       {QTY} AS quantity,
       value * 100 AS quote_qty,
       value * CAST(0.1 AS DOUBLE) AS fee,
       'USDT' AS fee_currency,
       event_type = 'purchase' AS is_maker,
       ts AS trade_ts,
       date_trunc('day', ts) AS trade_date,
       ts + INTERVAL 2 SECOND AS ingest_ts,
       CASE WHEN event_id % 2 = 0 THEN 'kinesis' ELSE 's3' END AS source_system,
       'T' || CAST(event_id AS VARCHAR) AS raw_record_id,
       event_id AS _eid
FROM events WHERE event_type <> 'error'
"""

CTES["orders_ev"] = f"""
SELECT CAST(event_id // 2 AS VARCHAR) AS order_id,
       {ACC} AS account_id,
       'W' || CAST(user_id AS VARCHAR) AS wallet_id,
       'V' || CAST(event_id % 4 AS VARCHAR) AS venue,
       {PAIR} AS trading_pair,
       {SIDE} AS side,
       CASE WHEN event_id % 2 = 0 THEN 'LIMIT' ELSE 'MARKET' END AS order_type,
       CASE WHEN event_type = 'error' THEN 'CANCELLED' ELSE 'FILLED' END AS state,
       {PRICE} AS price,
       {QTY} AS orig_qty,
       CASE WHEN event_type = 'error' THEN CAST(0 AS DOUBLE) ELSE {QTY} END AS filled_qty,
       ts AS event_ts,
       ts + INTERVAL 1 SECOND AS ingest_ts,
       'O' || CAST(event_id AS VARCHAR) AS raw_record_id
FROM events
"""

CTES["orders_latest"] = """
SELECT order_id, account_id, wallet_id, venue, trading_pair, side, order_type, state, price,
       orig_qty, filled_qty, coalesce(filled_qty, 0) / nullif(orig_qty, 0) AS fill_ratio,
       event_ts, ingest_ts, raw_record_id
FROM (SELECT *, row_number() OVER (PARTITION BY order_id
                                   ORDER BY event_ts DESC NULLS LAST, raw_record_id DESC) AS rn
      FROM orders_ev) WHERE rn = 1
"""

CTES["transfers_p"] = """
SELECT CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS event_id,
       CASE WHEN l.l_linenumber % 2 = 0 THEN 'ethereum' ELSE 'polygon' END AS chain,
       l.l_orderkey AS block_number,
       l.l_shipdate AS block_ts,
       md5(concat_ws('|', CAST(l.l_orderkey AS VARCHAR), CAST(l.l_partkey AS VARCHAR),
                     CAST(l.l_suppkey AS VARCHAR), CAST(l.l_linenumber AS VARCHAR),
                     CAST(CAST(l.l_quantity AS DECIMAL(18,2)) AS VARCHAR),
                     CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) AS VARCHAR),
                     CAST(CAST(l.l_shipdate AS DATE) AS VARCHAR))) AS tx_hash,
       'c' || CAST(o.o_custkey AS VARCHAR) AS from_address,
       's' || CAST(l.l_suppkey AS VARCHAR) AS to_address,
       CAST(CAST(round(l.l_extendedprice * 100) AS BIGINT) AS VARCHAR) AS value_raw,
       l.l_extendedprice AS value_decimal,
       CASE WHEN l.l_returnflag = 'N' THEN NULL ELSE '0xtoken' || lower(l.l_returnflag) END AS token_address,
       l.l_returnflag AS token_symbol,
       2 AS decimals,
       CASE WHEN l.l_linestatus = 'F' THEN 'transfer' ELSE 'swap' END AS event_type,
       l.l_shipdate + INTERVAL 30 SECOND AS ingested_at,
       l.l_suppkey AS _supp
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""

CTES["wallets"] = """
SELECT md5(wallet_address || '::' || chain) AS wallet_id, wallet_address, chain, owner_entity_id,
       wallet_type, is_exchange_wallet, is_mixer, is_sanctioned, is_mixer OR is_sanctioned AS is_high_risk,
       risk_score, label, CAST(NULL AS VARCHAR) AS cluster_id,
       CAST(NULL AS TIMESTAMP) AS first_seen_ts, CAST(NULL AS TIMESTAMP) AS last_seen_ts,
       TIMESTAMP '2000-01-01 00:00:00' AS created_at, TIMESTAMP '2000-01-01 00:00:00' AS updated_at,
       'SEED' AS source_system
FROM (
  SELECT 'c' || CAST(c_custkey AS VARCHAR) AS wallet_address, ch.chain,
         'ENT' || lpad(CAST(c_custkey AS VARCHAR), greatest(6, length(CAST(c_custkey AS VARCHAR)))::INTEGER, '0') AS owner_entity_id,
         'EOA' AS wallet_type, false AS is_exchange_wallet, false AS is_mixer, false AS is_sanctioned,
         CAST(NULL AS DOUBLE) AS risk_score, CAST(NULL AS VARCHAR) AS label
  FROM customer, (VALUES ('ethereum'), ('polygon')) ch(chain)
  UNION ALL
  SELECT 's' || CAST(s_suppkey AS VARCHAR), ch.chain, CAST(NULL AS VARCHAR),
         CASE WHEN s_suppkey % 3 = 0 THEN 'CONTRACT' ELSE 'EOA' END,
         s_suppkey % 11 = 0, s_suppkey % 5 = 2, s_suppkey % 7 = 3,
         CASE WHEN s_suppkey % 7 = 3 THEN 95.0 WHEN s_suppkey % 5 = 2 THEN 80.0 END,
         CASE WHEN s_suppkey % 5 = 2 THEN 'mixer-' || CAST(s_suppkey % 3 AS VARCHAR)
              WHEN s_suppkey % 7 = 3 THEN 'sdn-' || CAST(s_suppkey AS VARCHAR) END
  FROM supplier, (VALUES ('ethereum'), ('polygon')) ch(chain)
)
"""

CTES["transfers"] = """
SELECT t.event_id, t.chain, t.block_number, t.block_ts, t.tx_hash, t.from_address, t.to_address,
       t.value_raw, t.value_decimal, t.token_address, t.token_symbol, t.decimals, t.event_type,
       coalesce(wf.risk_score, wt.risk_score) AS risk_score,
       CASE WHEN wf.is_sanctioned OR wt.is_sanctioned THEN 'SANCTIONS'
            WHEN wf.is_mixer OR wt.is_mixer THEN 'MIXER' END AS risk_category,
       coalesce(wf.is_sanctioned, false) OR coalesce(wt.is_sanctioned, false) AS is_sanctioned_counterparty,
       t.ingested_at, 'X' || t.tx_hash AS raw_record_id
FROM transfers_p t
LEFT JOIN (SELECT * FROM wallets WHERE is_sanctioned OR is_mixer) wf
  ON t.from_address = wf.wallet_address AND t.chain = wf.chain
LEFT JOIN (SELECT * FROM wallets WHERE is_sanctioned OR is_mixer) wt
  ON t.to_address = wt.wallet_address AND t.chain = wt.chain
"""

CTES["entities"] = """
SELECT 'ENT' || lpad(CAST(c_custkey AS VARCHAR), greatest(6, length(CAST(c_custkey AS VARCHAR)))::INTEGER, '0') AS entity_id,
       c_name AS full_name,
       DATE '1950-01-01' + CAST(c_custkey % 18000 AS INTEGER) AS date_of_birth,
       CAST(c_nationkey AS VARCHAR) AS nationality,
       CAST(c_nationkey AS VARCHAR) AS country_of_residence,
       'user' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email,
       '+1 555 ' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'TIER_1' WHEN 'BUILDING' THEN 'TIER_2'
            WHEN 'FURNITURE' THEN 'TIER_3' WHEN 'HOUSEHOLD' THEN 'TIER_2'
            WHEN 'MACHINERY' THEN 'TIER_1' ELSE 'UNVERIFIED' END AS kyc_tier,
       CASE WHEN c_custkey % 97 = 0 THEN 'CRITICAL' WHEN c_acctbal < 0 THEN 'HIGH'
            WHEN c_acctbal < 1000 THEN 'MEDIUM' ELSE 'LOW' END AS aml_risk_rating,
       c_custkey % 50 = 0 AS pep_flag,
       c_custkey % 97 = 0 AS sanctions_flag,
       false AS adverse_media_flag,
       CASE WHEN c_nationkey % 3 = 0 THEN 'INSTITUTIONAL' ELSE 'INDIVIDUAL' END AS account_type,
       TIMESTAMP '2020-01-01 00:00:00' + c_custkey * INTERVAL 1 HOUR AS onboarded_at,
       'ACTIVE' AS status
FROM customer
"""

CTES["account_map"] = """
SELECT 'ACC' || lpad(CAST(c_custkey AS VARCHAR), greatest(6, length(CAST(c_custkey AS VARCHAR)))::INTEGER, '0') AS account_id,
       'ENT' || lpad(CAST(c_custkey AS VARCHAR), greatest(6, length(CAST(c_custkey AS VARCHAR)))::INTEGER, '0') AS entity_id
FROM customer
"""

CTES["alerts_store"] = """
SELECT CAST(event_id AS VARCHAR) AS alert_id,
       'ENT' || lpad(CAST(user_id AS VARCHAR), greatest(6, length(CAST(user_id AS VARCHAR)))::INTEGER, '0') AS entity_id,
       'W' || CAST(user_id AS VARCHAR) AS wallet_id,
       CASE event_type WHEN 'click' THEN 'WASH_TRADE' WHEN 'view' THEN 'PUMP_AND_DUMP'
            WHEN 'purchase' THEN 'STRUCTURING' WHEN 'signup' THEN 'CROSS_EXCHANGE_ARBITRAGE'
            WHEN 'error' THEN 'MIXER_EXPOSURE' ELSE 'WASH_TRADE' END AS alert_type,
       CASE event_id % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
       'event ' || event_type AS reason,
       round(value / 500, 4) AS ml_fraud_probability,
       CASE event_id % 3 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'IN_REVIEW' ELSE 'CLOSED' END AS status,
       CAST(NULL AS VARCHAR) AS case_id,
       ts AS detected_at,
       md5(CAST(event_id AS VARCHAR)) AS dedup_hash
FROM events
"""

CTES["cases_store"] = """
SELECT 'C' || CAST(o_orderkey AS VARCHAR) AS case_id,
       'CASE-' || strftime(o_orderdate, '%Y%m%d') || '-' || lpad(CAST(o_orderkey AS VARCHAR), greatest(5, length(CAST(o_orderkey AS VARCHAR)))::INTEGER, '0') AS case_ref,
       'ENT' || lpad(CAST(o_orderkey AS VARCHAR), greatest(6, length(CAST(o_orderkey AS VARCHAR)))::INTEGER, '0') AS entity_id,
       CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'P' THEN 'IN_REVIEW' WHEN 'F' THEN 'CLOSED' ELSE 'OPEN' END AS state,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH'
            WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS priority,
       'order ' || CAST(o_orderkey AS VARCHAR) AS title,
       round((o_orderkey % 100) / 100, 2) AS peak_ml_probability,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH'
            WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS composite_severity,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'analyst_' || CAST(o_orderkey % 5 AS VARCHAR) END AS assigned_to,
       o_orderdate + CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 24
                          WHEN '3-MEDIUM' THEN 72 ELSE 168 END * INTERVAL 1 HOUR AS due_by,
       o_orderkey % 7 = 0 AS sla_breached,
       CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'FALSE_POSITIVE' ELSE 'TRUE_POSITIVE' END END AS resolution_type,
       o_orderdate AS created_at,
       o_orderdate AS updated_at,
       CASE WHEN o_orderstatus = 'F' THEN o_orderdate + (o_orderkey % 200) * INTERVAL 1 HOUR END AS closed_at,
       'SEED' AS created_by
FROM orders
"""

_DEPS = {
    "orders_latest": ["orders_ev"],
    "transfers": ["transfers_p", "wallets"],
}


def with_(*names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """WITH clause holding ``names`` (and their dependencies, in order) plus ``extra``."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in _DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({CTES[n]})" for n in order]
    for n, body in extra or []:
        parts.append(f"{n} AS ({body})")
    return "WITH " + ",\n".join(parts) + "\n"
