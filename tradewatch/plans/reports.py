"""Risk and case reports (D30), each a grouped aggregate over the stores.

Single-row reports combine one global aggregate per table by a union and a max per
column (no join). The investigator views are set-wide: all cases at
once, with per-case top-k instead of one query per case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewatch.functions.risk import severity_rank
from tradewatch.functions.timefn import as_ts, boundary_diff, since, trunc
from tradewatch.operators.joins import HOT_COPIES, either_key_join
from tradewatch.operators.windows import top_k
from tradewatch.params import CLOSED_STATES, SEVERITIES
from tradewatch.session import checkpoint_dir


def _one_row(*frames: DataFrame) -> DataFrame:
    """Side-by-side columns of several one-row aggregates: union them (missing columns are
    NULL) and take the max per column. No join, so no cartesian product in the plan."""
    cols = [c for f in frames for c in f.columns]
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    return u.agg(*[F.max(c).alias(c) for c in cols])


def _count_if(c: Column) -> Column:
    return F.count_if(c).cast("long")


def kris(alerts: DataFrame, cases: DataFrame, entities: DataFrame, as_of: str) -> DataFrame:
    a = alerts.agg(
        _count_if(since("detected_at", as_of, 1, "day")).alias("alerts_24h"),
        _count_if(since("detected_at", as_of, 7, "day")).alias("alerts_7d"),
        _count_if((F.col("severity") == "CRITICAL") & since("detected_at", as_of, 1, "day")).alias("critical_alerts_24h"))
    c = cases.agg(
        _count_if(F.col("state") == "OPEN").alias("open_cases"),
        _count_if(F.col("state") == "IN_REVIEW").alias("cases_in_review"),
        _count_if(F.col("state") == "ESCALATED").alias("escalated_cases"),
        _count_if(F.col("sla_breached") == F.lit(True)).alias("sla_breached_cases"))
    e = entities.agg(
        _count_if(F.col("aml_risk_rating").isin("HIGH", "CRITICAL")).alias("high_risk_entities"),
        _count_if(F.col("sanctions_flag") == F.lit(True)).alias("sanctioned_entities"))
    return _one_row(a, c, e).select(F.to_date(as_ts(as_of)).alias("report_date"), "*")


def kpis(cases: DataFrame, as_of: str) -> DataFrame:
    return cases.agg(
        F.round(F.avg(F.when(F.col("resolution_type") == "FALSE_POSITIVE", F.lit(1.0)).otherwise(F.lit(0.0))), 4)
        .alias("false_positive_rate"),
        F.round(F.avg(boundary_diff("minute", F.col("created_at"), F.col("closed_at"))), 0).alias("avg_case_closure_minutes"),
        F.round(F.avg(F.when(F.col("sla_breached"), F.lit(0.0)).otherwise(F.lit(1.0))), 4).alias("sla_compliance_rate"),
        _count_if(since("closed_at", as_of, 7, "day")).alias("cases_closed_7d"),
        _count_if(since("created_at", as_of, 7, "day")).alias("cases_opened_7d"),
    ).select(F.to_date(as_ts(as_of)).alias("report_date"), "*")


def alert_volume(alerts: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    a = alerts.filter(since("detected_at", as_of, days, "day"))
    return a.groupBy(trunc("hour", "detected_at").alias("alert_hour"), "alert_type", "severity").agg(
        F.count(F.lit(1)).alias("alert_count"),
        F.count_distinct("entity_id").alias("unique_entities"),
        F.avg("ml_fraud_probability").alias("avg_ml_score"),
        _count_if(F.col("status") == "OPEN").alias("open_count"),
        _count_if(F.col("status") == "CLOSED").alias("closed_count"))


def entity_heatmap(entities: DataFrame, scores: DataFrame, features: DataFrame, alerts: DataFrame) -> DataFrame:
    """Entity attributes, score and alert counts; alerts are aggregated per entity before
    the joins (no fan-out, no group-by over twelve keys)."""
    per = alerts.groupBy("entity_id").agg(
        F.count("alert_id").alias("total_alerts"),
        _count_if(F.col("severity") == "CRITICAL").alias("critical_alerts"),
        _count_if(F.col("severity") == "HIGH").alias("high_alerts"),
        F.max("detected_at").alias("last_alert_ts"))
    e = entities.select("entity_id", "aml_risk_rating", "kyc_tier", "account_type", "pep_flag", "sanctions_flag")
    s = scores.select("entity_id", "ml_fraud_probability", "rule_risk_tier")
    f = features.select("entity_id", "cex_volume_usd_30d", "mixer_interactions_30d", "sanctioned_volume_30d", "wallet_count")
    j = e.join(s, "entity_id", "left").join(f, "entity_id", "left").join(per, "entity_id", "left")
    return j.select(
        "entity_id", "aml_risk_rating", "kyc_tier", "account_type", "pep_flag", "sanctions_flag",
        "ml_fraud_probability", "rule_risk_tier", "cex_volume_usd_30d", "mixer_interactions_30d",
        "sanctioned_volume_30d", "wallet_count",
        F.coalesce(F.col("total_alerts"), F.lit(0)).cast("long").alias("total_alerts"),
        F.coalesce(F.col("critical_alerts"), F.lit(0)).cast("long").alias("critical_alerts"),
        F.coalesce(F.col("high_alerts"), F.lit(0)).cast("long").alias("high_alerts"),
        "last_alert_ts")


def case_sla(cases: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    c = cases.filter(since("created_at", as_of, days, "day"))
    end = F.coalesce(F.col("closed_at"), as_ts(as_of))
    return c.groupBy(F.to_date("created_at").alias("case_date"), "priority", "state").agg(
        F.count(F.lit(1)).alias("case_count"),
        _count_if(F.col("sla_breached") == F.lit(True)).alias("breached_count"),
        F.round(F.avg(boundary_diff("hour", F.col("created_at"), end)), 1).alias("avg_resolution_hours"),
        F.round(F.avg("peak_ml_probability"), 4).alias("avg_ml_score"))


def trading_summary(trades: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    t = trades.filter(since("trade_ts", as_of, days, "day"))
    return t.groupBy(trunc("day", "trade_date").alias("trade_day"), "trading_pair", "venue").agg(
        F.count(F.lit(1)).alias("trade_count"), F.sum("quote_qty").alias("volume_usd"),
        F.avg("price").alias("avg_price"), F.max("price").alias("high_price"), F.min("price").alias("low_price"),
        F.count_distinct("account_id").alias("unique_traders"))


def onchain_flows(transfers: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    t = transfers.filter(since("block_ts", as_of, days, "day"))
    return t.groupBy(F.to_date("block_ts").alias("flow_date"), "chain", "token_symbol", "event_type").agg(
        F.count(F.lit(1)).alias("tx_count"), F.sum("value_decimal").alias("total_value"),
        F.count_distinct("from_address").alias("unique_senders"),
        F.count_distinct("to_address").alias("unique_receivers"),
        _count_if(F.col("is_sanctioned_counterparty")).alias("sanctioned_tx_count"))


def kri_cards(alerts: DataFrame, cases: DataFrame, as_of: str) -> DataFrame:
    a = alerts.agg(
        _count_if(since("detected_at", as_of, 1, "day")).alias("alerts_24h"),
        _count_if((F.col("severity") == "CRITICAL") & since("detected_at", as_of, 1, "day")).alias("critical_24h"),
        _count_if(F.col("status") == "OPEN").alias("open_alerts"),
        _count_if(F.col("status") == "IN_REVIEW").alias("in_review_alerts"))
    c = cases.agg(
        _count_if(F.col("state") == "OPEN").alias("open_cases"),
        _count_if((F.col("sla_breached") == F.lit(True)) & ~F.col("state").isin(*CLOSED_STATES)).alias("sla_breached"),
        _count_if(F.col("state") == "ESCALATED").alias("escalated"))
    return _one_row(a, c)


def case_queue(cases: DataFrame, entities: DataFrame, priority: str | None = None, state: str | None = None,
               limit: int = 200) -> DataFrame:
    """Work queue: optional filters, priority rank then newest first, first ``limit`` rows
    (a top-k report: Spark plans TakeOrderedAndProject, a bounded heap per task)."""
    c = cases
    if priority:
        c = c.filter(F.col("priority") == priority)
    if state:
        c = c.filter(F.col("state") == state)
    e = entities.select("entity_id", "aml_risk_rating", "kyc_tier", "pep_flag", "sanctions_flag")
    j = c.select("case_id", "case_ref", "entity_id", "state", "priority", "title", "peak_ml_probability",
                 "composite_severity", "sla_breached", "assigned_to", "created_at", "due_by").join(e, "entity_id", "left")
    return j.orderBy(severity_rank(F.col("priority")), F.col("created_at").desc(), F.col("case_id")).limit(limit)


def case_detail_trades(cases: DataFrame, trades: DataFrame, as_of: str, account_map: DataFrame | None = None,
                       days: int = 7, limit: int = 100) -> DataFrame:
    """The most recent ``limit`` trades of each case's entity in the last ``days``."""
    c = cases.select("case_id", "entity_id")
    if account_map is not None:
        c = c.join(account_map, on="entity_id", how="inner")
    else:
        c = c.withColumn("account_id", F.col("entity_id"))
    t = trades.filter(since("trade_ts", as_of, days, "day")).select(
        "account_id", "trade_id", "trading_pair", "side", "price", "quantity", "quote_qty", "venue", "trade_ts")
    j = c.join(t, on="account_id", how="inner")
    top = top_k(j, ["case_id"], [F.col("trade_ts").desc(), F.col("trade_id").desc()], limit, salt_col="trade_id",
                rank_col="row_rank")
    return top.select("case_id", "row_rank", "trade_id", "trading_pair", "side", "price", "quantity",
                      "quote_qty", "venue", "trade_ts")


def case_detail_transfers(cases: DataFrame, transfers: DataFrame, wallets: DataFrame, as_of: str,
                          days: int = 30, limit: int = 50) -> DataFrame:
    """The most recent ``limit`` transfers touching any wallet of each case's entity."""
    c = cases.select("case_id", F.col("entity_id").alias("owner_entity_id"))
    w = wallets.filter(F.col("owner_entity_id").isNotNull()).select(
        F.col("wallet_address").alias("_w"), "chain", "owner_entity_id").join(c, on="owner_entity_id", how="inner")
    t = transfers.filter(since("block_ts", as_of, days, "day")).select(
        "tx_hash", "chain", "event_type", "value_decimal", "token_symbol", "from_address", "to_address", "block_ts")
    j = either_key_join(t, w, ["from_address", "to_address"], "_w", on_also=["chain"], hot_copies=HOT_COPIES)
    top = top_k(j, ["case_id"], [F.col("block_ts").desc(), F.col("tx_hash").desc()], limit, salt_col="tx_hash",
                rank_col="row_rank")
    return top.select("case_id", "row_rank", "tx_hash", "chain", "event_type", "value_decimal", "token_symbol",
                      "from_address", "to_address", "block_ts")


def alert_pivot(alerts: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Alert counts by type x severity (one column per severity, zeros filled)."""
    a = alerts.filter(since("detected_at", as_of, days, "day"))
    return a.groupBy("alert_type").pivot("severity", SEVERITIES).count().na.fill(0)


def daily_alert_pivot(alerts: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    a = alerts.filter(since("detected_at", as_of, days, "day"))
    return (a.groupBy(F.to_date("detected_at").alias("alert_date")).pivot("severity", SEVERITIES).count()
            .na.fill(0))


def alert_breakdown(alerts: DataFrame) -> DataFrame:
    return (alerts.groupBy("alert_type", "severity").agg(
        F.count(F.lit(1)).alias("alert_count"), F.round(F.avg("ml_fraud_probability"), 4).alias("avg_score"))
        .orderBy(F.col("alert_count").desc(), "alert_type", "severity"))


def distinct_keys_stored(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row (row_count, distinct_keys) of a written table, which is read twice: hashes of the keys are counted first,
    and only rows whose hash occurs twice or more are compared by the keys themselves, so that wide keys are not shuffled."""
    src = df.select(*keys, F.xxhash64(*keys).alias("_key"))
    path = checkpoint_dir(df.sparkSession, "key-counts")
    src.groupBy("_key").count().groupBy(F.when(F.col("count") > 1, F.col("_key")).alias("_key")).agg(
        F.sum("count").alias("n")).write.parquet(path)  # rows of each repeated hash; of all others together (NULL)
    counts = df.sparkSession.read.schema("_key long, n long").parquet(path)
    again = src.join(counts.filter("_key IS NOT NULL"), "_key", "left_semi").agg(F.count_distinct(F.struct(*keys)).alias("again"))
    once = F.coalesce(F.sum(F.when(F.col("_key").isNull(), F.col("n"))), F.lit(0))
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), once.alias("once"))
    return _one_row(totals, again).select("row_count", (F.col("once") + F.col("again")).alias("distinct_keys"))


def health_check(tables: dict[str, tuple[DataFrame, list[str], int]], stored: tuple[str, ...] = ()) -> DataFrame:
    """Row count, duplicate keys and minimum-row check per table.
    ``tables[name] = (frame, key columns, minimum rows)``; one aggregate per table. ``stored``: written tables
    with wide keys."""
    parts = []
    for name, (df, keys, minimum) in tables.items():
        k = F.struct(*[F.col(x) for x in keys]) if keys else F.lit(1)
        agg = distinct_keys_stored(df, keys) if name in stored else df.agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct(k).alias("distinct_keys"))
        parts.append(agg.select(
            F.lit(name).alias("table_name"), "row_count",
            (F.col("row_count") - F.col("distinct_keys")).alias("duplicate_keys"),
            F.lit(minimum).cast("long").alias("min_expected"),
            ((F.col("row_count") >= minimum) & (F.col("row_count") == F.col("distinct_keys"))).alias("ok")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def case_daily_volume(detail_trades: DataFrame) -> DataFrame:
    """Daily traded volume of each case's recent trades (the case detail chart)."""
    return detail_trades.groupBy("case_id", F.to_date("trade_ts").alias("trade_day")).agg(
        F.sum("quote_qty").alias("volume_usd"), F.count(F.lit(1)).alias("trade_count"))


def next_case_for_narrative(cases: DataFrame) -> DataFrame:
    """The open case without a narrative to prepare first: highest priority, oldest first."""
    c = cases.filter((F.col("state") == "OPEN") & F.col("sar_narrative").isNull())
    return c.orderBy(severity_rank(F.col("priority")), F.col("created_at"), F.col("case_id")).limit(1).select(
        "case_id", "case_ref", "entity_id", "priority", "created_at")


def case_detail_header(cases: DataFrame, entities: DataFrame) -> DataFrame:
    """Every case with what is known of its entity (NULL where the entity is unknown)."""
    e = entities.select("entity_id", "full_name", "email", "account_type", "kyc_tier", "aml_risk_rating", "pep_flag",
                        "sanctions_flag", "onboarded_at")
    c = cases.select("case_id", "case_ref", "entity_id", "state", "priority", "title", "summary", "sar_narrative",
                     "peak_ml_probability", "assigned_to", "due_by", "sla_breached", "resolution_type", "created_at", "closed_at")
    return c.join(e, on="entity_id", how="left")


def case_detail_alerts(cases: DataFrame, alerts: DataFrame) -> DataFrame:
    """All alerts linked to each case; ``severity_order`` and the time order them for display."""
    a = alerts.filter(F.col("case_id").isNotNull()).select(
        "case_id", "alert_id", "alert_type", "severity", severity_rank(F.col("severity")).alias("severity_order"), "reason",
        "detected_at", "status", "ml_fraud_probability")
    return a.join(cases.select("case_id"), on="case_id", how="left_semi")


def case_detail_events(events: DataFrame, limit: int = 20) -> DataFrame:
    """The ``limit`` most recent audit events of every case, their data as JSON text."""
    top = top_k(events, ["case_id"], [F.col("event_ts").desc(), F.col("event_id").desc()], limit,
                salt_col="event_id", rank_col="row_rank")
    return top.select("case_id", "row_rank", "event_id", "event_type", F.to_json("event_data").alias("event_data"),
                      "performed_by", "event_ts")
