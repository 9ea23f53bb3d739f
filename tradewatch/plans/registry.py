"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator of the blueprint.

Every query derives its domain tables from the driver tables in ``sf_dir`` (see
``tradewatch.sources.adapters``) and runs over them whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tradewatch.plans import harmonise as H
from tradewatch.plans import rules as R
from tradewatch.plans.inputs import Inputs
from tradewatch.plans.present import finish
from tradewatch.functions.timefn import shift, since
from tradewatch.params import DEFAULT_FEATURES, DEFAULT_RULES, WIDE_RULES
from tradewatch.sources import adapters as A
from tradewatch.sources import raw as RAW
from tradewatch.session import cut_lineage, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return finish(fn(Inputs(spark, sf_dir)))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


T_AS_OF = A.TRADES_AS_OF
C_AS_OF = A.ONCHAIN_AS_OF


# ------------------------------------------------------------------ ingest / harmonise


@query("harmonise_trades")
def _harmonise_trades(i: Inputs) -> DataFrame:
    """Raw trade envelopes -> typed trades, one row per trade_id."""
    return H.harmonise_trades(H.parse_trades(A.trades_raw(i.events)))


@query("dlq_split")
def _dlq(i: Inputs) -> DataFrame:
    """Dead letters of the trade feed (payload text is not JSON)."""
    return RAW.dead_letters(A.trades_raw(i.events), "CEX_TRADES_RAW", RAW.TRADE_PAYLOAD)


@query("harmonise_orders_latest")
def _orders_latest(i: Inputs) -> DataFrame:
    return H.harmonise_orders(H.parse_orders(A.orders_raw(i.events)))


@query("harmonise_balances_latest")
def _balances_latest(i: Inputs) -> DataFrame:
    return H.harmonise_balances(H.parse_balances(A.balances_raw(i.events)))


@query("harmonise_transfers")
def _transfers(i: Inputs) -> DataFrame:
    raw = A.onchain_raw(i.table("lineitem"), i.table("orders"))
    return H.harmonise_transfers(H.parse_onchain(raw), i.wallets)


@query("discover_wallets")
def _discover(i: Inputs) -> DataFrame:
    return H.discover_wallets(i.transfers)


@query("sync_wallets")
def _sync(i: Inputs) -> DataFrame:
    return H.sync_wallets(i.wallets, H.discover_wallets(i.transfers), C_AS_OF)


# ------------------------------------------------------------------ rules


@query("rule_structuring")
def _structuring(i: Inputs) -> DataFrame:
    return R.structuring(i.trades, T_AS_OF, DEFAULT_RULES)


@query("rule_structuring_wide")
def _structuring_wide(i: Inputs) -> DataFrame:
    return R.structuring(i.trades, T_AS_OF, WIDE_RULES)


@query("rule_cross_venue")
def _cross_venue(i: Inputs) -> DataFrame:
    return R.cross_venue(i.trades, T_AS_OF, DEFAULT_RULES)


@query("rule_cross_venue_wide")
def _cross_venue_wide(i: Inputs) -> DataFrame:
    return R.cross_venue(i.trades, T_AS_OF, WIDE_RULES)


@query("rule_wash_trades")
def _wash(i: Inputs) -> DataFrame:
    return R.wash_trades(i.trades, T_AS_OF, DEFAULT_RULES)


@query("rule_wash_trades_wide")
def _wash_wide(i: Inputs) -> DataFrame:
    return R.wash_trades(i.trades, T_AS_OF, WIDE_RULES)


@query("rule_pump_dump")
def _pump(i: Inputs) -> DataFrame:
    return R.pump_dump(i.trades, None, T_AS_OF, DEFAULT_RULES)


@query("rule_pump_dump_wide")
def _pump_wide(i: Inputs) -> DataFrame:
    return R.pump_dump(i.trades, None, T_AS_OF, WIDE_RULES)


@query("rule_sanctioned")
def _sanctioned(i: Inputs) -> DataFrame:
    return R.sanctioned(i.transfers, i.wallets, C_AS_OF, DEFAULT_RULES)


@query("rule_mixer")
def _mixer(i: Inputs) -> DataFrame:
    return R.mixer(i.transfers, i.wallets, C_AS_OF, DEFAULT_RULES)


# ------------------------------------------------------------------ trade features

from tradewatch.plans import features as FE  # noqa: E402
from tradewatch.plans import scoring as SC  # noqa: E402


@query("trade_rolling_1h")
def _roll_1h(i: Inputs) -> DataFrame:
    pw = FE.pair_windows(FE.base_trades(i.trades, T_AS_OF), frames=("1h",))
    return pw.select("trade_id", "trade_count_1h", "volume_usd_1h", "avg_price_1h", "price_stddev_1h",
                     "buy_vol_1h", "sell_vol_1h")


@query("trade_rolling_4h")
def _roll_4h(i: Inputs) -> DataFrame:
    pw = FE.pair_windows(FE.base_trades(i.trades, T_AS_OF), frames=("4h",))
    return pw.select("trade_id", "trade_count_4h", "volume_usd_4h", "avg_price_4h", "price_stddev_4h")


@query("trade_rolling_24h")
def _roll_24h(i: Inputs) -> DataFrame:
    pw = FE.pair_windows(FE.base_trades(i.trades, T_AS_OF), frames=("24h",))
    return pw.select("trade_id", "trade_count_24h", "volume_usd_24h", "avg_price_24h", "price_max_24h",
                     "price_min_24h", "buy_vol_24h", "sell_vol_24h", "maker_count_24h")


@query("trade_rolling_7d")
def _roll_7d(i: Inputs) -> DataFrame:
    aw = FE.account_windows(FE.base_trades(i.trades, T_AS_OF))
    return aw.select("trade_id", "trade_count_7d", "volume_usd_7d", "avg_trade_size_7d", "trade_size_stddev_7d")


def _layers(i: Inputs, name: str, above: bool):
    """The trades of the features' look-back as they would arrive (``A.arrival_batch``: some come days late), with a
    refresh of the rolling layer, and of the layer ``above`` it, after each batch."""
    from tradewatch.operators.logstore import LogStore
    from tradewatch.session import checkpoint_dir
    path = checkpoint_dir(i.spark, name)
    trades = LogStore(i.spark, f"{path}/trades", FE.base_trades(i.trades, T_AS_OF).schema, ["trade_id"], day="trade_ts")
    rolling = FE.rolling_layer(trades, f"{path}/rolling")
    days = FE.account_day_layer(rolling, f"{path}/account_days")
    events = i.events.filter(since("ts", T_AS_OF, DEFAULT_FEATURES.base_days, "day")).withColumn("_b", A.arrival_batch(15))
    for b in [r["_b"] for r in events.select("_b").distinct().orderBy("_b").collect()]:
        trades.append(FE.base_trades(A.trades(events.filter(F.col("_b") == b)), T_AS_OF), b)
        rolling.refresh(b)
        if above:
            days.refresh(b)
    return days if above else rolling


@query("trade_rolling_refreshed")
def _rolling_refreshed(i: Inputs) -> DataFrame:
    """Rolling features after refreshes of the touched slices only."""
    return _layers(i, "rolling_layer", above=False).read().select("trade_id", "trade_count_24h", "volume_usd_24h", "price_max_24h", "price_min_24h",
                                                                 "trade_count_7d", "volume_usd_7d", "avg_trade_size_7d", "unique_pairs_24h_true")


@query("account_days_refreshed")
def _account_days_refreshed(i: Inputs) -> DataFrame:
    """The layer above the rolling features, refreshed from what each refresh of theirs changed."""
    return _layers(i, "account_day_layer", above=True).read()


@query("trade_ratios")
def _ratios(i: Inputs) -> DataFrame:
    base = FE.base_trades(i.trades, T_AS_OF)
    pw = FE.pair_windows(base, frames=("1h", "24h"))
    aw = FE.account_windows(base).select("trade_id", "volume_usd_7d")
    r = FE.ratios(pw.join(aw, on="trade_id", how="inner"))
    return r.select("trade_id", "buy_sell_ratio_1h", "buy_sell_ratio_24h", "price_range_pct_24h",
                    "volume_spike_ratio_1h", "maker_ratio_24h")


@query("trade_distinct_24h")
def _distinct_24h(i: Inputs) -> DataFrame:
    """True 24-hour distinct pairs and venues per account, at every trade."""
    aw = FE.account_windows(FE.base_trades(i.trades, T_AS_OF))
    return aw.select("trade_id", F.col("unique_pairs_24h_true").cast("long").alias("unique_pairs_24h_true"),
                     F.col("unique_venues_24h_true").cast("long").alias("unique_venues_24h_true"))


@query("venue_distinct")
def _venues(i: Inputs) -> DataFrame:
    return FE.venue_distinct(FE.base_trades(i.trades, T_AS_OF))


@query("wash_signal")
def _wash_signal(i: Inputs) -> DataFrame:
    return FE.wash_signal(i.trades, T_AS_OF)


@query("cancelled_orders_1h")
def _cancel_signal(i: Inputs) -> DataFrame:
    return FE.cancel_signal(i.trades, i.orders, T_AS_OF)


@query("trade_features")
def _trade_features(i: Inputs) -> DataFrame:
    """Flagship: every rolling feature of every trade of the last 30 days."""
    return FE.trade_features(i.trades, i.orders, T_AS_OF)


# ------------------------------------------------------------------ entity features and scores


def entity_features(i: Inputs) -> DataFrame:
    return FE.entity_features(i.entities, i.trades, i.transfers, i.wallets, T_AS_OF,
                              account_map=i.account_map, onchain_as_of=C_AS_OF)


@query("entity_onchain_stats")
def _onchain_stats(i: Inputs) -> DataFrame:
    return FE.onchain_stats(i.transfers, i.wallets, C_AS_OF)


@query("entity_cex_stats")
def _cex_stats(i: Inputs) -> DataFrame:
    return FE.cex_stats(i.trades, T_AS_OF, i.account_map)


@query("entity_burst")
def _burst(i: Inputs) -> DataFrame:
    return FE.burst_stats(i.trades, T_AS_OF, i.account_map)


@query("entity_features")
def _entity_features(i: Inputs) -> DataFrame:
    return entity_features(i)


@query("rule_score")
def _rule_score(i: Inputs) -> DataFrame:
    ef = entity_features(i)
    return ef.select("entity_id", SC.score_column(ef).alias("ml_fraud_probability"))


@query("alert_scores")
def _alert_scores(i: Inputs) -> DataFrame:
    return SC.alert_scores(entity_features(i), T_AS_OF)


@query("ml_score")
def _ml_score(i: Inputs) -> DataFrame:
    """Model-backed probability (rows-only check): GBT fitted on rule-derived labels. Labels, training and
    scoring read the features many times, so they are computed once and kept."""
    ef = cut_lineage(entity_features(i))
    model = SC.train_score_model(ef, SC.rule_labels(ef))
    return SC.apply_score_model(model, ef)


# ------------------------------------------------------------------ alerts

from pyspark.sql import functions as F  # noqa: E402

from tradewatch.plans import alerts as AL  # noqa: E402
from tradewatch.plans import cases as CA  # noqa: E402
from tradewatch.plans import context as CX  # noqa: E402
from tradewatch.plans import governance as GV  # noqa: E402


def rule_outputs(i: Inputs, pin: bool = False) -> dict[str, DataFrame]:
    """The six rules (widened trade parameters so the synthetic trades produce hits).
    ``pin`` checkpoints each output, for callers that use them more than once."""
    out = {
        "pump": R.pump_dump(i.trades, None, T_AS_OF, WIDE_RULES),
        "wash": R.wash_trades(i.trades, T_AS_OF, WIDE_RULES),
        "sanctioned": R.sanctioned(i.transfers, i.wallets, C_AS_OF),
        "cross": R.cross_venue(i.trades, T_AS_OF, WIDE_RULES),
        "structuring": R.structuring(i.trades, T_AS_OF, WIDE_RULES),
        "mixer": R.mixer(i.transfers, i.wallets, C_AS_OF),
    }
    if pin:
        from tradewatch.session import cut_lineage
        out = {k: cut_lineage(v) for k, v in out.items()}
    return out


def alert_candidates(i: Inputs, shift_hours: int = 0, rules: dict[str, DataFrame] | None = None,
                     scores: DataFrame | None = None) -> DataFrame:
    """Rule outputs shaped, resolved to entities and scored. ``shift_hours`` moves the
    detection time (a later run detecting the same patterns)."""
    def later(df: DataFrame) -> DataFrame:
        if not shift_hours:
            return df
        return df.withColumn("detected_at", F.timestamp_add("HOUR", F.lit(shift_hours), F.col("detected_at")))

    rules = rules or rule_outputs(i)
    shaped = AL.shape_rules(**{k: later(v) for k, v in rules.items()})
    if scores is None:
        scores = SC.alert_scores(entity_features(i), T_AS_OF)
    return AL.to_alerts(shaped, scores, i.account_map)


def present_alerts(a: DataFrame) -> DataFrame:
    return a.select(
        *[c for c in AL.ALERT_COLUMNS if c not in ("rule_flags", "trade_ids", "tx_hashes")],
        F.array_join(F.map_keys("rule_flags"), ",").alias("rule_flag"),
        F.array_join("trade_ids", ",").alias("trade_ids"),
        F.array_join("tx_hashes", ",").alias("tx_hashes"),
    )


@query("alerts_unified")
def _alerts_unified(i: Inputs) -> DataFrame:
    """First refresh into an empty store: one alert per hash, scores and tiers attached."""
    store = AL.empty_store(i.spark)
    return present_alerts(AL.refresh_alerts(store, alert_candidates(i)))


@query("refresh_alerts_second_run")
def _alerts_second(i: Inputs) -> DataFrame:
    """Second refresh one hour later against the first run's store: only hashes outside
    their rule's look-back come back (pump alerts hash the detection hour)."""
    from tradewatch.session import cut_lineage
    rules = rule_outputs(i, pin=True)
    scores = cut_lineage(SC.alert_scores(entity_features(i), T_AS_OF))
    store = AL.refresh_alerts(AL.empty_store(i.spark), alert_candidates(i, rules=rules, scores=scores))
    return present_alerts(AL.refresh_alerts(store, alert_candidates(i, 1, rules=rules, scores=scores)))


# ------------------------------------------------------------------ cases


def present_cases(c: DataFrame) -> DataFrame:
    return (c.withColumn("root_alert_ids", F.array_join("root_alert_ids", ","))
            .withColumn("alert_types", F.array_join("alert_types", ",")))


def new_cases(i: Inputs):
    return CA.create_cases(i.alerts_store, i.cases_store, T_AS_OF)


@query("create_cases")
def _create_cases(i: Inputs) -> DataFrame:
    cases, _ = new_cases(i)
    return present_cases(cases)


@query("alerts_linked")
def _alerts_linked(i: Inputs) -> DataFrame:
    _, linked = new_cases(i)
    return linked


@query("sla_breaches")
def _sla(i: Inputs) -> DataFrame:
    _, events = CA.check_sla(i.cases_store, C_AS_OF)
    return events.select("event_id", "case_id", "event_type",
                         F.col("event_data")["due_by"].alias("due_by"),
                         F.col("event_data")["breached_at"].alias("breached_at"),
                         F.col("event_data")["priority"].alias("priority"),
                         "performed_by", "event_ts")


def acted(i: Inputs):
    return CA.apply_actions(i.cases_store, i.alerts_store, A.case_actions(i.table("orders")))


@query("apply_actions")
def _apply_actions(i: Inputs) -> DataFrame:
    cases, _, _ = acted(i)
    return present_cases(cases)


@query("case_events_actions")
def _action_events(i: Inputs) -> DataFrame:
    _, _, events = acted(i)
    return events.select("event_id", "case_id", "event_type",
                         F.coalesce(F.col("event_data")["new_state"], F.col("event_data")["narrative_chars"]).alias("event_value"),
                         "performed_by", "event_ts")


@query("snapshot_diff")
def _snapshot_diff(i: Inputs) -> DataFrame:
    from tradewatch.operators.state import snapshot_diff
    before = CA._with_case_defaults(i.cases_store)
    after, _, _ = acted(i)
    return present_cases(snapshot_diff(before, after, ["case_id"]))


# ------------------------------------------------------------------ governance


@query("mask_admin")
def _mask_admin(i: Inputs) -> DataFrame:
    return GV.mask(i.entities, "SURVEILLANCE_ADMIN")


@query("mask_analyst")
def _mask_analyst(i: Inputs) -> DataFrame:
    return GV.mask(i.entities, "SURVEILLANCE_ANALYST")


@query("mask_other")
def _mask_other(i: Inputs) -> DataFrame:
    return GV.mask(i.entities, "SURVEILLANCE_ML")


@query("scope_cases")
def _scope(i: Inputs) -> DataFrame:
    return GV.scope_cases(i.cases_store, "SURVEILLANCE_AUDITOR", "analyst_1")


# ------------------------------------------------------------------ context / prompt


def contexts(i: Inputs) -> DataFrame:
    cases, linked = new_cases(i)
    return CX.case_context(cases, i.entities, entity_features(i), linked)


@query("case_context")
def _case_context(i: Inputs) -> DataFrame:
    ctx = contexts(i)
    recent = F.array_join(F.transform(F.col("recent_alerts"), lambda a: F.concat_ws(
        "|", a["severity"], a["alert_type"], F.date_format(a["detected_at"], "yyyy-MM-dd HH:mm:ss"))), ";")
    return (ctx.withColumn("alert_types", F.array_join("alert_types", ","))
            .withColumn("recent_alerts", recent))


@query("case_prompt")
def _case_prompt(i: Inputs) -> DataFrame:
    return CX.case_prompt(contexts(i))


# ------------------------------------------------------------------ prices and labels

from tradewatch.plans import prices as PX  # noqa: E402
from tradewatch.plans import reports as RP  # noqa: E402


@query("synthetic_prices")
def _synthetic_prices(i: Inputs) -> DataFrame:
    return PX.synthetic_prices(i.trades, T_AS_OF)


@query("pivot_prices")
def _pivot_prices(i: Inputs) -> DataFrame:
    return PX.pivot_prices(PX.eav_from_trades(i.trades, T_AS_OF))


@query("fx_rates")
def _fx(i: Inputs) -> DataFrame:
    return PX.fx_rates(PX.fx_from_lineitem(i.table("lineitem")))


def market_prices(i: Inputs) -> DataFrame:
    return PX.market_prices(PX.pivot_prices(PX.eav_from_trades(i.trades, T_AS_OF)),
                            PX.synthetic_prices(i.trades, T_AS_OF))


@query("market_prices")
def _market_prices(i: Inputs) -> DataFrame:
    return market_prices(i)


@query("wallet_labels")
def _wallet_labels(i: Inputs) -> DataFrame:
    return PX.wallet_labels(i.wallets)


@query("rule_pump_dump_priced")
def _pump_priced(i: Inputs) -> DataFrame:
    """Widened pump rule with the reference price of the pair's base asset ('-' separator)."""
    from dataclasses import replace
    return R.pump_dump(i.trades, market_prices(i), T_AS_OF, replace(WIDE_RULES, price_pair_separator="-"))


# ------------------------------------------------------------------ reports


@query("kris")
def _kris(i: Inputs) -> DataFrame:
    return RP.kris(i.alerts_store, i.cases_store, i.entities, T_AS_OF)


@query("kpis")
def _kpis(i: Inputs) -> DataFrame:
    return RP.kpis(i.cases_store, C_AS_OF)


@query("alert_volume")
def _alert_volume(i: Inputs) -> DataFrame:
    return RP.alert_volume(i.alerts_store, T_AS_OF)


@query("entity_heatmap")
def _heatmap(i: Inputs) -> DataFrame:
    ef = entity_features(i)
    return RP.entity_heatmap(i.entities, SC.alert_scores(ef, T_AS_OF), ef, i.alerts_store)


@query("case_sla")
def _case_sla(i: Inputs) -> DataFrame:
    return RP.case_sla(i.cases_store, C_AS_OF)


@query("trading_summary")
def _trading_summary(i: Inputs) -> DataFrame:
    return RP.trading_summary(i.trades, T_AS_OF)


@query("onchain_flows")
def _onchain_flows(i: Inputs) -> DataFrame:
    return RP.onchain_flows(i.transfers, C_AS_OF)


@query("kri_cards")
def _kri_cards(i: Inputs) -> DataFrame:
    return RP.kri_cards(i.alerts_store, i.cases_store, T_AS_OF)


@query("case_queue")
def _case_queue(i: Inputs) -> DataFrame:
    return RP.case_queue(i.cases_store, i.entities)


@query("case_queue_filtered")
def _case_queue_filtered(i: Inputs) -> DataFrame:
    return RP.case_queue(i.cases_store, i.entities, priority="HIGH", state="OPEN")


@query("case_detail_trades")
def _case_trades(i: Inputs) -> DataFrame:
    cases, _ = new_cases(i)
    return RP.case_detail_trades(cases, i.trades, T_AS_OF, i.account_map)


@query("case_detail_transfers")
def _case_transfers(i: Inputs) -> DataFrame:
    cases, _ = new_cases(i)
    return RP.case_detail_transfers(cases, i.transfers, i.wallets, C_AS_OF)


@query("alert_pivot")
def _alert_pivot(i: Inputs) -> DataFrame:
    return RP.alert_pivot(i.alerts_store, T_AS_OF)


@query("daily_alert_pivot")
def _daily_pivot(i: Inputs) -> DataFrame:
    return RP.daily_alert_pivot(i.alerts_store, T_AS_OF)


@query("alert_breakdown")
def _breakdown(i: Inputs) -> DataFrame:
    """Breakdown of the pipeline's own alerts (first refresh) by type and severity."""
    return RP.alert_breakdown(AL.refresh_alerts(AL.empty_store(i.spark), alert_candidates(i)))


@query("health_check")
def _health(i: Inputs) -> DataFrame:
    return RP.health_check({
        "trades": (i.trades, ["trade_id"], 1),
        "orders": (i.orders, ["order_id"], 1),
        "transfers": (i.transfers, ["chain", "tx_hash", "event_id"], 1),
        "wallets": (i.wallets, ["wallet_id"], 1),
        "entities": (i.entities, ["entity_id"], 1),
        "alerts": (i.alerts_store, ["alert_id"], 50),
        "cases": (i.cases_store, ["case_id"], 5),
    })


# ------------------------------------------------------------------ streaming forms

from tradewatch.streaming import feeds as ST  # noqa: E402


def _stream_trades(i: Inputs) -> DataFrame:
    return A.trades(ST.table_stream(i.spark, i.sf_dir, "events"))


def _run(df: DataFrame, name: str) -> DataFrame:
    out, _ = ST.run_to_parquet(df, name)
    return ST.ntz(ST.read_output(df.sparkSession, out, df.schema))


@query("stream_dlq_split")
def _stream_dlq(i: Inputs) -> DataFrame:
    """Dead letters split off a live trade feed by foreachBatch."""
    raw = A.trades_raw(ST.table_stream(i.spark, i.sf_dir, "events"))
    _, bad = ST.split_batches(raw, "CEX_TRADES_RAW", "stream_dlq")
    schema = RAW.dead_letters(A.trades_raw(i.events), "CEX_TRADES_RAW", RAW.TRADE_PAYLOAD).schema
    return ST.read_output(i.spark, bad, schema)


@query("stream_dedup")
def _stream_dedup(i: Inputs) -> DataFrame:
    """Replayed trade records removed within a 1-hour watermark on ingest time."""
    raw = A.trades_raw(ST.table_stream(i.spark, i.sf_dir, "events"))
    parsed = H.parse_trades(raw).filter(F.col("trade_id").isNotNull() & F.col("account_id").isNotNull())
    parsed = parsed.withColumn("_it", ST.event_time("ingest_ts"))
    d = ST.dedup_within_watermark(parsed, ["trade_id"], "_it", "1 hour")
    return _run(d.drop("_it", "ingest_ts", "source_system", "raw_record_id"), "stream_dedup")


@query("stream_cross_venue")
def _stream_xv(i: Inputs) -> DataFrame:
    """T4 (hour windows, widened): appended once the watermark passes the window end."""
    return _run(ST.cross_venue_windows(_stream_trades(i), "1 hour", "10 minutes", WIDE_RULES), "stream_xv")


@query("stream_price_spikes")
def _stream_spikes(i: Inputs) -> DataFrame:
    """T5 (widened thresholds)."""
    return _run(ST.price_spike_windows(_stream_trades(i), "10 minutes", WIDE_RULES), "stream_spikes")


@query("stream_structuring")
def _stream_struct(i: Inputs) -> DataFrame:
    """T6 (widened band)."""
    return _run(ST.structuring_windows(_stream_trades(i), "1 hour", WIDE_RULES), "stream_struct")


@query("stream_sliding_volume")
def _stream_sliding(i: Inputs) -> DataFrame:
    """4-hour windows sliding by 30 minutes."""
    return _run(ST.sliding_volume(_stream_trades(i), "4 hours", "30 minutes", "10 minutes"), "stream_sliding")


@query("stream_wash_join")
def _stream_wash(i: Inputs) -> DataFrame:
    """Stream-stream wash-pair join (600 s band)."""
    return _run(ST.wash_pairs_stream(_stream_trades(i), 600, "15 minutes", DEFAULT_RULES), "stream_wash")


@query("stream_sessions")
def _stream_sessions(i: Inputs) -> DataFrame:
    """Trading sessions (1-hour gap), appended once closed by the watermark."""
    return _run(ST.burst_sessions(_stream_trades(i), "1 hour", "0 seconds"), "stream_sessions")


@query("stream_sanctioned_flags")
def _stream_flags(i: Inputs) -> DataFrame:
    """Stream-static enrichment of transfers; sanctioned-counterparty rows."""
    t = ST.flag_transfers(ST.transfers_stream(i.spark, i.sf_dir), i.wallets)
    return _run(t.filter(F.col("is_sanctioned_counterparty")), "stream_flags")


# ------------------------------------------------------------------ files, tags, edges, pipeline


@query("json_file_ingest")
def _json_files(i: Inputs) -> DataFrame:
    """Trade payloads written as JSON-lines files and read back with the feed schema:
    corrupt lines are kept aside, the file path is kept as lineage, replays collapse."""
    from tradewatch.session import checkpoint_dir
    path = checkpoint_dir(i.spark, "json_ingest")
    A.trades_raw(i.events).select("payload").write.mode("overwrite").text(path)
    df = RAW.read_json_files(i.spark, path, RAW.TRADE_PAYLOAD)
    good = df.filter(F.col(RAW.CORRUPT).isNull())
    ts = F.try_to_timestamp(F.col("timestamp")).cast("timestamp_ntz")
    typed = good.select(
        "trade_id", "order_id", "account_id", "wallet_id", "venue", "trading_pair", "base_asset", "quote_asset",
        "side", "price", "quantity", "quote_qty", "fee", "fee_currency", "is_maker", ts.alias("trade_ts"),
        F.date_trunc("day", ts).cast("timestamp_ntz").alias("trade_date"), "_file_name")
    one = typed.filter(F.col("trade_id").isNotNull() & F.col("account_id").isNotNull()).dropDuplicates(["trade_id"])
    return one.drop("_file_name")


@query("tagged_entities")
def _tagged(i: Inputs) -> DataFrame:
    """Entities with PII / sensitivity / regulatory tags in the column metadata."""
    return GV.tag_columns(i.entities, "entity")


@query("active_relations")
def _relations(i: Inputs) -> DataFrame:
    """Edges of owners whose number ends in 7 ended after a day."""
    edges = H.owner_edges(i.wallets)
    ended = F.when(F.col("from_id").endswith("7"), F.timestamp_add("DAY", F.lit(1), F.col("valid_from")))
    return H.active_edges(edges.withColumn("valid_to", ended))


@query("pipeline_health")
def _pipeline_health(i: Inputs) -> DataFrame:
    """Runs the whole flow into the checkpoint folder and checks the written tables
    (rows-only: counts and key uniqueness of every layer)."""
    from tradewatch.plans.pipeline import pipeline_health, run_pipeline
    from tradewatch.session import checkpoint_dir
    paths = run_pipeline(i.spark, i.sf_dir, checkpoint_dir(i.spark, "pipeline"))
    return pipeline_health(i.spark, paths)


# ------------------------------------------------------------------ investigator views, T3


@query("case_daily_volume")
def _case_daily_volume(i: Inputs) -> DataFrame:
    cases, _ = new_cases(i)
    return RP.case_daily_volume(RP.case_detail_trades(cases, i.trades, T_AS_OF, i.account_map))


@query("next_case_for_narrative")
def _next_case(i: Inputs) -> DataFrame:
    return RP.next_case_for_narrative(CA._with_case_defaults(i.cases_store))


@query("case_detail_events")
def _case_events(i: Inputs) -> DataFrame:
    _, sla = CA.check_sla(i.cases_store, C_AS_OF)
    _, _, acts = acted(i)
    cols = ["event_id", "case_id", "event_type", "event_data", "performed_by", "event_ts"]
    return RP.case_detail_events(sla.select(*cols).unionByName(acts.select(*cols)))


@query("case_detail_header")
def _case_header(i: Inputs) -> DataFrame:
    cases, _, _ = acted(i)
    return RP.case_detail_header(cases, i.entities)


@query("case_detail_alerts")
def _case_alerts(i: Inputs) -> DataFrame:
    cases, linked = new_cases(i)
    return RP.case_detail_alerts(cases, linked)


@query("sla_snapshot")
def _sla_snapshot(i: Inputs) -> DataFrame:
    snapshot, _ = CA.check_sla(i.cases_store, C_AS_OF)
    return present_cases(snapshot)


@query("actions_alerts")
def _actions_alerts(i: Inputs) -> DataFrame:
    """Alerts after the analysts' actions: each alert belongs to the report case of its number."""
    alerts = i.alerts_store.withColumn("case_id", F.concat(F.lit("C"), F.col("alert_id")))
    _, out, _ = CA.apply_actions(i.cases_store, alerts, A.case_actions(i.table("orders")))
    return out.select("alert_id", "case_id", "status", "updated_at")


@query("log_feed")
def _log_feed(i: Inputs) -> DataFrame:
    return H.parse_logs(A.logs_raw(i.events))


@query("onchain_dead_letters")
def _onchain_dead_letters(i: Inputs) -> DataFrame:
    """Truncated payloads and raw amounts that are no number."""
    raw = A.onchain_raw(i.table("lineitem"), i.table("orders"), faults=True)
    dlq = RAW.dead_letters(raw, "ONCHAIN_RAW", RAW.ONCHAIN_PAYLOAD, RAW.unusable_amount())
    return dlq.withColumn("raw_payload", F.get_json_object("raw_payload", "$.value_raw"))


@query("onchain_amounts")
def _onchain_amounts(i: Inputs) -> DataFrame:
    """Amounts of the feed's good rows, some of them scaled from the raw integer amount."""
    raw = A.onchain_raw(i.table("lineitem"), i.table("orders"), faults=True)
    return H.parse_onchain(raw).select("event_id", "chain", "tx_hash", "value_decimal")


@query("json_array_ingest")
def _json_arrays(i: Inputs) -> DataFrame:
    """Files that hold one JSON array each (1000 event numbers a file), read with the feed's
    schema; the file a record came from is kept as lineage."""
    from tradewatch.session import checkpoint_dir
    path = checkpoint_dir(i.spark, "json_arrays")
    body = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.lit("info").alias("level"),
                              F.col("event_type").alias("service"), F.col("event_id").cast("string").alias("message")))
    files = i.events.select(F.expr("event_id div 1000").alias("file"), body.alias("record")).groupBy("file").agg(
        F.concat(F.lit("["), F.array_join(F.collect_list("record"), ","), F.lit("]")).alias("value"))
    files.repartition("file").write.partitionBy("file").text(path)
    df = RAW.read_json_files(i.spark, path, RAW.LOG_PAYLOAD, multiline=True)
    return df.filter(F.col(RAW.CORRUPT).isNull()).select(
        "timestamp", "level", "service", "message", F.regexp_extract("_file_name", "/file=(\\d+)/", 1).cast("long").alias("file_number"))


@query("entity_tag_coverage")
def _tag_coverage(i: Inputs) -> DataFrame:
    return GV.tag_coverage(GV.tag_columns(i.entities, "entity"))


@query("pipeline_second_run")
def _pipeline_second_run(i: Inputs) -> DataFrame:
    """The whole flow, then a second refresh 26 hours later on the stores of the first. The alerts of the first run
    per type must be those that follow from the tables, every number of broken rows must be zero, and some
    cases must be flagged."""
    from tradewatch.plans.pipeline import alert_store, refresh, run_pipeline, store_faults
    from tradewatch.session import checkpoint_dir
    out = checkpoint_dir(i.spark, "pipeline")
    run_pipeline(i.spark, i.sf_dir, out)
    later = shift(T_AS_OF, 26, "hour")
    refresh(i.spark, out, 2, later, shift(C_AS_OF, 26, "hour"), i.account_map)
    first = alert_store(i.spark, out).read(1).groupBy(F.concat(F.lit("alerts of the first run: "), "alert_type").alias("fault")).agg(
        F.count(F.lit(1)).alias("n_rows"))
    return store_faults(i.spark, out, 2, later).unionByName(first)


@query("stream_latest_orders")
def _stream_orders(i: Inputs) -> DataFrame:
    """Latest order state kept by a stream (a delta for each batch, folded on read)."""
    events = H.parse_orders(A.orders_raw(ST.table_stream(i.spark, i.sf_dir, "events", max_files=1)))
    newest = H.harmonise_orders(H.parse_orders(A.orders_raw(i.events)))
    return ST.latest_state_stream(events, "stream_orders", CA.newest_orders, newest.schema, ["order_id"], compact_every=2).read()


@query("stream_latest_balances")
def _stream_balances(i: Inputs) -> DataFrame:
    """Latest balance per account and asset kept by a stream."""
    events = H.parse_balances(A.balances_raw(ST.table_stream(i.spark, i.sf_dir, "events", max_files=1)))
    newest = H.harmonise_balances(H.parse_balances(A.balances_raw(i.events)))
    return ST.latest_state_stream(events, "stream_balances", H.harmonise_balances, newest.schema, ["account_id", "asset"]).read()


@query("seed_wallets")
def _seed_wallets(i: Inputs) -> DataFrame:
    """Insert-only merge (M2): discovered addresses missing from a master that holds the
    customers' own wallets (the counterparty addresses get inserted)."""
    from tradewatch.operators.state import insert_new
    found = H.discover_wallets(i.transfers).select(
        F.md5(F.concat(F.col("wallet_address"), F.lit("::"), F.col("chain"))).alias("wallet_id"),
        "wallet_address", "chain", "first_seen_ts", "last_seen_ts")
    return insert_new(i.wallets.filter(F.col("owner_entity_id").isNotNull()), found, ["wallet_id"])


@query("stream_alert_dedup")
def _stream_alert_dedup(i: Inputs) -> DataFrame:
    """Alerts of one entity, type and detection hour kept once within a 2-hour watermark."""
    alerts = A.alerts_store(ST.table_stream(i.spark, i.sf_dir, "events"))
    keyed = alerts.select("entity_id", "alert_type", F.date_trunc("hour", "detected_at").cast("timestamp_ntz")
                          .alias("alert_hour"), ST.event_time("detected_at").alias("_et"))
    keyed = keyed.withColumn("dedup_hash", F.md5(F.concat_ws("|", "entity_id", "alert_type",
                                                              F.date_format("alert_hour", "yyyy-MM-dd HH:mm:ss"))))
    d = ST.dedup_within_watermark(keyed, ["dedup_hash"], "_et", "2 hours")
    return _run(d.drop("_et"), "stream_alert_dedup")


# ------------------------------------------------------------------ windows with late rows

from tradewatch.streaming import window_log as WL  # noqa: E402


def _arrivals(i: Inputs, name: str, spec: WL.WindowSpec, delay: str) -> WL.WindowLog:
    """The events as they would arrive (``A.arrival_batch``), one scheduled run of the stream for each batch."""
    base = ST.checkpoint_dir(i.spark, name)
    events = i.events.withColumn("_b", A.arrival_batch())
    for b in [r["_b"] for r in events.select("_b").distinct().orderBy("_b").collect()]:
        events.filter(F.col("_b") == b).drop("_b").write.mode("overwrite").parquet(f"{base}/src/b{b}")
        feed = (i.spark.readStream.schema(i.events.schema).option("recursiveFileLookup", "true").parquet(f"{base}/src"))
        log = WL.run(A.trades(feed), name, spec, delay, base=f"{base}/log", compact_every=3)
    return log


@query("stream_structuring_upsert")
def _stream_struct_upsert(i: Inputs) -> DataFrame:
    """T6 on disordered arrivals: every day, the open ones and the corrected ones too."""
    log = _arrivals(i, "stream_struct_upsert", WL.structuring_spec(WIDE_RULES), "1 hour")
    return WL.structuring_hits(log.windows(), WIDE_RULES)


@query("stream_price_spikes_upsert")
def _stream_spikes_upsert(i: Inputs) -> DataFrame:
    """T5 on disordered arrivals."""
    log = _arrivals(i, "stream_spikes_upsert", WL.price_spike_spec(), "10 minutes")
    return WL.price_spike_hits(log.windows(), WIDE_RULES)


@query("stream_cross_venue_upsert")
def _stream_xv_upsert(i: Inputs) -> DataFrame:
    """T4 on disordered arrivals (hours)."""
    log = _arrivals(i, "stream_xv_upsert", WL.cross_venue_spec("1 hour"), "10 minutes")
    return WL.cross_venue_hits(log.windows(), WIDE_RULES)


@query("stream_late_rows")
def _stream_late_rows(i: Inputs) -> DataFrame:
    """Trades of hours that were closed when they arrived."""
    return _arrivals(i, "stream_late_rows", WL.price_spike_spec(), "10 minutes").late_rows().select(
        "trade_id", "trading_pair", "price", "quote_qty", "trade_ts")


@query("stream_corrections")
def _stream_corrections(i: Inputs) -> DataFrame:
    """New values of the hours that late trades changed."""
    return _arrivals(i, "stream_corrections", WL.price_spike_spec(), "10 minutes").corrections()
