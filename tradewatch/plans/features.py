"""Per-trade rolling features (D12) and per-entity risk features.

Design for skew: an account may hold a large share of all trades, so no step sorts a whole
account in one task and none goes through a frame's rows again for each row. RANGE frames are merged
from partials per time bucket (``rolling_partials``), ROWS frames use
global positions built from slice summaries (``rows_sum`` / ``rows_last_non_null``), the
order look-up is an as-of join, and the burst count is a plain aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewatch.functions.timefn import as_ts, epoch_seconds, shift, since, trunc
from tradewatch.operators.joins import HOT_COPIES, asof_join, either_key_join, interval_join
from tradewatch.operators.logstore import LogStore
from tradewatch.operators.slices import SliceLayer
from tradewatch.operators.windows import rolling_partials, rows_last_non_null, rows_sum
from tradewatch.params import DEFAULT_FEATURES, FeatureParams

H_US = 3_600_000_000
D_US = 24 * H_US

KEY_COLS = ["trade_id", "account_id", "wallet_id", "venue", "trade_ts", "trading_pair"]


def base_trades(trades: DataFrame, as_of: str, p: FeatureParams = DEFAULT_FEATURES) -> DataFrame:
    return trades.filter(since("trade_ts", as_of, p.base_days, "day")).select(
        "trade_id", "account_id", "wallet_id", "venue", "trading_pair", "side", "price",
        "quantity", "quote_qty", "is_maker", "trade_ts")


def _buy(c="quote_qty"):
    return F.when(F.col("side") == "BUY", F.col(c)).otherwise(F.lit(0.0))


def _sell(c="quote_qty"):
    return F.when(F.col("side") == "SELL", F.col(c)).otherwise(F.lit(0.0))


def pair_windows(base: DataFrame, p: FeatureParams = DEFAULT_FEATURES, frames=("1h", "4h", "24h")) -> DataFrame:
    """1 h / 4 h / 24 h RANGE frames per (account, pair) from hourly partials."""
    one, maker = F.lit(1), F.when(F.col("is_maker"), F.lit(1)).otherwise(F.lit(0))
    qty, price = F.col("quote_qty"), F.col("price")
    specs = {}
    for name, us in (("1h", H_US), ("4h", 4 * H_US), ("24h", D_US)):
        if name not in frames:
            continue
        specs[f"trade_count_{name}"] = ("count", one, us)
        specs[f"volume_usd_{name}"] = ("sum", qty, us)
        specs[f"avg_price_{name}"] = ("avg", price, us)
        if name == "24h":
            specs["price_max_24h"], specs["price_min_24h"] = ("max", price, us), ("min", price, us)
        else:
            specs[f"price_stddev_{name}"] = ("stddev", price, us)
        if name != "4h":
            specs[f"buy_vol_{name}"], specs[f"sell_vol_{name}"] = ("sum", _buy(), us), ("sum", _sell(), us)
        if name == "24h":
            specs["maker_count_24h"] = ("sum", maker, us)
    return rolling_partials(base, ["account_id", "trading_pair"], "trade_ts", specs, H_US)


def account_windows(base: DataFrame, p: FeatureParams = DEFAULT_FEATURES) -> DataFrame:
    """7-day RANGE frame per account, plus the true 24-hour distinct pair and venue counts
    (the reference's ``unique_pairs_24h`` is the constant 1 and its ``unique_venues_24h``
    spans the whole look-back; both are kept for parity, these are the ``_true`` forms),
    from six-hourly partials. A distinct count is the size of the merged value sets (values
    per account and day are few: pairs, venues)."""
    w, qty = 7 * D_US, F.col("quote_qty")
    specs = {
        "trade_count_7d": ("count", F.lit(1), w),
        "volume_usd_7d": ("sum", qty, w),
        "avg_trade_size_7d": ("avg", qty, w),
        "trade_size_stddev_7d": ("stddev", qty, w),
        "unique_pairs_24h_true": ("distinct", F.col("trading_pair"), D_US),
        "unique_venues_24h_true": ("distinct", F.col("venue"), D_US),
    }
    return rolling_partials(base, ["account_id"], "trade_ts", specs, 6 * H_US)


def venue_distinct(base: DataFrame) -> DataFrame:
    """COUNT(DISTINCT venue) OVER (PARTITION BY account) as a grouped aggregate (distinct
    window aggregates are rejected by Spark; the aggregate also combines map-side)."""
    return base.groupBy("account_id").agg(F.count_distinct("venue").alias("unique_venues_24h"))


def wash_flags(trades: DataFrame, as_of: str, p: FeatureParams = DEFAULT_FEATURES) -> DataFrame:
    """Trades of the last ``signal_days`` with an opposite-side trade of the same account and
    pair less than ``wash_signal_band_seconds`` apart (second boundaries) at a price within
    ``wash_signal_price_pct``. An existence test (left-semi band join): no pair rows."""
    t7 = trades.filter(since("trade_ts", as_of, p.signal_days, "day")).select(
        "trade_id", "account_id", "trading_pair", "side", "price", "trade_ts")
    # candidates: distinct (account, pair, side, second, price) points; a partner lies at most
    # one band before the first trade of the look-back, so older trades are never read
    first = shift(shift(as_of, -p.signal_days, "day"), -p.wash_signal_band_seconds, "second")
    cand = trades.filter(F.col("trade_ts") >= as_ts(first)).select(
        "account_id", "trading_pair", "side", "price", epoch_seconds("trade_ts").alias("_sec")).distinct()
    band = p.wash_signal_band_seconds - 1
    resid = ((F.col("l.side") != F.col("r.side"))
             & (F.try_divide(F.abs(F.col("r.price") - F.col("l.price")), F.nullif(F.col("l.price"), F.lit(0.0)))
                < F.lit(p.wash_signal_price_pct)))
    hit = interval_join(t7, cand, ["account_id", "trading_pair"], epoch_seconds("trade_ts"), F.col("_sec"),
                        -band, band, residual=resid, how="left_semi")
    flagged = hit.select("trade_id", F.lit(1).alias("_has_partner"))
    return t7.join(flagged, on="trade_id", how="left").withColumn(
        "_has_partner", F.coalesce(F.col("_has_partner"), F.lit(0)))


def wash_signal(trades: DataFrame, as_of: str, p: FeatureParams = DEFAULT_FEATURES) -> DataFrame:
    """Per trade of the last ``signal_days``: number of trades with a wash partner among the
    trade and its ``wash_signal_rows`` predecessors (account, pair; by time, then id)."""
    f = wash_flags(trades, as_of, p)
    out = rows_sum(f, ["account_id", "trading_pair"], "trade_ts", ["trade_id"], "_has_partner",
                   p.wash_signal_rows, "wash_trade_signal")
    return out.select("trade_id", F.col("wash_trade_signal").cast("long").alias("wash_trade_signal"))


def cancel_counts(orders: DataFrame, as_of: str, p: FeatureParams = DEFAULT_FEATURES) -> DataFrame:
    """Per order (latest state) of the last ``signal_days``: cancelled/expired orders of the
    account in the hour up to and including its time."""
    o = orders.filter(since("event_ts", as_of, p.signal_days, "day")).select(
        "order_id", "account_id", "state", "event_ts")
    gone = F.when(F.col("state").isin("CANCELLED", "EXPIRED"), F.lit(1)).otherwise(F.lit(0))
    frame = p.cancel_frame_seconds * 1_000_000
    return rolling_partials(o, ["account_id"], "event_ts", {"cancelled_orders_1h": ("sum", gone, frame)}, frame)


def cancel_signal(trades: DataFrame, orders: DataFrame, as_of: str, p: FeatureParams = DEFAULT_FEATURES) -> DataFrame:
    """Per trade of the last ``signal_days``: the cancel count of the latest order placed in
    the hour up to the trade (as-of join), carried forward over the trade and its
    ``cancel_carry_rows`` predecessors of the account (last non-null); 0 when none."""
    t7 = trades.filter(since("trade_ts", as_of, p.signal_days, "day")).select("trade_id", "account_id", "trade_ts")
    oc = cancel_counts(orders, as_of, p)
    j = asof_join(t7, oc, ["account_id"], "trade_ts", "event_ts", p.cancel_frame_seconds * 1_000_000,
                  ["cancelled_orders_1h"], right_order=["order_id"])
    out = rows_last_non_null(j, ["account_id"], "trade_ts", ["trade_id"], "asof_cancelled_orders_1h",
                             p.cancel_carry_rows, "_c")
    return out.select("trade_id", F.coalesce(F.col("_c"), F.lit(0)).cast("long").alias("cancelled_orders_1h"))


def ratios(df: DataFrame) -> DataFrame:
    def ratio(a, b):
        return F.coalesce(F.try_divide(F.col(a), F.nullif(F.col(b), F.lit(0.0))), F.lit(0.0))
    return df.select(
        "*",
        ratio("buy_vol_1h", "sell_vol_1h").alias("buy_sell_ratio_1h"),
        ratio("buy_vol_24h", "sell_vol_24h").alias("buy_sell_ratio_24h"),
        F.try_divide(F.coalesce(F.col("price_max_24h") - F.col("price_min_24h"), F.lit(0.0)),
                     F.nullif(F.col("avg_price_24h"), F.lit(0.0))).alias("price_range_pct_24h"),
        F.coalesce(F.try_divide(F.col("volume_usd_1h"), F.nullif(F.col("volume_usd_7d") / F.lit(168), F.lit(0.0))),
                   F.lit(0.0)).alias("volume_spike_ratio_1h"),
        F.coalesce(F.try_divide(F.col("maker_count_24h").cast("double"),
                                F.nullif(F.col("trade_count_24h").cast("double"), F.lit(0.0))),
                   F.lit(0.0)).alias("maker_ratio_24h"),
    )


FEATURE_COLUMNS = [
    "trade_count_1h", "volume_usd_1h", "avg_price_1h", "price_stddev_1h", "buy_vol_1h", "sell_vol_1h",
    "trade_count_4h", "volume_usd_4h", "avg_price_4h", "price_stddev_4h",
    "trade_count_24h", "volume_usd_24h", "avg_price_24h", "price_max_24h", "price_min_24h",
    "buy_vol_24h", "sell_vol_24h", "unique_pairs_24h", "unique_venues_24h", "maker_count_24h",
    "trade_count_7d", "volume_usd_7d", "avg_trade_size_7d", "trade_size_stddev_7d",
    "buy_sell_ratio_1h", "buy_sell_ratio_24h", "price_range_pct_24h", "volume_spike_ratio_1h",
    "maker_ratio_24h", "wash_trade_signal", "cancelled_orders_1h",
    "unique_pairs_24h_true", "unique_venues_24h_true",
]


def trade_features(trades: DataFrame, orders: DataFrame, as_of: str, p: FeatureParams = DEFAULT_FEATURES) -> DataFrame:
    """One row per trade of the last ``base_days`` with all rolling features."""
    base = base_trades(trades, as_of, p)
    pw = pair_windows(base, p)
    aw = account_windows(base, p).select("trade_id", "trade_count_7d", "volume_usd_7d",
                                         "avg_trade_size_7d", "trade_size_stddev_7d",
                                         "unique_pairs_24h_true", "unique_venues_24h_true")
    vd = venue_distinct(base)
    ws = wash_signal(trades, as_of, p)
    cs = cancel_signal(trades, orders, as_of, p)
    # the joins on trade_id first: they share one exchange of the wide rows
    j = (pw.join(aw, on="trade_id", how="inner")
         .join(ws, on="trade_id", how="left")
         .join(cs, on="trade_id", how="left")
         .join(vd, on="account_id", how="left"))
    j = (j.withColumn("unique_pairs_24h", F.lit(1))
          .withColumn("unique_pairs_24h_true", F.col("unique_pairs_24h_true").cast("long"))
          .withColumn("unique_venues_24h_true", F.col("unique_venues_24h_true").cast("long")))
    j = ratios(j)
    j = (j.withColumn("wash_trade_signal", F.coalesce(F.col("wash_trade_signal"), F.lit(0)).cast("long"))
          .withColumn("cancelled_orders_1h", F.coalesce(F.col("cancelled_orders_1h"), F.lit(0)).cast("long")))
    return j.select(*KEY_COLS, *FEATURE_COLUMNS, as_ts(as_of).alias("feature_computed_at"))


# ----------------------------------------------------------------------------- entity features


def _entity_of_account(df: DataFrame, account_map: DataFrame | None) -> DataFrame:
    """entity_id for each account: from ``account_map`` when given, else the account id."""
    if account_map is None:
        return df.withColumn("entity_id", F.col("account_id"))
    m = account_map.select("account_id", F.col("entity_id").alias("_mapped"))
    return (df.join(m, on="account_id", how="left")
            .withColumn("entity_id", F.coalesce(F.col("_mapped"), F.col("account_id"))).drop("_mapped"))


def onchain_stats(transfers: DataFrame, wallets: DataFrame, as_of: str, days: int = 30,
                  per_entity: bool = False,
                  true_counterparties: bool = False) -> DataFrame:
    """Per owning entity, transfers of the last ``days`` touching one of its wallets
    (either end, same chain): distinct transactions, volume, distinct senders, transfers to
    a mixer address, sanctioned volume, highest counterparty risk.

    Parity defaults: a transfer between two wallets of one entity counts once per matching
    wallet (as the OR join does), and "counterparties" are the distinct senders, own
    address included. ``per_entity`` counts each transfer once per entity;
    ``true_counterparties`` counts the distinct addresses at the other end."""
    event = ["event_id"] if "event_id" in transfers.columns else []  # one transaction may hold several transfers
    t = transfers.filter(since("block_ts", as_of, days, "day")).select(
        *event, "tx_hash", "chain", "from_address", "to_address", "value_decimal", "event_type",
        "is_sanctioned_counterparty", "risk_score")
    mixers = (wallets.filter(F.col("is_mixer") == F.lit(True)).select(F.col("wallet_address").alias("to_address"))
              .distinct().withColumn("_to_mixer", F.lit(True)))
    t = t.join(mixers, on="to_address", how="left")
    owned = wallets.filter(F.col("owner_entity_id").isNotNull()).select(
        F.col("wallet_address").alias("_w_addr"), "chain", "owner_entity_id")
    j = either_key_join(t, owned, ["from_address", "to_address"], "_w_addr", on_also=["chain"],
                        hot_copies=HOT_COPIES)
    if per_entity:
        j = j.dropDuplicates(["owner_entity_id", "chain", "tx_hash", *event])
    other = F.when(F.col("_match_key") == F.col("from_address"), F.col("to_address")).otherwise(F.col("from_address"))
    party = other if true_counterparties else F.col("from_address")
    return j.groupBy(F.col("owner_entity_id").alias("entity_id")).agg(
        F.count_distinct("tx_hash").alias("onchain_tx_count_30d"),
        F.sum("value_decimal").alias("onchain_volume_30d"),
        F.count_distinct(party).alias("unique_counterparties_30d"),
        F.sum(F.when((F.col("event_type") == "transfer") & F.col("_to_mixer").isNotNull(), F.lit(1))
              .otherwise(F.lit(0))).cast("long").alias("mixer_interactions_30d"),
        F.sum(F.when(F.col("is_sanctioned_counterparty"), F.col("value_decimal")).otherwise(F.lit(0.0)))
        .alias("sanctioned_volume_30d"),
        F.max("risk_score").alias("max_counterparty_risk_30d"),
    )


def cex_stats(trades: DataFrame, as_of: str, account_map: DataFrame | None = None, days: int = 30) -> DataFrame:
    t = _entity_of_account(trades.filter(since("trade_ts", as_of, days, "day")), account_map)
    return t.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("cex_trade_count_30d"),
        F.sum("quote_qty").alias("cex_volume_usd_30d"),
        F.count_distinct("trading_pair").alias("unique_pairs_30d"),
        F.stddev_samp("quote_qty").alias("trade_size_volatility_30d"),
        F.max("quote_qty").alias("max_single_trade_30d"),
    )


def burst_stats(trades: DataFrame, as_of: str, account_map: DataFrame | None = None, days: int = 30) -> DataFrame:
    """Trades whose previous trade of the account falls in the same clock hour (an hour
    boundary difference below 1). Every trade but the first of each (account, hour) has
    its predecessor in that hour, so the count is ``trades - distinct hours`` per account:
    a map-side-combinable aggregate instead of a LAG over the whole account."""
    t = trades.filter(since("trade_ts", as_of, days, "day")).select(
        "account_id", trunc("hour", "trade_ts").alias("_h"))
    per_account = t.groupBy("account_id").agg(
        (F.count(F.lit(1)) - F.count_distinct("_h")).alias("_burst"))
    e = _entity_of_account(per_account, account_map)
    return e.groupBy("entity_id").agg(F.sum("_burst").cast("long").alias("burst_trade_count_30d"))


def entity_features(entities: DataFrame, trades: DataFrame, transfers: DataFrame, wallets: DataFrame,
                    as_of: str, account_map: DataFrame | None = None, onchain_as_of: str | None = None,
                    p: FeatureParams = DEFAULT_FEATURES) -> DataFrame:
    """One row per entity (D16): CEX stats, burst count, on-chain stats, exposure flags and
    the number of wallets it owns. ``onchain_as_of`` defaults to ``as_of``."""
    cs = cex_stats(trades, as_of, account_map)
    bs = burst_stats(trades, as_of, account_map)
    oc = onchain_stats(transfers, wallets, onchain_as_of or as_of)
    wc = (wallets.filter(F.col("owner_entity_id").isNotNull())
          .groupBy(F.col("owner_entity_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("wallet_count")))
    e = entities.select("entity_id", "kyc_tier", "aml_risk_rating", "pep_flag", "sanctions_flag", "account_type")
    j = (e.join(cs, on="entity_id", how="left").join(bs, on="entity_id", how="left")
         .join(oc, on="entity_id", how="left").join(wc, on="entity_id", how="left"))

    def z(c, zero=0):
        return F.coalesce(F.col(c), F.lit(zero))

    return j.select(
        "entity_id", "kyc_tier", "aml_risk_rating", "pep_flag", "sanctions_flag", "account_type",
        z("cex_trade_count_30d").cast("long").alias("cex_trade_count_30d"),
        z("cex_volume_usd_30d", 0.0).alias("cex_volume_usd_30d"),
        z("unique_pairs_30d").cast("long").alias("unique_pairs_30d"),
        z("trade_size_volatility_30d", 0.0).alias("trade_size_volatility_30d"),
        z("max_single_trade_30d", 0.0).alias("max_single_trade_30d"),
        z("burst_trade_count_30d").cast("long").alias("burst_trade_count_30d"),
        z("onchain_tx_count_30d").cast("long").alias("onchain_tx_count_30d"),
        z("onchain_volume_30d", 0.0).alias("onchain_volume_30d"),
        z("unique_counterparties_30d").cast("long").alias("unique_counterparties_30d"),
        z("mixer_interactions_30d").cast("long").alias("mixer_interactions_30d"),
        z("sanctioned_volume_30d", 0.0).alias("sanctioned_volume_30d"),
        z("max_counterparty_risk_30d", 0.0).alias("max_counterparty_risk_30d"),
        (z("mixer_interactions_30d") > 0).alias("has_mixer_exposure"),
        (z("sanctioned_volume_30d", 0.0) > 0).alias("has_sanctioned_exposure"),
        (z("burst_trade_count_30d") > p.burst_threshold).alias("has_burst_behaviour"),
        z("wallet_count").cast("long").alias("wallet_count"),
        as_ts(as_of).alias("feature_computed_at"),
    )


def rolling_layer(trades: LogStore, path: str) -> SliceLayer:
    """24-hour and 7-day features of every trade of the store, recomputed where new trades touch them."""
    def compute(base: DataFrame) -> DataFrame:
        pair = pair_windows(base, frames=("24h",))
        account = account_windows(base).select("trade_id", "trade_count_7d", "volume_usd_7d", "avg_trade_size_7d", "unique_pairs_24h_true")
        return pair.join(account, "trade_id").select(*KEY_COLS, "quote_qty", "trade_count_24h", "volume_usd_24h", "price_max_24h", "price_min_24h",
                                                     "trade_count_7d", "volume_usd_7d", "avg_trade_size_7d", "unique_pairs_24h_true")
    return SliceLayer(trades, path, compute, ["trade_id"], "account_id", "trade_ts", frame_days=7)


def account_day_layer(rolling: SliceLayer, path: str) -> SliceLayer:
    """Per account and day over the rolling layer: volume and the day's highest rolling values."""
    def compute(rows: DataFrame) -> DataFrame:
        return rows.groupBy("account_id", trunc("day", "trade_ts").alias("trade_day")).agg(
            F.count(F.lit(1)).alias("n_trades"), F.sum("quote_qty").alias("volume_usd"), F.max("volume_usd_24h").alias("peak_volume_24h"),
            F.max("trade_count_7d").alias("peak_trade_count_7d"), F.max("unique_pairs_24h_true").alias("peak_pairs_24h"))
    return SliceLayer(rolling.store, path, compute, ["account_id", "trade_day"], "account_id", "trade_day")
