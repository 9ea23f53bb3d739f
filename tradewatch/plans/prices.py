"""Reference prices and wallet labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewatch.functions.timefn import since
from tradewatch.operators.state import priority_union

# Tickers and EAV variables of the external price series, FX base currency.
MARKET_TICKERS = ["BTC", "ETH", "GBTC", "ETHE", "COIN", "BITO", "MARA", "RIOT", "MSTR"]
EAV_VARIABLES = {
    "open_price": "pre-market_open",
    "high_price": "all-day_high",
    "low_price": "all-day_low",
    "close_price": "post-market_close",
    "volume_base": "nasdaq_volume",
}
MARKET_SOURCE = "MARKET_DATA"
PRICE_COLUMNS = ["asset_ticker", "trading_pair", "price_date", "open_price", "high_price", "low_price",
                 "close_price", "volume_base", "volume_quote_usd", "trade_count", "data_source"]


def synthetic_prices(trades: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Daily OHLCV per (asset, pair) from our own trades; open = close = average price."""
    t = trades.filter(since("trade_ts", as_of, days, "day"))
    g = t.groupBy(F.col("base_asset").alias("asset_ticker"), "trading_pair",
                  F.col("trade_date").alias("price_date")).agg(
        F.min("price").alias("low_price"), F.max("price").alias("high_price"),
        F.avg("price").alias("avg_price"), F.sum("quantity").alias("volume_base"),
        F.sum("quote_qty").alias("volume_quote_usd"), F.count(F.lit(1)).alias("trade_count"))
    return g.select(
        "asset_ticker", "trading_pair", "price_date",
        F.col("avg_price").alias("open_price"), "high_price", "low_price",
        F.col("avg_price").alias("close_price"), "volume_base", "volume_quote_usd", "trade_count",
        F.lit("SYNTHETIC").alias("data_source"))


def pivot_prices(eav: DataFrame, tickers: list[str] = MARKET_TICKERS) -> DataFrame:
    """EAV series (ticker, variable, date, value) -> one OHLCV row per (ticker, date) by
    conditional max; days without an open or close value are dropped."""
    e = eav.filter(F.col("ticker").isin(*tickers) & F.col("variable").isin(*EAV_VARIABLES.values()))
    aggs = [F.max(F.when(F.col("variable") == v, F.col("value"))).alias(k) for k, v in EAV_VARIABLES.items()]
    g = e.groupBy("ticker", "date").agg(*aggs, F.count(F.lit(1)).alias("trade_count"))
    g = g.filter(F.col("open_price").isNotNull() & F.col("close_price").isNotNull())
    return g.select(
        F.col("ticker").alias("asset_ticker"),
        F.concat(F.col("ticker"), F.lit("/USD")).alias("trading_pair"),
        F.col("date").alias("price_date"),
        "open_price", "high_price", "low_price", "close_price", "volume_base",
        F.lit(None).cast("double").alias("volume_quote_usd"), "trade_count",
        F.lit(MARKET_SOURCE).alias("data_source"))


def fx_rates(fx: DataFrame, base: str = "USD") -> DataFrame:
    return fx.filter(F.col("base_currency_id") == base).select(
        "base_currency_id", "quote_currency_id", "base_currency_name", "quote_currency_name",
        F.col("date").alias("rate_date"), F.col("value").alias("exchange_rate"),
        F.lit(MARKET_SOURCE).alias("data_source"))


def market_prices(market: DataFrame, synthetic: DataFrame) -> DataFrame:
    """External prices where they exist for (asset, day), our synthetic ones elsewhere."""
    return priority_union(market.select(*PRICE_COLUMNS), synthetic.select(*PRICE_COLUMNS),
                          ["asset_ticker", "price_date"])


def wallet_labels(wallets: DataFrame) -> DataFrame:
    """Label type by precedence SANCTIONS > MIXER > EXCHANGE > SMART_CONTRACT > UNKNOWN and a
    fixed risk score of 80 for sanctioned or mixer wallets (0 otherwise)."""
    t = (F.when(F.col("is_sanctioned"), "SANCTIONS").when(F.col("is_mixer"), "MIXER")
         .when(F.col("is_exchange_wallet"), "EXCHANGE").when(F.col("wallet_type") == "CONTRACT", "SMART_CONTRACT")
         .otherwise("UNKNOWN"))
    return wallets.select(
        "wallet_address", "chain", t.alias("label_type"),
        F.coalesce(F.col("label"), F.col("wallet_type")).alias("label_name"),
        F.when(F.col("is_sanctioned") | F.col("is_mixer"), F.lit(80.0)).otherwise(F.lit(0.0)).alias("risk_score"),
        F.lit("SYNTHETIC").alias("data_source"))


# --------------------------------------------------------------------------- derived series


def eav_from_trades(trades: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """An external-style EAV price series derived from the trades (test input): per (asset,
    day) five variables (open = day low, close = day high; order-independent aggregates);
    the close is missing on days whose day-of-month is divisible by 5."""
    d = synthetic_prices(trades, as_of, days)
    pairs = F.array(
        F.struct(F.lit(EAV_VARIABLES["open_price"]).alias("variable"), F.col("low_price").alias("value")),
        F.struct(F.lit(EAV_VARIABLES["high_price"]).alias("variable"), F.col("high_price").alias("value")),
        F.struct(F.lit(EAV_VARIABLES["low_price"]).alias("variable"), F.col("low_price").alias("value")),
        F.struct(F.lit(EAV_VARIABLES["close_price"]).alias("variable"),
                 F.when(F.dayofmonth("price_date") % 5 != 0, F.col("high_price")).alias("value")),
        F.struct(F.lit(EAV_VARIABLES["volume_base"]).alias("variable"),
                 F.col("volume_base").alias("value")),
    )
    x = d.select(F.col("asset_ticker").alias("ticker"), F.col("price_date").alias("date"), F.explode(pairs).alias("kv"))
    return x.select("ticker", "kv.variable", "date", "kv.value").filter(F.col("value").isNotNull())


def fx_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """An FX-style daily series derived from line items (test input)."""
    base = (F.when(F.col("l_returnflag") == "A", "USD").when(F.col("l_returnflag") == "N", "EUR").otherwise("GBP"))
    quote = F.when(F.col("l_linestatus") == "F", "JPY").otherwise("CHF")
    g = lineitem.groupBy(base.alias("base_currency_id"), quote.alias("quote_currency_id"),
                         F.col("l_shipdate").alias("date")).agg(
        F.avg(F.lit(1.0) + F.col("l_discount")).alias("value"))
    names = {"USD": "US Dollar", "EUR": "Euro", "GBP": "Pound Sterling", "JPY": "Yen", "CHF": "Swiss Franc"}

    def name(c):
        e = F.lit(None).cast("string")
        for k, v in names.items():
            e = F.when(F.col(c) == k, F.lit(v)).otherwise(e)
        return e

    return g.select("base_currency_id", "quote_currency_id", name("base_currency_id").alias("base_currency_name"),
                    name("quote_currency_id").alias("quote_currency_name"), "date", "value")
