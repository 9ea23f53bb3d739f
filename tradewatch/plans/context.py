"""Case context and prompt text for every case at once.

The external model call itself is not part of the library; the prompt is plain text built
with Spark string functions, so all cases are prepared in one distributed job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewatch.functions.risk import severity_rank
from tradewatch.operators.windows import top_k

FEATURES = ["cex_trade_count_30d", "cex_volume_usd_30d", "onchain_tx_count_30d", "onchain_volume_30d",
            "mixer_interactions_30d", "sanctioned_volume_30d", "has_burst_behaviour", "wallet_count"]


def case_context(cases: DataFrame, entities: DataFrame, features: DataFrame, alerts: DataFrame,
                 max_alerts: int = 10) -> DataFrame:
    """One row per case: case fields, entity profile (left join: a case whose entity is
    unknown still gets a context), eight entity features and its ``max_alerts`` most
    severe, most recent alerts (ranked severity, then time, then id)."""
    c = cases.select("case_id", "case_ref", "entity_id", "state", "priority", "alert_types",
                     "peak_ml_probability", "title")
    e = entities.select("entity_id", "aml_risk_rating", "pep_flag", "sanctions_flag", "kyc_tier", "account_type")
    f = features.select("entity_id", *FEATURES)
    a = alerts.filter(F.col("case_id").isNotNull()).select(
        "case_id", "alert_id", "alert_type", "severity", "reason", "detected_at")
    order = [severity_rank(F.col("severity")), F.col("detected_at").desc(), F.col("alert_id")]
    top = top_k(a, ["case_id"], order, max_alerts, salt_col="alert_id")
    packed = top.groupBy("case_id").agg(
        F.sort_array(F.collect_list(F.struct(
            F.col("_rank").alias("rank"), "alert_type", "severity", "reason", "detected_at"))).alias("recent_alerts"))
    return (c.join(e, on="entity_id", how="left").join(f, on="entity_id", how="left")
            .join(packed, on="case_id", how="left"))


def _yes_no(c: Column) -> Column:
    return F.when(c, F.lit("YES")).otherwise(F.lit("NO"))


def _pct1(p: Column) -> Column:
    """Probability as a percentage with one decimal (half-up on the decimal value)."""
    v = F.round((F.coalesce(p, F.lit(0.0)) * F.lit(100)).cast("decimal(20,4)"), 1).cast("decimal(20,1)")
    return F.concat(v.cast("string"), F.lit("%"))


def _money0(v: Column) -> Column:
    """Whole units with thousands separators."""
    return F.format_number(F.round(F.coalesce(v, F.lit(0.0)).cast("decimal(38,2)"), 0).cast("long"), 0)


def _fixed4(v: Column) -> Column:
    return F.coalesce(v, F.lit(0.0)).cast("decimal(38,4)").cast("string")


def _count(v: Column) -> Column:
    return F.coalesce(v, F.lit(0)).cast("long").cast("string")


NL = "\n"


def case_prompt(ctx: DataFrame) -> DataFrame:
    """Deterministic prompt text per case (YES/NO flags, 0.0% probability, grouped whole
    currency units, 4-decimal on-chain volume, one line per recent alert)."""
    lines = F.transform(
        F.coalesce(F.col("recent_alerts"), F.array().cast(ctx.schema["recent_alerts"].dataType)),
        lambda a: F.concat(F.lit("  - ["), a["severity"], F.lit("] "), a["alert_type"], F.lit(": "),
                           F.coalesce(a["reason"], F.lit(""))))
    details = F.when(F.size(lines) > 0, F.array_join(lines, NL)).otherwise(
        F.lit("  - No specific alert details available"))
    text = F.concat(
        F.lit("Investigation case "), F.coalesce(F.col("case_ref"), F.lit("N/A")),
        F.lit(" for entity "), F.coalesce(F.col("entity_id"), F.lit("N/A")),
        F.lit(" (priority "), F.coalesce(F.col("priority"), F.lit("MEDIUM")), F.lit(")"), F.lit(NL),
        F.lit("Alert types: "), F.coalesce(F.array_join(F.col("alert_types"), ", "), F.lit("")), F.lit(NL),
        F.lit("Model fraud probability: "), _pct1(F.col("peak_ml_probability")), F.lit(NL),
        F.lit("AML risk rating: "), F.coalesce(F.col("aml_risk_rating"), F.lit("UNKNOWN")),
        F.lit(" | PEP: "), _yes_no(F.col("pep_flag")),
        F.lit(" | Sanctions: "), _yes_no(F.col("sanctions_flag")), F.lit(NL),
        F.lit("Activity over 30 days:"), F.lit(NL),
        F.lit("- exchange trades: "), _count(F.col("cex_trade_count_30d")),
        F.lit(" (volume $"), _money0(F.col("cex_volume_usd_30d")), F.lit(")"), F.lit(NL),
        F.lit("- on-chain transactions: "), _count(F.col("onchain_tx_count_30d")),
        F.lit(" (volume "), _fixed4(F.col("onchain_volume_30d")), F.lit(")"), F.lit(NL),
        F.lit("- mixer interactions: "), _count(F.col("mixer_interactions_30d")), F.lit(NL),
        F.lit("- sanctioned counterparty exposure: "),
        _yes_no(F.coalesce(F.col("sanctioned_volume_30d"), F.lit(0.0)) > 0), F.lit(NL),
        F.lit("- burst trading: "), _yes_no(F.coalesce(F.col("has_burst_behaviour"), F.lit(False))), F.lit(NL),
        F.lit("- wallets: "), _count(F.col("wallet_count")), F.lit(NL),
        F.lit("Recent alerts:"), F.lit(NL), details, F.lit(NL),
        F.lit("Task: write a short case summary, a suspicious activity narrative and the next "
              "investigative steps. Answer as JSON with the keys case_summary, sar_narrative, "
              "next_steps, risk_indicators, recommended_action."),
    )
    return ctx.select("case_id", "case_ref", "entity_id", text.alias("prompt"))
