"""Thresholds and fixed values of the surveillance rules.

Fixed values: these must equal the published rule definitions for results to match.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Severities, case states, SLA hours, alert defaults.
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
SEVERITY_RANK = {"CRITICAL": 1, "HIGH": 2, "MEDIUM": 3, "LOW": 4}
CASE_STATES = ["OPEN", "IN_REVIEW", "ESCALATED", "SAR_FILED", "CLOSED", "FALSE_POSITIVE"]
CLOSED_STATES = ["CLOSED", "FALSE_POSITIVE"]
SLA_HOURS = {"CRITICAL": 4, "HIGH": 24, "MEDIUM": 72}
SLA_HOURS_DEFAULT = 168
ADMIN_ROLES = ["SURVEILLANCE_ADMIN", "ACCOUNTADMIN"]
ANALYST_ROLE = "SURVEILLANCE_ANALYST"
CASE_VIEW_ROLES = ["SURVEILLANCE_ADMIN", "ACCOUNTADMIN", "SURVEILLANCE_ANALYST"]
REDACTED = "***REDACTED***"


@dataclass(frozen=True)
class RuleParams:
    # pump and dump
    pump_lookback_days: int = 7
    pump_range_pct: float = 0.05
    pump_hour_volume: float = 50000.0
    pump_sell_buy_ratio: float = 2.0
    pump_min_sell: float = 10000.0
    price_pair_separator: str = "/"
    # wash trades (rule)
    wash_lookback_days: int = 7
    wash_band_seconds: int = 600
    wash_price_pct: float = 0.01
    wash_qty_pct: float = 0.05
    wash_critical_price_pct: float = 0.001
    wash_critical_qty_pct: float = 0.01
    wash_high_price_pct: float = 0.005
    # add a log-quantity bucket to the band join key (only pairs of similar size compared)
    wash_qty_buckets: bool = True
    # cross venue
    xv_lookback_days: int = 7
    xv_unit: str = "minute"
    xv_min_venues: int = 2
    xv_min_volume: float = 5000.0
    # structuring
    st_lookback_days: int = 30
    st_low: float = 8000.0
    st_high: float = 9999.0
    st_min_count: int = 3
    st_min_volume: float = 20000.0
    # on-chain
    sanctioned_lookback_days: int = 30
    mixer_lookback_days: int = 90
    mixer_high_volume: float = 10.0


@dataclass(frozen=True)
class FeatureParams:
    base_days: int = 30
    signal_days: int = 7
    wash_signal_band_seconds: int = 600
    wash_signal_price_pct: float = 0.005
    wash_signal_rows: int = 10          # ROWS 10 PRECEDING AND CURRENT ROW
    cancel_carry_rows: int = 20         # ROWS 20 PRECEDING AND CURRENT ROW
    cancel_frame_seconds: int = 3600
    burst_threshold: int = 20


@dataclass(frozen=True)
class AlertParams:
    # look-back of the de-duplication per rule, in hours
    lookback_hours: dict = field(default_factory=lambda: {
        "PUMP_AND_DUMP": 2, "WASH_TRADE": 24, "SANCTIONED_COUNTERPARTY": 168,
        "CROSS_EXCHANGE_ARBITRAGE": 24, "STRUCTURING": 24, "MIXER_EXPOSURE": 168,
    })


DEFAULT_RULES = RuleParams()
# Widened parameters used to exercise the rules on the driver's synthetic tables.
WIDE_RULES = replace(
    DEFAULT_RULES,
    wash_band_seconds=3600,
    xv_unit="hour",
    st_low=1000.0, st_min_volume=5000.0,
    pump_range_pct=0.005, pump_hour_volume=10000.0, pump_min_sell=1000.0,
    pump_lookback_days=30, wash_lookback_days=30, xv_lookback_days=30,
)
DEFAULT_FEATURES = FeatureParams()
DEFAULT_ALERTS = AlertParams()
