"""Risk expressions kept inside the JVM (whole-stage codegen), no Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradewatch.params import SEVERITY_RANK, SLA_HOURS, SLA_HOURS_DEFAULT


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _flag(x) -> Column:
    return F.coalesce(_c(x).cast("boolean"), F.lit(False))


def rule_score(burst, mixers, sanc_vol, pep, sanctions, mixer_exp, sanc_exp, burst_beh) -> Column:
    """Capped additive fraud score in [0, 1].

    Fixed values: weights 0.05 (cap 0.3) per burst trade, 0.15 (cap 0.4) per mixer
    interaction, 0.001 per unit of sanctioned volume, 0.2 PEP, 0.4 sanctions,
    0.2 mixer exposure, 0.3 sanctioned exposure, 0.1 burst behaviour; rounded to
    4 places, then capped at 1.0.
    """
    sv = F.coalesce(_c(sanc_vol).cast("double"), F.lit(0.0))
    risk = (
        F.least(F.coalesce(_c(burst).cast("double"), F.lit(0.0)) * 0.05, F.lit(0.3))
        + F.least(F.coalesce(_c(mixers).cast("double"), F.lit(0.0)) * 0.15, F.lit(0.4))
        + F.when(sv > 0, sv * 0.001).otherwise(F.lit(0.0))
        + F.when(_flag(pep), F.lit(0.2)).otherwise(F.lit(0.0))
        + F.when(_flag(sanctions), F.lit(0.4)).otherwise(F.lit(0.0))
        + F.when(_flag(mixer_exp), F.lit(0.2)).otherwise(F.lit(0.0))
        + F.when(_flag(sanc_exp), F.lit(0.3)).otherwise(F.lit(0.0))
        + F.when(_flag(burst_beh), F.lit(0.1)).otherwise(F.lit(0.0))
    )
    return F.least(F.round(risk, 4), F.lit(1.0))


def severity_rank(sev) -> Column:
    """CRITICAL=1 .. LOW=4, unknown=5 (ranked, not alphabetical)."""
    expr = F.lit(5)
    for name, rank in sorted(SEVERITY_RANK.items(), key=lambda kv: -kv[1]):
        expr = F.when(_c(sev) == name, F.lit(rank)).otherwise(expr)
    return expr


def severity_of_rank(rank) -> Column:
    expr = F.lit(None).cast("string")
    for name, r in SEVERITY_RANK.items():
        expr = F.when(_c(rank) == r, F.lit(name)).otherwise(expr)
    return expr


def sla_hours(sev) -> Column:
    expr = F.lit(SLA_HOURS_DEFAULT)
    for name, h in SLA_HOURS.items():
        expr = F.when(_c(sev) == name, F.lit(h)).otherwise(expr)
    return expr


def risk_tier(sanctions, pep, sanc_exp, mixer_exp, burst_beh) -> Column:
    return (
        F.when(_c(sanctions) == F.lit(True), "CRITICAL")
        .when((_c(pep) == F.lit(True)) | (_c(sanc_exp) == F.lit(True)), "HIGH")
        .when((_c(mixer_exp) == F.lit(True)) | (_c(burst_beh) == F.lit(True)), "MEDIUM")
        .otherwise("LOW")
    )
