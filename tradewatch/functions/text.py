"""String expressions: masking policies (D26), fixed-scale number text, padded ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradewatch.params import ADMIN_ROLES, ANALYST_ROLE, REDACTED

# The e-mail masking pattern keeps up to three leading characters and the '@'.
EMAIL_PATTERN = r"(^[^@]{1,3})[^@]+(@)"
EMAIL_REPLACEMENT = "$1***$2"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _is_admin(role: str) -> bool:
    return role in ADMIN_ROLES


def mask_full_name(val, role: str) -> Column:
    v = _c(val)
    if _is_admin(role):
        return v
    if role == ANALYST_ROLE:
        return F.concat(F.substring(v, 1, 1), F.repeat(F.lit("*"), F.greatest(F.length(v) - 1, F.lit(0))))
    return F.when(v.isNull(), F.lit(REDACTED)).otherwise(F.lit(REDACTED))


def mask_email(val, role: str) -> Column:
    v = _c(val)
    if _is_admin(role):
        return v
    if role == ANALYST_ROLE:
        return F.regexp_replace(v, EMAIL_PATTERN, EMAIL_REPLACEMENT)
    return F.lit(REDACTED)


def mask_phone(val, role: str) -> Column:
    v = _c(val)
    if _is_admin(role):
        return v
    return F.regexp_replace(v, "[0-9]", "*")


def mask_dob(val, role: str) -> Column:
    v = _c(val)
    if _is_admin(role):
        return v
    return F.make_date(F.year(v), F.lit(1), F.lit(1))


def fixed(x, scale: int = 2) -> Column:
    """Number as plain text with a fixed scale (no exponent), identical across engines."""
    return _c(x).cast(f"decimal(38,{scale})").cast("string")


def pad(x, width: int) -> Column:
    """Number as text with leading zeros to ``width``; longer numbers stay whole."""
    text = _c(x).cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def pad_id(prefix: str, x, width: int = 6) -> Column:
    return F.concat(F.lit(prefix), pad(x, width))
