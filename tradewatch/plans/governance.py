"""Governance (D26, D26b, D27): role-based masking, column tags, case row scope.

Masks are Column expressions chosen by role on the driver, so the plan contains only the
expression that applies (no per-row role test).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewatch.functions.text import mask_dob, mask_email, mask_full_name, mask_phone
from tradewatch.params import CASE_VIEW_ROLES

# Which entity columns carry which mask and PII tag.
MASKS = {"full_name": mask_full_name, "email": mask_email, "phone": mask_phone, "date_of_birth": mask_dob}
PII_TAGS = {"full_name": "name", "date_of_birth": "dob", "email": "email", "phone": "phone"}
TABLE_TAGS = {"entity": {"DATA_SENSITIVITY": "RESTRICTED", "REGULATORY": "KYC"},
              "alerts": {"REGULATORY": "AML"}, "cases": {"REGULATORY": "SAR"}}


def mask(df: DataFrame, role: str) -> DataFrame:
    """Apply the masking policy of every masked column present in ``df`` for ``role``."""
    cols = []
    for c in df.columns:
        fn = MASKS.get(c)
        cols.append(fn(F.col(c), role).alias(c) if fn else F.col(c))
    return df.select(*cols)


def tag_columns(df: DataFrame, table: str = "entity") -> DataFrame:
    """Attach PII / sensitivity / regulatory tags as column metadata (kept in the schema
    and in Parquet footers written from it)."""
    out = df
    tags = TABLE_TAGS.get(table, {})
    for c in df.columns:
        meta = dict(tags)
        if c in PII_TAGS:
            meta["PII"] = PII_TAGS[c]
        if meta:
            out = out.withMetadata(c, meta)
    return out


def tag_coverage(df: DataFrame) -> DataFrame:
    """One row per tagged column and tag of ``df``: how many values the tag covers."""
    tagged = [(f.name, k, str(v)) for f in df.schema.fields for k, v in sorted(f.metadata.items())]
    counts = df.agg(*[F.count(c).alias(c) for c in sorted({c for c, _, _ in tagged})])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("tag"), F.lit(v).alias("tag_value"), F.col(c).alias("n_values"))
        for c, k, v in tagged])))


def scope_cases(cases: DataFrame, role: str, user: str) -> DataFrame:
    """Row policy on cases (D27): privileged roles see all rows; others see unassigned
    cases and their own. Apply before aggregating: the policy also shapes aggregates."""
    if role in CASE_VIEW_ROLES:
        return cases
    return cases.filter(F.col("assigned_to").isNull() | (F.col("assigned_to") == F.lit(user)))
