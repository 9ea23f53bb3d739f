"""Investigation cases (D23-D25): creation from open alerts, SLA monitor, analyst actions.

Each operator returns new snapshots / rows to append instead of mutating tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewatch.functions.risk import severity_of_rank, severity_rank, sla_hours
from tradewatch.functions.text import pad
from tradewatch.functions.timefn import as_ts, since
from tradewatch.operators.state import merge_upsert
from tradewatch.operators.windows import global_row_number, latest_by
from tradewatch.params import CLOSED_STATES

CASE_COLUMNS = ["case_id", "case_ref", "entity_id", "state", "priority", "title", "summary",
                "sar_narrative", "root_alert_ids", "alert_types", "peak_ml_probability",
                "composite_severity", "assigned_to", "assigned_at", "due_by", "sla_breached",
                "resolution_type", "resolution_notes", "created_at", "updated_at", "closed_at",
                "created_by"]

CASE_SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM"]


def _with_case_defaults(cases: DataFrame) -> DataFrame:
    """Cases from any source with every case column present (missing ones NULL)."""
    x = cases
    types = {"root_alert_ids": "array<string>", "alert_types": "array<string>",
             "peak_ml_probability": "double", "sla_breached": "boolean", "assigned_at": "timestamp_ntz",
             "due_by": "timestamp_ntz", "created_at": "timestamp_ntz", "updated_at": "timestamp_ntz",
             "closed_at": "timestamp_ntz"}
    for c in CASE_COLUMNS:
        if c not in x.columns:
            x = x.withColumn(c, F.lit(None).cast(types.get(c, "string")))
    return x.select(*CASE_COLUMNS)


def next_case_number(cases: DataFrame, as_of: str) -> int:
    """Largest case number already used on the day of ``as_of`` (0 if none): numbering
    continues instead of restarting at 1 on every run. A one-value aggregate."""
    day = as_of[:10].replace("-", "")
    prefix = f"CASE-{day}-"
    r = (cases.filter(F.col("case_ref").startswith(prefix))
         .agg(F.max(F.substring(F.col("case_ref"), len(prefix) + 1, 18).cast("long")).alias("m")).first())
    return int(r["m"] or 0)


def create_cases(alerts: DataFrame, cases: DataFrame, as_of: str,
                 lookback_hours: int = 24, lexical_severity: bool = False) -> tuple[DataFrame, DataFrame]:
    """Group open, un-cased alerts of the last ``lookback_hours`` (CRITICAL/HIGH/MEDIUM)
    per entity into new cases, skipping entities that already have a case that is not
    closed (D23). Returns (new case rows, alert rows linked to them).

    Severity is ranked (CRITICAL > HIGH > MEDIUM), not compared as text; ``lexical_severity``
    reproduces the reference's text maximum (MEDIUM > HIGH > CRITICAL) for parity runs. Case
    numbers are a global order (severity, alert count desc, entity) continuing the day's
    numbering.
    """
    open_cases = cases.filter(~F.col("state").isin(*CLOSED_STATES)).select("entity_id").distinct()
    a = alerts.filter((F.col("status") == "OPEN") & F.col("case_id").isNull()
                      & F.col("severity").isin(*CASE_SEVERITIES)
                      & since("detected_at", as_of, lookback_hours, "hour"))
    a = a.join(open_cases, on="entity_id", how="left_anti")
    g = a.groupBy("entity_id").agg(
        F.max("ml_fraud_probability").alias("peak_ml_probability"),
        F.sort_array(F.collect_set("alert_id")).alias("root_alert_ids"),
        F.sort_array(F.collect_set("alert_type")).alias("alert_types"),
        (severity_rank(F.max("severity")) if lexical_severity
         else F.min(severity_rank(F.col("severity")))).alias("_sev_rank"),
        F.count(F.lit(1)).alias("alert_count"),
    )
    start = next_case_number(cases, as_of)
    numbered = global_row_number(g, [F.col("_sev_rank"), F.col("alert_count").desc(), F.col("entity_id")], "_n")
    now = as_ts(as_of)
    sev = severity_of_rank(F.col("_sev_rank"))
    day = as_of[:10].replace("-", "")
    ref = F.concat(F.lit(f"CASE-{day}-"), pad(F.col("_n") + F.lit(start), 5))
    new = numbered.select(
        F.md5(F.concat_ws("|", F.lit("case"), F.col("entity_id"), F.lit(as_of))).alias("case_id"),
        ref.alias("case_ref"),
        "entity_id",
        F.lit("OPEN").alias("state"),
        sev.alias("priority"),
        F.concat(F.col("alert_count").cast("string"), F.lit(" alert(s): "),
                 F.array_join(F.col("alert_types"), ", ")).alias("title"),
        F.lit(None).cast("string").alias("summary"),
        F.lit(None).cast("string").alias("sar_narrative"),
        "root_alert_ids", "alert_types", "peak_ml_probability",
        sev.alias("composite_severity"),
        F.lit(None).cast("string").alias("assigned_to"),
        F.lit(None).cast("timestamp_ntz").alias("assigned_at"),
        F.timestamp_add("HOUR", sla_hours(sev), now).alias("due_by"),
        F.lit(False).alias("sla_breached"),
        F.lit(None).cast("string").alias("resolution_type"),
        F.lit(None).cast("string").alias("resolution_notes"),
        now.alias("created_at"), now.alias("updated_at"),
        F.lit(None).cast("timestamp_ntz").alias("closed_at"),
        F.lit("AUTO_ALERT_TASK").alias("created_by"),
    )
    linked = link_alerts(alerts, new, as_of)
    return new, linked


def link_alerts(alerts: DataFrame, new_cases: DataFrame, as_of: str) -> DataFrame:
    """Open, un-cased alerts of the entities that got a case in this call, with the case id,
    status IN_REVIEW and the update time (M5; exactly this call's cases)."""
    c = new_cases.select("entity_id", F.col("case_id").alias("_new_case"))
    a = alerts.filter((F.col("status") == "OPEN") & F.col("case_id").isNull()).join(c, on="entity_id", how="inner")
    return (a.withColumn("case_id", F.col("_new_case")).withColumn("status", F.lit("IN_REVIEW"))
            .withColumn("updated_at", as_ts(as_of)).drop("_new_case"))


def with_links(alerts: DataFrame, linked: DataFrame) -> DataFrame:
    """The alert store with the linked rows in place of their open versions."""
    new = linked.select("alert_id", *[F.col(c).alias(f"_new_{c}") for c in ("case_id", "status", "updated_at")])
    j = alerts.join(new, on="alert_id", how="left")
    return j.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in ("case_id", "status", "updated_at")
                      else F.col(c) for c in alerts.columns])


def newest_orders(rows: DataFrame) -> DataFrame:
    """T3 fold: the newest state of each order, from parsed events or from states folded before."""
    from tradewatch.plans.harmonise import harmonise_orders
    return harmonise_orders(rows.drop("fill_ratio"))


def check_sla(cases: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Flag cases past their deadline that are not closed (D24). Returns (case snapshot,
    SLA_BREACH audit rows for exactly the cases flagged now)."""
    now = as_ts(as_of)
    c = _with_case_defaults(cases)
    due = (~F.col("state").isin(*CLOSED_STATES)) & (F.col("due_by") < now) & (F.col("sla_breached") == F.lit(False))
    flagged = c.filter(due)
    snapshot = c.select(*[
        (F.when(due, F.lit(True)).otherwise(F.col(x)).alias(x) if x == "sla_breached"
         else F.when(due, now).otherwise(F.col(x)).alias(x) if x == "updated_at"
         else F.col(x)) for x in CASE_COLUMNS])
    events = flagged.select(
        F.md5(F.concat_ws("|", F.col("case_id"), F.lit("SLA_BREACH"), F.lit(as_of))).alias("event_id"),
        "case_id",
        F.lit("SLA_BREACH").alias("event_type"),
        F.create_map(F.lit("due_by"), F.date_format("due_by", "yyyy-MM-dd HH:mm:ss"),
                     F.lit("breached_at"), F.lit(as_of),
                     F.lit("priority"), F.col("priority")).alias("event_data"),
        F.lit("SYSTEM").alias("performed_by"),
        now.alias("event_ts"),
    )
    return snapshot, events


def apply_actions(cases: DataFrame, alerts: DataFrame | None, actions: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Fold analyst actions into cases and alerts.

    ``actions(action_id, case_id, action, new_state, analyst, narrative, action_ts)`` with
    ``action`` STATE_CHANGE or NARRATIVE. The latest state change per case wins; closing
    states set ``closed_at`` and ``resolution_type``; the latest narrative is stored, with its
    ``summary`` where the actions have that column. A ``recommended_action`` goes to the audit event.
    Actions on unknown cases are ignored. Returns (cases, alerts, audit events).
    """
    c = _with_case_defaults(cases)
    for extra in ("summary", "recommended_action"):
        if extra not in actions.columns:
            actions = actions.withColumn(extra, F.lit(None).cast("string"))
    known = actions.join(c.select("case_id"), on="case_id", how="left_semi")
    st = latest_by(known.filter(F.col("action") == "STATE_CHANGE"), ["case_id"], ["action_ts", "action_id"])
    nar = latest_by(known.filter(F.col("action") == "NARRATIVE"), ["case_id"], ["action_ts", "action_id"])
    src = (st.select("case_id", F.col("new_state").alias("_state"), F.col("analyst").alias("_analyst"),
                     F.col("action_ts").alias("_st_ts"))
           .join(nar.select("case_id", F.col("narrative").alias("_narr"), F.col("summary").alias("_summary"),
                                F.col("action_ts").alias("_nr_ts")),
                 on="case_id", how="full_outer"))
    closing = F.col("src._state").isin(*CLOSED_STATES)
    upd = {
        "state": F.coalesce(F.col("src._state"), F.col("tgt.state")),
        "assigned_to": F.coalesce(F.col("src._analyst"), F.col("tgt.assigned_to")),
        "assigned_at": F.when(F.col("src._analyst").isNotNull(), F.col("src._st_ts")).otherwise(F.col("tgt.assigned_at")),
        "updated_at": F.greatest(F.col("src._st_ts"), F.col("src._nr_ts"), F.col("tgt.updated_at")),
        "closed_at": F.when(closing, F.col("src._st_ts")).otherwise(F.col("tgt.closed_at")),
        "resolution_type": F.when(F.col("src._state") == "FALSE_POSITIVE", F.lit("FALSE_POSITIVE"))
                            .when(closing, F.lit("TRUE_POSITIVE")).otherwise(F.col("tgt.resolution_type")),
        "sar_narrative": F.coalesce(F.col("src._narr"), F.col("tgt.sar_narrative")),
        "summary": F.coalesce(F.col("src._summary"), F.col("tgt.summary")),
    }
    # source rows whose case does not exist were removed above, so the merge only updates
    new_cases = merge_upsert(c, src, ["case_id"], update=upd)
    new_alerts = None
    if alerts is not None:
        s = st.select(F.col("case_id"), F.col("new_state").alias("_state"), F.col("action_ts").alias("_ts"))
        a = alerts if "updated_at" in alerts.columns else alerts.withColumn("updated_at", F.col("detected_at"))
        a = a.join(s, on="case_id", how="left")
        new_alerts = (a.withColumn("status", F.coalesce(F.col("_state"), F.col("status")))
                      .withColumn("updated_at", F.coalesce(F.col("_ts"), F.col("updated_at")))
                      .drop("_state", "_ts"))
    events = known.select(
        F.md5(F.concat_ws("|", F.col("action_id"), F.col("case_id"))).alias("event_id"),
        "case_id",
        F.when(F.col("action") == "NARRATIVE", F.lit("NARRATIVE")).otherwise(F.lit("STATE_CHANGE")).alias("event_type"),
        F.when(F.col("action") == "NARRATIVE", F.map_filter(F.create_map(
            F.lit("narrative_chars"), F.length("narrative").cast("string"),
            F.lit("recommended_action"), F.col("recommended_action")), lambda k, v: v.isNotNull()))
         .otherwise(F.create_map(F.lit("new_state"), F.col("new_state"))).alias("event_data"),
        F.col("analyst").alias("performed_by"),
        F.col("action_ts").alias("event_ts"),
    )
    return new_cases, new_alerts, events
