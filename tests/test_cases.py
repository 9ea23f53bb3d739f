"""Case creation, SLA monitor and analyst actions on hand-built stores."""

from datetime import datetime, timedelta

from conftest import rows
from tradewatch.plans import cases as C

AS_OF = "2024-01-31 00:00:00"
NOW = datetime(2024, 1, 31)


def alerts(spark, data):
    return spark.createDataFrame(
        data, "alert_id string, entity_id string, alert_type string, severity string, status string, "
              "case_id string, ml_fraud_probability double, detected_at timestamp_ntz")


def cases(spark, data):
    return spark.createDataFrame(
        data, "case_id string, case_ref string, entity_id string, state string, priority string, "
              "due_by timestamp_ntz, sla_breached boolean, created_at timestamp_ntz, updated_at timestamp_ntz, "
              "closed_at timestamp_ntz, assigned_to string")


def test_create_cases_rules(spark):
    h = timedelta(hours=1)
    a = alerts(spark, [
        ("a1", "E_OPEN", "WASH_TRADE", "HIGH", "OPEN", None, 0.5, NOW - h),        # entity has open case
        ("a2", "E_CLOSED", "WASH_TRADE", "MEDIUM", "OPEN", None, 0.2, NOW - h),    # only closed case
        ("a3", "E_CLOSED", "STRUCTURING", "CRITICAL", "OPEN", None, 0.9, NOW - h),
        ("a4", "E_FP", "MIXER_EXPOSURE", "HIGH", "OPEN", None, 0.3, NOW - h),      # false positive case
        ("a5", "E_LOW", "WASH_TRADE", "LOW", "OPEN", None, 0.1, NOW - h),          # LOW only: no case
        ("a6", "E_OLD", "WASH_TRADE", "HIGH", "OPEN", None, 0.1, NOW - 25 * h),    # older than 24 h
        ("a7", "E_NEW", "WASH_TRADE", "MEDIUM", "OPEN", None, 0.4, NOW - h),
        ("a8", "E_NEW", "WASH_TRADE", "MEDIUM", "IN_REVIEW", None, 0.4, NOW - h),  # not OPEN
        ("a9", "E_CLOSED", "WASH_TRADE", "LOW", "OPEN", None, 0.1, NOW - 30 * h),  # linked though not grouped
    ])
    c = cases(spark, [
        ("c1", "CASE-20240131-00007", "E_OPEN", "OPEN", "HIGH", NOW, False, NOW, NOW, None, None),
        ("c2", "CASE-20240130-00001", "E_CLOSED", "CLOSED", "HIGH", NOW, False, NOW, NOW, NOW, None),
        ("c3", "CASE-20240130-00002", "E_FP", "FALSE_POSITIVE", "HIGH", NOW, False, NOW, NOW, NOW, None),
    ])
    new, linked = C.create_cases(a, c, AS_OF)
    got = {r.entity_id: r for r in new.collect()}
    assert set(got) == {"E_CLOSED", "E_FP", "E_NEW"}
    assert got["E_CLOSED"].priority == "CRITICAL" and got["E_CLOSED"].alert_types == ["STRUCTURING", "WASH_TRADE"]
    assert got["E_CLOSED"].due_by == NOW + timedelta(hours=4)
    assert got["E_NEW"].due_by == NOW + timedelta(hours=72)
    # numbering continues after the day's largest reference (00007), ranked by severity
    assert [got[e].case_ref for e in ("E_CLOSED", "E_FP", "E_NEW")] == [
        "CASE-20240131-00008", "CASE-20240131-00009", "CASE-20240131-00010"]
    assert rows(linked, "alert_id", "status") == [("a2", "IN_REVIEW"), ("a3", "IN_REVIEW"), ("a4", "IN_REVIEW"),
                                                  ("a7", "IN_REVIEW"), ("a9", "IN_REVIEW")]


def test_check_sla(spark):
    c = cases(spark, [
        ("c1", "r1", "E1", "OPEN", "HIGH", NOW, False, NOW, NOW, None, None),                       # due exactly now
        ("c2", "r2", "E2", "OPEN", "HIGH", NOW - timedelta(minutes=1), False, NOW, NOW, None, None),  # overdue
        ("c3", "r3", "E3", "OPEN", "HIGH", NOW - timedelta(days=1), True, NOW, NOW, None, None),     # already
        ("c4", "r4", "E4", "CLOSED", "HIGH", NOW - timedelta(days=1), False, NOW, NOW, NOW, None),   # closed
    ])
    snap, events = C.check_sla(c, AS_OF)
    assert rows(events, "case_id") == [("c2",)]
    assert rows(snap, "case_id", "sla_breached") == [("c1", False), ("c2", True), ("c3", True), ("c4", False)]


def test_apply_actions(spark):
    c = cases(spark, [("c1", "r1", "E1", "OPEN", "HIGH", NOW, False, NOW, NOW, None, None),
                      ("c2", "r2", "E2", "OPEN", "HIGH", NOW, False, NOW, NOW, None, None)])
    a = alerts(spark, [("a1", "E1", "WASH_TRADE", "HIGH", "IN_REVIEW", "c1", 0.5, NOW)])
    acts = spark.createDataFrame([
        ("x1", "c1", "STATE_CHANGE", "ESCALATED", "ann", None, NOW + timedelta(hours=1)),
        ("x2", "c1", "STATE_CHANGE", "FALSE_POSITIVE", "bob", None, NOW + timedelta(hours=2)),   # last wins
        ("x3", "c2", "NARRATIVE", None, "copilot", "text", NOW + timedelta(hours=3)),
        ("x4", "nope", "STATE_CHANGE", "CLOSED", "ann", None, NOW),                              # unknown case
    ], "action_id string, case_id string, action string, new_state string, analyst string, narrative string, "
       "action_ts timestamp_ntz")
    cs, al, ev = C.apply_actions(c, a, acts)
    got = {r.case_id: r for r in cs.collect()}
    assert got["c1"].state == "FALSE_POSITIVE" and got["c1"].resolution_type == "FALSE_POSITIVE"
    assert got["c1"].closed_at == NOW + timedelta(hours=2) and got["c1"].assigned_to == "bob"
    assert got["c2"].state == "OPEN" and got["c2"].sar_narrative == "text"
    assert rows(al, "alert_id", "status") == [("a1", "FALSE_POSITIVE")]
    assert ev.count() == 3


def test_case_prompt_formatting(spark):
    from pyspark.sql import functions as F

    from tradewatch.plans.context import case_prompt
    ctx = spark.createDataFrame(
        [("c1", "CASE-1", "E1", "HIGH", ["WASH_TRADE", "STRUCTURING"], 0.1234, "LOW", True, False,
          12, 1234567.5, 3, 0.5, 2, 10.0, False, 4),
         ("c2", None, "E2", None, None, None, None, None, None, None, None, None, None, None, None, None, None)],
        "case_id string, case_ref string, entity_id string, priority string, alert_types array<string>, "
        "peak_ml_probability double, aml_risk_rating string, pep_flag boolean, sanctions_flag boolean, "
        "cex_trade_count_30d long, cex_volume_usd_30d double, onchain_tx_count_30d long, onchain_volume_30d double, "
        "mixer_interactions_30d long, sanctioned_volume_30d double, has_burst_behaviour boolean, wallet_count long")
    alerts = F.array(F.struct(F.lit(1).alias("rank"), F.lit("WASH_TRADE").alias("alert_type"),
                              F.lit("HIGH").alias("severity"), F.lit("pair").alias("reason"),
                              F.lit(None).cast("timestamp_ntz").alias("detected_at")))
    ctx = ctx.withColumn("recent_alerts", F.when(F.col("case_id") == "c1", alerts))
    out = {r.case_id: r.prompt for r in case_prompt(ctx).collect()}
    p1 = out["c1"]
    assert "Model fraud probability: 12.3%" in p1
    assert "PEP: YES | Sanctions: NO" in p1
    assert "(volume $1,234,568)" in p1 and "(volume 0.5000)" in p1
    assert "sanctioned counterparty exposure: YES" in p1
    assert "  - [HIGH] WASH_TRADE: pair" in p1
    p2 = out["c2"]
    assert "case N/A" in p2 and "(priority MEDIUM)" in p2 and "0.0%" in p2
    assert "No specific alert details available" in p2


def test_lexical_severity_parity_option(spark):
    h = timedelta(hours=1)
    a = alerts(spark, [("a1", "E1", "WASH_TRADE", "CRITICAL", "OPEN", None, 0.5, NOW - h),
                       ("a2", "E1", "WASH_TRADE", "MEDIUM", "OPEN", None, 0.5, NOW - h)])
    c = cases(spark, [("c0", "x", "E9", "CLOSED", "LOW", NOW, False, NOW, NOW, NOW, None)])
    ranked, _ = C.create_cases(a, c, AS_OF)
    lexical, _ = C.create_cases(a, c, AS_OF, lexical_severity=True)
    assert ranked.collect()[0].priority == "CRITICAL"
    assert lexical.collect()[0].priority == "MEDIUM"        # text maximum, as the reference
