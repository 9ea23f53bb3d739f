"""Generic operators against brute-force equivalents (the property checks of the blueprint)."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from tradewatch.functions.timefn import epoch_seconds
from tradewatch.operators import (
    HOT_COPIES, append_deduped, asof_join, either_key_join, frequent_keys, global_row_number, interval_join, latest_by,
    latest_by_stored, merge_upsert, rolling, rows_last_non_null, rows_sum, snapshot_diff, top_k,
)

T0 = datetime(2024, 1, 1)


def _events(spark, n=400, keys=3, seed=7, span_s=5 * 86400):
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        k = "k%d" % (0 if rnd.random() < 0.5 else rnd.randrange(keys))   # one hot key
        ts = T0 + timedelta(seconds=rnd.randrange(span_s), microseconds=rnd.choice([0, 0, 1, 999999]))
        data.append((str(i), k, ts, float(rnd.randrange(1, 100)), rnd.choice([None, 1.0, 2.0, 3.0])))
    # exact ties on time (peers)
    data.append(("t1", "k0", T0 + timedelta(hours=5), 1.0, None))
    data.append(("t2", "k0", T0 + timedelta(hours=5), 2.0, 4.0))
    return spark.createDataFrame(data, "id string, k string, ts timestamp_ntz, v double, x double")


def test_either_key_join_equals_or_join(spark):
    t = spark.createDataFrame([("1", "a", "b", "eth"), ("2", "b", "a", "eth"), ("3", "a", "a", "eth"),
                               ("4", "c", "d", "eth"), ("5", "a", "b", "pol"), ("6", None, "b", "eth")],
                              "tx string, f string, t string, chain string")
    w = spark.createDataFrame([("a", "eth", "E1"), ("b", "eth", "E2"), ("a", "pol", "E3")],
                              "addr string, chain string, owner string")
    got = either_key_join(t, w, ["f", "t"], "addr", on_also=["chain"])
    ref = t.alias("t").join(w.alias("w"), ((F.col("t.f") == F.col("w.addr")) | (F.col("t.t") == F.col("w.addr")))
                            & (F.col("t.chain") == F.col("w.chain")))
    assert rows(got, "tx", "owner") == rows(ref, "tx", "owner")
    left = either_key_join(t, w, ["f", "t"], "addr", on_also=["chain"], how="left")
    ref_left = t.alias("t").join(w.alias("w"), ((F.col("t.f") == F.col("w.addr")) | (F.col("t.t") == F.col("w.addr")))
                                 & (F.col("t.chain") == F.col("w.chain")), "left")
    assert rows(left, "tx", "owner") == sorted(rows(ref_left, "tx", "owner"), key=lambda r: (r[0], r[1] or ""))


def test_either_key_join_deals_a_hot_key_to_many_tasks(spark):
    """A third of all transfers touch one address: same rows as the plain path, no task far above the rest."""
    n = F.col("id")
    t = spark.range(30_000).select(
        n.alias("tx"), F.when(n % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("a"), (n % 5000).cast("string"))).alias("f"),
        F.concat(F.lit("a"), (n % 4999).cast("string")).alias("t"), F.lit("eth").alias("chain"))
    w = spark.range(5000).select(F.concat(F.lit("a"), n.cast("string")).alias("addr"), F.lit("eth").alias("chain"), n.alias("o"))
    w = w.union(spark.createDataFrame([("hot", "eth", -1), ("hot", "eth", -2), (None, "eth", -3)], "addr string, chain string, o long"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        plain = either_key_join(t, w, ["f", "t"], "addr", on_also=["chain"])
        dealt = either_key_join(t, w, ["f", "t"], "addr", on_also=["chain"], hot_copies=HOT_COPIES)
        assert dealt.columns == plain.columns
        assert plain.exceptAll(dealt).count() == 0 and dealt.exceptAll(plain).count() == 0
        per_task = sorted(r["n"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())
        assert per_task[-1] <= 2 * per_task[len(per_task) // 2]
        one = sorted(r["n"] for r in plain.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())
        assert one[-1] > 2 * one[len(one) // 2]
        hot = spark.range(1).select(frequent_keys(t, "f", 64)).head()[0]
        assert hot == ["hot"]
        empty = either_key_join(t.limit(0), w, ["f", "t"], "addr", on_also=["chain"], hot_copies=HOT_COPIES)
        assert empty.count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_interval_join_equals_theta_join(spark):
    df = _events(spark)
    a = df.select("id", "k", "ts")
    got = interval_join(a, a, ["k"], epoch_seconds("ts"), epoch_seconds("ts"), -599, 599)
    got = got.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
    l, r = a.alias("l"), a.alias("r")
    ref = l.join(r, (F.col("l.k") == F.col("r.k"))
                 & (F.abs(epoch_seconds(F.col("r.ts")) - epoch_seconds(F.col("l.ts"))) < 600)).select(
        F.col("l.id").alias("a"), F.col("r.id").alias("b"))
    assert rows(got) == rows(ref)
    semi = interval_join(a, a.withColumnRenamed("id", "rid"), ["k"], epoch_seconds("ts"), epoch_seconds("ts"), 1, 900,
                         how="left_semi")
    ref_semi = ref.join(a, (F.col("a") == F.col("id"))).select("a").distinct()
    ref_semi = l.join(r, (F.col("l.k") == F.col("r.k"))
                      & (epoch_seconds(F.col("r.ts")) - epoch_seconds(F.col("l.ts"))).between(1, 900),
                      "left_semi").select("id")
    assert rows(semi, "id") == rows(ref_semi, "id")


def test_rolling_equals_sql_range_frame(spark):
    df = _events(spark)
    h = 3_600_000_000
    got = rolling(df, ["k"], "ts", {"c1": (F.count(F.lit(1)), h), "s24": (F.sum("v"), 24 * h),
                                    "sd4": (F.stddev_samp("v"), 4 * h)}, slice_us=6 * h)
    df.createOrReplaceTempView("ev")
    ref = df.sparkSession.sql("""
      SELECT id, count(*) OVER (PARTITION BY k ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) c1,
             sum(v) OVER (PARTITION BY k ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) s24,
             stddev_samp(v) OVER (PARTITION BY k ORDER BY ts RANGE BETWEEN INTERVAL 4 HOURS PRECEDING AND CURRENT ROW) sd4
      FROM ev""")
    g = {r.id: (r.c1, r.s24, None if r.sd4 is None else round(r.sd4, 9)) for r in got.collect()}
    e = {r.id: (r.c1, r.s24, None if r.sd4 is None else round(r.sd4, 9)) for r in ref.collect()}
    assert g == e


def test_rows_frames_equal_sql(spark):
    df = _events(spark).withColumn("flag", (F.col("v") > 50).cast("int"))
    got = rows_sum(df, ["k"], "ts", ["id"], "flag", 10, "s", slice_us=3_600_000_000 * 6)
    got2 = rows_last_non_null(df, ["k"], "ts", ["id"], "x", 20, "lx", slice_us=3_600_000_000 * 6)
    df.createOrReplaceTempView("ev2")
    ref = df.sparkSession.sql("""
      SELECT id, sum(flag) OVER (PARTITION BY k ORDER BY ts, id ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) s,
             last_value(x, true) OVER (PARTITION BY k ORDER BY ts, id ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) lx
      FROM ev2""")
    assert rows(got, "id", "s") == rows(ref, "id", "s")
    assert sorted((r.id, r.lx) for r in got2.collect()) == sorted((r.id, r.lx) for r in ref.collect())


def test_asof_join_equals_brute_force(spark):
    rnd = random.Random(3)
    left = spark.createDataFrame([("L%d" % i, "a" if i % 3 else "b", T0 + timedelta(minutes=rnd.randrange(3000)))
                                  for i in range(200)], "lid string, k string, ts timestamp_ntz")
    right = spark.createDataFrame([("R%03d" % i, "a" if i % 2 else "b", T0 + timedelta(minutes=rnd.randrange(3000)), i)
                                   for i in range(150)], "rid string, k string, rts timestamp_ntz, val int")
    got = asof_join(left, right, ["k"], "ts", "rts", 3_600_000_000, ["val", "rid"], right_order=["rid"],
                    slice_us=2 * 3_600_000_000)
    l, r = left.alias("l"), right.alias("r")
    cand = l.join(r, (F.col("l.k") == F.col("r.k")) & (F.col("r.rts") <= F.col("l.ts"))
                  & (F.col("r.rts") >= F.col("l.ts") - F.expr("INTERVAL 1 HOUR")), "left")
    best = cand.groupBy("lid").agg(F.max_by("val", F.struct("rts", "rid")).alias("val"))
    assert rows(got.select("lid", F.col("asof_val").alias("val"))) == sorted(
        (r.lid, r.val) for r in best.collect())


def test_latest_by_null_time_never_wins(spark):
    df = spark.createDataFrame([("o1", None, "r9", "NULLTS"), ("o1", T0, "r1", "A"), ("o1", T0, "r2", "B"),
                                ("o2", None, "r3", "ONLY")], "k string, ts timestamp_ntz, rid string, v string")
    assert rows(latest_by(df, ["k"], ["ts", "rid"]), "k", "v") == [("o1", "B"), ("o2", "ONLY")]


def test_latest_by_stored_shuffles_repeated_keys_only(spark, tmp_path):
    new = spark.range(4000).select(F.concat(F.lit("k"), F.col("id")).alias("k"), (F.col("id") % 2).alias("c"),
                                   F.lit(T0).cast("timestamp_ntz").alias("ts"), F.lit("r1").alias("rid"), F.repeat(F.md5(F.col("id").cast("string")), 20).alias("v"))
    old = new.filter("c = 0 AND length(k) < 4").withColumn("rid", F.lit("r0"))
    late = new.filter("k = 'k8'").withColumn("ts", F.lit(None).cast("timestamp_ntz")).withColumn("rid", F.lit("r9"))
    no_key = new.filter("k = 'k8'").withColumn("k", F.lit(None).cast("string"))
    old.unionByName(new).unionByName(late).unionByName(no_key).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = latest_by_stored(df, ["k", "c"], ["ts", "rid"])
    assert out.columns == df.columns and rows(out) == rows(latest_by(df, ["k", "c"], ["ts", "rid"])) == rows(new)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("Exchange hashpartitioning") == 1  # of the repeated keys


def test_merge_upsert_idempotent(spark):
    tgt = spark.createDataFrame([("w1", "x", 1), ("w2", "y", 2)], "id string, a string, n int")
    src = spark.createDataFrame([("w2", "z", 9), ("w3", "q", 3)], "id string, a string, n int")
    upd = {"n": F.col("src.n")}
    once = merge_upsert(tgt, src, ["id"], update=upd)
    twice = merge_upsert(once, src, ["id"], update=upd)
    assert rows(once) == [("w1", "x", 1), ("w2", "y", 9), ("w3", "q", 3)]
    assert rows(twice) == rows(once)


def test_append_deduped_lookback_and_idempotence(spark):
    store = spark.createDataFrame([("h1", T0), ("h2", T0 - timedelta(days=3)), (None, T0)],
                                  "h string, ts timestamp_ntz")
    new = spark.createDataFrame([("h1", T0 + timedelta(hours=1), "b"), ("h2", T0 + timedelta(hours=1), "a"),
                                 ("h3", T0 + timedelta(hours=1), "z"), ("h3", T0 + timedelta(hours=1), "y")],
                                "h string, ts timestamp_ntz, nat string")
    lb = F.col("ts") - F.expr("INTERVAL 1 DAY")
    out = append_deduped(store, new, "h", "ts", lb, ["nat"])
    assert rows(out, "h", "nat") == [("h2", "a"), ("h3", "y")]
    again = append_deduped(store.unionByName(out.select("h", "ts")), out, "h", "ts", lb, ["nat"])
    assert again.count() == 0


def test_snapshot_diff(spark):
    b = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "k string, v string")
    a = spark.createDataFrame([("1", "a"), ("2", "B"), ("4", "d")], "k string, v string")
    assert rows(snapshot_diff(b, a, ["k"]), "k", "change_type", "v") == [
        ("2", "UPDATE", "B"), ("3", "DELETE", "c"), ("4", "INSERT", "d")]


def test_global_row_number_and_top_k(spark):
    df = _events(spark)
    n = global_row_number(df, [F.col("v").desc(), F.col("id")], "rn")
    ordered = [r.id for r in df.orderBy(F.col("v").desc(), "id").collect()]
    assert [r.id for r in n.orderBy("rn").collect()] == ordered
    assert sorted(r.rn for r in n.collect()) == list(range(1, len(ordered) + 1))
    top = top_k(df, ["k"], [F.col("v").desc(), F.col("id")], 5, salt_buckets=4, salt_col="id")
    df.createOrReplaceTempView("ev3")
    ref = spark.sql("SELECT id, k FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC, id) rn FROM ev3) "
                    "WHERE rn <= 5")
    assert rows(top, "id", "k") == rows(ref, "id", "k")


H = 3_600_000_000


def _partials_input(spark, n, key):
    rnd = random.Random(n)
    rows = []
    for i in range(n):
        # half of the times are shared by many rows, so frames have ties at both ends
        s = rnd.randrange(0, 200) * 900 if rnd.random() < 0.5 else rnd.randrange(0, 2 * 86400)
        rows.append((i, key(rnd), None if i % 97 == 0 else s, rnd.choice([None, 1.5, 1.5, 100.0, rnd.random() * 1000]), rnd.choice(["x", "y", None])))
    df = spark.createDataFrame(rows, "id int, k string, s long, v double, g string")
    return df.withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))


def test_rolling_partials_equal_range_frames(spark):
    """Every kind and frame against plain RANGE windows: ties, NULL values, NULL keys, rows without a time."""
    from tradewatch.operators.windows import rolling_partials
    df = _partials_input(spark, 1500, lambda r: r.choice(["a", "a", "a", "b", None]))
    specs, plain = {}, {}
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    for f in (1, 4, 24):
        w = Window.partitionBy("k").orderBy(us).rangeBetween(-f * H, 0)
        for kind, value, agg in (("count", F.lit(1), F.count(F.lit(1))), ("sum", F.col("v"), F.sum("v")), ("avg", F.col("v"), F.avg("v")), ("min", F.col("v"), F.min("v")),
                                 ("max", F.col("v"), F.max("v")), ("stddev", F.col("v"), F.stddev_samp("v")), ("distinct", F.col("g"), F.collect_set("g"))):
            specs[f"{kind}{f}"] = (kind, value, f * H)
            plain[f"{kind}{f}"] = F.size(agg.over(w)) if kind == "distinct" else agg.over(w)

    def found(d):
        return {r.id: tuple(round(x, 6) if isinstance(x, float) else x for x in (r[c] for c in specs)) for r in d.collect()}

    got = rolling_partials(df, ["k"], "ts", specs, H)
    assert got.columns == [*df.columns, *specs]
    assert found(got) == found(df.select("*", *[c.alias(n) for n, c in plain.items()]))


def test_rolling_partials_of_equal_values_deviate_by_zero(spark):
    from tradewatch.operators.windows import rolling_partials
    df = spark.range(500).select("id", F.lit("k").alias("k"), F.lit(0.1).alias("v"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"))
    out = rolling_partials(df, ["k"], "ts", {"sd": ("stddev", F.col("v"), 4 * H), "n": ("count", F.col("v"), 4 * H)}, H)
    assert max(r.sd for r in out.filter("n > 1").collect()) < 1e-12


def test_rolling_partials_have_no_bounded_frame_over_rows(spark):
    """Frames over rows run from one end; only frames over partials (one row a bucket) are bounded."""
    from tradewatch.operators.windows import rolling_partials
    df = _partials_input(spark, 10, lambda r: "a")
    plan = rolling_partials(df, ["k"], "ts", {"s": ("sum", F.col("v"), 24 * H)}, H)._jdf.queryExecution().executedPlan().toString()
    starts = re.findall(r"specifiedwindowframe\(RangeFrame, ([^,]+),", plan)
    assert {x for x in starts if "unboundedpreceding" not in x} == {"-23"} and len(starts) > 2
    with pytest.raises(ValueError):
        rolling_partials(df, ["k"], "ts", {"s": ("sum", F.col("v"), 90 * 60_000_000)}, H)
