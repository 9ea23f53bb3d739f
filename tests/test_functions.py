from datetime import date

from pyspark.sql import functions as F

from tradewatch.functions.risk import rule_score, severity_rank
from tradewatch.functions.text import mask_dob, mask_email, mask_full_name, mask_phone
from tradewatch.functions.timefn import boundary_diff


def test_boundary_diff_counts_boundaries(spark):
    df = spark.createDataFrame(
        [("2024-01-01 00:59:00", "2024-01-01 01:01:00"), ("2024-01-01 01:00:00", "2024-01-01 01:59:59"),
         ("2024-01-01 02:00:00", "2024-01-01 00:30:00"), ("2024-01-01 00:00:59.999", "2024-01-01 00:01:00")],
        "a string, b string").select(F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    out = df.select(boundary_diff("hour", "a", "b").alias("h"), boundary_diff("second", "a", "b").alias("s")).collect()
    assert [r.h for r in out] == [1, 0, -2, 0]
    assert out[3].s == 1


def test_masks_by_role(spark):
    df = spark.createDataFrame([("A", "a@x.io", "+1 555 0100", date(1980, 5, 6)),
                                ("Abcdef", "abcd@x.io", "555 12", date(1999, 12, 31)),
                                (None, None, None, None)],
                               "n string, e string, p string, d date")

    def run(role):
        return df.select(mask_full_name("n", role).alias("n"), mask_email("e", role).alias("e"),
                         mask_phone("p", role).alias("p"), mask_dob("d", role).alias("d")).collect()

    admin = run("SURVEILLANCE_ADMIN")
    assert admin[1].n == "Abcdef" and admin[1].e == "abcd@x.io"
    analyst = run("SURVEILLANCE_ANALYST")
    assert analyst[0].n == "A" and analyst[1].n == "A*****"
    assert analyst[0].e == "a@x.io"          # one character before '@': pattern needs two
    assert analyst[1].e == "abc***@x.io"
    assert analyst[0].p == "+* *** ****"
    assert analyst[0].d == date(1980, 1, 1)
    assert analyst[2].n is None
    other = run("SURVEILLANCE_ML")
    assert {r.n for r in other} == {"***REDACTED***"} and {r.e for r in other} == {"***REDACTED***"}
    for r, src in zip(other, df.collect()):
        if src.n:
            assert r.n != src.n and r.e != src.e


def test_rule_score_caps_and_terms(spark):
    df = spark.createDataFrame(
        [(6, 0, 0.0, False, False, False, False, False),     # burst cap 0.3
         (7, 0, 0.0, False, False, False, False, False),
         (0, 3, 0.0, False, False, False, False, False),     # 0.45 capped at 0.4
         (0, 0, 100.0, None, False, False, False, False),    # 0.1, NULL pep counts as no
         (10, 10, 5000.0, True, True, True, True, True)],    # sum > 1 -> 1.0
        "b long, m long, s double, pep boolean, san boolean, me boolean, se boolean, bb boolean")
    out = [r.x for r in df.select(rule_score("b", "m", "s", "pep", "san", "me", "se", "bb").alias("x")).collect()]
    assert out == [0.3, 0.3, 0.4, 0.1, 1.0]


def test_severity_rank_is_not_alphabetical(spark):
    df = spark.createDataFrame([("MEDIUM",), ("CRITICAL",), ("LOW",), ("HIGH",), ("X",)], "s string")
    out = df.select("s", severity_rank("s").alias("r")).orderBy("r").collect()
    assert [r.s for r in out] == ["CRITICAL", "HIGH", "MEDIUM", "LOW", "X"]


def test_raw_amount_scaled_by_decimals(spark):
    from tradewatch.plans.harmonise import parse_onchain
    raw = spark.createDataFrame([
        ("r1", '{"tx_hash":"a","chain":"ethereum","value_raw":"1234500000000000000000","decimals":18}'),
        ("r2", '{"tx_hash":"b","chain":"ethereum","value_raw":"5","decimals":2,"value_decimal":7.5}'),
        ("r3", '{"tx_hash":"c","chain":"ethereum","value_decimal":"not a number"}'),
    ], "_record_id string, payload string")
    got = {r.tx_hash: r.value_decimal for r in parse_onchain(raw).collect()}
    assert got == {"a": 1234.5, "b": 7.5}       # c is a dead letter (type mismatch)


def test_column_tags_and_jsonl_export(spark, tmp_path):
    from tradewatch.plans.governance import tag_columns
    from tradewatch.sources.raw import export_jsonl
    df = spark.createDataFrame([("E1", "Ann", "a@x.io")], "entity_id string, full_name string, email string")
    t = tag_columns(df, "entity")
    assert t.schema["full_name"].metadata == {"DATA_SENSITIVITY": "RESTRICTED", "REGULATORY": "KYC", "PII": "name"}
    assert t.schema["entity_id"].metadata["REGULATORY"] == "KYC"
    out = str(tmp_path / "all.jsonl")
    export_jsonl({"entities": df, "other": spark.createDataFrame([(1,)], "n int")}, out)
    back = spark.read.json(out)
    assert back.count() == 2 and set(back.columns) >= {"_feed", "entity_id", "n"}


def test_json_stage_outer_array_and_partitioned_append(spark, tmp_path):
    from tradewatch.sources.raw import TRADE_PAYLOAD, read_json_files, write_feed
    d = tmp_path / "stage"
    d.mkdir()
    (d / "a.json").write_text('[{"trade_id": "1", "account_id": "A", "price": 1.5},\n'
                              ' {"trade_id": "2", "account_id": "B", "price": 2.5}]')
    (d / "b.json").write_text('{"trade_id": "3", "price": "x"')          # broken file
    df = read_json_files(spark, str(d), TRADE_PAYLOAD, multiline=True)
    good = df.filter("_corrupt IS NULL")
    assert sorted(r.trade_id for r in good.collect()) == ["1", "2"]
    # (a query touching only the corrupt column is rejected by Spark; select another one too)
    assert len(df.filter("_corrupt IS NOT NULL").select("_corrupt", "trade_id").collect()) == 1
    assert all(r._file_name.endswith("a.json") for r in good.collect())
    env = spark.createDataFrame([("r1", "2024-01-01 00:00:00", "s3", "FILE", None, None, "{}")],
                                "_record_id string, _load_ts string, _source string, _ingest_method string, "
                                "_partition_key string, _file_name string, payload string") \
        .selectExpr("*", "CAST(_load_ts AS timestamp_ntz) AS lt").drop("_load_ts").withColumnRenamed("lt", "_load_ts")
    out = str(tmp_path / "raw")
    write_feed(env, out)
    write_feed(env, out)
    back = spark.read.parquet(out)
    assert back.count() == 2 and "event_date" in back.columns


def test_enrich_gives_replay_stable_ids(spark):
    from tradewatch.sources.raw import enrich
    df = spark.createDataFrame([("1", 2.5, "f1.json"), ("1", 2.5, "f2.json")], "trade_id string, price double, _file_name string")
    a = enrich(df, "s3", "FILE", "trade_id").collect()
    b = enrich(df, "s3", "FILE", "trade_id").collect()
    assert [r._record_id for r in a] == [r._record_id for r in b]
    assert a[0]._record_id != a[1]._record_id          # same payload, other file
    assert a[0].payload == '{"trade_id":"1","price":2.5}' and a[0]._partition_key == "1"
