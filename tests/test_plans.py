import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.plans import fixtures, modeling, report
from ledgerlens.plans.pipeline import profile_gold, profile_raw, run_cleaning, to_gold, with_event_time
from ledgerlens.sources.io import read_transactions, verify_gold, write_gold
from ledgerlens.spec import GOLD, GOLD_SCHEMA, RAW, RAW_SCHEMA

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def dirty(spark):
    return fixtures.dirty(spark, SF).cache()


@pytest.fixture(scope="module")
def csv(spark, dirty, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("raw") / "t.csv")
    dirty.write.csv(path, header=True)
    return path


def test_cleaning_end_to_end(spark, dirty, csv, tmp_path):
    gold, rep = str(tmp_path / "gold"), str(tmp_path / "report")
    for run in (1, 2):  # the second run's versions follow the first's
        p = run_cleaning(spark, csv, gold, rep)
        assert [r.ok for r in p.checks.collect()] == [True] * 4 and p.snapshot.version == run
    assert p.gold.columns == list(RAW.gold)
    assert sorted(map(tuple, p.gold.collect()), key=repr) == sorted(map(tuple, to_gold(dirty).collect()), key=repr)
    stats = {r.metric: r.value for r in p.report.where("section = 'cleaning'").collect()}
    assert stats["initial_rows"] == stats["duplicate_rows_removed"] + stats["invalid_amount_rows"] + stats["invalid_timestamp_rows"] + stats["final_rows"]
    assert sorted(os.listdir(tmp_path)) == ["gold", "report"]


def test_gold_as_csv(spark, dirty, tmp_path):
    path = write_gold(to_gold(dirty), str(tmp_path / "g"), fmt="csv")
    back = read_transactions(spark, path, GOLD_SCHEMA)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, to_gold(dirty).collect()), key=repr)
    assert verify_gold(spark, path, {"rows": back.count()}, "is_fraud", fmt="csv").first().ok


def test_other_drafts_stay(spark, dirty, tmp_path):
    path, rows = str(tmp_path / "g"), to_gold(dirty).limit(5)
    other = tmp_path / "g__staging" / "another run"
    other.mkdir(parents=True)
    for _ in range(2):
        write_gold(rows, path)
        assert other.exists() and sorted(os.listdir(tmp_path)) == ["g", "g__staging"]


def test_difficult_csv(spark, dirty, tmp_path):
    """Separators, quotes, line breaks and backslashes in fields, written and read; a reader by lines for files without them."""
    odd = ['x "y", z', "one\ntwo\r\nthree", "ends in \\", '"', '""', ",", "\\\"", " spaces "]
    gold = to_gold(dirty).limit(400).withColumn("device_used", F.element_at(F.array(*[F.lit(x) for x in odd]), (F.pmod(F.hash("transaction_id"), F.lit(len(odd))) + 1).cast("int")))
    gold = spark.createDataFrame(gold.collect(), gold.schema)
    path = write_gold(gold, str(tmp_path / "odd"), fmt="csv")
    want = sorted(map(tuple, gold.collect()), key=repr)
    assert sorted(map(tuple, read_transactions(spark, path, GOLD_SCHEMA).collect()), key=repr) == want and len({r[5] for r in want}) == len(odd)
    plain = write_gold(gold.withColumn("device_used", F.lit('a "b", c\\')), str(tmp_path / "plain"), fmt="csv")
    assert {r.device_used for r in read_transactions(spark, plain, GOLD_SCHEMA, multiline=False).collect()} == {'a "b", c\\'}
    assert verify_gold(spark, path, {"rows": len(want), "columns": 13}, "is_fraud", fmt="csv").where("not ok").isEmpty()


def _file(tmp_path, header, rows):
    p = tmp_path / "f.csv"
    p.write_text("\n".join([",".join(header), *(",".join(r) for r in rows)]) + "\n")
    return str(p)


ROW = {"transaction_id": "T1", "timestamp": "2023-08-22T09:22:43.516168", "sender_account": "A", "receiver_account": "B", "amount": "16", "transaction_type": "NA", "merchant_category": "null",
       "location": "-", "device_used": "mobile", "is_fraud": "FALSE", "fraud_type": "", "time_since_last_transaction": "nan", "spending_deviation_score": "-0.21", "velocity_score": "3",
       "geo_anomaly_score": "0.22", "payment_channel": "card", "ip_address": "1.2.3.4", "device_hash": "D1"}


def test_reading(spark, tmp_path):
    names = list(ROW)
    for header in (names, names[::-1]):
        r = read_transactions(spark, _file(tmp_path, header, [[ROW[c] for c in header]]), RAW_SCHEMA).first()
        assert (r.amount, r.is_fraud, r.transaction_type, r.merchant_category, r.location, r.time_since_last_transaction, r.velocity_score) == (16.0, False, None, None, "-", None, 3)
    for header in (names[1:], [*names, "more"], ["other", *names[1:]]):
        with pytest.raises(ValueError, match="columns"):
            read_transactions(spark, _file(tmp_path, header, []), RAW_SCHEMA)
    bad = _file(tmp_path, names, [[ROW[c] if c != "velocity_score" else "70000" for c in names]])
    for ansi in ("true", "false"):  # strict in either mode
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            with pytest.raises(Exception, match="unreadable smallint in velocity_score: 70000"):
                read_transactions(spark, bad, RAW_SCHEMA).collect()
        finally:
            spark.conf.unset("spark.sql.ansi.enabled")
    r = read_transactions(spark, bad, RAW_SCHEMA, mode="PERMISSIVE", corrupt="_corrupt_record").first()
    assert r.velocity_score is None and "70000" in r._corrupt_record
    short = _file(tmp_path, names, [[ROW[c] for c in names[:5]], [ROW[c] for c in names]])
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        read_transactions(spark, short, RAW_SCHEMA).collect()
    assert [x.location for x in read_transactions(spark, short, RAW_SCHEMA, mode="PERMISSIVE").collect()] == [None, "-"]
    bad = _file(tmp_path, names, [[ROW[c] if c != "velocity_score" else "70000" for c in names]])
    assert read_transactions(spark, bad, RAW_SCHEMA, preview=5).first().velocity_score == "70000"
    with pytest.raises(FileNotFoundError):
        read_transactions(spark, str(tmp_path / "none"), RAW_SCHEMA)


def test_profiles_run(spark, dirty):
    for d in (profile_raw(dirty), profile_gold(to_gold(dirty))):
        assert all(isinstance(v.count(), int) for v in d.values())
    assert report.findings(with_event_time(dirty), GOLD).where("value is not null").count() == 14
    assert report.observations(dirty, RAW).count() == 22 and report.observations(dirty.limit(0), RAW).count() == 22
    told = {r.metric: r.action for r in report.advice(dirty, RAW, raw=True).collect()}
    assert "repeats.rows" in told and "amount.negative" in told
    clean = to_gold(dirty).withColumn("fraud_type", F.lit(None).cast("string"))
    assert "amount.negative" not in {r.metric for r in report.advice(clean, GOLD).collect()}
    assert report.advice(dirty, RAW, (("size.rows", "<", 1.0, "never"),), raw=True).isEmpty()
    n = sum(r.row_count for r in report.series_hour_weekday(to_gold(dirty), GOLD).collect())
    assert n == to_gold(dirty).count()


def test_splits_never_part_equal_times(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(100)], "i int, d int").withColumn("event_timestamp", F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,d)"))
    s = modeling.time_split(df, GOLD)
    assert s.groupBy("event_timestamp").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    assert s.select("split").distinct().count() == 3


def test_evaluation_agrees_with_plain_numbers(spark):
    rows = [(0.9, 1, 10.0), (0.8, 0, 1.0), (0.8, 1, 5.0), (0.3, 0, 1.0), (0.2, 1, 7.0), (0.1, 0, None)]
    df = spark.createDataFrame(rows, "score double, y int, v double")
    m = {r.metric: r.value for r in modeling.evaluate(df, "y").collect()}
    pairs = [(a > b) + 0.5 * (a == b) for a, y, _ in rows if y for b, z, _ in rows if not z]
    assert m["roc_auc"] == pytest.approx(sum(pairs) / len(pairs)) and (m["tp"], m["fp"], m["fn"], m["tn"]) == (2, 1, 1, 2)
    assert m["pr_auc"] == pytest.approx((1 / 1 + 2 / 3 + 3 / 5) / 3)
    c = {r.threshold: r.cost for r in modeling.threshold_cost(df, "y", "v", 2.0).collect()}
    assert c == pytest.approx({0.9: 12.0, 0.8: 9.0, 0.3: 11.0, 0.2: 4.0, 0.1: 6.0})
    assert modeling.best_threshold(modeling.threshold_cost(df, "y", "v", 2.0)).first().threshold == 0.2


def test_models(spark, dirty, tmp_path):
    gold = modeling.time_split(to_gold(dirty), GOLD)
    for kind, select in (("logistic", 5), ("boosted", None)):
        model = modeling.fit(gold.where("split = 'train'"), GOLD, kind, select=select)
        out = modeling.score(model, gold.where("split = 'test'"), GOLD)
        assert out.where("score < 0 or score > 1").isEmpty() and not out.isEmpty()
    m = modeling.evaluate(out, "is_fraud")
    rules = spark.createDataFrame([("roc_auc", "<", 2.0, "not good enough")], "metric string, op string, bound double, reason string")
    g = modeling.gate(m, rules).first()
    assert not g.passed and g.reasons == ["not good enough"]
    modeling.log_run(spark, str(tmp_path / "runs"), "r1", m, {"kind": kind})
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 10


def test_balance(spark, dirty):
    g = to_gold(dirty)
    w = modeling.class_weights(g, GOLD).groupBy("is_fraud").agg(F.sum("weight").alias("w")).collect()
    assert w[0].w == pytest.approx(w[1].w)
    o = modeling.oversample(g, GOLD, 0.3).agg(F.avg("is_fraud").alias("p")).first().p
    assert 0.2 < o < 0.4


def test_drift_of_the_same_rows_is_none(spark, dirty):
    for r in modeling.drift(dirty, dirty, ["amount", "velocity_score"]).collect():
        assert r.psi == pytest.approx(0) and r.ecdf_gap == pytest.approx(0)


def test_queries_and_sql_have_the_same_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
