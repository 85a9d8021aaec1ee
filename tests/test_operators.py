import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import columns as K
from ledgerlens.operators import clean as C
from ledgerlens.operators import orderstat as O
from ledgerlens.operators import profile as P
from ledgerlens.operators import risk as R
from ledgerlens.operators.schema import check_schema, schema_differences, schema_profile, select_gold
from ledgerlens.spec import RAW, RAW_SCHEMA, TableSpec

S = TableSpec(target="y", timestamp="t", id="i", amount="x", kind="k", numerics=("x", "z"), categoricals=("k", "m"), identifiers=("i",), suspects=("z",), incomplete="z")


def _rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def _col(spark, values, kind="double", name="x"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


@pytest.fixture(scope="module")
def t(spark):
    rows = [(1, "2024-01-01T00:10:00", 1.0, 5.0, "a", "p", 0), (2, "2024-01-02T01:00:00.5", 2.0, None, "a", None, 1), (3, "2024-01-09", 3.0, 1.0, "b", "p", 0),
            (4, "2024-01-31 05:00", None, 2.0, None, "q", 1), (5, None, 4.0, None, "b", "q", None), (5, "nope", -1.0, 0.0, "b", "q", 0)]
    return spark.createDataFrame(rows, "i long, t string, x double, z double, k string, m string, y int").cache()


def test_schema_contract(spark):
    names = RAW_SCHEMA.names
    assert check_schema(reversed(names), names) == {"missing": [], "unexpected": []}
    for bad in (names[1:], [*names, "more"], ["other", *names[1:]]):
        with pytest.raises(ValueError, match="columns"):
            check_schema(bad, names)
    df = spark.createDataFrame([], RAW_SCHEMA).withColumnRenamed("amount", "amt")
    assert _rows(schema_differences(df, names)) == [("missing", "amount"), ("unexpected", "amt")]


def test_select_gold(spark):
    df = spark.createDataFrame([], RAW_SCHEMA).withColumn("event_timestamp", F.lit(None).cast("timestamp_ntz"))
    g = select_gold(df, RAW)
    assert g.columns == list(RAW.gold) and dict(g.dtypes)["is_fraud"] == "tinyint"


def test_negative_keeps_missing(spark):
    df = spark.createDataFrame([(1.0, "2024-01-01"), (None, "2024-01-01"), (-1.0, "2024-01-01")], "x double, t string")
    assert _rows(C.clean(df, S, out="e"), "x") == [(1.0,), (None,)]


def test_nan_is_missing(spark):
    assert _rows(C.normalise(_col(spark, [float("nan"), 1.0]))) == [(1.0,), (None,)]


def test_null_tokens(spark):
    df = _col(spark, ["NA", "null", "nan", "<NA>", "", "-", "None"], "string")
    assert _rows(df.select(K.no_token(F.col("x")))) == sorted([("-",)] + [(None,)] * 6, key=repr)


def test_iso(spark):
    v = ["2023-08-22T09:22:43.516168", "2023-08-22 09:22", "2023-08-22", "2023-08", "22/08/2023", "12:30", "T12:30", "20230822", "2023-08-22T09:22:43+02:00", " 2023-08-22", "2023-13-01", None]
    got = [r[0] for r in _col(spark, v, "string").coalesce(1).select(K.parse_iso(F.col("x"))).collect()]
    assert got[:4] == [dt.datetime(2023, 8, 22, 9, 22, 43, 516168), dt.datetime(2023, 8, 22, 9, 22), dt.datetime(2023, 8, 22), dt.datetime(2023, 8, 1)]
    assert got[4:] == [None] * 8


def test_cleaning_counts_in_order(spark):
    rows = [(1.0, "2024-01-01")] * 3 + [(-1.0, "bad")] * 2 + [(2.0, "bad"), (None, "2024-01-02")]
    df = spark.createDataFrame(rows, "x double, t string")
    assert tuple(C.cleaning_stats(df, S).first()) == (7, 3, 1, 1, 2)
    assert C.clean(df, S, out="e").count() == 2
    assert tuple(C.cleaning_stats(df.limit(0), S).first()) == (0, 0, 0, 0, 0)


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "c")], "i long, v string")
    assert C.duplicate_count(df).first()[0] == 1 and C.duplicate_count(df, ["i"]).first()[0] == 2 and C.duplicate_count(df.limit(0)).first()[0] == 0


@pytest.mark.parametrize(("values", "q"), [([1, 1, 1, 2, 3, 4, 5, 6, 7, 8, None], 4), ([0.1] * 5 + [0.9], 4), ([1, 1, 1], 4), ([i / 10 for i in range(101)], 20), ([None, None], 3), ([5], 2), ([3, 1, 2] * 40, 10)])
def test_quantile_bins_are_those_of_pandas(spark, values, q):
    df = _col(spark, [None if v is None else float(v) for v in values])
    got = sorted(((r.x, r.b) for r in O.quantile_bin(df, "x", q, "b").collect()), key=repr)
    s = pd.Series(values, dtype="float64")
    try:
        bins = pd.qcut(s, q, labels=False, duplicates="drop")
    except (ValueError, IndexError):
        bins = pd.Series([None] * len(s))
    want = sorted(((None if math.isnan(a) else a, None if pd.isna(b) else int(b)) for a, b in zip(s, bins, strict=True)), key=repr)
    assert got == want


def test_kernel(spark):
    v = [float((i * 37) % 101) for i in range(1000)] + [None, float("nan")]
    df = _col(spark, v).withColumn("g", F.when(F.col("x") > 50, "hi").otherwise("lo"))
    s = pd.Series([a for a in v if a is not None and not math.isnan(a)])
    p = [0.0, 0.01, 0.37, 0.5, 0.99, 1.0]
    assert O.quantiles(df, "x", p).first()[0] == pytest.approx(s.quantile(p).tolist(), abs=1e-12)
    e = _rows(O.ecdf(df, "x"))
    assert e[-1][1] <= 1 and len(e) == s.nunique() and max(c for _, c in e) == 1.0
    assert dict(e) == pytest.approx({k: (s <= k).mean() for k in s.unique()})
    assert O.ecdf(df, "x", max_points=10).count() <= 12
    assert {r.g for r in O.ecdf(df, "x", "g").collect()} == {"hi", "lo"}
    assert _rows(O.ecdf(df.repartition(7), "x", "g")) == _rows(O.ecdf(df.coalesce(1), "x", "g"))
    assert O.quantiles(df.limit(0), "x", p).count() == 0


def test_histogram(spark):
    h = _rows(O.histogram(_col(spark, [0.0, 1.0, 5.0, 10.0, None]), "x", 5))
    assert [(r[0], r[3]) for r in h] == [(1, 2), (3, 1), (5, 1)]
    assert [(r[0], r[3]) for r in _rows(O.histogram(_col(spark, [2.0, 2.0]), "x", 5))] == [(1, 2)]


def test_samples(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    a = {r.id for r in O.sample_n(df, 100, 42, "id").collect()}
    assert len(a) == 100 and a == {r.id for r in O.sample_n(df.repartition(9), 100, 42, "id").collect()} and a != {r.id for r in O.sample_n(df, 100, 1, "id").collect()}
    assert O.sample_n(df, 50, 7, "id", by="g").groupBy("g").count().where("count <> 50").isEmpty()
    with pytest.raises(ValueError, match="fewer"):
        O.sample_n(df, 1001, 1, "id")
    assert O.sample_n(df, 1001, 1, "id", clamp=True).count() == 1000
    same = spark.createDataFrame([(1,)] * 10, "id long")
    assert O.sample_n(same, 4, 1, "id").count() == 4


def test_profiles(t):
    assert _rows(P.class_distribution(t, S)) == [(0, 3, 50.0), (1, 2, pytest.approx(100 / 3))]
    assert dict((r.column, r.missing_count) for r in P.missing_summary(t).collect()) == {"i": 0, "t": 1, "x": 1, "z": 2, "k": 1, "m": 1, "y": 1}
    assert P.missing_total(t).first()[0] == 7
    assert _rows(P.cardinality(t, ["i", "k"])) == [("i", 5, pytest.approx(5 / 6), 1), ("k", 2, pytest.approx(1 / 3), 3)]
    prof = {r.column: r for r in schema_profile(t).collect()}
    assert prof["k"].unique_count == 2 and prof["x"].dtype == "double"
    assert ("k", None, 1, 1, pytest.approx(100 / 6), 1.0) in _rows(P.category_profile(t, S))
    assert ("k", None) not in _rows(R.category_rates(t, S), "feature", "category")
    over = {r.metric: r.value for r in P.overview(t, S).collect()}
    assert (over["rows"], over["invalid_timestamps"], over["duplicate_ids"], over["negative_amount_rows"]) == ("6", "2", "1", "1")
    assert _rows(P.type_summary(t, S, "k"), "k", "row_count", "amount_median") == [("a", 2, 1.5), ("b", 3, 3.0)]
    assert _rows(P.rate_by_time(t, S, "weekday"), "weekday", "row_count") == [(0, 1), (1, 2), (2, 1)]
    assert {r.column for r in P.missing_by_class(t, S).collect()} == {"t", "x", "z", "k", "m"}
    assert _rows(P.presence_by_class(t, S, ["z"]), "y", "present") == [(0, 3), (1, 1)]
    assert _rows(P.missingness_bias(t, S, "z"), "status", "row_count", "positive_count") == [("missing", 2, 1), ("observed", 4, 1)]


def test_describe(spark, t):
    d = {r.feature: r for r in P.describe(t, ["x", "z"], [0.25, 0.5]).collect()}
    s = pd.Series([1.0, 2.0, 3.0, 4.0, -1.0]).describe(percentiles=[0.25, 0.5])
    assert (d["x"]["count"], d["x"]["mean"], d["x"]["std"], d["x"].p25, d["x"].p50, d["x"]["max"]) == pytest.approx((5, s["mean"], s["std"], s["25%"], s["50%"], s["max"]))
    assert P.describe(_col(spark, [1.0]), ["x"], [0.5]).first()["std"] is None


def test_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0), (2.0, None, 7.0), (3.0, 5.0, 7.0), (None, 9.0, 7.0), (4.0, 4.0, 7.0)], "a double, b double, c double")
    r = {(x.a, x.b): x.r for x in R.correlation(df, ["a", "b", "c"]).collect()}
    assert r["a", "b"] == pytest.approx(0.7857142857142858) == r["b", "a"] and r["a", "c"] is None and r["a", "a"] == pytest.approx(1)
    assert R.strongest(R.correlation(df, ["a", "b", "c"]), "b").first()["a"] == "a"


def test_lift_of_no_positives(spark):
    df = spark.createDataFrame([(float(i), 0) for i in range(10)], "x double, y int")
    assert {r.lift for r in R.quantile_lift(df, S, "x", 5).collect()} == {None}
    assert R.quantile_lift(df.limit(0), S, "x", 5).count() == 0


def test_wilson(spark):
    low, high = K.wilson(F.col("f"), F.col("n"))
    rows = spark.createDataFrame([(0, 5), (5, 5), (1, 3), (0, 0)], "f long, n long").select("n", low.alias("lo"), high.alias("hi"), (F.try_divide("f", "n")).alias("p")).collect()
    for r in rows:
        if r.n:
            assert -1e-12 <= r.lo <= r.p + 1e-12 and r.p - 1e-12 <= r.hi <= 1 + 1e-12
        else:
            assert r.lo is None


def test_weeks_count_rows_not_calendar(spark):
    days = ["2024-01-01", "2024-01-08", "2024-01-29", "2024-02-05", "2024-02-12"]
    df = spark.createDataFrame([(dt.datetime.fromisoformat(d), y) for d, y in zip(days, [1, 0, 1, 0, 0], strict=True)], "t timestamp_ntz, y int")
    got = [r.rolling_percent for r in R.weekly_stability(df, S).orderBy("week").collect()]
    assert got == pytest.approx(pd.Series([100.0, 0, 100, 0, 0]).rolling(4, min_periods=1).mean().tolist())


def test_surface(spark):
    df = spark.createDataFrame([(0, 1, 1), (0, 1, 0), (1, 2, 0), (None, 1, 1)], "a int, b int, y int")
    assert _rows(R.rate_surface(df, S, F.col("a"), F.col("b"), ("a", "b"))) == [(0, 1, 2, 50.0), (1, 2, 1, 0.0)]
    assert R.rate_surface(df, S, F.col("a"), F.col("b"), ("a", "b"), wide=[1, 2]).columns == ["a", "1", "2"]


def test_whole_row_duplicates_and_distinct_values(spark):
    from ledgerlens.operators.clean import duplicate_count
    from ledgerlens.operators.profile import cardinality
    from ledgerlens.operators.schema import schema_profile

    rows = [(1, "a", None, 0.0), (1, "a", None, -0.0), (1, None, "a", 0.0), (None, None, None, None), (None, None, None, None), (2, "b", "c", 1.5)]
    df = spark.createDataFrame(rows, "i int, s string, t string, x double")
    assert duplicate_count(df).first().duplicates == 2 and duplicate_count(df.limit(0)).first().duplicates == 0
    got = {r.column: (r.dtype, r.missing_count, r.unique_count) for r in schema_profile(df).collect()}
    assert got == {"i": ("int", 2, 2), "s": ("string", 3, 2), "t": ("string", 4, 2), "x": ("double", 2, 2)}
    assert {r.column: r.unique_count for r in schema_profile(df, approx=True).collect()} == {k: v[2] for k, v in got.items()}
    assert sorted(r.column for r in schema_profile(df.limit(0)).collect()) == ["i", "s", "t", "x"]
    assert [(r.unique_count, r.repeated_non_missing_values) for r in cardinality(df, ["s"]).collect()] == [(2, 1)]
