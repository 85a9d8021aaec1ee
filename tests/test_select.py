import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import orderstat as O
from ledgerlens.operators import select as S
from ledgerlens.plans.modeling import ranked_outcomes

ODD = [0.0, -0.0, 1.0, -1.0, 0.1, 1 / 3, math.pi, 5e-324, -5e-324, 2.0**-1074 * 12345, 2.0**-1022, 2.2250738585072011e-308, 1.7976931348623157e308, -1.7976931348623157e308,
       float("inf"), float("-inf"), 2.0**52, 2.0**53 - 1, 1e-300, 8.0, 7.999999999999999, 1 - 2**-53, 1e22, 1e23]


def test_keys_sort_as_numbers_do(spark):
    r = random.Random(3)
    xs = ODD + [r.choice([-1, 1]) * math.ldexp(r.random(), r.randint(-1070, 1023)) for _ in range(3000)] + [math.ldexp(1.0, e) for e in range(-1074, 1024, 7)]
    rows = spark.createDataFrame([(x, x) for x in xs] + [(float("nan"),) * 2, (None, None)], "_g double, _x double")
    known = [(row["_g"], row["_k"]) for row in S.keyed(rows).collect()]
    assert len(known) == len(xs) and all(S.key_double(k) == x for x, k in known)
    known.sort()
    assert all((a[1] < b[1]) == (a[0] < b[0]) for a, b in zip(known, known[1:]))


def test_ranks_of_groups(spark):
    r = random.Random(5)
    data = {"a": [r.choice(ODD) for _ in range(500)], "b": [r.gauss(0, 1e-3) for _ in range(3000)], "c": [7.0] * 40, None: [1.0, 2.0], "far": [1e-300, 1e300, 0.0]}
    df = spark.createDataFrame([(g, x) for g, xs in data.items() for x in xs] + [("c", None), ("none", None), ("c", float("nan"))], "g string, x double").repartition(7)
    ps = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {x.g: x.quantiles for x in O.quantiles(df.where("not isnan(x) and x not in (double('inf'), double('-inf'))"), "x", ps, "g").collect()}
    data["a"] = [x for x in data["a"] if math.isfinite(x)]
    assert set(got) == set(data)
    for g, xs in data.items():
        assert np.allclose(got[g], np.quantile(xs, ps), rtol=1e-12, atol=0), g


def test_few_sums_move(spark, monkeypatch):
    monkeypatch.setattr(S, "FEW", 100)
    moved = []
    for n in (20_000, 1_000_000):
        rows = S.keyed(spark.range(n).select(F.lit(0).alias("_g"), (F.rand(7) * 1000).alias("_x")))
        got = S.select_ranks(rows, lambda total: [total // 2, total // 3])
        moved.append(got.sums)
        assert abs(S.key_double(got.at[0][n // 2][0]) - 500) < 25
    # fifty times the different values, no more than a few times the sums
    assert moved[1] < 3 * moved[0] and moved[1] < 8000


def test_more_groups_than_the_driver_takes(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUPS", 10)
    df = spark.range(400).select((F.col("id") % 40).alias("g"), (F.col("id") * 1.5).alias("x"))
    got = {r.g: r.quantiles[0] for r in O.quantiles(df, "x", [0.5], "g").collect()}
    assert got == {g: statistics.median(1.5 * i for i in range(g, 400, 40)) for g in range(40)}
    with pytest.raises(ValueError):
        O.sample_n(df, 2, 1, "x", by="g")


def test_unclamped_sample_raises(spark):
    df = spark.range(10).withColumn("g", F.col("id") % 2)
    with pytest.raises(ValueError, match="fewer than"):
        O.sample_n(df, 11, 1, "id")
    with pytest.raises(ValueError, match="fewer than"):
        O.sample_n(df, 6, 1, "id", by="g")
    with pytest.raises(ValueError, match="fewer than"):
        O.sample_n(df.limit(0), 1, 1, "id")
    assert O.sample_n(df, 11, 1, "id", clamp=True).count() == 10 and O.sample_n(df, 0, 1, "id").count() == 0
    assert O.sample_n(df.limit(0), 3, 1, "id", clamp=True).count() == 0
    first, again = ({r.id for r in O.sample_n(d, 4, 1, "id").collect()} for d in (df, df.repartition(3)))
    assert first == again and len(first) == 4


@pytest.fixture(scope="module")
def restless(spark):
    """240,000 rows whose order inside their partitions is another one each time they are computed."""

    def shuffled(batches):
        for pdf in batches:
            yield pdf.sample(frac=1.0, random_state=np.random.default_rng())

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000000")
    rows = spark.range(240_000, numPartitions=1).select((F.pmod(F.col("id") * 48271, F.lit(239_977)) / 7.0).alias("x"), (F.col("id") % 2).alias("g"))
    yield rows.mapInPandas(shuffled, rows.schema)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_bounds_are_the_same_in_a_whole_plan(restless):
    """Approximate quantiles depend on the order of rows; offsets and running sums need the same ones."""
    pdf = restless.toPandas().sort_values(["g", "x"])
    want = {(g, x): c for g, x, c in zip(pdf["g"], pdf["x"], pdf.groupby("g")["x"].rank(method="max", pct=True), strict=True)}
    got = O.ecdf(restless, "x", "g").collect()
    assert len(got) == len(want) and all(abs(r.cumulative - want[r.g, r.value]) < 1e-9 for r in got)
    thin = O.ecdf(restless, "x", "g", max_points=1000).collect()
    assert 1990 <= len(thin) <= 2010 and all(abs(r.cumulative - want[r.g, r.value]) < 1e-9 for r in thin)


def test_bounds_of_outcomes_are_the_same(restless):
    pdf = restless.toPandas()
    pdf = pdf.groupby("x")["g"].agg(["sum", "count"]).sort_index(ascending=False).cumsum()
    got = ranked_outcomes(restless, "g", "x", "x").collect()
    assert len(got) == len(pdf) and all((r.tp, r.tp + r.fp) == tuple(pdf.loc[r.threshold]) for r in got)
    assert ranked_outcomes(restless.limit(0), "g", "x").isEmpty()
