"""Expectations with quarantine, rolling folds, sketches, and batches against what is published."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import expectations as E
from ledgerlens.operators import sketches as K
from ledgerlens.plans import modeling
from ledgerlens.plans.folds import block_statistics, fold_selection, rolling_folds
from ledgerlens.sources.known import KnownKeys
from ledgerlens.spec import TableSpec


def test_rules(spark):
    rows = [(1, 5.0, "a", 2.0), (2, -1.0, "b", 2.0), (3, float("nan"), "z", 1.0), (4, None, None, 3.0), (4, 20.0, "a", None), (None, 5.0, "a", 9.0), (None, 5.0, "b", 1.0)]
    df = spark.createDataFrame(rows, "id int, x double, c string, y double")
    rules = [E.in_range("x", 0.0, 10.0), E.in_domain("c", ("a", "b")), E.present("c"), E.in_order("x", "y"), E.matches("c", "^[a-c]$"), E.nulls_at_most("x", 20.0), E.nulls_at_most("y", 10.0), E.unique("id")]
    got = {r.rule: (r.rows, r.broken, r.passed) for r in E.judge(df, rules).collect()}
    assert got == {"x in range": (7, 3, False), "c in domain": (7, 1, False), "c present": (7, 1, False), "x up to y": (7, 3, False), "c matches": (7, 1, False),
                   "x nulls": (7, 1, True), "y nulls": (7, 1, False), "id unique": (7, 2, False)}
    good, bad = E.quarantine(df, rules)
    told = sorted((r.id or 0, r.broken_rules) for r in bad.collect())
    assert good.columns == df.columns and [r.id for r in good.collect()] == [] or good.where("x < 0 or x > 10 or c is null").isEmpty()
    assert good.count() + bad.count() == 7 and (2, ["x in range"]) in told and (4, ["c present"]) in told and (3, ["x in range", "c in domain", "x up to y", "c matches"]) in told
    assert all(r.passed and r.broken == 0 for r in E.judge(df.limit(0), rules).collect())
    assert E.quarantine(df, [E.unique("id")])[0].count() == 7
    for wrong in ([E.present("c"), E.present("c")], [E.Expectation("none")]):
        with pytest.raises(ValueError):
            E.judge(df, wrong)
    with pytest.raises(ValueError):
        E.quarantine(df.withColumn("broken_rules", F.lit(1)), rules)
    plan = bad._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # no row moves


SPEC = TableSpec(target="y", timestamp="t", numerics=("a", "b"))


def _events(n, seed=3):
    r = random.Random(seed)
    return [(d, float(r.random() < 0.3), 1e6 + r.gauss(0, 1) if r.random() > 0.1 else None, r.gauss(0, 1)) for d in range(8) for _ in range(n)]


def test_folds_are_those_of_their_own_rows(spark):
    rows = _events(60)
    df = spark.createDataFrame([(d, int(y), a, b + y * (d > 4)) for d, y, a, b in rows], "d int, y int, a double, b double")
    folds = rolling_folds(block_statistics(df, SPEC, F.col("d")), 2)
    got = {(r.origin, r.feature): r for r in folds.collect()}
    assert {o for o, _ in got} == set(range(2, 8))
    values = {(r.origin, r.feature): r.f_value for r in fold_selection(folds, 1).collect()}
    data = [tuple(r) for r in df.collect()]
    for (o, f), r in got.items():
        x = [[v[2 if f == "a" else 3] for v in data if v[0] < o and v[1] == k and v[2 if f == "a" else 3] is not None] for k in (0, 1)]
        assert (r.n0, r.n1) == (len(x[0]), len(x[1])) and r.blocks == o
        means = [math.fsum(c) / len(c) for c in x]
        every = math.fsum(x[0] + x[1]) / (len(x[0]) + len(x[1]))
        between = sum(len(c) * (m - every) ** 2 for c, m in zip(x, means))
        within = sum((v - m) ** 2 for c, m in zip(x, means) for v in c)
        assert values[o, f] == pytest.approx(between / within * (len(x[0]) + len(x[1]) - 2), rel=1e-6, abs=1e-9)
    chosen = {r.origin: r.feature for r in fold_selection(folds, 1).where("selected").collect()}
    assert chosen[7] == "b"  # the feature that tells the classes apart in later blocks


def test_no_fold_sees_later_rows(spark):
    rows = [(d, int(y), a, b) for d, y, a, b in _events(40)]
    changed = [(d, y if d < 5 else 1 - y, a, b if d < 5 else b + 100 * y) for d, y, a, b in rows]
    out = []
    for data in (rows, changed):
        df = spark.createDataFrame(data, "d int, y int, a double, b double")
        f = fold_selection(rolling_folds(block_statistics(df, SPEC, F.col("d")), 1), 1)
        out.append({(r.origin, r.feature): (round(r.f_value, 6), r.place) for r in f.where("origin <= 5").collect()})
    assert out[0] == out[1] and len(out[0]) == 10
    assert rolling_folds(block_statistics(df.limit(0), SPEC, F.col("d"))).isEmpty()


def test_sketches_keep_their_bounds(spark):
    df = spark.range(200_000).select((F.col("id") % 10).alias("w"), (F.col("id") % 70_000).alias("k"), F.when(F.col("id") % 50 != 0, F.pow(F.rand(3), 2) * 1000).alias("x"), F.col("id"))
    kept = K.sketch_by(df, F.col("w"), ["k"], ["x"]).cache()
    assert kept.count() == 10 and kept.agg(F.sum("rows")).first()[0] == 200_000
    some = K.united(kept.where("period < 6"), ["k"], ["x"])
    rows = df.where("w < 6")
    exact = rows.select("k").distinct().count()
    estimate = some.select(F.hll_sketch_estimate("d_k")).first()[0]
    assert abs(estimate - exact) <= 4 * 1.04 / math.sqrt(2**K.LG_K) * exact
    some = some.withColumn("period", F.lit("first six"))
    for r in K.quantile_estimates(some, ["x"], [0.05, 0.5, 0.95]).collect():
        below = rows.where((F.col("x") <= r.value)).count() / rows.where("x is not null").count()
        assert abs(below - r.probability) <= 0.015
    halves = [K.united(K.sketch_by(d, F.lit(0), [], ["x"]), [], ["x"]) for d in (df.where("id % 2 = 0"), df.where("id % 2 = 1").withColumn("x", F.col("x") * 1.3))]
    got = K.sketch_drift(*halves, ["x"]).first()
    want = modeling.drift(df.where("id % 2 = 0"), df.where("id % 2 = 1").withColumn("x", F.col("x") * 1.3), ["x"]).first()
    assert abs(got.psi - want.psi) < 0.02 and abs(got.ecdf_gap - want.ecdf_gap) < 0.02 and want.ecdf_gap > 0.05
    none = K.united(K.sketch_by(df.where("id % 50 = 0"), F.lit(0), [], ["x"]), [], ["x"])
    assert K.sketch_drift(none, halves[1], ["x"]).first().psi is None


def test_a_batch_meets_only_its_own_buckets(spark, tmp_path):
    known = KnownKeys(spark, "known_in_test", "k", buckets=4, path=str(tmp_path / "known"))
    try:
        a = spark.createDataFrame([(i % 50 if i % 9 else None, i) for i in range(200)], "k int, v int")
        b = spark.createDataFrame([(i % 80 if i % 7 else None, 1000 + i) for i in range(300)], "k int, v int")
        out = []
        for batch in (a, b, b):
            fresh = known.fresh(batch, [F.col("v")]).cache()
            out.append({(r.k, r.v) for r in fresh.collect()})
            known.add(fresh)
        both = {}
        for k, v in sorted([tuple(r) for r in a.unionByName(b).collect()], key=lambda r: r[1]):
            both.setdefault(k, v)
        assert out[0] | out[1] == set(both.items()) and not out[2]  # two batches give what one run over both gives
        plan = known.fresh(b)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(_h" not in plan and "Bucketed: true" in plan  # the published side stays where it is
        assert known.fresh(a.limit(0)).isEmpty()
    finally:
        known.drop()
