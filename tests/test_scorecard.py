"""As-of retrieval and models as tables."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.asof import retrieve_as_of
from ledgerlens.plans import fixtures, modeling, queries
from ledgerlens.plans.pipeline import to_gold
from ledgerlens.plans.scorecard import learn_scorecard, model_table, score_table
from ledgerlens.spec import GOLD

SF = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1)


@pytest.mark.parametrize("ranges", [1, 4, 64])
def test_as_of(spark, ranges):
    r = random.Random(11)
    when = lambda n: START + timedelta(minutes=r.randrange(n))
    key = lambda: "hot" if r.random() < 0.5 else r.choice(["a", "b", "c", None])
    features = [(key(), when(500) if r.random() > 0.05 else None, r.random() if r.random() > 0.1 else None, i) for i in range(300)]
    labels = [(i, key(), when(600) if r.random() > 0.05 else None) for i in range(400)] + [(7, "hot", START)] * 2
    f = spark.createDataFrame(features, "k string, t timestamp_ntz, x double, n int")
    d = spark.createDataFrame(labels, "id int, k string, t timestamp_ntz").repartition(3)

    def plain(k, t, age=None):
        seen = [(ft, n, x) for fk, ft, x, n in features if fk == k and k is not None and t is not None and ft is not None and ft <= t]
        best = max(seen, key=lambda s: s[:2], default=None)
        return (None, None, None) if best is None or (age and best[0] < t - age) else (best[2], best[1], best[0])

    for age, text in ((None, None), (timedelta(minutes=20), "20 minutes")):
        got = retrieve_as_of(d, f, "k", "t", ["x", "n"], tie="n", max_age=text, ranges=ranges)
        assert got.columns == ["id", "k", "t", "x", "n", "t_feature"]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, k, t, *plain(k, t, age)) for i, k, t in labels), key=repr)
    assert retrieve_as_of(d.limit(0), f, "k", "t", ["x"]).count() == 0
    assert retrieve_as_of(d, f.limit(0), "k", "t", ["x"]).where("x is not null").isEmpty()
    with pytest.raises(ValueError, match="labels have columns"):
        retrieve_as_of(d, f, "k", "t", ["x", "id"])


@pytest.fixture(scope="module")
def split(spark):
    return modeling.time_split(to_gold(fixtures.dirty(spark, SF)), GOLD).cache()


def test_the_table_scores_as_the_fitted_pipeline_does(spark, split):
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    odd = test.limit(3).withColumn("location", F.lit("never seen")).withColumn("amount", F.lit(None).cast("double"))
    test = test.unionByName(odd.withColumn("transaction_id", F.concat(F.lit("odd "), "transaction_id")))
    model = modeling.fit(train, GOLD)
    a = {r.transaction_id: r.score for r in modeling.score(model, test, GOLD).collect()}
    b = {r.transaction_id: r.score for r in score_table(test, GOLD, model_table(spark, model, GOLD)).collect()}
    assert set(a) == set(b) and len(a) > 100 and max(abs(a[k] - b[k]) for k in a) < 1e-9


def test_a_model_with_gaps(spark, split):
    """No rows, no weights, a constant column, missing and unseen categories."""
    card = learn_scorecard(split.withColumn("amount", F.lit(3.0)), GOLD, {"amount": 2.0, "velocity_score": 0.5})
    out = score_table(split.withColumn("location", F.lit(None).cast("string")), GOLD, card, keep=["transaction_id"])
    assert out.where("score is null or score <= 0 or score >= 1").isEmpty() and out.count() == split.count()
    empty = learn_scorecard(split.limit(0), GOLD, {"amount": 2.0})
    assert {r.score for r in score_table(split, GOLD, empty).collect()} == {0.5}
    assert score_table(split.limit(0), GOLD, card).count() == 0


@pytest.mark.parametrize("name", ["model_scores", "fitted_scores"])
def test_rows_are_cleaned_once(spark, name):
    """Learning and scoring read the staged rows; no plan goes back to the raw table."""
    files = queries.QUERIES[name](spark, SF).inputFiles()
    assert files and all("/gold-" in f for f in files)
