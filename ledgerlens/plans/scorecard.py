"""A model as a table: everything that scoring needs as long rows, and scoring as joins and sums that SQL can repeat.

(part, feature, category, value): `fill`, `mean` and `scale` of each numeric feature, `weight` of a numeric feature or of a
category, `other` for categories of a feature that the model has not seen, and one `intercept`. A score is the logistic
function of the intercept, the weights of the standardised numerics, and the weights of the row's categories.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import ImputerModel, StandardScalerModel, StringIndexerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import no_nan, one
from ..operators.orderstat import column_quantiles
from ..spec import TableSpec

SCHEMA = "part string, feature string, category string, value double"


def model_table(spark: SparkSession, model: PipelineModel, spec: TableSpec) -> DataFrame:
    """The table of a fitted logistic pipeline (modeling.fit without selection); scores are the same up to rounding."""
    stage = lambda kind: next(s for s in model.stages if isinstance(s, kind))
    nums, cats = list(spec.numerics), list(spec.categoricals)
    fill = stage(ImputerModel).surrogateDF.first()
    scaler, logistic, indexer = stage(StandardScalerModel), stage(LogisticRegressionModel), stage(StringIndexerModel)
    weights = logistic.coefficients.toArray().tolist()
    rows = [("intercept", "", None, float(logistic.intercept))]
    for i, c in enumerate(nums):
        rows += [("fill", c, None, float(fill[c])), ("mean", c, None, float(scaler.mean[i])), ("scale", c, None, float(scaler.std[i])), ("weight", c, None, weights[i])]
    at = len(nums)
    for c, labels in zip(cats, indexer.labelsArray):
        # unseen and missing values are the index after the known ones, which the encoder leaves out as its last
        rows += [("weight", c, x, weights[at + i]) for i, x in enumerate(labels)] + [("other", c, None, 0.0)]
        at += len(labels)
    return spark.createDataFrame(rows, SCHEMA)


def learn_scorecard(train: DataFrame, spec: TableSpec, numeric_weights: dict[str, float], smooth: float = 0.5) -> DataFrame:
    """The table of a scorecard: numeric weights as given, the rest learned from the rows by aggregates.

    Gaps are filled with medians; means and deviations (sample) are of filled columns. A category weighs the logarithm of
    its odds over those of all rows, both with `smooth` added to each count; other categories weigh nothing; the intercept
    is the logarithm of all rows' odds. Rows without a label take no part; missing categories are other ones.
    """
    rows = train.where(F.col(spec.target).isNotNull())
    y = one(F.col(spec.target))
    nums = list(numeric_weights)
    medians = {c: q[0] for c, q in column_quantiles(rows, nums, [0.5]).items()}
    filled = {c: F.coalesce(no_nan(F.col(c).cast("double")), F.lit(medians.get(c, 0.0))) for c in nums}
    moments = rows.agg(*[f(filled[c]).alias(f"{n}{i}") for i, c in enumerate(nums) for n, f in (("m", F.avg), ("s", F.stddev_samp))],
                       F.coalesce(F.sum(y), F.lit(0)).alias("p"), F.count(F.lit(1)).alias("n")).first()  # one row of numbers
    all_odds = (moments["p"] + smooth) / (moments["n"] - moments["p"] + smooth)
    fixed = [("intercept", "", None, F.log(F.lit(all_odds)))]
    for i, c in enumerate(nums):
        fixed += [("fill", c, None, F.lit(medians.get(c, 0.0))), ("mean", c, None, F.lit(moments[f"m{i}"] or 0.0)), ("scale", c, None, F.lit(moments[f"s{i}"] or 0.0)), ("weight", c, None, F.lit(float(numeric_weights[c])))]
    fixed += [("other", c, None, F.lit(0.0)) for c in spec.categoricals]
    base = train.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(p).alias("part"), F.lit(f).alias("feature"), F.lit(x).cast("string").alias("category"), v.cast("double").alias("value")) for p, f, x, v in fixed])))
    long = rows.select(y.alias("y"), F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category")) for c in spec.categoricals])))
    counts = long.where("category is not null").groupBy("feature", "category").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))
    odds = (F.col("p") + smooth) / (F.col("n") - F.col("p") + smooth)
    return base.unionByName(counts.select(F.lit("weight").alias("part"), "feature", "category", F.log(odds / all_odds).alias("value")))


def score_table(df: DataFrame, spec: TableSpec, model: DataFrame, *, keep: list[str] | None = None) -> DataFrame:
    """(id, amount, target, score), or the kept columns and score.

    A numeric feature's weights are a row of the model; a category's weight comes by a join with the rows of its feature,
    which Spark broadcasts where they are few and shuffles where they are not: rows are never unpivoted. A feature whose
    scale is 0 adds nothing. Missing and unseen categories weigh what `other` says.
    """
    named = model.where("part in ('fill', 'mean', 'scale', 'weight', 'intercept', 'other') and category is null")
    known = {(r["part"], r["feature"]): r["value"] for r in named.collect()}  # a few rows a feature
    total: Column = F.lit(known.get(("intercept", ""), 0.0))
    out = df
    for c in spec.numerics:
        if ("weight", c) in known and known["scale", c]:
            x = F.coalesce(no_nan(F.col(c).cast("double")), F.lit(known["fill", c]))
            total = total + (x - known["mean", c]) / known["scale", c] * known["weight", c]
    parts = []
    for i, c in enumerate(spec.categoricals):
        mine = model.where((F.col("part") == "weight") & (F.col("feature") == c) & F.col("category").isNotNull()).select(F.col("category").alias(f"_c{i}"), F.col("value").alias(f"_w{i}"))
        out = out.join(mine, F.col(c).cast("string") == F.col(f"_c{i}"), "left")
        parts.append(F.coalesce(F.col(f"_w{i}"), F.lit(known.get(("other", c), 0.0))))
    score = F.lit(1.0) / (1 + F.exp(-reduce(lambda a, b: a + b, parts, total)))
    return out.select(*(keep or [spec.id, spec.amount, spec.target]), score.alias("score"))
