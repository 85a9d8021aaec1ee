"""Second tier: features, time-aware splits, models, evaluation, cost, drift and gates."""

from __future__ import annotations

from datetime import datetime

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import hash52, one, percent, rate
from ..operators.orderstat import bin_of, equal_frequency_edges
from ..operators.select import select_quantiles
from ..spec import TableSpec


def feature_sets(spec: TableSpec) -> dict[str, dict[str, Column]]:
    """Named experiments: columns to add to a cleaned table; none of them belongs in the published one."""
    ts = F.col(spec.timestamp)
    return {
        "amount_log": {f"{spec.amount}_log1p": F.when(F.col(spec.amount) > -1, F.log1p(F.col(spec.amount)))},
        "time_parts": {"hour": F.hour(ts), "weekday": F.weekday(ts), "month": F.month(ts)},
        "missing_flag": {f"{spec.incomplete}_missing": F.col(spec.incomplete).isNull().cast("int")},
    }


def add_features(df: DataFrame, spec: TableSpec, names: list[str]) -> DataFrame:
    every = feature_sets(spec)
    return df.withColumns({k: v for n in names for k, v in every[n].items()})


def time_split(df: DataFrame, spec: TableSpec, shares: tuple[float, float] = (0.7, 0.15), cuts: tuple[datetime, datetime] | None = None, out: str = "split") -> DataFrame:
    """df with `out`: train up to the first cut, validation up to the second, test after; null without a time.

    Cuts are given times, or the times below which the given shares of the rows lie; equal times never part.
    """
    us = F.unix_micros(F.col(spec.timestamp).cast("timestamp"))
    if cuts:
        a, b = (F.unix_micros(F.lit(c).cast("timestamp")) for c in cuts)
    else:
        found = select_quantiles(df.select(F.lit(0).alias("_g"), us.alias("_k")).where("_k is not null"), [shares[0], shares[0] + shares[1]], float)
        a, b = (F.lit(x).cast("double") for x in found.get(0, (None, None)))
    return df.withColumn(out, F.when(us.isNull(), None).when(us <= a, "train").when(us <= b, "validation").otherwise("test"))


def preparation(spec: TableSpec, *, select: int | None = None) -> Pipeline:
    """Imputation, indexing, encoding, scaling, and on request selection; to be fitted on training rows only."""
    nums, cats = list(spec.numerics), list(spec.categoricals)
    stages = [Imputer(strategy="median", inputCols=nums, outputCols=[f"{c}_filled" for c in nums]),
              StringIndexer(inputCols=cats, outputCols=[f"{c}_index" for c in cats], handleInvalid="keep"),
              OneHotEncoder(inputCols=[f"{c}_index" for c in cats], outputCols=[f"{c}_hot" for c in cats]),
              VectorAssembler(inputCols=[f"{c}_filled" for c in nums], outputCol="numbers"), StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True),
              VectorAssembler(inputCols=["scaled", *[f"{c}_hot" for c in cats]], outputCol="features")]
    if select:
        s = UnivariateFeatureSelector(featuresCol="features", labelCol="label", outputCol="selected", selectionMode="numTopFeatures")
        stages.append(s.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(select))
    return Pipeline(stages=stages)


def model_rows(df: DataFrame, spec: TableSpec) -> DataFrame:
    """df with `label`, and the numerics as doubles with NaN for missing, as the imputer wants them."""
    return df.where(F.col(spec.target).isNotNull()).withColumn("label", one(F.col(spec.target)).cast("double")).withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in spec.numerics})


def class_weights(df: DataFrame, spec: TableSpec, out: str = "weight") -> DataFrame:
    """df with weights that give both classes the same sum."""
    y = one(F.col(spec.target))
    n = df.agg(F.count(y).alias("_n"), F.sum(y).alias("_p"))
    w = F.when(y == 1, F.try_divide(F.col("_n"), 2 * F.col("_p"))).when(y == 0, F.try_divide(F.col("_n"), 2 * (F.col("_n") - F.col("_p"))))
    return df.crossJoin(F.broadcast(n)).withColumn(out, w).drop("_n", "_p")  # one row


def oversample(df: DataFrame, spec: TableSpec, share: float, seed: int = 42) -> DataFrame:
    """Positive rows repeated so that they are about `share` of all: whole repeats, and one more by a hash of the id."""
    y = one(F.col(spec.target))
    n = df.agg(F.count_if(y == 0).alias("_neg"), F.sum(y).alias("_pos"))
    want = F.greatest(F.lit(1.0), F.coalesce(F.try_divide(F.col("_neg") * share / (1 - share), F.col("_pos")), F.lit(1.0)))
    u = hash52(seed, F.col(spec.id)) / F.lit(float(1 << 52))
    times = F.when(y == 1, F.floor(want) + (u < want - F.floor(want)).cast("long")).otherwise(F.lit(1).cast("long"))
    return df.crossJoin(F.broadcast(n)).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), times))).drop("_i", "_neg", "_pos")  # one row


def fit(train: DataFrame, spec: TableSpec, kind: str = "logistic", *, select: int | None = None) -> PipelineModel:
    """Preparation and a classifier (`logistic` or `boosted`), fitted on the rows given."""
    rows = class_weights(model_rows(train, spec), spec)
    features = "selected" if select else "features"
    make = {"logistic": LogisticRegression(featuresCol=features, weightCol="weight", maxIter=30), "boosted": GBTClassifier(featuresCol=features, weightCol="weight", maxIter=20, seed=42)}[kind]
    model = Pipeline(stages=[*preparation(spec, select=select).getStages(), make]).fit(rows)
    if kind == "logistic":
        # the training summary holds the session, which cannot go to tasks once it has observed a write
        model.stages[-1]._java_obj.setSummary(train.sparkSession._jvm.scala.Option.empty())
    return model


def score(model: PipelineModel, df: DataFrame, spec: TableSpec) -> DataFrame:
    """(id, amount, target, score): batch scoring."""
    out = model.transform(model_rows(df, spec))
    return out.select(spec.id, spec.amount, spec.target, vector_to_array("probability")[1].alias("score"))


def ranked_outcomes(scored: DataFrame, target: str, score_col: str = "score", amount: str | None = None) -> DataFrame:
    """(threshold, tp, fp, fn_value): what flagging all scores of `threshold` or more does, for each distinct score.

    Running sums come from the rank kernel's buckets, so no task sorts all scores; equal scores are one threshold. The
    buckets' bounds are taken when this is called: computed again, they could be others.
    """
    value = F.coalesce(F.col(amount), F.lit(0.0)) if amount else F.lit(0.0)
    rows = scored.where(F.col(target).isNotNull() & F.col(score_col).isNotNull()).select(
        F.col(score_col).cast("double").alias("_x"), one(F.col(target)).alias("_y"), value.alias("_v"))
    g = rows.groupBy("_x").agg(F.sum("_y").alias("_p"), F.count(F.lit(1)).alias("_n"), F.sum(F.when(F.col("_y") == 1, F.col("_v")).otherwise(0.0)).alias("_pv"))
    bounds = rows.agg(F.percentile_approx("_x", F.array(*[F.lit(i / 64) for i in range(1, 64)]), F.lit(1000))).first()[0] or []  # 63 numbers
    below = F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<double>"), lambda b: b < F.col("_x"))
    g = g.withColumn("_k", F.size(below))
    down = Window.orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, -1)  # at most 64 rows
    sums = g.groupBy("_k").agg(F.sum("_p").alias("sp"), F.sum("_n").alias("sn"), F.sum("_pv").alias("sv"))
    sums = sums.select(F.col("_k").alias("_l"), *[F.coalesce(F.sum(c).over(down), F.lit(0)).alias(f"o{c}") for c in ("sp", "sn", "sv")], F.sum("sv").over(Window.partitionBy()).alias("_all"))
    inside = Window.partitionBy("_k").orderBy(F.desc("_x")).rowsBetween(Window.unboundedPreceding, 0)
    j = g.join(F.broadcast(sums), F.col("_k") == F.col("_l"))
    tp, n, v = (F.col(f"o{a}") + F.sum(b).over(inside) for a, b in (("sp", "_p"), ("sn", "_n"), ("sv", "_pv")))
    return j.select(F.col("_x").alias("threshold"), tp.alias("tp"), (n - tp).alias("fp"), (F.col("_all") - v).alias("fn_value"))


def evaluate(scored: DataFrame, target: str, threshold: float = 0.5, score_col: str = "score") -> DataFrame:
    """(metric, value): confusion counts, precision, recall and F1 at the threshold, ROC-AUC by ranks, PR-AUC as average precision."""
    y, s = one(F.col(target)), F.col(score_col)
    rows = scored.where(F.col(target).isNotNull() & s.isNotNull())
    c = rows.agg(F.count_if((y == 1) & (s >= threshold)).alias("tp"), F.count_if((y == 0) & (s >= threshold)).alias("fp"),
                 F.count_if((y == 1) & (s < threshold)).alias("fn"), F.count_if((y == 0) & (s < threshold)).alias("tn"))
    o = ranked_outcomes(rows, target, score_col)
    # steps between thresholds, by each threshold's own rows
    own = rows.groupBy(s.cast("double").alias("_x")).agg(F.sum(y).alias("dp"), F.count_if(y == 0).alias("dn"))
    o = o.join(own, F.col("threshold") == F.col("_x"))
    area = o.agg(F.sum(F.col("dn") * (F.col("tp") - F.col("dp") / 2)).alias("_area"), F.sum(F.col("dp") * rate(F.col("tp"), F.col("tp") + F.col("fp"))).alias("_ap"))
    r = c.crossJoin(F.broadcast(area))  # one row
    p, q = rate(F.col("tp"), F.col("tp") + F.col("fp")), rate(F.col("tp"), F.col("tp") + F.col("fn"))
    pos, neg = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    values = {"tp": F.col("tp"), "fp": F.col("fp"), "fn": F.col("fn"), "tn": F.col("tn"), "precision": p, "recall": q, "f1": F.try_divide(2 * p * q, p + q),
              "roc_auc": F.try_divide(F.col("_area"), (pos * neg).cast("double")), "pr_auc": F.try_divide(F.col("_ap"), pos.cast("double"))}
    return r.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in values.items()])))


def threshold_cost(scored: DataFrame, target: str, amount: str, false_alarm: float, score_col: str = "score") -> DataFrame:
    """(threshold, tp, fp, missed_value, cost): the value of missed positives and a price for each false alarm."""
    o = ranked_outcomes(scored, target, score_col, amount)
    return o.select("threshold", "tp", "fp", F.col("fn_value").alias("missed_value"), (F.col("fn_value") + F.col("fp") * false_alarm).alias("cost"))


def best_threshold(costs: DataFrame) -> DataFrame:
    return costs.orderBy("cost", F.desc("threshold")).limit(1)


def drift(reference: DataFrame, current: DataFrame, columns: list[str], q: int = 10) -> DataFrame:
    """(column, psi, ecdf_gap): population stability index over the reference's bins, and the largest gap of the distributions at their edges."""
    edges, out = equal_frequency_edges(reference, columns, q), None
    for c in columns:

        def shares(df: DataFrame, name: str, c=c) -> DataFrame:
            x = F.col(c).cast("double")
            known = df.where(x.isNotNull() & ~F.isnan(x))
            b = known.groupBy(F.coalesce(bin_of(x, edges[c]), F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
            return b.select("bin", (F.col("_n") / F.sum("_n").over(Window.partitionBy())).alias(name))

        j = shares(reference, "r").join(shares(current, "c"), "bin", "full").select("bin", *[F.coalesce(k, F.lit(0.0)).alias(k) for k in ("r", "c")])
        a, b = F.greatest(F.col("r"), F.lit(1e-6)), F.greatest(F.col("c"), F.lit(1e-6))
        upto = Window.orderBy("bin")  # q bins
        j = j.withColumn("_gap", F.abs(F.sum("r").over(upto) - F.sum("c").over(upto)))
        row = j.agg(F.sum((b - a) * F.log(b / a)).alias("psi"), F.max("_gap").alias("ecdf_gap")).select(F.lit(c).alias("column"), "psi", "ecdf_gap")
        out = row if out is None else out.unionByName(row)
    return out


def monitoring_batch(reference: DataFrame, current: DataFrame, spec: TableSpec, columns: list[str], score_col: str, threshold: float, false_alarm: float) -> DataFrame:
    """(section, metric, reference, current): quality, drift, predictions, performance and expected cost of two scored windows.

    Drift rows hold the index of a column in `current`, their reference is 0. Performance counts rows whose label is known.
    """
    y, s = one(F.col(spec.target)), F.col(score_col)
    flagged = s >= threshold

    def measured(df: DataFrame, name: str) -> DataFrame:
        aggs = {("quality", f"missing_percent {c}"): percent(F.count_if(F.col(c).isNull()), F.count(F.lit(1))) for c in columns}
        tp, fp, fn = (F.count_if(x) for x in (flagged & (y == 1), flagged & (y == 0), ~flagged & (y == 1)))
        aggs |= {("quality", "rows"): F.count(F.lit(1)).cast("double"), ("prediction", "flagged_percent"): percent(F.count_if(flagged), F.count(s)),
                 ("prediction", "score_mean"): F.avg(s), ("performance", "precision"): rate(tp, tp + fp), ("performance", "recall"): rate(tp, tp + fn),
                 ("cost", "expected_cost"): F.coalesce(F.sum(F.when(~flagged & (y == 1), F.col(spec.amount))), F.lit(0.0)) + fp * false_alarm}
        row = df.agg(*[v.alias(f"_{i}") for i, v in enumerate(aggs.values())])
        return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("section"), F.lit(b).alias("metric"), F.col(f"_{i}").alias(name)) for i, (a, b) in enumerate(aggs)])))

    moved = drift(reference, current, columns).select(F.lit("drift").alias("section"), F.concat(F.lit("psi "), F.col("column")).alias("metric"), F.lit(0.0).alias("reference"), F.col("psi").alias("current"))
    return measured(reference, "reference").join(measured(current, "current"), ["section", "metric"]).unionByName(moved)


def flags(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """(metric, value, flagged, reason): rules (metric, op, bound, reason) with op `>` or `<`, held against (metric, value)."""
    hit = F.when(F.col("op") == ">", F.col("value") > F.col("bound")).otherwise(F.col("value") < F.col("bound"))
    return metrics.join(rules, "metric").select("metric", "value", F.coalesce(hit, F.lit(True)).alias("flagged"), F.when(F.coalesce(hit, F.lit(True)), F.col("reason")).alias("reason"))


def gate(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """One row: whether no rule is broken, and which are."""
    f = flags(metrics, rules)
    return f.agg((F.count_if("flagged") == 0).alias("passed"), F.array_sort(F.collect_list(F.when(F.col("flagged"), F.col("reason")))).alias("reasons"))


def retrieve(labels: DataFrame, features: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Labels with the named features of their key; one feature row a key is expected, missing ones are null."""
    return labels.join(features.select(key, *names), key, "left")


def log_run(spark: SparkSession, path: str, run_id: str, metrics: DataFrame, params: dict[str, str]) -> None:
    """Append (run_id, kind, name, value) rows of a run."""
    rows = metrics.select(F.lit(run_id).alias("run_id"), F.lit("metric").alias("kind"), F.col("metric").alias("name"), F.col("value").cast("string").alias("value"))
    given = spark.createDataFrame([(run_id, "parameter", k, str(v)) for k, v in params.items()], "run_id string, kind string, name string, value string")
    rows.unionByName(given).write.mode("append").parquet(path)


__all__ = ["add_features", "best_threshold", "class_weights", "drift", "evaluate", "feature_sets", "fit", "flags", "gate", "log_run", "model_rows", "monitoring_batch", "oversample",
           "preparation", "ranked_outcomes", "retrieve", "score", "threshold_cost", "time_split"]
