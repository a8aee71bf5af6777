"""Classification and regression models on prepared features, with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Interaction, OneHotEncoder, StringIndexer, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from caseworks.operators.logits import LogitCrossValidator


def dealt(df: DataFrame, strata: str, seed: int = 1, key: str = "case_id", name: str = "place") -> DataFrame:
    """Add each row's place, 0 upwards, in its stratum, in an order that its keys' hashes give, the same at every run.

    The hashes' first three digits deal each stratum out to 4,096 ranges, which are numbered apart and start where those before them end: no
    stratum is sorted in one place. Strata are few.
    """
    ranged = df.withColumn("_mark", F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))).withColumn("_range", F.substring("_mark", 1, 3))
    earlier = W.partitionBy(strata).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = ranged.groupBy(strata, "_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select(F.col(strata).alias("_stratum"), F.col("_range").alias("_part"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    numbered = ranged.withColumn("_at", F.row_number().over(W.partitionBy(strata, "_range").orderBy("_mark", key)))
    joined = numbered.join(F.broadcast(starts), F.col(strata).eqNullSafe(F.col("_stratum")) & (F.col("_range") == F.col("_part")))
    return joined.select(*df.columns, (F.col("_start") + F.col("_at") - 1).alias(name))


def folds(df: DataFrame, strata: str, k: int, seed: int = 1, key: str = "case_id") -> DataFrame:
    """Add fold, 0 to k - 1: each stratum dealt round in an order that its keys' hashes give, the same at every run."""
    return dealt(df, strata, seed, key, "fold").withColumn("fold", (F.col("fold") % k).cast("int"))


def recipe(numbers: Sequence[str], categories: Sequence[str], output: str = "features") -> Pipeline:
    """Dummy-code categories, put all in a vector, drop what has no variance."""
    index = StringIndexer(inputCols=[*categories], outputCols=[f"{c}_index" for c in categories], handleInvalid="keep", stringOrderType="alphabetAsc")
    dummies = OneHotEncoder(inputCols=[f"{c}_index" for c in categories], outputCols=[f"{c}_dummy" for c in categories])
    gather = VectorAssembler(inputCols=[*numbers, *(f"{c}_dummy" for c in categories)], outputCol="assembled", handleInvalid="skip")
    return Pipeline(stages=[*([index, dummies] if categories else []), gather, VarianceThresholdSelector(featuresCol="assembled", outputCol=output, varianceThreshold=0.0)])


def vectors(df: DataFrame, numbers: Sequence[str], label: Column) -> DataFrame:
    rows = df.withColumn("label", label.cast("double")).dropna(subset=["label", *numbers])
    return VectorAssembler(inputCols=[*numbers], outputCol="features").transform(rows)


def forest_regression(rows: DataFrame, trees: int = 500, seed: int = 1) -> RandomForestRegressor:
    return RandomForestRegressor(numTrees=trees, seed=seed).fit(rows)


def forest_classifier(trees: int = 2500, per_split: str = "12", least: int = 30, seed: int = 1) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, featureSubsetStrategy=per_split, minInstancesPerNode=least, seed=seed)


def boosted_classifier(rounds: int = 1500, depth: int = 5, step: float = 0.1, seed: int = 1) -> GBTClassifier:
    return GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed)


def multinomial_logit(penalty: float = 0.0) -> LogisticRegression:
    return LogisticRegression(family="multinomial", regParam=penalty)


def linear_probability() -> GeneralizedLinearRegression:
    return GeneralizedLinearRegression(family="gaussian")


def out_of_fold(rows: DataFrame, estimator, k: int) -> DataFrame:
    """Predictions for each row by the model fitted on the other folds; one fit for each fold, all in one table."""
    out = None
    for f in range(k):
        part = estimator.fit(rows.filter(F.col("fold") != f)).transform(rows.filter(F.col("fold") == f))
        out = part if out is None else out.unionByName(part)
    return out


def fold_error(rows: DataFrame, estimator, k: int) -> float:
    """Root mean squared error over held-out folds, in place of the out-of-bag error that Spark does not offer."""
    return RegressionEvaluator(metricName="rmse").evaluate(out_of_fold(rows, estimator, k))


def fold_area(rows: DataFrame, estimator, k: int, metric: str = "areaUnderPR") -> float:
    return BinaryClassificationEvaluator(metricName=metric, rawPredictionCol="rawPrediction").evaluate(out_of_fold(rows, estimator, k))


def ablation(df: DataFrame, features: Sequence[str], label: Column, estimator, k: int, area: bool = False) -> list[tuple[str, float]]:
    """Held-out score with all features, and without each in turn; the loop is over feature lists, the fits are distributed."""
    score = fold_area if area else fold_error
    return [(left_out or "none", score(vectors(df, [f for f in features if f != left_out], label), estimator, k)) for left_out in [None, *features]]


def state_slopes(df: DataFrame, numbers: Sequence[str], group: str, label: Column, weight: str, penalty: float = 0.01) -> DataFrame:
    """In place of random slopes: fixed effects of group and group-by-number interactions, shrunk by a ridge penalty. Returns (term, coefficient)."""
    rows = df.withColumn("label", label.cast("double")).dropna(subset=["label", weight, *numbers])
    stages = [StringIndexer(inputCol=group, outputCol="_g", stringOrderType="alphabetAsc"), OneHotEncoder(inputCol="_g", outputCol="_d", dropLast=False), VectorAssembler(inputCols=[*numbers], outputCol="_x"), Interaction(inputCols=["_d", "_x"], outputCol="_dx"), VectorAssembler(inputCols=["_x", "_d", "_dx"], outputCol="features")]
    model = Pipeline(stages=[*stages, LogisticRegression(weightCol=weight, regParam=penalty, maxIter=50)]).fit(rows)
    groups, values = model.stages[0].labels, model.stages[-1].coefficients.toArray().tolist()
    names = [*numbers, *groups, *(f"{g}:{n}" for g in groups for n in numbers)]
    return df.sparkSession.createDataFrame([(a, float(b)) for a, b in zip(names, values, strict=True)], "term string, coefficient double")


def tuned(rows: DataFrame, estimator, grid: dict, k: int = 5):
    """Cross-validation of each point of a grid over the rows' own folds, 0 to k - 1."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), values)
    return CrossValidator(estimator=estimator, estimatorParamMaps=builder.build(), evaluator=BinaryClassificationEvaluator(metricName="areaUnderROC"), numFolds=k, foldCol="fold", parallelism=4).fit(rows)


def tuned_logit(rows: DataFrame, penalties: Sequence[float], k: int = 5) -> CrossValidatorModel:
    """As tuned() with a logit's penalties, all fitted and judged in the same passes over the rows."""
    estimator = LogisticRegression()
    points = ParamGridBuilder().addGrid(estimator.regParam, [*penalties]).build()
    return LogitCrossValidator(estimator=estimator, estimatorParamMaps=points, evaluator=BinaryClassificationEvaluator(metricName="areaUnderROC"), numFolds=k, foldCol="fold").fit(rows)


def probability() -> Column:
    return vector_to_array("probability")[1]


def confusion(predicted: DataFrame, truth: str, guess: str) -> DataFrame:
    counted = predicted.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(truth)))
