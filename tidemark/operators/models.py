"""Regressions of a series on its past by MLlib, compared over expanding folds."""

from __future__ import annotations

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.pipeline import Pipeline
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.numerics import folds


def candidates(seed: int = 42) -> dict[str, object]:
    common = {"featuresCol": "features", "labelCol": "label"}
    return {
        "ridge": LinearRegression(regParam=0.1, elasticNetParam=0.0, **common),
        "elastic_net": LinearRegression(regParam=0.01, elasticNetParam=0.5, **common),
        "forest": RandomForestRegressor(numTrees=50, maxDepth=5, seed=seed, **common),
    }


def compared(rows: DataFrame, target: str, features: list[str], order: str, k: int = 5) -> DataFrame:
    """(model, fold, n_train, n_test, r2, mae): each model fitted to the rows before a fold and tried on the fold; scaling is fitted to the former alone."""
    spark: SparkSession = rows.sparkSession
    data = rows.select(F.col(order).cast("double").alias("_at"), F.col(target).cast("double").alias("label"), *features).cache()
    places = [r["_at"] for r in data.select("_at").orderBy("_at").collect()]  # an aggregated series: a few hundred rows
    out = []
    for fold, (i, j) in enumerate(folds(len(places), k)):
        train, test = data.filter(F.col("_at") < places[i]), data.filter((F.col("_at") >= places[i]) & (F.col("_at") <= places[j - 1]))
        for name, model in candidates().items():
            stages = [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), model]
            seen = Pipeline(stages=stages).fit(train).transform(test).cache()
            score = lambda m, seen=seen: float(RegressionEvaluator(labelCol="label", metricName=m).evaluate(seen))
            out.append((name, fold, i, j - i, score("r2"), score("mae")))
            seen.unpersist()
    data.unpersist()
    return spark.createDataFrame(out, "model string, fold int, n_train int, n_test int, r2 double, mae double")
