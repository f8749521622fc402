"""An agreement model: a regression judged out of fold, with bands of confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import checkpointed


def out_of_fold(df: DataFrame, key: str, target: str, features: list[str], kind: str = "ridge", folds: int = 5, categories: list[str] | None = None, rounds: int = 20) -> DataFrame:
    """(key, actual, predicted): each row predicted by a model (`ridge` or `boosted` trees) that has not seen it.

    Folds come from the key's hash. Missing features take the training rows' median; categories are encoded one column a value, null and
    unseen values by none; rows whose target is null, NaN or not above 0 (0 means missing) are left out.
    """
    known, categories = F.col(target).cast("double"), categories or []
    rows = df.where(known.isNotNull() & ~F.isnan(known) & (known > 0)).select(F.col(key).alias("key"), known.alias("y"), *[F.col(f).cast("double").alias(f) for f in features], *[F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("none")).alias(c) for c in categories])
    rows = checkpointed(rows.withColumn("fold", F.pmod(F.xxhash64("key"), F.lit(folds))))
    model = LinearRegression(labelCol="y", featuresCol="scaled", regParam=1.0, elasticNetParam=0.0) if kind == "ridge" else GBTRegressor(labelCol="y", featuresCol="scaled", maxIter=rounds, maxDepth=3, seed=3)
    filled = [f"{f}_filled" for f in features]
    coded = [StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep") for c in categories] + [OneHotEncoder(inputCol=f"{c}_index", outputCol=f"{c}_code") for c in categories]
    steps = [Imputer(inputCols=features, outputCols=filled, strategy="median"), *coded, VectorAssembler(inputCols=[*filled, *[f"{c}_code" for c in categories]], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), model]
    parts = [Pipeline(stages=steps).fit(rows.where(F.col("fold") != k)).transform(rows.where(F.col("fold") == k)).select("key", F.col("y").alias("actual"), F.col("prediction").alias("predicted")) for k in range(folds)]
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("key", key)


def scores(predicted: DataFrame) -> DataFrame:
    """(rows, mape, rmse, r2)."""
    e = F.col("actual") - F.col("predicted")
    return predicted.agg(F.count("*").alias("rows"), (F.avg(F.abs(F.try_divide(e, F.col("actual")))) * 100).alias("mape"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), F.var_pop("actual") * F.count("*"))).alias("r2"))


def bands(predicted: DataFrame, key: str) -> DataFrame:
    """(key, residual_pct, confidence): high below 10 % off, medium below 25 %, else low."""
    r = F.try_divide(F.col("actual") - F.col("predicted"), F.col("predicted")) * 100
    return predicted.select(key, F.round(r, 2).alias("residual_pct"), F.when(F.abs(r) < 10, "high").when(F.abs(r) < 25, "medium").otherwise("low").alias("confidence"))
