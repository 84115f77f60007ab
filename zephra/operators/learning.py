"""Next-day band classifier and 24-hour regressor on MLlib.

A forest holds each training row with one count per tree, many times its size in the file, so training rows are dealt over
tasks by their number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephra.fixed_values import BANDS
from zephra.functions.text import quoted
from zephra.scale import dealt

FORECAST_FEATURES = ["pm25", "pm10", "temp", "humidity", "wind", "traffic", "sat_no2"]
# Stand-ins for signals a station does not have.
FORECAST_DEFAULTS = {"temp": 28.0, "humidity": 62.0, "wind": 9.0, "traffic": 70.0, "sat_no2": 135.0}
PM10_PER_PM25 = 1.6


def with_class_weight(train: DataFrame, target: str = "target") -> DataFrame:
    """Balanced weights n / (k * n_class). At most four classes, so the counts are one small broadcast."""
    counts = train.groupBy(target).agg(F.count(F.lit(1)).alias("_n"))
    sums = counts.agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    weights = counts.select(target, (F.lit(float(sums["n"] or 0)) / (F.lit(sums["k"]) * F.col("_n"))).alias("weight"))
    return train.join(F.broadcast(weights), target)


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=[f for f in features], outputCol="features", handleInvalid="keep")


def fit_band_model(
    train: DataFrame, features: Sequence[str], trees: int = 200, depth: int = 15, seed: int = 42
) -> PipelineModel:
    labels = StringIndexerModel.from_labels(BANDS, "target", "label")
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, seed=seed, weightCol="weight", featuresCol="features", labelCol="label",
        featureSubsetStrategy="sqrt", cacheNodeIds=False,
    )
    weighted = dealt(with_class_weight(train.select(*[quoted(f) for f in features], "target")))
    assembled = _assembler(features).transform(labels.transform(weighted))
    rows = assembled.select("features", "label", "weight")
    return PipelineModel([_assembler(features), forest.fit(rows)])


def predict_band(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds pred, confidence (%) and the probability per band; rows without complete features get NULL."""
    features = model.stages[0].getInputCols()
    complete = F.lit(True)
    for f in features:
        complete = complete & quoted(f).isNotNull()
    scored = model.transform(df.withColumn("_ok", complete))
    proba = vector_to_array("probability")
    pick = F.element_at(F.array(*[F.lit(x) for x in BANDS]), (F.col("prediction") + 1).cast("int"))
    out = scored.withColumns(
        {
            "pred": F.when(F.col("_ok"), pick),
            "confidence": F.when(F.col("_ok"), F.array_max(proba) * 100),
            **{f"p_{x}": F.when(F.col("_ok"), F.get(proba, F.lit(i))) for i, x in enumerate(BANDS)},
        }
    )
    return out.drop("_ok", "features", "rawPrediction", "probability", "prediction")


def importances(model: PipelineModel) -> DataFrame:
    """(feature, importance): one row per model feature."""
    from pyspark.sql import SparkSession

    names = model.stages[0].getInputCols()
    values = model.stages[-1].featureImportances.toArray().tolist()
    return SparkSession.active().createDataFrame(list(zip(names, values)), "feature string, importance double")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def forecast_inputs(df: DataFrame) -> DataFrame:
    """Completes the forecast features: PM10 from PM2.5, constants for what is not measured."""
    have = set(df.columns)
    cols = {
        "pm10": F.coalesce("pm10", F.col("pm25") * PM10_PER_PM25) if "pm10" in have else F.col("pm25") * PM10_PER_PM25
    }
    for name, value in FORECAST_DEFAULTS.items():
        cols[name] = F.coalesce(name, F.lit(value)) if name in have else F.lit(value)
    return df.withColumns(cols)


def fit_forecaster(train: DataFrame, target: str = "next_pm25", trees: int = 40, depth: int = 8, seed: int = 42) -> PipelineModel:
    """Regressor of the value a day later, on lagged readings."""
    forest = RandomForestRegressor(
        numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol=target, featureSubsetStrategy="all"
    )
    rows = dealt(train.dropna(subset=["pm25", target]).select(*[quoted(f) for f in FORECAST_FEATURES], quoted(target)))
    return Pipeline(stages=[_assembler(FORECAST_FEATURES), forest]).fit(rows)


def predict_ci(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds mean, half_width, lower, upper from the spread of the single trees."""
    out = model.stages[0].transform(df)
    names = []
    for i, tree in enumerate(model.stages[-1].trees):
        tree.setPredictionCol(f"_t{i}").setFeaturesCol("features")
        out = tree.transform(out)
        names.append(f"_t{i}")
    votes, n = F.array(*names), len(names)
    out = out.withColumn("_votes", votes).drop("features", *names)
    mean = F.aggregate("_votes", F.lit(0.0), lambda a, x: a + x) / n
    out = out.withColumn("mean", mean)
    spread = F.aggregate("_votes", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / n
    out = out.withColumn("half_width", F.greatest(F.lit(8.0), 1.96 * F.sqrt(spread))).drop("_votes")
    return out.withColumns(
        {"lower": F.greatest(F.lit(10.0), F.col("mean") - F.col("half_width")), "upper": F.col("mean") + F.col("half_width")}
    )
