import numpy as np
from pyspark.sql import functions as F

from zephra.fixed_values import BANDS
from zephra.operators import learning, metrics


def _rows(spark):
    band = F.element_at(F.array(*[F.lit(b) for b in BANDS]), (F.col("id") % 4 + 1).cast("int"))
    skewed = F.when(F.col("id") < 300, "Good").otherwise(band)
    return spark.range(600).select(
        F.when(F.col("id") < 300, 10.0).otherwise((F.col("id") % 4) * 30.0 + 15).alias("roll7"), (F.col("id") % 7).cast("double").alias("roll30"),
        skewed.alias("target"),
    )


def test_band_model(spark, tmp_path):
    rows = _rows(spark)
    weights = {r["target"]: r["w"] for r in learning.with_class_weight(rows).groupBy("target").agg(F.max("weight").alias("w")).collect()}
    assert abs(weights["Good"] - 600 / (4 * 375)) < 1e-12 and abs(weights["Poor"] - 2.0) < 1e-12
    model = learning.fit_band_model(rows, ["roll7", "roll30"], trees=5, depth=4)
    learning.save_model(model, str(tmp_path / "m"))
    model = learning.load_model(str(tmp_path / "m"))
    scored = learning.predict_band(model, rows.unionByName(spark.range(1).select(F.lit(None).cast("double").alias("roll7"), F.lit(1.0).alias("roll30"), F.lit("Good").alias("target"))))
    assert metrics.accuracy(scored.filter("roll7 IS NOT NULL")).first()["accuracy"] == 1.0
    gap = scored.filter("roll7 IS NULL").first()
    assert gap["pred"] is None and gap["confidence"] is None
    top = scored.filter("pred = 'Poor'").first()
    assert abs(top["confidence"] / 100 - top["p_Poor"]) < 1e-12
    fi = {r["feature"]: r["importance"] for r in learning.importances(model).collect()}
    assert set(fi) == {"roll7", "roll30"} and abs(sum(fi.values()) - 1) < 1e-9 and fi["roll7"] > 0.5


def test_interval_is_the_spread_of_the_trees(spark):
    rows = learning.forecast_inputs(spark.range(200).select((F.col("id") % 50).cast("double").alias("pm25")))
    assert rows.first()["pm10"] is not None and rows.filter("temp <> 28.0").count() == 0
    model = learning.fit_forecaster(rows.withColumn("next_pm25", F.col("pm25") * 2 + F.rand(3) * 40), trees=7)
    got = learning.predict_ci(model, rows.filter("pm25 IN (3, 30)").dropDuplicates(["pm25"])).collect()
    vec = model.stages[0].transform(rows.filter("pm25 IN (3, 30)").dropDuplicates(["pm25"])).select("pm25", "features").collect()
    for r in got:
        v = next(x["features"] for x in vec if x["pm25"] == r["pm25"])
        votes = [t.predict(v) for t in model.stages[-1].trees]
        half = max(8.0, 1.96 * np.std(votes))
        assert abs(r["mean"] - np.mean(votes)) < 1e-9 and abs(r["half_width"] - half) < 1e-9
        assert abs(r["lower"] - max(10.0, np.mean(votes) - half)) < 1e-9 and abs(r["upper"] - np.mean(votes) - half) < 1e-9


def test_forests_fit_on_rows_dealt_by_number(spark, monkeypatch):
    """Both forests deal their training rows over tasks, however few files these lie in."""
    from zephra import scale

    parts = []

    def few(df, rows=None):
        out = scale.dealt(df, rows, per_task=100)
        parts.append(out.select(F.spark_partition_id().alias("p")).distinct().count())
        return out

    monkeypatch.setattr(learning, "dealt", few)
    learning.fit_band_model(_rows(spark).coalesce(1), ["roll7", "roll30"], trees=2, depth=2)
    rows = learning.forecast_inputs(spark.range(600).coalesce(1).select((F.col("id") % 50).cast("double").alias("pm25")))
    learning.fit_forecaster(rows.withColumn("next_pm25", F.col("pm25") * 2), trees=2, depth=2)
    assert len(parts) == 2 and min(parts) >= 6
