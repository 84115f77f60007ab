"""Tables behind the station view: timeline and one record per station."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephra.functions import bands, risk
from zephra.functions.text import round_stable
from zephra.operators import features, fusion

FUTURE_HOURS = [6, 12, 18, 24]


def forecast_24h(latest: DataFrame) -> DataFrame:
    """Adds the 25-point curve, its last value and band, from pm25, mean, half_width."""
    curve = risk.trajectory(F.col("pm25"), F.col("mean"), F.col("half_width"))
    out = latest.withColumn("curve", curve)
    last = F.element_at("curve", -1)["value"]
    return out.withColumns({"aqi_24h": last, "aqi_24h_band": bands.aqi_band(last)})


def timeline(daily: DataFrame, reports: DataFrame, pixels: DataFrame, forecast: DataFrame, past_days: int = 7) -> DataFrame:
    """Per station: the days up to its last one, then the forecast points.

    ``forecast`` has station, date, curve. Reports count per station and day, NO2 is the city's mean of the day.
    """
    spine = forecast.select(
        "station", F.posexplode(F.sequence(F.date_sub("date", past_days), F.col("date"))).alias("step", "date")
    )
    counts = reports.groupBy("station", F.to_date("reported_at").alias("date")).agg(F.count(F.lit(1)).alias("reports"))
    sky = pixels.groupBy("date").agg(F.avg("no2").alias("no2"))
    past = spine.join(daily, ["station", "date"], "left").join(counts, ["station", "date"], "left").join(sky, "date", "left")
    past = past.select(
        "station", "step", F.when(F.col("step") == past_days, "today").otherwise(F.date_format("date", "MMM dd")).alias("label"),
        F.col("pm25").alias("aqi"), F.coalesce("reports", F.lit(0)).cast("long").alias("reports"), "no2",
    )
    ahead = forecast.select("station", F.explode("curve").alias("p")).filter(F.col("p.hour").isin(FUTURE_HOURS))
    ahead = ahead.select(
        "station", (F.lit(past_days) + F.col("p.hour") / 6).cast("int").alias("step"),
        F.concat(F.lit("T+"), F.col("p.hour").cast("string"), F.lit("h")).alias("label"), F.col("p.value").alias("aqi"),
        F.lit(None).cast("long").alias("reports"), F.lit(None).cast("double").alias("no2"),
    )
    return past.unionByName(ahead)


def ward_risk(latest: DataFrame) -> DataFrame:
    """Risk per ward from the mean of its stations' latest values; other signals take their stand-ins."""
    per_ward = latest.groupBy("ward_name").agg(round_stable(F.avg("pm25"), 6).alias("pm25"))
    return fusion.with_risk(with_stand_ins(per_ward))


def with_stand_ins(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    stand_ins = {"citizen": 72.0, "no2": 135.0, "traffic": 70.0, "humidity": 62.0, "wind": 9.0}
    return df.withColumns({c: F.coalesce(c, F.lit(v)) if c in have else F.lit(v) for c, v in stand_ins.items()})


def station_analysis(
    stations: DataFrame, daily: DataFrame, predicted: DataFrame, forecast: DataFrame, alerts_only: bool = False
) -> DataFrame:
    """One record per station: latest value, 30-day history, predicted band, forecast, risk, alert, advice.

    ``stations`` has station and ward_name; ``predicted`` station, pred, confidence; ``forecast`` station, mean, half_width.
    """
    # At most 30 entries per station.
    history = features.tail_n(daily, 30).groupBy("station").agg(
        F.sort_array(F.collect_list(F.struct("date", "pm25"))).alias("history")
    )
    out = (
        stations.join(features.latest(daily), "station")
        .join(history, "station", "left")
        .join(predicted.select("station", "pred", "confidence"), "station", "left")
        .join(forecast.select("station", "mean", "half_width"), "station", "left")
    )
    out = fusion.with_risk(with_stand_ins(forecast_24h(out)))
    out = out.withColumn("incident_type", F.when(F.col("pm25") > 90, "Garbage Burning").otherwise("Ambient Dust"))
    out = fusion.with_alert(out).withColumn("band", bands.pm25_band(F.col("pm25"), "Unknown"))
    plan = fusion.packed_actions(out.sparkSession)
    out = fusion.with_advisory(out.join(F.broadcast(plan), "branch", "left"))
    return out.filter("is_triggered") if alerts_only else out
