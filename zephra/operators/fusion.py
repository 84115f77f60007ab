"""Signals of ground, citizens and satellite brought together: points, risk, alerts, advice, indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephra.fixed_values import POLICY_FALLBACK, POLICY_INTRO
from zephra.functions import bands, risk
from zephra.functions.text import quoted
from zephra.sources import registry

REFERENCE_DIGITS = 16
GROUND, CITIZEN, SATELLITE = "Ground Sensor", "Citizen Photo Report", "Sentinel-5P Satellite"


def elevated_ground(sensors: DataFrame) -> DataFrame:
    """Sensors above 60; a sensor without a value counts as 50 and stays out."""
    return sensors.filter(F.coalesce(F.col("pm25"), F.lit(50.0)) > 60.0)


def elevated_pixels(pixels: DataFrame) -> DataFrame:
    return pixels.filter(F.coalesce(F.col("no2"), F.lit(50.0)) > 120.0)


def multimodal_points(sensors: DataFrame, reports: DataFrame, pixels: DataFrame) -> DataFrame:
    """(point_id, lat, lon, weight, source, label_name) of all elevated signals.

    ``point_id`` orders points as sensors, reports, pixels, each by their own number.
    """
    ground = elevated_ground(sensors).select(
        F.struct(F.lit(0).alias("kind"), F.col("pos").cast("long").alias("no")).alias("point_id"),
        F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), (F.col("pm25") / 100.0).alias("weight"),
        F.lit(GROUND).alias("source"), F.col("station").alias("label_name"),
    )
    citizens = reports.select(
        F.struct(F.lit(1).alias("kind"), F.col("report_no").cast("long").alias("no")).alias("point_id"),
        F.coalesce("lat", F.lit(12.97)).alias("lat"), F.coalesce("lon", F.lit(77.59)).alias("lon"),
        (F.coalesce(F.col("severity").cast("double"), F.lit(70.0)) / 100.0).alias("weight"),
        F.lit(CITIZEN).alias("source"), F.coalesce("incident_type", F.lit("Citizen Incident")).alias("label_name"),
    )
    sky = elevated_pixels(pixels).select(
        F.struct(F.lit(2).alias("kind"), F.col("pixel_no").cast("long").alias("no")).alias("point_id"),
        F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), (F.col("no2") / 150.0).alias("weight"),
        F.lit(SATELLITE).alias("source"), F.concat(F.lit("Sat Pixel "), F.col("pixel_id")).alias("label_name"),
    )
    return ground.unionByName(citizens).unionByName(sky)


def with_risk(df: DataFrame) -> DataFrame:
    """Adds sub_scores, risk_score, risk_class and contributions from pm25, citizen, no2, traffic, humidity, wind."""
    s = risk.sub_scores(*[F.col(c) for c in ("pm25", "citizen", "no2", "traffic", "humidity", "wind")])
    score = risk.risk_score(s)
    return df.withColumns(
        {
            "sub_scores": F.struct(*[F.round(c, 1).alias(n) for n, c in s.items()]),
            "risk_score": score,
            "risk_class": F.when(score.isNotNull(), bands.risk_class(score)),
            "contributions": risk.contributions(s),
        }
    )


def with_alert(df: DataFrame) -> DataFrame:
    """Adds the alert fields from ward_name, risk_score, incident_type."""
    ward, score, kind = F.col("ward_name"), F.col("risk_score"), F.col("incident_type")
    return df.withColumns(
        {
            "is_triggered": risk.is_alert(score, kind),
            "priority": risk.alert_priority(score),
            "reason": risk.alert_reason(ward, kind, score),
            "branch": risk.plan_branch(kind, ward),
        }
    )


def lakhs(cost: Column) -> Column:
    return F.regexp_extract(cost, "₹([0-9.]+)", 1).try_cast("double")


def percent_cut(impact: Column) -> Column:
    return F.regexp_extract(impact, "^-([0-9]+)%", 1).try_cast("int")


def action_plan(alerts: DataFrame) -> DataFrame:
    """One row per alert and action. Both dimensions are fixed in code (9 and 3 rows), hence broadcast."""
    spark = alerts.sparkSession
    with_plan = alerts.join(F.broadcast(registry.plans(spark)), "branch", "left")
    return with_plan.join(F.broadcast(registry.actions(spark)), "branch", "left")


def packed_actions(spark) -> DataFrame:
    """branch, its plan, and its three actions as an array in order."""
    items = registry.actions(spark).groupBy("branch").agg(
        F.sort_array(
            F.collect_list(F.struct("action_no", "title", "description", "stars", "cost", "impact", "dept"))
        ).alias("action_items")
    )
    return registry.plans(spark).join(items, "branch")


def with_advisory(df: DataFrame, band: str = "band") -> DataFrame:
    """Health advice for the band; bands without advice get that of ``Moderate``. Four fixed rows, broadcast."""
    advice = registry.advisories(df.sparkSession).withColumnRenamed("band", "_band")
    known = F.col(band).isin("Good", "Moderate", "Poor", "Severe")
    keyed = df.withColumn("_band", F.when(known, F.col(band)).otherwise("Moderate"))
    return keyed.join(F.broadcast(advice), "_band", "left").drop("_band")


def priority_areas(clusters: DataFrame, wards: DataFrame) -> DataFrame:
    """Clusters, then candidate stations that belong to none (label -1), in one shape."""
    hot = clusters.select(
        F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string")).alias("area"),
        "wards", F.col("avg_severity"), F.col("avg_pm25"), F.col("avg_pm10"), "stations",
    )
    short = F.regexp_replace(F.col("station"), ", .*$", "")
    alone = wards.filter(F.col("cluster") == -1).select(
        F.concat(F.lit("Standalone - "), short).alias("area"), F.col("ward_name").alias("wards"),
        F.round("severity", 1).alias("avg_severity"), F.lit(None).cast("double").alias("avg_pm25"),
        F.lit(None).cast("double").alias("avg_pm10"), short.alias("stations"),
    )
    return hot.unionByName(alone)


def policy_brief(areas: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Prompt per area, and the recommendation from ``texts`` (area, text) or the fixed fallback."""

    def show(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("N/A"))

    prompt = F.concat(
        F.lit(POLICY_INTRO),
        F.lit("\nHotspot Details:\n- Cluster/Station: "), F.col("area"),
        F.lit("\n- Wards involved: "), show("wards"), F.lit("\n- Included Stations: "), show("stations"),
        F.lit("\n- Average Severity Score: "), show("avg_severity"), F.lit("\n- Average PM2.5: "), show("avg_pm25"),
        F.lit("\n- Average PM10: "), show("avg_pm10"), F.lit("\n"),
    )
    out = areas.withColumn("prompt", prompt)
    if texts is None:
        return out.withColumn("recommendation_text", F.lit(POLICY_FALLBACK))
    cleaned = F.regexp_replace(F.trim(F.col("text")), "\n", " ")
    out = out.join(texts.select("area", cleaned.alias("_text")), "area", "left")
    return out.withColumn("recommendation_text", F.coalesce("_text", F.lit(POLICY_FALLBACK))).drop("_text")


def kpis(clusters: DataFrame, latest: DataFrame, reports: DataFrame, pixels: DataFrame, ward_risk: DataFrame,
         forecast: DataFrame) -> DataFrame:
    """One row of city indicators; every figure is a scalar subquery over its own table."""

    def one(df: DataFrame, value: Column) -> Column:
        return df.agg(value.alias("v")).scalar()

    n = F.count(F.lit(1))
    row = latest.sparkSession.range(1).select(
        one(clusters, n).alias("hotspot_count"),
        one(latest, F.round(F.avg("pm25"), 6)).alias("_aqi"),
        one(reports, n).alias("citizen_reports"),
        one(pixels.filter(F.col("no2") > 170.0), n).alias("satellite_alerts"),
        one(ward_risk.filter(F.col("risk_score") >= 60.0).select("ward_name").distinct(), n).alias("high_risk_wards"),
        one(forecast, F.round(F.avg("aqi_24h"), 6)).alias("_next"),
    )
    return row.select(
        "hotspot_count",
        F.floor("_aqi").cast("int").alias("avg_aqi"),
        bands.kpi_badge(F.floor("_aqi")).alias("aqi_badge"),
        "citizen_reports",
        "satellite_alerts",
        "high_risk_wards",
        F.floor("_next").cast("int").alias("predicted_aqi"),
        bands.forecast_badge(F.floor("_next")).alias("predicted_badge"),
    )


def recent_reports(reports: DataFrame, n: int = 10) -> DataFrame:
    return reports.orderBy(F.col("reported_at").desc(), F.col("report_no").desc()).limit(n)


def register_reports(events: DataFrame) -> DataFrame:
    """Report events to rows of the report table: reference id, time in UTC, formatted figures, status.

    The id comes from the other nine columns, so an event delivered again gets the id it had. Events without a time are
    registered at the present one and are new each time.
    """
    conf = F.col("confidence")
    at = F.col("reported_at")
    if isinstance(events.schema["reported_at"].dataType, T.TimestampType):
        at = F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz"))
    now = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz"))
    rows = events.select(
        F.date_format(F.coalesce(at, now), "yyyy-MM-dd HH:mm:ss").alias("Timestamp"),
        F.col("station").alias("Station"),
        F.col("incident_type").alias("Incident Type"),
        F.coalesce("file_name", F.lit("Citizen_Photo.jpg")).alias("File Name"),
        F.coalesce("category", "incident_type", F.lit("Garbage Burning")).alias("AI Category"),
        risk.confidence_text(conf).alias("AI Confidence"),
        F.concat(F.coalesce(F.col("severity").cast("int"), F.lit(75)).cast("string"), F.lit(" / 100"))
        .alias("Severity Score"),
        F.format_string("%.4f, %.4f", F.coalesce("lat", F.lit(12.9716)), F.coalesce("lon", F.lit(77.5946)))
        .alias("GPS Coords"),
        risk.report_status(conf).alias("Status"),
    )
    text = F.concat_ws("\x1f", *[F.coalesce(quoted(c), F.lit("\x00")) for c in rows.columns])
    number = F.upper(F.substring(F.sha2(text, 256), 1, REFERENCE_DIGITS))
    return rows.select(F.concat(F.lit("ARG-2026-"), number).alias("Reference ID"), *[quoted(c) for c in rows.columns])
