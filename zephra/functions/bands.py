"""Threshold ladders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from zephra.fixed_values import ZONES


def ladder(value: Column, steps: list[tuple[float, object]], last: object, null: object = None) -> Column:
    """First step whose inclusive upper limit holds the value."""
    out = F.when(value.isNull(), F.lit(null))
    for limit, label in steps:
        out = out.when(value <= limit, F.lit(label))
    return out.otherwise(F.lit(last))


def pm25_band(pm25: Column, null_label: str | None = None) -> Column:
    return ladder(pm25, [(30, "Good"), (60, "Moderate"), (90, "Poor")], "Severe", null_label)


def aqi_band(aqi: Column) -> Column:
    return ladder(
        aqi,
        [(50, "Good"), (100, "Moderate"), (200, "Unhealthy for Sensitive Groups"), (300, "Severe / Unhealthy")],
        "Hazardous",
    )


def kpi_badge(aqi: Column) -> Column:
    return ladder(aqi, [(50, "Good"), (100, "Moderate")], "Poor")


def forecast_badge(aqi: Column) -> Column:
    return F.when(aqi > 100, F.lit("Unhealthy Spike")).otherwise(F.lit("Moderate"))


def no2_band(no2: Column) -> Column:
    return ladder(no2, [(80, "low"), (120, "moderate"), (170, "high")], "very high")


def no2_radius(no2: Column) -> Column:
    return ladder(no2, [(80, 8), (120, 11), (170, 14)], 18)


def risk_class(score: Column) -> Column:
    return (
        F.when(score >= 80.0, "Critical").when(score >= 60.0, "High").when(score >= 35.0, "Moderate").otherwise("Low")
    )


def season(month: Column) -> Column:
    return (
        F.when(month.isin(6, 7, 8, 9), "monsoon").when(month.isin(11, 12, 1, 2), "winter").otherwise("summer")
    )


def zone_name(lat: Column, lon: Column) -> Column:
    return (
        F.when(lat > 13.0, ZONES["north"])
        .when((lat < 12.93) & (lon > 77.6), ZONES["southeast"])
        .when(lon < 77.55, ZONES["west"])
        .otherwise(ZONES["centre"])
    )
