"""Risk fusion, alert rules and the 24-hour curve."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from zephra.fixed_values import RISK_WEIGHTS
from zephra.functions.text import round_stable


def at_most(c: Column, high: float) -> Column:
    """``least`` skips NULL, so a missing reading would score the maximum; here it stays NULL."""
    return F.when(c > high, F.lit(float(high))).otherwise(c)


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c < low, F.lit(float(low))).otherwise(at_most(c, high))


def sub_scores(
    pm25: Column, citizen: Column, no2: Column, traffic: Column, humidity: Column, wind: Column
) -> dict[str, Column]:
    damp = F.when(humidity > 70, 15.0).otherwise(0.0)
    calm = F.when(wind < 6, 20.0).otherwise(0.0)
    return {
        "sensor": at_most(pm25 / 150.0 * 100.0, 100),
        "citizen": clip(citizen, 0, 100),
        "satellite": at_most(no2 / 200.0 * 100.0, 100),
        "traffic": clip(traffic, 0, 100),
        "meteorology": at_most(damp + calm + 30.0, 100),
    }


def risk_score(scores: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for name, _, weight in RISK_WEIGHTS:
        total = total + F.lit(weight) * scores[name]
    return round_stable(clip(total, 0, 100), 1)


def contributions(scores: dict[str, Column]) -> Column:
    pairs = []
    for name, label, weight in RISK_WEIGHTS:
        pairs += [F.lit(label), round_stable(F.lit(weight) * scores[name], 1)]
    return F.create_map(*pairs)


def is_alert(score: Column, kind: Column) -> Column:
    return (score > 75.0) | kind.contains("Burning") | kind.contains("Industrial")


def alert_priority(score: Column) -> Column:
    return F.when(score >= 80.0, "CRITICAL").when(score >= 65.0, "HIGH").otherwise("MODERATE")


def plan_branch(kind: Column, ward: Column) -> Column:
    return (
        F.when(kind.contains("Burning"), "burning")
        .when(kind.contains("Industrial") | ward.contains("Peenya"), "industrial")
        .otherwise("ambient")
    )


def alert_reason(ward: Column, kind: Column, score: Column) -> Column:
    return F.concat(
        F.lit("Unmitigated "), F.lower(kind), F.lit(" detected in "), ward,
        F.lit(" with rising PM2.5 levels and high satellite NO₂ column density anomaly (Risk Score: "),
        F.format_string("%.1f", score), F.lit("/100)."),
    )


def confidence_text(x: Column) -> Column:
    share = F.coalesce(x, F.lit(0.85))
    return F.format_string("%.1f%%", F.bround(F.when(share <= 1.0, share * 100.0).otherwise(share), 1))


def report_status(x: Column) -> Column:
    share = F.coalesce(x, F.lit(0.85))
    share = F.when(share <= 1.0, share).otherwise(share / 100.0)
    return F.when(share >= 0.70, "Verified").otherwise("Pending")


def surface_pm25(no2: Column, aod: Column) -> Column:
    return F.round(no2 * 0.55 + aod * 60.0, 1)


def trajectory(pm25: Column, mean: Column, half_width: Column) -> Column:
    """25 points of (hour, value, lower, upper) from now to the forecast mean."""

    def point(h: Column) -> Column:
        f = h.cast("double") / 24.0
        value = (pm25 * 1.1 * (1.0 - f) + mean * f) * (1.0 + 0.12 * F.sin(f * (2 * math.pi) - 1.2))
        half = half_width * (0.3 + 0.7 * f)
        return F.struct(
            h.cast("int").alias("hour"),
            round_stable(value, 1).alias("value"),
            round_stable(F.greatest(F.lit(10.0), value - half), 1).alias("lower"),
            round_stable(value + half, 1).alias("upper"),
        )

    return F.transform(F.sequence(F.lit(0), F.lit(24)), point)
