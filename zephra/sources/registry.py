"""Station registry and the dimension tables built from fixed values (their size is fixed in code)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from zephra.fixed_values import ACTIONS, ADVISORIES, PLANS, SITE_NAMES, STATIONS


def stations(spark: SparkSession) -> DataFrame:
    rows = [(i, *s) for i, s in enumerate(STATIONS)]
    return spark.createDataFrame(rows, "pos long, station string, latitude double, longitude double, aliases array<string>")


def site_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SITE_NAMES.items()), "site string, friendly string")


def actions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        ACTIONS,
        "branch string, action_no int, title string, description string, stars string, cost string, impact string, "
        "dept string",
    )


def plans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        PLANS, "branch string, responsible_dept string, budget string, reduction string, population string"
    )


def advisories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ADVISORIES, "band string, title string, advisory string")
