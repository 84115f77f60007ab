"""Declared schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

from zephra.fixed_values import POLLUTANTS, REPORT_COLUMNS


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


def _doubles(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


# As delivered: numbers and times are text until cleaned.
FEED_RAW = T.StructType(
    _strings(
        "country", "state", "city", "station", "last_update", "latitude", "longitude",
        "pollutant_id", "pollutant_min", "pollutant_max", "pollutant_avg",
    )
)
SERIES = T.StructType(
    [
        *_strings("station"),
        T.StructField("timestamp", T.TimestampNTZType()),
        *_doubles(*POLLUTANTS, "latitude", "longitude"),
    ]
)
MASTER = T.StructType(
    [
        *_strings("station_name"),
        T.StructField("datetime", T.TimestampNTZType()),
        *_doubles(*POLLUTANTS, "AQI", "latitude", "longitude"),
    ]
)
GEOJSON = T.StructType(
    [
        T.StructField(
            "features",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
                        T.StructField("geometry", T.StructType(_strings("type", "coordinates"))),
                    ]
                )
            ),
        )
    ]
)
REPORT_EVENTS = T.StructType(
    [
        *_strings("station", "ward_name", "incident_type", "file_name", "category"),
        *_doubles("confidence", "severity", "lat", "lon"),
        T.StructField("reported_at", T.TimestampType()),
    ]
)
REPORTS = T.StructType(_strings(*REPORT_COLUMNS))
FEED_CLEAN = T.StructType(
    [
        *_strings("station", "city", "state"),
        *_doubles("latitude", "longitude"),
        T.StructField("last_update", T.TimestampNTZType()),
        *_strings("pollutant_id"),
        *_doubles("pollutant_min", "pollutant_max", "pollutant_avg"),
    ]
)
ALERTS = T.StructType(
    [
        T.StructField("window_start", T.TimestampNTZType()),
        *_strings("ward_name"),
        T.StructField("alerts", T.LongType()),
        *_doubles("top_score"),
    ]
)
