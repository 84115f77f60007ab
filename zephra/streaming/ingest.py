"""Structured Streaming: live readings and citizen reports arriving as files, merged into keyed tables.

No row is too old: each batch updates the days that its rows belong to (``streaming.merge``), so the streams need neither
watermark nor state, and a file put in late counts like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from zephra.functions import risk
from zephra.operators.cleaning import clean_feed
from zephra.operators.fusion import register_reports
from zephra.sources.schemas import ALERTS, FEED_CLEAN, REPORT_EVENTS, REPORTS
from zephra.streaming.merge import BUCKET, read_merged, run_merge

FEED_STREAM = (
    "station string, city string, state string, latitude string, longitude string, last_update string, "
    "pollutant_id string, pollutant_avg string, pollutant_min string, pollutant_max string"
)
READING = ["station", "last_update", "pollutant_id"]
#: The file source passes over files this much older than the newest it has seen; by default a week, which loses late files.
_ANY_AGE = "36500d"


def stream_readings(spark: SparkSession, path: str, schema: str = FEED_STREAM) -> DataFrame:
    """New CSVs of the live folder, cleaned; rows without station or time are dropped."""
    raw = spark.readStream.schema(schema).option("header", "true").option("escape", '"').option("maxFileAge", _ANY_AGE).csv(path)
    rows = clean_feed(raw).dropna(subset=["station", "last_update"])
    return rows.select(*FEED_CLEAN.names)


def run_readings(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """One row per station, time and pollutant; of equal keys the one with the greatest values stays."""
    rest = [n for n in FEED_CLEAN.names if n not in READING]
    order = sorted(rest, key=lambda n: n != "pollutant_avg")

    def one_each(rows: DataFrame) -> DataFrame:
        best = rows.groupBy(BUCKET, *READING).agg(F.max(F.struct(*order)).alias("_r"))
        return best.select(*READING, "_r.*", BUCKET).select(*FEED_CLEAN.names, BUCKET)

    return run_merge(rows, target, checkpoint, F.to_date("last_update"), READING, one_each)


def current_readings(spark: SparkSession, target: str) -> DataFrame:
    return read_merged(spark, target, FEED_CLEAN)


def stream_reports(spark: SparkSession, path: str) -> DataFrame:
    """Report events as JSON lines arriving in ``path``."""
    return spark.readStream.schema(REPORT_EVENTS).option("maxFileAge", _ANY_AGE).json(path)


def alert_rows(events: DataFrame, window: str = "1 day") -> DataFrame:
    """(window_start in UTC, ward_name, alerts = 1, top_score) per triggered event and window that holds it."""
    hit = risk.is_alert(F.col("severity"), F.col("incident_type")) & F.col("reported_at").isNotNull()
    start = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("_w.start").cast("timestamp_ntz"))
    return events.filter(hit).withColumn("_w", F.window("reported_at", window)).select(
        start.alias("window_start"), "ward_name", F.lit(1).cast("long").alias("alerts"), F.col("severity").alias("top_score")
    )


def ward_alerts(rows: DataFrame, *more: str) -> DataFrame:
    """Number of alerts and highest score per ward and window."""
    return rows.groupBy(*more, "window_start", "ward_name").agg(
        F.sum("alerts").alias("alerts"), F.max("top_score").alias("top_score")
    )


def run_intake(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Registered reports, one row per reference id: an event delivered twice is one report."""
    rest = [n for n in REPORTS.names if n != "Reference ID"]

    def one_each(rows: DataFrame) -> DataFrame:
        # Equal ids come from equal events, so any of their rows is the report.
        return rows.groupBy(BUCKET, "Reference ID").agg(*[F.min(f"`{n}`").alias(n) for n in rest]).select(*REPORTS.names, BUCKET)

    return run_merge(register_reports(events), target, checkpoint, F.substring("Timestamp", 1, 10), ["Reference ID"], one_each)


def current_reports(spark: SparkSession, target: str) -> DataFrame:
    return read_merged(spark, target, REPORTS)


def run_alerts(events: DataFrame, target: str, checkpoint: str, window: str = "1 day") -> StreamingQuery:
    """Alert counts and highest scores per ward and window, added up over all batches.

    As a committed batch is never merged again, nothing counts twice.
    """

    def summed(rows: DataFrame) -> DataFrame:
        return ward_alerts(rows, BUCKET).select(*ALERTS.names, BUCKET)

    return run_merge(alert_rows(events, window), target, checkpoint, F.to_date("window_start"), ["window_start", "ward_name"], summed)


def current_alerts(spark: SparkSession, target: str) -> DataFrame:
    return read_merged(spark, target, ALERTS)

