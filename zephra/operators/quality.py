"""Station data quality and adaptive pollution severity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephra.functions.text import round_stable
from zephra.operators.cleaning import micros

MAX_MISSING_PCT = 40.0
SPARSE_PCT = 20.0


def station_quality(ts: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """One row per station: date range, missing counts and shares, mean gap, first coordinates.

    The mean of consecutive gaps telescopes to (max - min) / (n - 1), so one combinable aggregate does it all.
    """
    at = F.struct("timestamp", *order)
    out = ts.groupBy("station").agg(
        F.min("timestamp").alias("date_min"),
        F.max("timestamp").alias("date_max"),
        F.count(F.lit(1)).alias("total_readings"),
        F.sum(F.col("pm25").isNull().cast("long")).alias("pm25_missing"),
        F.sum(F.col("pm10").isNull().cast("long")).alias("pm10_missing"),
        F.min_by(F.struct("latitude", "longitude"), at).alias("_at"),
    )
    n = F.col("total_readings")
    span = (micros(F.col("date_max")) - micros(F.col("date_min"))) / F.lit(3_600_000_000.0)
    return out.select(
        "station",
        F.concat(F.date_format("date_min", "yyyy-MM-dd"), F.lit(" to "), F.date_format("date_max", "yyyy-MM-dd"))
        .alias("date_range"),
        "date_min",
        "date_max",
        "total_readings",
        "pm25_missing",
        (F.col("pm25_missing") / n * 100.0).alias("pm25_missing_pct"),
        "pm10_missing",
        (F.col("pm10_missing") / n * 100.0).alias("pm10_missing_pct"),
        F.when(n > 1, F.try_divide(span, n - 1)).otherwise(0.0).alias("avg_gap_hours"),
        F.col("_at.latitude").alias("latitude"),
        F.col("_at.longitude").alias("longitude"),
    )


def split_quality(quality: DataFrame, max_missing: float = MAX_MISSING_PCT) -> tuple[DataFrame, DataFrame]:
    """(valid, dropped) stations."""
    bad = F.col("pm25_missing_pct") > max_missing
    return quality.filter(~bad), quality.filter(bad)


def keep_valid(ts: DataFrame, valid: DataFrame) -> DataFrame:
    return ts.join(valid.select("station"), "station", "left_semi")


def coverage_by_year(ts: DataFrame, first: int, last: int) -> DataFrame:
    """(year, readings, pm10_present, coverage %) for every year of the range; empty years have 0 %."""
    years = ts.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    counts = ts.groupBy(F.year("timestamp").alias("year")).agg(
        F.count(F.lit(1)).alias("readings"), F.count("pm10").alias("pm10_present")
    )
    out = years.join(counts, "year", "left").fillna(0, ["readings", "pm10_present"])
    share = F.coalesce(F.try_divide(F.col("pm10_present") * 100.0, F.col("readings")), F.lit(0.0))
    return out.withColumn("coverage", share)


def sparse_cutoff(coverage: DataFrame, sparse: float = SPARSE_PCT) -> DataFrame:
    """One row: the last year with readings whose coverage is below ``sparse``; NULL when there is none."""
    hit = (F.col("coverage") < sparse) & (F.col("readings") > 0)
    return coverage.agg(F.max(F.when(hit, F.col("year"))).alias("cutoff"))


def tag_severity(ts: DataFrame, cutoff: Column) -> DataFrame:
    """Adds row_severity and severity_formula to every reading."""
    pm25, pm10 = F.col("pm25"), F.col("pm10")
    rows = ts.withColumn("_early", F.coalesce(F.year("timestamp") <= cutoff, F.lit(False)))
    both = pm25.isNotNull() & pm10.isNotNull()
    return rows.select(
        *ts.columns,
        F.when(F.col("_early"), pm25).when(both, 0.7 * pm25 + 0.3 * pm10).otherwise(pm25).alias("row_severity"),
        F.when(F.col("_early"), "pm25_only").when(both, "weighted").when(pm25.isNotNull(), "pm25_only")
        .otherwise("weighted").alias("severity_formula"),
    )


def station_severity(ts: DataFrame, cutoff: Column, order: Sequence[str] = ()) -> DataFrame:
    """Severity per station in one pass: readings up to the cutoff year count with PM2.5, later ones with
    0.7 PM2.5 + 0.3 PM10 when both are there. Stations without either are dropped."""
    pm25, pm10 = F.col("pm25"), F.col("pm10")
    rows = ts.withColumn("_cut", cutoff)
    early = F.coalesce(F.year("timestamp") <= F.col("_cut"), F.lit(False))
    late = ~early & pm25.isNotNull() & pm10.isNotNull()
    out = rows.groupBy("station").agg(
        F.min_by(F.struct("latitude", "longitude"), F.struct("timestamp", *order)).alias("_at"),
        F.max("_cut").alias("_cut"),
        F.avg(pm25).alias("_all25"),
        F.sum(F.when(early, pm25)).alias("_pre25"),
        F.count(F.when(early, pm25)).alias("_npre"),
        F.sum(F.when(late, pm25)).alias("_post25"),
        F.sum(F.when(late, pm10)).alias("_post10"),
        F.sum(late.cast("long")).alias("_npost"),
    )

    def part(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0))

    total = part("_pre25") + 0.7 * part("_post25") + 0.3 * part("_post10")
    after = (F.col("_cut") + 1).cast("string")
    note = F.concat(F.lit("adaptive (pre-"), after, F.lit(": PM2.5 only; "), after, F.lit("+: weighted)"))
    mean25 = F.when(F.col("_cut").isNull(), F.try_divide(F.col("_post25"), F.col("_npost"))).otherwise(F.col("_all25"))
    return out.filter(F.col("_npre") + F.col("_npost") > 0).select(
        "station",
        F.col("_at.latitude").alias("latitude"),
        F.col("_at.longitude").alias("longitude"),
        round_stable(mean25, 2).alias("pm25"),
        round_stable(F.try_divide(F.col("_post10"), F.col("_npost")), 2).alias("pm10"),
        round_stable(total / (F.col("_npre") + F.col("_npost")), 2).alias("severity"),
        F.coalesce(note, F.lit("full weighted formula")).alias("scoring_note"),
    )


def join_ward(df: DataFrame, wards: DataFrame) -> DataFrame:
    """Left lookup of the ward by station; ``Unknown`` when there is none."""
    names = wards.select("station", "ward_name").distinct()
    return df.join(names, "station", "left").withColumn("ward_name", F.coalesce("ward_name", F.lit("Unknown")))


def enrich(wards: DataFrame, severity: DataFrame) -> DataFrame:
    """Ward map with severity columns."""
    return wards.join(severity.drop("latitude", "longitude", "ward_name"), "station", "left")
