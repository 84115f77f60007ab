"""Queries: station quality, coverage, severity."""

from __future__ import annotations

from pyspark.sql import functions as F

from zephra.operators import cleaning, quality
from zephra.plans import bindings as b
from zephra.plans.bindings import READING_KEY, oracle, rnd
from zephra.plans.catalog import query

QUALITY_SQL = """SELECT station, min(timestamp) AS date_min, max(timestamp) AS date_max, count(*) AS total_readings,
    sum((pm25 IS NULL)::BIGINT)::BIGINT AS pm25_missing, sum((pm25 IS NULL)::BIGINT) * 100.0 / count(*) AS pm25_missing_pct,
    sum((pm10 IS NULL)::BIGINT)::BIGINT AS pm10_missing, sum((pm10 IS NULL)::BIGINT) * 100.0 / count(*) AS pm10_missing_pct,
    CASE WHEN count(*) > 1 THEN epoch(max(timestamp) - min(timestamp)) / 3600.0 / (count(*) - 1) ELSE 0 END AS avg_gap_hours,
    min(latitude) AS latitude, min(longitude) AS longitude FROM readings GROUP BY station"""
COVERAGE_SQL = """SELECT y::INT AS year, coalesce(n, 0) AS readings, coalesce(m, 0) AS pm10_present,
    coalesce(m * 100.0::DOUBLE / n, 0.0::DOUBLE) AS coverage FROM range(1993, 2004) r(y) LEFT JOIN
    (SELECT year(timestamp) AS yy, count(*) AS n, count(pm10) AS m FROM readings GROUP BY 1) ON yy = y"""
CUTOFF_SQL = "SELECT max(year) AS cutoff FROM coverage WHERE coverage < 20 AND readings > 0"
SEVERITY_SQL = f"""SELECT station, min(latitude) AS latitude, min(longitude) AS longitude, {rnd('avg(pm25)', 2)} AS pm25,
    {rnd('avg(pm10) FILTER (late)', 2)} AS pm10,
    {rnd('''(coalesce(sum(pm25) FILTER (early), 0) + 0.7::DOUBLE * coalesce(sum(pm25) FILTER (late), 0)
      + 0.3::DOUBLE * coalesce(sum(pm10) FILTER (late), 0))
      / (count(pm25) FILTER (early) + count(*) FILTER (late))''', 2)} AS severity,
    'adaptive (pre-' || (max(cutoff) + 1) || ': PM2.5 only; ' || (max(cutoff) + 1) || '+: weighted)' AS scoring_note
    FROM (SELECT *, year(timestamp) <= cutoff AS early,
      year(timestamp) > cutoff AND pm25 IS NOT NULL AND pm10 IS NOT NULL AS late FROM readings, cut)
    GROUP BY station HAVING count(pm25) FILTER (early) + count(*) FILTER (late) > 0"""
SEVERITY_CTES = {"coverage": COVERAGE_SQL, "cut": CUTOFF_SQL, "severity_by_station": SEVERITY_SQL}


def coverage(spark, d):
    return quality.coverage_by_year(b.readings(spark, d).select("timestamp", "pm10"), 1993, 2003)


def cutoff(spark, d):
    return quality.sparse_cutoff(coverage(spark, d))


def severity(spark, d):
    return quality.station_severity(b.readings(spark, d), cutoff(spark, d).scalar(), READING_KEY)


def ward_lookup(spark, d):
    """Station to ward name by nation; every seventh station has no ward."""
    return b.stations(spark, d).filter(F.col("pos") % 7 != 3).select(
        "station", F.concat(F.lit("Ward_"), F.col("s_nationkey").cast("string")).alias("ward_name")
    )


WARD_LOOKUP_SQL = "SELECT station, 'Ward_' || s_nationkey AS ward_name FROM stations WHERE pos % 7 <> 3"


@query(
    "A6_station_quality",
    oracle(
        """SELECT station, strftime(date_min, '%Y-%m-%d') || ' to ' || strftime(date_max, '%Y-%m-%d') AS date_range, date_min,
        date_max, total_readings, pm25_missing, round(pm25_missing_pct, 6)::DOUBLE AS pm25_missing_pct, pm10_missing,
        round(pm10_missing_pct, 6)::DOUBLE AS pm10_missing_pct, round(avg_gap_hours, 6) AS avg_gap_hours,
        round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM quality""",
        "readings", extra={"quality": QUALITY_SQL},
    ),
)
def station_quality(spark, d):
    out = quality.station_quality(b.readings(spark, d), READING_KEY)
    return out.withColumns(
        {c: F.round(c, 6) for c in ("pm25_missing_pct", "pm10_missing_pct", "avg_gap_hours", "latitude", "longitude")}
    )


@query(
    "F11_split_quality",
    oracle(
        """SELECT station, CASE WHEN pm25_missing_pct > 20 THEN 'dropped' ELSE 'valid' END AS verdict FROM quality""",
        "readings", extra={"quality": QUALITY_SQL},
    ),
)
def split_quality(spark, d):
    valid, dropped = quality.split_quality(quality.station_quality(b.readings(spark, d), READING_KEY), 20.0)
    return valid.select("station", F.lit("valid").alias("verdict")).unionByName(
        dropped.select("station", F.lit("dropped").alias("verdict"))
    )


@query(
    "J2_keep_valid",
    oracle(
        """SELECT station, timestamp, order_no, line_no, part_no, pm25 FROM readings WHERE station IN
        (SELECT station FROM quality WHERE pm25_missing_pct <= 20)""",
        "readings", extra={"quality": QUALITY_SQL},
    ),
)
def keep_valid(spark, d):
    rows = b.readings(spark, d)
    valid, _ = quality.split_quality(quality.station_quality(rows, READING_KEY), 20.0)
    return quality.keep_valid(rows.select("station", "timestamp", *READING_KEY, "pm25"), valid)


@query(
    "A7_coverage_by_year",
    oracle("SELECT year, readings, pm10_present, round(coverage, 6) AS coverage FROM coverage", "readings",
           extra={"coverage": COVERAGE_SQL}),
)
def coverage_by_year(spark, d):
    return coverage(spark, d).withColumn("coverage", F.round("coverage", 6))


@query("A8_sparse_cutoff", oracle("SELECT cutoff FROM cut", "readings", extra={"coverage": COVERAGE_SQL, "cut": CUTOFF_SQL}))
def sparse_cutoff(spark, d):
    return cutoff(spark, d)


@query(
    "F13_tag_severity",
    oracle(
        """SELECT station, timestamp, order_no, line_no, part_no, round(CASE WHEN year(timestamp) <= cutoff THEN pm25
        WHEN pm25 IS NOT NULL AND pm10 IS NOT NULL THEN 0.7::DOUBLE * pm25 + 0.3::DOUBLE * pm10 ELSE pm25 END, 6) AS row_severity,
        CASE WHEN year(timestamp) <= cutoff THEN 'pm25_only' WHEN pm25 IS NOT NULL AND pm10 IS NOT NULL THEN 'weighted'
        WHEN pm25 IS NOT NULL THEN 'pm25_only' ELSE 'weighted' END AS severity_formula FROM readings, cut""",
        "readings", extra={"coverage": COVERAGE_SQL, "cut": CUTOFF_SQL},
    ),
)
def tag_severity(spark, d):
    out = quality.tag_severity(b.readings(spark, d), cutoff(spark, d).scalar())
    return out.select("station", "timestamp", *READING_KEY, F.round("row_severity", 6).alias("row_severity"), "severity_formula")


@query(
    "A13_formula_counts",
    oracle(
        """SELECT label, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM readings), 6) AS share FROM (
        SELECT CASE WHEN year(timestamp) <= cutoff THEN 'pm25_only' WHEN pm25 IS NOT NULL AND pm10 IS NOT NULL THEN 'weighted'
        WHEN pm25 IS NOT NULL THEN 'pm25_only' ELSE 'weighted' END AS label FROM readings, cut) GROUP BY 1""",
        "readings", extra={"coverage": COVERAGE_SQL, "cut": CUTOFF_SQL},
    ),
)
def formula_counts(spark, d):
    tagged = quality.tag_severity(b.readings(spark, d).select("timestamp", "pm25", "pm10"), cutoff(spark, d).scalar())
    return cleaning.value_counts(tagged, "severity_formula").withColumn("share", F.round("share", 6))


_SEVERITY_OUT = """station, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, pm25, pm10, severity, scoring_note"""


@query(
    "A9_station_severity",
    oracle(f"SELECT {_SEVERITY_OUT} FROM severity_by_station", "readings", extra=SEVERITY_CTES),
)
def station_severity(spark, d):
    return severity(spark, d).withColumns({c: F.round(c, 6) for c in ("latitude", "longitude")})


@query(
    "J1_join_ward",
    oracle(
        "SELECT r.station, timestamp, order_no, line_no, part_no, coalesce(ward_name, 'Unknown') AS ward_name FROM readings r LEFT JOIN w ON w.station = r.station",
        "readings", "stations", extra={"w": WARD_LOOKUP_SQL},
    ),
)
def join_ward(spark, d):
    return quality.join_ward(b.readings(spark, d).select("station", "timestamp", *READING_KEY), ward_lookup(spark, d))


@query(
    "J4_enrich_wards",
    oracle(
        "SELECT w.station, ward_name, pm25, pm10, severity, scoring_note FROM w LEFT JOIN severity_by_station s ON s.station = w.station",
        "readings", "stations", extra={**SEVERITY_CTES, "w": WARD_LOOKUP_SQL},
    ),
)
def enrich_wards(spark, d):
    return quality.enrich(ward_lookup(spark, d), severity(spark, d))
