"""Queries: scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from zephra.fixed_values import ACTIONS, ADVISORIES, HIDDEN_LABEL, PLANS, RISK_WEIGHTS, ZONES  # noqa: F401
from zephra.functions import bands, geo, risk
from zephra.operators import features, fusion
from zephra.plans import bindings as b
from zephra.plans.bindings import READING_KEY, REGISTERED_SQL, oracle
from zephra.plans.catalog import query
from zephra.plans.feature_queries import band_sql, daily, season_sql

ROW = ["station", "timestamp", *READING_KEY]
_ROW = "station, timestamp, order_no, line_no, part_no"


@query("C1_pm25_band", oracle(f"SELECT {_ROW}, {band_sql('pm25', repr('Unknown'))} AS dashboard_band, {band_sql('pm25')} AS target_band FROM readings", "readings"))
def pm25_band(spark, d):
    return b.readings(spark, d).select(
        *ROW, bands.pm25_band(F.col("pm25"), "Unknown").alias("dashboard_band"),
        bands.pm25_band(F.col("pm25")).alias("target_band"),
    )


@query(
    "C2_aqi_band",
    oracle(
        f"""SELECT {_ROW}, CASE WHEN a <= 50 THEN 'Good' WHEN a <= 100 THEN 'Moderate' WHEN a <= 200 THEN
        'Unhealthy for Sensitive Groups' WHEN a <= 300 THEN 'Severe / Unhealthy' WHEN a > 300 THEN 'Hazardous' END AS band
        FROM (SELECT *, pm25 * 3.0::DOUBLE AS a FROM readings)""",
        "readings",
    ),
)
def aqi_band(spark, d):
    return b.readings(spark, d).select(*ROW, bands.aqi_band(F.col("pm25") * 3.0).alias("band"))


@query(
    "C3_C4_calendar",
    f"""SELECT o_orderkey, (isodow(o_orderdate) - 1)::INT AS day_of_week, month(o_orderdate)::INT AS month,
    year(o_orderdate)::INT AS year, {season_sql('month(o_orderdate)')} AS season FROM orders""",
)
def calendar(spark, d):
    cal = features.calendar("o_orderdate")
    return b.table(spark, d, "orders").select("o_orderkey", *[c.alias(n) for n, c in cal.items()])


_HAV = """2 * 6371.0::DOUBLE * atan2(sqrt(h), sqrt(1 - h)) FROM (SELECT *, pow(sin(radians({lat2} - {lat1}) / 2), 2)
    + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2) AS h FROM {src})"""


def haversine_sql(lat1, lon1, lat2, lon2) -> str:
    h = (f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
         f" * pow(sin(radians({lon2} - {lon1}) / 2), 2))")
    return f"(2 * 6371.0::DOUBLE * atan2(sqrt({h}), sqrt(1 - {h})))"


@query(
    "C5_C6_distances",
    oracle(
        f"""SELECT pixel_id, round({haversine_sql('12.97::DOUBLE', '77.59::DOUBLE', 'latitude', 'longitude')}, 6) AS km,
        round(sqrt((latitude - 12.97::DOUBLE) * (latitude - 12.97::DOUBLE) + (longitude - 77.59::DOUBLE) * (longitude - 77.59::DOUBLE))
        * 111.0::DOUBLE, 6) AS flat_km FROM pixels""",
        "pixels",
    ),
)
def distances(spark, d):
    lat, lon = F.col("latitude"), F.col("longitude")
    return b.pixels(spark, d).select(
        "pixel_id", F.round(geo.haversine_km(F.lit(12.97), F.lit(77.59), lat, lon), 6).alias("km"),
        F.round(geo.deg_to_km(geo.degrees_apart(lat, lon, F.lit(12.97), F.lit(77.59))), 6).alias("flat_km"),
    )


@query(
    "C8_confidence_and_status",
    """SELECT o_orderkey, CASE WHEN x IS NULL THEN '85.0%' ELSE printf('%.1f%%', CASE WHEN x <= 1 THEN x * 100 ELSE x END) END
    AS confidence, CASE WHEN coalesce(CASE WHEN x <= 1 THEN x ELSE x / 100 END, 0.85) >= 0.70 THEN 'Verified' ELSE 'Pending' END
    AS status FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN (o_orderkey % 100)::DOUBLE / 128.0::DOUBLE
    ELSE (o_orderkey % 99 + 2)::DOUBLE + 0.25::DOUBLE END AS x FROM orders)""",
)
def confidence_and_status(spark, d):
    k = F.col("o_orderkey")
    x = F.when(k % 4 == 0, None).when(k % 4 == 1, (k % 100).cast("double") / 128.0).otherwise(
        (k % 99 + 2).cast("double") + 0.25
    )
    return b.table(spark, d, "orders").select(
        k, risk.confidence_text(x).alias("confidence"), risk.report_status(x).alias("status")
    )


@query(
    "C11_C12_satellite",
    oracle(
        """SELECT pixel_id, round(no2 * 0.55::DOUBLE + aod * 60.0::DOUBLE, 1) AS pm25_est, CASE WHEN no2 > 170 THEN 'very high'
        WHEN no2 > 120 THEN 'high' WHEN no2 > 80 THEN 'moderate' ELSE 'low' END AS no2_band, CASE WHEN no2 > 170 THEN 18
        WHEN no2 > 120 THEN 14 WHEN no2 > 80 THEN 11 ELSE 8 END AS radius FROM pixels""",
        "pixels",
    ),
)
def satellite(spark, d):
    no2 = F.col("no2")
    return b.pixels(spark, d).select(
        "pixel_id", risk.surface_pm25(no2, F.col("aod")).alias("pm25_est"), bands.no2_band(no2).alias("no2_band"),
        bands.no2_radius(no2).alias("radius"),
    )


ZONE_SQL = (
    f"CASE WHEN {{lat}} > 13.0::DOUBLE THEN '{ZONES['north']}' WHEN {{lat}} < 12.93::DOUBLE AND {{lon}} > 77.6::DOUBLE THEN "
    f"'{ZONES['southeast']}' WHEN {{lon}} < 77.55::DOUBLE THEN '{ZONES['west']}' ELSE '{ZONES['centre']}' END"
)


@query("C13_zone_name", oracle(f"SELECT report_no, {ZONE_SQL.format(lat='lat', lon='lon')} AS zone FROM reports", "reports"))
def zone_name(spark, d):
    return b.parse_reports(b.reports(spark, d)).select("report_no", bands.zone_name(F.col("lat"), F.col("lon")).alias("zone"))


def _signals(spark, d):
    """Per reading, the six inputs of the risk score."""
    q = F.col("l_quantity")
    return b.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (q * 4.0).alias("pm25"), (F.col("l_discount") * 1200.0).alias("citizen"), (q * 5.0).alias("no2"),
        (F.col("l_linenumber") * 17.0).alias("traffic"), (q + 40.0).alias("humidity"), (q / 4.0).alias("wind"),
    )


_SCORES = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(100, l_quantity * 4.0::DOUBLE / 150.0::DOUBLE * 100.0::DOUBLE) AS s1,
    least(100, greatest(0, l_discount * 1200.0::DOUBLE)) AS s2, least(100, l_quantity * 5.0::DOUBLE / 200.0::DOUBLE * 100.0::DOUBLE) AS s3,
    least(100, l_linenumber * 17.0::DOUBLE) AS s4, least(100, CASE WHEN l_quantity + 40 > 70 THEN 15.0::DOUBLE ELSE 0 END
    + CASE WHEN l_quantity / 4.0::DOUBLE < 6 THEN 20.0::DOUBLE ELSE 0 END + 30.0::DOUBLE) AS s5 FROM lineitem"""
_TOTAL = "0.0::DOUBLE + " + " + ".join(f"{w}::DOUBLE * s{i + 1}" for i, (_, _, w) in enumerate(RISK_WEIGHTS))
_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(
    "C14_C15_risk_score",
    oracle(
        f"""SELECT {_LINE}, {", ".join(f"round(s{i + 1}, 4) AS {n}" for i, (n, _, _) in enumerate(RISK_WEIGHTS))}, risk_score,
        CASE WHEN risk_score >= 80 THEN 'Critical' WHEN risk_score >= 60 THEN 'High' WHEN risk_score >= 35 THEN 'Moderate'
        ELSE 'Low' END AS risk_class FROM (SELECT *, {b.rnd(f'least(100, {_TOTAL})', 1)} AS risk_score FROM scores)""",
        extra={"scores": _SCORES},
    ),
)
def risk_score(spark, d):
    s = risk.sub_scores(*[F.col(c) for c in ("pm25", "citizen", "no2", "traffic", "humidity", "wind")])
    score = risk.risk_score(s)
    return _signals(spark, d).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.round(c, 4).alias(n) for n, c in s.items()],
        score.alias("risk_score"), bands.risk_class(score).alias("risk_class"),
    )


@query(
    "C16_contributions",
    oracle(
        " UNION ALL ".join(
            f"SELECT {_LINE}, '{label}' AS signal, {b.rnd(f'{w}::DOUBLE * s{i + 1}', 1)} AS contribution FROM scores"
            for i, (_, label, w) in enumerate(RISK_WEIGHTS)
        ),
        extra={"scores": _SCORES},
    ),
)
def contributions(spark, d):
    s = risk.sub_scores(*[F.col(c) for c in ("pm25", "citizen", "no2", "traffic", "humidity", "wind")])
    return _signals(spark, d).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.explode(risk.contributions(s)).alias("signal", "contribution"),
    )


def _alerts(spark, d):
    """Reports as alert candidates: severity as risk score, some of them in Peenya."""
    r = b.parse_reports(b.reports(spark, d))
    ward = F.when(F.col("report_no") % 5 == 0, "Peenya Industrial Area").otherwise(
        F.concat(F.lit("Ward of "), F.col("station"))
    )
    return fusion.with_alert(
        r.select("report_no", "incident_type", ward.alias("ward_name"), F.col("severity").cast("double").alias("risk_score"))
    )


_ALERT = """SELECT report_no, incident_type, ward_name, risk_score, (risk_score > 75 OR contains(incident_type, 'Burning')
    OR contains(incident_type, 'Industrial')) AS is_triggered, CASE WHEN risk_score >= 80 THEN 'CRITICAL' WHEN risk_score >= 65
    THEN 'HIGH' ELSE 'MODERATE' END AS priority, 'Unmitigated ' || lower(incident_type) || ' detected in ' || ward_name ||
    ' with rising PM2.5 levels and high satellite NO₂ column density anomaly (Risk Score: ' || printf('%.1f', risk_score) ||
    '/100).' AS reason, CASE WHEN contains(incident_type, 'Burning') THEN 'burning' WHEN contains(incident_type, 'Industrial')
    OR contains(ward_name, 'Peenya') THEN 'industrial' ELSE 'ambient' END AS branch FROM (SELECT report_no, incident_type,
    CASE WHEN report_no % 5 = 0 THEN 'Peenya Industrial Area' ELSE 'Ward of ' || station END AS ward_name,
    severity::DOUBLE AS risk_score FROM reports)"""


@query("C17_C19_alerts", oracle("SELECT * FROM alerts", "reports", extra={"alerts": _ALERT}))
def alerts(spark, d):
    return _alerts(spark, d)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)


@query(
    "C18_action_plan",
    oracle(
        f"""SELECT report_no, branch, action_no, title, stars, cost, impact, dept, responsible_dept, budget, reduction, population
        FROM alerts JOIN (VALUES {_values(PLANS)}) p(branch, responsible_dept, budget, reduction, population) USING (branch)
        JOIN (VALUES {_values(ACTIONS)}) a(branch, action_no, title, description, stars, cost, impact, dept) USING (branch)""",
        "reports", extra={"alerts": _ALERT},
    ),
)
def action_plan(spark, d):
    return fusion.action_plan(_alerts(spark, d)).select(
        "report_no", "branch", "action_no", "title", "stars", "cost", "impact", "dept", "responsible_dept", "budget",
        "reduction", "population",
    )


@query(
    "C18_plan_totals",
    oracle(
        f"""SELECT branch, count(DISTINCT report_no) AS alerts, round(sum(lakhs), 1) AS lakhs, sum(cut)::BIGINT AS cut_points FROM alerts JOIN
        (SELECT branch, regexp_extract(cost, '₹([0-9.]+)', 1)::DOUBLE AS lakhs, regexp_extract(impact, '^-([0-9]+)%', 1)::INT AS cut
        FROM (VALUES {_values(ACTIONS)}) a(branch, action_no, title, description, stars, cost, impact, dept)) USING (branch)
        GROUP BY 1""",
        "reports", extra={"alerts": _ALERT},
    ),
)
def plan_totals(spark, d):
    """Cost and impact over all alerts, from the parsed texts of the actions."""
    rows = fusion.action_plan(_alerts(spark, d))
    return rows.groupBy("branch").agg(
        F.sum((F.col("action_no") == 1).cast("long")).alias("alerts"),
        F.round(F.sum(fusion.lakhs(F.col("cost"))), 1).alias("lakhs"),
        F.sum(fusion.percent_cut(F.col("impact"))).alias("cut_points"),
    )


@query(
    "C20_advisory",
    oracle(
        f"""SELECT {_ROW}, x.band, title, advisory FROM (SELECT *, {band_sql('pm25', repr('Unknown'))} AS band FROM readings) x
        JOIN (VALUES {_values(ADVISORIES)}) a(band, title, advisory)
        ON a.band = CASE WHEN x.band = 'Unknown' THEN 'Moderate' ELSE x.band END""",
        "readings",
    ),
)
def advisory(spark, d):
    rows = b.readings(spark, d).select(*ROW, bands.pm25_band(F.col("pm25"), "Unknown").alias("band"))
    return fusion.with_advisory(rows)


@query(
    "C21_trajectory",
    oracle(
        f"""SELECT station, hour::INT AS hour, {b.rnd('v', 1)} AS value, {b.rnd('greatest(10, v - w)', 1)} AS lower,
        {b.rnd('v + w', 1)} AS upper FROM (SELECT station, hour, (pm25 * 1.1::DOUBLE * (1 - f) + mean * f) * (1 + 0.12::DOUBLE *
        sin(f * 2 * pi() - 1.2::DOUBLE)) AS v, 12.5::DOUBLE * (0.3::DOUBLE + 0.7::DOUBLE * f) AS w FROM (SELECT *,
        hour / 24.0::DOUBLE AS f FROM (SELECT station, arg_max(pm25, date) AS pm25, avg(pm25) AS mean FROM daily GROUP BY 1),
        range(0, 25) h(hour)))""",
        "daily",
    ),
)
def trajectory(spark, d):
    """Curve from the latest value to the station's mean, half-width 12.5."""
    days = daily(spark, d).groupBy("station").agg(F.max_by("pm25", "date").alias("pm25"), F.avg("pm25").alias("mean"))
    curve = risk.trajectory(F.col("pm25"), F.col("mean"), F.lit(12.5))
    return days.select("station", F.inline(curve))


@query(
    "C22_kpi_badges",
    oracle(
        """SELECT station, date, CASE WHEN pm25 <= 50 THEN 'Good' WHEN pm25 <= 100 THEN 'Moderate' ELSE 'Poor' END AS aqi_badge,
        CASE WHEN pm25 > 100 THEN 'Unhealthy Spike' ELSE 'Moderate' END AS forecast_badge FROM daily""",
        "daily",
    ),
)
def kpi_badges(spark, d):
    return daily(spark, d).select(
        "station", "date", bands.kpi_badge(F.col("pm25")).alias("aqi_badge"),
        bands.forecast_badge(F.col("pm25")).alias("forecast_badge"),
    )


@query("C27_round_half_up", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity / 4.0::DOUBLE, 1) AS r1, round(l_quantity / 2.0::DOUBLE, 0) AS r0 FROM lineitem")
def round_half_up(spark, d):
    q = F.col("l_quantity")
    return b.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(q / 4.0, 1).alias("r1"), F.round(q / 2.0, 0).alias("r0")
    )


@query(
    "F14_elevated",
    oracle(
        f"""SELECT 'ground' AS source, count(*) AS n, round(min(pm25), 6) AS lowest FROM readings WHERE pm25 > 60
        UNION ALL SELECT 'satellite', count(*), round(min(no2), 6) FROM pixels WHERE no2 > 120""",
        "readings", "pixels",
    ),
)
def elevated(spark, d):
    def row(df, name, c):
        return df.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("n"), F.round(F.min(c), 6).alias("lowest"))

    ground = row(fusion.elevated_ground(b.readings(spark, d)), "ground", "pm25")
    return ground.unionByName(row(fusion.elevated_pixels(b.pixels(spark, d)), "satellite", "no2"))


SENSORS_SQL = "SELECT pos, s.station, latitude, longitude, pm25 FROM stations s LEFT JOIN (SELECT station, arg_max(pm25, date) AS pm25 FROM daily GROUP BY 1) l ON l.station = s.station"
POINTS_SQL = """SELECT 0 AS kind, pos AS no, latitude AS lat, longitude AS lon, pm25 / 100.0::DOUBLE AS weight, 'Ground Sensor' AS source,
    station AS label_name FROM sensors WHERE pm25 > 60 UNION ALL SELECT 1, report_no, lat, lon, severity::DOUBLE / 100.0::DOUBLE,
    'Citizen Photo Report', incident_type FROM reports UNION ALL SELECT 2, pixel_no, latitude, longitude, no2 / 150.0::DOUBLE,
    'Sentinel-5P Satellite', 'Sat Pixel ' || pixel_id FROM pixels WHERE no2 > 120"""


def sensors(spark, d):
    """Stations with their latest daily value."""
    return b.stations(spark, d).join(features.latest(daily(spark, d)).drop("date"), "station", "left")


def points(spark, d):
    return fusion.multimodal_points(sensors(spark, d), b.parse_reports(b.reports(spark, d)), b.pixels(spark, d))


@query(
    "U2_multimodal_points",
    oracle(
        "SELECT kind, no, round(lat, 6) AS lat, round(lon, 6) AS lon, round(weight, 6) AS weight, source, label_name FROM points",
        "stations", "daily", "reports", "pixels", extra={"sensors": SENSORS_SQL, "points": POINTS_SQL},
    ),
)
def multimodal_points(spark, d):
    return points(spark, d).select(
        "point_id.kind", "point_id.no", *[F.round(c, 6).alias(c) for c in ("lat", "lon", "weight")], "source", "label_name"
    )


@query(
    "O2_recent_reports",
    oracle("SELECT report_no, reference_id, reported_at, status FROM reports ORDER BY reported_at DESC, report_no DESC LIMIT 10", "reports"),
)
def recent_reports(spark, d):
    return fusion.recent_reports(
        b.parse_reports(b.reports(spark, d)).select("report_no", "reference_id", "reported_at", "status")
    )


@query(
    "S9_register_reports",
    oracle(
        REGISTERED_SQL,
        "reports",
    ),
)
def register_reports(spark, d):
    """Report rows with all ten columns; ids come from the other nine."""
    r = b.parse_reports(b.reports(spark, d))
    events = r.select(
        "station", "incident_type", F.lit(None).cast("string").alias("file_name"), F.col("incident_type").alias("category"),
        F.col("confidence"), F.col("severity").cast("double").alias("severity"), "lat", "lon", "reported_at",
    )
    return fusion.register_reports(events)
