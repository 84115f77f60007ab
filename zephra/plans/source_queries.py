"""Queries: file sources, sinks and streams over files that Spark derives from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from zephra.fixed_values import SERIES_ALIASES, STATIONS
from zephra.functions.text import to_number, to_time, to_utc_naive
from zephra.operators.cleaning import clean_feed
from zephra.plans import bindings as b
from zephra.plans.bindings import REGISTERED_WITH_FILE_SQL, oracle
from zephra.plans.catalog import query
from zephra.scale import checkpoint_root
from zephra.sources import files
from zephra.sources.schemas import FEED_RAW
from zephra.streaming import ingest

FEED_RAW_DDL = ", ".join(f"{f.name} string" for f in FEED_RAW)


def _folder(spark) -> str:
    """A new folder in the shared checkpoint directory."""
    return f"{checkpoint_root(spark)}/files-{uuid.uuid4().hex}"


def _write_text(rows, path: str, keys: list[str], order: str) -> None:
    """One text file per key, its lines in ``order``; columns: keys, order, text."""
    placed = rows.repartition(*keys).sortWithinPartitions(*keys, order)
    placed.select(*keys, "text").write.partitionBy(*keys).option("compression", "none").format("text").save(path)


# --- monthly grids: mean order value per priority, day and hour -----------------------------------------------------

_HOURS = [f"{h:02d}:00:00" for h in range(24)]


def _grid_cells(spark, d):
    at = F.col("o_orderdate")
    return b.table(spark, d, "orders").groupBy(
        F.substring("o_orderpriority", 1, 1).alias("site"), F.year(at).alias("year"), F.month(at).alias("month"),
        F.dayofmonth(at).alias("day"), F.concat(F.lit("h"), F.col("o_orderkey") % 24).alias("hour"),
    ).agg(F.avg("o_totalprice").alias("v"))


def _grid_lines(spark, d):
    """Text lines of one grid file per site and year: year row, month rows, days 1 to 31, gaps as NA."""
    wide = _grid_cells(spark, d).groupBy("site", "year", "month", "day").pivot("hour", [f"h{h}" for h in range(24)]).agg(
        F.first("v")
    )
    months = wide.select("site", "year", "month").distinct()
    days = months.select("*", F.explode(F.sequence(F.lit(1), F.lit(31))).alias("day"))
    days = days.join(wide, ["site", "year", "month", "day"], "left")
    cell = [F.coalesce(F.col(f"h{h}").cast("string"), F.lit("NA")) for h in range(24)]
    keys = ["site", "year"]
    name = F.date_format(F.make_date("year", "month", F.lit(1)), "MMMM")
    day_rows = days.select(
        *keys, (F.col("month") * 100 + F.col("day")).alias("line"),
        F.concat_ws(",", F.col("day").cast("string"), *cell).alias("text"),
    )
    month_rows = months.select(
        *keys, (F.col("month") * 100).alias("line"),
        F.concat(name, F.lit("-"), F.col("year").cast("string"), F.lit("," + ",".join(_HOURS))).alias("text"),
    )
    year_rows = months.select(*keys).distinct().select(
        *keys, F.lit(0).alias("line"), F.concat(F.lit("Year,"), F.col("year").cast("string")).alias("text")
    )
    return day_rows.unionByName(month_rows).unionByName(year_rows)


def _site_of(path):
    return F.regexp_extract(path, "site=([0-9]+)", 1)


_GRID_SQL = """SELECT site, t AS timestamp, round(v, 4) AS value FROM (SELECT m.site, m.month + to_days(d.i::INT) + to_hours(h.j) AS t, m.month AS mon,
    m.month + to_days(d.i::INT) AS day, h.j FROM (SELECT DISTINCT substr(o_orderpriority, 1, 1) AS site, date_trunc('month', o_orderdate)::TIMESTAMP AS month
    FROM orders) m, range(0, 31) d(i), range(0, 24) h(j)) g LEFT JOIN (SELECT substr(o_orderpriority, 1, 1) AS site, o_orderdate, o_orderkey % 24 AS hh,
    avg(o_totalprice) AS v FROM orders GROUP BY 1, 2, 3) o ON o.site = g.site AND o.o_orderdate = g.day AND o.hh = g.j
    WHERE date_trunc('month', g.day) = g.mon"""


@query("S4_month_grid", _GRID_SQL.replace("SELECT site, t", "SELECT g.site, t"))
def month_grid(spark, d):
    folder = _folder(spark)
    _write_text(_grid_lines(spark, d), folder, ["site", "year"], "line")
    rows = files.read_month_grid(files.read_lines(spark, folder, "part-*"), "AQI")
    return rows.select(_site_of(F.col("path")).alias("site"), "timestamp", F.round("AQI", 4).alias("value"))


@query(
    "S3_classify_layout",
    """SELECT DISTINCT substr(o_orderpriority, 1, 1) AS site, year(o_orderdate)::VARCHAR AS year, 'monthly_grid' AS layout FROM orders
    UNION ALL SELECT DISTINCT (l_linenumber)::VARCHAR, 'table', 'tabular' FROM lineitem""",
)
def classify_layout(spark, d):
    folder = _folder(spark)
    _write_text(_grid_lines(spark, d), folder + "/grid", ["site", "year"], "line")
    table = b.table(spark, d, "lineitem").select(
        F.col("l_linenumber").alias("site"), F.lit("table").alias("year"), F.col("l_orderkey").alias("line"),
        F.concat_ws(",", "l_shipdate", "l_quantity").alias("text"),
    )
    _write_text(table, folder + "/table", ["site", "year"], "line")
    found = files.classify_layout(files.file_heads(spark, folder, "part-*"))
    return found.select(
        _site_of(F.col("path")).alias("site"), F.regexp_extract("path", "year=([0-9a-z]+)", 1).alias("year"), "layout"
    )


# --- tables ---------------------------------------------------------------------------------------------------------


@query(
    "S5_alias_csv",
    oracle(
        """SELECT station || CASE order_no % 5 WHEN 0 THEN chr(10) || 'site "B", ' || line_no ELSE '' END AS station,
        CASE WHEN part_no % 3 = 0 THEN timestamp - INTERVAL 330 MINUTE ELSE timestamp END AS timestamp, order_no, line_no,
        part_no, round(pm25, 2) AS pm25, CASE WHEN part_no % 3 < 2 THEN round(pm10, 2) END AS pm10, round(latitude, 4) AS latitude FROM readings""",
        "readings",
    ),
)
def alias_csv(spark, d):
    """Three headers, two of them the same columns in another order, and stations that go over a line break inside quotes."""
    folder = _folder(spark)
    rows = b.readings(spark, d)
    key = F.concat_ws("-", "order_no", "line_no", "part_no")
    day = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    pm25 = F.coalesce(F.col("pm25").cast("string"), F.lit("NA"))
    name = F.when(F.col("order_no") % 5 == 0, F.concat("station", F.lit('\nsite "B", '), "line_no")).otherwise(F.col("station"))
    columns = [
        key.alias("NH3 key"), name.alias("Station Name"), pm25.alias("PM2.5 (ug/m3)"), F.col("pm10").alias("PM 10"),
        F.col("latitude").alias("Lat"), F.col("longitude").alias("Lng"),
    ]
    one = rows.select("part_no", *columns, F.concat(day, F.lit("+05:30")).alias("Date_Time"))
    two = rows.select("part_no", day.alias("Date_Time"), *reversed(columns))
    three = rows.select(
        "part_no", F.col("longitude").alias("lon"), F.col("latitude").alias("lat"), pm25.alias("pm25"), day.alias("time\nstamp"),
        name.alias("station"), key.alias("nh3"),
    )
    for i, part in enumerate((one, two, three)):
        part = part.filter(F.col("part_no") % 3 == i).drop("part_no")
        part.write.option("header", "true").option("escape", '"').csv(f"{folder}/{i}")
    out = files.read_alias_csv(spark, files.file_heads(spark, folder), SERIES_ALIASES)
    keys = F.split("NH3", "-")
    return out.select(
        "station", to_utc_naive(F.col("timestamp")).alias("timestamp"),
        *[keys[i].cast("long").alias(n) for i, n in enumerate(b.READING_KEY)],
        F.round(to_number(F.col("`PM2.5`")), 2).alias("pm25"), F.round(to_number(F.col("PM10")), 2).alias("pm10"),
        F.round(to_number(F.col("latitude")), 4).alias("latitude"),
    )


@query(
    "S1_S2_S8_tabular_roundtrip",
    """SELECT p_partkey::VARCHAR AS p_partkey, CASE p_partkey % 3 WHEN 0 THEN NULL ELSE p_name END AS p_name,
    CASE WHEN p_partkey % 2 = 1 OR p_size % 4 = 1 THEN NULL ELSE p_type END AS p_type,
    CASE WHEN p_partkey % 2 = 1 THEN p_brand || chr(10) || p_size END AS note, folder, n_files FROM part,
    (SELECT 2::BIGINT AS n_files), (SELECT 'a+b [1] 50%25' AS folder)""",
)
def tabular_roundtrip(spark, d):
    """Save as CSV with two headers, find the files, read them back by name with null tokens; the folder's name holds odd signs."""
    top = _folder(spark)
    folder = f"{top}/a+b [1] 50%25"
    part = b.table(spark, d, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 3 == 0, "NaN").otherwise(F.col("p_name")).alias("p_name"),
        F.when(F.col("p_size") % 4 == 1, "none").otherwise(F.col("p_type")).alias("p_type"),
        F.concat("p_brand", F.lit("\n"), F.col("p_size").cast("string")).alias("note"),
    )
    even = F.col("p_partkey") % 2 == 0
    files.save(part.filter(even).drop("note").coalesce(1), f"{folder}/even", "csv")
    files.save(part.filter(~even).select("note", "p_name", "p_partkey").coalesce(1), f"{folder}/odd", "csv")
    found = [r["path"] for r in files.list_sources(spark, [top, folder + "/missing", top]).collect()]
    read = files.read_tabular(spark, [files.literal_path(p) for p in found])
    where = {p.split(top.rsplit("/", 1)[1] + "/")[1].split("/")[0] for p in found}
    return read.withColumns({"folder": F.lit(",".join(sorted(where))), "n_files": F.lit(len(found)).cast("long")})


def _write_feed(spark, d) -> str:
    folder = _folder(spark)
    feed = b.feed(spark, d).select(
        F.lit("India").alias("country"), "state", "city", "station", "last_update", "latitude", "longitude", "pollutant_id",
        F.lit("NA").alias("pollutant_min"), F.col("event_id").cast("string").alias("pollutant_max"), "pollutant_avg",
    )
    files.save(feed, folder, "csv")
    return folder


@query(
    "S7_realtime_feed",
    oracle(
        """SELECT event_id::DOUBLE AS event_id, station, city, state, last_update, pollutant_id, pollutant_avg FROM feed""",
        "feed",
    ),
)
def realtime_feed(spark, d):
    rows = clean_feed(files.read_feed(spark, _write_feed(spark, d)))
    return rows.select(
        F.col("pollutant_max").alias("event_id"), "station", "city", "state", "last_update", "pollutant_id", "pollutant_avg"
    )


@query(
    "S10_read_reports",
    oracle(
        """SELECT reference_id AS "Reference ID", CASE report_no % 3 WHEN 0 THEN 'N/A' ELSE strftime(reported_at, '%Y-%m-%d %H:%M:%S') END AS "Timestamp",
        station AS "Station", incident_type AS "Incident Type", CASE report_no % 3 WHEN 1 THEN 'photo_' || report_no || '.jpg' ELSE 'N/A' END AS "File Name",
        CASE report_no % 3 WHEN 0 THEN incident_type ELSE 'N/A' END AS "AI Category", printf('%.1f%%', confidence) AS "AI Confidence",
        severity || ' / 100' AS "Severity Score", printf('%.4f, %.4f', lat, lon) AS "GPS Coords", status AS "Status" FROM reports""",
        "reports",
    ),
)
def read_reports(spark, d):
    """One folder whose files lack different columns, in different orders, and rows appended to it; read back with ``N/A``."""
    folder = _folder(spark)
    r = b.reports(spark, d).withColumn("Timestamp", F.date_format("Timestamp", "yyyy-MM-dd HH:mm:ss"))
    part = lambda i: r.filter(F.col("report_no") % 3 == i).drop("report_no")
    files.append_reports(part(2).drop("File Name", "AI Category"), folder)
    for rows in (part(0).drop("Timestamp", "File Name"), part(1).drop("AI Category").select(*reversed(part(1).drop("AI Category").columns))):
        rows.write.mode("append").option("header", "true").option("escape", '"').csv(folder)
    return files.read_reports(spark, folder)


@query(
    "U1_O1_load_series",
    oracle(
        f"""SELECT station, timestamp, round(pm25, 4) AS pm25, round(pm10, 4) AS pm10 FROM readings UNION ALL
        SELECT 'part', timestamp, value, NULL FROM ({_GRID_SQL.replace("SELECT site, t", "SELECT g.site, t")})""",
        "readings",
    ),
)
def load_series(spark, d):
    """Grids and tables of one folder tree to one ordered series."""
    folder = _folder(spark)
    _write_text(_grid_lines(spark, d), folder + "/grid", ["site", "year"], "line")
    rows = b.readings(spark, d).select(
        F.col("station").alias("Station"), F.col("timestamp").alias("Datetime"), F.col("pm25").alias("PM2.5"), F.col("pm10").alias("PM10"),
        F.col("latitude").alias("Latitude"), F.col("longitude").alias("Longitude"),
    )
    files.save(rows, folder + "/live", "csv")
    out = files.load_series(spark, [folder, folder + "/gone"], STATIONS, pattern="part-*")
    # A grid names its station by its file name, here the part name that Spark gave it.
    return out.select(
        "station", "timestamp", F.round("`PM2.5`", 4).alias("pm25"), F.round("PM10", 4).alias("pm10")
    ).withColumn("station", F.regexp_replace("station", "^part .*$", "part"))


# --- streams --------------------------------------------------------------------------------------------------------


def _put(rows, folder: str, part, fmt: str) -> None:
    """Files for the rows of ``part``, added to a folder."""
    writer = rows.filter(part).write.mode("append").format(fmt)
    (writer.option("header", "true").option("escape", '"') if fmt == "csv" else writer).save(folder)


def _late(rows, time: str):
    """Rows more than nine days older than the newest: they are delivered in a second run."""
    newest = rows.agg(F.max(time).alias("t")).scalar()
    return F.coalesce(F.col(time) < newest - F.expr("INTERVAL 9 DAYS"), F.lit(False))


def _in_two_runs(rows, late, fmt: str, run) -> None:
    """Newer rows first, then the late ones, then a third run with nothing new."""
    folder = _folder(rows.sparkSession)
    for part in (~late, late):
        _put(rows, folder, part, fmt)
        run(folder).awaitTermination()
    run(folder).awaitTermination()


@query(
    "T1_stream_readings",
    oracle(
        """SELECT station, last_update, pollutant_id, max(pollutant_avg) AS pollutant_avg FROM feed WHERE last_update IS NOT NULL GROUP BY 1, 2, 3""",
        "feed",
    ),
)
def stream_readings(spark, d):
    """Live folder merged in two runs, the second with rows more than nine days older; one row per station, time, pollutant."""
    target = _folder(spark)
    feed = b.feed(spark, d).select(
        F.lit("India").alias("country"), "state", "city", "station", "last_update", "latitude", "longitude", "pollutant_id",
        F.lit("NA").alias("pollutant_min"), F.col("event_id").cast("string").alias("pollutant_max"), "pollutant_avg",
    )
    timed = feed.withColumn("_at", to_time(F.col("last_update")))
    late = _late(timed, "_at")

    def run(folder):
        rows = ingest.stream_readings(spark, folder, schema=f"{FEED_RAW_DDL}, _at string")
        return ingest.run_readings(rows, target, target + "-state")

    _in_two_runs(timed, late, "csv", run)
    return ingest.current_readings(spark, target).select("station", "last_update", "pollutant_id", "pollutant_avg")


def _events(spark, d):
    r = b.parse_reports(b.reports(spark, d))
    return r.select(
        "station", F.concat(F.lit("Ward of "), "station").alias("ward_name"), "incident_type",
        F.concat(F.lit("photo_"), F.col("report_no").cast("string")).alias("file_name"), F.col("incident_type").alias("category"),
        "confidence", F.col("severity").cast("double").alias("severity"), "lat", "lon",
        F.date_format("reported_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("reported_at"),
        F.col("reported_at").alias("_at"),
    )


@query(
    "T2_stream_alerts",
    oracle(
        """SELECT date_trunc('day', reported_at)::TIMESTAMP AS window_start, 'Ward of ' || station AS ward_name, count(*) AS alerts,
        max(severity)::DOUBLE AS top_score FROM reports WHERE severity > 75 OR contains(incident_type, 'Burning')
        OR contains(incident_type, 'Industrial') GROUP BY 1, 2""",
        "reports",
    ),
)
def stream_alerts(spark, d):
    """Windowed alerts per ward, the older reports arriving last."""
    target, events = _folder(spark), _events(spark, d)
    _in_two_runs(events, _late(events, "_at"), "json", lambda f: ingest.run_alerts(ingest.stream_reports(spark, f), target, target + "-state"))
    return ingest.current_alerts(spark, target)


@query("T2_S9_stream_intake", oracle(REGISTERED_WITH_FILE_SQL, "reports"))
def stream_intake(spark, d):
    """Report events registered by the intake stream, some of them delivered twice and the older ones late."""
    target, events = _folder(spark), _events(spark, d)
    twice = events.unionByName(events.filter(F.col("severity") % 3 == 0))
    _in_two_runs(twice, _late(events, "_at"), "json", lambda f: ingest.run_intake(ingest.stream_reports(spark, f), target, target + "-state"))
    return ingest.current_reports(spark, target)
