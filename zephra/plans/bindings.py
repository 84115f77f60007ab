"""The given star-schema tables in the roles of air-quality tables: once as DataFrames, once as SQL for the oracle.

Both sides use the same arithmetic on the same columns. Every role reads its table whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zephra.functions.text import latlon, percent_value, score_value
from zephra.sources.geojson import ring_edges, with_bounds

POLLUTANT_OF = {"view": "PM2.5", "click": "PM10", "purchase": "NO2", "signup": "SO2", "error": "CO"}
INCIDENT_OF = {
    "1-URGENT": "Garbage Burning",
    "2-HIGH": "Industrial Smoke",
    "3-MEDIUM": "Construction Dust",
    "4-NOT SPECIFIED": "Vehicle Exhaust",
    "5-LOW": "Road Dust",
}
STATUS_OF = {"F": "Verified", "O": "Pending", "P": "Resolved"}
READING_KEY = ["order_no", "line_no", "part_no"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup(c: Column, mapping: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in mapping.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def _station(key: Column) -> Column:
    return F.concat(F.when(key % 2 == 0, "site_").otherwise("st_"), key.cast("string"))


def _latitude(key: Column) -> Column:
    return F.lit(12.85) + ((key * 37) % 100).cast("double") * 0.0027


def _longitude(key: Column) -> Column:
    return F.lit(77.45) + ((key * 61) % 100).cast("double") * 0.003


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("pos"), _station(k).alias("station"), _latitude(k).alias("latitude"), _longitude(k).alias("longitude"),
        "s_nationkey",
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        _station(k).alias("station"),
        F.col("l_shipdate").alias("timestamp"),
        F.when(F.col("l_tax") < 0.07, F.col("l_quantity") * 2.4).alias("pm25"),
        F.when((F.year("l_shipdate") > 1997) | (F.col("l_orderkey") % 10 == 0), F.col("l_quantity") * 4.0).alias("pm10"),
        _latitude(k).alias("latitude"),
        _longitude(k).alias("longitude"),
        F.col("l_orderkey").alias("order_no"),
        F.col("l_linenumber").cast("long").alias("line_no"),
        F.col("l_partkey").alias("part_no"),
    )


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long feed as text: the state in which it arrives."""
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    joined = e.join(nation, e["user_id"] % 25 == nation["n_nationkey"])
    u = F.col("user_id")
    return joined.select(
        F.col("event_id"),
        F.concat(F.lit("user_"), u.cast("string")).alias("station"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("state"),
        _latitude(u).cast("string").alias("latitude"),
        _longitude(u).cast("string").alias("longitude"),
        F.when(k % 17 == 3, "not a time").otherwise(F.date_format(F.date_trunc("hour", "ts"), "dd-MM-yyyy HH:mm:ss"))
        .alias("last_update"),
        lookup(F.col("event_type"), POLLUTANT_OF).alias("pollutant_id"),
        F.when(k % 10 == 0, "NA").otherwise(F.format_string("%.2f", F.col("value"))).alias("pollutant_avg"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citizen reports in their text form, numbered by ``report_no``."""
    n = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n")).scalar()
    o = table(spark, sf_dir, "orders").withColumn("_k", F.col("o_custkey") % n)
    no = F.col("o_orderkey")
    shift = ((no % 21) - 10).cast("double") * 0.001
    when = F.timestamp_add("SECOND", F.pmod(no * 7919, F.lit(86400)).cast("int"), F.col("o_orderdate"))
    return o.select(
        no.alias("report_no"),
        F.concat(F.lit("ARG-"), no.cast("string")).alias("Reference ID"),
        when.alias("Timestamp"),
        _station(F.col("_k")).alias("Station"),
        lookup(F.col("o_orderpriority"), INCIDENT_OF).alias("Incident Type"),
        F.concat(F.lit("photo_"), no.cast("string"), F.lit(".jpg")).alias("File Name"),
        lookup(F.col("o_orderpriority"), INCIDENT_OF).alias("AI Category"),
        F.concat(F.format_string("%.1f", 50.0 + (no % 500).cast("double") / 10.0), F.lit("%")).alias("AI Confidence"),
        F.concat((F.col("o_totalprice") / 5000.0).cast("int").cast("string"), F.lit(" / 100")).alias("Severity Score"),
        F.format_string("%.4f, %.4f", _latitude(F.col("_k")) + shift, _longitude(F.col("_k")) - shift)
        .alias("GPS Coords"),
        lookup(F.col("o_orderstatus"), STATUS_OF).alias("Status"),
    )


def parse_reports(text: DataFrame) -> DataFrame:
    """Typed columns from the packed text of a report."""
    lat, lon = latlon(F.col("GPS Coords"))
    return text.select(
        *(["report_no"] if "report_no" in text.columns else []),
        F.col("Reference ID").alias("reference_id"),
        F.col("Timestamp").alias("reported_at"),
        F.col("Station").alias("station"),
        F.col("Incident Type").alias("incident_type"),
        percent_value(F.col("AI Confidence")).alias("confidence"),
        score_value(F.col("Severity Score")).alias("severity"),
        lat.alias("lat"),
        lon.alias("lon"),
        F.col("Status").alias("status"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Satellite pixels."""

    def part(i: int) -> Column:
        return F.get("embedding", F.lit(i)).cast("double")

    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("pixel_no"),
        F.concat(F.lit("SAT-"), F.col("vec_id").cast("string")).alias("pixel_id"),
        (F.lit(12.985) + part(0) * 0.35).alias("latitude"),
        (F.lit(77.6) + part(1) * 0.35).alias("longitude"),
        (F.lit(110.0) + part(2) * 200.0).alias("no2"),
        (F.lit(0.5) + part(3)).alias("aod"),
        F.date_add(F.lit("2001-07-01").cast("date"), (F.col("vec_id") % 31).cast("int")).alias("date"),
    )


def ward_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, ward_name, rings) of 25 wards on a 5 x 5 grid, some L-shaped and some with a hole; some stations lie outside."""
    k = F.col("n_nationkey")
    x0 = F.lit(77.47) + (k % 5).cast("double") * 0.05
    y0 = F.lit(12.87) + F.floor(k / 5).cast("double") * 0.045
    base = table(spark, sf_dir, "nation").select(
        k.cast("long").alias("pos"), F.concat(F.lit("Ward "), F.col("n_name")).alias("ward_name"),
        x0.alias("x0"), (x0 + 0.05).alias("x1"), (x0 + 0.025).alias("xm"),
        y0.alias("y0"), (y0 + 0.045).alias("y1"), (y0 + 0.0225).alias("ym"),
    )

    def ring(*names: str) -> Column:
        return F.array(*[F.array(*n.split()) for n in names])

    square = ring("x0 y0", "x1 y0", "x1 y1", "x0 y1")
    shape_l = ring("x0 y0", "x1 y0", "x1 ym", "xm ym", "xm y1", "x0 y1")
    corner = {"xa": F.col("x0") + 0.015, "xb": F.col("x0") + 0.035, "ya": F.col("y0") + 0.015, "yb": F.col("y0") + 0.03}
    hole = ring("xa ya", "xa yb", "xb yb", "xb ya")
    rings = (
        F.when(F.col("pos") % 5 == 0, F.array(shape_l))
        .when(F.col("pos") % 7 == 3, F.array(square, hole))
        .otherwise(F.array(square))
    )
    return base.withColumns(corner).select("pos", "ward_name", rings.alias("rings"))


def wards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, ward_name, edges, bounds)."""
    out = ward_rings(spark, sf_dir).select("pos", "ward_name", F.flatten(F.transform("rings", ring_edges)).alias("edges"))
    return with_bounds(out)


def image_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 pixel tables, one image per part."""
    p = F.col("p_partkey")
    grid = table(spark, sf_dir, "part").select(
        p.alias("image_id"), "p_size", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")
    )
    x, y = F.col("i") % 8, F.floor(F.col("i") / 8).cast("int")
    kind = F.col("image_id") % 4
    tint = (F.col("image_id") * 7 + x * 5 + y * 3) % 40
    return grid.select(
        "image_id", x.alias("x"), y.alias("y"),
        *[
            F.when(kind == 0, F.lit(a) + tint).when(kind == 1, F.lit(b) + tint).when(kind == 2, F.lit(c) + tint)
            .otherwise((F.col("image_id") * m + x * 31 + y * 17 * m) % 256).cast("double").alias(n)
            for n, a, b, c, m in (("r", 60, 20, 150, 3), ("g", 90, 22, 120, 5), ("b", 180, 24, 80, 7))
        ],
    )


# --- the same roles as SQL ------------------------------------------------------------------------------------------


def rnd(x: str, places: int) -> str:
    """SQL twin of ``round_stable``."""
    return f"round(CAST({x} AS DECIMAL(28, 9)), {places})::DOUBLE"


def _case(column: str, mapping: dict[str, str]) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


def _sql_station(k: str) -> str:
    return f"(CASE WHEN ({k}) % 2 = 0 THEN 'site_' ELSE 'st_' END || CAST({k} AS VARCHAR))"


def _sql_lat(k: str) -> str:
    return f"(12.85::DOUBLE + ((({k})*37) % 100)::DOUBLE * 0.0027::DOUBLE)"


def _sql_lon(k: str) -> str:
    return f"(77.45::DOUBLE + ((({k})*61) % 100)::DOUBLE * 0.003::DOUBLE)"


_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
_SHIFT = "(((o_orderkey % 21) - 10)::DOUBLE * 0.001::DOUBLE)"
_EDGE = "(x0 + 0.015::DOUBLE) AS xa, (x0 + 0.035::DOUBLE) AS xb, (y0 + 0.015::DOUBLE) AS ya, (y0 + 0.03::DOUBLE) AS yb"


def _sql_ring(*names: str) -> str:
    return "[" + ", ".join("{'x': %s, 'y': %s}" % tuple(n.split()) for n in names) + "]"


CTES = {
    "stations": f"""SELECT s_suppkey AS pos, {_sql_station('s_suppkey')} AS station, {_sql_lat('s_suppkey')} AS latitude,
        {_sql_lon('s_suppkey')} AS longitude, s_nationkey FROM supplier""",
    "readings": f"""SELECT {_sql_station('l_suppkey')} AS station, l_shipdate AS timestamp,
        CASE WHEN l_tax < 0.07::DOUBLE THEN l_quantity * 2.4::DOUBLE END AS pm25,
        CASE WHEN year(l_shipdate) > 1997 OR l_orderkey % 10 = 0 THEN l_quantity * 4.0::DOUBLE END AS pm10,
        {_sql_lat('l_suppkey')} AS latitude, {_sql_lon('l_suppkey')} AS longitude,
        l_orderkey AS order_no, l_linenumber::BIGINT AS line_no, l_partkey AS part_no FROM lineitem""",
    "daily": """SELECT station, CAST(timestamp AS DATE) AS date, avg(pm25) AS pm25 FROM readings
        GROUP BY 1, 2 HAVING avg(pm25) IS NOT NULL""",
    "feed": f"""SELECT event_id, 'user_' || user_id AS station, n_name AS city, r_name AS state,
        {_sql_lat('user_id')} AS latitude, {_sql_lon('user_id')} AS longitude,
        CASE WHEN {_K} % 17 <> 3 THEN date_trunc('hour', ts) END AS last_update,
        {_case('event_type', POLLUTANT_OF)} AS pollutant_id,
        CASE WHEN {_K} % 10 <> 0 THEN value END AS pollutant_avg
        FROM events JOIN nation ON user_id % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "reports": f"""SELECT o_orderkey AS report_no, 'ARG-' || o_orderkey AS reference_id,
        o_orderdate + to_seconds((o_orderkey * 7919) % 86400) AS reported_at,
        {_sql_station('k')} AS station, {_case('o_orderpriority', INCIDENT_OF)} AS incident_type,
        round(50.0::DOUBLE + (o_orderkey % 500)::DOUBLE / 10.0::DOUBLE, 1) AS confidence,
        CAST(floor(o_totalprice / 5000.0::DOUBLE) AS INT) AS severity,
        round({_sql_lat('k')} + {_SHIFT}, 4) AS lat, round({_sql_lon('k')} - {_SHIFT}, 4) AS lon,
        {_case('o_orderstatus', STATUS_OF)} AS status
        FROM (SELECT *, o_custkey % (SELECT count(*) FROM supplier) AS k FROM orders)""",
    "pixels": """SELECT vec_id AS pixel_no, 'SAT-' || vec_id AS pixel_id,
        12.985::DOUBLE + embedding[1]::DOUBLE * 0.35::DOUBLE AS latitude,
        77.6::DOUBLE + embedding[2]::DOUBLE * 0.35::DOUBLE AS longitude,
        110.0::DOUBLE + embedding[3]::DOUBLE * 200.0::DOUBLE AS no2, 0.5::DOUBLE + embedding[4]::DOUBLE AS aod,
        CAST(DATE '2001-07-01' + CAST(vec_id % 31 AS INT) AS DATE) AS date FROM embeddings""",
    "ward_box": """SELECT n_nationkey::BIGINT AS pos, 'Ward ' || n_name AS ward_name, x0, x0 + 0.05::DOUBLE AS x1,
        x0 + 0.025::DOUBLE AS xm, y0, y0 + 0.045::DOUBLE AS y1, y0 + 0.0225::DOUBLE AS ym FROM (
        SELECT *, 77.47::DOUBLE + (n_nationkey % 5)::DOUBLE * 0.05::DOUBLE AS x0,
        12.87::DOUBLE + (n_nationkey // 5)::DOUBLE * 0.045::DOUBLE AS y0 FROM nation)""",
    "ward_rings": f"""
        SELECT pos, ward_name, {_sql_ring('x0 y0', 'x1 y0', 'x1 ym', 'xm ym', 'xm y1', 'x0 y1')} AS ring FROM ward_box
        WHERE pos % 5 = 0
        UNION ALL SELECT pos, ward_name, {_sql_ring('x0 y0', 'x1 y0', 'x1 y1', 'x0 y1')} FROM ward_box WHERE pos % 5 <> 0
        UNION ALL SELECT pos, ward_name, {_sql_ring('xa ya', 'xa yb', 'xb yb', 'xb ya')} FROM
        (SELECT *, {_EDGE} FROM ward_box) WHERE pos % 5 <> 0 AND pos % 7 = 3""",
    "ward_edges": """SELECT pos, ward_name, ring[i].x AS x1, ring[i].y AS y1, ring[i % len(ring) + 1].x AS x2,
        ring[i % len(ring) + 1].y AS y2 FROM (SELECT *, unnest(range(1, len(ring) + 1)) AS i FROM ward_rings)""",
    "image_pixels": """SELECT image_id, x, y,
        (CASE image_id % 4 WHEN 0 THEN 60 + t WHEN 1 THEN 20 + t WHEN 2 THEN 150 + t
         ELSE (image_id * 3 + x * 31 + y * 51) % 256 END)::DOUBLE AS r,
        (CASE image_id % 4 WHEN 0 THEN 90 + t WHEN 1 THEN 22 + t WHEN 2 THEN 120 + t
         ELSE (image_id * 5 + x * 31 + y * 85) % 256 END)::DOUBLE AS g,
        (CASE image_id % 4 WHEN 0 THEN 180 + t WHEN 1 THEN 24 + t WHEN 2 THEN 80 + t
         ELSE (image_id * 7 + x * 31 + y * 119) % 256 END)::DOUBLE AS b
        FROM (SELECT *, (image_id * 7 + x * 5 + y * 3) % 40 AS t FROM
        (SELECT p_partkey AS image_id, i % 8 AS x, i // 8 AS y FROM part, range(0, 64) g(i)))""",
}
_NEEDS = {
    "daily": ["readings"],
    "ward_rings": ["ward_box"],
    "ward_edges": ["ward_rings"],
}


def oracle(body: str, *roles: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """Full SQL: the named roles as CTEs, then ``extra`` CTEs, then ``body``."""
    order: list[str] = []

    def add(role: str) -> None:
        for need in _NEEDS.get(role, []):
            add(need)
        if role not in order:
            order.append(role)

    for r in roles:
        add(r)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ", ".join(parts) + " " + body if parts else body


#: Registered reports of the role ``reports``; {file} is the file name of an event, NULL if it has none.
_REGISTERED = """SELECT 'ARG-2026-' || upper(substr(sha256(concat_ws(chr(31), "Timestamp", "Station", "Incident Type", "File Name", "AI Category",
    "AI Confidence", "Severity Score", "GPS Coords", "Status")), 1, 16)) AS "Reference ID", * FROM (
    SELECT strftime(reported_at, '%Y-%m-%d %H:%M:%S') AS "Timestamp", station AS "Station", incident_type AS "Incident Type",
    coalesce({file}, 'Citizen_Photo.jpg') AS "File Name", incident_type AS "AI Category",
    printf('%.1f%%', confidence) AS "AI Confidence", severity || ' / 100' AS "Severity Score",
    printf('%.4f, %.4f', lat, lon) AS "GPS Coords", CASE WHEN confidence >= 70 THEN 'Verified' ELSE 'Pending' END AS "Status" FROM reports)"""
REGISTERED_SQL = _REGISTERED.format(file="NULL")
REGISTERED_WITH_FILE_SQL = _REGISTERED.format(file="'photo_' || report_no")
