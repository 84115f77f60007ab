"""Queries: parsing, cleaning, pivoting, profiling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from zephra.fixed_values import EMPTY_STATIONS, NULL_TOKENS, POLLUTANTS, SERIES_COLUMNS, SITE_NAMES, STATIONS
from zephra.functions.text import hour_of, month_no, norm_key, quoted, split_list, to_number, to_time, to_utc_naive
from zephra.operators import cleaning
from zephra.plans import bindings as b
from zephra.plans.bindings import READING_KEY, oracle
from zephra.plans.catalog import query
from zephra.sources import registry
from zephra.sources.schemas import SERIES

_TOKENS = ", ".join(f"'{t}'" for t in NULL_TOKENS)


@query(
    "F1_nullify_tokens",
    oracle(
        f"""SELECT p_partkey, CASE WHEN v IN ({_TOKENS}) THEN NULL ELSE v END AS value,
        CASE WHEN w IN ({_TOKENS}) THEN NULL ELSE w END AS unit FROM raw""",
        extra={
            "raw": """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'NA' WHEN 1 THEN '' WHEN 2 THEN 'nan'
            ELSE p_name END AS v, CASE p_size % 5 WHEN 0 THEN 'None' WHEN 1 THEN 'N/A' ELSE p_type END AS w FROM part"""
        },
    ),
)
def nullify_tokens(spark, d):
    k, s = F.col("p_partkey") % 7, F.col("p_size") % 5
    raw = b.table(spark, d, "part").select(
        "p_partkey",
        F.when(k == 0, "NA").when(k == 1, "").when(k == 2, "nan").otherwise(F.col("p_name")).alias("value"),
        F.when(s == 0, "None").when(s == 1, "N/A").otherwise(F.col("p_type")).alias("unit"),
    )
    return cleaning.nullify(raw)


@query(
    "F2_to_number",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE l_linenumber % 4 WHEN 0 THEN NULL ELSE round(l_extendedprice, 2) END AS value FROM lineitem""",
)
def to_number_texts(spark, d):
    price = F.format_string("%.2f", F.col("l_extendedprice"))
    grouped = F.regexp_replace(price, r"^([0-9]+)([0-9]{3}\.)", "$1,$2")
    n = F.col("l_linenumber") % 4
    text = (
        F.when(n == 0, "n.v.").when(n == 1, F.concat(F.lit(' "'), grouped, F.lit('" '))).when(n == 2, grouped)
        .otherwise(F.concat(F.lit("'"), price, F.lit("'")))
    )
    return b.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", to_number(text).alias("value")
    )


@query(
    "F3_fixed_format_time",
    "SELECT event_id, CASE WHEN event_id % 9 = 4 THEN NULL ELSE date_trunc('second', ts) END AS last_update FROM events",
)
def fixed_format_time(spark, d):
    text = F.when(F.col("event_id") % 9 == 4, "2024-13-45").otherwise(F.date_format("ts", "dd-MM-yyyy HH:mm:ss"))
    return b.table(spark, d, "events").select("event_id", to_time(text).alias("last_update"))


@query(
    "F4_utc_naive_time",
    """SELECT event_id, CASE event_id % 4 WHEN 1 THEN date_trunc('second', ts) - INTERVAL 330 MINUTE
    WHEN 3 THEN NULL ELSE date_trunc('second', ts) END AS timestamp FROM events""",
)
def utc_naive_time(spark, d):
    k = F.col("event_id") % 4
    iso = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    text = (
        F.when(k == 0, iso).when(k == 1, F.concat(iso, F.lit("+05:30")))
        .when(k == 2, F.concat(F.regexp_replace(iso, " ", "T"), F.lit("Z"))).otherwise("yesterday")
    )
    return b.table(spark, d, "events").select("event_id", to_utc_naive(text).alias("timestamp"))


@query(
    "F5_require_keys",
    oracle("SELECT * FROM readings WHERE pm25 IS NOT NULL AND pm10 IS NOT NULL", "readings"),
)
def require_keys(spark, d):
    return b.readings(spark, d).dropna(subset=["pm25", "pm10"])


def _typed_feed(spark, d):
    return b.feed(spark, d).withColumns(
        {
            "latitude": to_number(F.col("latitude")),
            "longitude": to_number(F.col("longitude")),
            "last_update": to_time(F.col("last_update")),
            "pollutant_avg": to_number(F.col("pollutant_avg")),
        }
    )


@query(
    "F1_F3_clean_feed",
    oracle(
        """SELECT event_id, station, city, state, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
        last_update, pollutant_id, pollutant_avg FROM feed""",
        "feed",
    ),
)
def clean_feed(spark, d):
    return _typed_feed(spark, d).withColumns(
        {"latitude": F.round("latitude", 6), "longitude": F.round("longitude", 6)}
    )


@query("F6_city_filter_hit", oracle("SELECT event_id, city FROM feed WHERE lower(trim(city)) IN ('nation_3', 'nation_7')", "feed"))
def city_filter_hit(spark, d):
    return cleaning.filter_or_all(b.feed(spark, d).select("event_id", "city"), "city", ["nation_3", "nation_7"])


@query("F6_city_filter_fallback", oracle("SELECT event_id, city FROM feed", "feed"))
def city_filter_fallback(spark, d):
    return cleaning.filter_or_all(b.feed(spark, d).select("event_id", "city"), "city")


@query(
    "F7_exclude",
    oracle(
        """SELECT pos, station FROM stations WHERE station NOT IN ('site_2', 'st_5') AND NOT starts_with(station, 'site_1')""",
        "stations",
    ),
)
def exclude(spark, d):
    return cleaning.exclude(b.stations(spark, d), "station", ["site_2", "st_5"], "site_1").select("pos", "station")


_SITE_SQL = "CASE site " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SITE_NAMES.items()) + " ELSE site END"


@query(
    "F8_canonical_station",
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_SITE_SQL} AS station FROM "
    "(SELECT *, 'site_' || (l_partkey + 150) AS site FROM lineitem)",
)
def canonical_station(spark, d):
    rows = b.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.concat(F.lit("site_"), (F.col("l_partkey") + 150).cast("string")).alias("station"),
    )
    return cleaning.canonical_station(rows, registry.site_names(spark))


_ALIASES = [(a, i, n, la, lo) for i, (n, la, lo, names) in enumerate(STATIONS) for a in names]


def _file_stems(spark, d):
    """One file name per part: aliases of the registry and texts of the table, glued together."""
    alias = F.element_at(
        F.array(*[F.lit(a[0]) for a in _ALIASES]), (F.col("p_partkey") % len(_ALIASES) + 1).cast("int")
    )
    name = F.regexp_replace("p_name", " ", "_")
    stem = (
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.upper(alias), F.lit("_2021_hourly AQI data_"), name))
        .when(F.col("p_partkey") % 3 == 1, F.concat(name, F.lit("-2019-CPCB-Bengaluru")))
        .otherwise(F.concat(F.lit("peenya-"), alias, F.lit("-"), name))
    )
    return b.table(spark, d, "part").select("p_partkey", stem.alias("stem"))


_ALIAS_ROWS = ", ".join(
    f"({j}, '{a}', regexp_replace(lower('{a}'), '[^a-z0-9]+', '', 'g'), '{n}', {la}::DOUBLE, {lo}::DOUBLE)"
    for j, (a, i, n, la, lo) in enumerate(_ALIASES)
)


@query(
    "F9_infer_station",
    oracle(
        r"""SELECT s.p_partkey, s.stem, coalesce(m.station, trim(regexp_replace(regexp_replace(regexp_replace(
        regexp_replace(regexp_replace(s.stem, '\b20(1[7-9]|2[0-6])\b', '', 'g'), 'hourly aqi data', '', 'gi'),
        'cpcb|kspcb|bengaluru|bangalore|blr', '', 'gi'), '[-_]+', ' ', 'g'), '\s+', ' ', 'g'))) AS station,
        m.latitude, m.longitude FROM stems s LEFT JOIN matched m USING (p_partkey)""",
        extra={
            "aliases": f"SELECT * FROM (VALUES {_ALIAS_ROWS}) t(j, alias, norm, station, latitude, longitude)",
            "stems": f"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(alias) || '_2021_hourly AQI data_' || nm
            WHEN 1 THEN nm || '-2019-CPCB-Bengaluru' ELSE 'peenya-' || alias || '-' || nm END AS stem
            FROM (SELECT p_partkey, replace(p_name, ' ', '_') AS nm, alias FROM part
            JOIN aliases ON j = p_partkey % {len(_ALIASES)})""",
            "matched": """SELECT p_partkey, station, latitude, longitude FROM (SELECT p_partkey, a.*, row_number() OVER (
            PARTITION BY p_partkey ORDER BY length(a.norm) DESC, j) AS rn FROM stems s JOIN aliases a
            ON contains(regexp_replace(lower(s.stem), '[^a-z0-9]+', '', 'g'), a.norm)) WHERE rn = 1""",
        },
    ),
)
def infer_station(spark, d):
    return cleaning.infer_station(_file_stems(spark, d))


@query(
    "F10_norm_key",
    "SELECT p_partkey, regexp_replace(lower(p_brand || ' / ' || p_name), '[^a-z0-9]+', '', 'g') AS key FROM part",
)
def key_norm(spark, d):
    text = F.concat("p_brand", F.lit(" / "), "p_name")
    return b.table(spark, d, "part").select("p_partkey", norm_key(text).alias("key"))


@query(
    "F12_with_defaults",
    oracle("SELECT report_no, coalesce(CASE WHEN report_no % 3 > 0 THEN severity END, 70) AS severity, 12.97::DOUBLE AS lat0 FROM reports", "reports"),
)
def with_defaults(spark, d):
    rows = b.parse_reports(b.reports(spark, d)).select(
        "report_no", F.when(F.col("report_no") % 3 > 0, F.col("severity")).alias("severity")
    )
    return cleaning.with_defaults(rows, {"severity": 70, "lat0": 12.97})


@query(
    "F15_conform",
    oracle(
        "SELECT station, timestamp, pm25 AS \"PM2.5\", pm10 AS \"PM10\", "
        + ", ".join(f'NULL::DOUBLE AS "{p}"' for p in POLLUTANTS[2:])
        + ", latitude, longitude FROM readings",
        "readings",
    ),
)
def conform(spark, d):
    return cleaning.conform(
        b.readings(spark, d).withColumnsRenamed({"pm25": "PM2.5", "pm10": "PM10"}), SERIES
    )


_PIVOT_SQL = ", ".join(
    f"avg(CASE WHEN pollutant_id = '{p}' THEN pollutant_avg END) AS \"{p}\"" for p in POLLUTANTS
)


@query(
    "A1_pivot_wide",
    oracle(
        f"""SELECT station, city, state, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, last_update,
        {", ".join(f'round("{p}", 6) AS "{p}"' for p in POLLUTANTS)} FROM (
        SELECT station, city, state, latitude, longitude, last_update, {_PIVOT_SQL} FROM feed
        WHERE last_update IS NOT NULL AND pollutant_avg IS NOT NULL GROUP BY ALL)""",
        "feed",
    ),
)
def pivot_wide(spark, d):
    wide = cleaning.pivot_wide(_typed_feed(spark, d))
    return wide.select(
        "station", "city", "state", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"),
        "last_update", *[F.round(quoted(p), 6).alias(p) for p in POLLUTANTS],
    )


@query("A2_distinct_rows", oracle("SELECT DISTINCT station, timestamp, pm25, pm10 FROM readings", "readings"))
def distinct_rows(spark, d):
    return b.readings(spark, d).select("station", "timestamp", "pm25", "pm10").dropDuplicates()


@query(
    "A3_distinct_by_key",
    oracle(
        """SELECT station, timestamp, pm25, pm10, order_no FROM (SELECT *, row_number() OVER (PARTITION BY station, timestamp
        ORDER BY order_no, line_no, part_no) AS rn FROM readings) WHERE rn = 1""",
        "readings",
    ),
)
def distinct_by_key(spark, d):
    return cleaning.first_per_key(b.readings(spark, d), ["station", "timestamp"], READING_KEY).select(
        "station", "timestamp", "pm25", "pm10", "order_no"
    )


@query(
    "A5_profile",
    oracle(
        """SELECT 6::BIGINT AS column_count, sum(n)::BIGINT AS row_count, sum(n - 1)::BIGINT AS duplicate_rows,
        sum(CASE WHEN station IS NULL THEN n ELSE 0 END)::BIGINT AS null_station,
        sum(CASE WHEN city IS NULL THEN n ELSE 0 END)::BIGINT AS null_city,
        sum(CASE WHEN state IS NULL THEN n ELSE 0 END)::BIGINT AS null_state,
        sum(CASE WHEN last_update IS NULL THEN n ELSE 0 END)::BIGINT AS null_last_update,
        sum(CASE WHEN pollutant_id IS NULL THEN n ELSE 0 END)::BIGINT AS null_pollutant_id,
        sum(CASE WHEN pollutant_avg IS NULL THEN n ELSE 0 END)::BIGINT AS null_pollutant_avg,
        (SELECT count(DISTINCT pollutant_id) FROM feed) AS distinct_pollutant_id,
        (SELECT count(DISTINCT station) FROM feed) AS distinct_station FROM
        (SELECT station, city, state, last_update, pollutant_id, pollutant_avg, count(*) AS n FROM feed GROUP BY ALL)""",
        "feed",
    ),
)
def profile(spark, d):
    rows = _typed_feed(spark, d).select("station", "city", "state", "last_update", "pollutant_id", "pollutant_avg")
    return cleaning.profile(rows, ["pollutant_id", "station"])


@query(
    "A13_station_counts",
    oracle(
        "SELECT station AS label, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM readings), 6) AS share FROM readings GROUP BY 1",
        "readings",
    ),
)
def station_counts(spark, d):
    return cleaning.value_counts(b.readings(spark, d), "station").withColumn("share", F.round("share", 6))


@query(
    "A14_describe",
    oracle(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS name, count({c}) AS n, round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS std,
            min({c}) AS min, round(quantile_cont({c}, 0.25), 2) AS p25, round(quantile_cont({c}, 0.5), 2) AS p50,
            round(quantile_cont({c}, 0.75), 2) AS p75, max({c}) AS max FROM readings"""
            for c in ("pm25", "pm10")
        ),
        "readings",
    ),
)
def describe(spark, d):
    return cleaning.describe(b.readings(spark, d), ["pm25", "pm10"])


@query(
    "A21_coalesce_rows",
    oracle(
        """SELECT station, timestamp, first(pm25 ORDER BY order_no, line_no, part_no) FILTER (pm25 IS NOT NULL) AS pm25,
        first(pm10 ORDER BY order_no, line_no, part_no) FILTER (pm10 IS NOT NULL) AS pm10 FROM readings
        GROUP BY station, timestamp""",
        "readings",
    ),
)
def coalesce_rows(spark, d):
    rows = b.readings(spark, d).drop("latitude", "longitude")
    return cleaning.coalesce_rows(rows, ["station", "timestamp"], READING_KEY)


@query(
    "A22_summary",
    oracle(
        """SELECT count(*) AS row_count, count(DISTINCT station) AS stations, min(timestamp) AS first_time,
        max(timestamp) AS last_time, 0::BIGINT AS null_station, 0::BIGINT AS null_timestamp,
        sum((pm25 IS NULL)::BIGINT)::BIGINT AS null_pm25, sum((pm10 IS NULL)::BIGINT)::BIGINT AS null_pm10 FROM readings""",
        "readings",
    ),
)
def summary(spark, d):
    rows = b.readings(spark, d).select("station", "timestamp", "pm25", "pm10")
    return cleaning.summary(rows, "station", "timestamp")


_FILL = """coalesce(last_value({c} IGNORE NULLS) OVER w, first_value({c} IGNORE NULLS) OVER (PARTITION BY station ORDER BY
timestamp, order_no, line_no, part_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"""


@query(
    "W4_fill_gaps",
    oracle(
        f"""SELECT station, timestamp, order_no, line_no, part_no, {_FILL.format(c='pm25')}, {_FILL.format(c='pm10')}
        FROM readings WINDOW w AS (PARTITION BY station ORDER BY timestamp, order_no, line_no, part_no
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        "readings",
    ),
)
def fill_gaps(spark, d):
    rows = b.readings(spark, d).select("station", "timestamp", *READING_KEY, "pm25", "pm10")
    return cleaning.fill_gaps(rows, ["station"], ["timestamp", *READING_KEY], ["pm25", "pm10"])


@query(
    "W5_reading_gaps",
    oracle(
        """SELECT station, timestamp, order_no, line_no, part_no, round(epoch(timestamp - lag(timestamp) OVER (
        PARTITION BY station ORDER BY timestamp, order_no, line_no, part_no)) / 3600.0, 6) AS gap_hours FROM readings""",
        "readings",
    ),
)
def reading_gaps(spark, d):
    rows = b.readings(spark, d).select("station", "timestamp", *READING_KEY)
    return cleaning.reading_gaps(rows, ["station"], "timestamp", READING_KEY).withColumn(
        "gap_hours", F.round("gap_hours", 6)
    )


@query(
    "O1_ordered",
    oracle(
        """SELECT station, timestamp, order_no, line_no, part_no, pm25 FROM readings
        ORDER BY station, timestamp, order_no, line_no, part_no""",
        "readings",
    ),
)
def ordered(spark, d):
    return b.readings(spark, d).select("station", "timestamp", *READING_KEY, "pm25").orderBy(
        "station", "timestamp", *READING_KEY
    )


@query(
    "U1_union_sources",
    oracle(
        """SELECT station, timestamp, pm25 AS "PM2.5", pm10 AS "PM10", NULL::DOUBLE AS "NO2" FROM readings
        UNION ALL SELECT station, last_update, CASE WHEN pollutant_id = 'PM2.5' THEN pollutant_avg END,
        CASE WHEN pollutant_id = 'PM10' THEN pollutant_avg END, CASE WHEN pollutant_id = 'NO2' THEN pollutant_avg END
        FROM feed WHERE last_update IS NOT NULL""",
        "readings", "feed",
    ),
)
def union_sources(spark, d):
    ground = b.readings(spark, d).select("station", "timestamp", F.col("pm25").alias("PM2.5"), F.col("pm10").alias("PM10"))
    live = _typed_feed(spark, d).select(
        "station", F.col("last_update").alias("timestamp"),
        *[F.when(F.col("pollutant_id") == p, F.col("pollutant_avg")).alias(p) for p in ("PM2.5", "PM10", "NO2")],
    )
    return ground.unionByName(live, allowMissingColumns=True).dropna(subset=["station", "timestamp"])


@query(
    "S14_first_per_station",
    oracle(
        """SELECT station, event_id, pollutant_id FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY
        event_id % 100, event_id) AS rn FROM feed) WHERE rn = 1""",
        "feed",
    ),
)
def first_per_station(spark, d):
    paged = b.feed(spark, d).select(
        "station", "event_id", "pollutant_id", (F.col("event_id") % 100).alias("page"), F.col("event_id").alias("pos")
    )
    return cleaning.first_per_key(paged, ["station"], ["page", "pos"]).select("station", "event_id", "pollutant_id")


@query(
    "S13_stations_near_registry",
    oracle(
        f"""SELECT s.station, count(r.station) AS aliases_hit FROM stations s LEFT JOIN
        (SELECT * FROM (VALUES {", ".join(f"('{n}', {la}::DOUBLE, {lo}::DOUBLE, '{a}')" for n, la, lo, names in STATIONS for a in names)})
        t(station, latitude, longitude, alias)) r ON floor(s.latitude * 100) = floor(r.latitude * 100)
        AND floor(s.longitude * 100) = floor(r.longitude * 100) GROUP BY 1""",
        "stations",
    ),
)
def stations_near_registry(spark, d):
    """Registry as dimension table: aliases of registered stations in the same hundredth of a degree."""
    known = registry.stations(spark).select(
        F.floor(F.col("latitude") * 100).alias("y"), F.floor(F.col("longitude") * 100).alias("x"),
        F.explode("aliases").alias("alias"),
    )
    mine = b.stations(spark, d).select(
        "station", F.floor(F.col("latitude") * 100).alias("y"), F.floor(F.col("longitude") * 100).alias("x")
    )
    return mine.join(F.broadcast(known), ["x", "y"], "left").groupBy("station").agg(F.count("alias").alias("aliases_hit"))


@query(
    "C7_parse_reports",
    oracle(
        "SELECT report_no, reference_id, reported_at, station, incident_type, confidence, severity, lat, lon, status FROM reports",
        "reports",
    ),
)
def parse_reports(spark, d):
    return b.parse_reports(b.reports(spark, d))


@query(
    "C9_split_list",
    """SELECT doc_id, trim(part) AS part, count(*) AS n FROM
    (SELECT doc_id, unnest(string_split(text, '.')) AS part FROM documents) GROUP BY ALL""",
)
def split_texts(spark, d):
    parts = b.table(spark, d, "documents").select("doc_id", F.explode(split_list(F.col("text"), r"\.")).alias("part"))
    return parts.groupBy("doc_id", "part").agg(F.count(F.lit(1)).alias("n"))


@query(
    "C10_month_and_hour",
    """SELECT event_id, month(ts) AS month, CASE WHEN event_id % 3 = 2 THEN event_id % 24 ELSE hour(ts) END AS hour
    FROM events""",
)
def month_and_hour(spark, d):
    k = F.col("event_id") % 3
    name = F.when(k == 0, F.date_format("ts", "MMMM")).otherwise(F.upper(F.date_format("ts", "MMM")))
    label = F.when(k == 0, F.date_format("ts", "HH:mm")).when(k == 1, F.date_format("ts", "H 'h'")).otherwise("99:00")
    return b.table(spark, d, "events").select(
        "event_id", month_no(name).alias("month"), hour_of(label, F.col("event_id") % 24).alias("hour")
    )
