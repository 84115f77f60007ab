"""Queries: percentile cutoffs, clustering, hotspot tables, priority areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from zephra.fixed_values import HIDDEN_LABEL, HOTSPOT_EPS_KM, MONITORED_LABEL, POLICY_FALLBACK, POLICY_INTRO
from zephra.operators import clustering, fusion
from zephra.plans import bindings as b
from zephra.plans.bindings import oracle, rnd
from zephra.plans.catalog import query
from zephra.plans.quality_queries import SEVERITY_CTES, severity
from zephra.plans.scalar_queries import POINTS_SQL, SENSORS_SQL, ZONE_SQL, haversine_sql, points, sensors
from zephra.scale import cut_lineage

_POS = {
    "sev": """SELECT s.*, st.pos, 'Ward_' || st.s_nationkey AS ward_name FROM severity_by_station s
        JOIN stations st ON st.station = s.station""",
    "cuts": "SELECT quantile_cont(severity, 0.6) AS p60, quantile_cont(severity, 0.4) AS p40 FROM sev",
}
_SWEEP = {
    **SEVERITY_CTES,
    **_POS,
    "configs": """SELECT 'A' AS run, 60 AS sev_pct, 0.02::DOUBLE AS eps, p60 AS cutoff FROM cuts UNION ALL
        SELECT 'B', 60, 0.05::DOUBLE, p60 FROM cuts UNION ALL SELECT 'C', 40, 0.02::DOUBLE, p40 FROM cuts
        UNION ALL SELECT 'D', 40, 0.05::DOUBLE, p40 FROM cuts""",
    "cand": "SELECT * FROM sev, configs WHERE severity >= cutoff",
    "nb": """SELECT a.run, a.pos AS a, b.pos AS b FROM cand a JOIN cand b ON a.run = b.run AND sqrt((a.latitude - b.latitude)
        * (a.latitude - b.latitude) + (a.longitude - b.longitude) * (a.longitude - b.longitude)) <= a.eps""",
    "core": "SELECT run, a AS pos FROM nb GROUP BY 1, 2 HAVING count(*) >= 3",
    "link": "SELECT nb.* FROM nb JOIN core c ON c.run = nb.run AND c.pos = a JOIN core d ON d.run = nb.run AND d.pos = b",
    "reach": "SELECT run, pos AS a, pos AS b FROM core UNION SELECT r.run, r.a, l.b FROM reach r JOIN link l ON l.run = r.run AND l.a = r.b",
    "core_label": "SELECT run, b AS pos, min(a) AS label FROM reach GROUP BY 1, 2",
    "label": """SELECT c.run, c.pos, min(l.label) AS label FROM cand c JOIN nb ON nb.run = c.run AND nb.a = c.pos
        JOIN core_label l ON l.run = nb.run AND l.pos = nb.b GROUP BY 1, 2""",
    "numbered": "SELECT *, dense_rank() OVER (PARTITION BY run ORDER BY label) - 1 AS no FROM label",
    "swept": """SELECT c.*, coalesce(n.no, -1)::INT AS cluster FROM cand c LEFT JOIN numbered n ON n.run = c.run AND n.pos = c.pos""",
    "results": """SELECT run, sev_pct, cutoff, eps, count(*) AS candidates, max(cluster) + 1 AS clusters,
        count(*) FILTER (cluster = -1) AS noise FROM swept GROUP BY ALL""",
    "best": "SELECT * FROM results ORDER BY clusters DESC, eps, run LIMIT 1",
    "chosen": "SELECT * FROM swept WHERE run = (SELECT run FROM best)",
    "clusters": f"""SELECT cluster AS cluster_id, {rnd('sum(latitude * severity) / sum(severity)', 6)} AS center_latitude,
        {rnd('sum(longitude * severity) / sum(severity)', 6)} AS center_longitude, {rnd('avg(severity)', 4)} AS avg_severity,
        {rnd('avg(pm25)', 4)} AS avg_pm25, {rnd('avg(pm10)', 4)} AS avg_pm10, count(*) AS station_count,
        string_agg(station, '; ' ORDER BY pos) AS stations FROM chosen WHERE cluster >= 0 GROUP BY 1""",
    "ward_lists": """SELECT cluster AS cluster_id, string_agg(ward_name, ', ' ORDER BY first_pos) AS wards, count(*) AS ward_count FROM (SELECT cluster, ward_name,
        min(pos) AS first_pos FROM chosen WHERE cluster >= 0 GROUP BY 1, 2) GROUP BY 1""",
    "areas": """SELECT 'Cluster ' || c.cluster_id AS area, wards, avg_severity, avg_pm25, avg_pm10, stations FROM clusters c
        JOIN ward_lists USING (cluster_id) UNION ALL SELECT 'Standalone - ' || station, ward_name, round(severity, 1), NULL, NULL,
        station FROM chosen WHERE cluster = -1""",
}


def _sweep_sql(body: str, *roles: str) -> str:
    return oracle(body, "readings", "stations", *roles, extra=_SWEEP, recursive=True)


def _stations(spark, d):
    """Severity per station with position and ward."""
    where = b.stations(spark, d).select(
        "pos", "station", F.concat(F.lit("Ward_"), F.col("s_nationkey").cast("string")).alias("ward_name")
    )
    return severity(spark, d).join(where, "station")


def _swept(spark, d):
    return clustering.sweep(_stations(spark, d))


def _chosen(spark, d):
    swept = _swept(spark, d)
    best = clustering.choose_sweep(clustering.sweep_results(swept)).select("run").scalar()
    return swept.filter(F.col("run") == best)


@query("A10_severity_cutoffs", oracle("SELECT round(p60, 6) AS p60, round(p40, 6) AS p40 FROM cuts", "readings", "stations", extra={**SEVERITY_CTES, **_POS}))
def severity_cutoffs(spark, d):
    return clustering.severity_cutoffs(severity(spark, d)).select(*[F.round(c, 6).alias(c) for c in ("p60", "p40")])


@query(
    "J11_core_points",
    _sweep_sql("SELECT c.run, c.pos, k.pos IS NOT NULL AS core FROM cand c LEFT JOIN core k ON k.run = c.run AND k.pos = c.pos"),
)
def core_points(spark, d):
    """Epsilon-neighbour test of every candidate in every sweep."""
    rows = _swept(spark, d).select(
        "run", "eps", "pos", F.col("pos").alias("pid"), F.col("latitude").alias("x"), F.col("longitude").alias("y")
    )
    flags = clustering.core_flags(clustering.collapse(rows)).select("run", "x", "y", "core")
    return rows.join(flags, ["run", "x", "y"]).select("run", "pos", "core")


@query("M1_M2_sweep_labels", _sweep_sql("SELECT run, pos, station, cluster FROM swept"))
def sweep_labels(spark, d):
    return _swept(spark, d).select("run", "pos", "station", "cluster")


@query("M2_sweep_results", _sweep_sql("SELECT run, sev_pct, round(cutoff, 6) AS cutoff, eps, candidates, clusters::BIGINT AS clusters, noise FROM results"))
def sweep_results(spark, d):
    return clustering.sweep_results(_swept(spark, d)).withColumn("cutoff", F.round("cutoff", 6))


@query("O5_choose_sweep", _sweep_sql("SELECT run, sev_pct, round(cutoff, 6) AS cutoff, eps, candidates, clusters::BIGINT AS clusters, noise FROM best"))
def choose_sweep(spark, d):
    return clustering.choose_sweep(clustering.sweep_results(_swept(spark, d))).withColumn("cutoff", F.round("cutoff", 6))


@query("J3_label_candidates", _sweep_sql("SELECT s.station, s.severity, coalesce(c.cluster, -2)::INT AS cluster FROM sev s LEFT JOIN chosen c ON c.station = s.station"))
def label_candidates(spark, d):
    return clustering.label_candidates(severity(spark, d).select("station", "severity"), _chosen(spark, d))


_CLUSTER_OUT = "cluster_id, center_latitude, center_longitude, avg_severity, avg_pm25, avg_pm10, station_count"


@query("A11_cluster_summary", _sweep_sql(f"SELECT {_CLUSTER_OUT}, ward_count, wards, stations FROM clusters JOIN ward_lists USING (cluster_id)"))
def cluster_summary(spark, d):
    """Every name of a cluster, as in the SQL."""
    return clustering.hotspot_clusters(_chosen(spark, d), shown=None)


@query(
    "A11_cluster_members",
    _sweep_sql(
        """SELECT cluster AS cluster_id, number, station, ward_name, number || '. ' || station || ' (' || ward_name || ')' AS line FROM (
        SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY pos) AS number FROM chosen WHERE cluster >= 0)"""
    ),
)
def cluster_members(spark, d):
    """Every station of every cluster, as rows and as numbered lines."""
    members = cut_lineage(clustering.cluster_members(_chosen(spark, d)))
    return members.join(clustering.member_lines(members), ["cluster_id", "number"])


@query("O4_ranked_clusters", _sweep_sql(f"SELECT {_CLUSTER_OUT} FROM clusters ORDER BY avg_severity DESC, cluster_id"))
def ranked_clusters(spark, d):
    return clustering.ranked_clusters(clustering.cluster_summary(_chosen(spark, d)))


def _areas(spark, d):
    chosen = _chosen(spark, d)
    return fusion.priority_areas(clustering.hotspot_clusters(chosen, shown=None), chosen)


@query("U4_priority_areas", _sweep_sql("SELECT * FROM areas"))
def priority_areas(spark, d):
    return _areas(spark, d)


@query("C23_policy_brief", _sweep_sql(
    f"""SELECT area, '{POLICY_INTRO.replace("'", "''")}' || chr(10) || 'Hotspot Details:' || chr(10) || '- Cluster/Station: ' || area ||
    chr(10) || '- Wards involved: ' || wards || chr(10) || '- Included Stations: ' || stations || chr(10) || '- Average Severity Score: '
    || avg_severity || chr(10) || '- Average PM2.5: ' || coalesce(avg_pm25::VARCHAR, 'N/A') || chr(10) || '- Average PM10: ' ||
    coalesce(avg_pm10::VARCHAR, 'N/A') || chr(10) AS prompt, '{POLICY_FALLBACK}' AS recommendation_text FROM areas"""))
def policy_brief(spark, d):
    return fusion.policy_brief(_areas(spark, d)).select("area", "prompt", "recommendation_text")


# --- multimodal -----------------------------------------------------------------------------------------------------

_EPS = f"({HOTSPOT_EPS_KM}::DOUBLE / 111.0::DOUBLE)"
_MULTI = {
    "sensors": SENSORS_SQL,
    "points": POINTS_SQL,
    "spots": "SELECT lat, lon, count(*) AS w, min(kind * 1000000000000 + no) AS id FROM points GROUP BY 1, 2",
    "near": f"""SELECT a.id AS a, b.id AS b, b.w FROM spots a JOIN spots b ON abs(a.lat - b.lat) <= 0.03 AND sqrt((a.lat - b.lat) * (a.lat - b.lat)
        + (a.lon - b.lon) * (a.lon - b.lon)) <= {_EPS}""",
    "core": "SELECT a AS id FROM near GROUP BY 1 HAVING sum(w) >= 3",
    "link": "SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)",
    "cc(id, label) USING KEY (id)": """SELECT id, id AS label FROM core UNION (SELECT l.b AS id, min(c.label) AS label FROM cc c
        JOIN link l ON l.a = c.id JOIN recurring.cc r ON r.id = l.b WHERE c.label < r.label GROUP BY l.b)""",
    "lab": "SELECT n.a AS id, min(c.label) AS label FROM near n JOIN cc c ON c.id = n.b GROUP BY 1",
    "multi": """SELECT p.*, coalesce(no_, -1)::INT AS cluster FROM points p JOIN spots s ON s.lat = p.lat AND s.lon = p.lon
        LEFT JOIN (SELECT id, dense_rank() OVER (ORDER BY label) - 1 AS no_ FROM lab) n ON n.id = s.id""",
    "per": """SELECT cluster, count(*) AS n, avg(lat) AS lat, avg(lon) AS lon, avg(weight) AS weight FROM multi WHERE cluster >= 0 GROUP BY 1""",
    "srcs": """SELECT cluster, string_agg(source, ', ' ORDER BY seen) AS sources FROM (SELECT cluster, source,
        min(kind * 1000000000000 + no) AS seen FROM multi GROUP BY 1, 2) GROUP BY 1""",
    "dist": f"""SELECT cluster, min({haversine_sql('p.lat', 'p.lon', 's.latitude', 's.longitude')}) AS km FROM per p, stations s GROUP BY 1""",
    "spots_summary": f"""SELECT cluster + 1 AS cluster_id, {rnd('lat', 5)} AS center_lat, {rnd('lon', 5)} AS center_lon, n AS point_count,
        {rnd('weight * 100', 1)} AS avg_severity, {ZONE_SQL.format(lat='lat', lon='lon')} AS ward_name,
        (NOT contains(sources, 'Ground Sensor') AND km > 2.0) AS is_hidden_hotspot, CASE WHEN NOT contains(sources, 'Ground Sensor') AND km > 2.0
        THEN '{HIDDEN_LABEL}' ELSE '{MONITORED_LABEL}' END AS status_label, {rnd('km', 2)} AS min_sensor_dist_km, sources
        FROM per JOIN srcs USING (cluster) JOIN dist USING (cluster)""",
}


def _multi_sql(body: str) -> str:
    return oracle(body, "stations", "daily", "reports", "pixels", extra=_MULTI, recursive=True)


@query("M1_multimodal_clusters", _multi_sql("SELECT kind, no, cluster FROM multi"))
def multimodal_clusters(spark, d):
    return clustering.cluster_points(points(spark, d), HOTSPOT_EPS_KM).select("point_id.kind", "point_id.no", "cluster")


@query("A12_hotspot_summary", _multi_sql("SELECT * FROM spots_summary"))
def hotspot_summary(spark, d):
    labelled = clustering.cluster_points(points(spark, d), HOTSPOT_EPS_KM)
    return clustering.hotspot_summary(labelled, sensors(spark, d))
