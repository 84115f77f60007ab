"""Queries: images, timeline, indicators, models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from zephra.fixed_values import HOTSPOT_EPS_KM, SEASONS
from zephra.operators import clustering, features, fusion, imaging, learning, metrics, quality, serving
from zephra.plans import bindings as b
from zephra.plans.bindings import oracle, rnd
from zephra.plans.catalog import query
from zephra.plans.feature_queries import YEARS, daily
from zephra.plans.hotspot_queries import _MULTI
from zephra.plans.quality_queries import WARD_LOOKUP_SQL, ward_lookup
from zephra.plans.scalar_queries import points, sensors
from zephra.scale import checkpoint_root, cut_lineage

_IMAGE_SQL = {
    "px": "SELECT *, (r + g + b) / 3.0::DOUBLE AS m FROM image_pixels",
    "px2": """SELECT *, sqrt((pow(r - m, 2) + pow(g - m, 2) + pow(b - m, 2)) / 3.0::DOUBLE) AS s, abs(m - lag(m) OVER (PARTITION BY image_id, y
        ORDER BY x)) AS dx, abs(m - lag(m) OVER (PARTITION BY image_id, x ORDER BY y)) AS dy FROM px""",
    "feats": """SELECT image_id, avg(m) AS brightness, avg((b > 1.15::DOUBLE * r AND b > 1.05::DOUBLE * g AND b > 80)::INT) AS blue_sky,
        avg((m < 70 AND s < 25)::INT) AS dark_smoke, avg((s < 14 AND m >= 70 AND m <= 225)::INT) AS light_haze,
        avg((r > 1.15::DOUBLE * b AND g > 0.82::DOUBLE * b AND r > 80 AND abs(r - g) < 65)::INT) AS dust, avg(dx) + avg(dy) AS edge_density
        FROM px2 GROUP BY 1""",
    "probs": """SELECT *, greatest(0.02::DOUBLE, least(0.98::DOUBLE, 0.55::DOUBLE * dark_smoke + 0.35::DOUBLE * light_haze + 0.1::DOUBLE *
        (1 - least(edge_density, 30) / 30) - 0.45::DOUBLE * blue_sky)) AS sp, greatest(0.02::DOUBLE, least(0.95::DOUBLE, 0.6::DOUBLE * dust +
        0.3::DOUBLE * light_haze + 0.1::DOUBLE * (brightness / 255) - 0.35::DOUBLE * blue_sky)) AS dp FROM feats""",
    "ruled": """SELECT *, CASE WHEN blue_sky > 0.35::DOUBLE AND dark_smoke < 0.05::DOUBLE AND light_haze < 0.2::DOUBLE THEN 1 WHEN dark_smoke >
        0.08::DOUBLE OR (sp > 0.5::DOUBLE AND dark_smoke > 0.03::DOUBLE) THEN 2 WHEN sp > 0.35::DOUBLE OR light_haze > 0.35::DOUBLE THEN 3
        WHEN dust > 0.15::DOUBLE AND dp > 0.3::DOUBLE THEN 4 WHEN dp > 0.25::DOUBLE THEN 5 ELSE 6 END AS rule FROM probs""",
}


@query(
    "C24_image_features",
    oracle("SELECT image_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in imaging.FEATURES) + " FROM feats", "image_pixels", extra=_IMAGE_SQL),
)
def image_features(spark, d):
    out = imaging.image_features(b.image_pixels(spark, d))
    return out.select("image_id", *[F.round(c, 6).alias(c) for c in imaging.FEATURES])


@query(
    "C25_classify_image",
    oracle(
        """SELECT image_id, CASE rule WHEN 2 THEN 'Garbage Burning' WHEN 3 THEN 'Industrial Smoke' WHEN 4 THEN 'Construction Dust'
        WHEN 5 THEN 'Road Dust' ELSE 'Clean / Normal Air' END AS category, trunc(CASE rule
        WHEN 1 THEN greatest(5, least(25, (1 - blue_sky) * 20)) WHEN 2 THEN greatest(50, least(98, sp * 85 + dark_smoke * 30 + 10))
        WHEN 3 THEN greatest(40, least(92, sp * 80 + light_haze * 15 + 10)) WHEN 4 THEN greatest(35, least(88, dp * 85 + dust * 15))
        WHEN 5 THEN greatest(25, least(75, dp * 75)) ELSE greatest(5, least(25, (sp + dp) * 20)) END)::INT AS severity_score,
        round(sp, 3) AS smoke_probability, round(dp, 3) AS dust_probability, round(CASE rule
        WHEN 1 THEN greatest(0.85::DOUBLE, least(0.98::DOUBLE, 0.85::DOUBLE + 0.12::DOUBLE * blue_sky))
        WHEN 2 THEN greatest(0.80::DOUBLE, least(0.96::DOUBLE, 0.82::DOUBLE + 0.15::DOUBLE * sp))
        WHEN 3 THEN greatest(0.75::DOUBLE, least(0.94::DOUBLE, 0.78::DOUBLE + 0.16::DOUBLE * sp))
        WHEN 4 THEN greatest(0.75::DOUBLE, least(0.93::DOUBLE, 0.76::DOUBLE + 0.18::DOUBLE * dp))
        WHEN 5 THEN greatest(0.70::DOUBLE, least(0.90::DOUBLE, 0.72::DOUBLE + 0.20::DOUBLE * dp))
        ELSE greatest(0.80::DOUBLE, least(0.95::DOUBLE, 0.80::DOUBLE + 0.10::DOUBLE * (1 - greatest(sp, dp)))) END, 3) AS confidence,
        CASE rule WHEN 1 THEN 'Clear sky and high atmospheric visibility detected (Blue Sky Coverage: ' || printf('%.1f%%', blue_sky * 100) || ', Minimal Plumes).'
        WHEN 2 THEN 'Detected dark carbonaceous plume and open waste burning absorption (Smoke Prob: ' || printf('%.1f%%', sp * 100) || ', Dark Plume: ' || printf('%.1f%%', dark_smoke * 100) || ').'
        WHEN 3 THEN 'Detected airborne effluent haze and desaturated stack plume dispersion (Smoke Prob: ' || printf('%.1f%%', sp * 100) || ', Haze: ' || printf('%.1f%%', light_haze * 100) || ').'
        WHEN 4 THEN 'Detected heavy tan/brownish particulate haze from unmitigated site dust (Dust Prob: ' || printf('%.1f%%', dp * 100) || ', Dust Tint: ' || printf('%.1f%%', dust * 100) || ').'
        WHEN 5 THEN 'Detected road dust re-suspension and localized vehicular particulate haze (Dust Prob: ' || printf('%.1f%%', dp * 100) || ').'
        ELSE 'No severe smoke or dust plumes detected across visual spectrum. Normal atmospheric clarity.' END AS explanation
        FROM ruled""",
        "image_pixels", extra=_IMAGE_SQL,
    ),
)
def classify_image(spark, d):
    """All six outputs of the rules."""
    return imaging.classify_image(imaging.image_features(b.image_pixels(spark, d))).select(
        "image_id", "category", "severity_score", "smoke_probability", "dust_probability", "confidence", "explanation"
    )


def _forecast(spark, d):
    """Latest value per station, forecast mean = mean of its days, half-width 12.5."""
    days = daily(spark, d).groupBy("station").agg(
        F.max("date").alias("date"), F.max_by("pm25", "date").alias("pm25"), F.avg("pm25").alias("mean"),
        F.lit(12.5).alias("half_width"),
    )
    return serving.forecast_24h(days)


_CURVE = """SELECT station, date, hour, (pm25 * 1.1::DOUBLE * (1 - hour / 24.0::DOUBLE) + mean * (hour / 24.0::DOUBLE)) * (1 + 0.12::DOUBLE *
    sin(hour / 24.0::DOUBLE * 2 * pi() - 1.2::DOUBLE)) AS v FROM (SELECT station, max(date) AS date, arg_max(pm25, date) AS pm25, avg(pm25) AS mean
    FROM daily GROUP BY 1), range(0, 25) h(hour)"""


@query(
    "D2_timeline",
    oracle(
        f"""SELECT s.station, i::INT AS step, CASE WHEN i = 7 THEN 'today' ELSE strftime(s.date - (7 - i)::INT, '%b %d') END AS label,
        round(d.pm25, 6) AS aqi, coalesce(r.n, 0)::BIGINT AS reports, round(x.no2, 6) AS no2 FROM
        (SELECT station, max(date) AS date FROM daily GROUP BY 1) s CROSS JOIN range(0, 8) g(i)
        LEFT JOIN daily d ON d.station = s.station AND d.date = s.date - (7 - i)::INT
        LEFT JOIN (SELECT station, reported_at::DATE AS date, count(*) AS n FROM reports GROUP BY 1, 2) r ON r.station = s.station AND r.date = s.date - (7 - i)::INT
        LEFT JOIN (SELECT date, avg(no2) AS no2 FROM pixels GROUP BY 1) x ON x.date = s.date - (7 - i)::INT
        UNION ALL SELECT station, (7 + hour / 6)::INT, 'T+' || hour || 'h', {rnd('v', 1)}, NULL, NULL FROM curve WHERE hour IN (6, 12, 18, 24)""",
        "daily", "reports", "pixels", extra={"curve": _CURVE},
    ),
)
def timeline(spark, d):
    out = serving.timeline(daily(spark, d), b.parse_reports(b.reports(spark, d)), b.pixels(spark, d), _forecast(spark, d))
    return out.withColumns({"aqi": F.round("aqi", 6), "no2": F.round("no2", 6)})


@query(
    "A23_executive_kpis",
    oracle(
        f"""SELECT *, CASE WHEN avg_aqi <= 50 THEN 'Good' WHEN avg_aqi <= 100 THEN 'Moderate' ELSE 'Poor' END AS aqi_badge,
        CASE WHEN predicted_aqi > 100 THEN 'Unhealthy Spike' ELSE 'Moderate' END AS predicted_badge FROM (SELECT
        (SELECT count(*) FROM per) AS hotspot_count, (SELECT floor(round(avg(pm25), 6))::INT FROM sensors) AS avg_aqi,
        (SELECT count(*) FROM reports) AS citizen_reports, (SELECT count(*) FROM pixels WHERE no2 > 170) AS satellite_alerts,
        (SELECT count(*) FROM ward_score WHERE score >= 60) AS high_risk_wards,
        (SELECT floor(round(avg({rnd('v', 1)}), 6))::INT FROM curve WHERE hour = 24) AS predicted_aqi)""",
        "stations", "daily", "reports", "pixels", recursive=True,
        extra={
            **_MULTI, "curve": _CURVE, "w": WARD_LOOKUP_SQL,
            "ward_score": f"""SELECT ward_name, {rnd('0.3::DOUBLE * least(100, p / 150 * 100) + 0.25::DOUBLE * 72 + 0.2::DOUBLE * 67.5::DOUBLE + 0.15::DOUBLE * 70 + 0.1::DOUBLE * 30', 1)}
                AS score FROM (SELECT coalesce(ward_name, 'Unknown') AS ward_name, round(avg(pm25), 6) AS p FROM sensors s LEFT JOIN w ON w.station = s.station
                GROUP BY 1)""",
        },
    ),
)
def executive_kpis(spark, d):
    labelled = clustering.cluster_points(points(spark, d), HOTSPOT_EPS_KM)
    hotspots = labelled.filter("cluster >= 0").select("cluster").distinct()
    latest = sensors(spark, d)
    risk = serving.ward_risk(quality.join_ward(latest, ward_lookup(spark, d)))
    return fusion.kpis(hotspots, latest, b.reports(spark, d), b.pixels(spark, d), risk, _forecast(spark, d))


# --- models ---------------------------------------------------------------------------------------------------------

FEATURES = ["roll7", "roll30", "day_of_week", "month", "is_hotspot_zone", *[f"season_{s}" for s in SEASONS]]
# A forest of this size fits in seconds; fit_band_model's own defaults are 200 trees of depth 15.
_TREES, _DEPTH = 20, 8


def _model_rows(days):
    rows = features.one_hot(features.folds(features.training_rows(days), YEARS), "season", SEASONS)
    return rows.withColumn("is_hotspot_zone", (F.crc32("station") % 4 == 0).cast("int"))


def _band_model(days):
    rows = cut_lineage(_model_rows(days))
    return learning.fit_band_model(rows.filter("fold = 'train'"), FEATURES, _TREES, _DEPTH), rows


@query("M3_M4_S11_band_model")
def band_model(spark, d):
    """Fit, save, load, predict the test fold."""
    model, rows = _band_model(daily(spark, d))
    path = f"{checkpoint_root(spark)}/model-{uuid.uuid4().hex}"
    learning.save_model(model, path)
    scored = learning.predict_band(learning.load_model(path), rows.filter("fold = 'test'"))
    return scored.select("station", "date", "target", "pred", "confidence", "p_Good", "p_Moderate", "p_Poor", "p_Severe")


@query("M6_model_importances")
def model_importances(spark, d):
    return metrics.rank_importance(learning.importances(_band_model(daily(spark, d))[0]))


def _forecaster(days):
    rows = cut_lineage(learning.forecast_inputs(features.add_target(days)))
    return learning.fit_forecaster(rows.filter(F.year("date") <= YEARS[0])), rows


@query("M5_forecast_interval")
def forecast_interval(spark, d):
    """Forecast with interval for the latest day of every station."""
    model, rows = _forecaster(daily(spark, d))
    last = learning.forecast_inputs(features.latest(rows.select("station", "date", "pm25")))
    return learning.predict_ci(model, last).select("station", "date", "pm25", "mean", "half_width", "lower", "upper")


@query("D3_station_analysis")
def station_analysis(spark, d):
    days = cut_lineage(daily(spark, d))
    band, _ = _band_model(days)
    refs = days.groupBy("station").agg(F.max("date").alias("ref_date"))
    at = features.one_hot(features.features_at(days, refs), "season", SEASONS)
    at = at.withColumn("is_hotspot_zone", (F.crc32("station") % 4 == 0).cast("int"))
    predicted = learning.predict_band(band, at)
    forecaster, _ = _forecaster(days)
    forecast = learning.predict_ci(forecaster, learning.forecast_inputs(features.latest(days)))
    stations = quality.join_ward(b.stations(spark, d).select("station"), ward_lookup(spark, d))
    return serving.station_analysis(stations, days, predicted, forecast)
