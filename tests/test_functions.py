import math

from pyspark.sql import functions as F

from zephra.functions import bands, risk, text
from zephra.operators import cleaning, features, fusion, serving


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_numbers(spark):
    rows = ["1,234.5", "'7'", '"8.25" ', "NaN", "", "1e3", "1d", "Infinity", "-3.", ".5", "N/A", "abc", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    got = [r["n"] for r in df.select("i", text.to_number(F.col("s")).alias("n")).orderBy("i").collect()]
    assert got == [1234.5, 7.0, 8.25, None, None, 1000.0, None, None, -3.0, 0.5, None, None, None]


def test_times(spark):
    rows = ["2023-05-01 10:00:00", "2023-05-01T10:00:00Z", "2023-05-01 10:00:00+05:30", "01-05-2023 10:00", "05/01/2023", "2023-13-01", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    for zone in ("UTC", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = [str(r["t"]) for r in df.select("i", text.to_utc_naive(F.col("s")).alias("t")).orderBy("i").collect()]
        assert got == ["2023-05-01 10:00:00", "2023-05-01 10:00:00", "2023-05-01 04:30:00", "2023-05-01 10:00:00",
                       "2023-05-01 00:00:00", "None", "None"], zone
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_station_names(spark):
    df = spark.createDataFrame([("shivapura-peenya 2021",), ("Foo_Bar-2019 CPCB hourly AQI data",), ("2020",)], "stem string")
    got = [(r["station"], r["latitude"]) for r in cleaning.infer_station(df).collect()]
    assert got == [("Shivapura Peenya, Bengaluru - KSPCB", 13.016048), ("Foo Bar-2019".replace("-2019", ""), None), ("2020", None)]


def test_bands(spark):
    vals = [30.0, 30.1, 60.0, 90.0, 90.1, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double")
    got = [r["b"] for r in df.select("i", bands.pm25_band(F.col("v"), "Unknown").alias("b")).orderBy("i").collect()]
    assert got == ["Good", "Moderate", "Moderate", "Poor", "Severe", "Unknown"]
    r = one(spark, bands.season(F.lit(10)), bands.season(F.lit(11)), bands.aqi_band(F.lit(300.0)), bands.aqi_band(F.lit(301.0)),
            bands.no2_band(F.lit(120.0)), bands.no2_band(F.lit(171.0)), bands.zone_name(F.lit(12.9), F.lit(77.5)))
    assert list(r) == ["summer", "winter", "Severe / Unhealthy", "Hazardous", "moderate", "very high", "Rajajinagar - Nayandahalli Belt"]


def test_risk(spark):
    lit = F.lit
    s = risk.sub_scores(lit(85.0), lit(75.0), lit(140.0), lit(70.0), lit(65.0), lit(8.0))
    r = one(spark, risk.risk_score(s), bands.risk_class(risk.risk_score(s)), risk.contributions(s))
    # 0.3 * 56.67 + 0.25 * 75 + 0.2 * 70 + 0.15 * 70 + 0.1 * 30
    assert r[0] == 63.3 and r[1] == "High"
    assert r[2] == {"Ground AQI Sensors": 17.0, "Citizen Image AI": 18.8, "Satellite NO₂": 14.0, "Traffic Congestion": 10.5,
                    "Weather / Stagnation": 3.0}
    missing = risk.sub_scores(lit(None).cast("double"), lit(75.0), lit(140.0), lit(70.0), lit(65.0), lit(8.0))
    assert one(spark, risk.risk_score(missing))[0] is None
    top = risk.sub_scores(lit(500.0), lit(500.0), lit(500.0), lit(500.0), lit(90.0), lit(1.0))
    assert one(spark, risk.risk_score(top))[0] == 96.5


def test_trajectory(spark):
    rows = one(spark, risk.trajectory(F.lit(75.0), F.lit(90.0), F.lit(10.0)))[0]
    assert len(rows) == 25
    for p in rows:
        f = p["hour"] / 24
        v = (75 * 1.1 * (1 - f) + 90 * f) * (1 + 0.12 * math.sin(2 * math.pi * f - 1.2))
        assert abs(p["value"] - v) <= 0.0501 and abs(p["upper"] - v - 10 * (0.3 + 0.7 * f)) <= 0.0501
    low = one(spark, risk.trajectory(F.lit(1.0), F.lit(1.0), F.lit(10.0)))[0]
    assert {p["lower"] for p in low} == {10.0}


def test_alert_payload(spark):
    df = spark.createDataFrame(
        [("Peenya Industrial Area", 84.5, "Garbage Burning"), ("Peenya", 50.0, "Ambient Dust"), ("X", 70.0, "Road Dust")],
        "ward_name string, risk_score double, incident_type string",
    )
    rows = {r["branch"]: r for r in fusion.with_alert(df).join(fusion.packed_actions(spark), "branch").collect()}
    assert rows["burning"]["priority"] == "CRITICAL" and rows["burning"]["is_triggered"] and rows["burning"]["budget"].startswith("₹2.5")
    assert not rows["industrial"]["is_triggered"] and rows["ambient"]["priority"] == "HIGH"
    assert [len(r["action_items"]) for r in rows.values()] == [3, 3, 3]
    assert rows["burning"]["reason"] == (
        "Unmitigated garbage burning detected in Peenya Industrial Area with rising PM2.5 levels and high satellite NO₂ column "
        "density anomaly (Risk Score: 84.5/100)."
    )
    for r in rows.values():  # the stated totals are the sums of the actions
        cost = sum(float(a["cost"][1:4]) for a in r["action_items"])
        cut = sum(int(a["impact"][1:].split("%")[0]) for a in r["action_items"])
        assert f"₹{cost:.1f}" in r["budget"] and r["reduction"].startswith(f"-{cut}%")


def test_pivot_rules(spark):
    rows = [("a", "c", "s", 1.0, 2.0, "t1", "CO", 1.0), ("a", "c", "s", 1.0, 2.0, "t1", "CO", 3.0), ("a", "c", "s", 1.0, 2.0, "t2", "CO", None),
            (None, "c", "s", 1.0, 2.0, "t1", "CO", 5.0)]
    df = spark.createDataFrame(rows, "station string, city string, state string, latitude double, longitude double, last_update string, "
                               "pollutant_id string, pollutant_avg double")
    out = cleaning.pivot_wide(df).collect()
    assert len(out) == 1 and out[0]["CO"] == 2.0 and out[0]["PM2.5"] is None


def test_features_need_history(spark):
    days = spark.range(20).select(
        F.when(F.col("id") < 3, "short").otherwise("long").alias("station"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.col("id").cast("double").alias("pm25"),
    )
    refs = days.groupBy("station").agg(F.max("date").alias("ref_date"))
    got = {r["station"]: r for r in features.features_at(days, refs).collect()}
    assert got["short"]["roll7"] is None and got["long"]["roll7"] == 15.0 and got["long"]["roll30"] == 10.5


def test_report_registration(spark):
    df = spark.createDataFrame([("s", "w", "Garbage Burning", None, None, 0.942, 82.0, None, None), ("s", "w", "Road Dust", "f.jpg", "Dust", 65.0, None, 12.5, 77.25)],
                               "station string, ward_name string, incident_type string, file_name string, category string, confidence double, "
                               "severity double, lat double, lon double").withColumn("reported_at", F.lit("2026-07-06 10:00:00").cast("timestamp"))
    a, b = fusion.register_reports(df).orderBy("File Name").collect()
    assert (a["AI Confidence"], a["Severity Score"], a["GPS Coords"], a["Status"], a["File Name"]) == ("94.2%", "82 / 100", "12.9716, 77.5946", "Verified", "Citizen_Photo.jpg")
    assert (b["AI Confidence"], b["Severity Score"], b["GPS Coords"], b["Status"], b["AI Category"]) == ("65.0%", "75 / 100", "12.5000, 77.2500", "Pending", "Dust")
    assert a["Reference ID"].startswith("ARG-2026-") and len(a["Reference ID"]) == 9 + fusion.REFERENCE_DIGITS


def test_timeline_has_twelve_points(spark):
    days = spark.createDataFrame([("s", "2024-01-10", 50.0)], "station string, d string, pm25 double").select("station", F.col("d").cast("date").alias("date"), "pm25")
    forecast = serving.forecast_24h(days.withColumns({"mean": F.lit(60.0), "half_width": F.lit(9.0)}))
    reports = spark.createDataFrame([("s", "2024-01-09 10:00:00")], "station string, t string").select("station", F.col("t").cast("timestamp_ntz").alias("reported_at"))
    pixels = spark.createDataFrame([("2024-01-10", 80.0)], "d string, no2 double").select(F.col("d").cast("date").alias("date"), "no2")
    rows = serving.timeline(days, reports, pixels, forecast).orderBy("step").collect()
    assert [r["label"] for r in rows][-5:] == ["today", "T+6h", "T+12h", "T+18h", "T+24h"] and len(rows) == 12
    assert [r["reports"] for r in rows[6:8]] == [1, 0] and rows[7]["no2"] == 80.0
