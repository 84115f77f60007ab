"""Keyed merge tables: late rows, repeated batches, unfinished versions; stream intake on top of them."""

import datetime as dt
import json

from pyspark.sql import functions as F

from zephra.operators import fusion
from zephra.streaming import ingest, merge

HEAD = "station,city,state,latitude,longitude,last_update,pollutant_id,pollutant_avg,pollutant_min,pollutant_max\n"


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _feed(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(HEAD + "".join(f"{s},c,s,12.9,77.5,{t},{p},{v},NA,NA\n" for s, t, p, v in rows))


def test_late_files_update_their_day_and_reruns_change_nothing(spark, tmp_path):
    folder, target, state = tmp_path / "live", str(tmp_path / "table"), str(tmp_path / "state")

    def run():
        ingest.run_readings(ingest.stream_readings(spark, str(folder)), target, state).awaitTermination()
        got = ingest.current_readings(spark, target).select("station", "last_update", "pollutant_id", "pollutant_avg")
        return [(s, str(t), p, v) for s, t, p, v in _rows(got)]

    _feed(folder, "a.csv", ("A", "20-03-2024 10:00:00", "NO2", "5"), ("A", "20-03-2024 10:00:00", "NO2", "7"), ("B", "bad", "CO", "1"))
    assert run() == [("A", "2024-03-20 10:00:00", "NO2", 7.0)]
    # Nine days and five years older, one of them for a key that is there already.
    _feed(folder, "b.csv", ("A", "11-03-2024 10:00:00", "NO2", "1"), ("B", "01-01-2019 00:00:00", "CO", "NA"), ("A", "20-03-2024 10:00:00", "NO2", "9"))
    want = [("A", "2024-03-11 10:00:00", "NO2", 1.0), ("A", "2024-03-20 10:00:00", "NO2", 9.0), ("B", "2019-01-01 00:00:00", "CO", None)]
    assert run() == want
    before = merge._manifests(spark, target)
    assert run() == want and merge._manifests(spark, target) == before and len(before) == 2
    assert merge.expire(spark, target) == 0 or run() == want
    assert run() == want


def _counted(rows):
    return rows.groupBy(merge.BUCKET, "k").agg(F.sum("n").alias("n")).select("k", "n", merge.BUCKET)


def test_a_repeated_batch_counts_once_and_other_buckets_stay(spark, tmp_path):
    target = str(tmp_path / "t")
    schema = spark.createDataFrame([], "k string, n long").schema

    def put(rows, batch_id, writer="w"):
        merge.merge_batch(spark.createDataFrame(rows, schema), batch_id, target, writer, F.substring("k", 1, 1), ["k"], _counted)

    assert merge.read_merged(spark, target, schema).collect() == []
    put([("a1", 1), ("b1", 2), (None, 9)], 0)
    first = merge._folders(spark, target, merge._manifests(spark, target))
    put([("a1", 1), ("b1", 2)], 0)  # the same batch again
    put([("a1", 5), ("a2", 7)], 1)
    put([("a1", 100)], 0, "other")  # another stream's batch of the same number
    put([], 2)
    now = merge._folders(spark, target, merge._manifests(spark, target))
    assert _rows(merge.read_merged(spark, target, schema)) == [("a1", 106), ("a2", 7), ("b1", 2)]
    assert now["b"] == first["b"] and now["a"] != first["a"]
    # A version without a committed manifest is not seen, and expire removes it with the replaced ones.
    spark.createDataFrame([("a1", 1)], schema).write.parquet(f"{target}/data/0000000009-x/_bucket=a")
    assert _rows(merge.read_merged(spark, target, schema)) == [("a1", 106), ("a2", 7), ("b1", 2)]
    assert merge.expire(spark, target) >= 2
    assert _rows(merge.read_merged(spark, target, schema)) == [("a1", 106), ("a2", 7), ("b1", 2)]


def test_one_hot_day_spreads_over_files(spark, tmp_path):
    target = str(tmp_path / "t")
    rows = spark.range(20_000).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("k"), F.lit(1).cast("long").alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        merge.merge_batch(rows, 0, target, "w", F.lit("a"), ["k"], _counted)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = merge.read_merged(spark, target, rows.schema)
    assert back.count() == 20_000 and len(back.inputFiles()) >= 4


def test_registration_is_repeatable(spark):
    at = dt.datetime(2026, 3, 1, 10, 0)
    rows = [("S", "W", "Garbage Burning", None, None, 0.5, 80.0, 12.9, 77.5, at), ("S", "W", "Garbage Burning", None, None, 0.5, 81.0, None, None, at)]
    events = spark.createDataFrame(rows, ingest.REPORT_EVENTS)
    one, two = fusion.register_reports(events).collect(), fusion.register_reports(events).collect()
    assert one == two and one[0]["Reference ID"] != one[1]["Reference ID"]
    assert one[0]["Reference ID"].startswith("ARG-2026-") and len(one[0]["Reference ID"]) == 9 + fusion.REFERENCE_DIGITS
    assert one[1]["GPS Coords"] == "12.9716, 77.5946" and one[0]["Status"] == "Pending" and one[0]["Timestamp"] == "2026-03-01 10:00:00"


def test_reports_delivered_twice_and_alerts_of_old_reports(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    event = {"station": "S", "ward_name": "W", "incident_type": "Road Dust", "confidence": 0.9, "severity": 90.0, "reported_at": "2026-03-01T10:00:00Z"}
    old = event | {"reported_at": "2020-01-01T01:00:00Z", "severity": 99.0}

    def put(name, *events):
        (folder / name).write_text("\n".join(json.dumps(e) for e in events))
        ingest.run_intake(ingest.stream_reports(spark, str(folder)), str(tmp_path / "r"), str(tmp_path / "rs")).awaitTermination()
        ingest.run_alerts(ingest.stream_reports(spark, str(folder)), str(tmp_path / "a"), str(tmp_path / "as")).awaitTermination()

    put("1.json", event, event | {"severity": 10.0}, event | {"reported_at": None})
    put("2.json", event, old)
    reports = ingest.current_reports(spark, str(tmp_path / "r")).collect()
    assert len(reports) == 4 and len({r["Reference ID"] for r in reports}) == 4
    alerts = [(str(r.window_start), r.ward_name, r.alerts, r.top_score) for r in ingest.current_alerts(spark, str(tmp_path / "a")).orderBy("window_start").collect()]
    assert alerts == [("2020-01-01 00:00:00", "W", 1, 99.0), ("2026-03-01 00:00:00", "W", 2, 90.0)]


def test_batch_alerts_equal_their_definition(spark):
    at = dt.datetime(2026, 3, 1, 10, 0)
    rows = [("S", "W", kind, None, None, 0.5, sev, 0.0, 0.0, t) for kind, sev, t in (("Garbage Burning", 1.0, at), ("Road Dust", 76.0, at), ("Road Dust", 75.0, at), ("Road Dust", 99.0, None))]
    got = ingest.ward_alerts(ingest.alert_rows(spark.createDataFrame(rows, ingest.REPORT_EVENTS))).collect()
    assert [(r.ward_name, r.alerts, r.top_score) for r in got] == [("W", 2, 76.0)]
