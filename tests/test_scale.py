import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from zephra import scale
from zephra.operators import cleaning, spatial


def hot(n=3000, seed=1):
    """Rows of which a third share one key and one time."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{rnd.randrange(20)}"
        t = 5 if i % 3 == 0 and i % 2 == 0 else rnd.randrange(1000)
        rows.append((key, t, i, rnd.choice([None, None, float(rnd.randrange(50))])))
    return rows


def test_ranked(spark):
    rows = hot()
    df = spark.createDataFrame(rows, "k string, t long, i long, v double").repartition(7)
    got = {r["i"]: r["rank"] for r in scale.ranked(df, ["k"], ["t", "i"]).collect()}
    pdf = pd.DataFrame(rows, columns=["k", "t", "i", "v"]).sort_values(["k", "t", "i"])
    pdf["rank"] = pdf.groupby("k").cumcount() + 1
    assert got == dict(zip(pdf["i"], pdf["rank"]))


def test_blocks_with_many_partitions(spark):
    """Several real range partitions, so that carries between blocks matter."""
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        test_ranked(spark)
        test_fill_gaps_and_reading_gaps(spark)
        test_percentiles(spark)
        blocks = scale.blocked(spark.createDataFrame(hot(), "k string, t long, i long, v double"), ["k"], ["t", "i"])
        assert blocks.filter("k = 'hot'").select(scale.BLOCK).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_fill_gaps_and_reading_gaps(spark):
    rows = hot()
    df = spark.createDataFrame(rows, "k string, t long, i long, v double")
    got = {r["i"]: r["v"] for r in cleaning.fill_gaps(df, ["k"], ["t", "i"], ["v"]).collect()}
    pdf = pd.DataFrame(rows, columns=["k", "t", "i", "v"]).sort_values(["k", "t", "i"])
    want = pdf.groupby("k")["v"].transform(lambda s: s.ffill().bfill())
    for i, w in zip(pdf["i"], want):
        assert got[i] == w or (got[i] is None and pd.isna(w))
    times = df.withColumn("at", F.timestamp_seconds(F.col("t") * 3600).cast("timestamp_ntz"))
    gaps = {r["i"]: r["gap_hours"] for r in cleaning.reading_gaps(times, ["k"], "at", ["i"]).collect()}
    want = pdf.groupby("k")["t"].diff()
    for i, w in zip(pdf["i"], want):
        assert gaps[i] == w or (gaps[i] is None and pd.isna(w))


def test_percentiles(spark):
    rows = hot()
    df = spark.createDataFrame(rows, "k string, t long, i long, v double")
    points = {"p0": 0.0, "p33": 0.33, "p50": 0.5, "p100": 1.0}
    got = {r["k"]: r for r in scale.percentiles(df, "v", points, ["k"]).collect()}
    for k, g in pd.DataFrame(rows, columns=["k", "t", "i", "v"]).groupby("k"):
        for n, p in points.items():
            assert abs(got[k][n] - np.percentile(g["v"].dropna(), p * 100)) < 1e-9
    whole = scale.percentiles(df, "t", points).first()
    assert abs(whole["p33"] - np.percentile([r[1] for r in rows], 33)) < 1e-9


def test_markers_at_one_place(spark):
    df = spark.createDataFrame([(i, 12.9, 77.6 + (i == 3) * 0.1) for i in range(6)], "pos long, latitude double, longitude double")
    got = {r["pos"]: round(r["longitude_shown"], 6) for r in spatial.spread_duplicates(df, ["pos"]).collect()}
    assert got == {0: 77.6, 1: 77.603, 2: 77.606, 3: 77.7, 4: 77.609, 5: 77.612}


def test_checkpoint_folder_is_required_off_local(spark, monkeypatch):
    import pytest

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        scale.checkpoint_root(Session())


def test_tasks_are_bounded_by_rows(spark):
    """Many narrow rows of one small file: tasks are sized by their number, few rows stay as they are."""
    from zephra.scale import cut_lineage, dealt

    rows = cut_lineage(spark.range(20_000).coalesce(1))
    per = [r["n"] for r in dealt(rows, per_task=500).groupBy(F.spark_partition_id()).agg(F.count("id").alias("n")).collect()]
    assert sum(per) == 20_000 and max(per) <= 600
    assert dealt(rows, per_task=20_000) is rows


def test_many_rows_of_a_small_file_are_not_broadcast(spark):
    """Files of few bytes may hold many rows: beyond the bound they are merged, at most that many stay with Catalyst."""
    from zephra.scale import cut_lineage, merged_if_large

    rows = cut_lineage(spark.range(1000).select((F.col("id") % 2).alias("k")))
    other = spark.range(2).withColumnRenamed("id", "k")
    plan = lambda df: other.join(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan(merged_if_large(rows, 999)) and "Broadcast" not in plan(merged_if_large(rows, 999))
    assert merged_if_large(rows, 1000) is rows and "BroadcastHashJoin" in plan(rows)


def test_nearest_with_points_dealt_over_tasks(spark, monkeypatch):
    """The nearest search keeps its answers when its points are more than a task takes."""
    from zephra import scale
    from zephra.operators import spatial

    pts = spark.range(900).select((F.col("id") % 31 * 0.01).alias("lon"), (F.col("id") * 7 % 29 * 0.013).alias("lat"))
    items = spark.range(150).select(
        F.col("id").alias("pos"), F.concat(F.lit("s"), F.col("id")).alias("station"),
        (F.col("id") * 17 % 101 * 0.003).alias("longitude"), (F.col("id") * 29 % 97 * 0.004).alias("latitude"),
    )
    want = {(r.lon, r.lat): (r.nearest_station, r.nearest_km) for r in spatial.nearest_station(pts, items).collect()}
    sizes = []

    def counted(df, rows=None):
        out = scale.dealt(df, rows, per_task=50)
        sizes.append(max(r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()))
        return out

    monkeypatch.setattr(spatial, "ROWS_PER_TASK", 50)
    monkeypatch.setattr(spatial, "dealt", counted)
    assert {(r.lon, r.lat): (r.nearest_station, r.nearest_km) for r in spatial.nearest_station(pts, items).collect()} == want
    assert len(sizes) > 1 and max(sizes) <= 130
    monkeypatch.setattr(spatial, "FEW", 0)
    assert {(r.lon, r.lat): (r.nearest_station, r.nearest_km) for r in spatial.nearest_station(pts, items).collect()} == want
