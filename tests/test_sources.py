import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from zephra.operators import imaging
from zephra.sources import files

GRID = """﻿Year,2021 report
February-2021,00:00:00,01:00:00,bad,30:00
1,"1,234.5",12,NA,7

28,3
29,4
Nonsense-2021,00:00
1,99
Mar / 2022,05:00
1,8,9
x,1
"""
TABLE = """Station,Date,pm2.5,PM 10,country,lat
 A , 2023-01-01 10:00:00+05:30,10,null,India,12.5
,03-02-2023 04:05:00,"1,000",7,India,
B,nonsense,5,6,India,1
"""


def _write(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


def test_grid_and_table_files(spark, tmp_path):
    _write(tmp_path / "hist", "BTM_Layout-2021.csv", GRID)
    _write(tmp_path / "live" / "deep", "my_site_2020.csv", TABLE)
    dirs = [str(tmp_path / "hist"), str(tmp_path / "live"), str(tmp_path / "gone")]
    found = [r["path"] for r in files.list_sources(spark, dirs).collect()]
    assert sorted(p.rsplit("/", 1)[1] for p in found) == ["BTM_Layout-2021.csv", "my_site_2020.csv"]
    kinds = {r["path"].rsplit("/", 1)[1]: r["layout"] for r in files.classify_layout(files.file_heads(spark, dirs[:2])).collect()}
    assert kinds == {"BTM_Layout-2021.csv": "monthly_grid", "my_site_2020.csv": "tabular"}
    out = files.load_series(spark, dirs)
    rows = {(r["station"], str(r["timestamp"])): r for r in out.collect()}
    grid = {k: v for k, v in rows.items() if k[0].startswith("BTM")}
    # 24 cells for 1 and 28 February and 1 March; 29 February 2021 and the unknown month are dropped. Two labels of the
    # short header name hours 0 and 1, the others fall back to their position.
    assert out.filter(F.col("station").startswith("BTM")).count() == 72
    v = lambda t: grid["BTM Layout, Bengaluru - CPCB", t]["PM2.5"]
    assert v("2021-02-01 00:00:00") == 1234.5 and v("2021-02-01 01:00:00") == 12.0
    assert v("2021-02-01 02:00:00") is None and v("2021-02-01 03:00:00") == 7.0
    assert v("2021-02-28 00:00:00") == 3.0 and v("2021-02-28 23:00:00") is None
    march = out.filter(F.col("timestamp").between("2022-03-01 00:00:00", "2022-03-01 23:59:59") & F.col("`PM2.5`").isNotNull())
    assert {(str(r["timestamp"]), r["PM2.5"]) for r in march.collect()} == {("2022-03-01 05:00:00", 8.0), ("2022-03-01 01:00:00", 9.0)}
    a = rows["A", "2023-01-01 04:30:00"]
    assert (a["PM2.5"], a["PM10"], a["latitude"], a["longitude"]) == (10.0, None, 12.5, None)
    b = rows["my site 2020", "2023-02-03 04:05:00"]
    assert (b["PM2.5"], b["PM10"], b["latitude"]) == (1000.0, 7.0, None)
    assert len(rows) == 72 - (72 - len(grid)) + 2


def test_header_matching(spark):
    heads = spark.createDataFrame([("f", ["country", "O3 level", "NO2", "no-2", "Time", "CO"])], "path string, header array<string>")
    aliases = {"CO": ["co"], "OZONE": ["ozone", "o3"], "NO2": ["no2"], "timestamp": ["timestamp", "date", "time"], "SO2": ["so2"]}
    strict = files.match_headers(heads, aliases).first()["columns"]
    assert strict == {"CO": 5, "OZONE": 1, "NO2": 3, "timestamp": 4}
    loose = files.match_headers(heads, aliases, loose=True).first()["columns"]
    assert loose["CO"] == 0 and loose["NO2"] == 3


def test_master_drops_duplicates(spark, tmp_path):
    _write(tmp_path, "peenya.csv", "datetime,AQI,pm25\n2020-01-01,50,1\n2020-01-01,50,1\n")
    rows = files.load_master(spark, [str(tmp_path)]).collect()
    assert [(r["station_name"], r["AQI"], r["PM2.5"], r["latitude"]) for r in rows] == [("Peenya, Bengaluru - KSPCB", 50.0, 1.0, 13.03)]


def test_missing_sources_are_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.list_sources(spark, [str(tmp_path / "none")])
    with pytest.raises(FileNotFoundError):
        files.list_sources(spark, [str(tmp_path)])
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_feed(spark, str(tmp_path / "none.csv")).count()


def test_reports_backfill(spark, tmp_path):
    _write(tmp_path, "r.csv", 'Reference ID,Timestamp,Station\nA1,2026-01-01,"S, x"\n')
    r = files.read_reports(spark, str(tmp_path)).first()
    assert r["Station"] == "S, x" and r["AI Category"] == "N/A" and r["Status"] == "N/A"


BROKEN = 'Note,Station,"Date\nTime",PM2.5\n"two\nlines, ""quoted""",A,2023-01-01 10:00:00,10\n\nplain,B,2023-01-02 10:00:00,20\n'


@pytest.mark.parametrize("whole_bytes", [256 << 20, 0])
def test_line_breaks_in_quotes_and_headers_in_any_order(spark, tmp_path, monkeypatch, whole_bytes):
    monkeypatch.setattr(files, "WHOLE_BYTES", whole_bytes)
    folder = tmp_path / "a+b [1] 50%25 {x}"
    _write(folder, "broken.csv", "\ufeff" + BROKEN)
    _write(folder, "other.csv", "PM2.5,Date Time,Station\n30,2023-01-03 10:00:00,C\n")
    _write(folder, "empty.csv", "")
    _write(folder, "blank.csv", "\n,,\n")
    _write(folder, "alone.csv", "Station,Date,PM2.5\n")
    _write(folder / "grid", "Peenya 2021.csv", "Year,2021\nMarch-2021,00:00\n1,5\n")
    out = files.load_series(spark, [str(folder)])
    rows = {(r["station"], str(r["timestamp"]), r["PM2.5"]) for r in out.filter("`PM2.5` is not null").collect()}
    assert rows == {
        ("A", "2023-01-01 10:00:00", 10.0), ("B", "2023-01-02 10:00:00", 20.0), ("C", "2023-01-03 10:00:00", 30.0),
        ("Peenya, Bengaluru - KSPCB", "2021-03-01 00:00:00", 5.0),
    }
    heads = {r["path"].rsplit("/", 1)[1]: r["header"] for r in files.file_heads(spark, files.literal_path(str(folder))).collect()}
    assert heads["broken.csv"][0] == "Note" and set(heads) == {"broken.csv", "other.csv", "alone.csv", "Peenya%202021.csv"}
    table = files.read_by_name(spark, [files.literal_path(str(folder / "broken.csv")), files.literal_path(str(folder / "other.csv"))])
    assert {(r["Note"], r["Station"]) for r in table.collect()} == {('two\nlines, "quoted"', "A"), ("plain", "B"), (None, "C")}


def test_long_files_are_read_only_at_their_head(spark, tmp_path):
    _write(tmp_path, "long.csv", "Station,Date,pm25\n" + "S,2023-01-01 10:00:00,1\n" * 200_000)
    _write(tmp_path, "short.csv", "Date,Station,pm25\n2023-01-01 10:00:00,T,1\n")
    heads = files.file_heads(spark, str(tmp_path))
    assert {tuple(r["header"]) for r in heads.collect()} == {("Station", "Date", "pm25"), ("Date", "Station", "pm25")}
    found = files.read_alias_csv(spark, heads, {"station": ["station"], "timestamp": ["date"], "SO2": ["so2"]})
    assert {(r["station"], r["n"]) for r in found.groupBy("station").agg(F.count("timestamp").alias("n")).collect()} == {("S", 200_000), ("T", 1)}
    assert found.filter("SO2 is not null").count() == 0


def test_columns_by_name_with_repeated_and_empty_headers(spark, tmp_path):
    _write(tmp_path, "1.csv", "a,,A,b\n1,2,3,NA\n")
    _write(tmp_path, "2.csv", "b,a\n4,5\nonly\n6,7,8\n")
    rows = files.read_tabular(spark, str(tmp_path))
    assert rows.columns == ["a", "_c1", "A.1", "b"]
    assert {tuple(r) for r in rows.collect()} == {("1", "2", "3", None), ("5", None, None, "4"), (None, None, None, "only"), ("7", None, None, "6")}
    with pytest.raises(FileNotFoundError):
        _write(tmp_path / "none", "x.csv", "")
        files.read_tabular(spark, str(tmp_path / "none"))


def test_appended_reports_conform_or_are_refused(spark, tmp_path):
    folder = str(tmp_path / "reports")
    files.append_reports(spark.createDataFrame([("S", "Pending")], ["Station", "Status"]), folder)
    with pytest.raises(ValueError, match="Weather"):
        files.append_reports(spark.createDataFrame([("S", "x")], ["Station", "Weather"]), folder)
    _write(tmp_path / "reports", "by_hand.csv", "Status,Station,Reference ID\nVerified,T,A1\n")
    rows = {(r["Station"], r["Status"], r["Reference ID"], r["Timestamp"]) for r in files.read_reports(spark, folder).collect()}
    assert rows == {("S", "Pending", "N/A", "N/A"), ("T", "Verified", "A1", "N/A")}


def test_files_that_differ_in_case_only_count_once(spark, tmp_path):
    for name in ("Peenya.csv", "peenya.csv"):
        _write(tmp_path, name, "Date,pm25\n2023-01-01 10:00:00,1\n")
    assert files.list_sources(spark, [str(tmp_path), str(tmp_path)]).count() == 1
    assert files.load_series(spark, [str(tmp_path)]).count() == 1


def _png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_photos(spark, tmp_path):
    sky = np.zeros((256, 256, 3), np.uint8)
    sky[:] = (90, 140, 220)
    rnd = np.random.default_rng(1).integers(0, 60, (256, 256, 1)).astype(np.uint8)
    soot = np.repeat(rnd, 3, axis=2)
    small = np.zeros((40, 60, 3), np.uint8)
    small[:] = (190, 150, 100)
    for name, img in (("sky", sky), ("soot", soot), ("sand", small)):
        _png(tmp_path / f"{name}.png", img)
    (tmp_path / "broken.png").write_bytes(b"no image")
    images = imaging.read_images(spark, str(tmp_path))
    feats = imaging.photo_features(images)
    out = {r["image_id"].rsplit("/", 1)[1]: r for r in imaging.classify_image(feats).collect()}
    assert out["sky.png"]["category"] == "Clean / Normal Air" and out["sky.png"]["severity_score"] == 5
    assert out["sky.png"]["confidence"] == 0.97 and out["sky.png"]["blue_sky"] == 1.0
    assert out["soot.png"]["category"] == "Garbage Burning" and out["soot.png"]["dark_smoke"] == 1.0
    assert out["sand.png"]["dust"] == 1.0 and out["sand.png"]["category"] == "Construction Dust"
    assert out["broken.png"]["category"] is None and out["broken.png"]["brightness"] is None
    # The pixel-table features of the same picture agree.
    rows = [(0, x, y, *[float(v) for v in soot[y, x]]) for y in range(256) for x in range(256)]
    px = spark.createDataFrame(rows, "image_id int, x int, y int, r double, g double, b double")
    same = imaging.image_features(px).first()
    for f in imaging.FEATURES:
        assert abs(same[f] - out["soot.png"][f]) < 1e-9
