"""Daily series, leakage-free features, folds.

After ``daily_mean`` a station has at most one row per calendar day, so the windows below partition by station over a
group whose size is bounded by the length of the calendar, however many raw readings the station has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zephra.functions.bands import pm25_band, season
from zephra.functions.text import split_list


def daily_mean(ts: DataFrame, keys: Sequence[str] = ("station",)) -> DataFrame:
    """Mean PM2.5 per key and day; days without a value are dropped. Combines map-side, one shuffle."""
    rows = ts.filter(F.col("pm25").isNotNull())
    return rows.groupBy(*keys, F.to_date("timestamp").alias("date")).agg(F.avg("pm25").alias("pm25"))


def rolling(value: str, rows: int, at_least: int) -> Column:
    """Mean of the ``rows`` observations before the current one, NULL with fewer than ``at_least``."""
    w = Window.partitionBy("station").orderBy("date").rowsBetween(-rows, -1)
    return F.when(F.count(value).over(w) >= at_least, F.avg(value).over(w))


def calendar(date: str = "date") -> dict[str, Column]:
    return {
        "day_of_week": F.weekday(date),
        "month": F.month(date),
        "year": F.year(date),
        "season": season(F.month(date)),
    }


def add_features(daily: DataFrame) -> DataFrame:
    cal = calendar()
    return daily.withColumns(
        {"roll7": rolling("pm25", 7, 4), "roll30": rolling("pm25", 30, 15),
         "day_of_week": cal["day_of_week"], "month": cal["month"], "season": cal["season"]}
    )


def add_target(daily: DataFrame, strict_days: bool = False) -> DataFrame:
    """Next observation and its band; with ``strict_days`` only when it is the next calendar day."""
    w = Window.partitionBy("station").orderBy("date")
    following = F.lead("pm25").over(w)
    if strict_days:
        following = F.when(F.lead("date").over(w) == F.date_add("date", 1), following)
    out = daily.withColumn("next_pm25", following)
    return out.withColumn("target", pm25_band(F.col("next_pm25")))


def training_rows(daily: DataFrame, strict_days: bool = False) -> DataFrame:
    """Features and target; rows lacking the target or a rolling mean are dropped."""
    return add_target(add_features(daily), strict_days).dropna(subset=["target", "roll7", "roll30"])


def hotspot_stations(clusters: DataFrame, wards: DataFrame) -> DataFrame:
    """Stations of the clusters, and those labelled 0 or 1; ``clusters`` is a member table or has packed lists."""
    packed = "station" not in clusters.columns
    listed = clusters.select((F.explode(split_list(F.col("stations"))) if packed else F.col("station")).alias("station"))
    labelled = wards.filter(F.col("cluster").isin(0, 1)).select("station")
    return listed.unionByName(labelled).distinct()


def hotspot_flag(daily: DataFrame, clusters: DataFrame, wards: DataFrame) -> DataFrame:
    hot = hotspot_stations(clusters, wards).withColumn("_hot", F.lit(1))
    return daily.join(hot, "station", "left").withColumn("is_hotspot_zone", F.coalesce("_hot", F.lit(0))).drop("_hot")


def one_hot(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """One 0/1 column per value of a fixed list; unlisted values have zeros throughout."""
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values})


def features_at(daily: DataFrame, refs: DataFrame) -> DataFrame:
    """Feature row per station at its reference date (``station, ref_date``), from earlier days only."""
    past = daily.join(refs, "station").filter(F.col("date") < F.col("ref_date"))
    recent = Window.partitionBy("station").orderBy(F.col("date").desc())
    rows = past.withColumn("_rn", F.row_number().over(recent)).filter(F.col("_rn") <= 30)
    agg = rows.groupBy("station", "ref_date").agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg(F.when(F.col("_rn") <= 7, F.col("pm25"))).alias("_r7"),
        F.avg("pm25").alias("_r30"),
    )
    cal = calendar("ref_date")
    out = refs.join(agg, ["station", "ref_date"], "left")
    return out.select(
        "station",
        "ref_date",
        F.when(F.col("_n") >= 4, F.col("_r7")).alias("roll7"),
        F.when(F.col("_n") >= 15, F.col("_r30")).alias("roll30"),
        *[cal[c].alias(c) for c in ("day_of_week", "month", "season")],
    )


def feature_rows(
    daily: DataFrame, refs: DataFrame, clusters: DataFrame, labelled: DataFrame, lookup: DataFrame, wards: Sequence[str], seasons: Sequence[str]
) -> DataFrame:
    """The full feature row of a station at its reference date: rolling means, calendar, hotspot flag, ward and season by 0 or 1.

    ``lookup`` has (station, ward_name); a station without a ward, or with one not listed, has zeros for all wards.
    """
    rows = features_at(daily, refs)
    rows = hotspot_flag(rows, clusters, labelled).join(lookup.select("station", "ward_name").distinct(), "station", "left")
    return one_hot(one_hot(rows, "ward_name", wards), "season", seasons).drop("season", "ward_name")



def latest(daily: DataFrame) -> DataFrame:
    """(station, date, pm25) of the last day; combines map-side."""
    return daily.groupBy("station").agg(F.max("date").alias("date"), F.max_by("pm25", "date").alias("pm25"))


def tail_n(daily: DataFrame, n: int = 30) -> DataFrame:
    w = Window.partitionBy("station").orderBy(F.col("date").desc())
    return daily.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def split_by_share(df: DataFrame, train: float = 0.70, upto: float = 0.85) -> DataFrame:
    """Fold by position in the station's own timeline."""
    w = Window.partitionBy("station")
    n = F.count(F.lit(1)).over(w)
    pos = F.row_number().over(w.orderBy("date")) - 1
    return df.withColumn(
        "fold", F.when(pos < F.floor(n * train), "train").when(pos < F.floor(n * upto), "validation").otherwise("test")
    )


def split_by_year(df: DataFrame, train_to: int = 2023, validation: int = 2024, test: int = 2025) -> DataFrame:
    """Fold by calendar year; years outside have none."""
    y = F.year("date")
    return df.withColumn(
        "fold",
        F.when(y <= train_to, "train").when(y == validation, "validation").when(y == test, "test"),
    )


def folds(df: DataFrame, years: tuple[int, int, int] = (2023, 2024, 2025), prefix: str = "site_") -> DataFrame:
    """Stations with the prefix split by share, the others by year; one column instead of three tables."""
    shared = split_by_share(df).withColumnRenamed("fold", "_by_share")
    both = split_by_year(shared, *years)
    modern = F.col("station").startswith(prefix)
    out = both.withColumn("fold", F.when(modern, F.col("_by_share")).otherwise(F.col("fold"))).drop("_by_share")
    return out.filter(F.col("fold").isNotNull())


def check_split(df: DataFrame) -> DataFrame:
    """Per station the fold borders and whether a later fold starts before an earlier one ends."""

    def edge(fn, fold: str) -> Column:
        return fn(F.when(F.col("fold") == fold, F.col("date")))

    out = df.groupBy("station").agg(
        edge(F.max, "train").alias("train_max"),
        edge(F.min, "validation").alias("validation_min"),
        edge(F.min, "test").alias("test_min"),
    )
    leak = (F.col("train_max") >= F.col("validation_min")) | (F.col("validation_min") >= F.col("test_min"))
    return out.withColumn("leaks", F.coalesce(leak, F.lit(False)))
