"""Queries: daily series, features, folds, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from zephra.fixed_values import BANDS, SEASONS
from zephra.functions.bands import pm25_band
from zephra.operators import cleaning, features, metrics, quality
from zephra.plans import bindings as b
from zephra.plans.bindings import oracle
from zephra.plans.catalog import query
from zephra.plans.quality_queries import WARD_LOOKUP_SQL, ward_lookup

YEARS = (1999, 2000, 2001)


def band_sql(c: str, null: str = "NULL") -> str:
    return f"CASE WHEN {c} IS NULL THEN {null} WHEN {c} <= 30 THEN 'Good' WHEN {c} <= 60 THEN 'Moderate' WHEN {c} <= 90 THEN 'Poor' ELSE 'Severe' END"


def season_sql(m: str) -> str:
    return f"CASE WHEN {m} IN (6, 7, 8, 9) THEN 'monsoon' WHEN {m} IN (11, 12, 1, 2) THEN 'winter' ELSE 'summer' END"


FEATURES_SQL = f"""SELECT station, date, pm25,
    CASE WHEN count(pm25) OVER w7 >= 4 THEN avg(pm25) OVER w7 END AS roll7,
    CASE WHEN count(pm25) OVER w30 >= 15 THEN avg(pm25) OVER w30 END AS roll30,
    (isodow(date) - 1)::INT AS day_of_week, month(date)::INT AS month, {season_sql('month(date)')} AS season,
    lead(pm25) OVER (PARTITION BY station ORDER BY date) AS next_pm25 FROM daily
    WINDOW w7 AS (PARTITION BY station ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
    w30 AS (PARTITION BY station ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"""
TRAINING_SQL = f"""SELECT *, {band_sql('next_pm25')} AS target, {band_sql('roll7')} AS pred FROM feats
    WHERE next_pm25 IS NOT NULL AND roll7 IS NOT NULL AND roll30 IS NOT NULL"""
FOLDS_SQL = """SELECT * FROM (SELECT *, CASE WHEN starts_with(station, 'site_') THEN
    CASE WHEN pos < floor(n * 0.7::DOUBLE) THEN 'train' WHEN pos < floor(n * 0.85::DOUBLE) THEN 'validation' ELSE 'test' END ELSE
    CASE WHEN year(date) <= 1999 THEN 'train' WHEN year(date) = 2000 THEN 'validation' WHEN year(date) = 2001 THEN 'test' END
    END AS fold FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY date) - 1 AS pos,
    count(*) OVER (PARTITION BY station) AS n FROM training)) WHERE fold IS NOT NULL"""
CHAIN = {"feats": FEATURES_SQL, "training": TRAINING_SQL}
FOLD_CHAIN = {**CHAIN, "folded": FOLDS_SQL}


def daily(spark, d):
    return features.daily_mean(b.readings(spark, d))


def training(spark, d):
    return features.training_rows(daily(spark, d))


def predicted(spark, d):
    """Training rows with the plain predictor: tomorrow's band is the band of the trailing week."""
    return training(spark, d).withColumn("pred", pm25_band(F.col("roll7")))


@query(
    "flagship_daily_trend",
    oracle(
        f"""SELECT station, date, round(pm25, 6) AS pm25, round(roll7, 6) AS roll7,
        {band_sql("pm25", "'Unknown'")} AS band FROM feats""",
        "daily", extra={"feats": FEATURES_SQL},
    ),
)
def daily_trend(spark, d):
    """Daily mean per station, trailing week mean, band."""
    rows = daily(spark, d).withColumn("roll7", features.rolling("pm25", 7, 4))
    return rows.select(
        "station", "date", F.round("pm25", 6).alias("pm25"), F.round("roll7", 6).alias("roll7"),
        pm25_band(F.col("pm25"), "Unknown").alias("band"),
    )


@query(
    "A4_daily_mean_by_ward",
    oracle(
        """SELECT r.station, coalesce(ward_name, 'Unknown') AS ward_name, CAST(timestamp AS DATE) AS date,
        round(avg(pm25), 6) AS pm25 FROM readings r LEFT JOIN w ON w.station = r.station GROUP BY 1, 2, 3
        HAVING avg(pm25) IS NOT NULL""",
        "readings", "stations", extra={"w": WARD_LOOKUP_SQL},
    ),
)
def daily_mean_by_ward(spark, d):
    # The ward depends on the station alone: aggregate first, join the small result.
    return quality.join_ward(daily(spark, d), ward_lookup(spark, d)).select(
        "station", "ward_name", "date", F.round("pm25", 6).alias("pm25")
    )


@query(
    "W1_W2_C4_features",
    oracle(
        "SELECT station, date, round(roll7, 6) AS roll7, round(roll30, 6) AS roll30, day_of_week, month, season FROM feats",
        "daily", extra={"feats": FEATURES_SQL},
    ),
)
def feature_rows(spark, d):
    return features.add_features(daily(spark, d)).select(
        "station", "date", F.round("roll7", 6).alias("roll7"), F.round("roll30", 6).alias("roll30"),
        "day_of_week", "month", "season",
    )


@query(
    "W3_next_day_target",
    oracle(
        "SELECT station, date, round(next_pm25, 6) AS next_pm25, target FROM training", "daily", extra=CHAIN,
    ),
)
def next_day_target(spark, d):
    return training(spark, d).select("station", "date", F.round("next_pm25", 6).alias("next_pm25"), "target")


@query(
    "W3_next_day_target_strict",
    oracle(
        f"""SELECT station, date, round(next_pm25, 6) AS next_pm25, {band_sql('next_pm25')} AS target FROM (SELECT *,
        lead(date) OVER (PARTITION BY station ORDER BY date) AS next_date FROM feats) WHERE next_date = date + 1
        AND roll7 IS NOT NULL AND roll30 IS NOT NULL""",
        "daily", extra={"feats": FEATURES_SQL},
    ),
)
def next_day_target_strict(spark, d):
    return features.training_rows(daily(spark, d), strict_days=True).select(
        "station", "date", F.round("next_pm25", 6).alias("next_pm25"), "target"
    )


@query(
    "A13_season_counts",
    oracle(
        f"""SELECT label, coalesce(n, 0) AS n, round(coalesce(n, 0) * 100.0 / (SELECT count(*) FROM daily), 6) AS share FROM
        (VALUES ('monsoon'), ('summer'), ('winter')) t(label) LEFT JOIN (SELECT {season_sql('month(date)')} AS label,
        count(*) AS n FROM daily GROUP BY 1) USING (label)""",
        "daily",
    ),
)
def season_counts(spark, d):
    rows = daily(spark, d).select(features.calendar()["season"].alias("season"))
    return cleaning.value_counts(rows, "season", SEASONS).withColumn("share", F.round("share", 6))


@query(
    "A13_class_counts",
    oracle(
        """SELECT label, coalesce(n, 0) AS n, round(coalesce(n, 0) * 100.0 / (SELECT count(*) FROM training), 6) AS share FROM
        (VALUES ('Good'), ('Moderate'), ('Poor'), ('Severe')) t(label) LEFT JOIN (SELECT target AS label, count(*) AS n
        FROM training GROUP BY 1) USING (label)""",
        "daily", extra=CHAIN,
    ),
)
def class_counts(spark, d):
    return cleaning.value_counts(training(spark, d), "target", BANDS).withColumn("share", F.round("share", 6))


@query(
    "J12_hotspot_flag",
    oracle(
        """SELECT station, date, CASE WHEN station IN (SELECT station FROM stations WHERE pos % 4 IN (2, 3)
        UNION SELECT 'st_' || (n_nationkey * 4 + 1) FROM nation UNION SELECT 'site_' || (n_nationkey * 6) FROM nation)
        THEN 1 ELSE 0 END AS is_hotspot_zone FROM daily""",
        "daily", "stations",
    ),
)
def hotspot_flag(spark, d):
    k = F.col("n_nationkey")
    clusters = b.table(spark, d, "nation").select(
        F.concat(F.lit("st_"), (k * 4 + 1).cast("string"), F.lit("; site_"), (k * 6).cast("string")).alias("stations")
    )
    wards = b.stations(spark, d).select("station", (F.col("pos") % 4 - 2).alias("cluster"))
    return features.hotspot_flag(daily(spark, d), clusters, wards).select("station", "date", "is_hotspot_zone")


@query(
    "C26_one_hot",
    oracle(
        f"""SELECT station, date, (season = 'monsoon')::INT AS season_monsoon, (season = 'summer')::INT AS season_summer,
        (season = 'winter')::INT AS season_winter FROM (SELECT station, date, {season_sql('month(date)')} AS season FROM daily)""",
        "daily",
    ),
)
def one_hot(spark, d):
    rows = daily(spark, d).select("station", "date", features.calendar()["season"].alias("season"))
    return features.one_hot(rows, "season", SEASONS).drop("season")


@query("W6_latest", oracle("SELECT station, max(date) AS date, round(arg_max(pm25, date), 6) AS pm25 FROM daily GROUP BY 1", "daily"))
def latest(spark, d):
    return features.latest(daily(spark, d)).withColumn("pm25", F.round("pm25", 6))


@query(
    "W7_last_30_days",
    oracle(
        """SELECT station, date, round(pm25, 6) AS pm25 FROM (SELECT *, row_number() OVER (PARTITION BY station
        ORDER BY date DESC) AS rn FROM daily) WHERE rn <= 30""",
        "daily",
    ),
)
def last_30_days(spark, d):
    return features.tail_n(daily(spark, d)).withColumn("pm25", F.round("pm25", 6))


_FEATURES_AT_SQL = f"""SELECT station, ref_date, round(CASE WHEN n >= 4 THEN r7 END, 6) AS roll7,
        round(CASE WHEN n >= 15 THEN r30 END, 6) AS roll30, (isodow(ref_date) - 1)::INT AS day_of_week,
        month(ref_date)::INT AS month, {season_sql('month(ref_date)')} AS season FROM (
        SELECT d.station, ref_date, count(*) FILTER (rn > 1) AS n, avg(pm25) FILTER (rn BETWEEN 2 AND 8) AS r7,
        avg(pm25) FILTER (rn BETWEEN 2 AND 31) AS r30 FROM (SELECT *, row_number() OVER (PARTITION BY station
        ORDER BY date DESC) AS rn, max(date) OVER (PARTITION BY station) AS ref_date FROM daily) d GROUP BY 1, 2)"""


@query("W12_features_at", oracle(_FEATURES_AT_SQL, "daily"))
def features_at(spark, d):
    days = daily(spark, d)
    refs = days.groupBy("station").agg(F.max("date").alias("ref_date"))
    return features.features_at(days, refs).withColumns({c: F.round(c, 6) for c in ("roll7", "roll30")})


_WARDS = [f"Ward_{k}" for k in range(25)]
_HOT_SQL = """SELECT station FROM stations WHERE pos % 4 IN (2, 3) UNION SELECT 'st_' || (n_nationkey * 4 + 1) FROM nation
    UNION SELECT 'site_' || (n_nationkey * 6) FROM nation"""
_ONE_HOTS = ", ".join(
    [f"coalesce((s.s_nationkey = {k})::INT, 0) AS ward_name_Ward_{k}" for k in range(25)] + [f"(season = '{x}')::INT AS season_{x}" for x in SEASONS]
)


@query(
    "W12_C26_feature_rows",
    oracle(
        f"""SELECT f.station, ref_date, roll7, roll30, day_of_week, month, (f.station IN ({_HOT_SQL}))::INT AS is_hotspot_zone, {_ONE_HOTS}
        FROM feats f LEFT JOIN stations s ON s.station = f.station""",
        "daily", "stations", extra={"feats": _FEATURES_AT_SQL},
    ),
)
def feature_rows(spark, d):
    """All features of a prediction: those at the reference date, hotspot flag, ward and season one-hots."""
    days = daily(spark, d)
    refs = days.groupBy("station").agg(F.max("date").alias("ref_date"))
    k = F.col("n_nationkey")
    clusters = b.table(spark, d, "nation").select(
        F.concat(F.lit("st_"), (k * 4 + 1).cast("string"), F.lit("; site_"), (k * 6).cast("string")).alias("stations")
    )
    stations = b.stations(spark, d)
    labelled = stations.select("station", (F.col("pos") % 4 - 2).alias("cluster"))
    lookup = stations.select("station", F.concat(F.lit("Ward_"), F.col("s_nationkey").cast("string")).alias("ward_name"))
    rows = features.feature_rows(days, refs, clusters, labelled, lookup, _WARDS, SEASONS)
    return rows.withColumns({c: F.round(c, 6) for c in ("roll7", "roll30")})


@query(
    "W10_split_by_share",
    oracle(
        """SELECT station, date, CASE WHEN pos < floor(n * 0.7::DOUBLE) THEN 'train' WHEN pos < floor(n * 0.85::DOUBLE)
        THEN 'validation' ELSE 'test' END AS fold FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY date) - 1
        AS pos, count(*) OVER (PARTITION BY station) AS n FROM training)""",
        "daily", extra=CHAIN,
    ),
)
def split_by_share(spark, d):
    return features.split_by_share(training(spark, d)).select("station", "date", "fold")


@query(
    "W11_split_by_year",
    oracle(
        """SELECT station, date, CASE WHEN year(date) <= 1999 THEN 'train' WHEN year(date) = 2000 THEN 'validation'
        WHEN year(date) = 2001 THEN 'test' END AS fold FROM training""",
        "daily", extra=CHAIN,
    ),
)
def split_by_year(spark, d):
    return features.split_by_year(training(spark, d), *YEARS).select("station", "date", "fold")


@query("U3_folds", oracle("SELECT station, date, fold FROM folded", "daily", extra=FOLD_CHAIN))
def folds(spark, d):
    return features.folds(training(spark, d), YEARS).select("station", "date", "fold")


@query(
    "W13_check_split",
    oracle(
        """SELECT *, coalesce(train_max >= validation_min OR validation_min >= test_min, false) AS leaks FROM (SELECT station,
        max(date) FILTER (fold = 'train') AS train_max, min(date) FILTER (fold = 'validation') AS validation_min,
        min(date) FILTER (fold = 'test') AS test_min FROM folded GROUP BY 1)""",
        "daily", extra=FOLD_CHAIN,
    ),
)
def check_split(spark, d):
    return features.check_split(features.folds(training(spark, d), YEARS))


@query(
    "A15_accuracy",
    oracle(
        "SELECT count(*) AS n, round(avg((target = pred)::INT), 6) AS accuracy FROM folded WHERE fold = 'test'",
        "daily", extra=FOLD_CHAIN,
    ),
)
def accuracy(spark, d):
    return metrics.accuracy(tested(spark, d)).withColumn("accuracy", F.round("accuracy", 6))


def tested(spark, d):
    return features.folds(predicted(spark, d), YEARS).filter("fold = 'test'")


_CLASS_SQL = """SELECT label, count(*) FILTER (target = label AND pred = label) AS tp, count(*) FILTER (target = label) AS sup,
    count(*) FILTER (pred = label) AS prd FROM folded, (VALUES ('Good'), ('Moderate'), ('Poor'), ('Severe')) t(label)
    WHERE fold = 'test' GROUP BY 1"""
_F1 = "coalesce(2.0::DOUBLE * tp / nullif(sup + prd, 0), 0)"


@query(
    "A16_f1",
    oracle(
        ", ".join([f"SELECT round(max({_F1}) FILTER (label = 'Good'), 6) AS \"f1_Good\""]
                  + [f"round(max({_F1}) FILTER (label = '{x}'), 6) AS \"f1_{x}\"" for x in BANDS[1:]])
        + f", round(sum({_F1}) / 4, 6) AS f1_macro, round(sum({_F1} * sup) / sum(sup), 6) AS f1_weighted FROM per_class",
        "daily", extra={**FOLD_CHAIN, "per_class": _CLASS_SQL},
    ),
)
def f1(spark, d):
    out = metrics.f1(tested(spark, d))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    "A17_confusion",
    oracle(
        "SELECT label AS actual, " + ", ".join(f"count(*) FILTER (target = label AND pred = '{x}') AS \"{x}\"" for x in BANDS)
        + " FROM folded, (VALUES ('Good'), ('Moderate'), ('Poor'), ('Severe')) t(label) WHERE fold = 'test' GROUP BY 1",
        "daily", extra=FOLD_CHAIN,
    ),
)
def confusion(spark, d):
    return metrics.confusion(tested(spark, d))


@query(
    "A18_classification_report",
    oracle(
        f"""SELECT label, round(coalesce(tp::DOUBLE / nullif(prd, 0), 0), 6) AS precision,
        round(coalesce(tp::DOUBLE / nullif(sup, 0), 0), 6) AS recall, round({_F1}, 6) AS f1, sup AS support FROM per_class""",
        "daily", extra={**FOLD_CHAIN, "per_class": _CLASS_SQL},
    ),
)
def classification_report(spark, d):
    return metrics.report(tested(spark, d)).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(
    "A19_station_scores",
    oracle(
        """SELECT station, n, round(accuracy, 6) AS accuracy, round(f / 4, 6) AS f1_macro FROM (SELECT station, count(*) AS n,
        avg((target = pred)::INT) AS accuracy, """
        + " + ".join(
            f"coalesce(2.0::DOUBLE * count(*) FILTER (target = '{x}' AND pred = '{x}') / nullif(count(*) FILTER (target = '{x}') + count(*) FILTER (pred = '{x}'), 0), 0)"
            for x in BANDS
        )
        + " AS f FROM folded WHERE fold = 'test' GROUP BY 1 HAVING count(*) >= 5)",
        "daily", extra=FOLD_CHAIN,
    ),
)
def station_scores(spark, d):
    return metrics.station_scores(tested(spark, d)).withColumns({c: F.round(c, 6) for c in ("accuracy", "f1_macro")})


_NAMES = ["roll7", "roll30", "month", "day_of_week", "is_hotspot_zone", "season_monsoon", "season_summer", "season_winter"]
_BRAND = "CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT)"
_IMPORTANCE = f"""SELECT CASE {_BRAND} {" ".join(f"WHEN {i + 1} THEN '{n}'" for i, n in enumerate(_NAMES))}
    ELSE 'ward_name_' || {_BRAND} END AS feature, sum(p_retailprice) / (SELECT sum(p_retailprice) FROM part) AS importance
    FROM part GROUP BY 1"""
_RANKED = """SELECT *, sum(importance_pct) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) AS cum FROM (
    SELECT row_number() OVER (ORDER BY importance DESC, feature) AS rank, feature, importance,
    round_even(importance * 100 * 1000, 0) / 1000.0::DOUBLE AS importance_pct FROM fi)"""


def importance(spark, d):
    """A feature importance table: share of list price per brand, brands named as features."""
    no = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    name = F.concat(F.lit("ward_name_"), no.cast("string"))
    for i, n in enumerate(_NAMES):
        name = F.when(no == i + 1, n).otherwise(name)
    part = b.table(spark, d, "part")
    total = part.agg(F.sum("p_retailprice").alias("t")).scalar()
    sums = part.groupBy(name.alias("feature")).agg(F.sum("p_retailprice").alias("s"))
    return sums.select("feature", (F.col("s") / total).alias("importance"))


@query(
    "W8_rank_importance",
    oracle(
        """SELECT rank::INT AS rank, feature, round(importance, 9) AS importance, importance_pct, round_even(cum * 100, 0) / 100.0::DOUBLE AS cumulative_pct
        FROM ranked_fi""",
        extra={"fi": _IMPORTANCE, "ranked_fi": _RANKED},
    ),
)
def rank_importance(spark, d):
    return metrics.rank_importance(importance(spark, d)).withColumn("importance", F.round("importance", 9))


@query(
    "O3_top_features",
    oracle(
        """SELECT rank::INT AS rank, feature, importance_pct FROM ranked_fi WHERE rank <= 20 UNION ALL
        SELECT 21, 'remaining', round(coalesce(sum(importance_pct), 0), 3) FROM ranked_fi WHERE rank > 20""",
        extra={"fi": _IMPORTANCE, "ranked_fi": _RANKED},
    ),
)
def top_features(spark, d):
    out = metrics.top_features(metrics.rank_importance(importance(spark, d)))
    return out.withColumn("importance_pct", F.round("importance_pct", 3))


@query(
    "A20_importance_groups",
    oracle(
        """SELECT CASE WHEN feature IN ('roll7', 'roll30') THEN 'rolling_avg (7d + 30d)' WHEN feature IN ('month', 'day_of_week')
        THEN 'calendar (dow + month)' WHEN feature = 'is_hotspot_zone' THEN feature WHEN feature LIKE 'season_%' THEN 'season'
        ELSE 'ward_name' END AS feature_group, round(sum(importance_pct), 3) AS total_importance_pct FROM ranked_fi GROUP BY 1""",
        extra={"fi": _IMPORTANCE, "ranked_fi": _RANKED},
    ),
)
def importance_groups(spark, d):
    return metrics.importance_groups(metrics.rank_importance(importance(spark, d)))
