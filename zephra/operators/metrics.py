"""Classification metrics over a fixed label list, each from one aggregate pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zephra.fixed_values import BANDS
from zephra.functions.text import round_half_even

# group label: names or prefixes of its features
IMPORTANCE_GROUPS = {
    "rolling_avg (7d + 30d)": ("roll7", "roll30"),
    "calendar (dow + month)": ("day_of_week", "month"),
    "is_hotspot_zone": ("is_hotspot_zone",),
    "season": ("season_*",),
    "ward_name": ("ward_name_*",),
}


def accuracy(pred: DataFrame) -> DataFrame:
    return pred.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("target") == F.col("pred")).cast("double")).alias("accuracy"))


def _counts(labels: Sequence[str]) -> list[Column]:
    out = []
    for i, x in enumerate(labels):
        t, p = F.col("target") == x, F.col("pred") == x
        out += [
            F.sum((t & p).cast("long")).alias(f"_tp{i}"),
            F.sum(t.cast("long")).alias(f"_sup{i}"),
            F.sum(p.cast("long")).alias(f"_prd{i}"),
        ]
    return out


def _f1(i: int) -> Column:
    return F.coalesce(F.try_divide(2.0 * F.col(f"_tp{i}"), F.col(f"_sup{i}") + F.col(f"_prd{i}")), F.lit(0.0))


def _macro(labels: Sequence[str]) -> Column:
    total = F.lit(0.0)
    for i in range(len(labels)):
        total = total + _f1(i)
    return total / len(labels)


def f1(pred: DataFrame, labels: Sequence[str] = BANDS) -> DataFrame:
    """One row: F1 per class, macro and support-weighted; 0 on zero division."""
    row = pred.agg(*_counts(labels))
    weighted, support = F.lit(0.0), F.lit(0)
    for i in range(len(labels)):
        weighted = weighted + _f1(i) * F.col(f"_sup{i}")
        support = support + F.col(f"_sup{i}")
    return row.select(
        *[_f1(i).alias(f"f1_{x}") for i, x in enumerate(labels)],
        _macro(labels).alias("f1_macro"),
        F.coalesce(F.try_divide(weighted, support), F.lit(0.0)).alias("f1_weighted"),
    )


def report(pred: DataFrame, labels: Sequence[str] = BANDS) -> DataFrame:
    """(label, precision, recall, f1, support) per class."""
    row = pred.agg(*_counts(labels))
    zero = F.lit(0.0)
    entries = F.array(
        *[
            F.struct(
                F.lit(x).alias("label"),
                F.coalesce(F.try_divide(1.0 * F.col(f"_tp{i}"), F.col(f"_prd{i}")), zero).alias("precision"),
                F.coalesce(F.try_divide(1.0 * F.col(f"_tp{i}"), F.col(f"_sup{i}")), zero).alias("recall"),
                _f1(i).alias("f1"),
                F.col(f"_sup{i}").alias("support"),
            )
            for i, x in enumerate(labels)
        ]
    )
    return row.select(F.inline(entries))


def confusion(pred: DataFrame, labels: Sequence[str] = BANDS) -> DataFrame:
    """One row per actual label, one column per predicted label, zero filled."""
    fixed = pred.sparkSession.createDataFrame([(x,) for x in labels], "actual string")
    counts = pred.groupBy(F.col("target").alias("actual")).agg(
        *[F.sum((F.col("pred") == x).cast("long")).alias(x) for x in labels]
    )
    return fixed.join(counts, "actual", "left").fillna(0, list(labels))


def station_scores(pred: DataFrame, labels: Sequence[str] = BANDS, at_least: int = 5) -> DataFrame:
    """(station, n, accuracy, f1_macro); stations with fewer rows are skipped."""
    rows = pred.groupBy("station").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("target") == F.col("pred")).cast("double")).alias("accuracy"),
        *_counts(labels),
    )
    return rows.filter(F.col("n") >= at_least).select("station", "n", "accuracy", _macro(labels).alias("f1_macro"))


def rank_importance(fi: DataFrame) -> DataFrame:
    """Rank, rounded share, and running sum of the rounded shares. One row per model feature: a schema-sized table."""
    order = Window.orderBy(F.col("importance").desc(), "feature")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    pct = round_half_even(F.col("importance") * 100, 3)
    out = fi.select(F.row_number().over(order).alias("rank"), "feature", "importance", pct.alias("importance_pct"))
    by_rank = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("cumulative_pct", round_half_even(F.sum("importance_pct").over(by_rank), 2))


def top_features(ranked: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` features, then one row with the share of all others."""
    top = ranked.filter(F.col("rank") <= n).select("rank", "feature", "importance_pct")
    rest = ranked.filter(F.col("rank") > n).agg(
        F.lit(n + 1).alias("rank"), F.lit("remaining").alias("feature"),
        F.coalesce(F.sum("importance_pct"), F.lit(0.0)).alias("importance_pct"),
    )
    return top.unionByName(rest)


def importance_groups(ranked: DataFrame) -> DataFrame:
    """Share per feature group."""
    label = F.lit(None).cast("string")
    for group, names in IMPORTANCE_GROUPS.items():
        for n in names:
            hit = F.col("feature").startswith(n[:-1]) if n.endswith("*") else F.col("feature") == n
            label = F.when(hit, group).otherwise(label)
    out = ranked.withColumn("feature_group", label).filter(F.col("feature_group").isNotNull())
    return out.groupBy("feature_group").agg(F.round(F.sum("importance_pct"), 3).alias("total_importance_pct"))
