"""Cleaning, shaping and profiling of readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephra.fixed_values import CITY_NAMES, FEED_INDEX, FEED_NULL_TOKENS, NULL_TOKENS, POLLUTANTS, STATIONS
from zephra.functions.text import clean_stem, norm_key, null_tokens, quoted, to_number, to_time
from zephra.scale import BLOCK, carried, cut_lineage, percentiles


def nullify(df: DataFrame, tokens: list[str] = NULL_TOKENS) -> DataFrame:
    """Null tokens in every text column become NULL, in one projection."""
    return df.select(
        *[
            null_tokens(quoted(f.name), tokens).alias(f.name) if isinstance(f.dataType, T.StringType) else quoted(f.name)
            for f in df.schema
        ]
    )


def clean_feed(feed: DataFrame) -> DataFrame:
    """Types the real-time feed; unreadable numbers and times become NULL."""
    numbers = ["latitude", "longitude", "pollutant_min", "pollutant_max", "pollutant_avg"]
    out = nullify(feed, FEED_NULL_TOKENS)
    return out.withColumns(
        {**{n: to_number(F.col(n)) for n in numbers}, "last_update": to_time(F.col("last_update"))}
    )


def pivot_wide(
    feed: DataFrame,
    index: Sequence[str] = FEED_INDEX,
    names: Sequence[str] = POLLUTANTS,
    key: str = "pollutant_id",
    value: str = "pollutant_avg",
) -> DataFrame:
    """Long to wide by mean. Groups with a NULL in the index or without any value disappear."""
    rows = feed.dropna(subset=list(index)).filter(F.col(value).isNotNull() & F.col(key).isin(list(names)))
    return rows.groupBy(*index).pivot(key, list(names)).agg(F.avg(value))


def filter_or_all(df: DataFrame, column: str, names: Sequence[str] = CITY_NAMES) -> DataFrame:
    """Rows whose city is in ``names``; all rows when none is. The count is a scalar subquery of the same plan."""
    hit = F.coalesce(F.lower(F.trim(F.col(column))).isin(list(names)), F.lit(False))
    hits = df.filter(hit).agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.filter(hit | (hits == 0))


def exclude(df: DataFrame, column: str, names: Sequence[str] = (), prefix: str | None = None) -> DataFrame:
    out = df
    if names:
        out = out.filter(~F.col(column).isin(list(names)))
    if prefix is not None:
        out = out.filter(~F.col(column).startswith(prefix))
    return out


def canonical_station(df: DataFrame, names: DataFrame, column: str = "station") -> DataFrame:
    """Site ids to friendly names by the fixed 12-row mapping; unmapped ids stay."""
    joined = df.join(F.broadcast(names), df[column] == names["site"], "left")
    return joined.withColumn(column, F.coalesce("friendly", column)).drop("site", "friendly")


def infer_station(files: DataFrame, registry: Sequence[tuple] = STATIONS, stem: str = "stem") -> DataFrame:
    """Station of a file name: the longest registry alias it contains, else the cleaned name without coordinates.

    The registry is a table fixed in code, so its aliases travel as one constant array; no join, no shuffle.
    """
    norm = norm_key(F.col(stem))
    options = []
    for i, (alias, name, lat, lon) in enumerate((a, n, la, lo) for n, la, lo, names in registry for a in names):
        key = norm_key(F.lit(alias))
        entry = F.struct(
            F.length(key).alias("len"), F.lit(-i).alias("rev"), F.lit(name).alias("station"),
            F.lit(lat).alias("latitude"), F.lit(lon).alias("longitude"),
        )
        options.append(F.when(F.contains(norm, key), entry))
    best = files.withColumn("_best", F.array_max(F.array(*options)))
    return best.select(
        *files.columns,
        F.coalesce("_best.station", clean_stem(F.col(stem))).alias("station"),
        F.col("_best.latitude").alias("latitude"),
        F.col("_best.longitude").alias("longitude"),
    )


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Fixed column order; absent columns are NULL."""
    have = set(df.columns)
    return df.select(
        *[
            quoted(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    have = set(df.columns)
    return df.withColumns(
        {c: F.coalesce(quoted(c), F.lit(v)) if c in have else F.lit(v) for c, v in defaults.items()}
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First record per key. ``min_by`` combines map-side, so a hot key never meets in one sort."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def coalesce_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First non-NULL value per column and key, in the given order."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    at = F.struct(*order)
    return df.groupBy(*keys).agg(
        *[F.min_by(quoted(c), F.when(quoted(c).isNotNull(), at)).alias(c) for c in rest]
    )


def fill_gaps(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Forward, then backward fill per key, blockwise: no key meets whole in one task."""
    ahead, before = carried(df, keys, order, columns)
    upto = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ahead.withColumns(
        {c: F.coalesce(F.last(quoted(c), ignorenulls=True).over(upto), F.col(before[c])) for c in columns}
    )
    # What is still NULL lies before the first value of its key.
    first = df.groupBy(*keys).agg(
        *[F.min_by(quoted(c), F.when(quoted(c).isNotNull(), F.struct(*order))).alias(f"_f{i}")
          for i, c in enumerate(columns)]
    )
    out = out.drop(BLOCK, *before.values()).join(first, list(keys), "left")
    return out.select(
        *[F.coalesce(quoted(c), F.col(f"_f{columns.index(c)}")).alias(c) if c in columns else quoted(c)
          for c in df.columns]
    )


def reading_gaps(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str]) -> DataFrame:
    """Hours since the reading before, NULL for the first of a key."""
    full = [time, *order]
    rows, carry = carried(df, keys, full, [time])
    within = Window.partitionBy(*keys, BLOCK).orderBy(*full)
    before = F.coalesce(F.lag(time).over(within), F.col(carry[time]))
    hours = (micros(F.col(time)) - micros(before)) / F.lit(3_600_000_000.0)
    return rows.withColumn("gap_hours", hours).drop(BLOCK, carry[time])


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp, read as UTC."""
    return F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), c).cast("timestamp"))


def value_counts(df: DataFrame, column: str, labels: Sequence[str] | None = None) -> DataFrame:
    """(label, n, share %) per value; with ``labels`` exactly those, zero filled."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    if labels is not None:
        fixed = df.sparkSession.createDataFrame([(x,) for x in labels], "label string")
        counts = fixed.join(counts, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    counts = cut_lineage(counts)  # read for the rows and for their total, while the source is read once
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return counts.withColumn("share", F.try_divide(F.col("n") * 100.0, total))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: count, mean, std, min, exact quartiles, max; two decimals."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), quoted(c).cast("double").alias("v")) for c in columns])
    long = df.select(F.explode(pairs).alias("p")).select("p.name", "p.v").filter(F.col("v").isNotNull())
    base = long.groupBy("name").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"),
    )
    q = percentiles(long, "v", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, ["name"])
    return base.join(q, "name").select(
        "name", "n", *[F.round(c, 2).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")]
    )


def profile(df: DataFrame, counted: Sequence[str], key: Sequence[str] | None = None) -> DataFrame:
    """One row: rows, duplicate rows, NULLs per column, distinct values of ``counted`` (among the key columns); one scan.

    Duplicates come from a grouped count, and the distinct values from a second one over its groups, both spread over all
    tasks; no distinct set is held in memory.
    """
    cols = list(key or df.columns)
    grouped = df.groupBy(*[quoted(c) for c in cols]).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(quoted(c).isNull().cast("long")).alias(f"_null_{c}".replace(".", "")) for c in df.columns],
    )
    out = grouped.agg(
        F.sum("_n").alias("row_count"),
        F.sum(F.col("_n") - 1).alias("duplicate_rows"),
        *[F.sum(f"_null_{c}".replace(".", "")).alias(f"null_{c}".replace(".", "")) for c in df.columns],
        *[F.count_distinct(quoted(c)).alias(f"distinct_{c}") for c in counted],
    )
    return out.select(F.lit(len(df.columns)).cast("long").alias("column_count"), *out.columns)


def summary(df: DataFrame, station: str, time: str) -> DataFrame:
    """One row: rows, stations, date range, NULLs per column."""
    per_station = df.groupBy(station).agg(
        F.count(F.lit(1)).alias("_n"), F.min(time).alias("_lo"), F.max(time).alias("_hi"),
        *[F.sum(quoted(c).isNull().cast("long")).alias(f"_x{i}") for i, c in enumerate(df.columns)],
    )
    return per_station.agg(
        F.sum("_n").alias("row_count"),
        F.count(station).alias("stations"),
        F.min("_lo").alias("first_time"),
        F.max("_hi").alias("last_time"),
        *[F.sum(f"_x{i}").alias(f"null_{c}".replace(".", "")) for i, c in enumerate(df.columns)],
    )
