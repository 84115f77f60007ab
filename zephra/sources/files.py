"""File sources and sinks: discovery, layout detection, monthly grids, alias-headed tables, feeds and reports.

The first record of every file is read on the executors and tells its layout and header; files that lie alike are then one
scan by Spark's CSV reader. Grids are read line by line, so a long one splits over tasks; the place of a line in its file is
(``_start``, ``_line``): byte offset of the split, then order within it.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephra.fixed_values import FEED_NULL_TOKENS, MASTER_ALIASES, NULL_TOKENS, REPORT_COLUMNS, SERIES_ALIASES, STATIONS
from zephra.functions.text import hour_of, month_no, norm_key, null_tokens, quoted, to_number, to_utc_naive
from zephra.operators.cleaning import conform, infer_station, nullify
from zephra.scale import BLOCK, broadcast_if_small, carried, cut_lineage
from zephra.sources.schemas import FEED_RAW, MASTER, REPORTS, SERIES

_MONTH_ROW = r"^([A-Za-z]+)\s*[-/]\s*([0-9]{4})$"
_PLACE = ["_start", "_line"]
WHOLE_BYTES = 256 << 20  # files beyond are split over tasks if no record of theirs goes over a line break


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def list_sources(spark: SparkSession, dirs: Sequence[str], recursive: bool = True, pattern: str = "*.csv") -> DataFrame:
    """``path`` of every file of ``pattern`` below the existing directories, one row per lower-cased path. None at all is an error."""
    found = [d for d in dirs if _exists(spark, d)]
    if not found:
        raise FileNotFoundError(f"no source directory among {list(dirs)}")
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", str(recursive).lower())
        .load([literal_path(d) for d in found])
    )
    out = files.groupBy(F.lower("path").alias("key")).agg(F.min("path").alias("path")).select("path")
    if out.isEmpty():
        raise FileNotFoundError(f"no CSV file in {found}")
    return out


def read_lines(spark: SparkSession, paths: str | Sequence[str], pattern: str = "*.csv") -> DataFrame:
    """(path, _start, _line, text) of all non-empty lines."""
    raw = spark.read.text(paths, recursiveFileLookup=True, pathGlobFilter=pattern)
    return raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_line"),
        F.regexp_replace("value", "^\\ufeff", "").alias("text"),
    ).filter(F.regexp_replace("text", "[\\s,\"]", "") != "")


def _one_file_each(spark: SparkSession) -> SparkSession:
    """A session whose file scans give every file a task of its own, and Python few lines at a time."""
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    for name in ("maxPartitionBytes", "openCostInBytes"):
        other.conf.set(f"spark.sql.files.{name}", str(1 << 40))
    other.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "32")
    return other


def _first_record(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first record with any content, of a task that reads one file from its start; what follows is not read."""
    file: list[pa.RecordBatch] = []

    def lines() -> Iterator[str]:
        for batch in batches:
            if batch.num_rows and batch.column("start")[0].as_py():
                return
            file[:] = [batch]
            for i, text in enumerate(batch.column("text").to_pylist()):
                yield text.removeprefix("\ufeff") if i == 0 and batch.column("first")[0].as_py() else text

    csv.field_size_limit(1 << 30)
    for record in csv.reader(lines()):
        cells = [c.strip().strip('"').strip() for c in record]
        if any(cells):
            row = file[0].slice(0, 1)
            yield pa.RecordBatch.from_pydict({"path": row.column("path"), "size": row.column("size"), "header": pa.array([cells], pa.list_(pa.string()))})
            return


def file_heads(spark: SparkSession, paths: str | Sequence[str], pattern: str = "*") -> DataFrame:
    """(path, size, header) per file with any content: the cells of its first record, read on the executors.

    A header may hold line breaks inside quotes. Of two files whose paths differ in case only, the first is taken.
    """
    raw = _one_file_each(spark).read.text(paths, recursiveFileLookup=True, pathGlobFilter=pattern)
    rows = raw.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("text"),
        (F.monotonically_increasing_id() % (1 << 33) == 0).alias("first"),
    )
    heads = cut_lineage(rows.mapInArrow(_first_record, "path string, size long, header array<string>"), spark)
    first = heads.groupBy(F.lower("path").alias("_key")).agg(F.min("path").alias("path"))
    return heads.join(first.select("path"), "path", "left_semi")


def is_grid(first_cell: Column) -> Column:
    return (F.lower(first_cell) == "year") | first_cell.rlike(_MONTH_ROW)


def classify_layout(heads: DataFrame) -> DataFrame:
    """``heads`` with ``layout``: ``monthly_grid`` or ``tabular``."""
    return heads.withColumn("layout", F.when(is_grid(F.get("header", F.lit(0))), "monthly_grid").otherwise("tabular"))


def _cells(text: Column, width: int) -> Column:
    """CSV line to an array of ``width`` trimmed cells; missing ones are NULL."""
    names = [f"c{i}" for i in range(width)]
    row = F.from_csv(text, ", ".join(f"{n} string" for n in names), {"escape": '"'})
    # Through a lambda the line is parsed once; taking fields of from_csv itself would parse it once per field.
    each = F.transform(F.array(row), lambda r: F.array(*[F.trim(F.btrim(F.trim(r[n]), F.lit('"'))) for n in names]))
    return each[0]


def literal_path(path: str) -> str:
    """A path as Spark's readers take it: wildcard signs in it escaped."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def plain_path(encoded: str) -> str:
    """The same from a path of ``_metadata.file_path``, which is URL-encoded."""
    return literal_path(unquote(encoded))


def file_stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), r"\.[^.]*$", "")


def _broken(spark: SparkSession, paths: list[str]) -> set[str]:
    """Files in which some line holds an odd number of quotes: a record goes over a line break there."""
    if not paths:
        return set()
    lines = spark.read.text([plain_path(p) for p in paths]).select(F.col("_metadata.file_path").alias("path"), "value")
    odd = F.regexp_count("value", F.lit('"')) % 2 == 1
    return {r["path"] for r in lines.filter(odd).select("path").distinct().collect()}


def _records(spark: SparkSession, paths: list[str], whole: bool, names: list[str]) -> DataFrame:
    """Records below the headers of files with equally many columns, as text, with their ``_path``."""
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))])
    rows = spark.read.csv([plain_path(p) for p in paths], schema=schema, header=True, escape='"', multiLine=whole, enforceSchema=True)
    return rows.select(F.col("_metadata.file_path").alias("_path"), *[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)])


def _grouped(spark: SparkSession, heads: DataFrame, *what: str) -> dict[tuple, list[str]]:
    """Paths by (width, whether files are read whole, values of ``what``).

    Files of up to ``WHOLE_BYTES`` are read whole, which finds line breaks inside quotes. Larger ones are split over tasks,
    unless a pass over their lines finds such a break.
    """
    rows = heads.select("path", "size", F.size("header").alias("width"), *what).collect()
    broken = _broken(spark, [r["path"] for r in rows if r["size"] > WHOLE_BYTES])
    out: dict[tuple, list[str]] = {}
    for r in sorted(rows, key=lambda r: r["path"]):
        values = tuple(tuple(sorted(r[w].items())) if isinstance(r[w], dict) else tuple(r[w] or ()) for w in what)
        out.setdefault((r["width"], r["size"] <= WHOLE_BYTES or r["path"] in broken, *values), []).append(r["path"])
    return out


def _column_names(header: Sequence[str]) -> list[str]:
    """Header cells as column names: empty ones by position, repeated ones (in any case) numbered."""
    out: list[str] = []
    for i, name in enumerate(header):
        name = name or f"_c{i}"
        k, taken = 0, {n.lower() for n in out}
        while (new := name if k == 0 else f"{name}.{k}").lower() in taken:
            k += 1
        out.append(new)
    return out


def read_by_name(spark: SparkSession, paths: str | Sequence[str], pattern: str = "*") -> DataFrame:
    """All-text rows of CSV files, each by its own header; columns are united by name, absent ones are NULL.

    Each distinct header is one scan of its files. No file with a header is an error.
    """
    parts = []
    for (_, whole, header), files in _grouped(spark, file_heads(spark, paths, pattern), "header").items():
        parts.append(_records(spark, files, whole, _column_names(header)).drop("_path"))
    if not parts:
        raise FileNotFoundError(f"no CSV file with a header in {paths}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_tabular(spark: SparkSession, paths: str | Sequence[str], tokens: list[str] = NULL_TOKENS) -> DataFrame:
    """All-text CSV scan by name; null tokens become NULL."""
    return nullify(read_by_name(spark, paths), tokens)


def read_month_grid(lines: DataFrame, value_col: str = "PM2.5") -> DataFrame:
    """Grid lines to one row per hour: (path, timestamp, ``value_col``)."""
    row = lines.withColumn("cells", _cells(F.col("text"), 25)).withColumn("head", F.col("cells")[0])
    is_month = F.col("head").rlike(_MONTH_ROW)
    year_cell = F.regexp_extract(F.coalesce(F.col("cells")[1], F.lit("")), "([0-9]{4})", 1).try_cast("int")
    row = row.select(
        "path",
        *_PLACE,
        "cells",
        "head",
        F.when(F.lower("head") == "year", year_cell)
        .when(is_month, F.regexp_extract("head", _MONTH_ROW, 2).try_cast("int"))
        .alias("year"),
        # 0 marks an unknown month name: it must replace the month before it.
        F.when(is_month, F.coalesce(month_no(F.regexp_extract("head", _MONTH_ROW, 1)), F.lit(0))).alias("month"),
        F.when(is_month, F.slice("cells", 2, 24)).alias("labels"),
    )
    heads = ["year", "month", "labels"]
    rows, carry = carried(row, ["path"], _PLACE, heads)
    upto = Window.partitionBy("path", BLOCK).orderBy(*_PLACE).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(
        "path",
        "cells",
        "head",
        *[F.coalesce(F.last(h, ignorenulls=True).over(upto), F.col(carry[h])).alias(h) for h in heads],
    )
    days = rows.filter(F.col("head").rlike("^[0-9]{1,2}$") & F.col("year").isNotNull() & (F.col("month") > 0))
    cells = days.select(
        "path", "year", "month", F.col("head").cast("int").alias("day"), "labels",
        F.posexplode(F.slice("cells", 2, 24)).alias("pos", "cell"),
    )
    hour = hour_of(F.coalesce(F.get("labels", F.col("pos")), F.lit("")), F.col("pos"))
    stamped = cells.withColumn("hour", hour).withColumn(
        "timestamp", F.expr("try_make_timestamp_ntz(year, month, day, hour, 0, 0)")
    )
    return stamped.filter(F.col("timestamp").isNotNull()).select(
        "path", "timestamp", to_number(F.col("cell")).alias(value_col)
    )


def match_headers(heads: DataFrame, aliases: dict[str, list[str]], loose: bool = False) -> DataFrame:
    """(path, columns map target -> cell position) from (path, header array).

    An alias matches a header equal to it or containing it, in alias order; of equal headers the later one counts.
    ``loose`` takes the first such match as it stands; the default prefers equality (so that ``co`` is not ``country``).
    """
    cols = heads.select("path", F.posexplode("header").alias("pos", "name")).withColumn("norm", norm_key(F.col("name")))
    cols = cols.groupBy("path", "norm").agg(F.max("pos").alias("pos"), F.min("pos").alias("seen"))
    wanted = F.array(
        *[
            F.struct(F.lit(t).alias("target"), F.lit(i).alias("alias_no"), norm_key(F.lit(a)).alias("alias"))
            for t, names in aliases.items()
            for i, a in enumerate(names)
        ]
    )
    tries = cols.select("*", F.explode(wanted).alias("w")).select("path", "norm", "pos", "seen", "w.*")
    tries = tries.filter(F.col("norm").contains(F.col("alias")))
    inexact = F.lit(0) if loose else (F.col("norm") != F.col("alias")).cast("int")
    best = tries.groupBy("path", "target").agg(F.min_by("pos", F.struct(inexact, "alias_no", "seen")).alias("pos"))
    return best.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("target", "pos"))).alias("columns"))


def read_alias_csv(spark: SparkSession, heads: DataFrame, aliases: dict[str, list[str]], loose: bool = False) -> DataFrame:
    """Records of tabular files with any header to (path, one text column per target).

    ``heads`` holds (path, size, header). Files whose targets lie in the same places are one scan, whatever their headers
    say; Spark's CSV reader takes their records, so quoted line breaks and quotes are its matter.
    """
    found = heads.join(match_headers(heads, aliases, loose), "path", "left")
    parts = []
    for (width, whole, places), paths in _grouped(spark, found, "columns").items():
        at = dict(places)
        rows = _records(spark, paths, whole, [f"_c{i}" for i in range(width)])
        parts.append(
            rows.select(
                F.col("_path").alias("path"),
                *[
                    null_tokens(F.trim(F.btrim(F.trim(f"_c{at[t]}"), F.lit('"'))), NULL_TOKENS).alias(t)
                    if t in at else F.lit(None).cast("string").alias(t)
                    for t in aliases
                ],
            )
        )
    if not parts:
        return spark.createDataFrame([], ", ".join(f"`{n}` string" for n in ("path", *aliases)))
    return reduce(DataFrame.unionByName, parts)


def _load(spark, dirs, registry, aliases, schema, station, time, value_col, loose, pattern):
    paths = [r["path"] for r in list_sources(spark, dirs, pattern=pattern).collect()]
    # One row per file: layout, header, and the station its name tells; written once, as three reads follow.
    heads = classify_layout(file_heads(spark, [literal_path(p) for p in paths], pattern))
    sources = cut_lineage(infer_station(heads.withColumn("stem", file_stem(F.col("path"))), registry))

    named = broadcast_if_small(
        sources.select("path", F.col("station").alias("_name"), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"))
    )
    table = read_alias_csv(spark, sources.filter("layout = 'tabular'").select("path", "size", "header"), aliases, loose)
    numbers = [n for n in aliases if n not in (station, time, "latitude", "longitude")]
    merged = conform(
        table.join(named, "path").select(
            F.trim(F.coalesce(quoted(station), F.col("_name"))).alias(station),
            to_utc_naive(quoted(time)).alias(time),
            *[to_number(quoted(n)).alias(n) for n in numbers],
            F.coalesce(to_number(F.col("latitude")), F.col("_lat")).alias("latitude"),
            F.coalesce(to_number(F.col("longitude")), F.col("_lon")).alias("longitude"),
        ),
        schema,
    )
    grids = [plain_path(r["path"]) for r in sources.filter("layout = 'monthly_grid'").select("path").collect()]
    if grids:
        grid = read_month_grid(read_lines(spark, grids, pattern), value_col).join(named, "path").select(
            F.col("_name").alias(station), F.col("timestamp").alias(time), quoted(value_col),
            F.col("_lat").alias("latitude"), F.col("_lon").alias("longitude"),
        )
        merged = conform(grid, schema).unionByName(merged)
    return merged.dropna(subset=[station, time])


def load_series(spark: SparkSession, dirs: Sequence[str], registry: Sequence[tuple] = STATIONS, loose: bool = False,
                pattern: str = "*.csv") -> DataFrame:
    """Unified time series of all files below ``dirs``: grids hold PM2.5, tables any pollutant."""
    return _load(spark, dirs, registry, SERIES_ALIASES, SERIES, "station", "timestamp", "PM2.5", loose, pattern)


def load_master(spark: SparkSession, dirs: Sequence[str], registry: Sequence[tuple] = STATIONS, loose: bool = False,
                pattern: str = "*.csv") -> DataFrame:
    """Historical master table: grids hold AQI, duplicate rows are dropped."""
    out = _load(spark, dirs, registry, MASTER_ALIASES, MASTER, "station_name", "datetime", "AQI", loose, pattern)
    return out.dropDuplicates()


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Real-time long feed as text; a missing file is an error. ``operators.cleaning.clean_feed`` types it."""
    return nullify(spark.read.csv(path, header=True, schema=FEED_RAW, escape='"', enforceSchema=False), FEED_NULL_TOKENS)


def read_reports(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Citizen reports of all files, each by its own header; columns absent from a file hold ``N/A`` in its rows."""
    parts = []
    for (_, whole, header), files in _grouped(spark, file_heads(spark, path, pattern), "header").items():
        rows = _records(spark, files, whole, _column_names(header))
        have = set(rows.columns)
        parts.append(rows.select(*[quoted(c) if c in have else F.lit("N/A").alias(c) for c in REPORT_COLUMNS]))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], REPORTS)


def save(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Overwriting table sink; CSV carries a header."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true").option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def append_reports(reports: DataFrame, path: str) -> None:
    """Adds rows in the columns of the report table; absent ones are written as ``N/A``, others are refused."""
    if unknown := set(reports.columns) - set(REPORT_COLUMNS):
        raise ValueError(f"no columns of a report: {sorted(unknown)}")
    have = set(reports.columns)
    rows = reports.select(*[quoted(c) if c in have else F.lit("N/A").alias(c) for c in REPORT_COLUMNS])
    rows.write.mode("append").option("header", "true").option("escape", '"').csv(path)
