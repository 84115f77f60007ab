"""Ward polygons: a feature collection to one row per ward with its edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zephra.fixed_values import WARD_NAME_PROPERTIES
from zephra.scale import cut_lineage, ranked
from zephra.sources.schemas import GEOJSON

_FEATURE = '"Feature"'


def ring_edges(ring: Column) -> Column:
    """Ring of [x, y] points to an array of edges; an open ring is closed."""
    n = F.size(ring)
    edges = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(
            F.get(ring, i)[0].alias("x1"),
            F.get(ring, i)[1].alias("y1"),
            F.get(ring, (i + 1) % n)[0].alias("x2"),
            F.get(ring, (i + 1) % n)[1].alias("y2"),
        ),
    )
    return F.filter(edges, lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))


def with_bounds(wards: DataFrame) -> DataFrame:
    """Adds x_lo, x_hi, y_lo, y_hi from the edges."""

    def starts(axis: str) -> Column:
        return F.transform("edges", lambda e: e[f"{axis}1"])

    return wards.select(
        "*",
        F.array_min(starts("x")).alias("x_lo"), F.array_max(starts("x")).alias("x_hi"),
        F.array_min(starts("y")).alias("y_lo"), F.array_max(starts("y")).alias("y_hi"),
    )


def _feature_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame | None:
    """(_at, f) per feature, cut from the text before each is parsed; None where features do not begin with their type.

    The text is split at the word "Feature": a long file is read by many tasks, and what follows the word up to the end of
    the feature is parsed alone, as a JSON reader takes no notice of what comes behind.
    """
    raw = spark.read.text(paths, lineSep=_FEATURE).select(
        F.struct(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("_at"),
        "value",
    )
    opened = F.col("value").rlike(r"\{\s*\"type\"\s*:\s*$")
    odd = raw.filter(~opened).groupBy("_at.path").agg(F.count(F.lit(1)).alias("n"))  # only the end of a file may be so
    if not odd.filter("n > 1").isEmpty():
        return None
    rest = raw.filter(~F.col("value").rlike(r"^[\ufeff\s]*\{"))
    parsed = F.from_json(F.concat(F.lit('{"type":' + _FEATURE), "value"), GEOJSON["features"].dataType.elementType)
    return rest.select("_at", parsed.alias("f"))


def read_features(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(pos, f) of all features in file order; collections in any JSON layout, features of any size."""
    found = _feature_records(spark, paths)
    if found is None:
        whole = spark.read.schema(GEOJSON).json(paths, multiLine=True)
        at = F.struct(F.col("_metadata.file_path").alias("path"), F.lit(0).cast("long").alias("start"), F.col("i").cast("long").alias("line"))
        found = whole.select("_metadata", F.posexplode("features").alias("i", "f")).select(at.alias("_at"), "f")
    flat = found.select(F.col("_at.path").alias("_path"), F.col("_at.start").alias("_start"), F.col("_at.line").alias("_line"), "f")
    return ranked(flat, [], ["_path", "_start", "_line"], "_n").select((F.col("_n") - 1).cast("long").alias("pos"), "f")


def read_wards(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(pos, ward_name, edges, bounds). x is longitude, y latitude.

    The name is the first of the known properties that any feature has, else the feature's number.
    """
    features = cut_lineage(read_features(spark, paths))
    props = F.col("f.properties")
    have = features.agg(
        *[F.max(F.coalesce(F.map_contains_key(props, c), F.lit(False))).alias(f"h{i}")
          for i, c in enumerate(WARD_NAME_PROPERTIES)]
    ).first()
    named = [c for i, c in enumerate(WARD_NAME_PROPERTIES) if have[i]]
    name = F.try_element_at(props, F.lit(named[0])) if named else F.concat(F.lit("Ward_"), F.col("pos") + 1)
    coords = F.col("f.geometry.coordinates")
    rings = F.when(
        F.col("f.geometry.type") == "MultiPolygon",
        F.flatten(F.from_json(coords, "array<array<array<array<double>>>>")),
    ).otherwise(F.from_json(coords, "array<array<array<double>>>"))
    wards = features.select("pos", name.alias("ward_name"), rings.alias("rings"))
    wards = wards.select("pos", "ward_name", F.flatten(F.transform("rings", ring_edges)).alias("edges"))
    return with_bounds(wards)


def feature_text(wards: DataFrame, path: str, name: str = "ward_name") -> None:
    """Writes (pos, name, rings) as one feature collection, in the order of ``pos``, as a single text file below ``path``.

    A ward of several outer rings comes as ``polygons``, an array of arrays of rings.
    """
    multi = "polygons" in wards.columns
    kind = F.when(F.col("polygons").isNotNull(), "MultiPolygon").otherwise("Polygon") if multi else F.lit("Polygon")
    plain = F.to_json("rings")
    coords = F.when(F.col("polygons").isNotNull(), F.to_json("polygons")).otherwise(plain) if multi else plain
    first = wards.agg(F.min("pos")).first()[0]
    text = F.concat(
        F.when(F.col("pos") == first, "").otherwise(","), F.lit('{"type": "Feature", "properties": '), F.to_json(F.struct(F.col(name))),
        F.lit(', "geometry": {"type": "'), kind, F.lit('", "coordinates": '), coords, F.lit("}}"),
    )
    spark = wards.sparkSession
    ends = spark.createDataFrame([(0, '{"type": "FeatureCollection", "features": ['), (2, "]}")], "part int, value string")
    lines = wards.select(F.lit(1).alias("part"), "pos", text.alias("value"))
    lines = lines.unionByName(ends.withColumn("pos", F.lit(None).cast("long")))
    lines.coalesce(1).sortWithinPartitions("part", "pos").select("value").write.text(path)
