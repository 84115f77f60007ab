"""Density clustering on a grid whose cells are so small that all points of a cell are neighbours.

With cell side eps / sqrt(2) any two points of one cell lie within eps. Hence

* a cell with ``min_samples`` points consists of core points, without looking at a single pair;
* all core points of a cell belong to one cluster, so clusters are connected components of *cells* (at most 24
  neighbours each), not of points;
* only points of thinly filled cells, fewer than ``min_samples`` per cell, are compared with points around them.

Whether two filled cells touch is decided on the bounding boxes of their core points, then of ever smaller parts of them,
until the boxes answer or few enough points are left to compare; cells with half of all points never meet pair by pair.
Identical coordinates are collapsed to one weighted point first.

Points carry ``run`` (one clustering each, all in the same jobs), ``pid`` (unique in the run, its order is the input
order), ``x``, ``y`` and the run's ``eps``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zephra.fixed_values import HIDDEN_LABEL, MIN_SAMPLES, MONITORED_LABEL, SWEEPS
from zephra.functions.bands import zone_name
from zephra.functions.geo import degrees_apart
from zephra.functions.text import round_stable
from zephra.operators.components import components
from zephra.operators.fusion import GROUND
from zephra.operators.spatial import nearest_sensor_km
from zephra.scale import cut_lineage, percentiles, ranked

# Two boxes with at most this many core points each are compared point by point.
BOX_POINTS = 64
# Points of one cell are spread over buckets of about this size before thinly filled cells look them up.
SHOWN_NAMES = 1000
PART_NAMES = 1000
BUCKET_POINTS = 4096
_CELL = ["run", "cx", "cy"]
_BOX = ["x_lo", "x_hi", "y_lo", "y_hi"]


def _bounds() -> list[Column]:
    return [F.min("x").alias("x_lo"), F.max("x").alias("x_hi"), F.min("y").alias("y_lo"), F.max("y").alias("y_hi")]


def _around(df: DataFrame) -> DataFrame:
    """Five by five cells around (cx, cy) as (nx, ny)."""
    wide = df.select("*", F.explode(F.sequence(F.col("cx") - 2, F.col("cx") + 2)).alias("nx"))
    return wide.select("*", F.explode(F.sequence(F.col("cy") - 2, F.col("cy") + 2)).alias("ny"))


def _bucket(n: Column) -> Column:
    """Number of buckets of a cell with ``n`` coordinates."""
    return F.ceil(n / F.lit(float(BUCKET_POINTS))).cast("int")


def collapse(points: DataFrame) -> DataFrame:
    """One row per run and coordinate: ``w`` points, the first of them ``first``, and its cell."""
    side = F.col("eps") / F.lit(2.0**0.5 * (1 + 1e-9))
    coords = points.groupBy("run", "eps", "x", "y").agg(F.count(F.lit(1)).alias("w"), F.min("pid").alias("first"))
    return coords.withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)})


def _look_up(thin: DataFrame, targets: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairs of a coordinate of ``thin`` and the coordinates of ``targets`` within eps, itself included.

    ``thin`` holds fewer than ``min_samples`` coordinates per cell, so a target meets a bounded number of them. Filled
    target cells are cut into buckets, and the few coordinates looking at them are repeated per bucket.
    """
    sizes = targets.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("_m"))
    placed = targets.join(sizes, _CELL).select(
        "run", F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("x").alias("qx"), F.col("y").alias("qy"), *columns,
        F.pmod(F.xxhash64("x", "y"), _bucket(F.col("_m"))).cast("int").alias("_b"),
    )
    look = _around(thin.select("run", "eps", "x", "y", "cx", "cy")).join(
        sizes.select("run", F.col("cx").alias("nx"), F.col("cy").alias("ny"), "_m"), ["run", "nx", "ny"]
    )
    look = look.withColumn("_b", F.explode(F.sequence(F.lit(0), _bucket(F.col("_m")) - 1)))
    near = look.join(placed, ["run", "nx", "ny", "_b"])
    return near.filter(degrees_apart(F.col("x"), F.col("y"), F.col("qx"), F.col("qy")) <= F.col("eps"))


def core_flags(coords: DataFrame, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Adds ``core``: at least ``min_samples`` points, itself counted, within eps."""
    weights = coords.groupBy(*_CELL).agg(F.sum("w").alias("_cw"))
    marked = coords.join(weights, _CELL)
    filled = marked.filter(F.col("_cw") >= min_samples)
    thin = marked.filter(F.col("_cw") < min_samples)
    seen = _look_up(thin, coords, ["w"]).groupBy("run", "x", "y").agg(F.sum("w").alias("_seen"))
    thin = thin.join(seen, ["run", "x", "y"]).withColumn("core", F.col("_seen") >= min_samples)
    cols = [*coords.columns, "core"]
    return filled.withColumn("core", F.lit(True)).select(*cols).unionByName(thin.select(*cols))


def _pair_boxes(pairs: DataFrame, boxes: DataFrame, sub: Sequence[str]) -> DataFrame:
    """Attach the boxes of both sides to (run, a*, b*) pairs."""

    def side(p: str) -> DataFrame:
        names = ["cx", "cy", *sub]
        return boxes.select("run", *[F.col(c).alias(p + c) for c in [*names, "n", *_BOX]])

    on = lambda p: ["run", *[p + c for c in ("cx", "cy", *sub)]]
    return pairs.join(side("a_"), on("a_")).join(side("b_"), on("b_"))


def cell_links(cores: DataFrame) -> DataFrame:
    """(run, a_cx, a_cy, b_cx, b_cy): neighbouring cells with core points within eps of each other.

    ``cores`` is a written table of core coordinates.
    """
    pair = ["run", "a_cx", "a_cy", "b_cx", "b_cy"]
    sub = ["sx", "sy"]

    def parts(level: int) -> DataFrame:
        """Core points with their sub-cell on a grid of 4^level by 4^level within the cell."""
        side, n = F.col("eps") / F.lit(2.0**0.5 * (1 + 1e-9)), F.lit(4.0**level)

        def at(c: str, cell: str) -> Column:
            inside = F.floor((F.col(c) - F.col(cell) * side) / side * n)
            return F.greatest(F.lit(0.0), F.least(n - 1, inside)).cast("long")

        return cores.withColumns({"sx": at("x", "cx"), "sy": at("y", "cy")})

    part = parts(0)
    nodes = cores.select(*_CELL, "eps").distinct()
    pairs = (
        _around(nodes)
        .filter((F.col("nx") > F.col("cx")) | ((F.col("nx") == F.col("cx")) & (F.col("ny") > F.col("cy"))))
        .select("run", "eps", F.col("cx").alias("a_cx"), F.col("cy").alias("a_cy"), F.col("nx").alias("b_cx"), F.col("ny").alias("b_cy"))
        .withColumns({f"{p}_{s}": F.lit(0).cast("long") for p in "ab" for s in sub})
    )
    boxes = part.groupBy(*_CELL, *sub).agg(F.count(F.lit(1)).alias("n"), *_bounds())
    links = None
    level = 0
    while True:
        here = _pair_boxes(pairs, boxes, sub)
        gap = {
            a: F.greatest(F.lit(0.0), F.col(f"a_{a}_lo") - F.col(f"b_{a}_hi"), F.col(f"b_{a}_lo") - F.col(f"a_{a}_hi"))
            for a in "xy"
        }
        reach = {
            a: F.greatest(F.col(f"a_{a}_hi") - F.col(f"b_{a}_lo"), F.col(f"b_{a}_hi") - F.col(f"a_{a}_lo")) for a in "xy"
        }
        nearest = F.sqrt(gap["x"] * gap["x"] + gap["y"] * gap["y"])
        farthest = F.sqrt(reach["x"] * reach["x"] + reach["y"] * reach["y"])
        here = here.filter(nearest <= F.col("eps") * (1 + 1e-9)).withColumn("_sure", farthest <= F.col("eps") * (1 - 1e-9))
        sure = here.filter("_sure").select(*pair).distinct()
        open_ = here.filter("NOT _sure").join(sure, pair, "left_anti")
        crowded = boxes.agg(F.max("n")).first()[0] or 0
        small = (F.col("a_n") <= BOX_POINTS) & (F.col("b_n") <= BOX_POINTS)
        few = open_.filter(small)
        at = ["cx", "cy", *sub]
        left = part.select("run", *[F.col(c).alias(f"a_{c}") for c in at], F.col("x").alias("ax"), F.col("y").alias("ay"))
        right = part.select("run", *[F.col(c).alias(f"b_{c}") for c in at], F.col("x").alias("bx"), F.col("y").alias("by"))
        direct = few.select("eps", *pair, *[f"{p}_{s}" for p in "ab" for s in sub])
        direct = direct.join(left, ["run", *[f"a_{c}" for c in at]]).join(right, ["run", *[f"b_{c}" for c in at]])
        direct = direct.filter(degrees_apart(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) <= F.col("eps"))
        found = sure.unionByName(direct.select(*pair).distinct())
        links = found if links is None else links.unionByName(found)
        if crowded <= BOX_POINTS:
            return links.distinct()
        # Next level: both boxes of an open pair split into 4 x 4 parts.
        level += 1
        links = cut_lineage(links.distinct())
        larger = open_.filter(~small).select("eps", *pair, *[F.col(f"{p}_{s}").alias(f"{p}_p{s}") for p in "ab" for s in sub])
        larger = larger.join(links, pair, "left_anti")
        part = parts(level)
        boxes = part.groupBy(*_CELL, *sub).agg(F.count(F.lit(1)).alias("n"), *_bounds())
        boxes = cut_lineage(boxes)
        kids = boxes.select(*_CELL, *sub, F.floor(F.col("sx") / 4).alias("psx"), F.floor(F.col("sy") / 4).alias("psy"))
        for p in "ab":
            kid = kids.select("run", *[F.col(c).alias(f"{p}_{c}") for c in ("cx", "cy", "psx", "psy", "sx", "sy")])
            larger = larger.join(kid, ["run", *[f"{p}_{c}" for c in ("cx", "cy", "psx", "psy")]])
        pairs = cut_lineage(larger.select("eps", *pair, *[f"{p}_{s}" for p in "ab" for s in sub]))
        if pairs.isEmpty():
            return links


def cluster_coords(points: DataFrame, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """(run, x, y, cluster) per coordinate: numbered from 0 by first core point within the run, -1 for noise."""
    coords = cut_lineage(core_flags(cut_lineage(collapse(points)), min_samples))
    cores = coords.filter("core")
    # A cell is named by its first core point; the smallest name of a component is the cluster's first core point.
    nodes = cores.groupBy(*_CELL).agg(F.min("first").alias("node"))
    links = cell_links(cores)
    for p in "ab":
        end = nodes.select("run", F.col("cx").alias(f"{p}_cx"), F.col("cy").alias(f"{p}_cy"), F.col("node").alias(p))
        links = links.join(end, ["run", f"{p}_cx", f"{p}_cy"])
    merged = components(links.select("run", F.col("a").alias("u"), F.col("b").alias("v")))
    labelled = nodes.join(merged.withColumnRenamed("u", "node"), ["run", "node"], "left")
    labelled = labelled.select(*_CELL, F.coalesce("label", "node").alias("label"))
    numbers = ranked(labelled.select("run", "label").distinct(), ["run"], ["label"], "_no")
    numbered = labelled.join(numbers, ["run", "label"]).select(*_CELL, (F.col("_no") - 1).cast("int").alias("cluster"))
    # All core points of a cell share its cluster; the others take the lowest number within reach.
    inside = cores.join(numbered, _CELL)
    rest = coords.filter("NOT core")
    reach = _look_up(rest, inside, ["cluster"]).groupBy("run", "x", "y").agg(F.min("cluster").alias("cluster"))
    border = rest.select("run", "x", "y").join(reach, ["run", "x", "y"], "left")
    border = border.select("run", "x", "y", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    return inside.select("run", "x", "y", "cluster").unionByName(border)


def dbscan(points: DataFrame, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """``points`` with their ``cluster``; a point without a full coordinate has no neighbour and is noise."""
    placed = F.col("x").isNotNull() & F.col("y").isNotNull()
    found = points.filter(placed).join(cluster_coords(points.filter(placed), min_samples), ["run", "x", "y"])
    rest = points.filter(~placed).withColumn("cluster", F.lit(-1))
    return found.unionByName(rest.select(*found.columns))


# --- station sweeps -------------------------------------------------------------------------------------------------


def severity_cutoffs(severity: DataFrame) -> DataFrame:
    """One row with the 60th and 40th percentile of the severity."""
    return percentiles(severity, "severity", {"p60": 0.60, "p40": 0.40})


def sweep(severity: DataFrame, configs: Sequence[tuple] = SWEEPS, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Candidates of every configuration with their cluster; all configurations run in the same jobs.

    ``severity`` has pos, station, latitude, longitude, severity.
    """
    severity = cut_lineage(severity)
    cut = severity_cutoffs(severity).first()
    runs = F.array(
        *[
            F.struct(F.lit(label).alias("run"), F.lit(pct).alias("sev_pct"), F.lit(float(eps)).alias("eps"),
                     F.lit(cut[f"p{pct}"]).alias("cutoff"))
            for label, pct, eps in configs
        ]
    )
    rows = severity.withColumn("_r", F.explode(runs)).select(
        *severity.columns, "_r.run", "_r.sev_pct", "_r.eps", "_r.cutoff"
    )
    rows = rows.filter(F.col("severity") >= F.col("cutoff"))
    points = rows.withColumns({"pid": F.col("pos"), "x": F.col("latitude"), "y": F.col("longitude")})
    return cut_lineage(dbscan(points, min_samples).drop("pid", "x", "y"))


def sweep_results(swept: DataFrame) -> DataFrame:
    """(run, sev_pct, cutoff, eps, candidates, clusters, noise) per configuration."""
    per = swept.groupBy("run").agg(
        F.max("sev_pct").alias("sev_pct"),
        F.max("cutoff").alias("cutoff"),
        F.max("eps").alias("eps"),
        F.count(F.lit(1)).alias("candidates"),
        F.max("cluster").alias("_top"),
        F.sum((F.col("cluster") == -1).cast("long")).alias("noise"),
    )
    return per.select("run", "sev_pct", "cutoff", "eps", "candidates", (F.col("_top") + 1).cast("long").alias("clusters"), "noise")


def choose_sweep(results: DataFrame) -> DataFrame:
    """The row with most clusters, then smallest eps, then first label."""
    order = F.struct(-F.col("clusters"), F.col("eps"), F.col("run"))
    return results.agg(F.min_by(F.struct(*results.columns), order).alias("_b")).select("_b.*")


def label_candidates(stations: DataFrame, labelled: DataFrame) -> DataFrame:
    """All stations with their cluster; -2 marks stations that were no candidates."""
    found = labelled.select("station", F.col("cluster").alias("_c"))
    return stations.join(found, "station", "left").withColumn("cluster", F.coalesce("_c", F.lit(-2))).drop("_c")


def cluster_summary(labelled: DataFrame) -> DataFrame:
    """Per cluster: severity-weighted centre and means. ``labelled`` has one row per station."""
    sev = F.col("severity")
    out = labelled.filter(F.col("cluster") >= 0).groupBy("cluster").agg(
        F.try_divide(F.sum(F.col("latitude") * sev), F.sum(sev)).alias("center_latitude"),
        F.try_divide(F.sum(F.col("longitude") * sev), F.sum(sev)).alias("center_longitude"),
        F.avg(sev).alias("avg_severity"), F.avg("pm25").alias("avg_pm25"), F.avg("pm10").alias("avg_pm10"),
        F.count(F.lit(1)).alias("station_count"),
    )
    return out.select(
        F.col("cluster").alias("cluster_id"),
        *[round_stable(F.col(c), 6).alias(c) for c in ("center_latitude", "center_longitude")],
        *[round_stable(F.col(c), 4).alias(c) for c in ("avg_severity", "avg_pm25", "avg_pm10")],
        "station_count",
    )


def cluster_members(labelled: DataFrame) -> DataFrame:
    """(cluster_id, number, station, ward_name): the stations of every cluster, numbered in their order."""
    members = labelled.filter(F.col("cluster") >= 0).select("cluster", "pos", "station", "ward_name")
    placed = ranked(members, ["cluster"], ["pos"], "_n")
    return placed.select(F.col("cluster").alias("cluster_id"), F.col("_n").cast("long").alias("number"), "station", "ward_name")


def member_lines(members: DataFrame) -> DataFrame:
    """(cluster_id, number, line): the member table as numbered lines of text."""
    return members.select("cluster_id", "number", F.format_string("%d. %s (%s)", "number", "station", F.coalesce("ward_name", F.lit("Unknown"))).alias("line"))


def name_lists(labelled: DataFrame, shown: int | None = SHOWN_NAMES) -> DataFrame:
    """(cluster_id, ward_count, wards, stations), one row per cluster whatever its size.

    Names come in station order, wards without repetition. Beyond the first ``shown`` a text says how many follow; the
    member table has them all. With None the texts have every name; parts of ``PART_NAMES`` are joined before they meet in
    the row of their cluster.
    """
    members = labelled.filter(F.col("cluster") >= 0)

    def listed(rows: DataFrame, column: str, sep: str) -> DataFrame:
        placed = ranked(rows.filter(F.col(column).isNotNull()), ["cluster"], ["pos"], "_n")
        name = F.struct("_n", column)
        few = name if shown is None else F.when(F.col("_n") <= shown, name)
        part = F.floor((F.col("_n") - 1) / PART_NAMES).alias("_p")
        parts = placed.groupBy("cluster", part).agg(F.sort_array(F.collect_list(few)).alias("_l"), F.count(F.lit(1)).alias("_c"))
        text = F.array_join(F.transform("_l", lambda e: e[column]), sep).alias("_t")
        lists = parts.groupBy("cluster").agg(
            F.sort_array(F.collect_list(F.when(F.size("_l") > 0, F.struct("_p", text)))).alias("_l"), F.sum("_c").alias(f"_{column}s")
        )
        names = F.array_join(F.transform("_l", lambda e: e["_t"]), sep)
        if shown is not None:
            more = F.col(f"_{column}s") - shown
            names = F.when(more > 0, F.concat(names, F.format_string(f"{sep}and %d more", more))).otherwise(names)
        return lists.select("cluster", names.alias(f"{column}s"), f"_{column}s")

    stations = listed(members.select("cluster", "pos", "station"), "station", "; ")
    wards = members.groupBy("cluster", F.col("ward_name").alias("ward")).agg(F.min("pos").alias("pos"))
    both = stations.join(listed(wards, "ward", ", "), "cluster", "left")
    return both.select(F.col("cluster").alias("cluster_id"), F.coalesce("_wards", F.lit(0)).cast("long").alias("ward_count"), "wards", "stations")


def hotspot_clusters(labelled: DataFrame, shown: int | None = SHOWN_NAMES) -> DataFrame:
    """The hotspot table: one row per cluster, summary and names."""
    return cluster_summary(labelled).join(name_lists(labelled, shown), "cluster_id")


def ranked_clusters(clusters: DataFrame) -> DataFrame:
    return clusters.orderBy(F.col("avg_severity").desc(), "cluster_id")


# --- multimodal hotspots --------------------------------------------------------------------------------------------


def cluster_points(points: DataFrame, eps_km: float, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Multimodal points with their cluster."""
    rows = points.withColumns(
        {"run": F.lit("all"), "eps": F.lit(eps_km / 111.0), "pid": F.col("point_id"), "x": F.col("lat"), "y": F.col("lon")}
    )
    return dbscan(rows, min_samples).drop("run", "eps", "pid", "x", "y")


def hotspot_summary(labelled: DataFrame, sensors: DataFrame) -> DataFrame:
    """Per cluster: centre, size, weight, sources by first appearance, distance to the nearest of all sensors, status."""
    # Sources are three at most, so the second step gathers three rows per cluster.
    per_source = labelled.filter(F.col("cluster") >= 0).groupBy("cluster", "source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("lat").alias("lat"), F.sum("lon").alias("lon"), F.sum("weight").alias("weight"),
        F.min("point_id").alias("seen"),
    )
    n = F.sum("n")
    centre = per_source.groupBy("cluster").agg(
        n.alias("point_count"), (F.sum("lat") / n).alias("lat"), (F.sum("lon") / n).alias("lon"),
        (F.sum("weight") / n).alias("weight"),
        F.transform(F.sort_array(F.collect_list(F.struct("seen", "source"))), lambda e: e["source"]).alias("sources"),
    )
    out = nearest_sensor_km(cut_lineage(centre), sensors)
    hidden = ~F.array_contains("sources", GROUND) & (F.col("nearest_km") > 2.0)
    return out.select(
        (F.col("cluster") + 1).alias("cluster_id"),
        round_stable(F.col("lat"), 5).alias("center_lat"),
        round_stable(F.col("lon"), 5).alias("center_lon"),
        "point_count",
        round_stable(F.col("weight") * 100, 1).alias("avg_severity"),
        zone_name(F.col("lat"), F.col("lon")).alias("ward_name"),
        hidden.alias("is_hidden_hotspot"),
        F.when(hidden, HIDDEN_LABEL).otherwise(MONITORED_LABEL).alias("status_label"),
        round_stable(F.col("nearest_km"), 2).alias("min_sensor_dist_km"),
        F.array_join("sources", ", ").alias("sources"),
    )
