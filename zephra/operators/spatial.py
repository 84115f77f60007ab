"""Spatial joins without cross joins: wards by a cover of cells, nearest neighbours by descending a cell pyramid.

Descent: items are counted in square cells, each depth splitting a cell into 4 x 4. A point first follows the one path of
nearest cells down to some items, whose distance bounds the answer; then it goes down through all cells within that bound
until a cell holds few items. Per depth that is one equi-join on the cell; the work per point grows with the depth, not
with the number of items, whether they are spread out or crowded into one place. Cells and items that are few, as they are at
the upper depths, are broadcast, so that no cell gathers its points in one task; points are dealt over tasks by their number,
as each meets 16 cells a depth.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zephra.functions.geo import deg_to_km, degrees_apart, haversine_km, segment_distance, utm_xy
from zephra.operators.cover import Cover, polygon_cover, polygon_of
from zephra.scale import ROWS_PER_TASK, cut_lineage, dealt, has_at_most

CELL_ITEMS = 16
MAX_DEPTH = 12
FEW = 70_000  # cells or items that are broadcast; 16 ** 4 are fewer
_SLACK = 1 + 1e-9
_BOX = ["x_lo", "x_hi", "y_lo", "y_hi"]


def spread_duplicates(df: DataFrame, order: Sequence[str], step: float = 0.003) -> DataFrame:
    """Shifts the n-th marker at the same four-decimal coordinate by ``step`` per marker before it."""
    from zephra.scale import ranked

    keyed = df.withColumns({"_y": F.round("latitude", 4), "_x": F.round("longitude", 4)})
    out = ranked(keyed, ["_y", "_x"], order, "_n")
    return out.withColumn("longitude_shown", F.col("longitude") + (F.col("_n") - 1) * step).drop("_n", "_x", "_y")


# --- wards ----------------------------------------------------------------------------------------------------------


def ward_cover(wards: DataFrame) -> Cover | None:
    return polygon_cover(wards.select("pos", F.explode("edges").alias("e")).select("pos", "e.*"))


def spatial_within(points: DataFrame, wards: DataFrame) -> DataFrame:
    """(longitude, latitude, pos, ward_name) for each distinct coordinate inside a ward; of several the first ward.

    A point on an outline is outside. Coordinates meet the cells of a cover of the wards, not the wards.
    """
    at = ["longitude", "latitude"]
    cover = ward_cover(wards)
    if cover is None:
        return points.select(*at).join(wards.select("pos", "ward_name"), F.lit(False), "inner")
    return polygon_of(points, cover, *at).join(wards.select("pos", "ward_name"), "pos").select(*at, "pos", "ward_name")


def map_wards(points: DataFrame, wards: DataFrame) -> DataFrame:
    """Every point with its ward; points in none get the nearest ward (distance to the polygon in UTM metres)."""
    at = ["longitude", "latitude"]
    inside = spatial_within(points, wards).select(*at, "ward_name")
    joined = cut_lineage(points.join(inside, at, "left").withColumn("inside", F.col("ward_name").isNotNull()))
    outside = nearest_ward(joined.filter(~F.col("inside")), wards).select(*at, F.col("ward_name").alias("_near"))
    return joined.join(outside, at, "left").withColumn("ward_name", F.coalesce("ward_name", "_near")).drop("_near")


# --- nearest --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Plane:
    """Distances in the plane; items are segments (a point is a segment of length 0)."""

    items_are_points = False

    def lower(self, px: Column, py: Column) -> Column:
        dx = F.greatest(F.lit(0.0), F.col("x_lo") - px, px - F.col("x_hi"))
        dy = F.greatest(F.lit(0.0), F.col("y_lo") - py, py - F.col("y_hi"))
        return F.sqrt(dx * dx + dy * dy)

    def upper(self, px: Column, py: Column) -> Column:
        dx = F.greatest(F.abs(px - F.col("x_lo")), F.abs(px - F.col("x_hi")))
        dy = F.greatest(F.abs(py - F.col("y_lo")), F.abs(py - F.col("y_hi")))
        return F.sqrt(dx * dx + dy * dy)

    def exact(self, px: Column, py: Column) -> Column:
        return segment_distance(px, py, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))


@dataclass(frozen=True)
class Points(Plane):
    items_are_points = True

    def exact(self, px: Column, py: Column) -> Column:
        return degrees_apart(px, py, F.col("x1"), F.col("y1"))


@dataclass(frozen=True)
class Sphere:
    """Great-circle kilometres; x is longitude, y latitude. Bounds compare the haversine itself."""

    items_are_points = True

    @staticmethod
    def _sin2(deg: Column) -> Column:
        s = F.sin(F.radians(deg) / 2)
        return s * s

    def _parts(self, px: Column, py: Column) -> tuple[Column, ...]:
        dx_lo = F.greatest(F.lit(0.0), F.col("x_lo") - px, px - F.col("x_hi"))
        dx_hi = F.greatest(F.abs(px - F.col("x_lo")), F.abs(px - F.col("x_hi")))
        dy_lo = F.greatest(F.lit(0.0), F.col("y_lo") - py, py - F.col("y_hi"))
        dy_hi = F.greatest(F.abs(py - F.col("y_lo")), F.abs(py - F.col("y_hi")))
        return dx_lo, dx_hi, dy_lo, dy_hi

    def lower(self, px: Column, py: Column) -> Column:
        dx_lo, dx_hi, dy_lo, _ = self._parts(px, py)
        cos = F.least(F.cos(F.radians("y_lo")), F.cos(F.radians("y_hi")))
        return self._sin2(dy_lo) + F.cos(F.radians(py)) * cos * F.least(self._sin2(dx_lo), self._sin2(dx_hi))

    def upper(self, px: Column, py: Column) -> Column:
        dx_lo, dx_hi, _, dy_hi = self._parts(px, py)
        widest = F.when((dx_lo <= 180) & (dx_hi >= 180), F.lit(1.0)).otherwise(
            F.greatest(self._sin2(dx_lo), self._sin2(dx_hi))
        )
        return self._sin2(dy_hi) + F.cos(F.radians(py)) * widest

    def exact(self, px: Column, py: Column) -> Column:
        return haversine_km(py, px, F.col("y1"), F.col("x1"))


def nearest(
    points: DataFrame, items: DataFrame, metric: Plane | Points | Sphere, payload: Sequence[str], distinct_from_self: bool = False
) -> DataFrame:
    """(px, py, distance, *payload) of the nearest item per distinct point, of equals the lowest ``item_no``.

    ``points`` has px, py; ``items`` has item_no, x1, y1, x2, y2 and the payload columns. With ``distinct_from_self``
    an item at the very coordinate of the point does not count.
    """
    keep = ["item_no", "x1", "y1", "x2", "y2", *payload]
    box = {
        "x_lo": F.least("x1", "x2"), "x_hi": F.greatest("x1", "x2"),
        "y_lo": F.least("y1", "y2"), "y_hi": F.greatest("y1", "y2"),
    }
    items = cut_lineage(items.select(*dict.fromkeys(keep)).withColumns(box))
    mid_x, mid_y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    x0, x1, y0, y1 = items.agg(F.min(mid_x), F.max(mid_x), F.min(mid_y), F.max(mid_y)).first()
    pts = points.select("px", "py").dropna().distinct()
    small = has_at_most(items, FEW)
    if x0 is None:
        none = [F.lit(None).cast(items.schema[c].dataType).alias(c) for c in payload]
        return pts.filter(F.lit(False)).select("px", "py", F.lit(None).cast("double").alias("distance"), *none)
    side = max(x1 - x0, y1 - y0) * _SLACK or 1.0

    def cell(c: Column, origin: float, depth: int | Column) -> Column:
        n = F.pow(F.lit(4.0), F.lit(depth) if isinstance(depth, int) else depth)
        return F.greatest(F.lit(0.0), F.least(n - 1, F.floor((c - origin) / side * n))).cast("long")

    # The depth at which no cell holds more than CELL_ITEMS items, from one aggregate over all depths.
    per_depth = items.select(mid_x.alias("mx"), mid_y.alias("my"), F.explode(F.sequence(F.lit(1), F.lit(MAX_DEPTH))).alias("depth"))
    per_depth = per_depth.groupBy(
        "depth", cell(F.col("mx"), x0, F.col("depth")).alias("ix"), cell(F.col("my"), y0, F.col("depth")).alias("iy")
    ).count()
    fine = per_depth.groupBy("depth").agg(F.max("count").alias("m")).filter(F.col("m") <= CELL_ITEMS)
    depth = fine.agg(F.min("depth")).first()[0] or MAX_DEPTH

    px, py = F.col("px"), F.col("py")
    rest = [c for c in payload if c != "item_no"]

    def level(d: int) -> tuple[DataFrame, DataFrame]:
        """Items with their cell at a depth, and the cells with count and bounds."""
        at = items.withColumns({"ix": cell(mid_x, x0, d), "iy": cell(mid_y, y0, d)})
        bounds = [(F.min if c.endswith("lo") else F.max)(c).alias(c) for c in _BOX]
        cells = at.groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("_n"), *bounds)
        if small:
            return F.broadcast(at), F.broadcast(cells)
        if 16**d > FEW:
            return at, cells
        # Cells that go on below are not looked into here; those of the last depth are, whatever they hold.
        ends = F.broadcast(cells.filter(F.col("_n") <= CELL_ITEMS).select("ix", "iy"))
        within = at if d == depth else at.join(ends, ["ix", "iy"])
        return (F.broadcast(within) if 16 ** (d + 1) <= FEW and (d < depth or depth < MAX_DEPTH) else within), F.broadcast(cells)

    def below(df: DataFrame) -> DataFrame:
        """The 16 cells within each cell."""
        wide = df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(15))))
        return wide.withColumns({"ix": F.col("ix") * 4 + F.col("_i") % 4, "iy": F.col("iy") * 4 + F.floor(F.col("_i") / 4)}).drop("_i")

    def without_self(df: DataFrame, d: int) -> DataFrame:
        """Drops the cell that holds nothing but an item at the point itself."""
        if not distinct_from_self:
            return df
        own = (cell(px, x0, d) == F.col("ix")) & (cell(py, y0, d) == F.col("iy"))
        return df.filter(~(own & (F.col("_n") == 1) & (F.col("x_lo") == px) & (F.col("y_lo") == py)))

    def items_of(df: DataFrame, at: DataFrame) -> DataFrame:
        out = df.join(at, ["ix", "iy"])
        return out.filter((F.col("x1") != px) | (F.col("y1") != py)) if distinct_from_self else out

    pts = cut_lineage(pts)
    n_points = pts.count()
    crowded = depth > 2 or n_points > ROWS_PER_TASK
    root = dealt(pts, n_points).withColumns({"ix": F.lit(0).cast("long"), "iy": F.lit(0).cast("long")})

    # First one path per point, always into the cell with the nearest corner: some item near by, hence a tight bound.
    frontier = root.withColumn("_best", F.lit(float("inf")))
    if depth > 1:
        path, bound = root, None
        for d in range(1, depth + 1):
            at, cells = level(d)
            here = without_self(below(path).join(cells, ["ix", "iy"]), d)
            step = here.groupBy("px", "py").agg(F.min(F.struct(metric.lower(px, py).alias("lo"), "ix", "iy", "_n")).alias("_s"))
            step = step.select("px", "py", "_s.ix", "_s.iy", "_s._n")
            if crowded:
                # Two reads follow; without the write every depth would run again for each one below it.
                step = dealt(cut_lineage(step))
            end = F.lit(d == depth) | (F.col("_n") <= CELL_ITEMS)
            near = items_of(step.filter(end).select("px", "py", "ix", "iy"), at)
            near = near.groupBy("px", "py").agg(F.min(metric.upper(px, py)).alias("_best"))
            bound = near if bound is None else bound.unionByName(near)
            path = step.filter(~end).select("px", "py", "ix", "iy")
        frontier = root.join(bound, ["px", "py"])

    # Then all cells within the bound.
    found = None
    for d in range(1, depth + 1):
        at, cells = level(d)
        wide = below(frontier)
        if metric.items_are_points:
            # Points lie inside their cell, so its outline can rule it out before the join.
            w = side / 4.0**d
            outline = {
                "x_lo": x0 + F.col("ix") * w - w * 1e-6, "x_hi": x0 + (F.col("ix") + 1) * w + w * 1e-6,
                "y_lo": y0 + F.col("iy") * w - w * 1e-6, "y_hi": y0 + (F.col("iy") + 1) * w + w * 1e-6,
            }
            wide = wide.withColumns(outline).filter(metric.lower(px, py) <= F.col("_best") * _SLACK + 1e-12).drop(*_BOX)
        here = without_self(wide.join(cells, ["ix", "iy"]), d)
        here = here.filter(metric.lower(px, py) <= F.col("_best") * _SLACK + 1e-12).select("px", "py", "_best", "ix", "iy", "_n")
        if crowded:
            here = dealt(cut_lineage(here))
        last = F.lit(d == depth) | (F.col("_n") <= CELL_ITEMS)
        leaf = items_of(here.filter(last).select("px", "py", "ix", "iy"), at)
        leaf = leaf.groupBy("px", "py").agg(F.min(F.struct(metric.exact(px, py).alias("distance"), "item_no", *rest)).alias("_f"))
        found = leaf if found is None else found.unionByName(leaf)
        frontier = here.filter(~last).select("px", "py", "_best", "ix", "iy")
    best = found.groupBy("px", "py").agg(F.min("_f").alias("_f"))
    return best.select("px", "py", "_f.distance", *[F.col(f"_f.{c}").alias(c) for c in payload])


def _as_items(stations: DataFrame, x: str = "longitude", y: str = "latitude") -> DataFrame:
    """One item per distinct coordinate: the station with the lowest position."""
    return stations.dropna(subset=[x, y]).groupBy(F.col(x).alias("x1"), F.col(y).alias("y1")).agg(
        F.min("pos").alias("item_no"), F.min_by("station", "pos").alias("station")
    ).withColumns({"x2": F.col("x1"), "y2": F.col("y1")})


def nearest_station(points: DataFrame, stations: DataFrame) -> DataFrame:
    """Adds the nearest station and its distance in km to points (lat, lon)."""
    found = nearest(
        points.select(F.col("lon").alias("px"), F.col("lat").alias("py")), _as_items(stations), Sphere(), ["station"]
    )
    found = found.select(F.col("px").alias("lon"), F.col("py").alias("lat"), F.col("station").alias("nearest_station"),
                         F.col("distance").alias("nearest_km"))
    return points.join(found, ["lon", "lat"], "left")


def nearest_sensor_km(centres: DataFrame, sensors: DataFrame) -> DataFrame:
    """Distance of each centre (lat, lon) to the nearest sensor, 999.0 when there is none."""
    out = nearest_station(centres, sensors).drop("nearest_station")
    return out.withColumn("nearest_km", F.coalesce("nearest_km", F.lit(999.0)))


def nearest_ward(points: DataFrame, wards: DataFrame) -> DataFrame:
    """(longitude, latitude, ward_name, metres) of the ward whose outline is nearest, for points outside all wards."""
    edges = wards.select("pos", "ward_name", F.explode("edges").alias("e"))
    ax, ay = utm_xy(F.col("e.y1"), F.col("e.x1"))
    bx, by = utm_xy(F.col("e.y2"), F.col("e.x2"))
    items = edges.select(
        F.col("pos").alias("item_no"), "ward_name", ax.alias("x1"), ay.alias("y1"), bx.alias("x2"), by.alias("y2")
    )
    ex, ny = utm_xy(F.col("latitude"), F.col("longitude"))
    flat = points.select("longitude", "latitude").distinct().withColumns({"px": ex, "py": ny})
    flat = cut_lineage(flat)
    found = nearest(flat, items, Plane(), ["ward_name"])
    return flat.join(found, ["px", "py"]).select("longitude", "latitude", "ward_name", F.col("distance").alias("metres"))


def self_nn(stations: DataFrame) -> DataFrame:
    """(pos, station, neighbour, km): nearest other station, flat degrees times 111, of equals the first.

    Stations at one coordinate are each other's neighbours at distance 0; only whole coordinates go through the search.
    """
    at = ["longitude", "latitude"]
    shared = stations.groupBy(*at).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("pos", "station")).alias("_first")
    )
    # The second lowest position of a shared coordinate serves its first station.
    rest = stations.join(shared.filter(F.col("_n") > 1).select(*at, F.col("_first.pos").alias("_p")), at)
    second = rest.filter(F.col("pos") != F.col("_p")).groupBy(*at).agg(
        F.min(F.struct("pos", "station")).alias("_second")
    )
    alone = cut_lineage(shared.filter(F.col("_n") == 1).select(F.col("longitude").alias("px"), F.col("latitude").alias("py")))
    found = nearest(alone, _as_items(stations), Points(), ["station"], distinct_from_self=True).select(
        F.col("px").alias("longitude"), F.col("py").alias("latitude"), "station", "distance"
    ).withColumnRenamed("station", "_near")
    out = stations.join(shared, at).join(second, at, "left").join(found, at, "left")
    same = F.when(F.col("pos") == F.col("_first.pos"), F.col("_second.station")).otherwise(F.col("_first.station"))
    return out.select(
        "pos", "station",
        F.when(F.col("_n") > 1, same).otherwise(F.col("_near")).alias("neighbour"),
        deg_to_km(F.when(F.col("_n") > 1, F.lit(0.0)).otherwise(F.col("distance"))).alias("km"),
    )


def closest_pairs(stations: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` closest unordered pairs by (km, first position, second position).

    The k-th smallest nearest-neighbour distance R bounds the answer, and fewer than 2k coordinates have a neighbour
    closer than R; so pairs within R are few even where stations crowd. Of one coordinate the first k + 1 stations suffice.
    """
    at = ["longitude", "latitude"]
    w = Window.partitionBy(*at).orderBy("pos")
    firsts = cut_lineage(
        stations.select("pos", "station", *at).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k + 1)
    )
    spots = firsts.filter(F.col("_rn") == 1).select(F.col("longitude").alias("px"), F.col("latitude").alias("py"), "pos")
    near = nearest(spots, _as_items(firsts), Points(), ["item_no"], distinct_from_self=True)
    near = cut_lineage(spots.join(near, ["px", "py"]))
    left = firsts.select(F.col("pos").alias("i"), F.col("station").alias("station_a"), *at)
    right = firsts.select(F.col("pos").alias("j"), F.col("station").alias("station_b"), *at)
    zero = left.join(right, at).filter(F.col("i") < F.col("j")).select("i", "j", "station_a", "station_b", F.lit(0.0).alias("d"))
    nn_pairs = near.select(
        F.least("pos", "item_no").alias("i"), F.greatest("pos", "item_no").alias("j"), F.col("distance").alias("d")
    ).distinct()
    bound = zero.select("i", "j", "d").unionByName(nn_pairs).orderBy("d").limit(k).agg(F.max("d"), F.count("d")).first()
    if bound[1] == 0:
        pairs = zero
    else:
        if bound[1] < k:  # fewer than k neighbour pairs: at most 2k coordinates, one cell holds them all
            ends = near.agg(F.max("px") - F.min("px"), F.max("py") - F.min("py")).first()
            radius = (ends[0] or 0.0) + (ends[1] or 0.0)
        else:
            radius = bound[0]
        pairs = zero
        if radius > 0:
            side = radius * _SLACK
            spot = near.filter(F.col("distance") <= radius * _SLACK).select(
                "px", "py", F.floor(F.col("px") / side).alias("cx"), F.floor(F.col("py") / side).alias("cy")
            )
            around = spot.select("px", "py", "cy", F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1)).alias("cx"))
            around = around.select("px", "py", "cx", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1)).alias("cy"))
            other = spot.select(F.col("px").alias("qx"), F.col("py").alias("qy"), "cx", "cy")
            d = degrees_apart(F.col("px"), F.col("py"), F.col("qx"), F.col("qy"))
            close = around.join(other, ["cx", "cy"]).withColumn("d", d)
            close = close.filter((F.col("d") > 0) & (F.col("d") <= radius * _SLACK))
            a = left.select("i", "station_a", F.col("longitude").alias("px"), F.col("latitude").alias("py"))
            b = right.select("j", "station_b", F.col("longitude").alias("qx"), F.col("latitude").alias("qy"))
            apart = close.join(a, ["px", "py"]).join(b, ["qx", "qy"]).filter(F.col("i") < F.col("j"))
            pairs = pairs.unionByName(apart.select("i", "j", "station_a", "station_b", "d"))
    return pairs.orderBy("d", "i", "j").limit(k).select("i", "j", "station_a", "station_b", deg_to_km(F.col("d")).alias("km"))
