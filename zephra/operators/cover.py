"""Polygon cover: a pyramid of cells in which a point meets a bounded number of edges, whatever the size of the polygons.

The square around all polygons is split 4 x 4 wherever more than ``CELL_EDGES`` edges (of all polygons together) meet a cell.
A cell keeps, per polygon, the edges that meet it and whether its lower left corner lies inside. A point of the cell is
inside if that corner is, changed by every edge on the way from the corner to the point: first along the row, then along the
column. The same count gives the corners of the cells below. Cells that no edge of a polygon meets are whole: outside, and
left out, or inside, and kept without edges at the depth where that is first known.

The number of kept cells follows that of the edges and of the cells on the outlines, not the area inside. Corners lie off
round coordinates, so no outline runs through them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephra.scale import broadcast_if_small, cut_lineage

CELL_EDGES = 256
MAX_DEPTH = 12
_EDGE = ["x1", "y1", "x2", "y2"]
_CELL = ["depth", "ix", "iy"]


@dataclass(frozen=True)
class Cover:
    """Cells of a set of polygons: ``whole`` (cell, pos), ``border`` (cell, pos, inside, edges); ``depths`` in use."""

    x0: float
    y0: float
    side: float
    whole: DataFrame
    border: DataFrame
    depths: list[int]

    def place(self, c: Column, origin: float, depth: Column) -> Column:
        """Number of the cell of a coordinate; cells of one depth split those of the depth before."""
        finest = F.floor((c - origin) / (self.side / 4.0**MAX_DEPTH)).cast("long")
        return F.floor(finest / F.pow(F.lit(4.0), F.lit(MAX_DEPTH) - depth)).cast("long")


def _side_of(e: Column | None, x: Column, y: Column) -> Column:
    get = (lambda n: F.col(n)) if e is None else (lambda n: e[n])
    return (get("x2") - get("x1")) * (y - get("y1")) - (get("y2") - get("y1")) * (x - get("x1"))


def _passed(e: Column | None, x0: Column, y0: Column, x: Column, y: Column) -> Column:
    """How often (0 to 2) an edge is crossed from (x0, y0) along the row to (x, y0), then along the column to (x, y).

    A point on an edge counts as just right of it, and then just above it.
    """
    x1, y1, x2, y2 = (F.col(n) if e is None else e[n] for n in _EDGE)
    up, ahead = y2 > y1, x2 > x1

    def right(px: Column) -> Column:
        s = _side_of(e, px, y0)
        return F.when(up, s > 0).otherwise(s < 0)

    def above(py: Column) -> Column:
        s = _side_of(e, x, py)
        return F.when(s == 0, (y1 != y2) & (up == ahead)).when(ahead, s < 0).otherwise(s > 0)

    row = ((y1 > y0) != (y2 > y0)) & (right(x0) != right(x))
    column = ((x1 > x) != (x2 > x)) & (above(y0) != above(y))
    return row.cast("int") + column.cast("int")


def _meets(x: Column, y: Column, w: Column) -> Column:
    """Whether an edge meets the square of side ``w`` at (x, y), or comes as near as rounding reaches."""
    pad = w * 1e-9
    boxes = (
        (F.least("x1", "x2") <= x + w + pad) & (F.greatest("x1", "x2") >= x - pad)
        & (F.least("y1", "y2") <= y + w + pad) & (F.greatest("y1", "y2") >= y - pad)
    )
    reach = (F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1"))) * (w / 2 + pad)
    return boxes & (F.abs(_side_of(None, x + w / 2, y + w / 2)) <= reach)


def polygon_cover(edges: DataFrame) -> Cover | None:
    """Cover of all polygons from their edges (pos, x1, y1, x2, y2); None without any edge."""
    rows = edges.select("pos", *_EDGE)
    x_lo, x_hi, y_lo, y_hi, n = rows.agg(
        F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("y1", "y2")), F.count(F.lit(1))
    ).first()
    if not n:
        return None
    extent = max(x_hi - x_lo, y_hi - y_lo) or 1.0
    x0, y0, side = x_lo - extent * 0.0137931, y_lo - extent * 0.0171717, extent * 1.0414213
    zero = F.lit(0).cast("long")
    rows = rows.withColumns({"ix": zero, "iy": zero, "inside": F.lit(False), "n": F.lit(n).cast("long")})
    whole, border, depths = [], [], []

    for depth in range(MAX_DEPTH + 1):
        last = F.lit(depth == MAX_DEPTH) | (F.col("n") <= CELL_EDGES)
        here = rows.filter(last).groupBy("ix", "iy", "pos", "inside").agg(F.collect_list(F.struct(*_EDGE)).alias("edges"))
        border.append(here.withColumn("depth", F.lit(depth)))
        depths.append(depth)
        if depth == MAX_DEPTH or (depth == 0 and n <= CELL_EDGES):
            break
        w = F.lit(side / 4.0 ** (depth + 1))
        x, y = F.lit(x0) + F.col("ix") * w, F.lit(y0) + F.col("iy") * w
        below = rows.filter(~last).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(15))))
        corner = [F.lit(x0) + F.col("ix") * 4 * w, F.lit(y0) + F.col("iy") * 4 * w]
        below = below.withColumns({"cx": F.col("ix") * 4 + F.col("_i") % 4, "cy": F.col("iy") * 4 + F.floor(F.col("_i") / 4)})
        to = [F.lit(x0) + F.col("cx") * w, F.lit(y0) + F.col("cy") * w]
        below = below.select(
            "pos", *_EDGE, F.col("cx").alias("ix"), F.col("cy").alias("iy"), "inside",
            _passed(None, *corner, *to).alias("passed"), _meets(*to, w).alias("meets"),
        )
        cells = below.groupBy("ix", "iy", "pos").agg(
            ((F.max(F.col("inside").cast("int")) + F.sum("passed")) % 2 == 1).alias("inside"), F.sum(F.col("meets").cast("long")).alias("n")
        )
        cells = cut_lineage(cells)
        whole.append(cells.filter("n = 0 and inside").groupBy("ix", "iy").agg(F.min("pos").alias("pos")).withColumn("depth", F.lit(depth + 1)))
        total = cells.filter("n > 0").groupBy("ix", "iy").agg(F.sum("n").alias("n"))
        known = cells.filter("n > 0").select("ix", "iy", "pos", "inside").join(total, ["ix", "iy"])
        rows = below.filter("meets").select("ix", "iy", "pos", *_EDGE).join(known, ["ix", "iy", "pos"])
        if (known.agg(F.max("n")).first()[0] or 0) <= CELL_EDGES:  # the cells below are the last
            here = rows.groupBy("ix", "iy", "pos", "inside").agg(F.collect_list(F.struct(*_EDGE)).alias("edges"))
            border.append(here.withColumn("depth", F.lit(depth + 1)))
            depths.append(depth + 1)
            break
        rows = cut_lineage(rows)

    def united(parts: list[DataFrame], names: list[str]) -> DataFrame:
        out = parts[0].select(*names)
        for p in parts[1:]:
            out = out.unionByName(p.select(*names))
        return out

    edged = united(border, [*_CELL, "pos", "inside", "edges"])
    none = edged.select(*_CELL, "pos").filter(F.lit(False))
    return Cover(x0, y0, side, united([none, *whole], [*_CELL, "pos"]), edged, depths)


def _touches(e: Column, px: Column, py: Column) -> Column:
    within = px.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & py.between(
        F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])
    )
    return (_side_of(e, px, py) == 0) & within


def polygon_of(points: DataFrame, cover: Cover, x: str, y: str) -> DataFrame:
    """(x, y, pos) of the first polygon (least pos) around each distinct point; a point on an outline is outside it."""
    px, py = F.col("_x"), F.col("_y")
    spots = points.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna().distinct()
    end_x, end_y = cover.x0 + cover.side, cover.y0 + cover.side
    spots = spots.filter(px.between(cover.x0, end_x) & py.between(cover.y0, end_y))
    keyed = spots.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in cover.depths])))
    keyed = keyed.withColumns({"ix": cover.place(px, cover.x0, F.col("depth")), "iy": cover.place(py, cover.y0, F.col("depth"))})
    w = F.lit(cover.side) / F.pow(F.lit(4.0), F.col("depth"))
    corner = [F.lit(cover.x0) + F.col("ix") * w, F.lit(cover.y0) + F.col("iy") * w]
    # A cover of one cell has CELL_EDGES rows at most; others are written, measured and read.
    alone = len(cover.depths) == 1
    near = keyed.join(F.broadcast(cover.border) if alone else broadcast_if_small(cut_lineage(cover.border)), _CELL)
    # Through a one-element array the corner is computed once for all edges of the cell.
    at = F.array(F.struct(corner[0].alias("x"), corner[1].alias("y")))
    flips = F.transform(at, lambda c: F.aggregate("edges", F.lit(0), lambda s, e: s + _passed(e, c["x"], c["y"], px, py)))[0]
    hit = (F.col("inside") != (flips % 2 == 1)) & ~F.exists("edges", lambda e: _touches(e, px, py))
    found = near.filter(hit).select("_x", "_y", "pos")
    if not alone:
        found = found.unionByName(keyed.join(broadcast_if_small(cut_lineage(cover.whole)), _CELL).select("_x", "_y", "pos"))
    out = found.groupBy("_x", "_y").agg(F.min("pos").alias("pos"))
    return out.select(px.alias(x), py.alias(y), "pos")
