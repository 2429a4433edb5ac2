"""Geometry in column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import Num, col, floor_mod

Ring = list[tuple[float, float]]


def inside(x: Num, y: Num, ring: Ring) -> Column:
    """Point in polygon by ray casting over literal vertices; a vertex or a boundary point counts as inside."""
    x, y = col(x), col(y)
    edges = list(zip(ring, ring[1:] + ring[:1], strict=True))
    on = reduce(lambda a, b: a | b, [
        ((x - x1) * (y2 - y1) == (y - y1) * (x2 - x1)) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)) for (x1, y1), (x2, y2) in edges
    ])
    crossings = [F.when(((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / float(y2 - y1) + x1), 1).otherwise(0) for (x1, y1), (x2, y2) in edges if y1 != y2]
    return on | (reduce(lambda a, b: a + b, crossings) % 2 == 1)


def inside_array(x: Num, y: Num, ring: Num) -> Column:
    """The same for a column of ``array<struct<x, y>>``."""
    x, y, ring = col(x), col(y), col(ring)
    edges = F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    on = F.exists(edges, lambda e: ((x - e["a"]["x"]) * (e["b"]["y"] - e["a"]["y"]) == (y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"])) & x.between(F.least(e["a"]["x"], e["b"]["x"]), F.greatest(e["a"]["x"], e["b"]["x"])) & y.between(F.least(e["a"]["y"], e["b"]["y"]), F.greatest(e["a"]["y"], e["b"]["y"])))
    hit = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])
    return on | (F.size(F.filter(edges, hit)) % 2 == 1)


def snap(coord: Num, to: Num, res: Num) -> Column:
    """``coord`` moved onto the lattice of ``to`` with step ``res``."""
    return col(coord) + floor_mod(to, res) - floor_mod(coord, res)


def upper_left(low: Num, high: Num, res: Num) -> Column:
    """The end of an axis at which a raster of step ``res`` begins."""
    return F.when(col(res) > 0, F.least(col(low), col(high))).otherwise(F.greatest(col(low), col(high)))


def overlap(lo1: Num, hi1: Num, lo2: Num, hi2: Num) -> Column:
    """Length that two intervals share, 0 if they only touch."""
    return F.greatest(F.least(col(hi1), col(hi2)) - F.greatest(col(lo1), col(lo2)), F.lit(0))


def rectangle_wkt(ul_x: Num, ul_y: Num, lr_x: Num, lr_y: Num) -> Column:
    a, b, c, d = (col(v).cast("string") for v in (ul_x, ul_y, lr_x, lr_y))
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *[F.concat_ws(" ", x, y) for x, y in ((a, b), (c, b), (c, d), (a, d), (a, b))]), F.lit("))"))


def wkt_points(wkt: Num) -> Column:
    """Vertices of a WKT text, in order, as ``array<struct<x, y>>``."""
    pairs = F.regexp_extract_all(col(wkt), F.lit(r"(-?[0-9.]+\s+-?[0-9.]+)"), F.lit(1))
    return F.transform(pairs, lambda p: F.struct(F.split(p, r"\s+")[0].cast("double").alias("x"), F.split(p, r"\s+")[1].cast("double").alias("y")))
