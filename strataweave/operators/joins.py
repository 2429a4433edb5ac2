"""Range, overlap, polygon and lookup joins.

A join on ranges alone plans as a nested loop. Here rectangles are dealt to the square bins they touch, so that it becomes
an equi-join on bins, which shuffles, spills and splits hot bins, with the exact ranges as its residual condition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import inside_array, overlap
from ..functions.numeric import shuffled


def _bins(low: Column, high: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))


def _boxes(rects: DataFrame, names: Sequence[str], width: float) -> DataFrame:
    x1, y1, x2, y2 = (F.col(n) for n in names)
    return rects.withColumn("_bx", _bins(F.least(x1, x2), F.greatest(x1, x2), width)).withColumn("_by", _bins(F.least(y1, y2), F.greatest(y1, y2), width))


def points_in_rectangles(points: DataFrame, rects: DataFrame, width: float, x: str = "x", y: str = "y", corners: Sequence[str] = ("ul_x", "ul_y", "lr_x", "lr_y"), strict: bool = True) -> DataFrame:
    """Every point with every rectangle around it; with ``strict``, points on an edge are outside. ``width`` is the bins'."""
    p = points.withColumn("_bx", F.floor(F.col(x) / width)).withColumn("_by", F.floor(F.col(y) / width))
    x1, y1, x2, y2 = (F.col(n) for n in corners)
    joined = p.join(_boxes(rects, corners, width), ["_bx", "_by"])
    within = lambda v, a, b: (v > F.least(a, b)) & (v < F.greatest(a, b)) if strict else (v >= F.least(a, b)) & (v <= F.greatest(a, b))
    return joined.filter(within(F.col(x), x1, x2) & within(F.col(y), y1, y2)).drop("_bx", "_by")


def overlapping(a: DataFrame, b: DataFrame, width: float, a_corners: Sequence[str], b_corners: Sequence[str]) -> DataFrame:
    """Pairs of rectangles whose common area is positive, each once, with ``area``; touching edges don't count."""
    joined = _boxes(a, a_corners, width).join(_boxes(b, b_corners, width), ["_bx", "_by"])
    ax1, ay1, ax2, ay2 = (F.col(n) for n in a_corners)
    bx1, by1, bx2, by2 = (F.col(n) for n in b_corners)
    lo, hi = F.least, F.greatest
    w = overlap(lo(ax1, ax2), hi(ax1, ax2), lo(bx1, bx2), hi(bx1, bx2))
    h = overlap(lo(ay1, ay2), hi(ay1, ay2), lo(by1, by2), hi(by1, by2))
    # a pair meets in several bins; the one that holds the corner of the common part reports it
    own = (F.col("_bx") == F.floor(hi(lo(ax1, ax2), lo(bx1, bx2)) / width)) & (F.col("_by") == F.floor(hi(lo(ay1, ay2), lo(by1, by2)) / width))
    return joined.filter(own).withColumn("area", w * h).filter("area > 0").drop("_bx", "_by")


def touching_any(a: DataFrame, b: DataFrame, width: float, key: str, a_corners: Sequence[str], b_corners: Sequence[str]) -> DataFrame:
    """Rows of ``a`` that overlap some row of ``b`` (a spatial semi-join)."""
    return a.join(overlapping(a, b, width, a_corners, b_corners).select(key).distinct(), key, "left_semi")


def points_in_polygons(points: DataFrame, polygons: DataFrame, width: float, ring: str = "ring") -> DataFrame:
    """Every point with every polygon it lies in; boxes of the rings are joined by bins, then rays are cast."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    boxed = polygons.withColumns({"_x1": F.array_min(xs), "_x2": F.array_max(xs), "_y1": F.array_min(ys), "_y2": F.array_max(ys)})
    near = points_in_rectangles(points, boxed, width, corners=("_x1", "_y1", "_x2", "_y2"), strict=False)
    return near.filter(inside_array("x", "y", ring)).drop("_x1", "_x2", "_y1", "_y2")


def lookup(samples: DataFrame, pixels: DataFrame, value: str, name: str, on: Sequence[str] = ("row", "col"), nodata: float | None = None) -> DataFrame:
    """Each sample with the pixel's value as ``name``; without a pixel, or at nodata, null."""
    v = F.col(value) if nodata is None else F.nullif(F.col(value), F.lit(nodata))
    return samples.join(pixels.select(*on, v.alias(name)), list(on), "left")


def extract(samples: DataFrame, pixels: DataFrame, variables: Sequence[str], on: Sequence[str], key: str) -> DataFrame:
    """One column for each variable of a long table (variable, value); known names, so no extra job finds them."""
    long_ = samples.join(pixels, list(on))
    return long_.groupBy(key).pivot("variable", list(variables)).agg(F.first("value"))


def with_nulls_apart(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows without a null in ``columns``, the others)."""
    broken = F.lit(False)
    for c in columns:
        broken = broken | F.col(c).isNull()
    return df.filter(~broken), df.filter(broken)


def snapped(grid: DataFrame, raster: DataFrame, value: str, nodata: float, on: Sequence[str] = ("row", "col"), mask: Column | None = None) -> DataFrame:
    """The raster on another grid: ``nodata`` where it has no value or ``mask`` holds on the grid."""
    joined = grid.join(raster.select(*on, value), list(on), "left")
    v = F.coalesce(F.col(value), F.lit(nodata))
    return joined.withColumn(value, F.when(mask, F.lit(nodata)).otherwise(v) if mask is not None else v)


def mosaicked(tiles: DataFrame, pixels: DataFrame, on: Sequence[str] = ("row", "col")) -> DataFrame:
    """The mosaic of tile rasters: where the tile map has an id, that tile's value."""
    return tiles.join(pixels, ["tile_id", *on])


def split_by_areas(pixels: DataFrame, areas: DataFrame, width: float, keep: str, value: str, nodata: float, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(test pixels inside the areas, all pixels with those set to nodata)."""
    test = points_in_rectangles(pixels.filter(F.col(value) != nodata), areas, width).select(*key, "x", "y", value, keep)
    hit = test.select(*key).distinct().withColumn("_hit", F.lit(True))
    train = pixels.join(hit, list(key), "left").withColumn(value, F.when(F.col("_hit"), F.lit(nodata)).otherwise(F.col(value))).drop("_hit")
    return test, train


def picked_apart(tiles: DataFrame, n: int, least: float, seed: int = 1) -> DataFrame:
    """Tiles picked stratum by stratum, at least one and its share of ``n`` each, none within ``least`` of an earlier pick.

    ``tiles(tile_id, stratum, area, x, y)``. Greedy by nature: one bounded task walks the tiles, a catalogue of a raster's tiles.
    """
    import pandas as pd

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "tile_id"])
        share = pdf.groupby("stratum").area.sum() / pdf.area.sum()
        picks: list = []
        for stratum in sorted(share.index):
            quota = max(1, round(share[stratum] * n))
            for t in pdf[pdf.stratum == stratum].itertuples():
                if quota and all((t.x - p.x) ** 2 + (t.y - p.y) ** 2 > least**2 for p in picks):
                    picks.append(t)
                    quota -= 1
        return pd.DataFrame([(p.tile_id, p.stratum, k % 2) for k, p in enumerate(picks)], columns=["tile_id", "stratum", "half"])

    return tiles.filter("upper(stratum) <> 'WATER'").withColumn("key", shuffled(seed, "tile_id")).groupBy().applyInPandas(walk, "tile_id long, stratum string, half long")


def merged_inventory(inventory: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Scores written into the inventory's rows of the same key; a column's old value stays where there is no new one."""
    new = scores.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in scores.columns if c != key])
    joined = inventory.join(new, key, "left")
    out = [F.coalesce(f"_{c}", c).alias(c) if c in scores.columns and c != key else F.col(c) for c in inventory.columns]
    return joined.select(*out, *[F.col(f"_{c}").alias(c) for c in scores.columns if c not in inventory.columns])


def by_year(frames: DataFrame, observations: DataFrame, key: str = "obs_id", year: str = "yr") -> DataFrame:
    """Yearly predictor tables, stacked, joined to the observations of their year."""
    return observations.join(frames, [key, year])


def first_match(files: DataFrame, pattern: str, without: str | None = None) -> DataFrame:
    """(tile_id, path): of each tile's files whose name fits, the first; files that match ``without`` are left out."""
    fit = files.filter(F.element_at(F.split("path", "/"), -1).rlike(pattern) & (F.element_at(F.split("path", "/"), -2) == F.lpad(F.col("tile_id").cast("string"), 4, "0")))
    if without:
        fit = fit.filter(~F.col("path").rlike(without))
    return fit.groupBy("tile_id").agg(F.min("path").alias("path"))


def empty_tiles(tiles: DataFrame, pixels: DataFrame, tile: str = "tile_id") -> DataFrame:
    """Tiles without a valid pixel."""
    return tiles.join(pixels.select(tile).distinct(), tile, "left_anti")


def with_constants(df: DataFrame, constants: dict[str, float]) -> DataFrame:
    """Constant predictors as columns, in the order of their names."""
    return df.withColumns({k: F.lit(constants[k]) for k in sorted(constants)})


def predictable(df: DataFrame, features: Sequence[str], nodata: float = -9999) -> DataFrame:
    """Rows of which no predictor is missing or nodata."""
    out = df
    for f in features:
        out = out.filter(F.col(f).isNotNull() & (F.col(f) != nodata))
    return out


def tile_lookup(samples: DataFrame, tile_map: DataFrame, on: Sequence[str] = ("row", "col")) -> DataFrame:
    """Each sample with the tile of its pixel, its id padded to four characters; the first row and column belong to no tile."""
    inside = samples.filter((F.col(on[0]) > 0) & (F.col(on[1]) > 0))
    return inside.join(tile_map.select(*on, F.lpad(F.col("tile_id").cast("string"), 4, "0").alias("tile")), list(on))


def complete_tiles(pixels: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Tiles of a long table (tile_id, variable) that hold every variable; the others are skipped."""
    held = pixels.filter(F.col("variable").isin(list(variables))).select("tile_id", "variable").distinct()
    return held.groupBy("tile_id").agg(F.count("*").alias("_n")).filter(F.col("_n") == len(set(variables))).select("tile_id")


def outside(pixels: DataFrame, training: DataFrame, key: Sequence[str], value: str, nodata: float) -> DataFrame:
    """Valid pixels that no training sample stands on."""
    return pixels.filter(F.col(value) != nodata).join(training.select(*key).distinct(), list(key), "left_anti")


def kernel_at(samples: DataFrame, pixels: DataFrame, value: str, offsets: Sequence[tuple[int, int]], stats: dict[str, Column], key: str, on: Sequence[str] = ("row", "col")) -> DataFrame:
    """``stats`` over ``v`` (and ``k``) of the pixels around each sample. A place is looked up once, however many samples share it."""
    kernel = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(j).alias("j")) for k, (i, j) in enumerate(offsets)])
    places = samples.select(*on).distinct().withColumn("_o", F.explode(kernel))
    near = places.select(F.col(on[0]).alias("_r"), F.col(on[1]).alias("_c"), F.col("_o.k").alias("k"), (F.col(on[0]) + F.col("_o.i")).alias(on[0]), (F.col(on[1]) + F.col("_o.j")).alias(on[1]))
    found = near.join(pixels.select(*on, F.col(value).alias("v")), list(on)).groupBy("_r", "_c").agg(*[c.alias(n) for n, c in stats.items()])
    return samples.select(key, *on).join(found.withColumnsRenamed({"_r": on[0], "_c": on[1]}), list(on)).select(key, *stats)


def with_attributes(features: DataFrame, stats: DataFrame, key: str = "fid", copy: bool = True) -> DataFrame:
    """Features with the columns of a table of statistics; without ``copy`` only the key and these."""
    return (features if copy else features.select(key)).join(stats, key, "left")


def attribute_raster(pixels: DataFrame, polygons: DataFrame, width: float, attribute: str, nodata: int, key: Sequence[str]) -> DataFrame:
    """Each pixel with the largest attribute of the polygons it lies in, else nodata."""
    hit = points_in_polygons(pixels, polygons, width).groupBy(*key).agg(F.max(attribute).alias("_a"))
    return pixels.join(hit, list(key), "left").withColumn(attribute, F.coalesce("_a", F.lit(nodata))).drop("_a")


def clipped(predictions: DataFrame, ul: tuple[int, int], size: tuple[int, int], on: Sequence[str] = ("row", "col")) -> DataFrame:
    """Stored predictions of the sets within a tile's rows and columns; the range reaches the scan."""
    row, column = (F.col(c) for c in on)
    return predictions.filter((row >= ul[0]) & (row < ul[0] + size[0]) & (column >= ul[1]) & (column < ul[1] + size[1]))
