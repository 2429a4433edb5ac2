"""Grids, tiles and support-set rectangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import overlap, snap, upper_left
from ..functions.numeric import Num, col, floor_mod, shuffled, truncated


def place_grid(spark: SparkSession, cell: tuple[int, int], bounds: tuple[int, int, int, int], res: tuple[int, int], seed: tuple[int, int]) -> DataFrame:
    """Cells (cell_id, ul_x, ul_y, lr_x, lr_y) of size ``cell`` = (y, x) over ``bounds`` = (min_x, min_y, max_x, max_y), through the point ``seed``.

    One more cell lies to the left and, for y, above, so that a north-up extent is covered.
    """
    (size_y, size_x), (min_x, min_y, max_x, max_y), (sx, sy) = cell, bounds, seed
    if not (min_x <= sx <= max_x and min_y <= sy <= max_y):
        raise ValueError("the seed point lies outside the bounds")
    left, right = int((sx - min_x) / size_x + 1), int((max_x - sx) / size_x)
    down, up = int((sy - min_y) / size_y), int((max_y - sy) / size_y + 1)
    xs = spark.range(-left, right + 1).select((F.col("id") * size_x + sx).alias("ul_x"))
    ys = spark.range(-down, up + 1).select((F.col("id") * size_y + sy).alias("ul_y"))
    step_x, step_y = size_x * (1 if res[0] > 0 else -1), size_y * (1 if res[1] > 0 else -1)
    cells = xs.crossJoin(ys)
    number = ((F.col("ul_y") - sy) / size_y + down).cast("long") * (left + right + 1) + ((F.col("ul_x") - sx) / size_x + left).cast("long")
    return cells.select(number.alias("cell_id"), "ul_x", "ul_y", (F.col("ul_x") + step_x).alias("lr_x"), (F.col("ul_y") + step_y).alias("lr_y"))


def drawn_apart(n: int, span: Column, cell: str, seed: int) -> Column:
    """Array of ``n`` offsets in [0, span), each value at most once (twice only where ``n`` exceeds the span), drawn by Floyd's
    method and then put in a random order, as that method draws larger values later."""

    def step(taken: Column, k: Column) -> Column:
        last = F.greatest(span - n + k, F.lit(0))
        pick = shuffled(seed, cell, k) % (last + 1)
        return F.concat(taken, F.array(F.when(F.array_contains(taken, pick), last).otherwise(pick)))

    drawn = F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), F.array().cast("array<bigint>"), step)
    keyed = F.transform(drawn, lambda v: F.struct(shuffled(seed, v, cell).alias("k"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda x: x["v"])


def sets_in_cells(cells: DataFrame, n: int, size: tuple[int, int], res: tuple[int, int], origin: tuple[int, int], seed: int = 1) -> DataFrame:
    """``n`` support sets of ``size`` = (y, x) around random lattice points of each cell: set_id, cell_id, corners and centre.

    The x of a cell's centres are drawn without replacement, and so are the y, each axis by itself.
    """
    span = lambda low, high: F.greatest(F.abs(F.col(high) - F.col(low)), F.lit(1)).cast("long")
    drawn = cells.withColumn("_x", drawn_apart(n, span("ul_x", "lr_x"), "cell_id", 2 * seed)).withColumn("_y", drawn_apart(n, span("ul_y", "lr_y"), "cell_id", 2 * seed + 1))
    k = drawn.select("*", F.posexplode(F.arrays_zip("_x", "_y")).alias("k", "_c"))

    def axis(low: Column, high: Column, r: int, o: int, offset: Column) -> Column:
        return truncated((F.least(low, high) + offset) / r) * r - floor_mod(F.lit(o), r)

    def corner(c: Column, length: int, r: int, end: int) -> Column:
        sign = (1 if r > 0 else -1) * end
        half = length / 2
        rest = half % abs(r)
        return F.round(c + (half + (-rest if end > 0 else rest)) * sign).cast("long")

    k = k.withColumn("ctr_x", axis(F.col("ul_x"), F.col("lr_x"), res[0], origin[0], F.col("_c._x"))).withColumn("ctr_y", axis(F.col("ul_y"), F.col("lr_y"), res[1], origin[1], F.col("_c._y")))
    x, y = F.col("ctr_x"), F.col("ctr_y")
    return k.select(
        (F.col("cell_id") * n + F.col("k")).alias("set_id"), "cell_id",
        corner(x, size[1], res[0], -1).alias("ul_x"), corner(y, size[0], res[1], -1).alias("ul_y"),
        corner(x, size[1], res[0], 1).alias("lr_x"), corner(y, size[0], res[1], 1).alias("lr_y"), "ctr_x", "ctr_y",
    )


def whole_size(size: int, res: int) -> int:
    """A support size cut to whole pixels."""
    return int(size / abs(res)) * abs(res)


def row_col(df: DataFrame, ul_x: Num, ul_y: Num, x_res: Num, y_res: Num) -> DataFrame:
    return df.withColumn("row", truncated((col("y") - col(ul_y)) / col(y_res)).cast("int")).withColumn("col", truncated((col("x") - col(ul_x)) / col(x_res)).cast("int"))


def x_y(df: DataFrame, ul_x: Num, ul_y: Num, x_res: Num, y_res: Num, row: str = "row", column: str = "col") -> DataFrame:
    return df.withColumn("x", truncated(col(ul_x) + col(column) * col(x_res))).withColumn("y", truncated(col(ul_y) + col(row) * col(y_res)))


def tiles(spark: SparkSession, n_tiles: tuple[int, int], rows: int, cols: int) -> DataFrame:
    """(tile_id, ul_r, lr_r, ul_c, lr_c) of a tiling whose last row and column reach the edge."""
    ny, nx = n_tiles
    h, w = rows // ny, cols // nx
    r = spark.range(ny).select(F.col("id").cast("int").alias("i")).crossJoin(spark.range(nx).select(F.col("id").cast("int").alias("j")))
    return r.select(
        (F.col("i") * nx + F.col("j")).alias("tile_id"), (F.col("i") * h).alias("ul_r"), F.when(F.col("i") == ny - 1, rows).otherwise((F.col("i") + 1) * h).alias("lr_r"),
        (F.col("j") * w).alias("ul_c"), F.when(F.col("j") == nx - 1, cols).otherwise((F.col("j") + 1) * w).alias("lr_c"),
    )


def tile_of(row: Num, column: Num, n_tiles: tuple[Num, Num], rows: Num, cols: Num) -> Column:
    """The tile of a pixel in that tiling, by arithmetic instead of a join."""
    ny, nx = map(col, n_tiles)
    i = F.least(F.floor(col(row) / F.floor(col(rows) / ny)), ny - 1)
    j = F.least(F.floor(col(column) / F.floor(col(cols) / nx)), nx - 1)
    return (i * nx + j).cast("int")


def tiling_of_count(n: int, rows: int, cols: int) -> tuple[int, int]:
    """A (rows, columns) split into about ``n`` tiles of the raster's shape."""
    ny = max(1, int((n / (cols / rows)) ** 0.5))
    return ny, max(1, n // ny)


def vector_transform(features: DataFrame, res: tuple[int, int], corners: tuple[str, str, str, str], to: tuple[int, int] | None = None) -> DataFrame:
    """(ul_x, x_res, ul_y, y_res, xsize, ysize) of the raster that would cover a vector layer, on the lattice of ``to`` if given."""
    x1, y1, x2, y2 = (F.col(c) for c in corners)
    b = features.agg(F.min(F.least(x1, x2)).alias("lx"), F.max(F.greatest(x1, x2)).alias("hx"), F.min(F.least(y1, y2)).alias("ly"), F.max(F.greatest(y1, y2)).alias("hy"))
    x, y = upper_left("lx", "hx", res[0]), upper_left("ly", "hy", res[1])
    if to is not None:
        x, y = snap(x, to[0], res[0]), snap(y, to[1], res[1])
    count = lambda low, high, r: F.ceil((F.col(high) - F.col(low)) / abs(r))
    return b.select(x.cast("long").alias("ul_x"), F.lit(res[0]).alias("x_res"), y.cast("long").alias("ul_y"), F.lit(res[1]).alias("y_res"), count("lx", "hx", res[0]).alias("xsize"), count("ly", "hy", res[1]).alias("ysize"))


def offset(ul_1: tuple[Num, Num], ul_2: tuple[Num, Num], res: tuple[Num, Num]) -> tuple[Column, Column]:
    """Rows and columns from one corner to another, truncated toward zero; corners are (x, y)."""
    return truncated((col(ul_2[1]) - col(ul_1[1])) / col(res[1])).cast("int"), truncated((col(ul_2[0]) - col(ul_1[0])) / col(res[0])).cast("int")


def least_type(df: DataFrame, value: str) -> DataFrame:
    """The smallest numeric type that holds every value: one row (low, high, type)."""
    got = df.agg(F.min(value).alias("low"), F.max(value).alias("high"), F.max((F.col(value) != F.floor(value)).cast("int")).alias("broken"))
    kind = F.when(F.col("broken") == 1, "float32")
    for name, low, high in (("uint8", 0, 255), ("int8", -128, 127), ("uint16", 0, 65535), ("int16", -32768, 32767), ("uint32", 0, 4294967295), ("int32", -2147483648, 2147483647)):
        kind = kind.when((F.col("low") >= low) & (F.col("high") <= high), name)
    return got.select("low", "high", kind.otherwise("float32").alias("type"))


#: Names of raster types and the Spark types that hold them.
SPARK_TYPES = {"uint8": "smallint", "int8": "tinyint", "uint16": "int", "int16": "smallint", "uint32": "bigint", "int32": "int", "int64": "bigint", "float16": "float", "float32": "float", "float64": "double"}

__all__ = ["SPARK_TYPES", "least_type", "overlap", "place_grid", "row_col", "sets_in_cells", "snap", "tile_of", "tiles", "tiling_of_count", "whole_size", "x_y"]
