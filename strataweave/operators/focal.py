"""Neighbourhood operators.

Pixels are dealt once, to square blocks with a halo as wide as the kernel; within a block each is sent to the centres it is
a neighbour of and aggregated there, without another shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def square(size: int) -> list[tuple[int, int]]:
    r = size // 2
    return [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1)]


def circle(diameter: int) -> list[tuple[int, int]]:
    """Offsets within radius floor(diameter / 2)."""
    r = diameter // 2
    return [(i, j) for i, j in square(diameter) if i * i + j * j <= r * r]


def neighbours(pixels: DataFrame, value: str, offsets: Sequence[tuple[int, int]], row: str = "row", column: str = "col", reflect: tuple[Column, Column] | None = None) -> DataFrame:
    """(row, col, k, v): each centre's neighbour k in the kernel's order. With ``reflect`` = (last row, last column), the raster is mirrored at its edges."""
    kernel = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(j).alias("j")) for k, (i, j) in enumerate(offsets)])
    sent = pixels.select(F.col(row).alias("_r"), F.col(column).alias("_c"), F.col(value).alias("v"), F.explode(kernel).alias("o"))
    if reflect is None:
        return sent.select((F.col("_r") - F.col("o.i")).alias(row), (F.col("_c") - F.col("o.j")).alias(column), F.col("o.k").alias("k"), "v")
    # a pixel is also the mirror image beyond an edge: -1 - x before 0, 2 * last + 1 - x after it
    images = lambda x, last: F.array(x, -1 - x, 2 * last + 1 - x)
    mirrored = sent.select(F.explode(images(F.col("_r"), reflect[0])).alias("_r"), "_c", "v", "o").select("_r", F.explode(images(F.col("_c"), reflect[1])).alias("_c"), "v", "o")
    out = mirrored.select((F.col("_r") - F.col("o.i")).alias(row), (F.col("_c") - F.col("o.j")).alias(column), F.col("o.k").alias("k"), "v")
    return out.filter(F.col(row).between(0, reflect[0]) & F.col(column).between(0, reflect[1]))


#: Side of a block in pixels.
BLOCK = 64


def focal(pixels: DataFrame, value: str, offsets: Sequence[tuple[int, int]], stats: dict[str, Column], row: str = "row", column: str = "col") -> DataFrame:
    """``stats`` over ``v`` (and ``k``) of each pixel's neighbourhood; nodata must be null, and centres are the pixels themselves,
    so the kernel holds the offset (0, 0)."""
    centre = list(offsets).index((0, 0))
    reach = [max(abs(o[axis]) for o in offsets) for axis in (0, 1)]
    around = lambda x, r: F.explode(F.sequence(F.floor((F.col(x) - r) / BLOCK), F.floor((F.col(x) + r) / BLOCK)))
    rows = pixels.select(F.col(row).alias("_r"), F.col(column).alias("_c"), F.col(value).alias("v"))
    held = rows.withColumn("_by", around("_r", reach[0])).withColumn("_bx", around("_c", reach[1])).repartition("_by", "_bx")
    kernel = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(j).alias("j")) for k, (i, j) in enumerate(offsets)])
    sent = held.withColumn("_o", F.explode(kernel)).select("_by", "_bx", (F.col("_r") - F.col("_o.i")).alias(row), (F.col("_c") - F.col("_o.j")).alias(column), F.col("_o.k").alias("k"), "v")
    own = sent.filter((F.floor(F.col(row) / BLOCK) == F.col("_by")) & (F.floor(F.col(column) / BLOCK) == F.col("_bx")))
    near = own.groupBy("_by", "_bx", row, column).agg(*[c.alias(n) for n, c in stats.items()], F.max(F.col("k") == centre).alias("_there"))
    return near.filter("_there").drop("_by", "_bx", "_there")


def share_nonzero(v: str = "v") -> Column:
    return F.coalesce(100 * F.avg((F.col(v) != 0).cast("int")), F.lit(0.0))


def all_equal_centre(v: str, centre: Column) -> Column:
    """1 if every valid neighbour equals the centre."""
    return ((F.min(v) == F.max(v)) & (F.min(v) == F.max(centre))).cast("int")


def best_match(predicted: DataFrame, truth: DataFrame, p: str, t: str, row: str = "row", column: str = "col") -> DataFrame:
    """Of the 3 x 3 reference pixels around each prediction, the closest in value (the first from the north-west on ties)."""
    near = neighbours(truth.filter(F.col(t).isNotNull()), t, square(3), row, column)
    joined = predicted.filter(F.col(p).isNotNull()).join(near, [row, column])
    return joined.groupBy(row, column, p).agg(F.min_by("v", F.struct(F.abs(F.col("v") - F.col(p)), F.col("k"))).alias("match"))


def kernel_means(predicted: DataFrame, truth: DataFrame, p: str, t: str, row: str = "row", column: str = "col") -> DataFrame:
    """Means of the 3 x 3 pixels around each valid prediction, of prediction and reference, truncated to whole numbers."""
    mean = lambda df, c: focal(df, c, square(3), {c: F.avg("v").cast("int")}, row, column)
    near = neighbours(truth.filter(F.col(t).isNotNull()), t, square(3), row, column).groupBy(row, column).agg(F.avg("v").cast("int").alias(t))
    return mean(predicted.filter(F.col(p).isNotNull()), p).join(near, [row, column])


def continuous_stats(v: str = "v") -> dict[str, Column]:
    """Mean, median, variance and deviation (population) and range."""
    x, n = F.col(v).cast("long"), F.nullif(F.count(v), F.lit(0))
    var = (n * F.sum(x * x) - F.sum(x) * F.sum(x)).cast("double") / (n * n)
    return {"mean": F.avg(v), "median": F.median(v), "variance": var, "stdv": F.sqrt(var), "range": F.max(v) - F.min(v)}
