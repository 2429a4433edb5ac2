"""Tables on storage. Rasters are long tables (tile_id, row, col, value), polygons are arrays of vertices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VARIABLES = "var_name string, data_type string, data_band int, search_str string, basepath string, by_tile int, nodata int, path_filter string, _corrupt_record string"
SAMPLE = "obs_id long, x long, y long, row int, col int, target int"
RASTER = "tile_id string, row int, col int, value double"


def delimited(spark: SparkSession, path: str, schema: str, separator: str = "\t") -> DataFrame:
    """A delimited table with a declared schema; a ragged row is kept with what fits, and whole in ``_corrupt_record`` if the schema has it."""
    return spark.read.csv(path, sep=separator, header=True, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record", enforceSchema=True)


def write_delimited(df: DataFrame, path: str, separator: str = "\t") -> None:
    df.write.mode("overwrite").csv(path, sep=separator, header=True)


def raster(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, nodata: float | None = None) -> DataFrame:
    """A raster table, whole or a window of it (the ranges reach the Parquet scan); nodata becomes null."""
    out = spark.read.schema(RASTER).parquet(path)
    for name, window in (("row", rows), ("col", cols)):
        if window:
            out = out.filter(F.col(name).between(window[0], window[1] - 1))
    return out if nodata is None else out.withColumn("value", F.nullif("value", F.lit(float(nodata))))


def window(spark: SparkSession, pixels: DataFrame, rows: tuple[int, int], cols: tuple[int, int], nodata: float) -> DataFrame:
    """Every pixel of a window, also beyond the raster, where it is ``nodata``."""
    grid = spark.range(rows[0], rows[1]).select(F.col("id").cast("int").alias("row")).crossJoin(spark.range(cols[0], cols[1]).select(F.col("id").cast("int").alias("col")))
    return grid.join(pixels.select("row", "col", "value"), ["row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(float(nodata))))


def write_raster(df: DataFrame, path: str, nodata: float, partitions: tuple[str, ...] = ("tile_id",)) -> None:
    """One file set for each tile, rows ordered within it so that windows prune; null leaves as ``nodata``."""
    ordered = df.withColumn("value", F.coalesce("value", F.lit(nodata))).repartition(*partitions).sortWithinPartitions(*partitions, "row", "col")
    ordered.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def write_model(sets: DataFrame, nodes: DataFrame, members: DataFrame, path: str) -> None:
    sets.write.mode("overwrite").parquet(f"{path}/support_sets")
    nodes.write.mode("overwrite").parquet(f"{path}/tree_nodes")
    members.write.mode("overwrite").parquet(f"{path}/set_samples")


def members(spark: SparkSession, path: str, set_id: int | None = None, in_bag: int | None = None) -> DataFrame:
    out = spark.read.parquet(f"{path}/set_samples")
    if set_id is not None:
        out = out.filter(F.col("set_id") == set_id)
    return out if in_bag is None else out.filter(F.col("in_bag") == in_bag)


def ids(spark: SparkSession, path: str) -> DataFrame:
    """One whole number a line."""
    return spark.read.text(path).select(F.trim("value").try_cast("long").alias("id")).filter("id IS NOT NULL")


def metadata_value(spark: SparkSession, path: str, keyword: str, separator: str = ":") -> DataFrame:
    """The value behind the separator on the first line with the keyword."""
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id()).filter(F.contains("value", F.lit(keyword)))
    return lines.agg(F.trim(F.split_part(F.min_by("value", "_at"), F.lit(separator), F.lit(2))).alias("value"))


def files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, tile_id) of files under tile folders, without their contents."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path")
    return found.withColumn("tile_id", F.element_at(F.split("path", "/"), -2))


def features(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A vector layer's attributes with ``fid``; a layer without features is an error."""
    out = spark.read.schema(schema).parquet(path)
    if not out.take(1):
        raise ValueError(f"no features in {path}")
    return out


def bounds(meta: DataFrame) -> DataFrame:
    """min_x, min_y, max_x, max_y of rasters given as (ul_x, x_res, ul_y, y_res, xsize, ysize)."""
    end = lambda a, r, n: F.col(a) + F.col(r) * F.col(n)
    x, y = end("ul_x", "x_res", "xsize"), end("ul_y", "y_res", "ysize")
    pick: dict[str, Column] = {"min_x": F.least("ul_x", x), "min_y": F.least("ul_y", y), "max_x": F.greatest("ul_x", x), "max_y": F.greatest("ul_y", y)}
    return meta.select("*", *[c.alias(n) for n, c in pick.items()])


def model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, nodes, members) of a model that :func:`write_model` wrote."""
    return tuple(spark.read.parquet(f"{path}/{n}") for n in ("support_sets", "tree_nodes", "set_samples"))


def database(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of a database over JDBC; ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` read it in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
