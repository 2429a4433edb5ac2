"""Ensemble statistics of each pixel over its sets, and importances."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import half_even, pop_std

#: name -> column over a pixel's predictions ``v``; ties of a vote go to the smallest value.
STATISTICS: dict[str, Callable[[Column], Column]] = {
    "mean": lambda v: half_even(F.avg(v)).cast("int"),
    "median": lambda v: half_even(F.median(v)).cast("int"),
    "stdv": lambda v: half_even(pop_std(v)).cast("int"),
    "vote": lambda v: F.mode(v, True),
    "count": lambda v: F.count(v),
    "min": F.min,
    "max": F.max,
}


def ensemble(predictions: DataFrame, pixel: Sequence[str], value: str, stats: Sequence[str]) -> DataFrame:
    """The named statistics of each pixel. All of them share one aggregation, so the predictions are shuffled once."""
    return predictions.groupBy(*pixel).agg(*[STATISTICS[s](F.col(value)).alias(s) for s in stats])


def vote_share(predictions: DataFrame, pixel: Sequence[str], value: str) -> DataFrame:
    """vote, count and pct_vote (the share that agrees with the vote, rounded half to even)."""
    counted = predictions.groupBy(*pixel, value).agg(F.count("*").alias("_n"))
    best = F.struct(F.col("_n"), (-F.col(value)).alias("neg"))
    out = counted.groupBy(*pixel).agg(F.max(best).alias("_b"), F.sum("_n").alias("count"))
    return out.select(*pixel, (-F.col("_b.neg")).alias("vote"), "count", half_even(100 * F.col("_b._n") / F.col("count")).cast("int").alias("pct_vote"))


def set_combinations(pixel_sets: DataFrame, pixel: Sequence[str], set_id: str = "set_id") -> DataFrame:
    """Each distinct combination of covering sets with its pixels' number; predictions can be made once for each."""
    combos = pixel_sets.groupBy(*pixel).agg(F.array_join(F.transform(F.array_sort(F.collect_set(set_id)), lambda x: x.cast("string")), ",").alias("combo"))
    return combos.groupBy("combo").agg(F.count("*").alias("n_pixels"))


def importance_ranks(importance: DataFrame, variable: str = "variable", value: str = "importance") -> DataFrame:
    """Mean importance of each variable, its share of all, and its rank (ties by name)."""
    mean = importance.groupBy(variable).agg(F.avg(value).alias("_m"))
    share = F.col("_m") / F.nullif(F.sum("_m").over(Window.partitionBy()), F.lit(0))
    return mean.withColumn("pct_importance", share).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("pct_importance"), variable))).drop("_m")


def gaussian_mean(predictions: DataFrame, pixel: Sequence[str], value: str, centre: str, c: float = 5, a: float = 1) -> DataFrame:
    """Mean weighted by (a e) ** (-(v - centre)**2 / (2 c**2)), rounded half to even; null where every weight is
    too small for a double."""
    import math

    w = F.exp(-((F.col(value) - F.col(centre)) ** 2) / (2.0 * c * c) * math.log(a * math.e))
    return predictions.groupBy(*pixel).agg(half_even(F.round(F.sum(F.col(value) * w) / F.nullif(F.sum(w), F.lit(0.0)), 6)).cast("int").alias("weighted_mean"))


def metric_map(pixel_sets: DataFrame, sets: DataFrame, pixel: Sequence[str], metric: str) -> DataFrame:
    """Mean of a set metric over the sets of each pixel (truncated), and their number."""
    joined = pixel_sets.join(sets.select("set_id", metric), "set_id")
    return joined.groupBy(*pixel).agg(F.floor(F.sum(metric) / F.nullif(F.count(metric), F.lit(0))).cast("int").alias(metric), F.count("*").alias("count"))


def importance_map(pixel_sets: DataFrame, importance: DataFrame, pixel: Sequence[str]) -> DataFrame:
    """Mean over the covering sets of each variable's importance in whole percent."""
    whole = importance.select("set_id", "variable", F.floor(F.col("importance") * 100).cast("int").alias("_i"))
    return pixel_sets.join(whole, "set_id").groupBy(*pixel, "variable").agg(half_even(F.avg("_i")).cast("int").alias("importance"))


def partial_ranges(predictions: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return predictions.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def combination_metrics(pixel_sets: DataFrame, sets: DataFrame, pixel: Sequence[str], metric: str, variable: str) -> DataFrame:
    """For each distinct combination of covering sets: its pixels, the mean metric (half away from zero) and the commonest ``variable`` (ties to the smallest)."""
    joined = pixel_sets.select(*pixel, "set_id").join(sets.select("set_id", metric, variable), "set_id")
    each = joined.groupBy(*pixel).agg(F.array_sort(F.collect_set(F.struct("set_id", metric, variable))).alias("_s"))
    combos = each.groupBy(F.array_join(F.transform("_s", lambda x: x["set_id"].cast("string")), ",").alias("combo")).agg(F.count("*").alias("n_pixels"), F.first("_s").alias("_s"))
    out = combos.select("combo", "n_pixels", F.explode("_s").alias("s"))
    return out.groupBy("combo", "n_pixels").agg(F.round(F.avg(f"s.{metric}")).cast("int").alias(metric), F.mode(F.col(f"s.{variable}"), True).alias(variable))


def partial_sums(predictions: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The first phase: what the second needs of a part of the sets, for each pixel."""
    v = F.col(value).cast("long")
    return predictions.groupBy(*by).agg(F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.count(v).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))


def stitched(parts: DataFrame, pixel: Sequence[str]) -> DataFrame:
    """The second phase: mean, stdv, count and range of each pixel from its partial sums."""
    s, q, n = F.sum("s"), F.sum("q"), F.nullif(F.sum("n"), F.lit(0))
    return parts.groupBy(*pixel).agg(half_even(s / n).cast("int").alias("mean"), half_even(F.sqrt((n * q - s * s).cast("double")) / n).cast("int").alias("stdv"), F.sum("n").alias("count"), F.min("low").alias("low"), F.max("high").alias("high"))
