"""Sampling: splits, bags, strata and hold-outs, all ordered by a stable integer key so that any plan draws the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import shuffled


def split_by_location(df: DataFrame, share: float, on: Sequence[str] = ("row", "col"), seed: int = 1) -> DataFrame:
    """``df`` with ``is_train``: a share of the distinct locations, whole locations on one side.

    A location's side follows from its key alone, so no ranking of all locations is needed.
    """
    return df.withColumn("is_train", (shuffled(seed, *on) % 10000 < int(share * 10000)).cast("int"))


def bagged(members: DataFrame, by: str, key: str, share: float = 0.63, least: int = 0, seed: int = 1) -> DataFrame:
    """Members of each set with ``in_bag`` (a share of them, without replacement; the rest is out of bag); sets whose bag
    would hold fewer than ``least`` are left out."""
    w = Window.partitionBy(by)
    out = members.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(shuffled(seed, key, by), key)))
    bag = F.floor(F.col("_n") * share)
    return out.filter(bag >= least).withColumn("in_bag", (F.col("_r") <= bag).cast("int")).drop("_n", "_r")


def binned(value: Column, bins: Sequence[tuple[float, float]]) -> Column:
    """The number of the first bin (lo, hi] that holds the value, else null."""
    out = None
    for k, (lo, hi) in enumerate(bins):
        test = (value > lo) & (value <= hi)
        out = F.when(test, k) if out is None else out.when(test, k)
    return out


def strata_counts(df: DataFrame, value: str, bins: Sequence[tuple[float, float]], by: Sequence[str] = ()) -> DataFrame:
    return df.withColumn("bin", binned(F.col(value), bins)).filter("bin IS NOT NULL").groupBy(*by, "bin").agg(F.count("*").alias("n_bin"))


def proportional_sizes(counts: DataFrame, n: int, scale: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """``share`` and ``size`` of each bin: shares drawn by ``scale`` toward the middle, then normalised to ``n``."""
    w = Window.partitionBy(*by)
    p = F.col("n_bin") / F.sum("n_bin").over(w)
    shares = counts.withColumn("share", p)
    middle = (F.max("share").over(w) - F.min("share").over(w)) / 2
    drawn = shares.withColumn("_s", (F.col("share") - middle) / scale + middle)
    return drawn.withColumn("size", F.col("_s") / F.sum("_s").over(w) * n).drop("_s")


def equal_sizes(counts: DataFrame, n: int, bins: Sequence[tuple[float, float]], zero_inflation: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """The same number of each bin; the bin that ends at 0 weighs ``zero_inflation`` times as much."""
    zero = next((k for k, (_, hi) in enumerate(bins) if hi == 0), -1)
    weight = F.when(F.col("bin") == zero, F.lit(float(zero_inflation))).otherwise(F.lit(1.0))
    weighted = counts.withColumn("_w", weight)
    return weighted.withColumn("size", F.col("_w") / F.sum("_w").over(Window.partitionBy(*by)) * n).drop("_w")


def within_limits(sizes: DataFrame, n: int, low: float | None, high: float | None, by: Sequence[str] = (), passes: int = 10) -> DataFrame:
    """Sizes moved toward [low, high] in damped passes, rescaled to ``n`` each time, at last whole numbers.

    A limit below 1 is a share of ``n``. Unrolled over rows of bins, which are few.
    """
    w = Window.partitionBy(*by)
    limit = lambda x: None if x is None else x * n if x < 1 else x
    low, high = limit(low), limit(high)
    if low is None and high is None:
        passes = 0
    out = sizes
    for _ in range(passes):
        v = F.col("size")
        if high is not None:
            out = out.withColumn("size", F.when(v > high, (v + high) / 2.05).otherwise(v)).withColumn("size", v / F.sum("size").over(w) * n)
        if low is not None:
            out = out.withColumn("size", F.when(v < low, (v + low) / 1.95).otherwise(v)).withColumn("size", v / F.sum("size").over(w) * n)
    return out.withColumn("size", F.floor(F.round("size", 6)))  # sums in any order give one result


def drawn(df: DataFrame, sizes: DataFrame, value: str, bins: Sequence[tuple[float, float]], key: Sequence[str], by: Sequence[str] = (), seed: int = 1) -> DataFrame:
    """``size`` rows of each stratum at random, all of one that has fewer; only as many leave each task as are wanted in all."""
    on = [*by, "bin"]
    rows = df.withColumn("bin", binned(F.col(value), bins)).filter("bin IS NOT NULL").join(sizes.select(*on, "size"), on)
    order = [shuffled(seed, *key), *key]
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*on).orderBy(*order))).filter(F.col("_r") <= F.col("size")).drop("_r", "size")


def zone_split(zones: DataFrame, zone: str, share: float, seed: int = 1) -> DataFrame:
    """Distinct zones with ``is_train``."""
    ids = zones.select(zone).distinct()
    total = F.count("*").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(shuffled(seed, zone), zone))
    return ids.withColumn("is_train", (rank <= F.floor(total * share)).cast("int"))


def simple_random(df: DataFrame, k: int, key: Sequence[str], seed: int = 1) -> DataFrame:
    """``k`` rows without replacement (a top-k, so each task keeps at most k)."""
    return df.orderBy(shuffled(seed, *key), *key).limit(k)


def balanced_trials(df: DataFrame, trials: int, per_cell: int, cell: str, key: str, seed: int = 1) -> DataFrame:
    """``per_cell`` rows of each cell in each of ``trials`` independent draws."""
    each = df.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    rank = F.row_number().over(Window.partitionBy("trial", cell).orderBy(shuffled(seed, key, "trial"), key))
    return each.withColumn("_r", rank).filter(F.col("_r") <= per_cell).drop("_r")


def tile_quota(tiles: DataFrame, n: int) -> DataFrame:
    """``pct_area`` and ``n_sample`` of each tile by its area."""
    share = F.col("area") / F.nullif(F.sum("area").over(Window.partitionBy()), F.lit(0))
    return tiles.withColumn("pct_area", share).withColumn("n_sample", F.floor(F.col("pct_area") * n))


def equal_allocation(df: DataFrame, value: str, bins: Sequence[tuple[float, float]], n: int, key: Sequence[str], seed: int = 1) -> DataFrame:
    """``n`` // bins rows of each bin at random, all of one that has fewer."""
    sizes = strata_counts(df, value, bins).select("bin", F.lit(n // len(bins)).alias("size"))
    return drawn(df, sizes, value, bins, key, seed=seed)


def zone_samples(df: DataFrame, zone: str, false_value: int, n: int, share_zones: float, key: Sequence[str], inflation: float = 1.0, seed: int = 1) -> DataFrame:
    """Samples of zones against the rest: whole zones are held out, half of ``n`` comes from zones (``value`` 1) and half, times
    ``inflation``, from pixels of ``false_value`` (``value`` 0); the same shares of both are for training."""
    zones = zone_split(df.filter(F.col(zone) != false_value), zone, share_zones, seed)
    inside = df.join(zones, zone)
    train, test = int(n / 2 * share_zones), n // 2 - int(n / 2 * share_zones)
    rest = df.filter(F.col(zone) == false_value).withColumn("is_train", (shuffled(seed + 1, *key) % 10000 < int(share_zones * 10000)).cast("int"))
    pick = lambda rows, k, train, value: simple_random(rows.filter(F.col("is_train") == train), k, key, seed).withColumn("value", F.lit(value))
    return pick(inside, train, 1, 1).unionByName(pick(inside, test, 0, 1)).unionByName(pick(rest, int(train * inflation), 1, 0)).unionByName(pick(rest, int(test * inflation), 0, 0))


def bag_of_all(df: DataFrame, key: str, share: float = 0.63, seed: int = 1) -> DataFrame:
    """One bag over everything: a row's side follows from its key, so no task sees all rows."""
    return df.withColumn("in_bag", (shuffled(seed, key) % 10000 < int(share * 10000)).cast("int"))
