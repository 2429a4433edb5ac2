"""Map evaluation: errors, agreement, area-adjusted confusion, zones, curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import Num, col
from .sampling import binned

Bins = Sequence[tuple[float, float]]


def rmse(x: Num, y: Num) -> Column:
    return F.sqrt(F.avg((col(x) - col(y)) * (col(x) - col(y))))


def rmspe(x: Num, y: Num) -> Column:
    """Root mean square percentage error relative to x; rows with x = 0 are left out."""
    e = 100.0 * (col(x) - col(y)) / F.nullif(col(x), F.lit(0))
    return F.sqrt(F.avg(e * e))


def mae(x: Num, y: Num) -> Column:
    return F.avg(F.abs(col(x) - col(y)))


def r2(truth: Num, predicted: Num) -> Column:
    """1 - SSE / SST, from sums; null where the truth is constant."""
    t, p = col(truth).cast("double"), col(predicted).cast("double")
    n = F.nullif(F.count(t), F.lit(0))
    return 1 - F.sum((t - p) * (t - p)) / F.nullif(F.sum(t * t) - F.sum(t) * F.sum(t) / n, F.lit(0.0))


def brier(truth: Num, probability: Num) -> Column:
    return F.avg((col(truth) - col(probability)) * (col(truth) - col(probability)))


def agreement(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Agreement coefficient and its systematic and unsystematic parts: ac, ac_s, ac_u, ssd, spod.

    Two passes: means and moments of each group, then the sums around them. A constant x or y has no line, so its ac_s and
    ac_u are null; ac is null where both are the same constant.
    """
    X, Y = F.col(x).cast("double"), F.col(y).cast("double")
    n = F.count("*")
    m = df.groupBy(*by).agg(F.avg(X).alias("_mx"), F.avg(Y).alias("_my"), (F.sum(X * X) - F.sum(X) * F.sum(X) / n).alias("_sxx"), (F.sum(Y * Y) - F.sum(Y) * F.sum(Y) / n).alias("_syy"), (F.sum(X * Y) - F.sum(X) * F.sum(Y) / n).alias("_sxy"))
    m = m.withColumn("_b", F.signum("_sxy") * F.sqrt(F.col("_syy") / F.nullif(F.col("_sxx"), F.lit(0.0)))).withColumn("_a", F.col("_my") - F.col("_b") * F.col("_mx"))
    rows = df.join(F.broadcast(m) if not by else m, list(by)) if by else df.join(F.broadcast(m))
    d = F.abs(F.col("_mx") - F.col("_my"))
    line = F.abs(X - (Y - F.col("_a")) / F.nullif("_b", F.lit(0.0))) * F.abs(Y - (F.col("_a") + F.col("_b") * X))
    s = rows.groupBy(*by).agg(F.sum((X - Y) * (X - Y)).alias("ssd"), F.sum((d + F.abs(X - F.col("_mx"))) * (d + F.abs(Y - F.col("_my")))).alias("spod"), F.sum(line).alias("_u"))
    spod = F.nullif("spod", F.lit(0.0))
    return s.select(*by, (1 - F.col("ssd") / spod).alias("ac"), (1 - (F.col("ssd") - F.col("_u")) / spod).alias("ac_s"), (1 - F.col("_u") / spod).alias("ac_u"), "ssd", "spod")


def confusion_counts(df: DataFrame, predicted: str, truth: str, bins: Bins, by: Sequence[str] = ()) -> DataFrame:
    """(p_bin, t_bin, n), tidy."""
    both = df.withColumn("p_bin", binned(F.col(predicted), bins)).withColumn("t_bin", binned(F.col(truth), bins))
    return both.filter("p_bin IS NOT NULL AND t_bin IS NOT NULL").groupBy(*by, "p_bin", "t_bin").agg(F.count("*").alias("n"))


def area_weights(pixels: DataFrame, value: str, bins: Bins, by: Sequence[str] = ()) -> DataFrame:
    """(p_bin, n_map, weight): the mapped share of each bin."""
    n = pixels.withColumn("p_bin", binned(F.col(value), bins)).filter("p_bin IS NOT NULL").groupBy(*by, "p_bin").agg(F.count("*").alias("n_map"))
    return n.withColumn("weight", F.col("n_map") / F.sum("n_map").over(Window.partitionBy(*by)))


def adjusted(counts: DataFrame, weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cells with n_i, weight and the area-adjusted p = n / n_i * weight. Bins never predicted are left out on both axes."""
    w = Window.partitionBy(*by, "p_bin")
    seen = counts.select(*by, "p_bin").distinct()
    kept = counts.join(seen.withColumnRenamed("p_bin", "t_bin"), [*by, "t_bin"], "left_semi")
    return kept.withColumn("n_i", F.sum("n").over(w)).join(weights, [*by, "p_bin"]).withColumn("p", F.col("n") / F.col("n_i") * F.col("weight"))


def class_accuracies(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(class, user, producer): shares of the adjusted diagonal in its row and its column."""
    rows = cells.groupBy(*by, F.col("p_bin").alias("class")).agg((F.sum(F.when(F.col("p_bin") == F.col("t_bin"), F.col("p"))) / F.nullif(F.sum("p"), F.lit(0.0))).alias("user"))
    cols = cells.groupBy(*by, F.col("t_bin").alias("class")).agg((F.sum(F.when(F.col("p_bin") == F.col("t_bin"), F.col("p"))) / F.nullif(F.sum("p"), F.lit(0.0))).alias("producer"))
    return rows.join(cols, [*by, "class"], "full")


def overall(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """accuracy (adjusted) and kappa, whose chance agreement comes from the sample counts."""
    row = cells.groupBy(*by, F.col("p_bin").alias("k")).agg(F.sum("n").alias("_row"))
    column = cells.groupBy(*by, F.col("t_bin").alias("k")).agg(F.sum("n").alias("_col"))
    chance = row.join(column, [*by, "k"], "full").groupBy(*by).agg((F.sum(F.col("_row") * F.col("_col")) / (F.sum("_row") * F.sum("_row"))).alias("_e"))
    acc = cells.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("p_bin") == F.col("t_bin"), F.col("p"))), F.lit(0.0)).alias("accuracy"))
    joined = acc.join(chance, list(by)) if by else acc.join(F.broadcast(chance))
    return joined.select(*by, "accuracy", ((F.col("accuracy") - F.col("_e")) / F.nullif(1 - F.col("_e"), F.lit(0.0))).alias("kappa"))


def intervals(cells: DataFrame, z: float = 1.96) -> DataFrame:
    """(class, user_ci, producer_ci, overall_ci); null where a bin has one sample."""
    n_i = F.nullif(F.col("n_i") - 1, F.lit(0))
    per_row = cells.groupBy("p_bin").agg(F.max("n_i").alias("n_i"), F.max("weight").alias("w"), F.max("n_map").alias("N"), F.coalesce(F.sum(F.when(F.col("p_bin") == F.col("t_bin"), F.col("n"))), F.lit(0)).alias("d"))
    u = F.col("d") / F.col("n_i")
    per_row = per_row.withColumn("u", u).withColumn("vu", F.col("u") * (1 - F.col("u")) / n_i)
    total = per_row.agg(F.sum(F.col("w") * F.col("w") * F.col("vu")).alias("vo"))
    share = F.col("n") / F.col("n_i")
    per_col = cells.groupBy("t_bin").agg(F.sum(F.col("n_map") / F.col("n_i") * F.col("n")).alias("nj"), F.sum(F.when(F.col("p_bin") != F.col("t_bin"), F.col("n_map").cast("double") * F.col("n_map") * share * (1 - share) / n_i)).alias("others"))
    j = per_row.join(per_col, F.col("p_bin") == F.col("t_bin"))
    prod = F.col("N") * F.col("u") / F.col("nj")
    vp = (F.col("N").cast("double") * F.col("N") * (1 - prod) * (1 - prod) * F.col("vu") + prod * prod * F.coalesce("others", F.lit(0.0))) / (F.col("nj") * F.col("nj"))
    return j.join(F.broadcast(total)).select(F.col("p_bin").alias("class"), (z * F.sqrt("vu")).alias("user_ci"), (z * F.sqrt(vp)).alias("producer_ci"), (z * F.sqrt("vo")).alias("overall_ci"))


def disagreement(cells: DataFrame) -> DataFrame:
    """quantity and allocation disagreement of the adjusted matrix."""
    row = cells.groupBy(F.col("p_bin").alias("k")).agg(F.sum("p").alias("r"), F.sum(F.when(F.col("p_bin") == F.col("t_bin"), F.col("p")).otherwise(0.0)).alias("d"))
    column = cells.groupBy(F.col("t_bin").alias("k")).agg(F.sum("p").alias("c"))
    both = row.join(column, "k", "full").na.fill(0.0)
    return both.agg((F.sum(F.abs(F.col("r") - F.col("c"))) / 2).alias("quantity"), (F.sum(2 * F.least(F.col("r") - F.col("d"), F.col("c") - F.col("d"))) / 2).alias("allocation"))


def area_weighted_rmse(samples: DataFrame, predicted: str, truth: str, bins: Bins, weights: DataFrame) -> DataFrame:
    """Sum over reference bins of the mapped share times the bin's RMSE."""
    per = samples.withColumn("p_bin", binned(F.col(truth), bins)).filter("p_bin IS NOT NULL").groupBy("p_bin").agg(rmse(predicted, truth).alias("_e"))
    return per.join(weights, "p_bin").agg(F.sum(F.col("_e") * F.col("weight")).alias("area_weighted_rmse"))


def auc(df: DataFrame, score: str, positive: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by ranks, tied scores at mid-rank, from counts of distinct scores; null with one class."""
    s = df.groupBy(*by, score).agg(F.sum(F.when(F.col(positive) == 1, 1).otherwise(0)).alias("_p"), F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = s.withColumn("_below", F.sum("_n").over(w) - F.col("_n"))
    twice = F.sum(F.col("_p") * (2 * F.col("_below") + F.col("_n") + 1))  # twice the rank sum
    pos, n = F.sum("_p"), F.sum("_n")
    return r.groupBy(*by).agg(((twice - pos * (pos + 1)) / 2 / F.nullif(pos * (n - pos), F.lit(0))).alias("auc"), pos.alias("n_pos"), (n - pos).alias("n_neg"))


def cdf(df: DataFrame, value: str, width: float) -> DataFrame:
    """Counts of bins of ``width`` and the cumulative count; only the bins pass through one task."""
    h = df.groupBy(F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"))
    return h.withColumn("cum", F.sum("n").over(Window.orderBy("bin")))


def histogram_2d(df: DataFrame, x: str, y: str, width: float) -> DataFrame:
    return df.groupBy(F.floor(F.col(x) / width).alias("bin_x"), F.floor(F.col(y) / width).alias("bin_y")).agg(F.count("*").alias("n"))


def difference(p: Num, t: Num, no_p: float, no_t: float) -> Column:
    return F.when((col(p) == no_p) | (col(t) == no_t), F.lit(no_p)).otherwise(col(p) - col(t))


def zonal(pixels: DataFrame, zone: str, stats: dict[str, Column]) -> DataFrame:
    return pixels.filter(F.col(zone).isNotNull()).groupBy(zone).agg(*[c.alias(n) for n, c in stats.items()])


def valid_rmse(p: Num, t: Num, no_p: float, no_t: float) -> Column:
    """RMSE over rows of which neither side is nodata."""
    e = F.when((col(p) != no_p) & (col(t) != no_t), col(p) - col(t))
    return F.sqrt(F.avg(e * e))


def trial_metrics(trials: DataFrame, truth: str, predicted: str, positive: str, trial: str = "trial") -> DataFrame:
    """auc, ac, r2, rmse and rmse_pm (RMSE of the positive rows) of each trial; null where a trial can't tell."""
    a = auc(trials, predicted, positive, [trial]).select(trial, "auc")
    c = agreement(trials, truth, predicted, [trial]).select(trial, "ac")
    hit = F.when(F.col(positive) == 1, (F.col(truth) - F.col(predicted)) * (F.col(truth) - F.col(predicted)))
    e = trials.groupBy(trial).agg(r2(truth, predicted).alias("r2"), rmse(truth, predicted).alias("rmse"), F.sqrt(F.avg(hit)).alias("rmse_pm"))
    return a.join(c, trial).join(e, trial)


def spread(trials: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, mean, pm): each metric's mean and population deviation over the trials."""
    rows = trials.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")).select("x.*")
    return rows.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("pm"))


def stats_slice(stats: DataFrame, row: str, column: str, columns: Sequence[str], metric: str) -> DataFrame:
    """One metric of a tidy table (row, column, metric, value) as a table of rows by columns."""
    return stats.filter(F.col("metric") == metric).groupBy(row).pivot(column, list(columns)).agg(F.first("value"))
