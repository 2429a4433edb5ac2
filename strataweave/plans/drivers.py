"""Whole jobs from parameter files: sampling, extraction, training, prediction, evaluation and the curve of tree numbers.

A job takes the parameters as :func:`..sources.params.read` gives them and tables in the shapes of ``operators``; what it
returns is lazy, so a caller writes it where it belongs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import half_even, row_ids
from ..operators import ensemble, evaluate, grid, joins, model, sampling
from ..sources import params as ps

Params = dict[str, str]


def sample(pixels: DataFrame, params: Params, key: Sequence[str] = ("row", "col")) -> DataFrame:
    """Stratified samples of ``pixels(row, col, x, y, value)`` with obs_id and is_train.

    bins, n_sample, and if given sampling_scheme (equal or proportional), bin_scale, zero_inflation, min_sample, max_sample, pct_train.
    """
    bins, n = ps.bins(params["bins"]), int(params["n_sample"])
    counts = sampling.strata_counts(pixels, "value", bins)
    if params.get("sampling_scheme", "proportional") == "equal":
        sizes = sampling.equal_sizes(counts, n, bins, float(params.get("zero_inflation", 1)))
    else:
        sizes = sampling.proportional_sizes(counts, n, float(params.get("bin_scale", 1)))
    low, high = (float(params[k]) if k in params else None for k in ("min_sample", "max_sample"))
    drawn = sampling.drawn(pixels, sampling.within_limits(sizes, n, low, high), "value", bins, key)
    numbered = row_ids(drawn, key[0], list(key), "obs_id")
    return sampling.split_by_location(numbered, float(params.get("pct_train", 1)), key)


def extract(samples: DataFrame, pixels: DataFrame, variables: Sequence[str], key: str = "obs_id") -> tuple[DataFrame, DataFrame]:
    """(samples with a column for each variable of the long table ``pixels(row, col, variable, value)``, those that miss one)."""
    found = joins.extract(samples.select(key, "row", "col"), pixels, variables, ["row", "col"], key)
    return joins.with_nulls_apart(samples.drop(*variables).join(found, key, "left"), variables)


def support_sets(spark: SparkSession, params: Params, bounds: tuple[int, int, int, int], res: tuple[int, int] = (30, -30), seed: tuple[int, int] | None = None) -> DataFrame:
    """Support sets over ``bounds``: a grid of cell_size, sets_per_cell sets of support_size in each, numbered from 0."""
    cell, size = ([int(float(x)) for x in params[k].replace(" ", "").split(",")] for k in ("cell_size", "support_size"))
    start = seed or ((bounds[0] + bounds[2]) // 2, (bounds[1] + bounds[3]) // 2)
    cells = grid.place_grid(spark, tuple(cell), bounds, res, start)
    whole = tuple(grid.whole_size(s, r) for s, r in zip(size, (res[1], res[0]), strict=True))
    return grid.sets_in_cells(cells, int(params["sets_per_cell"]), whole, res, (0, 0))


def train(samples: DataFrame, sets: DataFrame, params: Params, features: Sequence[str], target: str, width: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets with their out-of-bag metrics and number of samples, tree nodes, members with in_bag).

    min_obs, and if given max_features, model_type (regressor or classifier) and oob_drop, an expression whose sets go. Sets are numbered
    from 0 without gaps over those that are left.
    """
    kind = params.get("model_type", "regressor")
    inside = joins.points_in_rectangles(samples, sets, width)
    bags = sampling.bagged(inside, "set_id", "obs_id", least=int(params.get("min_obs", 1)))
    nodes = model.train_sets(bags, features, target, kind, max_features=ps.max_features(params.get("max_features", "None")))
    oob = model.oob_metrics(model.predict_nodes(bags.filter("in_bag = 0"), nodes, features, ["obs_id", target]), target, kind)
    rated = sets.join(bags.groupBy("set_id").agg(F.count("*").alias("n_samples")), "set_id").join(oob, "set_id", "left")
    metrics = [c for c in oob.columns if c != "set_id"]
    kept = row_ids(model.without(rated, params.get("oob_drop"), metrics).withColumnRenamed("set_id", "_old"), "_old", ["_old"], "set_id")
    number = kept.select(F.col("_old").alias("set_id"), F.col("set_id").alias("_new"))
    renamed = lambda df: df.join(number, "set_id").drop("set_id").withColumnRenamed("_new", "set_id")
    return kept.drop("_old"), renamed(nodes), renamed(bags.select("set_id", "obs_id", "in_bag"))


def predict(pixels: DataFrame, sets: DataFrame, nodes: DataFrame, params: Params, features: Sequence[str], width: float, pixel: Sequence[str] = ("row", "col")) -> tuple[DataFrame, DataFrame]:
    """(the statistics agg_stats of each pixel of ``pixels(row, col, x, y, features)``, importance of the variables).

    constant_vars are added to the pixels; where a predictor is missing or nodata, nothing is predicted.
    """
    stats = params.get("agg_stats", "mean, vote, median, stdv").replace(" ", "").split(",")
    full = joins.with_constants(pixels, ps.constants(params.get("constant_vars", "")))
    rows = joins.points_in_rectangles(joins.predictable(full, features, float(params.get("nodata", -9999))), sets, width)
    each = model.predict_nodes(rows.select("set_id", *pixel, *features), nodes, features, pixel)
    each = each.withColumn("v", half_even("prediction").cast("int"))
    return ensemble.ensemble(each, pixel, "v", stats), ensemble.importance_ranks(model.importances(nodes))


def confusion(pixels: DataFrame, params: Params, reference: DataFrame | None = None) -> dict[str, DataFrame]:
    """Evaluation of ``pixels(p, t, ...)``: area-adjusted cells, accuracies, intervals, overall and disagreement.

    bins, and if given p_nodata and t_nodata; ``reference`` holds the sampled pixels, else all are compared.
    """
    bins = ps.bins(params["bins"])
    for c, name in (("p", "p_nodata"), ("t", "t_nodata")):
        if name in params:
            pixels = pixels.filter(F.col(c) != float(params[name]))
            reference = reference.filter(F.col(c) != float(params[name])) if reference is not None else None
    cells = evaluate.adjusted(evaluate.confusion_counts(pixels if reference is None else reference, "p", "t", bins), evaluate.area_weights(pixels, "p", bins))
    return {
        "cells": cells, "accuracies": evaluate.class_accuracies(cells), "intervals": evaluate.intervals(cells), "overall": evaluate.overall(cells), "disagreement": evaluate.disagreement(cells),
        "errors": pixels.agg(evaluate.rmse("p", "t").alias("rmse"), evaluate.mae("p", "t").alias("mae"), evaluate.r2("t", "p").alias("r2")),
    }


def map_evaluation(pixels: DataFrame, params: Params, zone: str) -> dict[str, DataFrame]:
    """:func:`confusion` with agreement over all, within each zone, and within each bin that both values fall in."""
    both = pixels.withColumn("_b", evaluate.binned(F.col("t"), ps.bins(params["bins"]))).filter(F.col("_b") == evaluate.binned(F.col("p"), ps.bins(params["bins"])))
    return confusion(pixels, params) | {"agreement": evaluate.agreement(pixels, "t", "p"), "by_zone": evaluate.agreement(pixels, "t", "p", [zone]), "by_bin": evaluate.agreement(both, "t", "p", ["_b"])}


def trees_curve(samples: DataFrame, params: Params, features: Sequence[str], target: str) -> DataFrame:
    """(n_trees, error): the out-of-bag error of the vote of the first n of max_trees trees, for samples that a task can hold."""
    members = model.forest_members(samples, int(params["max_trees"]))
    nodes = model.train_sets(members, features, target, "classifier")
    votes = model.predict_nodes(members.filter("in_bag = 0"), nodes, features, ["obs_id", target])
    return model.error_by_trees(votes.withColumn("prediction", F.col("prediction").cast("long")), target)


def files_by_scale(files: DataFrame, pattern: str, scales: Sequence[str]) -> DataFrame:
    """(scale, path): for each evaluation scale the first file whose name fits the pattern with the scale in place of ``{0}``."""
    name = F.element_at(F.split("path", "/"), -1)
    found = files.select("path", F.explode(F.array(*[F.struct(F.lit(s).alias("scale"), name.rlike(pattern.replace("{0}", s)).alias("fits")) for s in scales])).alias("x"))
    return found.filter("x.fits").groupBy(F.col("x.scale").alias("scale")).agg(F.min("path").alias("path"))
