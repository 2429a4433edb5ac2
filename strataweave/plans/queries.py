"""Queries of the engine by name; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry, numeric, texts
from ..operators import ensemble as en
from ..operators import evaluate as ev
from ..operators import focal as fo
from ..operators import grid, joins, model
from ..operators import sampling as sa
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
PIXEL = ["px_row", "px_col"]
TENTHS = [(-1, 10), *[(k, k + 10) for k in range(10, 100, 10)]]
FEATURES = ["f_disc", "f_price", "f_retail", "f_size", "f_tax"]
HEXAGON = [(300, -60), (900, -60), (1200, -240), (900, -420), (300, -420), (0, -240)]
CORNERS = ("ul_x", "ul_y", "lr_x", "lr_y")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def r(c, digits: int = 4):
    return F.round(c, digits)


def _tiles(spark, d) -> DataFrame:
    """Tiles of 5 rows and 25 columns with their corners on the map, from the pixels' tile numbers."""
    px = fx.pixels(spark, d)
    return px.groupBy(F.floor(F.col("px_row") / 5).alias("ti"), F.floor(F.col("px_col") / 25).alias("tj")).agg(F.count("*").alias("n")).select(
        (F.col("ti") * 4 + F.col("tj")).alias("tile_id"), (F.col("tj") * 750).alias("tx1"), (F.col("ti") * -150).alias("ty1"), (F.col("tj") * 750 + 750).alias("tx2"), (F.col("ti") * -150 - 150).alias("ty2"), "n"
    )


def _pixel_tiles(spark, d, above: int) -> DataFrame:
    """The tile of every pixel whose value counts as valid: above a limit."""
    return fx.pixels(spark, d).filter(F.col("truth") > above).select((F.floor(F.col("px_row") / 5) * 4 + F.floor(F.col("px_col") / 25)).alias("tile_id"))


# grid and scalars


@query
def grid_rowcol(spark, d):
    s = fx.samples(spark, d)
    return grid.row_col(s, 0, 0, 30, -30).select("obs_id", "row", "col")


@query
def grid_xy_inverse(spark, d):
    p = fx.pixels(spark, d).drop("x", "y")
    return grid.x_y(p, 15, -15, 30, -30, "px_row", "px_col").select("px_row", "px_col", "x", "y")


@query
def snap_coordinate(spark, d):
    s = fx.samples(spark, d).select("obs_id", (F.col("x") + F.col("obs_id") % 29).alias("cx"), (F.col("y") - F.col("obs_id") % 31).alias("cy"))
    return s.select("obs_id", geometry.snap("cx", 15, 30).cast("long").alias("sx"), geometry.snap("cy", 15, -30).cast("long").alias("sy"))


@query
def aspect_transform(spark, d):
    p = fx.pixels(spark, d).withColumn("aspect", F.col("truth") * 3.6)
    return p.select("px_row", "px_col", texts.aspect("aspect", 225).alias("ne_sw"), texts.aspect("aspect", 135).alias("nw_se"))


@query
def scale_values(spark, d):
    return fx.pixels(spark, d).select("px_row", "px_col", F.when(F.col("truth") != 0, F.col("truth") * 10).otherwise(0).alias("scaled"))


@query
def tile_assign(spark, d):
    p = fx.pixels(spark, d).join(F.broadcast(fx.read(spark, d, "orders").selectExpr("CAST(floor(max(o_orderkey) / 100) + 1 AS INT) AS n_rows")))
    return p.select("px_row", "px_col", grid.tile_of("px_row", "px_col", (4, 6), "n_rows", 100).alias("tile_id"))


@query
def min_dtype(spark, d):
    p = fx.pixels(spark, d)
    return joins_union([grid.least_type(p, c).select(F.lit(c).alias("name"), F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"), "type") for c in ("truth", "x", "y")])


def joins_union(frames):
    return model.union_all(frames)


@query
def year_band(spark, d):
    s = fx.samples(spark, d)
    return s.select("obs_id", texts.band(F.when(F.col("obs_id") % 3 == 0, -1).otherwise(2), "yr").alias("band"), texts.for_year(F.lit("landcover_{0}.bsq"), "yr").alias("file"), texts.tile_name(F.col("obs_id") % 1000).alias("tile"))


@query
def difference_map(spark, d):
    return fx.pixels(spark, d).select("px_row", "px_col", ev.difference("pred", "truth", 0, 50).cast("long").alias("dif"))


@query
def metadata_numbers(spark, d):
    p = fx.read(spark, d, "part").select("p_partkey", F.concat(F.lit("Error "), F.col("p_size").cast("string"), F.lit(" of "), F.col("p_brand")).alias("t"))
    return p.select("p_partkey", r(texts.accuracy("t")).alias("accuracy"), F.size(texts.numbers("t")).alias("n_numbers"))


@query
def raster_bounds(spark, d):
    from ..sources.tables import bounds

    meta = fx.sets(spark, d).select("set_id", "ul_x", F.lit(30).alias("x_res"), "ul_y", F.lit(-30).alias("y_res"), F.lit(40).alias("xsize"), F.lit(40).alias("ysize"))
    return bounds(meta).select("set_id", "min_x", "min_y", "max_x", "max_y")


@query
def set_wkt(spark, d):
    s = fx.sets(spark, d)
    return s.select("set_id", geometry.rectangle_wkt(*CORNERS).alias("wkt")).select("set_id", "wkt", F.size(geometry.wkt_points("wkt")).alias("n_points"))


@query
def grid_cells(spark, d):
    return grid.place_grid(spark, (900, 1500), (0, -4500, 2970, 0), (30, -30), (411, -1000)).select("cell_id", *CORNERS)


@query
def sets_per_cell(spark, d):
    cells = grid.place_grid(spark, (900, 1500), (0, -4500, 2970, 0), (30, -30), (411, -1000))
    return grid.sets_in_cells(cells, 4, (1200, 1200), (30, -30), (0, 0)).select("set_id", "cell_id", *CORNERS)


@query
def param_parse(spark, d):
    from ..sources import params

    text = "Title\n\nn_jobs; 4\nbins; \"-1:10, 10:20\"\nno parameter\na; b; c\nconstant vars; K:1, L:2\n"
    p = params.parse(text)[0]
    return spark.createDataFrame(sorted(p.items()), "key string, value string")


@query
def time_series_params(spark, d):
    return spark.range(1990, 2013).select(F.col("id").cast("int").alias("year")).select("year", texts.band(F.lit(-1), "year").alias("band"), texts.for_year(F.lit("predict_{0}.txt"), "year").alias("file"))


# joins


@query
def pixel_set_overlap(spark, d):
    return fx.pixel_sets(spark, d).groupBy("set_id").agg(F.count("*").alias("n_pixels"), F.sum("truth").alias("sum_truth"))


@query
def sample_set_range_join(spark, d):
    return fx.members(spark, d).groupBy("set_id").agg(F.count("*").alias("n_samples"), F.sum("obs_id").alias("sum_obs"), F.sum("target").alias("sum_target"))


@query
def unique_set_combos(spark, d):
    return en.set_combinations(fx.pixel_sets(spark, d), PIXEL)


@query
def set_tile_overlap(spark, d):
    pairs = joins.overlapping(fx.sets(spark, d), _tiles(spark, d), fx.BIN, CORNERS, ("tx1", "ty1", "tx2", "ty2"))
    return pairs.groupBy("tile_id").agg(F.count("*").alias("n_sets"), F.sum("area").cast("long").alias("area"))


@query
def semi_overlap(spark, d):
    dark = joins.empty_tiles(_tiles(spark, d), _pixel_tiles(spark, d, 97))
    return joins.touching_any(fx.sets(spark, d), dark, fx.BIN, "set_id", CORNERS, ("tx1", "ty1", "tx2", "ty2")).select("set_id")


@query
def empty_tiles_anti(spark, d):
    return joins.empty_tiles(_tiles(spark, d), _pixel_tiles(spark, d, 98)).select("tile_id")


@query
def lookup_predictors(spark, d):
    s = grid.row_col(fx.samples(spark, d), 0, 0, 30, -30).select("obs_id", F.col("row").alias("px_row"), F.col("col").alias("px_col"))
    return joins.lookup(s, fx.pixels(spark, d), "truth", "value", PIXEL, 50).select("obs_id", "value")


@query
def extract_pivot_by_year(spark, d):
    p = fx.pixels(spark, d)
    long_ = p.select(*PIXEL, F.explode(F.array(*[F.struct(F.lit(f"var_{y}").alias("variable"), (F.col("truth") + (y - 1995)).alias("value")) for y in (1995, 1996, 1997)])).alias("v")).select(*PIXEL, "v.*")
    s = grid.row_col(fx.samples(spark, d), 0, 0, 30, -30).select("obs_id", F.col("row").alias("px_row"), F.col("col").alias("px_col"))
    return joins.extract(s, long_, ["var_1995", "var_1996", "var_1997"], PIXEL, "obs_id")


@query
def dropped_nulls(spark, d):
    s = fx.samples(spark, d).withColumn("f_size", F.expr("nullif(f_size, 7)")).withColumn("f_tax", F.expr("nullif(f_tax, 0)"))
    kept, gone = joins.with_nulls_apart(s, ["f_size", "f_tax"])
    return model.union_all([kept.agg(F.lit("kept").alias("part"), F.count("*").alias("n"), F.sum("obs_id").alias("ids")), gone.agg(F.lit("dropped").alias("part"), F.count("*").alias("n"), F.sum("obs_id").alias("ids"))])


@query
def point_in_polygon(spark, d):
    s = fx.samples(spark, d)
    return s.filter(geometry.inside("x", "y", HEXAGON)).select("obs_id")


@query
def polygon_join(spark, d):
    rings = [(k, [(x + 600.0 * k, float(y)) for x, y in HEXAGON]) for k in range(4)]
    polygons = spark.createDataFrame(rings, "poly_id int, ring array<struct<x: double, y: double>>")
    return joins.points_in_polygons(fx.pixels(spark, d), polygons, fx.BIN).groupBy("poly_id").agg(F.count("*").alias("n"), F.sum("truth").alias("sum_truth"))


@query
def snap_raster(spark, d):
    p = fx.pixels(spark, d)
    g = p.select((F.col("px_row") + 2).alias("px_row"), (F.col("px_col") + 3).alias("px_col"), F.col("zone"))
    return joins.snapped(g, p.select(*PIXEL, "truth"), "truth", -9999, PIXEL, F.col("zone") == 0).select(*PIXEL, "truth")


@query
def psu_split_test(spark, d):
    areas = _tiles(spark, d).filter("tile_id % 3 = 0").selectExpr("tile_id", "tx1 AS ul_x", "ty1 AS ul_y", "tx2 AS lr_x", "ty2 AS lr_y")
    return joins.split_by_areas(fx.pixels(spark, d), areas, fx.BIN, "tile_id", "truth", 0, PIXEL)[0].select("px_row", "px_col", "truth", "tile_id")


@query
def psu_split_train(spark, d):
    areas = _tiles(spark, d).filter("tile_id % 3 = 0").selectExpr("tile_id", "tx1 AS ul_x", "ty1 AS ul_y", "tx2 AS lr_x", "ty2 AS lr_y")
    return joins.split_by_areas(fx.pixels(spark, d), areas, fx.BIN, "tile_id", "truth", 0, PIXEL)[1].select("px_row", "px_col", "truth")


@query
def mosaic_merge(spark, d):
    p = fx.pixels(spark, d).withColumn("tile_id", F.floor(F.col("px_col") / 25))
    parts = model.union_all([p.filter(F.col("tile_id") == k).select("tile_id", *PIXEL, (F.col("pred") + k).alias("value")) for k in range(4)])
    return joins.mosaicked(p.select("tile_id", *PIXEL), parts, PIXEL).groupBy("tile_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query
def concat_by_year(spark, d):
    s = fx.samples(spark, d)
    yearly = model.union_all([s.filter(F.col("yr") == y).select("obs_id", "yr", (F.col("f_size") + y).alias("p")) for y in range(1995, 2002)])
    return joins.by_year(yearly, s.select("obs_id", "yr", "target")).groupBy("yr").agg(F.count("*").alias("n"), F.sum("p").cast("long").alias("sum_p"), F.sum("target").alias("sum_target"))


@query
def model_inventory(spark, d):
    inv = fx.sets(spark, d).select("set_id", F.lit(None).cast("long").alias("n_samples"), F.col("ctr_x").cast("long").alias("accuracy"))
    scores = fx.members(spark, d).filter("set_id % 2 = 0").groupBy("set_id").agg(F.count("*").alias("n_samples"), F.sum("target").alias("total"))
    return joins.merged_inventory(inv, scores, "set_id")


# sampling


@query
def split_train_test(spark, d):
    s = grid.row_col(fx.samples(spark, d), 0, 0, 30, -30)
    return sa.split_by_location(s, 0.8).groupBy("is_train").agg(F.count("*").alias("n"), F.sum("obs_id").alias("ids"))


@query
def bag_oob(spark, d):
    b = sa.bagged(fx.members(spark, d), "set_id", "obs_id")
    return b.groupBy("set_id", "in_bag").agg(F.count("*").alias("n"), F.sum("obs_id").alias("ids"))


@query
def min_obs_filter(spark, d):
    b = sa.bagged(fx.members(spark, d), "set_id", "obs_id", least=200)
    return b.groupBy("set_id").agg(F.sum("in_bag").alias("n_bag"), F.count("*").alias("n"))


@query
def strata_proportional(spark, d):
    s = sa.proportional_sizes(sa.strata_counts(fx.pixels(spark, d), "truth", TENTHS), 500, 2.0)
    return s.select("bin", "n_bin", r("share").alias("share"), r("size").alias("size"))


@query
def strata_equal(spark, d):
    bins = [(-1, 0), *[(k, k + 20) for k in range(0, 100, 20)]]
    return sa.equal_sizes(sa.strata_counts(fx.pixels(spark, d), "truth", bins), 600, bins, 2).select("bin", "n_bin", r("size").alias("size"))


@query
def stratified_sample(spark, d):
    p = fx.pixels(spark, d).withColumn("tile", F.floor(F.col("px_col") / 25).cast("int"))
    sizes = sa.strata_counts(p, "truth", TENTHS, ["tile"]).select("tile", "bin", F.lit(7).alias("size"))
    return sa.drawn(p, sizes, "truth", TENTHS, PIXEL, ["tile"]).select(*PIXEL, "tile", "bin", "truth")


@query
def stratified_minmax(spark, d):
    s = sa.proportional_sizes(sa.strata_counts(fx.pixels(spark, d), "truth", TENTHS), 500)
    return sa.within_limits(s, 500, 30, 60).select("bin", F.col("size").cast("long").alias("size"))


@query
def zone_holdout(spark, d):
    p = fx.pixels(spark, d)
    z = sa.zone_split(p, "zone", 0.7)
    return p.join(z, "zone").groupBy("is_train").agg(F.count("*").alias("n"), F.sum("truth").alias("total"))


@query
def random_pixels(spark, d):
    return sa.simple_random(fx.pixels(spark, d), 200, PIXEL).select(*PIXEL, "truth")


@query
def balanced_trials(spark, d):
    p = fx.pixels(spark, d).withColumn("cell", F.floor(F.col("px_col") / 20).cast("int")).withColumn("pid", F.col("px_row") * 100 + F.col("px_col"))
    t = sa.balanced_trials(p, 10, 5, "cell", "pid")
    return t.groupBy("trial").agg(F.count("*").alias("n"), r(ev.rmse("truth", "pred")).alias("rmse"), F.sum("pid").alias("ids"))


@query
def tile_quota(spark, d):
    return sa.tile_quota(_tiles(spark, d).withColumnRenamed("n", "area"), 1000).select("tile_id", r("pct_area", 6).alias("pct_area"), F.col("n_sample").cast("long").alias("n_sample"))


@query
def psu_min_distance(spark, d):
    s = fx.sets(spark, d).selectExpr("CAST(set_id AS LONG) AS tile_id", "CAST(set_id % 4 AS STRING) AS stratum", "1.0D + set_id % 3 AS area", "CAST(ctr_x AS DOUBLE) AS x", "CAST(ctr_y AS DOUBLE) AS y")
    return joins.picked_apart(s, 12, 500)


# ensembles


def _stat(name: str):
    def f(spark, d):
        return en.ensemble(fx.predictions(spark, d), PIXEL, "v", [name])

    f.__name__ = f"ensemble_{name}"
    return query(f)


for _name in ("mean", "median", "stdv", "vote", "count"):
    _stat(_name)


@query
def ensemble_all(spark, d):
    return en.ensemble(fx.predictions(spark, d), PIXEL, "v", ["mean", "median", "stdv", "vote", "count"])


@query
def ensemble_pct_vote(spark, d):
    return en.vote_share(fx.predictions(spark, d), PIXEL, "v")


@query
def gaussian_mean(spark, d):
    return en.gaussian_mean(fx.predictions(spark, d), PIXEL, "v", "truth")


@query
def partial_ranges(spark, d):
    p = fx.predictions(spark, d).withColumn("tile", F.floor(F.col("px_row") / 5) * 4 + F.floor(F.col("px_col") / 25))
    return en.partial_ranges(p, ["tile"], "v")


@query
def oob_map(spark, d):
    s = fx.sets(spark, d).withColumn("oob_rate", (F.col("set_id") * 7) % 101)
    return en.metric_map(fx.pixel_sets(spark, d), s, PIXEL, "oob_rate")


def _importance(spark, d):
    s = fx.sets(spark, d)
    return s.select("set_id", F.explode(F.array(*[F.struct(F.lit(f).alias("variable"), ((F.col("set_id") * (7 * k + 3)) % 100 / 100.0).alias("importance")) for k, f in enumerate(FEATURES)])).alias("i")).select("set_id", "i.*")


@query
def importance_share_rank(spark, d):
    i = _importance(spark, d).withColumn("importance", F.round(F.col("importance") * 100).cast("long"))
    return en.importance_ranks(i).select("variable", r("pct_importance").alias("pct_importance"), "rank")


@query
def importance_map(spark, d):
    i = _importance(spark, d).withColumn("importance", F.col("importance") + 0.001)
    return en.importance_map(fx.pixel_sets(spark, d), i, PIXEL)


@query
def max_importance(spark, d):
    return model.most_important(_importance(spark, d))


# evaluation


@query
def map_errors(spark, d):
    p = fx.pixels(spark, d)
    return p.agg(r(ev.rmse("pred", "truth")).alias("rmse"), r(ev.rmspe("truth", "pred")).alias("rmspe"), r(ev.mae("pred", "truth")).alias("mae"), r(ev.r2("truth", "pred")).alias("r2"))


@query
def agree_coef(spark, d):
    return ev.agreement(fx.pixels(spark, d), "truth", "pred").select(*[r(c).alias(c) for c in ("ac", "ac_s", "ac_u")], r("ssd", 0).alias("ssd"))


@query
def lc_eval(spark, d):
    p = fx.pixels(spark, d).filter("zone <> 0")
    a = ev.agreement(p, "truth", "pred", ["zone"])
    return a.join(p.groupBy("zone").agg(ev.rmspe("truth", "pred").alias("rmspe")), "zone").select("zone", r("ac").alias("ac"), r("ac_s").alias("ac_s"), r("ac_u").alias("ac_u"), r("rmspe").alias("rmspe"))


@query
def bin_agreement(spark, d):
    p = fx.pixels(spark, d).withColumn("b", F.floor(F.col("truth") / 10)).filter("b = floor(pred / 10)")
    return ev.agreement(p, "truth", "pred", ["b"]).select("b", r("ssd", 0).alias("ssd"), r("ac").alias("ac"))


@query
def confusion_counts(spark, d):
    return ev.confusion_counts(fx.pixels(spark, d), "pred", "truth", TENTHS)


def _cells(spark, d, by=()):
    p = fx.pixels(spark, d)
    return ev.adjusted(ev.confusion_counts(p, "pred", "truth", TENTHS, by), ev.area_weights(p, "pred", TENTHS, by), by)


@query
def confusion_area_adjusted(spark, d):
    return _cells(spark, d).select("p_bin", "t_bin", "n", "n_i", r("p", 6).alias("p"))


@query
def users_producers(spark, d):
    return ev.class_accuracies(_cells(spark, d)).select("class", r("user").alias("user"), r("producer").alias("producer"))


@query
def kappa(spark, d):
    return ev.overall(_cells(spark, d)).select(r("accuracy").alias("accuracy"), r("kappa").alias("kappa"))


@query
def accuracy_ci(spark, d):
    return ev.intervals(_cells(spark, d)).select("class", r("user_ci").alias("user_ci"), r("producer_ci").alias("producer_ci"), r("overall_ci").alias("overall_ci"))


@query
def disagreement(spark, d):
    return ev.disagreement(_cells(spark, d)).select(r("quantity").alias("quantity"), r("allocation").alias("allocation"))


@query
def region_eval(spark, d):
    e = fx.pixels(spark, d).groupBy("region").agg(ev.rmse("pred", "truth").alias("rmse"))
    return ev.overall(_cells(spark, d, ["region"]), ["region"]).join(e, "region").select("region", r("accuracy").alias("accuracy"), r("kappa").alias("kappa"), r("rmse").alias("rmse"))


@query
def area_weighted_rmse(spark, d):
    p = fx.pixels(spark, d)
    return ev.area_weighted_rmse(p, "pred", "truth", TENTHS, ev.area_weights(p, "pred", TENTHS)).select(r("area_weighted_rmse").alias("area_weighted_rmse"))


@query
def zonal_stats(spark, d):
    p = fx.pixels(spark, d).withColumn("v", F.expr("nullif(truth, 0)"))
    return ev.zonal(p, "zone", {"n": F.count("v"), "mean": r(F.avg("v")), "stdv": r(numeric.pop_std("v")), "low": F.min("v"), "high": F.max("v")})


@query
def auc_rank(spark, d):
    p = fx.pixels(spark, d).withColumn("pos", (F.col("truth") > 50).cast("int"))
    return ev.auc(p, "pred", "pos", ["zone"]).select("zone", r("auc").alias("auc"), "n_pos", "n_neg")


@query
def brier(spark, d):
    return fx.pixels(spark, d).agg(r(ev.brier(F.expr("CASE WHEN truth > 50 THEN 1 ELSE 0 END"), F.col("pred") / 100.0)).alias("brier"))


@query
def cdf(spark, d):
    return ev.cdf(fx.pixels(spark, d), "truth", 5)


@query
def hist2d(spark, d):
    return ev.histogram_2d(fx.pixels(spark, d), "truth", "pred", 10)


@query
def obs_per_class(spark, d):
    return fx.samples(spark, d).groupBy("target_class", "yr").agg(F.sum((F.col("target") % 2 == 1).cast("int")).alias("n_pos"), F.sum((F.col("target") % 2 == 0).cast("int")).alias("n_neg"))


# focal


@query
def row_stats_continuous(spark, d):
    p = fx.pixels(spark, d).withColumn("v0", F.expr("nullif(truth, 50)"))
    return fo.focal(p, "v0", fo.square(3), {k: r(c) for k, c in fo.continuous_stats().items()}, "px_row", "px_col")


@query
def row_stats_discrete(spark, d):
    near = fo.neighbours(fx.pixels(spark, d).withColumn("c", F.floor(F.col("truth") / 20).cast("int")), "c", fo.square(3), "px_row", "px_col")
    inside = near.join(fx.pixels(spark, d).select(*PIXEL), PIXEL)
    c = inside.groupBy(*PIXEL, "v").agg(F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy(*PIXEL).orderBy(F.desc("n"), "v"))
    return c.withColumn("k", best).filter("k = 1").select(*PIXEL, F.col("v").alias("mode"), "n")


@query
def focal_mean_square(spark, d):
    return fo.focal(fx.pixels(spark, d), "truth", fo.square(3), {"n": F.count("v"), "mean": r(F.avg("v"))}, "px_row", "px_col")


@query
def focal_mean_circle(spark, d):
    return fo.focal(fx.pixels(spark, d), "truth", fo.circle(5), {"n": F.count("v"), "mean": r(F.avg("v"))}, "px_row", "px_col")


@query
def focal_mode(spark, d):
    p = fx.pixels(spark, d).withColumn("c", F.floor(F.col("truth") / 10).cast("int"))
    return fo.focal(p, "c", fo.square(3), {"mode": F.mode("v", True)}, "px_row", "px_col")


@query
def focal_area_pct(spark, d):
    p = fx.pixels(spark, d).withColumn("c", (F.col("truth") > 40).cast("int"))
    return fo.focal(p, "c", fo.square(5), {"pct": r(fo.share_nonzero())}, "px_row", "px_col")


@query
def focal_equal(spark, d):
    p = fx.pixels(spark, d).withColumn("c", F.floor(F.col("truth") / 50).cast("int"))
    return fo.focal(p, "c", fo.square(3), {"equal": fo.all_equal_centre("v", F.when(F.col("k") == 4, F.col("v")))}, "px_row", "px_col")


@query
def focal_reflect(spark, d):
    p = fx.pixels(spark, d)
    last = F.broadcast(p.agg(F.max("px_row").alias("last")))
    near = fo.neighbours(p.join(last).withColumn("v0", F.struct("truth", "last")), "v0", fo.square(3), "px_row", "px_col", (F.col("v.last"), F.lit(99)))
    return near.groupBy(*PIXEL).agg(F.count("*").alias("n"), F.sum("v.truth").alias("total"))


@query
def best_match_3x3(spark, d):
    p = fx.pixels(spark, d).withColumn("t", F.expr("nullif(truth, 50)"))
    return fo.best_match(p, p, "pred", "t", "px_row", "px_col").select("px_row", "px_col", "pred", F.col("match"))


# models


@query
def best_split(spark, d):
    return model.best_splits(fx.members(spark, d), "set_id", FEATURES, "target")


def _bag(spark, d):
    return sa.bagged(fx.members(spark, d), "set_id", "obs_id")


@query
def train_sets(spark, d):
    return model.train_sets(_bag(spark, d), FEATURES, "target", share=0.02)


@query
def predict_sets(spark, d):
    b = _bag(spark, d)
    nodes = model.train_sets(b, FEATURES, "target", share=0.02)
    return model.predict_nodes(b.filter("in_bag = 0"), nodes, FEATURES, ["obs_id", "target"])


@query
def oob_trained(spark, d):
    return model.oob_metrics(predict_sets(spark, d), "target")


@query
def oob_metrics(spark, d):
    p = fx.predictions(spark, d).withColumnRenamed("v", "prediction")
    return model.oob_metrics(p, "truth")


@query
def oob_kappa(spark, d):
    p = fx.predictions(spark, d).select("set_id", F.floor(F.col("truth") / 20).alias("t"), F.floor(F.col("v") / 20).alias("prediction"))
    return model.oob_metrics(p, "t", "classifier").select("set_id", "oob_rate", r("oob_kappa").alias("oob_kappa"))


@query
def oob_drop(spark, d):
    s = fx.sets(spark, d).withColumn("oob_rate", (F.col("set_id") * 7) % 101).select("set_id", "oob_rate")
    return model.without(s, "oob_rate >= 50", ["oob_rate"])


@query
def important_features(spark, d):
    s = fx.samples(spark, d).select(F.col("target_class").alias("class"), F.when(F.col("f_size") > 25, "f_size").when(F.col("f_tax") > 0.04, "f_tax").otherwise("f_disc").alias("feature"), F.col("target").cast("long").alias("n"))
    return model.feature_of_class(s)


@query
def forest_vote(spark, d):
    return model.forest_votes(fx.samples(spark, d), FEATURES, "target_class", 8, max_features=3)


@query
def ntrees_curve(spark, d):
    p = fx.predictions(spark, d).select((F.col("set_id") - 1).alias("set_id"), (F.col("px_row") * 100 + F.col("px_col")).alias("obs_id"), F.floor(F.col("truth") / 25).alias("t"), F.floor(F.col("v") / 25).alias("prediction"))
    return model.error_by_trees(p, "t").select("n_trees", r("error").alias("error"))


@query
def forest_mllib(spark, d):
    return model.mllib_forest(fx.samples(spark, d), FEATURES, "target_class").select("obs_id", "target_class", "prediction")


# from samples to a map


MAP_FEATURES = ["p_pred", "p_region", "p_year", "p_zone"]


def _predictors(spark, d) -> DataFrame:
    """Pixels with three predictors, one of them with nodata, and a constant one."""
    p = fx.pixels(spark, d).select(*PIXEL, "x", "y", "truth", F.when(F.col("pred") == 50, -9999).otherwise(F.col("pred")).alias("p_pred"), F.col("region").alias("p_region"), F.col("zone").alias("p_zone"))
    return joins.with_constants(p, {"p_year": 2001})


def _map_samples(spark, d) -> DataFrame:
    """Members of every set with the predictors of their pixels, in and out of bag."""
    m = grid.row_col(fx.members(spark, d).select("set_id", "obs_id", "x", "y"), 0, 0, 30, -30).select("set_id", "obs_id", F.col("row").alias("px_row"), F.col("col").alias("px_col"))
    rows = m.join(joins.predictable(_predictors(spark, d), MAP_FEATURES).drop("x", "y"), PIXEL)
    return sa.bagged(rows, "set_id", "obs_id")


def _map_rows(spark, d) -> DataFrame:
    """Every pixel that can be predicted, with each set around it."""
    return joins.points_in_rectangles(joins.predictable(_predictors(spark, d), MAP_FEATURES), fx.sets(spark, d), fx.BIN).select("set_id", *PIXEL, "truth", *MAP_FEATURES)


def _map_stumps(spark, d) -> DataFrame:
    return model.stumps(_map_samples(spark, d).filter("in_bag = 1"), "set_id", MAP_FEATURES, "truth")


@query
def stumps(spark, d):
    return _map_stumps(spark, d).select("set_id", "feature", "threshold", "left", "right", "n")


@query
def map_from_stumps(spark, d):
    p = model.predict_stumps(_map_rows(spark, d), _map_stumps(spark, d), MAP_FEATURES)
    return en.ensemble(p, PIXEL, "prediction", ["mean", "median", "stdv", "vote", "count"])


@query
def oob_map_from_stumps(spark, d):
    b = _map_samples(spark, d)
    p = model.predict_stumps(b.filter("in_bag = 0"), model.stumps(b.filter("in_bag = 1"), "set_id", MAP_FEATURES, "truth"), MAP_FEATURES)
    return en.metric_map(_map_rows(spark, d), model.oob_metrics(p, "truth"), PIXEL, "oob_rmse")


@query
def map_from_trees(spark, d):
    nodes = model.train_sets(_map_samples(spark, d), MAP_FEATURES, "truth")
    p = model.predict_nodes(_map_rows(spark, d), nodes, MAP_FEATURES, PIXEL)
    return en.ensemble(p.withColumn("v", numeric.half_even("prediction").cast("int")), PIXEL, "v", ["mean", "median", "stdv", "vote", "count"])


@query
def tile_lookup(spark, d):
    p = fx.pixels(spark, d)
    tiles = p.select(F.col("px_row").alias("row"), F.col("px_col").alias("col"), (F.floor(F.col("px_row") / 5) * 4 + F.floor(F.col("px_col") / 25)).alias("tile_id"))
    return joins.tile_lookup(grid.row_col(fx.samples(spark, d), 0, 0, 30, -30).select("obs_id", "row", "col"), tiles).select("obs_id", "tile")


@query
def complete_tiles(spark, d):
    every = _tiles(spark, d).select("tile_id", F.lit("cover").alias("variable"))
    return joins.complete_tiles(every.unionByName(_pixel_tiles(spark, d, 98).withColumn("variable", F.lit("bright"))), ["cover", "bright"])


@query
def test_pixels(spark, d):
    train = grid.row_col(fx.samples(spark, d).filter("target_class <> 3"), 0, 0, 30, -30).select(F.col("row").alias("px_row"), F.col("col").alias("px_col"))
    return sa.simple_random(joins.outside(fx.pixels(spark, d), train, PIXEL, "truth", 0), 100, PIXEL).select(*PIXEL, "truth")


@query
def kernel_at_samples(spark, d):
    s = grid.row_col(fx.samples(spark, d), 0, 0, 30, -30).select("obs_id", F.col("row").alias("px_row"), F.col("col").alias("px_col"))
    p = fx.pixels(spark, d).withColumn("v0", F.expr("nullif(truth, 50)"))
    return joins.kernel_at(s, p, "v0", fo.square(3), {k: r(c) for k, c in fo.continuous_stats().items()}, "obs_id", PIXEL)


@query
def equal_allocation(spark, d):
    return sa.equal_allocation(fx.pixels(spark, d), "truth", TENTHS, 305, PIXEL).select(*PIXEL, "bin", "truth")


@query
def zone_samples(spark, d):
    return sa.zone_samples(fx.pixels(spark, d), "zone", 0, 200, 0.7, PIXEL, 1.5).select(*PIXEL, "is_train", "value")


@query
def whole_bag(spark, d):
    return sa.bag_of_all(fx.samples(spark, d), "obs_id").groupBy("in_bag").agg(F.count("*").alias("n"), F.sum("obs_id").alias("ids"), F.sum("target").alias("total"))


def _rated(spark, d) -> DataFrame:
    return fx.sets(spark, d).select("set_id", F.when(F.col("set_id") % 3 == 0, F.col("set_id") % 90).alias("oob_rate"))


@query
def oob_attach(spark, d):
    p = fx.predictions(spark, d).withColumnRenamed("v", "prediction")
    return model.without(model.with_rates(_rated(spark, d), model.oob_metrics(p, "truth")), "oob_rate < 92", ["oob_rate", "oob_rmse"])


@query
def combo_metrics(spark, d):
    s = fx.sets(spark, d).select("set_id", ((F.col("set_id") * 7) % 101).alias("oob_rate"), (F.col("set_id") % 5).alias("feature"))
    return en.combination_metrics(fx.pixel_sets(spark, d), s, PIXEL, "oob_rate", "feature")


@query
def stitched_map(spark, d):
    p = fx.predictions(spark, d).withColumn("part", F.col("set_id") % 4)
    return en.stitched(en.partial_sums(p, ["part", *PIXEL], "v"), PIXEL)


@query
def trial_metrics(spark, d):
    p = fx.pixels(spark, d).withColumn("cell", F.floor(F.col("px_col") / 20).cast("int")).withColumn("pid", F.col("px_row") * 100 + F.col("px_col")).withColumn("pos", (F.col("truth") > 50).cast("int"))
    t = ev.trial_metrics(sa.balanced_trials(p, 10, 12, "cell", "pid"), "truth", "pred", "pos")
    return t.select("trial", *[r(c).alias(c) for c in ("auc", "ac", "r2", "rmse", "rmse_pm")])


@query
def trial_spread(spark, d):
    p = fx.pixels(spark, d).withColumn("cell", F.floor(F.col("px_col") / 20).cast("int")).withColumn("pid", F.col("px_row") * 100 + F.col("px_col")).withColumn("pos", (F.col("truth") > 50).cast("int"))
    t = ev.trial_metrics(sa.balanced_trials(p, 10, 12, "cell", "pid"), "truth", "pred", "pos")
    return ev.spread(t, ["auc", "rmse"]).select("metric", r("mean").alias("mean"), r("pm").alias("pm"))


@query
def importance_by_kind(spark, d):
    i = _importance(spark, d).select((F.col("set_id") % 4).alias("model"), "variable", F.round(F.col("importance") * 100).cast("long").alias("importance"))
    return model.importance_by_kind(i, ["f_size", "f_tax"]).select("model", r("constant").alias("constant"), r("yearly").alias("yearly"))


@query
def stats_slice(spark, d):
    e = fx.pixels(spark, d).groupBy("zone", "region").agg(r(ev.rmse("pred", "truth")).alias("value")).withColumn("metric", F.lit("rmse")).withColumn("region", F.concat(F.lit("r"), F.col("region").cast("string")))
    return ev.stats_slice(e, "zone", "region", [f"r{k}" for k in range(5)], "rmse")


@query
def kernel_means(spark, d):
    p = fx.pixels(spark, d).select(*PIXEL, F.expr("nullif(pred, 40)").alias("p"), F.expr("nullif(truth, 50)").alias("t"))
    return fo.kernel_means(p.select(*PIXEL, "p"), p.select(*PIXEL, "t"), "p", "t", "px_row", "px_col")


@query
def features_with_stats(spark, d):
    f = _tiles(spark, d).select(F.col("tile_id").alias("fid"), "tx1", "ty1")
    stats = fx.pixels(spark, d).filter("truth > 60").groupBy((F.floor(F.col("px_row") / 5) * 4 + F.floor(F.col("px_col") / 25)).alias("fid")).agg(F.count("*").alias("n"), F.max("pred").alias("high"))
    return joins.with_attributes(f, stats)


@query
def predictions_of_tile(spark, d):
    return joins.clipped(fx.predictions(spark, d), (5, 25), (5, 25), PIXEL).select("set_id", *PIXEL, "v")


@query
def vector_transform(spark, d):
    return grid.vector_transform(fx.sets(spark, d), (30, -30), CORNERS, (7, 11))


@query
def attribute_raster(spark, d):
    rings = [(k + 1, [(x + 450.0 * k, float(y)) for x, y in HEXAGON]) for k in range(4)]
    polygons = spark.createDataFrame(rings, "name int, ring array<struct<x: double, y: double>>")
    return joins.attribute_raster(fx.pixels(spark, d), polygons, fx.BIN, "name", 0, PIXEL).select(*PIXEL, "name")


@query
def zone_metadata(spark, d):
    zones = fx.read(spark, d, "nation").select(F.col("n_nationkey").alias("fid"), F.col("n_name").alias("name"))
    meta = fx.read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("fid")).agg(F.max("c_name").alias("last")).select("fid", texts.accuracy("last").alias("accuracy"))
    return joins.with_attributes(zones, meta)


@query
def valid_rmse(spark, d):
    return fx.pixels(spark, d).groupBy("region").agg(r(ev.valid_rmse("pred", "truth", 20, 50)).alias("rmse"))


@query
def tile_offsets(spark, d):
    row, column = grid.offset((F.lit(15), F.lit(-15)), (F.col("ul_x"), F.col("ul_y")), (30, -30))
    return fx.sets(spark, d).select("set_id", row.alias("row"), column.alias("col"))


@query
def oob_per_set_agreement(spark, d):
    """Reference against out-of-bag prediction of the sets with a low rate: RMSE and agreement of each."""
    p = fx.predictions(spark, d)
    low = model.oob_metrics(p.withColumnRenamed("v", "prediction"), "truth").filter("oob_rate < 92").select("set_id")
    own = p.join(low, "set_id")
    e = own.groupBy("set_id").agg(r(ev.rmse("truth", "v")).alias("rmse"))
    return ev.agreement(own, "truth", "v", ["set_id"]).select("set_id", r("ac").alias("ac")).join(e, "set_id")
