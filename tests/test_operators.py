"""Operators on hand-made rasters, sets and parameter files, where the result can be told by eye."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataweave.functions import geometry, numeric, texts
from strataweave.operators import ensemble, evaluate, focal, grid, joins, model, sampling
from strataweave.sources import params, tables


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_remainder_has_the_divisors_sign(spark):
    assert one(spark, numeric.floor_mod(F.lit(3187125), F.lit(-30))) == -15


def test_rounding_rules(spark):
    assert [one(spark, numeric.half_even(F.lit(x))) for x in (0.5, 1.5, 2.5)] == [0, 2, 2]
    assert [one(spark, numeric.half_away(F.lit(x))) for x in (2.5, -2.5)] == [3, -3]
    assert one(spark, numeric.truncated(F.lit(-2.7))) == -2


def test_votes_tie_to_the_smallest_and_means_round_to_even(spark):
    rows = [(0, 0, 5), (0, 0, 3), (0, 1, 1), (0, 1, 2), (0, 1, 3), (1, 0, 2), (1, 0, 3), (1, 1, None)]
    df = spark.createDataFrame(rows, "r int, c int, v int")
    got = {(x.r, x.c): x for x in ensemble.ensemble(df, ["r", "c"], "v", ["mean", "vote", "count", "median"]).collect()}
    assert (got[0, 0].vote, got[0, 1].vote, got[1, 0].vote) == (3, 1, 2)
    assert (got[1, 0].mean, got[1, 0].median) == (2, 2)
    assert (got[1, 1].mean, got[1, 1].count) == (None, 0) or got[1, 1]["count"] == 0


def test_points_on_an_edge_are_outside(spark):
    points = spark.createDataFrame([(1, 0, 5), (2, 5, 5), (3, 10, 5), (4, 5, 10)], "id int, x int, y int")
    rects = spark.createDataFrame([(7, 0, 10, 10, 0)], "set_id int, ul_x int, ul_y int, lr_x int, lr_y int")
    assert [r.id for r in joins.points_in_rectangles(points, rects, 3).collect()] == [2]


def test_touching_rectangles_do_not_overlap(spark):
    c = ["ul_x", "ul_y", "lr_x", "lr_y"]
    a = spark.createDataFrame([(0, 10, 10, 0)], "ul_x int, ul_y int, lr_x int, lr_y int")
    b = spark.createDataFrame([(1, 10, 10, 20, 0), (2, 9, 11, 20, 9)], "id int, bx1 int, by1 int, bx2 int, by2 int")
    got = joins.overlapping(a, b, 4, c, ["bx1", "by1", "bx2", "by2"]).collect()
    assert [(r.id, r.area) for r in got] == [(2, 1)]


def test_polygon_vertices_and_boundaries_are_inside(spark):
    ring = [(0, 0), (10, 0), (10, 10), (0, 10)]
    points = spark.createDataFrame([(0, 0), (5, 0), (5, 5), (11, 5), (-1, 0)], "x int, y int")
    want = [True, True, True, False, False]
    assert [r.v for r in points.select(geometry.inside("x", "y", ring).alias("v")).collect()] == want
    shape = spark.createDataFrame([([(float(x), float(y)) for x, y in ring],)], "ring array<struct<x: double, y: double>>")
    got = points.join(shape).select("x", "y", geometry.inside_array("x", "y", "ring").alias("v")).collect()
    assert [r.v for r in got] == want


def test_bags_need_enough_samples(spark):
    for n, kept in ((15, False), (16, True)):  # floor(0.63 n) is 9, 10
        df = spark.range(n).select(F.lit(1).alias("set_id"), F.col("id").alias("obs_id"))
        got = sampling.bagged(df, "set_id", "obs_id", least=10).collect()
        assert bool(got) == kept
        if kept:
            assert sum(r.in_bag for r in got) == 10 and len({r.obs_id for r in got}) == 16


def test_whole_locations_fall_on_one_side(spark):
    df = spark.range(1000).select((F.col("id") % 50).alias("row"), (F.col("id") % 10).alias("col"))
    got = sampling.split_by_location(df, 0.8).groupBy("row", "col").agg(F.countDistinct("is_train").alias("n")).collect()
    assert all(r.n == 1 for r in got)


def test_adjusted_shares_sum_to_one_and_unpredicted_bins_go(spark):
    bins = [(-1, 10), (10, 20), (20, 30)]
    rows = [(5, 5)] * 6 + [(5, 15)] * 2 + [(15, 15)] * 4 + [(15, 25)]
    df = spark.createDataFrame(rows, "p int, t int")
    cells = evaluate.adjusted(evaluate.confusion_counts(df, "p", "t", bins), evaluate.area_weights(df, "p", bins))
    got = {(r.p_bin, r.t_bin): r for r in cells.collect()}
    assert set(got) == {(0, 0), (0, 1), (1, 1)}
    assert sum(r.p for r in got.values()) == pytest.approx(1)


def test_best_match_takes_the_first_of_equals(spark):
    truth = spark.createDataFrame([(0, 0, 4), (0, 1, 6), (1, 1, None)], "row int, col int, t int")
    pred = spark.createDataFrame([(1, 1, 5), (9, 9, 5)], "row int, col int, p int")
    got = focal.best_match(pred, truth, "p", "t").collect()
    assert [(r.row, r.col, r.match) for r in got] == [(1, 1, 4)]


def test_circle_and_square_kernels():
    assert len(focal.square(3)) == 9 and len(focal.circle(3)) == 5 and len(focal.circle(5)) == 13


def test_trees_split_where_the_error_falls_most():
    x = np.array([[0, 1], [0, 2], [0, 3], [0, 4]], float)
    nodes = model.grow_tree(x, np.array([1.0, 1, 5, 5]))
    assert nodes[0][1:3] == (1, 2.5) and len(nodes) == 3
    classes = model.grow_tree(x, np.array([2, 2, 1, 1]), "classifier")
    assert {n[5] for n in classes if n[1] < 0} == {1.0, 2.0}


def test_splits_try_as_many_predictors_as_asked_for():
    assert [model.features_tried(w, 9) for w in (None, 0.5, 4, "sqrt", "log2", 0.01, 40)] == [9, 4, 4, 3, 3, 1, 9]
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(200, 4)), rng.normal(size=200)
    one = [model.grow_tree(x, y, depth=1, max_features=1, seed=s)[0][1] for s in range(40)]
    assert set(one) == {0, 1, 2, 3} and model.grow_tree(x, y, max_features=2, seed=3) == model.grow_tree(x, y, max_features=2, seed=3)
    assert model.grow_tree(x, y, max_features=4) == model.grow_tree(x, y)


def test_drop_expressions(spark):
    sets = spark.createDataFrame([(1, 49), (2, 50), (3, None)], "set_id int, oob_rate int")
    assert {r.set_id for r in model.without(sets, "oob_rate >= 50", ["oob_rate"]).collect()} == {1, 3}
    assert model.without(sets, None, ["oob_rate"]).count() == 3
    for bad in ("oob_rate >> 5", "other < 5", "oob_rate < x"):
        with pytest.raises(ValueError):
            model.drop_condition(bad, ["oob_rate"])


def test_tiles_reach_the_edge(spark):
    t = grid.tiles(spark, (2, 3), 11, 10).collect()
    assert sum((r.lr_r - r.ul_r) * (r.lr_c - r.ul_c) for r in t) == 110
    assert one(spark, grid.tile_of(F.lit(10), F.lit(9), (2, 3), 11, 10)) == 5


def test_cells_cover_the_bounds(spark):
    cells = grid.place_grid(spark, (900, 1500), (0, -4500, 2970, 0), (30, -30), (411, -1000)).collect()
    for x, y in ((0, -4500), (2970, 0), (0, 0), (2970, -4500)):
        assert any(c.ul_x <= x <= c.lr_x and c.lr_y <= y <= c.ul_y for c in cells)


def test_parameter_files(tmp_path):
    found, rows = params.parse("Title\nvar\tband\nelev\t1\nn_jobs; 4\nname; \"a b\"\nno; two; here\n")
    assert found == {"n_jobs": "4", "name": "a b"} and rows == [["var", "band"], ["elev", "1"]]
    assert params.bins("-1:10, 10:20") == [(-1, 10), (10, 20)] and params.constants("K:1, L:2") == {"K": 1, "L": 2}
    assert [params.max_features(x) for x in ("0.5", "3", "sqrt")] == [0.5, 3, "sqrt"]
    params.write(str(tmp_path / "p.txt"), {"a": "1"}, "T")
    assert params.read(str(tmp_path / "p.txt")) == {"a": "1"}
    with pytest.raises(ValueError):
        params.check_variables(["slope"], ["elev"])


def test_rasters_are_written_and_read_by_window(spark, tmp_path):
    df = spark.createDataFrame([("0001", 0, 0, 1.0), ("0001", 0, 1, None), ("0002", 1, 0, 3.0)], tables.RASTER)
    path = str(tmp_path / "r")
    tables.write_raster(df, path, -9999)
    assert {(r.row, r.col, r.value) for r in tables.raster(spark, path, rows=(0, 1), nodata=-9999).collect()} == {(0, 0, 1.0), (0, 1, None)}
    window = tables.window(spark, tables.raster(spark, path), (0, 2), (0, 2), 0)
    assert window.count() == 4 and window.agg(F.sum("value")).first()[0] == 1 - 9999 + 3


def test_numbers_in_texts(spark):
    df = spark.createDataFrame([("Error 5 %",), ("0.9",), ("none",), ("80 and 90",)], "t string")
    assert [r.v for r in df.select(texts.accuracy("t").alias("v")).collect()] == [95.0, 90.0, 0.0, 85.0]


def test_streamed_tiles_resume(spark, tmp_path):
    from strataweave.streaming import tiles

    schema = "tile_id int, row int, col int, set_id int, v int"
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for k in range(2):
        spark.createDataFrame([(k, 0, 0, s, s + k) for s in range(3)], schema).coalesce(1).write.mode("append").parquet(source)
        tiles.ensemble_stream(spark, source, schema, sink, mark, ["mean", "count"]).awaitTermination()
    got = spark.read.parquet(sink)
    assert sorted((r.tile_id, r.mean, r["count"]) for r in got.collect()) == [(0, 1, 3), (1, 2, 3)]
    assert tiles.unfinished(spark.range(3).withColumnRenamed("id", "tile_id"), got).collect()[0].tile_id == 2


def test_row_ids_number_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), (F.col("id") % 7).alias("j"))
    got = numeric.row_ids(df, "k", ["k", "j"], "n", buckets=16).orderBy("n").collect()
    assert [r.n for r in got] == list(range(1000)) and [r.k for r in got] == sorted(r.k for r in got)


def test_bags_and_seeds_are_independent(spark):
    members = spark.range(2000).select(F.col("id").alias("obs_id"), F.explode(F.sequence(F.lit(1), F.lit(60))).alias("set_id"))
    for column, other in ((numeric.shuffled(1, "obs_id", "set_id"), "set_id"), (numeric.shuffled(1, "set_id", "obs_id"), "set_id")):
        pdf = members.select("obs_id", other, column.alias("k")).toPandas()
        bags = np.array([(g.sort_values(["k", "obs_id"]).obs_id.to_numpy()[:1260, None] == np.arange(2000)).any(0) for _, g in pdf.groupby(other)], float)
        spread = np.corrcoef(bags)[np.triu_indices(60, 1)]
        assert spread.std() < 0.03 and abs(spread).max() < 0.12  # independent draws: 0.022, about 0.08
    seeds = spark.range(2000).select("id", *[numeric.shuffled(s, "id").alias(f"s{s}") for s in range(30)]).toPandas()
    ranks = seeds.drop(columns="id").rank().corr().to_numpy()[np.triu_indices(30, 1)]
    assert abs(ranks).max() < 0.1


def test_centres_are_drawn_without_replacement_on_both_axes(spark):
    cells = spark.createDataFrame([(c, 0, 0, 50, -50) for c in range(40)], "cell_id long, ul_x long, ul_y long, lr_x long, lr_y long")
    sets = grid.sets_in_cells(cells, 24, (10, 10), (1, -1), (0, 0)).toPandas()
    for _, g in sets.groupby("cell_id"):
        assert g.ctr_x.nunique() == 24 and g.ctr_y.nunique() == 24
    assert abs(np.corrcoef(sets.ctr_x, sets.ctr_y)[0, 1]) < 0.15 and sets.ctr_x.nunique() > 45
    assert len({(y - x) % 50 for x, y in zip(sets.ctr_x, sets.ctr_y)}) > 40


def test_constant_groups_give_null(spark):
    df = spark.createDataFrame([(1, 5, 5), (1, 5, 5), (2, 1, 5), (2, 3, 5), (3, 1, 2), (3, 4, 5)], "g int, x int, y int")
    got = {r.g: r for r in evaluate.agreement(df, "x", "y", ["g"]).collect()}
    assert got[1].ac is None and got[2].ac_u is None and got[2].ac is not None and got[3].ac is not None
    assert df.filter("g = 2").agg(evaluate.r2("y", "x").alias("v")).first().v is None
    votes = spark.createDataFrame([(0, 0, 900, 0), (0, 1, 4, 4)], "r int, c int, v int, m int")
    assert {r.c: r.weighted_mean for r in ensemble.gaussian_mean(votes, ["r", "c"], "v", "m").collect()} == {0: None, 1: 4}
    empty = spark.createDataFrame([(1, None)], "g int, v int")
    assert empty.groupBy("g").agg(numeric.pop_std("v").alias("s")).first().s is None


def test_error_curve_equals_a_vote_for_every_number_of_trees(spark):
    rng = np.random.default_rng(3)
    rows = [(int(t), int(o), int(rng.integers(3)), int(o % 3)) for o in range(30) for t in range(12) if rng.random() < 0.6]
    got = {r.n_trees: r.error for r in model.error_by_trees(spark.createDataFrame(rows, "set_id int, obs_id int, prediction int, t int"), "t").collect()}
    for n, error in got.items():
        wrong = []
        for o in {r[1] for r in rows if r[0] < n}:
            own = [r[2] for r in rows if r[1] == o and r[0] < n]
            wrong.append(min(set(own), key=lambda c: (-own.count(c), c)) != o % 3)
        assert error == pytest.approx(np.mean(wrong))
    assert max(got) == 12


def test_models_are_written_and_read(spark, tmp_path):
    sets = spark.createDataFrame([(1, 5), (2, 7)], "set_id int, oob_rate int")
    nodes = spark.createDataFrame([(1, 0, "a", 1.5, 1, 2, 3.0, 4, 0.5)], model.NODES)
    bag = spark.createDataFrame([(1, 10, 1), (1, 11, 0), (2, 10, 1)], "set_id int, obs_id int, in_bag int")
    tables.write_model(sets, nodes, bag, str(tmp_path))
    got = tables.model(spark, str(tmp_path))
    assert [t.count() for t in got] == [2, 1, 3] and got[1].schema.simpleString() == nodes.schema.simpleString()
    assert [r.obs_id for r in tables.members(spark, str(tmp_path), 1, 0).collect()] == [11]


def test_text_tables(spark, tmp_path):
    tables.write_delimited(spark.createDataFrame([(1, 2, 3, 4, 5, 6)], tables.SAMPLE), str(tmp_path / "s"))
    assert tables.delimited(spark, str(tmp_path / "s"), tables.SAMPLE).first().target == 6
    (tmp_path / "ids.txt").write_text("3\n\n17\n")
    assert [r.id for r in tables.ids(spark, str(tmp_path / "ids.txt")).collect()] == [3, 17]
    (tmp_path / "meta.txt").write_text("name: x\nmean error: 12.5 percent\nmean error: 9\n")
    assert tables.metadata_value(spark, str(tmp_path / "meta.txt"), "mean error").first().value == "12.5 percent"
    spark.createDataFrame([(1, "a")], "fid int, name string").write.parquet(str(tmp_path / "layer"))
    assert tables.features(spark, str(tmp_path / "layer"), "fid int, name string").first().name == "a"
    with pytest.raises(ValueError):
        tables.features(spark, str(tmp_path / "layer"), "fid int").filter("false").write.parquet(str(tmp_path / "none"))
        tables.features(spark, str(tmp_path / "none"), "fid int")


def test_files_of_a_tile_are_found_by_pattern(spark, tmp_path):
    for tile in ("0012", "0345"):
        (tmp_path / tile).mkdir()
        for name in ("cover_2000.bsq", "cover_2001.bsq", "old_cover_2000.bsq", "slope.bsq"):
            (tmp_path / tile / name).write_bytes(b"x")
    found = tables.files(spark, str(tmp_path), "*.bsq")
    got = {r.tile_id: r.path.rsplit("/", 1)[1] for r in joins.first_match(found, "cover_20.*", without="old").collect()}
    assert got == {"0012": "cover_2000.bsq", "0345": "cover_2000.bsq"}


def test_parameter_files_are_written_for_models_filters_and_years(tmp_path):
    paths = params.confusion_params({"b": "/m/b", "a": "/m/a"}, "/t.bsq", str(tmp_path), "vote", {"bins": "-1:10"})
    assert [params.read(p)["p_path"] for p in paths] == ["/m/a/a_vote", "/m/b/b_vote"] and params.read(paths[0])["bins"] == "-1:10"
    paths = params.filter_params("/r_{0}.bsq", str(tmp_path), "area", 5, [2000, 2001], [1, 2])
    assert len(paths) == 4 and params.read(paths[3]) == {"path": "/r_2001.bsq", "function": "area", "kernel_size": "5", "out_path": f"{tmp_path}/area_2001_2", "filter_value": "2"}
    each = params.years({"agg_stats": "mean"}, 1990, 1992, [["cover", "-1"], ["slope", "1"]])
    assert [y["table"][0][1] for y in each] == [7, 8, 9] and each[0]["table"][1] == ["slope", "1"]


def test_corners_and_offsets(spark):
    assert one(spark, geometry.upper_left(3, 9, 30)) == 3 and one(spark, geometry.upper_left(3, 9, -30)) == 9
    row, column = grid.offset((0, 0), (F.lit(95), F.lit(-61)), (30, -30))
    assert (one(spark, row), one(spark, column)) == (2, 3)


def test_pixels_without_a_predictor_have_no_prediction(spark):
    df = joins.with_constants(spark.createDataFrame([(1, 5, 2), (2, -9999, 2), (3, 1, None)], "k int, a int, b int"), {"z": 7, "c": 1})
    assert df.columns == ["k", "a", "b", "c", "z"]
    assert [r.k for r in joins.predictable(df, ["a", "b", "c", "z"]).collect()] == [1]


def test_one_split_predicts_the_sides_means(spark):
    rows = [(1, i, float(i), 0.0, 10 if i < 6 else 31) for i in range(10)]
    df = spark.createDataFrame(rows, "set_id int, obs_id int, a double, b double, t int")
    tree = model.stumps(df, "set_id", ["a", "b"], "t").first()
    assert (tree.feature, tree.threshold, tree.left, tree.right, tree.n) == ("a", 5.5, 10, 31, 10)
    got = model.predict_stumps(df, model.stumps(df, "set_id", ["a", "b"], "t"), ["a", "b"]).collect()
    assert all(r.prediction == r.t for r in got)
    assert model.stumps(df.withColumn("t", F.lit(3)), "set_id", ["a", "b"], "t").count() == 0


def test_partial_sums_stitch_to_the_whole(spark):
    df = spark.createDataFrame([(i % 3, 0, i % 4, i * i % 17) for i in range(60)], "part int, r int, c int, v int")
    got = {r.c: (r.mean, r.stdv, r["count"]) for r in ensemble.stitched(ensemble.partial_sums(df, ["part", "r", "c"], "v"), ["r", "c"]).collect()}
    whole = {r.c: (r.mean, r.stdv, r["count"]) for r in ensemble.ensemble(df, ["r", "c"], "v", ["mean", "stdv", "count"]).collect()}
    assert got == whole


def test_forest_votes_equal_plain_trees(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 9, (3000, 3))
    y = (x[:, 0] + x[:, 1] > 8).astype(int) + (rng.random(3000) < 0.2) + 3
    rows = [(i, int(y[i]), float(x[i, 0]), float(x[i, 1]), float(x[i, 2])) for i in range(3000)]
    odd = [(3000, 3, None, 1.0, 1.0), (3001, 3, float("nan"), 1.0, 1.0), (3002, None, 1.0, 1.0, 1.0)]
    kind = "obs_id long, t int, f0 double, f1 double, f2 double"
    df = spark.createDataFrame(rows + odd, kind)
    names = ["f0", "f1", "f2"]
    got = {r.obs_id: (r.t, r.vote, r.n_trees) for r in model.forest_votes(df, names, "t", 5, least_share=0.01, depth=6).collect()}
    bag = model.forest_members(df.select("obs_id"), 5).toPandas().pivot(index="obs_id", columns="set_id", values="in_bag").loc[:2999].to_numpy()
    votes = np.zeros((3000, 6), int)
    for t in range(5):
        own, out = np.flatnonzero(bag[:, t] == 1), np.flatnonzero(bag[:, t] == 0)
        tree = model.grow_tree(x[own].astype(float), y[own].astype(float), "classifier", share=0.01, depth=6)
        for i in out:
            n = 0
            while tree[n][1] >= 0:
                n = tree[n][3] if x[i, tree[n][1]] <= tree[n][2] else tree[n][4]
            votes[i, int(tree[n][5])] += 1
    assert got == {i: (int(y[i]), float(votes[i].argmax()), int(votes[i].sum())) for i in range(3000) if votes[i].any()}
    assert model.forest_votes(spark.createDataFrame(odd, kind), names, "t", 5).count() == 0
