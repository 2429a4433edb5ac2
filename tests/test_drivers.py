"""Whole jobs on a small raster: sample, extract, train, predict, evaluate."""

import pytest
from pyspark.sql import functions as F

from strataweave.plans import drivers

FEATURES = ["elev", "k", "slope"]


@pytest.fixture(scope="module")
def pixels(spark):
    p = spark.range(1600).select((F.col("id") / 40).cast("int").alias("row"), (F.col("id") % 40).cast("int").alias("col"))
    p = p.withColumn("x", F.col("col") * 30 + 15).withColumn("y", F.col("row") * -30 - 15).withColumn("elev", F.col("row")).withColumn("slope", F.col("col") % 7)
    return p.withColumn("value", F.when(F.col("elev") < 20, 10).otherwise(60) + F.col("slope"))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A job writes what the next one reads."""
    folder, n = tmp_path_factory.mktemp("jobs"), iter(range(99))

    def write(df):
        path = f"{folder}/{next(n)}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    return write


@pytest.fixture(scope="module")
def trained(spark, pixels, stored):
    s = stored(drivers.sample(pixels, {"bins": "-1:30, 30:100", "n_sample": "600", "sampling_scheme": "equal", "pct_train": "0.8"}))
    long_ = pixels.select("row", "col", F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).alias("value")) for v in ("elev", "slope")])).alias("v")).select("row", "col", "v.*")
    kept, gone = drivers.extract(s.filter("is_train = 1").withColumnRenamed("value", "target"), long_.filter("NOT (row = 3 AND variable = 'slope')"), ["elev", "slope"])
    kept = stored(kept.withColumn("k", F.lit(4)))
    sets = stored(drivers.support_sets(spark, {"cell_size": "600, 600", "support_size": "900, 900", "sets_per_cell": "3"}, (0, -1200, 1200, 0)))
    return s, kept, gone, sets, drivers.train(kept, sets, {"min_obs": "20", "oob_drop": "oob_rate < 50"}, FEATURES, "target", 600)


def test_samples_are_stratified_and_extracted(trained):
    s, kept, gone, _, _ = trained
    assert sorted(r["count"] for r in s.groupBy("bin").count().collect()) == [300, 300]
    assert sorted(r.obs_id for r in s.select("obs_id").collect()) == list(range(600))
    assert {r.row for r in gone.select("row").collect()} <= {3} and not kept.filter("row = 3").count()


def test_a_map_is_trained_predicted_and_evaluated(pixels, trained, stored):
    sets, nodes, members = map(stored, trained[4])
    ids = sorted(r.set_id for r in sets.collect())
    assert ids == list(range(len(ids))) and len(ids) > 5 and sets.filter("oob_rate < 50").count() == 0
    assert {r.set_id for r in nodes.select("set_id").distinct().collect()} == set(ids)
    params = {"agg_stats": "mean, count", "constant_vars": "k:4", "bins": "-1:30, 30:100", "nodata": "-9999"}
    holed = pixels.withColumn("slope", F.when((F.col("row") == 5) & (F.col("col") == 5), -9999).otherwise(F.col("slope")))
    got, importance = drivers.predict(holed, sets, nodes, params, FEATURES, 600)
    got = stored(got)
    assert got.filter("row = 5 AND col = 5").count() == 0 and got.count() > 1000
    ranks = {r.variable: r["rank"] for r in importance.collect()}
    assert ranks["elev"] == 1 and "k" not in ranks
    both = stored(got.join(pixels, ["row", "col"]).select("row", "col", F.col("mean").alias("p"), F.col("value").alias("t"), (F.col("row") < 20).cast("int").alias("zone")))
    report = drivers.map_evaluation(both, params, "zone")
    assert report["overall"].first().accuracy > 0.95 and report["errors"].first().rmse < 6
    assert report["by_zone"].count() == 2 and report["cells"].count() >= 2


def test_the_curve_falls_with_trees(spark):
    s = spark.range(300).select(F.col("id").alias("obs_id"), (F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"), ((F.col("id") % 10) > 4).cast("int").alias("t"))
    curve = {r.n_trees: r.error for r in drivers.trees_curve(s, {"max_trees": "5"}, ["a", "b"], "t").collect()}
    assert len(curve) == 5 and curve[5] == 0
    files = spark.createDataFrame([("/a/map_30.bsq",), ("/a/map_90.bsq",), ("/b/map_30.bsq",)], "path string")
    assert {r.scale: r.path for r in drivers.files_by_scale(files, "map_{0}\\.bsq", ["30", "90", "300"]).collect()} == {"30": "/a/map_30.bsq", "90": "/a/map_90.bsq"}
