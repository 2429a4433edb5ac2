"""Every query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from strataweave.plans.oracle import ORACLE_SQL
from strataweave.plans.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(v) if isinstance(v, (int, float)) or hasattr(v, "as_integer_ratio") else v


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    want = duck.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    rows = lambda rs, cs: sorted([tuple(plain(r[cs.index(c)]) for c in columns) for r in rs], key=str)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


@pytest.fixture(scope="module")
def thirty_sets(tmp_path_factory):
    """The smallest tables with thirty suppliers, hence thirty sets."""
    d = tmp_path_factory.mktemp("sets")
    for p in DATA.glob("*.parquet"):
        if p.stem != "supplier":
            (d / p.name).symlink_to(p)
    duckdb.sql(f"COPY (SELECT * FROM '{DATA.parent}/sf0.01/supplier.parquet' WHERE s_suppkey <= 30) TO '{d}/supplier.parquet' (FORMAT parquet)")
    return str(d)


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_every_set_has_its_tree_and_predictions(spark, thirty_sets):
    from strataweave.operators import model
    from strataweave.operators import sampling as sa
    from strataweave.plans import fixtures as fx
    from strataweave.plans.queries import FEATURES

    names = sorted(FEATURES)
    b = sa.bagged(fx.members(spark, thirty_sets), "set_id", "obs_id").select("set_id", "obs_id", "in_bag", "target", *names).toPandas().sort_values("obs_id")
    want, oob = {}, set()
    for k, g in b.groupby("set_id"):
        fit = g[g.in_bag == 1]
        want |= {(k, r[0]): (names[r[1]] if r[1] >= 0 else None, *r[2:7]) for r in model.grow_tree(fit[names].to_numpy(float), fit.target.to_numpy(float), share=0.02)}
        oob |= {(k, o) for o in g.obs_id[g.in_bag == 0]}
    assert len({k for k, _ in want}) > 20
    got = QUERIES["train_sets"](spark, thirty_sets).collect()
    assert {(r.set_id, r.node_id): (r.feature, r.threshold, r.left, r.right, r.value, r.n) for r in got} == want
    assert {(r.set_id, r.obs_id) for r in QUERIES["predict_sets"](spark, thirty_sets).select("set_id", "obs_id").collect()} == oob
    assert QUERIES["oob_trained"](spark, thirty_sets).count() == len({k for k, _ in oob})


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_forests_take_all_samples(spark):
    from strataweave.operators import model
    from strataweave.plans import fixtures as fx

    samples = fx.samples(spark, str(DATA))
    m = model.forest_members(samples, 8).select("obs_id", "in_bag").toPandas()
    want = m[m.in_bag == 0].groupby("obs_id").size().to_dict()
    assert max(want) >= 2000
    assert {r.obs_id: r.n_trees for r in QUERIES["forest_vote"](spark, str(DATA)).collect()} == want
    assert QUERIES["forest_mllib"](spark, str(DATA)).count() == samples.count()
