"""Pixels, support sets, samples and per-set predictions laid over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import row_ids
from ..operators.joins import points_in_rectangles

#: Width of the bins of range joins: about the sets' side.
BIN = 600


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """px_row, px_col, x, y, truth, pred, zone, region: a grid of 100 columns."""
    o = read(spark, d, "orders").join(read(spark, d, "customer"), F.expr("o_custkey = c_custkey")).join(F.broadcast(read(spark, d, "nation")), F.expr("c_nationkey = n_nationkey"))
    return o.selectExpr(
        "CAST(floor(o_orderkey / 100) AS INT) AS px_row", "CAST(o_orderkey % 100 AS INT) AS px_col", "CAST(o_orderkey % 100 AS INT) * 30 AS x", "CAST(floor(o_orderkey / 100) AS INT) * -30 AS y",
        "CAST(floor(o_totalprice / 5000) AS INT) AS truth", "CAST(floor(0.8D * o_totalprice / 5000 + 20 * ((o_custkey * 7919) % 101) / 100.0D) AS INT) AS pred", "c_nationkey AS zone", "n_regionkey AS region",
    )


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return F.broadcast(read(spark, d, "orders").selectExpr("CAST(floor(max(o_orderkey) / 100) AS INT) + 1 AS n_rows"))


def sets(spark: SparkSession, d: str) -> DataFrame:
    """A 1200 x 1200 rectangle for each supplier."""
    s = read(spark, d, "supplier").join(_rows(spark, d)).selectExpr("CAST(s_suppkey AS INT) AS set_id", "CAST((s_suppkey * 37) % 100 AS INT) * 30 AS ctr_x", "CAST((s_suppkey * 53) % n_rows AS INT) * -30 AS ctr_y")
    return s.selectExpr("set_id", "ctr_x - 600 AS ul_x", "ctr_y + 600 AS ul_y", "ctr_x + 600 AS lr_x", "ctr_y - 600 AS lr_y", "ctr_x", "ctr_y")


def samples(spark: SparkSession, d: str) -> DataFrame:
    """obs_id, x, y, target, target_class, yr and five predictors."""
    lines = row_ids(read(spark, d, "lineitem"), "l_orderkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "obs_id")
    joined = lines.join(read(spark, d, "part"), F.expr("l_partkey = p_partkey")).join(_rows(spark, d))
    return joined.selectExpr(
        "obs_id", "CAST(l_partkey % 100 AS INT) * 30 AS x", "CAST(l_orderkey % n_rows AS INT) * -30 AS y", "CAST(l_quantity AS INT) AS target", "CAST(1 + floor(l_quantity / 10.5D) AS INT) AS target_class",
        "year(l_shipdate) AS yr", "l_extendedprice AS f_price", "l_discount AS f_disc", "l_tax AS f_tax", "CAST(p_size AS DOUBLE) AS f_size", "p_retailprice AS f_retail",
    )


def pixel_sets(spark: SparkSession, d: str) -> DataFrame:
    return points_in_rectangles(pixels(spark, d), sets(spark, d), BIN)


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """set_id, px_row, px_col, v: a stand-in for the sets' trees."""
    return pixel_sets(spark, d).selectExpr("set_id", "px_row", "px_col", "truth", "CAST(floor(truth * 0.8D + (set_id * 31 + px_row * 7 + px_col * 3) % 21) AS INT) AS v")


def members(spark: SparkSession, d: str) -> DataFrame:
    return points_in_rectangles(samples(spark, d), sets(spark, d), BIN)


#: The same in DuckDB SQL, as common table expressions.
PX = """px AS (
SELECT CAST(floor(o_orderkey / 100) AS INT) AS px_row, CAST(o_orderkey % 100 AS INT) AS px_col, CAST(o_orderkey % 100 AS INT) * 30 AS x, CAST(floor(o_orderkey / 100) AS INT) * -30 AS y,
       CAST(floor(o_totalprice / 5000) AS INT) AS truth, CAST(floor(CAST(0.8 AS DOUBLE) * o_totalprice / 5000 + 20 * ((o_custkey * 7919) % 101) / CAST(100 AS DOUBLE)) AS INT) AS pred, c_nationkey AS zone, n_regionkey AS region
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
SSET = """sset AS (
SELECT CAST(s_suppkey AS INT) AS set_id, ctr_x - 600 AS ul_x, ctr_y + 600 AS ul_y, ctr_x + 600 AS lr_x, ctr_y - 600 AS lr_y, ctr_x, ctr_y
FROM (SELECT s_suppkey, CAST((s_suppkey * 37) % 100 AS INT) * 30 AS ctr_x, CAST((s_suppkey * 53) % (SELECT max(px_row) + 1 FROM px) AS INT) * -30 AS ctr_y FROM supplier) t)"""
OBS = """obs AS (
SELECT obs_id, CAST(l_partkey % 100 AS INT) * 30 AS x, CAST(l_orderkey % (SELECT max(px_row) + 1 FROM px) AS INT) * -30 AS y,
       CAST(l_quantity AS INT) AS target, CAST(1 + floor(l_quantity / CAST(10.5 AS DOUBLE)) AS INT) AS target_class, CAST(year(l_shipdate) AS INT) AS yr,
       l_extendedprice AS f_price, l_discount AS f_disc, l_tax AS f_tax, CAST(p_size AS DOUBLE) AS f_size, p_retailprice AS f_retail
FROM (SELECT l.*, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS obs_id FROM lineitem l) l JOIN part ON l_partkey = p_partkey)"""
_IN = "x > ul_x AND x < lr_x AND y < ul_y AND y > lr_y"
PXSET = f"pxset AS (SELECT set_id, p.* FROM px p JOIN sset s ON {_IN})"
SETPRED = "setpred AS (SELECT set_id, px_row, px_col, truth, CAST(floor(truth * CAST(0.8 AS DOUBLE) + (set_id * 31 + px_row * 7 + px_col * 3) % 21) AS INT) AS v FROM pxset)"
MEMBERS = f"members AS (SELECT set_id, o.* FROM obs o JOIN sset s ON {_IN})"


def sql(body: str) -> str:
    """``body`` after the common tables that it, or another of them, names."""
    import re

    tables = {"px": PX, "sset": SSET, "obs": OBS, "pxset": PXSET, "setpred": SETPRED, "members": MEMBERS}
    wanted, text = set(), body
    while new := {t for t in tables if re.search(rf"\b{t}\b", text)} - wanted:
        wanted |= new
        text += " ".join(tables[t] for t in new)
    head = [tables[t] for t in tables if t in wanted]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join([*head, body[15:]])
    return ("WITH " + ",\n".join([*head, body[5:]]) if body.upper().startswith("WITH ") else "WITH " + ",\n".join(head) + "\n" + body) if head else body
