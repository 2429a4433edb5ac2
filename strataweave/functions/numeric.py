"""Rounding, integer division and ordering rules that results depend on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Num = Column | str | int | float
PRIME = 2147483647


def col(x: Num) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def floor_mod(a: Num, n: Num) -> Column:
    """The remainder with the divisor's sign."""
    return col(a) - col(n) * F.floor(col(a) / col(n))


def half_even(x: Num, digits: int = 0) -> Column:
    return F.bround(col(x), digits)


def half_away(x: Num, digits: int = 0) -> Column:
    return F.round(col(x), digits)


def truncated(x: Num) -> Column:
    """Toward zero, as a long."""
    return col(x).cast("double").cast("long")


def squared(h: Column, plus: int) -> Column:
    return (h * h + plus) % PRIME


def shuffled(seed: int, *ids: Num) -> Column:
    """An integer that orders rows as if at random, the same on every engine; break its ties by the ids.

    Each id is mixed into the key so far and the sum squared modulo a prime before the next one comes, so neighbouring
    ids, sets and seeds have unrelated keys. All products stay below 2**62.
    """
    key = F.lit(start_key(seed))
    for x, m in zip(ids, (48271, 69621, 16807, 39373), strict=False):
        key = squared((key + F.pmod(col(x).cast("long"), F.lit(PRIME)) * m) % PRIME, 104729)
    return squared(key, 1299709)


def start_key(seed: int) -> int:
    h = (seed * 2654435761 + 12345) % PRIME
    return (h * h + 7919) % PRIME


def pop_std(v: Num) -> Column:
    """Population standard deviation of integers from exact integer sums, so that ties of rounding agree everywhere."""
    x, n = col(v).cast("long"), F.count(col(v))
    return F.sqrt((n * F.sum(x * x) - F.sum(x) * F.sum(x)).cast("double")) / F.nullif(n, F.lit(0))


def row_ids(df: DataFrame, lead: str, order: list[str], name: str, buckets: int = 4096) -> DataFrame:
    """``df`` with ``name``: the row's position, from 0, in the order of ``order``, whose first column is the integer ``lead``.

    Rows are numbered within at most ``buckets`` ranges of ``lead``; only the ranges' counts pass through one task.
    """
    ends = df.agg(F.min(lead).alias("lo"), F.max(lead).alias("hi"))
    wide = df.join(F.broadcast(ends)).withColumn("_b", F.floor((F.col(lead) - F.col("lo")) * buckets / (F.col("hi") - F.col("lo") + 1)).cast("int")).drop("lo", "hi")
    counts = wide.groupBy("_b").agg(F.count("*").alias("_n"))
    before = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    return wide.join(F.broadcast(before), "_b").withColumn(name, own - 1 + F.col("_before")).drop("_b", "_before")
