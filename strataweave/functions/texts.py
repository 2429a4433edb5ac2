"""Small text parsers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import Num, col


def numbers(text: Num) -> Column:
    """Every number of a text, [0.0] if it has none."""
    found = F.transform(F.regexp_extract_all(col(text), F.lit(r"(\d+\.*\d*)"), F.lit(1)), lambda x: F.regexp_replace(x, r"\.+", ".").cast("double"))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(0.0)))


def accuracy(text: Num) -> Column:
    """An accuracy in percent: one number, a share below 1 times 100 and an error turned round; of several numbers the mean."""
    n = numbers(text)
    one = F.when(n[0] < 1, n[0] * 100).otherwise(n[0])
    one = F.when(F.lower(col(text)).contains("error") & (one != 0), 100 - one).otherwise(one)
    return F.when(F.size(n) == 1, one).otherwise(F.aggregate(n, F.lit(0.0), lambda a, x: a + x) / F.size(n))


def aspect(degrees: Num, toward: int) -> Column:
    """100 * (cos(aspect - toward) + 1), truncated into a byte."""
    return F.floor(100 * (F.cos(F.radians(col(degrees) - toward)) + 1)).cast("int")


def for_year(pattern: Num, year: Num) -> Column:
    """``{0}`` in a search pattern replaced by the year."""
    return F.replace(col(pattern), F.lit("{0}"), col(year).cast("string"))


def band(data_band: Num, year: Num) -> Column:
    """The band of a year (1984 is the first) where the band is given as by year (negative), else the band itself."""
    return F.when(col(data_band) < 0, col(year) - 1983).otherwise(col(data_band))


def tile_name(tile: Num) -> Column:
    return F.lpad(col(tile).cast("string"), 4, "0")
