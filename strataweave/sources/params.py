"""Parameter files: ``key; value`` lines. Values stay text; the getters turn them into what an operator takes."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse(text: str) -> tuple[dict[str, str], list[list[str]]]:
    """(parameters, table rows): lines with exactly one ``;`` are parameters, lines with tabs a variable table above them; quotes and spaces around values go."""
    found, rows = {}, []
    for line in text.splitlines():
        if line.count(";") == 1:
            key, value = line.split(";")
            found[key.replace(" ", "")] = value.strip().strip("\"'")
        elif "\t" in line and line.strip():
            rows.append(line.split("\t"))
    return found, rows


def read(path: str) -> dict[str, str]:
    return parse(Path(path).read_text())[0]


def bins(text: str) -> list[tuple[int, int]]:
    """``a:b, c:d`` as [(a, b), (c, d)]."""
    return [(int(a), int(b)) for a, b in (part.split(":") for part in text.replace(" ", "").split(",") if part)]


def constants(text: str) -> dict[str, int]:
    """``K:V, ...`` as {K: V}."""
    return {k: int(v) for k, v in (part.split(":") for part in text.replace(" ", "").split(",") if part)}


def max_features(text: str) -> float | int | str:
    """A share with a point, a number, or a word such as sqrt."""
    try:
        return float(text) if "." in text else int(text)
    except ValueError:
        return text


def years(params: dict[str, str], first: int, last: int, table: list[list[str]] = ()) -> list[dict]:
    """A year's parameters each: the band of by-year variables is its year's (1984 is band 1), a fixed band 1 stays."""
    return [params | {"year": str(y), "table": [[y - 1983 if v == "-1" else v for v in row] for row in table]} for y in range(first, last + 1)]


def write(path: str, params: dict[str, str], title: str = "") -> None:
    Path(path).write_text("".join([f"{title}\n\n"] * bool(title) + [f"{k}; {v}\n" for k, v in params.items()]))


def many(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, value) of every parameter of a folder of files."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.split("value", ";").alias("p")).filter(F.size("p") == 2)
    return lines.select("path", F.replace(F.col("p")[0], F.lit(" "), F.lit("")).alias("key"), F.trim(F.col("p")[1]).alias("value"))


def check_variables(wanted: list[str], columns: list[str], target: str | None = None) -> list[str]:
    """The columns that hold a wanted variable's name, sorted; a variable without a column, or a missing target, is an error."""
    if missing := [v for v in wanted if not any(v in c for c in columns)]:
        raise ValueError(f"variables without a column: {', '.join(missing)}")
    if target is not None and target not in columns:
        raise ValueError(f"no target column {target}")
    return sorted({c for c in columns for v in wanted if v in c and c != target})


def confusion_params(models: dict[str, str], truth: str, folder: str, statistic: str = "mean", extra: dict[str, str] | None = None) -> list[str]:
    """A parameter file for the evaluation of each model (stamp -> its output folder); their paths."""
    out = []
    for stamp, place in sorted(models.items()):
        path = f"{folder}/confusion_{stamp}_params.txt"
        write(path, {"p_path": f"{place}/{stamp}_{statistic}", "t_path": truth, "out_dir": place, **(extra or {})}, f"Confusion matrix of {stamp}")
        out.append(path)
    return out


def filter_params(raster: str, folder: str, function: str, kernel: int, years: list[int], values: list[int] = ()) -> list[str]:
    """A parameter file for a focal filter of each year, and of each value where the function is an area; ``{0}`` in the raster's path is the year."""
    out = []
    for year in years:
        for value in values or [None]:
            name = f"{function}_{year}" + (f"_{value}" if value is not None else "")
            own = {"path": raster.replace("{0}", str(year)), "function": function, "kernel_size": str(kernel), "out_path": f"{folder}/{name}"}
            write(f"{folder}/filter_{name}_params.txt", own | ({"filter_value": str(value)} if value is not None else {}))
            out.append(f"{folder}/filter_{name}_params.txt")
    return out
