"""DuckDB SQL for the queries of :mod:`.queries`, over the driver's tables alone."""

from __future__ import annotations

from ..functions.numeric import start_key
from .fixtures import sql

S = "2147483647"


def _shuffled(seed: int, *ids: str) -> str:
    key = str(start_key(seed))
    square = lambda h, plus: f"(({h}) * ({h}) + {plus}) % {S}"
    for x, m in zip(ids, (48271, 69621, 16807, 39373), strict=False):
        key = square(f"(({key}) + (CAST({x} AS BIGINT) % {S}) * {m}) % {S}", 104729)
    return f"({square(key, 1299709)})"


def _fmod(a: str, n: str) -> str:
    return f"({a} - {n} * floor(CAST({a} AS DOUBLE) / {n}))"


TENTHS = "(0, -1, 10), " + ", ".join(f"({k}, {10 * k}, {10 * k + 10})" for k in range(1, 10))
BINS = f"bins(b, lo, hi) AS (VALUES {TENTHS})"
FEATURES = ("f_disc", "f_price", "f_retail", "f_size", "f_tax")
TILES = """tiles AS (SELECT ti * 4 + tj AS tile_id, tj * 750 AS tx1, ti * -150 AS ty1, tj * 750 + 750 AS tx2, ti * -150 - 150 AS ty2, n
FROM (SELECT CAST(floor(px_row / 5) AS BIGINT) AS ti, CAST(floor(px_col / 25) AS BIGINT) AS tj, count(*) AS n FROM px GROUP BY ALL))"""
STD = "sqrt(CAST(count({v}) * sum({v} * {v}) - sum({v}) * sum({v}) AS DOUBLE)) / count({v})"
ROWCOL = "CAST(trunc(y / CAST(-30 AS DOUBLE)) AS INT) AS px_row, CAST(trunc(x / CAST(30 AS DOUBLE)) AS INT) AS px_col"
_std = STD.format(v="v")
MEAN = "CAST(round_even(avg(v), 0) AS INT)"
MEDIAN = "CAST(round_even(median(v), 0) AS INT)"
STDV = f"CAST(round_even({_std}, 0) AS INT)"
VOTE = "SELECT px_row, px_col, v AS vote, n AS k, total FROM (SELECT *, row_number() OVER (PARTITION BY px_row, px_col ORDER BY n DESC, v) AS r, sum(n) OVER (PARTITION BY px_row, px_col) AS total FROM (SELECT px_row, px_col, v, count(*) AS n FROM setpred GROUP BY ALL)) WHERE r = 1"
IMPORTANCE = "imp AS (" + " UNION ALL ".join(f"SELECT set_id, '{f}' AS variable, (set_id * {7 * k + 3}) % 100 AS i FROM sset" for k, f in enumerate(FEATURES)) + ")"


def _near(kernel: str, value: str, extra: str = "") -> str:
    """near(px_row, px_col, k, v): the neighbours of each pixel."""
    return f"""kernel(k, i, j) AS (VALUES {kernel}),
near AS (SELECT c.px_row, c.px_col, k, n.v, c.v AS centre {extra} FROM (SELECT px_row, px_col, {value} AS v FROM px) n, kernel, (SELECT px_row, px_col, {value} AS v FROM px) c
 WHERE n.px_row = c.px_row + i AND n.px_col = c.px_col + j)"""


def _square(size: int, keep=lambda i, j: True) -> str:
    r = size // 2
    cells = [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1) if keep(i, j)]
    return ", ".join(f"({k}, {i}, {j})" for k, (i, j) in enumerate(cells))


def _agree(source: str, by: str = "") -> str:
    """agree(by, ac, ac_s, ac_u, ssd) of source(x, y, by)."""
    g = f"{by}," if by else ""
    on = f"USING ({by})" if by else "ON true"
    group = f"GROUP BY {by}" if by else ""
    return f"""src AS ({source}),
m0 AS (SELECT {g} avg(x) AS mx, avg(y) AS my, sum(CAST(x AS DOUBLE) * x) - CAST(sum(x) AS DOUBLE) * sum(x) / count(*) AS sxx, sum(CAST(y AS DOUBLE) * y) - CAST(sum(y) AS DOUBLE) * sum(y) / count(*) AS syy, sum(CAST(x AS DOUBLE) * y) - CAST(sum(x) AS DOUBLE) * sum(y) / count(*) AS sxy FROM src {group}),
m AS (SELECT *, my - b * mx AS a FROM (SELECT *, sign(sxy) * sqrt(syy / nullif(sxx, 0)) AS b FROM m0)),
s AS (SELECT {g} sum(CAST(x - y AS DOUBLE) * (x - y)) AS ssd, sum((abs(mx - my) + abs(x - mx)) * (abs(mx - my) + abs(y - my))) AS spod, sum(abs(x - (y - a) / nullif(b, 0)) * abs(y - (a + b * x))) AS u FROM src JOIN m {on} {group}),
agree AS (SELECT {g} 1 - ssd / nullif(spod, 0) AS ac, 1 - (ssd - u) / nullif(spod, 0) AS ac_s, 1 - u / nullif(spod, 0) AS ac_u, ssd FROM s)"""


def _cells(by: str = "") -> str:
    g = f"{by}," if by else ""
    part = f"PARTITION BY {by}" if by else ""
    match = f"AND c.{by} = w.{by}" if by else ""
    seen = f"SELECT {g} p_bin FROM cnt" if by else "SELECT p_bin FROM cnt"
    return f"""{BINS},
smp AS (SELECT * FROM px),
cnt AS (SELECT {g} p.b AS p_bin, t.b AS t_bin, count(*) AS n FROM smp JOIN bins p ON pred > p.lo AND pred <= p.hi JOIN bins t ON truth > t.lo AND truth <= t.hi GROUP BY ALL),
kept AS (SELECT * FROM cnt WHERE ({g} t_bin) IN ({seen})),
wgt AS (SELECT *, n_map / CAST(sum(n_map) OVER ({part}) AS DOUBLE) AS weight FROM (SELECT {g} b AS p_bin, count(*) AS n_map FROM px JOIN bins ON pred > lo AND pred <= hi GROUP BY ALL)),
ni AS (SELECT *, CAST(sum(n) OVER (PARTITION BY {g} p_bin) AS BIGINT) AS n_i FROM kept),
cells AS (SELECT c.*, w.n_map, w.weight, n / CAST(n_i AS DOUBLE) * weight AS p FROM ni c JOIN wgt w ON c.p_bin = w.p_bin {match})"""


def _limits(n: int, low: int, high: int, passes: int = 10) -> str:
    """The damped passes as one table after another."""
    out, last = [], "s0"
    for k in range(passes):
        out += [
            f"a{k} AS (SELECT bin, CASE WHEN size > {high} THEN (size + {high}) / CAST(2.05 AS DOUBLE) ELSE size END AS size FROM {last})",
            f"b{k} AS (SELECT bin, size / sum(size) OVER () * {n} AS size FROM a{k})",
            f"c{k} AS (SELECT bin, CASE WHEN size < {low} THEN (size + {low}) / CAST(1.95 AS DOUBLE) ELSE size END AS size FROM b{k})",
            f"d{k} AS (SELECT bin, size / sum(size) OVER () * {n} AS size FROM c{k})",
        ]
        last = f"d{k}"
    return ",\n".join(out) + f" SELECT bin, CAST(floor(round(size, 6)) AS BIGINT) AS size FROM {last}"


_hexagon = [(300, -60), (900, -60), (1200, -240), (900, -420), (300, -420), (0, -240)]


def _inside(shift: int = 0) -> str:
    ring = [(x + shift, y) for x, y in _hexagon]
    edges = list(zip(ring, ring[1:] + ring[:1], strict=True))
    on = " OR ".join(f"((x - {a}) * ({d} - ({b})) = (y - ({b})) * ({c} - {a}) AND x BETWEEN {min(a, c)} AND {max(a, c)} AND y BETWEEN {min(b, d)} AND {max(b, d)})" for (a, b), (c, d) in edges)
    cross = " + ".join(f"(CASE WHEN (({b}) > y) <> (({d}) > y) AND x < ({c} - {a}) * (y - ({b})) / CAST({d} - ({b}) AS DOUBLE) + {a} THEN 1 ELSE 0 END)" for (a, b), (c, d) in edges if b != d)
    return f"({on} OR ({cross}) % 2 = 1)"


_bag = f"bag AS (SELECT set_id, obs_id, target, CASE WHEN r <= k THEN 1 ELSE 0 END AS in_bag, k FROM (SELECT *, CAST(floor(count(*) OVER (PARTITION BY set_id) * CAST(0.63 AS DOUBLE)) AS BIGINT) AS k, row_number() OVER (PARTITION BY set_id ORDER BY {_shuffled(1, 'obs_id', 'set_id')}, obs_id) AS r FROM members))"
_PIXEL_TILES = "SELECT CAST(floor(px_row / 5) * 4 + floor(px_col / 25) AS BIGINT) FROM px WHERE truth"
_areas = "areas AS (SELECT * FROM tiles WHERE tile_id % 3 = 0)"
_grid = "cells AS (SELECT CAST((j + 3) * 3 + i + 1 AS BIGINT) AS cell_id, 411 + i * 1500 AS ul_x, -1000 + j * 900 AS ul_y, 411 + i * 1500 + 1500 AS lr_x, -1000 + j * 900 - 900 AS lr_y FROM (SELECT unnest(range(-1, 2)) AS i), (SELECT unnest(range(-3, 3)) AS j))"

_MAP = {"p_pred": "pred", "p_region": "region", "p_year": "2001", "p_zone": "zone"}
_STUMP = f"""vm AS (SELECT *, CASE WHEN r <= k THEN 1 ELSE 0 END AS in_bag FROM (SELECT *, CAST(floor(count(*) OVER (PARTITION BY set_id) * CAST(0.63 AS DOUBLE)) AS BIGINT) AS k, row_number() OVER (PARTITION BY set_id ORDER BY {_shuffled(1, 'obs_id', 'set_id')}, obs_id) AS r
 FROM (SELECT set_id, obs_id, px_row, px_col, truth AS t, pred, region, zone FROM (SELECT set_id, obs_id, {ROWCOL} FROM members) JOIN px USING (px_row, px_col) WHERE pred <> 50))),
lg AS (""" + " UNION ALL ".join(f"SELECT set_id, t, '{f}' AS feature, {c} AS v FROM vm WHERE in_bag = 1" for f, c in _MAP.items()) + """),
dg AS (SELECT set_id, feature, v, count(*) AS n, sum(t) AS s FROM lg GROUP BY ALL),
wg AS (SELECT *, sum(n) OVER (PARTITION BY set_id, feature ORDER BY v) AS nl, sum(s) OVER (PARTITION BY set_id, feature ORDER BY v) AS sl, sum(n) OVER (PARTITION BY set_id, feature) AS nt, sum(s) OVER (PARTITION BY set_id, feature) AS st, lead(v) OVER (PARTITION BY set_id, feature ORDER BY v) AS nv FROM dg),
gg AS (SELECT *, round(CAST(sl AS DOUBLE) * sl / nl + CAST(st - sl AS DOUBLE) * (st - sl) / (nt - nl) - CAST(st AS DOUBLE) * st / nt, 4) AS gain, (v + nv) / CAST(2 AS DOUBLE) AS threshold FROM wg WHERE nv IS NOT NULL AND nl >= ceil(nt * CAST(0.005 AS DOUBLE)) AND nt - nl >= ceil(nt * CAST(0.005 AS DOUBLE))),
stump AS (SELECT set_id, feature, threshold, CAST(round_even(CAST(sl AS DOUBLE) / nl, 0) AS INT) AS lv, CAST(round_even(CAST(st - sl AS DOUBLE) / (nt - nl), 0) AS INT) AS rv, nt FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY gain DESC, feature, threshold) AS q FROM gg WHERE gain > 0) WHERE q = 1)"""
_STUMPED = "SELECT set_id, px_row, px_col, {truth}, CASE WHEN CASE feature " + " ".join(f"WHEN '{f}' THEN {c}" for f, c in _MAP.items()) + " END <= threshold THEN lv ELSE rv END AS v FROM {rows} JOIN stump USING (set_id) WHERE pred <> 50"
_RATES = "rates AS (SELECT set_id, CAST(round(sqrt(sse / n)) AS INT) AS oob_rmse, CAST(round(100 * (1 - sse / nullif(sst, 0))) AS INT) AS oob_rate FROM (SELECT set_id, count(*) AS n, CAST(sum((truth - v) * (truth - v)) AS DOUBLE) AS sse, CAST(sum(truth * truth) AS DOUBLE) - CAST(sum(truth) AS DOUBLE) * sum(truth) / count(*) AS sst FROM setpred GROUP BY 1))"
_TRIALS = f"""tr AS (SELECT trial, truth, pred, CASE WHEN truth > 50 THEN 1 ELSE 0 END AS pos FROM (SELECT *, row_number() OVER (PARTITION BY trial, cell ORDER BY {_shuffled(1, 'pid', 'trial')}, pid) AS r FROM (SELECT px_row * 100 + px_col AS pid, CAST(floor(px_col / 20) AS INT) AS cell, truth, pred, unnest(range(0, 10)) AS trial FROM px)) WHERE r <= 12),
{_agree('SELECT truth AS x, pred AS y, trial FROM tr', 'trial')},
au AS (SELECT trial, (sum(p * (2 * below + n + 1)) - sum(p) * (sum(p) + 1)) / CAST(2 AS DOUBLE) / nullif(sum(p) * (sum(n) - sum(p)), 0) AS auc FROM (SELECT *, sum(n) OVER (PARTITION BY trial ORDER BY pred) - n AS below FROM (SELECT trial, pred, sum(pos) AS p, count(*) AS n FROM tr GROUP BY ALL)) GROUP BY 1),
te AS (SELECT trial, 1 - sum((truth - pred) * (truth - pred)) / nullif(CAST(sum(truth * truth) AS DOUBLE) - CAST(sum(truth) AS DOUBLE) * sum(truth) / count(*), 0) AS r2, sqrt(avg((truth - pred) * (truth - pred))) AS rmse, sqrt(avg(CASE WHEN pos = 1 THEN (truth - pred) * (truth - pred) END)) AS rmse_pm FROM tr GROUP BY 1),
tm AS (SELECT trial, auc, ac, r2, rmse, rmse_pm FROM au JOIN agree USING (trial) JOIN te USING (trial))"""


def _floyd(axis: str, span: int, seed: int, source: str, n: int = 4) -> str:
    """Tables that add a centre each, drawn from ``span`` values without replacement."""
    out = []
    for k in range(n):
        last, taken = span - n + k, ", ".join([f"{axis}{j}" for j in range(k)] or ["-1"])
        pick = f"{_shuffled(seed, 'cell_id', str(k))} % {last + 1}"
        out.append(f"{axis}{k + 1} AS (SELECT *, CASE WHEN {pick} IN ({taken}) THEN {last} ELSE {pick} END AS {axis}{k} FROM {source})")
        source = f"{axis}{k + 1}"
    return ", ".join(out)


_RAW: dict[str, str] = {
    "grid_rowcol": f"SELECT obs_id, px_row AS \"row\", px_col AS \"col\" FROM (SELECT obs_id, {ROWCOL} FROM obs)",
    "grid_xy_inverse": "SELECT px_row, px_col, CAST(15 + px_col * 30 AS BIGINT) AS x, CAST(-15 - px_row * 30 AS BIGINT) AS y FROM px",
    "snap_coordinate": f"SELECT obs_id, CAST(cx + {_fmod('15', '30')} - {_fmod('cx', '30')} AS BIGINT) AS sx, CAST(cy + {_fmod('15', '(-30)')} - {_fmod('cy', '(-30)')} AS BIGINT) AS sy FROM (SELECT obs_id, x + obs_id % 29 AS cx, y - obs_id % 31 AS cy FROM obs)",
    "aspect_transform": "SELECT px_row, px_col, CAST(floor(100 * (cos(radians(truth * CAST(3.6 AS DOUBLE) - 225)) + 1)) AS INT) AS ne_sw, CAST(floor(100 * (cos(radians(truth * CAST(3.6 AS DOUBLE) - 135)) + 1)) AS INT) AS nw_se FROM px",
    "scale_values": "SELECT px_row, px_col, CASE WHEN truth <> 0 THEN truth * 10 ELSE 0 END AS scaled FROM px",
    "tile_assign": "SELECT px_row, px_col, CAST(least(floor(px_row / floor(n / 4.0)), 3) * 6 + least(floor(px_col / 16.0), 5) AS INT) AS tile_id FROM px, (SELECT max(px_row) + 1 AS n FROM px)",
    "min_dtype": " UNION ALL ".join(f"SELECT '{c}' AS name, CAST(min({c}) AS BIGINT) AS low, CAST(max({c}) AS BIGINT) AS high, CASE WHEN min({c}) >= 0 AND max({c}) <= 255 THEN 'uint8' WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'int8' WHEN min({c}) >= 0 AND max({c}) <= 65535 THEN 'uint16' WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'int16' ELSE 'int32' END AS type FROM px" for c in ("truth", "x", "y")),
    "year_band": "SELECT obs_id, CASE WHEN obs_id % 3 = 0 THEN yr - 1983 ELSE 2 END AS band, 'landcover_' || yr || '.bsq' AS file, lpad(CAST(obs_id % 1000 AS VARCHAR), 4, '0') AS tile FROM obs",
    "difference_map": "SELECT px_row, px_col, CAST(CASE WHEN pred = 0 OR truth = 50 THEN 0 ELSE pred - truth END AS BIGINT) AS dif FROM px",
    "metadata_numbers": r"""WITH t AS (SELECT p_partkey, 'Error ' || p_size || ' of ' || p_brand AS t FROM part), n AS (SELECT p_partkey, list_transform(regexp_extract_all(t, '\d+\.*\d*'), lambda v: CAST(v AS DOUBLE)) AS n FROM t)
SELECT p_partkey, round(CASE WHEN len(n) = 1 THEN 100 - CASE WHEN n[1] < 1 THEN n[1] * 100 ELSE n[1] END ELSE list_sum(n) / len(n) END, 4) AS accuracy, CAST(len(n) AS INT) AS n_numbers FROM n""",
    "raster_bounds": "SELECT set_id, ul_x AS min_x, ul_y - 1200 AS min_y, ul_x + 1200 AS max_x, ul_y AS max_y FROM sset",
    "set_wkt": "SELECT set_id, 'POLYGON ((' || ul_x || ' ' || ul_y || ', ' || lr_x || ' ' || ul_y || ', ' || lr_x || ' ' || lr_y || ', ' || ul_x || ' ' || lr_y || ', ' || ul_x || ' ' || ul_y || '))' AS wkt, 5 AS n_points FROM sset",
    "grid_cells": f"WITH {_grid} SELECT cell_id, CAST(ul_x AS BIGINT) AS ul_x, CAST(ul_y AS BIGINT) AS ul_y, CAST(lr_x AS BIGINT) AS lr_x, CAST(lr_y AS BIGINT) AS lr_y FROM cells",
    "sets_per_cell": f"""WITH {_grid}, {_floyd('x', 1500, 2, 'cells')}, {_floyd('y', 900, 3, 'x4')},
o AS (SELECT *, list_sort(list_transform([x0, x1, x2, x3], lambda v: {{'k': {_shuffled(2, 'v', 'cell_id')}, 'v': v}})) AS xs, list_sort(list_transform([y0, y1, y2, y3], lambda v: {{'k': {_shuffled(3, 'v', 'cell_id')}, 'v': v}})) AS ys FROM y4),
k AS (SELECT *, unnest([0, 1, 2, 3]) AS k FROM o),
c AS (SELECT *, trunc((least(ul_x, lr_x) + xs[k + 1].v) / CAST(30 AS DOUBLE)) * 30 AS cx, trunc((least(ul_y, lr_y) + ys[k + 1].v) / CAST(-30 AS DOUBLE)) * -30 AS cy FROM k)
SELECT CAST(cell_id * 4 + k AS BIGINT) AS set_id, cell_id, CAST(cx - 600 AS BIGINT) AS ul_x, CAST(cy + 600 AS BIGINT) AS ul_y, CAST(cx + 600 AS BIGINT) AS lr_x, CAST(cy - 600 AS BIGINT) AS lr_y FROM c""",
    "param_parse": "SELECT * FROM (VALUES ('bins', '-1:10, 10:20'), ('constantvars', 'K:1, L:2'), ('n_jobs', '4')) t(\"key\", \"value\")",
    "time_series_params": "SELECT CAST(y AS INT) AS year, CAST(y - 1983 AS INT) AS band, 'predict_' || y || '.txt' AS file FROM (SELECT unnest(range(1990, 2013)) AS y)",
    "pixel_set_overlap": "SELECT set_id, count(*) AS n_pixels, CAST(sum(truth) AS BIGINT) AS sum_truth FROM pxset GROUP BY set_id",
    "sample_set_range_join": "SELECT set_id, count(*) AS n_samples, CAST(sum(obs_id) AS BIGINT) AS sum_obs, CAST(sum(target) AS BIGINT) AS sum_target FROM members GROUP BY set_id",
    "unique_set_combos": "SELECT combo, count(*) AS n_pixels FROM (SELECT px_row, px_col, string_agg(set_id, ',' ORDER BY set_id) AS combo FROM pxset GROUP BY ALL) GROUP BY combo",
    "set_tile_overlap": f"WITH {TILES}, o AS (SELECT tile_id, (least(lr_x, tx2) - greatest(ul_x, tx1)) AS w, (least(ul_y, ty1) - greatest(lr_y, ty2)) AS h FROM sset, tiles) SELECT tile_id, count(*) AS n_sets, CAST(sum(w * h) AS BIGINT) AS area FROM o WHERE w > 0 AND h > 0 GROUP BY tile_id",
    "semi_overlap": f"WITH {TILES}, dark AS (SELECT * FROM tiles WHERE tile_id NOT IN ({_PIXEL_TILES} > 97)) SELECT set_id FROM sset WHERE EXISTS (SELECT 1 FROM dark WHERE ul_x < tx2 AND lr_x > tx1 AND lr_y < ty1 AND ul_y > ty2)",
    "empty_tiles_anti": f"WITH {TILES} SELECT tile_id FROM tiles WHERE tile_id NOT IN ({_PIXEL_TILES} > 98)",
    "lookup_predictors": f"SELECT obs_id, nullif(truth, 50) AS value FROM (SELECT obs_id, {ROWCOL} FROM obs) LEFT JOIN px USING (px_row, px_col)",
    "extract_pivot_by_year": f"SELECT obs_id, truth AS var_1995, truth + 1 AS var_1996, truth + 2 AS var_1997 FROM (SELECT obs_id, {ROWCOL} FROM obs) JOIN px USING (px_row, px_col)",
    "dropped_nulls": "SELECT CASE WHEN f_size = 7 OR f_tax = 0 THEN 'dropped' ELSE 'kept' END AS part, count(*) AS n, CAST(sum(obs_id) AS BIGINT) AS ids FROM obs GROUP BY 1",
    "point_in_polygon": f"SELECT obs_id FROM obs WHERE {_inside()}",
    "polygon_join": " UNION ALL ".join(f"SELECT {k} AS poly_id, count(*) AS n, CAST(sum(truth) AS BIGINT) AS sum_truth FROM px WHERE {_inside(600 * k)}" for k in range(4)),
    "snap_raster": "SELECT g.px_row, g.px_col, CASE WHEN g.zone = 0 THEN -9999 ELSE coalesce(p.truth, -9999) END AS truth FROM (SELECT px_row + 2 AS px_row, px_col + 3 AS px_col, zone FROM px) g LEFT JOIN px p ON g.px_row = p.px_row AND g.px_col = p.px_col",
    "psu_split_test": f"WITH {TILES}, {_areas} SELECT px_row, px_col, truth, tile_id FROM px JOIN areas ON x > tx1 AND x < tx2 AND y < ty1 AND y > ty2 WHERE truth <> 0",
    "psu_split_train": f"WITH {TILES}, {_areas} SELECT px_row, px_col, CASE WHEN EXISTS (SELECT 1 FROM areas WHERE x > tx1 AND x < tx2 AND y < ty1 AND y > ty2) THEN 0 ELSE truth END AS truth FROM px",
    "mosaic_merge": "SELECT CAST(floor(px_col / 25) AS BIGINT) AS tile_id, count(*) AS n, CAST(sum(pred + floor(px_col / 25)) AS BIGINT) AS total FROM px GROUP BY 1",
    "concat_by_year": "SELECT yr, count(*) AS n, CAST(sum(f_size + yr) AS BIGINT) AS sum_p, CAST(sum(target) AS BIGINT) AS sum_target FROM obs GROUP BY yr",
    "model_inventory": "WITH sc AS (SELECT set_id, count(*) AS n, CAST(sum(target) AS BIGINT) AS total FROM members WHERE set_id % 2 = 0 GROUP BY set_id) SELECT s.set_id, sc.n AS n_samples, CAST(ctr_x AS BIGINT) AS accuracy, sc.total FROM sset s LEFT JOIN sc ON s.set_id = sc.set_id",
    "split_train_test": f"SELECT CASE WHEN {_shuffled(1, 'px_row', 'px_col')} % 10000 < 8000 THEN 1 ELSE 0 END AS is_train, count(*) AS n, CAST(sum(obs_id) AS BIGINT) AS ids FROM (SELECT obs_id, {ROWCOL} FROM obs) GROUP BY 1",
    "bag_oob": f"WITH {_bag} SELECT set_id, in_bag, count(*) AS n, CAST(sum(obs_id) AS BIGINT) AS ids FROM bag GROUP BY ALL",
    "min_obs_filter": f"WITH {_bag} SELECT set_id, CAST(sum(in_bag) AS BIGINT) AS n_bag, count(*) AS n FROM bag WHERE k >= 200 GROUP BY set_id",
    "strata_proportional": f"WITH {BINS}, c AS (SELECT b AS bin, count(*) AS n_bin FROM px JOIN bins ON truth > lo AND truth <= hi GROUP BY 1), s AS (SELECT *, n_bin / CAST(sum(n_bin) OVER () AS DOUBLE) AS share FROM c), m AS (SELECT *, (max(share) OVER () - min(share) OVER ()) / 2 AS c FROM s), z AS (SELECT *, (share - c) / 2.0 + c AS z FROM m) SELECT bin, n_bin, round(share, 4) AS share, round(z / sum(z) OVER () * 500, 4) AS size FROM z",
    "strata_equal": "WITH bins(b, lo, hi) AS (VALUES (0, -1, 0), (1, 0, 20), (2, 20, 40), (3, 40, 60), (4, 60, 80), (5, 80, 100)), c AS (SELECT b AS bin, count(*) AS n_bin, CASE WHEN b = 0 THEN CAST(2 AS DOUBLE) ELSE 1 END AS w FROM px JOIN bins ON truth > lo AND truth <= hi GROUP BY b) SELECT bin, n_bin, round(w / sum(w) OVER () * 600, 4) AS size FROM c",
    "stratified_sample": f"WITH {BINS}, s AS (SELECT px_row, px_col, CAST(floor(px_col / 25) AS INT) AS tile, b AS bin, truth FROM px JOIN bins ON truth > lo AND truth <= hi) SELECT px_row, px_col, tile, bin, truth FROM (SELECT *, row_number() OVER (PARTITION BY tile, bin ORDER BY {_shuffled(1, 'px_row', 'px_col')}, px_row, px_col) AS r FROM s) WHERE r <= 7",
    "stratified_minmax": f"WITH {BINS}, c AS (SELECT b AS bin, count(*) AS n_bin FROM px JOIN bins ON truth > lo AND truth <= hi GROUP BY 1), p AS (SELECT bin, n_bin / CAST(sum(n_bin) OVER () AS DOUBLE) AS share FROM c), s0 AS (SELECT bin, share / sum(share) OVER () * 500 AS size FROM p), " + _limits(500, 30, 60),
    "zone_holdout": f"WITH z AS (SELECT zone, CASE WHEN row_number() OVER (ORDER BY {_shuffled(1, 'zone')}, zone) <= floor(count(*) OVER () * CAST(0.7 AS DOUBLE)) THEN 1 ELSE 0 END AS is_train FROM (SELECT DISTINCT zone FROM px)) SELECT is_train, count(*) AS n, CAST(sum(truth) AS BIGINT) AS total FROM px JOIN z USING (zone) GROUP BY 1",
    "random_pixels": f"SELECT px_row, px_col, truth FROM px ORDER BY {_shuffled(1, 'px_row', 'px_col')}, px_row, px_col LIMIT 200",
    "balanced_trials": f"WITH t AS (SELECT px_row * 100 + px_col AS pid, CAST(floor(px_col / 20) AS INT) AS cell, truth, pred, unnest(range(0, 10)) AS trial FROM px), r AS (SELECT *, row_number() OVER (PARTITION BY trial, cell ORDER BY {_shuffled(1, 'pid', 'trial')}, pid) AS r FROM t) SELECT CAST(trial AS INT) AS trial, count(*) AS n, round(sqrt(sum((truth - pred) * (truth - pred)) / CAST(count(*) AS DOUBLE)), 4) AS rmse, CAST(sum(pid) AS BIGINT) AS ids FROM r WHERE r <= 5 GROUP BY trial",
    "tile_quota": f"WITH {TILES}, s AS (SELECT tile_id, n / CAST(sum(n) OVER () AS DOUBLE) AS p FROM tiles) SELECT tile_id, round(p, 6) AS pct_area, CAST(floor(p * 1000) AS BIGINT) AS n_sample FROM s",
    "ensemble_mean": f"SELECT px_row, px_col, {MEAN} AS mean FROM setpred GROUP BY ALL",
    "ensemble_median": f"SELECT px_row, px_col, {MEDIAN} AS median FROM setpred GROUP BY ALL",
    "ensemble_stdv": f"SELECT px_row, px_col, {STDV} AS stdv FROM setpred GROUP BY ALL",
    "ensemble_vote": f"SELECT px_row, px_col, vote FROM ({VOTE})",
    "ensemble_count": "SELECT px_row, px_col, count(*) AS count FROM setpred GROUP BY ALL",
    "ensemble_all": f"SELECT * FROM (SELECT px_row, px_col, {MEAN} AS mean, {MEDIAN} AS median, {STDV} AS stdv, count(*) AS count FROM setpred GROUP BY ALL) JOIN (SELECT px_row, px_col, vote FROM ({VOTE})) USING (px_row, px_col)",
    "ensemble_pct_vote": f"SELECT px_row, px_col, vote, CAST(total AS BIGINT) AS count, CAST(round_even(100 * k / CAST(total AS DOUBLE), 0) AS INT) AS pct_vote FROM ({VOTE})",
    "gaussian_mean": "SELECT px_row, px_col, CAST(round_even(round(sum(v * w) / sum(w), 6), 0) AS INT) AS weighted_mean FROM (SELECT *, exp(-(CAST(v - truth AS DOUBLE) * (v - truth)) / 50) AS w FROM setpred) GROUP BY px_row, px_col",
    "partial_ranges": "SELECT CAST(floor(px_row / 5) * 4 + floor(px_col / 25) AS BIGINT) AS tile, min(v) AS low, max(v) AS high FROM setpred GROUP BY 1",
    "oob_map": "SELECT px_row, px_col, CAST(floor(sum((set_id * 7) % 101) / CAST(count(*) AS DOUBLE)) AS INT) AS oob_rate, count(*) AS count FROM pxset GROUP BY ALL",
    "importance_share_rank": f"WITH {IMPORTANCE}, m AS (SELECT variable, avg(i) AS m FROM imp GROUP BY 1), p AS (SELECT variable, m / sum(m) OVER () AS p FROM m) SELECT variable, round(p, 4) AS pct_importance, CAST(row_number() OVER (ORDER BY p DESC, variable) AS INT) AS rank FROM p",
    "importance_map": f"WITH {IMPORTANCE} SELECT px_row, px_col, variable, CAST(round_even(avg(i), 0) AS INT) AS importance FROM pxset JOIN imp USING (set_id) GROUP BY ALL",
    "max_importance": f"WITH {IMPORTANCE} SELECT set_id, variable FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY i DESC, variable) AS r FROM imp) WHERE r = 1",
    "map_errors": "SELECT round(sqrt(avg((pred - truth) * (pred - truth))), 4) AS rmse, round(sqrt(avg((CAST(100 AS DOUBLE) * (truth - pred) / nullif(truth, 0)) * (CAST(100 AS DOUBLE) * (truth - pred) / nullif(truth, 0)))), 4) AS rmspe, round(avg(abs(pred - truth)), 4) AS mae, round(1 - sum((truth - pred) * (truth - pred)) / (CAST(sum(truth * truth) AS DOUBLE) - CAST(sum(truth) AS DOUBLE) * sum(truth) / count(*)), 4) AS r2 FROM px",
    "agree_coef": f"WITH {_agree('SELECT truth AS x, pred AS y FROM px')} SELECT round(ac, 4) AS ac, round(ac_s, 4) AS ac_s, round(ac_u, 4) AS ac_u, round(ssd, 0) AS ssd FROM agree",
    "lc_eval": f"WITH {_agree('SELECT truth AS x, pred AS y, zone FROM px WHERE zone <> 0', 'zone')}, e AS (SELECT zone, sqrt(avg((CAST(100 AS DOUBLE) * (x - y) / nullif(x, 0)) * (CAST(100 AS DOUBLE) * (x - y) / nullif(x, 0)))) AS rmspe FROM src GROUP BY zone) SELECT zone, round(ac, 4) AS ac, round(ac_s, 4) AS ac_s, round(ac_u, 4) AS ac_u, round(rmspe, 4) AS rmspe FROM agree JOIN e USING (zone)",
    "bin_agreement": f"WITH {_agree('SELECT truth AS x, pred AS y, CAST(floor(truth / 10) AS BIGINT) AS b FROM px WHERE floor(truth / 10) = floor(pred / 10)', 'b')} SELECT b, round(ssd, 0) AS ssd, round(ac, 4) AS ac FROM agree",
    "confusion_counts": f"WITH {BINS} SELECT p.b AS p_bin, t.b AS t_bin, count(*) AS n FROM px JOIN bins p ON pred > p.lo AND pred <= p.hi JOIN bins t ON truth > t.lo AND truth <= t.hi GROUP BY ALL",
    "confusion_area_adjusted": f"WITH {_cells()} SELECT p_bin, t_bin, n, n_i, round(p, 6) AS p FROM cells",
    "users_producers": f"WITH {_cells()}, u AS (SELECT p_bin AS class, sum(CASE WHEN p_bin = t_bin THEN p END) / sum(p) AS u FROM cells GROUP BY 1), v AS (SELECT t_bin AS class, sum(CASE WHEN p_bin = t_bin THEN p END) / sum(p) AS v FROM cells GROUP BY 1) SELECT class, round(u, 4) AS \"user\", round(v, 4) AS producer FROM u FULL JOIN v USING (class)",
    "kappa": f"WITH {_cells()}, r AS (SELECT p_bin AS k, sum(n) AS r FROM cells GROUP BY 1), c AS (SELECT t_bin AS k, sum(n) AS c FROM cells GROUP BY 1), e AS (SELECT sum(r * c) / CAST(sum(r) * sum(r) AS DOUBLE) AS e FROM r FULL JOIN c USING (k)), a AS (SELECT sum(CASE WHEN p_bin = t_bin THEN p END) AS a FROM cells) SELECT round(a, 4) AS accuracy, round((a - e) / (1 - e), 4) AS kappa FROM a, e",
    "accuracy_ci": f"""WITH {_cells()}, q AS (SELECT p_bin, max(n_i) AS n_i, max(weight) AS w, max(n_map) AS big, coalesce(sum(CASE WHEN p_bin = t_bin THEN n END), 0) AS d FROM cells GROUP BY 1),
r AS (SELECT *, d / CAST(n_i AS DOUBLE) AS u, (d / CAST(n_i AS DOUBLE)) * (1 - d / CAST(n_i AS DOUBLE)) / nullif(n_i - 1, 0) AS vu FROM q), o AS (SELECT sum(w * w * vu) AS vo FROM r),
c AS (SELECT t_bin, sum(n_map / CAST(n_i AS DOUBLE) * n) AS nj, sum(CASE WHEN p_bin <> t_bin THEN CAST(n_map AS DOUBLE) * n_map * (n / CAST(n_i AS DOUBLE)) * (1 - n / CAST(n_i AS DOUBLE)) / nullif(n_i - 1, 0) END) AS others FROM cells GROUP BY 1)
SELECT p_bin AS class, round(CAST(1.96 AS DOUBLE) * sqrt(vu), 4) AS user_ci, round(CAST(1.96 AS DOUBLE) * sqrt((CAST(big AS DOUBLE) * big * (1 - big * u / nj) * (1 - big * u / nj) * vu + (big * u / nj) * (big * u / nj) * coalesce(others, 0)) / (nj * nj)), 4) AS producer_ci, round(CAST(1.96 AS DOUBLE) * sqrt(vo), 4) AS overall_ci FROM r JOIN c ON p_bin = t_bin, o""",
    "disagreement": f"WITH {_cells()}, r AS (SELECT p_bin AS k, sum(p) AS r, sum(CASE WHEN p_bin = t_bin THEN p ELSE 0 END) AS d FROM cells GROUP BY 1), c AS (SELECT t_bin AS k, sum(p) AS c FROM cells GROUP BY 1), b AS (SELECT coalesce(r, 0) AS r, coalesce(d, 0) AS d, coalesce(c, 0) AS c FROM r FULL JOIN c USING (k)) SELECT round(sum(abs(r - c)) / 2, 4) AS quantity, round(sum(2 * least(r - d, c - d)) / 2, 4) AS allocation FROM b",
    "region_eval": f"WITH {_cells('region')}, r AS (SELECT region, p_bin AS k, sum(n) AS r FROM cells GROUP BY ALL), c AS (SELECT region, t_bin AS k, sum(n) AS c FROM cells GROUP BY ALL), e AS (SELECT region, sum(r * c) / CAST(sum(r) * sum(r) AS DOUBLE) AS e FROM r FULL JOIN c USING (region, k) GROUP BY 1), a AS (SELECT region, coalesce(sum(CASE WHEN p_bin = t_bin THEN p END), 0) AS a FROM cells GROUP BY 1), z AS (SELECT region, sqrt(avg((pred - truth) * (pred - truth))) AS z FROM px GROUP BY 1) SELECT region, round(a, 4) AS accuracy, round((a - e) / nullif(1 - e, 0), 4) AS kappa, round(z, 4) AS rmse FROM a JOIN e USING (region) JOIN z USING (region)",
    "area_weighted_rmse": f"WITH {_cells()}, e AS (SELECT b AS p_bin, sqrt(avg((pred - truth) * (pred - truth))) AS e FROM smp JOIN bins ON truth > lo AND truth <= hi GROUP BY 1) SELECT round(sum(e * weight), 4) AS area_weighted_rmse FROM e JOIN wgt USING (p_bin)",
    "zonal_stats": f"SELECT zone, count(v) AS n, round(avg(v), 4) AS mean, round({_std}, 4) AS stdv, min(v) AS low, max(v) AS high FROM (SELECT zone, nullif(truth, 0) AS v FROM px) GROUP BY zone",
    "auc_rank": "WITH s AS (SELECT zone, pred, sum(CASE WHEN truth > 50 THEN 1 ELSE 0 END) AS p, count(*) AS n FROM px GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY zone ORDER BY pred) - n AS below FROM s) SELECT zone, round((sum(p * (2 * below + n + 1)) - sum(p) * (sum(p) + 1)) / CAST(2 AS DOUBLE) / nullif(sum(p) * (sum(n) - sum(p)), 0), 4) AS auc, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) - sum(p) AS BIGINT) AS n_neg FROM r GROUP BY zone",
    "brier": "SELECT round(avg((CASE WHEN truth > 50 THEN 1 ELSE 0 END - pred / CAST(100 AS DOUBLE)) * (CASE WHEN truth > 50 THEN 1 ELSE 0 END - pred / CAST(100 AS DOUBLE))), 4) AS brier FROM px",
    "cdf": "SELECT bin, n, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS cum FROM (SELECT CAST(floor(truth / 5) AS BIGINT) AS bin, count(*) AS n FROM px GROUP BY 1)",
    "hist2d": "SELECT CAST(floor(truth / 10) AS BIGINT) AS bin_x, CAST(floor(pred / 10) AS BIGINT) AS bin_y, count(*) AS n FROM px GROUP BY ALL",
    "obs_per_class": "SELECT target_class, yr, CAST(sum(CASE WHEN target % 2 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos, CAST(sum(CASE WHEN target % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg FROM obs GROUP BY ALL",
    "row_stats_continuous": f"WITH {_near(_square(3), 'nullif(truth, 50)')} SELECT px_row, px_col, round(avg(v), 4) AS mean, round(median(v), 4) AS median, round(CAST(count(v) * sum(v * v) - sum(v) * sum(v) AS DOUBLE) / (count(v) * count(v)), 4) AS variance, round({_std}, 4) AS stdv, CAST(round(max(v) - min(v), 4) AS INT) AS range FROM near GROUP BY px_row, px_col",
    "row_stats_discrete": f"WITH {_near(_square(3), 'CAST(floor(truth / 20) AS INT)')} SELECT px_row, px_col, v AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY px_row, px_col ORDER BY n DESC, v) AS r FROM (SELECT px_row, px_col, v, count(*) AS n FROM near GROUP BY ALL)) WHERE r = 1",
    "focal_mean_square": f"WITH {_near(_square(3), 'truth')} SELECT px_row, px_col, count(v) AS n, round(avg(v), 4) AS mean FROM near GROUP BY ALL",
    "focal_mean_circle": f"WITH {_near(_square(5, lambda i, j: i * i + j * j <= 4), 'truth')} SELECT px_row, px_col, count(v) AS n, round(avg(v), 4) AS mean FROM near GROUP BY ALL",
    "focal_mode": f"WITH {_near(_square(3), 'CAST(floor(truth / 10) AS INT)')} SELECT px_row, px_col, v AS mode FROM (SELECT *, row_number() OVER (PARTITION BY px_row, px_col ORDER BY n DESC, v) AS r FROM (SELECT px_row, px_col, v, count(*) AS n FROM near GROUP BY ALL)) WHERE r = 1",
    "focal_area_pct": f"WITH {_near(_square(5), 'CASE WHEN truth > 40 THEN 1 ELSE 0 END')} SELECT px_row, px_col, round(100 * avg(v), 4) AS pct FROM near GROUP BY ALL",
    "focal_equal": f"WITH {_near(_square(3), 'CAST(floor(truth / 50) AS INT)')} SELECT px_row, px_col, CASE WHEN min(v) = max(v) AND min(v) = min(centre) THEN 1 ELSE 0 END AS equal FROM near GROUP BY px_row, px_col",
    "focal_reflect": f"""WITH kernel(k, i, j) AS (VALUES {_square(3)}), last AS (SELECT max(px_row) AS last FROM px),
c AS (SELECT px_row, px_col, px_row + i AS r, px_col + j AS c, last FROM px, kernel, last),
f AS (SELECT px_row, px_col, CASE WHEN r < 0 THEN -1 - r WHEN r > last THEN 2 * last + 1 - r ELSE r END AS r, CASE WHEN c < 0 THEN -1 - c WHEN c > 99 THEN 199 - c ELSE c END AS c FROM c)
SELECT f.px_row, f.px_col, count(*) AS n, CAST(sum(p.truth) AS BIGINT) AS total FROM f JOIN px p ON p.px_row = f.r AND p.px_col = f.c GROUP BY ALL""",
    "best_match_3x3": f"WITH {_near(_square(3), 'nullif(truth, 50)')}, p AS (SELECT n.px_row, n.px_col, k, v, pred FROM near n JOIN px ON n.px_row = px.px_row AND n.px_col = px.px_col WHERE v IS NOT NULL) SELECT px_row, px_col, pred, v AS match FROM (SELECT *, row_number() OVER (PARTITION BY px_row, px_col ORDER BY abs(v - pred), k) AS r FROM p) WHERE r = 1",
    "best_split": "WITH l AS (" + " UNION ALL ".join(f"SELECT set_id, target, '{f}' AS feature, {f} AS v FROM members" for f in FEATURES) + """),
d AS (SELECT set_id, feature, v, count(*) AS n, sum(target) AS s FROM l GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY set_id, feature ORDER BY v) AS nl, sum(s) OVER (PARTITION BY set_id, feature ORDER BY v) AS sl, sum(n) OVER (PARTITION BY set_id, feature) AS nt, sum(s) OVER (PARTITION BY set_id, feature) AS st, lead(v) OVER (PARTITION BY set_id, feature ORDER BY v) AS nv FROM d),
g AS (SELECT *, round(CAST(sl AS DOUBLE) * sl / nl + CAST(st - sl AS DOUBLE) * (st - sl) / (nt - nl) - CAST(st AS DOUBLE) * st / nt, 4) AS gain, (v + nv) / 2 AS threshold FROM w WHERE nv IS NOT NULL AND nl >= ceil(nt * CAST(0.005 AS DOUBLE)) AND nt - nl >= ceil(nt * CAST(0.005 AS DOUBLE)))
SELECT set_id, feature, gain, threshold, CAST(nl AS BIGINT) AS n_left FROM (SELECT *, row_number() OVER (PARTITION BY set_id, feature ORDER BY gain DESC, threshold) AS r FROM g) WHERE r = 1""",
    "oob_metrics": "SELECT set_id, CAST(round(sqrt(sse / n)) AS INT) AS oob_rmse, CAST(round(100 * (1 - sse / nullif(sst, 0))) AS INT) AS oob_rate FROM (SELECT set_id, count(*) AS n, CAST(sum((truth - v) * (truth - v)) AS DOUBLE) AS sse, CAST(sum(truth * truth) AS DOUBLE) - CAST(sum(truth) AS DOUBLE) * sum(truth) / count(*) AS sst FROM setpred GROUP BY 1)",
    "oob_kappa": "WITH c AS (SELECT set_id, floor(truth / 20) AS t, floor(v / 20) AS p, count(*) AS n FROM setpred GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY set_id, t) AS rt, sum(n) OVER (PARTITION BY set_id, p) AS rp FROM c), s AS (SELECT set_id, CAST(sum(n) AS DOUBLE) AS nn, sum(CASE WHEN t = p THEN n ELSE 0 END) AS ok, sum(CASE WHEN t = p THEN rt * rp ELSE 0 END) AS e FROM m GROUP BY 1) SELECT set_id, CAST(round(100 * (ok / nn)) AS INT) AS oob_rate, round((ok / nn - e / (nn * nn)) / nullif(1 - e / (nn * nn), 0), 4) AS oob_kappa FROM s",
    "oob_drop": "SELECT set_id, (set_id * 7) % 101 AS oob_rate FROM sset WHERE NOT (set_id * 7) % 101 >= 50",
    "important_features": "WITH s AS (SELECT target_class AS class, CASE WHEN f_size > 25 THEN 'f_size' WHEN f_tax > CAST(0.04 AS DOUBLE) THEN 'f_tax' ELSE 'f_disc' END AS feature, CAST(sum(target) AS BIGINT) AS n FROM obs GROUP BY ALL) SELECT class, feature, n FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY n DESC, feature) AS r FROM s) WHERE r = 1",
    "ntrees_curve": "WITH p AS (SELECT set_id - 1 AS s, px_row * 100 + px_col AS o, CAST(floor(truth / 25) AS INT) AS t, CAST(floor(v / 25) AS INT) AS p FROM setpred), m AS (SELECT DISTINCT s + 1 AS k FROM p), u AS (SELECT k AS n_trees, o, t, p, count(*) AS n FROM p, m WHERE s < k GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY n_trees, o ORDER BY n DESC, p) AS r FROM u) SELECT CAST(n_trees AS INT) AS n_trees, round(avg(CASE WHEN p <> t THEN CAST(1 AS DOUBLE) ELSE 0 END), 4) AS error FROM b WHERE r = 1 GROUP BY 1",
    "stumps": f"WITH {_STUMP} SELECT set_id, feature, threshold, lv AS \"left\", rv AS \"right\", CAST(nt AS BIGINT) AS n FROM stump",
    "map_from_stumps": f"WITH {_STUMP}, p AS ({_STUMPED.format(rows='pxset', truth='truth')}) SELECT * FROM (SELECT px_row, px_col, {MEAN} AS mean, {MEDIAN} AS median, {STDV} AS stdv, count(*) AS count FROM p GROUP BY ALL) JOIN (SELECT px_row, px_col, v AS vote FROM (SELECT *, row_number() OVER (PARTITION BY px_row, px_col ORDER BY n DESC, v) AS r FROM (SELECT px_row, px_col, v, count(*) AS n FROM p GROUP BY ALL)) WHERE r = 1) USING (px_row, px_col)",
    "oob_map_from_stumps": f"WITH {_STUMP}, o AS ({_STUMPED.format(rows='(SELECT *, t AS truth FROM vm WHERE in_bag = 0)', truth='truth')}), e AS (SELECT set_id, CAST(round(sqrt(CAST(sum((truth - v) * (truth - v)) AS DOUBLE) / count(*))) AS INT) AS oob_rmse FROM o GROUP BY 1) SELECT px_row, px_col, CAST(floor(sum(oob_rmse) / CAST(count(*) AS DOUBLE)) AS INT) AS oob_rmse, count(*) AS count FROM pxset JOIN e USING (set_id) WHERE pred <> 50 GROUP BY ALL",
    "tile_lookup": f"SELECT obs_id, lpad(CAST(CAST(floor(px_row / 5) * 4 + floor(px_col / 25) AS BIGINT) AS VARCHAR), 4, '0') AS tile FROM (SELECT obs_id, {ROWCOL} FROM obs) JOIN px USING (px_row, px_col) WHERE px_row > 0 AND px_col > 0",
    "complete_tiles": f"WITH {TILES} SELECT tile_id FROM tiles WHERE tile_id IN ({_PIXEL_TILES} > 98)",
    "test_pixels": f"WITH tr AS (SELECT {ROWCOL} FROM obs WHERE target_class <> 3) SELECT px_row, px_col, truth FROM px WHERE truth <> 0 AND (px_row, px_col) NOT IN (SELECT (px_row, px_col) FROM tr) ORDER BY {_shuffled(1, 'px_row', 'px_col')}, px_row, px_col LIMIT 100",
    "kernel_at_samples": f"WITH {_near(_square(3), 'nullif(truth, 50)')}, k AS (SELECT px_row, px_col, round(avg(v), 4) AS mean, round(median(v), 4) AS median, round(CAST(count(v) * sum(v * v) - sum(v) * sum(v) AS DOUBLE) / (count(v) * count(v)), 4) AS variance, round({_std}, 4) AS stdv, CAST(round(max(v) - min(v), 4) AS INT) AS range FROM near GROUP BY px_row, px_col) SELECT obs_id, mean, median, variance, stdv, range FROM (SELECT obs_id, {ROWCOL} FROM obs) JOIN k USING (px_row, px_col)",
    "equal_allocation": f"WITH {BINS}, s AS (SELECT px_row, px_col, b AS bin, truth FROM px JOIN bins ON truth > lo AND truth <= hi) SELECT px_row, px_col, bin, truth FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY {_shuffled(1, 'px_row', 'px_col')}, px_row, px_col) AS r FROM s) WHERE r <= 30",
    "zone_samples": f"""WITH z AS (SELECT zone, CASE WHEN row_number() OVER (ORDER BY {_shuffled(1, 'zone')}, zone) <= floor(count(*) OVER () * CAST(0.7 AS DOUBLE)) THEN 1 ELSE 0 END AS is_train FROM (SELECT DISTINCT zone FROM px WHERE zone <> 0)),
a AS (SELECT px_row, px_col, is_train, 1 AS "value" FROM px JOIN z USING (zone) UNION ALL SELECT px_row, px_col, CASE WHEN {_shuffled(2, 'px_row', 'px_col')} % 10000 < 7000 THEN 1 ELSE 0 END, 0 FROM px WHERE zone = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY is_train, "value" ORDER BY {_shuffled(1, 'px_row', 'px_col')}, px_row, px_col) AS r FROM a)
SELECT px_row, px_col, is_train, "value" FROM r WHERE r <= CASE WHEN is_train = 1 THEN CASE WHEN "value" = 1 THEN 70 ELSE 105 END ELSE CASE WHEN "value" = 1 THEN 30 ELSE 45 END END""",
    "whole_bag": f"SELECT CASE WHEN {_shuffled(1, 'obs_id')} % 10000 < 6300 THEN 1 ELSE 0 END AS in_bag, count(*) AS n, CAST(sum(obs_id) AS BIGINT) AS ids, CAST(sum(target) AS BIGINT) AS total FROM obs GROUP BY 1",
    "oob_attach": f"WITH {_RATES} SELECT s.set_id, coalesce(CASE WHEN s.set_id % 3 = 0 THEN s.set_id % 90 END, oob_rate) AS oob_rate, oob_rmse FROM sset s LEFT JOIN rates r ON s.set_id = r.set_id WHERE NOT coalesce(coalesce(CASE WHEN s.set_id % 3 = 0 THEN s.set_id % 90 END, oob_rate) < 92, false)",
    "combo_metrics": "WITH c AS (SELECT px_row, px_col, string_agg(set_id, ',' ORDER BY set_id) AS combo, list(set_id) AS ids FROM pxset GROUP BY ALL), u AS (SELECT combo, count(*) AS n_pixels, first(ids) AS ids FROM c GROUP BY combo), e AS (SELECT combo, n_pixels, unnest(ids) AS s FROM u), f AS (SELECT combo, s % 5 AS feature, row_number() OVER (PARTITION BY combo ORDER BY count(*) DESC, s % 5) AS r FROM e GROUP BY combo, s % 5), m AS (SELECT combo, n_pixels, CAST(round(avg((s * 7) % 101)) AS INT) AS oob_rate FROM e GROUP BY ALL) SELECT combo, n_pixels, oob_rate, feature FROM m JOIN f USING (combo) WHERE r = 1",
    "stitched_map": f"SELECT px_row, px_col, {MEAN} AS mean, {STDV} AS stdv, count(*) AS count, min(v) AS low, max(v) AS high FROM setpred GROUP BY ALL",
    "trial_metrics": f"WITH {_TRIALS} SELECT CAST(trial AS INT) AS trial, round(auc, 4) AS auc, round(ac, 4) AS ac, round(r2, 4) AS r2, round(rmse, 4) AS rmse, round(rmse_pm, 4) AS rmse_pm FROM tm",
    "trial_spread": f"WITH {_TRIALS} SELECT 'auc' AS metric, round(avg(auc), 4) AS mean, round(stddev_pop(auc), 4) AS pm FROM tm UNION ALL SELECT 'rmse', round(avg(rmse), 4), round(stddev_pop(rmse), 4) FROM tm",
    "importance_by_kind": f"WITH {IMPORTANCE} SELECT set_id % 4 AS model, round(avg(CASE WHEN variable IN ('f_size', 'f_tax') THEN i END), 4) AS constant, round(avg(CASE WHEN variable NOT IN ('f_size', 'f_tax') THEN i END), 4) AS yearly FROM imp GROUP BY 1",
    "stats_slice": "SELECT zone, " + ", ".join(f"round(max(CASE WHEN region = {k} THEN e END), 4) AS r{k}" for k in range(5)) + " FROM (SELECT zone, region, sqrt(avg((pred - truth) * (pred - truth))) AS e FROM px GROUP BY ALL) GROUP BY zone",
    "kernel_means": f"WITH kernel(k, i, j) AS (VALUES {_square(3)}), c AS (SELECT px_row, px_col, nullif(pred, 40) AS p, nullif(truth, 50) AS t FROM px) SELECT a.px_row, a.px_col, CAST(trunc(avg(b.p)) AS INT) AS p, CAST(trunc(avg(b.t)) AS INT) AS t FROM c a, kernel, c b WHERE a.p IS NOT NULL AND b.px_row = a.px_row + i AND b.px_col = a.px_col + j GROUP BY ALL HAVING avg(b.t) IS NOT NULL",
    "features_with_stats": f"WITH {TILES}, s AS (SELECT CAST(floor(px_row / 5) * 4 + floor(px_col / 25) AS BIGINT) AS fid, count(*) AS n, max(pred) AS high FROM px WHERE truth > 60 GROUP BY 1) SELECT tile_id AS fid, tx1, ty1, s.n, high FROM tiles LEFT JOIN s ON tile_id = fid",
    "predictions_of_tile": "SELECT set_id, px_row, px_col, v FROM setpred WHERE px_row >= 5 AND px_row < 10 AND px_col >= 25 AND px_col < 50",
    "vector_transform": f"SELECT CAST(lx + {_fmod('7', '30')} - {_fmod('lx', '30')} AS BIGINT) AS ul_x, 30 AS x_res, CAST(hy + {_fmod('11', '(-30)')} - {_fmod('hy', '(-30)')} AS BIGINT) AS ul_y, -30 AS y_res, CAST(ceil((hx - lx) / CAST(30 AS DOUBLE)) AS BIGINT) AS xsize, CAST(ceil((hy - ly) / CAST(30 AS DOUBLE)) AS BIGINT) AS ysize FROM (SELECT min(least(ul_x, lr_x)) AS lx, max(greatest(ul_x, lr_x)) AS hx, min(least(ul_y, lr_y)) AS ly, max(greatest(ul_y, lr_y)) AS hy FROM sset)",
    "attribute_raster": "SELECT px_row, px_col, greatest(" + ", ".join(f"CASE WHEN {_inside(450 * k)} THEN {k + 1} ELSE 0 END" for k in range(4)) + ") AS name FROM px",
    "zone_metadata": r"SELECT n_nationkey AS fid, n_name AS name, CASE WHEN l IS NULL THEN NULL WHEN CAST(regexp_extract(l, '\d+') AS DOUBLE) < 1 THEN CAST(regexp_extract(l, '\d+') AS DOUBLE) * 100 ELSE CAST(regexp_extract(l, '\d+') AS DOUBLE) END AS accuracy FROM nation LEFT JOIN (SELECT c_nationkey, max(c_name) AS l FROM customer GROUP BY 1) ON c_nationkey = n_nationkey",
    "valid_rmse": "SELECT region, round(sqrt(avg(CASE WHEN pred <> 20 AND truth <> 50 THEN (pred - truth) * (pred - truth) END)), 4) AS rmse FROM px GROUP BY region",
    "tile_offsets": "SELECT set_id, CAST(trunc((ul_y + 15) / CAST(-30 AS DOUBLE)) AS INT) AS \"row\", CAST(trunc((ul_x - 15) / CAST(30 AS DOUBLE)) AS INT) AS \"col\" FROM sset",
    "oob_per_set_agreement": f"WITH {_RATES}, {_agree('SELECT truth AS x, v AS y, set_id FROM setpred WHERE set_id IN (SELECT set_id FROM rates WHERE oob_rate < 92)', 'set_id')}, e AS (SELECT set_id, sqrt(avg((x - y) * (x - y))) AS e FROM src GROUP BY 1) SELECT set_id, round(ac, 4) AS ac, round(e, 4) AS rmse FROM agree JOIN e USING (set_id)",
    "psu_min_distance": f"""WITH RECURSIVE t AS (SELECT CAST(set_id AS BIGINT) AS tile_id, CAST(set_id % 4 AS VARCHAR) AS stratum, 1 + set_id % 3 AS area, CAST(ctr_x AS DOUBLE) AS x, CAST(ctr_y AS DOUBLE) AS y FROM sset),
q AS (SELECT stratum, greatest(1, CAST(round_even(sum(area) / CAST((SELECT sum(area) FROM t) AS DOUBLE) * 12, 0) AS BIGINT)) AS quota FROM t GROUP BY 1),
o AS (SELECT t.*, quota, row_number() OVER (ORDER BY stratum, {_shuffled(1, 'tile_id')}, tile_id) AS n FROM t JOIN q USING (stratum)),
walk AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(tile_id BIGINT, stratum VARCHAR, x DOUBLE, y DOUBLE)[]) AS picks
 UNION ALL SELECT o.n, CASE WHEN len(list_filter(picks, lambda p: p.stratum = o.stratum)) < quota AND len(list_filter(picks, lambda p: (p.x - o.x) * (p.x - o.x) + (p.y - o.y) * (p.y - o.y) <= 250000)) = 0 THEN list_append(picks, {{'tile_id': tile_id, 'stratum': stratum, 'x': x, 'y': y}}) ELSE picks END FROM walk JOIN o ON o.n = walk.n + 1),
last AS (SELECT picks FROM walk ORDER BY n DESC LIMIT 1),
u AS (SELECT unnest(picks) AS p, generate_subscripts(picks, 1) AS k FROM last)
SELECT p.tile_id AS tile_id, p.stratum AS stratum, CAST((k - 1) % 2 AS BIGINT) AS half FROM u""",
}

ORACLE_SQL: dict[str, str] = {name: sql(text) for name, text in _RAW.items()}
