"""Local trees: the best split in SQL, a tree per support set, trees as tables of nodes, out-of-bag metrics, forests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NODES = "set_id long, node_id int, feature string, threshold double, left int, right int, value double, n long, gain double"


def best_splits(samples: DataFrame, by: str, features: Sequence[str], target: str, share: float = 0.005) -> DataFrame:
    """For each set and feature, the threshold that lowers the squared error most: gain, threshold, n_left."""
    return _splits(samples, by, features, target, share).select(by, "feature", "gain", "threshold", "n_left")


def stumps(samples: DataFrame, by: str, features: Sequence[str], target: str, share: float = 0.005) -> DataFrame:
    """A tree of one split for each set, without Python: feature, threshold, and each side's mean rounded half to even.

    Ties go to the first feature by name, then the lowest threshold; a set that no split improves has none.
    """
    s = _splits(samples, by, features, target, share).filter("gain > 0")
    best = s.groupBy(by).agg(F.min(F.struct((-F.col("gain")).alias("loss"), "feature", "threshold", "n_left", "s_left", "n", "s")).alias("b")).select(by, "b.*")
    mean = lambda s, n: F.bround(s.cast("double") / n, 0).cast("int")
    return best.select(by, "feature", "threshold", mean(F.col("s_left"), F.col("n_left")).alias("left"), mean(F.col("s") - F.col("s_left"), F.col("n") - F.col("n_left")).alias("right"), "n")


def predict_stumps(rows: DataFrame, trees: DataFrame, features: Sequence[str], by: str = "set_id") -> DataFrame:
    """``rows`` with the prediction of their set's split; rows of a set without one go."""
    value = F.coalesce(*[F.when(F.col("_feature") == f, F.col(f).cast("double")) for f in features])
    known = trees.select(by, F.col("feature").alias("_feature"), F.col("threshold").alias("_at"), F.col("left").alias("_left"), F.col("right").alias("_right"))
    out = rows.join(known, by)
    return out.withColumn("prediction", F.when(value <= F.col("_at"), F.col("_left")).otherwise(F.col("_right"))).drop("_feature", "_at", "_left", "_right")


def _splits(samples: DataFrame, by: str, features: Sequence[str], target: str, share: float) -> DataFrame:
    """The best threshold of each set and feature, with the numbers and sums of its left side and of all.

    Distinct values are aggregated first; a running sum over them gives every split at once.
    """
    long_ = samples.select(by, target, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("x")).select(by, target, "x.feature", "x.v")
    t = F.col(target).cast("long")
    long_ = long_.repartition(by, "feature")  # one shuffle for the counts, the running sums and the best of each
    d = long_.groupBy(by, "feature", "v").agg(F.count("*").alias("n"), F.sum(t).alias("s"))
    own = Window.partitionBy(by, "feature")
    run = own.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = own.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.select("*", F.sum("n").over(run).alias("nl"), F.sum("s").over(run).alias("sl"), F.sum("n").over(whole).alias("nt"), F.sum("s").over(whole).alias("st"), F.lead("v").over(own.orderBy("v")).alias("nv"))
    nr, sr = F.col("nt") - F.col("nl"), F.col("st") - F.col("sl")
    sq = lambda s, n: s.cast("double") * s / n
    gain = F.round(sq(F.col("sl"), F.col("nl")) + sq(sr, nr) - sq(F.col("st"), F.col("nt")), 4)
    least = F.ceil(F.col("nt") * share)
    ok = d.filter(F.col("nv").isNotNull() & (F.col("nl") >= least) & (nr >= least)).withColumn("gain", gain).withColumn("threshold", (F.col("v") + F.col("nv")) / 2)
    best = F.max(F.struct("gain", (-F.col("threshold")).alias("neg"), "nl", "sl", "nt", "st")).alias("_b")  # partitioned and sorted by (set, feature) already
    return ok.groupBy(by, "feature").agg(best).select(by, "feature", F.col("_b.gain").alias("gain"), (-F.col("_b.neg")).alias("threshold"), F.col("_b.nl").alias("n_left"), F.col("_b.sl").alias("s_left"), F.col("_b.nt").alias("n"), F.col("_b.st").alias("s"))


def features_tried(wanted: float | int | str | None, n: int) -> int:
    """How many of ``n`` predictors a split tries: a share, a number, sqrt, log2, or all."""
    if wanted in (None, "auto", "None"):
        return n
    m = {"sqrt": n**0.5, "log2": np.log2(n)}[wanted] if isinstance(wanted, str) else wanted * n if isinstance(wanted, float) else wanted
    return min(n, max(1, int(m)))


def grow_tree(x: np.ndarray, y: np.ndarray, kind: str = "regressor", share: float = 0.005, depth: int = 30, max_features: float | int | str | None = None, seed: int = 0) -> list[tuple]:
    """CART on arrays: (node, feature or -1, threshold, left, right, value, n, gain). Ties go to the lowest feature, then threshold.

    With ``max_features`` each split tries that many predictors, drawn by ``seed``.
    """
    rng, tried = np.random.default_rng(seed), features_tried(max_features, x.shape[1])
    least = max(1, int(np.ceil(share * len(y))))
    labels = np.unique(y)
    hot = (y[:, None] == labels[None, :]).astype(float) if kind == "classifier" else y[:, None].astype(float)
    nodes: list[list] = []
    stack = [(np.arange(len(y)), -1, 0, 0)]
    while stack:
        rows, parent, side, level = stack.pop()
        me, h = len(nodes), hot[rows]
        total = h.sum(0)
        value = labels[total.argmax()] if kind == "classifier" else total[0] / len(rows)
        nodes.append([me, -1, 0.0, -1, -1, float(value), len(rows), 0.0])
        if parent >= 0:
            nodes[parent][3 + side] = me
        base = (total**2).sum() / len(rows)
        best = (1e-9 * max(1.0, abs(base)), -1, 0.0)
        if level < depth and len(rows) >= 2 * least:
            for f in range(x.shape[1]) if tried == x.shape[1] else sorted(rng.permutation(x.shape[1])[:tried].tolist()):
                order = np.argsort(x[rows, f], kind="stable")
                v = x[rows[order], f]
                left = h[order].cumsum(0)[:-1]
                nl = np.arange(1, len(rows))
                ok = (v[1:] > v[:-1]) & (nl >= least) & (len(rows) - nl >= least)
                if ok.any():
                    gain = np.where(ok, (left**2).sum(1) / nl + ((total - left) ** 2).sum(1) / (len(rows) - nl) - base, -1.0)
                    k = int(gain.argmax())
                    if gain[k] > best[0] * (1 + 1e-12):
                        best = (float(gain[k]), f, float((v[k] + v[k + 1]) / 2))
        if best[1] >= 0:
            nodes[me][1], nodes[me][2], nodes[me][7] = best[1], best[2], best[0]
            go = x[rows, best[1]] <= best[2]
            stack += [(rows[~go], me, 1, level + 1), (rows[go], me, 0, level + 1)]
    return [tuple(n) for n in nodes]


def train_sets(members: DataFrame, features: Sequence[str], target: str, kind: str = "regressor", by: str = "set_id", share: float = 0.005, max_features: float | int | str | None = None, seed: int = 1) -> DataFrame:
    """A node table with a tree for each set, grown on its rows in bag; a set with a missing predictor has none.

    One set is one task's work, as a tree is fitted on all its samples; sets bound that by their area.
    """
    names = sorted(features)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("obs_id")
        x, y = pdf[names].to_numpy(float), pdf[target].to_numpy(float)
        rows = grow_tree(x, y, kind, share, max_features=max_features, seed=seed * 1_000_003 + int(pdf[by].iloc[0])) if not np.isnan(x).any() else []
        return pd.DataFrame([(pdf[by].iloc[0], r[0], names[r[1]] if r[1] >= 0 else None, *r[2:]) for r in rows], columns=["set_id", "node_id", "feature", "threshold", "left", "right", "value", "n", "gain"])

    return members.filter("in_bag = 1").select(by, "obs_id", target, *names).groupBy(by).applyInPandas(fit, NODES)


def predict_nodes(rows: DataFrame, nodes: DataFrame, features: Sequence[str], key: Sequence[str], depth: int = 30) -> DataFrame:
    """(set_id, *key, prediction): each row through its set's tree. Rows and trees of a set meet in one cogrouped task."""
    names = sorted(features)
    kept = ["set_id", *key]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*kept).schema) + ", prediction double"

    def walk(left: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        out = left[kept].copy()
        if not len(tree) or not len(left):
            return out.iloc[:0].assign(prediction=[])
        t = tree.sort_values("node_id")
        feature = t.feature.map(lambda f: names.index(f) if f is not None else -1).to_numpy()
        threshold, a, b, value = (t[c].to_numpy() for c in ("threshold", "left", "right", "value"))
        x, node = left[names].to_numpy(float), np.zeros(len(left), int)
        while (inner := feature[node] >= 0).any():
            i = np.flatnonzero(inner)
            go = x[i, feature[node[i]]] <= threshold[node[i]]
            node[i] = np.where(go, a[node[i]], b[node[i]])
        return out.assign(prediction=value[node])

    return rows.groupBy("set_id").cogroup(nodes.groupBy("set_id")).applyInPandas(walk, schema)


def oob_metrics(predictions: DataFrame, truth: str, kind: str = "regressor", by: str = "set_id") -> DataFrame:
    """regressor: oob_rmse and oob_rate (whole percent of R squared); classifier: oob_rate (percent right) and oob_kappa."""
    t, p = F.col(truth).cast("double"), F.col("prediction").cast("double")
    n = F.count("*")
    if kind == "regressor":
        sse, sst = F.sum((t - p) * (t - p)), F.sum(t * t) - F.sum(t) * F.sum(t) / n
        return predictions.groupBy(by).agg(F.round(F.sqrt(sse / n)).cast("int").alias("oob_rmse"), F.round(100 * (1 - sse / F.nullif(sst, F.lit(0.0)))).cast("int").alias("oob_rate"))
    cell = predictions.groupBy(by, t.alias("t"), p.alias("p")).agg(n.alias("n"))
    w = lambda c: Window.partitionBy(by, c)
    m = cell.withColumn("rt", F.sum("n").over(w("t"))).withColumn("rp", F.sum("n").over(w("p")))
    s = m.groupBy(by).agg(F.sum("n").alias("N"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("ok"), F.sum(F.when(F.col("t") == F.col("p"), F.col("rt") * F.col("rp")).otherwise(0)).alias("e"))
    po, pe = F.col("ok") / F.col("N"), F.col("e") / (F.col("N") * F.col("N"))
    return s.select(by, F.round(100 * po).cast("int").alias("oob_rate"), ((po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("oob_kappa"))


#: The comparisons of a drop expression; ``>=`` is itself.
COMPARISONS = {"<=": Column.__le__, ">=": Column.__ge__, "==": Column.__eq__, "!=": Column.__ne__, "<": Column.__lt__, ">": Column.__gt__}


def drop_condition(expression: str, metrics: Sequence[str]) -> Column:
    """``<metric> <comparison> <integer>`` as a condition; rows for which it holds are to be dropped."""
    parts = expression.split()
    if len(parts) != 3 or parts[0] not in metrics or parts[1] not in COMPARISONS or not parts[2].lstrip("-").isdigit():
        raise ValueError(f"not a drop expression over {', '.join(metrics)}: {expression!r}")
    return COMPARISONS[parts[1]](F.col(parts[0]), int(parts[2]))


def without(sets: DataFrame, expression: str | None, metrics: Sequence[str]) -> DataFrame:
    """Sets for which the expression doesn't hold; without an expression, all."""
    return sets if not expression else sets.filter(~F.coalesce(drop_condition(expression, metrics), F.lit(False)))


def with_rates(sets: DataFrame, metrics: DataFrame, key: str = "set_id") -> DataFrame:
    """Sets with their out-of-bag metrics; a value that a set has already stays."""
    new = metrics.select(key, *[F.col(c).alias(f"_{c}") for c in metrics.columns if c != key])
    joined = sets.join(new, key, "left")
    for c in metrics.columns:
        if c != key:
            joined = joined.withColumn(c, F.coalesce(c, f"_{c}") if c in sets.columns else F.col(f"_{c}")).drop(f"_{c}")
    return joined


def importance_by_kind(importance: DataFrame, constant: Sequence[str]) -> DataFrame:
    """Each model's mean importance of constant and of yearly variables (``importance(model, variable, importance)``)."""
    fixed = F.col("variable").isin(list(constant))
    return importance.groupBy("model").agg(F.avg(F.when(fixed, F.col("importance"))).alias("constant"), F.avg(F.when(~fixed, F.col("importance"))).alias("yearly"))


def importances(nodes: DataFrame) -> DataFrame:
    """(set_id, variable, importance): each feature's share of a tree's gain."""
    g = nodes.filter("feature IS NOT NULL").groupBy("set_id", F.col("feature").alias("variable")).agg(F.sum("gain").alias("_g"))
    return g.select("set_id", "variable", (F.col("_g") / F.nullif(F.sum("_g").over(Window.partitionBy("set_id")), F.lit(0.0))).alias("importance"))


def most_important(importance: DataFrame) -> DataFrame:
    """The first feature by name of those with the largest importance, for each set."""
    best = F.row_number().over(Window.partitionBy("set_id").orderBy(F.desc("importance"), "variable"))
    return importance.withColumn("_r", best).filter("_r = 1").select("set_id", "variable")


def feature_of_class(splits: DataFrame) -> DataFrame:
    """For each class, the feature whose splits hold most of its rows (``splits(class, feature, n)``), ties by name."""
    s = splits.groupBy("class", "feature").agg(F.sum("n").alias("n"))
    return s.withColumn("_r", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("n"), "feature"))).filter("_r = 1").select("class", "feature", "n")


def forest_members(samples: DataFrame, trees: int, share: float = 0.63, seed: int = 1) -> DataFrame:
    """Samples for each tree (as ``set_id``) with ``in_bag``: a forest is the ensemble whose sets all cover everything."""
    from ..functions.numeric import shuffled

    each = samples.withColumn("set_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trees - 1).cast("long"))))
    return each.withColumn("in_bag", (shuffled(seed, "obs_id", "set_id") % 10000 < int(share * 10000)).cast("int"))


def error_by_trees(predictions: DataFrame, truth: str, key: str = "obs_id") -> DataFrame:
    """(n_trees, error): the error of the vote of the first n trees (set_id below n) among the rows that have one, ties of a
    vote to the smallest class, for every n at which a tree adds a prediction.

    A row's vote can only change where a tree predicts it, so each prediction adds what it changes to its n, and a
    running sum over the trees gives the curve: the work doesn't grow with rows times trees.
    """
    order = Window.partitionBy(key).orderBy("set_id")
    own = predictions.withColumn("_k", F.row_number().over(Window.partitionBy(key, "prediction").orderBy("set_id")))
    # a class's count only grows, so the largest (count, -class) so far is the present vote
    best = F.max(F.struct("_k", (-F.col("prediction")).alias("neg"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    wrong = own.select(key, "set_id", (-best["neg"] != F.col(truth)).cast("long").alias("_wrong"))
    step = wrong.select((F.col("set_id") + 1).cast("int").alias("n_trees"), (F.col("_wrong") - F.lag("_wrong", 1, 0).over(order)).alias("_d"), (F.row_number().over(order) == 1).cast("long").alias("_new"))
    each = step.groupBy("n_trees").agg(F.sum("_d").alias("_d"), F.sum("_new").alias("_new"))
    run = Window.orderBy("n_trees")  # a row for each tree
    return each.select("n_trees", (F.sum("_d").over(run) / F.sum("_new").over(run)).alias("error"))


def mllib_forest(samples: DataFrame, features: Sequence[str], target: str, kind: str = "classifier", trees: int = 50, depth: int = 10, seed: int = 1, scored: DataFrame | None = None):
    """A distributed random forest, for samples too many for a task; it predicts ``scored``, or its own samples."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    forest = RandomForestClassifier if kind == "classifier" else RandomForestRegressor
    assembler = VectorAssembler(inputCols=sorted(features), outputCol="features", handleInvalid="skip")
    vectors = assembler.transform(samples.withColumn("label", F.col(target).cast("double")))
    model = forest(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", minWeightFractionPerNode=0.005).fit(vectors)
    return model.transform(vectors if scored is None else assembler.transform(scored))


def _histograms(rows: DataFrame, names: Sequence[str], buckets: int = 1 << 16) -> list[np.ndarray]:
    """For each of ``names``, (upper ends, rows) of the buckets of equal width that have rows, from all rows."""
    ends = rows.agg(*[f(n).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    lo, hi = (np.array([ends[f"{k}{i}"] for i in range(len(names))]) for k in ("lo", "hi"))
    wide = np.where(hi > lo, hi - lo, 1.0)

    def count(batches):
        n = np.zeros((len(names), buckets), np.int64)
        for b in batches:
            for i, c in enumerate(names):
                n[i] += np.bincount(np.clip(np.floor((b.column(c).to_numpy() - lo[i]) / wide[i] * buckets), 0, buckets - 1).astype(np.int64), minlength=buckets)
        at = np.flatnonzero(n.ravel())
        yield pa.record_batch([pa.array(at), pa.array(n.ravel()[at])], ["at", "n"])

    found = rows.select(*names).mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).orderBy("at").toArrow()
    at, n = found["at"].to_numpy(), found["n"].to_numpy()
    return [(lo[i] + (at[own] % buckets + 1) * wide[i] / buckets, n[own]) for i in range(len(names)) for own in [at // buckets == i]]


def _cuts(ends: np.ndarray, n: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins`` - 1 thresholds: all that tell buckets apart, or those nearest to equal shares of the rows."""
    if len(ends) <= bins:
        return ends[:-1]
    return ends[np.unique(np.searchsorted(np.cumsum(n), np.arange(1, bins) * n.sum() / bins).clip(0, len(ends) - 2))]


def _walk(tree: tuple[np.ndarray, ...], steps: int, codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The node of ``tree`` (feature, cut, left: arrays; a leaf's left is itself, above no cut) that each of ``rows`` ends in
    after ``steps``; ``codes`` has a row for each feature."""
    feature, cut, left = tree
    flat, n = codes.ravel(), codes.shape[1]
    node = np.zeros(len(rows), np.int64)
    for _ in range(steps):
        node = left[node] + (flat[feature[node] * n + rows] > cut[node])
    return node


def _gathered(batches, columns: Sequence[str], rows: int = 1 << 17):
    """The batches' ``columns`` as arrays of about ``rows`` values."""
    held, count = [], 0
    for b in batches:
        held.append(b.select(list(columns)))
        count += b.num_rows
        if count >= rows:
            yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]
            held, count = [], 0
    if count:
        yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]


def forest_votes(samples: DataFrame, features: Sequence[str], target: str, trees: int, key: str = "obs_id", share: float = 0.63, least_share: float = 0.005, depth: int = 10, bins: int = 32, max_features: float | int | str | None = None, seed: int = 1) -> DataFrame:
    """(key, target, vote, n_trees): for each row out of some bag, the vote of the classification trees that didn't see it,
    ties to the smallest class, and their number. Rows with a missing predictor or class take no part.

    The bags are those of :func:`forest_members`. All trees grow together, a level at a time: a pass over all rows
    counts classes by tree, node, feature and bin of its values, and the driver picks each node's split as :func:`grow_tree`
    does (up to 63 trees, 127 bins). Rows are derived and binned once, whatever the trees and levels.
    """
    from pyspark import StorageLevel

    from ..functions.numeric import shuffled

    names = sorted(features)
    whole = F.lit(True)
    for c in names:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows = samples.filter(whole & F.col(target).isNotNull()).select(key, target, *[F.col(c).cast("double").alias(c) for c in names]).persist(StorageLevel.DISK_ONLY)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    labels = [r[0] for r in rows.select(target).distinct().orderBy(target).collect()]
    if not labels:
        return rows.select(key, target, F.lit(None).cast("double").alias("vote"), F.lit(0).cast("long").alias("n_trees"))
    cuts = [_cuts(ends, n, bins) for ends, n in _histograms(rows, names)]
    of_label, width, classes = {x: i for i, x in enumerate(labels)}, max(len(c) for c in cuts) + 1, len(labels)
    codes = [f"c{i}" for i in range(len(names))]

    def binned(batches):
        for b in batches:
            made = [pa.array(np.searchsorted(cuts[i], b.column(c).to_numpy()).astype(np.int8)) for i, c in enumerate(names)]
            label = np.array([of_label[x] for x in labels])[np.searchsorted(labels, b.column(target).to_numpy())].astype(np.int32)
            yield pa.record_batch([b.column(key), b.column(target), pa.array(label), *made, b.column("bags")], [key, target, "label", *codes, "bags"])

    bags = reduce(lambda a, b: a.bitwiseOR(b), [F.when(shuffled(seed, key, F.lit(t)) % 10000 < int(share * 10000), 1 << t).otherwise(0).cast("long") for t in range(trees)])
    data = rows.withColumn("bags", bags).mapInArrow(binned, f"{key} {kinds[key]}, {target} {kinds[target]}, label int, {', '.join(f'{c} tinyint' for c in codes)}, bags long").persist(StorageLevel.DISK_ONLY)
    data.count()
    rows.unpersist()

    tried = features_tried(max_features, len(names))
    nodes = [[[0, 127, 0]] for _ in range(trees)]  # of each tree: feature, cut, left; right follows left
    value: list[list[int]] = [[0] for _ in range(trees)]
    due, least = [(t, 0) for t in range(trees)], [0] * trees
    for level in range(depth + 1):
        grown, slot = [tuple(np.array(n).T) for n in nodes], [np.full(len(n), -1) for n in nodes]
        for i, (t, node) in enumerate(due):
            slot[t][node] = i

        def count(batches, grown=grown, slot=slot, size=len(due), level=level):
            n = np.zeros(size * len(names) * width * classes, np.int64)
            for *code, label, bag in _gathered(batches, [*codes, "label", "bags"]):
                code = np.stack(code)
                for t in range(trees):
                    if slot[t].max() < 0:
                        continue
                    own = np.flatnonzero(bag >> t & 1)
                    at = slot[t][_walk(grown[t], level, code, own)]
                    own, at = own[at >= 0], at[at >= 0]
                    if not len(own):
                        continue
                    first = int(at.min())  # a tree's nodes follow each other
                    span = (int(at.max()) - first + 1) * len(names) * width * classes
                    base = (at - first) * (len(names) * width * classes) + label[own]
                    for i, c in enumerate(code):
                        n[first * len(names) * width * classes :][:span] += np.bincount(base + (c[own].astype(np.int64) + i * width) * classes, minlength=span)
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array(at), pa.array(n[at])], ["at", "n"])

        found = data.select("label", *codes, "bags").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        n = np.zeros(len(due) * len(names) * width * classes, np.int64)
        n[found["at"].to_numpy()] = found["n"].to_numpy()
        n = n.reshape(len(due), len(names), width, classes).astype(float)
        following = []
        for i, (t, node) in enumerate(due):
            total = n[i, 0].sum(0)
            size = total.sum()
            value[t][node] = int(total.argmax())
            least[t] = least[t] or max(1, int(np.ceil(least_share * size)))
            if level == depth or size < 2 * least[t]:
                continue
            base = (total**2).sum() / size
            best = (1e-9 * max(1.0, abs(base)), -1, 0)
            chosen = range(len(names)) if tried == len(names) else sorted(np.random.default_rng([seed, t, node]).permutation(len(names))[:tried].tolist())
            for f in chosen:
                left = n[i, f].cumsum(0)[:-1]
                nl = left.sum(1)
                ok = (nl >= least[t]) & (size - nl >= least[t])
                if ok.any():
                    gain = np.where(ok, (left**2).sum(1) / np.maximum(nl, 1) + ((total - left) ** 2).sum(1) / np.maximum(size - nl, 1) - base, -1.0)
                    k = int(gain.argmax())
                    if gain[k] > best[0] * (1 + 1e-12):
                        best = (float(gain[k]), f, k)
            if best[1] >= 0:
                left = len(nodes[t])
                nodes[t][node] = [best[1], best[2], left]
                following += [(t, left), (t, left + 1)]
                nodes[t] += [[0, 127, left], [0, 127, left + 1]]
                value[t] += [0, 0]
        due = following
        if not due:
            break
    grown, leaf, empty = [tuple(np.array(n).T) for n in nodes], [np.array(v) for v in value], [not x for x in least]

    def vote(batches):
        for *code, bag, ids, truth in _gathered(batches, [*codes, "bags", key, target]):
            code = np.stack(code)
            votes = np.zeros((len(bag), classes), np.int64)
            for t in range(trees):
                out = np.flatnonzero(~bag >> t & 1) if not empty[t] else np.zeros(0, np.int64)
                votes[out, leaf[t][_walk(grown[t], depth, code, out)]] += 1
            yield pa.record_batch([pa.array(ids), pa.array(truth), *(pa.array(votes[:, i]) for i in range(classes))], [key, target, *(f"v{i}" for i in range(classes))])

    each = data.mapInArrow(vote, f"{key} {kinds[key]}, {target} {kinds[target]}, {', '.join(f'v{i} long' for i in range(classes))}")
    summed = each.groupBy(key, target).agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(classes)])
    most = F.greatest(*[F.col(f"v{i}") for i in range(classes)]) if classes > 1 else F.col("v0")
    vote_of = F.coalesce(*[F.when(F.col(f"v{i}") == most, F.lit(float(x))) for i, x in enumerate(labels)])
    number = reduce(lambda a, b: a + b, [F.col(f"v{i}") for i in range(classes)])
    return summed.select(key, target, vote_of.alias("vote"), number.alias("n_trees")).filter("n_trees > 0")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


