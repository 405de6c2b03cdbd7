"""Distributed models: reconstruction by principal components, isolation forest, random forest."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penlight.operators.quantiles import one_row

LATENT, TREES, SUBSAMPLE = 32, 200, 256


def reconstruction(train: DataFrame, windows: DataFrame, vector: str, latent: int = LATENT) -> DataFrame:
    """windows with errors (squared error by place) and error (their mean) of a linear autoencoder fitted on train.

    Only the components go to the tasks: latent vectors of the window's size.
    """
    centre = train.select(F.posexplode(vector)).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos")
    mean = np.array([r.m for r in centre.collect()])
    # PCA takes the mean out by itself; the means go to the tasks with the components.
    fit = train.select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("_v"))
    model = PCA(k=min(latent, len(mean)), inputCol="_v", outputCol="_p").fit(fit)
    parts = windows.sparkSession.sparkContext.broadcast((np.array(model.pc.toArray()), mean))

    @F.pandas_udf("array<double>")
    def errors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, mean = parts.value
        for x in batches:
            m = (np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(w)))) - mean
            yield pd.Series(list((m - m @ w @ w.T) ** 2))

    scored = windows.withColumn("errors", errors(vector))
    return scored.withColumn("error", F.aggregate("errors", F.lit(0.0), lambda a, x: a + x) / F.size("errors"))


def top_features(scored: DataFrame, keys: Sequence[str], names: Sequence[str], k: int = 5) -> DataFrame:
    """The k features of largest error of each window; errors run over rows of features."""
    n = len(names)
    by_feature = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda f: F.struct((F.aggregate(F.filter("errors", lambda x, i: i % n == f), F.lit(0.0), lambda a, x: a + x) / (F.size("errors") / n)).alias("error"), F.element_at(F.array(*[F.lit(x) for x in names]), f + 1).alias("feature")))
    top = F.slice(F.reverse(F.array_sort(by_feature)), 1, k)
    return scored.select(*keys, F.posexplode(top).alias("i", "t")).select(*keys, (F.col("i") + 1).alias("rank"), "t.feature", "t.error")


def worst_window_features(scored: DataFrame, keys: Sequence[str], windows: int = 10) -> DataFrame:
    """Mean error by place over the windows of largest error."""
    return scored.orderBy(F.desc("error"), *keys).limit(windows).select(F.posexplode("errors").alias("place", "e")).groupBy("place").agg(F.avg("e").alias("mean_error"))


def window_map(windows: DataFrame, vector: str, keys: Sequence[str]) -> tuple[DataFrame, list[float]]:
    """Two principal coordinates of each window, and the shares of variance that they explain."""
    rows = windows.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(rows.select("_v"))
    at = model.transform(rows).withColumn("_a", vector_to_array("_p"))
    return at.select(*keys, F.element_at("_a", 1).alias("pc1"), F.element_at("_a", 2).alias("pc2")), [float(x) for x in model.explainedVariance]


def mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else float(n == 2)


def isolation_tree(points: np.ndarray, rng: np.random.Generator, depth: int = 0) -> tuple:
    low, high = points.min(axis=0), points.max(axis=0)
    if len(points) <= 1 or depth >= 8 or not (high > low).any():
        return (float(depth + mean_path(len(points))),)
    f = int(rng.choice(np.flatnonzero(high > low)))
    cut = float(rng.uniform(low[f], high[f]))
    left = points[:, f] < cut
    return (f, cut, isolation_tree(points[left], rng, depth + 1), isolation_tree(points[~left], rng, depth + 1))


def path_lengths(tree: tuple, points: np.ndarray, out: np.ndarray, rows: np.ndarray) -> None:
    if len(tree) == 1:
        out[rows] += tree[0]
        return
    f, cut, left, right = tree
    on = points[rows, f] < cut
    for part, sub in ((rows[on], left), (rows[~on], right)):
        if len(part):
            path_lengths(sub, points, out, part)


def isolation_scores(train: DataFrame, windows: DataFrame, vector: str, key: str, trees: int = TREES, seed: int = 42, contamination: float = 0.01) -> DataFrame:
    """windows with score (higher: more isolated) and outlier (above the training scores' upper `contamination`).

    Each tree sees about SUBSAMPLE rows, those whose hash for the tree falls into a share of
    all 63-bit hashes, at any number of rows; a row is copied only for the trees that take it.
    Trees are built in parallel and, at some hundred nodes each, sent to all tasks.
    """
    n = train.count()
    below = min(2**63 - 1, 2**63 * SUBSAMPLE // max(n, 1))
    mine = F.filter(F.sequence(F.lit(1), F.lit(trees)), lambda t: F.xxhash64(F.col(key), t, F.lit(seed)).bitwiseAND(F.lit(2**63 - 1)) <= below)
    picked = train.select(key, F.col(vector).alias("v"), F.explode(mine).alias("tree"))

    def build(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key)
        tree = isolation_tree(np.stack(rows["v"]).astype(float), np.random.default_rng(seed + int(k[0])))
        return pd.DataFrame({"tree": [int(k[0])], "nodes": [json.dumps(tree)], "n": [len(rows)]})

    grown = picked.groupBy("tree").applyInPandas(build, "tree int, nodes string, n int").orderBy("tree").collect()
    sent = windows.sparkSession.sparkContext.broadcast([json.loads(r.nodes) for r in grown])
    usual = mean_path(float(np.mean([r.n for r in grown])) if grown else 2.0)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            if not len(x):
                yield pd.Series(dtype=float)
                continue
            points, total = np.stack(x.to_numpy()).astype(float), np.zeros(len(x))
            for tree in sent.value:
                path_lengths(tree, points, total, np.arange(len(x)))
            yield pd.Series(2.0 ** (-total / max(len(sent.value), 1) / max(usual, 1e-9)))

    limit = one_row(train.select(score(vector).alias("s")), ["s"], [1 - contamination]).select(F.col("s")[0].alias("_limit"))
    # One row.
    return windows.withColumn("score", score(vector)).join(F.broadcast(limit)).withColumn("outlier", F.col("score") > F.col("_limit")).drop("_limit")


def group_hold_out(rows: DataFrame, group: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Tags whole groups `val`: the first max(1, floor(n share)) of them by a seeded hash, the others `train`."""
    groups = rows.select(group).distinct().withColumn("_h", F.xxhash64(F.lit(seed), F.col(group)))
    n = groups.count()
    most = max(1, int(n * share))
    # The groups chosen are a bounded share of the clips, ranked by a global top-k.
    chosen = groups.orderBy("_h").limit(most).select(group, F.lit(True).alias("_val"))
    return rows.join(chosen.hint("merge"), group, "left").withColumn("split", F.when(F.col("_val"), "val").otherwise("train")).drop("_val")


#: Trees and depth of the forest, rows that a tree sees, and the least rows of a leaf.
FOREST_TREES, FOREST_DEPTH, BAG, LEAST_LEAF = 300, 12, 2048, 2


def grown(x: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int, depth: int, rng: np.random.Generator) -> dict[str, list]:
    """A classification tree by Gini impurity over a random root-sized set of features at each node: feature (-1 in leaves), cut, children and class shares by node."""
    tree: dict[str, list] = {"feature": [], "cut": [], "left": [], "right": [], "shares": []}
    tries = max(1, round(x.shape[1] ** 0.5))
    onehot = np.eye(classes)[y] * weight[:, None]
    waiting = [(np.arange(len(y)), 0, None)]
    while waiting:
        rows, level, parent = waiting.pop()
        node, counts = len(tree["feature"]), onehot[rows].sum(axis=0)
        if parent is not None:
            tree[parent[1]][parent[0]] = node
        for name, value in (("feature", -1), ("cut", 0.0), ("left", -1), ("right", -1), ("shares", (counts / max(counts.sum(), 1e-300)).tolist())):
            tree[name].append(value)
        if level >= depth or len(rows) < 2 * LEAST_LEAF or (counts > 0).sum() < 2:
            continue
        best = (1e-12, None, None, None)
        whole = counts.sum() - (counts**2).sum() / counts.sum()
        for f in rng.permutation(x.shape[1])[:tries]:
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, left = x[order, f], np.cumsum(onehot[order], axis=0)[LEAST_LEAF - 1 : len(rows) - LEAST_LEAF]
            right = counts - left
            gain = whole - sum(side.sum(axis=1) - (side**2).sum(axis=1) / np.maximum(side.sum(axis=1), 1e-300) for side in (left, right))
            gain[v[LEAST_LEAF - 1 : len(rows) - LEAST_LEAF] >= v[LEAST_LEAF : len(rows) - LEAST_LEAF + 1]] = 0
            at = int(gain.argmax())
            if gain[at] > best[0]:
                k = at + LEAST_LEAF
                best = (gain[at], int(f), float((v[k - 1] + v[k]) / 2), (order[:k], order[k:]))
        if best[1] is not None:
            tree["feature"][node], tree["cut"][node] = best[1], best[2]
            waiting += [(best[3][0], level + 1, (node, "left")), (best[3][1], level + 1, (node, "right"))]
    return tree


def class_shares(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Of each row the class shares of the leaf that it falls into."""
    node = np.zeros(len(x), dtype=np.int64)
    while True:
        feature = tree["feature"][node]
        inner = feature >= 0
        if not inner.any():
            return tree["shares"][node]
        below = x[np.arange(len(x)), np.maximum(feature, 0)] <= tree["cut"][node]
        node = np.where(inner, np.where(below, tree["left"][node], tree["right"][node]), node)


def forest_predictions(rows: DataFrame, features: Sequence[str], label: str, key: str, trees: int = FOREST_TREES, depth: int = FOREST_DEPTH, seed: int = 0) -> DataFrame:
    """The rows tagged val with label (its place among the sorted labels) and prediction of a class-balanced random forest fitted on the others.

    Every tree sees about BAG rows, as many of each class: those whose hash for the tree falls
    into the class's share, whatever the number of rows. Rows of a class with fewer come all,
    with more weight. Trees grow in parallel; one has at most BAG nodes, and all go to every task.
    Rows with a null in a feature or label take no part.
    """
    known = rows.where(F.col(label).isNotNull()).dropna(subset=list(features)).select(F.col(key).alias("_key"), F.col(label).alias("_label"), "split", F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    # One row for each class.
    sizes = {r["_label"]: r["train"] for r in known.groupBy("_label").agg(F.count_if(F.col("split") == "train").alias("train")).collect()}
    names = sorted(sizes)
    place = {name: float(i) for i, name in enumerate(names)}
    share = {name: BAG / max(len(names), 1) / max(sizes[name], 1) for name in names}
    pick = lambda values: F.element_at(F.create_map(*[x for name in names for x in (F.lit(name), F.lit(values[name]))]), F.col("_label"))
    if not names:
        return rows.sparkSession.createDataFrame([], "key string, label double, prediction double")
    data = known.withColumns({"label": pick(place), "_share": pick(share)})
    below = F.least(F.lit(1.0), F.col("_share")) * float(2**63)
    mine = F.filter(F.sequence(F.lit(1), F.lit(trees)), lambda t: F.xxhash64(F.col("_key"), t, F.lit(seed)).bitwiseAND(F.lit(2**63 - 1)).cast("double") < below)
    bags = data.where("split = 'train'").select("_key", "label", "x", F.greatest(F.lit(1.0), F.col("_share")).alias("weight"), F.explode(mine).alias("tree"))

    def build(k: tuple, bag: pd.DataFrame) -> pd.DataFrame:
        bag = bag.sort_values("_key")
        tree = grown(np.stack(bag["x"]), bag["label"].to_numpy().astype(int), bag["weight"].to_numpy(), len(names), depth, np.random.default_rng([seed, int(k[0])]))
        return pd.DataFrame({"tree": [int(k[0])], "nodes": [json.dumps(tree)]})

    made = bags.groupBy("tree").applyInPandas(build, "tree int, nodes string").orderBy("tree").collect()
    if not made:
        return rows.sparkSession.createDataFrame([], "key string, label double, prediction double")
    held = [{name: np.array(v) for name, v in json.loads(r["nodes"]).items()} for r in made]
    sent = rows.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf("double")
    def vote(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if not len(batch):
                yield pd.Series(dtype=float)
                continue
            x = np.stack(batch.to_numpy())
            yield pd.Series(sum(class_shares(tree, x) for tree in sent.value).argmax(axis=1).astype(float))

    return data.where("split = 'val'").select(F.col("_key").cast("string").alias("key"), "label", vote("x").alias("prediction"))


def forest_confusion(rows: DataFrame, features: Sequence[str], label: str, key: str, trees: int = FOREST_TREES, depth: int = FOREST_DEPTH, seed: int = 0) -> DataFrame:
    """Labels against predictions on the rows tagged val."""
    return forest_predictions(rows, features, label, key, trees, depth, seed).groupBy("label", "prediction").agg(F.count("*").alias("n"))


def macro_f1(confusion: DataFrame) -> DataFrame:
    """Mean F1 over labels of a confusion table."""
    counted = confusion.withColumn("c", F.explode(F.array_distinct(F.array("label", "prediction"))))
    hit = (F.col("label") == F.col("c")) & (F.col("prediction") == F.col("c"))
    f1 = counted.groupBy("c").agg((2 * F.sum(F.when(hit, F.col("n")).otherwise(0)) / (F.sum(F.when(F.col("label") == F.col("c"), F.col("n")).otherwise(0)) + F.sum(F.when(F.col("prediction") == F.col("c"), F.col("n")).otherwise(0)))).alias("f1"))
    return f1.agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("classes"))
