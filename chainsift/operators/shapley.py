"""Exact Shapley values of fitted boosted trees, along the paths to their leaves.

For one leaf, a set of known features is worth the leaf's value times, for each feature its path asks for, 1 or 0 (known: the row goes the path's way or
not) or the share of training rows that go that way (unknown). Only the path's own features can have an effect, and what the sets of one size are
worth together is a coefficient of a product with a factor for each feature, so that the values of a path of d features take a number of steps
that is polynomial in d, not 2 ** d."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graphs import shared_folder


def node_table(model, spark) -> DataFrame:
    """(tree, node, feature, threshold, left, right, value, cover) of an MLlib tree ensemble: ``value`` times the tree's weight, ``cover`` the training
    rows of a node; feature -1 for a leaf. The model is written to the shared folder, and its node table read from there."""
    path = f"{shared_folder(spark)}/chainsift/model-{uuid.uuid4().hex}"
    model.write().save(path)
    n = F.col("nodeData")
    rows = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), n["split"]["featureIndex"].alias("feature"), F.try_element_at(n["split"]["leftCategoriesOrThreshold"], F.lit(1)).alias("threshold"), n["leftChild"].alias("left"),
        n["rightChild"].alias("right"), n["prediction"].alias("value"), n["rawCount"].cast("double").alias("cover"), n["split"]["numCategories"].alias("categories"),
    )
    weights = spark.createDataFrame([(k, float(w)) for k, w in enumerate(model.treeWeights)], "tree int, weight double")
    rows = rows.withColumn("categories", F.when(F.col("categories") > 0, F.raise_error(F.lit("splits by category are not supported")).cast("int")).otherwise(F.col("categories")))
    return rows.join(F.broadcast(weights), "tree").withColumn("value", F.col("value") * F.col("weight")).drop("weight", "categories")


@dataclass
class Path:
    """What a leaf asks of a row: ``low < x <= high`` for each of its features, and the share of training rows that meet it where they are unknown."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def leaf_paths(nodes: pd.DataFrame) -> list[Path]:
    """The paths of all trees of a node table (at most trees * 2 ** depth of them)."""
    out = []
    for _, tree in nodes.groupby("tree"):
        at = {r.node: r for r in tree.itertuples()}
        todo: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
        while todo:
            node, asked = todo.pop()
            own = at[node]
            if own.feature < 0:
                f = sorted(asked)
                low, high, share = (np.array([asked[k][c] for k in f], np.float64) for c in range(3))
                out.append(Path(own.value, np.array(f, np.int64), low, high, share))
                continue
            low, high, share = asked.get(own.feature, (-math.inf, math.inf, 1.0))
            for child, new in ((own.left, (low, min(high, own.threshold))), (own.right, (max(low, own.threshold), high))):
                part = at[child].cover / own.cover if own.cover else 0.0
                todo.append((child, asked | {own.feature: (*new, share * part)}))
    return out


def base_value(paths: list[Path]) -> float:
    """What the trees give where no feature is known."""
    return float(sum(p.value * p.share.prod() for p in paths))


def _sizes(present: np.ndarray, absent: np.ndarray) -> np.ndarray:
    """For each row: coefficients of the product over its columns of (absent + present * t), the lowest power first."""
    out = np.ones((len(present), 1))
    for j in range(present.shape[1]):
        longer = np.zeros((len(out), out.shape[1] + 1))
        longer[:, :-1] = out * absent[j]
        longer[:, 1:] += out * present[:, j : j + 1]
        out = longer
    return out


def shapley_values(x: np.ndarray, paths: list[Path]) -> np.ndarray:
    """Effects (rows x features): they add up to the trees' sum for the row minus the base value. A missing value goes to the right, as in MLlib."""
    out = np.zeros(x.shape)
    for p in paths:
        d = len(p.features)
        if not d:
            continue
        own = x[:, p.features]
        met = (~(own <= p.low) | np.isneginf(p.low)) & ((own <= p.high) | np.isposinf(p.high))
        kinds, which = np.unique(met, axis=0, return_inverse=True)
        present = kinds.astype(np.float64)
        weight = np.array([math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)])
        for i in range(d):
            others = np.arange(d) != i
            worth = _sizes(present[:, others], p.share[others]) @ weight
            out[:, p.features[i]] += (p.value * (present[:, i] - p.share[i]) * worth)[which.ravel()]
    return out


def attributions(model, features: DataFrame, names: list[str], top: int | None = 3, scale: float = 2.0) -> DataFrame:
    """(scenario, feature, effect, rank, base, score): exact path attributions of a fitted boosted model in log-odds, by size (ties by name), the
    ``top`` ones of each row (all where None).

    A row's effects add up to score - base. ``scale``: log-odds for a unit of the trees' sum (2 for MLlib's classifier). The paths (trees * 2 ** depth at most) go to all
    tasks, rows stay where they are."""
    spark = features.sparkSession
    paths = leaf_paths(node_table(model, spark).toPandas())
    for p in paths:
        p.value *= scale
    shared, base = spark.sparkContext.broadcast(paths), base_value(paths)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = shapley_values(np.array(b["x"].tolist(), np.float64).reshape(len(b), len(names)), shared.value)
            yield pd.DataFrame({"scenario": b["scenario"], "base": base, "score": base + found.sum(axis=1), "effects": list(found)})

    kind = features.schema["scenario"].dataType.simpleString()
    rows = features.select("scenario", F.array(*[F.col(n).cast("double") for n in names]).alias("x")).mapInPandas(run, f"scenario {kind}, base double, score double, effects array<double>")
    each = F.array(*[F.struct(F.lit(n).alias("feature"), F.col("effects")[k].alias("effect")) for k, n in enumerate(names)])
    order = F.array_sort(F.transform(each, lambda e: F.struct((-F.abs(e["effect"])).alias("size"), e["feature"].alias("feature"), e["effect"].alias("effect"))))
    long = rows.select("scenario", "base", "score", F.posexplode(order if top is None else F.slice(order, 1, top)).alias("at", "e"))
    return long.select("scenario", F.col("e.feature").alias("feature"), F.col("e.effect").alias("effect"), (F.col("at") + 1).alias("rank"), "base", "score")
