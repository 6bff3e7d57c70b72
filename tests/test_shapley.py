"""Exact attributions against the mean over all subsets of features."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
from chainsift.operators import models as M
from chainsift.operators import shapley as X


def grown(rng, depth, features, rows):
    """A node table of one tree with shuffled features, some of which come again on a path."""
    out, todo = [], [(0, 0, rows)]
    made = 1
    while todo:
        node, level, cover = todo.pop()
        if level == depth or cover < 2 or (level and rng.random() < 0.15):
            out.append((0, node, -1, None, -1, -1, float(rng.normal()), float(cover)))
            continue
        left = int(rng.integers(1, cover))
        out.append((0, node, int(rng.integers(features)), float(rng.normal()), made, made + 1, 0.0, float(cover)))
        todo += [(made, level + 1, left), (made + 1, level + 1, cover - left)]
        made += 2
    return pd.DataFrame(out, columns=["tree", "node", "feature", "threshold", "left", "right", "value", "cover"])


def known(tree, x, subset):
    """The tree's mean where only the features of ``subset`` are known."""
    at = {r.node: r for r in tree.itertuples()}

    def go(node):
        r = at[node]
        if r.feature < 0:
            return r.value
        if r.feature in subset:
            return go(r.left if x[r.feature] <= r.threshold else r.right)
        return (at[r.left].cover * go(r.left) + at[r.right].cover * go(r.right)) / r.cover

    return go(0)


def test_equals_all_subsets():
    rng = np.random.default_rng(4)
    n = 8
    trees = [grown(rng, 7, n, 400) for _ in range(4)]
    table = pd.concat([t.assign(tree=k) for k, t in enumerate(trees)])
    paths = X.leaf_paths(table)
    x = rng.normal(size=(5, n))
    x[4, 3] = np.nan
    got = X.shapley_values(x, paths)
    for row, own in zip(x, got):
        want = np.zeros(n)
        for tree in trees:
            worth = {s: known(tree, row, set(s)) for k in range(n + 1) for s in combinations(range(n), k)}
            for i in range(n):
                for s in worth:
                    if i not in s:
                        k = math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n)
                        want[i] += k * (worth[tuple(sorted((*s, i)))] - worth[s])
        assert np.allclose(own, want, atol=1e-9, rtol=0)
        assert abs(own.sum() + X.base_value(paths) - sum(known(t, row, set(range(n))) for t in trees)) < 1e-9


def test_effects_of_a_fitted_model_add_up(spark):
    rng = np.random.default_rng(6)
    values = rng.normal(size=(300, 5))
    label = ((values[:, 0] > 0) & (values[:, 2] < 0.4)).astype(int)
    names = ["f0", "f1", "f2", "f3", "f4"]
    rows = spark.createDataFrame([(k, int(y), *map(float, v)) for k, (y, v) in enumerate(zip(label, values))], "scenario long, label int, " + ", ".join(f"{n} double" for n in names))
    model = M.binary_model(rows, names, trees=8, depth=3)
    risk = {r["scenario"]: r["risk"] for r in M.binary_scores(model, rows, names).collect()}
    found = X.attributions(model, rows, names, top=None).collect()
    sums = {}
    for r in found:
        sums.setdefault(r["scenario"], [r["base"], r["score"], 0.0])[2] += r["effect"]
    assert len(sums) == 300
    for scenario, (base, score, total) in sums.items():
        assert abs(base + total - score) < 1e-9
        assert abs(1 / (1 + math.exp(-score)) - risk[scenario]) < 1e-9
    size = {n: np.mean([abs(r["effect"]) for r in found if r["feature"] == n]) for n in names}
    assert min(size["f0"], size["f2"]) > 5 * max(size["f1"], size["f3"], size["f4"])
    best = X.attributions(model, rows, names, top=2).collect()
    assert len(best) == 600 and {r["rank"] for r in best} == {1, 2}
