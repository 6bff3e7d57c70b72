"""Boosted trees over several classes: a tree for each class and round on the slopes of the softmax loss.

MLlib boosts two classes only. The trees are grown on all labelled rows. Slopes, curvatures and losses are added up as whole numbers (2 ** -24 each), so that
sums, and with them the trees, are the same however the rows are dealt: a small table's in one task (``Boosting.rows``), a larger one's by Spark jobs."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import _cut, _drop
from .ordering import ranked

SCALE = float(1 << 24)


@dataclass(frozen=True)
class Boosting:
    """How the trees are grown; a tenth of the rows tells when to stop. Up to ``rows`` rows go through one task, more through jobs, to the same trees."""

    rows: int = 20_000
    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 64  # 256 at most
    least: float = 1.0  # summed weight of a leaf's rows, at least (the mean row weighs 1)
    ridge: float = 1.0
    patience: int = 8
    kept: int = 8  # rounds after which rows are written with their sums anew, where jobs do it


Sampled = Boosting  # its name until all rows were used


@dataclass
class Tree:
    """Nodes in a heap: node k has the children 2k + 1 and 2k + 2; feature -1 for a leaf. ``cut``: the threshold's place among the feature's cuts."""

    feature: np.ndarray
    cut: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    @classmethod
    def bare(cls, depth: int) -> Tree:
        size = 2 ** (depth + 1) - 1
        return cls(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size), np.zeros(size))

    def place(self, x: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """The node at which each row ends: by ``threshold`` for values, by ``cut`` for bins."""
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while (inner := self.feature[at] >= 0).any():
            f = np.maximum(self.feature[at], 0)
            at = np.where(inner, 2 * at + 1 + (x[rows, f] > limits[at]), at)
        return at

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.place(x, self.threshold)]


def _softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Boosted:
    classes: list[str]
    start: np.ndarray
    rounds: list[list[Tree]]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        raw = np.tile(self.start, (len(x), 1))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                raw[:, k] += tree(x)
        return _softmax(raw)


def _moved(raw: np.ndarray, bins: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    """``raw`` after further rounds."""
    raw = raw.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            raw[:, k] += tree.value[tree.place(bins, tree.cut)]
    return raw


def _sums(bins: np.ndarray, label: np.ndarray, watched: np.ndarray, raw: np.ndarray, weight: np.ndarray, trees: list[Tree], level: int, width: int) -> tuple[np.ndarray, int]:
    """Slopes, curvatures and weights by class, node of the ``level``, feature and bin, over the rows that are not watched; and the watched rows' loss.
    Of two children the second has zeros: what its parent has besides the first."""
    features, classes, first = bins.shape[1], raw.shape[1], 2**level - 1
    place = bins + np.arange(features, dtype=np.intp) * width
    p, w = _softmax(raw), weight[label]
    loss = np.rint(-w[watched] * np.log(np.maximum(p[watched, label[watched]], 1e-12)) * SCALE).sum()
    out = np.zeros((classes, (first + 1) * features * width, 3), np.int64)
    for k, tree in enumerate(trees):
        at = tree.place(bins, tree.cut) - first
        own = np.flatnonzero(~watched & (at >= 0) & (at % 2 == 0))
        slot = (place[own] + at[own, None] * (features * width)).ravel()
        q, v = p[own, k], w[own]
        for j, value in enumerate((v * (q - (label[own] == k)), v * q * (1 - q), v)):
            out[k, :, j] = np.bincount(slot, np.repeat(np.rint(value * SCALE), features), out.shape[1])  # whole numbers: exact up to 2 ** 53
    return out, int(loss)


def _split(trees: list[Tree], level: int, sums: np.ndarray, cuts: list[np.ndarray], how: Boosting) -> bool:
    """Splits the nodes of a level where the sums say that it gains most (ties: the first feature, then the lowest cut); True if any was."""
    split, first, width = False, 2**level - 1, sums.shape[1] // (2**level * len(cuts))
    able = np.arange(width - 1) < np.array([len(c) for c in cuts])[:, None]
    leaf = lambda g, h: -how.rate * g / (h + how.ridge)
    for k, tree in enumerate(trees):
        for i, by_bin in enumerate(sums[k].reshape(2**level, len(cuts), width, 3)):
            node = first + i
            if node and tree.feature[(node - 1) // 2] < 0:
                continue
            g, h, w = by_bin[0].sum(axis=0) / SCALE
            if not node:
                tree.value[0] = leaf(g, h)
            left = np.cumsum(by_bin, axis=1)[:, :-1] / SCALE
            gain = left[..., 0] ** 2 / (left[..., 1] + how.ridge) + (g - left[..., 0]) ** 2 / (h - left[..., 1] + how.ridge) - g * g / (h + how.ridge)
            gain = np.where(able & (left[..., 2] >= how.least) & (w - left[..., 2] >= how.least), gain, 0.0)
            if gain.size and gain.max() > 1e-9:
                f, c = np.unravel_index(int(gain.argmax()), gain.shape)
                tree.feature[node], tree.cut[node], tree.threshold[node], split = f, c, cuts[f][c], True
                tree.value[2 * node + 1] = leaf(*left[f, c, :2])
                tree.value[2 * node + 2] = leaf(g - left[f, c, 0], h - left[f, c, 1])
    return split


def _boost(classes: list[str], cuts: list[np.ndarray], watches: bool, measure: Callable, how: Boosting) -> Boosted:
    """Rounds until the watched rows' loss has not fallen for ``patience`` of them. ``measure(rounds, trees, level)``: ``_sums`` over all rows."""
    out, best, kept = Boosted(classes, np.zeros(len(classes)), []), np.inf, 0
    while True:
        trees = [Tree.bare(how.depth) for _ in classes]
        sums, loss = measure(out.rounds, trees, 0)
        done = len(out.rounds)
        if done and watches:
            if loss / SCALE < best - 1e-9:
                best, kept = loss / SCALE, done
            elif done - kept >= how.patience:
                break
        if done == how.rounds:
            break
        level = 0
        while _split(trees, level, sums, cuts, how) and level + 1 < how.depth:
            level += 1
            above = sums.reshape(len(classes), 2 ** (level - 1), -1, 3)
            sums = measure(out.rounds, trees, level)[0].reshape(len(classes), 2**level, -1, 3)
            sums[:, 1::2] = above - sums[:, ::2]
            sums = sums.reshape(len(classes), -1, 3)
        out.rounds.append(trees)
    if watches:
        out.rounds = out.rounds[: max(1, kept)]
    return out


def _weights(counts: np.ndarray) -> np.ndarray:
    """A weight for each class, so that classes weigh the same and the mean row 1."""
    return counts.sum() / (len(counts) * np.maximum(counts, 1))


def _places(bins: int, n: int) -> list[int]:
    """Where in order the cuts lie: the lower of the two values at each quantile."""
    return np.floor(np.linspace(0, 1, bins + 1)[1:-1] * (n - 1)).astype(np.int64).tolist()


def fit_classes(x: np.ndarray, label: np.ndarray, watched: np.ndarray, classes: list[str], how: Boosting = Boosting()) -> Boosted:
    """Boosts on the rows that are not ``watched``, classes weighted to equal sums."""
    order = np.sort(x, axis=0)
    cuts = [np.unique(order[_places(how.bins, len(x)), f]) for f in range(x.shape[1])]
    cuts = [c[c < order[-1, f]] for f, c in enumerate(cuts)]
    bins = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1).astype(np.uint8)
    weight = _weights(np.bincount(label[~watched], minlength=len(classes)))
    held = [0, np.zeros((len(x), len(classes)))]

    def measure(rounds: list[list[Tree]], trees: list[Tree], level: int) -> tuple[np.ndarray, int]:
        held[:] = len(rounds), _moved(held[1], bins, rounds[held[0] :])
        return _sums(bins, label, watched, held[1], weight, trees, level, how.bins)

    return _boost(classes, cuts, bool(watched.any()), measure, how)


def _cuts(rows: DataFrame, features: int, n: int, bins: int) -> list[np.ndarray]:
    """The cuts of each feature of (x array<double>), exact: different values are counted and dealt in order."""
    values = rows.select(F.posexplode("x").alias("f", "v")).groupBy("f", "v").agg(F.count("*").alias("c"))
    up = F.col("up") - F.col("f") * n  # each feature has n values
    found = ranked(values, [F.col("f"), F.col("v")], {"up": "c"}).select("f", "v", (up - F.col("c")).alias("low"), up.alias("up"))
    at = F.array(*map(F.lit, sorted({*_places(bins, n), n - 1})))
    found = found.where(F.exists(at, lambda k: (k >= F.col("low")) & (k < F.col("up")))).orderBy("f", "v").toPandas()  # at most ``bins`` rows a feature
    return [own["v"].to_numpy()[:-1] for _, own in found.groupby("f")]


def _decoded(batches: Iterator[pa.RecordBatch], classes: int, features: int, size: int = 8_192) -> Iterator[tuple]:
    for whole in batches:
        for lo in range(0, len(whole), size):
            part = whole.slice(lo, size)
            bins = np.frombuffer(b"".join(part["bins"].to_pylist()), np.uint8).reshape(-1, features)
            raw = np.frombuffer(b"".join(part["raw"].to_pylist())).reshape(-1, classes)
            yield part, bins, part["label"].to_numpy(), part["watched"].to_numpy(zero_copy_only=False), raw


def _fit_spread(rows: DataFrame, n: int, features: int, how: Boosting) -> Boosted:
    """``fit_classes`` over (watched, label, x) by a job for each level of a round's trees: tasks add up their rows, Spark adds up the tasks. What comes
    to the driver has a row for each class, node, feature and bin."""
    found = rows.groupBy("label").agg(F.count_if(~F.col("watched")).alias("n"), F.count_if("watched").alias("w")).orderBy("label").collect()  # a row a class
    classes, weight = [r["label"] for r in found], _weights(np.array([r["n"] for r in found]))
    cuts, number = _cuts(rows, features, n, how.bins), {r["label"]: k for k, r in enumerate(found)}
    schema = "watched boolean, label int, bins binary, raw binary"
    binary = lambda a: pa.array([bytes(r) for r in np.ascontiguousarray(a)], pa.binary())

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b["x"].flatten().to_numpy().reshape(-1, features)
            bins = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1).astype(np.uint8)
            label = pa.array([number[v] for v in b["label"].to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([b["watched"], label, binary(bins), binary(np.zeros((len(b), len(classes))))], names=["watched", "label", "bins", "raw"])

    at = [0, _cut(rows.select("watched", "label", "x").mapInArrow(binned, schema), "boosted")]

    def measure(rounds: list[list[Tree]], trees: list[Tree], level: int) -> tuple[np.ndarray, int]:
        if len(rounds) - at[0] >= how.kept:
            ended = rounds[at[0] :]

            def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for part, bins, _, _, raw in _decoded(batches, len(classes), features):
                    yield pa.RecordBatch.from_arrays([part["watched"], part["label"], part["bins"], binary(_moved(raw, bins, ended))], names=["watched", "label", "bins", "raw"])

            new = _cut(at[1].mapInArrow(moved, schema), "boosted")
            _drop(at[1])
            at[:] = len(rounds), new
        since = rounds[at[0] :]

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, loss = 0, 0
            for _, bins, label, watched, raw in _decoded(batches, len(classes), features):
                own, lost = _sums(bins, label, watched, _moved(raw, bins, since), weight, trees, level, how.bins)
                sums, loss = sums + own, loss + lost
            if np.ndim(sums):
                flat = sums.reshape(-1, 3)
                slot = np.flatnonzero(flat.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(np.append(slot, -1)), *[pa.array(np.append(flat[slot, j], loss if j == 0 else 0)) for j in range(3)]], names=["slot", "g", "h", "w"])

        got = at[1].mapInArrow(added, "slot long, g long, h long, w long").groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("w").alias("w")).toArrow()
        slot, *sums = (got.column(c).to_numpy() for c in ("slot", "g", "h", "w"))
        out = np.zeros((len(classes) * 2**level * features * how.bins + 1, 3), np.int64)
        out[slot] = np.stack(sums, axis=1)  # the loss stands last
        return out[:-1].reshape(len(classes), -1, 3), int(out[-1, 0])

    model = _boost(classes, cuts, any(r["w"] for r in found), measure, how)
    _drop(at[1])
    return model


def boost_classes(train: DataFrame, names: list[str], label: str = "pattern_type", key: str = "scenario", seed: int = 42, how: Boosting = Boosting()) -> Boosted:
    """Trees fitted on all rows of (key, label, names ...); rows without a label or of a null feature are left out. Those whose key has a hash divisible by
    ten are watched. What comes to the driver are sums and trees, not rows."""
    if not 2 <= how.bins <= 256:
        raise ValueError("bins must be from 2 to 256")
    x = F.array(*[F.col(n).cast("double") for n in names])
    watched = F.coalesce(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10)) == 0, F.lit(False))
    rows = train.where(F.col(label).isNotNull()).select(watched.alias("watched"), F.col(label).alias("label"), x.alias("x")).where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    rows = _cut(rows, "labelled")
    n = rows.count()
    if not n:
        raise ValueError("no labelled rows to learn from")
    if n > how.rows:
        model = _fit_spread(rows, n, len(names), how)
    else:

        def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            table = pd.concat(list(batches))
            classes = sorted(table["label"].unique())
            made = fit_classes(np.array(table["x"].tolist(), np.float64), table["label"].map({c: k for k, c in enumerate(classes)}).to_numpy(), table["watched"].to_numpy(), classes, how)
            yield pd.DataFrame({"model": [pickle.dumps(made)]})

        model = pickle.loads(rows.coalesce(1).mapInPandas(fit, "model binary").first()["model"])
    _drop(rows)
    return model


def class_probabilities(model: Boosted, features: DataFrame, names: list[str], key: str = "scenario") -> DataFrame:
    """(key, p array<double>): a row's probabilities, in the order of ``model.classes``; a null feature counts as 0. They add up to 1."""
    shared = features.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "p": list(shared.value.probabilities(np.array(b["x"].tolist(), np.float64).reshape(len(b), len(names))))})

    x = F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names])
    return features.select(key, x.alias("x")).mapInPandas(run, f"{key} {features.schema[key].dataType.simpleString()}, p array<double>")
