"""Boosting over several classes, and local moves that never lose modularity."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
from chainsift.operators import boosting as B
from chainsift.operators import communities as C
from chainsift.operators import detect as D
from chainsift.operators import models as M
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import functions as F

NAMES = [f"f{k}" for k in range(6)]


def made(spark, n, seed):
    """Three classes parted by sums and products of features, which single cuts do not part."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, len(NAMES)))
    kind = np.where(x[:, 0] + x[:, 1] > 0.6, "layering", np.where(x[:, 2] * x[:, 3] > 0, "mixing", "peeling_chain"))
    return spark.createDataFrame([(k, c, *map(float, v)) for k, (c, v) in enumerate(zip(kind, x))], "scenario long, pattern_type string, " + ", ".join(f"{n} double" for n in NAMES))


def macro(rows):
    hit, said, real = Counter(), Counter(), Counter()
    for actual, predicted in rows:
        said[predicted] += 1
        real[actual] += 1
        hit[actual] += actual == predicted
    return np.mean([2 * hit[c] / (said[c] + real[c]) for c in real])


def test_boosting_beats_the_forest(spark):
    train, test = made(spark, 1500, 1).cache(), made(spark, 800, 2).cache()
    actual = {r["scenario"]: r["pattern_type"] for r in test.collect()}
    got = {r["scenario"]: r["typology"] for r in M.typology_scores(train, test, NAMES).collect()}
    boosted = macro([(actual[k], got[k]) for k in actual])
    index = StringIndexer(inputCol="pattern_type", outputCol="label", stringOrderType="alphabetAsc").fit(train)
    vectors = VectorAssembler(inputCols=NAMES, outputCol="features")
    forest = RandomForestClassifier(labelCol="label", numTrees=40, maxDepth=6, seed=42).fit(vectors.transform(index.transform(train)))
    said = {r["scenario"]: index.labels[int(r["prediction"])] for r in forest.transform(vectors.transform(test)).collect()}
    assert boosted > macro([(actual[k], said[k]) for k in actual]) and boosted > 0.9
    kinds = ["layering", "mixing", "peeling_chain", "ransomware"]
    for r in M.typology_probabilities(train, test, NAMES, kinds).collect():
        assert abs(sum(r[f"p_{k}"] for k in kinds) - 1) < 1e-5 and r["p_ransomware"] == 0


def test_boosting_of_odd_tables(spark):
    one = made(spark, 30, 3).where("pattern_type = 'mixing'")
    assert {r["typology"] for r in M.typology_scores(one, one, NAMES).collect()} == {"mixing"}
    model = B.boost_classes(made(spark, 200, 4), NAMES, how=B.Sampled(rounds=3))
    assert np.allclose(model.probabilities(np.zeros((4, len(NAMES)))).sum(axis=1), 1)
    same = np.zeros((20, 2))  # nothing to cut
    flat = B.fit_classes(same, np.array([0, 1] * 10), np.zeros(20, bool), ["a", "b"])
    assert np.allclose(flat.probabilities(same), 0.5)


def test_all_rows_are_learnt_from_and_jobs_give_the_trees_of_one_task(spark):
    rows = made(spark, 900, 5).withColumn("f5", F.round("f5")).withColumn("f4", F.lit(1.0))
    one, many = (B.boost_classes(t, NAMES, how=B.Boosting(rows=k, rounds=11, kept=4)) for t, k in ((rows.coalesce(1), 900), (rows.repartition(7), 40)))
    assert one.classes == many.classes and len(one.rounds) == len(many.rounds) > 4
    for a, b in zip([t for r in one.rounds for t in r], [t for r in many.rounds for t in r]):
        assert all(np.array_equal(x, y) for x, y in ((a.feature, b.feature), (a.threshold, b.threshold), (a.value, b.value)))
    # a class of a few rows among many is seen by any bound
    few = rows.unionByName(rows.limit(3).withColumn("pattern_type", F.lit("ransomware")).withColumn("scenario", F.col("scenario") + 5_000))
    assert B.boost_classes(few, NAMES, how=B.Boosting(rows=40, rounds=1)).classes == ["layering", "mixing", "peeling_chain", "ransomware"]


def planted(rng, groups, size, inside, across):
    n = groups * size
    return [(a, b, rng.choice([1, 1, 3])) for a, b in combinations(range(n), 2) if rng.random() < (inside if a // size == b // size else across)]


def test_moves_reach_the_greedy_partition(spark):
    rng = random.Random(6)
    ring = [(g * 5 + x, g * 5 + y, 1) for g in range(8) for x, y in combinations(range(5), 2)] + [(g * 5, (g * 5 + 5) % 40 + 1, 1) for g in range(8)]
    for edges in (ring, planted(rng, 3, 12, 0.4, 0.1)):
        df = spark.createDataFrame([(1, f"{a:03d}", f"{b:03d}", w) for a, b, w in edges], "group long, a string, b string, weight long")
        found = D.louvain(df.select("a", "b", "weight"))
        q = C.modularity(df, found.selectExpr("1L as group", "node", "community")).first()["modularity"]
        assert q >= C.greedy_communities(df).first()["modularity"] - 0.01


def test_no_round_loses(spark, monkeypatch):
    """The partition of every round, by its modularity."""
    rng = random.Random(7)
    edges = planted(rng, 3, 9, 0.5, 0.15)
    df = spark.createDataFrame([(1, f"{a:03d}", f"{b:03d}", w) for a, b, w in edges], "group long, a string, b string, weight long")
    seen = []
    cut = D._cut

    def watched(rows, name):
        out = cut(rows, name)
        if name == "part":
            seen.append(C.modularity(df, out.selectExpr("1L as group", "node", "community")).first()["modularity"])
        return out

    monkeypatch.setattr(D, "_cut", watched)
    both = df.select("a", "b", "weight").unionByName(df.selectExpr("b as a", "a as b", "weight"))
    D._moved(cut(both, "both"), 2 * sum(w for *_, w in edges))
    assert len(seen) > 2 and all(x < y + 1e-9 for x, y in zip(seen, seen[1:]))
