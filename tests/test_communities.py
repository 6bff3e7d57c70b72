"""Communities, diameters, longest paths and triangles against plain versions, in tasks and as Spark jobs."""

import random
from collections import Counter, deque
from itertools import combinations

import numpy as np
import pytest
from chainsift.operators import communities as C
from chainsift.operators import graphs as G


def graph(rng, n, m):
    pairs = set()
    while len(pairs) < m:
        a, b = rng.sample(range(n), 2)
        pairs.add((min(a, b), max(a, b)))
    return sorted(pairs)


def plain_modularity(edges, label):
    total = sum(w for *_, w in edges)
    inside, k = Counter(), Counter()
    for a, b, w in edges:
        k[label[a]] += w
        k[label[b]] += w
        inside[label[a]] += w * (label[a] == label[b])
    return sum(inside[c] / total - (k[c] / (2 * total)) ** 2 for c in k)


CLIQUES = [(x, y) for names in ("abcde", "vwxyz") for x, y in combinations(names, 2)] + [("e", "v")]


@pytest.mark.parametrize("in_task", [100, 3])
def test_two_cliques_and_a_bridge(spark, in_task):
    rows = [(g, x, y, 1.0) for g in (1, 2) for x, y in CLIQUES] + [(1, "b", "a", 0.0), (3, "p", "q", 2.0)]
    found = C.greedy_communities(spark.createDataFrame(rows, "group long, a string, b string, weight double"), in_task).collect()
    for g in (1, 2):
        own = {r["node"]: r["community"] for r in found if r["group"] == g}
        assert own == {**dict.fromkeys("abcde", 1), **dict.fromkeys("vwxyz", 2)}
        q = plain_modularity([(x, y, 1) for x, y in CLIQUES], own)
        assert {r["modularity"] for r in found if r["group"] == g} == {round(q, 9)}
    assert sorted((r["node"], r["community"], r["modularity"]) for r in found if r["group"] == 3) == [("p", 1, 0.0), ("q", 1, 0.0)]


def test_unions_never_lower_modularity():
    rng = random.Random(3)
    for _ in range(20):
        n = rng.randint(4, 30)
        edges = [(a, b, rng.choice([1, 2, 5])) for a, b in graph(rng, n, rng.randint(3, min(60, n * (n - 1) // 2)))]
        label = C._merged(n, *map(list, zip(*edges)))
        q = plain_modularity(edges, label)
        assert q >= plain_modularity(edges, range(n)) - 1e-12
        # no union of two communities would raise it further
        for x, y in combinations(set(label), 2):
            assert plain_modularity(edges, [x if c == y else c for c in label]) <= q + 1e-9


def plain_diameter(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = 0
    for start in near:
        far, todo = {start: 0}, deque([start])
        while todo:
            x = todo.popleft()
            for y in near[x] - far.keys():
                far[y] = far[x] + 1
                todo.append(y)
        out = max(out, *far.values())
    return out


def test_diameters(spark):
    rng = random.Random(5)
    groups = {g: graph(rng, 25, rng.randint(3, 40)) for g in range(12)}
    groups[12] = [(k, k + 1) for k in range(9)]
    rows = spark.createDataFrame([(g, *e) for g, own in groups.items() for e in own] + [(0, 1, 1)], "community long, a long, b long")
    want = {g: plain_diameter(own) for g, own in groups.items()}
    assert {r["community"]: r["diameter"] for r in C.diameters(rows).collect()} == want
    few = rows.where("community in (3, 4, 12)")
    assert {r["community"]: r["diameter"] for r in C.diameters(few, in_task=5).collect()} == {g: want[g] for g in (3, 4, 12)}
    assert C.diameters(rows.limit(0)).count() == 0


def test_long_path_and_star_need_few_searches():
    a = np.arange(10_000)
    path, searches = C.exact_diameter(a, a + 1)
    assert path == 10_000 and searches <= 6
    star, searches = C.exact_diameter(np.zeros(10_000, int), a + 1)
    assert star == 2 and searches <= 4


def plain_longest(edges, cap):
    near, nodes = {}, {x for e in edges for x in e}
    for u, v in edges:
        near.setdefault(u, []).append(v)
    memo, path = {}, set()

    def deep(x):
        if x in path:
            raise RecursionError
        if x not in memo:
            path.add(x)
            memo[x] = max((1 + deep(y) for y in near.get(x, [])), default=0)
            path.discard(x)
        return memo[x]

    try:
        return max(map(deep, nodes))
    except RecursionError:
        pass
    out = 0
    for start in nodes:
        far, todo = {start: 0}, deque([start])
        while todo:
            x = todo.popleft()
            if far[x] < cap:
                for y in near.get(x, []):
                    if y not in far:
                        far[y] = far[x] + 1
                        todo.append(y)
        out = max(out, *far.values())
    return out


def test_longest_paths(spark):
    rng = random.Random(8)
    groups = {g: sorted({(a, b) if g % 3 else tuple(rng.sample((a, b), 2)) for a, b in graph(rng, 40, rng.randint(5, 60))}) for g in range(15)}
    groups[15] = [(k, (k + 1) % 30) for k in range(30)]  # a ring
    groups[16] = [(k, k + 1) for k in range(25)] + [(3, 90), (90, 91), (91, 20)]
    groups[17] = [(0, 1), (1, 2), (2, 1), (2, 3), (3, 4)]
    rows = spark.createDataFrame([(g, f"n{u}", f"n{v}") for g, own in groups.items() for u, v in own], "scenario long, u string, v string")
    want = {g: plain_longest(own, 9) for g, own in groups.items()}
    assert {r["scenario"]: r["steps"] for r in C.longest_paths(rows, 9).collect()} == want
    few = rows.where("scenario in (0, 1, 3, 15, 16, 17)")
    assert {r["scenario"]: r["steps"] for r in C.longest_paths(few, 9, in_task=1).collect()} == {g: want[g] for g in (0, 1, 3, 15, 16, 17)}


def test_ten_thousand_steps_in_few_jobs(spark):
    rows = spark.range(10_000).selectExpr("1L as scenario", "concat('n', id) as u", "concat('n', id + 1) as v")
    context = spark.sparkContext
    context.setJobGroup("long-path", "a path of 10,000 steps")
    # adaptive plans run each shuffle as a job of its own, broadcasts are jobs as well
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = C.longest_paths(rows, in_task=100).collect()
        jobs = len(context.statusTracker().getJobIdsForGroup("long-path"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [r["steps"] for r in found] == [10_000] and jobs < 40, jobs
    assert C._longest(list(range(10_000)), list(range(1, 10_001)), 10_001) == 10_000


def test_triangles(spark):
    rng = random.Random(9)
    groups = {g: graph(rng, 18, 70) for g in range(4)}
    groups[4] = [(0, k) for k in range(1, 200)] + [(k, k + 1) for k in range(1, 199)]  # a hub
    rows = spark.createDataFrame([(g, f"{a:03d}", f"{b:03d}") for g, own in groups.items() for a, b in own], "scenario long, a string, b string")
    want = Counter()
    for g, own in groups.items():
        held, nodes = set(own), sorted({x for e in own for x in e})
        near = {x: {b if a == x else a for a, b in own if x in (a, b)} for x in nodes}
        for x in nodes:
            n = sum((min(p), max(p)) in held for p in combinations(near[x], 2))
            if n:
                want[g, f"{x:03d}"] = n
    assert {(r["scenario"], r["node"]): r["t"] for r in C.triangles(rows).collect()} == want


def test_community_metrics_of_a_path_and_a_star(spark):
    path = [(f"p{k:02d}", f"p{k + 1:02d}", 1) for k in range(20)]
    star = [("s", f"t{k}", 1) for k in range(20)]
    pairs = spark.createDataFrame(path + star, "a string, b string, weight long")
    members = G.connected(pairs).select("node", "label").toDF("node", "community")
    found = {r["community"]: (r["size"], r["inner_edges"], r["diameter"]) for r in G.community_metrics(pairs, members).collect()}
    assert found == {"p00": (21, 20, 20), "s": (21, 20, 2)}
