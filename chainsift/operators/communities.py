"""Modularity communities of scenario graphs, and exact diameters of communities.

Groups of a bounded number of edges are solved in one task each; larger ones go through the same steps as Spark jobs, so that results do not depend on
a group's size."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .graphs import _cut

#: Edges of a group that one task may hold.
IN_TASK = 1_000_000


def _merged(n: int, a: list[int], b: list[int], weight: list[float]) -> np.ndarray:
    """Labels (a member's number) of the communities of a graph: of all pairs of neighbouring communities the one whose union raises modularity most is
    united (ties: the lowest numbers), as long as it rises.

    A pair's gain depends on its own weight and strengths only, so that a union makes new entries for the neighbours of the united one; entries of
    an earlier state are left out when they come up."""
    near: list[dict[int, float]] = [{} for _ in range(n)]
    strength = [0.0] * n
    for x, y, w in zip(a, b, weight):
        strength[x] += w
        strength[y] += w
        if x != y:
            near[x][y] = near[x].get(y, 0.0) + w
            near[y][x] = near[y].get(x, 0.0) + w
    total = sum(strength) / 2
    state = [0] * n  # counts the unions of a community
    gain = lambda x, y: near[x][y] / total - strength[x] * strength[y] / (2 * total * total)
    waiting = [(-gain(x, y), x, y, 0, 0) for x in range(n) for y in near[x] if x < y]
    heapify(waiting)
    label = list(range(n))
    while waiting:
        less, x, y, at_x, at_y = heappop(waiting)
        if state[x] != at_x or state[y] != at_y:
            continue
        if less >= -1e-12:
            break
        keep, gone = (x, y) if len(near[x]) >= len(near[y]) else (y, x)
        label[gone] = keep
        strength[keep] += strength[gone]
        for z, w in near[gone].items():
            del near[z][gone]
            if z != keep:
                near[keep][z] = near[z][keep] = near[keep].get(z, 0.0) + w
        near[gone] = {}
        state[gone] = -1
        state[keep] += 1
        for z in near[keep]:
            p, q = min(keep, z), max(keep, z)
            heappush(waiting, (-gain(p, q), p, q, state[p], state[q]))
    for k in range(n):
        top = k
        while label[top] != top:
            top = label[top]
        while label[k] != top:
            label[k], k = top, label[k]
    return np.array(label)


def _numbered(members: DataFrame) -> DataFrame:
    """(group, node, community): communities of each group as 1, 2, ... by size, then by their lowest node."""
    size = members.groupBy("group", "label").agg(F.count("*").alias("n"), F.min("node").alias("low"))
    size = size.withColumn("community", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("n"), "low")))
    return members.join(size.select("group", "label", "community"), ["group", "label"]).select("group", "node", "community")


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(group, modularity) of edges (group, a, b, weight) under a partition (group, node, community); a group without edges has no row."""
    a, b = (members.select("group", F.col("node").alias(c), F.col("community").alias(f"c{c}")) for c in ("a", "b"))
    return partition_modularity(edges.join(a, ["group", "a"]).join(b, ["group", "b"]))


def partition_modularity(both: DataFrame) -> DataFrame:
    """(group, modularity) of edges whose ends lie in the communities ``ca`` and ``cb``: (group, ca, cb, weight)."""
    # an edge adds its weight to the strength of both ends' communities, and twice to the inside where they are one
    ends = both.select("group", F.explode(F.array("ca", "cb")).alias("community"), F.col("weight").alias("k"), F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0).alias("inside"))
    per = ends.groupBy("group", "community").agg(F.sum("k").alias("k"), F.sum("inside").alias("inside"))
    sums = per.groupBy("group").agg(F.sum("k").alias("total"), F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("k")).alias("squares"))
    total = F.col("total")
    return sums.select("group", F.round(F.col("inside") / total - F.col("squares") / (total * total), 9).alias("modularity"))


def _solved(edges: list[tuple[str, str, float]]) -> tuple[list[str], list[int], float]:
    """Nodes of one group's edges in order, the number of each one's community, and the partition's modularity."""
    names = sorted({x for e in edges for x in e[:2]})
    place = {x: k for k, x in enumerate(names)}
    a, b, weight = zip(*sorted((place[x], place[y], w) for x, y, w in edges))
    label = _merged(len(names), a, b, weight).tolist()
    members: dict[int, list[int]] = {}
    for k, top in enumerate(label):
        members.setdefault(top, []).append(k)
    community = [0] * len(names)
    for number, own in enumerate(sorted(members.values(), key=lambda m: (-len(m), m[0])), 1):
        for k in own:
            community[k] = number
    strength, inside = [0.0] * (len(members) + 1), 0.0
    for x, y, w in zip(a, b, weight):
        strength[community[x]] += w
        strength[community[y]] += w
        inside += 2 * w * (community[x] == community[y])
    total = sum(strength)
    return names, community, inside / total - sum(k * k for k in strength) / (total * total) if total else 0.0


def greedy_communities(edges: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """(group, node, community, modularity) of undirected edges (group, a, b, weight) between named nodes, by greedy agglomeration.

    Communities are numbered from 1 by size, then by their lowest node; ``modularity`` is the whole partition's. Parallel edges add up. Groups of
    more than ``in_task`` different edges are partitioned by distributed moves (``detect.louvain``) instead: no task holds them."""
    from .detect import louvain

    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = _cut(edges.select("group", low, high, F.col("weight").cast("double").alias("weight")), "community-edges")
    many = edges.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > in_task).select("group")
    small, rest = edges, None
    if many.limit(1).count():
        # only here parallel edges have to be drawn together before a group's size is known
        edges = _cut(edges.groupBy("group", "a", "b").agg(F.sum("weight").alias("weight")), "community-edges")
        large = edges.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > in_task).select("group")
        small, rest = edges.join(large, "group", "left_anti"), edges.join(large, "group", "left_semi")
    group = edges.schema["group"].dataType.simpleString()
    kind = f"group {group}, node string, community int, modularity double"

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("group", "a", "b", "weight"))))
        found: tuple[list, list, list, list] = ([], [], [], [])

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(found, made.types)], schema=made)

        for key, own in groupby(rows, itemgetter(0)):
            names, community, q = _solved([r[1:] for r in own])
            for x, new in zip(found, ([key] * len(names), names, community, [q] * len(names))):
                x += new
            if len(found[0]) >= 10_000:
                yield out()
                for x in found:
                    x.clear()
        yield out()

    made = to_arrow_schema(StructType.fromDDL(kind))
    # rows of a group come one after another; a task holds one group at a time
    members = small.repartition("group").sortWithinPartitions("group").mapInArrow(solve, kind).withColumn("modularity", F.round("modularity", 9))
    if rest is not None and rest.limit(1).count():
        mark = "\u0001"
        name = lambda c: F.concat_ws(mark, F.col("group").cast("string"), c)
        found = louvain(rest.select(name("a").alias("a"), name("b").alias("b"), F.round(F.col("weight") * 1000).cast("long").alias("weight")))
        split = lambda c, k: F.split(c, mark)[k]
        found = found.select(split("node", 0).cast(group).alias("group"), split("node", 1).alias("node"), split("community", 1).alias("label"))
        found = _cut(_numbered(found), "communities")
        members = members.unionByName(found.join(modularity(rest, found), "group", "left"))
    return members


# diameters


def _levels(starts: np.ndarray, heads: np.ndarray, n: int, source: int) -> np.ndarray:
    """Distances from a node over adjacency lists (``heads[starts[k] : starts[k + 1]]``), -1 where it does not reach."""
    far = np.full(n, -1, np.int64)
    far[source] = 0
    front, step = np.array([source]), 0
    while len(front):
        step += 1
        size = starts[front + 1] - starts[front]
        at = np.repeat(starts[front] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        new = np.unique(heads[at])
        front = new[far[new] < 0]
        far[front] = step
    return far


def exact_diameter(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """The largest distance of two connected nodes of the undirected edges, and how many searches it took.

    A search from a node bounds the eccentricity of all others: at least max(d, e - d), at most e + d for distance d and the node's own
    eccentricity e. Sources are the open nodes of the largest upper and of the smallest lower bound in turn; a node is open while its
    upper bound exceeds the largest eccentricity found."""
    codes, names = pd.factorize(np.concatenate([a, b]))
    n, half = len(names), len(a)
    tails = np.concatenate([codes[:half], codes[half:]])
    order = np.argsort(tails, kind="stable")
    heads = np.concatenate([codes[half:], codes[:half]])[order]
    starts = np.searchsorted(tails[order], np.arange(n + 1))
    low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    degree = np.diff(starts)
    best, searches = 0, 0
    while len(able := np.flatnonzero(high > best)):
        by = (-high[able], -degree[able]) if searches % 2 == 0 else (low[able], -degree[able])
        source = int(able[np.lexsort(by[::-1])[0]])
        far = _levels(starts, heads, n, source)
        seen = far >= 0
        own = int(far.max())
        best = max(best, own)
        low[seen] = np.maximum(low[seen], np.maximum(far[seen], own - far[seen]))
        high[seen] = np.minimum(high[seen], own + far[seen])
        high[source] = own
        searches += 1
    return best, searches


def _wide_diameters(both: DataFrame) -> DataFrame:
    """(community, diameter) by the same bounds as Spark jobs: all communities search from one source each at a time, a job for each level."""
    bounds = _cut(both.groupBy("community", F.col("a").alias("x")).agg(F.count("*").alias("degree")).select("*", F.lit(0).alias("low"), F.lit(1 << 30).alias("high")), "bounds")
    best = _cut(bounds.select("community").distinct().withColumn("best", F.lit(0)), "diameters")
    turn = 0
    while True:
        able = bounds.join(best, "community").where("high > best")
        rank = F.struct(-F.col("high") if turn % 2 == 0 else F.col("low"), -F.col("degree"), F.col("x"))
        front = _cut(able.groupBy("community").agg(F.min_by("x", rank).alias("x")).withColumn("d", F.lit(0)), "diameter-front")
        if not front.limit(1).count():
            return best.select("community", F.col("best").alias("diameter"))
        source, seen, step = front, front, 0
        while front.limit(1).count():
            step += 1
            new = front.select("community", F.col("x").alias("a")).join(both, ["community", "a"]).select("community", F.col("b").alias("x")).distinct()
            front = _cut(new.join(seen, ["community", "x"], "left_anti").withColumn("d", F.lit(step)), "diameter-front")
            seen = seen.unionByName(front)
        own = seen.groupBy("community").agg(F.max("d").alias("own"))
        reached = seen.join(own, "community").join(source.select("community", F.col("x").alias("source")), "community")
        new = bounds.join(reached, ["community", "x"], "left")
        low = F.when(F.col("d").isNotNull(), F.greatest("low", "d", F.col("own") - F.col("d"))).otherwise(F.col("low"))
        high = F.when(F.col("x") == F.col("source"), F.col("own")).when(F.col("d").isNotNull(), F.least("high", F.col("own") + F.col("d"))).otherwise(F.col("high"))
        bounds = _cut(new.select("community", "x", "degree", low.alias("low"), high.alias("high")), "bounds")
        best = _cut(best.join(own, "community", "left").select("community", F.greatest("best", F.coalesce("own", F.lit(0))).alias("best")), "diameters")
        turn += 1


def diameters(edges: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """(community, diameter): the largest distance of two connected nodes along the edges (community, a, b), exact, by bounds of eccentricities.

    A community of more than ``in_task`` edges is searched by Spark jobs; a community without edges has no row."""
    both = edges.select("community", "a", "b").where("a <> b")
    both = _cut(both.select("community", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "diameter-edges")
    large = both.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") > in_task).select("community")
    kind = both.schema["community"].dataType.simpleString()

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"community": [rows["community"].iloc[0]], "diameter": [exact_diameter(rows["a"].to_numpy(), rows["b"].to_numpy())[0]]})

    found = both.join(large, "community", "left_anti").groupBy("community").applyInPandas(solve, f"community {kind}, diameter int")
    rest = both.join(large, "community", "left_semi")
    if rest.limit(1).count():
        back = rest.select("community", F.col("b").alias("a"), F.col("a").alias("b"))
        found = found.unionByName(_wide_diameters(_cut(rest.unionByName(back), "diameter-wide")))
    return found


# longest paths


def _longest(u: list[int], v: list[int], n: int) -> int:
    """Edges of the longest path, -1 where there is a cycle: nodes are taken once all edges into them are."""
    ahead: list[list[int]] = [[] for _ in range(n)]
    waits = [0] * n
    for x, y in zip(u, v):
        ahead[x].append(y)
        waits[y] += 1
    steps, ready, taken = [0] * n, [k for k in range(n) if not waits[k]], 0
    while ready:
        x = ready.pop()
        taken += 1
        for y in ahead[x]:
            steps[y] = max(steps[y], steps[x] + 1)
            waits[y] -= 1
            if not waits[y]:
                ready.append(y)
    return max(steps, default=0) if taken == n else -1


def _farthest(u: np.ndarray, v: np.ndarray, n: int, cap: int) -> int:
    """The largest distance between two nodes, ``cap`` at most: 64 starts at a time, a bit each."""
    order = np.argsort(v, kind="stable")
    u, v = u[order], v[order]
    first = np.flatnonzero(np.diff(v, prepend=-1))
    into, out = v[first], 0
    for at in range(0, n, 64):
        front = np.zeros(n, np.uint64)
        k = np.arange(at, min(n, at + 64))
        front[k] = np.uint64(1) << (k - at).astype(np.uint64)
        seen = front.copy()
        for step in range(1, cap + 1):
            new = np.bitwise_or.reduceat(front[u], first) & ~seen[into]
            if not new.any():
                break
            out = max(out, step)
            front = np.zeros(n, np.uint64)
            front[into] = new
            seen |= front
        if out == cap:
            break
    return out


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scenario, u, v, w): edges in which runs of nodes with one edge in and one out are drawn together (w: how many edges, the most of parallel
    ones); and (scenario) with a ring of such nodes. Pointers double along the runs, twice in a round."""
    out, into = edges.groupBy("scenario", F.col("u").alias("x")).agg(F.count("*").alias("o"), F.min("v").alias("to")), edges.groupBy("scenario", F.col("v").alias("x")).agg(F.count("*").alias("i"))
    at = _cut(out.join(into, ["scenario", "x"]).where("o = 1 and i = 1").select("scenario", "x", "to", F.lit(1).cast("long").alias("w"), F.lit(True).alias("open")), "runs")
    left, covered = at.count(), 1

    def doubled(at: DataFrame) -> DataFrame:
        far = at.select("scenario", F.col("x").alias("to"), F.col("to").alias("then"), F.col("w").alias("more"), F.col("open").alias("on"))
        new = at.where("open").join(far, ["scenario", "to"], "left")
        moved = new.select("scenario", "x", F.coalesce("then", "to").alias("to"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"), F.coalesce("on", F.lit(False)).alias("open"))
        return moved.unionByName(at.where("not open"))

    # a ring's pointers stay open, however far they reach
    while covered <= 2 * left and at.where("open").limit(1).count():
        at = _cut(doubled(doubled(at)), "runs")
        covered *= 4
    ring = at.where("open").select("scenario").distinct()
    heads = edges.join(at.select("scenario", F.col("x").alias("u")), ["scenario", "u"], "left_anti")
    drawn = heads.join(at.where("not open").select("scenario", F.col("x").alias("v"), "to", "w"), ["scenario", "v"], "left")
    drawn = drawn.select("scenario", "u", F.coalesce("to", "v").alias("v"), (1 + F.coalesce("w", F.lit(0))).alias("w"))
    return _cut(drawn.groupBy("scenario", "u", "v").agg(F.max("w").alias("w")), "drawn"), _cut(ring, "rings")


def _wide_longest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scenario, steps) of acyclic scenarios, and (scenario) of those with a cycle: runs are drawn together, then nodes without edges into them are taken
    round by round (as many as junctions follow each other)."""
    left, ring = _contracted(edges)
    steps = _cut(left.select("scenario", F.col("u").alias("x")).union(left.select("scenario", F.col("v").alias("x"))).distinct().withColumn("steps", F.lit(0).cast("long")), "steps")
    while left.limit(1).count():
        held = left.select("scenario", F.col("v").alias("u")).distinct()
        free = _cut(left.join(held, ["scenario", "u"], "left_anti"), "free")
        if not free.limit(1).count():
            break
        new = free.join(steps.withColumnRenamed("x", "u"), ["scenario", "u"]).select("scenario", F.col("v").alias("x"), (F.col("steps") + F.col("w")).alias("steps"))
        steps = _cut(steps.unionByName(new).groupBy("scenario", "x").agg(F.max("steps").alias("steps")), "steps")
        left = _cut(left.join(free.select("scenario", "u", "v"), ["scenario", "u", "v"], "left_anti"), "drawn")
    cyclic = _cut(left.select("scenario").union(ring).distinct(), "cyclic")
    return steps.join(cyclic, "scenario", "left_anti").groupBy("scenario").agg(F.max("steps").alias("steps")), cyclic


def _wide_farthest(edges: DataFrame, cap: int) -> DataFrame:
    """(scenario, steps): the largest distance between two nodes, ``cap`` at most, from all starts at once."""
    front = edges.select("scenario", F.col("u").alias("start"), F.col("u").alias("x")).distinct()
    seen, far = front, edges.select("scenario").distinct().withColumn("steps", F.lit(0).cast("long"))
    for k in range(1, cap + 1):
        new = front.withColumnRenamed("x", "u").join(edges, ["scenario", "u"]).select("scenario", "start", F.col("v").alias("x")).distinct()
        front = _cut(new.join(seen, ["scenario", "start", "x"], "left_anti"), "chain-reach")
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
        far = far.unionByName(front.select("scenario").distinct().withColumn("steps", F.lit(k).cast("long")))
    return far.groupBy("scenario").agg(F.max("steps").alias("steps"))


def longest_paths(edges: DataFrame, cap: int = 15, in_task: int = 200_000) -> DataFrame:
    """(scenario, steps) of different edges (scenario, u, v): edges of the longest path; where the scenario has a cycle, the largest distance
    between two of its nodes, of at most ``cap``. Scenarios of more than ``in_task`` edges go through Spark jobs."""
    edges = _cut(edges.select("scenario", "u", "v"), "path-edges")
    large = edges.groupBy("scenario").agg(F.count("*").alias("n")).where(F.col("n") > in_task).select("scenario")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for scenario, us, vs in zip(rows["scenario"], rows["us"], rows["vs"]):
                codes, names = pd.factorize(np.concatenate([us, vs]))
                u, v = codes[: len(us)], codes[len(us) :]
                steps = _longest(u.tolist(), v.tolist(), len(names))
                found.append((scenario, steps if steps >= 0 else _farthest(u, v, len(names), cap)))
            yield pd.DataFrame(found, columns=["scenario", "steps"])

    kind = f"scenario {edges.schema['scenario'].dataType.simpleString()}, steps long"
    lists = edges.join(large, "scenario", "left_anti").groupBy("scenario").agg(F.collect_list("u").alias("us"), F.collect_list("v").alias("vs"))  # in_task edges at most
    found = lists.mapInPandas(solve, kind)
    rest = edges.join(large, "scenario", "left_semi")
    if rest.limit(1).count():
        rest = _cut(rest, "path-wide")
        steps, cyclic = _wide_longest(rest)
        found = found.unionByName(steps)
        if cyclic.limit(1).count():
            found = found.unionByName(_wide_farthest(rest.join(cyclic, "scenario", "left_semi"), cap))
    return found


# triangles


def triangles(edges: DataFrame) -> DataFrame:
    """(scenario, node, t): triangles through each node of different undirected edges (scenario, a, b), a < b; nodes without one have no row.

    Edges point from the end of fewer neighbours to that of more (ties: by name), so that a node has at most the root of twice the edges ahead of it
    and wedges are bounded by the edges to the power of 1.5, whatever the hubs."""
    ends = edges.select("scenario", F.explode(F.array("a", "b")).alias("x")).groupBy("scenario", "x").agg(F.count("*").alias("k"))
    both = edges.join(ends.toDF("scenario", "a", "ka"), ["scenario", "a"]).join(ends.toDF("scenario", "b", "kb"), ["scenario", "b"])
    up = F.struct("ka", "a") < F.struct("kb", "b")
    ahead = _cut(both.select("scenario", F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y")), "ahead")
    wedges = ahead.join(ahead.withColumnRenamed("y", "z"), ["scenario", "x"]).where("y < z")
    third = ahead.select("scenario", F.least("x", "y").alias("y"), F.greatest("x", "y").alias("z"))
    closed = wedges.join(third, ["scenario", "y", "z"], "left_semi")
    return closed.select("scenario", F.explode(F.array("x", "y", "z")).alias("node")).groupBy("scenario", "node").agg(F.count("*").alias("t"))
