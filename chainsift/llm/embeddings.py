"""Near-duplicate embeddings: lattice hashing with E8, links verified by cosine.

A table projects a unit vector at random to ``BLOCKS`` groups of eight numbers and decodes each to the nearest point of
the lattice E8; the points name the vector's cell. A vector lists its cell and the ``PROBES`` cells nearest to it besides
(one of its points moved to a neighbour among the lattice's 240 shortest vectors), in each of ``TABLES`` tables. Two
vectors meet in a cell that both list: at a cosine of 0.9 in one of the tables in about 99 of 100 pairs, at 0.95 nearly always.

1. Equal vectors become one node with a count.
2. Nodes choose a pivot among the smallest nodes of their cells; those within half of the angle of the threshold form its
   ball. Any two members of a ball are linked, so that they are counted, not compared.
3. Cells list balls, not nodes. In a cell, balls whose pivots' sign sketches are far apart are dropped; the others are
   compared exactly, and those that can hold linked members are tied (a spanning set of the ties comes out).
4. What is tied is a cluster. In it, members of different balls are compared in blocks; a task gives counts and a spanning set
   of the links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, reduce
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, arrow_schema, drop_table, mix, write_table
from .graph import components

TABLES = 8
BLOCKS = 2
PROBES = 12
SCALE = 0.65  # lattice units for a unit vector's component
SKETCH = 256  # signs of a sketch
SLACK = 5.5  # standard deviations of differing signs that a pair at the threshold is granted
CELL_BLOCK = 1024
COUNT_BLOCK = 4096
_SEED = 80641


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for places in combinations(range(8), 2):
        for signs in product((1.0, -1.0), repeat=2):
            v = [0.0] * 8
            v[places[0]], v[places[1]] = signs
            out.append(v)
    out += [s for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


ROOTS = _shortest()


def _even(y: np.ndarray) -> np.ndarray:
    """The nearest points of whole numbers with an even sum: round, and where the sum is odd, round the worst place the other way."""
    point = np.rint(y)
    off = y - point
    rows = np.flatnonzero(point.sum(axis=1) % 2)
    worst = np.abs(off[rows]).argmax(axis=1)
    point[rows, worst] += np.where(off[rows, worst] >= 0, 1.0, -1.0)
    return point


def decode(y: np.ndarray) -> np.ndarray:
    """The nearest points of E8: the better one of the even whole points and of those moved by a half in all places."""
    a, b = _even(y), _even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1))[:, None], a, b)


@cache
def _planes(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Projections of the tables and of the sketch for vectors of ``dim`` numbers, multipliers of points, and what each neighbour adds to a key."""
    rng = np.random.default_rng([_SEED, dim])
    tables, signs = rng.normal(size=(TABLES, 8 * BLOCKS, dim)) * SCALE, rng.normal(size=(SKETCH, dim))
    factors = rng.integers(1, 1 << 62, (TABLES, 8 * BLOCKS), dtype=np.int64) | 1
    steps = (2 * ROOTS).astype(np.int64)
    moves = np.stack([np.concatenate([(steps * f[8 * k : 8 * k + 8]).sum(axis=1) for k in range(BLOCKS)]) for f in factors])
    return tables, signs, factors, moves


def cells(unit: np.ndarray) -> np.ndarray:
    """Keys (vectors x tables x 1 + PROBES) of the cells that unit vectors list, their own first."""
    tables, _, factors, moves = _planes(unit.shape[1])
    out = np.empty((len(unit), TABLES, 1 + PROBES), np.int64)
    for t in range(TABLES):
        y = unit @ tables[t].T
        points = np.concatenate([decode(y[:, 8 * k : 8 * k + 8]) for k in range(BLOCKS)], axis=1)
        off = y - points
        gain = np.concatenate([off[:, 8 * k : 8 * k + 8] @ ROOTS.T for k in range(BLOCKS)], axis=1)
        nearest = np.argpartition(-gain, PROBES, axis=1)[:, :PROBES]
        own = ((2 * points).astype(np.int64) * factors[t]).sum(axis=1)
        out[:, t, 0] = own
        out[:, t, 1:] = own[:, None] + moves[t][nearest]
    salt = np.arange(TABLES, dtype=np.uint64)[None, :, None] + np.uint64(unit.shape[1] << 8)
    return mix(out.view(np.uint64) ^ mix(salt)).view(np.int64)


def sketch(unit: np.ndarray) -> np.ndarray:
    return np.packbits(unit @ _planes(unit.shape[1])[1].T > 0, axis=1)


def unit_vector(v: list[float]) -> np.ndarray:
    x = np.array(v, np.float64) + 0.0  # a negative zero is a zero
    x /= np.abs(x).max()
    return x / np.sqrt((x * x).sum())


def _digests(vectors: DataFrame) -> DataFrame:
    """``vec_id, digest, unit``: both null for vectors that link with nothing."""
    e = F.col("embedding").cast("array<double>")
    infinite = F.lit(float("inf"))
    sound = ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite)) & F.exists(e, lambda x: x != 0)

    def rows(col, _):
        out = {"vec_id": col["vec_id"], "digest": [], "unit": []}
        for v in col["v"]:
            x = None if v is None else np.array(v, np.float64) + 0.0
            out["digest"].append(None if x is None else xxhash.xxh3_128_digest(x.tobytes()))
            out["unit"].append(None if x is None else unit_vector(v).tobytes())
        return out

    return arrow_map(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, e).alias("v")), rows, "vec_id long, digest binary, unit binary")


def _units(found: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(found), np.float64).reshape(len(found), -1)


def _by_dim(col: list[bytes], make: Callable[[np.ndarray], list]) -> list:
    """``make`` of units (rows of equal length together), in order."""
    out: list = [None] * len(col)
    for size in {len(u) for u in col}:
        at = [k for k, u in enumerate(col) if len(u) == size]
        for k, made in zip(at, make(_units([col[k] for k in at]))):
            out[k] = made
    return out


def _groups(rows: DataFrame, keys: list[str], solve: Callable[[dict[str, list]], dict[str, object]], schema: str) -> DataFrame:
    """``solve`` on the columns of each group of ``keys``; small groups of a batch are handed over one after another."""
    kind = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                table = pa.Table.from_batches(held)
                out = solve({n: table.column(n).to_pylist() for n in table.column_names})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in kind], schema=kind)

        for batch in batches:
            values = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
            change = np.flatnonzero(reduce(np.logical_or, [v[1:] != v[:-1] for v in values])) + 1 if batch.num_rows > 1 else []
            for at, to in zip([0, *change], [*change, batch.num_rows]):
                if to == at:
                    continue
                key = tuple(v[at] for v in values)
                if key != now:
                    yield from done()
                    held, now = [], key
                held.append(batch.slice(at, to - at))
        yield from done()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _balls(nodes: DataFrame, half: float) -> DataFrame:
    """``node, ball, near``: nodes that lie within half of the angle of a pivot, without the pivots themselves; near: the cosine.

    A node votes for the smallest nodes of its cells and takes the one of most votes, or that one's own choice. A pivot has
    no choice of its own. Whoever finds none stays a ball of its own: nothing is lost, only compared in full."""
    own = nodes.select("node", F.explode("own").alias("key"))
    lead = own.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    votes = own.join(lead, "key").where("lead < node").groupBy("node", "lead").agg(F.count("*").alias("n"))
    choice = write_table(votes.groupBy("node").agg(F.max(F.struct("n", (-F.col("lead")).alias("lead"))).alias("top")).select("node", (-F.col("top.lead")).alias("lead")), "ball-votes")
    second = choice.toDF("lead", "then")
    taken = choice.join(second, "lead", "left").select("node", F.coalesce("then", "lead").alias("ball"))
    taken = taken.join(choice.select(F.col("node").alias("ball")), "ball", "left_anti")
    both = taken.join(nodes.select("node", "unit"), "node").join(nodes.select(F.col("node").alias("ball"), F.col("unit").alias("pivot")), "ball")

    def rows(col, _):
        near = [float(np.frombuffer(a) @ np.frombuffer(b)) if len(a) == len(b) else -1.0 for a, b in zip(col["unit"], col["pivot"])]
        ok = [k for k, c in enumerate(near) if c >= half]
        return {"node": [col["node"][k] for k in ok], "ball": [col["ball"][k] for k in ok], "near": [near[k] for k in ok]}

    out = write_table(arrow_map(both, rows, "node long, ball long, near double"), "balls")
    drop_table(choice)
    return out


def _pairs_of(rows: DataFrame, size: Column, block: int, keys: list[str], item: str) -> DataFrame:
    """Rows dealt to pairs of blocks of their group (``size`` rows, parted into blocks of about ``block``): ``_i <= _j``, ``_own`` the row's block.
    A group of one block is one pair."""
    blocks = F.ceil(size / block).cast("int")
    dealt = rows.withColumn("_own", F.pmod(F.xxhash64(item), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other")).drop("_other")


def _reach(angle: float, radius: np.ndarray) -> np.ndarray:
    """Signs of a sketch that may differ where the angle of two vectors is at most ``angle + radius``."""
    p = np.minimum((angle + radius) / np.pi, 0.5)
    return SKETCH * p + SLACK * np.sqrt(SKETCH * p * (1 - p))


def _close(rows: DataFrame, keys: list[str], angle: float) -> DataFrame:
    """The rows (``keys, ball, radius``) of groups of ``keys`` that have a partner in their group whose sketch is near enough."""
    schema = "key long, _i int, _j int, ball long, radius double"
    kind = arrow_schema(schema)

    def solve(table: pa.Table, group: np.ndarray) -> pa.Table:
        code = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(group), -1)
        wide, ok = table.column("radius").to_numpy(), np.zeros(len(group), bool)
        at = np.arange(len(group))
        for step in range(1, len(group)):  # rows and those ``step`` places after them, while their groups last
            at = at[at < len(group) - step]
            at = at[group[at] == group[at + step]]
            if not len(at):
                break
            apart = np.bitwise_count(code[at] ^ code[at + step]).sum(axis=1)
            hit = at[apart <= _reach(angle, wide[at] + wide[at + step])]
            ok[hit] = True
            ok[hit + step] = True
        return table.select(kind.names).filter(pa.array(ok)).combine_chunks().cast(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def numbered() -> tuple[pa.Table, np.ndarray]:
            table = pa.Table.from_batches(held)
            values = [table.column(k).to_numpy() for k in keys]
            return table, np.cumsum(np.append(False, reduce(np.logical_or, [v[1:] != v[:-1] for v in values])))

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table, group = numbered()
            whole = int(np.searchsorted(group, group[-1]))  # the last group may go on
            if whole:
                yield from solve(table.slice(0, whole), group[:whole]).to_batches()
                held = table.slice(whole).to_batches()
        if held:
            yield from solve(*numbered()).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


class _Sets:
    """Labels of connected rows; ``tie`` gives the pairs that were needed to connect them."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def tie(self, row: int, others: np.ndarray) -> list[tuple[int, int]]:
        labels, first = np.unique(self.label[others], return_index=True)
        own = self.label[row]
        fresh = labels != own
        if not fresh.any():
            return []
        self.label[np.isin(self.label, labels[fresh])] = own
        return [(row, int(others[k])) for k in first[fresh]]


def _ball_ties(nodes: DataFrame, balls: DataFrame, angle: float) -> DataFrame:
    """``a, b``: balls that can hold linked members, a spanning set of each cell's."""

    def listed(col, _):
        return {"node": col["node"], "keys": _by_dim(col["unit"], lambda u: list(cells(u).reshape(len(u), -1)))}

    lists = arrow_map(nodes.select("node", "unit"), listed, "node long, keys array<long>")
    of = lists.join(balls.select("node", "ball"), "node", "left").select(F.coalesce("ball", "node").alias("ball"), "keys")
    at = write_table(of.select("ball", F.explode("keys").alias("key")).distinct(), "cells")
    # a cell that one ball alone lists ties nothing
    live = at.join(at.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
    radius = balls.groupBy("ball").agg(F.acos(F.least(F.min("near"), F.lit(1.0))).alias("radius"))

    def sketched(col, _):
        return {"ball": col["node"], "sketch": _by_dim(col["unit"], lambda u: [s.tobytes() for s in sketch(u)])}

    pivots = nodes.select("node", "unit").join(balls.select("node"), "node", "left_anti")
    pivots = arrow_map(pivots, sketched, "ball long, sketch binary").join(radius, "ball", "left").select("ball", "sketch", F.coalesce("radius", F.lit(0.0)).alias("radius"))
    keys = ["key", "_i", "_j"]
    dealt = _pairs_of(live, F.col("n"), CELL_BLOCK, ["key"], "ball").drop("n")

    left = write_table(_close(dealt.join(pivots, "ball"), keys, angle), "near-cells")

    def ties(col):
        out: list[tuple[int, int]] = []
        for size in {len(u) for u in col["unit"]}:
            at = np.array([k for k, u in enumerate(col["unit"]) if len(u) == size])
            units, wide, sets = _units([col["unit"][k] for k in at]), np.array(col["radius"])[at], _Sets(len(at))
            for lo in range(0, len(at), 256):
                able = units[lo : lo + 256] @ units.T >= np.cos(np.minimum(angle + wide[lo : lo + 256, None] + wide[None], np.pi)) - 1e-9
                for r, row in enumerate(able, lo):
                    others = np.flatnonzero(row)
                    out += [(int(at[x]), int(at[y])) for x, y in sets.tie(r, others[others != r])] if len(others) > 1 else []
        return {"a": [col["ball"][x] for x, _ in out], "b": [col["ball"][y] for _, y in out]}

    out = write_table(_groups(left.join(nodes.select(F.col("node").alias("ball"), "unit"), "ball"), keys, ties, "a long, b long").distinct(), "ball-ties")
    drop_table(at)
    drop_table(left)
    return out


def _links(nodes: DataFrame, balls: DataFrame, ties: DataFrame, threshold: float) -> DataFrame:
    """``a, b, n``: spanning links between members of different balls (n null), and counts of links (b null) by node."""
    clusters = components(ties).toDF("ball", "cluster")
    members = nodes.join(balls.select("node", "ball"), "node", "left").withColumn("ball", F.coalesce("ball", "node")).select("node", "ball", "copies", "unit").join(clusters, "ball")
    members = write_table(members, "cluster-members")
    size = members.groupBy("cluster").agg(F.count("*").alias("n"))
    # a ball of at least a block keeps blocks of its own, where nothing is to be compared
    large = members.groupBy("cluster", "ball").agg(F.count("*").alias("held")).where(F.col("held") >= COUNT_BLOCK)
    placed = members.join(size, "cluster").join(large, ["cluster", "ball"], "left")
    alone = F.col("held").isNotNull()
    piece = F.when(alone, F.pmod(F.xxhash64("node"), F.ceil(F.col("held") / COUNT_BLOCK))).otherwise(F.pmod(F.xxhash64("ball"), F.ceil(F.col("n") / COUNT_BLOCK)))
    placed = write_table(placed.select("cluster", "node", "ball", "copies", "unit", F.when(alone, F.col("ball")).otherwise(F.lit(-1)).alias("home"), piece.cast("long").alias("piece")), "cluster-blocks")
    blocks = placed.select("cluster", "home", "piece").distinct()
    x, y = blocks.toDF("cluster", "h1", "p1"), blocks.toDF("cluster", "h2", "p2")
    first = F.struct("h1", "p1") <= F.struct("h2", "p2")
    pairs = x.join(y, "cluster").where(first & ~((F.col("h1") == F.col("h2")) & (F.col("h1") >= 0)))
    sides = pairs.select("*", F.col("h1").alias("home"), F.col("p1").alias("piece"), F.lit(0).alias("side")).unionByName(
        pairs.where("h1 <> h2 or p1 <> p2").select("*", F.col("h2").alias("home"), F.col("p2").alias("piece"), F.lit(1).alias("side"))
    )

    def compare(col):
        side, ball, copies = np.array(col["side"]), np.array(col["ball"]), np.array(col["copies"], np.int64)
        count, out, sets = np.zeros(len(side), np.int64), [], _Sets(len(side))
        within = not side.any()
        for size in {len(u) for u in col["unit"]}:
            at = np.array([k for k, u in enumerate(col["unit"]) if len(u) == size])
            ask, other = (at, at) if within else (at[side[at] == 0], at[side[at] == 1])
            if not len(ask) or not len(other):
                continue
            a, b = _units([col["unit"][k] for k in ask]), _units([col["unit"][k] for k in other])
            for lo in range(0, len(ask), 256):
                part = ask[lo : lo + 256]
                linked = (a[lo : lo + 256] @ b.T >= threshold) & (ball[part][:, None] != ball[other][None])
                count[part] += linked @ copies[other]
                if not within:
                    count[other] += copies[part] @ linked
                for r in np.flatnonzero(linked.any(axis=1)).tolist():
                    out += sets.tie(int(part[r]), other[linked[r]])
        node, held = col["node"], np.flatnonzero(count).tolist()
        return {"a": [node[x] for x, _ in out] + [node[k] for k in held], "b": [node[y] for _, y in out] + [None] * len(held), "n": [None] * len(out) + [int(count[k]) for k in held]}

    keys = ["cluster", "h1", "p1", "h2", "p2"]
    out = write_table(_groups(placed.join(sides, ["cluster", "home", "piece"]), keys, compare, "a long, b long, n long"), "vector-links")
    drop_table(members)
    drop_table(placed)
    return out


def near_embeddings(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors`` (``vec_id``, ``embedding``: an array of numbers; other columns are not read).

    Rows are linked where the cosine in double precision reaches ``threshold`` (above 0). Vectors that are null, empty or zero, or
    hold a null or non-finite component, link with nothing; vectors of different lengths are not linked. Each row is a vector:
    equal rows are linked with each other, n_links counts rows. A component is named by the smallest vec_id in it (null if all are
    null); ``kept`` is null-safe. An empty table gives no rows."""
    angle = float(np.arccos(threshold))
    signed = _digests(vectors)
    nodes = signed.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    digests = write_table(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")

    def own(col, _):
        return {"node": col["node"], "unit": col["unit"], "copies": col["copies"], "own": _by_dim(col["unit"], lambda u: list(cells(u)[:, :, 0]))}

    nodes = write_table(arrow_map(digests.select("node", "unit", "copies"), own, "node long, unit binary, copies long, own array<long>"), "vector-cells")
    balls = _balls(nodes, float(np.cos(angle / 2)) + 1e-9)
    ties = _ball_ties(nodes, balls, angle)
    found = _links(nodes, balls, ties, threshold)
    tied = balls.select(F.col("node").alias("a"), F.col("ball").alias("b"))
    labels = components(found.where("b is not null").select("a", "b").unionByName(tied))
    held = balls.select("node", "ball").unionByName(balls.select(F.col("ball").alias("node"), "ball").distinct())
    sums = held.join(nodes.select("node", "copies"), "node").groupBy("ball").agg(F.sum("copies").alias("rows"))
    inner = held.join(sums, "ball").select("node", "rows")
    outer = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    named = digests.select("digest", "node", "least", "copies").join(inner, "node", "left").join(outer, "node", "left").join(labels, "node", "left")
    named = named.select("digest", "least", "copies", F.coalesce("label", "node").alias("label"), (F.coalesce("rows", "copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    named = write_table(named, "vector-labels")
    names = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.join(names, "label").select("digest", "copies", "n_links", "component_id")
    # a vector that holds over a thousandth of the rows is broadcast: there are fewer than a thousand of them
    total = named.agg(F.sum("copies").alias("n")).first()["n"] or 0
    often = F.col("copies") * 1000 > total
    full = signed.select("vec_id", "digest").join(F.broadcast(named.where(often).select("digest", F.col("n_links").alias("hot_links"), F.col("component_id").alias("hot_id"), F.lit(True).alias("hot"))), "digest", "left")
    most = full.where("hot").select("vec_id", F.col("hot_links").alias("n_links"), F.col("hot_id").alias("component_id"))
    some = full.where("hot is null and digest is not null").join(named.where(~often), "digest").select("vec_id", "n_links", "component_id")
    none = full.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return most.unionByName(some).unionByName(none).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
