"""Near-duplicate documents: MinHash with tensored banding, links confirmed on full shingle sets.

Two small collections of ``HALVES`` half-keys (of ``ROWS`` minhashes each) are computed for a set of
shingles; a table's key is a pair of one half-key from either collection, so HALVES ** 2 tables need
2 * HALVES * ROWS minhashes where single keys would need HALVES times as many. Two sets of similarity s
share a table with probability (1 - (1 - s ** ROWS) ** HALVES) ** 2: at 0.75 all but four in a million.

1. Equal shingle sets become one node, named by their smallest doc_id.
2. A half-key that one node alone holds cannot be in a shared table key; only the others are paired into
   table keys. In each table, the members are tied to its smallest and to its largest node; ties with
   too few equal half-keys for the threshold are cut.
3. What hangs together is a cluster. In it, sets are compared exactly, in blocks: each block with itself and
   with the cluster's first block, which joins the bulk of large clusters. The members outside of the largest
   component then look for partners by their prints (a byte of each minhash); pairs of different components
   whose prints agree enough are compared exactly.
4. Components over the confirmed links. Large clusters are never brought into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, drop_table, mix, window_hashes, word_hashes, write_table
from .graph import components

SHINGLE = 5
ROWS = 3
HALVES = 24
#: Equal half-keys, of 2 * HALVES, that a pair must have to be looked at: at a similarity of 0.75 about
#: 20 are expected, and fewer than this happen less than once in a million pairs.
LEAST_EQUAL = 5
BLOCK = 256
#: Equal prints, of 2 * HALVES * ROWS, that such a pair must have: at 0.75 fewer happen in one of two million pairs,
#: at a similarity of 0.45 three pairs in a thousand have them.
LEAST_PRINTS = 82
PRINTS = 2048  # members whose prints are compared in one block
SALTS = 16
_RNG = np.random.default_rng(20240229)
_FLIP = _RNG.integers(0, 1 << 32, 2 * HALVES * ROWS, dtype=np.uint32)
_TURN = _RNG.integers(0, 1 << 32, 2 * HALVES * ROWS, dtype=np.uint32) | np.uint32(1)
_BOUND = 1 << 62


def shingles(text: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; with fewer words, of the whole sequence; empty without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = min(SHINGLE, len(words))
    found = window_hashes(word_hashes(words), tuple(range(n)), n)
    return np.unique(found if n == SHINGLE else mix(found + np.uint64(n)))


def signature(found: np.ndarray) -> tuple[np.ndarray, bytes]:
    """2 * HALVES keys of ROWS minhashes each (the first collection, then the second), and a byte of each minhash."""
    low = np.full(len(_FLIP), 0xFFFFFFFF, np.uint32)
    v = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(v), 2048):
        part = v[None, at : at + 2048] ^ _FLIP[:, None]
        part *= _TURN[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    grid = low.reshape(2 * HALVES, ROWS).astype(np.uint64)
    out = np.arange(2 * HALVES, dtype=np.uint64)
    for r in range(ROWS):
        out = mix((out << np.uint64(1)) + grid[:, r])
    return out.view(np.int64), (grid.ravel() & np.uint64(255)).astype(np.uint8).tobytes()


def _substituted(text: F.Column) -> F.Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text).bitwiseAND(F.lit(_BOUND - 1)).bitwiseOR(F.lit(_BOUND)))


def _named(docs: DataFrame) -> DataFrame:
    """``id, text_key, text``: rows of a null doc_id get a substitute, larger than other ids, from their text."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(_substituted(text).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _signatures(docs: DataFrame) -> DataFrame:
    def rows(col, _):
        out = {"id": col["id"], "text_key": col["text_key"], "n_shingles": [], "set_key": [], "keys": [], "prints": []}
        for t in col["text"]:
            s = shingles(t)
            out["n_shingles"].append(len(s))
            out["set_key"].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            keys, prints = signature(s) if len(s) else (None, None)
            out["keys"].append(keys)
            out["prints"].append(prints)
        return out

    return arrow_map(_named(docs), rows, "id long, text_key long, n_shingles long, set_key binary, keys array<long>, prints binary")


def _ties(nodes: DataFrame) -> DataFrame:
    """(a, b): edges that connect what tables tie together: each member with the smallest and the largest node of
    the table, where these have enough half-keys in common."""
    halves = nodes.select("node", F.posexplode("keys").alias("i", "key"))
    shared = halves.groupBy("i", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    live = halves.join(shared, ["i", "key"]).groupBy("node").agg(F.collect_list(F.struct("i", "key")).alias("live"))  # 2 * HALVES at most
    first = F.filter("live", lambda x: x["i"] < HALVES)
    second = F.filter("live", lambda x: x["i"] >= HALVES)
    live = write_table(live.select("node", first.alias("first"), second.alias("second")).where((F.size("first") > 0) & (F.size("second") > 0)), "near-live")
    tables = live.select("node", F.explode("first").alias("x"), "second").select("node", "x", F.explode("second").alias("y")).select("node", F.xxhash64("x.i", "x.key", "y.i", "y.key").alias("key"))
    ends = tables.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    tied = tables.join(ends, "key").select("node", F.explode(F.array("lo", "hi")).alias("end")).where("node <> end").distinct()
    keys = nodes.select("node", "keys")
    tied = tied.join(keys, "node").join(keys.toDF("end", "end_keys"), "end")
    equal = F.size(F.filter(F.zip_with("keys", "end_keys", lambda x, y: x == y), lambda same: same))
    # a node's ties (two for each table at most) are drawn together at its smallest end: few edges connect the same
    tied = tied.where(equal >= LEAST_EQUAL).select("node", "end", F.min("end").over(Window.partitionBy("node")).alias("to"))
    drawn = tied.select(F.col("node").alias("a"), F.col("to").alias("b")).unionByName(tied.select(F.col("end").alias("a"), F.col("to").alias("b")))
    out = write_table(drawn.where("a <> b").distinct(), "near-ties")
    drop_table(live)
    return out


def _incidence(sets: list[np.ndarray], common: np.ndarray) -> Iterator[np.ndarray]:
    """Slices (sets x shingles) of the 0/1 matrix of the sets over the common shingles."""
    places = [np.searchsorted(common, s[np.isin(s, common, assume_unique=True)]) for s in sets]
    for at in range(0, len(common), 4096):
        out = np.zeros((len(sets), min(4096, len(common) - at)), np.float32)
        for r, p in enumerate(places):
            lo, hi = np.searchsorted(p, (at, at + 4096))
            out[r, p[lo:hi] - at] = 1
        yield out


def links(sets: list[np.ndarray], queries: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """Index pairs (query, other) with 100 * intersection >= percent * union."""
    if not len(queries) or not len(others):
        return np.zeros((0, 2), np.int64)
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    common = values[counts > 1]
    inter = np.zeros((len(queries), len(others)), np.float32)
    for part in _incidence(sets, common):
        inter += part[queries] @ part[others].T
    sizes = np.array([len(s) for s in sets], np.int64)
    inter = np.rint(inter).astype(np.int64)
    union = sizes[queries][:, None] + sizes[others][None] - inter
    q, o = np.nonzero(100 * inter >= percent * union)
    return np.stack([queries[q], others[o]], axis=1)


def _compare(rows: DataFrame, percent: int) -> DataFrame:
    """Links in groups (cluster, part, block): rows of ``role`` 0 with those of role 1, or with each other
    where a group has ``within``. Only a spanning set of a group's links comes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def solve() -> pa.RecordBatch:
            sets = [np.frombuffer(r["hashes"], "<u8") for r in held]
            role = np.array([r["role"] for r in held])
            nodes = [r["node"] for r in held]
            label = [r["label"] for r in held]
            queries = np.flatnonzero(role == 0)
            others = np.arange(len(held)) if held[0]["within"] else np.flatnonzero(role == 1)
            parent: dict[int, int] = {}

            def top(x: int) -> int:
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            a, b = [], []
            for x, y in links(sets, queries, others, percent).tolist():
                if label[x] != label[y] and top(label[x]) != top(label[y]):
                    parent[top(label[x])] = top(label[y])
                    a.append(nodes[x])
                    b.append(nodes[y])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for r in batch.to_pylist():
                now = (r["cluster"], r["part"], r["block"])
                if now != key and held:
                    yield solve()
                    held = []
                key = now
                held.append(r)
        if held:
            yield solve()

    dealt = rows.repartition("cluster", "part", "block").sortWithinPartitions("cluster", "part", "block", "role", "node")
    return dealt.mapInArrow(run, "a long, b long")


def _spread(rows: DataFrame, small: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``small``, of few rows, on ``cluster``: a large cluster's rows go to several tasks."""
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("node", F.lit(SALTS)), F.lit(SALTS)).cast("int")).join(salted, ["cluster", "_salt"], how).drop("_salt")


def alike(queries: np.ndarray, others: np.ndarray, least: int) -> Iterator[np.ndarray]:
    """Index pairs (query, other) of rows of prints with ``least`` equal bytes, in slices."""
    turned = np.ascontiguousarray(others.T)
    for at in range(0, len(queries), BLOCK):
        part = queries[at : at + BLOCK]
        equal = np.zeros((len(part), len(others)), np.uint8)
        for c in range(turned.shape[0]):
            equal += part[:, c, None] == turned[c]
        q, o = np.nonzero(equal >= least)
        yield np.stack([q + at, o], axis=1)


def _candidates(rows: DataFrame) -> DataFrame:
    """(a, b): in groups (cluster, part, block), rows of ``role`` 0 with those of role 1 of another label whose prints
    agree. Of two that both ask, the smaller one finds the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def solve() -> Iterator[pa.RecordBatch]:
            prints = np.frombuffer(b"".join(r["prints"] for r in held), np.uint8).reshape(len(held), -1)
            node, label = (np.array([r[n] for r in held], np.int64) for n in ("node", "label"))
            role, asks = np.array([r["role"] for r in held]), np.array([r["asks"] for r in held])
            mine, theirs = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
            for pairs in alike(prints[mine], prints[theirs], LEAST_PRINTS):
                q, o = mine[pairs[:, 0]], theirs[pairs[:, 1]]
                ok = (label[q] != label[o]) & (~asks[o] | (node[q] < node[o]))
                yield pa.RecordBatch.from_arrays([pa.array(node[q[ok]]), pa.array(node[o[ok]])], names=["a", "b"])

        for batch in batches:
            for r in batch.to_pylist():
                now = (r["cluster"], r["part"], r["block"])
                if now != key and held:
                    yield from solve()
                    held = []
                key = now
                held.append(r)
        if held:
            yield from solve()

    dealt = rows.repartition("cluster", "part", "block").sortWithinPartitions("cluster", "part", "block")
    return dealt.mapInArrow(run, "a long, b long")


def _exact(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked."""
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")

    def rows(col, _):
        ok = []
        for a, b in zip(col["x"], col["y"]):
            x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
            inter = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * inter >= percent * (len(x) + len(y) - inter))
        return {n: [v for v, good in zip(col[n], ok) if good] for n in ("a", "b")}

    return arrow_map(both, rows, "a long, b long")


def _confirmed(docs: DataFrame, nodes: DataFrame, ties: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of clusters, enough of them to connect what is linked."""
    clusters = components(ties).withColumnRenamed("label", "cluster")
    large = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    members = _spread(clusters, large, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    wanted = members.join(nodes.select("node", "id", "set_key"), "node")
    texts = _named(docs).drop("text_key").join(wanted, "id")

    def rows(col, _):
        found = [shingles(t) for t in col["text"]]
        own = [xxhash.xxh3_128_digest(s.tobytes()) == k for s, k in zip(found, col["set_key"])]  # a repeated doc_id has other texts as well
        return {n: [v for v, ok in zip(col[n], own) if ok] for n in ("cluster", "node", "block", "blocks")} | {"hashes": [s.astype("<u8").tobytes() for s, ok in zip(found, own) if ok]}

    sets = arrow_map(texts.select("cluster", "node", "block", "blocks", "set_key", "text"), rows, "cluster long, node long, block int, blocks int, hashes binary")
    sets = write_table(sets, "near-sets")
    no = F.lit(False)
    # each block with itself, and with the cluster's first block
    own = sets.select("cluster", F.lit(0).alias("part"), "block", F.lit(0).alias("role"), F.lit(True).alias("within"), "node", F.col("node").alias("label"), "hashes")
    pivots = sets.where("block = 0 and blocks > 1").select("cluster", F.lit(1).alias("part"), F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), no.alias("within"), "node", F.col("node").alias("label"), "hashes")
    rest = sets.where("block > 0").select("cluster", F.lit(1).alias("part"), "block", F.lit(1).alias("role"), no.alias("within"), "node", F.col("node").alias("label"), "hashes")
    found = write_table(_compare(own.unionByName(pivots).unionByName(rest), percent), "near-links")
    # in clusters of several blocks: whoever is outside of the largest component looks for partners in all blocks
    several = sets.where("blocks > 1").select("cluster", "node", "blocks")
    if several.isEmpty():
        return found
    marked = several.join(components(found), "node", "left").withColumn("label", F.coalesce("label", "node"))
    parts = marked.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    largest = parts.groupBy("cluster").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"))
    asking = largest.select("cluster", F.col("top.label").alias("top"), F.ceil((F.col("all") - F.col("top.n")) / PRINTS).cast("int").alias("parts"))
    marked = _spread(marked, asking.where("parts > 0")).join(nodes.select("node", "prints"), "node")
    marked = marked.select("cluster", "node", "label", "prints", (F.col("label") != F.col("top")).alias("asks"), "parts", F.ceil(F.col("blocks") * BLOCK / PRINTS).cast("int").alias("blocks"))
    marked = write_table(marked, "near-marked")
    deal = lambda n: F.pmod(F.xxhash64("node", F.lit(1)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = marked.where("asks").select("cluster", deal("parts").alias("part"), each("blocks").alias("block"), F.lit(0).alias("role"), "asks", "node", "label", "prints")
    others = marked.select("cluster", each("parts").alias("part"), deal("blocks").alias("block"), F.lit(1).alias("role"), "asks", "node", "label", "prints")
    pairs = write_table(_candidates(queries.unionByName(others)), "near-pairs")
    out = write_table(found.unionByName(_exact(pairs, sets.select("node", "hashes"), percent)), "near-links")
    for done in (sets, found, marked, pairs):
        drop_table(done)
    return out


def _with_components(signed: DataFrame, named: DataFrame) -> DataFrame:
    """``signed`` with its sets' components. A set that holds more than a thousandth of the rows is broadcast (there are
    fewer than a thousand of them), so that no task gets all copies of a text; empty sets are left out of the join."""
    total = named.agg(F.sum("copies").alias("n")).first()["n"] or 0
    often = F.col("copies") * 1000 > total
    hot = F.broadcast(named.where(often).select("set_key", F.col("component").alias("hot")))
    full = signed.where("set_key is not null").join(hot, "set_key", "left")
    some = full.where("hot is null").drop("hot").join(named.where(~often).drop("copies"), "set_key")
    most = full.where("hot is not null").withColumnRenamed("hot", "component")
    none = signed.where("set_key is null").withColumn("component", F.col("id"))
    return some.unionByName(most).unionByName(none)


def near_duplicates(docs: DataFrame, percent: int = 75, raw_ids: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_key`` for each row of ``docs``.

    Words are lower-cased (A-Z) and parted by ASCII white space; a set holds the distinct 5-word shingles
    of the whole text, or the whole sequence of a shorter one. A null or empty text, or one without words,
    has an empty set and is linked with nothing. Repeated rows get equal results. A row of a null doc_id
    can be linked, but gives no component its name: a component of such rows alone has a null
    component_id (``raw_ids`` shows the substitutes); ``kept`` is null-safe. Other columns are not read. An empty table gives no rows."""
    signed = write_table(_signatures(docs), "near-signatures")
    full = signed.where("n_shingles > 0")
    nodes = full.groupBy("set_key").agg(F.min(F.struct("id", "keys", "prints")).alias("x"), F.count("*").alias("copies")).select("set_key", "x.*", "copies")
    # a doc_id that stands for several texts names the node of one; the others get a name of their own
    first = nodes.groupBy("id").agg(F.min("set_key").alias("first"))
    other = F.xxhash64("set_key").bitwiseAND(F.lit(_BOUND - 1)).bitwiseOR(F.lit(_BOUND))
    nodes = nodes.join(first, "id").withColumn("node", F.when(F.col("set_key") == F.col("first"), F.col("id")).otherwise(other)).drop("first")
    nodes = write_table(nodes, "near-nodes")
    ties = _ties(nodes)
    found = _confirmed(docs, nodes, ties, percent)
    label = components(found)
    named = nodes.select("set_key", "id", "node", "copies").join(label, "node", "left")
    least = named.where("label is not null").groupBy("label").agg(F.min("id").alias("component"))
    # linked with no other set: equal sets still are one component
    named = named.join(least, "label", "left").select("set_key", "copies", F.coalesce("component", "id").alias("component"))
    out = _with_components(signed.select("id", "text_key", "n_shingles", "set_key"), named)
    real = lambda c: F.col(c) if raw_ids else F.when(F.col(c) < _BOUND, F.col(c))
    return out.select(real("id").alias("doc_id"), "n_shingles", real("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"), "text_key")


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` with one row of each component (the one of the smallest doc_id); rows and columns as they are.

    A row of an empty set is a component of its own. Of repeated rows one stays. Of rows of null doc_ids
    only, linked with each other, the one of the smallest substitute id stays."""
    found = near_duplicates(docs, percent, raw_ids=True).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text"), F.col("component_id").alias("_component"), (F.col("n_shingles") > 0).alias("_full")).distinct()
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    named = docs.withColumn("_text", F.xxhash64(text)).withColumn("_id", _substituted(text))
    joined = named.join(found, ["_id", "_text"])
    full = joined.where("_full").dropDuplicates(["_id"])
    return full.unionByName(joined.where("not _full")).select(*docs.columns)
