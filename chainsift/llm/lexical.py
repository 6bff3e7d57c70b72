"""Ranked lexical search: benchmark items as queries against all documents, by a document FP-tree.

A document becomes its vector of terms that some item has, in the order of their document frequency, rarest first: documents
that share their rarest terms share a path from the root (with the most frequent first, paths would be shared as well, but
a subtree would hold nearly all terms and bound nothing). A node keeps the highest tf of each term and the lowest m in its subtree; the score of
these is an upper bound for all documents below, and exact for a single one. Each item searches a tree depth first, the best child first,
and leaves out subtrees whose bound is below its tenth score so far, which it carries from tree to tree of a task.

Items are handled in blocks of a bounded number of terms; a block is one pass over the documents and writes their vectors only.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, arrow_schema, drop_table, text_bytes, write_table

BLOCK_TERMS = 32_768  # different terms of a block of items (more where one item has more): what goes to all tasks
TREE_TERMS = 1024  # different terms of the items that share a tree (more where one item has more)
TREE_CELLS = 1 << 22  # documents x terms of a tree
PIECE = 1 << 22  # bytes that are split at a time
_LOWER = bytes(b if b >= 128 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """Runs of ASCII letters (A-Z lower-cased), digits and other than ASCII characters of UTF-8 bytes, in lists."""
    plain = text.translate(_LOWER)
    at = 0
    while at < len(plain):
        cut = plain.find(b" ", at + PIECE)
        cut = len(plain) if cut < 0 else cut
        yield plain[at:cut].split()
        at = cut


@dataclass
class Item:
    item_id: int | None
    terms: dict[int, int]  # the block's number of a term: how often the item has it


def _blocks(benchmark: DataFrame) -> Iterator[tuple[dict[bytes, int], list[Item]]]:
    """Vocabularies and items of blocks, one held at a time."""
    vocabulary: dict[bytes, int] = {}
    items: list[Item] = []
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_bytes()).distinct().toLocalIterator():
        found = Counter(t for part in term_lists(row["text"]) for t in part)
        if items and len(vocabulary) + sum(t not in vocabulary for t in found) > BLOCK_TERMS:
            yield vocabulary, items
            vocabulary, items = {}, []
        if found:
            items.append(Item(row["item_id"], {vocabulary.setdefault(t, len(vocabulary)): n for t, n in found.items()}))
    if items:
        yield vocabulary, items


def _vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, tfs``: all terms of a document, and those of the vocabulary with their tf."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(col, _):
        out = {"doc_id": col["doc_id"], "n": [], "terms": [], "tfs": []}
        for text in col["text"]:
            n, held = 0, Counter()
            for part in term_lists(text):
                n += len(part)
                held.update(map(shared.value.get, part))
            held.pop(None, None)
            out["n"].append(n)
            out["terms"].append(list(held))
            out["tfs"].append(list(held.values()))
        return out

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()), rows, "doc_id long, n long, terms array<int>, tfs array<int>")


def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds to a score."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Tree:
    """Documents as leaves 0 to n - 1, in the order of their vectors; inner nodes stand for the paths that neighbours share; the last is the root.

    ``doc``, ``term`` (a place in the order of the tree's terms) and ``tf`` give the documents' vectors, ``m`` their lengths' measure."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, terms: int):
        n = len(m)
        order = np.lexsort((term, doc))
        doc, term, tf = doc[order], term[order], tf[order]
        ends = np.searchsorted(doc, np.arange(n), "right").tolist()
        path = term.astype(">i4").tobytes()
        paths = [path[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]
        self.rows = np.array(sorted(range(n), key=paths.__getitem__), np.int64)
        leaf = np.empty(n, np.int64)
        leaf[self.rows] = np.arange(n)
        paths = [paths[r] for r in self.rows.tolist()]
        shared = [_common(a, b) for a, b in zip(paths, paths[1:])] + [0]
        self.children: list[np.ndarray] = []  # of inner nodes
        self.most, self.least = np.zeros((2 * n, terms), np.int32), np.zeros(2 * n, np.int64)
        self.most[leaf[doc], term] = tf
        self.least[:n] = m[self.rows]
        self.leaves = n
        # the path shared with the next leaf closes all deeper nodes and opens one of its own depth
        open_nodes: list[tuple[int, list[int]]] = [(0, [])]
        for at, depth in enumerate(shared):
            child = at
            while open_nodes[-1][0] > depth:
                inside = open_nodes.pop()[1]
                inside.append(child)
                child = self._close(inside)
            if open_nodes[-1][0] == depth:
                open_nodes[-1][1].append(child)
            else:
                open_nodes.append((depth, [child]))
        self.root = self._close(open_nodes[0][1])

    def _close(self, inside: list[int]) -> int:
        node, held = self.leaves + len(self.children), np.array(inside)
        self.children.append(held)
        np.max(self.most[held], axis=0, out=self.most[node])
        self.least[node] = self.least[held].min()
        return node

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best, ids: list) -> None:
        """Offers the documents (``ids`` by row) that can be among the best for an item of such terms and weights."""
        if not self.leaves:
            return
        waiting = [(math.inf, self.root)]
        while waiting:
            bound, node = waiting.pop()
            if bound < best.least:
                continue
            held = self.children[node - self.leaves]
            bounds = share(self.most[held][:, terms].astype(np.int64), self.least[held][:, None]) @ weights
            able = (bounds > 0) & (bounds >= best.least)
            held, bounds = held[able], bounds[able]
            single = held < self.leaves
            best.offer(bounds[single], [ids[r] for r in self.rows[held[single]].tolist()])
            inner, bounds = held[~single], bounds[~single]
            order = np.argsort(bounds, kind="stable")  # the last one is searched first
            waiting += zip(bounds[order].tolist(), inner[order].tolist())


def _common(a: bytes, b: bytes) -> int:
    """Terms at the start that two paths share."""
    n = min(len(a), len(b)) // 4
    if a[: 4 * n] == b[: 4 * n]:
        return n
    x, y = np.frombuffer(a, np.uint32, n), np.frombuffer(b, np.uint32, n)
    return int((x != y).argmax())


class Best:
    """The ``top`` best documents: the highest score, then the smallest doc_id (null last)."""

    def __init__(self, top: int):
        self.top, self.held = top, []
        self.least = 1  # scores below can't be among them

    def offer(self, scores: np.ndarray, ids: list) -> None:
        keys = sorted(zip(scores.tolist(), [-math.inf if i is None else -i for i in ids], range(len(ids))), reverse=True)[: self.top]
        for score, key, at in keys:
            entry = (score, key, ids[at] is None)
            if len(self.held) < self.top:
                heappush(self.held, entry)
            elif entry > self.held[0]:
                heapreplace(self.held, entry)
        if len(self.held) == self.top:
            self.least = self.held[0][0]

    def rows(self) -> list[tuple[int | None, int]]:
        return [(None if null else -key, score) for score, key, null in self.held]


def _searched(vectors: DataFrame, items: list[Item], weights: dict[int, int], documents: int, length: int, rank: dict[int, int], top: int) -> DataFrame:
    """``item_id, item, doc_id, score``: the best documents of each task for each item of a block."""
    groups: list[tuple[list[int], set[int]]] = []
    for k, item in enumerate(items):
        own = {t for t in item.terms if t in weights}
        if not groups or len(groups[-1][1] | own) > TREE_TERMS:
            groups.append(([], set()))
        groups[-1][0].append(k)
        groups[-1][1].update(own)
    shared = vectors.sparkSession.sparkContext.broadcast((items, weights, rank, groups))
    kind = arrow_schema("item int, item_id long, doc_id long, score long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, rank, groups = shared.value
        best = [Best(top) for _ in items]
        plans = []
        for members, held in groups:
            order = sorted(held, key=rank.__getitem__)
            place = np.full(max(weights, default=0) + 1, -1, np.int64)
            place[order] = np.arange(len(order))
            asks = []
            for k in members:
                own = [t for t in items[k].terms if t in weights]
                asks.append((k, place[own], np.array([weights[t] * items[k].terms[t] for t in own], np.int64)))
            plans.append((place, len(order), asks))
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            m = np.array([25 + 75 * n * documents // length for n in batch.column("n").to_pylist()], np.int64)
            terms, tfs = batch.column("terms"), batch.column("tfs")
            doc = np.repeat(np.arange(len(ids)), np.diff(terms.offsets.to_numpy()))
            term, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
            for place, width, asks in plans:
                if not width:
                    continue
                local = np.where(term < len(place), place[np.minimum(term, len(place) - 1)], -1)
                ok = local >= 0
                d, t, f = doc[ok], local[ok], tf[ok]
                rows = np.unique(d)  # documents without such terms are not in the tree
                step = max(64, TREE_CELLS // width)
                for at in range(0, len(rows), step):
                    own = rows[at : at + step]
                    lo, hi = np.searchsorted(d, (own[0], own[-1] + 1))
                    tree = Tree(np.searchsorted(own, d[lo:hi]), t[lo:hi], f[lo:hi], m[own], width)
                    names = [ids[r] for r in own.tolist()]
                    for k, wanted, weight in asks:
                        if len(wanted):
                            tree.search(wanted, weight, best[k], names)
        out = [(k, items[k].item_id, doc_id, score) for k, b in enumerate(best) for doc_id, score in b.rows()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], f.type) for c, f in enumerate(kind)], schema=kind)

    return vectors.select("doc_id", "n", "terms", "tfs").mapInArrow(run, "item int, item_id long, doc_id long, score long")


def rank_documents(docs: DataFrame, benchmark: DataFrame, top: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` highest-scoring documents for each item of ``benchmark`` (``item_id``, ``text``), among
    all rows of ``docs`` (``doc_id``, ``text``; other columns are not read).

    Terms are runs of ASCII letters and digits and of other than ASCII characters, A-Z lower-cased; a null text has none. Equal scores go by ascending doc_id, null last; only scores
    above 0 count. Repeated documents are documents of their own. Repeated items are one; texts that share an item_id are items
    of their own. Items without a document, items and documents without terms give no rows; nor does an empty table."""
    spark, parts, totals = docs.sparkSession, [], None
    for number, (vocabulary, items) in enumerate(_blocks(benchmark)):
        vectors = write_table(_vectors(docs, vocabulary), "term-vectors")
        if totals is None:
            totals = vectors.where("n > 0").agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        held = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()  # the block's terms at most
        weights = {r["term"]: math.floor(1000 * math.log((2 * totals["documents"] + 2) / (2 * r["df"] + 1))) for r in held}
        rank = {r["term"]: k for k, r in enumerate(sorted(held, key=lambda r: (r["df"], r["term"])))}
        if not weights:
            continue
        found = _searched(vectors.where(F.size("terms") > 0), items, weights, totals["documents"], totals["length"], rank, top)
        parts.append(write_table(found.withColumn("block", F.lit(number)), "ranked"))
        drop_table(vectors)
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
