"""Benchmark passages in documents, by spaced-seed hashing.

A seed is a fixed mask over a window of words: it hashes the positions it selects and ignores the others,
so that a replaced word in an ignored place does no harm. Masks are chosen by the length of an item, and only
those that ``escapes`` proves to hit every pattern of equal and replaced words which the rule accepts. Windows
of benchmark items and of documents that share a seed hash are hits; on each hit's diagonal (the same shift
between document and item) all stretches that the rule accepts are found exactly.

Benchmark items are searched in blocks of a bounded number of words. A block's hashes go to all tasks
(the bound is ``block_words``); further blocks are further passes over the documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, window_hashes, word_hashes, write_table

#: Sets of masks, the most selective first; an item is searched by the first set that is proven for its length.
MASKS = (((0, 1, 2, 3, 4), (0, 1, 3, 4, 5), (0, 2, 3, 4, 5)), ((0, 2, 3, 4),), ((0, 1, 2, 3),), ((0, 1, 2),), ((0, 1),), ((0,),))
_SPLIT = bytes.maketrans(bytes(c for c in range(128) if not chr(c).isalnum()), b" " * sum(not chr(c).isalnum() for c in range(128)))


@dataclass(frozen=True)
class Rule:
    """An overlap counts with ``least`` matching words (or, for items shorter than that, ``cover`` of
    the item's words), of which at least ``alike`` of the stretch."""

    least: int = 13
    cover: float = 0.8
    alike: float = 0.75
    shortest: int = 1  # items with fewer words are not searched

    def need(self, words: int) -> int:
        """Matching words that an overlap with an item of so many words has at least."""
        return min(self.least, math.ceil(self.cover * words))


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and digits (other ASCII characters part words)."""
    return (text or "").lower().encode("utf-8", "replace").translate(_SPLIT).split()


def escapes(masks: tuple[tuple[int, ...], ...], need: int, alike: float, words: int | None = None) -> bool:
    """Whether some pattern of equal and other words (at most ``words`` long, if given) has ``need`` equal ones, of
    a share of ``alike``, and yet holds no mask.

    Patterns of up to 2 * need - 1 equal words are enough: a longer one can be cut in two with at least
    ``need`` equal words each, one of which has the share as well."""
    most = 2 * need - 1
    spare = math.floor(most / alike - most + 1e-9)
    held = [sum(1 << (mask[-1] - o) for o in mask) for mask in masks]
    last = (1 << max(mask[-1] for mask in masks) + 1) - 1
    at = {(0, 0): 0}  # (last words, equal ones): the fewest others
    while at:
        then: dict[tuple[int, int], int] = {}
        for (tail, equal), other in at.items():
            for bit in (0, 1):
                t, e, o = (tail << 1 | bit) & last, equal + bit, other + 1 - bit
                if e > most or o > spare or (words is not None and e + o > words) or any(t & h == h for h in held):
                    continue
                if e >= need and e >= alike * (e + o) - 1e-9:
                    return True
                if o < then.get((t, e), o + 1):
                    then[t, e] = o
        at = then
    return False


@cache
def masks_for(words: int, rule: Rule) -> tuple[tuple[int, ...], ...]:
    """The masks for items of so many words; single words (the last set) hit whatever the rule accepts."""
    need = max(1, rule.need(words))
    if need == rule.least and words > 4 * need:
        return masks_for(4 * need, rule)
    limit = None if words >= 4 * need else words
    return next(m for m in MASKS if m == MASKS[-1] or not escapes(m, need, rule.alike, limit))


def stretches(places: np.ndarray, need: int, alike: float) -> list[tuple[int, int, int]]:
    """(first, end, matches) of the stretches between equal words at ``places`` (ascending) that have ``need`` of
    them, of a share of ``alike``: the one with the most matches (then the shortest, then the first), and so on
    before and after it."""
    out, todo = [], [(0, len(places))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < max(1, need):
            continue
        x = places[lo:hi]
        k = np.arange(hi - lo)
        # from a to b is alike enough if open[a] <= close[b]
        close, open_ = k + 1 - alike * (x + 1) + 1e-9, k - alike * x
        lowest = np.minimum.accumulate(open_)
        a = np.searchsorted(-lowest, -close, "left")  # the first a with lowest[a] <= close[b]
        n = np.where(a <= k, k - a + 1, 0)
        most = int(n.max())
        if most < max(1, need):
            continue
        # other starts of as many matches may be shorter
        ends = np.flatnonzero(n == most)
        b = int(ends[np.argmin(x[ends] - x[ends - most + 1])])
        out.append((int(x[b - most + 1]), int(x[b]) + 1, most))
        todo += [(lo, lo + b - most + 1), (lo + b + 1, hi)]
    return out


def runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... (n[k] of them) for each k, one after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Index:
    """Seed hashes of some benchmark items."""

    def __init__(self, items: list[tuple[int, list[bytes]]], rule: Rule):
        self.ids = [i for i, _ in items]
        words = [word_hashes(w) for _, w in items]
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.words = np.concatenate([*words, np.zeros(0, np.uint64)])
        self.need = np.array([max(1, rule.need(len(w))) for w in words], np.int64)
        seeds: dict[tuple[int, ...], list[int]] = {}
        for k, w in enumerate(words):
            if len(w) >= max(1, rule.shortest):
                for mask in masks_for(len(w), rule):
                    seeds.setdefault(mask, []).append(k)
        self.tables = []
        for mask, own in sorted(seeds.items()):
            found = [window_hashes(words[k], mask, mask[-1] + 1) for k in own]
            h = np.concatenate(found)
            item = np.repeat(np.array(own, np.int64), [len(f) for f in found])
            at = np.concatenate([np.arange(len(f)) for f in found])
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[(h >> np.uint64(44)).astype(np.int64)] = True
            self.tables.append((mask, h[order], item[order], at[order], bits))

    def _diagonals(self, h: np.ndarray, ends: np.ndarray, most: int = 1 << 20) -> np.ndarray:
        """Rows (document, item, shift) of the diagonals with a hit, each once; about ``most`` hits are in hand at once."""
        found = [np.zeros((0, 3), np.int64)]
        for mask, keys, item, at, bits in self.tables:
            w = window_hashes(h, mask, mask[-1] + 1)
            near = np.flatnonzero(bits[(w >> np.uint64(44)).astype(np.int64)])
            first, last = np.searchsorted(keys, w[near], "left"), np.searchsorted(keys, w[near], "right")
            doc = np.searchsorted(ends, near, "right")
            hit = np.flatnonzero((last > first) & (near + mask[-1] < ends[np.minimum(doc, len(ends) - 1)]))
            near, first, n, doc = near[hit], first[hit], (last - first)[hit], doc[hit]
            total = np.cumsum(n)
            lo = 0
            while lo < len(near):
                hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
                e = runs(first[lo:hi], n[lo:hi])
                found.append(np.unique(np.stack([np.repeat(doc[lo:hi], n[lo:hi]), item[e], np.repeat(near[lo:hi], n[lo:hi]) - at[e]], axis=1), axis=0))
                lo = hi
        return np.unique(np.concatenate(found), axis=0)

    def overlaps(self, docs: list[list[bytes]], rule: Rule, most: int = 1 << 20) -> list[list[dict]]:
        """Of each document, all overlaps by start in the document, start in the item and item."""
        out: list[list[dict]] = [[] for _ in docs]
        lengths = np.array([len(d) for d in docs], np.int64)
        ends = np.cumsum(lengths)
        h = word_hashes([w for d in docs for w in d])
        if not len(h) or not self.tables:
            return out
        doc, item, shift = self._diagonals(h, ends).T
        # the words of a diagonal that lie in both
        lo, hi = np.maximum(ends[doc] - lengths[doc], shift), np.minimum(ends[doc], shift + self.lengths[item])
        total = np.cumsum(hi - lo)
        at = 0
        while at < len(doc):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
            own, n = slice(at, to), (hi - lo)[at:to]
            same = h[runs(lo[own], n)] == self.words[runs(self.starts[item[own]] + lo[own] - shift[own], n)]
            start = np.cumsum(n) - n
            for k in np.flatnonzero(np.add.reduceat(same.astype(np.int64), start) >= self.need[item[own]]).tolist():
                d, i = int(doc[at + k]), int(item[at + k])
                first = int(lo[at + k])
                for a, b, matches in stretches(np.flatnonzero(same[start[k] : start[k] + n[k]]), int(self.need[i]), rule.alike):
                    out[d].append({"item_id": self.ids[i], "doc_start": first + a - int(ends[d] - lengths[d]), "item_start": first + a - int(shift[at + k]), "n_words": b - a, "matches": matches, "_": i})
            at = to
        for found in out:
            found.sort(key=lambda o: (o["doc_start"], o["item_start"], o.pop("_")))
        return out


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule(), block_words: int = 500_000, into: str = "overlaps") -> DataFrame:
    """Adds ``overlaps array<struct<item_id, doc_start, item_start, n_words, matches>>`` (places in words) to ``docs``.

    All overlaps are listed; those of a pair on one diagonal share no words. Null texts have no words, so neither
    such documents nor such items overlap with anything; items of fewer than ``rule.shortest`` words are not searched. Whole texts are read. All rows and columns stay
    (one that has the name ``into`` is replaced); equal texts get equal overlaps; items of equal text are
    each named; a null item_id is kept as null. An empty benchmark gives empty lists, an empty table an
    empty table."""
    total = benchmark.select(F.sum(F.char_length("text") + 1).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(total / 2 / block_words))  # a word has at least one character and a separator
    kept = [c for c in docs.columns if c.lower() != into.lower()]
    names = [f"c{n}" for n in range(len(kept))]
    text = names[[c.lower() for c in kept].index("text")]
    kinds = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, kept))
    out = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)])
    schema = "array<struct<item_id: long, doc_start: long, item_start: long, n_words: long, matches: long>>"
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    for k in range(blocks):
        # one block of items, of a bounded size
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        index = docs.sparkSession.sparkContext.broadcast(Index([(r["item_id"], w) for r in sorted(block, key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"])) if len(w := plain_words(r["text"])) >= rule.shortest], rule))

        def rows(col, _, index=index):
            new = index.value.overlaps([plain_words(t) for t in col[text]], rule)
            return col | {"overlaps": [a + b for a, b in zip(col["overlaps"], new)] if "overlaps" in col else new}

        out = arrow_map(out, rows, f"{kinds}, overlaps {schema}")
        if k < blocks - 1:  # a pass of its own: one block's index is held at a time
            out = write_table(out, "overlaps")
            index.unpersist()
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, kept)], F.col("overlaps").alias(into))


def decontaminate(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``docs`` without the documents that overlap with a benchmark item; other rows and columns stay as they are."""
    return benchmark_overlaps(docs, benchmark, rule, into="_overlaps").where(F.size("_overlaps") == 0).select(*docs.columns)
