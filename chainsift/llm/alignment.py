"""Ids of two tokenizers aligned by the bytes that they cover.

For each list of ids a dictionary leads from a token's cumulative end (in bytes) to its index; the intersection of the two key
sets, sorted, cuts both lists into groups that cover the same bytes, and links are expanded group by group.

Neither tokenizer has a token that goes on over the start of a run of spaces, so a text is cut there into words (with the space
before them), and the alignment of a word is made once and kept for its next occurrence in a worker. Documents are read in slices of
a few MB: a slice lists its different pairs of ids with their counts once, its documents name words. Counts of pairs are summed over
all slices, and what a slice needs of them goes back to it; no shuffle carries a row for each token.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, drop_table, write_table
from .tokens import _Lists, slices

#: Words that a worker remembers before it starts afresh.
REMEMBERED = 200_000
SLICE = 4 << 20  # bytes of texts in a slice, or one longer text
PIECE = 1 << 22  # characters of a text that are cut into words at a time
LOW = (1 << 32) - 1
# The characters of the Unicode property White_Space, in order.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_UNCLEAR = re.compile(f"[{_WHITE}] ")
_START = re.compile(f"(?<=[^{_WHITE}]) ")
_SPACE_MARK = "▁"


def pieces(text: str) -> Iterator[list[str]]:
    """The words of a text, without the space before each, in lists; put together with a space before each, they are space + text.

    A word starts at a space after a character that is no white space."""
    at = 0
    while True:
        cut = _START.search(text, at + PIECE) if len(text) > at + PIECE else None
        part = text[at : cut.start()] if cut else text[at:]
        yield _START.split(part) if _UNCLEAR.search(part) or part[:1] == " " else part.split(" ")
        if not cut:
            return
        at = cut.end()


def group_cuts(ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of either list lie before each common end, in order."""
    index_a, index_b = dict(zip(ends_a, range(1, len(ends_a) + 1))), dict(zip(ends_b, range(1, len(ends_b) + 1)))
    common = sorted(index_a.keys() & index_b.keys())
    return tuple(np.fromiter(map(index.__getitem__, common), np.int64, len(common)) for index in (index_a, index_b))


def group_links(ends_a: np.ndarray, ends_b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of linked tokens (a, b) and their group, by group: those whose bytes overlap."""
    from_a, from_b = np.append(0, cuts_a)[:-1], np.append(0, cuts_b)[:-1]
    n_a, n_b = cuts_a - from_a, cuts_b - from_b
    # one token on a side: it is linked with all of the other side
    plain = np.flatnonzero((n_a == 1) | (n_b == 1))
    n = np.maximum(n_a, n_b)[plain]
    group = np.repeat(plain, n)
    step = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
    a, b = from_a[group] + np.where(n_a[group] > 1, step, 0), from_b[group] + np.where(n_b[group] > 1, step, 0)
    more: list[tuple[int, int, int]] = []
    for g in np.flatnonzero((n_a > 1) & (n_b > 1)).tolist():
        i, j = int(from_a[g]), int(from_b[g])
        while i < cuts_a[g] and j < cuts_b[g]:
            more.append((i, j, g))
            i, j = i + (ends_a[i] <= ends_b[j]), j + (ends_b[j] <= ends_a[i])
    if more:
        x, y, z = np.array(more).T
        a, b, group = np.append(a, x), np.append(b, y), np.append(group, z)
        order = np.argsort(group, kind="stable")
        a, b, group = a[order], b[order], group[order]
    return a, b, group


class _Known(dict):
    """Numbers of words in order of their first occurrence; ``fresh``: those not aligned yet."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


class Aligner:
    """Alignments of words by a byte-level BPE file (A) and a sentencepiece file (B)."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        own = {t: i for t, i in self.a.get_vocab().items()}
        # a byte-level entry has a character for each byte
        size_a = {i: len(t) for t, i in own.items() if all(c in pre_tokenizers.ByteLevel.alphabet() for c in set(t))}
        self.size_a = np.array([size_a.get(i, 0) for i in range(max(own.values()) + 1)], np.int64)
        as_bytes = lambda p: 1 if re.fullmatch("<0x[0-9A-F]{2}>", p) else len(p.replace(_SPACE_MARK, " ").encode())
        self.size_b = np.array([as_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())], np.int64)
        self.text_a, self.text_b = [str(i) for i in range(len(self.size_a))], [str(i) for i in range(len(self.size_b))]
        self.forget()

    def forget(self) -> None:
        self.known = _Known()
        self.n_a, self.n_b, self.n_groups = (np.zeros(0, np.int64) for _ in range(3))
        self.texts: list[bytes] = []
        self.pairs = _Wide()

    def _align(self, words: list[str]) -> None:
        """Keeps the alignment of words that can stand one after another."""
        text = " " + " ".join(words)
        ids_a = np.asarray(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        # of an empty text B makes nothing, but a space at the end of a text has its piece
        ids_b = np.asarray(self.b.encode(text[1:]) if text != " " else self.b.encode("0 ")[len(self.b.encode("0")) :], np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        stops = np.cumsum([1 + len(w.encode()) for w in words])
        cuts_a, cuts_b = group_cuts(ends_a.tolist(), ends_b.tolist())
        common = ends_a[cuts_a - 1]
        last = np.searchsorted(common, stops)
        if ends_a[-1] != stops[-1] or ends_b[-1] != stops[-1] or (common[np.minimum(last, len(common) - 1)] != stops).any():
            raise ValueError("a token goes over the start of a word, or stands for other bytes than the text's")
        a, b, group = group_links(ends_a, ends_b, cuts_a, cuts_b)
        after = last + 1  # groups up to the end of each word
        for mine, cuts in (("n_a", cuts_a), ("n_b", cuts_b)):
            setattr(self, mine, np.append(getattr(self, mine), np.diff(cuts[last], prepend=0)))
        self.n_groups = np.append(self.n_groups, np.diff(after, prepend=0))
        self.pairs.add(ids_a[a] << 32 | ids_b[b], np.diff(np.searchsorted(group, after), prepend=0))
        x, y = list(map(self.text_a.__getitem__, ids_a.tolist())), list(map(self.text_b.__getitem__, ids_b.tolist()))
        shown, i, j = [], 0, 0
        for to_a, to_b in zip(cuts_a.tolist(), cuts_b.tolist()):
            shown.append(f"{x[i]}|{y[j]}" if to_a - i == 1 and to_b - j == 1 else f"{','.join(x[i:to_a])}|{','.join(y[j:to_b])}")
            i, j = to_a, to_b
        at = 0
        for to in after.tolist():
            self.texts.append(";".join(shown[at:to]).encode())
            at = to

    def learn(self) -> None:
        """Aligns the words that are new. Words that end in white space are aligned alone: what follows could change them."""
        fresh, held = self.known.fresh, []
        for k, word in enumerate(fresh):
            if word == "" or re.match(f"[{_WHITE}]", word[-1]):
                if held:
                    self._align(held)
                self._align([word])
                held = []
            else:
                held.append(word)
            if len(held) >= 50_000 or (k == len(fresh) - 1 and held):
                self._align(held)
                held = []
        self.known.fresh = []


class _Wide(_Lists):
    """Lists of 64-bit numbers."""

    def __init__(self):
        super().__init__()
        self.flat = np.zeros(1024, np.int64)

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> int:
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(self.used + len(flat), np.int64)])
        return super().add(flat, lengths)


_HELD: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each pair of files in a Python worker."""
    if (path_a, path_b) not in _HELD:
        _HELD[path_a, path_b] = Aligner(path_a, path_b)
    return _HELD[path_a, path_b]


_READ = "slice long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, words array<int>, pairs array<long>, times array<long>, ends array<int>, places array<int>"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _slice(found: Aligner, number: int, ids: list, texts: list[str | None]) -> dict[str, list]:
    """Rows of ``_READ``: one for each document (``words``: places in the slice's list of words), and one for the slice (its different
    pairs, how often each is linked, and the pairs of each word of the list)."""
    if len(found.known) > REMEMBERED:
        found.forget()
    numbers = []
    for text in texts:
        sound = text and _SPACE_MARK not in text  # that character's piece stands for a space, which has other bytes
        numbers.append(np.concatenate([np.fromiter(map(found.known.__getitem__, p), np.int64, len(p)) for p in pieces(text)]) if sound else np.zeros(0, np.int64))
    found.learn()
    used, times = np.unique(np.concatenate(numbers), return_counts=True)
    pairs, ends = found.pairs.gather(used)
    different, places = np.unique(pairs, return_inverse=True)
    linked = np.bincount(places, np.repeat(times, np.diff(ends, prepend=0)), len(different)).astype(np.int64)
    out: dict[str, list] = {c.split()[0]: [] for c in _READ.split(", ")}
    for doc_id, rows in zip(ids, numbers):
        digest = hashlib.sha256()
        for at in range(0, len(rows), 100_000):
            digest.update((b";" if at else b"") + b";".join(map(found.texts.__getitem__, rows[at : at + 100_000].tolist())))
        a, b, g = (int(n[rows].sum()) for n in (found.n_a, found.n_b, found.n_groups))
        row = (number, doc_id, a, b, g, a + b - g, digest.hexdigest() if len(rows) else "", np.searchsorted(used, rows).astype(np.int32), None, None, None, None)
        for column, value in zip(out.values(), row):
            column.append(value)
    for column, value in zip(out.values(), (number, *[None] * 7, different, linked, ends.astype(np.int32), places.astype(np.int32))):
        column.append(value)
    return out


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for each row of ``docs`` (other columns are not read).

    A reads space + text, B the text, before which it puts a space itself; special tokens' strings are plain text. Tokens are linked where
    their bytes overlap; an id pair's count is how many links of all documents hold it. n_best: links whose count is the highest of their B
    id's; count_sum: the sum of the counts of a document's links. Null and empty texts, and those whose B pieces stand for other bytes than
    the text's (such as U+2581), have no tokens: zeros and an empty digest. Repeated rows count each time; a null doc_id stays; an
    empty table gives no rows."""
    kind = arrow_schema(_READ)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            for at, rows in slices(batch.column("text"), SLICE):
                part = batch.slice(at, rows)
                out = _slice(found, n, part.column("doc_id").to_pylist(), part.column("text").to_pylist())
                n += 1
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in kind], schema=kind)

    table = write_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, _READ), "aligned")
    listed = table.where("pairs is not null")
    counts = listed.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    counts = write_table(counts, "pair-counts")
    b = F.col("pair").bitwiseAND(F.lit(LOW))
    highest = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # a row for each id of B's vocabulary at most
    rated = counts.join(F.broadcast(highest), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    wanted = listed.select(F.col("slice").alias("part"), F.posexplode("pairs").alias("place", "pair")).join(rated, "pair").select("part", "place", "n", "best")
    result = arrow_schema(_RESULT)

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        n, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        at = right.column("place").to_numpy()
        n[at], best[at] = right.column("n").to_numpy(), right.column("best").to_numpy()
        own = left.column("is_list").to_numpy()
        row = int(np.flatnonzero(own)[0])
        ends, places = (left.column(c)[row].values.to_numpy() for c in ("ends", "places"))
        sums = [np.diff(np.append(0, np.cumsum(x[places]))[ends], prepend=0) for x in (n, best)]
        docs = left.filter(pa.array(~own))
        words = [w.values.to_numpy() for w in docs.column("words")]
        new = {"count_sum": pa.array([int(sums[0][w].sum()) for w in words], pa.int64()), "n_best": pa.array([int(sums[1][w].sum()) for w in words], pa.int64())}
        return pa.table([new[c] if c in new else docs.column(c) for c in result.names], schema=result)

    own = table.withColumn("is_list", F.col("pairs").isNotNull()).drop("pairs", "times")
    return own.groupBy("slice").cogroup(wanted.groupBy("part")).applyInArrow(total, _RESULT)
