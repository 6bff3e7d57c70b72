"""Harmonic packing of token pieces into fixed-length sequences.

A piece of a length in (C / (k + 1), C / k] belongs to the reciprocal-capacity class k, and a bin of
class k always takes exactly k pieces. Documents are cut so that pieces nearly fill the slot C / k of
their class: the head of a document that would leave a wide gap is cut to the exact slot of the next
class, and its rest is looked at again. Each worker only needs to know how many pieces of a class the
workers before it hold (one count for each worker and class); it then fills its bins alone. The few
pieces that do not complete a bin of their class, less than k for each class, are packed by first-fit
decreasing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, drop_table, write_table
from .tokens import slices, tokenizer

#: Bytes of text that are encoded at once: what a task holds besides its words and one batch is a few times this.
SLICE = 1 << 19
#: Pieces that a worker ranks on its own, about.
PER_WORKER = 20_000


def classes(largest: int) -> list[int]:
    """Documents in a bin, by class: each count to 64, then steps of a sixteenth."""
    out = list(range(1, min(64, largest) + 1))
    while out[-1] < largest:
        out.append(min(largest, out[-1] + (1 << (out[-1].bit_length() - 5))))
    return out


def cuts(total: int, capacity: int, counts: list[int], slack: int, shortest: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, class) of the pieces of a document of ``total`` tokens."""
    start = 0
    while start < total:
        rest = min(capacity, total - start)
        k = counts[bisect_right(counts, capacity // rest) - 1]
        slot = capacity // k
        if rest > shortest and (slot - rest) * slack > slot and k + 1 <= counts[-1]:
            k = counts[bisect_right(counts, k)]
            rest = capacity // k
        yield start, rest, k
        start += rest


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, slack: int = 32, shortest: int = 64, most: int = 256, with_ids: bool = False) -> DataFrame:
    """Rows ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``, little-endian
    uint32, with ``with_ids``), one for each piece.

    Every document ends with ``end_id``, so a null or empty text is one piece of one token. Repeated rows
    and repeated or null doc_ids are packed as documents of their own. Very long texts give many pieces;
    no token is dropped. Sequence ids are gapless from 0, offsets gapless in a sequence. An empty table
    gives no rows. Other columns are not read. ``slack``: a gap over 1 / slack of a slot leads to a cut;
    ``shortest``: shorter rests are not cut; ``most``: the largest number of documents in a bin."""
    spark = docs.sparkSession
    counts = classes(min(most, capacity))
    kind = arrow_schema("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, k int, ids binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        for batch in batches:
            for at, n in slices(batch.column("text"), SLICE):
                part = batch.slice(at, n)
                ids, places = tok.encode_array(part.column("text"), end_id)
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                totals = np.diff(places)
                pieces = [(d, start, length, k) for d, total in enumerate(totals.tolist()) for start, length, k in cuts(total, capacity, counts, slack, shortest)]
                doc, start, length, k = np.array(pieces, np.int64).reshape(-1, 4).T
                lo = 4 * (places[doc] + start)
                spans = [raw[x:y] for x, y in zip(lo.tolist(), (lo + 4 * length).tolist())]
                found = (part.column("doc_id").take(pa.array(doc)), start, length, list(map(zlib.crc32, spans)), totals[doc], k, list(map(bytes, spans)) if with_ids else pa.nulls(len(doc)))
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) if isinstance(v, list) else v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v).cast(f.type) for v, f in zip(found, kind)], schema=kind)
            pa.default_memory_pool().release_unused()  # two workers share an executor's memory with its heap

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, k int, ids binary")
    if not with_ids:
        found = found.drop("ids")
    # equal rows get numbers of their own, so that they need not share a worker
    written = pieces = write_table(found.withColumn("row", F.monotonically_increasing_id()), "pack-pieces")
    workers = max(int(spark.conf.get("spark.sql.shuffle.partitions")), pieces.count() // PER_WORKER)
    pieces = pieces.withColumn("worker", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "row"), F.lit(workers)).cast("int"))

    held = pieces.groupBy("worker", "k").agg(F.count("*").alias("n"))
    by_class = Window.partitionBy("k")
    held = held.select(
        "worker",
        "k",
        F.coalesce(F.sum("n").over(by_class.orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(by_class).alias("of_class"),
    )
    bins = pieces.groupBy("k").agg(F.floor(F.count("*") / F.col("k")).alias("bins"))
    bins = bins.select("k", F.coalesce(F.sum("bins").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first_bin"), F.sum("bins").over(Window.partitionBy(F.lit(0))).alias("all_bins"))
    inside = Window.partitionBy("worker", "k").orderBy("doc_id", "start", "ids_crc32", "length", "row")
    # counts and pieces meet where the ranks need the pieces anyway; the bins have a row for each class
    ranked = (
        pieces.join(held, ["worker", "k"])
        .join(F.broadcast(bins), "k")
        .withColumn("rank", F.col("before") + F.row_number().over(inside) - 1)
        .withColumn("bin", F.floor(F.col("rank") / F.col("k")))
        .withColumn("in_full", (F.col("bin") + 1) * F.col("k") <= F.col("of_class"))
        .withColumn("sequence_id", F.when(F.col("in_full"), F.col("first_bin") + F.col("bin")))
    )
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    ranked = write_table(ranked.select(*kept, "sequence_id", "rank", "all_bins"), "pack-ranked")
    drop_table(written)

    def first_fit(rest: pd.DataFrame) -> pd.DataFrame:
        rest = rest.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True]).reset_index(drop=True)
        room = np.zeros(0, np.int64)
        into = []
        for length in rest["length"]:
            fits = np.flatnonzero(room >= length)
            b = int(fits[0]) if len(fits) else len(room)
            room = room if len(fits) else np.append(room, capacity)
            room[b] -= length
            into.append(b)
        rest["sequence_id"] = rest["all_bins"] + np.array(into, np.int64)
        rest["rank"] = np.arange(len(rest))
        return rest

    # at most k - 1 pieces of each class are left: a bound that does not depend on the input
    rest = ranked.where("sequence_id is null")
    rest = rest.groupBy("all_bins").applyInPandas(first_fit, ranked.schema)
    placed = ranked.where("sequence_id is not null").unionByName(rest)
    along = Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("offset", F.sum("length").over(along) - F.col("length")).select(*kept, "sequence_id", "offset")
