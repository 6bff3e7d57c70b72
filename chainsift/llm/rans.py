"""Token ids in files of independent blocks, coded by a static range asymmetric numeral system.

One frequency table, counted over the whole corpus, is shared by all blocks. Documents are dealt into
ranges of doc_id whose ids are counted first, so that a block knows how many ids lie before it. A block holds whole
documents in ascending doc_id order; its ids are dealt to ``LANES`` interleaved coders. Every
``CHECKPOINT`` rows of lanes the coder states and the place in the word stream are stored, so that the
parts of a block can be decoded side by side. Blocks carry checksums of the coded bytes and of the ids.

A file set is a folder with two Parquet tables, so that any store Spark writes to will do: ``blocks``
(one row a block) and ``frequencies`` (one row an id).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, drop_table, write_table
from .tokens import slices, tokenizer

LANES = 1024
CHECKPOINT = 128
BLOCK = 1 << 19
SCALE = 20
_LOW = np.uint64(1 << 31)
_BLOCK_SCHEMA = "part int, block int, start long, n_docs long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, states binary, places array<long>, coded binary, coded_crc32 long, ids_crc32 long"


def frequencies(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Shares of 2 ** scale: at least 1 for an id that occurs; what rounding leaves goes to, or is taken from, the most frequent ids."""
    if not counts.any():
        return np.zeros(len(counts), np.int64)
    share = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) * ((1 << scale) / counts.sum())).astype(np.int64)), 0)
    left = (1 << scale) - int(share.sum())
    for i in np.argsort(-share, kind="stable"):
        step = left if left > 0 else max(left, 1 - int(share[i]))
        share[i] += step
        left -= step
        if not left:
            return share
    raise ValueError("more ids than the scale can hold")


class Coder:
    def __init__(self, share: np.ndarray):
        self.share = share.astype(np.uint64)
        self.below = (np.cumsum(share) - share).astype(np.uint64)
        self.limit = self.share << np.uint64(63 - SCALE)
        self.symbol = np.repeat(np.arange(len(share), dtype=np.uint32), share)

    def encode(self, ids: np.ndarray, pad: int) -> tuple[np.ndarray, list[int], np.ndarray]:
        """States at each checkpoint (checkpoints x lanes), places of these in the words, and the words."""
        rows = -(-len(ids) // LANES)
        grid = np.full(rows * LANES, pad, np.int64)
        grid[: len(ids)] = ids
        grid = grid.reshape(rows, LANES)
        x = np.full(LANES, _LOW, np.uint64)
        states, spoken, chunks = [], [], []
        for r in range(rows - 1, -1, -1):
            f, limit = self.share[grid[r]], self.limit[grid[r]]
            full = x >= limit
            chunks.append(x[full].astype("<u4"))
            x = np.where(full, x >> np.uint64(32), x)
            q = x // f
            x = (q << np.uint64(SCALE)) + (x - q * f) + self.below[grid[r]]
            if r % CHECKPOINT == 0:
                states.append(x)
                spoken.append(len(chunks))
        sizes = np.cumsum([len(c) for c in chunks])
        total = int(sizes[-1])
        places = [total - int(sizes[n - 1]) for n in spoken[::-1]]
        return np.array(states[::-1], np.uint64), places, np.concatenate(chunks[::-1])

    def decode(self, states: np.ndarray, places: list[int], words: np.ndarray, n: int) -> np.ndarray:
        rows, parts = -(-n // LANES), len(places)
        x, at = states.copy(), np.array(places, np.int64)[:, None]
        out = np.zeros((parts, CHECKPOINT, LANES), np.uint32)
        words = np.append(words.astype(np.uint64), np.zeros(1, np.uint64))
        mask = np.uint64((1 << SCALE) - 1)
        for r in range(min(CHECKPOINT, rows)):
            live = parts if (parts - 1) * CHECKPOINT + r < rows else parts - 1
            y = x[:live]
            slot = y & mask
            s = self.symbol[slot.astype(np.int64)]
            out[:live, r] = s
            y = self.share[s] * (y >> np.uint64(SCALE)) + slot - self.below[s]
            low = y < _LOW
            take = np.cumsum(low, axis=1)
            more = words[np.where(low, at[:live] + take - 1, len(words) - 1)]
            x[:live] = np.where(low, (y << np.uint64(32)) | more, y)
            at[:live] += take[:, -1:]
        return out.reshape(-1)[:n]


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2) -> None:
    """Writes the ids of all documents, each with ``end_id`` after it, to a new folder ``path``.

    Order: ascending doc_id (null first; rows with one doc_id by their ids). A null or empty text is
    ``end_id`` alone; a very long text makes a block of its own size; an empty table makes no blocks.
    Other columns are not read."""
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # several ranges for each partition they are dealt to, which evens them out
    ranges = 4 * n
    bounds, without, total = rows.agg(F.percentile_approx("doc_id", [(k + 1) / ranges for k in range(ranges - 1)], 10 * ranges), F.count("*") - F.count("doc_id"), F.count("*")).first()
    bounds = np.array(sorted(set(bounds or [])), np.int64)
    # rows of a null doc_id come first, in as many ranges of a hash of their ids as their share asks for
    nulls = max(1, -(-ranges * without // max(1, total))) if without else 0
    staged_schema = "part int, tie long, doc_id long, n_ids long, wide boolean, ids binary, counts binary"
    staged_kind = arrow_schema(staged_schema)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        wide = max(tok.vocabulary, end_id + 1) > 1 << 16
        kind, seen = "<u4" if wide else "<u2", np.zeros(0, np.int64)
        for batch in batches:
            for at, size in slices(batch.column("text")):
                ids, places = tok.encode_array(batch.column("text").slice(at, size), end_id)
                found = np.bincount(ids, minlength=len(seen))
                found[: len(seen)] += seen
                seen = found
                doc = batch.column("doc_id").slice(at, size)
                raw = pa.Array.from_buffers(pa.large_binary(), size, [None, pa.py_buffer(places * np.dtype(kind).itemsize), pa.py_buffer(ids.astype(kind))])
                empty = doc.is_null().to_numpy(zero_copy_only=False)
                part = nulls + np.searchsorted(bounds, doc.fill_null(0).to_numpy(), "left")
                tie = np.zeros(size, np.int64)
                for k in np.flatnonzero(empty).tolist():
                    tie[k] = xxhash.xxh3_64_intdigest(raw[k].as_buffer()) >> 1
                    part[k] = (int(tie[k]) * nulls) >> 63
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(tie), doc, pa.array(np.diff(places)), pa.array(np.full(size, wide)), raw.cast(pa.binary()), pa.nulls(size, pa.binary())], schema=staged_kind)
        # the task's counts, an id's at its place
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((-1, None, None, None, None, None, seen.astype("<u8").tobytes()), staged_kind)], schema=staged_kind)

    staged = write_table(rows.mapInArrow(tokenise, staged_schema), "rans-ids")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("counts"):
                seen = np.frombuffer(raw.as_buffer(), "<u8").astype(np.int64)
                ids = np.flatnonzero(seen)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(seen[ids])], names=["id", "n"])

    # one row for an id at most: bounded by the tokenizer's vocabulary
    seen = staged.where("counts is not null").select("counts").mapInArrow(spread, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(seen["id"].max()) + 1 if len(seen) else 1, np.int64)
    counts[seen["id"]] = seen["n"]
    share = frequencies(counts)
    spark.createDataFrame([(int(i), int(share[i])) for i in np.flatnonzero(share)], "id long, share long").coalesce(1).write.parquet(f"{path}/frequencies")
    # ids of all ranges before each: one number a range
    held = {r["part"]: r["n"] for r in staged.where("part >= 0").groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before = dict(zip(sorted(held), np.cumsum([0, *(held[p] for p in sorted(held))]).tolist()))
    shared = spark.sparkContext.broadcast((share, before))
    kind = arrow_schema(_BLOCK_SCHEMA)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, before = Coder(shared.value[0]), shared.value[1]
        part, block, start = None, 0, 0
        docs_, ids_, held = [], [], 0

        def made() -> pa.RecordBatch:
            ids = np.concatenate(ids_).astype("<u4")
            states, places, words_ = coder.encode(ids, end_id)
            coded = words_.tobytes()
            row = (part, block, start, len(docs_), len(ids), docs_, [len(i) for i in ids_], states.astype("<u8").tobytes(), places, coded, zlib.crc32(coded), zlib.crc32(ids.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, kind)], schema=kind)

        for batch in batches:
            for now, doc, raw, wide in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids"), batch.column("wide").to_pylist()):
                ids = np.frombuffer(raw.as_buffer(), "<u4" if wide else "<u2")
                if held and (now != part or held + len(ids) > BLOCK):
                    yield made()
                    block, start, docs_, ids_, held = block + 1, start + held, [], [], 0
                if now != part:
                    part, block, start = now, 0, before[now]
                docs_.append(doc)
                ids_.append(ids)
                held += len(ids)
        if docs_:
            yield made()

    ordered = staged.where("part >= 0").repartition(n, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "tie", "ids")
    ordered.select("part", "doc_id", "wide", "ids").mapInArrow(encode, _BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")
    drop_table(staged)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``doc_id, start, n_tokens, ids`` (little-endian uint32) of a folder that ``write_ids`` made;
    ``start``: ids of all documents before it. Raises where a checksum does not hold."""
    blocks = spark.read.schema(_BLOCK_SCHEMA).parquet(f"{path}/blocks")
    share = spark.read.schema("id long, share long").parquet(f"{path}/frequencies").toPandas()  # as many rows as ids in the vocabulary
    table = np.zeros(int(share["id"].max()) + 1 if len(share) else 1, np.int64)
    table[share["id"]] = share["share"]
    shared = spark.sparkContext.broadcast(table)
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_buffer() if n in ("states", "coded") else batch.column(n)[k].as_py() for n in batch.schema.names}
                if zlib.crc32(row["coded"]) != row["coded_crc32"]:
                    raise ValueError(f"block {row['part']}:{row['block']} is damaged")
                states = np.frombuffer(row["states"], "<u8").reshape(-1, LANES)
                ids = coder.decode(states, row["places"], np.frombuffer(row["coded"], "<u4"), row["n_tokens"]).astype("<u4")
                if zlib.crc32(ids.tobytes()) != row["ids_crc32"]:
                    raise ValueError(f"block {row['part']}:{row['block']} does not decode")
                ends = np.cumsum(row["doc_tokens"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["start"] + ends - row["doc_tokens"], pa.int64()),
                        pa.array(row["doc_tokens"], pa.int64()),
                        pa.array([i.tobytes() for i in np.split(ids, ends[:-1])], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")
