"""Reconciliation of two feeds with kept state: lists of what a key has been seen with, and a timer that lets it go."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: State of this kind needs a store that holds lists and timers.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
READING = "key string, status string, block_us long, relay_us long, relay_ip string, relays long, delta_s double, timing string, final boolean"
_NEVER = 1 << 62


def feed(blocks: DataFrame, relays: DataFrame) -> DataFrame:
    """(key, is_block, ts, fact, relay_ip): both feeds in one, as the processor takes them."""
    none = lambda kind: F.lit(None).cast(kind)
    b = blocks.select("key", F.lit(True).alias("is_block"), F.col("block_ts").cast("timestamp").alias("ts"), F.col("fact").cast("double").alias("fact"), none("string").alias("relay_ip"))
    return b.unionByName(relays.select("key", F.lit(False).alias("is_block"), F.col("relay_ts").cast("timestamp").alias("ts"), none("double").alias("fact"), "relay_ip"))


def reading(key: str, blocks: set[tuple[int | None, float | None]], relays: list[tuple[int | None, str | None]], window_s: float) -> dict[str, object]:
    """What is known of a key: as ``joins.correlate`` has it. The earliest relay counts (no time last, ties by IP); equal block rows are one."""
    block_us = min((t for t, _ in blocks if t is not None), default=None)
    relay_us, ip = min(relays, key=lambda r: (_NEVER if r[0] is None else r[0], r[1] is not None, r[1] or ""), default=(None, None))
    status = "LEDGER_ONLY" if not relays else "NETWORK_ONLY" if not blocks else "CONFLICTING" if len(blocks) > 1 else "MATCHED"
    out = {"key": key, "status": status, "block_us": block_us, "relay_us": relay_us, "relay_ip": ip, "relays": len(relays), "delta_s": None, "timing": None}
    if status == "MATCHED":
        if block_us is None or relay_us is None:
            out["timing"] = "MISSING_TIME"
        else:
            scaled = (block_us - relay_us) / 1e6 * 1000.0
            delta = math.copysign(math.floor(abs(scaled) + 0.5), scaled) / 1000.0  # halves away from zero, as SQL engines round
            out |= {"delta_s": delta, "timing": "CLOCK_ORDER_ISSUE" if delta < 0 else "OUTSIDE_WINDOW" if delta > window_s else "WITHIN_WINDOW"}
    return out


class Matcher(StatefulProcessor):
    """Keeps a key's different block rows and all its relays; gives a reading for each batch that adds to them. Once the watermark is ``retention_s``
    past the key's last row, a timer gives the final reading and lets the key go: what comes later starts anew.

    A group is a bucket of keys, whose lists have a row's key beside it: they are read and written once a batch, not once a key, for each call to the
    state store goes from Python to the JVM and back. One timer a bucket stands at the first of its keys' times."""

    def __init__(self, window_s: float, retention_s: float):
        self.window_s, self.retention_ms = window_s, int(retention_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getListState("blocks", "key string, us long, fact double")
        self.relays = handle.getListState("relays", "key string, us long, ip string")
        self.until = handle.getListState("until", "key string, ms long")

    def _held(self, keys) -> tuple[dict, dict]:
        """Block rows and relays of ``keys``."""
        plain = lambda v: None if v is None or v != v else v
        blocks, relays = {k: set() for k in keys}, {k: [] for k in keys}
        for key, us, fact in self.blocks.get():
            if key in blocks:
                blocks[key].add((plain(us), plain(fact)))
        for key, us, ip in self.relays.get():
            if key in relays:
                relays[key].append((plain(us), ip))
        return blocks, relays

    def _rows(self, keys, blocks: dict, relays: dict, final: bool) -> pd.DataFrame:
        rows = [reading(k, blocks[k], relays[k], self.window_s) | {"final": final} for k in keys]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in READING.split(", ")]).astype({"block_us": "Int64", "relay_us": "Int64", "relays": "Int64", "delta_s": "float64"})

    def _wait(self, until: dict) -> None:
        """Keeps the keys' times, and the bucket's timer at the first of them."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if until:
            self.until.put(list(until.items()))
            self.handle.registerTimer(min(until.values()))
        else:
            self.until.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new, last = [], {}
        for batch in rows:
            for name, is_block, us, fact, ip in zip(batch["key"].tolist(), batch["is_block"].tolist(), batch["us"].tolist(), batch["fact"].tolist(), batch["relay_ip"].tolist()):
                name, us = None if pd.isna(name) else name, None if pd.isna(us) else int(us)
                last[name] = max(last.get(name, 0), (us or 0) // 1000)
                new.append((name, us, None if pd.isna(fact) else float(fact)) if is_block else (name, us, None if pd.isna(ip) else ip, True))
        blocks, relays = self._held(last)
        more_blocks, more_relays = [], []
        for row in new:
            if len(row) == 4:
                relays[row[0]].append(row[1:3])
                more_relays.append(row[:3])
            elif row[1:] not in blocks[row[0]]:
                blocks[row[0]].add(row[1:])
                more_blocks.append(row)
        if more_blocks:
            self.blocks.appendList(more_blocks)
        if more_relays:
            self.relays.appendList(more_relays)
        until, now = {k: int(ms) for k, ms in self.until.get()}, timerValues.getCurrentWatermarkInMs()
        for name, ms in last.items():
            until[name] = max(until.get(name, 0), max(ms, now) + self.retention_ms)
        self._wait(until)
        yield self._rows(last, blocks, relays, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until, now = {k: int(ms) for k, ms in self.until.get()}, timerValues.getCurrentWatermarkInMs()
        due = {k for k, ms in until.items() if ms <= now}
        if due:
            yield self._rows(sorted(due, key=repr), *self._held(due), True)
            for state in (self.blocks, self.relays):
                kept = [tuple(r) for r in state.get() if r[0] not in due]
                state.put(kept) if kept else state.clear()
            self._wait({k: ms for k, ms in until.items() if k not in due})

    def close(self) -> None:
        pass


def match_feeds(rows: DataFrame, window_s: float = 120.0, retention_s: float = 3600.0, late: str = "1 hour", buckets: int = 1024) -> DataFrame:
    """A stream of readings (``READING``; in update mode the newest one of a key counts) of a stream ``feed``. Rows more than ``late`` behind the
    newest one of earlier batches are left out, rows without a time never. The session needs the settings ``STORE``.

    Keys are dealt into ``buckets`` by a hash; a task holds one bucket's lists at once. The number must stay the same over restarts."""
    timed = rows.withWatermark("ts", late).withColumn("us", F.unix_micros("ts")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    return timed.groupBy("bucket").transformWithStateInPandas(Matcher(window_s, retention_s), outputStructType=READING, outputMode="Update", timeMode="eventTime")


def newest(readings: DataFrame) -> DataFrame:
    """The newest reading of each key of (``READING``, batch), with times as such."""
    names = [c.split()[0] for c in READING.split(", ")][1:-1]
    best = readings.groupBy("key").agg(F.max_by(F.struct(*names), F.struct("batch", "final")).alias("x"))
    at = lambda c: F.timestamp_micros(f"x.{c}")
    return best.select("key", "x.status", at("block_us").alias("block_ts"), at("relay_us").alias("relay_ts"), "x.relay_ip", "x.relays", "x.delta_s", "x.timing")


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: a batch's readings under its number; a batch that comes again replaces what it left."""

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def run_matching(spark: SparkSession, rows: DataFrame, path: str, window_s: float, retention_s: float, late: str = "1 hour") -> DataFrame:
    """Runs ``match_feeds`` over what the sources hold now, with state and readings under ``path``; goes on where an earlier run of that path ended."""
    old = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        stream = match_feeds(rows, window_s, retention_s, late).writeStream.outputMode("update").foreachBatch(append_to(f"{path}/readings"))
        stream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return newest(spark.read.schema(f"{READING}, batch long").parquet(f"{path}/readings"))


