"""Streams: reconciliation of two feeds, conflicts, windows, scoring, upserts."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chainsift.operators.joins import evidence, upsert


def reconcile(blocks: DataFrame, relays: DataFrame, window_s: float = 60.0, retention: str = "1 hour") -> DataFrame:
    """Full outer match of streams ``blocks`` (key, block_ts) and ``relays`` (key, relay_ts, relay_ip) by key.

    ``window_s`` only labels a match's timing. ``retention`` bounds the state: a pair whose times lie further
    apart, or a row that comes later than that, is emitted unmatched."""
    if window_s <= 0:
        raise ValueError("the window must be positive")
    b = blocks.select(F.col("key").alias("b_key"), "block_ts").withWatermark("block_ts", retention)
    r = relays.select(F.col("key").alias("r_key"), "relay_ts", "relay_ip").withWatermark("relay_ts", retention)
    on = (F.col("b_key") == F.col("r_key")) & (F.col("block_ts") >= F.col("relay_ts") - F.expr(f"interval {retention}")) & (F.col("block_ts") <= F.col("relay_ts") + F.expr(f"interval {retention}"))
    both = b.join(r, on, "full_outer")
    delta, timing = evidence(F.col("block_ts"), F.col("relay_ts"), window_s)
    status = F.when(F.col("r_key").isNull(), "LEDGER_ONLY").when(F.col("b_key").isNull(), "NETWORK_ONLY").otherwise("MATCHED")
    return both.select(F.coalesce("b_key", "r_key").alias("key"), status.alias("status"), "block_ts", "relay_ts", "relay_ip", F.when(status == "MATCHED", delta).alias("delta_s"), F.when(status == "MATCHED", timing).alias("timing"))


def conflicts(blocks: DataFrame, retention: str = "1 hour", retention_ms: int = 3_600_000, buckets: int = 1024) -> DataFrame:
    """(key, rows, variants, status) updates of a stream (key, fact, block_ts): equal repeats are ignored, differing ones are CONFLICTING.

    The state holds a key's distinct facts, which go once the watermark is ``retention_ms`` past its last row. Keys are dealt into ``buckets`` by a hash:
    a group is a bucket, whose keys are read and written together. The number must stay the same over restarts."""

    def update(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else {}  # key: rows, facts, until
        now, last = state.getCurrentWatermarkMs(), {}
        if not state.hasTimedOut:
            for b in batches:
                for key, fact, ms in zip(b["key"].tolist(), b["fact"].tolist(), b["ms"].tolist()):
                    own = held.get(key)
                    if own is None:
                        own = held[key] = [0, set(), 0]
                    own[0] += 1
                    own[1].add(fact)
                    last[key] = max(last.get(key, 0), 0 if pd.isna(ms) else int(ms))
            for key, ms in last.items():
                held[key][2] = max(ms, now) + retention_ms
        held = {k: v for k, v in held.items() if v[2] > now}
        if held:
            state.update((pickle.dumps(held),))
            state.setTimeoutTimestamp(min(v[2] for v in held.values()))
        else:
            state.remove()
        found = [(k, held[k][0], len(held[k][1])) for k in last]
        yield pd.DataFrame({"key": [k for k, *_ in found], "rows": [n for _, n, _ in found], "variants": [v for *_, v in found], "status": ["CONFLICTING" if v > 1 else "SINGLE" for *_, v in found]})

    timed = blocks.withWatermark("block_ts", retention).withColumn("ms", F.unix_millis("block_ts")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return timed.groupBy("bucket").applyInPandasWithState(update, "key string, rows long, variants long, status string", "held binary", "update", GroupStateTimeout.EventTimeTimeout)


def tumbling(events: DataFrame, every: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums of (ts, event_type, value) by window, a new one each ``slide`` (``every`` where not given); works on batches and streams."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every, slide or every), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) of sessions parted by ``gap``."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def score_events(telemetry: DataFrame, scored: DataFrame) -> DataFrame:
    """Each relayed transaction (a stream or a batch) with its scenario's risk level and the alert flag."""
    from chainsift.functions.columns import risk_level

    both = telemetry.join(scored, "txid", "left").withColumn("risk", F.coalesce("risk", F.lit(0.0)))
    alert = (F.col("risk") >= 0.75) | (F.col("node_type") == "tor_exit_node") | F.col("typology").isNotNull()
    return both.select("txid", "relay_ip", "node_type", "risk", risk_level(F.col("risk")).alias("level"), "typology", alert.alias("alert"))


def feature_sink(spark: SparkSession, store: str, features: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for new ledger entries: transactions the store does not know are appended to ``store``/entries, the features
    of the scenarios they touch are computed anew from the whole store, and appended to ``store``/features with the batch's number.

    The newest row of a scenario counts. A batch that comes again (a restart) finds its transactions known and its scenarios unchanged."""

    def run(batch: DataFrame, number: int) -> None:
        known = spark.read.schema(batch.schema).parquet(f"{store}/entries")
        new = batch.join(known.select("txid").distinct(), "txid", "left_anti").select(batch.columns)
        new.write.mode("append").parquet(f"{store}/entries")
        touched = batch.select("scenario").distinct()
        own = spark.read.schema(batch.schema).parquet(f"{store}/entries").join(touched, "scenario", "left_semi")
        features(own).withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{store}/features")

    return run


def upsert_sink(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], key: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: the batch is merged into what ``read`` gives and handed to ``write``."""

    def run(batch: DataFrame, _: int) -> None:
        write(upsert(read(), batch.dropDuplicates([key]), key))

    return run
