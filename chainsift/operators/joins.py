"""Joins between ledger and telemetry: correlation, conflicts, enrichment, projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainsift.functions.columns import seconds_between

from .graphs import _cut


def merged(tx: DataFrame, telemetry: DataFrame) -> DataFrame:
    return tx.join(telemetry, "txid").select("txid", "ts", "scenario", "fee", "script_type", "relay_ts", "relay_ip", "relay_port", "node_type", "country", "asn")


def conflicts(rows: DataFrame, key: str, facts: list[str]) -> DataFrame:
    """Keys with rows that differ in any of ``facts``."""
    return rows.groupBy(key).agg(F.count("*").alias("rows"), F.count_distinct(F.struct(*facts)).alias("variants")).where("variants > 1")


def id_collisions(rows: DataFrame, number: str, text: str) -> DataFrame:
    """Internal numbers that stand for several texts."""
    return rows.groupBy(number).agg(F.count_distinct(text).alias("texts")).where("texts > 1")


def earliest(observations: DataFrame, key: str) -> DataFrame:
    """The earliest relay of each key: no time comes last, ties by IP."""
    last = F.lit("9999-12-31").cast("timestamp_ntz")
    return observations.groupBy(key).agg(F.min(F.struct(F.coalesce("relay_ts", last).alias("at"), F.col("relay_ip"), F.col("relay_ts"))).alias("x"), F.count("*").alias("relays")).select(key, "x.relay_ts", "x.relay_ip", "relays")


def evidence(block_ts: Column, relay_ts: Column, window_s: float) -> tuple[Column, Column]:
    """(delta in seconds to 3 places, timing status) of a matched pair."""
    delta = F.round(seconds_between(block_ts, relay_ts), 3)
    status = F.when(block_ts.isNull() | relay_ts.isNull(), "MISSING_TIME").when(delta < 0, "CLOCK_ORDER_ISSUE").when(delta > window_s, "OUTSIDE_WINDOW").otherwise("WITHIN_WINDOW")
    return delta, status


def correlate(blocks: DataFrame, relays: DataFrame, window_s: float = 120.0) -> DataFrame:
    """Full outer match by exact key. ``blocks``: (key, block_ts, fact); ``relays``: (key, relay_ts, relay_ip).

    Either side is reduced to one row a key before the join. A key whose block rows differ is CONFLICTING;
    the window only labels the timing, it never unmatches."""
    b = blocks.groupBy("key").agg(F.min("block_ts").alias("block_ts"), F.count_distinct(F.struct("block_ts", "fact")).alias("variants"))
    both = b.join(earliest(relays, "key"), "key", "full_outer")
    delta, timing = evidence(F.col("block_ts"), F.col("relay_ts"), window_s)
    status = F.when(F.col("relays").isNull(), "LEDGER_ONLY").when(F.col("variants").isNull(), "NETWORK_ONLY").when(F.col("variants") > 1, "CONFLICTING").otherwise("MATCHED")
    matched = status == "MATCHED"
    return both.select("key", status.alias("status"), "block_ts", "relay_ts", "relay_ip", F.coalesce("relays", F.lit(0)).alias("relays"), F.when(matched, delta).alias("delta_s"), F.when(matched, timing).alias("timing"))


def correlate_summary(found: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    ledger, network = n("MATCHED") + n("CONFLICTING") + n("LEDGER_ONLY"), n("MATCHED") + n("CONFLICTING") + n("NETWORK_ONLY")
    return found.agg(
        n("MATCHED").alias("matched"), n("LEDGER_ONLY").alias("ledger_only"), n("NETWORK_ONLY").alias("network_only"), n("CONFLICTING").alias("conflicting"),
        F.count_if(F.col("timing").isin("MISSING_TIME", "CLOCK_ORDER_ISSUE")).alias("timing_issues"),
        F.round(n("MATCHED") / F.nullif(F.greatest(ledger, network), F.lit(0)), 4).alias("match_rate"),
        F.round(F.avg(F.when(F.col("timing") == "WITHIN_WINDOW", F.col("delta_s"))), 3).alias("mean_delta_s"),
    )


def enrich(ledger: DataFrame, network: DataFrame, key: str, columns: dict[str, object]) -> DataFrame:
    """Network facts win; a ledger value equal to its placeholder counts as missing. ``columns``: name -> placeholder."""
    other = network.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = ledger.join(other, key, "left")
    return out.select(*[c for c in ledger.columns if c not in columns], *[F.coalesce(f"_{c}", F.nullif(F.col(c), F.lit(p))).alias(c) for c, p in columns.items()])


def wallet_projection(entries: DataFrame) -> DataFrame:
    """Transfers (src, dst, txid, amount, ts): senders by receivers inside a transaction; the first entry of a wallet and side counts, no self-loops."""
    first = Window.partitionBy("txid", "side", "address").orderBy("idx")
    once = entries.withColumn("rn", F.row_number().over(first)).where("rn = 1")
    src = once.where("side = 'in'").select("txid", F.col("address").alias("src"))
    dst = once.where("side = 'out'").select("txid", F.col("address").alias("dst"), F.col("sat").alias("amount"), "ts")
    return src.join(dst, "txid").where("src <> dst").select("src", "dst", "txid", "amount", "ts")


def maximal_sets(members: DataFrame) -> DataFrame:
    """(set_id) of sets (set_id, member) that no other set holds as a whole; of equal sets the lowest id stays.

    Equal sets (in size and two hashes) are one. A set that holds another one holds its rarest member (ties: the lowest) and has all its marks, of
    256 bits: a set is looked for only among those that do and are larger, and pairs without all marks are dropped in the join, before any shuffle.
    What is left is confirmed on all members. A member common to all sets brings no two together, unless they have no other."""
    rows = _cut(members.distinct(), "sets")
    place = F.pmod(F.xxhash64("member", F.lit(1)), F.lit(256))
    marks = [F.bit_or(F.when(F.floor(place / 64) == k, F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).otherwise(0)).alias(f"w{k}") for k in range(4)]
    equal = rows.groupBy("set_id").agg(F.count("*").alias("n"), F.sum(F.xxhash64("member").cast("decimal(20,0)")).alias("h"), F.sum(F.xxhash64("member", F.lit(2)).cast("decimal(20,0)")).alias("g"), *marks)
    # the lowest of equal sets stands for all of them
    kinds = _cut(equal.groupBy("n", "h", "g").agg(F.min("set_id").alias("set_id"), *[F.max(f"w{k}").alias(f"w{k}") for k in range(4)]), "set-kinds")
    own = _cut(rows.join(kinds.select("set_id", "n", "w0", "w1", "w2", "w3"), "set_id"), "set-members")
    often = own.groupBy("member").agg(F.count("*").alias("sets"))
    rare = own.join(often, "member").groupBy("set_id", "n", "w0", "w1", "w2", "w3").agg(F.min(F.struct("sets", "member")).alias("x"))
    asks = rare.select(F.col("set_id").alias("a"), F.col("x.member").alias("member"), F.col("n").alias("n_a"), *[F.col(f"w{k}").alias(f"a{k}") for k in range(4)])
    holds = own.withColumnsRenamed({"set_id": "b", "n": "n_b"})
    within = reduce(lambda x, y: x & y, [F.col(f"a{k}").bitwiseAND(F.col(f"w{k}")) == F.col(f"a{k}") for k in range(4)])
    pairs = asks.join(holds, "member").where((F.col("n_a") < F.col("n_b")) & within).select("a", "b", "n_a")
    one = own.select("set_id", "member")
    shared = pairs.join(one.withColumnRenamed("set_id", "a"), "a").join(one.withColumnRenamed("set_id", "b"), ["b", "member"])
    inside = shared.groupBy("a", "b", "n_a").agg(F.count("*").alias("n")).where("n = n_a")
    return kinds.select("set_id").join(inside.select(F.col("a").alias("set_id")).distinct(), "set_id", "left_anti")


def upsert(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """New keys are added; a value of the delta replaces one of the base only if it is neither null nor empty."""
    other = delta.select(*[F.col(c).alias(f"_{c}") for c in delta.columns])
    out = base.join(other, F.col(key) == F.col(f"_{key}"), "full_outer")
    text = {f.name for f in base.schema if f.dataType.simpleString() == "string"}
    new = lambda c: F.nullif(F.col(f"_{c}"), F.lit("")) if c in text else F.col(f"_{c}")
    return out.select(*[F.coalesce(new(c), F.col(c)).alias(c) if c in delta.columns else F.col(c) for c in base.columns])
