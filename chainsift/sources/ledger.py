"""Canonical tables: ledger entries, transactions, telemetry, labels.

``entries`` is the physical layout that all operators share: one row for each address of a transaction's
side. ``from_tables`` derives it from a star schema of orders and lines; ``explode_ledger`` from a ledger
with parallel arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values.
SUSPICIOUS = ("tor_exit_node", "vpn_proxy", "bulletproof_host")
NODE_TYPES = ("residential", "datacenter", "mobile", "tor_exit_node", "vpn_proxy", "bulletproof_host")
SCRIPT_TYPES = ("P2PKH", "P2SH", "P2WPKH", "P2WSH")
PATTERNS = {"AUTOMOBILE": "peeling_chain", "BUILDING": "layering", "FURNITURE": "mixing", "HOUSEHOLD": "ransomware", "MACHINERY": "normal"}


@dataclass(frozen=True)
class Ledger:
    """entries(txid, ts, scenario, side, idx, address, sat), tx(txid, ts, scenario, fee, script_type),
    telemetry(txid, relay_ts, relay_ip, relay_port, node_type, country, asn, user_agent) and
    labels(scenario, pattern_type, is_illicit, split)."""

    entries: DataFrame
    tx: DataFrame
    telemetry: DataFrame
    labels: DataFrame


def _seconds(c: F.Column) -> F.Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), c.cast("decimal(18,6)"))


def from_tables(spark: SparkSession, sf_dir: str) -> Ledger:
    """Lines 1 to 3 of an order are the inputs of a transaction, further ones its outputs; the customer is the scenario."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    # dealt by order for entries and telemetry alike, so that one shuffle serves both where a query needs both
    orders, lines = read("orders"), read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").repartition("l_orderkey")
    at = (F.col("o_orderdate") + _seconds(F.col("o_orderkey") * 7919 % 86400)).cast("timestamp_ntz")
    head = orders.select(F.col("o_orderkey").alias("txid"), at.alias("ts"), F.col("o_custkey").alias("scenario"))
    customers = read("customer").agg(F.count("*").alias("customers"))
    side = F.when(F.col("l_linenumber") <= 3, "in").otherwise("out")
    own = F.concat(F.lit("c"), "scenario", F.lit("_"), "l_linenumber")
    other = F.concat(F.lit("c"), (F.col("scenario") * 17 + F.col("l_partkey")) % F.col("customers"), F.lit("_"), 1 + F.col("l_suppkey") % 3)
    entries = (
        lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
        .join(head, F.col("l_orderkey") == F.col("txid"))
        .crossJoin(F.broadcast(customers))  # one row
        .select(
            "txid", "ts", "scenario", side.alias("side"), F.when(side == "in", own).otherwise(other).alias("address"),
            F.round(F.col("l_extendedprice") * 100).cast("long").alias("sat"), "l_linenumber", "l_partkey", "l_suppkey",
        )
    )
    place = Window.partitionBy("txid", "side").orderBy("l_linenumber", "l_partkey", "l_suppkey", "sat")
    entries = entries.withColumn("idx", F.row_number().over(place) - 1).select("txid", "ts", "scenario", "side", "idx", "address", "sat")
    script = F.element_at(F.array(*map(F.lit, SCRIPT_TYPES)), (F.col("txid") % 4 + 1).cast("int"))
    tx = head.select("txid", "ts", "scenario", (100 + F.col("txid") % 900).alias("fee"), script.alias("script_type"))

    first = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    relay = lines.select("l_orderkey", "l_suppkey", F.row_number().over(first).alias("rn")).where("rn = 1")
    places = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", F.col("n_name").alias("country"))
    node = F.element_at(F.array(*map(F.lit, NODE_TYPES)), (F.col("l_suppkey") % 6 + 1).cast("int"))
    telemetry = (
        relay.join(head, F.col("l_orderkey") == F.col("txid"))
        .join(places, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            "txid",
            (F.col("ts") - _seconds((50 + F.col("txid") % 451) / F.lit(1000).cast("decimal(4,0)"))).cast("timestamp_ntz").alias("relay_ts"),
            F.concat(F.lit("10."), "s_nationkey", F.lit("."), F.col("l_suppkey") % 256, F.lit(".1")).alias("relay_ip"),
            F.when(F.col("txid") % 7 == 0, 9050).otherwise(8333).alias("relay_port"),
            node.alias("node_type"),
            "country",
            F.concat(F.lit("AS"), F.col("l_suppkey") % 25).alias("asn"),
            F.concat(F.lit("/Satoshi:"), F.col("txid") % 3 + 20, F.lit(".0.0/")).alias("user_agent"),
        )
    )
    pattern = F.create_map(*[F.lit(x) for kv in PATTERNS.items() for x in kv])[F.col("c_mktsegment")]
    labels = read("customer").select(
        F.col("c_custkey").alias("scenario"),
        pattern.alias("pattern_type"),
        (pattern != "normal").cast("int").alias("is_illicit"),
        F.when(F.col("c_custkey") % 5 == 0, "test").otherwise("train").alias("split"),
    )
    return Ledger(entries, tx, telemetry, labels)


def explode_ledger(ledger: DataFrame) -> DataFrame:
    """Entries of a ledger with parallel arrays (input_addresses, input_amounts, output_addresses, output_amounts; BTC amounts)."""
    sides = F.array(
        F.struct(F.lit("in").alias("side"), F.arrays_zip(F.col("input_addresses").alias("address"), F.col("input_amounts").alias("amount")).alias("all")),
        F.struct(F.lit("out").alias("side"), F.arrays_zip(F.col("output_addresses").alias("address"), F.col("output_amounts").alias("amount")).alias("all")),
    )
    long = ledger.select("txid", F.col("timestamp").alias("ts"), F.col("scenario_id").alias("scenario"), F.explode(sides).alias("s"))
    long = long.select("txid", "ts", "scenario", "s.side", F.posexplode("s.all").alias("idx", "e"))
    return long.select("txid", "ts", "scenario", "side", "idx", "e.address", F.round(F.col("e.amount").cast("decimal(28,8)") * 100000000).cast("long").alias("sat"))


#: The same tables as DuckDB CTEs, for oracles.
DUCK = """WITH RECURSIVE entry0 AS (
  SELECT o_orderkey AS txid, o_orderdate + to_seconds(o_orderkey * 7919 % 86400) AS ts, o_custkey AS scenario,
    CASE WHEN l_linenumber <= 3 THEN 'in' ELSE 'out' END AS side,
    CASE WHEN l_linenumber <= 3 THEN 'c' || o_custkey || '_' || l_linenumber
         ELSE 'c' || ((o_custkey * 17 + l_partkey) % (SELECT count(*) FROM customer)) || '_' || (1 + l_suppkey % 3) END AS address,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS sat, l_linenumber, l_partkey, l_suppkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
entry AS (SELECT txid, ts, scenario, side, CAST(row_number() OVER (PARTITION BY txid, side ORDER BY l_linenumber, l_partkey, l_suppkey, sat) - 1 AS INT) AS idx, address, sat FROM entry0),
tx AS (SELECT o_orderkey AS txid, o_orderdate + to_seconds(o_orderkey * 7919 % 86400) AS ts, o_custkey AS scenario, 100 + o_orderkey % 900 AS fee,
    CASE o_orderkey % 4 WHEN 0 THEN 'P2PKH' WHEN 1 THEN 'P2SH' WHEN 2 THEN 'P2WPKH' ELSE 'P2WSH' END AS script_type FROM orders),
relay AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem),
telemetry AS (SELECT o_orderkey AS txid, o_orderdate + to_seconds(o_orderkey * 7919 % 86400) - to_milliseconds(50 + o_orderkey % 451) AS relay_ts,
    '10.' || s_nationkey || '.' || (l_suppkey % 256) || '.1' AS relay_ip, CASE WHEN o_orderkey % 7 = 0 THEN 9050 ELSE 8333 END AS relay_port,
    CASE l_suppkey % 6 WHEN 0 THEN 'residential' WHEN 1 THEN 'datacenter' WHEN 2 THEN 'mobile' WHEN 3 THEN 'tor_exit_node' WHEN 4 THEN 'vpn_proxy' ELSE 'bulletproof_host' END AS node_type,
    n_name AS country, 'AS' || (l_suppkey % 25) AS asn, '/Satoshi:' || (o_orderkey % 3 + 20) || '.0.0/' AS user_agent
  FROM relay JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE rn = 1),
labels0 AS (SELECT c_custkey AS scenario, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'peeling_chain' WHEN 'BUILDING' THEN 'layering' WHEN 'FURNITURE' THEN 'mixing' WHEN 'HOUSEHOLD' THEN 'ransomware' ELSE 'normal' END AS pattern_type,
    CASE WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM customer),
label AS (SELECT *, CAST(pattern_type <> 'normal' AS INT) AS is_illicit FROM labels0),
sums AS (SELECT txid, any_value(ts) AS ts, any_value(scenario) AS scenario, CAST(sum(sat) FILTER (side = 'in') AS BIGINT) AS in_sat, CAST(sum(sat) FILTER (side = 'out') AS BIGINT) AS out_sat,
    count(*) FILTER (side = 'in') AS n_in, count(*) FILTER (side = 'out') AS n_out FROM entry GROUP BY txid),
first AS (SELECT *, row_number() OVER (PARTITION BY txid, side, address ORDER BY idx) AS rn FROM entry),
transfer AS (SELECT s.address AS src, d.address AS dst, s.txid AS txid, d.sat AS amount, d.ts AS ts FROM first s JOIN first d ON s.txid = d.txid
  WHERE s.rn = 1 AND d.rn = 1 AND s.side = 'in' AND d.side = 'out' AND s.address <> d.address),
spent AS (SELECT DISTINCT a.address AS a, b.address AS b FROM entry a JOIN entry b ON a.txid = b.txid AND a.side = 'in' AND b.side = 'in'),
reached AS (SELECT DISTINCT address AS node, address AS root FROM entry UNION SELECT b, root FROM reached JOIN spent ON a = node),
cluster AS (SELECT node AS address, min(root) AS cluster FROM reached GROUP BY node)
"""
