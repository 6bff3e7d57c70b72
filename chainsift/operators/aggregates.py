"""Profiles, statistics and accounting over the ledger and its telemetry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainsift.functions.columns import micros, seconds_between, suspicious, tor


def per_transaction(entries: DataFrame) -> DataFrame:
    """txid, ts, scenario, in_sat, out_sat, n_in, n_out: one row a transaction; sums of a side without entries are NULL."""
    return entries.groupBy("txid", "ts", "scenario").agg(
        F.sum(F.when(F.col("side") == "in", F.col("sat"))).alias("in_sat"),
        F.sum(F.when(F.col("side") == "out", F.col("sat"))).alias("out_sat"),
        F.count_if(F.col("side") == "in").alias("n_in"),
        F.count_if(F.col("side") == "out").alias("n_out"),
    )


def entity_profile(entries: DataFrame, rule: str = "volume", least_tx: int = 50, least_sat: int = 10_000_000_000) -> DataFrame:
    """One row an address: totals, transactions, first and last seen, scenarios and the exchange flag.

    ``rule``: 'volume' (that many transactions and more than that many satoshi), 'sent' or 'received' (that many rows of one side)."""
    sent, received = F.count_if(F.col("side") == "in"), F.count_if(F.col("side") == "out")
    sat = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("sat"))), F.lit(0))
    flag = {"volume": (F.count_distinct("txid") >= least_tx) & (sat("in") + sat("out") > least_sat), "sent": sent >= least_tx, "received": received >= least_tx}[rule]
    return entries.groupBy("address").agg(
        sat("in").alias("sent_sat"), sat("out").alias("received_sat"), F.count_distinct("txid").alias("tx_count"), F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"), F.count_distinct("scenario").alias("scenarios"), flag.alias("is_exchange"),
    )


def ranked(counts: DataFrame, value: str, key: str, limit: int, by: list[str] | None = None) -> DataFrame:
    """The ``limit`` largest rows, ties by key; with ``by`` in each group."""
    order = [F.desc(value), F.asc(key)]
    if not by:
        return counts.orderBy(*order).limit(limit)
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= limit)


def telemetry_stats(telemetry: DataFrame, tx: DataFrame, limit: int = 10) -> DataFrame:
    """(metric, key, value): transactions by node type and script, the top ASNs and countries, mean latency (ms) by node type."""
    both = telemetry.join(tx.select("txid", "ts", "script_type"), "txid")
    count = lambda c, name: both.groupBy(F.col(c).alias("key")).agg(F.count("*").cast("double").alias("value")).select(F.lit(name).alias("metric"), "key", "value")
    latency = both.groupBy(F.col("node_type").alias("key")).agg(F.round(F.avg(seconds_between(F.col("ts"), F.col("relay_ts")) * 1000), 3).alias("value"))
    parts = [count("node_type", "node_type"), ranked(count("asn", "asn"), "value", "key", limit), ranked(count("country", "country"), "value", "key", limit), count("script_type", "script_type")]
    out = latency.select(F.lit("latency_ms").alias("metric"), "key", "value")
    for p in parts:
        out = out.unionByName(p)
    return out


def scenario_profile(entries: DataFrame, telemetry: DataFrame, tx: DataFrame) -> DataFrame:
    """One row a scenario: volumes, fees, distinct counts, mean relay delay, time window, share of suspicious relays."""
    money = entries.groupBy("scenario").agg(
        F.count_distinct("txid").alias("tx_count"),
        F.coalesce(F.sum(F.when(F.col("side") == "in", F.col("sat"))), F.lit(0)).alias("in_sat"),
        F.coalesce(F.sum(F.when(F.col("side") == "out", F.col("sat"))), F.lit(0)).alias("out_sat"),
        F.count_distinct("address").alias("wallets"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    infra = telemetry.join(tx, "txid").groupBy("scenario").agg(
        F.sum("fee").alias("fee_sat"),
        F.count_distinct("relay_ip").alias("ips"),
        F.count_distinct("asn").alias("asns"),
        F.round(F.avg(seconds_between(F.col("ts"), F.col("relay_ts"))), 9).alias("delay_s"),
        F.round(100 * F.avg(suspicious(F.col("node_type")).cast("double")), 6).alias("infra_risk_pct"),
    )
    return money.join(infra, "scenario", "left")


def scenario_hubs(entries: DataFrame, limit: int = 5) -> DataFrame:
    """The wallets of most rows in each scenario."""
    return ranked(entries.groupBy("scenario", "address").agg(F.count("*").alias("degree")), "degree", "address", limit, ["scenario"])


def delay_entropy(delays: DataFrame, by: list[str], bin_seconds: float = 1.0) -> DataFrame:
    """Shannon entropy (bits, 4 places) of binned absolute delays (``delay_s``) for each ``by``."""
    bins = delays.where("delay_s is not null").groupBy(*by, F.floor(F.abs("delay_s") / bin_seconds).alias("bin")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    return bins.withColumn("part", -share * F.log2(share)).groupBy(*by).agg(F.round(F.abs(F.sum("part")), 4).alias("entropy"))


def tor_summary(telemetry: DataFrame, tx: DataFrame, bin_seconds: float = 0.05) -> DataFrame:
    """One row for Tor, one for the rest: transactions, IPs, mean delay and its entropy, and the five most frequent countries (country:n)."""
    both = telemetry.join(tx.select("txid", "ts"), "txid").select(tor(F.col("node_type")).alias("is_tor"), "relay_ip", "country", seconds_between(F.col("ts"), F.col("relay_ts")).alias("delay_s"))
    out = both.groupBy("is_tor").agg(F.count("*").alias("tx_count"), F.count_distinct("relay_ip").alias("ips"), F.round(F.avg("delay_s"), 6).alias("delay_s"))
    places = ranked(both.groupBy("is_tor", "country").agg(F.count("*").alias("n")), "n", "country", 5, ["is_tor"])
    places = places.groupBy("is_tor").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "country", "n").alias("c")))), lambda x: x["c"]), ",").alias("top_countries"))
    return out.join(delay_entropy(both, ["is_tor"], bin_seconds), "is_tor").join(places, "is_tor")


def tor_profile(telemetry: DataFrame, entries: DataFrame, tx: DataFrame, clusters: DataFrame, bin_seconds: float = 0.05) -> DataFrame:
    """For each Tor transaction: others from its IP, the IP's delay entropy, whether its inputs' cluster is large, and the
    evasion score: .30 Tor + .40 several transactions from the IP + .20 low delay entropy + .10 linked cluster."""
    own = telemetry.where(tor(F.col("node_type"))).join(tx.select("txid", "ts"), "txid").withColumn("delay_s", seconds_between(F.col("ts"), F.col("relay_ts")))
    ip = own.groupBy("relay_ip").agg((F.count("*") - 1).alias("same_ip"))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    first = entries.where("side = 'in' and idx = 0").join(clusters, "address").join(sizes, "cluster").select("txid", "size")
    out = own.join(ip, "relay_ip").join(delay_entropy(own, ["relay_ip"], bin_seconds), "relay_ip").join(first, "txid", "left")
    score = 0.3 + F.when(F.col("same_ip") > 0, 0.4).otherwise(0.0) + F.when(F.col("entropy") < 1.5, 0.2).otherwise(0.0) + F.when(F.col("size") > 1, 0.1).otherwise(0.0)
    return out.select("txid", "relay_ip", "same_ip", "entropy", F.coalesce("size", F.lit(0)).alias("cluster_size"), F.round(score, 2).alias("evasion_score"))


def dataset_snapshot(tx: DataFrame, telemetry: DataFrame, labels: DataFrame) -> DataFrame:
    """(dimension, key, n): totals and counts by split, class, infrastructure, country and script, in one pass of grouping sets.

    Fails where the sources do not fit: transactions repeated, relays repeated or without a transaction, scenarios of several labels."""
    total = lambda df, c: df.agg(c.alias("bad"))
    faults = {
        "repeated transactions": total(tx, F.count("*") - F.count_distinct("txid")),
        "repeated relays": total(telemetry, F.count("*") - F.count_distinct("txid")),
        "relays without a transaction": total(telemetry.join(tx, "txid", "left_anti"), F.count("*")),
        "scenarios of several labels": total(labels.groupBy("scenario").agg(F.count_distinct("pattern_type", "split").alias("k")), F.count_if(F.col("k") > 1)),
    }
    found = reduce(DataFrame.unionByName, [df.select("bad", F.lit(name).alias("fault")) for name, df in faults.items()])
    found = found.where("bad > 0").agg(F.array_join(F.array_sort(F.collect_list("fault")), ", ").alias("faults"))
    all_ = tx.join(telemetry, "txid").join(labels, "scenario")
    dims = ["split", "pattern_type", "node_type", "country", "script_type"]
    sets = all_.groupingSets([[F.col(d)] for d in dims] + [[]], *dims).agg(F.count("*").alias("n"), *[F.grouping(d).alias(f"g_{d}") for d in dims])
    name = F.coalesce(*[F.when(F.col(f"g_{d}") == 0, F.lit(d)) for d in dims], F.lit("total"))
    # one row of faults goes along, so that the plan itself fails
    n = F.when(F.col("faults") == "", F.col("n")).otherwise(F.raise_error(F.concat(F.lit("sources do not fit: "), F.col("faults"))).cast("long"))
    return sets.crossJoin(F.broadcast(found)).select(name.alias("dimension"), F.coalesce(*dims, F.lit("all")).alias("key"), n.alias("n"))


def timeline(tx: DataFrame, per_tx: DataFrame, bucket: str, most: int = 20_000) -> DataFrame:
    """Transactions and input volume for each day, week (from Monday) or month, zero where nothing happened; fails where that asks for more than ``most`` buckets."""
    kept = tx.join(per_tx.select("txid", "in_sat"), "txid", "left").groupBy(F.date_trunc(bucket, "ts").cast("date").alias("bucket")).agg(F.count("*").alias("tx_count"), F.coalesce(F.sum("in_sat"), F.lit(0)).alias("in_sat"))
    step = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month"}[bucket]
    ends = kept.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    spine = ends.where("a is not null").select(F.sequence("a", "b", F.expr(step)).alias("all")).select(F.explode(F.when(F.size("all") <= most, F.col("all")).otherwise(F.raise_error(F.lit(f"over {most} buckets")).cast("array<date>"))).alias("bucket"))
    return spine.join(kept, "bucket", "left").select("bucket", F.coalesce("tx_count", F.lit(0)).alias("tx_count"), F.coalesce("in_sat", F.lit(0)).alias("in_sat"))


def store_stats(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count_distinct("txid").alias("transactions"), F.count_distinct("scenario").alias("scenarios"), F.count_distinct("address").alias("wallets"))


def pattern_split_cube(labels: DataFrame) -> DataFrame:
    return labels.cube("pattern_type", "split").agg(F.count("*").alias("scenarios")).select(F.coalesce("pattern_type", F.lit("all")).alias("pattern_type"), F.coalesce("split", F.lit("all")).alias("split"), "scenarios")


def size_quartiles(tx: DataFrame, labels: DataFrame) -> DataFrame:
    """Box-plot figures of transactions in a scenario, by pattern."""
    n = tx.groupBy("scenario").agg(F.count("*").alias("n")).join(labels, "scenario")
    q = lambda p: F.percentile("n", F.lit(p))
    return n.groupBy("pattern_type").agg(F.min("n").alias("least"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max("n").alias("most"))


def class_balance(labels: DataFrame) -> DataFrame:
    return labels.groupBy("split").agg(F.count("*").alias("scenarios"), F.round(F.avg("is_illicit"), 6).alias("illicit_share"))


def wallet_reuse(entries: DataFrame) -> DataFrame:
    n = entries.groupBy("address").agg(F.count("*").alias("n"))
    band = F.when(F.col("n") == 1, "1").when(F.col("n") <= 10, "2-10").otherwise("11+")
    return n.groupBy(band.alias("band")).agg(F.count("*").alias("wallets"), F.max("n").alias("most"))


def io_size_stats(per_tx: DataFrame) -> DataFrame:
    long = per_tx.select(F.explode(F.array(F.struct(F.lit("in").alias("side"), F.col("n_in").alias("n")), F.struct(F.lit("out").alias("side"), F.col("n_out").alias("n")))).alias("x")).select("x.*")
    return long.groupBy("side").agg(F.min("n").alias("least"), F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("most"))


def upload_accounting(upload: DataFrame, store: DataFrame) -> DataFrame:
    """One row: rows of an upload (txid, address), unique transactions, repeats in it, already known, new, wallets added."""
    rows = upload.groupBy("txid").agg(F.count("*").alias("n"))
    known = store.select("txid").distinct().withColumn("known", F.lit(True))
    counts = rows.join(known, "txid", "left").agg(
        F.sum("n").alias("input_rows"), F.count("*").alias("unique_tx"), (F.sum("n") - F.count("*")).alias("repeated"), F.count("known").alias("already_indexed"), (F.count("*") - F.count("known")).alias("new_tx")
    )
    wallets = upload.select("address").distinct().join(store.select("address"), "address", "left_anti").agg(F.count("*").alias("wallets_added"))
    return counts.crossJoin(F.broadcast(wallets))  # one row each


def primary_wallet(entries: DataFrame) -> DataFrame:
    """The most frequent input address of each scenario, ties to the lowest."""
    n = entries.where("side = 'in'").groupBy("scenario", "address").agg(F.count("*").alias("n"))
    return n.groupBy("scenario").agg(F.min(F.struct(-F.col("n"), "address")).alias("x")).select("scenario", F.col("x.address").alias("address"))


def wallet_degree(entries: DataFrame) -> DataFrame:
    """Edges (not transactions) of each wallet."""
    return entries.groupBy("address").agg(F.count_if(F.col("side") == "in").alias("sent"), F.count_if(F.col("side") == "out").alias("received"), F.count("*").alias("degree"))


def alert_telemetry(telemetry: DataFrame, tx: DataFrame) -> DataFrame:
    """Distinct IPs, ASNs and countries and relays by infrastructure, for each scenario."""
    both = telemetry.join(tx.select("txid", "scenario"), "txid")
    n = lambda node: F.count_if(F.col("node_type") == node).alias(f"n_{node}")
    return both.groupBy("scenario").agg(
        F.count_distinct("relay_ip").alias("ips"), F.count_distinct("asn").alias("asns"), F.array_join(F.array_sort(F.collect_set("country")), ",").alias("countries"), n("tor_exit_node"), n("vpn_proxy"), n("bulletproof_host"), n("residential")
    )


def scenario_list(entries: DataFrame, telemetry: DataFrame, tx: DataFrame, prefix: str, page: int, page_size: int) -> DataFrame:
    """A page of scenarios whose id starts with ``prefix``, by volume: count, volume, most common node type (ties: lowest)."""
    money = entries.where(F.col("scenario").cast("string").startswith(prefix)).groupBy("scenario").agg(F.count_distinct("txid").alias("tx_count"), F.coalesce(F.sum(F.when(F.col("side") == "in", F.col("sat"))), F.lit(0)).alias("in_sat"))
    common = telemetry.join(tx.select("txid", "scenario"), "txid").groupBy("scenario").agg(F.mode("node_type", True).alias("node_type"))
    return money.join(common, "scenario", "left").orderBy(F.desc("in_sat"), "scenario").offset((page - 1) * page_size).limit(page_size)


def inter_tx_delta(tx: DataFrame) -> DataFrame:
    """Seconds since the scenario's transaction before (ties by txid)."""
    w = Window.partitionBy("scenario").orderBy("ts", "txid")
    return tx.select("scenario", "txid", ((micros(F.col("ts")) - micros(F.lag("ts").over(w))) / 1e6).alias("delta_s"))
