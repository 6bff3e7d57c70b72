"""Lookups, searches and feeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainsift.functions.columns import seconds_between

from .graphs import _cut


def transactions(per_tx: DataFrame, tx: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Each transaction with its telemetry; defaults where none was observed, and a flag that says so."""
    out = tx.join(per_tx.drop("ts", "scenario"), "txid", "left").join(telemetry, "txid", "left")
    return out.select(
        "txid", "ts", "scenario", "fee", "script_type", F.coalesce("in_sat", F.lit(0)).alias("in_sat"), F.coalesce("out_sat", F.lit(0)).alias("out_sat"),
        F.coalesce("relay_ip", F.lit("unknown")).alias("relay_ip"), F.coalesce("node_type", F.lit("unknown")).alias("node_type"), F.coalesce("country", F.lit("??")).alias("country"),
        F.col("relay_ts").isNotNull().alias("observed"),
    )


def first_match(branches: list[DataFrame]) -> DataFrame:
    """Rows (query, kind, id) of the first branch, by order, that has any for a query."""
    out = None
    for k, b in enumerate(branches):
        b = b.select("query", "kind", "id", F.lit(k).alias("priority"))
        out = b if out is None else out.unionByName(b)
    return out.withColumn("best", F.min("priority").over(Window.partitionBy("query"))).where("priority = best").select("query", "kind", "id")


def substrings(text: Column) -> Column:
    """All distinct substrings of a short text (ids, IPs): n (n + 1) / 2 at most."""
    n = F.char_length(text)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda a: F.transform(F.sequence(F.lit(1), n - a + 1), lambda k: F.substring(text, a, k)))))


def pieces(text: Column, size: Column) -> Column:
    """All distinct substrings of ``size`` characters, in one pass along the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.concat(F.lit("(?s)(?=(.{"), size.cast("string"), F.lit("}))")), F.lit(1)))


def search(queries: DataFrame, tx: DataFrame, entries: DataFrame, telemetry: DataFrame, limit: int = 20) -> DataFrame:
    """For each query: the transaction, else the wallet, else the scenario of that id, else IPs and ASNs that contain it; at most ``limit`` rows each.

    All are equi-joins: distinct IPs and ASNs, which are short, meet the queries by their substrings."""
    q = queries.select("query", F.lower(F.trim("query")).alias("q"))
    by_tx = q.join(tx.select("txid").distinct(), F.col("q") == F.col("txid").cast("string")).select("query", F.lit("transaction").alias("kind"), "q", F.col("q").alias("id"))
    by_wallet = q.join(entries.select("address").distinct(), F.col("q") == F.lower("address")).select("query", F.lit("wallet").alias("kind"), F.col("address").alias("id"))
    by_scenario = q.join(tx.select(F.concat(F.lit("s"), F.col("scenario")).alias("sid")).distinct(), F.col("q") == F.col("sid")).select("query", F.lit("scenario").alias("kind"), F.col("sid").alias("id"))
    places = telemetry.select(F.explode(F.array("relay_ip", "asn")).alias("id")).distinct()
    by_place = q.join(places.select("id", F.explode(substrings(F.lower("id"))).alias("q")), "q").select("query", F.lit("network").alias("kind"), "id")
    found = first_match([by_tx, by_wallet, by_scenario, by_place])
    return found.withColumn("rn", F.row_number().over(Window.partitionBy("query").orderBy("id"))).where(F.col("rn") <= limit).drop("rn")


def resolve_scenario(targets: DataFrame, tx: DataFrame, entries: DataFrame, aliases: DataFrame, hashes: DataFrame, prefixes: DataFrame, marks: str = "sample_|live_|test_") -> DataFrame:
    """(query, scenario), by the first that answers: scenario id, alias (alias, scenario), transaction, hash (hash, txid), address, a scenario id
    that holds the query (as it is or without ``marks``) or is held by it, and a known prefix (prefix, scenario) of the query.

    Of several scenarios the lowest counts. The two substring steps are equi-joins on the substrings of scenario ids, and on those of whole queries that
    are as long as some id; only queries that nothing before answers take part in them."""
    q = targets.select("query", F.regexp_replace("query", "^(TX:|w:|tx:)", "").alias("q")).distinct()
    ids = tx.select("scenario").distinct().withColumn("sid", F.concat(F.lit("s"), F.col("scenario")))
    of_tx = tx.select("txid", F.col("txid").cast("string").alias("q"), "scenario")
    steps = [
        q.join(ids.select(F.col("sid").alias("q"), "scenario"), "q"),
        q.join(aliases.select(F.col("alias").alias("q"), "scenario").join(ids, "scenario", "left_semi"), "q"),
        q.join(of_tx, "q"),
        q.join(hashes.select(F.col("hash").alias("q"), "txid").join(of_tx.select("txid", "scenario"), "txid"), "q"),
        q.join(entries.select(F.col("address").alias("q"), "scenario"), "q"),
    ]
    exact = [d.select("query", "scenario", F.lit(k).alias("p")) for k, d in enumerate(steps)]
    found = _cut(reduce(DataFrame.unionByName, exact), "exact")  # four parts ask for it
    low = F.lower("q")
    left = q.join(found.select("query").distinct(), "query", "left_anti").select("query", low.alias("low"), F.regexp_replace(low, marks, "").alias("clean")).where("low <> ''")
    left = _cut(left, "unanswered")
    parts = ids.select("scenario", F.explode(substrings(F.lower("sid"))).alias("part"))
    holds = left.select("query", F.explode(F.array_distinct(F.array("low", "clean"))).alias("part")).where("part <> ''").join(parts, "part").select("query", "scenario", F.lit(len(steps)).alias("p"))
    sizes = ids.select(F.char_length(F.lower("sid")).alias("k")).distinct()  # a row for each length of an id
    held = left.crossJoin(F.broadcast(sizes)).select("query", F.explode(pieces(F.col("low"), F.col("k"))).alias("sid"))
    held = held.join(ids.withColumn("sid", F.lower("sid")), "sid").select("query", "scenario", F.lit(len(steps)).alias("p"))
    begins = left.select("query", F.explode(F.array_distinct(F.array("low", "clean"))).alias("text"))
    begins = begins.join(F.broadcast(prefixes), F.col("text").startswith(F.col("prefix"))).select("query", "scenario", F.lit(len(steps) + 1).alias("p"))  # a short fixed list
    both = found.unionByName(holds).unionByName(held).unionByName(begins)
    return both.groupBy("query").agg(F.min(F.struct("p", "scenario")).alias("x")).select("query", "x.scenario")


def resolve_transaction(targets: DataFrame, tx: DataFrame) -> DataFrame:
    """(query, txid): ``TX:`` prefix or number, else the first transaction of the scenario named."""
    q = targets.select("query", F.regexp_extract("query", r"^(?:TX:|tx:)?(\d+)$", 1).alias("n"), F.regexp_extract("query", r"^s(\d+)$", 1).alias("s"))
    direct = q.where("n <> ''").join(tx, F.col("n") == F.col("txid").cast("string")).select("query", "txid")
    of = tx.groupBy("scenario").agg(F.min(F.struct("ts", "txid")).alias("x")).select(F.col("scenario").cast("string").alias("s"), F.col("x.txid").alias("txid"))
    return direct.unionByName(q.where("s <> ''").join(of, "s").select("query", "txid"))


def feed_page(tx: DataFrame, telemetry: DataFrame, limit: int, offset: int, tor_only: bool = False) -> DataFrame:
    both = tx.join(telemetry, "txid")
    if tor_only:
        both = both.where("node_type = 'tor_exit_node'")
    return both.orderBy("txid").offset(offset).limit(limit).select("txid", "ts", "relay_ip", "node_type", F.round(seconds_between(F.col("ts"), F.col("relay_ts")) * 1000, 2).alias("delta_ms"))


def transaction_flow(entries: DataFrame, tx: DataFrame, clusters: DataFrame) -> DataFrame:
    """Inputs, outputs, the first input's cluster, and the fee in per cent of the inputs."""
    sums = entries.groupBy("txid").agg(
        F.count_if(F.col("side") == "in").alias("inputs"), F.count_if(F.col("side") == "out").alias("outputs"), F.coalesce(F.sum(F.when(F.col("side") == "in", F.col("sat"))), F.lit(0)).alias("in_sat")
    )
    first = entries.where("side = 'in' and idx = 0").join(clusters, "address").select("txid", "cluster")
    pct = F.round(F.col("fee") / F.greatest(F.lit(1000.0), F.col("in_sat")) * 100, 6)  # 1e-5 coins at least
    return sums.join(tx.select("txid", "fee"), "txid").join(first, "txid", "left").select("txid", "inputs", "outputs", "in_sat", "cluster", pct.alias("fee_pct"))
