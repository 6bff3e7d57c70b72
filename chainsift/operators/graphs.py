"""Wallet, transaction and relay graphs, and bounded walks over them."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainsift.functions.columns import rounded


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. On one machine a temporary folder will do where it is unset; on a
    cluster that is an error, for the executors' rows would be left on their own disks."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all machines of the cluster share")
    return f"file://{_own()}"


def _own(made: list[str] = []) -> str:  # noqa: B006
    if not made:
        made.append(tempfile.mkdtemp(prefix="spark-graphs-", dir="/tmp"))
    return made[0]


def _cut(df: DataFrame, name: str) -> DataFrame:
    """Writes a step of an iteration to the shared folder and reads it again."""
    path = f"{shared_folder(df.sparkSession)}/chainsift/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _drop(*written: DataFrame | None) -> None:
    """Deletes steps that ``_cut`` wrote, once nothing reads them any more."""
    for df in written:
        if df is not None:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def nodes(entries: DataFrame, tx: DataFrame, telemetry: DataFrame) -> DataFrame:
    """(id, node_type, detail): wallets, transactions and relay IPs; an IP's facts are those of its first transaction."""
    w = entries.select(F.concat(F.lit("w:"), "address").alias("id")).distinct().select("id", F.lit("wallet").alias("node_type"), F.lit(None).cast("string").alias("detail"))
    t = tx.select(F.concat(F.lit("tx:"), "txid").alias("id"), F.lit("transaction").alias("node_type"), F.col("script_type").alias("detail"))
    ip = telemetry.groupBy("relay_ip").agg(F.min_by("node_type", "txid").alias("detail")).select(F.concat(F.lit("ip:"), "relay_ip").alias("id"), F.lit("ip").alias("node_type"), "detail")
    return w.unionByName(t).unionByName(ip)


def edges(entries: DataFrame, telemetry: DataFrame) -> DataFrame:
    """(src, dst, edge_type, amount): SENT wallet to transaction, RECEIVED transaction to wallet, BROADCAST transaction to IP; parallel edges are rows."""
    t, w = F.concat(F.lit("tx:"), "txid"), F.concat(F.lit("w:"), "address")
    sent = entries.where("side = 'in'").select(w.alias("src"), t.alias("dst"), F.lit("SENT").alias("edge_type"), F.col("sat").alias("amount"))
    received = entries.where("side = 'out'").select(t.alias("src"), w.alias("dst"), F.lit("RECEIVED").alias("edge_type"), F.col("sat").alias("amount"))
    broadcast = telemetry.select(t.alias("src"), F.concat(F.lit("ip:"), "relay_ip").alias("dst"), F.lit("BROADCAST").alias("edge_type"), F.lit(None).cast("long").alias("amount"))
    return sent.unionByName(received).unionByName(broadcast)


def census(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    return node_rows.groupBy(F.col("node_type").alias("kind")).agg(F.count("*").alias("n")).unionByName(edge_rows.groupBy(F.col("edge_type").alias("kind")).agg(F.count("*").alias("n")))


def bipartite_violations(tx: DataFrame, entries: DataFrame) -> DataFrame:
    """Transactions that lack a sender or a receiver."""
    sides = entries.groupBy("txid").agg(F.count_if(F.col("side") == "in").alias("i"), F.count_if(F.col("side") == "out").alias("o"))
    both = tx.select("txid").join(sides, "txid", "left")
    no_in, no_out = F.coalesce("i", F.lit(0)) == 0, F.coalesce("o", F.lit(0)) == 0
    reason = F.when(no_in & no_out, "no entries").when(no_in, "no sender").otherwise("no receiver")
    return both.where(no_in | no_out).select("txid", reason.alias("reason"))


def connected(pairs: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of (a, b) reaches, by alternating large and small stars, until they no longer change (about
    the logarithm of the longest path); a round's table goes once the next one is written."""
    at = _cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    seen = None
    while True:
        both = at.unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        new = _cut(small.where("a <> b").distinct(), "stars")
        _drop(at)
        at = new
        now = at.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen:
            return at.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(at.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        seen = now


def entity_clusters(entries: DataFrame) -> DataFrame:
    """(address, cluster): wallets spent together in a transaction belong to one entity, named by its lowest address; others are alone."""
    spent = entries.where("side = 'in'")
    first = spent.groupBy("txid").agg(F.min("address").alias("b"))
    label = connected(spent.join(first, "txid").select(F.col("address").alias("a"), "b"))
    return entries.select("address").distinct().join(label.withColumnRenamed("node", "address"), "address", "left").select("address", F.coalesce("label", "address").alias("cluster"))


def cluster_profile(entries: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row a cluster: members, flows, inputs of transactions with several, scenarios, and a unit-length embedding of eight terms:
    log1p of members, coins received and coins sent; such inputs a member; scenarios; log1p of input and of output rows; the
    difference of both flows by their sum."""
    several = entries.where("side = 'in'").groupBy("txid").agg(F.count("*").alias("n")).where("n > 1").select("txid", F.lit(1).alias("multi"))
    rows = entries.join(clusters, "address").join(several, "txid", "left")
    out = rows.groupBy("cluster").agg(
        F.count_distinct("address").alias("size"),
        F.coalesce(F.sum(F.when(F.col("side") == "in", F.col("sat"))), F.lit(0)).alias("sent_sat"),
        F.coalesce(F.sum(F.when(F.col("side") == "out", F.col("sat"))), F.lit(0)).alias("received_sat"),
        F.count_distinct("txid").alias("tx_count"),
        F.count_if((F.col("side") == "in") & (F.col("multi") == 1)).alias("multi_inputs"),
        F.count_distinct("scenario").alias("scenarios"),
        F.count_if(F.col("side") == "in").alias("in_rows"),
        F.count_if(F.col("side") == "out").alias("out_rows"),
    )
    size, got, sent = F.col("size").cast("double"), F.col("received_sat") / 1e8, F.col("sent_sat") / 1e8
    parts = [
        F.log1p(size), F.log1p(got), F.log1p(sent), F.col("multi_inputs") / size, F.col("scenarios").cast("double"), F.log1p(F.col("in_rows").cast("double")), F.log1p(F.col("out_rows").cast("double")),
        F.abs(got - sent) / F.greatest(F.lit(0.0001), got + sent),
    ]
    norm = F.sqrt(sum(p * p for p in parts))
    return out.select("*", *[F.round(p / norm, 4).alias(f"e{k}") for k, p in enumerate(parts)])


def trace_path(transfers: DataFrame, src: str, dst: str, max_depth: int = 6) -> DataFrame:
    """(hop, from_wallet, to_wallet, txid) of a shortest path; each wallet keeps its lowest transaction (then wallet) as parent.

    One join a level over a frontier; wallets seen are not visited again. src = dst gives no rows."""
    spark = transfers.sparkSession
    seen = spark.createDataFrame([(src, None, None, 0)], "wallet string, parent string, txid long, hop int")
    frontier = seen
    steps = _cut(transfers.groupBy("src", "dst").agg(F.min("txid").alias("txid")), "trace-steps")
    if src != dst:
        for hop in range(1, max_depth + 1):
            new = frontier.select(F.col("wallet").alias("src")).join(steps, "src").groupBy(F.col("dst").alias("wallet")).agg(F.min(F.struct("txid", "src")).alias("x"))
            new = new.join(seen, "wallet", "left_anti").select("wallet", F.col("x.src").alias("parent"), F.col("x.txid").alias("txid"), F.lit(hop).alias("hop"))
            frontier = _cut(new, "trace")
            seen = seen.unionByName(frontier)
            if frontier.where(F.col("wallet") == dst).limit(1).count() or not frontier.limit(1).count():
                break
    path, at = [], dst
    for hop in range(max_depth, 0, -1):  # one row a level
        row = seen.where((F.col("wallet") == at) & (F.col("hop") > 0) & (F.col("hop") <= hop)).first()
        if row is None:
            break
        path.append((row["hop"], row["parent"], row["wallet"], row["txid"]))
        at = row["parent"]
    path = sorted(path) if at == src and src != dst else []
    return spark.createDataFrame(path, "hop int, from_wallet string, to_wallet string, txid long")


def taint(entries: DataFrame, seeds: DataFrame, decay: float = 0.85, max_depth: int = 5, threshold: float = 0.01) -> DataFrame:
    """(address, hop, taint): haircut taint from ``seeds`` (address), level by level.

    A transaction passes on to each output the taint of a tainted input by its share of all inputs,
    times the output's share, times ``decay``, rounded to four places at each hop (``columns.rounded``); what is below
    ``threshold`` stops. A wallet has the highest taint of all walks of at most ``max_depth`` hops, and the fewest hops of those that give it:
    a later hop can raise it, and is then passed on. A wallet that was not raised is not expanded again, for what it would pass on has been."""
    amounts = entries.groupBy("txid", "side", "address").agg(F.sum("sat").alias("sat"))
    totals = amounts.groupBy("txid", "side").agg(F.sum("sat").alias("total"))
    share = amounts.join(totals, ["txid", "side"]).where("total > 0")
    spent = share.where("side = 'in'").select("txid", F.col("address").alias("src"), (F.col("sat") / F.col("total")).alias("in_share"))
    got = share.where("side = 'out'").select("txid", F.col("address").alias("dst"), (F.col("sat") / F.col("total")).alias("out_share"))
    flow = spent.join(got, "txid").where("src <> dst").select("src", "dst", (F.col("in_share") * F.col("out_share")).alias("share"))
    flow = _cut(flow.groupBy("src", "dst").agg(F.max("share").alias("share")), "flow")
    best = frontier = _cut(seeds.select("address").distinct().select("address", F.lit(0).alias("hop"), F.lit(1.0).alias("taint")), "taint")
    for hop in range(1, max_depth + 1):
        new = frontier.join(flow, F.col("address") == F.col("src")).groupBy("dst").agg(rounded(F.max(F.col("taint") * F.col("share")) * decay, 4).alias("taint"))
        new = new.where(F.col("taint") >= threshold).select(F.col("dst").alias("address"), F.lit(hop).alias("hop"), "taint")
        held = best.select("address", F.col("taint").alias("held"))
        frontier = _cut(new.join(held, "address", "left").where("held is null or taint > held").drop("held"), "taint")
        if not frontier.limit(1).count():
            break
        best = _cut(best.join(frontier.select("address"), "address", "left_anti").unionByName(frontier), "taint-best")
    return best


def coparticipation(entries: DataFrame, least: int = 3) -> DataFrame:
    """(a, b, weight): inputs spent together in transactions of at least ``least`` inputs and outputs."""
    wide = entries.groupBy("txid").agg(F.count_if(F.col("side") == "in").alias("i"), F.count_if(F.col("side") == "out").alias("o")).where((F.col("i") >= least) & (F.col("o") >= least)).select("txid")
    own = entries.where("side = 'in'").join(wide, "txid").select("txid", "address").distinct()
    return own.select("txid", F.col("address").alias("a")).join(own.select("txid", F.col("address").alias("b")), "txid").where("a < b").groupBy("a", "b").agg(F.count("*").alias("weight"))


def community_metrics(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Of communities (node, community): size, density, the share of edge ends that leave, and the diameter of the inner edges."""
    a = members.select(F.col("node").alias("a"), F.col("community").alias("ca"))
    b = members.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    both = pairs.join(a, "a").join(b, "b")
    inner = both.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("inner_edges"))
    outer = both.where("ca <> cb").select(F.explode(F.array("ca", "cb")).alias("community")).groupBy("community").agg(F.count("*").alias("outer_edges"))
    size = members.groupBy("community").agg(F.count("*").alias("size"))
    out = size.join(inner, "community", "left").join(outer, "community", "left").na.fill(0, ["inner_edges", "outer_edges"])
    n, i, o = F.col("size"), F.col("inner_edges"), F.col("outer_edges")
    far = diameters(both.where("ca = cb").select(F.col("ca").alias("community"), "a", "b"))
    out = out.join(far, "community", "left").na.fill(0, ["diameter"])
    return out.select("community", "size", "inner_edges", "outer_edges", "diameter", F.round(F.when(n > 1, 2 * i / (n * (n - 1))).otherwise(0.0), 6).alias("density"), F.round(F.when(i + o > 0, o / (i + o)).otherwise(0.0), 6).alias("external_ratio"))


def diameters(edges: DataFrame) -> DataFrame:
    """(community, diameter) over the edges (community, a, b): see ``communities.diameters``."""
    from . import communities

    return communities.diameters(edges)


def simple_paths(transfers: DataFrame, src: str, dst: str, max_depth: int = 3) -> DataFrame:
    """(hops, path): all paths of at most ``max_depth`` transfers between two wallets that visit no wallet twice, wallets joined by '>'.

    Depth is bounded (six by default in investigations); only steps that can still reach ``dst`` in time are followed."""
    steps = _cut(transfers.select("src", "dst").where("src <> dst").distinct(), "path-steps")
    # wallets from which dst lies within k steps
    near = [transfers.sparkSession.createDataFrame([(dst,)], "dst string")]
    for _ in range(max_depth - 1):
        near.append(_cut(steps.join(near[-1], "dst", "left_semi").select(F.col("src").alias("dst")).union(near[-1]).distinct(), "path-near"))
    front = transfers.sparkSession.createDataFrame([(src, [src])], "at string, path array<string>")
    found = []
    for hop in range(1, max_depth + 1):
        new = front.join(steps, F.col("at") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).join(near[max_depth - hop], "dst", "left_semi")
        new = _cut(new.select(F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path")), "paths")
        found.append(new.where(F.col("at") == dst).select(F.lit(hop).alias("hops"), F.array_join("path", ">").alias("path")))
        front = new.where(F.col("at") != dst)
    return reduce(DataFrame.unionByName, found)


def scenario_graph(entries: DataFrame, tx: DataFrame, telemetry: DataFrame, clusters: DataFrame | None, labels: DataFrame, exchange_rows: int = 50) -> DataFrame:
    """Nodes of each scenario's graph: (scenario, id, node_type, tx_count, first_seen, last_seen, cluster, is_exchange, amount_sat, tag).

    Wallets have what the whole ledger knows of them: rows, first and last time, cluster, and whether they look like an exchange (rows of the
    side they stand on in the scenario, inputs before outputs). Transactions have their outputs' sum, the cluster of the first input and the
    pattern; IPs the time of their first relay in the scenario and its infrastructure.

    Transactions are written once, a row each with its entries and relays. Without ``clusters``, those of ``entity_clusters`` come from these rows too."""
    spends = F.col("side") == "in"
    own = entries.groupBy(F.col("txid").alias("id")).agg(
        F.coalesce(F.sum(F.when(~spends, F.col("sat"))), F.lit(0)).alias("amount_sat"), F.min(F.when(spends & (F.col("idx") == 0), F.col("address"))).alias("address"),
        F.collect_list(F.struct("scenario", "address", "ts", spends.alias("spends"))).alias("entries"),
    )
    relays = telemetry.groupBy("txid").agg(F.collect_list(F.struct("relay_ip", "relay_ts", "node_type")).alias("relays"))
    heads = tx.groupBy("txid").agg(F.collect_list(F.struct("scenario", "ts")).alias("heads"))  # one, but where rows come again
    both = heads.join(relays, "txid", "left")
    at = _cut(both.join(own, both["txid"] == own["id"], "full"), "scenario-transactions")
    if clusters is None:
        inputs = F.transform(F.filter("entries", lambda e: e["spends"]), lambda e: e["address"])
        pairs = at.where("id is not null").select(F.explode(F.array_distinct(inputs)).alias("a"), F.array_min(inputs).alias("b"))
        clusters = connected(pairs).select(F.col("node").alias("address"), F.col("label").alias("cluster"))
        cluster = F.coalesce("cluster", "address")
    else:
        cluster = F.col("cluster")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    # a wallet's rows meet once: those of each scenario are counted first, then all of them
    rows = at.select(F.inline("entries")).repartition("address").groupBy("address", "scenario").agg(
        F.count("*").alias("n"), F.count_if("spends").alias("i"), F.count_if(~F.col("spends")).alias("o"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )
    whole = Window.partitionBy("address")
    wallet = rows.where("address is not null").select(
        "address", "scenario", (F.col("i") > 0).alias("spends"), F.sum("n").over(whole).alias("tx_count"), F.sum("i").over(whole).alias("ins"), F.sum("o").over(whole).alias("outs"), F.min("first").over(whole).alias("first_seen"), F.max("last").over(whole).alias("last_seen")
    )
    busy = F.when(F.col("spends"), F.col("ins")).otherwise(F.col("outs")) >= exchange_rows
    w = wallet.join(clusters, "address", "left").select(
        "scenario", F.concat(F.lit("w:"), "address").alias("id"), F.lit("wallet").alias("node_type"), "tx_count", "first_seen", "last_seen", cluster.alias("cluster"), busy.alias("is_exchange"), none("long", "amount_sat"),
        F.when(busy, "LICIT_EXCHANGE").otherwise(F.concat(F.lit("S"), "scenario")).alias("tag"),
    )
    t = at.select("txid", "amount_sat", "address", F.inline("heads")).join(clusters, "address", "left").join(labels.select("scenario", "pattern_type"), "scenario", "left").select(
        "scenario", F.concat(F.lit("tx:"), "txid").alias("id"), F.lit("transaction").alias("node_type"), F.lit(1).cast("long").alias("tx_count"), F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"), cluster.alias("cluster"), F.lit(False).alias("is_exchange"),
        F.coalesce("amount_sat", F.lit(0)).alias("amount_sat"), F.when(F.col("pattern_type") != "normal", F.upper("pattern_type")).alias("tag"),
    )
    ip = at.select("txid", "relays", F.inline("heads")).select("txid", "scenario", F.inline("relays")).groupBy("scenario", "relay_ip").agg(F.count("*").alias("tx_count"), F.min("relay_ts").alias("first_seen"), F.max("relay_ts").alias("last_seen"), F.min_by("node_type", "txid").alias("tag")).select(
        "scenario", F.concat(F.lit("ip:"), "relay_ip").alias("id"), F.lit("ip").alias("node_type"), "tx_count", "first_seen", "last_seen", none("string", "cluster"), F.lit(False).alias("is_exchange"), none("long", "amount_sat"), "tag"
    )
    return w.unionByName(t).unionByName(ip)


def reach(transfers: DataFrame, hubs: DataFrame, hops: int = 3, gap_s: float = 259200.0, span_s: float = 259200.0) -> DataFrame:
    """(source, recipient, sink, hop, end_ts): where the money of a source's recipients gets to in time order, not through hubs.

    Steps keep the earliest arrival at a wallet for each (source, recipient)."""
    from .ordering import join_within

    transfers = _cut(transfers.select("src", "dst", "ts"), "reach-transfers")  # read in every hop
    step = transfers.join(hubs.select(F.col("address").alias("dst")), "dst", "left_anti")
    front = transfers.groupBy(F.col("src").alias("source"), F.col("dst").alias("recipient")).agg(F.min("ts").alias("start_ts"))
    front = _cut(front.select("source", "recipient", "start_ts", F.col("recipient").alias("sink"), F.col("start_ts").alias("end_ts")), "reach")
    gap, span = F.expr(f"make_dt_interval(0, 0, 0, {gap_s})"), F.expr(f"make_dt_interval(0, 0, 0, {span_s})")
    found = None
    for hop in range(1, hops + 1):
        until = F.least(F.col("end_ts") + gap, F.col("start_ts") + span)
        # stretches of twice the span: most walks lie in one of them
        new = join_within(front, step, ("sink", "src"), F.col("end_ts"), until, "ts", 2 * min(gap_s, span_s))
        new = new.where((F.col("dst") != F.col("source")) & (F.col("dst") != F.col("recipient"))).select("source", "recipient", "start_ts", F.col("dst").alias("sink"), F.col("ts").alias("end_ts"), F.lit(hop).alias("hop"))
        # what an earlier hop has reached is not reached again
        both = new if found is None else new.unionByName(found)
        both = both.groupBy("source", "recipient", "sink").agg(F.min("hop").alias("hop"), F.min("start_ts").alias("start_ts"), F.min("end_ts").alias("end_ts")).where(F.col("hop") == hop)
        front = _cut(both.select("source", "recipient", "start_ts", "sink", "end_ts", "hop"), "reach")
        found = front if found is None else found.unionByName(front)
    return found.select("source", "recipient", "sink", "hop", "end_ts")
