"""What is computed once: walks, shapes of transactions and exports do not compute or shuffle their input again for each part."""

import datetime as dt
from collections import Counter

from chainsift.operators import communities as K
from chainsift.operators import detect as D
from chainsift.operators import graphs as G
from chainsift.operators import joins as J
from chainsift.operators import lookup as L
from chainsift.plans.catalog import queries
from chainsift.sources import uploads as U
from pyspark.sql import functions as F

START = dt.datetime(2024, 3, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ledger(spark, n=60):
    """Transactions from wallet k to the wallets k + 1, k + 2 and k + 3, an hour after one another."""
    rows = [(k, START + dt.timedelta(hours=k), k % 5, side, i, f"w{k + i if side == 'out' else k}", 100 * (i + 1)) for k in range(n) for side, i in [("in", 0), ("out", 1), ("out", 2), ("out", 3)]]
    return spark.createDataFrame(rows, "txid long, ts timestamp_ntz, scenario long, side string, idx int, address string, sat long")


def test_wallets_of_a_transaction_are_counted_without_an_expand(spark):
    for found in (D.peel_transactions(ledger(spark)), D.layering_pairs(ledger(spark), least_wide=2)):
        assert "Expand" not in plan(found)


def test_reach_reads_what_it_wrote(spark):
    e = ledger(spark)
    found = G.reach(J.wallet_projection(e), spark.createDataFrame([], "address string"), 3, 7200.0, 14400.0)
    assert "Exchange" not in plan(found)
    # plain walks: the earliest arrival in the fewest hops
    steps = {(k, k + i): START + dt.timedelta(hours=k) for k in range(60) for i in (1, 2, 3)}
    want = set()
    for (a, r), t0 in steps.items():
        seen, front = {r}, {r: t0}
        for hop in (1, 2, 3):
            new = {}
            for s, t in front.items():
                for i in (1, 2, 3):
                    at = steps.get((s, s + i))
                    if at and t <= at <= min(t + dt.timedelta(hours=2), t0 + dt.timedelta(hours=4)) and s + i != a and s + i not in seen:
                        new[s + i] = min(at, new.get(s + i, at))
            want |= {(f"w{a}", f"w{r}", f"w{s}", hop, t) for s, t in new.items()}
            seen, front = seen | set(new), new
    assert {tuple(r) for r in found.collect()} == want and want


def test_the_query_of_reach_goes_three_hops(spark):
    found = queries()["reach_bfs"](spark, "/root/testdata/sf0.001").select("hop").distinct().collect()
    assert {r["hop"] for r in found} == {1, 2, 3}


def test_layering_shuffles_pairs_once_and_equals_plain_walks(spark):
    e = ledger(spark)
    found = D.layering_candidates(e, J.wallet_projection(e), 2, 0.5, 4 * 3600, 500, 3)
    assert plan(found).count("Exchange hashpartitioning") <= 6
    steps = {k: [k + i for i in (1, 2, 3)] for k in range(60)}
    want = set()
    for a, out in steps.items():
        met = {}
        for r in out:
            t0, seen, front = a, {r}, {r: a}
            for _ in range(3):
                new = {}
                for s, t in front.items():
                    for d in steps.get(s, []):
                        if t <= s <= t0 + 4 and d != a and d not in seen:
                            new[d] = min(s, new.get(d, s))
                seen, front = seen | set(new), new
                for d in new:
                    met.setdefault(d, set()).add(r)
        want |= {(f"w{a}", f"w{d}", 3, len(rs), round(len(rs) / 3, 6)) for d, rs in met.items() if round(len(rs) / 3, 6) >= 0.5}
    assert {tuple(r) for r in found.collect()} == want and want


def test_an_export_computes_its_nodes_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def marked(x):
        seen.add(1)
        return x

    nodes = spark.range(10).select(marked(F.col("id").cast("string")).alias("id"), F.lit("wallet").alias("node_type"))
    edges = spark.range(7).select(F.col("id").cast("string").alias("src"), F.lit("a").alias("dst"))
    U.export_graph(nodes, edges, edges, f"{tmp_path}/out")
    assert seen.value == 10
    assert [tuple(r) for r in spark.read.schema("nodes long, edges long").json(f"{tmp_path}/out/metadata").collect()] == [(10, 7)]


def test_lookups_write_their_exact_steps(spark):
    e = ledger(spark, 10)
    tx = spark.createDataFrame([(k, START, k % 5) for k in range(10)], "txid long, ts timestamp_ntz, scenario long")
    texts = spark.createDataFrame([("w3",), ("s2",), ("xs1x",), ("s",)], "query string")
    none = lambda schema: spark.createDataFrame([], schema)
    found = L.resolve_scenario(texts, tx, e, none("alias string, scenario long"), none("hash string, txid long"), none("prefix string, scenario long"))
    assert "address" not in plan(found)  # entries are not read again for the steps by substrings
    assert {tuple(r) for r in found.collect()} == {("w3", 0), ("s2", 2), ("xs1x", 1), ("s", 0)}


def test_a_scenario_is_looked_for_in_the_whole_text(spark):
    tx = spark.createDataFrame([(k, START, k) for k in (2, 11, 305)], "txid long, ts timestamp_ntz, scenario long")
    long = "x" * 300 + "\n\U0001f600"
    texts = spark.createDataFrame([(long + "s305" + "y" * 9,), (long + "S11",), (long,), ("s2" + long + "s11",), ("s" * 64 + "11",)], "query string")
    none = lambda schema: spark.createDataFrame([], schema)
    prefixes = spark.createDataFrame([("s" * 60 + "k" * 9, 2), ("s" * 64 + "k", 305)], "prefix string, scenario long")
    more = texts.unionByName(spark.createDataFrame([("s" * 60 + "k" * 10,), ("s" * 64 + "kk",)], "query string"))
    found = L.resolve_scenario(more, tx, ledger(spark, 2), none("alias string, scenario long"), none("hash string, txid long"), prefixes)
    assert {tuple(r) for r in found.collect()} == {(long + "s305" + "y" * 9, 305), (long + "S11", 11), ("s2" + long + "s11", 2), ("s" * 64 + "11", 11), ("s" * 60 + "k" * 10, 2), ("s" * 64 + "kk", 305)}


def test_communities_of_small_groups_leave_their_task_finished(spark):
    # more groups than an Arrow batch has rows, each a pair beside a triangle, with parallel edges
    names = [("a", "b", 1.0), ("b", "a", 0.5), ("p", "q", 1.0), ("q", "r", 1.0), ("r", "p", 1.0)]
    rows = [(g, *e) for g in range(4_000) for e in names]
    found = K.greedy_communities(spark.createDataFrame(rows, "group long, a string, b string, weight double"))
    assert "FlatMapGroups" not in plan(found) and plan(found).count("Exchange hashpartitioning") <= 1
    want = {"a": 2, "b": 2, "p": 1, "q": 1, "r": 1}
    got = found.collect()
    assert Counter((r["node"], r["community"]) for r in got) == dict.fromkeys(want.items(), 4_000)
    assert {r["modularity"] for r in got} == {round(1 - (1.5 / 4.5) ** 2 - (3 / 4.5) ** 2, 9)}


def test_modularity_by_transaction_reads_lines_once_for_wallets_and_once_for_relays(spark):
    found = queries()["modularity_by_transaction"](spark, "/root/testdata/sf0.001")
    assert plan(found).count("lineitem.parquet") <= 2


def test_a_scenario_graph_reads_its_lines_once(spark):
    found = queries()["scenario_graph"](spark, "/root/testdata/sf0.001")
    assert "lineitem.parquet" not in plan(found)
    # clusters that come from outside give the same; rows that come again, without transaction or without entries, count as they do in joins
    e = ledger(spark).unionByName(spark.createDataFrame([(None, START, 1, "in", 0, "w1", 5), (None, START, 1, "in", 1, "w9", 5), (99, START, 2, "in", 0, None, 7)], ledger(spark, 1).schema))
    tx = spark.createDataFrame([*((k, START, k % 5) for k in [*range(1, 61), 7]), (None, START, 0)], "txid long, ts timestamp_ntz, scenario long")
    relays = spark.createDataFrame([(k, START + dt.timedelta(seconds=k), f"10.0.0.{k % 3}", "vpn_proxy" if k % 2 else "mobile") for k in [7, 8, 8, 9, 200]], "txid long, relay_ts timestamp_ntz, relay_ip string, node_type string")
    labels = spark.createDataFrame([(k, "layering" if k else "normal") for k in range(5)], "scenario long, pattern_type string")
    graph, other = (G.scenario_graph(e, tx, relays, c, labels, 3).collect() for c in (None, G.entity_clusters(e)))
    assert Counter(graph) == Counter(other)
    got = {(r["scenario"], r["id"]): (r["tx_count"], r["cluster"], r["is_exchange"], r["amount_sat"], r["tag"]) for r in graph}
    assert got[(2, "tx:7")] == (1, "w7", False, 900, "LAYERING") and sum(r["id"] == "tx:7" for r in graph) == 2
    assert got[(1, "w:w1")] == (3, "w1", False, None, "S1") and got[(1, "w:w9")][1] == "w9" and got[(4, "w:w12")] == (4, "w12", True, None, "LICIT_EXCHANGE")
    assert got[(2, "ip:10.0.0.1")] == (2, None, False, None, "vpn_proxy") and got[(3, "ip:10.0.0.2")][0] == 2 and (0, "tx:60") in got and (0, "tx:0") not in got
