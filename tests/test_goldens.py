"""Small hand-made ledgers with known answers."""

import datetime as dt

import pytest
from chainsift.functions import columns as C
from chainsift.operators import aggregates as A
from chainsift.operators import detect as D
from chainsift.operators import features as E
from chainsift.operators import graphs as G
from chainsift.operators import joins as J
from chainsift.operators import quality as Q
from chainsift.sources.ledger import explode_ledger
from pyspark.sql import functions as F

T0 = dt.datetime(2014, 3, 15, 9, 0, 0)
HOUR = dt.timedelta(hours=1)


def entries(spark, txs):
    """txs: (txid, time, inputs, outputs), sides as lists of (address, satoshi)."""
    rows = [(txid, ts, 1, side, k, a, s) for txid, ts, ins, outs in txs for side, own in (("in", ins), ("out", outs)) for k, (a, s) in enumerate(own)]
    return spark.createDataFrame(rows, "txid long, ts timestamp_ntz, scenario long, side string, idx int, address string, sat long")


def test_arrays_become_entries(spark):
    ledger = spark.createDataFrame([(9001, T0, ["A", "B"], [0.3, 0.2], ["C", "D"], [0.4, 0.0999], "s1")], "txid long, timestamp timestamp_ntz, input_addresses array<string>, input_amounts array<double>, output_addresses array<string>, output_amounts array<double>, scenario_id string")
    got = sorted((r["side"], r["idx"], r["address"], r["sat"]) for r in explode_ledger(ledger).collect())
    assert got == [("in", 0, "A", 30_000_000), ("in", 1, "B", 20_000_000), ("out", 0, "C", 40_000_000), ("out", 1, "D", 9_990_000)]


def test_projection_keeps_parallel_edges(spark):
    e = entries(spark, [(9001, T0, [("A", 30), ("B", 20)], [("C", 40), ("D", 9)]), (9002, T0 + HOUR, [("A", 20)], [("C", 19), ("A", 1)])])
    got = sorted((r["src"], r["dst"], r["txid"], r["amount"]) for r in J.wallet_projection(e).collect())
    assert got == [("A", "C", 9001, 40), ("A", "C", 9002, 19), ("A", "D", 9001, 9), ("B", "C", 9001, 40), ("B", "D", 9001, 9)]


@pytest.mark.parametrize("series, want", [([10, 8, 6.4, 5.12, 4.096], 1.0), ([5, 5, 5, 5], 0.0), ([1, 2, 3], 0.0), ([7], 1.0), ([10, 8], 1.0)])
def test_decay(spark, series, want):
    rows = [(1, k, int(v * 1000)) for k, v in enumerate(series)]
    assert D.decay(spark.createDataFrame(rows, "chain long, pos int, carry long")).first()["decay"] == pytest.approx(want, abs=1e-4)


def peel_chain(gap=HOUR):
    out, carry = [], 10_000
    for k in range(5):
        nxt = int(carry * 0.8)
        out.append((101 + k, T0 + gap * k, [(f"W{k}", carry)], [(f"W{k + 1}", nxt), (f"P{k}", carry - nxt)]))
        carry = nxt
    return out


def test_peel_chain(spark):
    got = D.peel_chains(entries(spark, peel_chain())).collect()
    assert [(r["chain"], r["hops"], r["decay"]) for r in got] == [(101, 5, 1.0)]
    assert D.peel_chains(entries(spark, peel_chain(dt.timedelta(hours=24)))).count() == 0


def test_long_peel_chain(spark):
    txs, carry = [], 10**14
    for k in range(150):
        nxt = carry * 9 // 10
        txs.append((1001 + k, T0 + HOUR * k, [(f"W{k}", carry)], [(f"W{k + 1}", nxt), (f"P{k}", carry - nxt)]))
        carry = nxt
    got = D.peel_chains(entries(spark, txs)).collect()
    assert [(r["chain"], r["hops"], r["total_peeled"], r["last_ts"] - r["first_ts"]) for r in got] == [(1001, 150, 10**14 - carry, HOUR * 149)]


def test_chain_length(spark):
    path = lambda s, n, ring=False: [(s, f"{k}", f"W{(k + d) % n if ring else k + d}", side) for k in range(n) for d, side in ((0, "in"), (1, "out"))]
    rows = path(1, 18) + path(2, 10, True) + path(3, 2, True) + path(4, 1) + path(5, 3) + [(5, "9", "W1", "in"), (5, "9", "X", "out")]
    got = E.chain_length(spark.createDataFrame(rows, "scenario long, txid string, address string, side string"))
    assert {r["scenario"]: r["max_chain_length"] for r in got.collect()} == {1: 18, 2: 7, 3: 1, 4: 1, 5: 3}


def test_equal_split_is_no_peel(spark):
    e = entries(spark, [(201, T0, [("A", 100)], [("B", 50), ("C", 50)])])
    assert D.peel_transactions(e).count() == 0 and D.peel_transactions(e, 1.0).count() == 1


def layering(last=5):
    txs = [(k, T0 + HOUR * k, [("S", 100)], [(f"R{k}", 99)]) for k in range(1, 6)]
    return txs + [(10 + k, T0 + HOUR * (10 + k) if k <= last else T0 + dt.timedelta(days=30), [(f"R{k}", 99)], [("Sink", 98)]) for k in range(1, 6)]


def test_layering(spark):
    for last, ratio in ((5, 1.0), (3, 0.6)):
        e = entries(spark, layering(last))
        got = D.layering_candidates(e, J.wallet_projection(e)).collect()
        assert [(r["source"], r["sink"], r["ratio"]) for r in got] == [("S", "Sink", ratio)]
    hub = entries(spark, layering() + [(1000 + k, T0, [(f"X{k}", 5)], [("Sink", 4)]) for k in range(600)])
    assert D.layering_candidates(hub, J.wallet_projection(hub)).count() == 0


def test_maximal_sets(spark):
    rows = [(1, 10), (1, 11), (2, 10), (2, 11), (2, 12), (3, 20), (4, 20), (5, 30)]
    assert sorted(r[0] for r in J.maximal_sets(spark.createDataFrame(rows, "set_id long, member long")).collect()) == [2, 3, 5]


def test_clusters_and_trace(spark):
    e = entries(spark, [(1, T0, [("A", 5), ("B", 5)], [("C", 9)]), (2, T0, [("B", 1), ("D", 1)], [("E", 2)]), (3, T0, [("C", 9)], [("E", 8)])])
    assert {r["address"]: r["cluster"] for r in G.entity_clusters(e).collect()} == {"A": "A", "B": "A", "D": "A", "C": "C", "E": "E"}
    path = G.trace_path(J.wallet_projection(e), "A", "E").collect()
    assert [(r["hop"], r["from_wallet"], r["to_wallet"], r["txid"]) for r in path] == [(1, "A", "C", 1), (2, "C", "E", 3)]
    assert G.trace_path(J.wallet_projection(e), "A", "A").count() == 0


def test_taint(spark):
    e = entries(spark, [(1, T0, [("A", 50), ("X", 50)], [("B", 80), ("C", 20)]), (2, T0, [("B", 80)], [("D", 80)])])
    got = {r["address"]: (r["hop"], r["taint"]) for r in G.taint(e, spark.createDataFrame([("A",)], "address string")).collect()}
    assert got == {"A": (0, 1.0), "B": (1, 0.34), "C": (1, 0.085), "D": (2, 0.289)}


def test_correlate(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    blocks = spark.createDataFrame([("a", at(5), "x"), ("b", at(600), "x"), ("c", at(1), "x"), ("d", at(1), "x"), ("d", at(1), "y"), ("e", None, "x")], "key string, block_ts timestamp_ntz, fact string")
    relays = spark.createDataFrame([("a", at(0), "1"), ("a", at(1), "2"), ("b", at(0), "1"), ("c", at(3), "1"), ("d", at(0), "1"), ("e", at(0), "1"), ("f", at(0), "1")], "key string, relay_ts timestamp_ntz, relay_ip string")
    got = {r["key"]: (r["status"], r["timing"], r["relays"]) for r in J.correlate(blocks, relays, 60).collect()}
    assert got["a"] == ("MATCHED", "WITHIN_WINDOW", 2) and got["b"][1] == "OUTSIDE_WINDOW" and got["c"][1] == "CLOCK_ORDER_ISSUE"
    assert got["d"] == ("CONFLICTING", None, 1) and got["e"] == ("MATCHED", "MISSING_TIME", 1) and got["f"][0] == "NETWORK_ONLY"


def test_upsert(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, note string, n long")
    delta = spark.createDataFrame([(1, "", 5), (3, "c", None)], "id long, note string, n long")
    assert sorted(map(tuple, J.upsert(base, delta, "id").collect())) == [(1, "a", 5), (2, "b", 2), (3, "c", None)]


def test_feature_guard(spark):
    with pytest.raises(ValueError):
        E.guard(spark.createDataFrame([(1, 2.0, 1)], "scenario long, x double, is_illicit int"))


def test_columns(spark):
    row = spark.range(1).select(C.parse_list(F.lit('["a", "b"]')).alias("j"), C.parse_list(F.lit("a; b ;")).alias("s"), C.stable_id(F.lit("x")).alias("i"), C.parse_time(F.lit("nope")).alias("t"), C.from_satoshi(F.array(F.lit(3e7), F.lit(1e8))).alias("m")).first()
    assert row["j"] == ["a", "b"] and row["s"] == ["a", "b"] and 10**8 <= row["i"] < 10**9 and row["t"] is None and row["m"] == [0.3, 1.0]


def test_entropy(spark):
    rows = [("flat", 1.0)] * 8 + [("wide", float(k)) for k in range(8)]
    got = {r["g"]: r["entropy"] for r in A.delay_entropy(spark.createDataFrame(rows, "g string, delay_s double"), ["g"]).collect()}
    assert got == {"flat": 0.0, "wide": 3.0}


def test_validation(spark):
    e = entries(spark, [(1, T0, [("A", 5)], [("A", 4)]), (2, T0, [("A", 5)], [])])
    tx = spark.createDataFrame([(1, T0, 1, 1, "P2SH"), (2, T0, 1, 1, "P2SH")], "txid long, ts timestamp_ntz, scenario long, fee long, script_type string")
    seen = spark.createDataFrame([(1, T0)], "txid long, relay_ts timestamp_ntz")
    got = {r["txid"]: (r["valid"], r["reasons"], r["warnings"]) for r in Q.validate_records(tx, A.per_transaction(e), seen, e).collect()}
    assert got == {1: (True, "", "address_on_both_sides"), 2: (False, "no_relay_time,empty_outputs", "")}


def test_scenario_chain(spark):
    got = D.evidence_peel(entries(spark, peel_chain())).collect()
    assert [(r["scenario"], r["start"], r["hops"]) for r in got] == [(1, 101, 5)]
    assert D.evidence_peel(entries(spark, peel_chain(dt.timedelta(hours=7)))).count() == 0


def test_louvain_parts_two_cliques(spark):
    clique = lambda names: [(a, b, 3) for a in names for b in names if a < b]
    pairs = spark.createDataFrame(clique("abcde") + clique("vwxyz") + [("e", "v", 1)], "a string, b string, weight long")
    assert {r["node"]: r["community"] for r in D.louvain(pairs).collect()} == {n: "a" if n in "abcde" else "v" for n in "abcdevwxyz"}


def test_simple_paths_and_diameter(spark):
    e = spark.createDataFrame([("A", "B"), ("B", "C"), ("A", "C"), ("C", "A"), ("C", "D"), ("D", "B")], "src string, dst string")
    assert sorted((r["hops"], r["path"]) for r in G.simple_paths(e, "A", "D").collect()) == [(2, "A>C>D"), (3, "A>B>C>D")]
    line = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "d"), (2, "x", "y")], "community long, a string, b string")
    assert {r["community"]: r["diameter"] for r in G.diameters(line).collect()} == {1: 3, 2: 1}


def test_snapshot_and_timeline_fail_closed(spark):
    tx = spark.createDataFrame([(1, T0, 1, 1, "P2SH"), (1, T0, 1, 1, "P2SH")], "txid long, ts timestamp_ntz, scenario long, fee long, script_type string")
    seen = spark.createDataFrame([(1, "residential", "X")], "txid long, node_type string, country string")
    labels = spark.createDataFrame([(1, "normal", 0, "train")], "scenario long, pattern_type string, is_illicit int, split string")
    assert A.dataset_snapshot(tx.dropDuplicates(["txid"]), seen, labels).where("dimension = 'total'").first()["n"] == 1
    with pytest.raises(Exception, match="repeated transactions"):
        A.dataset_snapshot(tx, seen, labels).collect()
    far = spark.createDataFrame([(1, T0, 1, 1, "P2SH"), (2, dt.datetime(2100, 1, 1), 1, 1, "P2SH")], tx.schema)
    with pytest.raises(Exception, match="over 20000 buckets"):
        A.timeline(far, spark.createDataFrame([], "txid long, in_sat long"), "day").collect()


def test_entry_says_what_is_missing(tmp_path):
    """Without the text operators the other queries are there; a fault inside of them is no reason to drop them silently."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for name in ("chainsift", "__spark_entry__.py"):
        source = root / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path / name)
    run = lambda code: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**__import__("os").environ, "PYTHONPATH": str(tmp_path)})
    count = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q)"
    out = run(count)
    assert out.returncode == 0 and out.stdout.split()[1] == "False" and int(out.stdout.split()[0]) > 140
    (tmp_path / "chainsift" / "llm").mkdir()
    (tmp_path / "chainsift" / "llm" / "__init__.py").write_text("")
    (tmp_path / "corpus_pipeline.py").write_text("")
    (tmp_path / "chainsift" / "llm" / "catalog.py").write_text("from chainsift.llm import nothing_of_that_name")
    assert run(count).returncode != 0
    (tmp_path / "chainsift" / "llm" / "catalog.py").write_text("import a_library_that_is_not_there")
    assert run(count).returncode == 0
