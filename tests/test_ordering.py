"""Joins by stretches of time, ranks by ranges, sets by their rarest member, taint of later hops."""

import datetime as dt
import random

import pytest
from chainsift.functions import columns as C
from chainsift.operators import graphs as G
from chainsift.operators import joins as J
from chainsift.operators.ordering import bucket, join_within, ranked
from pyspark.sql import functions as F

START = dt.datetime(2020, 1, 1, 12)


def test_join_within_equals_all_pairs(spark):
    rng = random.Random(2)
    left = [(k, rng.choice("ab"), START + dt.timedelta(minutes=rng.randint(-600, 600)), rng.randint(0, 90)) for k in range(120)] + [(900, "a", None, 5), (901, None, START, 5)]
    right = [(k, rng.choice("abc"), START + dt.timedelta(minutes=rng.randint(-600, 600))) for k in range(150)] + [(900, "a", None), (901, None, START)]
    a = spark.createDataFrame(left, "l long, key string, t timestamp, minutes int")
    b = spark.createDataFrame(right, "r long, own string, at timestamp")
    until = F.col("t") + F.expr("make_dt_interval(0, 0, minutes)")
    for width in (60 * 90, 60 * 7, 60 * 5000):
        got = sorted((x["l"], x["r"]) for x in join_within(a, b, ("key", "own"), F.col("t"), until, "at", width).collect())
        want = sorted((k, r) for k, x, t, m in left for r, y, at in right if x == y and x and t and at and t <= at <= t + dt.timedelta(minutes=m))
        assert got == want and want


def test_a_hot_address_is_spread_over_time(spark):
    """Half of all rows have one address: no part of the dealt rows holds more than a few of its days."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("address"), F.timestamp_seconds(F.col("id") * 3600 % 31_536_000).alias("ts"))
    day = 86_400
    met = rows.groupBy("address", bucket(F.col("ts"), 3 * day)).agg(F.count("*").alias("n"))
    assert met.agg(F.max("n")).first()[0] <= 200  # a key alone would hold 10,000
    parts = rows.repartition(8, "address", bucket(F.col("ts"), 3 * day)).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).select("n").collect()
    sizes = sorted(r["n"] for r in parts)
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]


@pytest.mark.parametrize("parts", [1, 5])
def test_ranks_and_running_sums(spark, parts):
    rng = random.Random(3)
    rows = [(k, rng.randint(0, 30), rng.choice([None, 1, 2, 5])) for k in range(400)]
    df = spark.createDataFrame(rows, "k long, v int, w long").repartition(7)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = sorted((r["rank"], r["k"], r["sum"]) for r in ranked(df, [F.desc("v"), F.asc("k")], {"sum": "w"}).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    total, want = 0, []
    for place, (k, _, w) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        total += w or 0
        want.append((place, k, total))
    assert got == want
    assert ranked(df.limit(0), [F.asc("k")]).count() == 0


def test_sets_by_their_rarest_member(spark):
    rng = random.Random(4)
    sets = {k: set(rng.sample(range(30), rng.randint(1, 6))) | {99} for k in range(80)}
    sets |= {100: {99}, 101: {1, 2, 99}, 102: {1, 2, 99}, 103: {1, 2, 3, 4, 5, 6, 7, 99}}
    want = sorted(a for a in sets if not any(sets[a] < sets[b] or (sets[a] == sets[b] and b < a) for b in sets if b != a))
    df = spark.createDataFrame([(k, m) for k, own in sets.items() for m in own], "set_id long, member long")
    assert sorted(r[0] for r in J.maximal_sets(df.union(df)).collect()) == want


def test_one_member_of_all_sets_is_linear(spark):
    """3,000 sets that share one member and have one of their own: each looks for itself alone."""
    df = spark.range(3000).select(F.col("id").alias("set_id"), F.explode(F.array(F.col("id") + 10, F.lit(0).cast("long"))).alias("member"))
    assert J.maximal_sets(df).count() == 3000
    same = spark.range(3000).select(F.col("id").alias("set_id"), F.lit(7).cast("long").alias("member"))  # equal sets: one stands for all
    assert [r[0] for r in J.maximal_sets(same).collect()] == [0]


def test_a_later_hop_raises_taint(spark):
    """S pays B a tenth directly, and nine tenths by way of A, who pays all of it on: B has the higher taint of two hops, and C what that passes on."""
    rows = [(1, "in", "S", 100), (1, "out", "B", 10), (1, "out", "A", 90), (2, "in", "A", 90), (2, "out", "B", 90), (3, "in", "B", 50), (3, "out", "C", 50)]
    entries = spark.createDataFrame(rows, "txid long, side string, address string, sat long")
    seeds = spark.createDataFrame([("S",)], "address string")
    got = {r["address"]: (r["hop"], r["taint"]) for r in G.taint(entries, seeds).collect()}
    assert got == {"S": (0, 1.0), "A": (1, 0.765), "B": (2, 0.6503), "C": (3, 0.5528)}
    assert {r["address"]: r["taint"] for r in G.taint(entries, seeds, max_depth=1).collect()} == {"S": 1.0, "A": 0.765, "B": 0.085}


def test_words_come_from_names(spark):
    assert C.readable("change_output_ratio") == "ratio of change output" and C.readable("in_sat") == "in satoshi" and C.readable("unique_asn_count") == "count of unique asn"
    df = spark.createDataFrame([("in_sat", 1.0), ("wallets", -2.0), ("other", 0.0)], "f string, e double")
    assert [r[0] for r in df.select(C.explanation(F.col("f"), F.col("e"), ["in_sat", "wallets"])).collect()] == ["in satoshi above usual", "wallets below usual", "other as usual"]


def test_taint_is_rounded_like_sql(spark):
    """0.181 * 0.85 prints as 0.15385 and 0.123 * 0.85 as 0.10454999999999999: times 10,000 they are below and at the half."""
    got = {}
    for k in (181, 123):
        entries = spark.createDataFrame([(1, None, 1, "in", 0, "S", 1000), (1, None, 1, "out", 0, "A", k), (1, None, 1, "out", 1, "B", 1000 - k)], "txid long, ts timestamp, scenario long, side string, idx int, address string, sat long")
        got[k] = {r["address"]: r["taint"] for r in G.taint(entries, spark.createDataFrame([("S",)], "address string"), max_depth=1).collect()}["A"]
    assert got == {181: 0.1538, 123: 0.1046}


def test_sets_that_share_all_members_but_hold_few(spark):
    """Many equal sets over a few members, as relays of few networks: pairs grow with the different sets, and those without all marks never leave the join."""
    rng = random.Random(5)
    sets = {k: frozenset(rng.sample(range(12), rng.randint(1, 4))) for k in range(3000)} | {5000: frozenset(range(300, 700)), 5001: frozenset(range(300, 699))}
    df = spark.createDataFrame([(k, m) for k, s in sets.items() for m in s], "set_id long, member long").repartition(4)
    kinds = {}
    for k, s in sorted(sets.items()):
        kinds.setdefault(s, k)
    want = sorted(k for s, k in kinds.items() if not any(s < o for o in kinds))
    found = J.maximal_sets(df)
    assert sorted(r[0] for r in found.collect()) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert any("Join Inner" in line and "& w0" in line for line in plan.splitlines())
