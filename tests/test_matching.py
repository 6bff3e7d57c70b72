"""Kept state of two feeds against the batch: late and conflicting rows, a restart in the middle, what is held, and what is let go."""

import datetime as dt
import random

import pytest
from chainsift.operators import joins as J
from chainsift.streaming import matching as S
from pyspark.sql import functions as F

START = dt.datetime(2024, 3, 1, 8)
BLOCK, RELAY = "key string, block_ts timestamp, fact double", "key string, relay_ts timestamp, relay_ip string"


def rows_of(df):
    return sorted((tuple(r[c] for c in ("key", "status", "block_ts", "relay_ts", "relay_ip", "relays", "delta_s", "timing")) for r in df.collect()), key=repr)


@pytest.fixture
def parts():
    """Three parts of both feeds: relays before and after their blocks, repeats, conflicts, missing times, and rows hours late."""
    rng = random.Random(13)
    at = lambda: START + dt.timedelta(seconds=rng.randint(0, 7200))
    out = []
    for part in range(3):
        blocks = [(f"k{rng.randint(0, 40)}", at(), float(rng.randint(0, 1))) for _ in range(25)]
        relays = [(f"k{rng.randint(0, 40)}", at(), f"10.0.0.{rng.randint(0, 3)}") for _ in range(60)]
        if part == 2:
            blocks += [blocks[0], ("k3", START - dt.timedelta(hours=9), 1.0), ("none", None, 2.0)]
            relays += [("k5", START - dt.timedelta(hours=9), "10.9.9.9"), ("k5", None, "10.0.0.1"), ("none", None, None)]
        out.append((blocks, relays))
    return out


def test_equals_the_batch_over_a_restart(spark, parts, tmp_path):
    path, source = f"file://{tmp_path}/run", f"{tmp_path}/in"
    schema = spark.createDataFrame([], "key string, is_block boolean, ts timestamp, fact double, relay_ip string").schema
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)

    def add(k):
        blocks, relays = parts[k]
        S.feed(spark.createDataFrame(blocks, BLOCK), spark.createDataFrame(relays, RELAY)).coalesce(1).write.mode("append").parquet(source)

    def batch(upto):
        blocks = spark.createDataFrame([b for p in parts[:upto] for b in p[0]], BLOCK)
        return J.correlate(blocks, spark.createDataFrame([r for p in parts[:upto] for r in p[1]], RELAY).withColumn("relay_ts", F.col("relay_ts").cast("timestamp_ntz")), 600.0)

    same = lambda got, want: rows_of(got) == rows_of(want.withColumn("relay_ts", F.col("relay_ts").cast("timestamp")))
    keep = 30 * 86_400.0
    add(0)
    assert same(S.run_matching(spark, stream(), path, 600.0, keep, "1 day"), batch(1))
    add(1)
    add(2)  # the second run goes on from the state of the first one
    assert same(S.run_matching(spark, stream(), path, 600.0, keep, "1 day"), batch(3))
    held = spark.read.format("statestore").option("path", f"{path}/state").option("stateVarName", "relays").load()
    assert held.count() == sum(len(p[1]) for p in parts)  # all relays are kept, repeats too
    blocks = spark.read.format("statestore").option("path", f"{path}/state").option("stateVarName", "blocks").load()
    assert blocks.count() == len({b for p in parts for b in p[0]})  # equal repeats are one


def test_a_timer_lets_keys_go(spark, tmp_path):
    path, source = f"file://{tmp_path}/run", f"{tmp_path}/in"
    schema = spark.createDataFrame([], "key string, is_block boolean, ts timestamp, fact double, relay_ip string").schema
    for k, (key, hours) in enumerate([("a", 0), ("b", 5), ("b", 6), ("a", 10), ("c", 11), ("c", 12)]):
        when = START + dt.timedelta(hours=hours)
        S.feed(spark.createDataFrame([(key, when, 1.0)], BLOCK), spark.createDataFrame([(key, when, "10.0.0.1")], RELAY)).coalesce(1).write.parquet(f"{source}/{k}")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
    S.run_matching(spark, rows, path, 600.0, 3600.0, "10 minutes")
    seen = spark.read.schema(f"{S.READING}, batch long").parquet(f"{path}/readings").orderBy("batch").collect()
    # a's first rows are final before its second ones come, which then count alone
    assert [(r["relays"], r["final"]) for r in seen if r["key"] == "a"][:3] == [(1, False), (1, True), (1, False)]
    assert any(r["key"] == "b" and r["final"] for r in seen)


class Kept:
    """A bucket's lists and timers in memory, with a count of the calls."""

    def __init__(self):
        self.lists, self.timers, self.calls = {}, set(), 0

    def getListState(self, name, schema):  # noqa: N802
        outer = self

        class State:
            def get(self):
                outer.calls += 1
                return iter(list(outer.lists.get(name, [])))

            def put(self, rows):
                outer.calls += 1
                outer.lists[name] = list(rows)

            def appendList(self, rows):  # noqa: N802
                outer.calls += 1
                outer.lists.setdefault(name, []).extend(rows)

            def clear(self):
                outer.calls += 1
                outer.lists.pop(name, None)

        return State()

    def registerTimer(self, ms):  # noqa: N802
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):  # noqa: N802
        self.calls += 1
        self.timers.discard(ms)

    def listTimers(self):  # noqa: N802
        self.calls += 1
        return iter(set(self.timers))


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def test_calls_to_the_state_do_not_grow_with_keys():
    import pandas as pd

    held, matcher = Kept(), S.Matcher(600.0, 10.0)
    matcher.init(held)
    rows = [(f"k{k}", block, k * 1_000_000, 1.0 if block else None, None if block else "10.0.0.1") for k in range(2000) for block in (True, False, True)]
    batch = pd.DataFrame(rows, columns=["key", "is_block", "us", "fact", "relay_ip"])
    found = pd.concat(matcher.handleInputRows((0,), iter([batch[:3000], batch[3000:]]), Now(0)))
    assert len(found) == 2000 and set(found["status"]) == {"MATCHED"} and set(found["relays"]) == {1}
    assert held.calls < 20 and held.timers == {10_000}
    # the keys whose time has come go with a final reading, the others stay and a timer waits for the first of them
    gone = pd.concat(matcher.handleExpiredTimer((0,), Now(10_000 + 5_000), None))
    assert set(gone["key"]) == {f"k{k}" for k in range(6)} and gone["final"].all()
    assert held.timers == {10_000 + 6_000} and len(held.lists["blocks"]) == len(held.lists["relays"]) == 1994
    # one that comes again starts anew; a conflict with rows that are still kept is seen
    again = pd.DataFrame([("k0", True, 20_000_000, 1.0, None), ("k9", True, 9_000_000, 2.0, None)], columns=batch.columns)
    found = pd.concat(matcher.handleInputRows((0,), iter([again]), Now(15_000))).set_index("key")
    assert (found.loc["k0", "status"], found.loc["k9", "status"]) == ("LEDGER_ONLY", "CONFLICTING")


def test_delays_are_rounded_as_sql_has_them():
    assert S.reading("k", {(0, 1.0)}, [(144_588_601_500, "10.0.0.1")], 1.0)["delta_s"] == -144588.602
    assert S.reading("k", {(57_642_399_500, 1.0)}, [(0, "10.0.0.1")], 1.0)["delta_s"] == 57642.4


def test_conflicts_are_kept_by_buckets_of_keys(spark, tmp_path):
    """Four files in turn: repeats, facts that differ in a later file, a fact with a bar in it, and keys that the watermark has let go."""
    from chainsift.streaming.reconcile import conflicts

    start = dt.datetime(2024, 5, 1)
    rows = [[(f"k{k}", f"a{k}|b", start + dt.timedelta(seconds=k)) for k in range(200) for _ in range(2)], [("k3", "c", start), ("k7", "a7|b", start)], [("late", "x", start + dt.timedelta(hours=9))], [("late", "x", start + dt.timedelta(hours=9)), ("k3", "c", start + dt.timedelta(hours=9))]]
    for k, own in enumerate(rows):
        spark.createDataFrame(own, "key string, fact string, block_ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("key string, fact string, block_ts timestamp").parquet(f"{tmp_path}/in")
        run = conflicts(stream, buckets=8).writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}"))
        run = run.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress) <= 8
    found = spark.read.parquet(f"{tmp_path}/out").orderBy("batch").collect()
    newest = {r["key"]: (r["rows"], r["variants"], r["status"]) for r in found}
    assert newest.pop("late") == (2, 1, "SINGLE") and newest.pop("k3") == (1, 1, "SINGLE") and newest.pop("k7") == (3, 1, "SINGLE")
    assert (3, 2, "CONFLICTING") in [(r["rows"], r["variants"], r["status"]) for r in found if r["key"] == "k3"]
    assert len(newest) == 198 and set(newest.values()) == {(2, 1, "SINGLE")}
