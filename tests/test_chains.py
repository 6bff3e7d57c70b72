"""Chains walked in one task and by doubling pointers; members of chains; candidates judged as a whole."""

import datetime as dt
import random

from chainsift.operators import detect as D

START = dt.datetime(2022, 5, 1)


def forest(rng, n):
    """(txid, next): some lead to a later one, several to the same."""
    return [(k, rng.choice([None, *range(k + 1, min(n, k + 6))]) if k + 1 < n else None) for k in range(n)]


def steps_of(spark, hops, rng):
    rows = [(t, n, rng.random() * 5, float(rng.randint(0, 1)), rng.randint(1, 99), START + dt.timedelta(hours=t)) for t, n in hops]
    return rows, spark.createDataFrame(rows, "txid long, next long, y double, falls double, total long, ts timestamp").repartition(3)


def plain_sums(rows):
    own = {r[0]: r for r in rows}
    out = {}
    for t in own:
        way = [t]
        while own[way[-1]][1] is not None:
            way.append(own[way[-1]][1])
        y = [own[w][2] for w in way]
        out[t] = (way[-1], len(way), sum(range(len(way))), sum(k * k for k in range(len(way))), sum(y), sum(v * v for v in y), sum(k * v for k, v in enumerate(y)), sum(own[w][3] for w in way), sum(own[w][4] for w in way), own[way[-1]][5])
    return out


def test_sums_along_chains(spark):
    rng = random.Random(21)
    rows, steps = steps_of(spark, forest(rng, 150), rng)
    want = plain_sums(rows)
    for in_task in (10_000, 0):
        got = {r["txid"]: r for r in D.chains(steps, in_task).collect()}
        assert got.keys() == want.keys()
        for t, w in want.items():
            g = tuple(got[t][c] for c in ("last", "n", "x", "xx", "y", "yy", "xy", "falls", "total", "until"))
            assert (g[0], g[1], g[8], g[9]) == (w[0], w[1], w[8], w[9]) and all(abs(a - b) < 1e-6 for a, b in zip(g[2:8], w[2:8]))
    assert D.chains(steps.limit(0)).count() == 0


def test_what_good_starts_pass(spark):
    rng = random.Random(22)
    hops = forest(rng, 120)
    ahead = dict(hops)
    good = rng.sample(range(120), 15)
    want = set()
    for t in good:
        while (t := ahead[t]) is not None:
            want.add(t)
    g = spark.createDataFrame([(t,) for t in good], "txid long")
    h = spark.createDataFrame([x for x in hops if x[1] is not None], "txid long, next long")
    for in_task in (10_000, 0):
        assert {r["txid"] for r in D._descends(g, h, in_task).collect()} == want
    members = {}
    for r in D.chain_members(g, h).collect():
        members.setdefault(r["chain"], {})[r["pos"]] = r["txid"]
    for t in good:
        way = [t]
        while ahead[way[-1]] is not None:
            way.append(ahead[way[-1]])
        assert [members[t][k] for k in range(len(way))] == way and len(members[t]) == len(way)


def test_validation_of_candidates(spark):
    truth = spark.createDataFrame([(k, k // 10, "layering" if k < 30 else "mixing" if k < 40 else "normal") for k in range(60)], "txid long, scenario long, pattern_type string")
    found = [("layering", "a", t) for t in range(5)] + [("layering", "b", t) for t in (11, 12, 13, 14, 45)] + [("layering", "c", t) for t in (21, 46, 47)] + [("mixing", "d", 50), ("mixing", "d", 999), ("peeling_chain", "e", 3)]
    rows = {r["kind"]: r.asDict() for r in D.validate_candidates(spark.createDataFrame(found, "kind string, candidate string, txid long"), truth).collect()}
    got = rows["layering"]
    # a is wholly right, b has four of five; c has one of three: its scenario is not found
    assert (got["candidates"], got["true_positives"], got["false_positives"], got["found"], got["scenarios"]) == (3, 2, 1, 2, 3)
    assert (got["precision"], got["recall"], got["f1"]) == (0.666667, 0.666667, 0.666667)
    assert (rows["mixing"]["precision"], rows["mixing"]["recall"], rows["mixing"]["scenarios"]) == (0.0, 0.0, 1)
    assert (rows["peeling_chain"]["recall"], rows["peeling_chain"]["scenarios"]) == (0.0, 0)


def test_rounds_leave_no_tables(spark, tmp_path, monkeypatch):
    from chainsift.operators import graphs as G

    monkeypatch.setattr(G, "shared_folder", lambda _: f"file://{tmp_path}")
    pairs = spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long")
    assert {r["label"] for r in G.connected(pairs).collect()} == {0}
    assert len(list((tmp_path / "chainsift").glob("stars-*"))) == 1
    weighted = spark.createDataFrame([(f"{a}", f"{b}", 1) for a, b in [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)]], "a string, b string, weight long")
    assert len({r["community"] for r in D.louvain(weighted).collect()}) == 2
    assert sorted(p.name.rsplit("-", 1)[0] for p in (tmp_path / "chainsift").iterdir()) == ["louvain", "stars"]


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    import pytest
    from chainsift.operators import graphs as G

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://somewhere:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        G.shared_folder(session)
