"""Typology detectors: peeling chains, layering, mixing, ransomware; and evidence for alerts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainsift.functions.columns import micros, suspicious

from .graphs import _cut, _drop, community_metrics
from .ordering import join_within


def _wallets(side: str) -> F.Column:
    """Different wallets on a side of a transaction (an aggregate). Sets stay where the transaction's entries lie; several distinct counts would shuffle
    each entry once for each of them."""
    return F.size(F.collect_set(F.when(F.col("side") == side, F.col("address")))).cast("long")


def peel_transactions(entries: DataFrame, least_ratio: float = 2.0) -> DataFrame:
    """(txid, ts, scenario, carry, peel, carry_to, in_sat, two_rows): one or two distinct inputs, two distinct outputs, and the
    larger output at least ``least_ratio`` times the smaller one (a smaller one of nothing passes). ``two_rows``: exactly two output rows."""
    per = entries.groupBy("txid", "ts", "scenario").agg(
        _wallets("in").alias("ins"),
        _wallets("out").alias("outs"),
        F.count_if(F.col("side") == "out").alias("out_rows"),
        F.sum(F.when(F.col("side") == "in", F.col("sat"))).alias("in_sat"),
        F.max(F.when(F.col("side") == "out", F.struct("sat", "address"))).alias("top"),
        F.min(F.when(F.col("side") == "out", F.struct("sat", "address"))).alias("low"),
    )
    peel = F.col("low.sat")
    ok = F.col("ins").between(1, 2) & (F.col("outs") == 2) & ((peel <= 0) | (F.col("top.sat") / F.nullif(peel, F.lit(0)) >= least_ratio))
    return per.where(ok).select("txid", "ts", "scenario", F.col("top.sat").alias("carry"), peel.alias("peel"), F.col("top.address").alias("carry_to"), "in_sat", (F.col("out_rows") == 2).alias("two_rows"))


def peel_hops(entries: DataFrame, peels: DataFrame, gap_s: float = 21600, tolerance: float = 0.05, by_scenario: bool = False) -> DataFrame:
    """(txid, next): the earliest (then lowest) peel transaction that spends a peel's carry within the gap, for no more than the carry and the tolerance.

    Equal times go to a larger txid only, so hops form a forest."""
    spent = entries.where("side = 'in'").groupBy("txid", "address").agg(F.sum("sat").alias("spent"))
    rows = peels.where("two_rows")
    later = rows.select(F.col("txid").alias("next"), F.col("ts").alias("next_ts"), F.col("scenario").alias("next_scenario")).join(spent.withColumnRenamed("txid", "next"), "next")
    until = F.col("ts") + F.expr(f"make_dt_interval(0, 0, 0, {gap_s})")
    both = join_within(rows, later, ("carry_to", "address"), F.col("ts"), until, "next_ts", gap_s)
    gap = (micros(F.col("next_ts")) - micros(F.col("ts"))) / 1e6
    ok = ((gap > 0) | ((gap == 0) & (F.col("next") > F.col("txid")))) & (gap <= gap_s) & (F.col("spent") <= F.col("carry") * (1 + tolerance))
    if by_scenario:
        ok = ok & (F.col("scenario") == F.col("next_scenario"))
    return both.where(ok).groupBy("txid").agg(F.min(F.struct("next_ts", "next")).alias("x")).select("txid", F.col("x.next").alias("next"))


#: Rows of chains that one task may hold; more go through rounds of jobs, to the same result.
IN_TASK = 200_000
_SUMS = ("n", "x", "xx", "y", "yy", "xy", "falls", "total")


def _along(next_of: dict[int, int]) -> Iterator[int]:
    """Transactions of a forest of hops, each after the one it leads to."""
    done: set[int] = set()
    for start in next_of:
        way = []
        at = start
        while at is not None and at not in done:
            way.append(at)
            done.add(at)
            at = next_of.get(at)
        yield from reversed(way)


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``chains`` in one task: what a chain adds up to is its first transaction and the rest, moved on by one position."""
    tables = list(batches)
    if not tables:
        return
    rows = pd.concat(tables)
    own = {r.txid: r for r in rows.itertuples()}
    next_of = {t: None if pd.isna(r.next) or int(r.next) not in own else int(r.next) for t, r in own.items()}
    held: dict[int, tuple] = {}
    for t in _along(next_of):
        r, ahead = own[t], held.get(next_of[t])
        n, x, xx, y, yy, xy, falls, total, last, until = ahead or (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0, t, r.ts)
        held[t] = (n + 1, x + n, xx + 2 * x + n, r.y + y, r.y * r.y + yy, xy + y, r.falls + falls, r.total + total, last, until)
    out = pd.DataFrame.from_dict(held, orient="index", columns=[*_SUMS, "last", "until"])
    yield out.rename_axis("txid").reset_index()


def chains(steps: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """(txid, last, n, x, xx, y, yy, xy, falls, total, until): what the chain from each transaction on adds up to, whatever its length.

    ``steps``: (txid, next, y, falls, total, ts), one row a transaction, next NULL at an end; hops form a forest. n members, sums over their
    positions x (0 first) and values y, ``falls`` and ``total`` summed, ``until`` the last time. Up to ``in_task`` rows are walked in one task. With more,
    pointers double: after round k a row covers 2 ** k members, so that there are as many rounds as the longest chain's logarithm; a round reads and
    writes the rows whose chain goes on, and looks up the others."""
    zero = F.lit(0.0)
    at = steps.select("txid", "next", F.col("txid").alias("last"), F.lit(1.0).alias("n"), zero.alias("x"), zero.alias("xx"), "y", (F.col("y") * F.col("y")).alias("yy"), zero.alias("xy"), "falls", "total", F.col("ts").alias("until"))
    at = _cut(at, "chain")
    kinds = dict(at.dtypes)
    if at.count() <= in_task:
        schema = ", ".join(f"{c} {kinds[c]}" for c in ("txid", *_SUMS, "last", "until"))
        return at.select("txid", "next", "y", "falls", "total", F.col("until").alias("ts")).coalesce(1).mapInPandas(_summed, schema)
    ended = at.where("next is null")
    while (going := at.where("next is not null")).limit(1).count():
        far = ended.unionByName(going).select(*[F.col(c).alias(f"f_{c}") for c in at.columns])
        n = F.col("n")
        g = lambda c: F.coalesce(F.col(f"f_{c}"), zero)
        both = going.join(far, F.col("next") == F.col("f_txid"), "left")
        at = _cut(
            both.select(
                "txid",
                F.col("f_next").alias("next"),
                F.coalesce("f_last", "last").alias("last"),
                (n + g("n")).alias("n"),
                (F.col("x") + g("x") + n * g("n")).alias("x"),
                (F.col("xx") + g("xx") + 2 * n * g("x") + n * n * g("n")).alias("xx"),
                (F.col("y") + g("y")).alias("y"),
                (F.col("yy") + g("yy")).alias("yy"),
                (F.col("xy") + g("xy") + n * g("y")).alias("xy"),
                (F.col("falls") + g("falls")).alias("falls"),
                (F.col("total") + F.coalesce("f_total", F.lit(0))).alias("total"),
                F.coalesce("f_until", "until").alias("until"),
            ),
            "chain",
        )
        ended = ended.unionByName(at.where("next is null"))
    return ended


def _decay() -> F.Column:
    """Half the share of falling steps, and half R2 of the log value against the position (0 where it does not fall); 1 for a single hop."""
    n = F.col("n")
    sxx, syy, sxy = F.col("xx") - F.col("x") * F.col("x") / n, F.col("yy") - F.col("y") * F.col("y") / n, F.col("xy") - F.col("x") * F.col("y") / n
    r2 = F.when((sxy >= -1e-9) | (syy <= 0), 0.0).otherwise(F.least(F.lit(1.0), sxy * sxy / (sxx * syy)))
    return F.round(F.when(n <= 1, 1.0).otherwise(0.5 * F.col("falls") / (n - 1) + 0.5 * r2), 6)


def decay(members: DataFrame, group: str = "chain") -> DataFrame:
    """(group, hops, decay): ``_decay`` of listed members (group, pos, carry)."""
    w = Window.partitionBy(group).orderBy("pos")
    rows = members.withColumn("fall", (F.lead("carry").over(w) < F.col("carry")).cast("double")).withColumn("v", F.log(F.greatest(F.col("carry"), F.lit(1)).cast("double"))).withColumn("p", F.col("pos").cast("double"))
    sums = rows.groupBy(group).agg(F.count("*").cast("double").alias("n"), F.sum("p").alias("x"), F.sum(F.col("p") * F.col("p")).alias("xx"), F.sum("v").alias("y"), F.sum(F.col("v") * F.col("v")).alias("yy"), F.sum(F.col("p") * F.col("v")).alias("xy"), F.coalesce(F.sum("fall"), F.lit(0.0)).alias("falls"))
    return sums.select(group, F.col("n").cast("long").alias("hops"), _decay().alias("decay"))


def chain_members(heads: DataFrame, hops: DataFrame) -> DataFrame:
    """(chain, pos, txid): the transactions of the chains that start at ``heads`` (txid) along ``hops`` (txid, next); pos 0 is the head.

    Positions double: after round k all below 2 ** k are known, so that there are as many rounds as the longest chain's logarithm."""
    out, jump, step = _cut(heads.select(F.col("txid").alias("chain"), F.lit(0).cast("long").alias("pos"), "txid"), "members"), _cut(hops.select("txid", "next"), "jump"), 1
    while jump.limit(1).count():
        out = _cut(out.unionByName(out.join(jump, "txid").select("chain", (F.col("pos") + step).alias("pos"), F.col("next").alias("txid"))), "members")
        jump = _cut(jump.join(jump.toDF("next", "far"), "next").select("txid", F.col("far").alias("next")), "jump")
        step *= 2
    return out


def _passed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``_descends`` in one task, over (txid, next, good)."""
    tables = list(batches)
    if not tables:
        return
    rows = pd.concat(tables)
    next_of, good = dict(zip(rows["txid"].tolist(), rows["next"].tolist())), set(rows.loc[rows["good"], "txid"].tolist())
    passed: set[int] = set()
    for t in reversed(list(_along(next_of))):  # each before the one it leads to
        if t in next_of and (t in good or t in passed):
            passed.add(next_of[t])
    yield pd.DataFrame({"txid": pd.Series(sorted(passed), dtype="int64")})


def _descends(good: DataFrame, hops: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """(txid): transactions that the chain of a good start passes later on: in one task up to ``in_task`` hops, else by doubling pointers backwards."""
    if hops.count() <= in_task:
        marked = hops.join(good.select("txid", F.lit(True).alias("good")), "txid", "left").select("txid", "next", F.coalesce("good", F.lit(False)).alias("good"))
        return marked.coalesce(1).mapInPandas(_passed, f"txid {dict(hops.dtypes)['txid']}")
    marked = _cut(good.select("txid"), "marked")
    jump, out = _cut(hops.select("txid", "next"), "jump"), None
    while jump.limit(1).count():
        # whoever is 2 ** k hops behind a marked one (or behind one found before)
        new = marked.join(jump, "txid").select(F.col("next").alias("txid"))
        marked = _cut(marked.unionByName(new).distinct(), "marked")
        out = new if out is None else out.unionByName(new)
        jump = _cut(jump.join(jump.toDF("next", "far"), "next").select("txid", F.col("far").alias("next")), "jump")
    return out.distinct() if out is not None else marked.limit(0)


def peel_chains(entries: DataFrame, gap_s: float = 21600, ratio: float = 2.0, tolerance: float = 0.05, least_hops: int = 3, least_decay: float = 0.6) -> DataFrame:
    """(chain, hops, decay, total_peeled, first_ts, last_ts): suffixes of maximal chains that are long and decay enough; a
    suffix of a chain that passes itself is dropped. ``chain``: the first transaction."""
    return _peel_chains(entries, gap_s, ratio, tolerance, least_hops, least_decay)[0]


def peel_members(entries: DataFrame, gap_s: float = 21600, ratio: float = 2.0, tolerance: float = 0.05, least_hops: int = 3, least_decay: float = 0.6) -> DataFrame:
    """(chain, pos, txid): the transactions of the chains that ``peel_chains`` finds."""
    found, hops = _peel_chains(entries, gap_s, ratio, tolerance, least_hops, least_decay)
    return chain_members(found.select(F.col("chain").alias("txid")), hops)


def _peel_chains(entries: DataFrame, gap_s: float, ratio: float, tolerance: float, least_hops: int, least_decay: float) -> tuple[DataFrame, DataFrame]:
    peels = _cut(peel_transactions(entries, ratio), "peels")
    hops = _cut(peel_hops(entries, peels, gap_s, tolerance), "hops")
    own = peels.where("two_rows").select("txid", "ts", "carry", "peel")
    if least_hops > 1:  # whoever neither leads nor follows is a chain of one
        own = own.join(hops.select("txid").union(hops.select("next")).distinct(), "txid", "left_semi")
    ahead = hops.join(own.select(F.col("txid").alias("next"), F.col("carry").alias("after")), "next")
    steps = own.join(ahead, "txid", "left").select("txid", "next", F.log(F.greatest(F.col("carry"), F.lit(1)).cast("double")).alias("y"), F.coalesce((F.col("after") < F.col("carry")).cast("double"), F.lit(0.0)).alias("falls"), F.col("peel").alias("total"), "ts")
    found = chains(steps).withColumn("decay", _decay()).where((F.col("n") >= least_hops) & (F.col("decay") >= least_decay))
    good = _cut(found.join(own.select("txid", "ts"), "txid").select("txid", F.col("n").cast("long").alias("hops"), "decay", F.col("total").alias("total_peeled"), F.col("ts").alias("first_ts"), F.col("until").alias("last_ts")), "good")
    return good.join(_descends(good, hops), "txid", "left_anti").withColumnRenamed("txid", "chain"), hops


def evidence_peel(entries: DataFrame, gap_s: float = 21600, ratio: float = 2.0, rise: float = 1.05, least_hops: int = 5, least_shapes: int = 3) -> DataFrame:
    """(scenario, start, hops): the longest chain of each scenario, if it has ``least_hops`` transactions and its carries fall at every step.

    Members have one or two inputs and one or two outputs (rows), the larger ``ratio`` times the smaller; the next one is the earliest (then
    lowest) that spends the carry strictly later, within the gap, and carries at most ``rise`` times as much. Of equally long chains the
    earliest start counts. Scenarios of fewer than ``least_shapes`` such transactions have no chain."""
    per = entries.groupBy("scenario", "txid", "ts").agg(
        F.count_if(F.col("side") == "in").alias("i"), F.count_if(F.col("side") == "out").alias("o"), F.min(F.when(F.col("side") == "out", F.col("sat"))).alias("low"),
        F.max(F.when(F.col("side") == "out", F.struct("sat", (-F.col("idx")).alias("first"), "address"))).alias("top"),
    )
    ok = F.col("i").between(1, 2) & F.col("o").between(1, 2) & (F.col("low") > 0) & ((F.col("o") == 1) | (F.col("top.sat") / F.col("low") >= ratio))
    shapes = _cut(per.where(ok).select("scenario", "txid", "ts", F.col("top.sat").alias("carry"), F.col("top.address").alias("address")), "shapes")
    several = shapes.groupBy("scenario").agg(F.count("*").alias("n")).where(F.col("n") >= least_shapes).select("scenario")
    shapes = shapes.join(several, "scenario", "left_semi")
    spends = entries.where("side = 'in'").select("txid", "address").distinct().join(shapes.drop("address"), "txid").select("scenario", "address", F.col("txid").alias("next"), F.col("ts").alias("then"), F.col("carry").alias("after"))
    gap = (micros(F.col("then")) - micros(F.col("ts"))) / 1e6
    hops = shapes.join(spends, ["scenario", "address"]).where((gap > 0) & (gap <= gap_s) & (F.col("after") <= F.col("carry") * rise))
    hops = hops.groupBy("txid").agg(F.min(F.struct("then", "next", "after")).alias("x")).select("txid", "x.next", "x.after")
    steps = shapes.join(hops, "txid", "left").select("txid", "next", F.lit(0.0).alias("y"), F.coalesce((F.col("after") < F.col("carry")).cast("double"), F.lit(0.0)).alias("falls"), F.lit(0).cast("long").alias("total"), "ts")
    best = chains(steps).join(shapes.select("scenario", "txid", "ts"), "txid").groupBy("scenario").agg(F.min(F.struct((-F.col("n")).alias("m"), "ts", "txid", "falls")).alias("x"))
    return best.select("scenario", F.col("x.txid").alias("start"), (-F.col("x.m")).cast("long").alias("hops"), F.col("x.falls").alias("falls")).where(f"hops >= {int(least_hops)} and falls = hops - 1").drop("falls")


def layering_candidates(entries: DataFrame, transfers: DataFrame, least_out: int = 5, least_ratio: float = 0.6, window_s: float = 259200, hub_degree: int = 500, hops: int = 3) -> DataFrame:
    """(source, sink, recipients, reached, ratio): sources of at least ``least_out`` recipients, most of whose money meets again in one sink in time; no hubs."""
    # each is read in every hop: written once
    hubs = _cut(entries.groupBy("address").agg(F.count("*").alias("n")).where(F.col("n") > hub_degree).select("address"), "hubs")
    transfers = _cut(transfers.select("src", "dst", "ts"), "transfers")
    own = transfers.join(hubs.select(F.col("address").alias("src")), "src", "left_anti")
    # one shuffle to the sources for pairs and their number; the walk starts at the recipients of wide sources and may go on through any wallet
    pairs = own.repartition("src").groupBy("src", "dst").agg(F.min("ts").alias("ts")).withColumn("recipients", F.count("*").over(Window.partitionBy("src")))
    starts = _cut(pairs.where(F.col("recipients") >= least_out).select(F.col("src").alias("source"), F.col("dst").alias("recipient"), "ts", "recipients"), "starts")
    found = _walk(starts, transfers, hubs, hops, window_s)
    # a recipient that gets to a sink in several ways is one
    meet = found.repartition("source", "sink").distinct().groupBy("source", "sink").agg(F.count("*").alias("reached"))
    out = meet.join(starts.groupBy("source").agg(F.max("recipients").alias("recipients")), "source").withColumn("ratio", F.round(F.col("reached") / F.col("recipients"), 6)).where(F.col("ratio") >= least_ratio)
    return out.select("source", "sink", "recipients", "reached", "ratio")


def _walk(starts: DataFrame, transfers: DataFrame, hubs: DataFrame, hops: int, window_s: float) -> DataFrame:
    """(source, recipient, sink), with repeats: wallets other than the recipient that its money reaches in time, in at most ``hops`` steps.

    A hop keeps the earliest arrival at each wallet that no earlier hop has reached. The last one goes nowhere from there, so that it is neither
    reduced nor written."""
    step = transfers.join(hubs.select(F.col("address").alias("dst")), "dst", "left_anti")
    front, span, way = starts.select("source", "recipient", F.col("ts").alias("t0"), F.col("recipient").alias("sink"), F.col("ts").alias("t1")), F.expr(f"make_dt_interval(0, 0, 0, {window_s})"), ["source", "recipient", "sink"]
    seen = None
    for hop in range(1, hops + 1):
        # stretches of twice the window: most walks lie in one of them
        new = join_within(front, step, ("sink", "src"), F.col("t1"), F.col("t0") + span, "ts", 2 * window_s)
        new = new.where((F.col("dst") != F.col("source")) & (F.col("dst") != F.col("recipient"))).select("source", "recipient", "t0", F.col("dst").alias("sink"), F.col("ts").alias("t1"))
        if hop == hops:
            return new.select(*way) if seen is None else seen.select(*way).unionByName(new.select(*way))
        both = new.withColumn("old", F.lit(0)) if seen is None else new.withColumn("old", F.lit(0)).unionByName(seen.withColumn("old", F.lit(1)))
        both = both.groupBy(*way).agg(F.min("t0").alias("t0"), F.min("t1").alias("t1"), F.max("old").alias("old")).where("old = 0")
        front = _cut(both.select(front.columns), "walk")
        seen = front if seen is None else seen.unionByName(front)
    return starts.select("source", "recipient", F.col("recipient").alias("sink")).limit(0)


def _moved(both: DataFrame, total: float) -> DataFrame | None:
    """(node, community) after local moving over (a, b, weight), both ways, loops in; None if nothing moves.

    A node wants to go where modularity gains most (ties: the lowest community). Of neighbours that want to move, only the one of the highest gain (then
    hash) may in a round, so that no two neighbours move together; and of those that go to one community, each must still gain after all of
    higher gain have gone there. What a round gains is then at least the sum of what is counted, so that modularity never falls, and the
    best move of all is always made. Rounds end when no node wants to move."""
    degree = _cut(both.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("k")), "degree")
    apart = both.where("a <> b")
    part, r, changed = _cut(degree.select("node", F.col("node").alias("community")), "part"), 0, False
    while True:
        own = degree.join(part, "node")
        sums = own.groupBy("community").agg(F.sum("k").alias("tot"))
        near = apart.join(part.select(F.col("node").alias("b"), "community"), "b").groupBy(F.col("a").alias("node"), "community").agg(F.sum("weight").alias("w"))
        # the own community is a choice even without a neighbour in it
        near = near.unionByName(part.withColumn("w", F.lit(0).cast("long"))).groupBy("node", "community").agg(F.sum("w").alias("w"))
        choice = near.join(sums, "community").join(own.select("node", "k", F.col("community").alias("own")), "node")
        gain = F.round(F.col("w") - F.col("k") * (F.col("tot") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0)) / total, 9)
        best = choice.groupBy("node").agg(F.min(F.struct((-gain).alias("g"), "community")).alias("x"), F.max(F.when(F.col("community") == F.col("own"), gain)).alias("stay"), F.max("k").alias("k"))
        wants = best.select("node", "k", F.col("x.community").alias("to"), (-F.col("x.g") - F.col("stay")).alias("more")).where("more > 1e-9")
        wants = _cut(wants.withColumn("first", F.struct("more", F.xxhash64("node", F.lit(r)).alias("h"), "node")), "wants")
        if not wants.limit(1).count():
            _drop(wants, degree, None if changed else part)
            return part if changed else None
        beside = apart.join(wants.select(F.col("node").alias("a"), F.col("first").alias("mine")), "a").join(wants.select(F.col("node").alias("b"), F.col("first").alias("other")), "b")
        free = wants.join(beside.where("other > mine").select(F.col("a").alias("node")).distinct(), "node", "left_anti")
        before = F.coalesce(F.sum("k").over(Window.partitionBy("to").orderBy(F.desc("more"), "node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        goes = free.withColumn("before", before).where(F.col("more") - F.col("k") * F.col("before") / total > 1e-9).select("node", "to")
        new = _cut(part.join(goes, "node", "left").select("node", F.coalesce("to", "community").alias("community")), "part")
        _drop(part, wants)
        part, r, changed = new, r + 1, True


def louvain(pairs: DataFrame) -> DataFrame:
    """(node, community) over (a, b, weight): local moving until nothing moves, then the communities become nodes (their inner
    weight a loop) and move in turn, level by level. A community is named after its lowest node; deterministic."""
    both = _cut(pairs.select("a", "b", F.col("weight").cast("long").alias("weight")).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("weight").cast("long").alias("weight"))), "pairs")
    total = both.agg(F.sum("weight")).first()[0] or 1
    label = _cut(both.select(F.col("a").alias("node"), F.col("a").alias("community")).distinct(), "louvain")
    while (part := _moved(both, total)) is not None:
        new = _cut(label.join(part.toDF("community", "to"), "community").select("node", F.col("to").alias("community")), "louvain")
        _drop(label)
        label = new
        new = _cut(both.join(part.toDF("a", "ca"), "a").join(part.toDF("b", "cb"), "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("weight").alias("weight")), "pairs")
        _drop(both, part)
        both = new
    _drop(both)
    name = label.groupBy("community").agg(F.min("node").alias("name"))
    return label.join(name, "community").select("node", F.col("name").alias("community"))


def mixing_candidates(entries: DataFrame, members: DataFrame, pairs: DataFrame, least_size: int = 5, least_density: float = 0.3, most_external: float = 0.4, most_cv: float = 0.5, span_s: float = 172800) -> DataFrame:
    """Communities that look like mixers: size, density, external ratio, variation (sample) of their output amounts and time span."""
    shape = community_metrics(pairs, members).where((F.col("size") >= least_size) & (F.col("density") >= least_density) & (F.col("external_ratio") <= most_external))
    own = members.select(F.col("node").alias("address"), "community").join(shape.select("community"), "community", "left_semi")
    tx = entries.where("side = 'in'").join(own, "address").select("community", "txid").distinct()
    out = tx.join(entries.where("side = 'out'").select("txid", "sat", "ts"), "txid").groupBy("community").agg(
        F.round(F.stddev_samp("sat") / F.avg("sat"), 6).alias("cv"), ((F.max(micros(F.col("ts"))) - F.min(micros(F.col("ts")))) / 1e6).alias("span_s"), F.count_distinct("txid").alias("tx_count")
    )
    return shape.join(out, "community").where((F.col("cv") <= most_cv) & (F.col("span_s") <= span_s))


def evidence_layering(entries: DataFrame, window_s: float = 259200, least_share: float = 0.6, least_wide: int = 3) -> DataFrame:
    """(scenario, fan_out, fan_in, share): in a scenario, a fan-out whose outputs mostly are the inputs of a later fan-in within the window; the first such pair."""
    pairs = layering_pairs(entries, window_s, least_share, least_wide)
    return pairs.groupBy("scenario").agg(F.min(F.struct("t0", "fan_out", "t1", "fan_in", "share")).alias("x")).select("scenario", "x.fan_out", "x.fan_in", "x.share")


def layering_pairs(entries: DataFrame, window_s: float = 259200, least_share: float = 0.6, least_wide: int = 3) -> DataFrame:
    """(scenario, fan_out, fan_in, t0, t1, shared, share): all pairs of a fan-out and a later fan-in of a scenario, within the window, that
    share at least ``least_share`` of the fan-out's outputs."""
    per = entries.groupBy("scenario", "txid", "ts").agg(_wallets("in").alias("i"), _wallets("out").alias("o"))
    outs = entries.where("side = 'out'").join(per.where(F.col("o") >= least_wide).select("txid", "o"), "txid").select("scenario", "address", F.col("txid").alias("fan_out"), F.col("ts").alias("t0"), "o").distinct()
    ins = entries.where("side = 'in'").join(per.where(F.col("i") >= least_wide).select("txid"), "txid").select("scenario", "address", F.col("txid").alias("fan_in"), F.col("ts").alias("t1")).distinct()
    gap = (micros(F.col("t1")) - micros(F.col("t0"))) / 1e6
    pairs = outs.join(ins, ["scenario", "address"]).where((gap > 0) & (gap <= window_s)).groupBy("scenario", "fan_out", "t0", "fan_in", "t1", "o").agg(F.count("*").alias("shared"))
    return pairs.withColumn("share", F.round(F.col("shared") / F.col("o"), 6)).where(F.col("share") >= least_share).drop("o")


def aggregation_flow(entries: DataFrame, least_in: int = 2, most_in: int | None = None, most_out: int | None = None) -> DataFrame:
    """(scenario, txid): fan-ins (input rows, from ``least_in`` to ``most_in``; at most ``most_out`` output rows) of which some output is spent later in the same scenario."""
    per = entries.groupBy("scenario", "txid").agg(F.count_if(F.col("side") == "in").alias("i"), F.count_if(F.col("side") == "out").alias("o"))
    ok = (F.col("i") >= least_in) & (F.lit(True) if most_in is None else F.col("i") <= most_in) & (F.lit(True) if most_out is None else F.col("o") <= most_out)
    outs = entries.where("side = 'out'").join(per.where(ok).select("txid"), "txid", "left_semi").select("scenario", "txid", "address", F.col("ts").alias("t0"))
    # spent later means: the last time it is spent is later
    later = entries.where("side = 'in'").groupBy("scenario", "address").agg(F.max("ts").alias("t1"))
    return outs.join(later, ["scenario", "address"]).where("t1 > t0").select("scenario", "txid").distinct()


def evidence_mixing(entries: DataFrame, least: int = 3, most_cv: float = 0.1) -> DataFrame:
    """(scenario, txid, cv): the most even transaction of as many inputs as outputs (population variation of outputs)."""
    per = entries.groupBy("scenario", "txid").agg(
        F.count_if(F.col("side") == "in").alias("i"), F.count_if(F.col("side") == "out").alias("o"), (F.stddev_pop(F.when(F.col("side") == "out", F.col("sat"))) / F.avg(F.when(F.col("side") == "out", F.col("sat")))).alias("cv")
    )
    good = per.where((F.col("i") == F.col("o")) & (F.col("i") >= least)).withColumn("cv", F.round("cv", 6)).where(F.col("cv") <= most_cv)
    return good.groupBy("scenario").agg(F.min(F.struct("cv", "txid")).alias("x")).select("scenario", "x.txid", "x.cv")


def evidence_ransomware(entries: DataFrame, telemetry: DataFrame, tx: DataFrame, least: int = 3, most: int = 50, least_suspicious: int = 2, least_share: float = 0.25, fan_in: int = 2, most_outputs: int = 2, fan_out: int = 3) -> DataFrame:
    """(scenario, tx_count, suspicious, aggregated): small scenarios with suspicious relays, without a transaction of ``fan_out`` outputs, where an output
    of some fan-in (exactly ``fan_in`` input rows, at most ``most_outputs`` output rows) is spent again later."""
    infra = telemetry.join(tx, "txid").groupBy("scenario").agg(F.count("*").alias("tx_count"), F.count_if(suspicious(F.col("node_type"))).alias("suspicious"))
    infra = infra.where(F.col("tx_count").between(least, most) & (F.col("suspicious") >= least_suspicious) & (F.col("suspicious") >= least_share * F.col("tx_count")))
    per = entries.groupBy("scenario", "txid").agg(F.count_if(F.col("side") == "out").alias("o"))
    wide = per.where(F.col("o") >= fan_out).select("scenario").distinct()
    again = aggregation_flow(entries, fan_in, fan_in, most_outputs).groupBy("scenario").agg(F.count("*").alias("aggregated"))
    return infra.join(again, "scenario").join(wide, "scenario", "left_anti")


def attach_evidence(flagged: DataFrame, fragments: DataFrame) -> DataFrame:
    """(scenario, evidence, n): fragments (scenario, kind, detail) of flagged scenarios only, joined in order."""
    own = fragments.join(flagged.select("scenario"), "scenario", "left_semi")
    one = F.concat_ws(":", "kind", "detail")
    return own.groupBy("scenario").agg(F.array_join(F.array_sort(F.collect_set(one)), ";").alias("evidence"), F.count("*").alias("n"))


def alert_records(flagged: DataFrame, entries: DataFrame, tx: DataFrame, telemetry: DataFrame, evidence: DataFrame) -> DataFrame:
    """One evidence record for each flagged (scenario, pattern_type): its transactions in time order, flows, relays and fragments of evidence."""
    own = tx.join(flagged.select("scenario"), "scenario", "left_semi")
    listed = own.groupBy("scenario").agg(F.count("*").alias("tx_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "txid"))), lambda x: x["txid"].cast("string")), ",").alias("txids"))
    money = entries.groupBy("scenario").agg(F.coalesce(F.sum(F.when(F.col("side") == "in", F.col("sat"))), F.lit(0)).alias("in_sat"), F.coalesce(F.sum(F.when(F.col("side") == "out", F.col("sat"))), F.lit(0)).alias("out_sat"))
    relays = own.select("txid", "scenario").join(telemetry, "txid")
    several = lambda c, name: F.array_join(F.array_sort(F.collect_set(c)), ",").alias(name)
    places = relays.groupBy("scenario").agg(several("relay_ip", "ips"), several("asn", "asns"), several("country", "countries"))
    kinds = relays.groupBy("scenario", "node_type").agg(F.count("*").alias("n")).groupBy("scenario").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "node_type", "n"))), ",").alias("infrastructure"))
    out = flagged.join(listed, "scenario").join(money, "scenario", "left").join(places, "scenario", "left").join(kinds, "scenario", "left").join(evidence, "scenario", "left")
    return out.select(F.concat(F.lit("alert_"), "scenario").alias("candidate"), "scenario", "pattern_type", "tx_count", "txids", "in_sat", "out_sat", "ips", "asns", "countries", "infrastructure", F.coalesce("evidence", F.lit("")).alias("evidence"))


def explanations(features: DataFrame, names: list[str], top: int = 3, kind: str | None = None) -> DataFrame:
    """(scenario, text): the ``top`` features of largest standard score over all scenarios, in words (ties by name), behind the scenario's typology
    (the column ``kind``) where given."""
    from chainsift.functions.columns import explanation

    spread = features.agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names])
    score = lambda n: F.round(F.when(F.col(f"s_{n}") > 0, (F.col(n) - F.col(f"m_{n}")) / F.col(f"s_{n}")).otherwise(0.0), 6)
    head = F.concat(F.col(kind), F.lit(": ")) if kind else F.lit("")
    long = features.crossJoin(F.broadcast(spread)).select("scenario", head.alias("head"), F.array_sort(F.array(*[F.struct((-F.abs(score(n))).alias("size"), F.lit(n).alias("feature"), score(n).alias("effect")) for n in names])).alias("all"))  # one row of means
    listed = F.array_join(F.transform(F.slice("all", 1, top), lambda x: explanation(x["feature"], x["effect"], names)), "; ")
    return long.select("scenario", F.concat("head", listed).alias("text"))


def candidate_network(members: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Of candidates (candidate, txid): distinct IPs and ASNs, share of Tor or VPN relays, and the IPs."""
    return members.join(telemetry, "txid").groupBy("candidate").agg(
        F.count_distinct("relay_ip").alias("ips"), F.count_distinct("asn").alias("asns"), F.round(F.avg(F.col("node_type").isin("tor_exit_node", "vpn_proxy").cast("double")), 6).alias("tor_vpn_share"),
        F.array_join(F.array_sort(F.collect_set("relay_ip")), ",").alias("member_ips"),
    )


def candidate_truth(members: DataFrame, truth: DataFrame) -> DataFrame:
    """Of candidates (candidate, kind, txid) against (txid, pattern_type): members, matching ones, the most common pattern."""
    return members.join(truth, "txid").groupBy("candidate", "kind").agg(F.count("*").alias("members"), F.count_if(F.col("pattern_type") == F.col("kind")).alias("matching"), F.mode("pattern_type", True).alias("dominant"))


def validate_candidates(found: DataFrame, truth: DataFrame, least_share: float = 0.8) -> DataFrame:
    """Precision, recall and F1 by kind of candidates (kind, candidate, txid) against (txid, scenario, pattern_type).

    A candidate is a true positive if ``least_share`` of its transactions are of its kind's pattern. A scenario of the pattern counts as found if a
    true positive has one of its transactions. A kind without candidates has zeros; one without scenarios has a recall of zero."""
    rows = found.select("kind", "candidate", "txid").distinct().join(truth, "txid", "left")
    hit = F.coalesce(F.col("pattern_type") == F.col("kind"), F.lit(False))
    per = rows.groupBy("kind", "candidate").agg((F.count_if(hit) >= least_share * F.count("*")).alias("tp"))
    counts = per.groupBy("kind").agg(F.count("*").alias("candidates"), F.count_if("tp").alias("true_positives"))
    covered = rows.where(hit).join(per.where("tp"), ["kind", "candidate"]).groupBy("kind").agg(F.count_distinct("scenario").alias("found"))
    totals = truth.groupBy(F.col("pattern_type").alias("kind")).agg(F.count_distinct("scenario").alias("scenarios"))
    out = counts.join(covered, "kind", "left").join(totals, "kind", "left").na.fill(0, ["found", "scenarios"])
    p, r = F.col("true_positives") / F.col("candidates"), F.when(F.col("scenarios") > 0, F.col("found") / F.col("scenarios")).otherwise(0.0)
    return out.select("kind", "candidates", "true_positives", (F.col("candidates") - F.col("true_positives")).alias("false_positives"), "found", "scenarios", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def validate(truthed: DataFrame, totals: DataFrame, least_share: float = 0.8) -> DataFrame:
    """Precision, recall and F1 by kind. ``truthed``: candidate_truth with ``scenario``; ``totals``: (kind, scenarios)."""
    tp = F.col("matching") >= least_share * F.col("members")
    per = truthed.groupBy("kind").agg(F.count("*").alias("candidates"), F.count_if(tp).alias("true_positives"), F.count_distinct(F.when(tp, F.col("scenario"))).alias("found"))
    out = per.join(totals, "kind")
    p, r = F.col("true_positives") / F.col("candidates"), F.col("found") / F.col("scenarios")
    return out.select("kind", "candidates", "true_positives", "found", "scenarios", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))
