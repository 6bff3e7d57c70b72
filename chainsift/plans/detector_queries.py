"""Queries of detectors, features and their evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainsift.functions.columns import rounded
from chainsift.operators import detect as D
from chainsift.operators import features as E
from chainsift.operators import graphs as G

from chainsift.sources.ledger import DUCK

from .base import ORACLES, Tables, query

DAYS = 180 * 86400  # the orders are spread over years: wider gaps than the detectors' defaults

_PEEL = """p AS (SELECT txid, any_value(ts) AS ts, any_value(scenario) AS scenario, count(DISTINCT address) FILTER (side = 'in') AS ins, count(DISTINCT address) FILTER (side = 'out') AS outs, count(*) FILTER (side = 'out') AS out_rows,
  CAST(sum(sat) FILTER (side = 'in') AS BIGINT) AS in_sat, max(row(sat, address)) FILTER (side = 'out') AS hi, min(row(sat, address)) FILTER (side = 'out') AS lo FROM entry GROUP BY txid),
  peel AS (SELECT txid, ts, scenario, hi[1] AS carry, lo[1] AS peel, hi[2] AS carry_to, in_sat, out_rows = 2 AS two_rows FROM p WHERE ins BETWEEN 1 AND 2 AND outs = 2 AND (lo[1] <= 0 OR hi[1] / nullif(lo[1], 0) >= 2)),
  sp AS (SELECT txid, address, sum(sat) AS spent FROM entry WHERE side = 'in' GROUP BY 1, 2)"""


def _hop(extra: str = "") -> str:
    return f"""hop AS (SELECT a.txid AS txid, arg_min(b.txid, epoch_us(b.ts) * 10 + 0) AS next0, (min(row(b.ts, b.txid)))[2] AS next FROM peel a JOIN sp ON sp.address = a.carry_to JOIN peel b ON b.txid = sp.txid
  WHERE a.two_rows AND b.two_rows AND (b.ts > a.ts OR b.ts = a.ts AND b.txid > a.txid) AND epoch_us(b.ts) - epoch_us(a.ts) <= {DAYS}::BIGINT * 1000000 AND spent <= carry_limit(a.carry) {extra} GROUP BY 1)""".replace("arg_min(b.txid, epoch_us(b.ts) * 10 + 0) AS next0, ", "").replace("carry_limit(a.carry)", "a.carry * (1 + 0.05::DOUBLE)")


@query(f", {_PEEL} SELECT * FROM peel")
def peel_tx(t: Tables):
    return D.peel_transactions(t.entries)


@query(f", {_PEEL}, {_hop()} SELECT txid, next FROM hop")
def peel_hops(t: Tables):
    return D.peel_hops(t.entries, G._cut(D.peel_transactions(t.entries), "peels"), DAYS)


_CHAIN = """ch AS (SELECT txid AS chain, txid, 0 AS pos FROM peel WHERE two_rows UNION ALL SELECT chain, next, pos + 1 FROM ch JOIN hop USING (txid)),
  mem AS (SELECT chain, ch.txid, pos, carry, peel, ts, lead(carry) OVER (PARTITION BY chain ORDER BY pos) AS after FROM ch JOIN peel USING (txid)),
  dec AS (SELECT chain, count(*) AS hops, round(0.5 * avg(CAST(after < carry AS INT)) + 0.5 * CASE WHEN regr_slope(ln(greatest(carry, 1)), pos) >= 0 THEN 0 ELSE coalesce(regr_r2(ln(greatest(carry, 1)), pos), 0) END, 6) AS decay FROM mem GROUP BY 1 HAVING count(*) >= 2)"""


@query(f""", {_PEEL}, {_hop()}, {_CHAIN}, good AS (SELECT * FROM dec WHERE hops >= 2 AND decay >= 0.6), inner_ AS (SELECT DISTINCT mem.txid AS chain FROM mem JOIN good USING (chain) WHERE pos > 0)
  SELECT chain, hops, decay, CAST(sum(peel) AS BIGINT) AS total_peeled, min(ts) AS first_ts, max(ts) AS last_ts FROM mem JOIN good USING (chain) WHERE chain NOT IN (SELECT chain FROM inner_) GROUP BY 1, 2, 3""")
def peel_chains(t: Tables):
    return D.peel_chains(t.entries, DAYS, least_hops=2)


@query(f""", per AS (SELECT scenario, txid, ts, count(*) FILTER (side = 'in') AS i, count(*) FILTER (side = 'out') AS o, min(sat) FILTER (side = 'out') AS low, max(row(sat, -idx, address)) FILTER (side = 'out') AS top FROM entry GROUP BY 1, 2, 3),
  sh0 AS (SELECT scenario, txid, ts, top[1] AS carry, top[3] AS address FROM per WHERE i BETWEEN 1 AND 2 AND o BETWEEN 1 AND 2 AND low > 0 AND (o = 1 OR top[1] / low >= 2)), sh AS (SELECT * FROM sh0 WHERE scenario IN (SELECT scenario FROM sh0 GROUP BY 1 HAVING count(*) >= 3)),
  nx AS (SELECT a.txid, (min(row(b.ts, b.txid)))[2] AS next FROM sh a JOIN sh b ON a.scenario = b.scenario JOIN entry e ON e.txid = b.txid AND e.side = 'in' AND e.address = a.address WHERE b.ts > a.ts AND epoch_us(b.ts) - epoch_us(a.ts) <= {8 * DAYS}::BIGINT * 1000000 AND b.carry <= a.carry * 1.05::DOUBLE GROUP BY 1),
  ch AS (SELECT txid AS start, txid, 1 AS hops, true AS falls FROM sh UNION ALL SELECT start, next, hops + 1, falls AND b.carry < a.carry FROM ch JOIN nx USING (txid) JOIN sh a ON a.txid = ch.txid JOIN sh b ON b.txid = next),
  lg AS (SELECT scenario, ts, start, max(hops) AS hops, bool_and(falls) AS falls FROM ch JOIN sh ON sh.txid = start GROUP BY 1, 2, 3), be AS (SELECT scenario, min(row(-hops, ts, start, falls)) AS x FROM lg GROUP BY 1)
  SELECT scenario, x[3] AS start, CAST(-x[1] AS BIGINT) AS hops FROM be WHERE -x[1] >= 2 AND x[4]""")
def ev_peel(t: Tables):
    """The longest falling chain of each scenario."""
    return D.evidence_peel(t.entries, 8 * DAYS, least_hops=2)


@query(f""", {_PEEL}, {_hop()} SELECT h.txid, h.next, (epoch_us(b.ts) - epoch_us(a.ts)) / 1e6 AS gap_s FROM hop h JOIN peel a ON a.txid = h.txid JOIN peel b ON b.txid = h.next""")
def chain_gaps(t: Tables):
    from chainsift.functions.columns import seconds_between

    peels = G._cut(D.peel_transactions(t.entries), "peels")
    ts = peels.select(F.col("txid").alias("next"), F.col("ts").alias("next_ts"))
    return D.peel_hops(t.entries, peels, DAYS).join(peels.select("txid", "ts"), "txid").join(ts, "next").select("txid", "next", seconds_between(F.col("next_ts"), F.col("ts")).alias("gap_s"))


@query(""", hub AS (SELECT address FROM entry GROUP BY 1 HAVING count(*) > 40), own AS (SELECT * FROM transfer WHERE src NOT IN (SELECT address FROM hub)), fan AS (SELECT src AS source, count(DISTINCT dst) AS recipients FROM own GROUP BY 1 HAVING count(DISTINCT dst) >= 5),
  st AS (SELECT DISTINCT src, dst, ts FROM transfer WHERE dst NOT IN (SELECT address FROM hub)), s0 AS (SELECT src AS source, dst AS recipient, min(ts) AS t0 FROM own WHERE src IN (SELECT source FROM fan) GROUP BY 1, 2),
  r1 AS (SELECT source, recipient, t0, dst AS sink, min(ts) AS t1 FROM s0 JOIN st ON recipient = src WHERE ts >= t0 AND ts <= t0 + INTERVAL 400 DAY AND dst <> source AND dst <> recipient GROUP BY 1, 2, 3, 4),
  r2 AS (SELECT r1.source, r1.recipient, dst AS sink FROM r1 JOIN st ON r1.sink = src WHERE ts >= t1 AND ts <= t0 + INTERVAL 400 DAY AND dst <> source AND dst <> recipient),
  m AS (SELECT source, sink, count(DISTINCT recipient) AS reached FROM (SELECT source, recipient, sink FROM r1 UNION SELECT * FROM r2) GROUP BY 1, 2)
  SELECT source, sink, recipients, reached, round(reached / recipients, 6) AS ratio FROM m JOIN fan USING (source) WHERE round(reached / recipients, 6) >= 0.3""")
def layering_candidates(t: Tables):
    return D.layering_candidates(t.entries, t.transfers, 5, 0.3, 400 * 86400, 40, 2)


@query(""", per AS (SELECT scenario, txid, ts, count(DISTINCT address) FILTER (side = 'in') AS i, count(DISTINCT address) FILTER (side = 'out') AS o FROM entry GROUP BY 1, 2, 3),
  ou AS (SELECT DISTINCT e.scenario, address, e.txid AS fan_out, e.ts AS t0, o FROM entry e JOIN per USING (txid) WHERE side = 'out' AND o >= 2), inn AS (SELECT DISTINCT e.scenario, address, e.txid AS fan_in, e.ts AS t1 FROM entry e JOIN per USING (txid) WHERE side = 'in' AND i >= 2),
  pr AS (SELECT scenario, fan_out, t0, fan_in, t1, round(count(*) / any_value(o), 6) AS share FROM ou JOIN inn USING (scenario, address) WHERE t1 > t0 AND t1 <= t0 + INTERVAL 2000 DAY GROUP BY 1, 2, 3, 4, 5)
  SELECT scenario, x[2] AS fan_out, x[4] AS fan_in, x[5] AS share FROM (SELECT scenario, min(row(t0, fan_out, t1, fan_in, share)) AS x FROM pr WHERE share >= 0.3 GROUP BY 1)""")
def ev_layering(t: Tables):
    return D.evidence_layering(t.entries, 2000 * 86400, 0.3, 2)


@query(""", per AS (SELECT scenario, txid, count(*) FILTER (side = 'in') AS i, count(*) FILTER (side = 'out') AS o, round(stddev_pop(sat) FILTER (side = 'out') / avg(sat) FILTER (side = 'out'), 6) AS cv FROM entry GROUP BY 1, 2)
  SELECT scenario, x[2] AS txid, x[1] AS cv FROM (SELECT scenario, min(row(cv, txid)) AS x FROM per WHERE i = o AND i >= 2 AND cv <= 0.4 GROUP BY 1)""")
def ev_mixing(t: Tables):
    return D.evidence_mixing(t.entries, 2, 0.4)


@query(""", inf AS (SELECT scenario, count(*) AS tx_count, count(*) FILTER (node_type IN ('tor_exit_node', 'vpn_proxy', 'bulletproof_host')) AS suspicious FROM tx JOIN telemetry USING (txid) GROUP BY 1),
  per AS (SELECT scenario, txid, count(*) FILTER (side = 'in') AS i, count(*) FILTER (side = 'out') AS o FROM entry GROUP BY 1, 2), la AS (SELECT scenario, address, max(ts) AS t1 FROM entry WHERE side = 'in' GROUP BY 1, 2),
  ag AS (SELECT e.scenario, count(DISTINCT e.txid) AS aggregated FROM entry e JOIN per USING (txid) JOIN la ON la.scenario = e.scenario AND la.address = e.address WHERE side = 'out' AND i = 2 AND o <= 4 AND t1 > e.ts GROUP BY 1)
  SELECT scenario, tx_count, suspicious, aggregated FROM inf JOIN ag USING (scenario) WHERE tx_count BETWEEN 3 AND 50 AND suspicious >= 2 AND suspicious >= 0.25 * tx_count AND scenario NOT IN (SELECT scenario FROM per WHERE o >= 5)""")
def ev_ransomware(t: Tables):
    """Transactions have more outputs here than the detector's defaults allow."""
    return D.evidence_ransomware(t.entries, t.telemetry, t.tx, most_outputs=4, fan_out=5)


def _fragments(t: Tables):
    mixing = D.evidence_mixing(t.entries, 2, 0.4).select("scenario", F.lit("mixing").alias("kind"), F.col("txid").cast("string").alias("detail"))
    layering = D.evidence_layering(t.entries, 2000 * 86400, 0.3, 2).select("scenario", F.lit("layering").alias("kind"), F.concat_ws(">", "fan_out", "fan_in").alias("detail"))
    return mixing.unionByName(layering)


@query(""", per AS (SELECT scenario, txid, ts, count(*) FILTER (side = 'in') AS ri, count(*) FILTER (side = 'out') AS ro, count(DISTINCT address) FILTER (side = 'in') AS i, count(DISTINCT address) FILTER (side = 'out') AS o, round(stddev_pop(sat) FILTER (side = 'out') / avg(sat) FILTER (side = 'out'), 6) AS cv FROM entry GROUP BY 1, 2, 3),
  mx AS (SELECT scenario, 'mixing:' || (min(row(cv, txid)))[2] AS f FROM per WHERE ri = ro AND ri >= 2 AND cv <= 0.4 GROUP BY 1),
  ou AS (SELECT DISTINCT e.scenario, address, e.txid AS fan_out, e.ts AS t0, o FROM entry e JOIN per USING (txid) WHERE side = 'out' AND o >= 2), inn AS (SELECT DISTINCT e.scenario, address, e.txid AS fan_in, e.ts AS t1 FROM entry e JOIN per USING (txid) WHERE side = 'in' AND i >= 2),
  pr AS (SELECT scenario, fan_out, t0, fan_in, t1, round(count(*) / any_value(o), 6) AS share FROM ou JOIN inn USING (scenario, address) WHERE t1 > t0 AND t1 <= t0 + INTERVAL 2000 DAY GROUP BY 1, 2, 3, 4, 5),
  ly AS (SELECT scenario, 'layering:' || x[2] || '>' || x[4] AS f FROM (SELECT scenario, min(row(t0, fan_out, t1, fan_in)) AS x FROM pr WHERE share >= 0.3 GROUP BY 1)), fr AS (SELECT * FROM mx UNION ALL SELECT * FROM ly)
  SELECT scenario, string_agg(f, ';' ORDER BY f) AS evidence, count(*) AS n FROM fr WHERE scenario IN (SELECT scenario FROM label WHERE is_illicit = 1) GROUP BY 1""")
def alert_evidence(t: Tables):
    return D.attach_evidence(t.labels.where("is_illicit = 1"), _fragments(t))


_PAIRS = """per AS (SELECT scenario, txid, ts, count(DISTINCT address) FILTER (side = 'in') AS i, count(DISTINCT address) FILTER (side = 'out') AS o FROM entry GROUP BY 1, 2, 3),
  ou AS (SELECT DISTINCT e.scenario, address, e.txid AS fan_out, e.ts AS t0, o FROM entry e JOIN per USING (txid) WHERE side = 'out' AND o >= 2), inn AS (SELECT DISTINCT e.scenario, address, e.txid AS fan_in, e.ts AS t1 FROM entry e JOIN per USING (txid) WHERE side = 'in' AND i >= 2)"""


@query(f", {_PAIRS} SELECT scenario, fan_out, t0, fan_in, t1, count(*) AS shared, round(count(*) / any_value(o), 6) AS share FROM ou JOIN inn USING (scenario, address) WHERE t1 > t0 AND t1 <= t0 + INTERVAL 2000 DAY GROUP BY 1, 2, 3, 4, 5 HAVING round(count(*) / any_value(o), 6) >= 0.3")
def layering_pairs(t: Tables):
    return D.layering_pairs(t.entries, 2000 * 86400, 0.3, 2)


@query(""", per AS (SELECT scenario, txid, count(*) FILTER (side = 'in') AS i FROM entry GROUP BY 1, 2) SELECT DISTINCT e.scenario, e.txid FROM entry e JOIN per USING (txid) WHERE side = 'out' AND i >= 2
  AND EXISTS (SELECT 1 FROM entry k WHERE k.side = 'in' AND k.scenario = e.scenario AND k.address = e.address AND k.ts > e.ts)""")
def agg_flow(t: Tables):
    return D.aggregation_flow(t.entries, 2)


_MEMBERS = "mem AS (SELECT 's' || scenario AS candidate, scenario, pattern_type AS kind, txid FROM tx JOIN label USING (scenario) WHERE is_illicit = 1)"


def _members(t: Tables):
    return t.tx.join(t.labels.where("is_illicit = 1"), "scenario").select(F.concat(F.lit("s"), "scenario").alias("candidate"), "scenario", F.col("pattern_type").alias("kind"), "txid")


@query(f""", {_MEMBERS} SELECT candidate, count(DISTINCT relay_ip) AS ips, count(DISTINCT asn) AS asns, round(avg(CAST(node_type IN ('tor_exit_node', 'vpn_proxy') AS INT)), 6) AS tor_vpn_share, string_agg(DISTINCT relay_ip, ',' ORDER BY relay_ip) AS member_ips FROM mem JOIN telemetry USING (txid) GROUP BY 1""")
def candidate_network(t: Tables):
    return D.candidate_network(_members(t), t.telemetry)


_TRUTH = "tru AS (SELECT m.candidate, m.kind, count(*) AS members, count(*) FILTER (p.pattern_type = m.kind) AS matching, min(p.pattern_type) AS dominant FROM (SELECT 'c' || (scenario // 2) AS candidate, arg_min(kind, scenario) OVER (PARTITION BY scenario // 2) AS kind, txid FROM mem) m JOIN (SELECT txid, pattern_type FROM tx JOIN label USING (scenario)) p USING (txid) GROUP BY 1, 2)"


def _pairs(t: Tables):
    """Candidates of two neighbouring scenarios each, named after the first one's pattern."""
    from pyspark.sql import Window

    rows = _members(t)
    w = Window.partitionBy(F.floor(F.col("scenario") / 2))
    return rows.withColumn("kind", F.min_by("kind", "scenario").over(w)).withColumn("candidate", F.concat(F.lit("c"), F.floor(F.col("scenario") / 2)))


@query(f", {_MEMBERS}, {_TRUTH} SELECT candidate, kind, members, matching FROM tru")
def candidate_truth(t: Tables):
    return D.candidate_truth(_pairs(t), t.tx.join(t.labels, "scenario").select("txid", "pattern_type")).drop("dominant")


def _found(t: Tables):
    """(candidate, kind, scenario, txid): members of what the evidence detectors find, from entries alone."""
    mixing = D.evidence_mixing(t.entries, 2, 0.4).select(F.lit("mixing").alias("kind"), "scenario", "txid")
    layering = D.evidence_layering(t.entries, 2000 * 86400, 0.3, 2).select(F.lit("layering").alias("kind"), "scenario", F.explode(F.array("fan_out", "fan_in")).alias("txid"))
    both = mixing.unionByName(layering.select("kind", "scenario", "txid"))
    return both.withColumn("candidate", F.concat_ws(":", "kind", "scenario"))


@query(f""", mxp AS (SELECT scenario, txid, count(*) FILTER (side = 'in') AS i, count(*) FILTER (side = 'out') AS o, round(stddev_pop(sat) FILTER (side = 'out') / avg(sat) FILTER (side = 'out'), 6) AS cv FROM entry GROUP BY 1, 2),
  mx AS (SELECT scenario, (min(row(cv, txid)))[2] AS txid FROM mxp WHERE i = o AND i >= 2 AND cv <= 0.4 GROUP BY 1), {_PAIRS}, pr AS (SELECT scenario, fan_out, t0, fan_in, t1 FROM ou JOIN inn USING (scenario, address) WHERE t1 > t0 AND t1 <= t0 + INTERVAL 2000 DAY GROUP BY 1, 2, 3, 4, 5 HAVING round(count(*) / any_value(o), 6) >= 0.3),
  ly AS (SELECT scenario, min(row(t0, fan_out, t1, fan_in)) AS x FROM pr GROUP BY 1), cand AS (SELECT 'mixing' AS kind, scenario, txid FROM mx UNION ALL SELECT 'layering', scenario, unnest([x[2], x[4]]) FROM ly),
  tru AS (SELECT kind, c.scenario, count(*) AS members, count(*) FILTER (l.pattern_type = kind) AS matching, mode(l.pattern_type ORDER BY l.pattern_type) AS dominant FROM cand c JOIN tx USING (txid) JOIN label l ON l.scenario = tx.scenario GROUP BY 1, 2), tot AS (SELECT pattern_type AS kind, count(*) AS scenarios FROM label WHERE is_illicit = 1 GROUP BY 1),
  v AS (SELECT kind, count(*) AS candidates, count(*) FILTER (matching >= 0.8 * members) AS true_positives, count(DISTINCT CASE WHEN matching >= 0.8 * members THEN tru.scenario END) AS found, any_value(scenarios) AS scenarios FROM tru JOIN tot USING (kind) GROUP BY 1),
  w AS (SELECT *, true_positives / candidates AS p, found / scenarios AS r FROM v) SELECT kind, candidates, true_positives, found, scenarios, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM w""")
def validate_detectors(t: Tables):
    """What the detectors find against the labels."""
    found = _found(t)
    truthed = D.candidate_truth(found, t.tx.join(t.labels, "scenario").select("txid", "pattern_type")).join(found.select("candidate", "scenario").distinct(), "candidate")
    return D.validate(truthed, t.labels.where("is_illicit = 1").groupBy(F.col("pattern_type").alias("kind")).agg(F.count("*").alias("scenarios")))


@query()
def mix_communities(t: Tables):
    return D.louvain(G.coparticipation(t.entries))


@query()
def mixing_candidates(t: Tables):
    pairs = G.coparticipation(t.entries)
    return D.mixing_candidates(t.entries, D.louvain(pairs), pairs, 3, 0.3, 0.4, 1.0, 4000 * 86400)


# features


def _rounded(df, places: int = 6):
    return df.select(*[rounded(F.col(c), places).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


_AMOUNT = """, per AS (SELECT scenario, txid, ts, coalesce(sum(sat) FILTER (side = 'in'), 0) / 1e8 AS i, coalesce(sum(sat) FILTER (side = 'out'), 0) / 1e8 AS o FROM entry GROUP BY 1, 2, 3),
  pf AS (SELECT per.*, CASE WHEN i > 0 THEN fee / 1e8 / i END AS fr, row_number() OVER (PARTITION BY per.scenario ORDER BY per.ts, per.txid) - 1 AS pos FROM per JOIN tx USING (txid)),
  b AS (SELECT scenario, round(avg(i), 6) AS total_input_mean, round(avg(o), 6) AS total_output_mean, round(avg(fr), 6) AS fee_ratio_mean, round(coalesce(stddev_samp(fr), 0), 6) AS fee_ratio_std, round(coalesce(CASE WHEN count(*) > 1 THEN regr_slope(o, pos) END, 0), 6) AS amount_decay_slope, round(avg(CASE WHEN i > 0 THEN 1 - abs(i - o) / i END), 6) AS io_amount_similarity FROM pf GROUP BY 1),
  ou AS (SELECT scenario, txid, idx, sat / 1e8 AS v FROM entry WHERE side = 'out'), rk AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY v, txid, idx) AS r FROM ou),
  g AS (SELECT scenario, round((2 * sum(r * v) - (count(*) + 1) * sum(v)) / (count(*) * sum(v)), 6) AS output_amount_gini, round(avg(CAST(list_bool_or(list_transform([0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 100.0], lambda t: abs(v - t) / t <= 0.01)) AS INT)), 6) AS round_number_ratio FROM rk GROUP BY 1),
  lg AS (SELECT scenario, log10(greatest(v, 1e-12)) AS l FROM ou), bb AS (SELECT scenario, l, min(l) OVER (PARTITION BY scenario) - 1e-9 AS lo, max(l) OVER (PARTITION BY scenario) + 1e-9 AS hi FROM lg),
  bn AS (SELECT scenario, least(19, floor((l - lo) / ((hi - lo) / 20))) AS bin, count(*) AS n FROM bb GROUP BY 1, 2), pp AS (SELECT scenario, n / sum(n) OVER (PARTITION BY scenario) AS p FROM bn), en AS (SELECT scenario, round(-sum(p * log2(p + 1e-12)), 6) AS denomination_entropy FROM pp GROUP BY 1)
  SELECT b.*, output_amount_gini, round_number_ratio, denomination_entropy FROM b LEFT JOIN g USING (scenario) LEFT JOIN en USING (scenario)"""


@query(_AMOUNT)
def features_amount(t: Tables):
    return _rounded(E.amount_features(t.entries, t.tx))


@query(""", per AS (SELECT scenario, txid, count(*) FILTER (side = 'in') AS i, count(*) FILTER (side = 'out') AS o, max(sat) FILTER (side = 'in') / 1e8 AS most, list(sat / 1e8) FILTER (side = 'out') AS vs FROM entry GROUP BY 1, 2),
  b AS (SELECT scenario, count(*) AS num_txns, avg(i) AS mi, avg(o) AS mo, round(avg(CASE WHEN most IS NOT NULL AND o > 0 THEN len(list_filter(vs, lambda v: len(list_filter(vs, lambda w: w <> v AND most - w > 0 AND abs(v - (most - w)) <= 0.01 * (most - w))) > 0)) / o END), 6) AS change_output_ratio FROM per GROUP BY 1),
  ad AS (SELECT scenario, address, max(CAST(side = 'in' AS INT)) AS i, max(CAST(side = 'out' AS INT)) AS o FROM entry GROUP BY 1, 2), u AS (SELECT scenario, CAST(sum(i) AS BIGINT) AS unique_input_addrs, CAST(sum(o) AS BIGINT) AS unique_output_addrs, sum(i * o) AS both_ FROM ad GROUP BY 1),
  sc AS (SELECT scenario, script_type, count(*) AS n FROM tx GROUP BY 1, 2), sp AS (SELECT *, n / sum(n) OVER (PARTITION BY scenario) AS p, row_number() OVER (PARTITION BY scenario ORDER BY n DESC, script_type) AS rn FROM sc),
  se AS (SELECT scenario, round(-sum(p * log2(p + 1e-12)), 6) AS script_type_entropy, max(CASE WHEN rn = 1 THEN CASE script_type WHEN 'P2PKH' THEN 0 WHEN 'P2SH' THEN 1 WHEN 'P2WPKH' THEN 2 ELSE 3 END END) AS script_type_mode FROM sp GROUP BY 1)
  SELECT b.scenario, num_txns, round(mi, 6) AS mean_num_inputs, round(mo, 6) AS mean_num_outputs, round(CASE WHEN mo > 0 THEN mi / mo ELSE 0 END, 6) AS io_count_ratio, change_output_ratio, unique_input_addrs, unique_output_addrs, round(unique_output_addrs / num_txns, 6) AS fanout_ratio, round(unique_input_addrs / num_txns, 6) AS fanin_ratio,
  round(CASE WHEN unique_output_addrs > 0 THEN both_ / unique_output_addrs ELSE 0 END, 6) AS address_reuse_ratio, script_type_entropy, script_type_mode FROM b JOIN u USING (scenario) JOIN se USING (scenario)""")
def features_structure(t: Tables):
    return _rounded(E.structure_features(t.entries, t.tx))


@query(""", d AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY scenario ORDER BY ts, txid)) / 1e6 AS d FROM tx), b AS (SELECT scenario, (max(epoch_us(ts)) - min(epoch_us(ts))) / 3.6e9 AS s, coalesce(avg(d), 0) AS m, coalesce(stddev_pop(d), 0) AS sd, coalesce(min(d), 0) AS mn FROM d GROUP BY 1),
  h AS (SELECT scenario, hour(ts) AS h, count(*) AS n FROM tx GROUP BY 1, 2), hp AS (SELECT scenario, n / sum(n) OVER (PARTITION BY scenario) AS p FROM h), he AS (SELECT scenario, round(-sum(p * log2(p + 1e-12)), 6) AS hour_of_day_entropy FROM hp GROUP BY 1),
  pd AS (SELECT scenario, avg((epoch_us(ts) - epoch_us(relay_ts)) / 1e3) AS pm, coalesce(stddev_samp((epoch_us(ts) - epoch_us(relay_ts)) / 1e3), 0) AS ps FROM tx JOIN telemetry USING (txid) GROUP BY 1)
  SELECT b.scenario, round(s, 6) AS time_span_hours, round(m, 6) AS inter_tx_delta_mean, round(sd, 6) AS inter_tx_delta_std, round(mn, 6) AS inter_tx_delta_min, round(CASE WHEN sd + m > 0 THEN (sd - m) / (sd + m) ELSE 0 END, 6) AS "burstiness_B", hour_of_day_entropy,
  round(pm, 6) AS prop_delta_mean, round(ps, 6) AS prop_delta_std, round(CASE WHEN pm <> 0 THEN ps / pm ELSE 0 END, 6) AS prop_delta_cv FROM b LEFT JOIN he USING (scenario) LEFT JOIN pd USING (scenario)""")
def features_temporal(t: Tables):
    return _rounded(E.temporal_features(t.tx, t.telemetry))


@query(""", r AS (SELECT * FROM tx JOIN telemetry USING (txid)), ac AS (SELECT scenario, max(n) / sum(n) AS c FROM (SELECT scenario, asn, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1), cc AS (SELECT scenario, max(n) / sum(n) AS c FROM (SELECT scenario, country, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1),
  ia AS (SELECT scenario, count(DISTINCT address) AS a FROM entry WHERE side = 'in' GROUP BY 1)
  SELECT r.scenario, round(avg(CAST(node_type IN ('tor_exit_node', 'vpn_proxy', 'bulletproof_host') AS INT)), 6) AS suspicious_infra_ratio, count(DISTINCT asn) AS unique_asn_count, count(DISTINCT country) AS unique_country_count, count(DISTINCT relay_ip) AS unique_ip_count, round(avg(CAST(relay_port <> 8333 AS INT)), 6) AS alt_port_ratio,
  count(DISTINCT user_agent) AS unique_user_agents, round(any_value(ac.c), 6) AS asn_concentration, round(any_value(cc.c), 6) AS country_concentration, round(CASE WHEN any_value(a) > 0 THEN count(DISTINCT relay_ip) / any_value(a) ELSE 0 END, 6) AS ip_to_addr_ratio FROM r LEFT JOIN ac USING (scenario) LEFT JOIN cc USING (scenario) LEFT JOIN ia USING (scenario) GROUP BY 1""")
def features_network(t: Tables):
    return _rounded(E.network_features(t.tx, t.telemetry, t.entries))


@query(""", e AS (SELECT DISTINCT scenario, CASE WHEN side = 'in' THEN 'w:' || address ELSE 'tx:' || txid END AS u, CASE WHEN side = 'in' THEN 'tx:' || txid ELSE 'w:' || address END AS v FROM entry), m AS (SELECT scenario, count(*) AS m FROM e GROUP BY 1), n AS (SELECT scenario, count(DISTINCT x) AS n FROM (SELECT scenario, u AS x FROM e UNION ALL SELECT scenario, v FROM e) GROUP BY 1),
  od AS (SELECT scenario, u, count(*) AS d FROM e GROUP BY 1, 2), idg AS (SELECT scenario, v, count(*) AS d FROM e GROUP BY 1, 2), mi AS (SELECT scenario, max(d) AS max_in_degree FROM idg WHERE starts_with(v, 'w:') GROUP BY 1), mo AS (SELECT scenario, max(d) AS max_out_degree FROM od WHERE starts_with(u, 'w:') GROUP BY 1),
  ass AS (SELECT e.scenario, round(CASE WHEN stddev_pop(od.d) > 0 AND stddev_pop(idg.d) > 0 THEN corr(od.d, idg.d) ELSE 0 END, 6) AS degree_assortativity FROM e JOIN od ON od.scenario = e.scenario AND od.u = e.u JOIN idg ON idg.scenario = e.scenario AND idg.v = e.v GROUP BY 1),
  pt AS (SELECT DISTINCT scenario, txid, address FROM entry), co AS (SELECT DISTINCT x.scenario, x.address AS a, y.address AS b FROM pt x JOIN pt y ON x.txid = y.txid AND x.address <> y.address), kk AS (SELECT scenario, a, count(*) AS k FROM co GROUP BY 1, 2),
  tr AS (SELECT p.scenario, p.a, count(*) / 2 AS t FROM co p JOIN co q ON q.scenario = p.scenario AND q.a = p.b JOIN co z ON z.scenario = p.scenario AND z.a = p.a AND z.b = q.b WHERE q.b <> p.a GROUP BY 1, 2),
  ws AS (SELECT DISTINCT scenario, address AS a FROM pt), cl AS (SELECT ws.scenario, round(avg(CASE WHEN coalesce(k, 0) > 1 THEN 2 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END), 6) AS avg_clustering FROM ws LEFT JOIN kk ON kk.scenario = ws.scenario AND kk.a = ws.a LEFT JOIN tr ON tr.scenario = ws.scenario AND tr.a = ws.a GROUP BY 1)
  SELECT m.scenario, round(m / n, 6) AS edge_to_node_ratio, round(CASE WHEN n > 1 THEN m / (n * (n - 1)) ELSE 0 END, 6) AS graph_density, max_in_degree, max_out_degree, degree_assortativity, avg_clustering FROM m JOIN n USING (scenario) LEFT JOIN mi USING (scenario) LEFT JOIN mo USING (scenario) LEFT JOIN ass USING (scenario) LEFT JOIN cl USING (scenario)""")
def features_graph(t: Tables):
    return _rounded(E.graph_features(t.entries))


_CHAIN_LENGTH = """e AS (SELECT DISTINCT scenario, CASE WHEN side = 'in' THEN 'w:' || address ELSE 'tx:' || txid END AS u, CASE WHEN side = 'in' THEN 'tx:' || txid ELSE 'w:' || address END AS v FROM entry), nd AS (SELECT scenario, u AS x FROM e UNION SELECT scenario, v FROM e), sz AS (SELECT scenario, count(*) AS n FROM nd GROUP BY 1),
  wk AS (SELECT scenario, x, 0 AS k FROM nd UNION SELECT wk.scenario, e.v, k + 1 FROM wk JOIN sz USING (scenario) JOIN e ON e.scenario = wk.scenario AND e.u = x WHERE k < n), lo AS (SELECT scenario, max(k) AS k, max(n) AS n FROM wk JOIN sz USING (scenario) GROUP BY 1),
  ds AS (SELECT scenario, u AS s, u AS x, 0 AS d FROM e WHERE scenario IN (SELECT scenario FROM lo WHERE k >= n) UNION SELECT ds.scenario, s, e.v, d + 1 FROM ds JOIN e ON e.scenario = ds.scenario AND e.u = x WHERE d < 15), df AS (SELECT scenario, max(d) AS d FROM (SELECT scenario, s, x, min(d) AS d FROM ds GROUP BY 1, 2, 3) GROUP BY 1)
  SELECT scenario, CAST(CASE WHEN k < n THEN k ELSE d END // 2 AS BIGINT) AS max_chain_length FROM lo LEFT JOIN df USING (scenario)"""


@query(f", {_CHAIN_LENGTH}")
def chain_length(t: Tables):
    return E.chain_length(t.entries)


def _joined() -> str:
    """The SQL of all feature groups, joined."""
    groups = {"fa": ORACLES["features_amount"], "fs": ORACLES["features_structure"], "ft": ORACLES["features_temporal"], "fn": ORACLES["features_network"], "fg": ORACLES["features_graph"], "fc": ORACLES["chain_length"]}
    parts = [f"{name} AS (WITH RECURSIVE {sql.removeprefix(DUCK).lstrip(', ')})" for name, sql in groups.items()]
    zero = ", ".join(f"coalesce({c}, 0) AS {c}" for c in E.GRAPH)
    return f", {', '.join(parts)} SELECT * REPLACE ({zero}) FROM fa LEFT JOIN fs USING (scenario) LEFT JOIN ft USING (scenario) LEFT JOIN fn USING (scenario) LEFT JOIN fg USING (scenario) LEFT JOIN fc USING (scenario)"


@query(_joined())
def features_full(t: Tables):
    out = E.all_features(t.entries, t.tx, t.telemetry)
    E.guard(out)
    return _rounded(out)


@query(ORACLES["features_network"].removeprefix(DUCK))
def feature_guard(t: Tables):
    """Features that passed the check for label columns; tables that hold one are refused by their schema, before any row is read."""
    features = E.network_features(t.tx, t.telemetry, t.entries)
    try:
        E.guard(features.join(t.labels, "scenario"))
    except ValueError:
        return _rounded(features.select("scenario", *E.guard(features)))
    raise AssertionError("a table with labels was let through")
