"""Queries over the ledger: aggregates, lookups, joins, graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chainsift.operators import aggregates as A
from chainsift.operators import graphs as G
from chainsift.operators import joins as J
from chainsift.operators import lookup as L
from chainsift.functions import columns as C

from .base import Tables, query

_DELAY = "(epoch_us(ts) - epoch_us(relay_ts)) / 1e6"
_TOR = "node_type = 'tor_exit_node'"
_SUSP = "node_type IN ('tor_exit_node', 'vpn_proxy', 'bulletproof_host')"
_BLOCKS = "b AS (SELECT user_id || '-' || CAST(props::JSON->>'k' AS INT) AS key, ts AS block_ts, value AS fact FROM events WHERE event_type = 'purchase')"
_RELAYS = "m AS (SELECT user_id || '-' || CAST(props::JSON->>'k' AS INT) AS key, ts AS relay_ts, '10.0.' || (user_id % 8) || '.' || (event_id % 16) AS relay_ip FROM events WHERE event_type IN ('view', 'click'))"


# scans


@query("SELECT txid, ts, scenario, side, idx, address, sat FROM entry")
def scan_ledger(t: Tables):
    return t.entries


@query("SELECT txid, relay_ts, relay_ip, relay_port, node_type, country, asn, user_agent FROM telemetry")
def scan_telemetry(t: Tables):
    return t.telemetry


@query("SELECT t.txid, t.ts, t.scenario, t.fee, t.script_type, relay_ts, relay_ip, relay_port, node_type, country, asn FROM tx t JOIN telemetry m ON t.txid = m.txid")
def merged_ledger(t: Tables):
    return J.merged(t.tx, t.telemetry)


@query("SELECT event_id, CAST(props::JSON->>'k' AS INT) AS k, value FROM events", bare=True)
def scan_json(t: Tables):
    return t.read("events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), "value")


# aggregates


@query("""SELECT address, CAST(coalesce(sum(sat) FILTER (side = 'in'), 0) AS BIGINT) AS sent_sat, CAST(coalesce(sum(sat) FILTER (side = 'out'), 0) AS BIGINT) AS received_sat,
  count(DISTINCT txid) AS tx_count, min(ts) AS first_seen, max(ts) AS last_seen, count(DISTINCT scenario) AS scenarios, count(DISTINCT txid) >= 10 AND sum(sat) > 100000000 AS is_exchange FROM entry GROUP BY address""")
def entity_profile(t: Tables):
    return A.entity_profile(t.entries, least_tx=10, least_sat=100_000_000)


@query(f"""SELECT * FROM (SELECT 'node_type' AS metric, node_type AS key, CAST(count(*) AS DOUBLE) AS value FROM telemetry GROUP BY 2)
  UNION ALL SELECT * FROM (SELECT 'asn', asn, CAST(count(*) AS DOUBLE) AS n FROM telemetry GROUP BY 2 ORDER BY n DESC, asn LIMIT 10)
  UNION ALL SELECT * FROM (SELECT 'country', country, CAST(count(*) AS DOUBLE) AS n FROM telemetry GROUP BY 2 ORDER BY n DESC, country LIMIT 10)
  UNION ALL SELECT 'script_type', script_type, CAST(count(*) AS DOUBLE) FROM tx JOIN telemetry USING (txid) GROUP BY 2
  UNION ALL SELECT 'latency_ms', node_type, round(avg({_DELAY} * 1000), 3) FROM tx JOIN telemetry USING (txid) GROUP BY 2""")
def telemetry_stats(t: Tables):
    return A.telemetry_stats(t.telemetry, t.tx)


@query(f"""SELECT e.*, fee_sat, ips, asns, delay_s, infra_risk_pct FROM
  (SELECT scenario, count(DISTINCT txid) AS tx_count, CAST(coalesce(sum(sat) FILTER (side = 'in'), 0) AS BIGINT) AS in_sat, CAST(coalesce(sum(sat) FILTER (side = 'out'), 0) AS BIGINT) AS out_sat, count(DISTINCT address) AS wallets, min(ts) AS first_ts, max(ts) AS last_ts FROM entry GROUP BY scenario) e
  LEFT JOIN (SELECT scenario, CAST(sum(fee) AS BIGINT) AS fee_sat, count(DISTINCT relay_ip) AS ips, count(DISTINCT asn) AS asns, round(avg({_DELAY}), 9) AS delay_s, round(100 * avg(CAST({_SUSP} AS INT)), 6) AS infra_risk_pct FROM tx JOIN telemetry USING (txid) GROUP BY scenario) USING (scenario)""")
def scenario_profile(t: Tables):
    return A.scenario_profile(t.entries, t.telemetry, t.tx)


@query("SELECT scenario, address, degree, CAST(rank AS INT) AS rank FROM (SELECT scenario, address, count(*) AS degree, row_number() OVER (PARTITION BY scenario ORDER BY count(*) DESC, address) AS rank FROM entry GROUP BY 1, 2) WHERE rank <= 5")
def scenario_hubs(t: Tables):
    return A.scenario_hubs(t.entries)


_BINS = f"d AS (SELECT {_TOR} AS is_tor, relay_ip, country, txid, scenario, {_DELAY} AS delay_s FROM tx JOIN telemetry USING (txid))"


@query(f""", {_BINS}, h AS (SELECT is_tor, floor(abs(delay_s) / 0.05) AS bin, count(*) AS n FROM d GROUP BY 1, 2), p AS (SELECT is_tor, n / sum(n) OVER (PARTITION BY is_tor) AS p FROM h),
  e AS (SELECT is_tor, round(abs(-sum(p * log2(p))), 4) AS entropy FROM p GROUP BY 1),
  cc AS (SELECT is_tor, country, count(*) AS n, row_number() OVER (PARTITION BY is_tor ORDER BY count(*) DESC, country) AS rn FROM d GROUP BY 1, 2), tc AS (SELECT is_tor, string_agg(country || ':' || n, ',' ORDER BY rn) AS top_countries FROM cc WHERE rn <= 5 GROUP BY 1)
  SELECT is_tor, count(*) AS tx_count, count(DISTINCT relay_ip) AS ips, round(avg(delay_s), 6) AS delay_s, any_value(entropy) AS entropy, any_value(top_countries) AS top_countries FROM d JOIN e USING (is_tor) JOIN tc USING (is_tor) GROUP BY is_tor""")
def tor_summary(t: Tables):
    return A.tor_summary(t.telemetry, t.tx)


@query(f""", {_BINS}, o AS (SELECT * FROM d WHERE is_tor), h AS (SELECT relay_ip, floor(abs(delay_s) / 0.05) AS bin, count(*) AS n FROM o GROUP BY 1, 2), p AS (SELECT relay_ip, n / sum(n) OVER (PARTITION BY relay_ip) AS p FROM h),
  e AS (SELECT relay_ip, round(abs(-sum(p * log2(p))), 4) AS entropy FROM p GROUP BY 1), s AS (SELECT relay_ip, count(*) - 1 AS same_ip FROM o GROUP BY 1), z AS (SELECT cluster, count(*) AS size FROM cluster GROUP BY 1),
  f AS (SELECT txid, size FROM entry JOIN cluster USING (address) JOIN z USING (cluster) WHERE side = 'in' AND idx = 0)
  SELECT o.txid, relay_ip, same_ip, entropy, coalesce(size, 0) AS cluster_size, round(CAST(0.3 + CASE WHEN same_ip > 0 THEN 0.4 ELSE 0 END + CASE WHEN entropy < 1.5 THEN 0.2 ELSE 0 END + CASE WHEN size > 1 THEN 0.1 ELSE 0 END AS DOUBLE), 2) AS evasion_score
  FROM o JOIN s USING (relay_ip) JOIN e USING (relay_ip) LEFT JOIN f ON o.txid = f.txid""")
def tor_profile(t: Tables):
    return A.tor_profile(t.telemetry, t.entries, t.tx, t.clusters)


@query(""", j AS (SELECT * FROM tx JOIN telemetry USING (txid) JOIN label USING (scenario))
  SELECT 'total' AS dimension, 'all' AS key, count(*) AS n FROM j UNION ALL SELECT 'split', split, count(*) FROM j GROUP BY 2 UNION ALL SELECT 'pattern_type', pattern_type, count(*) FROM j GROUP BY 2
  UNION ALL SELECT 'node_type', node_type, count(*) FROM j GROUP BY 2 UNION ALL SELECT 'country', country, count(*) FROM j GROUP BY 2 UNION ALL SELECT 'script_type', script_type, count(*) FROM j GROUP BY 2""")
def dataset_snapshot(t: Tables):
    return A.dataset_snapshot(t.tx, t.telemetry, t.labels)


def _timeline(bucket: str, step: str) -> str:
    return f""", k AS (SELECT CAST(date_trunc('{bucket}', t.ts) AS DATE) AS bucket, count(*) AS tx_count, CAST(coalesce(sum(in_sat), 0) AS BIGINT) AS in_sat FROM tx t LEFT JOIN sums s ON t.txid = s.txid GROUP BY 1),
  spine AS (SELECT CAST(unnest(generate_series(min(bucket), max(bucket), INTERVAL {step})) AS DATE) AS bucket FROM k)
  SELECT bucket, coalesce(tx_count, 0) AS tx_count, coalesce(in_sat, 0) AS in_sat FROM spine LEFT JOIN k USING (bucket)"""


@query(_timeline("day", "1 DAY"))
def timeline_day(t: Tables):
    return A.timeline(t.tx, t.per_tx, "day")


@query(_timeline("week", "7 DAY"))
def timeline_week(t: Tables):
    return A.timeline(t.tx, t.per_tx, "week")


@query(_timeline("month", "1 MONTH"))
def timeline_month(t: Tables):
    return A.timeline(t.tx, t.per_tx, "month")


@query("SELECT count(DISTINCT txid) AS transactions, count(DISTINCT scenario) AS scenarios, count(DISTINCT address) AS wallets FROM entry")
def store_stats(t: Tables):
    return A.store_stats(t.entries)


@query("SELECT coalesce(pattern_type, 'all') AS pattern_type, coalesce(split, 'all') AS split, count(*) AS scenarios FROM label GROUP BY CUBE (pattern_type, split)")
def pattern_split_cube(t: Tables):
    return A.pattern_split_cube(t.labels)


@query(""", n AS (SELECT scenario, count(*) AS n FROM tx GROUP BY 1) SELECT pattern_type, min(n) AS least, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.75) AS q3, max(n) AS most FROM n JOIN label USING (scenario) GROUP BY 1""")
def size_quartiles(t: Tables):
    return A.size_quartiles(t.tx, t.labels)


@query("SELECT split, count(*) AS scenarios, round(avg(is_illicit), 6) AS illicit_share FROM label GROUP BY 1")
def class_balance(t: Tables):
    return A.class_balance(t.labels)


@query("SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 10 THEN '2-10' ELSE '11+' END AS band, count(*) AS wallets, max(n) AS most FROM (SELECT address, count(*) AS n FROM entry GROUP BY 1) GROUP BY 1")
def wallet_reuse(t: Tables):
    return A.wallet_reuse(t.entries)


@query("SELECT side, min(n) AS least, quantile_cont(n, 0.5) AS median, max(n) AS most FROM (SELECT 'in' AS side, n_in AS n FROM sums UNION ALL SELECT 'out', n_out FROM sums) GROUP BY 1")
def io_size_stats(t: Tables):
    return A.io_size_stats(t.per_tx)


@query(""", up AS (SELECT txid, address FROM entry WHERE txid % 3 = 0), st AS (SELECT txid, address FROM entry WHERE txid % 2 = 0)
  SELECT CAST(count(*) AS BIGINT) AS input_rows, count(DISTINCT txid) AS unique_tx, CAST(count(*) - count(DISTINCT txid) AS BIGINT) AS repeated,
  count(DISTINCT txid) FILTER (txid IN (SELECT txid FROM st)) AS already_indexed, count(DISTINCT txid) FILTER (txid NOT IN (SELECT txid FROM st)) AS new_tx,
  count(DISTINCT address) FILTER (address NOT IN (SELECT address FROM st)) AS wallets_added FROM up""")
def upload_accounting(t: Tables):
    return A.upload_accounting(t.entries.where("txid % 3 = 0").select("txid", "address"), t.entries.where("txid % 2 = 0").select("txid", "address"))


@query("SELECT scenario, address FROM (SELECT scenario, address, row_number() OVER (PARTITION BY scenario ORDER BY count(*) DESC, address) AS rn FROM entry WHERE side = 'in' GROUP BY 1, 2) WHERE rn = 1")
def primary_wallet(t: Tables):
    return A.primary_wallet(t.entries)


@query("SELECT address, count(*) FILTER (side = 'in') AS sent, count(*) FILTER (side = 'out') AS received, count(*) AS degree FROM entry GROUP BY 1")
def wallet_degree(t: Tables):
    return A.wallet_degree(t.entries)


@query("""SELECT scenario, count(DISTINCT relay_ip) AS ips, count(DISTINCT asn) AS asns, string_agg(DISTINCT country, ',' ORDER BY country) AS countries, count(*) FILTER (node_type = 'tor_exit_node') AS n_tor_exit_node,
  count(*) FILTER (node_type = 'vpn_proxy') AS n_vpn_proxy, count(*) FILTER (node_type = 'bulletproof_host') AS n_bulletproof_host, count(*) FILTER (node_type = 'residential') AS n_residential FROM tx JOIN telemetry USING (txid) GROUP BY 1""")
def alert_telemetry(t: Tables):
    return A.alert_telemetry(t.telemetry, t.tx)


@query("""SELECT scenario, tx_count, in_sat, node_type FROM (SELECT scenario, count(DISTINCT txid) AS tx_count, CAST(coalesce(sum(sat) FILTER (side = 'in'), 0) AS BIGINT) AS in_sat FROM entry WHERE starts_with(CAST(scenario AS VARCHAR), '1') GROUP BY 1)
  LEFT JOIN (SELECT scenario, node_type FROM (SELECT scenario, node_type, row_number() OVER (PARTITION BY scenario ORDER BY count(*) DESC, node_type) AS rn FROM tx JOIN telemetry USING (txid) GROUP BY 1, 2) WHERE rn = 1) USING (scenario)
  ORDER BY in_sat DESC, scenario LIMIT 25 OFFSET 25""")
def scenario_list(t: Tables):
    return A.scenario_list(t.entries, t.telemetry, t.tx, "1", 2, 25)


@query("SELECT scenario, txid, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY scenario ORDER BY ts, txid)) / 1e6 AS delta_s FROM tx")
def inter_tx_delta(t: Tables):
    return A.inter_tx_delta(t.tx)


@query("SELECT o_orderkey AS txid, CASE WHEN r >= 0.9 THEN 'CRITICAL' WHEN r >= 0.75 THEN 'HIGH' WHEN r >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS severity, CASE WHEN r * 100 >= 70 THEN 'HIGH' WHEN r * 100 >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS anomaly, CASE WHEN r >= 0.75 THEN 'HIGH' WHEN r >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM (SELECT o_orderkey, (o_orderkey * 7919 % 1000) / 1000.0::DOUBLE AS r FROM orders)", bare=True)
def severity(t: Tables):
    r = t.read("orders").select(F.col("o_orderkey").alias("txid"), ((F.col("o_orderkey") * 7919 % 1000) / 1000.0).alias("r"))
    return r.select("txid", C.risk_severity(F.col("r")).alias("severity"), C.anomaly_label(F.col("r") * 100).alias("anomaly"), C.risk_level(F.col("r")).alias("level"))


# lookups


@query("""SELECT t.txid, t.ts, t.scenario, t.fee, t.script_type, coalesce(in_sat, 0) AS in_sat, coalesce(out_sat, 0) AS out_sat, coalesce(n_in, NULL) AS n_in, coalesce(relay_ip, 'unknown') AS relay_ip, coalesce(node_type, 'unknown') AS node_type, coalesce(country, '??') AS country, relay_ts IS NOT NULL AS observed
  FROM tx t LEFT JOIN sums s ON t.txid = s.txid LEFT JOIN telemetry m ON t.txid = m.txid""".replace("coalesce(n_in, NULL) AS n_in, ", ""))
def tx_lookup(t: Tables):
    return L.transactions(t.per_tx, t.tx, t.telemetry)


_TARGETS = "q(query) AS (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT 's' || c_custkey FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT 'c' || c_custkey || '_1' FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT '10.' || n_nationkey || '.' FROM nation UNION ALL SELECT 'nothing')"


def _targets(t: Tables):
    orders, customers = t.read("orders").where("o_orderkey % 10 = 0"), t.read("customer").where("c_custkey % 10 = 0")
    parts = [customers.select(F.concat(F.lit("s"), "c_custkey")), customers.select(F.concat(F.lit("c"), "c_custkey", F.lit("_1"))), t.read("nation").select(F.concat(F.lit("10."), "n_nationkey", F.lit("."))), t.spark.range(1).select(F.lit("nothing"))]
    out = orders.select(F.col("o_orderkey").cast("string").alias("query"))
    for p in parts:
        out = out.union(p)
    return out


@query(f""", {_TARGETS}, b AS (SELECT query, 'transaction' AS kind, query AS id, 0 AS p FROM q JOIN tx ON query = CAST(txid AS VARCHAR) UNION ALL SELECT query, 'wallet', address, 1 FROM q JOIN (SELECT DISTINCT address FROM entry) ON query = address
  UNION ALL SELECT query, 'scenario', 's' || scenario, 2 FROM q JOIN (SELECT DISTINCT scenario FROM tx) ON query = 's' || scenario
  UNION ALL SELECT query, 'network', id, 3 FROM q JOIN (SELECT DISTINCT relay_ip AS id FROM telemetry UNION SELECT DISTINCT asn FROM telemetry) ON contains(lower(id), query)),
  r AS (SELECT *, min(p) OVER (PARTITION BY query) AS best FROM b), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY id) AS rn FROM r WHERE p = best) SELECT query, kind, id FROM k WHERE rn <= 20""")
def search(t: Tables):
    return L.search(_targets(t), t.tx, t.entries, t.telemetry)


_RESOLVE = _TARGETS.replace("UNION ALL SELECT 'nothing')", "UNION ALL SELECT 'alias_' || c_custkey FROM customer WHERE c_custkey % 20 = 0 UNION ALL SELECT md5('tx' || o_orderkey) FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT 'test_s' || c_custkey || 'x' FROM customer WHERE c_custkey % 50 = 0 UNION ALL SELECT unnest(['nothing', 'peel_9', 'sample_mix', 'licit', 'S77', '77']))")
_PREFIXES = {"licit": "normal", "ransom": "ransomware", "peel": "peeling_chain", "mix": "mixing", "layer": "layering"}  # fixed values


@query(f""", {_RESOLVE}, qq AS (SELECT DISTINCT query FROM q), ids AS (SELECT DISTINCT scenario, 's' || scenario AS sid FROM tx), pre AS (SELECT p.prefix, min(scenario) AS scenario FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _PREFIXES.items())}) p(prefix, kind) JOIN label ON pattern_type = kind JOIN ids USING (scenario) GROUP BY 1),
  ex AS (SELECT query, scenario, 0 AS p FROM qq JOIN ids ON query = sid UNION ALL SELECT query, scenario, 1 FROM qq JOIN ids ON query = 'alias_' || scenario UNION ALL SELECT query, scenario, 2 FROM qq JOIN tx ON query = CAST(txid AS VARCHAR)
  UNION ALL SELECT query, scenario, 3 FROM qq JOIN tx ON query = md5('tx' || txid) UNION ALL SELECT query, scenario, 4 FROM qq JOIN (SELECT DISTINCT address, scenario FROM entry) ON query = address),
  lf AS (SELECT query, lower(query) AS low, regexp_replace(lower(query), 'sample_|live_|test_', '', 'g') AS clean FROM qq WHERE query NOT IN (SELECT query FROM ex)),
  b AS (SELECT * FROM ex UNION ALL SELECT query, scenario, 5 FROM lf JOIN ids ON contains(sid, low) OR contains(sid, clean) OR contains(low, sid) UNION ALL SELECT query, scenario, 6 FROM lf JOIN pre ON starts_with(low, prefix) OR starts_with(clean, prefix))
  SELECT query, arg_min(scenario, CAST(p AS BIGINT) * 1000000000 + scenario) AS scenario FROM b GROUP BY query""")
def resolve_scenario(t: Tables):
    customers, orders = t.read("customer"), t.read("orders")
    more = customers.where("c_custkey % 20 = 0").select(F.concat(F.lit("alias_"), "c_custkey").alias("query")).union(orders.where("o_orderkey % 50 = 0").select(F.md5(F.concat(F.lit("tx"), "o_orderkey"))))
    more = more.union(customers.where("c_custkey % 50 = 0").select(F.concat(F.lit("test_s"), "c_custkey", F.lit("x")))).union(t.spark.range(1).select(F.explode(F.array(*map(F.lit, ["peel_9", "sample_mix", "licit", "S77", "77"])))))
    aliases = t.tx.select(F.concat(F.lit("alias_"), "scenario").alias("alias"), "scenario").distinct()
    hashes = t.tx.select(F.md5(F.concat(F.lit("tx"), "txid")).alias("hash"), "txid")
    kinds = t.spark.createDataFrame(list(_PREFIXES.items()), "prefix string, pattern_type string")
    prefixes = t.labels.join(t.tx, "scenario", "left_semi").groupBy("pattern_type").agg(F.min("scenario").alias("scenario")).join(kinds, "pattern_type").select("prefix", "scenario")
    return L.resolve_scenario(_targets(t).union(more), t.tx, t.entries, aliases, hashes, prefixes)


@query(f""", {_TARGETS} SELECT query, txid FROM q JOIN tx ON query = CAST(txid AS VARCHAR) UNION ALL SELECT query, x FROM q JOIN (SELECT scenario, (min(row(ts, txid)))[2] AS x FROM tx GROUP BY 1) ON query = 's' || scenario""")
def resolve_tx(t: Tables):
    return L.resolve_transaction(_targets(t), t.tx)


@query(f"SELECT txid, ts, relay_ip, node_type, round({_DELAY} * 1000, 2) AS delta_ms FROM tx JOIN telemetry USING (txid) WHERE {_TOR} ORDER BY txid LIMIT 50 OFFSET 100")
def feed_page(t: Tables):
    return L.feed_page(t.tx, t.telemetry, 50, 100, tor_only=True)


@query("""SELECT e.txid, inputs, outputs, in_sat, cluster, round(fee / greatest(1000.0, in_sat) * 100, 6) AS fee_pct FROM
  (SELECT txid, count(*) FILTER (side = 'in') AS inputs, count(*) FILTER (side = 'out') AS outputs, CAST(coalesce(sum(sat) FILTER (side = 'in'), 0) AS BIGINT) AS in_sat FROM entry GROUP BY 1) e JOIN tx USING (txid)
  LEFT JOIN (SELECT txid, cluster FROM entry JOIN cluster USING (address) WHERE side = 'in' AND idx = 0) USING (txid)""")
def tx_flow(t: Tables):
    return L.transaction_flow(t.entries, t.tx, t.clusters)


# joins


def _key():
    return F.concat("user_id", F.lit("-"), F.from_json("props", "k int")["k"])


def _blocks(t: Tables):
    return t.read("events").where("event_type = 'purchase'").select(_key().alias("key"), F.col("ts").alias("block_ts"), F.col("value").alias("fact"))


def _relays(t: Tables):
    ip = F.concat(F.lit("10.0."), F.col("user_id") % 8, F.lit("."), F.col("event_id") % 16)
    return t.read("events").where("event_type in ('view', 'click')").select(_key().alias("key"), F.col("ts").alias("relay_ts"), ip.alias("relay_ip"))


_MATCH = f"""WITH {_BLOCKS}, {_RELAYS}, bb AS (SELECT key, min(block_ts) AS block_ts, count(DISTINCT row(block_ts, fact)) AS variants FROM b GROUP BY key),
  mm AS (SELECT key, (min(row(relay_ts, relay_ip)))[1] AS relay_ts, (min(row(relay_ts, relay_ip)))[2] AS relay_ip, count(*) AS relays FROM m GROUP BY key),
  j AS (SELECT coalesce(bb.key, mm.key) AS key, CASE WHEN relays IS NULL THEN 'LEDGER_ONLY' WHEN variants IS NULL THEN 'NETWORK_ONLY' WHEN variants > 1 THEN 'CONFLICTING' ELSE 'MATCHED' END AS status, block_ts, relay_ts, relay_ip, coalesce(relays, 0) AS relays,
    round((epoch_us(block_ts) - epoch_us(relay_ts)) / 1e6, 3) AS d FROM bb FULL JOIN mm ON bb.key = mm.key),
  c AS (SELECT key, status, block_ts, relay_ts, relay_ip, relays, CASE WHEN status = 'MATCHED' THEN d END AS delta_s, CASE WHEN status = 'MATCHED' THEN CASE WHEN d < 0 THEN 'CLOCK_ORDER_ISSUE' WHEN d > 864000 THEN 'OUTSIDE_WINDOW' ELSE 'WITHIN_WINDOW' END END AS timing FROM j)"""


@query(f"{_MATCH} SELECT * FROM c", bare=True)
def correlate(t: Tables):
    return J.correlate(_blocks(t), _relays(t), 864_000)


@query(f"""{_MATCH} SELECT count(*) FILTER (status = 'MATCHED') AS matched, count(*) FILTER (status = 'LEDGER_ONLY') AS ledger_only, count(*) FILTER (status = 'NETWORK_ONLY') AS network_only, count(*) FILTER (status = 'CONFLICTING') AS conflicting,
  count(*) FILTER (timing = 'CLOCK_ORDER_ISSUE') AS timing_issues, round(count(*) FILTER (status = 'MATCHED') / greatest(count(*) FILTER (status <> 'NETWORK_ONLY'), count(*) FILTER (status <> 'LEDGER_ONLY')), 4) AS match_rate,
  round(avg(delta_s) FILTER (timing = 'WITHIN_WINDOW'), 3) AS mean_delta_s FROM c""", bare=True)
def correlate_summary(t: Tables):
    return J.correlate_summary(J.correlate(_blocks(t), _relays(t), 864_000))


@query(f"WITH {_RELAYS} SELECT key, (min(row(relay_ts, relay_ip)))[1] AS relay_ts, (min(row(relay_ts, relay_ip)))[2] AS relay_ip, count(*) AS relays FROM m GROUP BY key", bare=True)
def earliest_relay(t: Tables):
    return J.earliest(_relays(t), "key")


@query(f"WITH {_RELAYS} SELECT key, string_agg(strftime(relay_ts, '%Y-%m-%d %H:%M:%S') || ' ' || relay_ip, ';' ORDER BY strftime(relay_ts, '%Y-%m-%d %H:%M:%S') || ' ' || relay_ip) AS observations FROM m GROUP BY key", bare=True)
def relay_observations(t: Tables):
    one = F.concat(F.date_format("relay_ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), "relay_ip")
    return _relays(t).groupBy("key").agg(F.array_join(F.array_sort(F.collect_list(one)), ";").alias("observations"))


@query(f"WITH {_BLOCKS} SELECT key, count(*) AS rows, count(DISTINCT row(block_ts, fact)) AS variants FROM b GROUP BY key HAVING count(DISTINCT row(block_ts, fact)) > 1", bare=True)
def conflicts(t: Tables):
    return J.conflicts(_blocks(t), "key", ["block_ts", "fact"])


@query("SELECT number, count(DISTINCT text) AS texts FROM (SELECT o_custkey % 700 AS number, 'h' || o_custkey AS text FROM orders) GROUP BY 1 HAVING count(DISTINCT text) > 1", bare=True)
def id_collisions(t: Tables):
    return J.id_collisions(t.read("orders").select((F.col("o_custkey") % 700).alias("number"), F.concat(F.lit("h"), "o_custkey").alias("text")), "number", "text")


@query("SELECT t.txid, t.scenario, coalesce(node_type, CASE WHEN t.txid % 3 = 0 THEN 'known' END) AS node_type FROM tx t LEFT JOIN (SELECT * FROM telemetry WHERE txid % 2 = 0) m ON t.txid = m.txid")
def enrich_overwrite(t: Tables):
    ledger = t.tx.select("txid", "scenario", F.when(F.col("txid") % 3 == 0, "known").otherwise("unknown").alias("node_type"))
    return J.enrich(ledger, t.telemetry.where("txid % 2 = 0"), "txid", {"node_type": "unknown"})


@query("SELECT txid FROM tx WHERE txid NOT IN (SELECT txid FROM telemetry)")
def orphans_anti(t: Tables):
    return t.tx.join(t.telemetry, "txid", "left_anti").select("txid")


@query("SELECT DISTINCT scenario FROM tx WHERE txid IN (SELECT txid FROM telemetry WHERE node_type = 'tor_exit_node')")
def keys_semi(t: Tables):
    return t.tx.join(t.telemetry.where("node_type = 'tor_exit_node'"), "txid", "left_semi").select("scenario").distinct()


@query("SELECT txid FROM tx INTERSECT SELECT txid FROM telemetry")
def keys_intersect(t: Tables):
    return t.tx.select("txid").intersect(t.telemetry.select("txid"))


@query("SELECT address FROM entry WHERE side = 'in' EXCEPT ALL SELECT address FROM entry WHERE side = 'out'")
def keys_except(t: Tables):
    return t.entries.where("side = 'in'").select("address").exceptAll(t.entries.where("side = 'out'").select("address"))


@query("SELECT src, dst, txid, amount, ts FROM transfer")
def wallet_projection(t: Tables):
    return t.transfers


@query(""", s AS (SELECT DISTINCT scenario AS set_id, asn AS member FROM tx JOIN telemetry USING (txid) WHERE node_type = 'tor_exit_node'), z AS (SELECT set_id, count(*) AS n FROM s GROUP BY 1),
  h AS (SELECT a.set_id AS a, b.set_id AS b, count(*) AS n FROM s a JOIN s b ON a.member = b.member AND a.set_id <> b.set_id GROUP BY 1, 2)
  SELECT set_id FROM z WHERE NOT EXISTS (SELECT 1 FROM h JOIN z y ON y.set_id = h.b WHERE h.a = z.set_id AND h.n = z.n AND (y.n > z.n OR y.n = z.n AND h.b < h.a))""")
def maximal_sets(t: Tables):
    rows = t.tx.join(t.telemetry.where("node_type = 'tor_exit_node'"), "txid").select(F.col("scenario").alias("set_id"), F.col("asn").alias("member"))
    return J.maximal_sets(rows)


@query("SELECT coalesce(b.txid, d.txid) AS txid, coalesce(nullif(d.note, ''), b.note) AS note, coalesce(d.fee, b.fee) AS fee FROM (SELECT txid, script_type AS note, fee FROM tx WHERE txid % 2 = 0) b FULL JOIN (SELECT txid, CASE WHEN txid % 5 = 0 THEN '' ELSE 'new' END AS note, CASE WHEN txid % 7 = 0 THEN NULL ELSE fee + 1 END AS fee FROM tx WHERE txid % 3 = 0) d ON b.txid = d.txid")
def upsert_merge(t: Tables):
    base = t.tx.where("txid % 2 = 0").select("txid", F.col("script_type").alias("note"), "fee")
    delta = t.tx.where("txid % 3 = 0").select("txid", F.when(F.col("txid") % 5 == 0, "").otherwise("new").alias("note"), F.when(F.col("txid") % 7 != 0, F.col("fee") + 1).alias("fee"))
    return J.upsert(base, delta, "txid")


@query("SELECT relay_ip, min(txid) AS txid, arg_min(node_type, txid) AS node_type FROM telemetry GROUP BY 1")
def ip_nodes(t: Tables):
    w = Window.partitionBy("relay_ip").orderBy("txid")
    return t.telemetry.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("relay_ip", "txid", "node_type")


@query(f"WITH {_BLOCKS} SELECT key, min(block_ts) AS block_ts FROM b GROUP BY key", bare=True)
def dedup_first(t: Tables):
    w = Window.partitionBy("key").orderBy("block_ts", "fact")
    return _blocks(t).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("key", "block_ts")


# graphs

_NODES = """SELECT DISTINCT 'w:' || address AS id, 'wallet' AS node_type, CAST(NULL AS VARCHAR) AS detail FROM entry UNION ALL SELECT 'tx:' || txid, 'transaction', script_type FROM tx UNION ALL SELECT 'ip:' || relay_ip, 'ip', arg_min(node_type, txid) FROM telemetry GROUP BY relay_ip"""
_EDGES = """SELECT 'w:' || address AS src, 'tx:' || txid AS dst, 'SENT' AS edge_type, sat AS amount FROM entry WHERE side = 'in' UNION ALL SELECT 'tx:' || txid, 'w:' || address, 'RECEIVED', sat FROM entry WHERE side = 'out' UNION ALL SELECT 'tx:' || txid, 'ip:' || relay_ip, 'BROADCAST', NULL FROM telemetry"""


@query(_NODES)
def graph_nodes(t: Tables):
    return G.nodes(t.entries, t.tx, t.telemetry)


@query(_EDGES)
def graph_edges(t: Tables):
    return G.edges(t.entries, t.telemetry)


@query(f"SELECT node_type AS kind, count(*) AS n FROM ({_NODES}) GROUP BY 1 UNION ALL SELECT edge_type, count(*) FROM ({_EDGES}) GROUP BY 1")
def graph_census(t: Tables):
    return G.census(G.nodes(t.entries, t.tx, t.telemetry), G.edges(t.entries, t.telemetry))


@query("SELECT txid, CASE WHEN coalesce(n_in, 0) = 0 AND coalesce(n_out, 0) = 0 THEN 'no entries' WHEN coalesce(n_in, 0) = 0 THEN 'no sender' ELSE 'no receiver' END AS reason FROM (SELECT t.txid, n_in, n_out FROM tx t LEFT JOIN sums s ON t.txid = s.txid) WHERE coalesce(n_in, 0) = 0 OR coalesce(n_out, 0) = 0")
def bipartite_violations(t: Tables):
    return G.bipartite_violations(t.tx, t.entries)


@query("SELECT address, cluster FROM cluster")
def entity_clusters(t: Tables):
    return t.clusters


@query(""", mi AS (SELECT txid FROM entry WHERE side = 'in' GROUP BY 1 HAVING count(*) > 1),
  p AS (SELECT cluster, count(DISTINCT address) AS size, CAST(coalesce(sum(sat) FILTER (side = 'in'), 0) AS BIGINT) AS sent_sat, CAST(coalesce(sum(sat) FILTER (side = 'out'), 0) AS BIGINT) AS received_sat, count(DISTINCT txid) AS tx_count,
  count(*) FILTER (side = 'in' AND txid IN (SELECT txid FROM mi)) AS multi_inputs, count(DISTINCT scenario) AS scenarios FROM entry JOIN cluster USING (address) GROUP BY cluster),
  rr AS (SELECT cluster, count(*) FILTER (side = 'in') AS in_rows, count(*) FILTER (side = 'out') AS out_rows FROM entry JOIN cluster USING (address) GROUP BY 1),
  v AS (SELECT *, ln(1 + size) AS v0, ln(1 + received_sat / 1e8) AS v1, ln(1 + sent_sat / 1e8) AS v2, multi_inputs / size AS v3, scenarios AS v4, ln(1 + in_rows) AS v5, ln(1 + out_rows) AS v6, abs(received_sat / 1e8 - sent_sat / 1e8) / greatest(0.0001, received_sat / 1e8 + sent_sat / 1e8) AS v7 FROM p JOIN rr USING (cluster)),
  w AS (SELECT *, sqrt(v0*v0+v1*v1+v2*v2+v3*v3+v4*v4+v5*v5+v6*v6+v7*v7) AS z FROM v)
  SELECT cluster, size, sent_sat, received_sat, tx_count, multi_inputs, scenarios, in_rows, out_rows, round(v0/z, 4) AS e0, round(v1/z, 4) AS e1, round(v2/z, 4) AS e2, round(v3/z, 4) AS e3, round(v4/z, 4) AS e4, round(v5/z, 4) AS e5, round(v6/z, 4) AS e6, round(v7/z, 4) AS e7 FROM w""")
def cluster_profile(t: Tables):
    return G.cluster_profile(t.entries, t.clusters)


@query(""", s AS (SELECT min(src) AS a FROM transfer), f AS (SELECT src, dst, min(txid) AS txid FROM transfer GROUP BY 1, 2),
  l1 AS (SELECT dst AS w, 1 AS hop FROM f, s WHERE src = a AND dst <> a GROUP BY 1), l2 AS (SELECT dst AS w, 2 AS hop FROM f JOIN l1 ON src = w, s WHERE dst NOT IN (SELECT w FROM l1) AND dst <> a GROUP BY 1),
  l3 AS (SELECT dst AS w, 3 AS hop FROM f JOIN l2 ON src = w, s WHERE dst NOT IN (SELECT w FROM l1) AND dst NOT IN (SELECT w FROM l2) AND dst <> a GROUP BY 1),
  t AS (SELECT max(w) AS z FROM l3), p3 AS (SELECT 3 AS hop, (min(row(f.txid, src)))[2] AS from_wallet, (min(row(f.txid, src)))[1] AS txid, any_value(z) AS to_wallet FROM f JOIN l2 ON src = w, t WHERE dst = z),
  p2 AS (SELECT 2 AS hop, (min(row(f.txid, src)))[2] AS from_wallet, (min(row(f.txid, src)))[1] AS txid, any_value(p3.from_wallet) AS to_wallet FROM f JOIN l1 ON src = w, p3 WHERE dst = p3.from_wallet),
  p1 AS (SELECT 1 AS hop, any_value(a) AS from_wallet, min(f.txid) AS txid, any_value(p2.from_wallet) AS to_wallet FROM f, s, p2 WHERE src = a AND dst = p2.from_wallet)
  SELECT CAST(hop AS INT) AS hop, from_wallet, to_wallet, txid FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) WHERE from_wallet IS NOT NULL""")
def trace_path(t: Tables):
    """From the lowest sending wallet to the highest wallet that lies three hops away."""
    steps = G._cut(t.transfers, "transfers")
    a = steps.agg(F.min("src")).first()[0]
    level = steps.where(F.col("src") == a).select(F.col("dst").alias("w")).distinct()
    seen = level.unionByName(t.spark.createDataFrame([(a,)], "w string"))
    for _ in range(2):
        level = steps.join(level, F.col("src") == F.col("w")).select(F.col("dst").alias("w")).distinct().join(seen, "w", "left_anti")
        seen = seen.unionByName(level)
    return G.trace_path(steps, a, level.agg(F.max("w")).first()[0] or "")


@query(""", am AS (SELECT txid, side, address, sum(sat) AS sat FROM entry GROUP BY 1, 2, 3), tt AS (SELECT txid, side, sum(sat) AS total FROM am GROUP BY 1, 2 HAVING sum(sat) > 0), sh AS (SELECT am.*, sat / total AS share FROM am JOIN tt USING (txid, side)),
  fl AS (SELECT i.address AS src, o.address AS dst, max(CAST(i.share AS DOUBLE) * CAST(o.share AS DOUBLE)) AS share FROM sh i JOIN sh o ON i.txid = o.txid AND i.side = 'in' AND o.side = 'out' WHERE i.address <> o.address GROUP BY 1, 2),
  wk AS (SELECT DISTINCT address, 0 AS hop, CAST(1.0 AS DOUBLE) AS taint FROM entry WHERE side = 'in' AND scenario % 100 = 0 UNION SELECT dst, hop + 1, round(taint * share * 0.85, 4) FROM wk JOIN fl ON src = address WHERE hop < 5 AND round(taint * share * 0.85, 4) >= 0.01)
  SELECT address, CAST(-x[2] AS INT) AS hop, x[1] AS taint FROM (SELECT address, max(row(taint, -hop)) AS x FROM wk GROUP BY 1)""")
def taint_hops(t: Tables):
    seeds = t.entries.where("side = 'in' and scenario % 100 = 0").select("address").distinct()
    return G.taint(t.entries, seeds, max_depth=5)


_CO = """w AS (SELECT txid FROM sums WHERE n_in >= 3 AND n_out >= 3), o AS (SELECT DISTINCT txid, address FROM entry JOIN w USING (txid) WHERE side = 'in'), co AS (SELECT x.address AS a, y.address AS b, count(*) AS weight FROM o x JOIN o y ON x.txid = y.txid AND x.address < y.address GROUP BY 1, 2)"""


@query(f", {_CO} SELECT * FROM co")
def coparticipation(t: Tables):
    return G.coparticipation(t.entries)


@query(f""", {_CO}, sy AS (SELECT a, b FROM co UNION SELECT b, a FROM co), rr AS (SELECT DISTINCT a AS node, a AS root FROM sy UNION SELECT b, root FROM rr JOIN sy ON a = node), m AS (SELECT node, min(root) AS community FROM rr GROUP BY 1),
  s AS (SELECT community, count(*) AS size FROM m GROUP BY 1), i AS (SELECT x.community, count(*) AS inner_edges FROM co JOIN m x ON x.node = a GROUP BY 1)
  , ds AS (SELECT a AS x, a AS y, 0 AS d FROM sy UNION SELECT x, b, d + 1 FROM ds JOIN sy ON sy.a = y WHERE d < (SELECT max(size) FROM s)), dm AS (SELECT community, max(d) AS diameter FROM (SELECT x, y, min(d) AS d FROM ds GROUP BY 1, 2) JOIN m ON node = x GROUP BY 1)
  SELECT community, size, inner_edges, 0::BIGINT AS outer_edges, CAST(diameter AS INT) AS diameter, round(2 * inner_edges / (size * (size - 1)), 6) AS density, 0.0::DOUBLE AS external_ratio FROM s JOIN i USING (community) JOIN dm USING (community)""")
def community_metrics(t: Tables):
    pairs = G.coparticipation(t.entries)
    members = G.connected(pairs).select("node", F.col("label").alias("community"))
    return G.community_metrics(pairs, members)


def _reach(source: str) -> str:
    return f""", hub AS (SELECT address FROM entry GROUP BY 1 HAVING count(*) > 40), st AS (SELECT DISTINCT src, dst, ts FROM transfer WHERE dst NOT IN (SELECT address FROM hub)), so AS (SELECT src AS source, dst AS recipient, min(ts) AS t0 FROM transfer {source} GROUP BY 1, 2),
  r0 AS (SELECT source, recipient, t0, recipient AS sink, t0 AS e FROM so), r1 AS (SELECT source, recipient, t0, dst AS sink, min(ts) AS e FROM r0 JOIN st ON sink = src WHERE ts BETWEEN e AND least(e + INTERVAL 100 DAY, t0 + INTERVAL 100 DAY) AND dst <> source AND dst <> recipient GROUP BY 1, 2, 3, 4),
  r2 AS (SELECT r1.source, r1.recipient, r1.t0, dst AS sink, min(ts) AS e FROM r1 JOIN st ON r1.sink = src WHERE ts BETWEEN e AND least(e + INTERVAL 100 DAY, t0 + INTERVAL 100 DAY) AND dst <> source AND dst <> recipient AND NOT EXISTS (SELECT 1 FROM r1 k WHERE k.source = r1.source AND k.recipient = r1.recipient AND k.sink = dst) GROUP BY 1, 2, 3, 4)"""


_THIRD = """, r3 AS (SELECT r2.source, r2.recipient, r2.t0, dst AS sink, min(ts) AS e FROM r2 JOIN st ON r2.sink = src WHERE ts BETWEEN e AND least(e + INTERVAL 100 DAY, t0 + INTERVAL 100 DAY) AND dst <> source AND dst <> recipient
  AND NOT EXISTS (SELECT 1 FROM r1 k WHERE k.source = r2.source AND k.recipient = r2.recipient AND k.sink = dst) AND NOT EXISTS (SELECT 1 FROM r2 k WHERE k.source = r2.source AND k.recipient = r2.recipient AND k.sink = dst) GROUP BY 1, 2, 3, 4)"""


@query(f"{_reach('')}{_THIRD} SELECT source, recipient, sink, CAST(1 AS INT) AS hop, e AS end_ts FROM r1 UNION ALL SELECT source, recipient, sink, 2, e FROM r2 UNION ALL SELECT source, recipient, sink, 3, e FROM r3")
def reach_bfs(t: Tables):
    hubs = t.entries.groupBy("address").agg(F.count("*").alias("n")).where("n > 40").select("address")
    return G.reach(t.transfers, hubs, 3, 100 * 86400, 100 * 86400)
