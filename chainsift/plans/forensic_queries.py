"""Queries of scenario graphs, paths, records, parsers and digests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chainsift.functions import columns as C
from chainsift.operators import detect as D
from chainsift.operators import graphs as G
from chainsift.sources import uploads as U
from chainsift.sources.ledger import DUCK

from .base import ORACLES, Tables, query
from .detector_queries import _fragments
from .ledger_queries import _targets
from .model_queries import _FEAT, _PROF, _profiles
from .source_queries import _folder


@query(""", wal AS (SELECT address, count(*) AS tx_count, count(*) FILTER (side = 'in') AS ins, count(*) FILTER (side = 'out') AS outs, min(ts) AS first_seen, max(ts) AS last_seen FROM entry GROUP BY 1), ow AS (SELECT scenario, address, max(CAST(side = 'in' AS INT)) AS spends FROM entry GROUP BY 1, 2),
  wn AS (SELECT scenario, 'w:' || address AS id, 'wallet' AS node_type, tx_count, first_seen, last_seen, cluster, CASE WHEN spends = 1 THEN ins ELSE outs END >= 12 AS is_exchange, CAST(NULL AS BIGINT) AS amount_sat FROM ow JOIN wal USING (address) LEFT JOIN cluster USING (address)),
  fi AS (SELECT txid, address FROM entry WHERE side = 'in' AND idx = 0)
  SELECT *, CASE WHEN is_exchange THEN 'LICIT_EXCHANGE' ELSE 'S' || scenario END AS tag FROM wn
  UNION ALL SELECT t.scenario, 'tx:' || t.txid, 'transaction', 1, t.ts, t.ts, cluster, false, coalesce(out_sat, 0), CASE WHEN pattern_type <> 'normal' THEN upper(pattern_type) END FROM tx t LEFT JOIN sums s ON s.txid = t.txid LEFT JOIN fi ON fi.txid = t.txid LEFT JOIN cluster c ON c.address = fi.address LEFT JOIN label l ON l.scenario = t.scenario
  UNION ALL SELECT scenario, 'ip:' || relay_ip, 'ip', count(*), min(relay_ts), max(relay_ts), NULL, false, NULL, arg_min(node_type, txid) FROM telemetry JOIN tx USING (txid) GROUP BY scenario, relay_ip""")
def scenario_graph(t: Tables):
    return G.scenario_graph(t.entries, t.tx, t.telemetry, None, t.labels, 12)


@query(""", s AS (SELECT min(src) AS a FROM transfer), f AS (SELECT DISTINCT src, dst FROM transfer WHERE src <> dst), l1 AS (SELECT DISTINCT dst AS w FROM f, s WHERE src = a), z AS (SELECT max(dst) AS z FROM f JOIN l1 ON src = w, s WHERE dst <> a),
  p AS (SELECT a AS w, [a] AS path, 0 AS hops FROM s UNION ALL SELECT f.dst, list_append(path, f.dst), hops + 1 FROM p JOIN f ON f.src = p.w CROSS JOIN z WHERE hops < 3 AND p.w <> z AND NOT list_contains(path, f.dst))
  SELECT hops, array_to_string(path, '>') AS path FROM p, z WHERE w = z""")
def simple_paths(t: Tables):
    """From the lowest sending wallet to the highest one two hops away, by at most three transfers."""
    steps = G._cut(t.transfers.select("src", "dst").where("src <> dst").distinct(), "transfers")
    a = steps.agg(F.min("src")).first()[0]
    near = steps.where(F.col("src") == a).select(F.col("dst").alias("w"))
    z = steps.join(near, F.col("src") == F.col("w")).where(F.col("dst") != a).agg(F.max("dst")).first()[0]
    return G.simple_paths(steps, a or "", z or "", 3)


_EVIDENCE = f"ev AS (WITH RECURSIVE {ORACLES['alert_evidence'].removeprefix(DUCK).lstrip(', ')})"


@query(f""", {_EVIDENCE}, il AS (SELECT scenario, pattern_type FROM label WHERE is_illicit = 1), tr AS (SELECT scenario, count(*) AS tx_count, string_agg(CAST(txid AS VARCHAR), ',' ORDER BY ts, txid) AS txids FROM tx GROUP BY 1),
  mo AS (SELECT scenario, coalesce(sum(sat) FILTER (side = 'in'), 0) AS in_sat, coalesce(sum(sat) FILTER (side = 'out'), 0) AS out_sat FROM entry GROUP BY 1), inf AS (SELECT scenario, string_agg(node_type || ':' || n, ',' ORDER BY node_type) AS infrastructure FROM (SELECT scenario, node_type, count(*) AS n FROM tx JOIN telemetry USING (txid) GROUP BY 1, 2) GROUP BY 1),
  tl AS (SELECT scenario, string_agg(DISTINCT relay_ip, ',' ORDER BY relay_ip) AS ips, string_agg(DISTINCT asn, ',' ORDER BY asn) AS asns, string_agg(DISTINCT country, ',' ORDER BY country) AS countries FROM tx JOIN telemetry USING (txid) GROUP BY 1)
  SELECT 'alert_' || scenario AS candidate, scenario, pattern_type, tx_count, txids, CAST(in_sat AS BIGINT) AS in_sat, CAST(out_sat AS BIGINT) AS out_sat, ips, asns, countries, infrastructure, coalesce(evidence, '') AS evidence FROM il JOIN tr USING (scenario) LEFT JOIN mo USING (scenario) LEFT JOIN tl USING (scenario) LEFT JOIN inf USING (scenario) LEFT JOIN ev USING (scenario)""")
def alert_record(t: Tables):
    """The evidence record of each flagged scenario."""
    flagged = t.labels.where("is_illicit = 1").select("scenario", "pattern_type")
    return D.alert_records(flagged, t.entries, t.tx, t.telemetry, D.attach_evidence(flagged, _fragments(t)).select("scenario", "evidence"))


_ZS = """zs AS (SELECT scenario, feature, value, avg(value) OVER (PARTITION BY feature) AS m, stddev_pop(value) OVER (PARTITION BY feature) AS sd FROM lo), zz AS (SELECT scenario, feature, round(CASE WHEN sd > 0 THEN (value - m) / sd ELSE 0 END, 6) AS effect FROM zs),
  rk AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY abs(effect) DESC, feature) AS rn FROM zz)"""
_PHRASE = " ".join(f"WHEN '{f}' THEN '{C.readable(f)}'" for f in _FEAT)


@query(f", {_PROF.replace('SELECT CAST(tx_count AS DOUBLE)', 'SELECT scenario, CAST(tx_count AS DOUBLE)')}, {_ZS}, tx3 AS (SELECT scenario, string_agg(CASE feature {_PHRASE} END || CASE WHEN effect > 0 THEN ' above usual' WHEN effect < 0 THEN ' below usual' ELSE ' as usual' END, '; ' ORDER BY rn) AS said FROM rk WHERE rn <= 3 GROUP BY 1) SELECT scenario, pattern_type || ': ' || said AS text FROM tx3 JOIN label USING (scenario)")
def explanation_texts(t: Tables):
    """Each scenario's typology and its three most unusual features (by standard score) in words."""
    return D.explanations(_profiles(t), _FEAT, kind="pattern_type")


@query("SELECT scenario, sha256(string_agg(txid || '|' || fee || '|' || script_type, chr(10) ORDER BY txid || '|' || fee || '|' || script_type)) AS digest FROM tx GROUP BY 1")
def content_digest(t: Tables):
    return t.tx.groupBy("scenario").agg(C.digest(F.concat_ws("|", "txid", "fee", "script_type")).alias("digest"))


@query(", k AS (SELECT scenario, address, row_number() OVER (PARTITION BY scenario ORDER BY address) AS rn, count(*) OVER (PARTITION BY scenario) AS n FROM (SELECT DISTINCT scenario, address FROM entry)) SELECT scenario, any_value(n) AS wallets, string_agg(address, ',' ORDER BY address) AS preview FROM k WHERE rn <= 20 GROUP BY 1")
def scenario_preview(t: Tables):
    """The number of wallets of a scenario and the first 20 of them: ranked first, so that no long list is made."""
    own = t.entries.select("scenario", "address").distinct()
    w = Window.partitionBy("scenario")
    first = own.select("*", F.row_number().over(w.orderBy("address")).alias("rn"), F.count("*").over(w).alias("n")).where("rn <= 20")
    return first.groupBy("scenario").agg(F.first("n").alias("wallets"), F.array_join(F.array_sort(F.collect_list("address")), ",").alias("preview"))


@query("SELECT txid, 'in' AS side, count(*) AS n, string_agg(address, ';' ORDER BY idx) AS addresses FROM entry WHERE side = 'in' GROUP BY 1")
def strict_arrays(t: Tables):
    """Address lists as JSON arrays of text, parsed strictly."""
    lists = t.entries.where("side = 'in'").groupBy("txid").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("idx", "address"))), lambda x: x["address"])).alias("text"))
    parsed = lists.select("txid", C.parse_list_strict(F.col("text")).alias("a"))
    return parsed.select("txid", F.lit("in").alias("side"), F.size("a").cast("long").alias("n"), F.array_join("a", ";").alias("addresses"))


@query("SELECT o_orderkey AS txid, CASE WHEN o_orderkey % 5 < 4 THEN date_trunc('second', o_orderdate) END AS ts FROM orders", bare=True)
def parse_times(t: Tables):
    """Times as epoch numbers, ISO text with and without a zone, and text that is no time."""
    at = F.date_trunc("second", F.col("o_orderdate").cast("timestamp"))
    kind = F.col("o_orderkey") % 5
    text = F.when(kind == 0, F.unix_seconds(at).cast("string")).when(kind == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(kind == 2, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).when(kind == 3, F.date_format(at + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss'+02:00'")).otherwise("soon")
    return t.read("orders").select(F.col("o_orderkey").alias("txid"), C.parse_time(text).cast("timestamp_ntz").alias("ts"))


@query("SELECT txid, round(sum(sat / 1e5), 6) AS coins FROM entry WHERE sat > 21000 GROUP BY 1")
def satoshi_rescue(t: Tables):
    """Lists of amounts, in satoshi for even transactions and in coins for odd ones, all read as coins."""
    per = t.entries.where("sat > 21000").groupBy("txid").agg(F.collect_list(F.col("sat") * 1000).alias("s"))
    mixed = F.transform("s", lambda x: F.when(F.col("txid") % 2 == 0, x.cast("double")).otherwise(x / 1e8))
    return per.select("txid", F.round(F.aggregate(C.from_satoshi(mixed), F.lit(0.0), lambda a, x: a + x), 6).alias("coins"))


@query("SELECT address, CAST('0x' || substr(md5(address), 1, 8) AS BIGINT) % 900000000 + 100000000 AS id FROM (SELECT DISTINCT address FROM entry)")
def stable_ids(t: Tables):
    return t.entries.select("address").distinct().select("address", C.stable_id(F.col("address")).alias("id"))


@query("SELECT CAST(txid AS VARCHAR) AS txid, relay_ip, asn FROM telemetry")
def scan_unknown_suffix(t: Tables):
    """A folder of JSON lines whose name says nothing of its format."""
    at = _folder(t)
    t.telemetry.select(F.col("txid").cast("string").alias("TxID"), F.col("relay_ip").alias("ip"), F.col("asn").alias("AS-number")).write.json(f"{at}/upload")
    return U.read_upload(t.spark, f"{at}/upload").select("txid", "relay_ip", "asn")
