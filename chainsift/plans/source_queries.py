"""Queries of sources and sinks: files are written to the shared folder from the tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from chainsift.operators import detect as D
from chainsift.operators import graphs as G
from chainsift.operators import joins as J
from chainsift.sources import uploads as U
from chainsift.sources.ledger import DUCK

from .base import ORACLES, Tables, query
from .detector_queries import _PEEL, _hop


def _folder(t: Tables) -> str:
    return f"{G.shared_folder(t.spark)}/chainsift/files-{uuid.uuid4().hex}"


@query("SELECT CAST(txid AS VARCHAR) AS txid, relay_ip, asn, country AS country_code, node_type FROM telemetry")
def scan_csv_upload(t: Tables):
    at = _folder(t)
    t.telemetry.select(F.col("txid").alias("Transaction ID"), F.col("relay_ip").alias("Source-IP"), F.col("asn").alias("AS number"), F.col("country").alias("Country"), F.col("node_type").alias("infrastructure")).write.option("header", True).csv(f"{at}/up.csv")
    return U.read_upload(t.spark, f"{at}/up.csv").select("txid", "relay_ip", "asn", "country_code", "node_type")


@query("SELECT CAST(txid AS VARCHAR) AS txid, relay_ip, node_type FROM telemetry")
def scan_xml(t: Tables):
    at = _folder(t)
    t.telemetry.select(F.col("txid").alias("txid"), F.col("relay_ip").alias("ip"), F.col("node_type").alias("node")).write.format("xml").option("rowTag", "transaction").option("rootTag", "transactions").save(f"{at}/up.xml")
    return U.read_upload(t.spark, f"{at}/up.xml").select(F.col("txid").cast("string").alias("txid"), "relay_ip", "node_type")


@query("SELECT txid, relay_ip AS relay_ip, asn, coalesce(CASE WHEN txid % 2 = 0 THEN country END, 'none') AS country_code FROM telemetry")
def alias_headers(t: Tables):
    odd = t.telemetry.select(F.col("txid").alias("TxID"), F.col("relay_ip").alias("IP Address"), F.col("asn").alias("as_number"), F.when(F.col("txid") % 2 == 0, F.col("country")).alias("Country"), F.lit("none").alias("country-code"))
    return U.canonical(odd)


@query("SELECT txid, ts AS timestamp, fee AS fee_btc, scenario AS scenario_id FROM tx")
def field_map(t: Tables):
    return U.FieldMap({"txid": "txid", "timestamp": "ts", "fee_btc": "fee", "scenario_id": "scenario"}).apply(t.tx)


@query("SELECT 'w:' || address AS id, 'wallet' AS node_type FROM entry GROUP BY address UNION ALL SELECT 'tx:' || txid, 'transaction' FROM tx UNION ALL SELECT DISTINCT 'ip:' || relay_ip, 'ip' FROM telemetry")
def export_nodes(t: Tables):
    at = _folder(t)
    _export(t, at)
    return t.spark.read.schema("id string, node_type string").json(f"{at}/nodes")


def _export(t: Tables, at: str) -> None:
    """Entries and relays are read by several files: written once."""
    entries, telemetry = G._cut(t.entries, "entries"), G._cut(t.telemetry, "telemetry")
    U.export_graph(G.nodes(entries, t.tx, telemetry), G.edges(entries, telemetry), D.evidence_mixing(entries, 2, 0.4), at)


def _exported(t: Tables) -> str:
    at = _folder(t)
    _export(t, at)
    return at


@query("""SELECT 'w:' || address AS src, 'tx:' || txid AS dst, 'SENT' AS edge_type, sat AS amount FROM entry WHERE side = 'in' UNION ALL SELECT 'tx:' || txid, 'w:' || address, 'RECEIVED', sat FROM entry WHERE side = 'out' UNION ALL SELECT 'tx:' || txid, 'ip:' || relay_ip, 'BROADCAST', NULL FROM telemetry""")
def export_edges(t: Tables):
    return t.spark.read.schema("src string, dst string, edge_type string, amount long").json(f"{_exported(t)}/edges")


@query(""", per AS (SELECT scenario, txid, count(*) FILTER (side = 'in') AS i, count(*) FILTER (side = 'out') AS o, round(stddev_pop(sat) FILTER (side = 'out') / avg(sat) FILTER (side = 'out'), 6) AS cv FROM entry GROUP BY 1, 2), c AS (SELECT scenario, min(row(cv, txid)) AS x FROM per WHERE i = o AND i >= 2 AND cv <= 0.4 GROUP BY 1)
  SELECT scenario, x[2] AS txid, x[1] AS cv, (SELECT count(DISTINCT address) FROM entry) + (SELECT count(*) FROM tx) + (SELECT count(DISTINCT relay_ip) FROM telemetry) AS nodes, (SELECT count(*) FROM entry) + (SELECT count(*) FROM telemetry) AS edges FROM c""")
def export_candidates(t: Tables):
    """Candidates and the metadata beside them, as written and read again."""
    at = _exported(t)
    found = t.spark.read.schema("scenario long, txid long, cv double").json(f"{at}/candidates")
    return found.crossJoin(F.broadcast(t.spark.read.schema("nodes long, edges long").json(f"{at}/metadata")))  # one row of counts


@query("SELECT txid, script_type FROM tx WHERE txid % 4 = 1 ORDER BY txid")
def load_custom(t: Tables):
    return t.tx.withColumn("is_custom", F.col("txid") % 4 == 1).where("is_custom").orderBy("txid").select("txid", "script_type")


@query("SELECT o_orderpriority AS file, 'csv' AS type, count(*) AS records, string_agg(DISTINCT CAST(o_custkey AS VARCHAR), ',' ORDER BY CAST(o_custkey AS VARCHAR)) AS scenarios FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1", bare=True)
def ingest_audit(t: Tables):
    """Two uploads, each with its row appended to the audit table."""
    at = _folder(t)
    for name in ("1-URGENT", "2-HIGH"):  # one append an upload
        U.append_audit(t.spark, t.read("orders").where(F.col("o_orderpriority") == name).select(F.col("o_orderkey").alias("txid"), F.col("o_custkey").alias("scenario_id")), name, "csv", f"{at}/audit")
    return t.spark.read.parquet(f"{at}/audit")


@query("SELECT scenario, txid, ts FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY ts DESC, txid DESC) AS rn FROM tx) WHERE rn = 1")
def latest_report(t: Tables):
    w = Window.partitionBy("scenario").orderBy(F.desc("ts"), F.desc("txid"))
    return t.tx.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("scenario", "txid", "ts")


@query("""SELECT scenario AS case_id, count(*) AS reports, arg_max(txid, epoch_us(ts) * 1000 + txid % 1000) AS txid, max(ts) AS updated, CASE WHEN max(txid % 2) = 1 THEN 'REVIEWED' ELSE 'OPEN' END AS status FROM tx GROUP BY 1""")
def case_table(t: Tables):
    """The case table after two rounds of reports: new cases are added, known ones take over what the later round says."""
    key = F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("txid") % 1000
    cases = lambda tx: tx.groupBy(F.col("scenario").alias("case_id")).agg(F.count("*").alias("reports"), F.max(F.struct(key.alias("k"), "txid")).alias("x"), F.max("ts").alias("updated"), F.max(F.col("txid") % 2).alias("odd"))
    first, both = cases(t.tx.where("txid % 2 = 0")), cases(t.tx)
    flat = lambda df: df.select("case_id", "reports", "x.txid", "updated", F.when(F.col("odd") == 1, "REVIEWED").otherwise("OPEN").alias("status"))
    at = _folder(t)
    flat(first).write.parquet(f"{at}/cases")
    changed = both.where("odd = 1")  # cases that the second round reports on
    return J.upsert(t.spark.read.parquet(f"{at}/cases"), flat(changed), "case_id")


@query("SELECT scenario AS candidate, count(*) AS hops, arg_min(txid, epoch_us(ts) * 1000 + txid % 1000) AS origin, arg_max(txid, epoch_us(ts) * 1000 + txid % 1000) AS sink FROM tx GROUP BY 1")
def candidate_index(t: Tables):
    key = F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("txid") % 1000
    return t.tx.groupBy(F.col("scenario").alias("candidate")).agg(F.count("*").alias("hops"), F.min_by("txid", key).alias("origin"), F.max_by("txid", key).alias("sink"))


def _found(t: Tables, entries):
    """Candidates of all typologies, each with its own columns."""
    return [
        D.evidence_peel(entries, 8 * 180 * 86400, least_hops=2).select(F.lit("peeling_chain").alias("kind"), "scenario", "hops"),
        D.evidence_layering(entries, 2000 * 86400, 0.3, 2).select(F.lit("layering").alias("kind"), "scenario", "share"),
        D.evidence_mixing(entries, 2, 0.4).select(F.lit("mixing").alias("kind"), "scenario", "cv"),
        D.evidence_ransomware(entries, t.telemetry, t.tx, most_outputs=4, fan_out=5).select(F.lit("ransomware").alias("kind"), "scenario", "suspicious", "aggregated"),
    ]


_KINDS = {"peeling_chain": ("ev_peel", "hops"), "layering": ("ev_layering", "share"), "mixing": ("ev_mixing", "cv"), "ransomware": ("ev_ransomware", "suspicious, aggregated")}


def _handoff() -> str:
    ctes = ", ".join(f"h_{k} AS (WITH RECURSIVE {ORACLES[q].removeprefix(DUCK).lstrip(', ')})" for k, (q, _) in _KINDS.items())
    return f", {ctes} " + " UNION ALL BY NAME ".join(f"SELECT '{k}' AS kind, scenario, {cols} FROM h_{k}" for k, (_, cols) in _KINDS.items())


@query(_handoff())
def ml_handoff(t: Tables):
    """Written as CSV files for the models, and read again."""
    at = _folder(t)
    U.ml_handoff(_found(t, t.entries)).write.option("header", True).csv(f"{at}/handoff")
    return t.spark.read.option("header", True).schema("kind string, scenario long, hops long, share double, cv double, suspicious long, aggregated long").csv(f"{at}/handoff")


def _traced(entries, transfers):
    """(kind, candidate, txid) of peeling chains and of layering: all transactions of a chain, all sends of a source."""
    peel = D.peel_members(entries, 180 * 86400, least_hops=2).select(F.lit("peeling_chain").alias("kind"), F.concat(F.lit("p"), "chain").alias("candidate"), "txid")
    layered = D.layering_candidates(entries, transfers, 5, 0.3, 400 * 86400, 40, 2)
    sends = entries.where("side = 'in'").select(F.col("address").alias("source"), "txid").distinct()
    layering = layered.join(sends, "source").select(F.lit("layering").alias("kind"), F.concat_ws(">", "source", "sink").alias("candidate"), "txid")
    return peel.unionByName(layering)


_CANDIDATES = f""", pc AS (WITH RECURSIVE {ORACLES['peel_chains'].removeprefix(DUCK).lstrip(', ')}), {_PEEL}, {_hop()}, cm AS (SELECT chain, chain AS txid FROM pc UNION ALL SELECT chain, next FROM cm JOIN hop USING (txid)),
  lc AS (WITH RECURSIVE {ORACLES['layering_candidates'].removeprefix(DUCK).lstrip(', ')}), cand AS (SELECT 'peeling_chain' AS kind, 'p' || chain AS candidate, txid FROM cm UNION SELECT 'layering', source || '>' || sink, txid FROM lc JOIN entry ON address = source AND side = 'in')"""


@query(f"""{_CANDIDATES}, vr AS (SELECT kind, candidate, c.txid, scenario, pattern_type, coalesce(pattern_type = kind, false) AS hit FROM cand c LEFT JOIN (SELECT txid, scenario, pattern_type FROM tx JOIN label USING (scenario)) l USING (txid)),
  vp AS (SELECT kind, candidate, count(*) FILTER (hit) >= 0.3 * count(*) AS tp FROM vr GROUP BY 1, 2), vk AS (SELECT kind, count(*) AS candidates, count(*) FILTER (tp) AS true_positives FROM vp GROUP BY 1), vf AS (SELECT kind, count(DISTINCT scenario) AS found FROM vr JOIN vp USING (kind, candidate) WHERE hit AND tp GROUP BY 1),
  vs AS (SELECT pattern_type AS kind, count(DISTINCT scenario) AS scenarios FROM tx JOIN label USING (scenario) GROUP BY 1), vm AS (SELECT *, true_positives / candidates AS pr, CASE WHEN coalesce(scenarios, 0) > 0 THEN coalesce(found, 0) / scenarios ELSE 0 END AS re FROM vk LEFT JOIN vf USING (kind) LEFT JOIN vs USING (kind))
  SELECT kind, candidates, true_positives, candidates - true_positives AS false_positives, coalesce(found, 0) AS found, coalesce(scenarios, 0) AS scenarios, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1 FROM vm""")
def validate_traced(t: Tables):
    """Chains and layering against the labels, which are independent of the money's ways in these tables: a third of the transactions will do here."""
    entries, transfers = G._cut(t.entries, "entries"), G._cut(t.transfers, "transfers")
    return D.validate_candidates(_traced(entries, transfers), t.tx.join(t.labels, "scenario").select("txid", "scenario", "pattern_type"), 0.3)


@query()
def detect_all(t: Tables):
    """The detector pipeline: chains, layering and mixing over one table of entries; candidates with their relays; the graph, the candidates and
    the models' flat table as files; precision, recall and F1 by kind beside each candidate."""
    at = _folder(t)
    entries, transfers = G._cut(t.entries, "entries"), G._cut(t.transfers, "transfers")
    pairs = G._cut(G.coparticipation(entries), "co")
    sends = entries.where("side = 'in'").select(F.col("address").alias("node"), "txid").distinct()
    members = D.louvain(pairs)
    mixed = D.mixing_candidates(entries, members, pairs, 3, 0.3, 0.4, 1.0, 4000 * 86400)
    mixing = mixed.select("community").join(members, "community").join(sends, "node").select(F.lit("mixing").alias("kind"), F.col("community").alias("candidate"), "txid").distinct()
    found = G._cut(_traced(entries, transfers).unionByName(mixing), "candidates")
    U.export_graph(G.nodes(entries, t.tx, t.telemetry), G.edges(entries, t.telemetry), found, at)
    size = found.groupBy("kind", "candidate").agg(F.count_distinct("txid").alias("members"))
    network = D.candidate_network(found.select("candidate", "txid"), t.telemetry).drop("member_ips")
    shape = mixed.select(F.lit("mixing").alias("kind"), F.col("community").alias("candidate"), "density", "external_ratio", "cv")
    size.join(network, "candidate").join(shape, ["kind", "candidate"], "left").write.option("header", True).csv(f"{at}/handoff")
    checked = D.validate_candidates(found, t.tx.join(t.labels, "scenario").select("txid", "scenario", "pattern_type"))
    return size.join(network, "candidate").join(F.broadcast(checked.select("kind", "precision", "recall", "f1")), "kind")  # a row for each kind
