"""Data-quality checks: one row a check, and record validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainsift.functions.columns import suspicious


def _check(df: DataFrame, name: str, actual: Column, expected: Column) -> DataFrame:
    return df.agg(actual.cast("double").alias("actual"), expected.cast("double").alias("expected")).select(F.lit(name).alias("check"), "expected", "actual", (F.col("expected") == F.col("actual")).alias("passed"))


def suite(tx: DataFrame, telemetry: DataFrame, entries: DataFrame, labels: DataFrame, band: tuple[float, float] = (0.1, 0.9), apart: float = 0.05) -> DataFrame:
    """(check, expected, actual, passed): counts, keys, duplicates, order in time, nulls, sides, categories, coverage, splits, balance."""
    zero = F.lit(0)
    both = tx.join(telemetry, "txid")
    known = F.col("node_type").isin("residential", "datacenter", "mobile", "tor_exit_node", "vpn_proxy", "bulletproof_host")
    sides = entries.groupBy("txid").agg(F.count_if(F.col("side") == "in").alias("i"), F.count_if(F.col("side") == "out").alias("o"))
    labelled = tx.join(labels, "scenario", "left")
    classes = both.join(labels, "scenario")
    of = lambda k: F.count_distinct(F.when(F.col("is_illicit") == k, F.col("asn")))
    shared = classes.groupBy("asn").agg(F.count_distinct("is_illicit").alias("k"))
    rate = lambda s: F.avg(F.when(F.col("split") == s, F.col("is_illicit")))
    flag = lambda c: c.cast("int")
    years = classes.groupBy("is_illicit").agg(F.min(F.year("ts")).alias("a"), F.max(F.year("ts")).alias("b"))
    checks = [
        _check(tx.join(telemetry.select("txid", F.lit(1).alias("t")), "txid", "full_outer"), "rows_match", F.count("t"), F.count("ts")),
        _check(tx.join(telemetry, "txid", "left_anti"), "ledger_orphans", F.count("*"), zero),
        _check(telemetry.join(tx, "txid", "left_anti"), "network_orphans", F.count("*"), zero),
        _check(tx, "duplicate_ids", F.count("*") - F.count_distinct("txid"), zero),
        _check(both, "relayed_before_block", F.count_if(F.col("relay_ts") >= F.col("ts")), zero),
        _check(both, "nulls", F.sum(reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in ("ts", "relay_ts", "relay_ip", "node_type", "country", "asn")])), zero),
        _check(sides, "empty_sides", F.count_if((F.col("i") == 0) | (F.col("o") == 0)), zero),
        _check(telemetry, "unknown_categories", F.count_if(~known), zero),
        _check(telemetry, "categories_present", F.count_distinct("node_type"), F.lit(6)),
        _check(labelled, "unlabelled", F.count_if(F.col("pattern_type").isNull()), zero),
        _check(shared, "asns_of_both_classes", F.count_if(F.col("k") == 2), F.count("*")),
        _check(years, "classes_span_years", F.min(F.col("b") - F.col("a")), F.max(F.col("b") - F.col("a"))),
        _check(labels.groupBy("scenario").agg(F.count_distinct("split").alias("n")), "scenarios_in_two_splits", F.count_if(F.col("n") > 1), zero),
        _check(labels, "splits_apart", flag(F.abs(rate("train") - rate("test")) > apart), zero),
        _check(labels, "class_out_of_band", flag((F.avg("is_illicit") < band[0]) | (F.avg("is_illicit") > band[1])), zero),
    ]
    return reduce(DataFrame.unionByName, checks)


def accounting(per_tx: DataFrame, tx: DataFrame, tolerance: int = 2) -> DataFrame:
    """One row: transactions with both sides, violations of in = out + fee beyond ``tolerance`` satoshi, the largest residual."""
    rows = per_tx.where("n_in > 0 and n_out > 0").join(tx.select("txid", "fee"), "txid").withColumn("residual", F.abs(F.col("in_sat") - F.col("out_sat") - F.col("fee")))
    return rows.agg(F.count("*").alias("checked"), F.count_if(F.col("residual") > tolerance).alias("violations"), F.max("residual").alias("most"))


def hard_negatives(entries: DataFrame, labels: DataFrame, least_rows: int = 50) -> DataFrame:
    """Licit wallets of at least so many input rows."""
    licit = labels.where("is_illicit = 0").select("scenario")
    return entries.where("side = 'in'").join(licit, "scenario", "left_semi").groupBy("address").agg(F.count("*").alias("rows")).where(F.col("rows") >= least_rows)


def block_concentration(tx: DataFrame, labels: DataFrame, block: int = 500) -> DataFrame:
    """(blocks, most): largest share of illicit rows in blocks of ``block`` rows by txid; a block must start before the last ``block`` rows.

    Ranks are global without one task that sorts all: ids are dealt into ranges, and each row's rank is its
    rank in its range after the counts of the ranges before."""
    rows = tx.join(labels, "scenario").select("txid", "is_illicit")
    n = rows.agg(F.count("*").alias("n"), F.min("txid").alias("a"), F.max("txid").alias("b"))
    parts = 256
    part = F.least(F.lit(parts - 1), F.floor((F.col("txid") - F.col("a")) * parts / F.greatest(F.lit(1), F.col("b") - F.col("a"))))
    dealt = rows.crossJoin(F.broadcast(n)).withColumn("part", part)
    counts = dealt.groupBy("part").agg(F.count("*").alias("c"))
    before = counts.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = dealt.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("txid")) - 1)
    blocks = ranked.withColumn("b", F.floor(F.col("rank") / block)).where(F.col("b") * block < F.col("n") - block).groupBy("b").agg(F.avg("is_illicit").alias("share"))
    return blocks.agg(F.count("*").alias("blocks"), F.round(F.max("share"), 6).alias("most"))


def monetary(entries: DataFrame, tx: DataFrame) -> DataFrame:
    per = entries.agg(F.min("sat").alias("least"), F.max("sat").alias("most"), F.count_if(F.col("sat") < 0).alias("negative"), F.count_if(F.col("sat") == 0).alias("zero"))
    fee = tx.agg(F.min("fee").alias("fee_least"), F.max("fee").alias("fee_most"), F.round(F.avg("fee"), 6).alias("fee_mean"))
    return per.crossJoin(F.broadcast(fee))  # one row each


def satoshi(per_tx: DataFrame, tx: DataFrame) -> DataFrame:
    """Counts of broken invariants of whole satoshi."""
    rows = per_tx.join(tx.select("txid", "fee"), "txid")
    gap = F.col("in_sat") - F.col("out_sat") - F.col("fee")
    return rows.agg(
        F.count_if(F.col("n_in") == 0).alias("no_input"), F.count_if(F.col("n_out") == 0).alias("no_output"), F.count_if(F.col("fee") < 0).alias("negative_fee"), F.count_if(F.col("in_sat") <= 0).alias("empty_input"),
        F.count_if(F.col("out_sat") > F.col("in_sat")).alias("creates_money"), F.count_if(F.abs(gap) > 2).alias("unbalanced"),
    )


def correlation_rate(tx: DataFrame, telemetry: DataFrame) -> DataFrame:
    both = tx.select("txid").distinct().withColumn("t", F.lit(1)).join(telemetry.select("txid").distinct().withColumn("m", F.lit(1)), "txid", "full_outer")
    return both.agg(F.count("t").alias("ledger"), F.count("m").alias("network"), F.count_if(F.col("t").isNotNull() & F.col("m").isNotNull()).alias("matched"), F.round(F.count_if(F.col("t").isNotNull() & F.col("m").isNotNull()) / F.greatest(F.count("t"), F.count("m")), 6).alias("rate"))


def homogeneity(rows: DataFrame) -> DataFrame:
    """Scenarios of (scenario, pattern_type) with several labels."""
    return rows.groupBy("scenario").agg(F.count_distinct("pattern_type").alias("labels")).where("labels > 1")


def validate_records(tx: DataFrame, per_tx: DataFrame, telemetry: DataFrame, entries: DataFrame) -> DataFrame:
    """(txid, valid, reasons, warnings): hard rejects and soft warnings of each record, comma-joined."""
    overlap = entries.groupBy("txid", "address").agg(F.count_distinct("side").alias("k")).where("k = 2").select("txid").distinct().withColumn("both_sides", F.lit(True))
    rows = tx.join(per_tx.drop("ts", "scenario"), "txid", "left").join(telemetry.select("txid", "relay_ts"), "txid", "left").join(overlap, "txid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    why = F.array_compact(F.array(F.when(F.col("ts").isNull(), "no_timestamp"), F.when(F.col("relay_ts").isNull(), "no_relay_time"), F.when(zero("n_in"), "empty_inputs"), F.when(zero("n_out"), "empty_outputs"), F.when(F.col("fee") < 0, "negative_fee")))
    warn = F.array_compact(F.array(F.when(F.col("both_sides"), "address_on_both_sides"), F.when(F.abs(F.col("in_sat") - F.col("out_sat") - F.col("fee")) > 100, "unbalanced")))
    return rows.select("txid", (F.size(why) == 0).alias("valid"), F.array_join(why, ",").alias("reasons"), F.array_join(warn, ",").alias("warnings"))


def reject_rate(validated: DataFrame) -> DataFrame:
    return validated.agg(F.count("*").alias("records"), F.count_if(~F.col("valid")).alias("rejected"), F.round(F.avg((~F.col("valid")).cast("double")), 6).alias("rate"))


def feature_gate(features: DataFrame, scenarios: DataFrame, names: list[str]) -> DataFrame:
    """One row: rows, scenarios, null cells."""
    nulls = reduce(lambda a, b: a + b, [F.col(n).isNull().cast("int") for n in names])
    a = features.agg(F.count("*").alias("rows"), F.sum(nulls).alias("null_cells"))
    return a.crossJoin(F.broadcast(scenarios.agg(F.count_distinct("scenario").alias("scenarios"))))  # one row each


def non_finite(long: DataFrame) -> DataFrame:
    """Rows (key, feature, value) whose value is null, NaN or infinite."""
    v = F.col("value")
    return long.where(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def report_consistency(rows: DataFrame) -> DataFrame:
    """(class, support, confusion_sum, consistent) of (actual, predicted)."""
    n = rows.groupBy("actual", "predicted").agg(F.count("*").alias("n")).groupBy("actual").agg(F.sum("n").alias("confusion_sum"))
    return rows.groupBy("actual").agg(F.count("*").alias("support")).join(n, "actual").select(F.col("actual").alias("class"), "support", "confusion_sum", (F.col("support") == F.col("confusion_sum")).alias("consistent"))
