"""Metrics of scores against labels, and audits of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import ranked


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def _ranked(scored: DataFrame) -> DataFrame:
    """One row a distinct score, from the highest: positives and negatives at it and down to it.

    Rows are counted for each score first; the running sums then go over distinct scores, dealt into ranges."""
    per = scored.groupBy("score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    return ranked(per, [F.desc("score")], {"tp": "p", "fp": "n"}).drop("rank")


def binary_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row for (score, label): confusion, accuracy, balanced accuracy, precision, recall, F1, ROC-AUC (ties half) and average precision."""
    hit = F.col("score") >= threshold
    c = scored.agg(
        F.count_if(hit & (F.col("label") == 1)).alias("tp"), F.count_if(hit & (F.col("label") == 0)).alias("fp"), F.count_if(~hit & (F.col("label") == 1)).alias("fn"), F.count_if(~hit & (F.col("label") == 0)).alias("tn")
    )
    r = _ranked(scored)
    curve = r.agg(F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)).alias("area"), F.sum("p").alias("pos"), F.sum("n").alias("neg"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))
    out = c.crossJoin(F.broadcast(curve))  # one row each
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    precision, recall = _div(tp, tp + fp), _div(tp, tp + fn)
    return out.select(
        "tp", "fp", "fn", "tn", F.round(_div(tp + tn, tp + fp + fn + tn), 6).alias("accuracy"), F.round((recall + _div(tn, tn + fp)) / 2, 6).alias("balanced_accuracy"), F.round(precision, 6).alias("precision"),
        F.round(recall, 6).alias("recall"), F.round(_div(2 * tp, 2 * tp + fp + fn), 6).alias("f1"), F.round(_div(F.col("area"), F.col("pos") * F.col("neg")), 6).alias("roc_auc"), F.round(_div(F.col("ap"), F.col("pos")), 6).alias("pr_auc"),
    )


def multiclass_metrics(rows: DataFrame) -> DataFrame:
    """One row a class of (actual, predicted), one for 'macro' and one for 'weighted'."""
    n = rows.groupBy("actual", "predicted").agg(F.count("*").alias("n"))
    long = n.select(F.explode(F.array(F.struct(F.col("actual").alias("c"), F.col("n").alias("a"), F.lit(0).cast("long").alias("p")), F.struct(F.col("predicted").alias("c"), F.lit(0).cast("long").alias("a"), F.col("n").alias("p")))).alias("x"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("t"))
    per = long.groupBy(F.col("x.c").alias("class")).agg(F.sum("x.a").alias("support"), F.sum("x.p").alias("claimed"), (F.sum("t") / 2).alias("t"))
    per = per.withColumn("precision", _div(F.col("t"), F.col("claimed"))).withColumn("recall", _div(F.col("t"), F.col("support"))).withColumn("f1", _div(2 * F.col("t"), F.col("claimed") + F.col("support")))
    s = F.sum("support")
    macro = per.agg(F.lit("macro").alias("class"), s.alias("support"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    weighted = per.agg(F.lit("weighted").alias("class"), s.alias("support"), *[(F.sum(F.col(c) * F.col("support")) / s).alias(c) for c in ("precision", "recall", "f1")])
    out = per.select("class", "support", "precision", "recall", "f1").unionByName(macro).unionByName(weighted)
    return out.select("class", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """One row: expected calibration error over equal bins (the last leaves out 1.0) and the Brier score."""
    inside = scored.where("score >= 0 and score < 1").groupBy(F.floor(F.col("score") * bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("s"), F.avg("label").alias("l"))
    total = scored.agg(F.count("*").alias("all"), F.avg(F.pow(F.col("score") - F.col("label"), F.lit(2))).alias("brier"))
    ece = inside.agg(F.sum(F.col("n") * F.abs(F.col("s") - F.col("l"))).alias("e"))
    return total.crossJoin(F.broadcast(ece)).select(F.round(F.col("e") / F.col("all"), 6).alias("ece"), F.round("brier", 6).alias("brier"))


def error_analysis(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(kind, pattern_type, n, mean, least, most) of false positives and negatives of (scenario, score, label, pattern_type)."""
    kind = F.when((F.col("score") >= threshold) & (F.col("label") == 0), "FP").when((F.col("score") < threshold) & (F.col("label") == 1), "FN")
    rows = scored.withColumn("kind", kind).where("kind is not null")
    return rows.groupBy("kind", "pattern_type").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.min("score").alias("least"), F.max("score").alias("most"))


def anomaly_normalize(raw: DataFrame) -> DataFrame:
    """``score`` from 0 to 100 of ``raw`` between its least and largest value; 0 where these are equal."""
    ends = raw.agg(F.min("raw").alias("a"), F.max("raw").alias("b"))
    span = F.col("b") - F.col("a")
    score = F.when(span > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), (F.col("raw") - F.col("a")) / span * 100))).otherwise(0.0)
    return raw.crossJoin(F.broadcast(ends)).withColumn("score", F.round(score, 6)).drop("a", "b")


def anomaly_report(scored: DataFrame) -> DataFrame:
    q = lambda p: F.round(F.percentile("score", F.lit(p)), 6)
    return scored.groupBy("pattern_type").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), q(0.5).alias("p50"), q(0.9).alias("p90"), F.round(F.avg((F.col("score") >= 70).cast("double")), 6).alias("high_share"))


def unpivot(features: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    return features.select(*keep, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(keep, names, "feature", "value")


def leakage(features: DataFrame, names: list[str], label: str = "label") -> DataFrame:
    """(feature, r, flagged): Pearson correlation of each feature with the label; flagged over 0.9."""
    long = unpivot(features, names, [label]).where("value is not null")
    spread = F.stddev_pop("value") * F.stddev_pop(label)
    r = F.coalesce(F.covar_pop("value", label) / F.nullif(spread, F.lit(0.0)), F.lit(0.0))
    return long.groupBy("feature").agg(F.round(r, 6).alias("r")).withColumn("flagged", F.abs("r") > 0.9)


def class_feature_stats(features: DataFrame, names: list[str], label: str) -> DataFrame:
    long = unpivot(features, names, [label])
    return long.groupBy("feature", label).agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("std"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"))


def size_audit(sizes: DataFrame) -> DataFrame:
    """One row for (size, label): overlap of the two histograms, Kolmogorov-Smirnov distance, rank AUC and average precision of the size
    alone, mutual information (nats) of the label and the size's band, and whether each stays within its gate.

    The windows go over distinct sizes."""
    bounds = (5, 7, 16, 41, 81, 151, 301)  # fixed values
    band = sum((F.col("size") >= b).cast("int") for b in bounds)
    cells = sizes.groupBy(band.alias("band"), "label").agg(F.count("*").alias("c"))
    of = lambda *by: F.sum("c").over(Window.partitionBy(*by))
    info = cells.select((F.col("c") / of(F.lit(0)) * F.log(F.col("c") * of(F.lit(0)) / (of("band") * of("label")))).alias("part")).agg(F.round(F.sum("part"), 6).alias("mutual_information"))
    per = sizes.groupBy("size").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    all_, up = Window.partitionBy(F.lit(0)), Window.orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    per = per.select("size", "p", "n", F.sum("p").over(all_).alias("all_p"), F.sum("n").over(all_).alias("all_n"), F.sum("p").over(up).alias("cp"), F.sum("n").over(up).alias("cn"))
    above_p, above_n = F.col("all_p") - F.col("cp") + F.col("p"), F.col("all_n") - F.col("cn") + F.col("n")
    out = per.agg(
        F.round(F.sum(F.least(F.col("p") / F.col("all_p"), F.col("n") / F.col("all_n"))), 6).alias("overlap"), F.round(F.max(F.abs(F.col("cp") / F.col("all_p") - F.col("cn") / F.col("all_n"))), 6).alias("ks"),
        F.round(F.sum(F.col("p") * (F.col("cn") - F.col("n") / 2)) / F.max(F.col("all_p") * F.col("all_n")), 6).alias("auc"),
        F.round(F.sum(F.col("p") * above_p / (above_p + above_n)) / F.max("all_p"), 6).alias("pr_auc"),
    ).crossJoin(F.broadcast(info))  # fmt: skip  # one row each
    gates = (("overlap", ">=", 0.75), ("ks", "<=", 0.2), ("auc", "<=", 0.58), ("pr_auc", "<=", 0.45), ("mutual_information", "<=", 0.01))  # fixed values
    return out.select("*", *[F.expr(f"{c} {op} {v}").alias(f"{c}_ok") for c, op, v in gates])


def score_gate(scores: DataFrame, typologies: list[str], threshold: float = 0.5, confident: float = 0.6) -> DataFrame:
    """Adds verdict, typology and confidence: illicit from ``threshold`` on; a typology only then, ambiguous between the best two below ``confident``."""
    pairs = F.array_sort(F.array(*[F.struct((-F.col(f"p_{t}")).alias("p"), F.lit(t).alias("t")) for t in typologies]))
    first, second = pairs[0], pairs[1]
    name = F.when(-first["p"] >= confident, first["t"]).otherwise(F.concat(F.lit("ambiguous between "), first["t"], F.lit(" and "), second["t"]))
    illicit = F.col("p_illicit") >= threshold
    return scores.withColumn("verdict", F.when(illicit, "illicit").otherwise("licit")).withColumn("typology", F.when(illicit, name)).withColumn("confidence", F.when(illicit, F.round(-first["p"], 6)))


def transaction_risk(tx: DataFrame, scores: DataFrame) -> DataFrame:
    return tx.join(scores, "scenario", "left").select("txid", "scenario", F.coalesce("risk", F.lit(0.0)).alias("risk"))


def rank_alerts(alerts: DataFrame, limit: int | None = None) -> DataFrame:
    """Alerts by risk, then anomaly, then scenario, with their place among all alerts; with ``limit`` the first ones only."""
    order = [F.desc("risk"), F.desc("anomaly"), F.asc("scenario")]
    return ranked(alerts if limit is None else alerts.orderBy(*order).limit(limit), order)
