"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of lexicon words (a short general list, and word stems learned from the
labelled sample), how near these stand to a second person, capitals, punctuation, and how often words
are obfuscated (digits or marks inside, letters drawn out, letters spaced apart). MLlib fits the trees
and the isotonic curve on the sample; all texts are then scored where they lie.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, drop_table, write_table

#: General insults, as fixed values.
INSULTS = frozenset(
    "arse ass asshole bastard bitch bullshit clown clowns coward crap cretin cunt damn degenerate despicable dickhead dimwit disgrace disgusting dumb dumbass fag filth filthy "
    "fool freak fuck fucking garbage gross hate hideous idiot idiotic idiots imbecile jerk kill liar loser losers lunatic moron moronic morons nasty nazi pathetic pig prick "
    "psycho retard retarded rotten scum scumbag shit shut sick slut stupid stupidity subhuman suck sucks trash twat ugly useless vermin vile whore worthless wretched "
    "arschloch dreckig dumm hure hurensohn idioten scheiße schlampe schwein trottel widerlich wichser "
    "connard connasse crétin débile enculé imbécile merde minable ordure pourri putain salaud salope "
    "asqueroso basura cabrón estúpido gilipollas idiota imbécil inútil maldito mierda pendejo puta puto".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur ya du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split())
_LEET = str.maketrans("013457@$!|", "oieastasil")
_INNER = re.compile(r"(?:[^\W\d_][*@$!0-9|]+[^\W\d_])|(?:([^\W\d_])\1{3,})")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?!\w)")
_EDGE = ".,;:!?\"'()[]{}<>#%&*$|-_"
STEM = 5
FEATURES = (
    "listed", "listed_share", "learned", "learned_share", "learned_most", "near_you", "you_share", "upper", "shouted", "exclaims", "marks", "obfuscated", "spaced", "words_log",
)


@dataclass(frozen=True)
class Sample:
    """What the model is fitted on. ``rows``: at most so many labelled documents, by a hash of doc_id;
    ``support``: toxic documents of the sample that a learned stem is in at least."""

    rows: int = 20_000
    support: int = 4
    trees: int = 24
    depth: int = 3
    seed: int = 7


def plain(word: str) -> str:
    word = word.strip(_EDGE)
    return word if word.isalpha() else word.translate(_LEET)


def features(text: str | None, learned: dict[str, float]) -> tuple[float, ...]:
    """The values of ``FEATURES``; an empty text has zeros."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    low = [plain(w) for w in text.lower().split()]
    listed = [i for i, w in enumerate(low) if w in INSULTS]
    weights = [learned.get(w[:STEM], 0.0) for w in low]
    hits = sorted({*listed, *(i for i, x in enumerate(weights) if x > 0)})
    you = [i for i, w in enumerate(low) if w in SECOND_PERSON]
    near = 0.0
    if hits and you:
        at = np.array(you)
        k = np.searchsorted(at, hits)
        gap = np.minimum(np.abs(at[np.minimum(k, len(at) - 1)] - hits), np.abs(at[np.maximum(k - 1, 0)] - hits))
        near = float((1 / (1 + gap)).max())
    letters = sum(map(str.isalpha, text)) or 1
    total = sum(weights)
    return (
        float(len(listed)),
        len(listed) / n,
        total,
        total / n,
        max(weights),
        near,
        len(you) / n,
        sum(map(str.isupper, text)) / letters,
        sum(1 for w in words if len(w) > 2 and w.isupper()) / n,
        text.count("!") / n,
        sum(map(text.count, "?*#$%&@|")) / n,
        sum(1 for _ in _INNER.finditer(text)) / n,
        sum(1 for _ in _SPACED.finditer(text)) / n,
        float(np.log1p(n)),
    )


def _learn_stems(sample: DataFrame, bound: Sample) -> dict[str, float]:
    """Log-odds of stems (the first letters of a word) that toxic documents of the sample hold far more often.
    The sample is bounded, and so are its stems."""
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}

    def rows(col, _):
        out = {"stem": [], "toxic": []}
        for text, label in zip(col["text"], col["toxic"]):
            found = {w[:STEM] for w in map(plain, (text or "").lower().split()) if len(w) >= STEM}
            out["stem"] += found
            out["toxic"] += [label] * len(found)
        return out

    counts = arrow_map(sample.select("text", "toxic"), rows, "stem string, toxic int").groupBy("stem").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    odds = F.log((F.col("bad") + 0.5) / F.lit(sizes.get(1, 0) + 1.0)) - F.log((F.col("good") + 0.5) / F.lit(sizes.get(0, 0) + 1.0))
    best = counts.where(F.col("bad") >= bound.support).withColumn("odds", odds).where("odds > 2.5 and good * 20 <= bad")
    return {r["stem"]: float(r["odds"]) for r in best.collect()}


def _featured(rows: DataFrame, learned: dict[str, float], kept: list[str], text: str = "text") -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(learned)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)

    def run(col, _):
        found = list(zip(*[features(t, shared.value) for t in col[text]]))
        return {c: col[c] for c in kept} | dict(zip(FEATURES, found))

    return arrow_map(rows.select(*dict.fromkeys([*kept, text])), run, f"{kinds}, " + ", ".join(f"{f} double" for f in FEATURES))


def _training(docs: DataFrame, labels: DataFrame, bound: Sample) -> DataFrame:
    """(doc_id, text, toxic, part) of the sample: one row for each different text; part is 'a' or 'b' (for the trees) or 'curve'."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(fold != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound.rows)  # a bounded table
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    deal = F.pmod(F.xxhash64("doc_id"), F.lit(10))
    return rows.dropDuplicates(["text"]).withColumn("part", F.when(deal < 2, "curve").when(deal < 6, "a").otherwise("b"))


def score_toxicity(docs: DataFrame, labels: DataFrame, bound: Sample = Sample()) -> DataFrame:
    """``doc_id, score, predicted`` for each row of ``docs``; see ``score_toxicity_with``."""
    return score_toxicity_with(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, bound).select("doc_id", "score", "predicted")


def score_toxicity_with(docs: DataFrame, labels: DataFrame, bound: Sample = Sample(), into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``, named ``into`` (columns of these names are replaced).

    Learned from labelled rows whose crc32(doc_id as text) mod 5 is not 0 (a row of a null doc_id is never
    learned from, but scored). A null or empty text has features of zero and the score that follows. Equal
    texts get equal scores. If the sample lacks either class, every score is 0 or 1, as its only class is
    (0 without labels). Whole texts are read; labels, lang, source and doc_id are no features. An empty
    table gives no rows."""
    kept = [c for c in docs.columns if c.lower() not in [x.lower() for x in into]]
    sample = write_table(_training(docs, labels, bound), "toxicity-sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        drop_table(sample)
        share = 1.0 if toxic else 0.0
        return docs.select(*kept, F.lit(share).alias(into[0]), F.lit(int(share)).alias(into[1]))
    fold = {x: sample.where(F.col("part") == x) for x in ("a", "b")}
    learned = _learn_stems(sample.where("part <> 'curve'"), bound)
    # a training row's features come from stems that its own label had no say in
    kept_in = ["doc_id", "toxic", "part"]
    parts = [_featured(fold["a"], _learn_stems(fold["b"], bound), kept_in), _featured(fold["b"], _learn_stems(fold["a"], bound), kept_in), _featured(sample.where("part = 'curve'"), learned, kept_in)]
    table = write_table(parts[0].unionByName(parts[1]).unionByName(parts[2]), "toxicity-features")
    drop_table(sample)
    gather = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    weight = F.when(F.col("toxic") == 1, F.lit(min(20.0, max(1.0, other / toxic / 2)))).otherwise(1.0)
    table = gather.transform(table).withColumn("label", F.col("toxic").cast("double")).withColumn("weight", weight)
    # the sample is bounded: a few partitions spare the boosting rounds many empty tasks
    fit = table.where("part <> 'curve'").coalesce(4)
    model = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=bound.trees, maxDepth=bound.depth, stepSize=0.2, seed=bound.seed, minInstancesPerNode=2).fit(fit)
    raw = vector_to_array("probability")[1]
    curve = IsotonicRegression(featuresCol="raw", labelCol="label").fit(model.transform(table.where("part = 'curve'")).select(raw.alias("raw"), "label"))
    names = [f"c{n}" for n in range(len(kept))]  # columns of clashing names do no harm
    target = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)])
    scored = gather.transform(_featured(target, learned, names, names[[c.lower() for c in kept].index("text")]))
    scored = curve.transform(model.transform(scored).select(*names, raw.alias("raw")))
    # steps of the curve are level; a little of the trees' own score keeps the order inside a step
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.98 * F.col("prediction") + 0.02 * F.col("raw")))
    out = scored.withColumn("own", score)
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, names)], F.col("own").alias(into[0]), (F.col("own") >= 0.5).cast("int").alias(into[1]))
