"""Quality rules with risk-controlled thresholds.

Each rule rejects documents on one side of a cutoff of one measure. Cutoffs are chosen for each stratum
(language) on labelled documents: the exact binomial upper bound of the rate at which good documents
would be rejected must stay under the rule's share of the allowed rate. Along a rule's fixed ladder of
cutoffs, from the mildest on, testing stops at the first failure (a fixed sequence needs no correction);
over rules and strata the error level is divided (Bonferroni). Of the certified cutoffs, the one that
rejects the most bad documents net of good ones is used. A stratum without enough labels to certify
anything rejects nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, window_hashes, word_hashes, write_table

_SPACE = np.array([9, 10, 11, 12, 13, 32])
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
MEASURES = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks")

#: measure -> (expression over the counts, ladder of cutoffs from mild to strict); values above a cutoff are rejected.
_LADDER = tuple(round(0.95 * 0.9**k, 6) for k in range(44))
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", _LADDER),
    "marks": ("n_marks / greatest(n_words, 1)", tuple(round(4 * 0.9**k, 6) for k in range(44))),
    "upper": ("n_upper / greatest(n_letters, 1)", _LADDER),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", _LADDER),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", _LADDER),
}


@dataclass(frozen=True)
class Risk:
    """At most ``rate`` of good documents of a stratum rejected by all rules together, at confidence 1 - ``error``.

    ``strata``: the most frequent languages have strata of their own, other rows share one."""

    rate: float = 0.02
    error: float = 0.05
    strata: int = 16


def measure(text: bytes) -> tuple[int, ...]:
    """(n_words, *MEASURES) of a UTF-8 text."""
    words = text.split()
    held = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = len(text) - int(held[0x80:0xC0].sum())  # continuation bytes are no code points
    lines = [line for line in text.split(b"\n") if line.split()]
    repeated = 0
    if len(words) > 5:
        windows = window_hashes(word_hashes(words), (0, 1, 2, 3, 4), 5)
        _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(counts[inverse] > 1)
        if len(twice):
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, twice, 1)
            np.add.at(edge, twice + 5, -1)
            repeated = int((np.cumsum(edge) > 0).sum())
    upper = int(held[65:91].sum())
    return (
        len(words),
        points - int(held[_SPACE].sum()),
        int(held[_SYMBOLS].sum()),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        upper,
        upper + int(held[97:123].sum()),
        int(held[[33, 63]].sum()),
    )


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, text_key`` (a hash of the text) and the counts ``n_words`` and ``MEASURES`` (long) of each whole text; a null text counts as empty."""
    names = ("n_words", *MEASURES)

    def rows(col, _):
        found = list(zip(*[measure(t) for t in col["text"]]))
        return {n: col[n] for n in ("doc_id", "lang", "text_key")} | dict(zip(names, found))

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang, F.xxhash64(text).alias("text_key"), text.alias("text")), rows, "doc_id long, lang string, text_key long, " + ", ".join(f"{n} long" for n in names))


def at_most(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), exactly summed."""
    if k >= n:
        return 1.0
    base = math.lgamma(n + 1)
    terms = [base - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return min(1.0, math.exp(top) * math.fsum(math.exp(t - top) for t in terms))


def certified(good: list[int], n: int, rate: float, error: float) -> int:
    """How many cutoffs, from the mildest on, have an exact upper bound of the false rejection rate of at most ``rate``."""
    for step, k in enumerate(good):
        # the Clopper-Pearson upper bound is at most rate exactly if this tail is at most error
        if k > rate * n or at_most(k, n, rate) > error:
            return step
    return len(good)


def thresholds(found: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> dict[str, dict[str, float]]:
    """stratum -> rule -> cutoff, learned from all labelled texts of ``measured``; '' is the stratum of all other languages.

    The bounds ask for independent documents, so a text counts once in a stratum however many labelled copies it has
    (as good, if any is). Only counts for each (stratum, rule, cutoff) come to the driver."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    rows = found.join(known, "doc_id")
    top = [r["lang"] for r in rows.where("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(risk.strata).collect()]
    stratum = F.when(F.col("lang").isin(top), F.col("lang")).otherwise(F.lit("")) if top else F.lit("")
    counts = [F.count("*").alias("n")]
    for name, (value, ladder) in RULES.items():
        # how many steps of the ladder reject the row; cumulated below
        steps = sum((F.expr(value) > c).cast("int") for c in ladder)
        rows = rows.withColumn(f"steps_{name}", steps)
    rows = rows.select(stratum.alias("stratum"), "text_key", "quality", *[f"steps_{n}" for n in RULES])
    # copies share all measures
    rows = rows.groupBy("stratum", "text_key").agg(F.max("quality").alias("quality"), *[F.first(f"steps_{n}").alias(f"steps_{n}") for n in RULES])
    long = rows.select("stratum", "quality", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"steps_{n}").alias("steps")) for n in RULES])).alias("s"))
    seen = long.groupBy("stratum", "quality", "s.rule", "s.steps").agg(*counts).collect()  # strata x rules x cutoffs at most
    tests = max(1, len({r["stratum"] for r in seen})) * len(RULES)
    out: dict[str, dict[str, float]] = {}
    for at in sorted({r["stratum"] for r in seen}):
        for name, (_, ladder) in RULES.items():
            # rejected by cutoff j: the rows with more than len(ladder) - 1 - ... steps; the ladder falls, so j is met if steps > len - 1 - j
            tally = {q: np.zeros(len(ladder) + 1, np.int64) for q in (0, 1)}
            for r in seen:
                if r["stratum"] == at and r["rule"] == name and r["quality"] in (0, 1):
                    tally[r["quality"]][r["steps"]] += r["n"]
            n_good = int(tally[1].sum())
            # a value above cutoff j is above all later (lower) ones as well: it has at least len - j steps
            rejected = {q: [int(t[len(ladder) - j :].sum()) for j in range(len(ladder))] for q, t in tally.items()}
            steps = certified(rejected[1], n_good, risk.rate / len(RULES), risk.error / tests) if n_good else 0
            if steps:
                gain = [rejected[0][j] - rejected[1][j] for j in range(steps)]
                best = max(range(steps), key=lambda j: (gain[j], -j))
                if gain[best] > 0:
                    out.setdefault(at, {})[name] = ladder[best]
    return out


def quality_filter(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """The counts of ``measured`` with ``base_failed`` and ``kept``, one row for each row of ``docs``.

    Base: fewer than 10 words, or more than a fifth of the words in repeated 5-word windows. Rows with a
    null lang, or one without enough labels, belong to the common stratum. Repeated rows are judged each;
    repeated labels of a doc_id, and labelled copies of a text, count once (good, if any says so); rows of a
    repeated doc_id all count as labelled. Without labels no rule rejects. An empty table gives no rows."""
    found = write_table(measured(docs), "quality-measures")
    cutoffs = thresholds(found, labels, risk)
    stratum = F.coalesce(F.when(F.col("lang").isin(*[s for s in cutoffs if s]), F.col("lang")), F.lit(""))
    known = [s for s in cutoffs if s]
    fails = F.lit(False)
    for at, rules in cutoffs.items():
        hit = F.lit(False)
        for name, cut in rules.items():
            hit = hit | (F.expr(RULES[name][0]) > F.lit(cut))
        here = F.col("lang") == at if at else (~F.col("lang").isin(*known) | F.col("lang").isNull() if known else F.lit(True))
        fails = fails | (F.coalesce(here, F.lit(False)) & hit)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return found.drop("text_key").withColumn("base_failed", base).withColumn("kept", ~base & ~fails)
