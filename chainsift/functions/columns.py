"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from chainsift.sources.ledger import SUSPICIOUS


def suspicious(node_type: Column) -> Column:
    return node_type.isin(*SUSPICIOUS)


def tor(node_type: Column, is_tor: Column | None = None) -> Column:
    hit = node_type == "tor_exit_node"
    return hit if is_tor is None else hit | F.coalesce(is_tor, F.lit(False))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def risk_severity(risk: Column) -> Column:
    return F.when(risk >= 0.9, "CRITICAL").when(risk >= 0.75, "HIGH").when(risk >= 0.5, "MEDIUM").otherwise("LOW")


def anomaly_label(score: Column) -> Column:
    return F.when(score >= 70, "HIGH").when(score >= 40, "MEDIUM").otherwise("LOW")


def risk_level(risk: Column) -> Column:
    return F.when(risk >= 0.75, "HIGH").when(risk >= 0.5, "MEDIUM").otherwise("LOW")


def round_number(value: Column, targets: tuple[float, ...] = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 100.0), within: float = 0.01) -> Column:
    return F.exists(F.array(*map(F.lit, targets)), lambda t: F.abs(value - t) / t <= within)


def rounded(value: Column, places: int) -> Column:
    """A double rounded as SQL engines do: times a power of ten, to the nearest whole number (halves away from zero), and back. ``F.round`` goes by the
    decimal digits that are printed, which differ from that where a value is at a half but for its last bit."""
    scaled = F.round(value * 10.0**places) / 10.0**places
    return F.when(F.abs(value) < 1e300, scaled).otherwise(value)


def stable_id(text: Column) -> Column:
    """A nine-digit id from the first eight hex digits of the md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 900000000 + 100000000


def parse_time(text: Column) -> Column:
    """Epoch seconds, or ISO text (naive: UTC); NULL for anything else."""
    number = text.try_cast("double")
    return F.coalesce(F.when(F.abs(number) < 1e11, F.timestamp_micros((number * 1000000).cast("long"))), F.try_to_timestamp(text))


def parse_list(text: Column) -> Column:
    """JSON array, or values parted by ; | or , ; blanks dropped."""
    plain = F.split(F.regexp_replace(text, r"^\s*\[|\]\s*$", ""), r"[;|,]")
    found = F.when(F.trim(text).startswith("["), F.from_json(text, "array<string>")).otherwise(plain)
    return F.filter(F.transform(F.coalesce(found, plain), lambda x: F.trim(x)), lambda x: x != "")


def parse_list_strict(text: Column) -> Column:
    """JSON array; anything else is an error."""
    return F.from_json(text, "array<string>", {"mode": "FAILFAST"})


def digest(rows: Column) -> Column:
    """A content digest of a group's rows (texts), whatever their order: an aggregate."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(rows)), "\n"), 256)


#: Words of feature names that are written out, and measures that stand behind what they measure.
WORDS = {"sat": "satoshi", "tx": "transactions", "txns": "transactions", "addrs": "addresses", "num": "number of", "io": "input to output", "infra": "infrastructure", "prop": "propagation", "ips": "relay addresses", "asns": "relay networks"}
MEASURES = frozenset("count cv entropy gini hours max mean min ratio similarity slope std".split())


def readable(feature: str) -> str:
    """A feature's name in words: the measure first, then what it is taken of."""
    *rest, last = (WORDS.get(w, w) for w in feature.split("_"))
    return f"{last} of {' '.join(rest)}" if rest and last in MEASURES else " ".join([*rest, last])


def explanation(feature: Column, effect: Column, names: list[str], more: str = " above usual", less: str = " below usual") -> Column:
    """One effect in words: what the feature (one of ``names``) measures, and what a positive or a negative effect means."""
    words = F.create_map(*[F.lit(x) for n in names for x in (n, readable(n))])
    side = F.when(effect > 0, more).when(effect < 0, less).otherwise(" as usual")
    return F.concat(F.coalesce(words[feature], feature), side)


def from_satoshi(amounts: Column) -> Column:
    """Amounts over any possible number of coins are satoshi: the whole list is scaled."""
    return F.when(F.exists(amounts, lambda x: x > 21e6), F.transform(amounts, lambda x: F.round(x / 1e8, 8))).otherwise(amounts)


def entropy(count: Column, keys: list[str], guard: float = 0.0) -> Column:
    """Shannon entropy (bits) of counts inside a window of ``keys``, as an aggregate over rows (key, count)."""
    share = count / F.sum(count).over(Window.partitionBy(*keys))
    return -share * F.log2(share + guard)
