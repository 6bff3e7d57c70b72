"""Secrets in texts: fixed patterns, and strings that a primed compressor finds new.

The base kinds are patterns. The method adds ``novel`` spans: a string of visible ASCII characters that starts
shortly after a word that speaks of credentials is compressed behind its surrounding text, by zstandard primed with a
dictionary of code and identifiers. What it adds to the compressed size is its marginal cost; prose,
identifiers, paths and repeated strings cost a fraction of their length, secrets nearly all of it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a longest run, as [0-9a-f]+ finds it
_ASSIGNED = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words that make what follows sensitive.
SENSITIVE = ("password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "access_key", "private_key", "credential", "auth", "bearer", "signature", "client_id", "session", "cookie")
_CONTEXT = re.compile("|".join(map(re.escape, SENSITIVE)), re.I | re.A)
#: Runs of visible ASCII characters, of those that seldom set a value apart, and of those of keys.
_RUNS = (re.compile(r"[!-~]+"), re.compile(r"""[^\x00-\x20\x7f-\U0010ffff"'`<>()\[\]{},;|\\]+"""), re.compile(r"[A-Za-z0-9+/_=~.-]+", re.A))
#: Marks around a value.
_BEFORE, _AFTER = "\"'`<([{:=,;|\\", "\"'`>)]},;|\\.:?"

#: Primes the compressor: common code, configuration and identifier text.
DICTIONARY = """
import os sys json logging requests return None True False self def class public private static final void function const let var
#include <stdio.h> #include <string> int main(int argc, char **argv) { printf("%s\\n", value); return 0; }
if (error != null) throw new IllegalArgumentException("invalid argument"); else return result; for (int i = 0; i < length; i++) {
https://www.example.com/index.html http://localhost:8080/api/v1/users?page=1&limit=100 Content-Type: application/json; charset=utf-8
Authorization: Bearer Accept-Encoding: gzip, deflate User-Agent: Mozilla/5.0 (X11; Linux x86_64) Set-Cookie: session_id=; path=/; HttpOnly
username password passwd secret token api_key apikey access_key secret_access_key private_key public_key client_id client_secret credential
authentication authorization configuration connection_string database_url environment_variable development production staging
SELECT column FROM table WHERE identifier = value ORDER BY created_at updated_at DESC LIMIT
/usr/local/lib/python3/site-packages/ /home/user/.ssh/id_rsa.pub /etc/ssl/certs/ca-certificates.crt /var/log/application.log
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef aaaaaaaaaaaaaaaa 0000000000000000 xxxxxxxxxxxxxxxx
2024-01-01T00:00:00.000Z 00000000-0000-0000-0000-000000000000 your_api_key_here changeme placeholder example_token <redacted>
""".encode()


class Novelty:
    """Marginal compressed size, by a compressor primed with ``DICTIONARY``."""

    def __init__(self, level: int = 19):
        primed = zstandard.ZstdCompressionDict(DICTIONARY, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=level)
        self.compressor = zstandard.ZstdCompressor(dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def marginal(self, context: str, candidate: str) -> int:
        before = context.encode("utf-8", "replace")
        return len(self.compressor.compress(before + candidate.encode("utf-8", "replace"))) - len(self.compressor.compress(before))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, in code points."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGNED):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


class _Parts:
    """Runs of one kind, from places that mostly go forward: a run's end is searched once, however many places lie inside it."""

    def __init__(self, kind: re.Pattern, text: str):
        self.kind, self.text = kind, text
        self.start = self.end = self.cut = -1  # cut: the end without the marks after a value

    def after(self, at: int) -> tuple[int, int, int] | None:
        """(start, end, end without marks) of what the kind finds from ``at`` on."""
        if not self.start <= at < self.end:
            m = self.kind.search(self.text, at)
            if m is None:
                return None
            self.start, self.end = m.span()
            self.cut = self.end
            while self.cut > self.start and self.text[self.cut - 1] in _AFTER:
                self.cut -= 1
        start = max(at, self.start)
        return start, self.end, max(start, self.cut)


def novel_spans(text: str, base: list[tuple[int, int, str]], novelty: Novelty, reach: int = 48, surroundings: int = 400, share: float = 0.7, least: int = 8) -> list[tuple[int, int, str]]:
    """Runs of ``least`` characters that start within ``reach`` code points after a sensitive word, that no base span
    touches, and that add at least ``share`` of their length to the compressed surroundings.

    A run that holds a later sensitive word is not measured as a whole: what follows that word is, so that each character is measured a few times at most."""
    low = text.lower()
    if not any(w in low for w in SENSITIVE):
        return []
    out, last, tried = [], -1, set()
    begins = sorted((s, e) for s, e, _ in base)
    reached = list(accumulate((e for _, e in begins), max))  # the furthest end of the spans up to each
    starts = [s for s, _ in begins]

    def novel(a: int, b: int, following: int) -> bool:
        if a <= last or b - a < least or following < b or (a, b) in tried:
            return False
        tried.add((a, b))
        k = bisect_left(starts, b)
        if k and reached[k - 1] > a:
            return False
        context = text[max(0, a - surroundings) : a] + " " + text[b : b + surroundings] + " "
        return novelty.marginal(context, text[a:b]) >= share * (b - a)

    kinds = [_Parts(kind, text) for kind in _RUNS]
    words = _CONTEXT.finditer(text)
    following = next(words, None)
    while (word := following) is not None:
        following = next(words, None)
        ahead = following.start() if following else len(text)
        at, far = word.end(), word.end() + reach
        tried = {(a, b) for a, b in tried if a >= at}
        # whole runs first, also where they leave the reach; then their parts
        while (run := kinds[0].after(at)) and run[0] <= far:
            for kind in kinds:
                begin = run[0]
                while begin < run[1] and (part := kind.after(begin)) and part[0] < run[1] and part[0] <= far:
                    a, end, b = part
                    while a < b and text[a] in _BEFORE:
                        a += 1
                    if a <= far and novel(a, b, ahead):
                        out.append((a, b, "novel"))
                        last = b - 1
                    begin = end
            at = run[1]
    return out


def find_secrets(docs: DataFrame, into: str = "spans") -> DataFrame:
    """Adds ``spans array<struct<kind, start, end>>`` to ``docs``, by start, then kind as listed in ``KINDS``.

    Places are code points, the end exclusive. A null or empty text has no spans. Whole texts are read,
    very long ones too. All rows and columns stay; repeated rows get equal spans; a column that has the
    name ``into`` already is replaced. An empty table gives an empty table."""
    kept = [c for c in docs.columns if c.lower() != into.lower()]
    kinds = {k: n for n, k in enumerate(KINDS)}
    names = [f"c{n}" for n in range(len(kept))]  # clashing names do no harm
    narrow = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)])
    text = names[[c.lower() for c in kept].index("text")]

    def rows(col, novelty):
        found = []
        for t in col[text]:
            base = base_spans(t or "")
            spans = base + novel_spans(t or "", base, novelty)
            found.append([{"kind": k, "start": a, "end": b} for a, b, k in sorted(spans, key=lambda s: (s[0], kinds[s[2]], s[1]))])
        return col | {"spans": found}

    kinds_of = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, kept))
    out = arrow_map(narrow, rows, f"{kinds_of}, spans array<struct<kind: string, start: long, end: long>>", Novelty)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, kept)], F.col("spans").alias(into))


def joined(spans: F.Column) -> F.Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each span's text replaced by ``mark`` (overlapping spans by one) and ``n_chars`` set anew.

    All rows and columns stay; a null text stays null; texts without secrets are untouched."""
    found = find_secrets(docs, "_spans")

    def step(state, span):
        start, end = span["start"].cast("int"), span["end"].cast("int")
        text = F.concat(state["out"], F.when(start >= state["at"], F.concat(F.substr(F.col("text"), state["at"] + 1, start - state["at"]), F.lit(mark))).otherwise(F.lit("")))
        return F.struct(text.alias("out"), F.greatest(state["at"], end).alias("at"))

    clean = F.aggregate(
        F.col("_spans"),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        step,
        lambda s: F.concat(s["out"], F.substr(F.col("text"), s["at"] + 1)),
    )
    text = F.when(F.size("_spans") > 0, clean).otherwise(F.col("text"))
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
