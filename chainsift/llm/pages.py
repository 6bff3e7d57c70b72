"""Main text of web pages by line-block distribution.

Markup is stripped: elements whose tag says that they are never article text (menus, forms, scripts, headers)
leave a gap of empty lines, every other block of text becomes a line. Text lengths are summed over sliding
windows of lines, and the densest window marks the main part. Names are weights only: lines in an element with a
boilerplate class, id or role count a little, lines outside of a page's article elements a part of their length.
Named elements that do not hold the densest window are then gaps as well.

From the densest window the text reaches back to the surge point (before it, windows are empty) and on to the
dive point (after it, windows are empty), and over other windows that are nearly as dense. A gap whose element
was removed from inside the container of the text does not end it: what stands on both sides is kept. The end of
an article element is such a gap, so articles beside the densest one in its container are kept.

A form goes as a whole, unless it is wrapped around the page or its text (``page_forms``): then it is a box like others. Buttons and
labels are words of the sentence they stand in; a line made of them alone is a gap.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

WINDOW = 3
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|select|object|canvas|head)\b[^>]*>.*?(?:</(?P=raw)\s*>|(?=<body\b)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[/!?a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORD = re.compile(r"[a-z0-9]+")
#: Elements that are never article text.
SKIPPED = frozenset("nav header footer aside menu dialog fieldset".split())
#: Elements whose words alone make no line.
CONTROLS = frozenset("button label".split())
#: What the page itself has, not a form to fill in; and the prose (lines of ``LONG`` characters) that a form must hold for each field to be one of text.
_PAGE_PARTS = frozenset("article main h1 nav header footer".split())
LONG, PROSE = 60, 200
#: Words of a class, id or role that make boilerplate likely.
SKIPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup sidebar widget nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead topbar toolbar "
    "comment comments commentary disqus reply replies respond discussion share sharing social related recommended recommendations pagination pager "
    "login search complementary contentinfo".split()
)
#: Words beside them that say nothing of the content; a name with any other word is no boilerplate name.
NEUTRAL_WORDS = frozenset(
    "area bar block body bottom box btn button buttons card cards col column container content count feed field fixed group head heading inner item items js layer left link links "
    "list main meta module more nav outer page panel placeholder post posts right row section site slot small sticky thread title tools top unit view w wrap wrapper zone".split()
)
#: Weights of lines in elements of boilerplate names, and of lines outside of a page's article elements.
NAMED, OUTSIDE = 0.1, 0.25
_NEVER_SKIPPED = frozenset("html body main".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold blocks side by side.
_BOXES = frozenset("html body div section center article main td th form".split())
_FIELDS = frozenset("input button select textarea".split())
_HIDDEN_FIELD = re.compile(r"""\btype\s*=\s*["']?hidden""", re.I)
#: A start tag of the key ends an open element of these, as browsers do.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _hidden(tag: str, attrs: str) -> bool:
    """Whether an element is never article text, by its tag or because it is not shown."""
    if tag in SKIPPED:
        return True
    return tag not in _NEVER_SKIPPED and any(n.lower() == "hidden" or n.lower() == "aria-hidden" and "true" in v.lower() for n, v in _ATTRIBUTE.findall(attrs))


def _named(tag: str, attrs: str) -> bool:
    """Whether a class, id or role has a name made of boilerplate words (and neutral ones) alone."""
    if not attrs or tag in _NEVER_SKIPPED:
        return False
    for name, value in _ATTRIBUTE.findall(attrs):
        if name.lower() in ("class", "id", "role"):
            for one in value.strip("\"'").lower().split():
                words = [w for w in _WORD.findall(one) if not w.isdigit()]
                if not SKIPPED_WORDS.isdisjoint(words) and all(w in SKIPPED_WORDS or w in NEUTRAL_WORDS for w in words):
                    return True
    return False


def page_forms(page: str) -> set[int]:
    """The forms (by their order in the page) that are wrapped around the page or its text: they hold an article, a main heading, a menu or
    the like, or ``PROSE`` characters in long lines for each field that shows."""
    open_forms: list[int] = []
    fields, prose, kept, n, run, at = [], [], set(), 0, 0, 0

    def line() -> None:
        nonlocal run
        if run >= LONG:
            for f in open_forms:
                prose[f] += run
        run = 0

    for m in _MARKUP.finditer(page):
        if open_forms:
            run += len(page[at : m.start()].strip())
        at = m.end()
        tag = (m["tag"] or m["raw"] or "").lower()
        if tag == "form":
            line()
            if m["end"]:
                if open_forms:
                    open_forms.pop()
            else:
                open_forms.append(n)
                fields.append(0)
                prose.append(0)
                n += 1
        elif open_forms and not m["end"]:
            if tag in _BLOCKS:
                line()
            if tag in _PAGE_PARTS:
                kept.update(open_forms)
            if tag in _FIELDS and not (tag == "input" and _HIDDEN_FIELD.search(m["attrs"])):
                for f in open_forms:
                    fields[f] += 1
        elif open_forms and tag in _BLOCKS:
            line()
    run += len(page[at:].strip())
    line()
    return kept | {f for f in range(n) if prose[f] >= PROSE * max(1, fields[f])}


def lines(page: str, kept: frozenset[int] | None = None, window: int = WINDOW) -> tuple[list[tuple[str, bool, tuple[int, ...], int]], set[int], dict[int, int]]:
    """(text, whether in an article or main element, named elements around it, container) of each line, the elements
    that are the page itself, and the container around each container.

    Containers: the innermost open one of ``_BOXES``, but not the one whose only text the line is. Gaps are empty lines with the
    container of the element removed. Elements of boilerplate names are removed, but for those in ``kept`` (None: for all)."""
    out: list[tuple[str, bool, tuple[int, ...], int]] = []
    held: list[str] = []
    plain = False  # whether what is held has words besides those of controls
    stack: list[tuple[str, bool, bool, tuple[int, ...], int]] = []  # tag, skipped, in an article, named elements, innermost box
    tags: dict[str, int] = {}  # how many of a tag are open
    around = {0: 0}
    top, parted = {0}, {0}  # the page itself; elements with blocks inside
    forms, form = page_forms(page), -1
    number = 0

    def skipping() -> bool:
        return bool(stack) and stack[-1][1]

    def inside() -> tuple[bool, tuple[int, ...]]:
        return stack[-1][2:4] if stack else (False, ())

    def box() -> int:
        return stack[-1][4] if stack else 0

    def flush() -> None:
        nonlocal plain
        text = " ".join("".join(held).split())
        held.clear()
        if text and plain:
            out.append((text, *inside(), box()))
        elif text:
            gap()
        plain = False

    def gap() -> None:
        out.extend([("", *inside(), box())] * window)

    def add(text: str) -> None:
        nonlocal plain
        held.append(html.unescape(text))
        if not plain and not (tags.get("button") or tags.get("label")):
            plain = not held[-1].isspace()

    def close(k: int) -> None:
        for tag, *_ in stack[k:]:
            tags[tag] -= 1
        del stack[k:]

    at = 0
    for m in _MARKUP.finditer(page):
        if m.start() > at and not skipping():
            add(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"]:
            k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag) if tags.get(tag) else None
            if tag in _BLOCKS and not skipping():
                flush()
            if k is not None:
                parts = any(s[1] or s[0] in ("article", "main") for s in stack[k:]) and not (k and stack[k - 1][1])
                close(k)
                if parts:
                    gap()
            continue
        if tag in _VOID:
            if tag == "br" and not skipping():
                held.append("\n")
            elif tag == "hr" and not skipping():
                flush()
            continue
        if tag in _BLOCKS and not skipping():
            flush()
        if tag in _ENDS:
            for k in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                if stack[k][0] in _ENDS[tag]:
                    close(k)
                    break
                if stack[k][0] in ("ul", "ol", "table", "dl"):
                    break
        elif tag == "p" and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        number += 1
        article, named = inside()
        if not skipping() and _named(tag, m["attrs"]):
            named = (*named, number)
        skip = skipping() or _hidden(tag, m["attrs"]) or kept is not None and bool(named) and named[-1] == number and number not in kept
        if tag == "form":
            form += 1
            skip = skip or form not in forms
        if not skip and tag in ("article", "main"):
            if out and out[-1][0]:
                gap()
            article = True
        if tag in ("html", "body"):
            top.add(number)
        own = box()
        if tag in _BLOCKS or skip:
            up = own  # all around a parted box are parted already
            while up not in parted:
                parted.add(up)
                up = around[up]
        if tag in _BOXES:
            around[number] = own
            own = number
        tags[tag] = tags.get(tag, 0) + 1
        stack.append((tag, skip, article, named, own))
    if at < len(page) and not skipping():
        add(page[at:])
    flush()
    leaf = lambda text, at: around[at] if text and at not in parted else at
    return [(text, article, named, leaf(text, at)) for text, article, named, at in out], top, around


def _sums(found: list[tuple], sizes: list[float], window: int) -> list[float]:
    half = window // 2
    return [sum(sizes[max(0, i - half) : i + half + 1]) for i in range(len(found))]


def _bridged(found: list[tuple], top: set[int], around: dict[int, int], a: int, b: int) -> bool:
    """Whether the gaps between lines a and b (of text) all come from elements removed inside one container of both: the
    page itself only where both stand in it directly."""

    def containers(at: int) -> set[int]:
        out = {0}
        while at:
            out.add(at)
            at = around[at]
        return out

    between = {line[3] for line in found[min(a, b) + 1 : max(a, b)]}
    if not between.isdisjoint(top) and (found[a][3] not in top or found[b][3] not in top):
        return False
    inner = between - top
    return not inner or inner <= containers(found[a][3]) & containers(found[b][3])


def main_text(page: str | None, window: int = WINDOW) -> str:
    """The main text, one line a block; empty where a page has none. ``window``: lines whose lengths are summed."""
    page = page or ""
    found, *_ = lines(page, None, window)
    if not any(line[0] for line in found):
        return ""

    def weighed(found: list[tuple]) -> list[float]:
        some = any(article for _, article, *_ in found)
        return _sums(found, [len(text) * (NAMED if named else 1) * (OUTSIDE if some and not article else 1) for text, article, named, _ in found], window)

    sums = weighed(found)
    peak = max(range(len(sums)), key=lambda i: (sums[i], -i))
    # of the elements with boilerplate names, those that hold the densest text stay
    near = [i for i in range(max(0, peak - window // 2), min(len(found), peak + window // 2 + 1)) if found[i][0]]
    heart = max(near, key=lambda i: (len(found[i][0]) * (NAMED if found[i][2] else 1), -i))
    found, top, around = lines(page, frozenset(found[heart][2]), window)
    found = [(text, article, (), at) for text, article, _, at in found]
    sums = weighed(found)
    peak = max(range(len(sums)), key=lambda i: (sums[i], -i))
    # other parts that are nearly as dense belong to the text as well
    dense = [i for i, s in enumerate(sums) if s >= sums[peak] / 4]
    surge, dive = dense[0], dense[-1]
    while surge > 0 and sums[surge - 1]:
        surge -= 1
    while dive < len(sums) - 1 and sums[dive + 1]:
        dive += 1
    full = [i for i, line in enumerate(found) if line[0]]
    low = next(k for k, i in enumerate(full) if i >= surge)
    high = max(k for k, i in enumerate(full) if i <= dive)
    while low > 0 and _bridged(found, top, around, full[low - 1], full[low]):
        low -= 1
    while high < len(full) - 1 and _bridged(found, top, around, full[high], full[high + 1]):
        high += 1
    return "\n".join(found[i][0] for i in full[low : high + 1])


def extract_pages(pages: DataFrame) -> DataFrame:
    """Rows ``page_id, url, text`` of all pages.

    A null or empty page, or one without text, has an empty text; null ids and urls stay null; repeated
    rows are extracted each. Broken markup (unclosed elements, a page cut off in a tag or reference) is
    read as far as it goes. Other columns are not read; an empty table gives no rows."""

    def rows(col, _):
        return {"page_id": col["page_id"], "url": col["url"], "text": [main_text(h) for h in col["html"]]}

    return arrow_map(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), rows, "page_id long, url string, text string")
