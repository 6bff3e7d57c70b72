"""Alignment, ranked search and embeddings against plain versions; long and odd texts of the operators before them."""

import hashlib
import json
import math
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from chainsift.llm import alignment, catalog, lexical
from chainsift.llm.alignment import align_tokenizers
from chainsift.llm.embeddings import ROOTS, cells, decode, near_embeddings, unit_vector
from chainsift.llm.lexical import rank_documents
from chainsift.llm.pages import main_text, page_forms
from chainsift.llm.secrets import Novelty, base_spans, novel_spans
from chainsift.llm.tokens import WordTokens


def rows(df):
    return [r.asDict() for r in df.collect()]


# alignment


@pytest.fixture(scope="module")
def paths():
    return catalog.tokenizer_path("byte_bpe_50k.json"), catalog.tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain_alignment(paths):
    """Rows of whole texts by two pointers over the bytes, without words, slices or dictionaries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a.encode_special_tokens = True
    names = {i: t for t, i in a.get_vocab().items()}
    shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
    byte = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}

    def one(text):
        if not text:
            return [], [], []
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ba = [bytes(byte[c] for c in names[i]) for i in ia]
        bb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ib)]
        if not b"".join(ba) == b"".join(bb) == (" " + text).encode():
            return [], [], []
        groups, links, i, j, x, y = [], [], 0, 0, [], []
        ea, eb = np.cumsum([len(w) for w in ba]), np.cumsum([len(w) for w in bb])
        while i < len(ia):
            links.append((ia[i], ib[j]))
            if ea[i] == eb[j]:
                groups.append(",".join(map(str, [*x, ia[i]])) + "|" + ",".join(map(str, [*y, ib[j]])))
                i, j, x, y = i + 1, j + 1, [], []
            elif ea[i] < eb[j]:
                x.append(ia[i])
                i += 1
            else:
                y.append(ib[j])
                j += 1
        return ia, ib, (groups, links)

    def all_rows(texts):
        found = [one(t) for t in texts]
        count = Counter(link for *_, g in found if g for link in g[1])
        best = {}
        for (_, b_id), n in count.items():
            best[b_id] = max(n, best.get(b_id, 0))
        out = []
        for ia, ib, g in found:
            groups, links = g or ([], [])
            digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
            out.append((len(ia), len(ib), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), digest))
        return out

    return all_rows


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_equals_two_pointers(spark, data, small, plain_alignment):
    docs = small("documents")
    want = dict(zip([d[0] for d in docs], plain_alignment([d[1] for d in docs]), strict=True))
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in rows(catalog.op11_alignment(spark, data))}
    assert got == want


def test_alignment_of_odd_texts(spark, odd, nothing, paths, plain_alignment, monkeypatch):
    rng = random.Random(7)
    parts = ["a", "b", " ", "  ", "\n", "\t", "\xa0", "é", "日", "x́", "'s", "1", "23", "!", "\x1c", "\x00", "　", "▁", "<s>", "<0x41>", "<|endoftext|>", "word", "  \n ", "\U0001f600"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(1500)]
    texts += [" ", "  ", "x ", " x", "\n", "a " * 3000, "▁", "a▁b", None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(alignment, "PIECE", 40)  # long texts are read in pieces; workers keep their own setting, so both are tried
    found = alignment.Aligner(*paths)
    inside = alignment._slice(found, 0, list(range(len(texts))), texts)
    want = plain_alignment(texts)
    assert list(zip(inside["n_a"], inside["n_b"], inside["n_groups"], inside["n_links"], inside["groups_sha256"]))[: len(texts)] == [(*w[:4], w[6]) for w in want]
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in rows(align_tokenizers(df, *paths))}
    assert got == dict(enumerate(want))
    listed = odd.collect()
    want = sorted(plain_alignment([r["text"] for r in listed]))
    assert sorted(tuple(r[c] for c in COLUMNS) for r in rows(align_tokenizers(odd, *paths))) == want
    assert align_tokenizers(nothing, *paths).count() == 0
    only = rows(align_tokenizers(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string"), *paths))
    assert [tuple(r[c] for c in COLUMNS) for r in only] == [(0, 0, 0, 0, 0, 0, "")] * 2


# ranked search


def plain_ranks(docs, items, top=10):
    """Every document scored for every item."""
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(terms(t))) for i, t in docs]
    full = [c for _, c in held if c]
    n_docs, length = len(full), sum(sum(c.values()) for c in full)
    df = Counter(t for c in full for t in c)
    out = []
    for item, text in set(items):
        wanted = Counter(terms(text))
        scored = []
        for doc_id, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // length if length else 0
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, k in wanted.items() if t in c)
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0, doc_id))
        out += [(item, k + 1, d[3], -d[0]) for k, d in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def ranked(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows(df)), key=str)


def test_search_equals_all_scores(spark, data, small):
    want = plain_ranks([(d[0], d[1]) for d in small("documents")], [(b[0], b[1]) for b in small("benchmark")])
    assert ranked(catalog.op12_search(spark, data)) == want
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{data}/{name}.parquet'")
    assert sorted(con.sql(catalog.oracle_sql()["op12_search"]).fetchall(), key=str) == want


def test_search_of_odd_rows_in_small_blocks(spark, odd, nothing, monkeypatch):
    items = [(1, "alpha1 bravo2 Charlie3 one one"), (1, "alpha1 bravo2 Charlie3 one one"), (1, "line"), (2, "ÜNÏ ünï 日本語"), (3, None), (4, ""), (5, "nowhere at all"), (None, "two words golf4 golf4"), (6, "!!! ,,")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = plain_ranks(docs, items)
    assert ranked(rank_documents(odd, bench)) == want
    for name, value in (("BLOCK_TERMS", 4), ("TREE_TERMS", 3)):
        monkeypatch.setattr(lexical, name, value)
    assert ranked(rank_documents(odd, bench)) == want
    assert rank_documents(nothing, bench).count() == 0 and rank_documents(odd, bench.limit(0)).count() == 0
    # many ties: the smallest ids win
    same = spark.range(500).selectExpr("id as doc_id", "'alpha bravo' as text").repartition(7)
    got = ranked(rank_documents(same.union(spark.createDataFrame([(500, "other")], "doc_id long, text string")), spark.createDataFrame([(1, "bravo")], "item_id long, text string")))
    assert sorted(r[2] for r in got) == list(range(10))


def test_tree_bounds_hold():
    rng = np.random.default_rng(5)
    n, width = 300, 12
    grid = rng.integers(0, 5, (n, width)) * (rng.random((n, width)) < 0.3)
    doc, term = np.nonzero(grid)
    own = np.unique(doc)
    m = rng.integers(25, 400, len(own))
    tree = lexical.Tree(np.searchsorted(own, doc), term, grid[doc, term], m, width)
    assert (tree.most[tree.root] == grid.max(axis=0)).all() and tree.least[tree.root] == m.min()
    assert sorted(tree.rows.tolist()) == list(range(len(own)))
    terms, weights = np.array([1, 4, 7, 11]), np.array([900, 20, 300, 4000])
    best = lexical.Best(10)
    tree.search(terms, weights, best, own.tolist())
    scores = lexical.share(grid[own][:, terms], m[:, None]) @ weights
    want = sorted(zip((-scores).tolist(), own.tolist()))[:10]
    assert sorted((-s, d) for d, s in best.rows()) == [w for w in want if w[0] < 0]


# embeddings


def plain_links(vectors, threshold=0.9):
    """{row number: (links, component's smallest id)} by all pairs."""
    good = [k for k, (_, v) in enumerate(vectors) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    up = {k: k for k in range(len(vectors))}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    n = Counter()
    for size in {len(vectors[k][1]) for k in good}:
        own = [k for k in good if len(vectors[k][1]) == size]
        x = np.array([unit_vector(vectors[k][1]) for k in own])
        for i, j in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1))):
            n[own[i]] += 1
            n[own[j]] += 1
            up[max(top(own[i]), top(own[j]))] = min(top(own[i]), top(own[j]))
    least = {}
    for k, (vec_id, _) in enumerate(vectors):
        if vec_id is not None:
            least[top(k)] = min(vec_id, least.get(top(k), vec_id))
    return [(v[0], n[k], least.get(top(k))) for k, v in enumerate(vectors)]


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(2)
    y = rng.normal(size=(300, 8)) * 2
    points = decode(y)
    assert len(ROOTS) == 240 and np.allclose((ROOTS**2).sum(axis=1), 2)
    assert ((2 * points) % 1 == 0).all() and (points.sum(axis=1) % 2 == 0).all()
    # no neighbour is nearer
    assert (((y - points) ** 2).sum(axis=1) <= ((y[:, None] - points[:, None] - ROOTS[None]) ** 2).sum(axis=2).min(axis=1) + 1e-9).all()


def test_cells_meet_at_the_threshold():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    for cos, least in ((0.9, 0.97), (0.95, 0.999)):
        y = cos * x + math.sqrt(1 - cos * cos) * z
        a, b = (cells(v).reshape(len(v), -1) for v in (x, y))
        assert np.mean([not set(p).isdisjoint(q) for p, q in zip(a.tolist(), b.tolist())]) >= least


def test_embeddings_equal_all_pairs(spark, data, small):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(150, 24))
    near = base[:60] + rng.normal(size=(60, 24)) * 0.2
    blob = base[7] / np.linalg.norm(base[7]) + rng.normal(size=(120, 24)) * 0.04
    tight = base[9] / np.linalg.norm(base[9]) + rng.normal(size=(120, 24)) * 0.005
    made = [[float(x) for x in v] for v in np.concatenate([base, near, blob, tight, 3 * base[:20], base[:20]])]
    vectors = list(enumerate(made))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows(near_embeddings(spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3))))
    assert got == [(i, n, c, i == c) for i, n, c in plain_links(vectors)]
    con = small("embeddings")
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in rows(catalog.op13_embeddings(spark, data))) == sorted(plain_links([(v[0], v[1]) for v in con]))


def test_embeddings_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2e200, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (None, [0.0, 5.0]), (None, [-1.0, -1.0]), (None, [-1.0, -1.1]), (None, None), (9, [1.0]), (10, [-0.0, 1e-300])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], "vec_id long, embedding array<double>, label string, VEC int")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in rows(near_embeddings(df))), key=str)
    assert got == sorted(plain_links(vectors), key=str)
    assert near_embeddings(df.limit(0)).count() == 0
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows(near_embeddings(df)))


def test_embeddings_in_small_blocks(spark, monkeypatch):
    """Clusters and cells of several blocks; balls with blocks of their own."""
    from chainsift.llm import embeddings

    monkeypatch.setattr(embeddings, "CELL_BLOCK", 20)
    monkeypatch.setattr(embeddings, "COUNT_BLOCK", 25)
    rng = np.random.default_rng(12)
    base = rng.normal(size=(4, 16))
    base /= np.linalg.norm(base, axis=1)[:, None]
    made = np.concatenate([base[0] + rng.normal(size=(90, 16)) * 0.06, base[0] + rng.normal(size=(90, 16)) * 0.004, base[1] + rng.normal(size=(60, 16)) * 0.01, base])
    vectors = [(k, [float(x) for x in v]) for k, v in enumerate(made)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in rows(near_embeddings(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))))
    assert got == sorted(plain_links(vectors))


# long texts and forms


def test_words_past_the_table(monkeypatch):
    """A text of more different words than the table has places at first."""
    from chainsift.llm import tokens
    from chainsift.llm.common import Words

    monkeypatch.setattr(tokens, "Words", lambda: Words(8))
    own = WordTokens(catalog.tokenizer_path())
    text = " ".join(f"{k:x}" for k in range(20_000))
    assert own.encode([text, "again 1f"])[0].tolist() == own.whole.encode(text, add_special_tokens=False).ids
    assert own.short.bits > 15 and own.short.used == 20_000 + 1


def test_secrets_in_unbroken_text():
    novelty = Novelty()

    def made(keys):
        return json.dumps({f"token_{k}": {"secret": k % 7, "auth": "value of the list"} for k in range(keys)}, separators=(",", ":")).replace(" ", "_")

    took = []
    for keys in (500, 4000):
        text = made(keys)
        began = time.time()
        novel_spans(text, base_spans(text), novelty)
        took.append(time.time() - began)
    assert took[1] < 24 * took[0] + 0.5  # eight times the text
    # a key in the midst of it is still found
    key = "q9Zx7LmT2vBn8RkW4sYc"
    text = made(300) + f'{{"session":"{key}"}}' + made(300)
    assert (text.index(key), text.index(key) + len(key), "novel") in novel_spans(text, base_spans(text), novelty)


def test_pages_inside_forms():
    long = "A long paragraph of an article that goes on and on with words. " * 6
    two = f"<p>{long}</p><p>{long}</p>"
    want = [long.strip()] * 2
    found = lambda page: main_text(page).split("\n")
    assert found(f'<html><body><form id="aspnetForm" method=post><input type=hidden name=v value=1><div>{two}</div></form></body></html>') == want
    search = "<div><label>Search</label><input type=text><button>Go</button></div>"
    assert found(f"<body><form>{search}<nav>menu of the page</nav><div>{two}</div></form></body>") == want
    assert found(f"<body><form>{search}</form><div>{two}</div></body>") == want
    assert found(f"<body><form id=outer><p>{long}</p><form><label>Mail</label><input><button>Sign up</button></form><p>{long}</p></form></body>") == want
    reply = "<form><p>Leave a reply, your address will not be published on this page.</p><label>Name</label><input><textarea></textarea><button>Send</button></form>"
    assert found(f"<body><article>{two}</article>{reply}</body>") == want
    assert page_forms(f"<form>{reply}") == set() and page_forms("<form><h1>x</h1>") == {0} and page_forms("</form><form>") == set()
    assert found("<p>Press <button>Save</button> and then the <label>file name</label> stays as it was.</p>") == ["Press Save and then the file name stays as it was."]
    assert main_text("<div>" * 8000 + "words " * 50) == ("words " * 50).strip()
    assert main_text("<b>" * 8000 + "x" + "</i>" * 8000) == "x"
