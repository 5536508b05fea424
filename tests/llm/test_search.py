"""Prefix tries, exact top-k search and ranked lexical search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampliq.llm import lexical_search, prefix_trie, queries, topk_search
from tests.conftest import SF
from tests.check import compare, duck

from .cases import edge_docs

# -- prefix tries


def brute_trie(rows):
    """The contract of op11 on rows (conv_id, turn, role, text)."""

    def symbol(r):
        return hashlib.md5(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).digest()

    own = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, symbol(r))):
        own[r[0]].append((r[2] or "", r[3] or ""))
    members, ends = defaultdict(set), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    inner = {p[:-1] for p in members if p}
    for p in members:
        if p:
            children[p[:-1]] += 1
        w = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += w
            leaves[p[:d]] += p not in inner
    return sorted(
        (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p in members
    )


CONV = "conv_id long, turn long, role string, text string, key string, place string"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations():
    rows = [(None, 0, "user", "nobody's"), (7, None, "user", "null first"), (7, 0, None, None), (7, 0, None, None), (8, 1, "a", "b  c\t\n d"), (8, 0, "a", "x " * 5000)]
    for c in range(20, 60):
        rows += [(c, t, "system" if t == 0 else "user", "the same start" if t == 0 else f"turn {t} of {c % 3 if t < 4 else c % 5}") for t in range(c % 7)]
    # Long ones that part at depths on both sides of chunk borders, one that ends inside another, and copies.
    for c, n, leave in [(100, 140, 999), (101, 140, 32), (102, 140, 33), (103, 97, 64), (104, 70, 999), (105, 140, 999), (106, 140, 96), (107, 128, 127), (108, 32, 999), (109, 64, 999)]:
        rows += [(c, t, "user", f"word{t} again" + (f" from {c}" if t >= leave else "")) for t in range(n)]
    return rows


def test_trie_equals_brute_force(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, "k", "p") for r in rows], CONV).repartition(5)
    own = prefix_trie.turns(df)
    got = prefix_trie.nodes(*prefix_trie.branched(own))
    assert sorted(tuple(r) for r in got.select(NODE).collect()) == brute_trie(rows) or _differ(got, rows)
    assert got.select("key").distinct().count() == got.count()


def _differ(got, rows):
    a, b = {tuple(r) for r in got.select(NODE).collect()}, set(brute_trie(rows))
    raise AssertionError((sorted(a - b, key=str)[:3], sorted(b - a, key=str)[:3]))


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    empty = prefix_trie.turns(spark.createDataFrame([], CONV))
    assert prefix_trie.nodes(*prefix_trie.branched(empty)).count() == 0
    # 41 takes 3 turns of 40, which has one; 43 takes its own after 3 and has none; 63 has no base.
    alone = [c for c in range(40, 400) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20][0]
    rows = [(alone, t, "user", f"own {t}") for t in range(2)]
    got = prefix_trie.nodes(*prefix_trie.branched(prefix_trie.turns(spark.createDataFrame([(*r, "k", "p") for r in rows], CONV))))
    assert sorted(tuple(r) for r in got.select(NODE).collect()) == brute_trie(rows) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_z_fast_trie_finds_exit_nodes():
    trie = prefix_trie.ZFastTrie()
    words = ["", "a", "ab", "abcdefgh", "abcdefgx", "abcz", "abcdefghijkl", "b", "abcdefgh", "q" * 20, "q" * 9 + "r"]

    def names(w):
        return [hashlib.md5(w[:d].encode()).digest() for d in range(len(w) + 1)]

    for part in (words[:3], words[3:7], words[7:]):
        trie.insert([names(w) for w in part], [words.index(w) for w in part], [words.index(w) for w in part], [True] * len(part))
    root = trie.roots[names("")[0]]
    for w in words:
        node = trie.exit_node(names(w), root)
        assert node.high == len(w) and node.names[node.high] == names(w)[-1]
    below = trie.exit_node(names("abcdefghiXXX"), root)
    assert (below.low, below.high) == (8, 12)
    assert all(trie.handles[n.names[prefix_trie.two_fattest(n.low, n.high)]] is n for n in trie.nodes if n.high > n.low)
    trie.summed()
    assert root.n == len(words)
    assert [prefix_trie.two_fattest(a, b) for a, b in [(0, 7), (4, 7), (5, 6), (3, 9), (0, 1)]] == [4, 6, 6, 8, 1]


# -- exact top-k search


def brute_topk(vectors, every, k):
    """Ranks of every ``every``-th id's row among all other rows with as many components."""
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(good):
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for o, (j, v) in enumerate(good) if o != n and len(v) == len(q))
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def vectors():
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(9)]
    rows = [(i, [c + rng.gauss(0, 0.3) for c in centres[i % 9 if i % 3 else 0]]) for i in range(1200)]
    rows += [(2000 + i, rows[i % 7][1]) for i in range(90)] + [rows[50], rows[50], rows[100]]
    rows += [(None, rows[0][1]), (3000, None), (3050, [1.0, None]), (3100, [float("nan")] * 12), (3150, [float("inf")] * 12), (3200, []), (3201, []), (3250, [1.5, -2.5, 0.0]), (3251, [-1.0, 4.0, 9.0]), (3300, [7.0])]
    # So large that doubles cannot hold the products.
    rows += [(4000 + i, [4e6 + i, 1.0 / 256, -4e6 + 2 * i, 5.0]) for i in range(60)]
    return rows


def test_topk_equals_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, block string").repartition(6)
    made = topk_search.whole(df)
    index = topk_search.build(made)
    assert index.agg(F.sum(F.octet_length("ids") / 8)).first()[0] == made.count()
    got = topk_search.search(index, made.where("id % 50 = 0"), 5)
    assert sorted(tuple(r) for r in got.collect()) == brute_topk(rows, 50, 5)


def test_topk_in_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "QUERY_BYTES", 2_000)
    rows = vectors()[:400]
    made = topk_search.whole(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = topk_search.search(topk_search.build(made), made.where("id % 10 = 0"), 3)
    rounded = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(tuple(r) for r in got.collect()) == brute_topk(rounded, 10, 3)


def test_topk_of_few_rows(spark):
    for rows in ([], [(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (1, [0.5, -1.0])]):
        made = topk_search.whole(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        got = topk_search.search(topk_search.build(made), made.where("id % 50 = 0"), 5)
        assert [tuple(r) for r in got.collect()] == brute_topk(rows, 50, 5)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    queries, block = rng.integers(-300, 300, (20, 16)), rng.integers(-300, 300, (50, 16))
    bound = topk_search.bounds(queries, block.min(axis=0)[None], block.max(axis=0)[None])[:, 0]
    assert (bound >= (queries @ block.T).max(axis=1)).all()
    assert (topk_search.bounds(queries, block[:1], block[:1])[:, 0] == queries @ block[0]).all()


# -- ranked lexical search

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_ranks(docs, items, k):
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for _, _, n in counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for i, text in items:
        scored = []
        for doc, c, n in counted:
            if n and doc is not None:
                m = 75 + 25 * n * n_docs // n_terms
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
                if score > 0:
                    scored.append((-score, doc))
        out += [(i, rank + 1, doc, -s) for rank, (s, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def test_lexical_search_equals_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{n}" for n in range(40)] + ["café", "日本", "X9"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 3, 3, 40, 400])))) for i in range(300)]
    docs += [(i + 500, docs[7][1]) for i in range(60)] + [docs[3], docs[3], (None, "w1 w2 w3")] + [(i, t) for i, t in ((r.doc_id, r.text) for r in edge_docs(spark).collect())]
    items = [(1, "w1 W2 w2 café"), (2, "X9 x9 nothing"), (2, "w5"), (3, None), (4, ""), (5, "unheard of"), (6, "the quick brown fox"), (7, " ".join(words)), (8, docs[7][1]), (None, "w1")]
    got = lexical_search.search(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, m int").repartition(5), spark.createDataFrame(items, "item_id long, text string"), k=20)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_ranks(docs, items, 20)


def test_lexical_search_in_blocks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 40)
    monkeypatch.setattr(lexical_search, "PART_POSTINGS", 20)
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choices("abcdefgh", k=5))) for i in range(200)]
    items = [(i, " ".join(rng.choices("abcdefgh", k=4))) for i in range(12)]
    got = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=7)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_ranks(docs, items, 7)


def test_lexical_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(none, item).count() == 0
    assert lexical_search.search(some, item.limit(0)).count() == 0
    assert [tuple(r) for r in lexical_search.search(some, item).collect()] == brute_ranks([(1, "a b")], [(1, "a")], 20)


# -- queries against SQL

SQL = [n for n in ("op11_prefix_trie", "op12_topk", "op13_lexical") if n in queries.QUERIES]


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, name):
    ok, note = compare(spark, duck(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert ok, note
