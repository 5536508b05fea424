"""The similarity join against all pairs."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ampliq.llm import ngram_join
from ampliq.llm.common import components

from .cases import edge_docs, no_docs

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(docs, width, p, q):
    sets = {d: shingles(t, width) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            o = len(sets[a] & sets[b])
            if o and q * o >= p * (len(sets[a]) + len(sets[b]) - o):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def corpus(seed):
    """Groups of exact and near copies, chains whose ends are unlike, a passage that many share, and short texts."""
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = " ".join(rnd.choices(vocabulary, k=40))
    out = []
    for _ in range(25):
        base = rnd.choices(vocabulary, k=rnd.choice([3, 8, 30, 60, 120]))
        chain = list(base)
        for k in range(rnd.choice([1, 2, 6])):
            words = list(base)
            for _ in range(rnd.choice([0, 1, 2, 4])):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            out.append(" ".join(words))
            chain[rnd.randrange(len(chain))] = f"new{k}"
            out.append(" ".join(chain).upper())
        if rnd.random() < 0.5:
            out.append(" ".join(base) + " " + passage)
    out += [passage, passage, "", "a", "A", "a b"]
    rnd.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed, width, p, q", [(1, 3, 90, 100), (2, 5, 80, 100), (3, 3, 60, 100)])
def test_equals_all_pairs(spark, seed, width, p, q):
    docs = corpus(seed)
    got = ngram_join.groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), width=width, p=p, q=q).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, width, p, q)
    assert len(got) == len(docs)


def test_levels_change_no_result(spark, monkeypatch):
    docs = corpus(4)
    monkeypatch.setattr(ngram_join, "LEVELS", (2, 3, 4, 5, 6))
    got = ngram_join.groups(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), width=3, p=90, q=100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, 3, 90, 100)


def test_edges(spark):
    docs = edge_docs(spark)
    got = ngram_join.groups(docs, width=3, p=90, q=100).collect()
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").distinct().collect()], 3, 90, 100)
    assert len(got) == docs.count()
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)
    assert want[6] == want[5] and want[0] == (0, 0)
    assert ngram_join.groups(no_docs(spark)).count() == 0


def test_components(spark):
    rnd = random.Random(5)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 600)] + [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(60)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for start in sorted(near):
        todo = [start] if start not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    assert got == want
    assert components(spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))).count() == 0


def test_null_and_repeated_ids(spark):
    """Every row is a document of its own: rows without an id link like others, and two texts under one id are two documents."""
    near = "the quick brown fox jumps over the lazy dog near the river bank at noon " * 3
    rows = [(None, near + "one"), (None, near + "two"), (8, near + "three"), (4, "a text of its own entirely"), (4, "another text under that very id"), (None, "a text of its own entirely"), (None, "alone and without any id here"), (None, None), (9, "a text of its own entirely")]
    got = ngram_join.groups(spark.createDataFrame(rows, "doc_id long, text string"), width=3, p=60, q=100).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted([(None, 8), (None, 8), (8, 8), (4, 4), (4, 4), (None, 4), (None, None), (None, None), (9, 4)], key=str)
    words = ngram_join.groups(spark.createDataFrame([("x", "a b c"), ("7", "a b c")], "doc_id string, text string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in words), key=str) == [(7, 7), (None, 7)]
