"""Operators that work on whole tables: archives, shards, repeated strings, quality, and the pipeline."""

import io
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ampliq.llm import quality, queries, sharding, suffix_dedup, warc
from tests.conftest import SF

from .cases import edge_docs, no_docs
from .test_join import brute
from .test_texts import brute_hits

# -- archives


def pages_of(spark):
    return spark.createDataFrame(
        [(5, "http://a/5", "<p>same</p>", "x"), (2, "http://a/2", "<p>same</p>", "x"), (9, None, "<p>same</p>", "x"), (1, "http://a/1", None, "x"), (3, "http://a/3", "", "x"), (7, "bad\r\nurl", "été " * 5000, "x")],
        "page_id long, url string, html string, payload string",
    )


def test_archives_round_trip(spark):
    pages = pages_of(spark)
    rows = {r.page_id: r for r in warc.read_archives(warc.archive(pages.repartition(3))).collect()}
    assert len(rows) == 6
    first = {2: None, 5: 2, 9: 2, 1: None, 3: 1, 7: None}
    for r in pages.collect():
        raw = (r.html or "").encode()
        got = rows[r.page_id]
        assert (got.payload_bytes, got.payload_digest, got.refers_to) == (len(raw), warc.digest(raw), first[r.page_id])
        assert got.record_type == ("response" if first[r.page_id] is None else "revisit")
        assert got.payload == (raw if first[r.page_id] is None else None)
    assert warc.read_archives(warc.archive(pages.limit(0))).count() == 0


def test_pages_without_a_key_are_responses(spark):
    pages = spark.createDataFrame([(None, "u", "<p>same</p>"), (None, None, "<p>same</p>"), (4, "u", "<p>same</p>"), (6, "u", "<p>same</p>"), (None, "u", None)], "page_id long, url string, html string")
    rows = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(warc.archive(pages)).collect()]
    assert sorted(rows, key=str) == sorted([(None, "response", None, 11)] * 2 + [(4, "response", None, 11), (6, "revisit", 4, 11), (None, "response", None, 0)], key=str)


def test_small_payloads_are_all_responses(spark):
    assert warc.revisits(pages_of(spark), least=5).select("key").orderBy("key").collect() == [(5,), (9,)]


def test_archives_close_at_their_size(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    manifest = warc.archive(pages)
    assert manifest.count() > 1
    got = {r.page_id: bytes(r.payload) for r in warc.read_archives(manifest).collect()}
    assert got == {r.page_id: r.html.encode() for r in pages.collect()}


def archive_bytes(records, dictionary=b""):
    trained = warc.zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    c = warc.zstandard.ZstdCompressor(dict_data=trained)
    return warc.dictionary_frame(dictionary) + b"".join(c.compress(r) for r in records)


def read(data, step=7):
    return [warc.parse(f) for f in warc.frames(io.BytesIO(data), step)]


def test_frames_and_damage():
    records = [warc.record(k, "u", b"payload %d" % k, None) for k in range(5)]
    trained = warc.zstandard.train_dictionary(2048, [warc.record(k, f"u{k}", b"some payload %d " % k * 9, None) for k in range(200)]).as_bytes()
    packed = warc.zstandard.compress(trained)
    for data in (archive_bytes(records), archive_bytes(records, trained), archive_bytes(records, trained).replace(warc.dictionary_frame(trained), warc.dictionary_frame(packed))):
        assert [r["payload"] for r in read(data)] == [b"payload %d" % k for k in range(5)]
        with pytest.raises(warc.WarcError):
            read(data[:-3])
    good = records[0]
    for bad in (
        good.replace(b"payload 0", b"payload 1"),
        good.replace(b"WARC/1.1", b"WARC/9"),
        good[:-1],
        good.replace(b"\r\n\r\n", b"\r\n\r\nxx", 1),
        good.replace(b"WARC-Type: response\r\n", b""),
        good.replace(b"WARC-Type: response", b"WARC-Type response"),
        good.replace(b"WARC-Date", b"WARC-Type"),
    ):
        with pytest.raises(ValueError):
            read(archive_bytes([bad]))


# -- shards


@pytest.mark.parametrize("n, shards, epsilon", [(1000, 16, 0.0), (997, 7, 0.0), (1000, 16, 0.25), (3, 16, 0.0)])
def test_bounds_hold(spark, monkeypatch, n, shards, epsilon):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 20)
    rows = sharding.bounded_ring(spark.range(n).withColumnRenamed("id", "k").repartition(5), "k", shards, epsilon=epsilon).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len(rows) == n and all(sorted(s) == list(range(len(s))) for s in by.values())
    room = sharding.capacities(n, shards, epsilon)
    assert all(len(by[k]) <= room[k] for k in range(shards))
    if not epsilon:
        assert max(len(by[k]) for k in range(shards)) - min(len(by[k]) for k in range(shards)) <= 1


def test_overflow_goes_on_clockwise(spark):
    nodes = sharding.ring(5, 8)
    counts = [(k * 37) % 50 for k in range(len(nodes))]
    placed = sharding.place(counts, nodes, [sum(counts) // 5 + 1] * 5)
    held = Counter()
    for arc, low, high, shard, _ in placed:
        held[shard] += high - low
    assert sum(held.values()) == sum(counts) and max(held.values()) <= sum(counts) // 5 + 1
    for arc in range(len(nodes)):
        got = sorted((low, shard) for a, low, _, shard, _ in placed if a == arc)
        clockwise = list(dict.fromkeys(nodes[(arc + k) % len(nodes)][1] for k in range(len(nodes))))
        steps = [clockwise.index(shard) for _, shard in got]
        assert steps == sorted(steps)


def test_little_moves_when_a_shard_comes(spark):
    def at(shards):
        return {r.k: r.shard for r in sharding.bounded_ring(spark.range(3000).withColumnRenamed("id", "k"), "k", shards, virtual_nodes=256, epsilon=0.3).collect()}

    old, new = at(10), at(11)
    assert sum(old[k] != new[k] for k in old) < 3000 * 0.25


def test_shard_edges(spark):
    docs = edge_docs(spark)
    rows = sharding.bounded_ring(docs, "doc_id", 4).collect()
    assert len(rows) == docs.count() and all(isinstance(r.shard, int) and r.text_score for r in rows)
    assert sharding.bounded_ring(docs.withColumn("doc_id", F.lit(None).cast("long")), "doc_id", 4).groupBy("shard").count().agg(F.max("count")).first()[0] == 4
    assert sharding.bounded_ring(no_docs(spark), "doc_id", 4).count() == 0


# -- repeated strings


def brute_removal(docs):
    seen, out = set(), {}
    for d, t in sorted(docs):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - suffix_dedup.LENGTH + 1):
            s = raw[k : k + suffix_dedup.LENGTH]
            if s in seen:
                gone[k : k + suffix_dedup.LENGTH] = True
            seen.add(s)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        out[d] = (len(raw), list(zip(edges[::2].tolist(), edges[1::2].tolist())), bytes(np.frombuffer(raw, np.uint8)[~gone]))
    return out


def removal(docs):
    return {r.doc_id: (r.n_bytes, [(x.start, x.stop) for x in r.removed], bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()}


@pytest.mark.parametrize("depth", [10**9, 100])
def test_suffix_array(depth):
    rng = np.random.default_rng(12)
    for letters, n in ((1, 40), (2, 60), (4, 500), (250, 800)):
        t = np.append(rng.integers(1, letters + 1, n), 0)
        if letters == 4:
            t = np.concatenate([t[:200], t[:200], t])
            t[199] = t[399] = 1
            t[t[:-1].argmin()] = 1
            t = np.append(np.maximum(t[:-1], 1), 0)
        text = t.tolist()
        order = suffix_dedup.suffix_array(t, depth).tolist()
        assert sorted(order) == list(range(len(text)))
        keys = [text[k : k + depth] for k in order]
        assert keys == sorted(keys)


@pytest.mark.parametrize("hot, combined", [(256, 150_000), (1, 150_000), (256, 3)])
def test_removal_equals_brute_force(spark, monkeypatch, hot, combined):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "COMBINED", combined)
    monkeypatch.setattr(suffix_dedup, "SHARD_ANCHORS", 40)
    rnd = random.Random(13)
    letters = "abcdefgh é\n"
    base = ["".join(rnd.choices(letters, k=n)) for n in (90, 120, 400, 900, 101, 99, 100)]
    docs = []
    for k in range(60):
        parts = [rnd.choice(base) if rnd.random() < 0.6 else "".join(rnd.choices(letters, k=rnd.randrange(150))) for _ in range(rnd.randrange(0, 5))]
        docs.append((k * 2, "".join(p[rnd.randrange(30) :] for p in parts)))
    docs += [(200, "ab" * 300), (201, "x" * 500), (202, docs[7][1]), (203, docs[7][1]), (204, None), (205, "")]
    assert removal(spark.createDataFrame(rnd.sample(docs, len(docs)), "doc_id long, text string").repartition(4)) == brute_removal(docs)


def test_removal_edges(spark):
    docs = edge_docs(spark, repeat=False)
    assert removal(docs) == brute_removal([(r.doc_id, r.text) for r in docs.collect()])
    assert suffix_dedup.remove_repeats(edge_docs(spark)).count() == docs.count() + 2
    assert suffix_dedup.remove_repeats(no_docs(spark)).count() == 0


# -- quality


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    test = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = quality.fit(docs, labels.where(~test))
    assert model.pseudo_labels and min(model.pseudo_labels[-1]) > 0
    rows = quality.score(docs, model, keep=["doc_id"]).join(labels.where(test), "doc_id").collect()
    good = [r.score >= quality.KEEP_AT for r in rows if r.quality == 1 and r.toxic == 0]
    low = [r.score >= quality.KEEP_AT for r in rows if r.quality == 0]
    toxic = [r.score >= quality.KEEP_AT for r in rows if r.toxic == 1]
    assert sum(good) / len(good) > 0.97 and sum(low) / len(low) < 0.06 and sum(toxic) / len(toxic) < 0.4


def test_views_teach_each_other():
    """A page view that is blind at first learns from what the text view is sure of."""
    rng = np.random.default_rng(14)
    n = 4000
    good = rng.random(n) < 0.5
    label = np.where(np.arange(n) < 60, good, -1).astype(int)
    text = np.append(0, np.cumsum(good)), np.zeros(int(good.sum()), np.int64)
    page = quality.Dense(np.column_stack([good + rng.normal(0, 0.4, n), rng.normal(0, 1, (n, 40))]))
    alone = quality.co_train(quality.Sparse(*text, (n, 2)), page, label, np.arange(n) % 5 == 0, rounds=0)
    taught = quality.co_train(quality.Sparse(*text, (n, 2)), page, label, np.arange(n) % 5 == 0, rounds=3)

    def right(m):
        return ((page.dot(m.page[:-1]) + m.page[-1] > 0) == good)[60:].mean()

    assert right(taught) > right(alone)


def test_every_unlabelled_row_teaches(spark):
    rng = np.random.default_rng(13)
    # Rows in one task or many, more than any bound on rows: sums equal those over the whole.
    n = 25_000
    bits, page = rng.integers(0, 256, (n, 4), np.uint8), rng.random((n, 5)).astype(np.float16)
    frozen, now = [[rng.normal(0, 2, k + 1) for k in (32, 5)] for _ in range(2)]
    rows = spark.createDataFrame([(a.tobytes(), b.tobytes()) for a, b in zip(bits, page)], "bits binary, page binary")
    x = [quality.Dense(np.unpackbits(bits, axis=1)), quality.Dense(page)]
    for parts in (1, 7):
        for k, (loss, gradient, told) in enumerate(quality._far(rows.repartition(parts))(frozen, now)):
            sure, y = quality.taught(x[1 - k].dot(frozen[1 - k][:-1]) + frozen[1 - k][-1])
            want, slope = quality.sums(x[k], y, sure.astype(float), now[k])
            assert told == sure.sum() > 0 and abs(loss - want) < 1e-3 * want and np.allclose(gradient, slope, rtol=1e-2, atol=0.5)
    assert quality.LABELLED == 20_000 and not hasattr(quality, "POOL")


def test_quality_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (5, 1, None), (9, 0, 0), (9, 1, 0), (None, 1, 1), (77, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.token for r in rows)
    unlearned = quality.fit(docs, labels.limit(0))
    assert all(r.score > 0.99 for r in quality.score(docs, unlearned).collect())
    assert quality.score(no_docs(spark), unlearned).count() == 0


# -- pipeline


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    rows = {r.doc_id: r for r in docs.collect()}
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), name)
        made[name] = {r.doc_id: r for r in docs.collect()}
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert 0.6 * len(rows) < len(made["quality"]) < len(rows)
    groups = brute([(d, r.text) for d, r in made["quality"].items()], 5, 80, 100)
    assert set(made["near_duplicates"]) == {d for d, (_, c) in groups.items() if c == d}
    assert set(made["decontaminate"]) == {d for d, r in made["near_duplicates"].items() if not brute_hits(r.text, benchmark)[1]}
    assert set(made["secrets"]) == set(made["decontaminate"])
    for d, r in made["secrets"].items():
        assert r.n_chars == len(r.text) and (r.text == rows[d].text or corpus_pipeline.MARK in r.text)
        assert not corpus_pipeline.secret_scan.scan_text(r.text)
    library = Tokenizer.from_file(queries.tokenizer_path())
    assert set(made["tokens"]) == set(made["secrets"])
    for d, r in made["tokens"].items():
        assert r.ids == library.encode(made["secrets"][d].text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_pipeline_edges(spark, tmp_path):
    docs = edge_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    more = [(None, "nobody named this text of many words"), (None, "nor this one with its own words"), (4, "two texts under one id are no copies"), (None, None)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str) == sorted([0, 1, 2, 3, 4, 4, 5, 8, 9, 10, None, None, None], key=str)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


