"""The pipeline's stages and its run against the operators' own brute-force rules."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
from filelens.llm import registry
from tests.llm.fixtures import SCHEMA
from tests.llm.fixtures import rows as edge_rows
from tests.llm.test_operators import base_spans


def near_classes(texts: dict) -> set:
    """The smallest id of each class linked by a 5-word Jaccard similarity of 0.8 or more, by comparing all pairs."""

    def shingles(text):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(texts):
        for b in texts:
            if b < a and (not sets[a] and not sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {find(i) for i in texts}


def test_stages_on_edge_cases(spark, sf):
    """Nulls in any column, repeated rows and ids, empty and long texts, columns with the names that stages use inside, and an empty table."""
    names = ["_id", "_digest", "own", "own_id", "whole", "row", "pieces", "blocks", "n", "stays"]
    docs = spark.createDataFrame(edge_rows(), SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").repartition(3)
    for n in names:
        docs = docs.withColumn(n, docs.doc_id)
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)] + [(None, 1)], "doc_id bigint, quality int")
    from filelens.llm import exact_dedup, minhash, quality, secrets, simhash

    kept = quality.keep_good(docs, labels, least=0.0)
    assert kept.columns == docs.columns and kept.count() == len(edge_rows())
    for drop in (exact_dedup.drop_copies, minhash.drop_near_copies, simhash.drop_near_copies, secrets.redact):
        got = drop(docs)
        assert got.columns == docs.columns
        found = got.collect()
        assert 0 < len(found) <= len(edge_rows()) and all(r[n] == r.doc_id for r in found for n in names)
        assert drop(docs.limit(0)).collect() == []
    once = minhash.drop_near_copies(docs).select("doc_id", "text").collect()
    assert len(once) == len(set(once))
    pieces = corpus_pipeline.pack_sequences(spark, docs, sf)
    assert {r.doc_id for r in pieces.collect()} == {r[0] for r in edge_rows()}
    assert corpus_pipeline.pack_sequences(spark, docs.limit(0), sf).collect() == []


def test_stages_take_effect(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows, columns = docs, docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, sf)
        out.write.parquet(str(tmp_path / str(k)))
        seen[name] = rows, spark.read.parquet(str(tmp_path / str(k)))
        rows = seen[name][1]
        assert name == "packing" or rows.columns == columns
    text = lambda df: {r.doc_id: r.text for r in df.collect()}
    before, after = map(text, seen["exact_dedup"])
    first = {}
    for i, t in sorted(before.items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    assert set(after) == set(first.values())
    before, after = map(text, seen["near_dedup"])
    assert set(after) == near_classes(before)
    before, after = map(text, seen["secrets"])
    assert set(before) == set(after)
    for i, t in before.items():
        assert not base_spans(after[i])
        if not base_spans(t) and after[i] != t:
            assert "[opaque]" in after[i]
    before, pieces = text(seen["packing"][0]), seen["packing"][1].collect()
    assert {p.doc_id for p in pieces} == set(before)
    whole = corpus_pipeline.run(spark, sf).collect()
    key = lambda p: (p.doc_id, p.start, p.length, p.ids_crc32) if p.start == 0 and p.length == 1024 else (p.doc_id, p.doc_tokens)
    assert {k[0] for k in map(key, whole)} == set(before)
    assert Counter({p.doc_id: p.doc_tokens for p in whole}) == Counter({p.doc_id: p.doc_tokens for p in pieces})


def test_quality_stage_keeps_labelled_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    kept = {r.doc_id for r in corpus_pipeline.keep_quality(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good, bad = [r.doc_id for r in labels if r.quality], [r.doc_id for r in labels if not r.quality]
    assert sum(i in kept for i in good) > 0.98 * len(good) and sum(i in kept for i in bad) < 0.1 * len(bad)


def test_registry():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in registry.QUERIES) == list(range(1, 14))
