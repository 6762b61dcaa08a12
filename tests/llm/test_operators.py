"""Each operator against a brute-force version on a table with all edge cases, and on an empty one."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from filelens.llm._additive import BoostedTrees, Isotonic, PairwiseAdditive
from filelens.llm import exact_dedup, language, minhash, packing, quality, secrets, sentencepiece_fst, simhash, substring_dedup, toxicity
from tests.llm.fixtures import SCHEMA, rows

SPACE = re.compile(r"[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def unique(docs):
    return docs.where("doc_id is not null and not (doc_id = 3 and n_chars is not null)").dropDuplicates(["doc_id"])


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def least(ids):
    known = [i for i in ids if i is not None]
    return min(known) if known else None


# exact dedup


def test_exact_dedup(docs, empty):
    groups = defaultdict(list)
    for r in rows():
        groups[SPACE.sub(" ", r[1] or "")].append(r[0])
    want = Counter((i, least(ids), len(ids), i == least(ids), sha(t)) for t, ids in groups.items() for i in ids)
    assert Counter(map(tuple, exact_dedup.exact_dedup(docs).collect())) == want
    assert Counter(map(tuple, exact_dedup.exact_dedup(docs, nodes=200).collect())) == want
    assert exact_dedup.exact_dedup(empty).collect() == []


def test_drop_copies(docs, empty):
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    groups = defaultdict(list)
    for r in rows():
        groups[SPACE.sub(" ", r[1] or "")].append(r[0])
    assert Counter((r.doc_id, SPACE.sub(" ", r.text or "")) for r in got.collect()) == Counter((least(ids), t) for t, ids in groups.items())
    assert exact_dedup.drop_copies(empty).collect() == []


def test_rounds_are_the_only_exchanges(spark):
    runs = exact_dedup.digests(spark.range(100).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")))
    for nodes, rounds in ((64, 3), (16, 2), (4, 1), (2, 1)):
        plan = exact_dedup.tree_merge(runs, nodes)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == rounds


# SimHash


def simple_fingerprint(text) -> int:
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints: list[tuple], bits: int) -> list:
    component = list(range(len(prints)))

    def find(k):
        while component[k] != k:
            k = component[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= bits:
                component[find(a)] = find(b)
    members = defaultdict(list)
    for k in range(len(prints)):
        members[find(k)].append(prints[k][0])
    return [least(members[find(k)]) for k in range(len(prints))]


def test_simhash(docs, empty):
    prints = [(r[0], simple_fingerprint(r[1])) for r in rows()]
    want = Counter((i, fp, c) for (i, fp), c in zip(prints, linked(prints, 2), strict=True))
    got = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_dedup(docs).collect())
    assert got == want
    assert simhash.near_dedup(empty).collect() == []
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for _, _, c in want} | {None} - {None}


@pytest.mark.parametrize("threshold", [1, 2, 3, 4])
def test_anchor_cover_misses_no_pair(spark, threshold):
    r = np.random.default_rng(threshold)
    base = r.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2)
    prints = [int(x) for x in base] + [0, (1 << 64) - 1]
    for x in list(prints):
        for n in range(1, 6):
            flips = r.choice(64, n, replace=False)
            prints.append(x ^ int(sum(1 << int(b) for b in flips)))
    signed = sorted({x - (1 << 64) if x >> 63 else x for x in prints})
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= threshold}
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), threshold).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 299), (299, 300)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)} | {299: 299, 300: 299}


# secrets

KINDS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]


def base_spans(text) -> list[tuple]:
    return sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(KINDS) for m in p.finditer(text or "") if ok(m))


def test_secret_spans(docs, empty):
    got = [(r.doc_id, [(s.start, s.kind, s.end) for s in r.spans if s.kind < 3]) for r in secrets.secret_scan(docs).collect()]
    assert Counter(map(str, got)) == Counter(str((r[0], base_spans(r[1]))) for r in rows())
    assert secrets.secret_scan(empty).collect() == []


def test_ownership_separates_copied_from_live(spark):
    key = "sk_live_AbC123dEf456GhI789"
    own = "pk_test_ZyX987wVu654TsR321"
    data = [(k, f"see {key} there", f"owner{k}") for k in range(5)] + [(9, f"see {own} there", "owner1"), (10, f"again {own}", "owner1")]
    got = {r.doc_id: r.spans for r in secrets.secret_scan(spark.createDataFrame(data, "doc_id bigint, text string, source string")).collect()}
    assert all(got[k] == [] for k in range(5))
    assert [(s.start, s.end, s.live, s.n_repos, s.n_owners) for s in got[9]] == [(4, 30, True, 2, 1)]


def test_redaction(docs):
    got = {r.doc_id: r.text for r in secrets.redact(docs.where("doc_id in (6, 7, 13, 14)")).collect()}
    assert got[6] is None and got[7] == ""
    assert got[13] == '[assign]" then [access] é\U0001d538 [hex]'
    assert got[14] == 'passwd:short token=secret: abcdefghij api-key [assign]"'


# packing


def test_packing(unique, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    pieces = packing.pack(unique, path).collect()
    texts = {r.doc_id: r.text for r in unique.collect()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(texts)
    for k, own in by_doc.items():
        ids = t.encode(texts[k] or "", add_special_tokens=False).ids + [0]
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 0.02 * sum(p.length for p in pieces)
    assert packing.pack(empty, path).collect() == []


def test_ids_equal_the_tokenizers(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, ids = Tokenizer.from_file(path), packing.Ids(path)
    odd = ["a  b\t\n c  ", "x<|endoftext|>y", "it's  don't  x　　y 12 ab12\r\n", "\x1c a\x1f b", " ", "\n", "a\n\nb", " x", "\x85 y", "a \n b", "café\nü \U0001d538"]
    for text in [*odd, *(r[1] or "" for r in rows())]:
        assert np.frombuffer(ids.of(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text[:40]


@pytest.mark.parametrize("run", [" " * 3_000_000, "\t" * 1_000_000, "\n" * 1_000_000, " \n" * 500_000, "\u3000 " * 100_000])
def test_ids_of_long_white_space(run):
    """tiktoken alone ends in a panic at runs of a million."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, ids = Tokenizer.from_file(path), packing.ids_of(path)
    for text in ["a" + run + "word  two" + run, run + "a<|endoftext|>"]:
        assert np.frombuffer(ids.of(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_packing_of_long_white_space(spark):
    text = "a" + " " * 1_000_000 + "b"
    pieces = packing.pack(spark.createDataFrame([(1, text), (2, "c")], "doc_id bigint, text string"), public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert {p.doc_id: p.doc_tokens for p in pieces} == {1: len(packing.ids_of(public_tokenizers.path("byte_bpe_50k.json")).of(text)) // 4 + 1, 2: 2}


# substring dedup


def without_repeats(data: list[tuple], n: int = 50) -> list[tuple]:
    first = {}
    low = -(1 << 63)
    for r in data:
        w = words(r[1])
        for k in range(len(w) - n + 1):
            run, i = tuple(w[k : k + n]), low if r[0] is None else r[0]
            first[run] = min(first.get(run, i), i)
    out = []
    for r in data:
        w, i = words(r[1]), low if r[0] is None else r[0]
        gone = {k + j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < i for j in range(n)}
        out.append((r[0], len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def test_substring_dedup(docs, empty):
    got = substring_dedup.repeats(docs).drop("spans").collect()
    assert Counter(map(tuple, got)) == Counter(without_repeats(rows()))
    assert substring_dedup.repeats(empty).collect() == []


def test_equal_runs_pick_equal_seeds():
    r = np.random.default_rng(3)
    w = r.integers(0, 40, 3000).astype(np.uint64)
    hashes, at = substring_dedup.picked(w)
    assert len(at) == len(w) - substring_dedup.LENGTH + 1
    assert ((at >= np.arange(len(at))) & (at + substring_dedup.SEED <= np.arange(len(at)) + substring_dedup.LENGTH)).all()
    moved = substring_dedup.picked(np.concatenate((w[500:900], w[:100])))[1]
    assert (moved[:351] == at[500:851] - 500).all()


# fingerprints


def test_fingerprints(docs, unique, empty):
    data = sorted(((r.doc_id, r.text or "") for r in unique.collect()), reverse=True)
    got = {r.doc_id: r for r in minhash.fingerprints_with_next(unique).collect()}
    assert len(got) == len(data)
    for k, (i, text) in enumerate(data):
        following = data[(k + 1) % len(data)][1]
        half = len(text) // 2
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == sha(text[: len(text) - half] + following[:half])
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[6].fingerprint == got[7].fingerprint == got[8].fingerprint
    assert minhash.fingerprints_with_next(docs).count() == len(rows())
    assert minhash.fingerprints_with_next(empty).collect() == []
    one = minhash.fingerprints_with_next(unique.where("doc_id = 0")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_likeness_estimates_jaccard():
    text = [f"w{k}" for k in range(2000)]
    a, b = " ".join(text[:1500]), " ".join(text[500:])
    assert abs(minhash.likeness(minhash.fingerprint(a), minhash.fingerprint(b)) - 0.5) < 0.15


def test_near_duplicates(docs, empty):
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs.where("doc_id <> 3")).collect()}
    assert got[0] == got[1] == got[2] == 0 and got[16] == 16
    assert got[6] == got[7] == got[8] == 6 and got[4] == 4 and got[9] == 9
    assert minhash.near_duplicates(empty).collect() == []


# language, quality, toxicity


def held_out(spark, sf, query, label, size="sf0.01"):
    got = query(spark, f"/root/testdata/{size}")
    truth = spark.read.parquet(f"/root/testdata/{size}/" + ("documents" if label == "lang" else "labels") + ".parquet").select("doc_id", label)
    return [r for r in got.join(truth, "doc_id").collect() if r.held_out]


def test_language(spark, sf, docs, empty):
    scored = held_out(spark, sf, language.op6_language, "lang")
    assert sum(r.lang_pred == r.lang for r in scored) > 0.98 * len(scored)
    filters = language.fit(docs)
    got = language.predict(docs, filters).collect()
    assert len(got) == len(rows()) and all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (6, 7, 8))
    assert all(r.lang_pred == "und" for r in language.predict(docs, language.fit(empty)).collect())
    assert language.predict(empty, filters).collect() == []


def test_language_filter_returns_all_languages_of_an_ngram():
    grams = {name: np.arange(k * 50, k * 50 + 100, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for k, name in enumerate("abcdefgh")}
    filters = language.Filters(grams)
    for name, keys in grams.items():
        counts = filters.counts(keys)
        assert counts[filters.languages.index(name)] == pytest.approx(100, abs=1)
        assert sorted(counts.round())[-3:] == [50, 50, 100] or name in "ah"


def test_quality(spark, sf, docs, empty):
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.score(empty, quality.fit(empty, labels)).collect() == []
    scored = held_out(spark, sf, quality.op2_quality, "quality")
    assert sum(r.predicted == r.quality for r in scored) > 0.95 * len(scored)


def test_toxicity(spark, sf, docs, empty):
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(17)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()}) == 1
    assert toxicity.score(empty, toxicity.fit(empty, labels)).collect() == []
    scored = held_out(spark, sf, toxicity.op7_toxicity, "toxic")
    assert sum(r.predicted for r in scored if not r.toxic) <= 0.03 * len(scored)
    assert sum(r.predicted for r in scored if r.toxic) >= 0.6 * sum(r.toxic for r in scored)
    scored = held_out(spark, sf, toxicity.op7_toxicity, "toxic", "sf0.1")
    assert sum(r.predicted for r in scored if not r.toxic) <= 0.01 * len(scored)
    assert sum(r.predicted for r in scored if r.toxic) >= 0.9 * sum(r.toxic for r in scored)


# slow plain versions of the scores


def test_quality_score_is_a_sum_of_table_entries(spark):
    r = np.random.default_rng(1)
    x = np.round(r.normal(size=(500, 5)), 1)
    m = PairwiseAdditive.fit(x, ((x[:, 0] + x[:, 1] * x[:, 2] + r.normal(size=500) / 3) > 0).astype(float), rounds=30)
    assert len(m.pairs) > 0

    def bin_of(cuts, v):
        return sum(1 for c in cuts if c < v)

    def slow(row):
        total = m.base + sum(float(t[bin_of(c, v)]) for t, c, v in zip(m.tables, m.cuts, row, strict=True))
        total += sum(float(t[bin_of(m.coarse[i], row[i]), bin_of(m.coarse[j], row[j])]) for i, j, t in m.pairs)
        return 1 / (1 + math.exp(-total))

    test = np.round(r.normal(size=(200, 5)) * 2, 1)
    assert m.score(test) == pytest.approx([slow(row) for row in test.tolist()])


def test_tree_score_is_a_walk_to_a_leaf_and_calibration_a_line():
    r = np.random.default_rng(2)
    x = np.round(r.normal(size=(400, 4)), 1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = BoostedTrees.fit(x, y, rounds=20)

    def slow(row):
        total = m.base
        for feature, border, value in m.trees:
            node = 0
            for _ in range(m.depth):
                k = int(feature[node])
                node = 2 * node + 1 + (sum(1 for c in m.cuts[k] if c < row[k]) > border[node])
            total += float(value[node - (2**m.depth - 1)])
        return total

    test = np.round(r.normal(size=(200, 4)) * 2, 1)
    raw = m.score(test)
    assert raw == pytest.approx([slow(row) for row in test.tolist()])
    iso = Isotonic.fit(m.score(x), y)

    def line(v):
        if v <= iso.x[0]:
            return iso.y[0]
        for a, b, ya, yb in zip(iso.x, iso.x[1:], iso.y, iso.y[1:], strict=False):
            if a < v <= b:
                return ya + (yb - ya) * (v - a) / (b - a)
        return iso.y[-1]

    assert iso(raw) == pytest.approx([line(float(v)) for v in raw])


def test_toxicity_score_follows_from_lexicon_trees_and_calibration(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    m = toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    texts = [r.text for r in docs.limit(40).collect()]
    want = [float((m.calibration or (lambda v: 1 / (1 + np.exp(-v))))(m.trees.score(np.array([toxicity.features(t, m.lexicon)]))[0])) for t in texts]
    assert m.score(texts) == pytest.approx(want)


def test_language_counts_look_every_ngram_up(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    filters = language.fit(docs)
    for text in [r.text for r in docs.limit(15).collect()] + ["½ ② x", "Ⅷ ①"]:
        keys = [int(k) for k in language.ngrams(language.code_points(text))]
        found = dict.fromkeys(filters.languages, 0)
        for key in keys:
            slots = [((key * int(m)) % (1 << 64)) >> (65 - filters.slots.bit_length()) for m in language._MIX[1:4]]
            for k, name in enumerate(filters.languages):
                found[name] += all(int(filters.words[0][s]) >> k & 1 for s in slots)
        want = [max(0.0, (found[n] - len(keys) * rate) / (1 - rate)) for n, rate in zip(filters.languages, filters.rate, strict=True)]
        assert filters.counts(np.array(keys, np.uint64)) == pytest.approx(want)
        if sum(want):
            assert filters.predict(text) == (filters.languages[int(np.argmax(want))], pytest.approx(max(want) / sum(want)))
    assert filters.predict("½ ² ① Ⅷ 12 _") == ("und", 0.0)


def test_minhash_fingerprint_is_the_low_byte_of_each_smallest_value():
    text = " ".join(f"w{k % 37}x{k % 11}" for k in range(300))
    hashes = [int(h) for h in minhash.shingles(text.encode())]
    want = bytes(min((int(a) * h + int(b)) % (1 << 64) >> 32 for h in hashes) % 256 for a, b in zip(minhash._A[:, 0], minhash._B[:, 0], strict=True))
    assert minhash.fingerprint(text) == want
    other = text.replace("w3x3", "y")
    agree = sum(a == b for a, b in zip(want, minhash.fingerprint(other), strict=True)) / 128
    assert minhash.likeness(want, minhash.fingerprint(other)) == pytest.approx(max(0, (agree - 1 / 256) / (1 - 1 / 256)))


def test_classes_of_near_duplicates_against_all_pairs(spark):
    """All pairs of 2,000 documents of sf0.1 and their edited copies."""
    import random

    r = random.Random(9)
    texts = [t.text for t in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 1400 and n_chars < 20000").collect()]
    for t in list(texts[:600]):
        w = t.split(" ")
        for _ in range(max(1, int(len(w) * r.choice([0.01, 0.02, 0.03])))):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = [set(zip(*(w[k:] for k in range(min(5, len(w)))), strict=False)) if (w := words(t)) else set() for t in texts]
    index, common, root = defaultdict(list), Counter(), list(range(len(texts)))
    for k, s in enumerate(sets):
        for x in s:
            index[x].append(k)
    for members in index.values():
        common.update((a, b) for j, b in enumerate(members) for a in members[:j])

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    pairs = [(a, b) for (a, b), n in common.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(docs).collect()}
    assert len(pairs) > 300 and sum(got[a] == got[b] for a, b in pairs) == len(pairs)
    assert all(find(k) == got[k] for k in got if sets[k])


def test_isotonic_never_falls():
    r = np.random.default_rng(0)
    s = r.normal(size=400)
    f = Isotonic.fit(s, (r.random(400) < 1 / (1 + np.exp(-3 * s))).astype(float))
    out = f(np.linspace(-4, 4, 200))
    assert (np.diff(out) >= 0).all() and out[0] < 0.1 and out[-1] > 0.9


# SentencePiece


def test_sentencepiece(docs, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sentencepiece_fst.encode(docs, path).collect()
    want = Counter((r[0], tuple(sp.encode(r[1] or ""))) for r in rows())
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    back = sentencepiece_fst.decode(sentencepiece_fst.encode(docs, path), path).collect()
    assert Counter(map(tuple, back)) == Counter((i, sp.decode(list(ids))) for i, ids in want.elements())
    trips = sentencepiece_fst.round_trips(docs, path).collect()
    assert len(trips) == len(rows()) and all(r.same for r in trips)
    assert sentencepiece_fst.encode(empty, path).collect() == []


def test_sentencepiece_odd_texts_and_ids():
    import random

    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, fst = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_fst.Transducer(path)
    r = random.Random(5)
    texts = ["a▁b", "  a  b \n", " a", "\x00a", "<s>", "▁", "日本語", "aaaaaaaaaaaaa", "\n", " \n", "<0x0A>", "\U0001f389 ok"]
    texts += ["".join(r.choice("abcdefghijklmnopqrstuvwxyzABC   ..,\n\t0123é▁日<>=_-/") for _ in range(r.randint(1, 40))) for _ in range(500)]
    for t in texts:
        assert fst.encode(t) == sp.encode(t), t
        assert fst.decode_packed(fst.encode_packed(t)) == sp.decode(sp.encode(t)), t
    for ids in [[r.randrange(32000) for _ in range(8)] for _ in range(300)] + [[r.randrange(3, 259) for _ in range(5)] for _ in range(300)]:
        assert fst.decode(ids) == sp.decode(ids), ids


def test_sentencepiece_bytes_are_arcs():
    """Characters that no piece has go through the byte arcs of the composed machine, and back through the inverted one."""
    import random

    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, fst = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_fst.Transducer(path)
    assert all(label in fst.step[fst.root] for label in sentencepiece_fst.BYTE_LABELS)
    r = random.Random(3)
    strange = [c for c in map(chr, [*range(0x20), *range(0x2600, 0x2700), *range(0x1F300, 0x1F500), 0x10FFFF]) if c not in fst.alphabet]
    assert len(strange) > 200
    for text in [*strange, *("".join(r.choice([*strange, "a", " ", "the", "▁"]) for _ in range(r.randint(1, 30))) for _ in range(300))]:
        ids = fst.encode(text)
        assert ids == sp.encode(text) and fst.decode(ids) == sp.decode(ids), text
    assert fst.best_path(fst.labels(strange[-1])) == [sentencepiece_fst.BYTE_LABELS[b] for b in strange[-1].encode()]
    # a control id parts the bytes of a character; at the beginning only the first mark is taken back
    euro, other = [sp.piece_to_id(f"<0x{b:02X}>") for b in "€".encode()], sp.piece_to_id("</s>")
    for ids in [[*euro[:1], other, *euro[1:]], [other, *sp.encode("a")], [sp.unk_id(), *sp.encode("a")], [], euro[1:] + euro]:
        assert fst.decode(ids) == sp.decode(ids), ids


def test_machines_compose_and_give_the_lightest_path():
    from filelens.llm._wfst import EPS, Machine, compose, invert, lightest_writings, linear, shortest_path

    a = Machine()
    one, two = a.state(), a.state()
    a.arc(0, "x", "p", 1.0, one)
    a.arc(0, "x", "q", 0.5, two)
    a.arc(one, "y", EPS, 0.0, two)
    a.arc(two, "y", "r", 3.0, two)
    a.finals = {two: 0.25}
    assert shortest_path(compose(linear("xy"), a)) == (1.25, ["p"])
    assert shortest_path(compose(linear("xyy"), a)) == (4.25, ["p", "r"])
    assert shortest_path(compose(linear("pr"), invert(a))) == (4.25, ["x", "y", "y"])
    assert lightest_writings(invert(a), a.start) == {"p": ("x",), "q": ("x",)}
    assert lightest_writings(invert(a), one) == {"r": ("y", "y")}
    assert shortest_path(compose(linear("yx"), a)) == (float("inf"), [])
    # input o (normaliser o lexicon) with weights, as a model of kind unigram has them
    weights = {"▁": 5.0, "a": 3.0, "b": 3.0, "ab": 4.0, "▁a": 3.5, "ba": 2.0}
    both = compose(sentencepiece_fst.normaliser(set("▁ab"), True), sentencepiece_fst.lexicon(weights, weights))

    def brute(text):
        if not text:
            return 0.0
        return min((weights[p] + brute(text[len(p) :]) for p in weights if text.startswith(p)), default=float("inf"))

    for text in ["ab", "ba ab", "abab ba", " a b", "bbaab"]:
        weight, pieces = shortest_path(compose(linear(text), both))
        assert weight == brute("▁" + text.replace(" ", "▁")) and "".join(pieces) == "▁" + text.replace(" ", "▁")


def test_search_by_position_is_the_composition_written_out():
    """input o lexicon o grammar as machines, for a few words of the model, against the search."""
    from filelens.llm._wfst import INFINITE, Machine, compose, linear, shortest_path

    fst = sentencepiece_fst.Transducer(public_tokenizers.path("piece_bpe_32k.model"))
    for word in ["▁banana", "▁unhappiness", "▁xylophonés", "ababab"]:
        pieces = sorted({word[a:b] for a in range(len(word)) for b in range(a + 1, len(word) + 1) if word[a:b] in fst.ids or b == a + 1})
        grammar = Machine()
        state = {p: grammar.state() for p in pieces}
        for s in ["", *pieces]:
            for t in pieces:
                grammar.arc(state.get(s, 0), t, t, 0.0 if fst.merged(s + t) == ([s, t] if s else [t]) else INFINITE, state[t])
        grammar.finals = dict.fromkeys(state.values(), 0.0)
        assert shortest_path(compose(compose(linear(word), sentencepiece_fst.lexicon(pieces)), grammar)) == (0.0, fst.best_path(word))


@pytest.mark.parametrize("least", [0.6, 0.7, 0.8])
def test_recall_of_bands_at_the_similarity_asked_for(spark, least):
    """Every pair of similarity ``least`` and more among edited copies, by brute force; bands lose none of some hundreds."""
    import random

    r = random.Random(round(100 * least))
    data = []
    for k in range(150):
        words = [f"w{r.randrange(3000)}" for _ in range(80)]
        data.append(" ".join(words))
        for _ in range(2):
            edited = list(words)
            for at in r.sample(range(80), r.randint(1, 6)):
                edited[at] = f"e{r.randrange(3000)}"
            data.append(" ".join(edited))
    sets = [set(minhash.shingles(t.encode()).tolist()) for t in data]
    near = [(a, b) for a in range(len(data)) for b in range(a - a % 3, a) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    assert len(near) > 40
    docs = spark.createDataFrame(list(enumerate(data)), "doc_id bigint, text string").repartition(3)
    found = {x.doc_id: x.class_id for x in minhash.near_duplicates(docs, least=least).collect()}
    missed = sum(found[a] != found[b] for a, b in near)
    assert missed <= 0.002 * len(near)
    want = list(range(len(data)))
    for a, b in near:
        low, high = sorted((want[a], want[b]))
        want = [low if x == high else x for x in want]
    assert missed or [found[k] for k in range(len(data))] == want


def test_band_widths():
    assert [minhash.band_width(x) for x in (0.8, 0.7, 0.6, 0.5)] == [5, 4, 3, 2]
    with pytest.raises(ValueError):
        minhash.band_width(0.02)


@pytest.mark.parametrize("n", [0, 1, 5, 20_000])
def test_ranges_are_looked_up_among_the_borders(n):
    """Any number of borders, keys that are borders' more than once, the smallest and largest numbers."""
    import random

    import pyarrow as pa

    r = random.Random(n)
    borders = minhash._borders(sorted(r.choice([r.randrange(-(1 << 63), 1 << 63), 7, -5, minhash.LOWEST]) for _ in range(n)))
    keys = [minhash.LOWEST, (1 << 63) - 1, 7, 7, 7, -5, 0, *(k for k, _ in borders[:50]), *(r.randrange(-(1 << 63), 1 << 63) for _ in range(50))]
    rows = [(k, r.randbytes(32)) for k in keys]
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([d for _, d in rows], pa.binary())], names=["key", "digest"])
    [out] = minhash._placing(borders)([batch])
    assert out.column("part").to_pylist() == [sum(b < row for b in borders) for row in rows]


def test_keep_good_with_any_column_name(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"a.b": F.lit(1), "c`d": F.lit("x"), "row": F.lit(2), "score": F.lit(3)})
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.keep_good(docs, labels)
    plain = quality.keep_good(docs.drop("a.b", "c`d", "row", "score"), labels)
    assert got.columns == docs.columns and sorted(x.doc_id for x in got.collect()) == sorted(x.doc_id for x in plain.collect())


# features against slow versions


def test_edited_fingerprints_by_hand(spark, unique):
    """op4's texts, fingerprints and likenesses, document by document."""
    data = sorted(((x.doc_id, x.text or "") for x in unique.collect()), key=lambda x: -x[0])
    want = {}
    for k, (doc_id, text) in enumerate(data):
        follows = data[(k + 1) % len(data)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + follows[:half]
        own, new, beside = (minhash.fingerprint(t) for t in (text, edited, follows))
        like = lambda a, b: max(0.0, (sum(x == y for x, y in zip(a, b, strict=True)) / 128 - 1 / 256) / (1 - 1 / 256))
        want[doc_id] = (len(text), sha(edited), own.hex(), new.hex(), like(own, new), like(own, beside))
    got = {x.doc_id: (x.n_chars, x.edited_sha256, x.fingerprint, x.edited_fingerprint, x.near_edited, x.near_next) for x in minhash.fingerprints_with_next(unique).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][:4] == want[k][:4] and got[k][4:] == pytest.approx(want[k][4:])
