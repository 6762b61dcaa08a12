"""Cases that a review found cut short."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from filelens.llm import minhash, packing, secrets, sentencepiece_fst, simhash, toxicity
from filelens.llm._common import small_batches
from filelens.llm._wfst import compose, linear, shortest_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, data: list[tuple], owner: str = "s"):
    """Documents of (id, text)."""
    return spark.createDataFrame([(i, t, "en", owner, len(t or "")) for i, t in data], SCHEMA).repartition(3)


def prose(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def jaccard(a: str, b: str) -> float:
    x, y = (set(zip(*(t.lower().split()[k:] for k in range(5)), strict=False)) for t in (a, b))
    return len(x & y) / len(x | y)


# pipeline, near_dedup


def edited(words: list[str], *at: int) -> list[str]:
    return [f"edit{k}" if k in at else w for k, w in enumerate(words)]


def test_near_copies_beyond_the_bits_of_op3_go(spark):
    base = prose(1, 300)
    near, far = " ".join(edited(base, 40, 140, 220, 280)), " ".join(edited(base, *range(5, 300, 25)))
    text = " ".join(base)
    assert jaccard(text, near) >= 0.8 > jaccard(text, far)
    assert bin(simhash.fingerprint(text.encode()) ^ simhash.fingerprint(near.encode())).count("1") > 2
    docs = frame(spark, [(1, text), (2, near.upper()), (3, far), (4, " ".join(prose(2, 80)))])
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == {1, 3, 4}


@pytest.mark.parametrize("seed", [1])
def test_every_pair_of_a_bucket_is_compared(spark, seed):
    """Texts that drift from one to the next, so that few are near their bucket's smallest node."""
    r = random.Random(seed)
    data = []
    for k in range(6):
        words = prose(100 * seed + k, 150)
        for _ in range(25):
            words = edited(words)
            for at in r.sample(range(len(words)), 2):
                words[at] = f"x{r.randrange(10**6)}"
            data.append((len(data), " ".join(words)))
    r.shuffle(data)
    root = {i: i for i, _ in data}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in data:
        for j, b in data:
            if j < i and jaccard(a, b) >= 0.8:
                hi, lo = sorted((find(i), find(j)), reverse=True)
                root[hi] = lo
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(frame(spark, data)).collect()}
    assert got == {i: find(i) for i, _ in data}


def classes_by_all_pairs(data: list[tuple]) -> dict:
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for i, t in data}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in sets.items():
        for j, y in sets.items():
            if j < i and len(x & y) >= 0.8 * len(x | y):
                hi, lo = sorted((find(i), find(j)), reverse=True)
                root[hi] = lo
    return {i: find(i) for i in sets}


def copies(base: list[str], n: int, edits: tuple, r: random.Random) -> list[str]:
    """Near copies of one text, each with changes of its own."""
    out = []
    for k in range(n):
        words = list(base)
        for at in r.sample(range(len(words)), edits[k % len(edits)]):
            words[at] = f"y{r.randrange(10**9)}"
        out.append(" ".join(words))
    return out


def test_few_pairs_of_a_large_group_of_near_copies_are_compared(spark, monkeypatch):
    """Copies that are nearly similar enough to each other share most shingles, so none may be compared for these alone."""
    verified, linked = [], minhash._linked

    def counted(pairs, *rest):
        verified.append(pairs.count())
        return linked(pairs, *rest)

    monkeypatch.setattr(minhash, "_linked", counted)
    r = random.Random(5)
    data = list(enumerate(copies(prose(7, 150), 300, (2, 3, 3, 3, 4), r)))
    r.shuffle(data)
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(frame(spark, data)).collect()}
    assert got == classes_by_all_pairs(data)
    assert len(set(got.values())) > 20 and sum(verified) < 300 * 299 / 2 / 4, verified


def test_a_group_of_two_texts_and_their_copies(spark):
    """No shingle is in more than half of a group that two texts share evenly, and sizes differ."""
    r = random.Random(6)
    half = prose(8, 120)
    texts = copies(half + prose(9, 40), 40, (1, 3, 4, 5), r) + copies(half + prose(10, 44), 40, (0, 2, 4, 6), r) + copies(half, 25, (1, 2, 3), r) + [" ".join(half[: 90 + k]) for k in range(0, 30, 3)]
    data = list(enumerate(texts))
    r.shuffle(data)
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(frame(spark, data)).collect()}
    assert got == classes_by_all_pairs(data)


def test_near_dedup_runs_operator_3s_anchors(spark, sf, monkeypatch):
    """With one band of the whole signature, which near copies don't share, the stage finds what the anchors reach."""
    monkeypatch.setattr(minhash, "band_width", lambda least: minhash.PERMUTATIONS)
    base, other = prose(21, 1500), prose(22, 1500)
    data = [(1, " ".join(base)), (2, " ".join(other)), (3, ""), (4, None)]
    data += [(10 + k, " ".join(edited(base, 70 * k, 70 * k + 9))) for k in range(1, 20)]
    sets = {i: minhash.shingle_set((t or "").encode(), True) for i, t in data}
    prints, sigs = {i: simhash.majority(h) for i, h in sets.items()}, {i: minhash.signature(h).tobytes() for i, h in sets.items()}
    reached = {i for i in sets if i >= 10 and (prints[i] ^ prints[1]).bit_count() <= 2 and len(np.intersect1d(sets[i], sets[1])) >= 0.8 * len(np.union1d(sets[i], sets[1]))}
    assert sum(sigs[i] not in {sigs[j] for j in sets if j != i} for i in reached) > 1
    assert len({prints[i] for i in reached | {1}}) > 1  # not only those of one SimHash
    kept = {x.doc_id for x in corpus_pipeline.drop_near_copies(spark, frame(spark, data), sf).collect()}
    assert {1, 2, 3} <= kept and 4 not in kept and not kept & reached
    assert {x.doc_id: x.class_id for x in minhash.near_duplicates(frame(spark, data)).collect()}[2] == 2


def test_anchors_pair_each_node_once_with_the_first_of_its_simhash(spark):
    rows = [(same, 5) for same in range(1, 40)] + [(50, 4), (60, 1 << 63), (70, 12), (1, 5)]
    own = spark.createDataFrame([(s, simhash.signed(fp)) for s, fp in rows], "same bigint, fp bigint")
    got = [(x.a, x.b) for x in minhash._at_anchors(own, 2).collect()]
    assert sorted(got) == sorted([(k, 1) for k in range(2, 40)] + [(50, 1), (70, 1), (70, 50), (60, 50)])


def test_rows_with_null_and_repeated_ids_keep_their_own_verdicts(spark):
    near = prose(1, 300)
    a, b = " ".join(near), " ".join(edited(near, 150))
    clean, other = " ".join(prose(2, 90)), " ".join(prose(3, 90))
    docs = frame(spark, [(1, a), (None, b), (None, clean), (None, other), (7, b + " more"), (7, " ".join(prose(4, 60)))])
    for drop in (minhash.drop_near_copies, lambda d: simhash.drop_near_copies(d, threshold=4)):
        kept = [(r.doc_id, r.text) for r in drop(docs).collect()]
        assert {(1, a), (None, clean), (None, other), (7, " ".join(prose(4, 60)))} <= set(kept) and len(kept) == len(set(kept))
    assert len([x for x in minhash.drop_near_copies(docs).collect()]) == 4


def test_redaction_of_null_and_repeated_ids(spark):
    texts = ["my password=abcdefgh1 x", "a longer beginning token: zyxwvuts2 y", "nothing here"]
    docs = frame(spark, [(i, t) for i in (None, 5) for t in texts])
    want = ["my [assign] x", "a longer beginning [assign] y", "nothing here"]
    got = sorted((str(r.doc_id), r.text) for r in secrets.redact(docs).collect())
    assert got == sorted((str(i), t) for i in (None, 5) for t in want)


# op10_packing


def test_added_tokens_keep_their_ids():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, ids = Tokenizer.from_file(path), packing.Ids(path)
    assert np.frombuffer(ids.of("a <|endoftext|> b"), "<u4").tolist() == [64, 220, 50256, 275]
    for text in ["<|endoftext|>", "x<|endoftext|>y", "<|endoftext|><|endoftext|> a", "a\n<|endoftext|>\n\nb  ", "<|endoftext|", "<|<|endoftext|>|>", " <|endoftext|>　c"]:
        assert np.frombuffer(ids.of(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


# op1_secrets


def live(spark, data: list[tuple]) -> bool:
    """The verdict on the one value in documents of (text, owner)."""
    docs = spark.createDataFrame([(k, *x) for k, x in enumerate(data)], "doc_id bigint, text string, source string")
    verdicts = {s.live for r in secrets.secret_scan(docs).collect() for s in r.spans}
    assert len(verdicts) <= 1
    return verdicts == {True}


def test_an_owners_own_secret_stays_live_however_often_it_occurs(spark):
    key = "sk_live_AbC123dEf456GhI789"
    assert live(spark, [(f"{key} in {k}", "one") for k in range(12)])
    assert live(spark, [(f"the same {key}", f"owner{k % 2}") for k in range(12)])
    assert not live(spark, [(f"{key} in {k}", f"owner{k % 2}") for k in range(12)])
    assert not live(spark, [(f"the same {key}", f"owner{k}") for k in range(3)])


# op7_toxicity


def test_hits_beside_a_second_person_are_counted_in_long_texts():
    at = toxicity.FEATURES.index("addressed")
    far = "you " * 1100 + "filler " * 10 + "bad " * 1100
    assert toxicity.features(far, {"bad": 1.0})[at] == 0
    assert toxicity.features(far + "you", {"bad": 1.0})[at] == 4
    r = random.Random(1)
    words = [r.choice(["you", "bad"] + ["other"] * 12) for _ in range(800)]
    you, hits = ([k for k, w in enumerate(words) if w == x] for x in ("you", "bad"))
    assert toxicity.features(" ".join(words), {"bad": 1.0})[at] == sum(any(abs(k - y) <= 4 for y in you) for k in hits)


def test_hits_and_pronouns_by_thousands():
    r = random.Random(2)
    words = ["bad"] * 3000 + ["you"] * 3000 + ["other"] * 9000
    r.shuffle(words)
    you, hits = ([k for k, w in enumerate(words) if w == x] for x in ("you", "bad"))
    near = {p + d for p in you for d in range(-4, 5)}
    assert toxicity.beside(hits, you) == sum(k in near for k in hits)


def test_many_matches_in_one_text(spark):
    import time

    text = "token=abcdefgh000000 " * 6000 + "sk_live_AbC123dEf456GhI789 " * 4000
    docs = spark.createDataFrame([(1, text, "a"), (2, "x", "b")], "doc_id bigint, text string, source string")
    secrets.secret_scan(docs).collect()
    began = time.time()
    got = {r.doc_id: r.spans for r in secrets.secret_scan(docs).collect()}
    assert time.time() - began < 10
    assert len(got[1]) == 10_000 and got[2] == [] and (got[1][-1].start, got[1][-1].end) == (len(text) - 27, len(text) - 1)
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert clean[1] == "[assign] " * 6000 + "[opaque] " * 4000


def test_a_text_that_repeats_its_words_gives_each_run_once(spark):
    from filelens.llm import substring_dedup
    from tests.llm.test_operators import without_repeats

    data = [(1, "again " * 3000), (2, "again " * 2500 + "end"), (3, "again and " * 200 + " ".join(prose(1, 70))), (4, " ".join(prose(1, 70)))]
    got = substring_dedup.repeats(frame(spark, data)).drop("spans").collect()
    assert sorted(map(tuple, got)) == sorted(without_repeats(data))


def test_harmonic_bins_hold_whole_documents():
    lengths = [random.Random(3).randrange(1, 3000) for _ in range(3000)]
    packer, out = packing.HarmonicPacker(), []
    for k, n in enumerate(lengths):
        out += packer((k, bytes(4 * n)))
    out += packer.finish()
    used, whole = {}, {}
    for doc, start, n, _, total, sequence, at in out:
        assert at == used.get(sequence, 0)
        used[sequence] = at + n
        whole.setdefault(sequence, []).append(n == total)
    assert sum(used.values()) == sum(lengths) and all(n == 1024 or n & (n - 1) == 0 for n in used.values())
    assert len(out) < 2.5 * len(lengths)
    short = [k for k, n in enumerate(lengths) if n <= 1024]
    pieces = {k: 0 for k in short}
    for o in out:
        if o[0] in pieces:
            pieces[o[0]] += 1
    assert sum(n == 1 for n in pieces.values()) > 0.9 * len(short)


def test_fingerprints_hand_texts_to_python_in_small_batches(spark):
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(bound, None)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    try:
        spark.conf.set(bound, str(64 << 20))
        got = minhash.fingerprints_with_next(frame(spark, [(k, " ".join(prose(k, 30))) for k in range(20)]))
        texts = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("x"), 4000).alias("text"))
        batches = texts.mapInArrow(sizes, "n bigint, bytes bigint").collect()
        assert sum(b.n for b in batches) == 6000 and max(b.bytes for b in batches) < 5 << 20
        assert got.count() == 20
        spark.conf.set(bound, "1m")  # a smaller bound of the session holds
        small_batches(spark)
        assert spark.conf.get(bound) == "1m"
    finally:
        spark.conf.unset(bound) if before is None else spark.conf.set(bound, before)


# op9_sentencepiece

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_sentencepiece_weighs_less_than_an_arc_a_character():
    """A search of all states weighs 219 arcs for these 83 characters."""
    import sentencepiece

    fst, sp = sentencepiece_fst.Transducer(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    words = ["reintionen", "undeinaukeit", "oumentellevi", "laciónarcoga", "nthonentionen", "retioneaatteration"]
    assert [fst.best_path("▁" + w) for w in words] == [sp.encode(w, out_type=str) for w in words]
    assert fst.n_arcs < sum(len("▁" + w) for w in words)
    for text in ["a" * 30_000, "thethe" * 3000 + "q", "é" * 200 + "z" * 9000, "日本" * 2000, "-" * 4000 + "="]:
        assert fst.encode(text) == sp.encode(text)


def test_sentencepiece_arcs_are_bpe():
    fst, r = sentencepiece_fst.Transducer(PIECES), random.Random(11)
    pieces = sorted(p for p in fst.ids if len(p) <= 6)
    short = [p for p in pieces if len(p) <= 2] + ["日", "\x00", "\U0001f389"]
    pairs = [(r.choice(short), r.choice(short)) for _ in range(3000)] + [(p, p) for p in short] + [("", p) for p in pieces[:500]]
    pairs += [(r.choice(pieces), r.choice(pieces)) for _ in range(3000)]
    pairs += [(p[:k], p[k:]) for p in r.sample(pieces, 2000) for k in range(1, len(p))]
    weights = [fst.weigh(s, t) for s, t in pairs]
    assert weights == [0.0 if fst.merged(s + t) == ([s, t] if s else [t]) else float("inf") for s, t in pairs]
    assert 1000 < weights.count(0.0) < len(pairs) - 1000


def test_sentencepiece_search_adds_weights():
    """With a lexicon that has weights and a grammar without: the lightest path, not the first."""
    fst, weights = sentencepiece_fst.Transducer(PIECES), {"▁": 5.0, "a": 3.0, "b": 3.0, "ab": 4.0, "▁a": 3.5, "ba": 2.0, "abb": 9.0}
    fst.compile(compose(sentencepiece_fst.normaliser(set("▁ab"), True), sentencepiece_fst.lexicon(weights, weights)))
    fst.weigh = lambda s, t: 0.0
    for text in ["▁ab", "▁ba▁ab", "▁abab▁ba", "▁abba", "▁bbaab"]:
        weight, _ = shortest_path(compose(linear(text), sentencepiece_fst.lexicon(weights, weights)))
        got = fst.best_path(text)
        assert "".join(got) == text and sum(weights[p] for p in got) == weight


# op4_fingerprints, CPU seconds


def any_text(r: random.Random) -> str:
    letters = r.choice(["ab ", "abc  \n\t", "aé日 \x0b", "abcdef", "  ", "abcdefghij klmn opq rst uvw "])
    if r.random() < 0.6:
        return "".join(r.choice(letters) for _ in range(r.choice([*range(16), 25, 60, 400, 1500])))
    return "".join(r.choice([" ", "  ", "\n"]).join(f"w{r.randrange(30)}" for _ in range(r.randrange(300))))


def test_edited_fingerprints_from_their_parts():
    """Values of the two parts and of what is new at the cut give what the whole edited text gives, wherever the cut falls."""
    r = random.Random(11)
    for _ in range(4000):
        text, follows = any_text(r), any_text(r)
        one = minhash.Chained(text, r.randrange(60))
        two = minhash.Chained(follows, one.half)
        whole = text[: len(text) - len(text) // 2] + follows[: len(text) // 2]
        assert one.edited(two) == (hashlib.sha256(whole.encode()).hexdigest(), minhash.fingerprint(whole)), (text, follows)
        assert (one.n_chars, one.print) == (len(text), minhash.fingerprint(text))


def test_each_shingle_runs_through_the_permutations_once(monkeypatch):
    counted, lows = [], minhash.lows

    def counting(hashes, cuts):
        counted.append(cuts[-1] - cuts[0])
        return lows(hashes, cuts)

    monkeypatch.setattr(minhash, "lows", counting)
    one = minhash.Chained(" ".join(prose(31, 1000)), 700)
    two = minhash.Chained(" ".join(prose(32, 1200)), one.half)
    one.edited(two)
    assert 996 + 1196 <= sum(counted) <= 996 + 1196 + 12
