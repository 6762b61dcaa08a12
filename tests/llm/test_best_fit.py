"""Best-fit packing: pieces against the tokenizer library, plans against bounds and a plain best fit."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from filelens.llm import best_fit
from tests.llm.fixtures import SCHEMA, rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_best_fit(counts: Counter, capacity: int) -> int:
    """Bins of best-fit decreasing, piece by piece."""
    gaps, bins = [0] * (capacity + 1), 0
    for x in sorted(counts.elements(), reverse=True):
        gap = next((g for g in range(x, capacity + 1) if gaps[g]), None)
        if gap is None:
            bins, gap = bins + 1, capacity
        else:
            gaps[gap] -= 1
        gaps[gap - x] += 1
    return bins


def drawn(seed: int, low: int, high: int, n: int) -> Counter:
    r = random.Random(seed)
    return Counter(r.randint(low, high) for _ in range(n))


@pytest.mark.parametrize(
    "counts",
    [Counter(), Counter({1: 1}), Counter({1024: 5}), Counter({1: 5000}), Counter({600: 1000, 400: 1500}), Counter({512: 3}), Counter({256: 9, 341: 7}), *(drawn(k, *x, 3000) for k, x in enumerate([(1, 1023), (1, 100), (300, 700), (200, 400), (900, 1024)]))],
)
def test_patterns_hold_all_pieces_in_few_bins(counts):
    found = best_fit.patterns(counts)
    held: Counter = Counter()
    for lengths, bins in found:
        assert sum(lengths) <= 1024 and bins > 0
        for x in lengths:
            held[x] += bins
    assert held == counts
    bins, total = sum(n for _, n in found), sum(x * n for x, n in counts.items())
    assert -(-total // 1024) <= bins <= 1.003 * plain_best_fit(counts, 1024) + 1
    # no more patterns than a few for each length, however many pieces
    many = best_fit.patterns({x: 1_000_003 * n for x, n in counts.items()})
    assert len(many) <= 4 * max(1, len(counts)) and sum(n for _, n in many) <= 1.003 * 1_000_003 * bins


def test_exact_fills_come_before_best_fit():
    assert Counter(dict(best_fit.patterns({700: 10, 324: 4, 200: 6, 124: 6, 300: 1}))) == Counter({(700, 324): 4, (700, 200, 124): 6, (300,): 1})
    assert best_fit.patterns({256: 8}) == [((256, 256, 256, 256), 2)]
    assert sum(n for _, n in best_fit.patterns({500: 3, 100: 2})) == 2


def slow_filling(left: dict[int, int], gap: int) -> set:
    """All combinations of fewest lengths that fill a gap."""
    lengths = [x for x, n in left.items() if n]
    for size in (1, 2, 3):
        found = set()
        for a in lengths:
            for b in lengths if size > 1 else [0]:
                for c in lengths if size > 2 else [0]:
                    if a >= b >= c and a + b + c == gap:
                        combination = tuple(x for x in (a, b, c) if x)
                        if all(left[x] >= n for x, n in Counter(combination).items()):
                            found.add(combination)
        if found:
            return found
    return set()


@pytest.mark.parametrize("prefer", best_fit.PREFERENCES)
def test_index_finds_what_fills_a_gap(prefer):
    r = random.Random(7)
    for _ in range(60):
        left = np.zeros(61, np.int64)
        for x in r.sample(range(1, 60), r.randint(1, 12)):
            left[x] = r.randint(1, 3)
        index = best_fit.Complements(left, prefer)
        for gap in r.choices(range(1, 60), k=30):
            want = slow_filling({x: int(n) for x, n in enumerate(left)}, gap)
            got = index.filling(gap)
            assert (got in want) if want else got is None
            for x in got or ():
                left[x] -= 1


def check(docs, placed: list, capacity: int) -> None:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    want = Counter()
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[r.doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in placed) == want
    bins = defaultdict(list)
    for p in placed:
        bins[p.sequence_id].append(p)
    for own in bins.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    counts = Counter(p.length for p in placed)
    assert len(bins) <= 1.003 * plain_best_fit(counts, capacity) + 1


@pytest.mark.parametrize("capacity", [1024, 64, 7])
def test_pieces_and_places(spark, capacity):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    check(docs, best_fit.pack(docs, PATH, capacity).collect(), capacity)


def test_empty_table_and_clashing_columns(spark):
    assert best_fit.pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []
    odd = spark.createDataFrame([(1, "a b", 5, 6, 7), (None, None, 5, 6, 7)], "doc_id bigint, text string, `task` int, `length` int, `a.b` int")
    got = best_fit.pack(odd, PATH).collect()
    assert len({p.sequence_id for p in got}) == 1 and {p.doc_id for p in got} == {1, None}


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    placed = best_fit.pack(docs, PATH, 128, with_ids=True)
    held = {r.sequence_id: r.ids for r in best_fit.sequences(placed).collect()}
    for p in placed.collect():
        own = held[p.sequence_id][p.offset : p.offset + p.length]
        assert own == p.ids and zlib.crc32(np.array(own, "<u4").tobytes()) == p.ids_crc32
    assert sum(map(len, held.values())) == sum(p.length for p in placed.collect())


def test_both_ways_to_meet_the_numbers(spark, monkeypatch):
    """Beyond the bound of a broadcast the table of numbers is joined by sort-merge."""
    from filelens.llm import _common

    docs = spark.createDataFrame(rows() * 5, SCHEMA).repartition(4)
    monkeypatch.setattr(_common, "BROADCAST_BYTES", 0)
    placed = best_fit.pack(docs, PATH, 256)
    assert "SortMergeJoin" in placed._jdf.queryExecution().toString()
    check(docs, placed.collect(), 256)


def test_the_query_reads_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(docs, best_fit.op11_best_fit(spark, sf).collect(), 1024)
