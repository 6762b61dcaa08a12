"""Source divergence against whole numbers in plain Python."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from filelens.llm import _common, divergence
from tests.llm.fixtures import SCHEMA, rows

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow(data: list[tuple], min_docs: int = 3, top: int = 200) -> Counter:
    """data: (text, lang, source)."""
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in data:
        lang, source, terms = lang or "", source or "", TERM.findall((text or "").translate(FOLD))
        groups[lang].add(source)
        df[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = Counter()
    for lang, sources in groups.items():
        kept = {t for t, n in df[lang].items() if n >= min_docs}
        own = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        p = {s: {t: 1 + 10**9 * (n + 1) // (sum(c.values()) + len(kept)) for t, n in c.items()} for s, c in own.items()}
        total = {t: sum(c[t] for c in own.values()) for t in kept}
        q = {t: 1 + 10**9 * (n + 1) // (sum(total.values()) + len(kept)) for t, n in total.items()}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out[lang, s, part, item, value, rank] += 1
    return out


def made(n: int) -> list[tuple]:
    """Documents with a hot source, shared and own terms, capitals, other alphabets, and terms that few have."""
    out = []
    for k in range(n):
        source = "hot" if k % 3 else f"s{k % 7}"
        words = [f"Term{'abcdefghij'[(k * j) % 10]}" for j in range(k % 9)] + ["ÉCOLE", "école", "straße"][: k % 4] + ["once" + chr(97 + k % 26) * (k % 5 + 1)] + ["λόγος"] * (k % 3)
        out.append((" ".join(words) + " 12 x_y", ["en", "fr", None][k % 3 if k % 2 else 0], source))
    return out


@pytest.mark.parametrize("bound", [_common.BROADCAST_BYTES, 0])
def test_divergence(spark, monkeypatch, bound):
    """By broadcast and, beyond its bound, by sort-merge."""
    monkeypatch.setattr(_common, "BROADCAST_BYTES", bound)
    edge = [("", "xx", "a"), (None, "xx", "b"), (None, None, None), ("only", "one", "alone"), ("x" * 20_000, "xx", "c")]
    data = made(300) + edge + [("tie tie", "t", s) for s in "abcabc"] + edge[:1]
    docs = spark.createDataFrame(data, "text string, lang string, source string").repartition(4)
    assert Counter(map(tuple, divergence.source_divergence(docs).collect())) == slow(data)
    assert Counter(map(tuple, divergence.source_divergence(docs, min_docs=1, top=3).collect())) == slow(data, 1, 3)


def test_divergence_of_odd_rows(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    assert Counter(map(tuple, divergence.source_divergence(docs).collect())) == slow([r[1:4] for r in rows()])
    clashing = spark.createDataFrame([(*x, 1, 2, 3) for x in made(40)], "text string, lang string, source string, n int, docs int, `a.b` int")
    assert Counter(map(tuple, divergence.source_divergence(clashing).collect())) == slow(made(40))
    assert divergence.source_divergence(docs.limit(0)).collect() == []


def test_counts_handed_on_early_are_the_same(spark, monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([x[c] or "" for x in made(50)]) for c in (1, 2, 0)], names=["lang", "source", "text"])

    def total() -> Counter:
        out: Counter = Counter()
        for b in divergence._counted(iter([batch, batch])):
            for lang, source, term, n, docs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out[lang, source, term, "n"] += n
                out[lang, source, term, "docs"] += docs
        return out

    want = total()
    monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    assert total() == want
    monkeypatch.setattr(divergence, "HELD_BYTES", 1)
    assert total() == want


def test_large_counts_stay_exact(spark):
    """A count of 10**11 times 10**9 is beyond a long."""
    kept = spark.createDataFrame([("en", "a", 10**11 + 7, [("s", 10**11), ("t", 7)]), ("en", "b", 5, [("s", 5)])], "lang string, term string, n bigint, entries array<struct<source:string,n:bigint>>")
    docs = spark.createDataFrame([("en", "s"), ("en", "t")], "lang string, source string")
    groups = divergence.group_sizes(docs, kept)
    p = {s: {t: 1 + 10**9 * (n + 1) // (total + 2) for t, n in c.items()} for s, c, total in (("s", {"a": 10**11, "b": 5}, 10**11 + 5), ("t", {"a": 7, "b": 0}, 7))}
    want = {(s, o): sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in "ab") for s, o in (("s", "t"), ("t", "s"))}
    assert {(r.source, r.item): r.value for r in divergence.pair_values(kept, groups).collect()} == want


def test_only_the_first_terms_of_each_task_are_exchanged(spark, sf):
    from pyspark.sql import functions as F

    plan = divergence.op12_divergence(spark, sf).where(F.col("part") == "term")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
