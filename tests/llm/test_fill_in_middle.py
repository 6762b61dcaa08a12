"""Fill-in-middle against a version that lists all tokens, and exact round trips."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from filelens.llm import fill_in_middle as fim
from tests.llm.fixtures import SCHEMA, rows

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def slow(doc_id, text, rate: int = 50) -> tuple:
    text = text or ""
    tokens = TOKEN.findall(text)
    assert "".join(tokens) == text
    n, h = len(tokens), sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or h3 % 100 >= rate or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return n, form, len(prefix), len(middle), out


def texts() -> list[str | None]:
    r = random.Random(5)
    alphabet = ["a", "bc", "é", "\U0001d538", "\x1c", " ", "　", " ", "  ", "\n", "\t\r\n", "\x0b", "<P", "S>", "<", "\x00"]
    made = ["".join(r.choices(alphabet, k=k)) for k in range(0, 700, 3)]
    edges = [" ".join("x" for _ in range(k)) for k in (fim.EVERY - 1, fim.EVERY, fim.EVERY + 1, 2 * fim.EVERY)]
    return [*made, *edges, None, "", " ", "  lead", "trail  ", "a <P> b", "a <S", "<M>", "\U0001d538" * 300, " " * 100_000, "é" * 100_000 + " z", "w " * 50_000]


def test_cuts_against_all_tokens():
    for k, text in enumerate(texts()):
        for doc_id in (k, -k, None, 7, 10**15 + k):
            assert fim.cut(doc_id, text) == slow(doc_id, text)
            assert fim.cut(doc_id, text, rate=100) == slow(doc_id, text, 100)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 200, 1000])
def test_checkpoints(n):
    text = "".join(f" é{k}" for k in range(n)) + ("  " if n % 2 else "")
    index, tokens = fim.Checkpoints(text.encode()), TOKEN.findall(text)
    assert index.n == len(tokens) and len(index.tokens) == len(tokens) // fim.EVERY + 1
    for k in range(len(tokens) + 1):
        head = "".join(tokens[:k])
        assert index.after(k) == (len(head.encode()), len(head))


def test_rows_and_round_trip(spark):
    data = [(k, t) for k, t in enumerate(texts())] + [(3, "twice the id"), (None, "no id at all"), (3, "twice the id")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)
    done = fim.fill_in_middle(docs, rate=100)
    got = done.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == Counter((i, *slow(i, t, 100)) for i, t in data)
    assert Counter((r.doc_id, r.back) for r in got) == Counter((i, t or "") for i, t in data)
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    assert fim.fill_in_middle(docs.limit(0)).collect() == []


def test_rewritten_keeps_all_columns(spark):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows()], SCHEMA + ", `a.b` int, output int").repartition(3)
    got = fim.rewritten(docs)
    assert got.columns == docs.columns
    rest = [c for c in docs.columns if c != "text"]
    whole = lambda df: Counter(tuple(r[c] for c in rest) for r in df.collect())
    assert whole(got) == whole(docs)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((r[0], slow(r[0], r[1])[-1]) for r in rows())


def test_batches_end_at_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(fim, "BATCH_BYTES", 50)
    docs = spark.createDataFrame([(k, f"some words {k}") for k in range(100)], "doc_id bigint, text string").coalesce(1)
    assert Counter((r.doc_id, r.output) for r in fim.fill_in_middle(docs).collect()) == Counter((k, slow(k, f"some words {k}")[-1]) for k in range(100))
