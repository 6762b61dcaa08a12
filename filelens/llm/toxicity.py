"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A lexicon is learned first: words and word beginnings (4 to 6 letters) whose document counts lean to toxic training
rows, with their log-odds. Dense features follow: lexicon hits and densities, hits beside a second person, capitals,
punctuation, and obfuscation (a lexicon word behind digits, symbols or stretched letters). To keep the trees from
trusting a lexicon that has seen their own rows, each half of the sample gets features from the other half's lexicon;
the final lexicon comes from both. The calibration is fitted on scores that each half gets from trees of the other half.

At most ``sample`` labelled training documents are used (default 20,000; their texts are kept once in the shared folder),
and only counts of tokens that a lexicon takes come to the driver, whose number the sample bounds. Scoring is one pass over the texts without a shuffle.

Edge cases: null and empty texts have no hits and a score like any other. Null labels and null ids are not learned from;
without labelled rows, or with one class only, every score is the same. Repeated rows are scored alike; an empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filelens.llm._additive import BoostedTrees, Isotonic, sigmoid
from filelens.llm._common import cut, fold_of, labelled_sample, map_rows, table

FOLDS, HELD_OUT = 3, 1
SAMPLE = 20_000
#: A lexicon takes tokens of more log-odds than ODDS that exceed what is expected by SIGMAS standard deviations.
ODDS, SIGMAS = 2.0, 2.0
TOXIC_AT = 0.7

FEATURES = ("hits", "hit_density", "strongest", "weight", "stem_hits", "stem_strongest", "stem_weight", "addressed", "hidden_hits", "hidden_share", "upper_share", "upper_words", "exclaim_share", "punctuation_share", "log_words")

#: Second-person words of the four languages, fixed values.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deiner ihr euch euer tú ti contigo usted ustedes vosotros".split())
#: Stand-ins for letters, fixed values.
STAND_INS = str.maketrans("0134578@$!*", "oieastbasi.")

_WORD = re.compile(r"[^\W_]+")
_ODD = re.compile(r"[^\W_]*(?:[0-9@$!*][^\W_]+)+")
_STRETCH = re.compile(r"(.)\1{2,}")
_NEAR = 4


def stems(word: str) -> list[str]:
    return ["^" + word[:k] for k in (4, 5, 6) if len(word) >= k]


def hidden(text: str) -> list[str]:
    """Words behind stand-ins and stretched letters."""
    return [_STRETCH.sub(r"\1", x.translate(STAND_INS)) for x in _ODD.findall(text) if not x.isdigit()]


def beside(hits: list[int], you: list[int]) -> int:
    """How many of the sorted positions ``hits`` are within _NEAR of one in the sorted ``you``."""
    if not hits or not you:
        return 0
    at, near = np.array(hits), np.array(you)
    k = np.searchsorted(near, at)
    gap = np.minimum(np.abs(at - near[np.maximum(k - 1, 0)]), np.abs(at - near[np.minimum(k, len(near) - 1)]))
    return int((gap <= _NEAR).sum())


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """The numbers of a text, in the order of FEATURES."""
    text = text or ""
    low = text.lower()
    words = _WORD.findall(low)
    n, w = max(1, len(text)), max(1, len(words))
    hit_at = [k for k, x in enumerate(words) if x in lexicon]
    weights = [lexicon[words[k]] for k in hit_at]
    begun = [max(s) for x in words if (s := [lexicon[t] for t in stems(x) if t in lexicon])]
    you = [k for k, x in enumerate(words) if x in SECOND_PERSON]
    odd = hidden(low)
    concealed = [x for x in odd if x in lexicon or any(t in lexicon for t in stems(x))]
    original = text.split()
    return [
        len(hit_at),
        len(hit_at) / w,
        max(weights, default=0.0),
        sum(weights),
        len(begun),
        max(begun, default=0.0),
        sum(begun),
        beside(hit_at, you),
        len(concealed),
        len(odd) / w,
        sum(map(str.isupper, text)) / n,
        sum(map(str.isupper, original)) / w,
        text.count("!") / w,
        sum(map(text.count, ".,;:?")) / n,
        math.log1p(len(words)),
    ]


def token_counts(sample: DataFrame) -> DataFrame:
    """(token, half, toxic, clean): documents of the sample that hold each word or beginning; summed per task first."""

    def start():
        seen: Counter = Counter()

        class Step:
            def __call__(self, row: tuple) -> tuple:
                words = set(_WORD.findall((row[1] or "").lower()))
                seen.update((t, row[3], row[2]) for t in words.union(*map(stems, words)))
                return ()

            def finish(self) -> Iterator[tuple]:
                for (token, half, y), n in seen.items():
                    yield token, half, n * y, n * (1 - y)

        return Step()

    rows = map_rows(sample.select("doc_id", "text", "y", "half"), "token string, half int, toxic bigint, clean bigint", start)
    return rows.groupBy("token", "half").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def lexicon_of(counts: dict[str, tuple[int, int]], toxic: int, clean: int, least: int = 3) -> dict[str, float]:
    """Token -> log-odds of its document counts, for tokens that lean clearly to toxic rows."""
    out = {}
    for token, (t, c) in counts.items():
        odds = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
        expected = (t + c) * toxic / max(1, toxic + clean)
        if t >= least and odds > ODDS and t - expected > SIGMAS * math.sqrt(expected + 1):
            out[token] = odds
    return out


def taken(t: Column, c: Column, toxic: int, clean: int, least: int) -> Column:
    """The test of ``lexicon_of`` on columns, with room for rounding."""
    odds = F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1))
    expected = (t + c) * (toxic / max(1, toxic + clean))
    return (t >= least) & (odds > ODDS - 1e-6) & (t - expected > SIGMAS * F.sqrt(expected + 1) - 1e-6)


class Model:
    """A lexicon, trees and their calibration."""

    def __init__(self, lexicon: dict[str, float], trees: BoostedTrees, calibration: Isotonic | None):
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration

    def score(self, texts: list[str | None]) -> np.ndarray:
        raw = self.trees.score(np.array([features(t, self.lexicon) for t in texts], float).reshape(-1, len(FEATURES)))
        return self.calibration(raw) if self.calibration else sigmoid(raw)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model, from at most ``sample`` labelled training rows."""
    half = (F.crc32(F.reverse(F.col("doc_id").cast("string")).cast("binary")) % 2).cast("int")
    rows = cut(labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, sample).withColumn("half", half))
    sizes = {(r.half, r.y): r.n for r in rows.groupBy("half", "y").agg(F.count("*").alias("n")).collect()}
    counts = token_counts(rows)
    total = counts.groupBy("token").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), *(F.sum(F.when(F.col("half") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in (0, 1) for c in ("toxic", "clean"))
    )
    of = lambda k: (sum(n for (h, y), n in sizes.items() if y == 1 and h in k), sum(n for (h, y), n in sizes.items() if y == 0 and h in k))
    some = taken(F.col("toxic"), F.col("clean"), *of((0, 1)), 3) | taken(F.col("toxic0"), F.col("clean0"), *of((0,)), 2) | taken(F.col("toxic1"), F.col("clean1"), *of((1,)), 2)
    leaning = sorted(total.where(some).collect(), key=lambda r: r.token)
    halves = {k: lexicon_of({r.token: (r[f"toxic{k}"], r[f"clean{k}"]) for r in leaning}, *of((k,)), least=2) for k in (0, 1)}
    both = lexicon_of({r.token: (r.toxic, r.clean) for r in leaning}, *of((0, 1)))

    def start():
        return lambda row: [(row[0], row[2], row[3], features(row[1], halves[1 - row[3]]))]

    got = map_rows(rows.select("doc_id", "text", "y", "half"), "doc_id bigint, y int, half int, x array<double>", start).collect()
    got.sort(key=lambda r: (r.doc_id, r.y, r.x))
    x = np.array([r.x for r in got], float).reshape(len(got), len(FEATURES))
    y, side = np.array([r.y for r in got], float), np.array([r.half for r in got], int)
    trees = BoostedTrees.fit(x, y)
    if not trees.trees or not 0 < side.sum() < len(side):
        return Model(both, trees, None)
    apart = np.empty(len(y))
    for k in (0, 1):
        apart[side == k] = BoostedTrees.fit(x[side != k], y[side != k]).score(x[side == k])
    return Model(both, trees, Isotonic.fit(apart, y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(part.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))
