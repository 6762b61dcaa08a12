"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes ``FEATURES`` dense numbers. Cyclic boosting of shallow trees learns a lookup table over the bins of each
feature and of the strongest feature pairs; a batch is scored by adding up table entries at its bins.

The model is fitted on the driver from at most ``sample`` labelled documents (numbers only; default 20,000), all taken
from training rows; scoring is one pass over the texts without a shuffle.

Edge cases: null and empty texts have all features zero and a score like any other. Null labels and null ids are not
learned from; without labelled rows, or with one class only, every score is the share of label 1 (0.5 without rows).
Repeated rows are scored alike; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelens.llm._additive import PairwiseAdditive
from filelens.llm._common import boxed, fold_of, labelled_sample, map_rows, table

FOLDS, HELD_OUT = 3, 1
SAMPLE = 20_000

FEATURES = (
    "log_words", "word_length", "upper_share", "digit_share", "punctuation_share", "symbol_share", "distinct_share", "top_word_share",
    "repeat_share", "bar_share", "exclaim_share", "marked_words", "upper_words", "short_lines", "repeated_lines", "line_words", "sentence_ends", "packed_share",
)

_UPPER = re.compile(r"[^\W\d_a-zß-öø-ÿ]")
_SYMBOL = re.compile(r"[^\w\s.,;:'\"\-?!|]")
_DIGIT = re.compile(r"\d")
_PUNCT = re.compile(r"[.,;:'\"\-?!]")
_MARKED = re.compile(r"[^\w\s.,;:'\"\-?!|]{2,}(?=\s|$)")


def features(text: str | None) -> list[float]:
    """The numbers of a text, in the order of FEATURES."""
    text = text or ""
    words, n = text.split(), max(1, len(text))
    if not words:
        return [0.0] * len(FEATURES)
    count, w = Counter(words), len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    data = text.encode("utf-8", "replace")
    return [
        math.log1p(w),
        sum(map(len, words)) / w,
        len(_UPPER.findall(text)) / n,
        len(_DIGIT.findall(text)) / n,
        len(_PUNCT.findall(text)) / n,
        len(_SYMBOL.findall(text)) / n,
        len(count) / w,
        max(count.values()) / w,
        sum(map(str.__eq__, words, words[1:])) / w,
        text.count("|") / w,
        text.count("!") / w,
        len(_MARKED.findall(text)) / w,
        sum(map(str.isupper, words)) / w,
        sum(len(x) < 40 for x in lines) / len(lines),
        1 - len(set(lines)) / len(lines),
        math.log1p(w / len(lines)),
        len(re.findall(r"[.?](?=\s|$)", text)) / w,
        len(zlib.compress(data, 1)) / len(data),
    ]


def training_rows(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a bounded sample, gathered on the driver in the order of the ids."""

    def start():
        return lambda row: [(row[0], row[2], features(row[1]))]

    rows = map_rows(sample.select("doc_id", "text", "y"), "doc_id bigint, y int, x array<double>", start).collect()
    rows.sort(key=lambda r: (r.doc_id, r.y, r.x))
    return np.array([r.x for r in rows], float).reshape(len(rows), len(FEATURES)), np.array([r.y for r in rows], float)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> PairwiseAdditive:
    """The model, from at most ``sample`` labelled training rows."""
    return PairwiseAdditive.fit(*training_rows(labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, sample)))


def score(docs: DataFrame, model: PairwiseAdditive, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                x = np.array([features(t) for t in part.column(1).to_pylist()], float).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, score double")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without those that score under ``least``; all columns stay, and the row is scored where it stands.

    The row rides along through the scoring pass as one struct, so nothing is joined or shuffled and columns may have any
    name.
    """
    model = fit(docs, labels, sample)
    at = docs.columns.index("text")
    rows = boxed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                x = np.array([features(t) for t in pc.struct_field(part.column(0), at).to_pylist()], float).reshape(-1, len(FEATURES))
                yield part.filter(pa.array(model.score(x) >= least))

    return rows.mapInArrow(run, rows.schema).select("row.*")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
