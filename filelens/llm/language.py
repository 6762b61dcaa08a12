"""Language ID with language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: slot j holds a bitmask with one bit per language, so the AND of the
masks at an n-gram's slots is the set of all languages that contain it, found with HASHES lookups whatever the number of
languages. For a text the bits are counted per language over all its n-grams; each count is corrected for the filter's
false positives, (count - n * rate) / (1 - rate) with the language's own rate, and the largest share decides.

An n-gram is 1 to 4 letters of a lower-cased word with its borders. A language's filter holds all n-grams of its training
texts that make up more than ``LEAN`` times the average of the languages and occur ``LEAST`` times at least.

Training reads at most ``sample`` documents with a language (default 12,000, by the smallest hashes of their ids; of rows
that repeat an id one). That alone bounds the n-grams; the filters have SPARE slots or more for each n-gram of the language
that has most. Prediction is one pass over the texts without a shuffle.

Edge cases: null texts and texts without a letter (Unicode category L) are ``und`` with score 0. Without training rows all are ``und``. Texts
none of whose n-grams is in a filter get the commonest training language with score 0. Equal counts go to the language
that sorts first. Repeated rows are treated alike; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelens.llm._common import cut, fold_of, map_rows, table, text_digest

FOLDS, HELD_OUT = 4, 2
SAMPLE = 12_000
#: Slots for each n-gram of a language, and the fewest slots.
SPARE, SLOTS = 16, 1 << 20
HASHES = 3
LEAN = 1.5
LEAST = 2
SIZES = (1, 2, 3, 4)
UND = "und"

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _numerals() -> str:
    """Characters that count as word characters but are no letters, as ranges of a pattern."""
    at = [k for k in range(sys.maxunicode + 1) if chr(k).isalnum() and not chr(k).isalpha()]
    first = [k for i, k in enumerate(at) if not i or at[i - 1] < k - 1]
    last = [k for i, k in enumerate(at) if i + 1 == len(at) or at[i + 1] > k + 1]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(first, last, strict=True))


_LETTERS = re.compile(f"[^\\W_{_numerals()}]+")
_BORDER = 32


def code_points(text: str) -> np.ndarray:
    """Letters of the lower-cased text, words apart by one border, a border at both ends."""
    return np.frombuffer(f" {' '.join(_LETTERS.findall(text.lower()))} ".encode("utf-32-le", "replace"), "<u4").astype(np.uint64)


def ngrams(points: np.ndarray) -> np.ndarray:
    """Keys of the n-grams of a text, with repeats: n code points of 21 bits hashed to 64 bits; none spans a border inside."""
    out = []
    inside = np.concatenate(([0], np.cumsum(points == _BORDER)))
    for n in SIZES:
        m = len(points) - n + 1
        if m <= 0:
            break
        key = np.full(m, n, np.uint64)
        for k in range(n):
            key = (key ^ points[k : m + k]) * _MIX[0]
            key ^= key >> np.uint64(29)
        within = inside[n - 1 : n - 1 + m] - inside[1 : m + 1] if n > 2 else np.zeros(m, np.int64)
        alone = (points[:m] == _BORDER) if n == 1 else np.zeros(m, bool)
        out.append(key[(within <= 0) & ~alone])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def slots_of(keys: np.ndarray, slots: int) -> list[np.ndarray]:
    """The slots of each key; ``slots`` is a power of two."""
    return [((keys * m) >> np.uint64(65 - slots.bit_length())).astype(np.int64) for m in _MIX[1 : 1 + HASHES]]


class Filters:
    """Bit-sliced filters of all languages (up to 64 to a word; more take more words)."""

    def __init__(self, grams: dict[str, np.ndarray], prior: str = UND):
        self.languages = sorted(grams)
        self.prior = prior
        self.slots = max(SLOTS, 1 << (SPARE * max(map(len, grams.values()), default=0)).bit_length())
        bits = np.min_scalar_type((1 << min(64, len(self.languages))) - 1).type  # no wider than the languages need
        self.words = [np.zeros(self.slots, bits) for _ in range(0, len(self.languages), 64)]
        for k, language in enumerate(self.languages):
            for at in slots_of(grams[language], self.slots):
                self.words[k // 64][at] |= bits(1 << (k % 64))
        full = [np.mean(self.words[k // 64] >> bits(k % 64) & bits(1)) for k in range(len(self.languages))]
        self.rate = np.array(full, float) ** HASHES  # a foreign n-gram finds all its slots set this often

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """n-grams of the text that each language contains, corrected for false positives."""
        at = slots_of(keys, self.slots)
        found = []
        for k in range(len(self.languages)):
            if k % 64 == 0:
                masks = self.words[k // 64][at[0]]
                for more in at[1:]:
                    masks = masks & self.words[k // 64][more]
            found.append(int(np.count_nonzero(masks & masks.dtype.type(1 << (k % 64)))))
        return np.maximum(0.0, (np.array(found, float) - len(keys) * self.rate) / (1 - self.rate))

    def predict(self, text: str | None) -> tuple[str, float]:
        points = code_points(text or "")
        if len(points) <= 2 or not self.languages:
            return UND, 0.0
        share = self.counts(ngrams(points))
        if not share.sum():
            return self.prior, 0.0
        return self.languages[int(share.argmax())], float(share.max() / share.sum())


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters from at most ``sample`` training documents; n-gram counts are summed per task, then by key."""
    ids = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (fold_of(F.col(id_col), FOLDS) != HELD_OUT)).select(F.col(id_col).alias("_id")).distinct()
    chosen = ids.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    own = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_doc", F.struct(text_digest(F.col("text")).alias("digest"), "lang", "text").alias("one"))
    rows = own.groupBy("_doc").agg(F.min("one").alias("one")).select("one.text", "one.lang")

    def start():
        seen: dict[str, Counter] = {}

        class Step:
            def __call__(self, row: tuple) -> tuple:
                keys, n = np.unique(ngrams(code_points(row[0] or "")).view(np.int64), return_counts=True)
                own = seen.setdefault(row[1], Counter())
                for key, times in zip(keys.tolist(), n.tolist(), strict=True):
                    own[key] += times
                return ()

            def finish(self) -> Iterator[tuple]:
                for language, own in seen.items():
                    for key, times in own.items():
                        yield language, key, times

        return Step()

    counts = cut(map_rows(rows, "lang string, gram bigint, n bigint", start).groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return Filters({})
    share = F.create_map(*[v for k, n in totals.items() for v in (F.lit(k), F.lit(float(n)))])
    shares = counts.withColumn("share", F.col("n") / share[F.col("lang")])
    average = shares.groupBy("gram").agg((F.sum("share") / len(totals)).alias("average"), F.collect_list(F.struct("lang", "n", "share")).alias("own"))
    leaning = average.select("gram", "average", F.explode("own").alias("o")).where((F.col("o.share") > LEAN * F.col("average")) | F.lit(len(totals) == 1)).where(F.col("o.n") >= LEAST)
    found = leaning.select(F.col("o.lang").alias("lang"), "gram").toArrow()
    lang, gram = np.array(found["lang"].to_pylist(), object), found["gram"].to_numpy().view(np.uint64)
    grams = {language: np.sort(gram[lang == language]) for language in sorted(totals)}
    return Filters(grams, max(sorted(totals), key=totals.get))


def predict(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                got = [filters.predict(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
