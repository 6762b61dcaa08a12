"""Substring dedup: seed and extend over word runs.

Seeds: each run of ``LENGTH`` words picks one of its ``SEED``-word runs, the one with the smallest hash (winnowing). Equal
runs pick equal seeds, so whatever is repeated over the threshold shares at least one seed in every place; about one word
in 17 is a seed. Seeds that occur in two documents are joined back to their documents (two-way, combined before the
exchange). Extension: around each shared seed every run of LENGTH words that picked it is hashed, to the left as far as
the seed still reaches and to the right likewise, and the smallest document of each run is found. Runs that start in a
smaller document are chained into maximal repeats. Comparing a run with the smallest document of its hash instead of with
every document that has the seed keeps the work in proportion to the repeated words, however many documents share a
passage; no pair of documents is ever made.

Whole copies are settled first by the digest of their words: only the smallest document of a class takes part.

A document gives each of its runs once, with all its starts, so a text that repeats itself is no hot key; a run that very
many documents share is combined before it is exchanged, and its documents may be split in the join that follows.

A run is matched on 95 bits of two hashes; at 10**13 runs a false match is expected less than once in a hundred corpora.

At scale: texts are hashed in one pass that leaves only seeds (12 bytes for 17 words) in the shared folder, and shuffled
once, compressed, by id; all later uses read that exchange. The runs are settled as a table, which the search for repeated
ones and the join with them read. Hot seeds and runs are combined before they are exchanged, and the joins back are plain
shuffle joins that AQE may split.

Edge cases: null and empty texts have no words. A null id counts as smaller than all others. Rows that repeat an id don't
take words from each other unless another document does. Texts shorter than LENGTH words keep all. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelens.llm._common import apart, cut, map_rows, met, packed, table, unpacked
from filelens.llm._words import SECOND_BASE, run_hashes, word_bounds, word_hashes

LENGTH = 50
SEED = 18
#: Words of a text that are winnowed at a time.
BLOCK = 1 << 22
NULL_ID = -(1 << 63)
_AT = np.uint64((1 << 24) - 1)


def picked(words: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all seed-word runs, for each run of ``length`` words the position of the seed that it picks)."""
    hashes = run_hashes(words, seed)
    span = length - seed + 1
    out = []
    for k in range(0, len(hashes) - span + 1, BLOCK):
        low = (hashes[k : k + BLOCK + span - 1] & ~_AT) | np.arange(min(BLOCK + span - 1, len(hashes) - k), dtype=np.uint64)
        width = 1
        while width < span:  # minimum over windows, doubled until they are as wide as the span
            step = min(width, span - width)
            low = np.minimum(low[: len(low) - step], low[step:])
            width += step
        out.append((low & _AT).astype(np.int64) + k)
    return hashes, np.concatenate(out) if out else np.zeros(0, np.int64)


def spans(starts: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal stretches [begin, end) of words that the runs at ``starts`` cover."""
    if not len(starts):
        return []
    starts = np.unique(starts)
    gap = np.nonzero(np.diff(starts) > length)[0]
    return list(zip(starts[np.concatenate(([0], gap + 1))].tolist(), (starts[np.concatenate((gap, [len(starts) - 1]))] + length).tolist(), strict=True))


def _profile(length: int, seed: int):
    def start():
        def step(row: tuple) -> Iterable[tuple]:
            key, mark, data = row
            begin, end = bounds = word_bounds(data)
            hashes, at = picked(word_hashes(data, bounds), length, seed) if len(begin) >= length else (None, np.zeros(0, np.int64))
            at = np.unique(at)
            seeds = hashes[at].view(np.int64).tolist() if len(at) else []
            yield key, mark, len(begin), hashlib.sha256(b" ".join(data.split())).digest(), seeds, at.tolist()

        return step

    return start


def _runs(length: int, seed: int):
    """For ``mapInArrow``: (key, mark, h, g, starts) of each distinct run of a document beside its shared seeds; starts as 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def flush() -> pa.RecordBatch:
            nonlocal n
            key, mark, h, g, size, data = ([x[k] for x in held] for k in range(6))
            offsets = np.concatenate((np.zeros(1, np.int32), np.cumsum(np.concatenate([np.zeros(0, np.int64), *size]) * 4))).astype(np.int32)
            starts = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(data))])
            ids = [np.repeat(np.array(x, np.int64), [len(v) for v in h]) if x else np.zeros(0, np.int64) for x in (key, mark)]
            got = pa.RecordBatch.from_arrays([*map(pa.array, ids), *(pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (h, g)), starts], names=["key", "mark", "h", "g", "starts"])
            held.clear()
            n = 0
            return got

        for batch in batches:
            for key, mark, data, shared in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = word_hashes(unpacked(data))
                runs = np.nonzero(np.isin(picked(words, length, seed)[1], shared))[0]
                if not len(runs):
                    continue
                h = run_hashes(words, length)[runs].view(np.int64)
                g = (run_hashes(words, length, SECOND_BASE)[runs] >> np.uint64(33)).astype(np.int64)
                order = np.lexsort((runs, g, h))
                h, g = h[order], g[order]
                new = np.nonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]))))[0]
                held.append((key, mark, h[new], g[new], np.diff(np.append(new, len(h))), runs[order].astype("<i4").tobytes()))
                n += len(new)
                if n >= 50_000:
                    yield flush()
        yield flush()

    return run


def _removed(length: int):
    def start():
        def step(row: tuple) -> Iterable[tuple]:
            key, mark, data, starts = row
            words, covered = unpacked(data).split(), spans(np.frombuffer(b"".join(starts), "<i4").astype(np.int64), length)
            kept, at = [], 0
            for begin, end in covered:
                kept += words[at:begin]
                at = end
            kept += words[at:]
            yield key, mark, len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), [list(s) for s in covered]

        return step

    return start


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """One row per input row: (doc_id, n_words, n_removed, kept_sha256, spans), spans the maximal repeats [begin, end) in words.

    A word is removed if a run of ``length`` words that covers it starts in a document with a smaller id.
    """
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("key"), F.xxhash64(data).alias("mark"), data.alias("data"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    own = cut(map_rows(rows, "key bigint, mark bigint, n_words bigint, sha binary, seeds array<bigint>, at array<int>", _profile(length, seed)))
    first = own.groupBy("sha", apart("sha")).agg(F.min("key").alias("keep")).drop("_apart")
    placed = met(own, first, "sha")
    seeds = placed.where((F.col("key") == F.col("keep")) & (F.size("seeds") > 0)).select("key", "mark", F.explode(F.arrays_zip("seeds", "at")).alias("s")).select("key", "mark", "s.seeds", "s.at")
    shared = seeds.groupBy("seeds", apart("seeds")).agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("seeds")
    hits = met(seeds, shared, "seeds").groupBy("key", "mark").agg(F.collect_set("at").alias("shared"))

    texts = rows.mapInArrow(packed, "key bigint, mark bigint, data binary").repartition(parts, "key", "mark")
    near = met(texts, hits, ["key", "mark"]).select("key", "mark", "data", "shared")
    runs = cut(near.mapInArrow(_runs(length, seed), "key bigint, mark bigint, h bigint, g bigint, starts binary"))
    repeated = runs.groupBy("h", "g", apart("h", "g")).agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").select("h", "g", "first")
    later = met(runs, repeated, ["h", "g"]).where("key > first").groupBy("key", "mark").agg(F.collect_list("starts").alias("starts"))
    removed = map_rows(met(texts, later, ["key", "mark"]).select("key", "mark", "data", "starts"), "key bigint, mark bigint, n_removed bigint, kept string, spans array<array<int>>", _removed(length))
    removed = removed.groupBy("key", "mark").agg(F.first("n_removed").alias("n_removed"), F.first("kept").alias("kept"), F.first("spans").alias("spans"))

    copy = (F.col("key") > F.col("keep")) & (F.col("n_words") >= length)
    none = F.array().cast("array<array<int>>")
    whole = F.array(F.array(F.lit(0), F.col("n_words").cast("int")))
    return met(placed.select("key", "mark", "n_words", "sha", "keep"), removed, ["key", "mark"], "left").select(
        F.nullif("key", F.lit(NULL_ID)).alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", F.lower(F.hex("sha")))).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.coalesce("spans", none)).alias("spans"),
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
r AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 49), ' ') AS run FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY run) AS first FROM r) WHERE doc_id > first),
gone AS (SELECT doc_id, list(DISTINCT i + k) AS lost FROM late, range(50) t(k) GROUP BY doc_id),
kept AS (SELECT w.doc_id, len(words) AS n_words, CASE WHEN lost IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(lost, i)) END AS left_over
  FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, n_words - len(left_over) AS n_removed, sha256(array_to_string(left_over, ' ')) AS kept_sha256 FROM kept
"""
