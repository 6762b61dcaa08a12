"""SimHash near-dedup by anchor-point covering.

Fingerprint: 64 bits, each set if it is set in more than half of the XXH64 values of the 3-word shingles.

Anchors are the words of a covering code: the product of two perfect binary Golay codes of length 23 (covering radius 3
each) over bits 0-22 and 23-45; the other 18 bits are free, so anchors are 2**24 pairs of code words. Let p and q differ
in at most t bits, and let m lie between them, at most ceil(t/2) bits from each. m has its anchor within the covering
radius in both blocks, so p and q both lie within the covering radius plus ceil(t/2) of that anchor. Each fingerprint is
thus replicated to every anchor within that reach (for t = 2: one bit over the radius in one of the blocks, 9.6 anchors
on average), and fingerprints are compared only with those at the same anchor. No pair is missed and none outside the
threshold is linked, at any size. Only distinct fingerprints are replicated, however many documents share one; within
t = 2 a fingerprint has at most 2,080 neighbours, so links grow in proportion to fingerprints.

Classes are the connected components of the links, by alternating large-star and small-star steps over edges that are
written to the shared folder at each round.

Edge cases: null and empty texts, and texts of white space, have fingerprint zero, which links like any other. With
fewer words than a shingle the whole sequence is the one shingle. A null id is never a component's id unless all its ids
are null. Repeated rows get the same result each. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelens.llm._common import apart, cut, keep_one, map_rows, met, table

SHINGLE = 3
SEED = 42
THRESHOLD = 2
#: Generator polynomial of the binary Golay code of length 23. Fixed value.
GOLAY = 0b101011100011
BLOCK = 23
RADIUS = 3
BLOCKS = (0, BLOCK)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the 64-bit hashes, as an unsigned number."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes | None) -> int:
    """SimHash of a UTF-8 text, as an unsigned 64-bit number."""
    words = (text or b"").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    begins, ends = start[: -SHINGLE + 1].tolist(), (start + size)[SHINGLE - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begins, ends, strict=True)], "<u8")
    return majority(hashes)


def signed(fp: int) -> int:
    """An unsigned 64-bit number as Spark has it."""
    return fp - (1 << 64) if fp >> 63 else fp


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator."""
    rest = words.astype(np.int64)
    for bit in range(BLOCK - 1, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY << bit - 11), rest)
    return rest


@cache
def errors(reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, patterns): patterns of at most ``reach`` bits in the order of their syndromes; index[s] to index[s + 1] are those of s."""
    bits = [1 << k for k in range(BLOCK)]
    patterns = np.array([sum(c) for n in range(reach + 1) for c in combinations(bits, n)], np.int64)
    s = syndromes(patterns)
    order = np.argsort(s, kind="stable")
    return np.searchsorted(s[order], np.arange((1 << 11) + 1)), patterns[order]


def _near(words: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, code word) for all code words within ``reach`` of the 23-bit words."""
    index, patterns = errors(reach)
    s = syndromes(words)
    n = index[s + 1] - index[s]
    row = np.repeat(np.arange(len(words)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + index[s][row]
    return row, words[row] ^ patterns[at]


def anchors(prints: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of every anchor that each fingerprint is replicated to: the excess over the radius, summed over the blocks, is at most ceil(threshold / 2)."""
    slack = (threshold + 1) // 2
    blocks = [(prints >> np.uint64(at)).astype(np.int64) & ((1 << BLOCK) - 1) for at in BLOCKS]
    rows, found = [], []
    for extra in range(slack + 1):
        a_row, a = _near(blocks[0], RADIUS + extra)
        if extra:  # only those that need this much
            needed = np.bitwise_count(a ^ blocks[0][a_row]) == RADIUS + extra
            a_row, a = a_row[needed], a[needed]
        b_row, b = _near(blocks[1], RADIUS + slack - extra)
        first, n = np.searchsorted(b_row, a_row), np.bincount(b_row, minlength=len(prints))[a_row]
        take = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        rows.append(np.repeat(a_row, n))
        found.append(np.repeat(a, n) << BLOCK | b[take])
    return np.concatenate(rows), np.concatenate(found)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, fp): fp as a signed 64-bit number. With ``digest`` also the SHA-256 of the text."""

    def start():
        def step(row: tuple) -> Iterable[tuple]:
            fp = signed(fingerprint(row[1]))
            yield (row[0], fp, hashlib.sha256(row[1] or b"").digest()) if digest else (row[0], fp)

        return step

    schema = "doc_id bigint, fp bigint" + ", digest binary" * digest
    return map_rows(docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("binary")), schema, start)


def links(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct numbers in ``prints.fp`` that differ in 1 to ``threshold`` bits."""

    def replicate(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 20_000):
                fp = batch.column(0).slice(k, 20_000).to_numpy(zero_copy_only=False)
                row, anchor = anchors(fp.view(np.uint64), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[row])], names=["anchor", "fp"])

    placed = prints.select("fp").mapInArrow(replicate, "anchor bigint, fp bigint")
    left, right = (placed.select(F.col("anchor").alias(f"anchor_{x}"), F.col("fp").alias(x)) for x in "ab")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    return met(left, right, (F.col("anchor_a") == F.col("anchor_b")) & near).select("a", "b").distinct()


def _state(edges: DataFrame) -> tuple:
    """Number of the edges and sum of their hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over the edges (a, b), for every node that has one.

    Large-star: the greater neighbours of a node join the smallest of its neighbourhood. Small-star: so do the smaller
    ones. Both keep the components; they end when the edges are stars around the smallest nodes, after a number of rounds
    that grows as the logarithm of the edges, at worst its square. Work per round is one aggregation and one join over the
    edges, and a hub's edges may be split by the join.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a", apart("a")).agg(F.least(F.min("b"), F.col("a")).alias("m")).drop("_apart")
        large = met(both.where("b > a"), low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a", apart("a")).agg(F.min("b").alias("m")).drop("_apart")
        moved = met(large, low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = cut(moved.where("a <> b").distinct())
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _classes(own: DataFrame, threshold: int) -> DataFrame:
    """(fp, root, component_id) of every fingerprint."""
    distinct = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct, threshold)).withColumnRenamed("node", "fp")
    placed = met(distinct, roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root", apart("root")).agg(F.min("first").alias("component_id")).drop("_apart")
    return met(placed, smallest, "root").select("fp", "root", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row per input row: (doc_id, fp, component_id)."""
    own = cut(fingerprints(docs, id_col, text_col))
    return met(own, _classes(own, threshold), "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each component; all columns stay. Rows are told apart by id and text."""
    own = cut(fingerprints(docs, id_col, text_col, digest=True))
    return keep_one(docs, cut(met(own, _classes(own, threshold), "fp").select("doc_id", "digest", "root")), id_col, text_col)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
