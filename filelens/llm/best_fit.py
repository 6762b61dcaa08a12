"""Best-fit packing by exact complements: whole documents into as few token sequences as possible.

Only a document longer than the capacity is cut: whole sequences from its end, so its first piece is the shorter one.
What is then packed are lengths, and there are no more different ones than the capacity, however many pieces there are.
So the pieces are counted by length, and the *counts* are packed:

  * The longest piece left opens a bin, and the gap that it leaves is looked up in an index of the sums of one, two and
    three lengths that are still there. A combination that fills the gap exactly is consumed as often as the counts of
    all its lengths allow, so each step uses up a length.
  * If none fills it, the longest piece that fits is put in (the best fit), and what is left of the gap is looked up
    again. A bin whose gap nothing fits is closed with that padding.
  * Among combinations of equally many lengths the index may prefer the one with the longest, the one of most alike
    lengths, or one between. All three packings are made and the one with the fewest bins is taken.

The result is a list of patterns with the number of their bins, at most a few for each length. It is all that the driver
holds and the tasks are sent: its size depends on the capacity alone.

A piece finds its place by its number among the pieces of its length: tasks number their own pieces while they encode
the texts, and a table with one row per task and length says at which number each task begins. Pieces (ids of the
document, place and length, without texts) are settled in the shared folder first, so that these numbers stay the same if
an executor is lost. A length that a third of all pieces have is one row per task in that table; the table is broadcast
if its bytes, counted first, are few, else joined by a sort-merge join.

Edge cases: a null or empty text has the end id alone. A null id stays null. Rows that repeat an id are documents of their
own. Equal lengths take any of the places for their length. A text of any length is encoded whole, and its ids are held
once. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filelens.llm._common import beside, cut, map_rows, table
from filelens.llm.packing import ids_of

CAPACITY = 1024
END_ID = 2

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task bigint, place bigint"
PLACED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"

#: Which of several combinations that fill a gap is taken.
PREFERENCES = (1.0, 0.5, 0.0)

#: Bits of a key for a piece's number among those of its length; the length is above them.
_NUMBER_BITS = 48


class Complements:
    """Sums of one, two and three lengths that are still there, by the gap that they fill.

    A length that is used up never comes back, so what is found unavailable is dropped from the index. The combinations
    of a gap are listed when the gap first comes up, and kept while it is the last one asked for. ``prefer`` is where in
    their order, from most alike (0) to the one with the longest (1), one is taken.
    """

    def __init__(self, left: np.ndarray, prefer: float):
        self.left, self.prefer, self.gap, self.pairs, self.triples = left, prefer, -1, None, None

    def _available(self, rows: np.ndarray) -> np.ndarray:
        """Of rows of lengths, each from the greatest to the smallest, those whose lengths are there as often as needed."""
        ok = (self.left[rows] > 0).all(axis=1)
        for k in range(1, rows.shape[1]):
            repeats = (rows[:, : k + 1] == rows[:, k : k + 1]).sum(axis=1)
            ok &= self.left[rows[:, k]] >= repeats
        return rows[ok]

    def _pairs_of(self, total: int) -> np.ndarray:
        greater = np.arange((total + 1) // 2, total)
        return np.stack([greater, total - greater], axis=1)

    def _triples_of(self, total: int) -> np.ndarray:
        """The first length runs over those that are there, the other two over the pairs that it leaves."""
        there = np.flatnonzero(self.left[: max(0, total - 1)])
        parts = []
        for first in there[there >= (total + 2) // 3]:
            pairs = self._pairs_of(total - int(first))
            pairs = pairs[(pairs[:, 0] <= first) & (self.left[pairs] > 0).all(axis=1)]
            parts.append(np.insert(pairs, 0, first, axis=1))
        return np.concatenate(parts) if parts else np.empty((0, 3), np.int64)

    def _one_of(self, rows: np.ndarray) -> tuple[int, ...] | None:
        return tuple(map(int, rows[round(self.prefer * (len(rows) - 1))])) if len(rows) else None

    def filling(self, gap: int) -> tuple[int, ...] | None:
        """A combination that fills the gap: a single length, else of two, else of three."""
        if self.left[gap]:
            return (gap,)
        if gap != self.gap:
            self.gap, self.pairs, self.triples = gap, self._pairs_of(gap), None
        self.pairs = self._available(self.pairs)
        if len(self.pairs):
            return self._one_of(self.pairs)
        if self.triples is None:
            self.triples = self._triples_of(gap)
        self.triples = self._available(self.triples)
        return self._one_of(self.triples)


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, number of bins) that hold ``counts[length]`` pieces of each length, in the fewest bins of PREFERENCES."""
    return min((_patterns(counts, capacity, x) for x in PREFERENCES), key=lambda found: sum(bins for _, bins in found))


def _patterns(counts: dict[int, int], capacity: int, prefer: float) -> list[tuple[tuple[int, ...], int]]:
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    index, out = Complements(left, prefer), []
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return out
        taken = Counter({int(there[-1]): 1})
        left[there[-1]] -= 1
        gap, filling = capacity - int(there[-1]), None
        while gap:
            fitting = np.flatnonzero(left[: gap + 1])
            if not len(fitting):
                break
            # Three of the longest that fit must reach the end of the gap.
            filling = index.filling(gap) if gap <= 3 * fitting[-1] else None
            if filling:
                break
            best = int(fitting[-1])
            taken[best] += 1
            left[best] -= 1
            gap -= best
        for length, n in taken.items():
            left[length] += n
        taken.update(filling or ())
        bins = min(int(left[length]) // n for length, n in taken.items())
        for length, n in taken.items():
            left[length] -= bins * n
        out.append((tuple(sorted(taken.elements(), reverse=True)), bins))


def slots(found: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Where the pieces of each length go, by their number: rows (key, per bin, first sequence, offset) in order of the key.

    A slot is what a pattern has of one length; the key is the length and the number of the first piece in the slot.
    """
    rows, numbers, sequence = [], Counter(), 0
    for lengths, bins in found:
        offset = 0
        for length, n in Counter(lengths).items():
            rows.append((length << _NUMBER_BITS | numbers[length], n, sequence, offset))
            numbers[length] += n * bins
            offset += n * length
        sequence += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of all documents, numbered within task and length: PIECES, and their ``ids`` if asked for."""

    class Step:
        def __init__(self) -> None:
            self.ids = ids_of(tokenizer_path)
            self.task = TaskContext.get().partitionId() if TaskContext.get() else 0
            self.places: Counter = Counter()

        def __call__(self, row: tuple) -> Iterable[tuple]:
            ids = self.ids.of(row[1] or "") + end_id.to_bytes(4, "little")
            total, start = len(ids) // 4, 0
            end = (total - 1) % capacity + 1
            for piece in range(-(-total // capacity)):
                own, length = ids[4 * start : 4 * end], end - start
                yield (row[0], piece, start, length, zlib.crc32(own), self.task, self.places[length], *([np.frombuffer(own, "<i4")] if with_ids else []))
                self.places[length] += 1
                start, end = end, end + capacity

    return map_rows(docs.select(F.col(id_col).cast("bigint"), text_col), PIECES + (", ids array<int>" if with_ids else ""), Step)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: PLACED, and the piece's ``ids`` if asked for."""
    held = cut(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids))
    counts = cut(held.groupBy("task", "length").agg(F.count("*").alias("n")))
    where = slots(patterns({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint")).alias("first"))
    more = ["ids"] if with_ids else []
    numbered = beside(held, cut(firsts), ["task", "length"], "inner", F.lit(32)).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("place")).alias("number"), *more)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, per_bin, first, offset = where.T
        for batch in batches:
            *kept, number = batch.columns[:6]
            length, number = kept[3].to_numpy(), number.to_numpy()
            key = length << _NUMBER_BITS | number
            at = np.searchsorted(keys, key, "right") - 1
            bin_, k = np.divmod(key - keys[at], per_bin[at])
            columns = [*kept, pa.array(first[at] + bin_, pa.int64()), pa.array(offset[at] + k * length, pa.int64()), *batch.columns[6:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *more])

    return numbered.mapInArrow(place, PLACED + (", ids array<int>" if with_ids else ""))


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of each sequence without its padding, from pieces with their ids; a sequence has at most the capacity."""
    return placed.groupBy("sequence_id").agg(F.flatten(F.sort_array(F.collect_list(F.struct("offset", "ids"))).getField("ids")).alias("ids"))


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
