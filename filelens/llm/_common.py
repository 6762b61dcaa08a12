"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filelens.storage import settled as cut

#: Rows of one Arrow batch that Python builds; a batch also ends at BATCH_BYTES of text.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20
#: Bytes of one Arrow batch that Spark hands to Python, after ``small_batches``.
HANDED_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: the last column, bytes, compressed; texts that are exchanged whole take half the room so."""
    press = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        *rest, last = batch.columns
        yield pa.RecordBatch.from_arrays([*rest, pa.array([press(x or b"") for x in last.to_pylist()], pa.binary())], names=batch.schema.names)


def unpacked(data: bytes) -> bytes:
    return zstandard.decompress(data)


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of the session end at HANDED_BYTES, unless they end sooner already.

    Spark's own bound of 64 MB lets a batch have all texts of a split, which buffers that double as they grow, Python's
    copy and its list of values then hold at once, outside the heap, for each task. The rows stay the same. The bound is
    read when a plan runs, after the operator has returned, so it stays set.
    """
    bound, read = "spark.sql.execution.arrow.maxBytesPerBatch", spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if read(spark.conf.get(bound, "64m")) > HANDED_BYTES:
        spark.conf.set(bound, str(HANDED_BYTES))


def apart(*keys: str) -> Column:
    """A further grouping key that depends on ``keys`` alone.

    Grouped by it too, the groups are the same, but Spark can't reuse their partitioning for a join on the keys: both
    sides of the join get an exchange of their own, and adaptive execution can then split a key that has very many rows.
    """
    return F.xxhash64(*keys, F.lit(1)).alias("_apart")


def met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A shuffle join of two tables that both grow with the corpus: never a broadcast, and hot keys may be split."""
    return left.hint("merge").join(right, on, how)


def boxed(docs: DataFrame, **columns: Column) -> DataFrame:
    """(row, further columns): the whole row of ``docs`` in one struct, so that its column names can't clash."""
    return docs.select(F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("row"), *(v.alias(k) for k, v in columns.items()))


#: A side of at most this many bytes, as counted before the join, is broadcast to spare the texts an exchange.
BROADCAST_BYTES = 8 << 20


def beside(texts: DataFrame, small: DataFrame, on: Column, how: str, size: Column | None = None) -> DataFrame:
    """Rows with whole texts joined with settled rows about them, whose bytes ``size`` gives per row (default 96).

    The bytes are counted first: up to BROADCAST_BYTES ``small`` is broadcast, beyond it both sides are exchanged.
    """
    n = small.agg(F.sum(F.lit(96) if size is None else size)).first()[0] or 0
    return texts.join(F.broadcast(small), on, how) if n <= BROADCAST_BYTES else met(texts, small, on, how)


def text_digest(text: Column) -> Column:
    """The SHA-256 of a text's bytes, null as empty. With the id it tells rows apart where ids repeat or are null."""
    return F.unhex(F.sha2(F.coalesce(text.cast("binary"), F.lit(b"")), 256))


def without(docs: DataFrame, marked: DataFrame, id_col: str, text_col: str, digest: Column) -> DataFrame:
    """``docs`` without rows whose (id, ``digest``) are in ``marked`` (_id, _digest, stays), settled; all columns stay.

    Marked keys that ``stays`` are on several rows, of which the one whose text has the smallest digest stays. Only
    these keys meet the texts.
    """
    own = boxed(docs, own_id=F.col(id_col), own=digest, whole=text_digest(F.col(text_col)))
    same = F.col("own_id").eqNullSafe(F.col("_id")) & (F.col("own") == F.col("_digest"))
    kept = beside(own, marked.select("_id", "_digest"), same, "left_anti").select("row")
    repeated = marked.where("stays").select("_id", "_digest")
    if not repeated.isEmpty():
        kept = kept.unionByName(beside(own, repeated, same, "left_semi").groupBy("own_id", "own").agg(F.min_by("row", "whole").alias("row")).select("row"))
    return kept.select("row.*")


def keep_one(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that have the smallest (id, digest) of their class; a null id comes last, of equal rows one stays.

    ``classes`` has (doc_id, digest, root) of every row of ``docs``, settled, the digest as ``text_digest`` has it.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    best = classes.groupBy("root", apart("root")).agg(F.min(key).alias("k")).select("root", "k")
    rows = classes.groupBy("root", "doc_id", "digest").agg(F.count("*").alias("n"))
    judged = met(rows, best, "root").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "n", (F.col("k") == key).alias("stays"))
    return without(docs, cut(judged.where("n > 1 or not stays")), id_col, text_col, text_digest(F.col(text_col)))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, bound: int) -> DataFrame:
    """(doc_id, text, y) of at most ``bound`` labelled training documents, the same ones at every run.

    Held-out rows (``fold_of`` = ``held_out``) and null labels are never used. The ids with the smallest hash are
    taken, so the sample is bounded before it meets the texts and its broadcast has ``bound`` rows at most. Of rows that
    repeat an id the one with the smallest digest is learned from, and only sampled texts are exchanged.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), folds) != held_out))
        .select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y"))
        .groupBy("_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(bound)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y")
    return rows.groupBy("doc_id").agg(F.min_by("text", text_digest(F.col("text"))).alias("text"), F.first("y").alias("y"))


def map_rows(df: DataFrame, schema: str, start: Callable[[], Callable[..., Iterable[tuple]]]) -> DataFrame:
    """Each input row (a tuple) through ``start()(row)``, which yields output rows; state lives as long as a task.

    Output leaves in Arrow batches of BATCH_ROWS rows. ``start()`` may return an object with ``finish()`` that yields
    the last rows of a task.
    """
    out = df.sparkSession.createDataFrame([], schema).schema
    names = out.names
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            got = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)
            rows.clear()
            return got

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    rows.extend(step(row))
                    if len(rows) >= BATCH_ROWS:
                        yield flush()
        if hasattr(step, "finish"):
            rows.extend(step.finish())
        yield flush()

    return df.mapInArrow(run, out)


class Memo(dict):
    """What ``make(key)`` gave, for keys of up to 64 characters: the last ``size`` keys asked for, and those of the generation before."""

    def __init__(self, make: Callable, size: int):
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key: str):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got
