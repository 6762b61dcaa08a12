"""Keeping an index up to date from events.

``reconcile`` compares the paths that events name with the disk and gives the changes; ``follow`` does so for each micro
batch of a stream of (path, rescan) rows, and ``apply_stream`` appends a stream of ready-made changes. ``rescan`` compares
all roots with the disk and appends the differences only. All of it runs on the executors, which must see the files: the
driver holds the roots and the patterns of excludes, never paths.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from filelens.operators.changes import LOG_SCHEMA, diff
from filelens.operators.numbering import numbered
from filelens.operators.search import absolute
from filelens.schema import BASE_COLUMNS, ROOT_PARENT
from filelens.sources import filesystem
from filelens.sources.catalog import Catalog, Replaced, Snapshot
from filelens.sources.excludes import Excludes
from filelens.storage import settled

#: How often a stream looks for events.
SETTLE = "250 milliseconds"
LOG_COLUMNS = [c.split()[0] for c in LOG_SCHEMA.split(", ")]

_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}


def _by_row(rows: DataFrame, schema: str, of_row: Callable[..., Iterable[tuple]]) -> DataFrame:
    """What ``of_row(*row)`` yields for each row, in Arrow batches."""
    fields = [column.split() for column in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                made = [out for row in zip(*(c.to_pylist() for c in batch.slice(k, 1000).columns), strict=True) for out in of_row(*row)]
                columns = zip(*made, strict=True) if made else [[] for _ in fields]
                yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    return rows.mapInArrow(run, schema)


def _chain(root: str, path: str) -> list[str]:
    """The path and the folders above it, from the root down."""
    out = [path]
    while out[-1] != root:
        out.append(os.path.dirname(out[-1]))
    return out[::-1]


#: A path on the way to one that an event names: whether it, or what is above it, is excluded, and whether the path is on disk.
_STEPS = "path string, rescan boolean, root string, at string, level int, excluded boolean, there boolean"
#: What is to be done at a path: R takes the entry away, A puts one there (instead of it), with all below.
_ACTS = "path string, root string, above array<string>, op string, old_id bigint, old_parent bigint, is_dir boolean, size bigint, mtime bigint, ctime bigint"


def _steps(events: DataFrame, roots: list[str], excludes: Excludes) -> DataFrame:
    def steps(path: str, rescan: bool | None) -> Iterator[tuple]:
        path = absolute(path)
        root = next((r for r in roots if path == r or path.startswith(r if r == "/" else r + "/")), None)
        if root is None:
            return
        # what stands below an excluded folder is excluded too, and on an event a root as well
        there, excluded = os.path.lexists(path), False
        for level, at in enumerate(_chain(root, path)):
            excluded = excluded or excludes.match(at, os.path.basename(at))
            yield path, bool(rescan), root, at, level, excluded, there

    return _by_row(events.select("path", "rescan"), _STEPS, steps)


def reconcile(snapshot: Snapshot, events: DataFrame, excludes: Excludes) -> DataFrame:
    """A log that brings the index to what is on disk at the paths of ``events`` (path, rescan); rescan replaces a folder's subtree.

    Of a path that is on disk and not in the index, the uppermost folder that the index lacks is added with all below it.
    A path's entry is left alone if its kind is the same and it is a folder without rescan, or a file whose size and times
    are the same; else it goes, with all below it, and comes again under a new id. What lies below a path that goes or
    comes isn't looked at on its own.
    """
    roots = [r.rstrip("/") or "/" for r in snapshot.roots]
    steps = settled(_steps(events, roots, excludes))
    wanted = steps.select(F.col("at").alias("path")).distinct()
    entry = F.struct("id", "parent_id", "is_dir", "size", "mtime", "ctime")
    known = settled(snapshot.entries.select("path", entry.alias("e"), "id").join(wanted, "path").groupBy("path").agg(F.min_by("e", "id").alias("e")))

    # Where each event leads to: the first step that isn't a folder of the index, or the path itself.
    beside = steps.join(known.withColumnRenamed("path", "at"), "at", "left")
    stop = (F.col("at") == F.col("path")) | (F.col("there") & (F.col("e").isNull() | ~F.col("e.is_dir")))
    # A path that is excluded, or below what is, only goes.
    shut = F.max(F.when(F.col("at") == F.col("path"), F.col("excluded")))
    own = F.struct("at", "root", "excluded", "e", "rescan")
    places = beside.groupBy("path").agg(F.min_by(F.when(stop, own), F.when(stop, F.col("level"))).alias("first"), F.max_by(own, "level").alias("last"), shut.alias("shut"))
    place = F.when(F.col("shut"), F.col("last")).otherwise(F.col("first"))
    targets = places.select(place.alias("t"), (place.getField("at") == F.col("path")).alias("itself"))
    targets = targets.groupBy("t.at").agg(F.first("t.root").alias("root"), F.max("t.excluded").alias("excluded"), F.first("t.e").alias("e"), F.max(F.col("itself") & F.col("t.rescan")).alias("rescan"))

    def acts(path: str, root: str, excluded: bool, rescan: bool, old_id, old_parent, is_dir, size, mtime, ctime) -> Iterator[tuple]:
        found = None if excluded else filesystem.metadata(path)
        if found is None and old_id is None:
            return
        if found and old_id is not None and is_dir == found[0] and (not rescan if is_dir else (size, mtime, ctime) == found[1:]):
            return
        yield path, root, _chain(root, path)[:-1], "A" if found else "R", old_id, old_parent, *(found or [None] * 4)

    old = [F.col(f"e.{c}") for c in ("id", "parent_id", "is_dir", "size", "mtime", "ctime")]
    acts_ = settled(_by_row(targets.select("at", "root", "excluded", "rescan", *old), _ACTS, acts))
    covered = acts_.select(F.col("path").alias("_own"), F.explode("above").alias("_above")).join(acts_.select(F.col("path").alias("_above")), "_above", "left_semi").select(F.col("_own").alias("path"))
    acts_ = acts_.join(covered, "path", "left_anti")

    top = acts_.where("op = 'A'")
    name = F.when(F.col("path") == F.col("root"), F.col("path")).otherwise(F.substring_index("path", "/", -1))
    # An entry's parent is "" where it is a root; below "/" it is "/".
    parent = F.when(F.col("path") == F.col("root"), "").otherwise(F.element_at("above", -1))
    tops = top.select("root", "path", parent.alias("parent"), name.alias("name"), "is_dir", "size", "mtime", "ctime", "old_parent")
    start = top.where("is_dir").select("root", F.col("path").cast("binary").alias("at"), F.lit(filesystem.ENTER).alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("parent"))
    below = filesystem.expand(start, excludes).select("root", "path", "parent", "name", "is_dir", "size", "mtime", "ctime", F.lit(None).cast("bigint").alias("old_parent"))
    new = settled(numbered(tops.unionByName(below), [F.col("path"), F.col("root")], "id", snapshot.top_id + 1))
    folders = known.where("e.is_dir").select("path", F.col("e.id").alias("id")).join(new.select("path"), "path", "left_anti").unionByName(new.where("is_dir").select("path", "id"))
    placed = new.join(folders.select(F.col("path").alias("parent"), F.col("id").alias("_up")), "parent", "left")
    parent_id = F.when(F.col("path") == F.col("root"), ROOT_PARENT).otherwise(F.coalesce("old_parent", "_up")).cast("bigint")
    added = placed.select(F.lit(1).cast("bigint").alias("seq"), F.lit("A").alias("op"), "id", parent_id.alias("parent_id"), "size", "mtime", "ctime", "is_dir", "name").where("parent_id is not null")
    nulls = [F.lit(None).cast(kind).alias(c) for c, kind in (column.split() for column in LOG_SCHEMA.split(", ")[3:])]
    removed = acts_.where("old_id is not null").select(F.lit(0).cast("bigint").alias("seq"), F.lit("R").alias("op"), F.col("old_id").alias("id"), *nulls)
    return removed.unionByName(added).select(LOG_COLUMNS)


def apply_events(catalog: Catalog, snapshot: Snapshot, events: DataFrame | Iterable[tuple[str, bool]], excludes: Excludes, origin: tuple[str, int] | None = None) -> Snapshot:
    """The state after the events; the same one if nothing has changed."""
    rows = events if isinstance(events, DataFrame) else catalog.spark.createDataFrame(list(events), "path string, rescan boolean")
    log = settled(reconcile(snapshot, rows, excludes))
    return snapshot if log.isEmpty() else catalog.append(snapshot, log, origin)


def on_disk(snapshot: Snapshot, excludes: list[str]) -> DataFrame:
    """Base rows of what the snapshot's roots hold now: entries that it has keep their ids, others get new ones in path order.

    The scan and the comparison run on the executors. A root that isn't there has no entries.
    """
    spark = snapshot.entries.sparkSession
    there = any(map(os.path.isdir, snapshot.roots))
    found = settled((filesystem.scan(spark, list(snapshot.roots), excludes) if there else spark.createDataFrame([], filesystem.SCHEMA)).withColumn("size", F.when(F.col("is_dir"), 0).otherwise(F.col("size"))))
    roots = snapshot.entries.where(F.col("parent_id") == ROOT_PARENT).select(F.col("id").alias("root_id"), F.col("path").alias("root"))
    old = snapshot.entries.select("root_id", "path", "is_dir", "id", "parent_id").join(roots, "root_id").drop("root_id")
    kept = found.join(old, ["root", "path", "is_dir"])
    new = found.join(old, ["root", "path", "is_dir"], "left_anti")
    ids = settled(numbered(new, [F.col("path"), F.col("root")], "id", snapshot.top_id + 1))
    folders = kept.where("is_dir").select("root", "path", "id").unionByName(ids.where("is_dir").select("root", "path", "id")).withColumnsRenamed({"path": "parent", "id": "parent_id"})
    added = ids.join(folders, ["root", "parent"], "left").withColumn("parent_id", F.coalesce("parent_id", F.lit(ROOT_PARENT).cast("bigint")))
    return kept.select(BASE_COLUMNS).unionByName(added.select(BASE_COLUMNS))


def rescan(catalog: Catalog, snapshot: Snapshot, excludes: list[str]) -> Snapshot:
    """The state after comparing all roots with the disk; the same one, and nothing appended, if nothing has changed."""
    log = settled(diff(snapshot.entries.select(BASE_COLUMNS), on_disk(snapshot, excludes)))
    return snapshot if log.isEmpty() else catalog.append(snapshot, log.select(LOG_COLUMNS))


def follow(catalog: Catalog, events: DataFrame, excludes: Excludes, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Applies a stream of (path, rescan): a micro batch's paths are told apart and compared with the disk, once.

    ``events.settle`` before it makes one row of a burst.
    """

    def batch(rows: DataFrame, number: int) -> None:
        told = settled(rows.groupBy("path").agg(F.max("rescan").alias("rescan")))
        if not told.isEmpty():
            _retried(catalog, lambda s: apply_events(catalog, s, told, excludes, (checkpoint, number)))

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": SETTLE})).start()


def apply_stream(catalog: Catalog, log: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends a stream of changes in the log's schema, a batch of the log per micro batch; one that is given again is left out."""

    def batch(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            _retried(catalog, lambda s: catalog.append(s, rows, (checkpoint, number)))

    return log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": SETTLE})).start()


def _retried(catalog: Catalog, change) -> None:
    """One more try on the newest state if another writer came between; then compaction if it is due."""
    try:
        after = change(catalog.load())
    except Replaced:
        after = change(catalog.load())
    catalog.compact_if_due(after)
