"""Folder trees: ``scan`` walks them on the executors, in rounds that deal the work evenly whatever the shape of the tree.

In a round each task walks the folders that it was dealt until it has seen ``BUDGET`` entries; the folders that it hasn't
entered by then, and the names of an overlong folder that it hasn't looked at, are the next round's work, dealt evenly
again. So one folder that holds everything is walked by all tasks from the second round on, and a deep chain takes no
round per level. Executors must see the same file system. Excluded children are dropped before they are entered; a root
is never excluded. Folders that can't be read are kept as entries with ``unreadable`` set. A symbolic link is an entry,
never followed.

There is a data source too, ``spark.read.format("filetree").option("roots", json).load()``, for plans that want one
relation: it makes a partition of each sub-folder of a root.
"""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from filelens.operators.numbering import numbered
from filelens.plans.values import seconds_of
from filelens.schema import BASE_COLUMNS, ROOT_PARENT
from filelens.sources.excludes import Excludes
from filelens.storage import settled

SCHEMA = "root string, path string, parent string, name string, is_dir boolean, size bigint, mtime bigint, ctime bigint, unreadable boolean"

#: Entries that a task looks at in a round.
BUDGET = 20_000
#: What a row of a round is: an entry, a folder to be entered, or a path to be looked at.
FOUND, ENTER, LOOK = 0, 1, 2
_ROUND = f"{SCHEMA}, at binary, kind int"


def metadata(path: str) -> tuple[bool, int, int, int] | None:
    """(is_dir, size, mtime, ctime) of a path, None if it is gone. Creation time is 0 where the system has none."""
    try:
        s = os.lstat(path)
    except OSError:
        return None
    folder = stat.S_ISDIR(s.st_mode)
    born = getattr(s, "st_birthtime_ns", None)
    return folder, 0 if folder else s.st_size, seconds_of(s.st_mtime_ns), seconds_of(born) if born else 0


def _text(name: str) -> str:
    """Names that aren't UTF-8 are kept with U+FFFD for what can't be read."""
    return os.fsencode(name).decode("utf-8", "replace")


def walk(root: str, top: str, excludes: Excludes, deep: bool = True) -> Iterator[tuple]:
    """Rows of what is below ``top`` (not itself), parents first."""
    pending = [top]
    while pending:
        folder = pending.pop()
        try:
            with os.scandir(folder) as it:
                children = sorted(e.name for e in it)
        except OSError:
            continue
        for name in children:
            path = (folder if folder.endswith("/") else folder + "/") + name
            if excludes.match(_text(path), _text(name)):
                continue
            row = entry(root, path, _text(name), _text(folder))
            if row:
                yield row
                if row[4] and deep:
                    pending.append(path)


def entry(root: str, path: str, name: str, parent: str) -> tuple | None:
    found = metadata(path)
    if not found:
        return None
    return root, _text(path), parent, name, *found, bool(found[0] and not os.access(path, os.R_OK | os.X_OK))


@dataclass
class _Part(InputPartition):
    root: str
    top: str
    deep: bool


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.roots = json.loads(options["roots"])
        self.excludes = Excludes.of(json.loads(options.get("excludes", "[]")))

    def partitions(self) -> list[InputPartition]:
        parts: list[InputPartition] = []
        for root in self.roots:
            parts.append(_Part(root, root, False))
            parts += [_Part(root, row[1], True) for row in walk(root, root, self.excludes, False) if row[4]]
        return parts or [_Part("", "", False)]

    def read(self, part: _Part) -> Iterator[tuple]:
        if part.root and not part.deep:
            top = entry(part.root, part.root, _text(part.root), "")
            if top:
                yield top
        if part.root:
            yield from walk(part.root, part.top, self.excludes, part.deep)


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


def scan(spark: SparkSession, roots: list[str], excludes: list[str]) -> DataFrame:
    """What a scan finds, in SCHEMA. Roots that aren't there are skipped; none at all is an error."""
    there = [r for r in roots if os.path.isdir(r)]
    if not there:
        raise FileNotFoundError(f"none of the roots can be read: {', '.join(roots)}")
    start = spark.createDataFrame([(r, os.fsencode(r), LOOK, _text(r), "") for r in there], "root string, at binary, kind int, name string, parent string")
    return expand(start, Excludes.of(excludes))


class _Round:
    """What a task does in a round: rows of _ROUND from rows (root, at, kind, name, parent)."""

    def __init__(self, excludes: Excludes, budget: int):
        self.excludes, self.left = excludes, budget

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
        schema = pa.schema([(name, types[kind]) for name, kind in (column.split() for column in _ROUND.split(", "))])
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return got

        work = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for row in self._rows(work):
            rows.append(row)
            if len(rows) >= 2000:
                yield flush()
        if rows:
            yield flush()

    def _rows(self, work: Iterator[tuple]) -> Iterator[tuple]:
        entered: list[tuple[str, str]] = []
        for root, at, kind, name, parent in work:
            path = os.fsdecode(at)
            if kind == ENTER:
                entered.append((root, path))
            else:
                yield from self._look(root, path, name, parent, entered)
            yield from self._walk(entered)

    def _look(self, root: str, path: str, name: str, parent: str, entered: list) -> Iterator[tuple]:
        self.left -= 1
        row = entry(root, path, name, parent)
        if row:
            yield (*row, None, FOUND)
            if row[4]:
                entered.append((root, path))

    def _walk(self, entered: list) -> Iterator[tuple]:
        later = lambda root, path, kind, name, parent: (root, None, parent, name, *[None] * 5, os.fsencode(path), kind)
        while entered:
            root, folder = entered.pop()
            if self.left <= 0:
                yield later(root, folder, ENTER, None, None)
                continue
            try:
                with os.scandir(folder) as it:
                    children = sorted(e.name for e in it)
            except OSError:
                continue
            for child in children:
                path = (folder if folder.endswith("/") else folder + "/") + child
                if self.excludes.match(_text(path), _text(child)):
                    continue
                if self.left <= 0:
                    yield later(root, path, LOOK, _text(child), _text(folder))
                else:
                    yield from self._look(root, path, _text(child), _text(folder), entered)


def expand(start: DataFrame, excludes: Excludes, budget: int = BUDGET) -> DataFrame:
    """Entries (SCHEMA) from rows (root, at, kind, name, parent): what is to be looked at, and all below folders to be entered."""
    tasks = start.sparkSession.sparkContext.defaultParallelism
    found, work = [], start.select("root", "at", "kind", "name", "parent")
    while True:
        rows = settled(work.repartition(tasks).mapInArrow(_Round(excludes, budget), _ROUND))
        found.append(rows.where(F.col("kind") == FOUND).drop("at", "kind"))
        work = rows.where(F.col("kind") != FOUND).select("root", "at", "kind", "name", "parent")
        if work.isEmpty():
            return reduce(DataFrame.unionByName, found)


def base_rows(scanned: DataFrame, first_id: int = 0) -> DataFrame:
    """Base rows with ids in path order, parents found by their paths; overlapping roots keep an entry for each."""
    key = [F.col(c) for c in ("_fold", "path", "root")]
    fold = F.translate(F.col("path"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    ids = numbered(scanned.withColumn("_fold", fold), key, "id", first_id).drop("_fold")
    up = ids.where("is_dir").select(F.col("id").alias("_up"), F.col("root").alias("_root"), F.col("path").alias("_path"))
    joined = ids.join(up, (ids.root == up._root) & (ids.parent == up._path), "left")
    return joined.withColumn("parent_id", F.coalesce("_up", F.lit(ROOT_PARENT).cast("bigint"))).select(BASE_COLUMNS)
