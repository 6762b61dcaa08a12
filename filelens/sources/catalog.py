"""Stored indexes: generations of entries with their change logs.

    <dir>/CURRENT              the number of the generation that readers open
    <dir>/gen=<g>/entries      Parquet in path order, all columns
    <dir>/gen=<g>/by_name      Parquet in buckets, for lookups by parent and name
    <dir>/gen=<g>/meta         roots and times
    <dir>/gen=<g>/changes      the log since then, a Parquet folder per batch

A generation's meta and, for each batch, a file ``_state`` that is renamed into place with it tell of the state there: how
many files and folders it has, the greatest id ever used (ids of removed entries never come back), and the last micro
batch of each stream that the log holds. A micro batch that a stream gives again after a failure is known by this and left
out, so each is applied once; and a status needs no entry.

A generation never changes once CURRENT names it; a snapshot that was opened stays what it was while later ones are
written. All files go through Hadoop's file systems, so the folder may be anywhere that Spark can write.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelens.operators import changes, tree
from filelens.operators.overlay import Delta, delta
from filelens.operators.search import Index
from filelens.schema import COLUMNS
from filelens.sources import config, filesystem, lookup
from filelens.storage import settled, write_entries


class Replaced(RuntimeError):
    """Another writer made a new generation; load again."""


@dataclass(frozen=True)
class Snapshot(Index):
    """An open state: the generation, and how many change batches it has seen."""

    generation: int = 0
    batches: int = 0
    roots: tuple[str, ...] = ()
    built_at: int = 0
    unreadable: int = 0
    #: The last micro batch of each stream that is in this state.
    applied: dict[str, int] = field(default_factory=dict)
    files: int = 0
    folders: int = 0
    top_id: int = -1
    #: What the log changes of the stored generation; None where there is no log.
    delta: Delta | None = None

    def stats(self) -> DataFrame:
        """(files, folders), from what the catalog keeps of each state: no entry is read."""
        return self.entries.sparkSession.createDataFrame([(self.files, self.folders)], "files bigint, folders bigint")


class Catalog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # files

    def _at(self, name: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str | None:
        p, fs = self._at(name)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        """Whole or not at all: a new file that takes the place of the old."""
        jvm = self.spark._jvm
        new, fs = self._at(f".{name.rpartition('/')[2]}.new")
        stream = fs.create(new, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        target, _ = self._at(name)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(target.getParent())
        option = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        option[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        context.rename(fs.makeQualified(new), fs.makeQualified(target), option)

    def _batches(self, generation: int) -> int:
        p, fs = self._at(f"gen={generation}/changes")
        return sum(s.getPath().getName().startswith("batch=") and fs.exists(self._at(f"gen={generation}/changes/{s.getPath().getName()}/_SUCCESS")[0]) for s in fs.listStatus(p)) if fs.exists(p) else 0

    # generations

    def current(self) -> int | None:
        text = self._read("CURRENT")
        return int(text) if text else None

    def publish(self, entries: DataFrame, roots: list[str], built_at: int | None = None, unreadable: int = 0, applied: dict[str, int] | None = None) -> Snapshot:
        """A new generation, which readers see once it is whole; ``unreadable`` is the number of folders that the scan couldn't enter."""
        generation = max(time.time_ns(), (self.current() or 0) + 1)
        at = f"{self.path}/gen={generation}"
        write_entries(tree.with_intervals(settled(entries)), f"{at}/entries")
        files, folders, top = self.spark.read.parquet(f"{at}/entries").agg(F.count_if(~F.col("is_dir")), F.count_if(F.col("is_dir")), F.max("id")).first()
        state = {"applied": applied or {}, "files": files, "folders": folders, "top_id": -1 if top is None else top}
        buckets = lookup.buckets_for(files + folders)
        lookup.store(self._stored(generation), self._by_name(generation), buckets)
        meta = {"roots": roots, "built_at": int(time.time()) if built_at is None else built_at, "unreadable": unreadable, "buckets": buckets}
        self._write(f"gen={generation}/meta", json.dumps(meta | state))
        self._write("CURRENT", str(generation))
        return self.load()

    def build(self, c: config.Config) -> Snapshot:
        """Scans the roots and publishes what it finds."""
        scanned = settled(filesystem.scan(self.spark, c.roots, c.excludes))
        before = self.current()
        applied = {} if before is None else self._state(before, self._batches(before))["applied"]
        return self.publish(tree.entries_of(filesystem.base_rows(scanned)), c.roots, unreadable=scanned.where("unreadable").count(), applied=applied)

    def _meta(self, generation: int) -> dict:
        return json.loads(self._read(f"gen={generation}/meta"))

    def _state(self, generation: int, batches: int) -> dict:
        text = self._read(f"gen={generation}/changes/batch={batches - 1}/_state") if batches else None
        meta = json.loads(text) if text else self._meta(generation)
        return {k: meta[k] for k in ("applied", "files", "folders", "top_id")}

    def _stored(self, generation: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/gen={generation}/entries")

    def _by_name(self, generation: int) -> str:
        path, fs = self._at(f"gen={generation}/by_name")
        return fs.makeQualified(path).toString()

    def load(self) -> Snapshot:
        """The current generation with its log laid over it. Raises FileNotFoundError if there is none."""
        generation = self.current()
        if generation is None:
            raise FileNotFoundError(f"no index in {self.path}")
        stored, batches, meta = self._stored(generation), self._batches(generation), self._meta(generation)
        found = delta(stored, self._log(generation, batches)) if batches else None
        entries = found.over(stored) if found else stored.select(COLUMNS)
        return Snapshot(entries, generation, batches, tuple(meta["roots"]), meta["built_at"], meta["unreadable"], delta=found, **self._state(generation, batches))

    def load_or_build(self, c: config.Config) -> Snapshot:
        """Builds only where there is no index yet; any other failure is raised."""
        try:
            return self.load()
        except FileNotFoundError:
            return self.build(c)

    def lookup(self, snapshot: Snapshot, keys: DataFrame) -> DataFrame:
        """(parent_id, name, id, is_dir) of the snapshot's entries at the keys (parent_id, name); ``sources.lookup.find`` has the details."""
        buckets = self._meta(snapshot.generation)["buckets"]
        return lookup.find(lookup.opened(self.spark, self._by_name(snapshot.generation), buckets), keys, snapshot.delta)

    # changes

    def _log(self, generation: int, batches: int) -> DataFrame:
        """The changes of the first ``batches`` batches; each counts from 0, so a change's place is its batch and its number there."""
        at = f"{self.path}/gen={generation}/changes"
        log = self.spark.read.schema(f"{changes.LOG_SCHEMA}, batch int").option("basePath", at).parquet(*(f"{at}/batch={k}" for k in range(batches)))
        return log.withColumn("seq", F.struct("batch", "seq")).drop("batch")

    def append(self, snapshot: Snapshot, log: DataFrame, origin: tuple[str, int] | None = None) -> Snapshot:
        """Adds a batch to the log of the snapshot's generation and opens the state after it.

        ``origin``: the stream and the number of its micro batch that the log comes from, if from one. The snapshot is
        returned as it is if it has that micro batch already; micro batches of a stream come in the order of their numbers.

        The batch is written aside and takes its number by a rename that fails where another writer has taken it.
        """
        if origin and snapshot.applied.get(origin[0], -1) >= origin[1]:
            return snapshot
        replaced = Replaced(f"generation {snapshot.generation} isn't the latest any more")
        if self.current() != snapshot.generation or self._batches(snapshot.generation) != snapshot.batches:
            raise replaced
        held = settled(log.select([c.split()[0] for c in changes.LOG_SCHEMA.split(", ")]))
        place = F.struct(F.lit(snapshot.batches).alias("batch"), "seq").alias("seq")
        own = held.select(place, *[c for c in held.columns if c != "seq"])
        stored = self._stored(snapshot.generation)
        found = delta(stored, self._log(snapshot.generation, snapshot.batches).unionByName(own) if snapshot.batches else own)
        files, folders = found.counts(*(self._meta(snapshot.generation)[k] for k in ("files", "folders")))
        top = held.agg(F.max("id")).first()[0]
        after = replace(
            snapshot,
            entries=found.over(stored),
            delta=found,
            batches=snapshot.batches + 1,
            applied=snapshot.applied | ({origin[0]: origin[1]} if origin else {}),
            files=files,
            folders=folders,
            top_id=max(snapshot.top_id, -1 if top is None else top),
        )
        changes_at = f"gen={snapshot.generation}/changes"
        aside, fs = self._at(f"{changes_at}/.new-{uuid.uuid4().hex}")
        held.write.parquet(aside.toString())
        self._write(f"{changes_at}/{aside.getName()}/_state", json.dumps({k: getattr(after, k) for k in ("applied", "files", "folders", "top_id")}))
        target, _ = self._at(f"{changes_at}/batch={snapshot.batches}")
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(aside), fs.makeQualified(target), self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Py4JJavaError as e:
            if not fs.exists(target):
                raise
            fs.delete(aside, True)
            raise replaced from e
        return after

    def change_count(self, snapshot: Snapshot) -> int:
        return self._log(snapshot.generation, snapshot.batches).count() if snapshot.batches else 0

    def compact(self, snapshot: Snapshot) -> Snapshot:
        """A new generation with the log worked in, dense ids in path order and no orphans."""
        rows = changes.compact(snapshot.entries)
        return self.publish(tree.entries_of(rows), list(snapshot.roots), snapshot.built_at, snapshot.unreadable, snapshot.applied)

    def compact_if_due(self, snapshot: Snapshot) -> Snapshot:
        if snapshot.batches and changes.compaction_due(self.change_count(snapshot), snapshot.entries.count()):
            return self.compact(snapshot)
        return snapshot
