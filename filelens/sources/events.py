"""Event logs: which paths may have changed, as a stream with offsets, and the settling of bursts.

An event log is a folder of segments, ``<number>.jsonl``, numbered from 0 without gaps. A segment appears whole, by a
link, and never changes, so an offset is a number of segments and a micro batch that is replayed reads the same lines.
Each line is an object with ``path`` and, if the folder's whole subtree is in doubt, ``rescan``. Readers on the executors
must see the folder.

    spark.dataSource.register(EventSource)
    events = spark.readStream.format("fileevents").load("/shared/events")
    live.follow(catalog, settle(events), excludes, checkpoint)
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "path string, rescan boolean"

#: A path is handed on after so many milliseconds without an event, and after this long in any case.
QUIET, LONGEST = 250, 2000


def _segment(folder: str, number: int) -> str:
    return os.path.join(folder, f"{number:020d}.jsonl")


class EventLog:
    """The writing side."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def append(self, events: Iterable[tuple[str, bool]]) -> int:
        """Adds a segment and returns its number; of two writers of one number the slower takes the next."""
        aside = os.path.join(self.folder, f".{uuid.uuid4().hex}")
        with open(aside, "w", encoding="utf-8") as f:
            f.writelines(json.dumps({"path": path, "rescan": bool(rescan)}) + "\n" for path, rescan in events)
        number = segments(self.folder)
        while True:
            try:
                os.link(aside, _segment(self.folder, number))
                break
            except FileExistsError:
                number += 1
        os.unlink(aside)
        return number


def segments(folder: str, known: int = 0) -> int:
    """How many segments there are; ``known`` of them are known to be there."""
    while os.path.exists(_segment(folder, known)):
        known += 1
    return known


@dataclass
class _Segment(InputPartition):
    number: int


class EventReader(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder, self.known = folder, 0

    def initialOffset(self) -> dict:
        return {"segments": 0}

    def latestOffset(self) -> dict:
        self.known = segments(self.folder, self.known)
        return {"segments": self.known}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Segment(k) for k in range(start["segments"], end["segments"])]

    def read(self, partition: _Segment) -> Iterator[tuple]:
        with open(_segment(self.folder, partition.number), encoding="utf-8") as f:
            for line in f:
                event = json.loads(line)
                yield event["path"], bool(event.get("rescan"))


class EventSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fileevents"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return EventReader(self.options["path"])


def settle(events: DataFrame, quiet: int = QUIET, longest: int = LONGEST) -> DataFrame:
    """One row per burst of events of a path, handed on when the path has been quiet, or at last ``longest`` ms after the first.

    The burst is state by path, with a timer in processing time; a burst that holds a rescan is a rescan. State and timers
    are in the checkpoint, so a burst that was open when the stream stopped is handed on after its next start.
    """
    import pandas as pd

    def burst(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        first, rescan = state.get if state.exists else (now, False)
        rescan = bool(rescan) or any(bool(frame["rescan"].fillna(False).any()) for frame in frames)
        # A path that has events in each micro batch never times out.
        if state.hasTimedOut or now >= first + longest:
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "rescan": [rescan]})
        else:
            state.update((first, rescan))
            state.setTimeoutDuration(min(quiet, first + longest - now))

    return events.groupBy("path").applyInPandasWithState(burst, SCHEMA, "first bigint, rescan boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)
