"""A change log laid over a stored table, at a cost that follows the changes and not the table.

An entry's path changes only if a folder above it has changed, and whether a folder is the first of its twins only if a
folder of the same name came or went beside it. So the entries to be placed anew are the added ones and those below such
folders, whose intervals give them as ranges of places. They are placed below the stored folders above them. All other
entries stay in the stored table, whose filters and columns are still pushed down to the scan: what has changed is left
out of it by an anti-join on ids and united with it.

Everything but the stored table itself is of the size of the changes and of the subtrees that they move, and settled. The
stored table is only ever the streamed side of joins with these tables, on columns that the join needs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelens.functions import columns as C
from filelens.operators import tree
from filelens.operators.changes import laid_over, net_changes
from filelens.schema import BASE_COLUMNS, COLUMNS, INTERVALS, TREE_COLUMNS, with_derived
from filelens.storage import settled

#: Up to so many intervals are handed to the scan as ranges of places; of more, the range that holds them all.
MOST_RANGES = 64


def _within(stored: DataFrame, tops: DataFrame) -> DataFrame:
    """``stored`` without row groups that can't hold anything below the folders."""
    ranges = tops.select("below_first", "below_last").limit(MOST_RANGES + 1).collect()
    if len(ranges) > MOST_RANGES:
        ranges = [tops.agg(F.min("below_first"), F.max("below_last")).first()]
    return stored.where(reduce(or_, (F.col("place").between(*r) for r in ranges)))


@dataclass(frozen=True)
class Delta:
    """What a log does to a stored table: the ids that it takes the place of, their stored rows' kinds, and the rows in their place."""

    ids: DataFrame
    replaced: DataFrame
    changed: DataFrame

    def over(self, stored: DataFrame) -> DataFrame:
        """The full table after the log."""
        return stored.select(COLUMNS).join(self.ids, "id", "left_anti").unionByName(self.changed)

    def counts(self, files: int, folders: int) -> tuple[int, int]:
        """Files and folders after the log, from those before it: only the changes are counted."""
        kinds = (F.count_if(~F.col("is_dir")), F.count_if(F.col("is_dir")))
        (less_files, less_folders), (more_files, more_folders) = self.replaced.agg(*kinds).first(), self.changed.agg(*kinds).first()
        return files - less_files + more_files, folders - less_folders + more_folders


def overlay(stored: DataFrame, log: DataFrame) -> DataFrame:
    """The full table after the log. ``stored`` has COLUMNS and INTERVALS, the log is as ``apply_log`` takes it."""
    return delta(stored, log).over(stored)


def delta(stored: DataFrame, log: DataFrame) -> Delta:
    """The changes of the log, with everything below changed folders, placed."""
    net = settled(net_changes(log))
    structural = net.where("op <> 'U'").select("id")
    named = net.select(F.col("id").alias("_id"), F.col("op").alias("_op"))
    old = settled(stored.join(named, F.col("id") == F.col("_id")).drop("_id"))
    own = ["id", "root_id", "path", "below_first", "below_last"]

    # Folders that come, go or change their twins, as they are stored.
    moved = old.where("_op <> 'U' and is_dir")
    beside = moved.select("parent_id", "name_fold").unionByName(net.where("op = 'A' and is_dir").select("parent_id", C.fold(F.col("name")).alias("name_fold"))).distinct()
    twins = settled(stored.where("is_dir").join(beside, ["parent_id", "name_fold"], "left_semi").join(structural, "id", "left_anti").select(*COLUMNS, *INTERVALS))
    tops = settled(moved.select(own).unionByName(twins.select(own)))

    if tops.isEmpty():
        affected = stored.limit(0).select(BASE_COLUMNS)
    else:
        affected = tree.below(_within(stored, tops), tops).select(BASE_COLUMNS).unionByName(twins.select(BASE_COLUMNS)).distinct()
    affected = settled(affected)
    moving = settled(laid_over(affected, net))
    parents = moving.select(F.col("parent_id").alias("id")).distinct().join(moving.select("id"), "id", "left_anti").join(structural, "id", "left_anti")
    above = settled(stored.where("is_dir").join(parents, "id", "left_semi").select("id", *TREE_COLUMNS))
    placed = with_derived(tree.with_paths(moving, above))

    # Entries whose size or times alone have changed.
    stays = old.where("_op = 'U'").join(affected.select("id"), "id", "left_anti")
    values = net.select("id", *(F.col(c).alias(f"_{c}") for c in ("size", "mtime", "ctime")))
    updated = stays.join(values, "id").withColumns({c: F.coalesce(f"_{c}", c) for c in ("mtime", "ctime")} | {"size": F.when(F.col("is_dir"), 0).otherwise(F.coalesce("_size", "size")).cast("bigint")})
    changed = settled(placed.unionByName(updated.select(COLUMNS)))
    ids = settled(net.select("id").unionByName(affected.select("id")).distinct())
    replaced = settled(old.select("id", "is_dir").unionByName(affected.select("id", "is_dir")).distinct())
    return Delta(ids, replaced, changed.select(COLUMNS))
