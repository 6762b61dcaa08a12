"""Trees of parent ids: paths, depths, subtrees as intervals, orphans, children."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelens.functions.columns import join_path
from filelens.operators.numbering import numbered
from filelens.schema import BASE_COLUMNS, INTERVALS, ROOT_PARENT, TREE_COLUMNS, first_of_twins, with_derived
from filelens.storage import settled

#: Bits of a place below its block: intervals and rows meet by blocks of 2**BLOCK_BITS places.
BLOCK_BITS = 12


def with_paths(rows: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """Base rows with root_id, path, tree_depth and dir_primary; rows without a root above them are gone, cycles too.

    Only folders are followed upwards. Each holds a pointer to a folder further up and the path from there; in a round it
    takes over the pointer of the folder that it points to, so pointers double in length and a tree of depth d needs
    log2(d) rounds. What has reached its root drops out of the rounds; the rounds end when none is left, or none has got
    there in a round (only cycles do that). Files then take the path of their parent in one join.

    ``above``: (id, root_id, path, tree_depth, dir_primary) of folders outside ``rows`` that have their paths already.
    """
    folders = first_of_twins(rows.select(BASE_COLUMNS).where("is_dir"))
    top = F.col("parent_id") == ROOT_PARENT
    start = folders.select(
        *BASE_COLUMNS,
        F.when(~top, F.col("parent_id")).alias("up"),
        F.when(top, F.col("id")).alias("root_id"),
        F.col("name").alias("path"),
        F.when(top, 0).otherwise(1).alias("tree_depth"),
        (top | F.col("first")).alias("dir_primary"),
    )
    start = settled(start)
    known = ["id", "up", *TREE_COLUMNS]
    outside = [] if above is None else [above.select("id", F.lit(None).cast("bigint").alias("up"), *TREE_COLUMNS)]
    rooted, pending = [start.where("up is null")], start.where("up is not null")
    while True:
        state = reduce(DataFrame.unionByName, [x.select(known) for x in [*rooted, pending]] + outside)
        to = state.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("root_id").alias("_root"), F.col("path").alias("_path"), F.col("tree_depth").alias("_depth"), F.col("dir_primary").alias("_primary"))
        moved = pending.join(to, pending.up == to._id).select(
            *BASE_COLUMNS,
            F.col("_up").alias("up"),
            F.col("_root").alias("root_id"),
            join_path(F.col("_path"), F.col("path")).alias("path"),
            (F.col("_depth") + F.col("tree_depth")).alias("tree_depth"),
            (F.col("_primary") & F.col("dir_primary")).alias("dir_primary"),
        )
        moved = settled(moved)
        arrived, left = moved.agg(F.count_if(F.col("up").isNull()), F.count_if(F.col("up").isNotNull())).first()
        rooted.append(moved.where("up is null"))
        pending = moved.where("up is not null")
        if not arrived or not left:
            break
    found = reduce(DataFrame.unionByName, [x.select(*BASE_COLUMNS, *TREE_COLUMNS) for x in rooted])
    parents = reduce(DataFrame.unionByName, [found.select("id", *TREE_COLUMNS), *(x.drop("up") for x in outside)])
    up = parents.select(F.col("id").alias("_up"), "root_id", F.col("path").alias("_path"), (F.col("tree_depth") + 1).alias("tree_depth"))
    files = rows.select(BASE_COLUMNS).where("not is_dir")
    alone = files.where(top).select(*BASE_COLUMNS, F.col("id").alias("root_id"), F.col("name").alias("path"), F.lit(0).alias("tree_depth"), F.lit(False).alias("dir_primary"))
    below = files.where(~top).join(up, F.col("parent_id") == F.col("_up")).select(*BASE_COLUMNS, "root_id", join_path(F.col("_path"), F.col("name")).alias("path"), "tree_depth", F.lit(False).alias("dir_primary"))
    return found.unionByName(alone).unionByName(below)


def entries_of(rows: DataFrame) -> DataFrame:
    """The full table from base rows."""
    return with_derived(with_paths(rows))


def rebuild_paths_sql(rows: DataFrame) -> DataFrame:
    """(id, path, tree_depth) by one recursive query, for trees within Spark's recursion limits."""
    return rows.sparkSession.sql(
        f"""
        WITH RECURSIVE up(id, path, tree_depth) AS (
          SELECT id, name, 0 FROM {{rows}} WHERE parent_id = {ROOT_PARENT}
          UNION ALL
          SELECT r.id, concat(up.path, CASE WHEN endswith(up.path, '/') THEN '' ELSE '/' END, r.name), up.tree_depth + 1
          FROM up JOIN {{rows}} r ON r.parent_id = up.id)
        SELECT id, path, tree_depth FROM up""",
        rows=rows,
    )


def with_intervals(entries: DataFrame) -> DataFrame:
    """Adds each entry's ``place`` in the order of folded paths, and a folder's ``below_first`` and ``below_last``.

    A folder stands in that order twice: as itself and, further on, as its subtree, since names with characters before
    the slash come between. So each folder adds two marks to the order, where its subtree begins and where it ends; all
    are numbered together, and what is below a folder lies between its marks. Twins, whose paths fold alike, share an
    interval; who asks for the entries of one of them compares paths too.
    """
    bare = F.rtrim(F.col("path_fold"), F.lit("/"))
    mark = lambda end: F.struct(F.concat(bare, F.lit(end)).alias("key"), F.lit(0).alias("kind"))
    own = F.struct(F.col("path_fold").alias("key"), F.lit(1).alias("kind"))
    # "0" is the character after "/", so a mark with it comes after all that is below.
    keys = F.when(F.col("is_dir"), F.array(mark("/"), mark("0"), own)).otherwise(F.array(own))
    marks = numbered(entries.select("id", F.explode(keys).alias("m")), [F.col("m.key"), F.col("m.kind")], "n")
    end = F.when(F.col("m.kind") == 0, F.col("n"))
    found = marks.groupBy(F.col("id").alias("_id")).agg(F.max(F.when(F.col("m.kind") == 1, F.col("n"))).alias("place"), F.min(end).alias("below_first"), F.max(end).alias("below_last"))
    return entries.join(found, F.col("id") == F.col("_id")).select(*entries.columns, *INTERVALS)


def _blocks(folders: DataFrame) -> DataFrame:
    """The folders' intervals, a row for each block of places that they reach into."""
    first, last = (F.shiftright(c, BLOCK_BITS) for c in ("below_first", "below_last"))
    prefix = F.when(F.col("path").endswith("/"), F.col("path")).otherwise(F.concat("path", F.lit("/")))
    return folders.select(F.col("id").alias("_top"), F.col("root_id").alias("_root"), prefix.alias("_prefix"), F.col("below_first").alias("_first"), F.col("below_last").alias("_last"), F.explode(F.sequence(first, last)).alias("_block"))


def _in_interval() -> Column:
    inside = (F.shiftright("place", BLOCK_BITS) == F.col("_block")) & (F.col("place") > F.col("_first")) & (F.col("place") < F.col("_last"))
    return inside & (F.col("root_id") == F.col("_root")) & F.startswith("path", F.col("_prefix")) & (F.col("id") != F.col("_top"))


def below(entries: DataFrame, folders: DataFrame) -> DataFrame:
    """The entries, which have intervals, that stand below any of the folders (id, root_id, path, below_first, below_last)."""
    return entries.join(_blocks(folders), _in_interval(), "left_semi")


def orphan_sweep(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """``rows`` without those whose ids are removed and without all that stood below them; rows have paths.

    Places are compared with the intervals of the removed folders, by blocks of places; no path is taken apart. Rows
    without intervals (a table that isn't stored) get them first.
    """
    full = rows if set(INTERVALS) <= set(rows.columns) else with_intervals(rows)
    ids = removed.select(F.col("id").alias("_gone"))
    gone = full.where("is_dir").join(ids, F.col("id") == F.col("_gone"), "left_semi")
    left = full.join(_blocks(gone), _in_interval(), "left_anti").join(ids, F.col("id") == F.col("_gone"), "left_anti")
    return left.select(rows.columns)


def children_per_parent(rows: DataFrame) -> DataFrame:
    return rows.groupBy("parent_id").agg(F.count("*").alias("children"))
