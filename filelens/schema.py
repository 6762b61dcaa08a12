"""The one table of the engine: an entry per file or folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filelens.functions import columns as C

#: No parent.
ROOT_PARENT = -1

#: What a scan or a change log gives for each entry; no column is ever null.
BASE = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("parent_id", T.LongType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("is_dir", T.BooleanType(), False),
        T.StructField("size", T.LongType(), False),
        T.StructField("mtime", T.LongType(), False),
        T.StructField("ctime", T.LongType(), False),
    ]
)

BASE_COLUMNS = BASE.names
TREE_COLUMNS = ["root_id", "path", "tree_depth", "dir_primary"]
DERIVED_COLUMNS = ["name_fold", "path_fold", "ext_fold", "stem_fold", "name_len", "slash_depth"]
COLUMNS = BASE_COLUMNS + TREE_COLUMNS + DERIVED_COLUMNS
#: Further columns of a stored table: the place in path order, and between which places the subtree of a folder lies.
INTERVALS = ["place", "below_first", "below_last"]


def with_derived(rows: DataFrame) -> DataFrame:
    """Adds the columns that queries read but no source stores: folded names, extension, stem, lengths. Folders have size 0."""
    folded = rows.withColumns({"size": F.when(F.col("is_dir"), F.lit(0).cast("bigint")).otherwise(F.col("size")), "name_fold": C.fold(F.col("name")), "path_fold": C.fold(F.col("path"))})
    return folded.withColumns(
        {"ext_fold": C.extension(F.col("name_fold")), "stem_fold": C.stem(F.col("name_fold")), "name_len": F.length("name"), "slash_depth": C.slash_depth(F.col("path"))}
    ).select(COLUMNS)


def first_of_twins(rows: DataFrame) -> DataFrame:
    """Adds ``first``: whether a folder is the one with the smallest id among sibling folders whose names fold alike."""
    twins = Window.partitionBy("parent_id", C.fold(F.col("name")), "is_dir")
    return rows.withColumn("first", F.col("is_dir") & (F.col("id") == F.min("id").over(twins)))
