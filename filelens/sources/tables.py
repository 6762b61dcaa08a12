"""Entries, texts and a change log made from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelens.operators import tree
from filelens.schema import BASE_COLUMNS, with_derived
from filelens.sources import lookup
from filelens.storage import own_folder, settled, write_entries

#: The time that relative dates count from in queries over these tables: 2001-07-15 00:00 UTC.
NOW = 995155200


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_tree_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rows of the order tree: a root, regions, nations, customers, and a file for each order."""
    t = lambda name: _table(spark, sf_dir, name)
    big = lambda c: F.col(c).cast("bigint")
    folder = lambda rows, id_, parent, name: rows.select(id_.alias("id"), parent.alias("parent_id"), name.alias("name"), F.lit(True).alias("is_dir"), *(F.lit(0).cast("bigint").alias(c) for c in ("size", "mtime", "ctime")))
    root = folder(spark.range(1), F.lit(0).cast("bigint"), F.lit(-1).cast("bigint"), F.lit("/data"))
    regions = folder(t("region"), 1 + big("r_regionkey"), F.lit(0).cast("bigint"), F.col("r_name"))
    nations = folder(t("nation"), 1000 + big("n_nationkey"), 1 + big("n_regionkey"), F.col("n_name"))
    customers = folder(t("customer"), 10_000 + big("c_custkey"), 1000 + big("c_nationkey"), F.col("c_name"))
    ext = F.when(F.col("o_orderstatus") == "F", ".pdf").when(F.col("o_orderstatus") == "O", ".PDF").otherwise("")
    seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    orders = t("orders").select(
        (10_000_000 + big("o_orderkey")).alias("id"),
        (10_000 + big("o_custkey")).alias("parent_id"),
        F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"), F.lit("_"), F.col("o_orderpriority"), ext).alias("name"),
        F.lit(False).alias("is_dir"),
        F.floor(F.col("o_totalprice") * 100).cast("bigint").alias("size"),
        seconds.alias("mtime"),
        F.when(F.col("o_orderkey") % 7 == 0, 0).otherwise(seconds - 86_400 * (F.col("o_orderkey") % 30)).cast("bigint").alias("ctime"),
    )
    return root.unionByName(regions).unionByName(nations).unionByName(customers).unionByName(orders).select(BASE_COLUMNS)


def build_order_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full table of the order tree, computed."""
    return tree.entries_of(order_tree_rows(spark, sf_dir))


#: Stored indexes of this process: (application, sf_dir) -> the table.
_built: dict[tuple[str, str], DataFrame] = {}


def order_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order tree as a stored index, built when it is first asked for: Parquet in path order in the shared folder.

    That is how the engine works: an index is built once, with paths and folded columns, and searches scan it with
    pruned columns and pushed-down ranges.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        at = f"{own_folder(spark)}/order-tree-{uuid.uuid4().hex}"
        write_entries(tree.with_intervals(settled(build_order_tree(spark, sf_dir))), at)
        _built[key] = spark.read.parquet(at)
    return _built[key]


def order_tree_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookup table of the order tree, stored when it is first asked for."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}/by_name")
    if key not in _built:
        rows = order_tree(spark, sf_dir)
        _built[key] = lookup.store(rows, f"{own_folder(spark)}/by-name-{uuid.uuid4().hex}", lookup.buckets_for(rows.count()))
    return _built[key]


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as names, for predicates on text alone."""
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(-1).cast("bigint").alias("parent_id"), F.col("text").alias("name"))
    rows = d.withColumns({"is_dir": F.lit(False), "size": F.lit(0).cast("bigint"), "mtime": F.lit(0).cast("bigint"), "ctime": F.lit(0).cast("bigint"), "root_id": F.col("id"), "path": F.col("name"), "tree_depth": F.lit(0), "dir_primary": F.lit(False)})
    return with_derived(rows)


def web_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files whose paths are their addresses below /web."""
    path = F.concat(F.lit("/web/"), F.regexp_replace("url", "^[a-z]+://", ""))
    p = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit(-1).cast("bigint").alias("parent_id"), F.substring_index(path, "/", -1).alias("name"), path.alias("path"))
    rows = p.withColumns({"is_dir": F.lit(False), "size": F.lit(0).cast("bigint"), "mtime": F.lit(0).cast("bigint"), "ctime": F.lit(0).cast("bigint"), "root_id": F.col("id"), "tree_depth": F.lit(0), "dir_primary": F.lit(False)})
    return with_derived(rows)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change log whose ids are users: a signup adds, an error removes, anything else updates."""
    return as_log(_table(spark, sf_dir, "events"))


def as_log(events: DataFrame) -> DataFrame:
    """The same for any frame of events, a stream too."""
    return events.select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "signup", "A").when(F.col("event_type") == "error", "R").otherwise("U").alias("op"),
        F.col("user_id").alias("id"),
        F.floor(F.col("value") * 100).cast("bigint").alias("size"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("mtime"),
    )
