"""Entries by parent and name: a bucketed table beside a stored index.

It has a row per entry, dealt to buckets by a hash of parent and name together, so a folder that holds a third of all
entries is spread over all buckets. Keys that are looked up are dealt likewise and meet the buckets where they lie: the
stored side is never exchanged. Up to ``MOST_KEYS`` keys are handed to the scan as values, and it opens their buckets only.

Buckets need a table in the session's catalog. It is an external one, named after its folder, so dropping it leaves the
files, and any session makes it anew from the folder and the number of buckets.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filelens.operators.overlay import Delta

#: Entries of a bucket, at which a bucket's file has some tens of megabytes, and the fewest buckets.
BUCKET_ROWS = 2_000_000
FEWEST_BUCKETS = 8
#: Spark's own limit, ``spark.sql.sources.bucketing.maxBuckets``.
MOST_BUCKETS = 100_000
#: Up to so many keys select buckets by value.
MOST_KEYS = 64

FOUND = ["parent_id", "name", "id", "is_dir"]
_SCHEMA = "key BIGINT, parent_id BIGINT, name STRING, id BIGINT, is_dir BOOLEAN"


def buckets_for(rows: int) -> int:
    return min(max(math.ceil(rows / BUCKET_ROWS), FEWEST_BUCKETS), MOST_BUCKETS)


def _key() -> Column:
    return F.xxhash64("parent_id", "name").alias("key")


def _name(at: str) -> str:
    return "by_name_" + hashlib.sha256(at.encode()).hexdigest()[:32]


def store(entries: DataFrame, at: str, buckets: int) -> DataFrame:
    """Writes the lookup table of ``entries`` to the folder ``at``, a file per bucket, and opens it."""
    rows = entries.select(_key(), *FOUND).repartition(buckets, "key")
    rows.write.format("parquet").bucketBy(buckets, "key").sortBy("key").option("path", at).saveAsTable(_name(at))
    return opened(entries.sparkSession, at, buckets)


def opened(spark: SparkSession, at: str, buckets: int) -> DataFrame:
    """The lookup table in the folder ``at``."""
    place = at.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_name(at)} ({_SCHEMA}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{place}'")
    return spark.table(_name(at))


def find(stored: DataFrame, keys: DataFrame, delta: Delta | None = None) -> DataFrame:
    """(parent_id, name, id, is_dir) of the entries at the keys (parent_id, name), after the changes of ``delta`` if given.

    Names are compared as they are, without folding. Entries that share parent and name are all given; a key that repeats
    counts once, and one that is null or that no entry has gives nothing. Further columns of ``keys`` are left out.
    """
    wanted = keys.select("parent_id", "name").dropna().distinct().select("*", _key())
    few = [row.key for row in wanted.select("key").limit(MOST_KEYS + 1).collect()]
    if len(few) <= MOST_KEYS:
        stored = stored.where(F.col("key").isin(few))
    found = _at_keys(stored, wanted)
    if delta is None:
        return found
    changed = _at_keys(delta.changed.select(_key(), *FOUND), wanted)
    return found.join(delta.ids, "id", "left_anti").select(FOUND).unionByName(changed)


def _at_keys(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    asked = wanted.select(F.col("key").alias("_key"), F.col("parent_id").alias("_parent"), F.col("name").alias("_name"))
    # Hashes may collide, so parent and name are compared too: as ranges, since equality would make them keys of the join,
    # and buckets are dealt by the hash alone.
    same = F.col("parent_id").between(F.col("_parent"), F.col("_parent")) & F.col("name").between(F.col("_name"), F.col("_name"))
    return rows.join(asked, (F.col("key") == F.col("_key")) & same).select(FOUND)
