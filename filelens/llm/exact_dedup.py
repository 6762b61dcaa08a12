"""Exact dedup: tree-merge of sorted digest runs, in DataFrame operations only.

Every input partition is a run of records (digest, smallest id, count). The runs belong to 2**bits nodes, one partition
each. In a binomial round each node sends its run, divided by ``RADIX_BITS`` bits of the digest, to the partners whose
numbers differ from its own in these bits only, and merges the parts that its partners send: records are dealt by node
number, sorted by digest and folded into one record per digest, in the partition where they arrive. The rounds are the
only exchanges. After the last one a node holds all that remains of its part of the digest space, one record per digest.
A digest that a third of the rows share is dealt in the first round to as many nodes as there are groups of partners, is
one record in each from then on, and never gathers in one task. (Spark sorts what a node receives once more; it doesn't
keep the order of the runs.)

A record is matched on SHA-256, byte length and XXH64 together; that check is made again at every level, and two texts
count as equal only if all three agree.

Edge cases: a null text is the empty text. A null id never wins over a non-null one; a group with null ids only has a
null ``keep_id`` and its rows are kept. Rows that repeat both id and text share one verdict (``group_size`` counts each);
``drop_copies`` keeps the one of them whose text as it stands has the smallest SHA-256. An empty table gives an empty
result. Other columns are ignored and may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filelens.llm._common import cut, met, table, without

#: Bits of the node number that a round settles: a node merges the runs of 2**2 partners, itself among them.
RADIX_BITS = 2

#: Whitespace that counts as one space.
SPACES = r"[\x20\x09-\x0D]+"

RUN_KEY = ["sha", "n_bytes", "mark"]


def normalised(text: Column) -> Column:
    """Each whitespace run as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sha, n_bytes, mark) of each row."""
    text = normalised(F.col(text_col))
    return docs.select(F.col(id_col).alias("id"), text.alias("t")).select("id", F.unhex(F.sha2("t", 256)).alias("sha"), F.octet_length("t").alias("n_bytes"), F.xxhash64("t").alias("mark"))


def tree_merge(runs: DataFrame, nodes: int | None = None) -> DataFrame:
    """(sha, n_bytes, mark, keep, n): the smallest id and the count of each digest, merged in binomial rounds.

    ``runs`` has (id, sha, n_bytes, mark). ``nodes``: runs at the leaves, by default the number of shuffle partitions,
    rounded up to a power of two.
    """
    nodes = nodes or int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1, math.ceil(math.log2(max(2, nodes))))
    merged = (F.min("keep").alias("keep"), F.sum("n").alias("n"))
    leaf = F.spark_partition_id().bitwiseAND((1 << bits) - 1).alias("node")
    keep = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id")).alias("keep")
    level = runs.select(leaf, *RUN_KEY, keep, F.lit(1).cast("bigint").alias("n"))
    shard = F.xxhash64("sha")
    for low in range(0, bits, RADIX_BITS):
        mask = ((1 << min(RADIX_BITS, bits - low)) - 1) << low
        partner = F.col("node").bitwiseAND(((1 << bits) - 1) & ~mask).bitwiseOR(shard.bitwiseAND(F.lit(mask).cast("bigint")).cast("int"))
        level = level.withColumn("node", partner).repartitionById(1 << bits, F.col("node")).groupBy("node", *RUN_KEY).agg(*merged)
    return level.select(*RUN_KEY, F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", nodes: int | None = None) -> DataFrame:
    """One row per input row: (doc_id, keep_id, group_size, kept, text_sha256).

    The texts are read once: their digests are written to the shared folder, then merged and joined from there.
    """
    own = cut(digests(docs, id_col, text_col))
    merged = tree_merge(own, nodes)
    return met(own, merged, RUN_KEY).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", nodes: int | None = None) -> DataFrame:
    """``docs`` without the later copies; all columns stay. Of rows that repeat id and text one stays."""
    verdict = exact_dedup(docs, id_col, text_col, nodes).groupBy(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_digest")).agg(F.count("*").alias("n"), F.max("kept").alias("stays"))
    return without(docs, cut(verdict.where("n > 1 or not stays")), id_col, text_col, F.unhex(F.sha2(normalised(F.col(text_col)), 256)))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
