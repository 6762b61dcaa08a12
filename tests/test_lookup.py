"""Lookups by parent and name against the full table, with and without a log; what their plans read."""

import re

import pytest
from pyspark.sql import functions as F

from filelens.operators import tree
from filelens.operators.overlay import delta
from filelens.schema import BASE
from filelens.sources import lookup
from filelens.sources.catalog import Catalog
from filelens.storage import settled
from tests.test_overlay import forest

KEYS = "parent_id bigint, name string"


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows, log = forest(5, 12)
    entries = settled(tree.with_intervals(tree.entries_of(spark.createDataFrame(rows, BASE))))
    by_name = lookup.store(entries, str(tmp_path_factory.mktemp("lookup") / "it's here"), 8)
    return entries, by_name, log


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select(lookup.FOUND).collect())


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_every_entry_by_its_key(spark, stored, no_broadcast):
    entries, by_name, _ = stored
    twice = entries.select("parent_id", "name", F.lit(1).alias("id"), F.lit(2).alias("a.b"))
    assert rows_of(lookup.find(by_name, twice.unionByName(twice))) == rows_of(entries)


def test_after_a_log(spark, stored):
    entries, by_name, log = stored
    found = delta(entries, spark.createDataFrame(log, "seq bigint, op string, id bigint, parent_id bigint, size bigint, mtime bigint, ctime bigint, is_dir boolean, name string"))
    after = found.over(entries)
    keys = entries.select("parent_id", "name").unionByName(after.select("parent_id", "name"))
    want = rows_of(after)
    assert want != rows_of(entries)
    assert rows_of(lookup.find(by_name, keys, found)) == want
    some = after.where("id % 7 = 0").select("parent_id", "name")
    assert rows_of(lookup.find(by_name, some, found)) == rows_of(after.join(some.distinct(), ["parent_id", "name"], "left_semi"))


def test_no_key_null_keys_unknown_keys(spark, stored):
    _, by_name, _ = stored
    for keys in ([], [(None, "a"), (0, None)], [(0, "not there"), (10**12, "a")]):
        assert rows_of(lookup.find(by_name, spark.createDataFrame(keys, KEYS))) == []


def test_empty_table(spark, stored, tmp_path):
    entries, _, _ = stored
    empty = lookup.store(entries.limit(0), str(tmp_path / "none"), 8)
    assert rows_of(lookup.find(empty, entries.select("parent_id", "name"))) == []


def test_few_keys_open_their_buckets_only(spark, stored, no_broadcast):
    entries, by_name, _ = stored
    one = entries.select("parent_id", "name", "id", "is_dir").orderBy("id").limit(1)
    found = lookup.find(by_name, one)
    assert rows_of(found) == rows_of(entries.join(one.select("parent_id", "name"), ["parent_id", "name"], "left_semi"))
    assert "SelectedBucketsCount: 1 out of 8" in plan(found)


def test_buckets_are_left_out_of_plain_scans_too(spark, stored):
    """Beside a broadcast the scan isn't a bucketed one; it opens the same files."""
    _, by_name, _ = stored
    key = by_name.select("key").first().key
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))  # no two files in one partition
    try:
        tasks = lambda rows: rows._jdf.queryExecution().toRdd().getNumPartitions()
        assert (tasks(by_name.where(F.col("key") == key)), tasks(by_name)) == (1, 8)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_the_stored_side_has_no_exchange(spark, stored, no_broadcast):
    entries, by_name, _ = stored
    text = plan(lookup.find(by_name, settled(entries.select("parent_id", "name"))))
    assert "SortMergeJoin" in text or "ShuffledHashJoin" in text
    # from the scan of the stored table upwards to the join there is no exchange
    lines = text.splitlines()
    at = next(k for k, line in enumerate(lines) if "SelectedBucketsCount: 8 out of 8" in line)
    depth = lambda line: re.search(r"[A-Za-z*]", line).start()
    above, left = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if line.strip() and depth(line) < left:
            above.append(line)
            left = depth(line)
            if "Join" in line:
                break
    assert "Join" in above[-1]
    assert not any("Exchange" in line for line in above)


def test_hot_folder_is_spread(spark, stored, tmp_path):
    entries, _, _ = stored
    one = entries.where("is_dir").limit(1)
    wide = one.crossJoin(spark.range(4000).select(F.col("id").alias("k"))).withColumns({"name": F.concat(F.lit("f"), F.col("k")), "id": F.col("k"), "parent_id": F.lit(7).cast("bigint")})
    by_name = lookup.store(wide.drop("k"), str(tmp_path / "wide"), 8)
    sizes = [r["count"] for r in by_name.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 4000 / 8


def test_catalog_lookups_follow_the_log_and_compaction(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "index"))
    base = [(0, -1, "/r", True, 0, 1, 0), (1, 0, "d", True, 0, 1, 0), (2, 1, "f", False, 5, 1, 0), (3, 0, "g", False, 6, 1, 0)]
    snapshot = catalog.publish(tree.entries_of(spark.createDataFrame(base, BASE)), ["/r"])
    keys = spark.createDataFrame([(0, "d"), (1, "f"), (0, "g"), (0, "new")], KEYS)
    assert [r[2] for r in rows_of(catalog.lookup(snapshot, keys))] == [1, 3, 2]
    log = [(0, "R", 1, *[None] * 6), (1, "A", 4, 0, 7, 1, 0, False, "new")]
    after = catalog.append(snapshot, spark.createDataFrame(log, "seq bigint, op string, id bigint, parent_id bigint, size bigint, mtime bigint, ctime bigint, is_dir boolean, name string"))
    # what stood below the removed folder is gone with it
    for state in (after, catalog.load()):
        assert rows_of(catalog.lookup(state, keys)) == [(0, "g", 3, False), (0, "new", 4, False)]
    assert [r[2] for r in rows_of(catalog.lookup(snapshot, keys))] == [1, 3, 2]
    compacted = catalog.compact(after)
    assert sorted(r[1] for r in rows_of(catalog.lookup(compacted, compacted.entries.select("parent_id", "name")))) == ["/r", "g", "new"]
