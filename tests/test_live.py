"""Scans of any shape, reconciling on the executors, event logs, bursts, micro batches that are given again."""

import inspect
import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from filelens.operators import changes
from filelens.sources import config, events, filesystem
from filelens.sources.catalog import Catalog
from filelens.sources.excludes import Excludes
from filelens.streaming import live

NONE = Excludes.of([])


@pytest.fixture
def root(tmp_path):
    at = tmp_path / "files" / "top"
    for k in range(6):
        (at / f"d{k}").mkdir(parents=True)
        (at / f"d{k}" / f"f{k}.txt").write_text("x" * k)
    return at


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "index"))


def on_disk(root):
    """What the root holds, by the standard library."""
    out = {str(root)}
    for at, folders, files in os.walk(root):
        out |= {os.path.join(at, x) for x in folders + files}
    return out


def paths(snapshot):
    return sorted(r.path for r in snapshot.entries.collect())


# scans


def test_scan_of_a_flat_folder_a_chain_and_a_bush(spark, tmp_path):
    """Each shape in rounds of a few entries: all tasks get some of it, and nothing is lost or found twice."""
    top = tmp_path / "scan"
    (top / "one" / "flat").mkdir(parents=True)
    for k in range(300):
        (top / "one" / "flat" / f"f{k}").write_text("")
    deep = top / "one"
    for k in range(60):
        deep = deep / f"c{k}"
    deep.mkdir(parents=True)
    for k in range(40):
        (top / "one" / "bush" / f"b{k % 7}" / f"c{k}").mkdir(parents=True)
    (top / "one" / "bush" / "skipped" / "x").mkdir(parents=True)
    (top / "link").symlink_to(top / "one")
    want = {p for p in on_disk(top) if "/skipped" not in p}
    start = spark.createDataFrame([(str(top), os.fsencode(str(top)), filesystem.LOOK, str(top), "")], "root string, at binary, kind int, name string, parent string")
    for budget in (7, 50, 100_000):
        got = filesystem.expand(start, Excludes.of(["skipped"]), budget).collect()
        assert sorted(r.path for r in got) == sorted(want)
        assert all(r.parent == (os.path.dirname(r.path) if r.path != str(top) else "") for r in got)
    assert {r.path: (r.is_dir, r.size) for r in got}[str(top / "link")][0] is False


def test_a_round_leaves_what_its_budget_does_not_cover(spark, tmp_path):
    top = tmp_path / "wide"
    top.mkdir()
    for k in range(50):
        (top / f"f{k}").write_text("")
    step = filesystem._Round(NONE, 10)
    rows = list(step._rows(iter([(str(top), os.fsencode(str(top)), filesystem.ENTER, None, None)])))
    kinds = [r[-1] for r in rows]
    assert kinds.count(filesystem.FOUND) == 10 and kinds.count(filesystem.LOOK) == 40


def test_names_that_are_not_utf8_are_walked(spark, tmp_path):
    top = os.fsencode(str(tmp_path)) + b"/raw"
    os.makedirs(top + b"/bad\xff/in")
    got = {r.path for r in filesystem.scan(spark, [str(tmp_path / "raw")], []).collect()}
    assert got == {str(tmp_path / "raw"), str(tmp_path / "raw/bad�"), str(tmp_path / "raw/bad�/in")}


# reconciling


def test_a_batch_of_all_kinds_equals_the_disk(catalog, root):
    s = catalog.build(config.Config([str(root)], ["never"]))
    assert paths(s) == sorted(on_disk(root))
    (root / "new/a/b").mkdir(parents=True)
    (root / "new/a/b/leaf").write_text("1")
    (root / "new/never").mkdir()
    (root / "d0/f0.txt").unlink()
    shutil.rmtree(root / "d1")
    shutil.rmtree(root / "d2")
    (root / "d2").write_text("now a file")
    (root / "d3/f3.txt").unlink()
    (root / "d3/f3.txt/below").mkdir(parents=True)
    (root / "d4/f4.txt").write_text("longer than before")
    (root / "d5/unseen").write_text("")
    told = ["new/a/b/leaf", "new/a", "new/never", "d0/f0.txt", "d1/f1.txt", "d1", "d2", "d2/f2.txt", "d3/f3.txt/below", "d4/f4.txt", "d5", "nowhere/at/all"]
    s = live.apply_events(catalog, s, [(str(root / p), False) for p in told] + [("/outside", True), (str(root / "d4/../d4/f4.txt"), False)], Excludes.of(["never"]))
    want = {p for p in on_disk(root) if "/never" not in p and not p.endswith("unseen")}
    assert paths(s) == sorted(want) and s.hits("f4.txt").first().size == 18
    assert len({r.id for r in s.entries.collect()}) == len(want)
    s = live.apply_events(catalog, s, [(str(root / "d5"), True)], Excludes.of(["never"]))
    assert paths(s) == sorted(want | {str(root / "d5/unseen")})
    shutil.rmtree(root)
    s = live.apply_events(catalog, s, [(str(root), False)], NONE)
    assert paths(s) == []
    (root / "again").mkdir(parents=True)
    s = live.apply_events(catalog, s, [(str(root / "again"), False)], NONE)
    assert paths(s) == sorted(on_disk(root))


def test_a_hundred_thousand_events_in_one_batch(spark, catalog, root):
    s = catalog.build(config.Config([str(root)]))
    for k in range(300):
        (root / f"d{k % 6}" / f"late{k}").write_text("")
    told = spark.range(100_000).select(F.concat(F.lit(f"{root}/d"), (F.col("id") % 6).cast("string"), F.lit("/late"), (F.col("id") % 50_000).cast("string")).alias("path"), F.lit(False).alias("rescan"))
    s = live.apply_events(catalog, s, told, NONE)
    assert paths(s) == sorted(on_disk(root))


def test_no_path_passes_through_the_driver():
    source = inspect.getsource(live)
    assert ".collect(" not in source and "toLocalIterator" not in source and "broadcast" not in source


# micro batches that are given again


def given_again(checkpoint):
    """The last micro batch counts as not committed, as after a failure between the work and the commit."""
    commits = [p for p in (checkpoint / "commits").iterdir() if p.name.isdigit()]
    last = max(commits, key=lambda p: int(p.name))
    for p in (last, checkpoint / "commits" / f".{last.name}.crc"):
        if p.exists():
            p.unlink()


def test_a_replayed_batch_of_changes_leaves_the_log_as_it_was(spark, catalog, root, tmp_path):
    s = catalog.build(config.Config([str(root)]))
    top = s.entries.where("parent_id = -1").first().id
    log = tmp_path / "log"
    once = {"availableNow": True}
    stream = lambda: live.apply_stream(catalog, spark.readStream.schema(changes.LOG_SCHEMA).parquet(str(log)), str(tmp_path / "cp"), once).awaitTermination()
    spark.createDataFrame([(0, "A", 900, top, 1, 1, 0, False, "streamed")], changes.LOG_SCHEMA).write.parquet(str(log))
    stream()
    s = catalog.load()
    assert s.batches == 1 and s.count("streamed") == 1
    s = catalog.append(s, spark.createDataFrame([(0, "R", 900, *[None] * 6)], changes.LOG_SCHEMA))
    given_again(tmp_path / "cp")
    stream()
    s = catalog.load()
    assert s.batches == 2 and s.count("streamed") == 0  # the removal in between stands
    compacted = catalog.compact(s)
    given_again(tmp_path / "cp")
    stream()
    assert catalog.load().generation == compacted.generation and catalog.load().batches == 0  # known over a compaction too
    spark.createDataFrame([(0, "A", 901, compacted.entries.where("parent_id = -1").first().id, 1, 1, 0, False, "next")], changes.LOG_SCHEMA).write.mode("append").parquet(str(log))
    stream()
    assert catalog.load().batches == 1 and catalog.load().count("next") == 1
    rebuilt = catalog.build(config.Config([str(root)]))
    assert rebuilt.applied == {str(tmp_path / "cp"): 1}


# event logs


def test_event_log_replays_from_its_checkpoint(spark, tmp_path):
    spark.dataSource.register(events.EventSource)
    log = events.EventLog(str(tmp_path / "events"))
    seen = []

    def run():
        stream = spark.readStream.format("fileevents").load(str(tmp_path / "events"))
        keep = lambda rows, number: seen.append((number, sorted(map(tuple, rows.collect()))))
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    assert log.append([("/a", False), ("/b", True)]) == 0 and log.append([("/c", False)]) == 1
    run()
    assert [x for _, rows in seen for x in rows] == [("/a", False), ("/b", True), ("/c", False)]
    first = list(seen)
    given_again(tmp_path / "cp")
    log.append([("/d", False)])
    seen.clear()
    run()
    assert seen == first[-1:]  # the same batch again, without the later segment
    run()
    assert [x for _, rows in seen[1:] for x in rows] == [("/d", False)]


def test_bursts_come_out_once_and_long_ones_at_last(spark, tmp_path):
    spark.dataSource.register(events.EventSource)
    log = events.EventLog(str(tmp_path / "events"))
    seen = []
    stream = events.settle(spark.readStream.format("fileevents").load(str(tmp_path / "events")), quiet=1500, longest=6000)
    keep = lambda rows, _: seen.extend((r.path, r.rescan, time.monotonic()) for r in rows.collect())
    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="100 milliseconds").start()
    try:
        log.append([("/burst", False), ("/burst", True), ("/burst", False), ("/other", False)])
        began = time.monotonic()
        while time.monotonic() < began + 60 and not {"/busy", "/burst", "/other"} <= {p for p, _, _ in seen}:
            log.append([("/busy", False)])  # never quiet
            time.sleep(0.3)
        assert sorted((p, r) for p, r, _ in seen if p != "/busy") == [("/burst", True), ("/other", False)]
        assert any(p == "/busy" for p, _, _ in seen)
    finally:
        query.stop()


def test_events_to_index(spark, catalog, root, tmp_path):
    spark.dataSource.register(events.EventSource)
    catalog.build(config.Config([str(root)]))
    log = events.EventLog(str(tmp_path / "events"))
    (root / "d0/late").write_text("x")
    log.append([(str(root / "d0/late"), False)] * 3)
    stream = spark.readStream.format("fileevents").load(str(tmp_path / "events"))
    run = lambda: live.follow(catalog, stream, NONE, str(tmp_path / "cp"), {"availableNow": True}).awaitTermination()
    run()
    given_again(tmp_path / "cp")
    run()
    s = catalog.load()
    assert paths(s) == sorted(on_disk(root)) and s.batches == 1
