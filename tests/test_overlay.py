"""Logs over stored tables against plain replays and full rebuilds; intervals, long chains, numbering."""

import random

import pytest
from pyspark.sql import functions as F

from filelens.operators import changes, tree
from filelens.operators.overlay import overlay
from filelens.schema import BASE, COLUMNS
from filelens.storage import settled

NAMES = ["a", "A", "b", "B", "a-b", "a.txt", "a0", "Z", "é"]
WIDTH = 1000


def random_tree(r, first, n=30):
    """A root and entries below it, folders more often than files, names that fold alike among them."""
    rows, folders = [(first, -1, f"/t{first}", True, 0, 1, 0)], [first]
    for k in range(first + 1, first + n):
        folder = r.random() < 0.6
        rows.append((k, r.choice(folders), r.choice(NAMES), folder, 0 if folder else r.randrange(50), r.randrange(50), 0))
        folders += [k] * folder
    return rows


def random_log(r, first, n=30, changes=25):
    """Adds of new and of used ids (files and folders, moved below anything, cycles too), removals, updates."""
    out = []
    for _ in range(changes):
        op = r.choice("AARRU")
        key = first + r.randrange(n + 8)
        if op == "A":
            folder = r.random() < 0.6
            out.append((op, key, first + r.randrange(n + 8) if r.random() < 0.95 else -1, r.randrange(9), 5, 6, folder, r.choice(NAMES)))
        elif op == "R":
            out.append((op, key, *[None] * 6))
        else:
            out.append((op, key, None, 100 + r.randrange(9), 7, 8, None, None))
    return out


def replay(rows, log):
    """The plain meaning: one change after the other."""
    live = {x[0]: list(x) for x in rows}
    for _, op, key, parent, size, mtime, ctime, folder, name in log:
        if op == "A":
            live[key] = [key, parent, name, folder, size, mtime, ctime]
        elif op == "R":
            live.pop(key, None)
        elif key in live:
            live[key][4:] = [size, mtime, ctime]
    return [tuple(x) for x in live.values()]


def forest(seed, trees):
    r = random.Random(seed)
    rows = [x for k in range(trees) for x in random_tree(r, k * WIDTH)]
    logs = [c for k in range(trees) for c in random_log(r, k * WIDTH)]
    return rows, [(seq, *c) for seq, c in enumerate(logs)]


def test_net_changes_equal_a_plain_replay(spark):
    rows, log = forest(1, 150)
    got = changes.apply_log(spark.createDataFrame(rows, BASE), spark.createDataFrame(log, changes.LOG_SCHEMA))
    assert sorted(map(tuple, got.collect())) == sorted(replay(rows, log))


def test_an_old_update_is_not_laid_over_a_later_add(spark):
    base = spark.createDataFrame([(1, -1, "/t", True, 0, 1, 0), (2, 1, "x", False, 10, 1, 0)], BASE)
    log = [(0, "U", 2, None, 99, 9, 9, None, None), (1, "R", 2, *[None] * 6), (2, "A", 2, 1, 5, 1, 0, False, "x")]
    got = changes.apply_log(base, spark.createDataFrame(log, changes.LOG_SCHEMA))
    assert {r.id: r.size for r in got.collect()} == {1: 0, 2: 5}


@pytest.mark.parametrize("seed", [2, 3])
def test_overlay_equals_a_rebuild(spark, seed):
    """A hundred trees with a random log each, at once."""
    rows, log = forest(seed, 100)
    stored = settled(tree.with_intervals(tree.entries_of(spark.createDataFrame(rows, BASE))))
    got = overlay(stored, spark.createDataFrame(log, changes.LOG_SCHEMA))
    want = tree.entries_of(spark.createDataFrame(replay(rows, log), BASE))
    assert got.columns == COLUMNS
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(COLUMNS).collect()))


def test_overlay_of_nothing_and_of_all(spark):
    rows = random_tree(random.Random(4), 0)
    stored = settled(tree.with_intervals(tree.entries_of(spark.createDataFrame(rows, BASE))))
    log = lambda x: spark.createDataFrame(x, changes.LOG_SCHEMA)
    assert sorted(map(repr, overlay(stored, log([])).collect())) == sorted(map(repr, stored.select(COLUMNS).collect()))
    assert overlay(stored, log([(0, "R", 0, *[None] * 6)])).count() == 0
    fresh = overlay(stored.limit(0), log([(0, "A", 7, -1, 0, 1, 0, True, "/new"), (1, "A", 8, 7, 3, 1, 0, False, "f")]))
    assert sorted(r.path for r in fresh.collect()) == ["/new", "/new/f"]


def test_filters_still_reach_the_stored_table(spark):
    rows = random_tree(random.Random(5), 0)
    stored = settled(tree.with_intervals(tree.entries_of(spark.createDataFrame(rows, BASE))))
    after = overlay(stored, spark.createDataFrame([(0, "U", 3, None, 1, 1, 1, None, None)], changes.LOG_SCHEMA))
    plan = after.where("size >= 40").select("id", "size")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(size,40)" in plan and "SortMergeJoin" not in plan


def test_below_by_intervals(spark):
    rows = [x for k in range(20) for x in random_tree(random.Random(k), k * WIDTH)] + [(900_000, -1, "/", True, 0, 1, 0), (900_001, 900_000, "in", True, 0, 1, 0), (900_002, 900_001, "x", False, 0, 1, 0)]
    full = settled(tree.with_intervals(tree.entries_of(spark.createDataFrame(rows, BASE))))
    data = full.collect()
    assert sorted(r.place for r in data) == sorted({r.place for r in data})
    for seed in range(3):
        tops = random.Random(seed).sample([r for r in data if r.is_dir], 5)
        tops += [r for r in data if r.id == 900_000] * seed
        want = {r.id for r in data for t in tops if r.id != t.id and r.root_id == t.root_id and r.path.startswith(t.path.rstrip("/") + "/")}
        chosen = full.join(spark.createDataFrame([(t.id,) for t in tops], "id bigint").distinct(), "id", "left_semi")
        assert {r.id for r in tree.below(full, chosen).collect()} == want
        left = {r.id for r in tree.orphan_sweep(full, chosen.select("id")).collect()}
        assert left == {r.id for r in data} - want - {t.id for t in tops}


def test_a_chain_of_4000_folders_takes_12_rounds(spark, monkeypatch):
    rounds = []
    count = tree.settled
    monkeypatch.setattr(tree, "settled", lambda rows: rounds.append(1) or count(rows))
    rows = [(k, k - 1, "/r" if k == 0 else f"d{k % 10}", True, 0, 1, 0) for k in range(4000)] + [(5000, 3999, "leaf", False, 1, 1, 0), (6000, 6001, "loop", True, 0, 1, 0), (6001, 6000, "loop", True, 0, 1, 0), (7000, 7777, "orphan", True, 0, 1, 0)]
    got = {r.id: r for r in tree.with_paths(spark.createDataFrame(rows, BASE)).collect()}
    assert len(rounds) - 1 <= 13 and set(got) == {*range(4000), 5000}
    assert got[5000].tree_depth == 4000 and got[5000].path.startswith("/r/d1/d2") and got[5000].path.count("/") == 4001
    assert all(got[k].tree_depth == k for k in range(4000))


def test_numbering_has_one_exchange_and_no_window(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("x"))
    got = changes.numbered(rows, [F.col("x")], "n", 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange hashpartitioning" not in plan
    assert all(r.n == r.x + 3 for r in got.collect())


def test_shared_folder_of_a_cluster_must_be_set():
    from types import SimpleNamespace

    from filelens.storage import shared_folder

    session = lambda master, at: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: at), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    assert shared_folder(session("spark://x", "/shared")) == "/shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session("spark://x", None))
