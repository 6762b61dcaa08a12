"""Sources and what keeps them current: file trees, binary files, catalog, live updates, streams, server, command line."""

import json
import os
import socket
import struct
import time

import pytest

from filelens import cli, server
from filelens.operators import changes
from filelens.plans.nodes import QueryError
from filelens.schema import BASE
from filelens.sources import binary, config, filesystem
from filelens.sources.catalog import Catalog, Replaced
from filelens.sources.excludes import Excludes
from filelens.streaming import live
from tests.test_engine import LOG, SMALL

EXCLUDES = ["node_modules"]


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "files" / "top"
    for path, size in [("src/main.go", 10), ("src/main_test.go", 2000), ("src/report_2024.PDF", 50000), ("docs/Readme.md", 5), ("docs/IMG_0001.JPG", 1), ("node_modules/dep/index.js", 1)]:
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"x" * size)
    (root / "empty").mkdir()
    return root


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "index"))


def names(snapshot, query, sort="path"):
    return [r.name for r in snapshot.search(query, sort).collect()]


def test_build_and_search(catalog, tree):
    with pytest.raises(FileNotFoundError):
        catalog.load()
    s = catalog.load_or_build(config.Config([str(tree), str(tree / "gone")], EXCLUDES))
    assert tuple(s.stats().first()) == (5, 4)
    assert names(s, "ext:pdf;md") == ["Readme.md", "report_2024.PDF"] and names(s, "index.js") == []
    assert names(s, f"infolder:{tree}/docs") == ["IMG_0001.JPG", "Readme.md"]
    ids = [(r.id, r.parent_id) for r in s.entries.orderBy("id").collect()]
    assert [i for i, _ in ids] == list(range(9)) and all(p < i for i, p in ids)
    assert catalog.load_or_build(config.Config(["/nowhere"])).generation == s.generation
    with pytest.raises(FileNotFoundError):
        filesystem.scan(catalog.spark, ["/nowhere"], [])


def test_overlapping_roots_are_two_entries(catalog, tree):
    s = catalog.build(config.Config([str(tree), str(tree / "docs")], EXCLUDES))
    assert names(s, "readme") == ["Readme.md", "Readme.md"] and len({r.root_id for r in s.hits("readme").collect()}) == 2


def test_live_updates(catalog, tree):
    x = Excludes.of(EXCLUDES)
    first = catalog.build(config.Config([str(tree)], EXCLUDES))
    (tree / "new/deep").mkdir(parents=True)
    (tree / "new/deep/fresh.txt").write_text("hi")
    (tree / "src/main.go").write_bytes(b"y" * 99)
    for f in (tree / "docs").iterdir():
        f.unlink()
    (tree / "docs").rmdir()
    s = live.apply_events(catalog, first, [(str(tree / p), False) for p in ("new/deep/fresh.txt", "src/main.go", "docs")], x)
    assert names(s, "fresh") == ["fresh.txt"] and names(s, "size:99") == ["main.go"] and names(s, "readme") == []
    assert names(first, "size:99") == [] and names(first, "readme") == ["Readme.md"]  # an open snapshot stays
    assert live.apply_events(catalog, s, [(str(tree / "src/main.go"), False)], x) is s
    (tree / "src/unreported.c").write_text("")
    assert names(live.apply_events(catalog, s, [(str(tree / "src"), False)], x), "unreported") == []
    s = live.apply_events(catalog, s, [(str(tree / "src"), True)], x)
    assert names(s, "unreported") == ["unreported.c"] and names(s, "main") == ["main.go", "main_test.go"]
    with pytest.raises(Replaced):
        catalog.append(first, changes.diff(first.entries, first.entries))
    before = names(s, "")
    compacted = catalog.compact(s)
    assert compacted.generation > s.generation and compacted.batches == 0 and names(compacted, "") == before
    with pytest.raises(Replaced):
        live.apply_events(catalog, s, [(str(tree / "empty"), True)], x)


def test_added_deleted_and_added_again(catalog, tree):
    x = Excludes.of(EXCLUDES)
    s = catalog.build(config.Config([str(tree)], EXCLUDES))
    path = tree / "back.txt"
    for content in ("one", None, "three", None, "fifth"):
        path.write_text(content) if content else path.unlink()
        s = live.apply_events(catalog, s, [(str(path), False)], x)
        assert names(s, "back") == (["back.txt"] if content else [])
    assert s.batches == 5 and names(s, "size:5 back") == ["back.txt"] and names(catalog.compact(s), "back") == ["back.txt"]


def test_rescan_appends_differences_only(catalog, tree):
    first = catalog.build(config.Config([str(tree)], EXCLUDES))
    assert live.rescan(catalog, first, EXCLUDES) is first and catalog.load().batches == 0
    (tree / "src/main.go").write_bytes(b"y" * 99)
    (tree / "new/deep").mkdir(parents=True)
    (tree / "new/deep/fresh.txt").write_text("hi")
    (tree / "docs/Readme.md").unlink()
    (tree / "docs/Readme.md").mkdir()
    (tree / "docs/Readme.md/child.txt").write_text("c")
    s = live.rescan(catalog, first, EXCLUDES)
    assert names(s, "size:99") == ["main.go"] and names(s, "fresh") == ["fresh.txt"] and names(s, "folder: readme") == ["Readme.md"] and names(s, "child") == ["child.txt"]
    kept = {r.path: r.id for r in first.entries.collect()}
    assert all(r.id == kept[r.path] for r in s.entries.collect() if r.path in kept and r.name != "Readme.md")
    assert live.rescan(catalog, s, EXCLUDES) is s and s.batches == 1
    rebuilt = catalog.build(config.Config([str(tree)], EXCLUDES))
    show = lambda x: sorted((r.path, r.is_dir, r.size, r.mtime, r.tree_depth) for r in x.entries.collect())
    assert show(rebuilt) == show(s)


def test_one_of_two_writers_of_a_batch_is_told(catalog, tree):
    s = catalog.build(config.Config([str(tree)], EXCLUDES))
    log = changes.diff(s.entries.where("name <> 'empty'"), s.entries)
    catalog._batches = lambda generation: 0  # both writers looked before either wrote
    catalog.append(s, log)
    with pytest.raises(Replaced):
        catalog.append(s, log)
    del catalog._batches
    assert catalog.load().batches == 1


def test_file_becomes_folder(catalog, tree):
    s = catalog.build(config.Config([str(tree)], EXCLUDES))
    (tree / "docs/Readme.md").unlink()
    (tree / "docs/Readme.md").mkdir()
    (tree / "docs/Readme.md/child.txt").write_text("c")
    s = live.apply_events(catalog, s, [(str(tree / "docs/Readme.md/child.txt"), False)], Excludes.of(EXCLUDES))
    assert names(s, "folder: readme") == ["Readme.md"] and names(s, "child") == ["child.txt"]
    assert names(catalog.compact(s), "") == names(s, "")


def test_streams(spark, catalog, tree, tmp_path):
    catalog.build(config.Config([str(tree)], EXCLUDES))
    events = tmp_path / "events"
    (tree / "late.txt").write_text("x")
    spark.createDataFrame([(str(tree / "late.txt"), False), (str(tree / "late.txt"), False)], "path string, rescan boolean").write.json(str(events))
    stream = spark.readStream.schema("path string, rescan boolean").json(str(events))
    live.follow(catalog, stream, Excludes.of(EXCLUDES), str(tmp_path / "cp1"), {"availableNow": True}).awaitTermination()
    s = catalog.load()
    assert names(s, "late") == ["late.txt"] and s.batches == 1
    key = s.hits("late").first().id
    log = tmp_path / "log"
    spark.createDataFrame([(0, "U", key, None, 77, 77, 77, None, None)], changes.LOG_SCHEMA).write.parquet(str(log))
    live.apply_stream(catalog, spark.readStream.schema(changes.LOG_SCHEMA).parquet(str(log)), str(tmp_path / "cp2"), {"availableNow": True}).awaitTermination()
    assert names(catalog.load(), "size:77") == ["late.txt"]


# binary files

MAGIC = b"TEST"


def test_index_file(spark, tmp_path):
    order = sorted(SMALL, key=lambda r: r[0])
    data = binary.encode(order, ["/t/root"], 5, 1234, MAGIC)
    f = binary.decode(data, MAGIC)
    assert list(f.rows()) == order and f.generation == 5 and f.built_at == 1234 and f.roots == ["/t/root"]
    assert f.names == sorted({r[2] for r in SMALL}, key=lambda n: (n.lower(), n))
    at = tmp_path / "index.bin"
    at.write_bytes(data)
    spark.dataSource.register(binary.IndexFileSource)
    assert sorted(map(tuple, spark.read.format("indexfile").load(str(at)).collect())) == order
    for bad in (data[:100], data[:4] + b"\1\0\0\0" + data[8:], data[:40] + struct.pack("<Q", 1 << 40) + data[48:]):
        with pytest.raises(binary.CorruptIndex):
            binary.decode(bad, MAGIC)
    with pytest.raises(binary.CorruptIndex):
        binary.decode(data, b"ELSE")
    assert list(binary.decode(binary.encode([], [], 1, 1, MAGIC), MAGIC).rows()) == []


def test_journal():
    data = binary.journal_bytes(LOG, 5, MAGIC)
    got, size = binary.journal_entries(data, 5, 9, MAGIC)
    assert got == LOG and size == len(data)
    assert binary.journal_entries(data + b"A\3", 5, 9, MAGIC) == (LOG, len(data))
    assert binary.journal_entries(data, 6, 9, MAGIC) == ([], 0)
    with pytest.raises(binary.CorruptIndex):
        binary.journal_entries(binary.journal_bytes([(0, "R", 40, *[None] * 6)], 5, MAGIC), 5, 9, MAGIC)


# server and command line


class Client:
    def __init__(self, path):
        self.s = socket.socket(socket.AF_UNIX, socket.SOCK_STREAM)
        self.s.connect(path)
        self.f = self.s.makefile("r")

    def ask(self, text):
        self.s.sendall(text.encode() + b"\n")
        return self.f.readline()


def test_server(spark, catalog, tree, tmp_path):
    s = catalog.build(config.Config([str(tree)], EXCLUDES))
    path = f"/tmp/filelens-test-{os.getpid()}.sock"
    srv = server.Server(s, path, "here")
    try:
        with pytest.raises(RuntimeError):
            server.Server(s, path)
        c = Client(path)
        got = json.loads(c.ask('{"id":"a","query":"main","limit":1}'))
        assert got["id"] == "a" and got["total"] == 2 and [r["name"] for r in got["results"]] == ["main.go"]
        assert c.ask('{"id":7.50,"op":"status"}').startswith('{"id":7.50,"files":5,"folders":4,"roots":["')
        assert json.loads(c.ask('{"query":"size:big"}'))["error"].startswith("size: expected a size")
        got = json.loads(c.ask('{"query":"file:","limit":0}'))
        assert got["total"] == 5 and got["results"] == []
        got = json.loads(c.ask('{"query":"","files":true,"sort":"size","descending":true,"offset":1.9,"limit":-1}'))
        assert [r["size"] for r in got["results"]] == [2000, 10, 5, 1]
        assert "error" in json.loads(c.ask("[1]")) and "unknown op" in json.loads(c.ask('{"op":"dance"}'))["error"]
        assert "error" in json.loads(c.ask('{"sort":"colour"}'))
        assert json.loads(server.handle('{"id":1,"query":"x"}', lambda: s, "", lambda: True)) == {"id": 1, "cancelled": True}
    finally:
        srv.stop()
    assert not server.running(path)


def test_cli(spark, tree, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    cfg = tmp_path / "config"
    cfg.write_text(f"root = {tree}\nexclude = node_modules\n")
    places = ["--config", str(cfg), "--index", str(tmp_path / "idx"), "--socket", str(tmp_path / "s.sock")]

    def run(*args):
        out = []
        return cli.main([*args, *places], out.append), "".join(out)

    assert run("status")[1].endswith("not built yet\n")
    assert run("index")[1].startswith("indexed 5 files and 4 folders in ")
    assert run("main", "!test", "--name-only") == (0, "main.go\n")
    assert run("--count", "-n", "1", "file:") == (0, "5\n")
    assert run("search", "ext:go", "-s", "size", "-d", "-n", "1", "--name-only") == (0, "main_test.go\n")
    assert run("-.x", "--name-only") == (0, "") and run("--no-such")[0] == 2
    assert run("size:big")[0] == 1
    assert run("file:", "--path", str(tree / "docs"), "--json")[1].count('"type":"file"') == 2
    assert "server:  not running" in run("status")[1]
    assert run("config")[1].endswith("exclude = node_modules\n")
    assert run("version")[1].startswith("filelens ") and run("help")[0] == 0
    (tree / "added.txt").write_text("")
    o = cli.arguments().parse_args(["--save-interval", "10ms", *places])
    began = time.monotonic()
    assert cli._serve(o, print, server=False, rounds=1) == 0 and time.monotonic() > began
    assert run("added", "--name-only") == (0, "added.txt\n")
    with pytest.raises(QueryError):
        config.parse("x = y")


def test_base_schema_has_no_nulls():
    assert not any(f.nullable for f in BASE)
