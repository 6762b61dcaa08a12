"""Pages far down, pages after a cursor, totals that are observed beside a page."""

import json
import random

import pytest

from filelens import server
from filelens.operators import search, tree
from filelens.operators.search import Index
from filelens.plans import nodes, parser
from filelens.plans.nodes import QueryError
from filelens.schema import BASE
from filelens.sources.catalog import Snapshot


@pytest.fixture(scope="module")
def entries(spark):
    r = random.Random(3)
    rows = [(0, -1, "/t", True, 0, 0, 0)] + [(k, r.choice([0, 0, 1, 2, 3]) if k > 3 else 0, r.choice(["main", "Main", "main.go", "domain", "other"]) + str(k % 7), k < 4, 0 if k < 4 else k % 5, k % 3, k % 2) for k in range(1, 300)]
    return tree.entries_of(spark.createDataFrame(rows, BASE)).cache()


@pytest.mark.parametrize("sort,descending", [("relevance", False), ("name", True), ("size", True), ("size", False), ("ext", False), ("path", True), ("dm", False)])
def test_pages_after_cursors_are_the_whole_order(entries, sort, descending):
    index, node = Index(entries), parser.parse("main | other1")
    whole = [r.id for r in index.search(node, sort, descending).collect()]
    got, cursor = [], None
    while True:
        page = index.search_after(node, cursor, sort, descending, 61) if cursor else index.search(node, sort, descending, 61)
        rows = search.cursor_of(page, node, search.values.sort_key(sort), descending).collect()
        got += [r.id for r in rows]
        if len(rows) < 61:
            break
        cursor = tuple(rows[-1].cursor)
    assert got == whole


def test_a_cursor_bounds_the_scan(spark, entries, tmp_path):
    entries.write.parquet(str(tmp_path / "e"))
    index = Index(spark.read.parquet(str(tmp_path / "e")))
    page = index.search_after("", (3, "main", "main", 7), "size", limit=10)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(size,3)" in plan and "TakeOrderedAndProject(limit=10" in plan


@pytest.mark.parametrize("limit,offset", [(10, 0), (10, 95), (7, 290), (-1, 250), (5, 1000), (0, 3)])
def test_deep_pages_equal_plain_ones(entries, monkeypatch, limit, offset):
    index = Index(entries)
    plain = index.search("", "size", True, limit, offset).collect()
    monkeypatch.setattr(search, "DEEP", -1)
    deep = index.search("", "size", True, limit, offset)
    assert deep.collect() == plain
    assert "TakeOrderedAndProject" not in deep._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n,offset,want", [(0, 0, (-1, 0)), (5, 0, (5, 0)), (5, 3, (5, 3)), (5, -3, (2, 0)), (5, -9, (0, 0)), (-1, 4, (-1, 4)), (0, -4, (-1, 0))])
def test_limits_of_the_command_line(n, offset, want):
    assert search.cli_limits(n, offset) == want


@pytest.mark.parametrize("query", ["main", "", "ext:", "nothing-like-it", "main !main", "size:>3 file:"])
def test_total_and_page_come_from_one_scan(spark, entries, query):
    snapshot = Snapshot(entries)
    want = Index(entries).count(query)
    for limit, offset in ((3, 0), (2, 5), (4, 10_000), (-1, 0), (0, 0)):
        got = json.loads("{" + server.search(snapshot, {"query": query, "limit": limit, "offset": offset}) + "}")
        assert got["total"] == want
        assert len(got["results"]) == (max(0, want - offset) if limit < 0 else min(limit, max(0, want - offset)))


def test_one_job_per_socket_search(spark, entries):
    from pyspark.sql import DataFrame

    counted = []
    plain = DataFrame.count
    try:
        DataFrame.count = lambda self: counted.append(1) or plain(self)
        server.search(Snapshot(entries), {"query": "main", "limit": 5})
    finally:
        DataFrame.count = plain
    assert counted == []


def test_restrict_and_first_error():
    node = nodes.restrict(parser.parse("a"), "/x", True, False)
    assert str(node) == str(nodes.And((parser.parse("a"), nodes.Under("/x", True), nodes.Kind(False))))
    with pytest.raises(QueryError, match="^size: "):
        parser.parse("size:nonsense dm:alsononsense")
    with pytest.raises(QueryError, match="^dm: "):
        parser.parse("dm:alsononsense size:nonsense")
