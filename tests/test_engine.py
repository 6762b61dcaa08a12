"""The engine on small trees: searches, order, change logs, compaction, registered queries against SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from filelens import output, queries
from filelens.functions import columns as C
from filelens.operators import changes, tree
from filelens.operators.search import Index, cli_page, find_folder
from filelens.plans import parser
from filelens.plans.lower import register_predicate
from filelens.plans.nodes import QueryError
from filelens.schema import BASE
from tests.evaluator import matches

SMALL = [
    (0, -1, "/t/root", True, 0, 100, 0),
    (1, 0, "docs", True, 0, 100, 0),
    (2, 1, "IMG_0001.JPG", False, 1, 200, 150),
    (3, 1, "Readme.md", False, 5, 300, 0),
    (4, 0, "empty", True, 0, 100, 0),
    (5, 0, "src", True, 0, 100, 0),
    (6, 5, "main.go", False, 10, 400, 0),
    (7, 5, "main_test.go", False, 2000, 500, 0),
    (8, 5, "report_2024.PDF", False, 50000, 600, 0),
]

HOSTILE = [
    (0, -1, "/", True, 0, 0, 0),
    (1, 0, "Src", True, 0, 0, 0),
    (2, 0, "src", True, 0, 0, 0),
    (3, 1, "a.txt", False, 1, 1, 0),
    (4, 2, "b.txt", False, 1, 1, 0),
    (5, 0, ".bashrc", False, 1, 1, 0),
    (6, 0, "..foo", False, 1, 1, 0),
    (7, 0, "x.", False, 1, 1, 0),
    (8, 0, "100%_a\\b", False, 1, 1, 0),
    (9, 0, "É.é", False, 1, 1, 0),
    (10, 0, "line\nend\n", False, 1, 1, 0),
    (11, 0, "日本語.txt", False, 1, 1, 0),
    (12, 0, "\U0001f389 party", False, 1, 1, 0),
    (13, 0, 'say "hi", you', False, 1, 1, 0),
    (14, -1, "/src", True, 0, 0, 0),
    (15, 14, "b.txt", False, 1, 1, 0),
]


def entries(spark, rows):
    return tree.entries_of(spark.createDataFrame(rows, BASE)).cache()


@pytest.fixture(scope="module")
def small(spark):
    return Index(entries(spark, SMALL))


@pytest.fixture(scope="module")
def hostile(spark):
    return Index(entries(spark, HOSTILE))


def names(rows):
    return [r.name for r in rows.collect()]


@pytest.mark.parametrize(
    ("query", "found"),
    [
        ("main", "main.go main_test.go"),
        ("ww:main", "main.go main_test.go"),
        ("file: ww:test", "main_test.go"),
        ("*.go", "main.go main_test.go"),
        ("*_????.JPG", "IMG_0001.JPG"),
        ("ext:pdf;md", "Readme.md report_2024.PDF"),
        ("case:readme", ""),
        ("wfn:readme.md", "Readme.md"),
        (r"regex:_\d+\.pdf$", "report_2024.PDF"),
        ("size:>1kb", "main_test.go report_2024.PDF"),
        ("folder:", "/t/root docs empty src"),
        ("main !test", "main.go"),
        ("<readme|img> ext:md", "Readme.md"),
        ("nothing-like-this", ""),
        ("path:src/main", "main.go main_test.go"),
        ("len:<8", "/t/root docs empty src main.go"),
        ("infolder:/t/root/docs", "IMG_0001.JPG Readme.md"),
        ("parent:/T/ROOT/Docs/ file:", "IMG_0001.JPG Readme.md"),
        ("!infolder:/missing folder:", "/t/root docs empty src"),
        ("size:empty", "/t/root docs empty src"),
        ("dc:<1970-01-02 file:", "IMG_0001.JPG Readme.md main.go main_test.go report_2024.PDF"),
        ("depth:3", "docs empty src"),
        ("!", ""),
    ],
)
def test_small_tree(small, query, found):
    assert names(small.search(query, "path")) == found.split()


def test_bad_regex_fails(small):
    with pytest.raises(QueryError, match="invalid regex"):
        small.search("regex:(unclosed")


def test_order_and_pages(small):
    assert names(small.search("main", limit=1)) == ["main.go"]
    assert names(small.search("file:", "path", limit=1)) == ["IMG_0001.JPG"]
    assert names(small.search("file:", "path", True, limit=1)) == ["report_2024.PDF"]
    assert names(small.search("", "size", True, limit=2)) == ["report_2024.PDF", "main_test.go"]
    assert names(small.search("size:>=0", "rank", True, limit=2)) == ["/t/root", "docs"]
    full = names(small.search("", "name"))
    for n, offset, want in [(0, 0, full), (3, 2, full[2:5]), (-1, 4, full[4:]), (4, -1, full[:3]), (2, -5, [])]:
        assert names(cli_page(small.search("", "name"), n, offset)) == want
    assert small.count("main") == 2 and tuple(small.stats().first()) == (5, 4)
    plan = small.search("e", "size", limit=5)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_relevance_sums_over_terms(spark):
    rows = [(0, -1, "/r", True, 0, 0, 0), (1, 0, "ab-cd", False, 0, 0, 0), (2, 0, "abcd", False, 0, 0, 0), (3, 0, "ab.x", False, 0, 0, 0), (4, 0, "x_ab_cd", False, 0, 0, 0)]
    index = Index(entries(spark, rows))
    assert names(index.search("ab")) == ["ab.x", "ab-cd", "abcd", "x_ab_cd"]
    assert names(index.search("ab cd")) == ["ab-cd", "abcd", "x_ab_cd"]


def test_hostile_names(hostile):
    paths = {r.id: r.path for r in hostile.entries.collect()}
    assert paths[0] == "/" and paths[3] == "/Src/a.txt" and paths[15] == "/src/b.txt"
    got = {r.name: (r.ext_fold, r.stem_fold) for r in hostile.entries.where("parent_id = 0").collect()}
    assert got[".bashrc"] == ("", ".bashrc") and got["..foo"] == ("foo", ".") and got["x."] == ("", "x") and got["É.é"] == ("é", "É")
    assert names(hostile.hits("nowildcards:100%_a")) == ["100%_a\\b"]
    assert names(hostile.hits("*%_a\\b")) == ["100%_a\\b"]
    assert names(hostile.hits("É")) == ["É.é"] and names(hostile.hits("case:É")) == ["É.é"]
    assert names(hostile.hits("regex:e.end")) == ["line\nend\n"] and names(hostile.hits("regex:end$")) == []
    assert names(hostile.hits("wildcards:line?end?")) == ["line\nend\n"]
    assert names(hostile.hits("len:7 ext:txt")) == ["日本語.txt"]
    # the first of the twins has the name, without looking back; later roots are tried after
    assert find_folder(hostile.entries, "/SRC").id == 1 and find_folder(hostile.entries, "/").id == 0
    assert names(hostile.hits("infolder:/src")) == ["a.txt"]
    assert sorted(names(hostile.hits("infolder:/ ext:txt"))) == ["a.txt", "b.txt", "日本語.txt"]


def test_random_queries_match_plain_python(hostile, small):
    r = random.Random(7)
    words = ["a", "b.txt", "src", "*.txt", "?oo*", "ext:txt;md", "file:", "folder:", "size:>0", "size:1..5", "len:<6", "depth:1..2", "case:S", "path:src/", "ww:end", "wfn:SRC", "ww:test", "nowildcards:%", "path:*r*.?*", "É", "dm:>1970", "main", "dc:..1970-01-01"]

    def query(depth=0):
        if depth > 2 or r.random() < 0.5:
            return ("!" if r.random() < 0.2 else "") + r.choice(words)
        return "<" + r.choice([" ", " | "]).join(query(depth + 1) for _ in range(r.randint(1, 3))) + " >"

    for index in (hostile, small):
        rows = [x.asDict() for x in index.entries.collect()]
        texts = [query() for _ in range(60)]
        conditions = [index.condition(t, parser.Defaults(now=1)) for t in texts]
        got = index.entries.select("id", *(c.alias(f"c{k}") for k, c in enumerate(conditions))).collect()
        by_id = {x.id: x for x in got}
        for k, t in enumerate(texts):
            node = parser.parse(t, parser.Defaults(now=1))
            for x in rows:
                assert by_id[x["id"]][f"c{k}"] == matches(node, x), (t, x["name"])


def test_registered_predicate(small):
    register_predicate("even", lambda a: (F.col("size") % int(a)) == 0)
    assert names(small.search("file: even:1000", "path")) == ["main_test.go", "report_2024.PDF"]
    with pytest.raises(ValueError):
        register_predicate("size", lambda a: F.lit(True))


def test_paths_by_recursion_agree(spark, small):
    rows = spark.createDataFrame(SMALL, BASE)
    assert sorted(tree.rebuild_paths_sql(rows).collect()) == sorted(small.entries.select("id", "path", "tree_depth").collect())


# change logs


def log_of(spark, rows):
    return spark.createDataFrame(rows, changes.LOG_SCHEMA)


LOG = [
    (0, "A", 9, 0, 0, 1, 0, True, "new"),
    (1, "A", 10, 9, 7, 1, 0, False, "fresh.txt"),
    (2, "U", 6, None, 99, 9, 9, None, None),
    (3, "R", 1, None, None, None, None, None, None),
    (4, "U", 6, None, 98, 8, 8, None, None),
]


def test_apply_log_and_compaction(spark, small):
    base = spark.createDataFrame(SMALL, BASE)
    after = tree.entries_of(changes.apply_log(base, log_of(spark, LOG)))
    index = Index(after)
    assert names(index.search("", "path")) == ["/t/root", "empty", "new", "fresh.txt", "src", "main.go", "main_test.go", "report_2024.PDF"]
    assert names(index.hits("size:98")) == ["main.go"] and names(small.hits("size:98")) == []
    compacted = tree.entries_of(changes.compact(after))
    got = compacted.orderBy("id").collect()
    assert [x.id for x in got] == list(range(8)) and all(x.parent_id < x.id for x in got)
    assert [x.path for x in got] == [x.path for x in index.search("", "path").collect()]


def test_diff_replays_to_the_same_state(spark):
    before = spark.createDataFrame(SMALL, BASE)
    after = changes.apply_log(before, log_of(spark, LOG))
    replayed = changes.apply_log(before, changes.diff(before, after))
    assert sorted(replayed.collect()) == sorted(after.collect())


def test_orphans_go_with_their_folder(spark, small):
    left = tree.orphan_sweep(small.entries, spark.createDataFrame([(5,)], "id bigint"))
    assert sorted(x.id for x in left.collect()) == [0, 1, 2, 3, 4]
    assert tree.orphan_sweep(small.entries, spark.createDataFrame([(0,)], "id bigint")).count() == 0


def test_numbering_is_dense(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = sorted((r.n, r.x) for r in changes.numbered(rows, [F.col("x")], "n", 5).collect())
    assert got == [(k + 5, k) for k in range(1000)]
    assert changes.numbered(rows.limit(0), [F.col("x")], "n").count() == 0


def test_compaction_rule():
    assert not changes.compaction_due(9_999, 5) and changes.compaction_due(10_000, 5) and not changes.compaction_due(10_000, 2_000_000)


# output


def test_lines(small, hostile):
    rows = small.search("main|docs", "path")
    assert "".join(output.written(rows)) == "/t/root/docs\n/t/root/src/main.go\n/t/root/src/main_test.go\n"
    o = output.Lines(size=True, modified=True, created=True, name_only=True, null_separated=True, color=True)
    assert "".join(output.written(rows.limit(1), o)) == "    <DIR>  1970-01-01 00:01                    \x1b[1;34mdocs\x1b[0m\0"
    json_ = "".join(output.written(small.search("img"), output.Lines("json")))
    assert json_ == '[\n  {"path":"/t/root/docs/IMG_0001.JPG","name":"IMG_0001.JPG","type":"file","size":1,"modified":"1970-01-01T00:03:20Z","created":"1970-01-01T00:02:30Z"}\n]\n'
    assert "".join(output.written(small.search("nope"), output.Lines("json"))) == "[]\n"
    csv = "".join(output.written(hostile.search("say"), output.Lines("csv")))
    assert csv == 'path,name,type,size,modified,created\n"/say ""hi"", you","say ""hi"", you",file,1,1970-01-01T00:00:01Z,\n'


def test_human_sizes(spark):
    got = spark.createDataFrame([(0,), (1023,), (1536,), (5 << 30,)], "s bigint").select(C.human_size(F.col("s"), F.lit(False)).alias("t")).collect()
    assert [x.t for x in got] == ["      0 B", "   1023 B", "   1.5 KB", "   5.0 GB"]


# registered queries


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in "region nation customer orders events documents pages".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_agrees_with_sql(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(repr, want))
