"""The query language without Spark: trees, values, patterns, excludes, configuration."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from filelens.plans import nodes, parser, regex, values
from filelens.plans.nodes import HIGH, LOW, QueryError
from filelens.sources import config
from filelens.sources.excludes import Excludes, glob_match

NOW = 1710342000
DEFAULTS = parser.Defaults(now=NOW)


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("", "and()"),
        ("report", "sub:report"),
        ("foo bar", "and(sub:foo sub:bar)"),
        ("a b | c", "or(and(sub:a sub:b) sub:c)"),
        ("!draft", "not(sub:draft)"),
        ("<a|b> c", "and(or(sub:a sub:b) sub:c)"),
        ('path:"my dir"', "sub+path:my dir"),
        ("*.txt", "glob:*.txt"),
        (r"regex:^img_\d+", r"re:^img_\d+"),
        ("folder:case:src", "and(dir sub+case:src)"),
        ("file:", "file"),
        ("ext:pdf;.DOCX", "ext:pdf,docx"),
        ("size:>1kb", "size[1025,9223372036854775807]"),
        ("size:1kb..2kb", "size[1024,2048]"),
        ("size:<1kb", "size[-9223372036854775808,1023]"),
        ("len:>40", "len[41,9223372036854775807]"),
        ("depth:3", "depth[3,3]"),
        ("infolder:/tmp", "infolder:/tmp"),
        ("c:notafunction", "sub:c:notafunction"),
        # traps
        ("a |", "or(sub:a and())"),
        ("|a", "or(and() sub:a)"),
        ("!|a", "and(not(and()) sub:a)"),
        ("a !", "and(sub:a not(and()))"),
        ('"ext:pdf"', "ext:pdf"),
        ('"*.txt"', "glob:*.txt"),
        ("a > b", "and(sub:a sub:b)"),
        ("<a b", "and(sub:a sub:b)"),
        ("x<y", "and(sub:x sub:y)"),
        ("a!b", "sub:a!b"),
        ("case:", "and()"),
        ("file:folder:x", "and(dir sub:x)"),
        ("CASE:NoCase:Path:x", "sub+path:x"),
        ("nowildcards:a*", "sub:a*"),
        ("wildcards:abc", "glob:abc"),
        ("ww:wfn:x", "wfn:x"),
        ("ext:", "ext"),
        ("parents:2 parent:~/x", "and(depth[2,2] parent:~/x)"),
    ],
)
def test_trees(text, tree):
    assert str(parser.parse(text, DEFAULTS)) == tree


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("size:big", 'size: expected a size such as 10mb, got "big"'),
        ("dm:someday", 'dm: unknown date "someday"'),
        ("len:x", 'len: expected a number, got "x"'),
        ("size:big len:x", 'size: expected a size such as 10mb, got "big"'),
        ("dm:2024-1-2-3", "dm: expected a date such as 2024, 2024-03 or 2024-03-15"),
        ("dm:15-03-2024", 'dm: year must come first in "15-03-2024"'),
    ],
)
def test_errors(text, error):
    with pytest.raises(QueryError) as e:
        parser.parse(text, DEFAULTS)
    assert str(e.value) == error


def test_defaults():
    every = parser.Defaults(True, True, False, True, NOW)
    assert str(parser.parse("foo ext:txt", every)) == "and(re+case+path:foo ext:txt)"
    words = parser.Defaults(whole_word=True, now=NOW)
    assert str(parser.parse("a b*", words)) == "and(ww:a glob:b*)"
    assert str(nodes.restrict(parser.parse("a", DEFAULTS), "/x", True, False)) == "and(sub:a infolder:/x file)"
    assert nodes.restrict(parser.parse("a", DEFAULTS)) == parser.parse("a", DEFAULTS)


def test_plain_terms():
    assert nodes.plain_terms(parser.parse("Foo !bar path:x <*.y | ww:Zed > regex:q case:W", DEFAULTS)) == ["foo", "zed", "w"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='ab:<>|!" *?\t;.é1', max_size=30))
def test_any_text_parses_or_fails_with_a_query_error(text):
    try:
        str(parser.parse(text, DEFAULTS))
    except QueryError:
        pass


@pytest.mark.parametrize(
    ("text", "low", "high"),
    [
        ("today", 1710288000, 1710374399),
        ("yesterday", 1710201600, 1710287999),
        ("thisweek", 1710115200, 1710719999),
        ("lastweek", 1709510400, 1710115199),
        ("thismonth", 1709251200, 1711929599),
        ("lastmonth", 1706745600, 1709251199),
        ("lastyear", 1672531200, 1704067199),
        ("last7days", 1709737200, 1710342000),
        ("past1week", 1709737200, 1710342000),
        ("2023-11", 1698796800, 1701388799),
        ("2023/11/05", 1699142400, 1699228799),
        ("2023.13", 1704067200, 1706745599),
    ],
)
def test_dates(text, low, high):
    assert values.date(text, NOW) == (low, high)


def test_month_overflow_carries_over():
    march31 = 1711843200  # 2024-03-31
    assert values.date("last1month", march31)[0] == 1709337600  # 2024-03-02


@pytest.mark.parametrize(
    ("text", "out"),
    [
        ("1.5kb", (1536, 1536)),
        ("2 MB", (2 << 20, 2 << 20)),
        ("gigantic", ((128 << 20) + 1, HIGH)),
        ("empty", (0, 0)),
        ("7", (7, 7)),
        ("1pib", (1 << 50, 1 << 50)),
    ],
)
def test_sizes(text, out):
    assert values.size(text) == out


@pytest.mark.parametrize("text", ["3 parsecs", ".5kb", "1.kb", "", "kb", "1 2"])
def test_bad_sizes(text):
    with pytest.raises(QueryError):
        values.size(text)


@pytest.mark.parametrize(
    ("text", "out"),
    [(">=3", (3, HIGH)), ("<=3", (LOW, 3)), (">3", (4, HIGH)), ("<3", (LOW, 2)), ("=3", (3, 3)), ("1..5", (1, 5)), ("..5", (LOW, 5)), ("1..", (1, HIGH)), ("..", (LOW, HIGH)), (f">{HIGH}", (HIGH, HIGH))],
)
def test_ranges(text, out):
    assert values.ranged(text, values.number) == out
    assert values.ranged(">2023", values.date, NOW) == (1704067200, HIGH)


def test_sort_keys_and_durations():
    assert values.sort_key("Date-Modified") == "dm" and values.sort_key("rank") == "relevance"
    with pytest.raises(QueryError):
        values.sort_key("colour")
    assert values.duration("1m30s") == 90 and values.duration("500ms") == 0.5
    for bad in ("", "0s", "5", "-1s", "1x"):
        with pytest.raises(QueryError):
            values.duration(bad)
    assert values.seconds_of(-1) == -1


@pytest.mark.parametrize(
    ("pattern", "java"),
    [
        (r"^img_\d+$", r"^img_(?:[0-9])+\z"),
        (r"[\D]", "[0-9]"),
        (r"\W", r"[^a-zA-Z0-9_]"),
        ("[]a]", r"[\]a]"),
        ("[^]a]", r"[^\]a]"),
        ("a*?", "(?:(?:a)*)?"),
        ("[[:alpha:]-]", r"[a-zA-Z\-]"),
        (r"[a\.b]", r"[a\\.b]"),
        ("a{2,3}b{,4}c{5}", "(?:a){2,3}(?:b){0,4}(?:c){5}"),
        ("a)", r"a\)"),
        (r"[[:alpha:]\d]", r"[a-zA-Z\[0-9]\]"),
    ],
)
def test_regex_dialect(pattern, java):
    assert regex.to_java(pattern, True) == "(?s)" + java


@pytest.mark.parametrize("pattern", ["(unclosed", "[abc", "(?i)x", "*a", "a|*", r"x\ "[:2], "[b-a]", "[[:nope:]]", "a{3,2}"])
def test_bad_regex(pattern):
    with pytest.raises(QueryError) as e:
        regex.to_java(pattern, False)
    assert str(e.value).startswith(f'invalid regex "{pattern}": ')


def test_like():
    assert regex.to_like(r"a*b?c%d_e\f") == r"a%b_c\%d\_e\\f"


def test_globs():
    assert glob_match("**/.git", "/home/me/x/.git") and glob_match("/a/**/c", "/a/c") and glob_match("IMG_[0-9]???.JPG", "IMG_0001.JPG")
    assert not glob_match("*.c", "a/b.c") and glob_match("[!a]b", "cb") and not glob_match("[!a]b", "ab")


def test_excludes():
    x = Excludes.of(["node_modules", "/proc", "~/*/cache/", "**/.git"], home="/home/me")
    for path, out in [("/x/node_modules", True), ("/proc/1/status", True), ("/processes", False), ("/home/me/x/cache/a/b", True), ("/home/me/x/caches", False), ("/src/repo/.git/objects/ab", True)]:
        assert x.match(path, path.rpartition("/")[2]) is out, path
    with pytest.raises(ValueError):
        Excludes.of(["[abc"])


def test_config(tmp_path):
    c = config.parse("# x\n\nroot = ~/a\nexclude=*.tmp\n")
    assert c.roots[0].endswith("/a") and not c.roots[0].startswith("~") and c.excludes == ["*.tmp"]
    with pytest.raises(QueryError, match="f:2: unknown key"):
        config.parse("root = /\ncolour = red", "f")
    with pytest.raises(QueryError, match="f:1: expected key = value"):
        config.parse("root", "f")
    assert config.parse("") == config.default() == config.load(str(tmp_path / "none"))
    at = str(tmp_path / "d" / "config")
    assert config.write_default(at) and not config.write_default(at)
    assert config.load(at) == config.default()
    assert re.search("^root = ", config.render(config.default()), re.M)
