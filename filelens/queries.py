"""The engine's registered queries over the driver's tables, each with its SQL.

A search query is a line of the query language; its twin is the condition in SQL over the same entries.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filelens.functions import columns as C
from filelens.operators import changes, search, tree
from filelens.operators.search import Index
from filelens.plans import nodes, parser, regex
from filelens.sources import tables
from filelens.storage import own_folder

Query = Callable[[SparkSession, str], DataFrame]

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The order tree in SQL, with the derived columns.
ENTRIES = f"""
WITH base AS (
  SELECT 0::BIGINT AS id, (-1)::BIGINT AS parent_id, '/data' AS name, true AS is_dir, 0::BIGINT AS size, 0::BIGINT AS mtime, 0::BIGINT AS ctime, '/data' AS path, 0 AS tree_depth
  UNION ALL SELECT 1 + r_regionkey, 0, r_name, true, 0, 0, 0, '/data/' || r_name, 1 FROM region
  UNION ALL SELECT 1000 + n_nationkey, 1 + n_regionkey, n_name, true, 0, 0, 0, '/data/' || r_name || '/' || n_name, 2 FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 10000 + c_custkey, 1000 + c_nationkey, c_name, true, 0, 0, 0, '/data/' || r_name || '/' || n_name || '/' || c_name, 3
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 10000000 + o_orderkey, 10000 + o_custkey, f, false, floor(o_totalprice * 100)::BIGINT, s, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE s - 86400 * (o_orderkey % 30) END,
      '/data/' || r_name || '/' || n_name || '/' || c_name || '/' || f, 4
    FROM (SELECT *, 'order_' || o_orderkey || '_' || o_orderpriority || CASE o_orderstatus WHEN 'F' THEN '.pdf' WHEN 'O' THEN '.PDF' ELSE '' END AS f, floor(epoch(o_orderdate))::BIGINT AS s FROM orders)
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
folded AS (SELECT *, {_FOLD.format("name")} AS name_fold, {_FOLD.format("path")} AS path_fold, length(name) AS name_len, length(path) - length(replace(path, '/', '')) AS slash_depth FROM base),
dotted AS (SELECT *, CASE WHEN strpos(name_fold, '.') > 0 THEN length(name_fold) - strpos(reverse(name_fold), '.') + 1 ELSE 0 END AS dot FROM folded),
entries AS (SELECT *, CASE WHEN dot > 1 THEN substr(name_fold, dot + 1) ELSE '' END AS ext_fold, CASE WHEN dot > 1 THEN substr(name_fold, 1, dot - 1) ELSE name_fold END AS stem_fold FROM dotted)
"""

TEXTS = f"WITH entries AS (SELECT doc_id AS id, text AS name, {_FOLD.format('text')} AS name_fold FROM documents)\n"
PAGES = f"""
WITH base AS (SELECT page_id AS id, '/web/' || regexp_replace(url, '^[a-z]+://', '') AS path FROM pages),
entries AS (SELECT *, {_FOLD.format("path")} AS path_fold, length(rtrim(path, '/')) - length(replace(rtrim(path, '/'), '/', '')) AS slash_depth FROM base)
"""

_NAME = "name_fold, name, id"
_SHOWN = "id, path, size, mtime, ctime"


@dataclass(frozen=True)
class Search:
    """A query text, the SQL of its condition, and how its page is cut. Without a limit the result is the set of ids."""

    text: str
    where: str
    sort: str = "name"
    descending: bool = False
    limit: int = -1
    offset: int = 0
    order: str = ""
    source: str = "tree"
    defaults: parser.Defaults = parser.Defaults(now=tables.NOW)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        index = Index({"tree": tables.order_tree, "texts": tables.texts, "pages": tables.web_paths}[self.source](spark, sf_dir))
        if self.limit < 0:
            return index.hits(self.text, self.defaults).select("id", *(["path"] if self.source != "texts" else []))
        return index.search(self.text, self.sort, self.descending, self.limit, self.offset, self.defaults).select(_SHOWN.split(", "))

    def sql(self) -> str:
        head = {"tree": ENTRIES, "texts": TEXTS, "pages": PAGES}[self.source]
        if self.limit < 0:
            return f"{head}SELECT id{', path' if self.source != 'texts' else ''} FROM entries WHERE {self.where}"
        return f"{head}SELECT {_SHOWN} FROM entries WHERE {self.where} ORDER BY {self.order} LIMIT {self.limit} OFFSET {self.offset}"


def _desc(keys: str) -> str:
    return ", ".join(f"{k} DESC" for k in keys.split(", "))


def _score(*terms: str) -> str:
    one = "(CASE WHEN name_fold = '{t}' OR stem_fold = '{t}' THEN 4 WHEN starts_with(name_fold, '{t}') THEN 3 WHEN regexp_matches(name_fold, '(^|[^a-z0-9]){t}') THEN 2 WHEN contains(name_fold, '{t}') THEN 1 ELSE 0 END)"
    return " + ".join(one.format(t=t) for t in terms)


_SQL_LIKE = lambda pattern: regex.to_like(pattern).replace("'", "''")

SEARCHES: dict[str, Search] = {
    # text
    "substr_fold": Search("URGENT", "contains(name_fold, 'urgent')"),
    "substr_case": Search("case:.PDF", "contains(name, '.PDF')"),
    "substr_path": Search("path:ASIA/nation_1", "contains(path_fold, 'asia/nation_1')"),
    "wild_suffix": Search("*.pdf", "name_fold LIKE '%.pdf'"),
    "wild_prefix": Search("customer*", "name_fold LIKE 'customer%'"),
    "wild_contains": Search("*_1-*", f"name_fold LIKE '{_SQL_LIKE('*_1-*')}' ESCAPE '\\'"),
    "wild_general": Search("order_1?3*_?-h*.pdf", f"name_fold LIKE '{_SQL_LIKE('order_1?3*_?-h*.pdf')}' ESCAPE '\\'"),
    "wild_path_crosses_slash": Search("path:/data/a*/order_*9_*", f"path_fold LIKE '{_SQL_LIKE('/data/a*/order_*9_*')}' ESCAPE '\\'"),
    "wild_question_in_paths": Search("path:*/th*?page=*", "path_fold LIKE '%/th%_page=%'", source="pages"),
    "nowildcards": Search("path:nowildcards:?", "contains(path, '?')", source="pages"),
    "wildcards_forced": Search("wildcards:/data", "name_fold LIKE '/data'"),
    "regex_digits": Search(r"regex:^order_\d+_[1-3]-.*\.pdf$", r"regexp_matches(name_fold, '^order_[0-9]+_[1-3]-.*\.pdf$')"),
    "regex_case": Search(r"case:regex:\.PDF$", r"regexp_matches(name, '\.PDF$')"),
    "regex_classes": Search(r"regex:^[[:upper:]#]+\s?\w*0[05]$", "regexp_matches(name_fold, '^[a-z#]+\\s?[a-z0-9_]*0[05]$')"),
    "regex_path": Search(r'path:regex:"/e[a-z]+/nation_([38]|1.)$"', r"regexp_matches(path_fold, '/e[a-z]+/nation_([38]|1.)$')"),
    "regex_dot_newline": Search(r"regex:the.and", r"regexp_matches(name_fold, 'the.and', 's')", source="texts"),
    "ww": Search("ww:urgent", "regexp_matches(name_fold, '(^|[^a-z0-9])urgent([^a-z0-9]|$)')"),
    "ww_underscore": Search("ww:order", "regexp_matches(name_fold, '(^|[^a-z0-9])order([^a-z0-9]|$)')"),
    "ww_unicode_docs": Search("ww:que", r"regexp_matches(name_fold, '(^|[^a-z0-9\x{80}-\x{10FFFF}])que([^a-z0-9\x{80}-\x{10FFFF}]|$)')", source="texts"),
    "wfn": Search("wfn:asia", "name_fold = 'asia'"),
    "fold_ascii_only": Search("É", "contains(name, 'É')", source="texts"),
    "quoted": Search('"MIDDLE EAST"', "contains(name_fold, 'middle east')"),
    "unknown_key_is_text": Search("c:nothing | customer", "contains(name_fold, 'customer')"),
    "default_regex": Search(r"^[am].*a$", "regexp_matches(name_fold, '^[am].*a$')", defaults=parser.Defaults(regex=True, now=tables.NOW)),
    "default_case": Search("Nation_1 | NATION_2", "contains(name, 'NATION_2')", defaults=parser.Defaults(cased=True, now=tables.NOW)),
    "default_whole_word": Search("high", "regexp_matches(name_fold, '(^|[^a-z0-9])high([^a-z0-9]|$)')", defaults=parser.Defaults(whole_word=True, now=tables.NOW)),
    "nocase": Search("nocase:ASIA", "contains(name_fold, 'asia')", defaults=parser.Defaults(cased=True, now=tables.NOW)),
    "nopath": Search("nopath:africa", "contains(name_fold, 'africa')", defaults=parser.Defaults(on_path=True, now=tables.NOW)),
    "default_path": Search("africa", "contains(path_fold, 'africa')", defaults=parser.Defaults(on_path=True, now=tables.NOW)),
    # ranges
    "size_gt": Search("size:>20mb", "size >= 20971521"),
    "size_named": Search("size:huge", "size BETWEEN 16777217 AND 134217728"),
    "size_between": Search("size:1.5mb..3mb", "size BETWEEN 1572864 AND 3145728"),
    "size_empty_has_folders": Search("size:empty", "size = 0"),
    "dm_year": Search("dm:1997", "mtime BETWEEN 852076800 AND 883612799"),
    "dm_month_range": Search("dm:1996-02..1996-04", "mtime BETWEEN 823132800 AND 830908799"),
    "dm_relative": Search("dm:last90days", "mtime BETWEEN 987379200 AND 995155200"),
    "dm_today": Search("dm:today", "mtime BETWEEN 995155200 AND 995241599"),
    "dm_yesterday": Search("dm:yesterday", "mtime BETWEEN 995068800 AND 995155199"),
    "dm_thisweek": Search("dm:thisweek", "mtime BETWEEN 994636800 AND 995241599"),
    "dm_lastmonth": Search("dm:lastmonth", "mtime BETWEEN 991353600 AND 993945599"),
    "dm_thisyear": Search("dm:thisyear", "mtime BETWEEN 978307200 AND 1009843199"),
    "dm_lastyear": Search("dm:lastyear", "mtime BETWEEN 946684800 AND 978307199"),
    "dm_day": Search("dm:1998-03-05", "mtime BETWEEN 889056000 AND 889142399"),
    "dc_lt_includes_unknown": Search("dc:<1996 file:", "ctime <= 820454399 AND NOT is_dir"),
    "len_gt": Search("len:>22", "name_len >= 23"),
    "depth_eq": Search("depth:3", "slash_depth = 3"),
    "depth_pages": Search("depth:>=4", "slash_depth >= 4", source="pages"),
    # structure
    "ext_list": Search("ext:pdf;.doc", "ext_fold IN ('pdf', 'doc')"),
    "ext_empty": Search("ext:", "false"),
    "files_only": Search("file:", "NOT is_dir"),
    "dirs_only": Search("folder:", "is_dir"),
    "kind_with_text": Search("folder:case:A", "is_dir AND contains(name, 'A')"),
    "parent_of": Search("parent:/data/ASIA", "parent_id = (SELECT id FROM entries WHERE path = '/data/ASIA')"),
    "infolder": Search("infolder:/DATA/asia/ file:", "starts_with(path, '/data/ASIA/') AND NOT is_dir"),
    "infolder_missing_not": Search("!infolder:/nowhere folder:", "is_dir"),
    # boolean
    "and_or_not": Search("order <urgent|low> !ext:pdf", "contains(name_fold, 'order') AND (contains(name_fold, 'urgent') OR contains(name_fold, 'low')) AND NOT ext_fold = 'pdf'"),
    "group": Search("<asia|<europe|africa>> folder:", "is_dir AND (contains(name_fold, 'asia') OR contains(name_fold, 'europe') OR contains(name_fold, 'africa'))"),
    "trailing_or_matches_all": Search("urgent |", "true"),
    "not_end_matches_none": Search("urgent !", "false"),
    "match_all": Search("", "true"),
    "stray_close": Search("urgent > ext:pdf", "contains(name_fold, 'urgent') AND ext_fold = 'pdf'"),
    # order and pages
    "sort_path": Search("file:", "NOT is_dir", "path", limit=50, order=f"path_fold, {_NAME}"),
    "sort_path_desc": Search("file:", "NOT is_dir", "path", True, 50, order=_desc(f"path_fold, {_NAME}")),
    "sort_name": Search("ext:pdf", "ext_fold = 'pdf'", "name", limit=50, order=_NAME),
    "sort_size_desc": Search("ext:pdf size:>10mb", "ext_fold = 'pdf' AND size >= 10485761", "size", True, 20, order=_desc(f"size, {_NAME}")),
    "sort_dm": Search("", "true", "dm", limit=50, order=f"mtime, {_NAME}"),
    "sort_dc": Search("file:", "NOT is_dir", "created", True, 50, order=_desc(f"ctime, {_NAME}")),
    "sort_ext": Search("", "true", "extension", True, 50, order=_desc(f"ext_fold, {_NAME}")),
    "rank_single": Search("nation_2", "contains(name_fold, 'nation_2')", "relevance", limit=20, order=f"{_score('nation_2')} DESC, tree_depth, name_fold, id"),
    "rank_multi": Search("order 1 low", "contains(name_fold, 'order') AND contains(name_fold, '1') AND contains(name_fold, 'low')", "relevance", limit=20, order=f"{_score('order', '1', 'low')} DESC, tree_depth, name_fold, id"),
    "rank_no_terms": Search("size:>1mb", "size >= 1048577", "rank", limit=20, order="name_fold, id"),
    "rank_ignores_descending": Search("low", "contains(name_fold, 'low')", "relevance", True, 50, order=f"{_score('low')} DESC, tree_depth, name_fold, id"),
    "page_offset": Search("order", "contains(name_fold, 'order')", "size", limit=25, offset=40, order=f"size, {_NAME}"),
    # the reference benchmark's shapes
    "bench_relevance": Search("low", "contains(name_fold, 'low')", "relevance", limit=50, order=f"{_score('low')} DESC, tree_depth, name_fold, id"),
    "bench_ext_size": Search("ext:pdf size:>10kb", "ext_fold = 'pdf' AND size >= 10241", "name", limit=50, order=_NAME),
    "bench_wildcard": Search("*.pdf", "name_fold LIKE '%.pdf'", "name", limit=50, order=_NAME),
    "bench_regex": Search(r"regex:^order_[0-9]+_5-low\.pdf$", r"regexp_matches(name_fold, '^order_[0-9]+_5-low\.pdf$')", "name", limit=50, order=_NAME),
    "bench_path": Search("path:europe/nation_3", "contains(path_fold, 'europe/nation_3')", "path", limit=50, order=f"path_fold, {_NAME}"),
}

_LAST = """
WITH log AS (SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'A' WHEN 'error' THEN 'R' ELSE 'U' END AS op, user_id AS id, floor(value * 100)::BIGINT AS size, floor(epoch(ts))::BIGINT AS mtime FROM events),
last AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)
"""


def _index(spark: SparkSession, sf_dir: str) -> Index:
    return Index(tables.order_tree(spark, sf_dir))


def count_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).hits("e", parser.Defaults(now=tables.NOW)).agg(F.count("*").alias("hits"))


def stats_files_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).stats()


def children_per_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.children_per_parent(tables.order_tree_rows(spark, sf_dir))


def distinct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.order_tree_rows(spark, sf_dir).select("name").distinct()


def journal_last_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.last_state(tables.event_log(spark, sf_dir)).select("id", "seq", "op", "size", "mtime")


def stream_last_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of the log read as a stream: state is one change per key, and each micro batch replaces the result."""
    at = f"{own_folder(spark)}/last-state-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    log = tables.as_log(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))
    states = changes.last_state(log).select("id", "seq", "op", "size", "mtime")
    replace = lambda rows, _: rows.write.mode("overwrite").parquet(f"{at}/rows")
    states.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/rows")


def _half_logs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Live keys of the log's first half, and of all of it."""
    log = tables.event_log(spark, sf_dir)
    middle = log.agg((F.max("seq") / 2).alias("middle"))
    first = log.crossJoin(F.broadcast(middle)).where("seq <= middle").drop("middle")  # one row
    return changes.last_state(first), changes.last_state(log)


def journal_adds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.added(*_half_logs(spark, sf_dir)).select("id", "seq", "size")


def journal_removes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.removed(*_half_logs(spark, sf_dir)).select("id", "seq", "size")


def _removed_customers(rows: DataFrame) -> DataFrame:
    return rows.where("id between 10000 and 9999999 and id % 10 = 3").select("id")


def compact_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.order_tree(spark, sf_dir)
    return changes.compact(rows, _removed_customers(rows)).select("id", "parent_id", "name", "size")


def orphan_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.order_tree(spark, sf_dir)
    return tree.orphan_sweep(rows, _removed_customers(rows)).select("id", "path")


def apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with keys divisible by 5 removed, those by 3 updated, one added for each by 11."""
    base = tables.order_tree_rows(spark, sf_dir)
    o = base.where("not is_dir").withColumn("k", F.col("id") - 10_000_000)
    null = lambda kind: F.lit(None).cast(kind)
    r = o.where("k % 5 = 0").select((F.col("k") * 10 + 1).alias("seq"), F.lit("R").alias("op"), "id", null("bigint").alias("parent_id"), null("bigint").alias("size"), null("bigint").alias("mtime"), null("bigint").alias("ctime"), null("boolean").alias("is_dir"), null("string").alias("name"))
    u = o.where("k % 3 = 0").select((F.col("k") * 10).alias("seq"), F.lit("U").alias("op"), "id", null("bigint").alias("parent_id"), (F.col("size") + 7).alias("size"), F.lit(77).cast("bigint").alias("mtime"), F.lit(78).cast("bigint").alias("ctime"), null("boolean").alias("is_dir"), null("string").alias("name"))
    a = o.where("k % 11 = 0").select((F.col("k") * 10 + 2).alias("seq"), F.lit("A").alias("op"), (F.col("id") + 1_000_000_000).alias("id"), "parent_id", "size", "mtime", "ctime", "is_dir", F.concat("name", F.lit(".copy")).alias("name"))
    return changes.apply_log(base, r.unionByName(u).unionByName(a)).select("id", "parent_id", "name", "is_dir", "size", "mtime", "ctime")


def log_of_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches that each count from 0: copies of orders with keys divisible by 11 added, by 22 removed, by 44 added again.

    The copies are updated in the batch that adds them first (which those added again don't keep), those by 33 once more in the last.
    """
    base = tables.order_tree_rows(spark, sf_dir)
    o = base.where("not is_dir").withColumn("k", F.col("id") - 10_000_000)
    null = lambda kind: F.lit(None).cast(kind)
    copy = ((F.col("id") + 1_000_000_000).alias("id"), "parent_id", "size", "mtime", "ctime", "is_dir", F.concat("name", F.lit(".copy")).alias("name"))
    place = lambda batch: F.struct(F.lit(batch).alias("batch"), (F.col("k") % 7).alias("seq")).alias("seq")
    adds = [o.where(f"k % {m} = 0").select(place(b), F.lit("A").alias("op"), *copy) for b, m in ((0, 11), (2, 44))]
    gone = o.where("k % 22 = 0").select(place(1), F.lit("R").alias("op"), (F.col("id") + 1_000_000_000).alias("id"), null("bigint").alias("parent_id"), null("bigint").alias("size"), null("bigint").alias("mtime"), null("bigint").alias("ctime"), null("boolean").alias("is_dir"), null("string").alias("name"))
    values = lambda n: ((F.col("id") + 1_000_000_000).alias("id"), null("bigint").alias("parent_id"), (F.col("size") + n).alias("size"), F.lit(n).cast("bigint").alias("mtime"), F.lit(n).cast("bigint").alias("ctime"), null("boolean").alias("is_dir"), null("string").alias("name"))
    later = lambda batch: F.struct(F.lit(batch).alias("batch"), (F.col("k") % 7 + 7).alias("seq")).alias("seq")
    updates = o.where("k % 11 = 0").select(later(0), F.lit("U").alias("op"), *values(5)).unionByName(o.where("k % 33 = 0").select(later(2), F.lit("U").alias("op"), *values(9)))
    return changes.apply_log(base, adds[0].unionByName(gone).unionByName(adds[1]).unionByName(updates)).select("id", "parent_id", "name", "is_dir", "size", "mtime", "ctime")


def overlay_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log over the stored order tree: customers removed, moved to the next nation under new names, orders updated and added."""
    from filelens.operators.overlay import overlay

    stored = tables.order_tree(spark, sf_dir)
    return overlay(stored, _moves(stored)).select("id", "parent_id", "path", "size", "mtime", "tree_depth")


def _moves(stored: DataFrame) -> DataFrame:
    null = lambda kind: F.lit(None).cast(kind)
    customers = stored.where("id between 10000 and 9999999").withColumn("k", F.col("id") - 10_000)
    orders = stored.where("not is_dir").withColumn("k", F.col("id") - 10_000_000)
    gone = _removed_customers(stored).select(F.lit(0).cast("bigint").alias("seq"), F.lit("R").alias("op"), "id", *(null(t).alias(c) for c, t in (("parent_id", "bigint"), ("size", "bigint"), ("mtime", "bigint"), ("ctime", "bigint"), ("is_dir", "boolean"), ("name", "string"))))
    moved = customers.where("k % 10 = 5").select(F.lit(1).cast("bigint").alias("seq"), F.lit("A").alias("op"), "id", (1000 + (F.col("parent_id") - 999) % 25).alias("parent_id"), "size", "mtime", "ctime", "is_dir", F.concat("name", F.lit(" moved")).alias("name"))
    updated = orders.where("k % 3 = 0").select(F.lit(2).cast("bigint").alias("seq"), F.lit("U").alias("op"), "id", null("bigint").alias("parent_id"), (F.col("size") + 7).alias("size"), F.lit(77).cast("bigint").alias("mtime"), F.lit(78).cast("bigint").alias("ctime"), null("boolean").alias("is_dir"), null("string").alias("name"))
    added = orders.where("k % 11 = 0").select(F.lit(3).cast("bigint").alias("seq"), F.lit("A").alias("op"), (F.col("id") + 1_000_000_000).alias("id"), "parent_id", "size", "mtime", "ctime", "is_dir", F.concat("name", F.lit(".copy")).alias("name"))
    return gone.unionByName(moved).unionByName(updated).unionByName(added)


def lookup_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries after the log of ``overlay_load`` by parent and name: every entry is looked up where it was, as a copy, and as moved."""
    from filelens.operators.overlay import delta
    from filelens.sources import lookup

    stored, by_name = tables.order_tree(spark, sf_dir), tables.order_tree_by_name(spark, sf_dir)
    moved = stored.select((1000 + (F.col("parent_id") - 999) % 25).alias("parent_id"), F.concat("name", F.lit(" moved")).alias("name"))
    keys = stored.select("parent_id", "name").unionByName(stored.select("parent_id", F.concat("name", F.lit(".copy")).alias("name"))).unionByName(moved)
    return lookup.find(by_name, keys, delta(stored, _moves(stored)))


def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.order_tree(spark, sf_dir).select("id", C.human_size(F.col("size"), F.col("is_dir")).alias("shown"))


def plain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain line of every entry, with all its columns."""
    from filelens.output import Lines, plain_line

    return tables.order_tree(spark, sf_dir).select("id", plain_line(Lines(size=True, modified=True, created=True)).alias("line"))


def restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query narrowed to the files of a folder, as the command line's and the socket's options do it."""
    node = nodes.restrict(parser.parse("low | urgent", parser.Defaults(now=tables.NOW)), "/data/asia", files=True)
    return _index(spark, sf_dir).hits(node).select("id", "path")


def restricted_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = nodes.restrict(parser.parse("", parser.Defaults(now=tables.NOW)), "/data/EUROPE/", folders=True)
    return _index(spark, sf_dir).hits(node).select("id", "path")


def page_negative_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a page of 30 a negative offset leaves 20."""
    index, node = _index(spark, sf_dir), parser.parse("low", parser.Defaults(now=tables.NOW))
    return search.paged(index.hits(node), search.order_keys(node, "size", True), *search.cli_limits(30, -10)).select(_SHOWN.split(", "))


def page_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page far down, found by the counts of ranges."""
    index, node = _index(spark, sf_dir), parser.parse("file:", parser.Defaults(now=tables.NOW))
    return search.deep_page(index.hits(node), search.order_keys(node, "size", True), 25, 1000).select(_SHOWN.split(", "))


def page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after the first 40 results, from the cursor of the last of them."""
    index, defaults = _index(spark, sf_dir), parser.Defaults(now=tables.NOW)
    node = parser.parse("order", defaults)
    last = search.cursor_of(index.search(node, "relevance", limit=40), node, "relevance").select("cursor.*").collect()[-1]
    return index.search_after(node, tuple(last), "relevance", limit=25).select(_SHOWN.split(", "))


def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and folders after the log of ``overlay_load``, from those before it and the changes alone."""
    from filelens.operators.overlay import delta

    stored = tables.order_tree(spark, sf_dir)
    before = Index(stored).stats().first()
    return spark.createDataFrame([delta(stored, _moves(stored)).counts(*before)], "files bigint, folders bigint")


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = tables.order_tree_rows(spark, sf_dir)
    return changes.diff(before, apply_changes(spark, sf_dir)).select("op", "id", "size", "name")


def rebuild_path_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.with_paths(tables.order_tree_rows(spark, sf_dir)).select("id", "path")


def tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.order_tree(spark, sf_dir).select("id", "tree_depth", *(F.col(c).cast("bigint").alias(c) for c in ("slash_depth", "name_len")))


def names_and_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.order_tree(spark, sf_dir).select("id", "ext_fold", "stem_fold", C.kind_label(F.col("is_dir")).alias("kind"))


def name_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense number of each distinct name in name order."""
    names = tables.order_tree_rows(spark, sf_dir).select("name").distinct()
    return changes.numbered(names, [F.col("name")], "name_id").select("name_id", "name")


def sibling_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each entry among its siblings by name."""
    place = F.row_number().over(Window.partitionBy("parent_id").orderBy("name_fold", "name", "id"))
    return tables.order_tree(spark, sf_dir).select("id", place.cast("bigint").alias("place"))


def json_rows_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON line of every entry, folders too."""
    from filelens.output import json_line

    return tables.order_tree(spark, sf_dir).select("id", json_line().alias("line"))


def csv_rows_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CSV line of every entry."""
    from filelens.output import csv_line

    return tables.order_tree(spark, sf_dir).select("id", csv_line().alias("line"))


def rfc3339_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.order_tree(spark, sf_dir).where("not is_dir").select("id", C.rfc3339(F.col("mtime")).alias("modified"), C.short_time(F.col("mtime")).alias("short"))


def excluded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filelens.sources.excludes import Excludes

    excludes = Excludes.of(["order_*_1-urgent*", "/data/ASIA", "**/NATION_3", "/data/*/NATION_[16]/Customer#*"])
    return tables.order_tree(spark, sf_dir).where(~excludes.column(F.col("path"), F.col("name"))).select("id", "path")


_SIZE = "lpad(CASE WHEN is_dir THEN '<DIR>' WHEN size >= 1073741824 THEN printf('%.1f GB', size / 1073741824.0) WHEN size >= 1048576 THEN printf('%.1f MB', size / 1048576.0) WHEN size >= 1024 THEN printf('%.1f KB', size / 1024.0) ELSE size || ' B' END, 9, ' ')"
_SHORT = "strftime(make_timestamp({} * 1000000), '%Y-%m-%d %H:%M')"
_TIME = "strftime(make_timestamp({} * 1000000), '%Y-%m-%dT%H:%M:%SZ')"

OTHERS: dict[str, tuple[Query, str]] = {
    "count_hits": (count_hits, f"{ENTRIES}SELECT count(*) AS hits FROM entries WHERE contains(name_fold, 'e')"),
    "stats_files_dirs": (stats_files_dirs, f"{ENTRIES}SELECT count(*) FILTER (NOT is_dir) AS files, count(*) FILTER (is_dir) AS folders FROM entries"),
    "children_per_parent": (children_per_parent, f"{ENTRIES}SELECT parent_id, count(*) AS children FROM entries GROUP BY parent_id"),
    "distinct_names": (distinct_names, f"{ENTRIES}SELECT DISTINCT name FROM entries"),
    "journal_last_state": (journal_last_state, f"{_LAST}SELECT id, seq, op, size, mtime FROM last WHERE op <> 'R'"),
    "stream_last_state": (stream_last_state, f"{_LAST}SELECT id, seq, op, size, mtime FROM last WHERE op <> 'R'"),
    "journal_adds": (
        journal_adds,
        f"{_LAST}, early AS (SELECT * FROM log WHERE seq <= (SELECT max(seq) / 2 FROM log) QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) "
        "SELECT id, seq, size FROM last WHERE op <> 'R' AND id NOT IN (SELECT id FROM early WHERE op <> 'R')",
    ),
    "journal_removes": (
        journal_removes,
        f"{_LAST}, early AS (SELECT * FROM log WHERE seq <= (SELECT max(seq) / 2 FROM log) QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) "
        "SELECT id, seq, size FROM early WHERE op <> 'R' AND id NOT IN (SELECT id FROM last WHERE op <> 'R')",
    ),
    "compact_renumber": (
        compact_renumber,
        f"{ENTRIES}, live AS (SELECT *, row_number() OVER (ORDER BY path_fold, name_fold, name, id) - 1 AS new_id FROM entries WHERE NOT (id BETWEEN 10000 AND 9999999 AND id % 10 = 3) AND NOT (parent_id BETWEEN 10000 AND 9999999 AND parent_id % 10 = 3)) "
        "SELECT a.new_id AS id, coalesce(b.new_id, -1) AS parent_id, a.name, a.size FROM live a LEFT JOIN live b ON a.parent_id = b.id",
    ),
    "orphan_sweep": (orphan_sweep, f"{ENTRIES}SELECT id, path FROM entries WHERE NOT (id BETWEEN 10000 AND 9999999 AND id % 10 = 3) AND NOT (parent_id BETWEEN 10000 AND 9999999 AND parent_id % 10 = 3)"),
    "apply_changes": (
        apply_changes,
        f"{ENTRIES}, e AS (SELECT *, CASE WHEN is_dir THEN 1 ELSE id - 10000000 END AS k FROM entries) "
        "SELECT id, parent_id, name, is_dir, CASE WHEN NOT is_dir AND k % 3 = 0 THEN size + 7 ELSE size END AS size, CASE WHEN NOT is_dir AND k % 3 = 0 THEN 77 ELSE mtime END AS mtime, "
        "CASE WHEN NOT is_dir AND k % 3 = 0 THEN 78 ELSE ctime END AS ctime FROM e WHERE is_dir OR k % 5 <> 0 "
        "UNION ALL SELECT id + 1000000000, parent_id, name || '.copy', is_dir, size, mtime, ctime FROM e WHERE NOT is_dir AND k % 11 = 0",
    ),
    "log_of_batches": (
        log_of_batches,
        f"{ENTRIES}SELECT id, parent_id, name, is_dir, size, mtime, ctime FROM entries "
        "UNION ALL SELECT id + 1000000000, parent_id, name || '.copy', is_dir, CASE WHEN k % 33 = 0 THEN size + 9 WHEN k % 44 = 0 THEN size ELSE size + 5 END, "
        "CASE WHEN k % 33 = 0 THEN 9 WHEN k % 44 = 0 THEN mtime ELSE 5 END, CASE WHEN k % 33 = 0 THEN 9 WHEN k % 44 = 0 THEN ctime ELSE 5 END "
        "FROM (SELECT *, id - 10000000 AS k FROM entries WHERE NOT is_dir) WHERE k % 11 = 0 AND (k % 22 <> 0 OR k % 44 = 0)",
    ),
    "overlay_load": (
        overlay_load,
        """WITH n AS (SELECT n_nationkey AS nk, '/data/' || r_name || '/' || n_name AS path, n_name AS name, 1 + n_regionkey AS up FROM nation JOIN region ON n_regionkey = r_regionkey),
        c AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 5 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS nk, c_name || CASE WHEN c_custkey % 10 = 5 THEN ' moved' ELSE '' END AS name FROM customer WHERE c_custkey % 10 <> 3),
        cp AS (SELECT c_custkey, 1000 + nk AS up, n.path || '/' || c.name AS path FROM c JOIN n USING (nk)),
        o AS (SELECT o_orderkey AS k, o_custkey, 'order_' || o_orderkey || '_' || o_orderpriority || CASE o_orderstatus WHEN 'F' THEN '.pdf' WHEN 'O' THEN '.PDF' ELSE '' END AS name,
          floor(o_totalprice * 100)::BIGINT AS size, floor(epoch(o_orderdate))::BIGINT AS mtime FROM orders)
        SELECT 0::BIGINT AS id, (-1)::BIGINT AS parent_id, '/data' AS path, 0::BIGINT AS size, 0::BIGINT AS mtime, 0 AS tree_depth
        UNION ALL SELECT 1 + r_regionkey, 0, '/data/' || r_name, 0, 0, 1 FROM region UNION ALL SELECT 1000 + nk, up, path, 0, 0, 2 FROM n UNION ALL SELECT 10000 + c_custkey, up, path, 0, 0, 3 FROM cp
        UNION ALL SELECT 10000000 + k, 10000 + o_custkey, path || '/' || name, CASE WHEN k % 3 = 0 THEN size + 7 ELSE size END, CASE WHEN k % 3 = 0 THEN 77 ELSE mtime END, 4 FROM o JOIN cp ON o_custkey = c_custkey
        UNION ALL SELECT 1010000000 + k, 10000 + o_custkey, path || '/' || name || '.copy', size, mtime, 4 FROM o JOIN cp ON o_custkey = c_custkey WHERE k % 11 = 0""",
    ),
    "lookup_by_name": (
        lookup_by_name,
        f"""{ENTRIES}, o AS (SELECT *, id BETWEEN 10000 AND 9999999 AS customer FROM entries),
        a AS (SELECT parent_id, name, id, is_dir FROM o WHERE NOT (customer AND id % 10 IN (3, 5)) AND (is_dir OR parent_id % 10 <> 3)
          UNION ALL SELECT 1000 + (parent_id - 999) % 25, name || ' moved', id, is_dir FROM o WHERE customer AND id % 10 = 5
          UNION ALL SELECT parent_id, name || '.copy', id + 1000000000, is_dir FROM o WHERE NOT is_dir AND (id - 10000000) % 11 = 0 AND parent_id % 10 <> 3),
        k AS (SELECT parent_id, name FROM o UNION SELECT parent_id, name || '.copy' FROM o UNION SELECT 1000 + (parent_id - 999) % 25, name || ' moved' FROM o)
        SELECT a.parent_id, a.name, a.id, a.is_dir FROM a JOIN k ON a.parent_id = k.parent_id AND a.name = k.name""",
    ),
    "state_counts": (
        state_counts,
        f"{ENTRIES}, o AS (SELECT id - 10000000 AS k, parent_id - 10000 AS c FROM entries WHERE NOT is_dir) SELECT (SELECT count(*) FILTER (c % 10 <> 3) + count(*) FILTER (c % 10 <> 3 AND k % 11 = 0) FROM o) AS files, "
        "(SELECT count(*) FROM entries WHERE is_dir AND NOT (id BETWEEN 10000 AND 9999999 AND id % 10 = 3)) AS folders",
    ),
    "human_sizes": (human_sizes, f"{ENTRIES}SELECT id, {_SIZE} AS shown FROM entries"),
    "plain_lines": (plain_lines, f"{ENTRIES}SELECT id, {_SIZE} || '  ' || {_SHORT.format('mtime')} || '  ' || CASE WHEN ctime = 0 THEN repeat(' ', 16) ELSE {_SHORT.format('ctime')} END || '  ' || path AS line FROM entries"),
    "restricted": (restricted, f"{ENTRIES}SELECT id, path FROM entries WHERE (contains(name_fold, 'low') OR contains(name_fold, 'urgent')) AND starts_with(path, '/data/ASIA/') AND NOT is_dir"),
    "restricted_folders": (restricted_folders, f"{ENTRIES}SELECT id, path FROM entries WHERE starts_with(path, '/data/EUROPE/') AND is_dir"),
    "page_negative_offset": (page_negative_offset, f"{ENTRIES}SELECT {_SHOWN} FROM entries WHERE contains(name_fold, 'low') ORDER BY {_desc(f'size, {_NAME}')} LIMIT 20"),
    "page_deep": (page_deep, f"{ENTRIES}SELECT {_SHOWN} FROM entries WHERE NOT is_dir ORDER BY {_desc(f'size, {_NAME}')} LIMIT 25 OFFSET 1000"),
    "page_after": (page_after, f"{ENTRIES}SELECT {_SHOWN} FROM entries WHERE contains(name_fold, 'order') ORDER BY {_score('order')} DESC, tree_depth, name_fold, id LIMIT 25 OFFSET 40"),
    "snapshot_diff": (
        snapshot_diff,
        f"{ENTRIES}, o AS (SELECT *, id - 10000000 AS k FROM entries WHERE NOT is_dir) "
        "SELECT 'R' AS op, id, NULL::BIGINT AS size, NULL::VARCHAR AS name FROM o WHERE k % 5 = 0 UNION ALL SELECT 'A', id + 1000000000, size, name || '.copy' FROM o WHERE k % 11 = 0 "
        "UNION ALL SELECT 'U', id, size + 7, NULL FROM o WHERE k % 3 = 0 AND k % 5 <> 0",
    ),
    "rebuild_path_recursive": (rebuild_path_recursive, f"{ENTRIES}SELECT id, path FROM entries"),
    "tree_depth": (tree_depth, f"{ENTRIES}SELECT id, tree_depth, slash_depth, name_len FROM entries"),
    "names_and_stems": (names_and_stems, f"{ENTRIES}SELECT id, ext_fold, stem_fold, CASE WHEN is_dir THEN 'dir' ELSE 'file' END AS kind FROM entries"),
    "name_ranks": (name_ranks, f"{ENTRIES}SELECT row_number() OVER (ORDER BY name) - 1 AS name_id, name FROM (SELECT DISTINCT name FROM entries)"),
    "sibling_rows": (sibling_rows, f"{ENTRIES}SELECT id, row_number() OVER (PARTITION BY parent_id ORDER BY name_fold, name, id) AS place FROM entries"),
    "json_rows_all": (
        json_rows_all,
        f"""{ENTRIES}SELECT id, '{{"path":"' || path || '","name":"' || name || '","type":"' || CASE WHEN is_dir THEN 'dir' ELSE 'file' END || '","size":' || size || ',"modified":"' || {_TIME.format("mtime")} || '"' ||
        CASE WHEN ctime = 0 THEN '' ELSE ',"created":"' || {_TIME.format("ctime")} || '"' END || '}}' AS line FROM entries""",
    ),
    "csv_rows_all": (
        csv_rows_all,
        f"""{ENTRIES}SELECT id, path || ',' || name || ',' || CASE WHEN is_dir THEN 'dir' ELSE 'file' END || ',' || size || ',' || {_TIME.format("mtime")} || ',' ||
        CASE WHEN ctime = 0 THEN '' ELSE {_TIME.format("ctime")} END AS line FROM entries""",
    ),
    "rfc3339_utc": (rfc3339_utc, f"{ENTRIES}SELECT id, {_TIME.format('mtime')} AS modified, strftime(make_timestamp(mtime * 1000000), '%Y-%m-%d %H:%M') AS short FROM entries WHERE NOT is_dir"),
    "excluded_paths": (
        excluded_paths,
        f"{ENTRIES}SELECT id, path FROM entries WHERE NOT (regexp_matches(name, '^order_.*_1-urgent') OR path = '/data/ASIA' OR starts_with(path, '/data/ASIA/') OR regexp_matches(path, '/NATION_3(/|$)') "
        "OR regexp_matches(path, '^/data/[^/]*/NATION_[16]/Customer#'))",
    ),
}

QUERIES: dict[str, Query] = {k: s.run for k, s in SEARCHES.items()} | {k: q for k, (q, _) in OTHERS.items()}
ORACLES: dict[str, str] = {k: s.sql() for k, s in SEARCHES.items()} | {k: sql for k, (_, sql) in OTHERS.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDFs of more than 10 MB, the largest first."""
    return SEARCHES["sort_size_desc"].run(spark, sf_dir)
