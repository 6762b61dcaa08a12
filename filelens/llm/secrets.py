"""Secret scans with corpus-wide ownership, in DataFrame operations only.

A scan finds candidate spans of four kinds. Three are flagged wherever they occur: ``assign`` (a keyword, a separator and
a value of 8 or more characters), ``access`` (AKIA and at least 12 more) and ``hex`` (32 or more lower-case hex digits).
``opaque`` is any other run of 20 or more key-like characters that has lower-case or upper-case letters and at least
three digits and doesn't overlap one of the others.

Every candidate's value is hashed; the corpus then counts, for each hash, its occurrences and the distinct repositories
and owners it occurs under. A hash under at least ``copied_owners`` owners is a widely
copied example, and so is one of several owners that occurs in at least ``copied_repos`` repositories, where those that
hold the same text count once; one that stays with fewer is live-looking, however often its owner repeats it. Opaque candidates are flagged only if live-looking,
so the method adds spans and drops none of the first three kinds; each flagged span carries the verdict and the counts.

At scale: texts are read once and only matches (rows of a few bytes) leave the scan, in the shared folder.
Positions are running sums, and overlaps running maxima, over the matches of a row in order, so the work grows as the
matches (times their logarithm, for the sort) however many a text has. Owners, repositories and texts are counted by
nested aggregations that combine before each exchange, so a hash or owner that has a third of all rows is one record per
task; the join back is a plain shuffle join that may be split by AQE.

Positions are code points, ends exclusive. They come from the lengths of the matches and of the parts between them,
which ``regexp_extract_all`` and ``split`` return for the same pattern.

Edge cases: a null text is empty and has no spans. Null repositories and owners count as one value each. Rows that
repeat an id are reported once each; redaction tells rows apart by id and text, so null and repeated ids keep nothing in
clear. An empty table gives an empty result. Other columns are ignored, or kept by ``redact``, and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filelens.llm._common import apart, beside, boxed, cut, met, table, text_digest

#: Kinds in their order among spans with the same start, with pattern and the group that holds the value. Fixed values.
KINDS = ("assign", "access", "hex", "opaque")
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
    "opaque": r"[A-Za-z0-9+/_=-]{20,}",
}
VALUE_GROUP = {"assign": 2, "access": 0, "hex": 0, "opaque": 0}
LEAST_ASSIGNED = 8
OPAQUE = KINDS.index("opaque")

MATCH = "struct<kind:int,before:int,length:int,ok:boolean,h:binary>"
#: Code points of a text that redaction cuts at a time.
BLOCK = 4096


def matches(text: Column, kind: str) -> Column:
    """All matches of a kind, in order: array of MATCH, with the length of the part before each, whether it counts, and its value's hash."""
    pattern = F.lit(PATTERNS[kind])
    zipped = F.arrays_zip(
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.regexp_extract_all(text, pattern, F.lit(VALUE_GROUP[kind])).alias("v"), F.split(text, PATTERNS[kind], -1).alias("p")
    )

    def counts(value: Column) -> Column:
        if kind == "assign":
            return F.length(value) >= LEAST_ASSIGNED
        if kind == "opaque":
            return (F.length(F.regexp_replace(value, "[^0-9]", "")) >= 3) & value.rlike("[A-Za-z]")
        return F.lit(True)

    # split gives one part more than there are matches
    each = F.transform(
        F.filter(zipped, lambda x: x["m"].isNotNull()),
        lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.length(x["p"]).alias("before"), F.length(x["m"]).alias("length"), counts(x["v"]).alias("ok"), F.unhex(F.sha2(x["v"], 256)).alias("h")),
    )
    return F.when(text.rlike(PATTERNS[kind]), each).otherwise(F.array()).cast(f"array<{MATCH}>")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """(row, doc_id, digest, repo, owner, found) of every row, written to the shared folder; ``row`` tells rows apart."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return cut(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_digest(F.col("text")).alias("digest"), "repo", "owner", F.concat(*(matches(F.col("text"), k) for k in KINDS)).alias("found")))


def candidates(scanned: DataFrame) -> DataFrame:
    """(row, digest, repo, owner, start, kind, end, h) of every candidate span, settled: matches that count, without opaque ones beside others.

    A row's matches are in one task, which its text was too; they are dealt by row once for both passes.
    """
    each = scanned.where(F.size("found") > 0).select("row", "digest", "repo", "owner", F.posexplode("found").alias("at", "m")).select("row", "digest", "repo", "owner", "at", "m.*")
    so_far = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.repartition("row").withColumn("end", F.sum(F.col("before") + F.col("length")).over(so_far).cast("int")).withColumn("start", F.col("end") - F.col("length")).where("ok")
    # Base spans come in the order of their starts, opaque ones of their ends, so all base spans that begin before an
    # opaque one ends stand before it; it overlaps one of them if the farthest of their ends is beyond its start.
    opaque = F.col("kind") == OPAQUE
    before = Window.partitionBy("row").orderBy(F.when(opaque, F.col("end")).otherwise(F.col("start")), F.when(opaque, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    farthest = F.coalesce(F.max(F.when(~opaque, F.col("end"))).over(before), F.lit(-1))
    return cut(placed.withColumn("farthest", farthest).where(~opaque | (F.col("farthest") <= F.col("start"))).select("row", "digest", "repo", "owner", "start", "kind", "end", "h"))


def ownership(spans: DataFrame, copied_owners: int = 3, copied_repos: int = 10) -> DataFrame:
    """(h, n_seen, n_repos, n_owners, live) of every candidate hash of the corpus."""
    by_repo = spans.groupBy("h", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("h", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("r"))
    counted = by_owner.groupBy("h", apart("h")).agg(F.sum("n").alias("n_seen"), F.sum("r").alias("n_repos"), F.count("*").alias("n_owners")).drop("_apart")
    # A text that several repositories hold counts for the first of them.
    by_text = spans.groupBy("h", "digest").agg(F.min(F.struct("owner", "repo")).alias("first"))
    places = by_text.groupBy("h", "first").agg(F.lit(1).alias("one")).groupBy("h", apart("h")).agg(F.count("*").alias("places")).drop("_apart")
    copied = (F.col("n_owners") >= copied_owners) | ((F.col("n_owners") > 1) & (F.col("places") >= copied_repos))
    return met(counted, places, "h").withColumn("live", ~copied).drop("places")


def flagged(scanned: DataFrame, copied_owners: int, copied_repos: int) -> DataFrame:
    """(row, start, kind, end, live, n_repos, n_owners) of every flagged span."""
    spans = candidates(scanned)
    judged = met(spans.select("row", "start", "kind", "end", "h"), ownership(spans, copied_owners, copied_repos), "h")
    return judged.where((F.col("kind") < OPAQUE) | F.col("live")).select("row", "start", "kind", "end", "live", "n_repos", "n_owners")


def secret_scan(docs: DataFrame, copied_owners: int = 3, copied_repos: int = 10, **columns: str) -> DataFrame:
    """One row per input row: (doc_id, spans), spans an array of (start, kind, end, live, n_repos, n_owners) by start and kind.

    ``columns``: id_col, text_col, repo_col, owner_col.
    """
    scanned = scan(docs, **columns)
    span = F.struct("start", "kind", "end", "live", "n_repos", "n_owners")
    with_spans = flagged(scanned, copied_owners, copied_repos).groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    return met(scanned.select("row", "doc_id"), with_spans, "row", "left").select("doc_id", F.coalesce("spans", F.array().cast(with_spans.schema["spans"].dataType)).alias("spans"))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))))


def _stretch(blocks: Column, begin: Column, end: Column) -> Column:
    """The code points [begin, end) of a text in blocks; the work is in proportion to a block and the stretch."""
    at = lambda x: F.floor(x / BLOCK).cast("int")
    part = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
    first, last, offset = at(begin), at(end), (begin % BLOCK) + 1
    across = F.concat(F.substring(part(first), offset, F.lit(BLOCK)), F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), F.substring(part(last), F.lit(1), end % BLOCK))
    return F.when(first == last, F.substring(part(first), offset, end - begin)).otherwise(across)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", copied_owners: int = 3, copied_repos: int = 10) -> DataFrame:
    """``docs`` with every flagged span replaced by ``[kind]``, or ``[kind example]`` where it is widely copied; all columns stay.

    Overlapping spans are replaced as one, named after the first. Spans and verdicts follow from the text alone, so
    verdicts meet the rows by id and text; null and repeated ids may occur.
    """
    scanned = scan(docs, id_col, text_col, repo_col, owner_col)
    in_order = Window.partitionBy("row").orderBy("start", "kind")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    spans = flagged(scanned, copied_owners, copied_repos).repartition("row")
    heads = spans.withColumn("head", (F.coalesce(F.max("end").over(earlier), F.lit(0)) <= F.col("start")).cast("int")).withColumn("stretch", F.sum("head").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = heads.groupBy("row", "stretch").agg(F.min(F.struct("start", "kind", "live")).alias("s"), F.max("end").alias("end"))
    label = F.concat(F.lit("["), F.array(*map(F.lit, KINDS))[F.col("s.kind")], F.when(F.col("s.live"), "").otherwise(" example"), F.lit("]"))
    pieces = merged.select("row", F.col("s.start").alias("start"), "end", label.alias("label")).withColumn("after", F.lag("end", 1, 0).over(Window.partitionBy("row").orderBy("start")))
    by_row = pieces.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "after", "label"))).alias("pieces"))
    verdict = met(scanned.select("row", "doc_id", "digest"), by_row, "row").groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.first("pieces").alias("pieces"))
    own = boxed(docs, text=F.col(text_col), own_id=F.col(id_col), own=text_digest(F.col(text_col)))
    met_rows = beside(own, cut(verdict), F.col("own_id").eqNullSafe(F.col("_id")) & (F.col("own") == F.col("_digest")), "left", 96 + 48 * F.size("pieces"))
    blocks = F.when(F.col("pieces").isNotNull(), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))
    held = met_rows.select("row", "text", "pieces", blocks.alias("blocks"), F.length("text").alias("n"))
    clean = F.concat(
        F.array_join(F.transform("pieces", lambda p: F.concat(_stretch(F.col("blocks"), p["after"], p["start"]), p["label"])), ""),
        _stretch(F.col("blocks"), F.element_at("pieces", -1)["end"], F.col("n")),
    )
    told = held.select("row", F.when(F.col("pieces").isNull(), F.col("text")).otherwise(clean).alias("text"))
    return told.select(*(F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a repository of its own here, its source the owner."""
    got = secret_scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < OPAQUE)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")
    return got.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s["live"])).cast("bigint").alias("n_live")
    )


def _oracle() -> str:
    """The query in SQL for DuckDB: positions are sums of the lengths of matches and of the parts between them."""
    quote = lambda p: p.replace("'", "''")
    kinds = " UNION ALL ".join(
        f"SELECT doc_id, source, {k} AS kind, regexp_extract_all(text, '{quote(PATTERNS[kind])}', 0) AS m, regexp_extract_all(text, '{quote(PATTERNS[kind])}', {VALUE_GROUP[kind]}) AS v, "
        f"string_split_regex(text, '{quote(PATTERNS[kind])}') AS p FROM t"
        for k, kind in enumerate(KINDS)
    )
    return f"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
hashed AS (SELECT doc_id AS d, sha256(text) AS whole FROM t),
found AS ({kinds}),
each AS (SELECT doc_id, source, kind, m, v, p, unnest(range(1, len(m) + 1)) AS k FROM found),
placed AS (SELECT doc_id, source, kind, v[k] AS value, length(m[k]) AS n,
  (coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) + list_sum(list_transform(p[1:k], lambda x: length(x))))::BIGINT AS b FROM each),
base AS (SELECT *, b + n AS e FROM placed WHERE kind BETWEEN 1 AND 2 OR kind = 0 AND length(value) >= {LEAST_ASSIGNED}),
opaque AS (SELECT *, b + n AS e FROM placed o WHERE kind = 3 AND length(regexp_replace(value, '[^0-9]', '', 'g')) >= 3 AND regexp_matches(value, '[A-Za-z]')
  AND NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = o.doc_id AND base.b < o.b + o.n AND o.b < base.e)),
candidates AS (SELECT * FROM base UNION ALL SELECT * FROM opaque),
owned AS (SELECT value AS w, count(DISTINCT source) < 3 AND (count(DISTINCT source) = 1 OR count(DISTINCT whole) < 10) AS live FROM candidates JOIN hashed ON doc_id = d GROUP BY value),
flagged AS (SELECT *, ['assign', 'access', 'hex', 'opaque'][kind + 1] || ':' || b || ':' || e AS s FROM candidates JOIN owned ON value = w WHERE kind < 3 OR live),
listed AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (live) AS n_live,
  string_agg(s, ',' ORDER BY b, kind) AS spans, string_agg(s, ',' ORDER BY b, kind) FILTER (kind < 3) AS base_spans FROM flagged GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM documents LEFT JOIN listed USING (doc_id)
"""


ORACLE_SQL = _oracle()
