"""Source divergence audit: how far the sources of a language differ in their terms, and by which terms.

Each language keeps the terms that at least ``min_docs`` of its documents have. A kept term of a language is one wide
vector: its counts in an array indexed by the language's sources. JVM higher-order functions turn the vector into
probabilities (in billionths, smoothed) and emit what it adds to each pair of sources, both ways; the sums are combined
before the exchange. Terms whose vectors are equal add the same and are counted first, so the long tail of rare terms is
emitted once per vector. Where both sources lack a term it adds a constant, which is multiplied and not emitted: work
follows the counts that aren't 0.

Terms are counted inside the tasks, in tables that are handed on at ``HELD_TERMS`` entries or ``HELD_BYTES`` of text;
Spark combines them by (language, term, source), so a source, a language or a term with a third of all rows is one record
per table. A vector has one entry per source of its language, and the result one row per pair of them. What a language
has per source is broadcast if its bytes, counted first, are few; else it is joined by a sort-merge join whose hot
languages may be split.

All arithmetic is exact: products of counts are decimals, quotients are floored. A sum over all terms stays below 2**63
while a language keeps fewer than 8 * 10**9 terms; beyond it the job fails instead of giving a wrong number.

Edge cases: null text, language and source are the empty string, a group like any other. A group without terms takes part
with counts of 0; a language that keeps no term has pairs of value 0; a language with one source has no pairs. Ties are
ordered by item. Repeated rows are documents of their own; ids aren't looked at. A text of any length is counted whole,
and a term may be as long as its text. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filelens.llm._common import BATCH_ROWS, beside, cut, table

MIN_DOCS, TOP = 3, 200
#: Entries and bytes of text after which a task hands its counts on.
HELD_TERMS, HELD_BYTES = 200_000, 64 << 20

COUNTS = "lang string, source string, term string, n bigint, docs bigint"

#: Bytes of a term stay (A-Z in lower case), all others part terms.
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> COUNTS: occurrences and documents of each term, combined within a task."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    entries = size = 0

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            whole = pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64()), pa.array(map(docs.__getitem__, n), pa.int64())], names=["term", "n", "docs"])
            for k in range(0, whole.num_rows, 10 * BATCH_ROWS):
                part = whole.slice(k, 10 * BATCH_ROWS)
                own = [pa.array([x] * part.num_rows, pa.string()) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*own, *part.columns], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*batch.columns, strict=True):
            data = (text.as_py() or "").encode()
            terms = data.translate(_FOLDED).split()
            if terms:
                n, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                before = len(docs)
                n.update(terms)
                docs.update(set(terms))
                entries, size = entries + len(docs) - before, size + len(data)
                if entries >= HELD_TERMS or size >= HELD_BYTES:
                    yield from handed_on()
                    entries = size = 0
    yield from handed_on()


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, n, entries): of each kept term its count and those by source. ``docs`` has (lang, source, text), no nulls in the first two."""
    counts = docs.select("lang", "source", "text").mapInArrow(_counted, COUNTS).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("entries"))
    return terms.where(F.col("docs") >= min_docs).select("lang", "term", "n", "entries")


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, n, terms, lang_n) of each occurring group: its count over the kept terms, their number, and the language's count."""
    groups = docs.select("lang", "source").distinct()
    sizes = kept.select("lang", F.explode("entries").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("n"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_n"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("n"), zero("terms"), zero("lang_n"))


def _billionths(count: str, total: str) -> str:
    """The smoothed probability in SQL; ``total`` holds the number of kept terms already."""
    return f"1 + (1000000000BD * ({count} + 1)) div {total}"


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each ordered pair of sources of a language."""
    of_lang = F.sort_array(F.collect_list(F.struct("source", "n"))).alias("g")
    langs = groups.groupBy("lang").agg(of_lang, F.first("terms").alias("terms")).select("lang", "terms", F.expr("g.source AS sources"), F.expr("transform(g.n, n -> n + terms) AS totals"))
    langs = cut(langs)
    same = cut(kept.groupBy("lang", "entries").agg(F.count("*").alias("copies")).select("lang", "copies", F.map_from_entries("entries").alias("by_source")))
    bytes_ = F.octet_length(F.array_join("sources", "")) + 32 * F.size("sources")
    wide = beside(same, langs, "lang", "inner", bytes_).select(
        "lang",
        "copies",
        F.expr(f"transform(transform(sources, s -> coalesce(try_element_at(by_source, s), 0L)), (c, i) -> {_billionths('c', 'totals[i]')}) AS p"),
        F.expr("filter(sequence(0, size(sources) - 1), i -> map_contains_key(by_source, sources[i])) AS has"),
    )
    emitted = cut(wide).select(
        "lang",
        "copies",
        F.explode(
            F.expr(
                """flatten(transform(sequence(0, size(p) - 1), i ->
                     transform(if(array_contains(has, i), slice(sequence(0, size(p) - 1), i + 2, size(p)), filter(has, j -> j > i)),
                       j -> struct(i, j, (p[i] - p[j]) * (p[i] - p[j]) div p[j] AS f, (p[i] - p[j]) * (p[i] - p[j]) div p[i] AS g))))"""
            )
        ).alias("x"),
    )
    added = lambda c: F.sum(F.col(f"x.{c}") * F.col("copies")).alias(c)
    once = emitted.groupBy("lang", F.col("x.i").alias("i"), F.col("x.j").alias("j")).agg(added("f"), added("g"), F.sum("copies").alias("met"))
    ways = F.array(F.struct("i", "j", "f"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("g").alias("f")))
    sums = once.select("lang", "met", F.explode(ways).alias("w")).select("lang", "w.*", "met")
    # A language without kept terms has totals of 0 and nothing to multiply.
    absent = langs.withColumn("z", F.expr(f"transform(totals, n -> {_billionths('0L', 'greatest(n, 1L)')})"))
    ordered = absent.select("lang", "terms", "z", "sources", F.posexplode("sources").alias("i", "source")).select("lang", "terms", "z", "i", "source", F.posexplode("sources").alias("j", "item")).where("i <> j")
    both_absent = F.expr("(terms - coalesce(met, 0L)) * ((z[i] - z[j]) * (z[i] - z[j]) div z[j])")
    return ordered.join(sums, ["lang", "i", "j"], "left").select("lang", "source", "item", (F.coalesce("f", F.lit(0).cast("bigint")) + both_absent).alias("value"))


def term_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each term that a group has more of than its language."""
    rows = kept.select("lang", "term", F.col("n").alias("all_n"), F.explode("entries").alias("e")).select("lang", "term", "all_n", F.col("e.source").alias("source"), F.col("e.n").alias("own_n"))
    bytes_ = F.octet_length("lang") + F.octet_length("source") + 48
    both = beside(rows, groups, ["lang", "source"], "inner", bytes_)
    compared = both.select("lang", "source", "term", F.expr(f"{_billionths('own_n', '(n + terms)')} AS p"), F.expr(f"{_billionths('all_n', '(lang_n + terms)')} AS q"))
    return compared.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q AS value"))


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): parts ``pair`` (all other sources) and ``term`` (the first ``top`` terms)."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.col(text_col).alias("text"))
    kept = cut(kept_terms(rows, min_docs))
    groups = cut(group_sizes(rows, kept))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_values(kept, groups).withColumn("rank", ranked)
    terms = term_values(kept, groups).withColumn("rank", ranked).where(F.col("rank") <= top)
    shown = lambda part, found: found.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return shown("pair", pairs).unionByName(shown("term", terms))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS k,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT lang, source, k, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS all_n FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
counts AS (SELECT lang, source, term, count(*) AS own_n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
langs AS (SELECT lang, count(*) AS v, sum(all_n) AS lang_n FROM kept GROUP BY lang),
groups AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(any_value(lang_n), 0) AS lang_n, coalesce(sum(own_n), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN langs USING (lang) LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
p AS (
  SELECT lang, source, term, coalesce(own_n, 0) AS own_n, 1 + (1000000000::HUGEINT * (coalesce(own_n, 0) + 1)) // (n + v) AS p, 1 + (1000000000::HUGEINT * (all_n + 1)) // (lang_n + v) AS q
  FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(any_value(s), 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // y.p) AS s FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) z
    ON z.lang = a.lang AND z.source = a.source AND z.other = b.source GROUP BY ALL)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', term, v::BIGINT, r::INTEGER
FROM (SELECT lang, source, term, (p - q) * (p - q) // q AS v, row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // q DESC, term) AS r FROM p WHERE own_n > 0 AND p > q) WHERE r <= 200
"""
