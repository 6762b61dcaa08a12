"""Search over entries: filter, order, page, count.

    index = Index(entries)
    index.search("ext:pdf size:>10mb", sort="size", descending=True, limit=20)
"""

from __future__ import annotations

import os.path
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelens.operators.numbering import numbered
from filelens.plans import nodes, parser, values
from filelens.plans.lower import Folder, lower, relevance
from filelens.plans.nodes import Node

#: Order of names: folded, raw, id. Every order ends in it, so pages are stable.
BY_NAME = ("name_fold", "name", "id")
ORDERS = {
    "path": ("path_fold", *BY_NAME),
    "name": BY_NAME,
    "size": ("size", *BY_NAME),
    "dm": ("mtime", *BY_NAME),
    "dc": ("ctime", *BY_NAME),
    "ext": ("ext_fold", *BY_NAME),
}

#: Offsets beyond this many rows are found by counts, not by a top-k of all rows before them.
DEEP = 100_000


def absolute(path: str) -> str:
    """A folder argument as it is looked up: ``~`` expanded, absolute, without empty or dot components."""
    clean = os.path.normpath(os.path.abspath(os.path.expanduser(path)))
    return clean[1:] if clean.startswith("//") else clean


def find_folder(entries: DataFrame, path: str) -> Folder | None:
    """The folder with that path, whatever the case of its letters: one point query.

    Among twins, each component goes to the sibling with the smallest id; among roots the first that has it.
    """
    target = nodes.fold(absolute(path))
    root = F.when(F.col("parent_id") == -1, F.rtrim(F.col("path_fold"), F.lit("/"))).otherwise(F.col("path_fold"))
    hit = entries.where((root == (target if target != "/" else "")) & F.col("is_dir") & F.col("dir_primary")).orderBy("root_id", "id").select("id", "root_id", "path").first()
    return Folder(hit.id, hit.root_id, hit.path) if hit else None


@dataclass(frozen=True)
class Index:
    """One state of the table: an immutable DataFrame of entries."""

    entries: DataFrame

    def condition(self, query: str | Node, defaults: parser.Defaults = parser.Defaults()) -> Column:  # noqa: B008
        node = parser.parse(query, defaults) if isinstance(query, str) else query
        return lower(node, lambda path: find_folder(self.entries, path))

    def hits(self, query: str | Node, defaults: parser.Defaults = parser.Defaults()) -> DataFrame:  # noqa: B008
        """All matching entries, in no order."""
        return self.entries.where(self.condition(query, defaults))

    def search(
        self,
        query: str | Node,
        sort: str = "relevance",
        descending: bool = False,
        limit: int = -1,
        offset: int = 0,
        defaults: parser.Defaults = parser.Defaults(),  # noqa: B008
    ) -> DataFrame:
        """A page of the matching entries in order; a limit under zero means all."""
        node = parser.parse(query, defaults) if isinstance(query, str) else query
        return paged(self.hits(node), order_keys(node, values.sort_key(sort), descending), limit, offset)

    def search_after(
        self,
        query: str | Node,
        cursor: tuple,
        sort: str = "relevance",
        descending: bool = False,
        limit: int = 100,
        defaults: parser.Defaults = parser.Defaults(),  # noqa: B008
    ) -> DataFrame:
        """The page after the row whose ``cursor_of`` is given: a top-k of ``limit`` rows however far down the order it is."""
        node = parser.parse(query, defaults) if isinstance(query, str) else query
        sort = values.sort_key(sort)
        return page(ordered(after(self.hits(node), node, cursor, sort, descending), node, sort, descending), limit)

    def count(self, query: str | Node, defaults: parser.Defaults = parser.Defaults()) -> int:  # noqa: B008
        return self.hits(query, defaults).count()

    def stats(self) -> DataFrame:
        """(files, folders) over all entries."""
        return self.entries.agg(F.count_if(~F.col("is_dir")).alias("files"), F.count_if(F.col("is_dir")).alias("folders"))


def _keys(node: Node, sort: str, descending: bool) -> list[tuple[Column, bool]]:
    """The keys of an order, each with whether it runs from the greatest down."""
    if sort == "relevance":
        terms = nodes.plain_terms(node)
        best = [(relevance(terms), True), (F.col("tree_depth"), False)] if terms else []
        return [*best, (F.col("name_fold"), False), (F.col("id"), False)]
    return [(F.col(c), descending) for c in ORDERS[sort]]


def order_keys(node: Node, sort: str, descending: bool = False) -> list[Column]:
    """Sort expressions. Relevance is best first and ignores ``descending``; the others reverse every key, ids too."""
    return [key.desc() if down else key.asc() for key, down in _keys(node, sort, descending)]


def cursor_of(rows: DataFrame, node: Node, sort: str, descending: bool = False) -> DataFrame:
    """``rows`` with their keys in the order, as a struct ``cursor``; the last one of a page is where the next begins."""
    return rows.withColumn("cursor", F.struct(*(key.alias(f"k{n}") for n, (key, _) in enumerate(_keys(node, sort, descending)))))


def after(hits: DataFrame, node: Node, cursor: tuple, sort: str, descending: bool = False) -> DataFrame:
    """The hits that come after a cursor. The first key's bound stands by itself, so it reaches the scan."""
    keys = _keys(node, sort, descending)
    first, down = keys[0]
    beyond, same = F.lit(False), F.lit(True)
    for (key, falls), value in zip(keys, cursor, strict=True):
        beyond = beyond | (same & ((key < value) if falls else (key > value)))
        same = same & (key == value)
    return hits.where(((first <= cursor[0]) if down else (first >= cursor[0])) & beyond)


def ordered(hits: DataFrame, node: Node, sort: str, descending: bool = False) -> DataFrame:
    return hits.orderBy(*order_keys(node, sort, descending))


def page(rows: DataFrame, limit: int = -1, offset: int = 0) -> DataFrame:
    """Rows from ``offset`` on, ``limit`` of them (all if under zero); with an order below it is a top-k, not a full sort."""
    if offset > 0:
        rows = rows.offset(offset)
    return rows.limit(limit) if limit >= 0 else rows


def deep_page(hits: DataFrame, keys: list[Column], limit: int, offset: int) -> DataFrame:
    """The same page for an offset far down: hits are sorted by range once, and the sizes of the ranges tell where it lies.

    No task keeps the rows before the page, as a top-k of offset + limit rows would.
    """
    place = numbered(hits, keys, "_place")
    held = place.where(F.col("_place").between(offset, offset + limit - 1) if limit >= 0 else F.col("_place") >= offset)
    return held.orderBy("_place").select(hits.columns)


def paged(hits: DataFrame, keys: list[Column], limit: int = -1, offset: int = 0) -> DataFrame:
    """A page of hits in order, by the way that suits its offset."""
    return deep_page(hits, keys, limit, offset) if offset > DEEP else page(hits.orderBy(*keys), limit, offset)


def cli_limits(n: int = 0, offset: int = 0) -> tuple[int, int]:
    """(limit, offset) as the command line has them: n under 1 means all; a negative offset skips nothing but takes that many off the page."""
    return max(0, n + min(offset, 0)) if n > 0 else -1, max(0, offset)


def cli_page(rows: DataFrame, n: int = 0, offset: int = 0) -> DataFrame:
    """A page of rows that are in order, by ``cli_limits``."""
    return page(rows, *cli_limits(n, offset))
