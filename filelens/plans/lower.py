"""Query tree to Column. Everything becomes a built-in expression over stored columns, so Catalyst prunes, reorders and
pushes down as usual: no UDF, and wildcards as LIKE, which Catalyst turns into prefix, suffix and contains tests."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from filelens.plans import nodes, parser, regex
from filelens.plans.nodes import REGEX, SUBSTRING, WHOLE_NAME, WHOLE_WORD, WILDCARD, And, Between, Custom, Extensions, Kind, Node, Not, Or, Text, Under

#: Columns of the range filters.
FIELDS = {"size": "size", "dm": "mtime", "dc": "ctime", "len": "name_len", "depth": "slash_depth"}


@dataclass(frozen=True)
class Folder:
    """A folder that a query names, found in the index."""

    id: int
    root_id: int
    path: str


Resolve = Callable[[str], Folder | None]

_predicates: dict[str, Callable[[str], Column]] = {}


def register_predicate(key: str, predicate: Callable[[str], Column]) -> None:
    """Adds ``key:argument`` to the language; ``predicate(argument)`` gives its condition over the entries' columns."""
    parser.add_key(key)
    _predicates[nodes.fold(key)] = predicate


def _text(n: Text) -> Column:
    column = F.col(("path" if n.on_path else "name") + ("" if n.cased else "_fold"))
    needle = n.text if n.cased else nodes.fold(n.text)
    match n.mode:
        case nodes.SUBSTRING:
            return column.contains(needle)
        case nodes.WHOLE_NAME:
            return column == needle
        case nodes.WILDCARD:
            return column.like(regex.to_like(needle))
        case nodes.WHOLE_WORD:
            return column.rlike(regex.whole_word(needle))
    return F.col("path" if n.on_path else "name").rlike(regex.to_java(n.text, n.cased))


def _under(n: Under, resolve: Resolve) -> Column:
    folder = resolve(n.path)
    if folder is None:
        return F.lit(False)
    if not n.deep:
        return F.col("parent_id") == folder.id
    prefix = folder.path if folder.path.endswith("/") else folder.path + "/"
    # Stored entries are in the order of folded paths: their range prunes row groups, the path itself tells twins apart.
    in_range = F.col("path_fold").startswith(nodes.fold(prefix))
    return in_range & (F.col("root_id") == folder.root_id) & F.col("path").startswith(prefix) & (F.col("id") != folder.id)


#: What a predicate costs per row, about; cheap ones are tested first.
_COST = {SUBSTRING: 3, WHOLE_NAME: 2, WILDCARD: 4, WHOLE_WORD: 8, REGEX: 9}


def cost(n: Node) -> int:
    match n:
        case And(kids) | Or(kids):
            return sum(map(cost, kids))
        case Not(kid):
            return cost(kid)
        case Text():
            return _COST[n.mode] + n.on_path
        case Extensions() | Custom():
            return 2
    return 1


def lower(n: Node, resolve: Resolve) -> Column:
    """The condition of a query tree. ``resolve`` finds a folder by its path (one point query on the driver), or None."""
    match n:
        case And(kids):
            return functools.reduce(operator.and_, (lower(k, resolve) for k in sorted(kids, key=cost)), F.lit(True)) if kids else F.lit(True)
        case Or(kids):
            return functools.reduce(operator.or_, (lower(k, resolve) for k in sorted(kids, key=cost)))
        case Not(kid):
            return ~lower(kid, resolve)
        case Text():
            return _text(n)
        case Extensions(any_of):
            return F.col("ext_fold").isin(*any_of) if any_of else F.lit(False)
        case Between(field, low, high):
            column = F.col(FIELDS[field])
            bounds = [column >= low] * (low > nodes.LOW) + [column <= high] * (high < nodes.HIGH)
            if low == high:
                return column == low
            return functools.reduce(operator.and_, bounds) if bounds else F.lit(True)
        case Kind(folder):
            return F.col("is_dir") if folder else ~F.col("is_dir")
        case Under():
            return _under(n, resolve)
        case Custom(key, argument):
            return _predicates[key](argument)
    raise TypeError(n)


def relevance(terms: list[str]) -> Column:
    """Sum over the terms of 4 for the whole name or stem, 3 for its beginning, 2 for a word's beginning, 1 for elsewhere."""
    name, stem = F.col("name_fold"), F.col("stem_fold")
    of = lambda t: F.when((name == t) | (stem == t), 4).when(name.startswith(t), 3).when(name.rlike(regex.word_start(t)), 2).when(name.contains(t), 1).otherwise(0)
    return functools.reduce(operator.add, map(of, terms), F.lit(0))


__all__ = ["Folder", "Resolve", "cost", "lower", "register_predicate", "relevance", "SUBSTRING", "WHOLE_NAME", "WHOLE_WORD", "WILDCARD", "REGEX"]
