"""Change logs over entries: last state, snapshot derivation, diff, compaction.

A log has (seq, op, id, parent_id, size, mtime, ctime, is_dir, name): A adds an entry, R removes one, U replaces size and
times. The last change of an id wins, which one aggregation decides (max_by combines before the exchange, so an id with
many changes is one record per task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelens.operators.numbering import numbered
from filelens.operators.tree import orphan_sweep
from filelens.schema import BASE_COLUMNS, ROOT_PARENT

LOG_SCHEMA = "seq bigint, op string, id bigint, parent_id bigint, size bigint, mtime bigint, ctime bigint, is_dir boolean, name string"

#: Compaction is due at this many changes, or at one in SHARE of the live entries if that is more.
LEAST_CHANGES, SHARE = 10_000, 100


def last_change(log: DataFrame, key: str = "id") -> DataFrame:
    """The change with the greatest ``seq`` of each key."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), "seq").alias("last")).select(key, "last.*")


def last_state(log: DataFrame, key: str = "id") -> DataFrame:
    """Keys whose last change isn't a removal, with it."""
    return last_change(log, key).where(F.col("op") != "R")


def net_changes(log: DataFrame) -> DataFrame:
    """One change per id, as (op, base columns): A is added or replaced and has its final values, R is gone, U has the last size and times.

    An update counts only after the last time its id was added; before it, it was another entry's. All of it is one
    aggregation, combined before the exchange. ``seq`` may be a number or a struct of numbers.
    """
    when = lambda op, value: F.when(F.col("op") == op, value)
    at = F.col("seq")
    last = log.groupBy("id").agg(
        F.max_by(when("A", F.struct("parent_id", "name", "is_dir", "size", "mtime", "ctime")), when("A", at)).alias("a"),
        F.max(when("A", at)).alias("added"),
        F.max(when("R", at)).alias("removed"),
        F.max_by(when("U", F.struct("size", "mtime", "ctime")), when("U", at)).alias("u"),
        F.max(when("U", at)).alias("updated"),
    )
    gone = F.col("removed").isNotNull() & (F.col("added").isNull() | (F.col("removed") > F.col("added")))
    counts = F.col("updated").isNotNull() & (F.col("added").isNull() | (F.col("updated") > F.col("added")))
    laid = lambda c: F.coalesce(F.when(counts, F.col(f"u.{c}")), F.col(f"a.{c}")).alias(c)
    op = F.when(gone, "R").when(F.col("added").isNotNull(), "A").otherwise("U")
    return last.select(op.alias("op"), "id", "a.parent_id", "a.name", "a.is_dir", laid("size"), laid("mtime"), laid("ctime"))


def laid_over(base: DataFrame, net: DataFrame) -> DataFrame:
    """Base rows after net changes."""
    over = net.select(F.col("id").alias("_id"), F.col("op").alias("_op"), *(F.col(c).alias(f"_{c}") for c in ("size", "mtime", "ctime")))
    kept = base.select(BASE_COLUMNS).join(over, F.col("id") == F.col("_id"), "left").where("_op is null or _op = 'U'")
    left = kept.select("id", "parent_id", "name", "is_dir", *(F.coalesce(f"_{c}", c).alias(c) for c in ("size", "mtime", "ctime")))
    return left.unionByName(net.where("op = 'A'").select(BASE_COLUMNS))


def apply_log(base: DataFrame, log: DataFrame) -> DataFrame:
    """Base rows after a log: one join with the net changes. Children of removed folders stay until a sweep."""
    return laid_over(base, net_changes(log))


def added(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows whose ids only the later snapshot has."""
    return after.join(before.select("id"), "id", "left_anti")


def removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows whose ids only the earlier snapshot has."""
    return before.join(after.select("id"), "id", "left_anti")


def diff(before: DataFrame, after: DataFrame, first_seq: int = 0) -> DataFrame:
    """A log that turns the one snapshot into the other; removals first, then adds parents first, then updates."""
    null = lambda kind: F.lit(None).cast(kind)
    a = added(before, after).select(F.lit("A").alias("op"), "id", "parent_id", "size", "mtime", "ctime", "is_dir", "name")
    r = removed(before, after).select(F.lit("R").alias("op"), "id", *(null(k).alias(c) for c, k in (("parent_id", "bigint"), ("size", "bigint"), ("mtime", "bigint"), ("ctime", "bigint"), ("is_dir", "boolean"), ("name", "string"))))
    old = before.select("id", *(F.col(c).alias(f"_{c}") for c in ("size", "mtime", "ctime")))
    changed = after.join(old, "id").where("size <> _size or mtime <> _mtime or ctime <> _ctime")
    u = changed.select(F.lit("U").alias("op"), "id", null("bigint").alias("parent_id"), "size", "mtime", "ctime", null("boolean").alias("is_dir"), null("string").alias("name"))
    rank = F.when(F.col("op") == "R", 0).when(F.col("op") == "A", 1).otherwise(2)
    return numbered(r.unionByName(a).unionByName(u), [rank, F.col("id")], "seq", first_seq)


def compact(rows: DataFrame, dead: DataFrame | None = None) -> DataFrame:
    """One snapshot of live entries in path order with dense new ids; entries below dead ones go too. ``rows`` have paths."""
    live = orphan_sweep(rows, dead) if dead is not None else rows
    new = numbered(live.select("id", "path_fold", "name_fold", "name"), [F.col(c) for c in ("path_fold", "name_fold", "name", "id")], "new_id").select("new_id", F.col("id").alias("_old"))
    own = live.join(new, live.id == new._old).drop("_old")
    parent = new.select(F.col("new_id").alias("_new_parent"), F.col("_old").alias("_old_parent"))
    moved = own.join(parent, own.parent_id == parent._old_parent, "left").withColumns({"parent_id": F.coalesce("_new_parent", F.lit(ROOT_PARENT).cast("bigint")), "id": F.col("new_id")})
    return moved.select(BASE_COLUMNS)


def compaction_due(changes: int, live: int) -> bool:
    return changes >= max(LEAST_CHANGES, live // SHARE)
