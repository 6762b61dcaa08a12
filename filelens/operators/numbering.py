"""Dense numbers in a total order, without a window and without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelens.storage import settled

#: Spark's own numbers hold the partition above this many bits and the row's place in it below.
_PLACE_BITS = 33


def numbered(rows: DataFrame, order: list[Column], name: str, first: int = 0) -> DataFrame:
    """``rows`` with dense numbers from ``first`` on in the order of the sort keys, ties in any order.

    One range exchange: rows are sorted by range and settled with their partition and place. The sizes of the partitions
    (one number each, on the driver) give the first number of each, to which the place is added.
    """
    held = settled(rows.sort(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _PLACE_BITS)
    start, firsts = first, []
    for part_id, n in sorted(held.groupBy(part.alias("part")).count().collect()):
        firsts.append((part_id, start))
        start += n
    offsets = rows.sparkSession.createDataFrame(firsts, "_part bigint, _first bigint")
    out = held.join(F.broadcast(offsets), part == F.col("_part")).withColumn(name, F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)))
    return out.select(name, *[c for c in rows.columns if c != name])
