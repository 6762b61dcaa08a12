"""Result lines: plain, JSON and CSV, as column expressions; and the writers that stream them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelens.functions import columns as C

CSV_HEADER = "path,name,type,size,modified,created"
#: Terminal codes for folders, fixed values.
BLUE, PLAIN = "\x1b[1;34m", "\x1b[0m"


@dataclass(frozen=True)
class Lines:
    """How results are written: format is plain, json or csv."""

    format: str = "plain"
    size: bool = False
    modified: bool = False
    created: bool = False
    name_only: bool = False
    null_separated: bool = False
    color: bool = False


def json_line() -> Column:
    """One object; ``created`` is left out where it is unknown."""
    created = F.when(F.col("ctime") != 0, C.rfc3339(F.col("ctime")))
    return F.to_json(F.struct("path", "name", C.kind_label(F.col("is_dir")).alias("type"), "size", C.rfc3339(F.col("mtime")).alias("modified"), created.alias("created")))


def csv_field(text: Column) -> Column:
    """Quoted where it begins with a space or holds a comma, a quote or a line end; quotes inside are doubled."""
    return F.when(text.rlike('^ |[,"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line() -> Column:
    created = F.when(F.col("ctime") != 0, C.rfc3339(F.col("ctime"))).otherwise("")
    return F.concat_ws(",", csv_field(F.col("path")), csv_field(F.col("name")), C.kind_label(F.col("is_dir")), F.col("size").cast("string"), C.rfc3339(F.col("mtime")), created)


def plain_line(o: Lines) -> Column:
    text = F.col("name" if o.name_only else "path")
    if o.color:
        text = F.when(F.col("is_dir"), F.concat(F.lit(BLUE), text, F.lit(PLAIN))).otherwise(text)
    parts = []
    if o.size:
        parts.append(C.human_size(F.col("size"), F.col("is_dir")))
    if o.modified:
        parts.append(C.short_time(F.col("mtime")))
    if o.created:
        parts.append(F.when(F.col("ctime") != 0, C.short_time(F.col("ctime"))).otherwise(" " * 16))
    return F.concat_ws("  ", *parts, text)


def written(rows: DataFrame, o: Lines = Lines()) -> Iterator[str]:  # noqa: B008
    """The whole output in pieces, a partition of rows at a time on the driver."""
    if o.format == "plain":
        end = "\0" if o.null_separated else "\n"
        for r in rows.select(plain_line(o).alias("line")).toLocalIterator():
            yield r.line + end
    elif o.format == "csv":
        yield CSV_HEADER + "\n"
        for r in rows.select(csv_line().alias("line")).toLocalIterator():
            yield r.line + "\n"
    else:
        between = "["
        for r in rows.select(json_line().alias("line")).toLocalIterator():
            yield f"{between}\n  {r.line}"
            between = ","
        yield "[]\n" if between == "[" else "\n]\n"
