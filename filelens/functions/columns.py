"""Column functions: folding, names and paths, times and sizes. All are built-in expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(text: Column) -> Column:
    """ASCII letters in lower case; others, accented ones too, stay."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _last_dot(name: Column) -> Column:
    """1-based place of the last dot, 0 without one or if it comes first."""
    place = F.length(name) - F.instr(F.reverse(name), ".") + 1
    return F.when((F.instr(name, ".") > 0) & (place > 1), place).otherwise(0)


def extension(name: Column) -> Column:
    """What follows the last dot, unless the name begins with it; empty without one."""
    return F.when(_last_dot(name) > 0, F.substring_index(name, ".", -1)).otherwise("")


def stem(name: Column) -> Column:
    """The name without its extension and dot."""
    return F.when(_last_dot(name) > 0, name.substr(F.lit(1), _last_dot(name) - 1)).otherwise(name)


def slash_depth(path: Column) -> Column:
    """Slashes in a path, those at its end not counted."""
    trimmed = F.rtrim(path, F.lit("/"))
    return F.length(trimmed) - F.length(F.replace(trimmed, F.lit("/")))


def kind_label(is_dir: Column) -> Column:
    return F.when(is_dir, "dir").otherwise("file")


def rfc3339(seconds: Column) -> Column:
    """Local time of the session's zone, such as 2024-03-13T15:00:00+01:00; Z in UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ssXXX")


def short_time(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm")


#: Unit letters of human sizes, fixed values.
SIZE_UNITS = ("KB", "MB", "GB", "TB", "PB", "EB")


def human_size(size: Column, is_dir: Column) -> Column:
    """A size in the largest unit of 1024 that it fills, one decimal, halves to the even digit; <DIR> for folders; 9 wide."""
    text = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(SIZE_UNITS, 1):
        text = F.when(size >= 1 << 10 * power, F.format_string(f"%.1f {unit}", F.bround(size / float(1 << 10 * power), 1))).otherwise(text)
    return F.lpad(F.when(is_dir, "<DIR>").otherwise(text), 9, " ")


def join_path(parent: Column, name: Column) -> Column:
    """A child's path: a slash between, unless the parent's path ends in one."""
    return F.concat(parent, F.when(parent.endswith("/"), "").otherwise("/"), name)
