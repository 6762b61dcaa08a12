"""What a scan leaves out: globs on names, and globs or plain paths with all below them."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

_META = re.compile(r"[*?\[]")


def glob_pattern(glob: str) -> str:
    """A pattern (Python and Java alike) for a glob: ``*`` and ``?`` stay within a component, ``**`` is any number of them."""
    out, at = [], 0
    while at < len(glob):
        rest = glob[at:]
        if rest.startswith("**/") and (at == 0 or glob[at - 1] == "/"):
            out.append("(?:[^/]*/)*")
            at += 3
        elif rest.startswith("**"):
            out.append("[\\s\\S]*")
            at += 2
        elif rest[0] == "*":
            out.append("[^/]*")
            at += 1
        elif rest[0] == "?":
            out.append("[^/]")
            at += 1
        elif rest[0] == "[":
            end = glob.find("]", at + 2 + (glob[at + 1 : at + 2] in ("!", "^")))
            if end < 0:
                raise ValueError(f"invalid pattern: {glob}")
            body = glob[at + 1 : end]
            negated = body[:1] in ("!", "^")
            inner = re.sub(r"([\\\[\]^&~])", r"\\\1", body[negated:])
            out.append(f"[{'^' * negated}{inner}]")
            at = end + 1
        elif rest[0] == "\\" and len(rest) > 1:
            out.append(re.escape(rest[1]))
            at += 2
        else:
            out.append(re.escape(rest[0]))
            at += 1
    return "".join(out)


def glob_match(glob: str, text: str) -> bool:
    return re.fullmatch(glob_pattern(glob), text, re.S) is not None


@dataclass(frozen=True)
class Excludes:
    """Patterns without a slash match names; the others match paths and what is below them."""

    names: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()

    @classmethod
    def of(cls, patterns: list[str], home: str | None = None) -> Excludes:
        """``~`` at the beginning is the home directory; slashes at the end don't count. Raises ValueError for a bad glob."""
        home = os.path.expanduser("~") if home is None else home
        full = [home + p[1:] if p == "~" or p.startswith("~/") else p for p in patterns if p]
        trimmed = [p.rstrip("/") or "/" for p in full]
        for p in trimmed:
            re.compile(glob_pattern(p))
        return cls(tuple(p for p in trimmed if "/" not in p), tuple(p for p in trimmed if "/" in p))

    def _path_pattern(self, p: str) -> str:
        if _META.search(p):
            return f"{glob_pattern(p)}(?:/[\\s\\S]*)?"
        return "/[\\s\\S]*" if p == "/" else f"{re.escape(p)}(?:/[\\s\\S]*)?"

    @cached_property
    def patterns(self) -> tuple[str, str]:
        """One anchored pattern for names and one for paths, empty where there is nothing to match."""
        union = lambda parts: f"^(?:{'|'.join(parts)})$" if parts else ""
        return union([glob_pattern(p) for p in self.names]), union([self._path_pattern(p) for p in self.paths])

    def match(self, path: str, name: str) -> bool:
        return any(p and re.search(p.removesuffix("$") + r"\Z", text) for p, text in zip(self.patterns, (name, path), strict=True))

    def column(self, path: Column, name: Column) -> Column:
        """The same test over columns."""
        out = F.lit(False)
        for p, text in zip(self.patterns, (name, path), strict=True):
            if p:
                out = out | text.rlike("(?s)" + p.removesuffix("$") + r"\z")
        return out
