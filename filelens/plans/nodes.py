"""The query tree: what a query asks for, before it meets any data."""

from __future__ import annotations

from dataclasses import dataclass

#: Bounds of a 64-bit range.
LOW, HIGH = -(1 << 63), (1 << 63) - 1

SUBSTRING, WILDCARD, REGEX, WHOLE_WORD, WHOLE_NAME = "sub", "glob", "re", "ww", "wfn"


class QueryError(ValueError):
    """A query, value or pattern that can't be understood."""


class Node:
    """A predicate over one entry."""


@dataclass(frozen=True)
class And(Node):
    kids: tuple[Node, ...] = ()  # none: everything matches

    def __str__(self) -> str:
        return f"and({' '.join(map(str, self.kids))})"


@dataclass(frozen=True)
class Or(Node):
    kids: tuple[Node, ...]

    def __str__(self) -> str:
        return f"or({' '.join(map(str, self.kids))})"


@dataclass(frozen=True)
class Not(Node):
    kid: Node

    def __str__(self) -> str:
        return f"not({self.kid})"


@dataclass(frozen=True)
class Text(Node):
    text: str
    mode: str = SUBSTRING
    cased: bool = False
    on_path: bool = False

    def __str__(self) -> str:
        return f"{self.mode}{'+case' * self.cased}{'+path' * self.on_path}:{self.text}"


@dataclass(frozen=True)
class Extensions(Node):
    any_of: tuple[str, ...]

    def __str__(self) -> str:
        return "ext" + ":" * bool(self.any_of) + ",".join(self.any_of)


@dataclass(frozen=True)
class Between(Node):
    """field: size, dm, dc, len or depth."""

    field: str
    low: int
    high: int

    def __str__(self) -> str:
        return self.field if self.field in ("dm", "dc") else f"{self.field}[{self.low},{self.high}]"


@dataclass(frozen=True)
class Kind(Node):
    folder: bool

    def __str__(self) -> str:
        return "dir" if self.folder else "file"


@dataclass(frozen=True)
class Under(Node):
    """Entries below a folder: its children, or all of its descendants."""

    path: str
    deep: bool

    def __str__(self) -> str:
        return f"{'infolder' if self.deep else 'parent'}:{self.path}"


@dataclass(frozen=True)
class Custom(Node):
    """A predicate registered from outside, with its argument."""

    key: str
    argument: str

    def __str__(self) -> str:
        return f"{self.key}:{self.argument}"


EVERYTHING = And()


def restrict(node: Node, path: str = "", files: bool = False, folders: bool = False) -> Node:
    """The query narrowed to a folder and to files or folders; an empty path narrows nothing."""
    more = [Under(path, True)] * bool(path) + [Kind(False)] * files + [Kind(True)] * folders
    return And((node, *more)) if more else node


def plain_terms(node: Node) -> list[str]:
    """Words that count for relevance: text on names outside negation that is neither wildcard nor regex, folded."""
    if isinstance(node, (And, Or)):
        return [t for kid in node.kids for t in plain_terms(kid)]
    if isinstance(node, Text) and not node.on_path and node.mode not in (WILDCARD, REGEX):
        return [fold(node.text)]
    return []


def fold(text: str) -> str:
    """ASCII letters in lower case; nothing else changes."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
