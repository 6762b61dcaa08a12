"""POSIX extended regular expressions, with the classes \\d \\D \\w \\W \\s \\S, as Java patterns.

Two passes. The first puts POSIX classes in the place of the shorthands; the second reads the POSIX expression and writes
the Java one. Only whether a text matches is ever asked, so the order in which alternatives are tried doesn't matter.

The second pass knows: ``.`` takes any code point, line ends included; ``$`` is the end of the text; a backslash inside
brackets is literal; a ``]`` that comes first in brackets is literal; a quantifier after a quantifier applies to the
whole before it; ``(?``, a quantifier without an operand and unclosed groups or brackets are errors; a closing
parenthesis without an opening one is literal.
"""

from __future__ import annotations

import re

from filelens.plans.nodes import QueryError

#: What the shorthands stand for; inside brackets the negated ones stand for the same as the plain ones. Fixed values.
SHORTHANDS = {"d": "0-9", "w": "[:alnum:]_", "s": "[:space:]"}

#: Java spelling of the POSIX classes in the C locale, fixed values.
CLASSES = {
    "alpha": "a-zA-Z",
    "digit": "0-9",
    "alnum": "a-zA-Z0-9",
    "upper": "A-Z",
    "lower": "a-z",
    "space": r" \t\n\x0B\f\r",
    "blank": r" \t",
    "punct": r"!-/:-@\[-`{-~",
    "print": r"\x20-\x7E",
    "graph": r"\x21-\x7E",
    "cntrl": r"\x00-\x1F\x7F",
    "xdigit": "0-9a-fA-F",
}

_MOST_REPEATS = 255
_INTERVAL = re.compile(r"\{(\d*)(?:(,)(\d*))?\}", re.A)


def without_shorthands(pattern: str) -> str:
    """The pattern with POSIX classes for \\d, \\w and \\s and their negations.

    Brackets are followed only as far as their first ``]`` that isn't the first character, so after a named class inside
    brackets the rest counts as outside; other escapes are kept as they are.
    """
    out, at, inside = [], 0, False
    while at < len(pattern):
        c, pair = pattern[at], pattern[at : at + 2]
        if c == "\\" and len(pair) == 2:
            at += 2
            body = SHORTHANDS.get(pair[1].lower())
            if body is None:
                out.append(pair)
            else:
                out.append(body if inside else f"[{'^' * pair[1].isupper()}{body}]")
            continue
        at += 1
        out.append(c)
        if not inside and c == "[":
            inside = True
            for first in "^]":
                if pattern[at : at + 1] == first:
                    out.append(first)
                    at += 1
        elif inside and c == "]":
            inside = False
    return "".join(out)


class _Posix:
    """Reads one expression from left to right."""

    def __init__(self, pattern: str):
        self.p, self.at = pattern, 0

    def more(self) -> bool:
        return self.at < len(self.p)

    def alternatives(self, depth: int) -> str:
        branches = [self.branch(depth)]
        while self.more() and self.p[self.at] == "|":
            self.at += 1
            branches.append(self.branch(depth))
        return "|".join(branches)

    def branch(self, depth: int) -> str:
        atoms: list[str] = []
        repeatable = False
        while self.more():
            c = self.p[self.at]
            if c == "|" or (c == ")" and depth):
                break
            quantifier = self.quantifier()
            if quantifier:
                if not repeatable:
                    raise QueryError("a repetition has nothing to repeat")
                atoms[-1] = f"(?:{atoms[-1]}){quantifier}"
                continue
            atoms.append(self.atom(depth))
            repeatable = atoms[-1] not in ("^", r"\z")
        return "".join(atoms)

    def quantifier(self) -> str:
        c = self.p[self.at]
        if c in "*+?":
            self.at += 1
            return c
        m = _INTERVAL.match(self.p, self.at) if c == "{" else None
        if not m or not (m[1] or m[3]):
            return ""
        low, high = int(m[1] or 0), m[1] if not m[2] else m[3]
        if low > _MOST_REPEATS or high and not low <= int(high) <= _MOST_REPEATS:
            raise QueryError("invalid repetition count")
        self.at = m.end()
        return f"{{{low}}}" if not m[2] else f"{{{low},{high}}}"

    def atom(self, depth: int) -> str:
        c = self.p[self.at]
        self.at += 1
        if c == "(":
            if self.p[self.at : self.at + 1] == "?":
                raise QueryError("a repetition has nothing to repeat")
            inner = self.alternatives(depth + 1)
            if not self.more():
                raise QueryError("a parenthesis isn't closed")
            self.at += 1
            return f"({inner})"
        if c == "[":
            return self.bracket()
        if c == "\\":
            if not self.more():
                raise QueryError("trailing backslash")
            c = self.p[self.at]
            self.at += 1
            if c in "123456789":
                return "\\" + c
            return {"b": r"\b", "B": r"\B", "<": r"\b(?=\w)", ">": r"\b(?<=\w)"}.get(c) or literal(c)
        return {".": ".", "^": "^", "$": r"\z"}.get(c) or literal(c)

    def bracket(self) -> str:
        negated = self.p[self.at : self.at + 1] == "^"
        self.at += negated
        items: list[str] = []
        first = True
        while True:
            if not self.more():
                raise QueryError("a bracket isn't closed")
            if self.p[self.at] == "]" and not first:
                self.at += 1
                return f"[{'^' * negated}{''.join(items)}]"
            first = False
            if self.p.startswith("[:", self.at):
                end = self.p.find(":]", self.at + 2)
                name = self.p[self.at + 2 : end] if end >= 0 else ""
                if name not in CLASSES:
                    raise QueryError("invalid character class")
                self.at = end + 2
                items.append(CLASSES[name])
                continue
            low = self.element()
            if self.p[self.at : self.at + 1] == "-" and self.p[self.at + 1 : self.at + 2] not in ("]", ""):
                self.at += 1
                high = self.element()
                if high < low:
                    raise QueryError("invalid range end")
                items.append(f"{escaped(low)}-{escaped(high)}")
            else:
                items.append(escaped(low))

    def element(self) -> str:
        """One character of a bracket, which may be written as [.c.] or [=c=]."""
        if self.p[self.at : self.at + 2] in ("[.", "[="):
            kind = self.p[self.at + 1]
            end = self.p.find(kind + "]", self.at + 3)
            if end != self.at + 3:
                raise QueryError("invalid collating element")
            self.at = end + 2
            return self.p[end - 1]
        self.at += 1
        return self.p[self.at - 1]


def literal(c: str) -> str:
    return "\\" + c if c in r"\^$.|?*+()[]{}" else c


def escaped(c: str) -> str:
    """A character inside a Java class."""
    return "\\" + c if c in r"\^[]&-~#" or c.isspace() and c in " " else c


def to_java(pattern: str, cased: bool) -> str:
    """A Java pattern that finds the same texts; raises QueryError for an invalid one. Case is folded for ASCII only."""
    try:
        body = _Posix(without_shorthands(pattern)).alternatives(0)
    except QueryError as e:
        raise QueryError(f'invalid regex "{pattern}": {e}') from None
    return ("(?s)" if cased else "(?s)(?i)") + body


def to_like(pattern: str) -> str:
    """A LIKE pattern (escape: backslash) for a wildcard that must match the whole text: * is any run, ? one code point."""
    return "".join({"*": "%", "?": "_"}.get(c) or ("\\" + c if c in "%_\\" else c) for c in pattern)


#: Letters, digits and everything outside ASCII belong to words; an underscore separates them.
WORD_CHARACTER = r"[A-Za-z0-9\x{80}-\x{10FFFF}]"


def whole_word(needle: str) -> str:
    """A Java pattern for the needle with no word character on either side."""
    quoted = "".join(literal(c) for c in needle)
    return f"(?s)(?<!{WORD_CHARACTER}){quoted}(?!{WORD_CHARACTER})"


def word_start(needle: str) -> str:
    """A Java pattern for the needle with no word character before it."""
    return f"(?s)(?<!{WORD_CHARACTER}){''.join(literal(c) for c in needle)}"
