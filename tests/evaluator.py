"""Row-at-a-time evaluation of query trees in plain Python: the oracle for random queries."""

from __future__ import annotations

import re

from filelens.plans import nodes
from filelens.plans.nodes import And, Between, Extensions, Kind, Not, Or, Text, Under, fold

_WORD = r"[A-Za-z0-9-\U0010ffff]"


def like(pattern: str, text: str) -> bool:
    return re.fullmatch("".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in pattern), text, re.S) is not None


def matches(node, row: dict, folder=lambda path: None) -> bool:
    match node:
        case And(kids):
            return all(matches(k, row, folder) for k in kids)
        case Or(kids):
            return any(matches(k, row, folder) for k in kids)
        case Not(kid):
            return not matches(kid, row, folder)
        case Extensions(any_of):
            name = fold(row["name"])
            return (name.rpartition(".")[2] if "." in name[1:] else "") in any_of
        case Kind(is_folder):
            return row["is_dir"] == is_folder
        case Between(field, low, high):
            value = {"size": row["size"], "dm": row["mtime"], "dc": row["ctime"], "len": len(row["name"]), "depth": row["path"].rstrip("/").count("/")}[field]
            return low <= value <= high
        case Under(path, deep):
            found = folder(path)
            if found is None:
                return False
            return row["path"].startswith(found["path"].rstrip("/") + "/") if deep else row["parent_id"] == found["id"]
        case Text(text, mode, cased, on_path):
            hay = row["path" if on_path else "name"]
            if not cased:
                text, hay = fold(text), fold(hay)
            return {
                nodes.SUBSTRING: lambda: text in hay,
                nodes.WHOLE_NAME: lambda: text == hay,
                nodes.WILDCARD: lambda: like(text, hay),
                nodes.WHOLE_WORD: lambda: re.search(f"(?<!{_WORD}){re.escape(text)}(?!{_WORD})", hay) is not None,
            }[mode]()
    raise TypeError(node)
