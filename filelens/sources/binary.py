"""The binary index file and its journal, read and written.

An index file is a header of 192 bytes (magic of 4 bytes, version, generation, build time, counts of entries and names,
and the place of each of 10 sections) and its sections, each at a multiple of 8; all numbers are little-endian. A journal
is a magic, the generation that it belongs to, and entries A, R and U. The two magics are the caller's to name.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Version, header size, sections in their order, and the parent of a root. Fixed values of the format.
VERSION = 2
HEADER_SIZE = 192
SECTIONS = ("roots", "names", "name_offsets", "name_ids", "parents", "sizes", "modified", "created", "dirs", "unicode")
NO_PARENT = 0xFFFFFFFF
LATEST = 0xFFFFFFFF

#: Entries of a partition of the data source.
PART = 1_000_000


class CorruptIndex(ValueError):
    pass


@dataclass
class IndexFile:
    """Columns of an index file: ids are positions."""

    generation: int
    built_at: int
    roots: list[str]
    names: list[str]
    name_ids: np.ndarray
    parents: np.ndarray
    sizes: np.ndarray
    modified: np.ndarray
    created: np.ndarray
    dirs: np.ndarray

    def rows(self, begin: int = 0, end: int | None = None) -> Iterator[tuple]:
        """Base rows: (id, parent_id, name, is_dir, size, mtime, ctime)."""
        end = len(self.name_ids) if end is None else end
        columns = [c[begin:end].tolist() for c in (self.parents, self.name_ids, self.dirs, self.sizes, self.modified, self.created)]
        for k, (p, n, d, s, m, c) in enumerate(zip(*columns, strict=True), begin):
            yield k, -1 if p == NO_PARENT else p, self.names[n], bool(d), s, m, c


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[:n].astype(bool)


def decode(data: bytes, magic: bytes | None = None) -> IndexFile:
    """Raises CorruptIndex unless every rule of the format holds."""

    def need(ok: bool, what: str) -> None:
        if not ok:
            raise CorruptIndex(what)

    need(len(data) >= HEADER_SIZE and (magic is None or data[:4] == magic), "not an index file")
    need(struct.unpack_from("<I", data, 4)[0] == VERSION, "another version: build the index again")
    generation, built_at, n, d = struct.unpack_from("<QqII", data, 8)
    part = {}
    for k, name in enumerate(SECTIONS):
        at, size = struct.unpack_from("<QQ", data, 32 + 16 * k)
        need(at % 8 == 0 and at + size <= len(data), f"section {name} lies outside")
        part[name] = data[at : at + size]
    words = lambda k: 8 * ((k + 63) // 64)
    sizes = {"name_offsets": 4 * d, "name_ids": 4 * n, "parents": 4 * n, "sizes": 8 * n, "modified": 4 * n, "created": 4 * n, "dirs": words(n), "unicode": words(d)}
    for name, size in sizes.items():
        need(len(part[name]) == size, f"section {name} has the wrong length")
    need(not d or part["names"].endswith(b"\0"), "the names don't end")
    offsets = np.frombuffer(part["name_offsets"], "<u4").astype(np.int64)
    need(not d or bool(offsets[-1] < len(part["names"]) and (np.diff(offsets) > 0).all()), "name offsets don't ascend")
    name_ids, parents = np.frombuffer(part["name_ids"], "<u4"), np.frombuffer(part["parents"], "<u4")
    need(bool((name_ids < d).all()), "a name id is out of range")
    need(bool(((parents == NO_PARENT) | (parents < np.arange(n))).all()), "a parent doesn't precede its child")
    ends = np.append(offsets[1:], len(part["names"]))[:d]
    names = [part["names"][a:b].split(b"\0", 1)[0].decode("utf-8", "replace") for a, b in zip(offsets.tolist(), ends.tolist(), strict=True)]
    roots = [r.decode("utf-8", "replace") for r in part["roots"].split(b"\0")[:-1]]
    column = lambda name, kind: np.frombuffer(part[name], kind)
    return IndexFile(generation, built_at, roots, names, name_ids, parents, column("sizes", "<i8"), column("modified", "<u4"), column("created", "<u4"), _bits(part["dirs"], n))


def encode(rows: list[tuple], roots: list[str], generation: int, built_at: int, magic: bytes) -> bytes:
    """An index file from base rows in path order with ids 0, 1, 2 ...; times are clamped to 32 bits."""
    fold = lambda b: b.lower()  # noqa: E731  bytes: ASCII only
    encoded = [r[2].encode() for r in rows]
    names = sorted(set(encoded), key=lambda b: (fold(b), b))
    place = {b: k for k, b in enumerate(names)}
    bits = lambda flags: np.packbits(np.array([*flags, *[False] * (-len(flags) % 64)], bool), bitorder="little").tobytes()
    u4 = lambda values: np.array(values, "<u4").tobytes()
    clamp = lambda t: min(max(t, 0), LATEST)
    offsets = np.cumsum([0, *(len(b) + 1 for b in names[:-1])]) if names else []
    body = {
        "roots": b"".join(r.encode() + b"\0" for r in roots),
        "names": b"".join(b + b"\0" for b in names),
        "name_offsets": u4(offsets),
        "name_ids": u4([place[b] for b in encoded]),
        "parents": u4([NO_PARENT if r[1] < 0 else r[1] for r in rows]),
        "sizes": np.array([0 if r[3] else r[4] for r in rows], "<i8").tobytes(),
        "modified": u4([clamp(r[5]) for r in rows]),
        "created": u4([clamp(r[6]) for r in rows]),
        "dirs": bits([r[3] for r in rows]),
        "unicode": bits([any(c >= 0x80 for c in b) for b in names]),
    }
    head, out, at = struct.pack("<4sIQqII", magic, VERSION, generation, built_at, len(rows), len(names)), b"", HEADER_SIZE
    for name in SECTIONS:
        head += struct.pack("<QQ", at, len(body[name]))
        padded = body[name] + b"\0" * (-len(body[name]) % 8)
        out += padded
        at += len(padded)
    return head + out


_ADD, _REMOVE, _UPDATE = struct.Struct("<cIqqqBH"), struct.Struct("<cI"), struct.Struct("<cIqqq")


def journal_entries(data: bytes, generation: int, first_id: int, magic: bytes | None = None) -> tuple[list[tuple], int]:
    """(changes in the log's schema, length of the valid part). Another generation, or no header, gives none; a torn or unknown tail ends the log."""
    if len(data) < 12 or magic is not None and data[:4] != magic or struct.unpack_from("<Q", data, 4)[0] != generation:
        return [], 0
    out, at, added = [], 12, first_id
    while at < len(data):
        kind = data[at : at + 1]
        shape = {b"A": _ADD, b"R": _REMOVE, b"U": _UPDATE}.get(kind)
        if shape is None or at + shape.size > len(data):
            break
        _, key, *rest = shape.unpack_from(data, at)
        end = at + shape.size
        if kind == b"A":
            size, modified, created, folder, length = rest
            if end + length > len(data):
                break
            parent = -1 if key == NO_PARENT else key
            if parent >= added:
                raise CorruptIndex(f"a change names the unknown entry {parent}")
            out.append((len(out), "A", added, parent, size, modified, created, bool(folder), data[end : end + length].decode("utf-8", "replace")))
            added, end = added + 1, end + length
        else:
            if key >= added:
                raise CorruptIndex(f"a change names the unknown entry {key}")
            out.append((len(out), "R", key, *[None] * 6) if kind == b"R" else (len(out), "U", key, None, *rest, None, None))
        at = end
    return out, at


def journal_bytes(changes: list[tuple], generation: int | None = None, magic: bytes = b"") -> bytes:
    """Entries, after a header if a generation is given."""
    out = [magic + struct.pack("<Q", generation)] if generation is not None else []
    for _, op, key, parent, size, modified, created, folder, name in changes:
        if op == "A":
            data = name.encode()
            out.append(_ADD.pack(b"A", NO_PARENT if parent < 0 else parent, size, modified, created, folder, len(data)) + data)
        elif op == "R":
            out.append(_REMOVE.pack(b"R", key))
        else:
            out.append(_UPDATE.pack(b"U", key, size, modified, created))
    return b"".join(out)


@dataclass
class _Range(InputPartition):
    begin: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        with open(self.path, "rb") as f:
            n = struct.unpack_from("<I", f.read(32), 24)[0]
        return [_Range(k, min(k + PART, n)) for k in range(0, n, PART)] or [_Range(0, 0)]

    def read(self, part: _Range) -> Iterator[tuple]:
        yield from decode(Path(self.path).read_bytes()).rows(part.begin, part.end)


class IndexFileSource(DataSource):
    """``spark.read.format("indexfile").load(path)``: base rows."""

    @classmethod
    def name(cls) -> str:
        return "indexfile"

    def schema(self) -> str:
        return "id bigint, parent_id bigint, name string, is_dir boolean, size bigint, mtime bigint, ctime bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])
