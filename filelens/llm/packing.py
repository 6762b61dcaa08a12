"""Packing: token sequences filled by harmonic classes.

Class k holds the documents with capacity/(k+1) < length <= capacity/k, whole, and a bin of class k takes exactly k of
them: the harmonic rule. What such a bin leaves over, less than 1/(k+1) of it, is filled from one document that is held
aside for this, the only kind that is cut: a document longer than the capacity, as long as there is one, else the next
that comes. Of a longer document that isn't held aside, whole sequences are cut off and the rest goes into its class.

Every task packs its own rows, so nothing is shuffled and no task waits for another. When a task ends, the bins that are
not full are poured together and cut again at the capacity; the last of them is cut at powers of two, which need no
padding. A task has a number of its own in the high bits of ``sequence_id``. It holds less than one bin per class and one
document.

Edge cases: a null or empty text has the end id alone. A null id stays null. Repeated rows are packed once each. An
empty table gives no pieces. Other columns are ignored. A text of any length is encoded whole, with runs of white space of
any length; its ids are held once.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelens.llm._common import map_rows, table

CAPACITY = 1024
#: Runs of white space of this length and more don't go to tiktoken, whose search for their end takes stack for each character.
LONG_RUN = 100_000

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

#: Unicode White_Space, as the pre-tokenizer's \s has it. Fixed values.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A long run and the word after it. No pre-token crosses from another character to white space, so a text may be cut there.
_LONG = re.compile(f"((?<![{_WS}])[{_WS}]{{{LONG_RUN},}}+[^{_WS}]*)")


def byte_of_char() -> dict[str, int]:
    """Byte-level BPE's printable stand-ins: bytes that print stand for themselves, the others for U+0100 and up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Ids:
    """The ids of a tokenizer file (byte-level BPE of the library ``tokenizers``) as little-endian 32-bit bytes.

    The file's merges are run by tiktoken, which takes the lowest id first; that is the same order as the file's, and is
    checked when the file is read. White space of LONG_RUN characters and more, with the word after it, goes to the
    library ``tokenizers``. The file's added tokens are found in the texts and keep their own ids.
    """

    def __init__(self, tokenizer_path: str, pattern: str | None = None):
        import json

        import public_tokenizers
        import tiktoken

        with open(tokenizer_path, encoding="utf-8") as f:
            file = json.load(f)
        model, added = file["model"], file.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{tokenizer_path}: added tokens that take in white space or stand as words alone aren't supported")
        byte, vocab = byte_of_char(), model["vocab"]
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{tokenizer_path}: the merges aren't in the order of their ids")
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if i <= merged[-1] and all(c in byte for c in t)}
        self.encode = tiktoken.Encoding("file", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.path = tokenizer_path
        self.added = {t["content"]: packed([t["id"]]) for t in added}
        # The longest first among those that begin at the same place.
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None

    def of(self, text: str) -> bytes:
        """Texts are cut at the file's added tokens, which keep their own ids; the parts between are encoded apart."""
        if self.marks is None or not self.marks.search(text):
            return self._plain(text)
        return b"".join(self.added[x] if k % 2 else self._plain(x) for k, x in enumerate(self.marks.split(text)) if x)

    def _plain(self, text: str) -> bytes:
        if len(text) < LONG_RUN:
            return packed(self.encode(text))
        return b"".join(packed(self.library.encode(x, add_special_tokens=False).ids if k % 2 else self.encode(x)) for k, x in enumerate(_LONG.split(text)) if x)

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = True  # those in the text are cut out before
        return found


@lru_cache(maxsize=2)
def ids_of(tokenizer_path: str) -> Ids:
    """One for all tasks of a worker."""
    return Ids(tokenizer_path)


class HarmonicPacker:
    """Puts whole documents into bins: class k = capacity // length, k documents to a bin, and a cut from the one held aside."""

    def __init__(self, capacity: int = CAPACITY, first_sequence: int = 0):
        self.capacity, self.sequence = capacity, first_sequence
        self.bins: dict[int, list[tuple]] = {}
        #: what is left of the document held aside: (doc_id, start, ids, total) or None
        self.aside: tuple | None = None
        #: a bin with its count of documents that waits to be filled
        self.short: list[tuple] = []

    def __call__(self, row: tuple) -> Iterator[tuple]:
        """row: (doc_id, ids as bytes)."""
        doc_id, ids = row
        total = len(ids) // 4
        if self.aside is None and (self.short or total > self.capacity):
            self.aside = (doc_id, 0, ids, total)
            if self.short:
                yield from self._fill()
            return
        whole = (total - 1) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            yield from self._close([(doc_id, start, ids[4 * start : 4 * (start + self.capacity)], total)])
        k = self.capacity // (total - whole)
        held = self.bins.setdefault(k, [])
        held.append((doc_id, whole, ids[4 * whole :], total))
        if len(held) == k:
            self.short = self.bins.pop(k)
            yield from self._fill()

    def _fill(self) -> Iterator[tuple]:
        """Closes the short bin if the document held aside fills it."""
        room = self.capacity - sum(len(x[2]) // 4 for x in self.short)
        if room and self.aside:
            doc_id, start, ids, total = self.aside
            n = min(room, len(ids) // 4)
            self.short.append((doc_id, start, ids[: 4 * n], total))
            self.aside = (doc_id, start + n, ids[4 * n :], total) if 4 * n < len(ids) else None
            room -= n
        if not room:
            bin_, self.short = self.short, []
            yield from self._close(bin_)

    def _close(self, held: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc_id, start, ids, total in held:
            n = len(ids) // 4
            yield doc_id, start, n, zlib.crc32(ids), total, self.sequence, at
            at += n
        self.sequence += 1

    def finish(self) -> Iterator[tuple]:
        """The bins that are not full: poured together, cut at the capacity, the last at powers of two."""
        rest = deque(self.short + [x for k in sorted(self.bins) for x in self.bins[k]] + ([self.aside] if self.aside else []))
        left = sum(len(x[2]) // 4 for x in rest)
        self.bins, self.short, self.aside = {}, [], None
        while rest:
            size = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            held, room = [], size
            while room:
                doc_id, start, ids, total = rest.popleft()
                n = min(room, len(ids) // 4)
                held.append((doc_id, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    rest.appendleft((doc_id, start + n, ids[4 * n :], total))
                room -= n
            left -= size
            yield from self._close(held)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""

    class Step:
        def __init__(self) -> None:
            self.ids = ids_of(tokenizer_path)
            self.packer = HarmonicPacker(capacity, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40)

        def __call__(self, row: tuple) -> Iterable[tuple]:
            return self.packer((row[0], self.ids.of(row[1] or "") + end_id.to_bytes(4, "little")))

        def finish(self) -> Iterable[tuple]:
            return self.packer.finish()

    return map_rows(docs.select(F.col(id_col).cast("bigint"), text_col), SCHEMA, Step)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
