"""SentencePiece encoding and decoding as a weighted finite-state transducer, for models of kind BPE with byte fallback.

Three machines are compiled from a model file. The normaliser writes a mark at the beginning and for each space. The
lexicon is a trie whose arcs read the characters of the pieces and at whose ends a piece is written; the byte pieces are
256 more of its arcs, each of which reads a byte and writes its piece. A text is read as a sequence of labels: a character that
occurs in the pieces is its own label, any other is the labels of its UTF-8 bytes (the surrogates U+DC00 to U+DCFF, which
no valid text contains). Normaliser and lexicon are composed when the model is read. The grammar has a state for each piece; its arc from s to t weighs nothing if BPE itself splits the text of
s followed by t into s and t, else infinity. A sequence of pieces is what BPE makes of a text exactly if all its
neighbours are so, so the shortest path through input o normaliser o lexicon o grammar is the model's own encoding, and it
is the only one of finite weight. Arcs of the grammar are weighed when a path first asks for them, from the merges that make
their two pieces, and kept.

Decoding runs the composition of normaliser and lexicon inverted: its arcs read pieces and write labels. From a state of the
inverted machine every piece is reached over arcs that read nothing, so these are removed once, by the lightest path to each
piece, and an id is then one arc that writes the labels of its piece. A mark could come from a space or a mark; the
normaliser weighs a mark that is kept, so the inverse writes a space. Bytes that are part of no character give U+FFFD each.

The composition with a text isn't written out. Its states are (position, state of the lexicon, last piece), and the
shortest path is found by settling them in the order of their weight, of equal weights the furthest first: the lexicon is
walked along the text from a state's position, and the pieces written on the way, the longest first, are relaxed by
(min, +) over the grammar's arcs to them. Only the arcs that the search meets before the end are weighed. A path of finite
weight to a position is the only one, being the encoding of the text up to there, so no position is met twice.
Between two characters that are neighbours in no piece no arc spans, so the parts of a text between such places are
composed apart; words and their parts are remembered by each worker (MEMO of each, in two generations).

Edge cases: null and empty texts have no ids and decode to the empty text. A mark in the text decodes to a space, as the
model has it. Repeated rows are encoded alike; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelens.llm._common import Memo, map_rows, table
from filelens.llm._wfst import EPS, INFINITE, Machine, compose, invert, lightest_writings

MARK = "\u2581"
MEMO = 300_000
#: Arcs of the grammar that a worker keeps at most.
ARCS = 500_000
#: The rank of what isn't a piece.
NEVER = 1 << 40

#: Kinds of pieces and fields of the model file, fixed values.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_KIND = 1, 2, 3
MODEL_KIND, BPE, BYTE_FALLBACK = 3, 2, 35
RULES, DUMMY_PREFIX, DROP_SPACES = 2, 3, 4

UNKNOWN_TEXT = " \u2047 "

#: The label of a byte that is no part of a known character.
BYTE_LABELS = [chr(0xDC00 + b) for b in range(256)]

codecs.register_error("each_byte_apart", lambda error: ("\ufffd", error.start + 1))


def label_bytes(labels: str) -> bytes:
    """The UTF-8 bytes that a sequence of labels stands for."""
    return b"".join(bytes([ord(x) - 0xDC00]) if "\udc00" <= x <= "\udcff" else x.encode() for x in labels)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + size]
        at += size


def normaliser(characters: set[str], prefix: bool) -> Machine:
    """Writes a mark for each space, other labels as they are, and a mark at the beginning if ``prefix``. A mark that is read weighs 1."""
    m = Machine()
    inner = m.state() if prefix else m.start
    if prefix:
        m.arc(m.start, EPS, MARK, 0.0, inner)
    for c in sorted(characters):
        m.arc(inner, c, c, float(c == MARK), inner)
    m.arc(inner, " ", MARK, 0.0, inner)
    m.finals[inner] = 0.0
    return m


def lexicon(pieces: Iterable[str], weights: dict[str, float] | None = None) -> Machine:
    """A trie that reads characters and writes a piece where it ends, back at the root; each character is a piece of its own too."""
    m = Machine()
    m.finals[m.start] = 0.0
    node = {"": m.start}
    every = set(pieces)
    for piece in sorted(every | {c for p in every for c in p}):
        for k in range(1, len(piece) + 1):
            if piece[:k] not in node:
                node[piece[:k]] = m.state()
                m.arc(node[piece[: k - 1]], piece[k - 1], EPS, 0.0, node[piece[:k]])
        m.arc(node[piece], EPS, piece, (weights or {}).get(piece, 0.0), m.start)
    return m


class Transducer:
    """The compiled machines of a model file."""

    def __init__(self, model_path: str):
        with open(model_path, "rb") as f:
            parts = list(fields(f.read()))
        pieces = [dict(fields(v)) for n, v in parts if n == PIECES]
        trainer = dict(fields(b"".join(v for n, v in parts if n == TRAINER)))
        rules = dict(fields(b"".join(v for n, v in parts if n == NORMALIZER)))
        if trainer.get(MODEL_KIND) != BPE or not trainer.get(BYTE_FALLBACK) or rules.get(RULES) or rules.get(DROP_SPACES, 1):
            raise ValueError(f"{model_path}: only BPE with byte fallback and without character rules is compiled")
        self.prefix = MARK if rules.get(DUMMY_PREFIX, 1) else ""
        texts = [p[PIECE_TEXT].decode() for p in pieces]
        kinds = [p.get(PIECE_KIND, NORMAL) for p in pieces]
        scores = np.array([np.frombuffer(p[PIECE_SCORE], "<f4")[0] if PIECE_SCORE in p else 0.0 for p in pieces])
        rank = np.empty(len(pieces), np.int64)
        rank[np.argsort(-scores, kind="stable")] = np.arange(len(pieces))
        self.ids = {t: k for k, t in enumerate(texts) if kinds[k] == NORMAL}
        self.rank = {t: int(rank[k]) for t, k in self.ids.items()}
        #: characters that the lexicon reads as they are
        self.alphabet = {c for t in self.ids for c in t}
        if not self.alphabet <= set(self.ids):
            raise ValueError(f"{model_path}: a character of a piece isn't a piece itself")
        self.ids |= {BYTE_LABELS[int(t[1:-1], 16)]: k for k, t in enumerate(texts) if kinds[k] == BYTE}
        longer = [t for t in self.ids if len(t) > 1]
        self.marks_apart = not any(re.search(f"[^{MARK}]{MARK}", t) for t in longer)
        self.lines_apart = not any("\n" in t for t in longer)
        #: neighbouring characters of some piece; elsewhere no arc spans
        self.near = {t[k : k + 2] for t in longer for k in range(len(t) - 1)}
        machine = compose(normaliser({c for t in self.ids for c in t}, bool(self.prefix)), lexicon(self.ids))
        self.compile(machine)
        self.compile_inverse(invert(machine), [UNKNOWN_TEXT if kind == UNKNOWN else "" for kind in kinds])
        #: piece -> next piece -> weight of the grammar's arc, as far as it has been asked for
        self.grammar: dict[str, dict[str, float]] = {}
        self.n_arcs = 0
        self.ends = Memo(self._ends, MEMO)
        self.packed = Memo(self._ids, MEMO)
        self.part = Memo(self._whole, MEMO)
        self.after_space = Memo(lambda part: self._packed(part if part[0] == "\n" else " " + part), MEMO)
        self.segment = Memo(self._packed, MEMO)

    def merges(self, text: str) -> Iterator[tuple[list[str], int]]:
        """BPE itself: of all neighbours the pair that makes the best piece is merged, the leftmost first. For short texts.

        (parts, rank of the piece that is merged next) before each merge and, with NEVER, after the last.
        """
        parts = list(text)
        while True:
            best, k = min(((self.rank.get(a + b, NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(NEVER, 0))
            yield parts, best
            if best == NEVER:
                return
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def merged(self, text: str) -> list[str]:
        """What BPE makes of a short text."""
        for parts, _ in self.merges(text):
            pass
        return parts

    def _ends(self, piece: str) -> list[tuple[str, str, int]] | None:
        """(first part, last part, rank of the next merge) as BPE makes the piece of its characters; None if it makes something else."""
        out = [(parts[0], parts[-1], rank) for parts, rank in self.merges(piece)]
        return out if out[-1][0] == piece else None

    def compile(self, m: Machine) -> None:
        """Tables of the composed machine: the next state by character, and what is written on the way to a state, the longest first."""
        none: dict = {}
        self.root = next(to for arcs in m.arcs for _, writes, _, to in arcs if writes != EPS)
        self.step = [{reads: to for reads, _, _, to in arcs if reads != EPS} or none for arcs in m.arcs]
        #: state -> (piece, weight) of itself and of the states before it
        self.written: list[tuple[tuple[str, float], ...]] = [()] * len(m.arcs)
        wait = [self.root]
        while wait:
            at = wait.pop()
            for to in self.step[at].values():
                self.written[to] = (*((writes, w) for _, writes, w, _ in m.arcs[to] if writes != EPS), *self.written[at])
                wait.append(to)
        self.longest = max(len(w[0][0]) for w in self.written if w)

    def compile_inverse(self, m: Machine, fixed: list[str]) -> None:
        """What each id writes, after others and as the first one. An id whose piece the machine doesn't read writes its ``fixed`` text."""
        inner, first = lightest_writings(m, self.root), lightest_writings(m, m.start)
        labels, opening = list(fixed), {}
        for piece, k in self.ids.items():
            labels[k] = "".join(inner[piece])
            if piece in first:
                opening[k] = "".join(first[piece])
        self.writes = [label_bytes(x) for x in labels]
        self.opens = [label_bytes(opening.get(k, x)) for k, x in enumerate(labels)]
        #: ids that write nothing: a character's bytes don't reach over them
        self.silent = set(range(len(fixed))) - set(self.ids.values()) - {k for k, x in enumerate(fixed) if x}

    def weigh(self, s: str, t: str) -> float:
        """The weight of the grammar's arc from s to t, kept in the row of s; the start of a text is the empty piece."""
        weight = 0.0 if self._apart(s, t) else INFINITE
        self.n_arcs += 1
        if self.n_arcs > ARCS:
            self.grammar.clear()
            self.n_arcs = 1
        self.grammar.setdefault(s, {})[t] = weight
        return weight

    def _apart(self, s: str, t: str) -> bool:
        """Whether BPE splits s + t into s and t.

        Until it merges across the border, it merges within s as it does in s alone and within t as in t alone, whichever
        is next by rank, of equal ranks the left one. So the merges of both are gone through once, and the pieces at the
        border must never be the next to be merged.
        """
        left, right, rank = self.ends[s] if s else [("", "", NEVER)], self.ends[t], self.rank
        if left is None or right is None:
            return False
        i = j = 0
        while s:
            (_, a, next_left), (b, _, next_right) = left[i], right[j]
            across = rank.get(a + b, NEVER)
            if across < next_left and across <= next_right:
                return False
            if next_left == next_right:
                if next_left == NEVER:
                    break
                i += 1
            elif next_left < next_right:
                i += 1
            else:
                j += 1
        return True

    def best_path(self, text: str) -> list[str]:
        """The pieces of a sequence of labels: the shortest path through lexicon and grammar.

        Arcs are relaxed one at a time. One that adds nothing to the weight is followed at once, since nothing that waits
        is lighter, and the other arcs of its state wait with that weight.
        """
        n, step, written, grammar, root, longest = len(text), self.step, self.written, self.grammar, self.root, self.longest
        found: dict[tuple[int, str], tuple[float, str]] = {}  # (position, last piece) -> (weight, piece before it)
        queue: list[tuple] = []  # (weight, -position, last piece, its arcs not yet relaxed or None for all)
        so_far, begin, last, arcs = 0.0, 0, "", None
        while begin < n:
            if arcs is None:
                at = root
                for c in text[begin : begin + longest]:
                    to = step[at].get(c)
                    if to is None:
                        break
                    at = to
                arcs = iter(written[at])
            row = grammar.get(last, {})
            for piece, weight in arcs:
                arc = row.get(piece)
                total = so_far + weight + (self.weigh(last, piece) if arc is None else arc)
                if total < INFINITE:
                    state = begin + len(piece), piece
                    if state not in found or total < found[state][0]:
                        found[state] = total, last
                        if total == so_far:
                            heappush(queue, (so_far, -begin, last, arcs))
                            begin, last = state
                            arcs = None
                            break
                        heappush(queue, (total, -state[0], piece, None))
            else:
                so_far, begin, last, arcs = heappop(queue)
                begin = -begin
        out = []
        while begin:
            out.append(last)
            begin, last = begin - len(last), found[begin, last][1]
        return out[::-1]

    def _ids(self, piece: str) -> bytes:
        return np.array([self.ids[piece]], "<u4").tobytes()

    def labels(self, text: str) -> str:
        """What the lexicon reads of a text: its characters, or the bytes of those that no piece has."""
        return "".join([c if c in self.alphabet or c == " " else "".join([BYTE_LABELS[b] for b in c.encode("utf-8", "replace")]) for c in text])

    def _whole(self, part: str) -> bytes:
        return b"".join([self.packed[piece] for piece in self.best_path(self.labels(part))])

    def _packed(self, text: str) -> bytes:
        """Parts between which no piece reaches have paths of their own."""
        near, marked = self.near, text.replace(" ", MARK)
        cuts = [k for k in range(1, len(text)) if marked[k - 1 : k + 1] not in near]
        if not cuts:
            return self._whole(text)
        return b"".join([self.part[text[i:j]] for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True)])

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        if not text:
            return b""
        if self.marks_apart and self.lines_apart and self.prefix and MARK not in text and "  " not in text and text[0] not in " \n" and text[-1] != " " and " \n" not in text and "\n " not in text:
            return b"".join(map(self.after_space.__getitem__, text.replace("\n", " \n").split(" ")))
        marked = self.prefix + text
        return b"".join(map(self.segment.__getitem__, re.findall(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+", marked))) if self.marks_apart else self._packed(marked)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: Sequence[int]) -> str:
        """The text of a sequence of ids: what the inverted machine writes. A byte that is part of no character gives U+FFFD."""
        if self.silent.isdisjoint(ids):
            runs = [[self.opens[k] for k in ids[:1]] + [self.writes[k] for k in ids[1:]]]
        else:
            runs, writes = [[]], self.opens
            for k in ids:
                if k in self.silent:
                    runs.append([])
                else:
                    runs[-1].append(writes[k])
                    writes = self.writes
        return "".join([b"".join(run).decode("utf-8", "each_byte_apart") for run in runs])

    def decode_packed(self, ids: bytes) -> str:
        """``decode`` for ids as ``encode_packed`` gives them."""
        return self.decode(np.frombuffer(ids, "<u4").tolist())


@functools.lru_cache(maxsize=2)
def transducer(model_path: str) -> Transducer:
    """The machines of a model file, compiled once in each worker process; what they remember serves its later tasks too."""
    return Transducer(model_path)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row."""

    def start():
        fst = transducer(model_path)
        return lambda row: [(row[0], fst.encode(row[1] or ""))]

    return map_rows(docs.select(F.col(id_col).cast("bigint"), text_col), "doc_id bigint, ids array<int>", start)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of every row of ids."""

    def start():
        fst = transducer(model_path)
        return lambda row: [(row[0], fst.decode(row[1] or ()))]

    return map_rows(encoded.select(F.col(id_col).cast("bigint"), ids_col), "doc_id bigint, text string", start)


def round_trips(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_sha256, same): digests of the encoding and of what it decodes to, in one pass."""

    def start():
        fst = transducer(model_path)

        def step(row: tuple) -> Iterable[tuple]:
            text = row[1] or ""
            ids = fst.encode_packed(text)
            back = fst.decode_packed(ids)
            yield row[0], len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back.encode("utf-8", "replace")).hexdigest(), back == text

        return step

    return map_rows(docs.select(F.col(id_col).cast("bigint"), text_col), "doc_id bigint, n_ids bigint, ids_crc32 bigint, decoded_sha256 string, same boolean", start)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
