"""Fill-in-middle: texts cut at token borders into prefix, middle and suffix, and written out with the middle last.

A token is a run of non-space with the white space before it, or white space alone. While a text's tokens are counted, a
sparse checkpoint index records (token, byte, code point) every ``EVERY`` tokens. A cut is found by binary search among the
checkpoints and a short scan of less than EVERY tokens from there, so neither the tokens nor their borders are kept, and
an index has one entry per EVERY tokens. Texts are scanned as UTF-8, whose bytes of white space stand for themselves only.

Which texts are transformed, where they are cut and in which order they are written depends on the seed and the id alone,
so a lost task writes the same again. Every row is by itself: nothing is shuffled and no text meets another.

Edge cases: a null text is the empty text; an empty text and one that holds a marker stay plain. A null id is hashed as
the empty string and stays null. Rows that repeat an id are cut at the same hashes, each in its own text. A prefix, middle
or suffix may be empty. A text is held once as bytes and once as output, whatever its length, and one token may be all of
it. An empty table gives an empty result. Other columns are ignored by ``fill_in_middle``; ``rewritten`` keeps them all,
whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filelens.llm._common import BATCH_BYTES, boxed, table

#: Tokens between two checkpoints.
EVERY = 64
SEED = 42
#: Of a hundred texts, those that are transformed; of a hundred transformed, those written suffix first.
RATE, SUFFIX_FIRST = 50, 80

_TOKEN = rb"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
_one = re.compile(_TOKEN)
#: Each token is atomic, so a text with fewer left fails at once and none is split to make up the number.
_stride = re.compile(b"(?>" + _TOKEN + b"){%d}" % EVERY)

RESULT = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
)


@dataclass
class Checkpoints:
    """The sparse index of one text."""

    data: bytes
    tokens: list[int] = field(default_factory=lambda: [0])
    bytes_: list[int] = field(default_factory=lambda: [0])
    points: list[int] = field(default_factory=lambda: [0])
    n: int = 0

    def __post_init__(self) -> None:
        at = 0
        while m := _stride.match(self.data, at):
            self.points.append(self.points[-1] + len(self.data[at : m.end()].decode()))
            at = m.end()
            self.tokens.append(self.tokens[-1] + EVERY)
            self.bytes_.append(at)
        self.n = self.tokens[-1] + sum(1 for _ in _one.finditer(self.data, at))

    def after(self, token: int) -> tuple[int, int]:
        """(byte, code point) at which the first ``token`` tokens end."""
        k = bisect_right(self.tokens, token) - 1
        first = at = self.bytes_[k]
        for _ in range(token - self.tokens[k]):
            at = _one.match(self.data, at).end()
        return at, self.points[k] + len(self.data[first:at].decode())


def cut(doc_id: int | None, text: str | None, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    text = text or ""
    data = text.encode()
    index = Checkpoints(data)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or h3 % 100 >= rate or "<P>" in text or "<S>" in text or "<M>" in text:
        return index.n, "plain", None, None, text
    first, last = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    (a, a_points), (b, b_points) = index.after(first), index.after(last)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h4 % 100 < suffix_first:
        form, out = "spm", (b"<S>", suffix, b"<P>", prefix, b"<M>", middle)
    else:
        form, out = "psm", (b"<P>", prefix, b"<S>", suffix, b"<M>", middle)
    return index.n, form, a_points, b_points - a_points, b"".join(out).decode()


def _cut_all(rows: DataFrame, seed: int, rate: int, suffix_first: int) -> DataFrame:
    """``rows`` with RESULT in place of their last two columns, the id and the text."""
    schema = T.StructType(rows.schema.fields[:-2] + RESULT.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        own = len(out) - len(RESULT.fields)
        for batch in batches:
            *kept, ids, texts = batch.columns
            done, start, size = [], 0, 0

            def part(end: int) -> pa.RecordBatch:
                """The rows from ``start`` on."""
                results = zip(*done, strict=True)
                columns = [c.slice(start, end - start).cast(f.type) for c, f in zip(kept, out, strict=False)]
                return pa.RecordBatch.from_arrays(columns + [pa.array(c, out.field(own + k).type) for k, c in enumerate(results)], schema=out)

            for k in range(batch.num_rows):
                done.append(cut(ids[k].as_py(), texts[k].as_py(), seed, rate, suffix_first))
                size += len(done[-1][-1])
                if size >= BATCH_BYTES:
                    yield part(k + 1)
                    done, start, size = [], k + 1, 0
            if done:
                yield part(batch.num_rows)

    return rows.mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row per input row: (doc_id, n, form, prefix_chars, middle_chars, output); n counts tokens."""
    own = F.col(id_col).cast("bigint")
    return _cut_all(docs.select(own.alias("doc_id"), own.alias("own"), F.col(text_col).alias("text")), seed, rate, suffix_first)


def rewritten(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs`` with transformed texts in place of their own; all columns stay."""
    done = _cut_all(boxed(docs, own=F.col(id_col).cast("bigint"), whole=F.col(text_col)), seed, rate, suffix_first)
    return done.select(*(F.col("output").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. A text with a marker in it is never cut, so the markers part the output."""
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda k: F.element_at(parts, F.lit(k))
    return F.when(form == "spm", F.concat(part(3), part(4), part(2))).when(form == "psm", F.concat(part(2), part(4), part(3))).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


ORACLE_SQL = r"""
WITH tokens AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
hashed AS (
  SELECT *, len(tokens) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM tokens),
formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM hashed),
parts AS (SELECT *, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:], '') AS suffix FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
