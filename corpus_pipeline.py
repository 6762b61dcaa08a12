"""The corpus pipeline: quality filter, exact dedup, near-dedup (anchors, then bands), secret redaction, packing.

Each stage takes (spark, docs, sf_dir), where docs are the rows that the stage before kept, and returns rows; all but the
last return the columns of ``documents``. Decisions take effect: rejected documents, copies and near copies are gone, and
flagged spans are replaced in the texts, before the next stage reads them.

In every stage: an empty table gives an empty one; null lang, source and n_chars stay; further columns of any name ride
along (packing leaves them out); a text of any length is read whole; the same rows give the same result at every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelens.llm import exact_dedup, minhash, packing, quality, secrets
from filelens.llm._common import table
from filelens.storage import settled


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from the labelled training rows among ``docs``.

    A null or empty text is scored like any other. Rows with a null id are scored and never learned from; rows that repeat
    an id are scored each by its own text, and one of them is learned from.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the row with the smallest id.

    A null text is an empty one. A null id never wins over another; rows with null ids alone all stay. Of rows that repeat
    id and text one stays.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = minhash.LIKENESS) -> DataFrame:
    """One document of each group linked by a 5-word Jaccard similarity of ``least`` or more: the one with the smallest id.

    Candidates come from operator 3's anchors over SimHashes of 5-word shingles, and from operator 4's bands for pairs farther
    apart than the anchors reach; both are verified by the exact similarity.

    Null and empty texts are one group. Of texts with fewer than five words the whole sequence is compared. A null id comes
    last; of equal ids the text with the smallest digest stays.
    """
    return minhash.drop_near_copies(docs, least=least)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with flagged spans replaced and ``n_chars`` counted anew.

    A null text stays null, with a null ``n_chars``. Rows that repeat an id are redacted each by its own text.
    """
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their places in the sequences.

    A null or empty text has the end id alone; a null id stays null; repeated rows are packed once each.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Trained and fingerprinting stages have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what each returns is a table in the shared folder, which the next reads and which goes with the application."""
    rows = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        rows = settled(stage(spark, rows, sf_dir))
    return STAGES[-1][1](spark, rows, sf_dir)
