"""Document fingerprints: MinHash over 5-word shingles.

PERMUTATIONS universal hash functions ((a h + b) mod 2**64) >> 32 run over all shingle hashes of a text in one numpy
operation; the smallest value of each makes the signature. The fingerprint keeps the low byte of each (b-bit MinHash), so
likeness is the share of equal bytes, corrected for the 1/256 that agree by chance.

Near duplicates: equal shingle sets are one node; nodes meet in bands of the signature, joined in Spark. In a bucket of
up to SMALL members all are compared; in a larger one CENTRES of them are compared with all and the links make components.
Members that are still in different components are told by what they differ in from the typical set of their group:
two are compared only if they have enough of these differences in common, without which they can't be similar, and where they
differ so little that they must be similar one comparison with the group's nearest member stands for all. A pair whose
fingerprints could agree is verified by the exact Jaccard similarity of the shingle sets. So every two nodes that share a
band are in one class if they are similar enough, and members of a large group that differ by changes of their own emit no
pairs among themselves. Bands are as wide as lets two sets of the least similarity asked for share one with a chance of SHARED: 25
bands of 5 at 0.8 (5e-5 share none), 32 of 4 at 0.7, 42 of 3 at 0.6. A similarity too low for any width is an error.

The pipeline's stage runs operator 3's method first: each node has a SimHash of its shingle set, SimHashes are replicated to the
anchors of the covering code, and all that differ in at most 2 bits are compared there. Their nodes are verified by the
exact Jaccard similarity like those that meet in bands, and one set of components is made of all links. Bands find what lies
farther than the anchors reach.

Edge cases: a null text is empty. Texts without words have one fingerprint of their own (all bytes 255). With fewer words
than a shingle the whole sequence is the one shingle. The order of documents is descending id, then descending digest of the
text; a null id comes last. Repeated rows are each other's neighbours and share a class. Near duplicates: of a class the row with the smallest id stays, of equal ids that
with the smallest digest; rows are told apart by id and text, so null and repeated ids may occur. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filelens.llm._common import apart, beside, cut, keep_one, map_rows, met, packed, small_batches, table, text_digest, unpacked
from filelens.llm._words import run_hashes, word_bounds, word_hashes
from filelens.llm.simhash import THRESHOLD, components, links, majority, signed

SHINGLE = 5
PERMUTATIONS = 128
#: Chance that two sets of the least similarity share a band, at least.
SHARED = 0.999
LIKENESS = 0.8
#: Nodes of a bucket that all its members are compared with.
CENTRES = 2
#: Up to this many members of a bucket are compared with each other.
SMALL = 8
#: Stands for a null id in the order.
LOWEST = -(1 << 63)

_random = np.random.default_rng(20240607)
_A = _random.integers(0, 1 << 63, (PERMUTATIONS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 1 << 63, (PERMUTATIONS, 1), dtype=np.uint64)
#: Room for the values of some shingles, used again for the next ones.
_VALUES = np.empty((256, PERMUTATIONS), np.uint64)


def runs(words: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of a sequence of word hashes, with repeats; of fewer words than a shingle, of the whole sequence."""
    return run_hashes(words, min(SHINGLE, len(words))) if len(words) else words


def shingles(text: bytes) -> np.ndarray:
    """Hashes of the 5-word shingles, with repeats."""
    return runs(word_hashes(text))


def lows(hashes: np.ndarray, cuts: list[int]) -> np.ndarray:
    """The smallest 64-bit value of each permutation, a row for each stretch of ``hashes`` between neighbours of the sorted ``cuts``."""
    low = np.full((len(cuts) - 1, PERMUTATIONS), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(cuts[0], cuts[-1], len(_VALUES)):
        some = hashes[k : k + len(_VALUES), None]
        values = np.multiply(some, _A.T, out=_VALUES[: len(some)])
        values += _B.T
        for row, begin, end in zip(low, cuts, cuts[1:]):
            begin, end = max(begin - k, 0), min(end - k, len(values))
            if begin < end:
                np.minimum(row, np.minimum.reduce(values[begin:end], axis=0), out=row)
    return low


def values_of(low: np.ndarray) -> np.ndarray:
    """A signature from smallest 64-bit values: the upper half of each."""
    return (low >> np.uint64(32)).astype("<u4")


def signature(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of each permutation, 32 bits each."""
    return values_of(lows(hashes, [0, len(hashes)])[0])


def fingerprint(text: str) -> bytes:
    """The low byte of each signature value."""
    return low_bytes(signature(shingles(text.encode("utf-8", "replace"))))


def low_bytes(sig: np.ndarray) -> bytes:
    return sig.astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimate of the Jaccard similarity of the shingle sets, 0 to 1."""
    same = np.count_nonzero(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)) / PERMUTATIONS
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


class Chained:
    """A text in the chain of documents: its head is the end of the text before's edited text, its own edited text begins with its first part.

    Each shingle is run through the permutations once: the smallest values are kept for the head, the first part and all, and
    an edited text takes those of the two parts. Only shingles with a word at or across a cut are new there.
    """

    def __init__(self, text: str, head: int) -> None:
        """``head``: code points that the text before takes."""
        self.data = text.encode("utf-8", "replace")
        self.n_chars, self.half = len(text), len(text) // 2
        at = (lambda n: min(n, len(text))) if len(self.data) == len(text) else (lambda n: len(text[:n].encode("utf-8", "replace")))
        self.head, self.part = at(head), at(len(text) - self.half)
        self.begin, self.end = word_bounds(self.data)
        self.words = word_hashes(self.data, (self.begin, self.end))
        hashes = runs(self.words)
        # Whole words of the head behind a white space, and those of the first part before one.
        self.first = int(len(self.begin) > 0 and self.begin[0] == 0)
        self.last = max(self.first, int(np.searchsorted(self.end, self.head, "right")))
        self.before = int(np.searchsorted(self.end, self.part))
        self.inner = self.first, max(self.first, self.last - SHINGLE + 1)
        self.lead = max(0, self.before - SHINGLE + 1)
        cuts = sorted({0, *self.inner, self.lead, len(hashes)})
        low = lows(hashes, cuts) if len(cuts) > 1 else lows(hashes, [0, 0])
        least = lambda a, b: low[cuts.index(a) : cuts.index(b)].min(axis=0, initial=0xFFFFFFFFFFFFFFFF)
        self.low_inner, self.low_lead = least(*self.inner), least(0, self.lead)
        self.print = low_bytes(values_of(low.min(axis=0)))

    def edited(self, follows: Chained) -> tuple[str, bytes]:
        """SHA-256 and fingerprint of the edited text; ``follows`` was made with this text's ``half`` as its head."""
        head, (first, last) = follows.data[: follows.head], (follows.first, follows.last)
        kept, n, near = self.before, last - first, SHINGLE - 1
        at = int(self.end[kept - 1]) if kept else 0
        digest = hashlib.sha256(self.data[: self.part] + head).hexdigest()
        # Words at the cut, and the one that the end of the head cuts through, if there is one.
        through = int(n > 0 and last < len(follows.begin) and follows.begin[last] < follows.head)
        cut_words = self.data[at : self.part] + (head[: follows.begin[first]] if n else head)
        middle = word_hashes(cut_words + b" " + head[follows.begin[last] :] if through else cut_words)
        middle, tail = middle[: len(middle) - through], middle[len(middle) - through :]
        lead = self.words[max(0, kept - near) : kept]
        if n <= near:  # no shingle of the head alone
            words = np.concatenate((lead, middle, follows.words[first:last], tail))
            new = runs(words) if kept <= near else run_hashes(words, SHINGLE)
        else:
            new = run_hashes(np.concatenate((lead, middle, follows.words[first : first + near], follows.words[last - near : last], tail)), SHINGLE)
            across = len(lead) + len(middle)  # those that follow, up to the last words, aren't of the text
            new = np.concatenate((new[:across], new[across + near :]))
        low = np.minimum(lows(new, [0, len(new)])[0], self.low_lead)
        return digest, low_bytes(values_of(np.minimum(low, follows.low_inner)))


def _placing(borders: list[tuple[int, bytes]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over rows with ``key`` and ``digest``: adds ``part``, how many of the sorted ``borders`` (key, digest) are smaller than a row's.

    Keys are looked up all at once; the digest is looked at only where a key is a border's.
    """
    keys = np.array([k for k, _ in borders], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, digest = batch.column("key").to_numpy(zero_copy_only=False), batch.column("digest")
            part = np.searchsorted(keys, key).astype(np.int32)
            for k in np.flatnonzero(np.searchsorted(keys, key, "right") > part).tolist():
                part[k] = bisect_left(borders, (int(key[k]), digest[k].as_py()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], names=[*batch.schema.names, "part"])

    return run


def _borders(keys: list[int]) -> list[tuple[int, bytes]]:
    """Borders (key, digest) from quantiles of the keys. A key that fills several ranges is divided by digest."""
    out = []
    for k in sorted(set(keys)):
        n = keys.count(k)
        out += [(k, b"\xff" * 33)] if n == 1 else [(k, ((j << 64) // (n + 1)).to_bytes(8, "big")) for j in range(1, n + 1)]
    return out


def in_order(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, digest, packed, class_id, ghost) in ranges of (id, digest), one range per partition, each sorted descending.

    ``packed`` is the text, compressed before it is exchanged, once. ``classes`` has (doc_id, digest, class_id); its rows
    ride in the same exchange without a text, each just before its document. The last row of each partition is a ghost:
    the document that follows its last one, which is the first of the range below, or the first of all. Only the borders
    of the ranges and the first key of each (two small values per partition) come to the driver; a row's range is looked up
    among the borders, so the plan is the same for any number of partitions.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(LOWEST)).alias("key")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"))
    keyed = rows.select(key("id"), "id", text_digest(F.col("text")).alias("digest"), "text")
    quantiles = [k / parts for k in range(1, parts)] or [0.5]
    borders = _borders(rows.select(key("id")).agg(F.percentile_approx("key", quantiles, 10 * parts)).first()[0] or [])
    place = _placing(borders)
    first = {r.part: r.top for r in keyed.select("key", "digest").mapInArrow(place, "key bigint, digest binary, part int").groupBy("part").agg(F.max(F.struct("key", "digest")).alias("top")).collect()}
    order = sorted(first, reverse=True)
    follows = [(part, *first[below]) for part, below in zip(order, order[1:] + order[:1], strict=True)]
    heads = spark.createDataFrame(follows, "part int, head bigint, head_digest binary")

    whole = keyed.mapInArrow(lambda batches: place(packed(batches)), "key bigint, id bigint, digest binary, packed binary, part int")
    none = F.lit(None).cast("bigint").alias("class_id")
    own = whole.select("part", "key", "id", "digest", "packed", none, F.lit(False).alias("ghost"))
    ghosts = keyed.join(F.broadcast(heads), (F.col("key") == F.col("head")) & (F.col("digest") == F.col("head_digest"))).groupBy("part").agg(F.first("key").alias("key"), F.first("id").alias("id"), F.first("digest").alias("digest"), F.first("text").alias("text"))
    ghosts = ghosts.select("part", "key", "id", "digest", "text").mapInArrow(packed, "part int, key bigint, id bigint, digest binary, packed binary")
    ghosts = ghosts.select("part", "key", "id", "digest", "packed", none, F.lit(True).alias("ghost"))
    about = classes.select(key("doc_id"), F.col("doc_id").alias("id"), "digest", "class_id").mapInArrow(place, "key bigint, id bigint, digest binary, class_id bigint, part int")
    about = about.select("part", "key", "id", "digest", F.lit(None).cast("binary").alias("packed"), "class_id", F.lit(False).alias("ghost"))
    placed = own.unionByName(ghosts).unionByName(about).repartitionById(parts, F.col("part"))
    return placed.sortWithinPartitions("ghost", F.desc("key"), F.desc("digest"), F.col("packed").isNotNull()).select("id", "digest", "packed", "class_id", "ghost")


def fingerprints_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LIKENESS) -> DataFrame:
    """One row per document: its fingerprint, that of the text whose last half is the head of the next document's, the likenesses, and its class of near duplicates."""
    small_batches(docs.sparkSession)
    classes = near_duplicates_by_text(docs, id_col, text_col, least)

    class Step:
        def __init__(self) -> None:
            self.held: tuple | None = None
            self.about: tuple = (None, None)

        def __call__(self, row: tuple) -> Iterable[tuple]:
            doc_id, digest, data, class_id, ghost = row
            if data is None:
                self.about = (digest, class_id)
                return
            own = Chained(unpacked(data).decode("utf-8", "replace"), self.held[1].half if self.held else 0)
            if self.held:
                held_id, held, held_class = self.held
                edited_sha, edited_print = held.edited(own)
                yield held_id, held.n_chars, edited_sha, held.print.hex(), edited_print.hex(), likeness(held.print, edited_print), likeness(held.print, own.print), held_class
            self.held = None if ghost else (doc_id, own, self.about[1])

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id bigint"
    return map_rows(in_order(docs, classes, id_col, text_col), schema, Step)


def band_width(least: float) -> int:
    """The values of a band: as many as let two sets of similarity ``least`` share a band with a chance of SHARED."""
    fit = [w for w in range(1, PERMUTATIONS + 1) if 1 - (1 - least**w) ** (PERMUTATIONS // w) >= SHARED]
    if not fit:
        raise ValueError(f"{PERMUTATIONS} hash functions don't find sets of similarity {least}")
    return max(fit)


def bands(sig: np.ndarray, width: int) -> list[int]:
    """A hash of each band of a signature, as signed 64-bit numbers."""
    n = PERMUTATIONS // width
    return [int(np.uint64(xxhash.xxh64_intdigest(part.tobytes(), k)).view(np.int64)) for k, part in enumerate(sig[: n * width].reshape(n, width))]


def shingle_set(text: bytes | None, fold: bool) -> np.ndarray:
    """The distinct shingle hashes, sorted; ``fold``: of the text with ASCII letters in lower case."""
    text = text or b""
    return np.unique(shingles(text.lower() if fold else text))


def _likely(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose fingerprints don't speak against a similarity of at least ``least``.

    Of PERMUTATIONS values, sets that similar agree in so few less than once in 10**8 pairs (six standard deviations).
    """
    few = PERMUTATIONS * least - 6 * (PERMUTATIONS * least * (1 - least)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, PERMUTATIONS) for c in batch.columns[2:])
                yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array((a == b).sum(axis=1) >= few))

    left, right = (nodes.select(F.col("same").alias(x), F.col("print").alias(f"print_{x}")) for x in "ab")
    return met(met(pairs, left, "a"), right, "b").select("a", "b", "print_a", "print_b").mapInArrow(run, "a bigint, b bigint")


def _linked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of at least ``least``, settled in the shared folder."""
    left, right = (sets.select(F.col("same").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "ab")
    common = F.size(F.array_intersect("of_a", "of_b"))
    near = common >= least * (F.size("of_a") + F.size("of_b") - common)
    return cut(met(met(pairs, left, "a"), right, "b").where(near).select("a", "b"))


def _by_differences(nodes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of ``nodes`` (same, n, root, cluster) of one cluster and different roots, of which those that are similar enough link the same roots as all would.

    A node is told by its differences: the shingles that it alone or the cluster's typical set alone has, which is of the
    shingles in more than half of the nodes. Two sets of n and m shingles with d and e differences, c of them common, differ
    in d + e - 2c; they are similar if that is at most k (n + m), where k = (1 - least) / (1 + least). With over = d - k n:

    - If the sum of their ``over`` is 0 or less, they are similar whatever c is. Each is then similar to the cluster's node with
      the smallest ``over`` too, so one pair with that node for each root stands for all of these, and such roots are one.
    - Else c must be at least half the sum. Of d differences, in one order for all nodes, one among the first d - c + 1 is then
      common, and what follows the first common one makes up c in both. The order is by the number of nodes that have a
      difference, those that one root alone has first, so near copies that differ by changes of their own make no pair.

    All sets of differences together are no larger than the sets.
    """
    slack = (1 - least) / (1 + least)
    of_cluster = lambda rows, *what: rows.groupBy("cluster", apart("cluster")).agg(*what).drop("_apart")
    whole = met(nodes, sets, "same")
    often = whole.select("cluster", F.explode("shingles").alias("s")).groupBy("cluster", "s").agg(F.count("*").alias("df")).where("df > 1")
    # One row per cluster: the rows of a large cluster stay where they are as long as these are few.
    sizes = cut(of_cluster(nodes, F.count("*").alias("size")))
    most = beside(often, sizes, "cluster", "inner", F.lit(24)).where(2 * F.col("df") > F.col("size"))
    typical = cut(of_cluster(most, F.collect_list("s").alias("typical")).withColumnRenamed("cluster", "_cluster"))
    base = F.coalesce("typical", F.array().cast("array<bigint>"))
    differs = F.concat(F.array_except("shingles", base), F.array_except(base, F.col("shingles")))
    told = beside(whole, typical, F.col("cluster") == F.col("_cluster"), "left", 24 + 8 * F.size("typical"))
    each = cut(told.select("same", "n", "root", "cluster", differs.alias("differs")))
    each = each.withColumn("d", F.size("differs")).withColumn("over", F.col("d") - slack * F.col("n"))

    # Roots that are similar to the cluster's nearest node in any case count as its root.
    nearest = cut(of_cluster(each, F.min(F.struct("over", "same", "root")).alias("nearest")))
    by_root = each.groupBy("cluster", "root").agg(F.min(F.struct("over", "same")).alias("one"))
    sure = F.col("one.over") + F.col("nearest.over") <= 1e-9
    roots = cut(beside(by_root, nearest, "cluster", "inner", F.lit(48)).select("root", F.when(sure, F.col("nearest.root")).otherwise(F.col("root")).alias("label"), F.col("one.same").alias("a"), F.col("nearest.same").alias("b"), F.col("nearest.over").alias("lowest")))

    common = lambda x, y: F.greatest(F.lit(1), F.ceil((x + y) / 2 - 1e-9))
    listed = met(each, roots.select("root", "label", "lowest"), "root").select("cluster", "same", "label", "d", "over", common(F.col("over"), F.col("lowest")).alias("c"), F.explode("differs").alias("s"))
    spread = listed.groupBy("cluster", "s", apart("cluster", "s")).agg(F.count("*").alias("df"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("cluster", "s", "df")
    of_node = Window.partitionBy("same")
    placed = met(listed, spread, ["cluster", "s"]).withColumn("rank", F.row_number().over(of_node.orderBy("df", "s"))).withColumn("rest", F.count("*").over(of_node) - F.col("rank") + 1)
    first = cut(placed.where("rest >= c").select("cluster", "s", "same", "label", "over", "rest"))
    left, right = (first.select(*(F.col(c).alias(f"{c}_{x}") for c in first.columns)) for x in "ab")
    meet = (F.col("cluster_a") == F.col("cluster_b")) & (F.col("s_a") == F.col("s_b")) & (F.col("label_a") < F.col("label_b"))
    enough = F.least("rest_a", "rest_b") >= common(F.col("over_a"), F.col("over_b"))
    pairs = met(left, right, meet & enough).select(F.col("same_a").alias("a"), F.col("same_b").alias("b")).distinct()
    return pairs.unionByName(roots.where("label <> root").select("a", "b"))


def _at_anchors(own: DataFrame, threshold: int) -> DataFrame:
    """(a, b), a > b: pairs of the nodes in ``own`` (same, fp) whose SimHashes differ in at most ``threshold`` bits, by operator 3's anchors, settled.

    One node stands for all with its SimHash: these are paired with it, and it with those of the SimHashes nearby, so there are
    no more pairs than nodes and links of SimHashes.
    """
    nodes = cut(own.select("same", "fp").distinct())
    heads = cut(nodes.groupBy("fp", apart("fp")).agg(F.min("same").alias("head")).select("fp", "head"))
    a, b = (heads.select(F.col("fp").alias(f"fp_{x}"), F.col("head").alias(x)) for x in "ab")
    close = met(met(links(heads.select("fp"), threshold).toDF("fp_a", "fp_b"), a, "fp_a"), b, "fp_b")
    equal = met(nodes, heads, "fp").where("same <> head")
    return cut(close.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).unionByName(equal.select(F.col("same").alias("a"), F.col("head").alias("b"))))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LIKENESS, fold: bool = False, threshold: int | None = None) -> DataFrame:
    """(doc_id, digest, root) of every row: rows with the same root are linked; ``digest`` is the SHA-256 of the text.

    With ``threshold`` nodes also meet at the anchors of their SimHashes.
    """

    width = band_width(least)
    anchored = threshold is not None

    def start():
        def step(row: tuple) -> Iterator[tuple]:
            hashes = shingle_set(row[1], fold)
            same = int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64))
            sig = signature(hashes)
            told = row[0], hashlib.sha256(row[1] or b"").digest(), same, len(hashes), bands(sig, width), low_bytes(sig)
            yield (*told, signed(majority(hashes))) if anchored else told

        return step

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    own = cut(map_rows(rows, "doc_id bigint, digest binary, same bigint, n int, bands array<bigint>, print binary" + ", fp bigint" * anchored, start))
    buckets = own.select("same", F.explode("bands").alias("bucket"))
    # Two nodes in a bucket are told by 32 bits of their hashes: that is the one exchange that all buckets take part in twice.
    short = F.hash("same")
    crowded = cut(buckets.groupBy("bucket").agg(F.min(short).alias("low"), F.max(short).alias("high")).where("low < high").select("bucket"))
    meeting = cut(met(buckets, crowded, "bucket").distinct())
    partners = meeting.select("same")
    if anchored:
        at_anchors = _at_anchors(own, threshold)
        partners = partners.unionByName(at_anchors.select(F.explode(F.array("a", "b")).alias("same")))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    nodes = met(own.select("same", "n", "doc_id", "digest", "print"), partners.distinct(), "same", "left_semi").groupBy("same").agg(F.min(F.struct(key.alias("k"), "n", "print")).alias("one"))
    nodes = cut(nodes.select("same", "one.n", "one.print", F.col("one.k.doc_id").alias("_id"), F.col("one.k.digest").alias("_digest")))
    members = met(meeting, nodes.select("same", "n"), "same")
    counted = members.groupBy("bucket", apart("bucket")).agg(F.count("*").alias("members"), *(F.min(F.struct(F.xxhash64("same", F.lit(k)).alias("h"), "same", "n")).alias(f"c{k}") for k in range(CENTRES)))
    centres = F.array_distinct(F.array(*(F.struct(f"c{k}.same", f"c{k}.n") for k in range(CENTRES))))
    members = cut(met(members, counted.select("bucket", "members", centres.alias("centres")), "bucket"))

    # Pairs of small buckets, and of each member with the centres of its bucket.
    sized = lambda a, b: F.least(a, b) >= least * F.greatest(a, b)
    small = members.where(F.col("members") <= SMALL)
    left, right = (small.select("bucket", F.col("same").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    pairs = met(left, right, "bucket").where(F.col("a") > F.col("b")).where(sized("n_a", "n_b")).select("a", "b")
    large = members.where(F.col("members") > SMALL)
    beside_centre = large.select("same", "n", F.explode("centres").alias("c")).where((F.col("same") != F.col("c.same")) & sized("n", "c.n"))
    pairs = pairs.unionByName(beside_centre.select(F.greatest("same", "c.same").alias("a"), F.least("same", "c.same").alias("b")))
    likely = cut(_likely((pairs.unionByName(at_anchors) if anchored else pairs).distinct(), nodes, least))

    # The sets of one row for each node that has a likely partner, or is in a large bucket; only the keys of these rows meet the texts.
    needed = likely.select(F.explode(F.array("a", "b")).alias("same")).unionByName(large.select("same")).distinct()
    wanted = cut(met(nodes.select("same", "_id", "_digest"), needed, "same", "left_semi"))
    texts = beside(rows.withColumn("own", text_digest(F.col("text"))), wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("own") == F.col("_digest")), "inner")
    sets = cut(map_rows(texts.select("same", "text"), "same bigint, shingles array<bigint>", lambda: lambda row: [(row[0], shingle_set(row[1], fold).view(np.int64).tolist())]))
    if sets.count() > wanted.count():  # rows that repeat both id and text
        sets = cut(sets.dropDuplicates(["same"]))
    links = _linked(likely, sets, least)
    first = components(links)

    # Members of a large bucket in different components. Clusters are roots that mixed buckets connect.
    rooted = met(large.select("bucket", "same", "n"), first.withColumnRenamed("node", "same"), "same", "left").select("bucket", "same", "n", F.coalesce("root", "same").alias("root"))
    mixed = rooted.groupBy("bucket", apart("bucket")).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket", "low")
    apart_yet = cut(met(rooted, mixed, "bucket").select("same", "n", "root", "low").distinct())
    clusters = components(apart_yet.select(F.col("root").alias("a"), F.col("low").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("cluster"))
    unsettled = cut(met(apart_yet.select("same", "n", "root").distinct(), clusters, "root"))
    across = cut(_by_differences(unsettled, sets, least))
    if not across.isEmpty():
        a, b = (unsettled.select(F.col("same").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
        moved = components(met(met(_linked(across, sets, least), a, "a"), b, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
        known = first.unionByName(moved.select("node", F.col("node").alias("root"))).distinct()
        first = met(known, moved.select(F.col("node").alias("root"), F.col("root").alias("last")), "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return met(own.select("doc_id", "digest", "same"), first.withColumnRenamed("node", "same"), "same", "left").select("doc_id", "digest", F.coalesce("root", "same").alias("root"))


def _with_class_id(own: DataFrame) -> DataFrame:
    """(doc_id, digest, class_id) of rows (doc_id, digest, root)."""
    own = cut(own)
    classes = own.groupBy("root", apart("root")).agg(F.min("doc_id").alias("class_id")).drop("_apart")
    return met(own, classes, "root").select("doc_id", "digest", "class_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LIKENESS) -> DataFrame:
    """(doc_id, class_id): documents linked by a verified Jaccard similarity of at least ``least``; class_id is the smallest id reachable."""
    return _with_class_id(near_classes(docs, id_col, text_col, least)).select("doc_id", "class_id")


def near_duplicates_by_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LIKENESS) -> DataFrame:
    """(doc_id, digest, class_id), once for rows that repeat both id and text."""
    return _with_class_id(near_classes(docs, id_col, text_col, least)).distinct()


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LIKENESS, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class of near duplicates, ASCII letters compared in lower case; all columns stay.

    Documents meet at the anchors of their SimHashes, as far as ``threshold`` bits, and in the bands of their signatures.
    """
    return keep_one(docs, cut(near_classes(docs, id_col, text_col, least, fold=True, threshold=threshold)), id_col, text_col)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_with_next(table(spark, sf_dir, "documents"))
