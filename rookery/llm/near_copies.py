"""Near copies by meet-in-the-middle ball hashing on several words of a long fingerprint.

Two texts are near copies when the sets of their five-word shingles have a Jaccard similarity of 0.8 or more. Their SimHash fingerprints then
differ in about a seventh of the bits, far more than half a radius of variants can bridge over 64 bits. So the fingerprint is cut into words so short that
most pairs differ in at most two bits of one: every word emits all its variants within half that radius, itself and each of its
bits flipped, and two words within two bits share a variant. A short word alone would be shared by chance; each stands beside a least
hash of the shingles, which two texts have in common as often as their similarity says. The number of words follows from the recall wanted at
the least similarity, and does not grow with the documents.

The two of a bucket that just two share are tied; where more do, all are tied to the least instead of emitting pairs. Ties are tested by all bits
of the fingerprints, which leaves few that are not near copies, and these by the shingles themselves; what passes is joined to groups.

Pairs that share no variant are found exactly, by the prefixes of their shingles (`missed_links`): every two near copies are in one group.

Buckets are aggregated before they are shuffled, so a bucket that very many fingerprints share is one row per task. Only variants of buckets
that more than two share are shuffled again, to be tied to their least; a bitmap tells them from the others, and the tables are written ones, so adaptive
execution splits a hot bucket. Texts are read twice, the second time only where a tie has to be tested, and a third time to write the
rows that stay. Equal fingerprints are one node.

Defined results: null, empty and blank texts have no shingles and are copies of each other; fewer words than a shingle make one
shingle; of each group the row with the smallest id stays, one of them where it is repeated, and rows without an id come last; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, marked, marks, row_key, settled, stored
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
#: Least part of the pairs at exactly the least similarity that share a variant.
RECALL = 0.93
#: Bits of a word, and words of a fingerprint; the first ones emit variants.
BITS, WORDS = 16, 12
#: Standard deviations by which ties may differ more than expected before they are tested by their shingles.
SLACK = 3.0
#: Shingles taken at a time, to bound the memory for long texts.
STEP = 1 << 14
#: Classes of shingles whose parities tell sets apart before their shingles are compared.
PARITIES = 512
#: Texts that a worker is sent at a time, and of which it holds the shingles: a few MB each.
BATCH_ROWS = 512

_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """The distinct hashes of all runs of `size` words, rising."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    each = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    size = min(size, len(each))
    found = np.zeros(len(each) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            found = found * _ODD + each[k : k + len(found)]
        return np.unique(_mixed(found))


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def fingerprint_words(hashes: np.ndarray) -> tuple[list[int], list[int]]:
    """The words of a fingerprint, each bit set where it is in over half the shingles' hashes; and extremes of the hashes, to stand beside the words."""
    ones, ends = [], []
    for k in range(BITS * WORDS // 64):
        count, least, most = np.zeros(64, np.int64), np.uint64(2**64 - 1), np.uint64(0)
        for at in range(0, len(hashes), STEP):
            with np.errstate(over="ignore"):
                own = _mixed(hashes[at : at + STEP] + np.uint64(k + 1) * _ODD)
            count += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            least, most = min(least, own.min()), max(most, own.max())
        ones.append(count)
        ends += [least, most]
    is_set = np.concatenate(ones) * 2 > len(hashes)
    words = (is_set.reshape(WORDS, BITS) @ (1 << np.arange(BITS, dtype=np.int64))).tolist()
    return words, np.array(ends, np.uint64).view(np.int64).tolist()


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether an odd number of the hashes fall in each of `PARITIES` classes, as bits. Two sets differ in at least as many elements as these in bits."""
    odd = np.bincount((hashes % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _part_apart(similarity: float) -> float:
    """The part of the bits that two equally large sets of this Jaccard similarity differ in."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def words_used(similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """How many words have to emit variants."""
    p = _part_apart(similarity)
    near = similarity * sum(math.comb(BITS, k) * p**k * (1 - p) ** (BITS - k) for k in range(3))
    n = max(1, math.ceil(math.log(1 - recall) / math.log(1 - near)))
    if n > BITS * WORDS // 32:
        raise ValueError(f"a recall of {recall} at a similarity of {similarity} takes {n} words, more than a fingerprint has extremes")
    return n


def prefix_length(n: int, similarity: float) -> tuple[int, int]:
    """How many elements to take, first in any common order, of a set of `n`; and how many of them a set of at least this similarity has among its own."""
    spare = lambda n: n - math.ceil(similarity * n - 1e-9)
    if 2 * spare(n) + 1 > n:
        return n, min(n, 1)
    # The first k common elements are among the first spare + k of either set; the other set may be smaller.
    return 2 * spare(n) + 1, spare(math.ceil(similarity * n - 1e-9)) + 1


def _texts(column: pa.Array) -> Iterator[bytes]:
    return (t.as_py() or b"" for t in column.cast(pa.binary()))


def _fingerprints(size: int, similarity: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *others, texts = batch.columns
            found = []
            for t in _texts(texts):
                hashes = shingle_hashes(t, size)
                length, need = prefix_length(len(hashes), similarity)
                # A copy: a part of the array would keep the whole of it.
                found.append((*fingerprint_words(hashes), hashes[:length].copy().view(np.int64), need))
            columns = [pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in range(3)]
            needs = pa.array([f[3] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*others, *columns, needs], names=[*batch.schema.names[:-1], "words", "ends", "prefix", "need"])
        pa.default_memory_pool().release_unused()  # the worker waits for other tasks with what it keeps

    return run


def _shingles(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_hashes(t, size) for t in _texts(batch.column(1))]
            columns = [pa.array(c, pa.list_(pa.int64())) for c in ([h.view(np.int64) for h in found], [parities(h) for h in found])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["node", "shingles", "parities"])
        pa.default_memory_pool().release_unused()

    return run


def _variants(nodes: DataFrame, n: int) -> DataFrame:
    """(bucket, node): of the first `n` words each as it is and with each of its bits flipped, beside the hash of its place."""
    flips = ", ".join(["0L", *(f"{1 << b}L" for b in range(BITS))])
    bucket = f"explode(flatten(transform(slice(words, 1, {n}), (w, i) -> transform(array({flips}), f -> xxhash64(i, ends[i], w ^ f)))))"
    return nodes.select(F.expr(bucket).alias("bucket"), "node")


def ties(spark: SparkSession, nodes: DataFrame, n: int) -> DataFrame:
    """Distinct (a, b), a > b, among the fingerprints that share a variant: each with the least that has it."""
    shared = _variants(nodes, n).groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("greatest"), F.count("*").alias("n"))
    shared = stored(spark, shared.where("least < greatest"), "shared-variants")
    pairs = shared.where("n = 2").select(F.col("greatest").alias("a"), F.col("least").alias("b"))
    larger = stored(spark, shared.where("n > 2").select("bucket", "least"), "larger-buckets")
    members = marked(_variants(nodes, n), "bucket", marks(spark, larger.select("bucket"))).where("__marked")
    tied = members.join(larger, "bucket").where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return pairs.unionByName(tied).distinct()


def _bits_apart(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def links(spark: SparkSession, docs: DataFrame, prints: DataFrame, nodes: DataFrame, n: int, shingle: int, similarity: float) -> DataFrame:
    """(a, b): ties whose texts are near copies."""
    p, total = _part_apart(similarity), BITS * WORDS
    most = math.ceil(p * total + SLACK * math.sqrt(p * (1 - p) * total))
    tied = ties(spark, nodes, n)
    words = lambda name: nodes.select(F.col("node").alias(name), F.col("words").alias(f"words_{name}"))
    close = tied.join(words("a"), "a").join(words("b"), "b").where(_bits_apart("words_a", "words_b") <= most)
    close = stored(spark, close.select("a", "b"), "close-ties")
    return _alike(close, shingle_sets(spark, docs, prints, _ends_of(close), shingle), similarity)


def _ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def shingle_sets(spark: SparkSession, docs: DataFrame, prints: DataFrame, tested: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles, parities) of the nodes in `tested`; the text of a node is that of its first row."""
    keys = stored(spark, prints.join(tested, F.col("place") == F.col("node"), "left_semi").select("key", F.col("place").alias("node")), "tested")
    texts = docs.select(row_key(F.col("doc_id"), F.xxhash64("text")).alias("key"), "text")
    texts = marked(texts, "key", marks(spark, keys.select("key"))).where("__marked").join(keys, "key").dropDuplicates(["node"])
    with batches_of(spark, BATCH_ROWS):
        return stored(spark, texts.select("node", "text").mapInArrow(_shingles(shingle), "node long, shingles array<long>, parities array<long>"), "shingles")


def _alike(close: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that are near copies by their shingles."""
    # Each side gets the sets of its own ends only; the least ends are few.
    of = lambda name: sets.join(close.select(F.col(name).alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias(name), F.col("shingles").alias(f"of_{name}"))
    pairs = close.join(of("b"), "b").join(of("a"), "a")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    alike = shared >= F.lit(similarity) * (F.size("of_a") + F.size("of_b") - shared)
    return pairs.where(alike).select("a", "b")


def missed_links(spark: SparkSession, docs: DataFrame, prints: DataFrame, groups: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): the groups of `groups` (node, component) that a pair of near copies links which shares no variant.

    Exact, by prefixes: of two near copies the first shingles in any one order, two fifths of them, share some. First in order of the hashes, which needs no
    counts and leaves the nodes that share enough of them with other groups. Then among these in order of how many have a shingle, where those that one
    node alone has come first and need no bucket, and very frequent ones last. What shares a bucket across groups is tested, if by the places of the
    shingle in both orders and by the parities of all their shingles it may be near copies.
    """
    first = prints.join(groups, F.col("place") == F.col("node"))
    # 40 bits of a token compress better; where two tokens share them, more nodes stay.
    first = first.select("node", "component", "need", F.explode("prefix").alias("token")).withColumn("token", F.shiftrightunsigned("token", 24))
    spans = F.min("component") != F.max("component")
    # Most tokens are one node's: counts alone take half the shuffle of components, which only those of several nodes need.
    several = stored(spark, first.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token"), "tokens-of-several")
    first = marked(first, "token", marks(spark, several)).where("__marked").drop("__marked")
    across = stored(spark, first.groupBy("token").agg(spans.alias("spans")).where("spans").select("token"), "tokens-across")
    held = marked(first, "token", marks(spark, across)).where("__marked").join(across, "token", "left_semi")
    nodes = stored(spark, held.groupBy("node", "need").agg(F.count("*").alias("n")).where("n >= need").select("node"), "nodes-across")
    sets = shingle_sets(spark, docs, prints, nodes, shingle)
    each = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    counts = stored(spark, each.groupBy("token").agg(F.count("*").alias("n_nodes")).where("n_nodes > 1"), "token-counts")
    known = marked(each, "token", marks(spark, counts.select("token"))).where("__marked").join(counts, "token").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("n_nodes", "token"))).alias("shared"))
    length = F.col("n") - F.ceil(F.col("n") * F.lit(similarity) - 1e-9) + 1 - (F.col("n") - F.size("shared"))
    left = F.size("shared") - F.col("at")
    taken = known.select("node", "n", "shared", F.posexplode(F.slice("shared", F.lit(1), F.greatest(length, F.lit(0)).cast("int"))).alias("at", "t")).select("node", "n", left.alias("left"), "t.token")
    posted = stored(spark, taken.join(groups, "node").select("node", "component", "n", "left", "token"), "postings")
    open_tokens = stored(spark, posted.groupBy("token").agg(spans.alias("spans")).where("spans").select("token"), "open-tokens")
    posted = posted.join(open_tokens, "token", "left_semi").join(sets.select("node", "parities"), "node")
    posted = stored(spark, posted, "open-postings")
    side = lambda x: posted.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "component", "n", "left", "parities")])
    # At the first shingle they share, two near copies both have enough left to share; and they differ in few of all.
    both = F.col("n_a") + F.col("n_b")
    enough = F.least("left_a", "left_b") >= both * F.lit(similarity / (1 + similarity)) - 1e-9
    few = _bits_apart("parities_a", "parities_b") <= both * F.lit((1 - similarity) / (1 + similarity)) + 1e-9
    met = side("a").join(side("b"), "token").where(F.col("component_a") > F.col("component_b")).where(enough).where(few)
    close = stored(spark, met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), "close-across")
    found = _alike(close, sets, similarity)
    of = lambda name: groups.select(F.col("node").alias(name), F.col("component").alias(f"of_{name}"))
    return found.join(of("a"), "a").join(of("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct()


def grouped(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(key, doc_id, place, component) of each row; `key` names its id and text, and `place` the row."""
    n = words_used(similarity, recall)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(row_key(F.col("doc_id"), F.xxhash64("text")).alias("key"), "doc_id", F.monotonically_increasing_id().alias("place"), "text")
    with batches_of(spark, BATCH_ROWS):
        prints = stored(spark, rows.mapInArrow(_fingerprints(shingle, similarity), f"key string, doc_id {kind}, place long, words array<long>, ends array<long>, prefix array<long>, need long"), "fingerprints")
    nodes = stored(spark, prints.groupBy("words", "ends").agg(F.min("place").alias("node"), F.count("*").alias("n")), "nodes")
    found = components(spark, links(spark, docs, prints, nodes, n, shingle, similarity))
    groups = nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    groups = stored(spark, groups, "groups-by-variants")
    joined = components(spark, missed_links(spark, docs, prints, groups, shingle, similarity))
    joined = groups.join(joined.toDF("component", "least"), "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    joined = stored(spark, joined, "node-components")
    # Most rows are a node: only the copies of one carry their fingerprints through a join.
    own = prints.select("key", "doc_id", "place").join(joined, F.col("place") == F.col("node")).select("key", "doc_id", "place", "component")
    copied = stored(spark, nodes.where("n > 1").join(joined, "node").select("words", "ends", "node", "component"), "copied-nodes")
    copies = prints.join(copied, ["words", "ends"]).where("place != node").select("key", "doc_id", "place", "component")
    return own.unionByName(copies)


def drop_near_copies(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """`docs` with all columns, and one row of each group of near copies."""
    rows = settled(spark, lambda: grouped(spark, docs, shingle, similarity, recall), "near-copies")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))).alias("first")
    groups = rows.groupBy("component").agg(first, F.count("*").alias("n"))
    groups = stored(spark, groups.where("n > 1").select("component", F.col("first.key").alias("kept")), "near-copy-groups")
    # Rows that go, or that are there more than once; all others stay as they are.
    each = rows.join(groups, "component").groupBy("key").agg(F.max(F.col("key") == F.col("kept")).alias("__keep"), F.count("*").alias("n"))
    each = stored(spark, each.where("n > 1 OR NOT __keep").select(F.col("key").alias("__key"), "__keep"), "near-copy-rows")
    keyed = docs.withColumn("__key", row_key(F.col("doc_id"), F.xxhash64("text")))
    keyed = marked(keyed, "__key", marks(spark, each.select("__key")))
    # Of a kept row that is repeated, one of its copies; all others have a key of their own.
    some = keyed.where("__marked").join(each, "__key", "left").where(F.coalesce("__keep", F.lit(True))).dropDuplicates(["__key"])
    return keyed.where("NOT __marked").select(*docs.columns).unionByName(some.select(*docs.columns))
