"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints at 3 or fewer differing bits are linked. Half that radius is one and a half bits: the 64 bits
are cut into three blocks, and for each block a fingerprint emits itself with the block set aside and
at most one of the other bits flipped (131 variants). Of two fingerprints at distance 3, some block holds exactly one
of the differing bits, or one holds all three. With it set aside at most two remain, and each side flips one: they
share a variant. Full balls of radius 2, which need no block, would be 2,081 variants.

Within the fingerprints that share a variant, the block decides: those that are equal there but for one erased bit differ
in at most three bits. Where several share a variant unflipped, all their differing bits are in the block, and the same
is done there: each also emits its block with one bit flipped and one erased. All members of such
a group are links by construction, so each is tied to the least member instead of emitting pairs, and no link is lost.
Equal fingerprints are one node, so exact copies never meet, and a shared variant is shuffled once.

Defined results: null, empty and blank texts have no words and the fingerprint zero, which is linked
like any other; fewer than three words make one shingle; null ids count for no component's smallest id;
rows that repeat an id have one result each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored
from .components import components

SHINGLE = 3
HASH_SEED = 42
#: Lowest bit and number of bits of each block that is set aside in turn.
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Shingles hashed at a time, to bound the memory for long texts.
STEP = 1 << 15


def fingerprint(text: bytes) -> int:
    """The 64 bits, as a signed number, of a text in UTF-8."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    size = min(SHINGLE, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    stops = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(starts), STEP):
        spans = zip(starts[k : k + STEP], stops[k : k + STEP])
        hashes = np.array([digest(joined[i:j], HASH_SEED) for i, j in spans], dtype=np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view(np.int64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *others, texts = batch.columns
        prints = pa.array([fingerprint(t.as_py() or b"") for t in texts.cast(pa.binary())], pa.int64())
        yield pa.RecordBatch.from_arrays([*others, prints], names=[*batch.schema.names[:-1], "fingerprint"])


def fingerprints(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, `more`, fingerprint) of each row."""
    texts = docs.select("doc_id", *more, "text")
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in texts.schema.fields[:-1]]
    return texts.mapInArrow(_fingerprint_batches, ", ".join([*kinds, "fingerprint long"]))


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct fingerprints in `fingerprint`, whose closure is that of all links."""
    # Written as one text each: hundreds of column calls would take longer than the query's small tables.
    texts = lambda rows: "array(" + ", ".join(f"struct({x} AS x, {y} AS y)" for x, y in rows) + ")"
    bits = [range(low, low + width) for low, width in BLOCKS]
    flips = texts((n, b) for n, block in enumerate(bits) for b in [-1, *range(64)] if b not in block)
    near = [texts((-1, e) for e in [-1, *block]) for block in bits]
    within = [texts((f, e) for f in block for e in block if f != e) for block in bits]
    of_block = lambda columns: F.element_at(F.array(*columns), F.col("block") + 1)
    bit = lambda c: F.when(c < 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), c))
    insides = of_block([F.lit(_signed(((1 << w) - 1) << low)) for low, w in BLOCKS])
    fp = F.col("fp")
    variants = prints.select(F.col("fingerprint").alias("fp"), F.explode(F.expr(flips)).alias("c"))
    variants = variants.select("fp", F.col("c.x").alias("block"), (F.col("c.y") < 0).cast("int").alias("plain"), fp.bitwiseXOR(bit(F.col("c.y"))).alias("variant"))
    variants = variants.withColumn("variant", F.col("variant").bitwiseAND(F.bitwise_not(insides)))

    bucket = ["variant", "block"]
    whole = Window.partitionBy(*bucket)
    shared = variants.withColumn("n", F.count("*").over(whole)).withColumn("plains", F.sum("plain").over(whole)).where("n > 1")
    shared = shared.withColumn("inside", fp.bitwiseAND(insides))
    shared = shared.withColumn("least", F.min("fp").over(Window.partitionBy(*bucket, "inside")))
    # Members that are equal inside go on as one, but for what only an unflipped member can emit.
    changes = F.when(fp == F.col("least"), of_block(map(F.expr, near))).otherwise(F.expr(texts([(-1, -1)])))
    changes = F.when((F.col("plain") == 1) & (F.col("plains") > 1), F.concat(changes, of_block(map(F.expr, within)))).otherwise(changes)
    spread = shared.select(*bucket, "fp", "inside", F.explode(changes).alias("c"))
    inside = F.col("inside").bitwiseXOR(bit(F.col("c.x"))).bitwiseAND(F.bitwise_not(bit(F.col("c.y"))))
    spread = spread.select(*bucket, "fp", F.col("c.y").alias("erased"), inside.alias("inside"))
    tied = spread.select("fp", F.min("fp").over(Window.partitionBy(*bucket, "erased", "inside")).alias("least"))
    return tied.where("fp != least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()


def _grouped(spark: SparkSession, prints: DataFrame) -> DataFrame:
    """`prints` with the component and the smallest id in it, which another component may have too where ids are repeated."""
    prints = stored(spark, prints, "fingerprints")
    nodes = stored(spark, prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    found = components(spark, links(nodes))
    of = nodes.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    of = of.select("fingerprint", "least_id", F.coalesce("component", "fingerprint").alias("component"))
    of = stored(spark, of, "fingerprint-components")
    least = stored(spark, of.groupBy("component").agg(F.min("least_id").alias("component_id")), "component-ids")
    of = stored(spark, of.join(least, "component").select("fingerprint", "component", "component_id"), "components")
    return prints.join(of, "fingerprint")


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint in hex, component_id) of every row; one row per document, no pairs."""
    print_hex = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return _grouped(spark, fingerprints(docs)).select("doc_id", print_hex.alias("fingerprint"), "component_id")
