"""Fill-in-the-middle transformation on seekable compressed frames.

Texts are stored as independent zstandard frames of about `FRAME` bytes, each with the number of units (runs of letters, and all
other characters singly) that begin in it and before it. A document's two cuts follow from its id and its number of
units, so the counts alone tell which frames a cut falls into: only these are decompressed and split, all others pass on as
they are, as frames of the output. Digests stream a document's frames in order, one at a time.

The text is rebuilt from the output and its form: the markers tell where the parts begin, and the parts are read in the order of the text.
A document of one frame is done in its own row. The frames of longer ones are shuffled by document once; a digest of a whole
text is sequential, so one document is one task's, but never whole in its memory.

Defined results: null and empty texts have no units and stay plain; a null id is hashed as the empty text; rows that repeat an id are cut by the same
draws; texts with a marker stay plain; an empty table gives an empty result; other columns of `docs` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filled, stored

PREFIX, SUFFIX, MIDDLE = MARKERS = (b"<P>", b"<S>", b"<M>")
#: Documents of a hundred that are transformed, and of these, suffix first.
RATE, SUFFIX_FIRST = 90, 20
SEED = 1
#: Bytes of a frame before compression, but for a cut character.
FRAME = 1 << 15

#: The parts of each form's output in order; prefix, middle and suffix are parts 0 to 2 of the text.
ORDERS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1)), "plain": ((b"", 0),)}


def unit_starts(data: bytes, joined: bool) -> np.ndarray:
    """The bytes at which units begin; `joined` tells that a letter stands before the first."""
    codes = np.frombuffer(data, np.uint8)
    low = codes | 32
    letter = (low >= 97) & (low <= 122)
    follows = np.concatenate(([joined], letter[:-1])) & letter
    return np.flatnonzero(~follows & ((codes & 0xC0) != 0x80))


def n_chars(data: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def _frames(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            rows = {"of": [], "n": [], "marked": [], "n_frames": [], "frame": [], "joined": [], "before": [], "units": [], "chars": [], "data": []}
            for row, text in enumerate(batch.column(2).cast(pa.binary())):
                text = text.as_py()
                found, n, at = [], 0, 0
                while True:
                    end = min(at + size, len(text))
                    while end < len(text) and text[end] & 0xC0 == 0x80:
                        end += 1
                    data = text[at:end]
                    joined = at > 0 and text[at - 1 : at].isalpha()  # of bytes: ASCII letters
                    units = len(unit_starts(data, joined))
                    found.append((len(found), joined, n, units, n_chars(data), pack(data)))
                    n, at = n + units, end
                    if at >= len(text):
                        break
                marked = any(m in text for m in MARKERS)
                for values in found:
                    for column, value in zip(rows.values(), (row, n, marked, len(found), *values)):
                        column.append(value)
            of = pa.array(rows.pop("of"), pa.int64())
            kinds = {"marked": pa.bool_(), "joined": pa.bool_(), "data": pa.binary()}
            columns = [pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *columns], names=["place", "doc_id", *rows])

    return run


def text_frames(spark: SparkSession, docs: DataFrame, size: int = FRAME) -> DataFrame:
    """The frames of all texts: (place, doc_id, n, marked, n_frames, frame, joined, before, units, chars, data).

    `place` names the row, `n` counts its units, `before` those before the frame and `units` those that begin in it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(F.monotonically_increasing_id().alias("place"), "doc_id", filled("text").alias("text"))
    schema = f"place long, doc_id {kind}, n long, marked boolean, n_frames long, frame long, joined boolean, before long, units long, chars long, data binary"
    return stored(spark, texts.mapInArrow(_frames(size), schema), "frames")


def _hashes(doc_id: Column, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), filled(doc_id.cast("string"))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def planned(frames: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """`frames` with the form of their document and the units after which its prefix and its middle end."""
    h1, h2, h3, h4 = _hashes(F.col("doc_id"), seed)
    plain = (F.col("n") == 0) | F.col("marked") | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    cuts = [h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)]
    first, second = F.least(*cuts), F.greatest(*cuts)
    # Plain texts are all prefix.
    return frames.withColumns({"form": form, "first": F.when(plain, F.col("n")).otherwise(first), "second": F.when(plain, F.col("n")).otherwise(second)})


def split(data: bytes, joined: bool, cuts: tuple[int, int]) -> list[bytes]:
    """The frame's prefix, middle and suffix; `cuts` count its own units, and lie outside where it has no cut."""
    starts = unit_starts(data, joined)
    # Unit k begins at starts[k]; what comes before the first goes on with a unit of an earlier frame.
    ends = [0 if c < 0 else int(starts[c]) if c < len(starts) else len(data) for c in cuts]
    return [data[: ends[0]], data[ends[0] : ends[1]], data[ends[1] :]]


def output_of(parts: list[bytes], form: str) -> bytes:
    return b"".join(marker + parts[part] for marker, part in ORDERS[form])


def restored_of(output: bytes, form: str) -> bytes:
    """The text, from the output and its form alone."""
    order = ORDERS[form]
    if form == "plain":
        return output
    parts, end = {}, len(output)
    for marker, part in reversed(order):
        at = output.index(marker)
        parts[part], end = output[at + len(marker) : end], at
    return b"".join(parts[k] for k in range(3))


RESULT = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _whole(texts: bool) -> Callable:
    """The results of documents of one frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            doc_ids, *columns = batch.columns
            rows = []
            for n, form, first, second, data in zip(*(c.to_pylist() for c in columns)):
                parts = split(unpack(data), False, (first, second))
                output = output_of(parts, form)
                chars = [None, None] if form == "plain" else [n_chars(p) for p in parts[:2]]
                rows.append([n, form, *chars, _sha(output), _sha(restored_of(output, form)), output.decode() if texts else None])
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            names = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"]
            found = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)]
            yield pa.RecordBatch.from_arrays([doc_ids, *found[: 6 + texts]], names=["doc_id", *names[: 6 + texts]])

    return run


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The output's frames of each frame of a text: the frame itself, or the parts it is cut into; a document's markers come with its first."""
    pack, unpack = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
    for batch in batches:
        doc_ids = batch.column(1)
        rows = {"of": [], "section": [], "frame": [], "part": [], "chars": [], "data": []}
        columns = [batch.column(n).to_pylist() for n in ("form", "first", "second", "frame", "n_frames", "joined", "before", "units", "chars", "data")]
        for row, (form, first, second, frame, n_frames, joined, before, units, chars, data) in enumerate(zip(*columns)):
            # A cut at the text's end is no unit's beginning: it lies after all frames.
            where = [-1 if c < before else 0 if c < before + units else 1 for c in (first, second)]
            if 0 in where:
                parts = split(unpack(data), joined, (first - before, second - before))
                pieces = [(k, n_chars(p), pack(p)) for k, p in enumerate(parts) if p]
            else:
                pieces = [(where.index(1) if 1 in where else 2, chars, data)]
            order = {part: section for section, (_, part) in enumerate(ORDERS[form])}
            out = [(row, order[k], frame, k, c, d) for k, c, d in pieces]
            if frame == 0 and form != "plain":
                out += [(row, section, -1, -1, 0, pack(marker)) for section, (marker, _) in enumerate(ORDERS[form])]
            for values in out:
                for column, value in zip(rows.values(), values):
                    column.append(value)
        of = pa.array(rows.pop("of"), pa.int64())
        kept = [batch.column(0).take(of), doc_ids.take(of), batch.column("n").take(of), batch.column("form").take(of)]
        found = [pa.array(v, pa.binary() if k == "data" else pa.int64()) for k, v in rows.items()]
        yield pa.RecordBatch.from_arrays([*kept, *found], names=["place", "doc_id", "n", "form", *rows])


def output_frames(frames: DataFrame) -> DataFrame:
    """The outputs as compressed frames (place, doc_id, n, form, section, frame, part, chars, data), in order by (section, frame), markers among them."""
    kind = frames.schema["doc_id"].dataType.simpleString()
    used = frames.select("place", "doc_id", "n", "form", "first", "second", "frame", "n_frames", "joined", "before", "units", "chars", "data")
    return used.mapInArrow(_segments, f"place long, doc_id {kind}, n long, form string, section long, frame long, part long, chars long, data binary")


def _outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frames of outputs in order: each goes on with its rank in the text, told by the marker before it, and the last with the digest and the counts."""
    unpack = zstandard.ZstdDecompressor().decompress
    ranks = {marker: rank for rank, marker in enumerate((PREFIX, MIDDLE, SUFFIX))}
    place, digest, rank, chars, last = None, None, 0, [0, 0, 0], None

    def summary() -> dict:
        _, doc_id, n, form = last
        counts = [None, None] if form == "plain" else chars[:2]
        return {"place": place, "doc_id": doc_id, "n": n, "form": form, "prefix_chars": counts[0], "middle_chars": counts[1], "output_sha256": digest.hexdigest(), "rank": 3}

    for batch in batches:
        rows = []
        for row in zip(*(batch.column(n).to_pylist() for n in ("place", "doc_id", "n", "form", "data"))):
            *last_row, packed = row
            if last is None or row[0] != place:
                if last is not None:
                    rows.append(summary())
                place, digest, rank, chars = row[0], hashlib.sha256(), 0, [0, 0, 0]
            last = tuple(last_row)
            data = unpack(packed)
            digest.update(data)
            if row[3] != "plain" and data in ranks:
                rank = ranks[data]
                continue
            chars[rank] += n_chars(data)
            rows.append({"place": row[0], "rank": rank, "data": packed})
        yield pa.RecordBatch.from_pylist(rows, schema=_between(batch.schema.field("doc_id").type))
    if last is not None:
        yield pa.RecordBatch.from_pylist([summary()], schema=_between(batch.schema.field("doc_id").type))


def _between(kind: pa.DataType) -> pa.Schema:
    whole, text = pa.int64(), pa.string()
    return pa.schema([("place", whole), ("doc_id", kind), ("n", whole), ("form", text), ("prefix_chars", whole), ("middle_chars", whole), ("output_sha256", text), ("rank", whole), ("data", pa.binary())])


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document, from its frames in the order of the text and its summary after them."""
    unpack = zstandard.ZstdDecompressor().decompress
    digest = hashlib.sha256()
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if row["rank"] < 3:
                digest.update(unpack(row["data"]))
            else:
                rows.append({k: row[k] for k in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256")} | {"restored_sha256": digest.hexdigest()})
                digest = hashlib.sha256()
        whole, text = pa.int64(), pa.string()
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", batch.schema.field("doc_id").type), ("n", whole), ("form", text), ("prefix_chars", whole), ("middle_chars", whole), ("output_sha256", text), ("restored_sha256", text)]))


def long_digests(outputs: DataFrame) -> DataFrame:
    """The results of the documents whose output's frames are given."""
    kind = outputs.schema["doc_id"].dataType.simpleString()
    ordered = outputs.repartition("place").sortWithinPartitions("place", "section", "frame")
    found = ordered.mapInArrow(_outputs, f"place long, doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, rank long, data binary")
    # The same tasks go on: frames in the order of the text are those of its parts, each in the order they came.
    found = found.withColumn("came", F.monotonically_increasing_id()).sortWithinPartitions("place", "rank", "came").drop("came")
    return found.mapInArrow(_restored, f"doc_id {kind}, {RESULT}")


def fill_in_middle(spark: SparkSession, docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED, size: int = FRAME) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of each row of `docs`."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    frames = planned(text_frames(spark, docs, size), rate, suffix_first, seed)
    short = frames.where("n_frames = 1").select("doc_id", "n", "form", "first", "second", "data")
    short = short.mapInArrow(_whole(False), f"doc_id {kind}, {RESULT}")
    return short.unionByName(long_digests(output_frames(frames.where("n_frames > 1"))))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The output of each document from its frames in order."""
    unpack = zstandard.ZstdDecompressor().decompress
    schema, place, row, parts = None, None, None, []
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        schema = pa.schema([("doc_id", kind), ("form", pa.string()), ("output", pa.string())])
        for of, doc_id, form, data in zip(*(batch.column(n).to_pylist() for n in ("place", "doc_id", "form", "data"))):
            if row is not None and of != place:
                yield pa.RecordBatch.from_pylist([row | {"output": b"".join(parts).decode()}], schema=schema)
                parts = []
            place, row = of, {"doc_id": doc_id, "form": form}
            parts.append(unpack(data))
    if row is not None:
        yield pa.RecordBatch.from_pylist([row | {"output": b"".join(parts).decode()}], schema=schema)


def transformed(spark: SparkSession, docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED, size: int = FRAME) -> DataFrame:
    """(doc_id, form, output) of each row of `docs`: the texts to train on."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    frames = planned(text_frames(spark, docs, size), rate, suffix_first, seed)
    short = frames.where("n_frames = 1").select("doc_id", "n", "form", "first", "second", "data")
    short = short.mapInArrow(_whole(True), f"doc_id {kind}, {RESULT}, output string").select("doc_id", "form", "output")
    ordered = output_frames(frames.where("n_frames > 1")).repartition("place").sortWithinPartitions("place", "section", "frame")
    return short.unionByName(ordered.mapInArrow(_joined, f"doc_id {kind}, form string, output string"))
