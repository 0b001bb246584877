"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Each text gives some twenty statistics (shares of characters, words, repeats and lines). Their
standardised values go through cosines of random projections, which approximate a Gaussian kernel, and
a ridge regression is fitted by its normal equations, summed per partition. Scores of labelled rows that had no part in the fit
are counted in bins, and pooling adjacent violators over the bins turns scores into shares of label 1.

Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0: 2, 3 and 4 for the fit, 1 for
the calibration. At most about `FIT_ROWS` labelled rows are used, chosen by a hash of the id, so what is
summed on the driver has a fixed size: `FIT_PARTS` matrices and `BINS` counts. Statistics come from the text alone; labels,
lang, source and doc_id are no input of a score. Scoring reads each text where it lies and shuffles none.

Defined results: null and empty texts have statistics of zero words and are scored like others; rows without an id
are held out; ids with several labels count as label 1 if any label is 1; without labels of both
kinds every score is the share of label 1, or 0.5 without labels; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filled, stored

FOLDS = 5
THRESHOLD = 0.3
#: Bound on labelled rows in the fit and the calibration.
FIT_ROWS = 200_000
FIT_PARTS = 16
FEATURES = 256
RIDGE = 1e-3
BINS = 1024
#: Bytes of text whose statistics are taken at a time.
STEP = 1 << 20

_PUNCTUATION, _QUOTES = b".,;:?-()", b"'\""
_CLASS = np.zeros(256, np.uint8)
_CLASS[np.frombuffer(b" \t\x0b\x0c\r", np.uint8)] = 1
_CLASS[10] = 2
_CLASS[48:58] = 3
_CLASS[65:91] = 4
_CLASS[97:123] = 5
_CLASS[128:] = 6
_CLASS[33:48] = _CLASS[58:65] = _CLASS[91:97] = _CLASS[123:127] = 7  # other symbols
_CLASS[np.frombuffer(_PUNCTUATION + _QUOTES, np.uint8)] = 8
_CLASS[ord("!")] = 9
_RANDOM = np.random.default_rng(42)
_BYTE_HASH = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE_HASH = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

N_STATS = 20


def _runs(inside: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at the texts' `edges`."""
    cut = np.zeros(len(inside) + 1, bool)
    cut[edges] = True
    before = np.concatenate(([False], inside))
    after = np.concatenate((inside, [False]))
    return np.flatnonzero(after & (cut | ~before)), np.flatnonzero(before & (cut | ~after))


def _run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run's bytes and their places."""
    place = np.arange(len(data), dtype=np.int64)
    if len(starts):
        place -= np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(data)]))))
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE_HASH[data] * _PLACE_HASH[place & 63], dtype=np.uint64)))
        return total[ends] - total[starts]


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    return np.bincount(o[new], minlength=n)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of `N_STATS` per text; text i is the bytes from offsets[i] to offsets[i + 1]."""
    n = len(offsets) - 1
    kind = _CLASS[data]
    start, end = offsets[:-1], offsets[1:]
    size = (end - start).astype(float)
    per = np.maximum(size, 1)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return (total[end] - total[start]).astype(float)

    space, line_end, digit, upper, lower, beyond, symbol, mark, shout = (count(kind == k) for k in range(1, 10))
    pipe = count(data == ord("|"))
    letters = np.maximum(upper + lower, 1)

    s, e = _runs((kind != 1) & (kind != 2), offsets)
    owner = np.searchsorted(offsets, s, side="right") - 1
    words = np.bincount(owner, minlength=n).astype(float)
    per_word = np.maximum(words, 1)
    length = e - s
    hashes = _run_hashes(data, s, e)
    again = np.zeros(len(s), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    total = lambda mask: np.bincount(owner[mask], minlength=n)
    last = kind[e - 1] if len(e) else kind[:0]

    ls, le = _runs(kind != 2, offsets)
    line_owner = np.searchsorted(offsets, ls, side="right") - 1
    lines = np.bincount(line_owner, minlength=n).astype(float)
    per_line = np.maximum(lines, 1)
    line_last = data[le - 1] if len(le) else data[:0]
    stop = (line_last == ord(".")) | (line_last == ord("?")) | (line_last == ord("!"))

    return np.column_stack([
        space / per, line_end / per, digit / per, upper / letters, beyond / per, symbol / per, mark / per, shout / per, pipe / per,
        np.log1p(words),
        np.bincount(owner, weights=length, minlength=n) / per_word,
        total(length <= 3) / per_word,
        total(length > 15) / per_word,
        total(again) / per_word,
        _distinct(owner, hashes, n) / per_word,
        total((last == 7) | (last == 9)) / per_word,
        np.log1p(lines),
        np.log1p(size / per_line),
        1 - _distinct(line_owner, _run_hashes(data, ls, le), n) / per_line * (lines > 0),
        np.bincount(line_owner[stop], minlength=n) / per_line,
    ])


def batch_statistics(texts: pa.Array) -> np.ndarray:
    """Statistics of a batch's texts, some `STEP` bytes at a time."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    out, k = [np.zeros((0, N_STATS))], 0
    while k < len(texts):
        stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + STEP, side="right")) - 1)
        stop = min(stop, len(texts))
        out.append(statistics(data[offsets[k] : offsets[stop]], offsets[k : stop + 1] - offsets[k]))
        k = stop
    return np.concatenate(out)


def _statistics_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch_statistics(batch.column(2)).astype(np.float32)
        column = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * N_STATS, pa.int32()), pa.array(values.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), column], names=["doc_id", "fold", "stats"])


def fold(doc_id: Column) -> Column:
    return F.crc32(filled(doc_id.cast("string"))) % FOLDS


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, fold, stats) of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", fold(F.col("doc_id")).alias("fold"), "text").mapInArrow(_statistics_batches, f"doc_id {kind}, fold long, stats array<float>")


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    #: Raw scores and the calibrated scores there, both rising.
    at: np.ndarray
    score: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return _features(stats, self.mean, self.scale) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(stats), self.score[0])
        raw = self.raw(stats)
        # A little of the raw score keeps the order within calibrated steps.
        return np.clip(0.999 * np.interp(raw, self.at, self.score) + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


@functools.cache
def _projection() -> tuple[np.ndarray, np.ndarray]:
    """Directions and phases; the kernel's width is the square root of the number of statistics."""
    rng = np.random.default_rng(7)
    return rng.normal(0, N_STATS**-0.5, (N_STATS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)


def _features(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    x = np.clip((stats - mean) / scale, -8, 8)
    directions, phases = _projection()
    return np.column_stack([np.ones(len(x)), np.sqrt(2 / FEATURES) * np.cos(x @ directions + phases)])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, N_STATS)


def _normal_equations(mean: np.ndarray, scale: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = FEATURES + 1
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = _features(_matrix(batch.column(0)), mean, scale)
            y = np.asarray(batch.column(1), np.float64)
            total += z.T @ np.column_stack([z, y])
        yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})

    return run


def _binned(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(_matrix(batch.column(0)))
            bins = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"bin": bins, "quality": np.asarray(batch.column(1), np.int64)})

    return run


def pooled(counts: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The rising shares nearest to ones / counts, by pooling adjacent violators."""
    blocks: list[list[float]] = []  # ones, count, bins
    for n, k in zip(counts, ones):
        blocks.append([k, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            k2, n2, m2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + k2, blocks[-1][1] + n2, blocks[-1][2] + m2]
    return np.concatenate([np.full(int(m), k / n) for k, n, m in blocks])


def fit(spark: SparkSession, stats: DataFrame, labels: DataFrame) -> Model:
    """The model, from the statistics of labelled rows outside the held-out fold."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("long").alias("quality"))
    train = stats.where("fold != 0").join(known, "doc_id").select("doc_id", "fold", "stats", "quality")
    train = stored(spark, train, "labelled-statistics")
    rows, ones = train.agg(F.count("*"), F.coalesce(F.sum("quality"), F.lit(0))).first()
    empty = np.zeros(0)
    if ones in (0, rows):
        return Model(empty, empty, empty, empty, np.array([ones / rows if rows else 0.5]))
    draw = F.pmod(F.xxhash64(F.lit("fit"), F.col("doc_id")), F.lit(1 << 20)) / float(1 << 20)
    train = train.where(draw < FIT_ROWS / rows)

    moments = [f(F.get("stats", F.lit(i))) for f in (F.avg, F.stddev_pop) for i in range(N_STATS)]
    moments = np.array(train.agg(*[F.coalesce(m, F.lit(0.0)) for m in moments]).first(), float)
    mean, scale = moments[:N_STATS], np.maximum(moments[N_STATS:], 1e-6)
    for_fit = train.where("fold != 1").select("stats", "quality").repartition(FIT_PARTS)
    parts = for_fit.mapInArrow(_normal_equations(mean, scale), "sums binary").collect()  # FIT_PARTS of a fixed size
    size = FEATURES + 1
    sums = sum(np.frombuffer(p.sums).reshape(size, size + 1) for p in parts)
    penalty = np.diag([1e-9] + [RIDGE * max(sums[0, 0], 1)] * FEATURES)
    weights = np.linalg.solve(sums[:, :size] + penalty, sums[:, size])

    model = Model(mean, scale, weights, empty, empty)
    some = train.where("fold = 1") if train.where("fold = 1").take(1) else train
    bins = some.select("stats", "quality").mapInArrow(_binned(model), "bin long, quality long")
    bins = sorted(bins.groupBy("bin").agg(F.count("*"), F.sum("quality")).collect())  # BINS at most
    numbers, counts, ones = (np.array(c, float) for c in zip(*bins))
    return Model(mean, scale, weights, (numbers + 0.5) / BINS * 2 - 0.5, pooled(counts, ones))


def _scored(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(_matrix(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], names=["doc_id", "fold", "score"])

    return run


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    stats = stored(spark, document_statistics(docs), "statistics")
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = stats.mapInArrow(_scored(fit(spark, stats, labels)), f"doc_id {kind}, fold long, score double")
    return scored.select("doc_id", (F.col("fold") == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _kept(model: Model, place: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch_statistics(batch.column(place))) >= THRESHOLD))
        pa.default_memory_pool().release_unused()  # the worker waits for other tasks with what it keeps

    return run


def drop_rejected(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` with all columns, without the documents scored below the threshold."""
    stats = document_statistics(docs)
    return docs.mapInArrow(_kept(fit(spark, stats, labels), docs.columns.index("text")), docs.schema)
