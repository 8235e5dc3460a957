"""Resampling towards a target distribution by the importance of hashed n-grams, in two Arrow passes.

The first pass counts every partition's features into vectors of one number a bucket (np.bincount), which a tree of reductions adds
up; the target's texts are counted alike. The two vectors give each bucket a gain. The second pass gathers the broadcast gains of
every document's features and adds them up by document, again by np.bincount. A document's score is its weight and a draw of
its own from the Gumbel distribution, so that the highest scores are a sample without replacement.

A feature's bucket is its crc32. As crc32 is linear, that of "a b" follows from those of "a" and "b" and the length of "b"; so
words are hashed once, and no feature is ever put together as text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean_memory
from .words import _LOWER, parts_of, text_bytes

#: Bytes of words, once A-Z are folded: digits, a-z, and whatever is not ASCII.
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[128:] = True
#: Words longer than this are hashed one at a time.
_LONG = 256
#: A longer text is counted in pieces of about so many bytes.
_PIECE = 4 << 20


def _zero_byte(v: np.ndarray) -> np.ndarray:
    """v after a zero byte."""
    return _TABLE[v & np.uint32(255)] ^ (v >> np.uint32(8))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(crc32 by byte, shifts by 0 to 63 bytes, shifts by 2^6 to 2^40 bytes); a shift is four rows of 256, by byte of what is shifted."""
    global _TABLE
    v = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        v = np.where(v & np.uint32(1), (v >> np.uint32(1)) ^ np.uint32(0xEDB88320), v >> np.uint32(1))
    _TABLE = v
    shifts = [np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32)[:, None])]
    while len(shifts) < 65:
        shifts.append(_zero_byte(shifts[-1]))
    powers = [shifts.pop()]
    while len(powers) < 35:
        powers.append(_through(powers[-1].reshape(-1), 0, powers[-1]))
    return v, np.concatenate(shifts).reshape(-1), np.stack(powers).reshape(len(powers), -1)


def _through(table: np.ndarray, at: np.ndarray | int, v: np.ndarray) -> np.ndarray:
    """v shifted by the four rows of table from at on."""
    out = table[at + (v & np.uint32(255)).astype(np.intp)]
    for k in (1, 2, 3):
        out = out ^ table[at + 256 * k + (v >> np.uint32(8 * k) & np.uint32(255)).astype(np.intp)]
    return out


_TABLE = np.zeros(256, np.uint32)
_TABLE, _SHIFTS, _POWERS = _tables()
_SPACE = np.uint32(zlib.crc32(b" "))


def shifted(v: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What crc32 v of some bytes adds to the crc32 of those bytes with so many more after them."""
    out = _through(_SHIFTS, (sizes & 63) << 10, v)
    for j in range(6, int(sizes.max(initial=0)).bit_length()):
        some = np.flatnonzero(sizes >> j & 1)
        out[some] = _through(_POWERS[j - 6], 0, out[some])
    return out


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(crc32, starts, ends, row) of every word of texts end to end, already folded."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint32), none, none, none
    inside = _INSIDE[data]
    gap = np.ones(n + 1, bool)
    gap[1:n] = ~inside[:-1]
    gap[bounds] = True
    starts = np.flatnonzero(inside & gap[:n])
    stop = np.ones(n, bool)
    stop[:-1] = ~inside[1:] | gap[1:n]
    ends = np.flatnonzero(inside & stop) + 1
    sizes = ends - starts
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    rest, done = np.flatnonzero(sizes <= _LONG), 0
    at, left, own = starts[rest], sizes[rest], crc[rest]
    while len(rest):
        own = _TABLE[(own ^ data[at + done]) & np.uint32(255)] ^ (own >> np.uint32(8))
        done += 1
        over = left == done
        crc[rest[over]] = ~own[over]
        go = ~over
        rest, at, left, own = rest[go], at[go], left[go], own[go]
    for k in np.flatnonzero(sizes > _LONG).tolist():
        crc[k] = zlib.crc32(data[starts[k] : ends[k]])
    return crc, starts, ends, np.searchsorted(bounds, starts, "right") - 1


def _features(crc: np.ndarray, sizes: np.ndarray, row: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(crc32, row) of the runs of one to three words that end at a word k with first[k]."""
    found = [(crc[first], row[first])]
    before = crc
    for back in (1, 2):
        if len(crc) > back:
            run = shifted(_zero_byte(before[:-1]) ^ _SPACE, sizes[back:]) ^ crc[back:]
            whole = (row[back:] == row[:-back]) & first[back:]
            found.append((run[whole], row[back:][whole]))
            before = run
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _long_text(data: np.ndarray, piece: int) -> Iterator[tuple[np.ndarray, int]]:
    """Pieces of one text, cut between words, and how many words at the start of each are those that end the piece before."""
    at, carried = 0, b""
    while at < len(data):
        stop = min(at + piece, len(data))
        if stop < len(data):
            gaps = np.flatnonzero(~_INSIDE[data[at:stop]])
            while not len(gaps) and stop < len(data):  # one word fills it
                begin, stop = stop, min(stop + piece, len(data))
                gaps = np.flatnonzero(~_INSIDE[data[begin:stop]]) + begin - at
            stop = at + int(gaps[-1]) + 1 if len(gaps) else stop
        whole = np.concatenate([np.frombuffer(carried, np.uint8), data[at:stop]])
        yield whole, len(carried.split())
        _, starts, ends, _ = _words(whole, np.array([0, len(whole)]))
        carried = b"".join(whole[a:b].tobytes() + b" " for a, b in zip(starts[-2:], ends[-2:], strict=True))
        at = stop


def features(column: pa.Array, buckets: int, piece: int = _PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket of each feature, its row, words of each row) of a text column, in parts whose words add up."""
    data, bounds = text_bytes(column)
    data = _LOWER[data]
    if len(data) > piece:
        for row, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            for part, seen in _long_text(data[a:b], piece):
                crc, starts, ends, of = _words(part, np.array([0, len(part)]))
                bucket, rows = _features(crc, ends - starts, of, np.arange(len(crc)) >= seen)
                words = np.zeros(len(column), np.int64)
                words[row] = len(crc) - seen
                yield bucket % np.uint32(buckets), rows + row, words
        return
    crc, starts, ends, row = _words(data, bounds)
    bucket, rows = _features(crc, ends - starts, row, np.ones(len(crc), bool))
    yield bucket % np.uint32(buckets), rows, np.bincount(row, minlength=len(column))


def bucket_counts(texts: DataFrame, text_col: str, buckets: int) -> np.ndarray:
    """How many features of all texts fall in each bucket: a vector a partition, added up in a tree of which the driver sees the last few."""

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory("")
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for some in parts_of(batch, 0):
                for bucket, _, _ in features(some.column(0), buckets):
                    total += np.bincount(bucket, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    vectors = texts.select(text_col).mapInArrow(counting, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    n = vectors.getNumPartitions()
    return vectors.treeReduce(np.add, max(2, math.ceil(math.log(n, 32)))) if n else np.zeros(buckets, np.int64)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket, floor(1000 ln) of the target's share over the source's, both with one more in every bucket."""
    n, all_source, all_target = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_source + n) / ((s + 1.0) * (all_target + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, n_features, weight) of every row: the sum of the gains of its features."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def weighing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory("")
        gain = shared.value
        for batch in batches:
            for some in parts_of(batch, 1):
                words, count, weight = (np.zeros(some.num_rows, np.int64) for _ in range(3))
                for bucket, row, own in features(some.column(1), len(gain)):
                    words += own
                    count += np.bincount(row, minlength=some.num_rows)
                    weight += np.bincount(row, gain[bucket], some.num_rows).astype(np.int64)  # whole numbers far below 2^53
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(words), pa.array(count), pa.array(weight)], names=[id_col, "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(weighing, f"`{id_col}` {kind}, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = 10_000,
) -> DataFrame:
    """A row per row of docs: id, n_features, weight, score, rank (1, 2, 3... by falling score among the drawn, null for the rest), n_words.

    Of the rows with at least least_words words, percent in a hundred are drawn, rounded down: those of the highest scores, of equal
    ones those of the smaller id (null comes last), then whichever. A null text has no words and so weight 0; a null id draws as the
    empty text does. Repeated rows are drawn each by itself and share their draw. Empty tables give an empty result, an empty target weighs
    all buckets by the source alone. Other columns are not read.

    The result rests on all rows: only scores that may be drawn are sorted, above a quantile of all that has been counted to leave enough.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "importance")
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    draw = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = weighed(docs, gain, id_col, text_col).select(
        F.col(id_col).alias("_id"), "n_words", "n_features", "weight", (F.col("weight") + draw).cast("long").alias("score"), F.monotonically_increasing_id().alias("_row")
    )
    rows = scratch.save(rows, "scored")
    fit = F.col("n_words") >= least_words
    n = rows.where(fit).count()
    drawn = n * percent // 100
    cut = None
    if drawn:
        share = max(0.0, 1 - drawn / n - 2e-4)
        cut = rows.where(fit).agg(F.percentile_approx("score", share, 10_000)).first()[0]
        if rows.where(fit & (F.col("score") >= cut)).count() < drawn:
            cut = rows.agg(F.min("score")).first()[0]
    close = fit & (F.col("score") >= F.lit(cut)) if cut is not None else F.lit(False)
    order = [F.desc("score"), F.asc_nulls_last("_id"), F.asc("_row")]
    placed = scratch.save(rows.where(close).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "placed")
    part, first, starts = F.shiftright("_place", 33), 0, []
    for p, count in sorted(placed.groupBy(part.alias("p")).count().collect()):  # a row per partition
        starts.append((p, first))
        first += count
    starts = spark.createDataFrame(starts, "_part long, _first long")
    rank = F.col("_first") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("rank", F.when(rank <= drawn, rank))
    columns = [F.col("_id").alias(id_col), "n_features", "weight", "score", "rank", "n_words"]
    return ranked.select(*columns).unionByName(rows.where(~close).withColumn("rank", F.lit(None).cast("long")).select(*columns))
