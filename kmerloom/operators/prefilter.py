"""Hashes that can't reach a least count, dropped before they are shuffled.

Reads have many hashes that occur once, each of which would cross the network to be counted and dropped. Every partition counts its rows in a
count-min sketch of fixed size; the sketches are added up in a tree, and a second pass keeps the rows whose estimate reaches the least count.
An estimate is never below the count, so the exact count that follows finds all that it would have found. The more distinct
hashes there are for the room, the fewer go: what is right does not depend on the room, only what is saved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import saved

_TOP = 255


def _cells(keys: np.ndarray, depth: int, width: int) -> Iterator[np.ndarray]:
    """The places of keys (hashed already) in each row of a sketch."""
    with np.errstate(over="ignore"):
        for k in range(depth):
            x = (keys ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            yield ((x >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)).astype(np.int64) + k * width


def counted(cells: np.ndarray, keys: np.ndarray, depth: int) -> None:
    """Adds keys to a sketch, up to 255 a cell."""
    for at in _cells(keys, depth, len(cells) // depth):
        place, n = np.unique(at, return_counts=True)
        cells[place] = np.minimum(cells[place].astype(np.int64) + n, _TOP)


def estimated(cells: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """What a sketch has of keys: at least their counts, or 255."""
    return np.minimum.reduce([cells[at] for at in _cells(keys, depth, len(cells) // depth)])


def _keyed(found: DataFrame) -> DataFrame:
    return found.withColumn("_key", F.xxhash64("name", "hash"))


def count_sketch(found: DataFrame, room: int, depth: int) -> np.ndarray:
    """The count-min sketch of all rows' (name, hash), of room bytes."""
    size = max(1, room // depth) * depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(size, np.uint8)
        for batch in batches:
            counted(cells, batch.column(0).to_numpy().view(np.uint64), depth)
        yield pa.RecordBatch.from_arrays([pa.array([zstandard.compress(cells.tobytes(), 1)], pa.binary())], names=["cells"])

    def added(a: bytes, b: bytes) -> bytes:
        x, y = (np.frombuffer(zstandard.decompress(v), np.uint8) for v in (a, b))
        return zstandard.compress(np.where(x > _TOP - y, np.uint8(_TOP), x + y).astype(np.uint8).tobytes(), 1)

    parts = _keyed(found).select("_key").mapInArrow(run, "cells binary").rdd.map(lambda r: bytes(r[0]))
    n = parts.getNumPartitions()
    return np.frombuffer(zstandard.decompress(parts.treeReduce(added, max(2, math.ceil(math.log(n, 16)) if n > 1 else 2))), np.uint8) if n else np.zeros(size, np.uint8)


def likely(found: DataFrame, least: int, room: int = 16 << 20, depth: int = 4) -> DataFrame:
    """The rows of found (name, hash, s) without most of those whose (name, hash) occurs less than least times; all others stay.

    found is written to the shared folder once, as two passes read it. room bounds what is broadcast; least counts above 255 drop nothing that occurs so often.
    """
    if least < 2:
        return found
    found = saved(found, "prefilter")
    cells = found.sparkSession.sparkContext.broadcast(count_sketch(found, room, depth))  # of room bytes
    enough, columns = min(least, _TOP), found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = estimated(cells.value, batch.column(len(columns)).to_numpy().view(np.uint64), depth) >= enough
            yield batch.select(columns).filter(pa.array(keep))

    return _keyed(found).mapInArrow(run, found.schema)
