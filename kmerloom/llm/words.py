"""Words of a whole Arrow text column at once: their 64-bit hashes and where they stand, in numpy.

A word is a run of bytes other than the six ASCII white-space characters. Its bytes are taken eight at a time, and
each eight go through a mix that depends on all before them, so a column costs a few passes over its words
and no Python step per word. A seed that is drawn anew for a run makes collisions a matter of chance (2^-64 a pair of words);
who can't live with that compares bytes by same_words.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Words longer than this are hashed one at a time.
_LONG = 256
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def new_seed() -> int:
    """A seed for the words of one run."""
    return secrets.randbits(63)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds): the column's texts end to end, and len(column) + 1 bounds in them; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if large else np.int32
    bounds = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def parts_of(batch: pa.RecordBatch | pa.Table, text: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch | pa.Table]:
    """The batch in slices of at most so many bytes of text, or one row; text is the place of its column."""
    column = batch.column(text)
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)) if batch.num_rows else []
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto


class Eights:
    """Bytes with room to read eight of them from any place."""

    def __init__(self, data: np.ndarray):
        self.whole = np.zeros((len(data) >> 3) + 2, "<u8")
        self.whole.view(np.uint8)[: len(data)] = data

    @classmethod
    def over(cls, whole: np.ndarray) -> Eights:
        """Over 64-bit integers that end in two to spare."""
        self = cls.__new__(cls)
        self.whole = whole
        return self

    def at(self, places: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The eight bytes at each place as an integer, with zeros where fewer are left."""
        k, shift = places >> 3, ((places & 7) << 3).astype(np.uint64)
        low = self.whole[k] >> shift
        high = (self.whole[k + 1] << (np.uint64(63) - shift)) << np.uint64(1)
        return (low | high) & _MASKS[np.minimum(left, 8)]


def same_words(a: Eights, a_starts: np.ndarray, b: Eights, b_starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the words of equal sizes at a_starts in a and at b_starts in b have the same bytes."""
    same = np.ones(len(sizes), bool)
    rest, done = np.arange(len(sizes)), 0
    while len(rest):
        left = sizes[rest] - done
        same[rest] = equal = a.at(a_starts[rest] + done, left) == b.at(b_starts[rest] + done, left)
        done += 8
        rest = rest[equal & (left > 8)]
    return same


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, the place of one of each in keys, and for each key the place of its distinct one)."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], order[new], place


def hashed_words(column: pa.Array, fold: bool = True, seed: int = 0, block: int = 1 << 15) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first, bytes) of the words of a text column, with their ASCII case folded if fold, so many words at a time.

    starts and ends are places in bytes; words first[k] to first[k + 1] are those of row k.
    """
    data, bounds = text_bytes(column)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, np.zeros(len(bounds), np.int64), data
    if fold:
        data = _LOWER[data]
    gap = np.ones(n + 1, bool)  # gap[i]: no word goes on from byte i - 1 into byte i
    inside = ~_SPACE[data]
    gap[1:n] = ~inside[:-1]
    gap[bounds] = True
    starts = np.flatnonzero(inside & gap[:n])
    stop = np.ones(n, bool)
    stop[:-1] = ~inside[1:] | gap[1:n]
    ends = np.flatnonzero(inside & stop) + 1
    first = np.searchsorted(starts, bounds)
    sizes, eights = ends - starts, Eights(data)
    hashes = np.empty(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(starts), block):
            at, size = starts[lo : lo + block], sizes[lo : lo + block]
            h = mix64(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
            rest, done = np.flatnonzero(size <= _LONG), 0
            while len(rest):
                left = size[rest] - done
                h[rest] = mix64((h[rest] ^ eights.at(at[rest] + done, left)) * np.uint64(0xD6E8FEB86659FD93))
                done += 8
                rest = rest[left > 8]
            hashes[lo : lo + block] = h
    for k in np.flatnonzero(sizes > _LONG).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes(), seed)
    return hashes, starts, ends, first, data
