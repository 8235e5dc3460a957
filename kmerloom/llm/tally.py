"""Corpus-wide counts of keys, asked for and answered chunk by chunk.

Documents are dealt by a hash of id and text into chunks of bounded size. Each chunk asks for the keys that it
has, once each, with its own counts: sorted, cut into key ranges, delta-coded and packed. Each key range adds
up what all chunks have and answers every chunk in the order in which it asked. So a key that a third of all
documents have costs one entry per chunk, no count is broadcast, and what crosses the network grows as the
corpus does. The chunk's texts and its answers then meet in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean_memory


def packed(values: np.ndarray) -> bytes:
    """Integers as zstd over their bytes by place."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), 1)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys, packed as differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def ranges_of(keys: np.ndarray, n: int) -> np.ndarray:
    """n + 1 bounds of the key ranges in sorted keys; ranges cut the 64-bit space evenly."""
    edges = np.array([k * (1 << 64) // n for k in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def chunk_count(docs: DataFrame, text_col: str, chunk_bytes: int) -> int:
    """How many chunks to deal docs into: of chunk_bytes of text each, or more where the corpus is so large that what a chunk
    sends to a key range would fall under about a kilobyte (then chunks grow as the root of the corpus)."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, -(-total // max(chunk_bytes, math.isqrt(total << 10))))


def dealt(docs: DataFrame, id_col: str, text_col: str, chunks: int) -> DataFrame:
    """(_id, _text, _chunk): documents in chunks by a hash of id and text; a null text is empty."""
    chunk = F.pmod(F.xxhash64(id_col, text_col), F.lit(chunks)).cast("int").alias("_chunk")
    return docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), chunk).repartition(chunks, "_chunk")


ASKED = "_range int, _chunk int, _keys binary, _counts binary"
ANSWERED = "_chunk int, _range int, _answers binary, _distinct long, _once long, _total long"


def question(chunk: int, keys: np.ndarray, counts: np.ndarray, ranges: int) -> pa.Table:
    """What a chunk asks, a row per key range, as ASKED says; keys are sorted and distinct, counts fit in 32 bits (0 to ask only)."""
    at = ranges_of(keys, ranges)
    some = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
    columns = [
        pa.array(range(ranges), pa.int32()), pa.array([chunk] * ranges, pa.int32()),
        pa.array([packed_keys(keys[a:b]) for a, b in some], pa.binary()), pa.array([packed(counts[a:b].astype(np.uint32)) for a, b in some], pa.binary()),
    ]
    return pa.table(columns, ["_range", "_chunk", "_keys", "_counts"])


def ranges_for(chunks: int) -> int:
    """How many key ranges chunks ask."""
    return max(1, chunks // 2)


def answered(asked: DataFrame, chunks: int, answer: type = np.uint64, shrink: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Every question's answer, as ANSWERED says: the corpus-wide counts of its keys in its order, shrunk by shrink to the type answer (whole counts
    need 64 bits: a chunk's own fit in 32, the corpus's do not); and of the range, the distinct keys with a count, those counted once, and the sum of counts."""

    def answering(table: pa.Table) -> pa.Table:
        lean_memory()
        keys = [unpacked_keys(x.as_py()) for x in table.column("_keys")]
        counts = [unpacked(x.as_py(), np.uint32) for x in table.column("_counts")]
        parts: list[list[np.ndarray]] = [[] for _ in keys]
        known = once = everything = 0
        pieces = max(1, sum(map(len, keys)) >> 20)  # a part of the range at a time: sorting takes several times its size
        top = max((int(k[-1]) for k in keys if len(k)), default=0)
        low = min((int(k[0]) for k in keys if len(k)), default=0)
        edges = np.array([low + (top + 1 - low) * k // pieces for k in range(1, pieces)], np.uint64)
        bounds = [[0, *np.searchsorted(k, edges).tolist(), len(k)] for k in keys]
        for p in range(pieces):
            some = [k[b[p] : b[p + 1]] for k, b in zip(keys, bounds, strict=True)]
            distinct, place = np.unique(np.concatenate(some), return_inverse=True)
            total = np.bincount(place, np.concatenate([c[b[p] : b[p + 1]] for c, b in zip(counts, bounds, strict=True)]), len(distinct)).astype(np.int64)
            shrunk = (shrink(total) if shrink else total).astype(answer)
            known, once, everything, at = known + int((total > 0).sum()), once + int((total == 1).sum()), everything + int(total.sum()), 0
            for x, part in zip(some, parts, strict=True):
                part.append(shrunk[place[at : at + len(x)]])
                at += len(x)
        n = table.num_rows
        columns = [table.column("_chunk"), table.column("_range"), pa.array([packed(np.concatenate(part)) for part in parts], pa.binary())]
        return pa.table([*columns, *(pa.array([x] * n, pa.int64()) for x in (known, once, everything))], ["_chunk", "_range", "_answers", "_distinct", "_once", "_total"])

    return asked.repartition(ranges_for(chunks), "_range").groupBy("_range").applyInArrow(answering, ANSWERED)


def whole_answer(table: pa.Table, answer: type = np.uint64) -> tuple[np.ndarray, tuple[int, int, int]]:
    """A chunk's answers in the order of its keys; and of all keys, the distinct with a count, those counted once, and the sum of counts."""
    order = np.argsort(table.column("_range").to_numpy())
    got = table.column("_answers").to_pylist()
    return np.concatenate([unpacked(got[k], answer) for k in order]), tuple(sum(table.column(c).to_pylist()) for c in ("_distinct", "_once", "_total"))


def tallied(
    docs: DataFrame, id_col: str, text_col: str, chunks: int,
    ask: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], use: Callable[[pa.Table, np.ndarray, tuple[int, int, int]], pa.Table],
    schema: str, answer: type = np.uint64, shrink: Callable[[np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """use(texts, answers, totals) for each chunk of docs, as a DataFrame of schema.

    texts: the chunk's rows (_id, _text). ask(texts) gives the chunk's sorted distinct keys and its counts of them; use also gets the
    corpus-wide counts in the same order, and what whole_answer says of all keys. Both must see the same keys for the same rows in any order.
    """
    texts = dealt(docs, id_col, text_col, chunks)

    def asking(table: pa.Table) -> pa.Table:
        lean_memory()
        return question(table.column("_chunk")[0].as_py(), *ask(table), ranges_for(chunks))

    def using(table: pa.Table, answers: pa.Table) -> pa.Table:
        lean_memory()
        return use(table, *whole_answer(answers, answer))

    got = answered(texts.groupBy("_chunk").applyInArrow(asking, ASKED), chunks, answer, shrink)
    return texts.groupBy("_chunk").cogroup(got.repartition(chunks, "_chunk").groupBy("_chunk")).applyInArrow(using, schema)
