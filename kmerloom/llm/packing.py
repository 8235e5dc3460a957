"""Packing by concatenate-and-cut.

One pass encodes every document and writes its token ids with their place in the partition; the totals of
the partitions, summed up, give every document its global offset. A second pass cuts the one long row of
ids at multiples of the sequence length; a document that crosses a boundary has a piece on each side. There
is no shuffle, and a sequence is never short except the last.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean_memory
from .tokens import default_tokenizer, word_encoder
from .words import parts_of


def encoded(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int) -> DataFrame:
    """A row per input row: id, _part, _at (ids before it in its partition), ids (binary, 16 bits each, the end included), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory("encoders")
        encoder, part, at = word_encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in parts_of(batch, 1):
                ids, bounds = encoder.encode(some.column(1), end_id)
                n = np.diff(bounds)
                raw = pa.BinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(2 * bounds), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(at + bounds[:-1]), raw.cast(pa.binary()), pa.array(n)], names=[id_col, "_part", "_at", "ids", "n"])
                at += len(ids)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, _part int, _at long, ids binary, n long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, tokenizer: str | None = None, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if with_ids).

    Each document's ids are followed by end_id, so a null or empty text is one piece of one id. Null ids stay
    null, repeated rows are packed each, an empty table gives an empty result; other columns are not read.
    Sequences are numbered from 0 in the order of partitions and rows; all but the last are full. A row per
    partition passes through the driver.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    rows = scratch.save(encoded(docs, id_col, text_col, tokenizer or default_tokenizer(), end_id), "ids")
    first, offsets = 0, []
    for part, n in sorted(rows.groupBy("_part").agg(F.sum("n")).collect()):
        offsets.append((part, first))
        first += n
    placed = rows.join(F.broadcast(docs.sparkSession.createDataFrame(offsets, "_part int, _first long")), "_part")  # a row per partition
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for batch in batches:
            source, numbers, ids = [], [], []
            for k, (data, at) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), strict=True)):
                wide = np.frombuffer(data.as_py(), "<u2").astype("<u4").tobytes()
                n, start = len(wide) // 4, 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(n - start, length - offset)
                    piece = wide[4 * start : 4 * (start + size)]
                    source.append(k)
                    numbers.append((start, size, zlib.crc32(piece), n, sequence, offset))
                    if with_ids:
                        ids.append(piece)
                    start += size
            columns = np.array(numbers, np.int64).reshape(-1, 6).T
            out = [batch.column(0).take(pa.array(source, pa.int64())), *(pa.array(np.ascontiguousarray(c)) for c in columns)]
            yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.binary())] * with_ids, names=names)

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = f"`{id_col}` {kind}, " + ", ".join(f"`{c}` long" for c in names[1:7]) + ", ids binary" * with_ids
    return placed.select(id_col, "ids", (F.col("_first") + F.col("_at")).alias("_at")).mapInArrow(cut, schema)
