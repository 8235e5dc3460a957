"""BPE encoding and decoding by a table of the corpus's distinct words.

Texts are split at white space where they are read. A run of documents (a chunk) becomes places in a list of its own distinct words, so a
word travels once a chunk and never once an occurrence. The lists of all chunks, cut into ranges by a hash of the word, make the table of
distinct words: a range encodes each of its words once and answers every chunk in the order in which it asked. So a chunk's
answers, end to end, are the ids of its words by place, and its documents follow from their places. They stay where they were written,
in a table bucketed by chunk, and only answers go to them. Decoding joins ids with the vocabulary's pieces.

That the ids of a text are those of its words in a row holds for tokenizers that drop white space; others are refused.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import Scratch, kept, lean_memory
from .tally import packed, unpacked
from .tokens import default_tokenizer, ragged
from .words import Eights, grouped, hashed_words, parts_of, same_words

if TYPE_CHECKING:
    from tokenizers import Tokenizer

_tokenizers: dict[str, Tokenizer] = kept("tokenizers")


def whole_tokenizer(path: str) -> Tokenizer:
    """The tokenizer in a file, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def separator(tokenizer: Tokenizer) -> str:
    """What stands between pieces in decoded text. ValueError if words can't be encoded one by one or pieces not be decoded one by one."""
    if tokenizer.decoder is not None:
        raise ValueError("the tokenizer has a decoder; only plain pieces can be joined")
    for gap in (" ", "\n", " \t\r\n\x0b\x0c"):
        ids = [tokenizer.encode(x, add_special_tokens=False).ids for x in (f"{gap}ab,{gap}c3{gap}", "ab,", "c3")]
        if ids[0] != ids[1] + ids[2]:
            raise ValueError("the tokenizer does not drop white space")
    return " "


class _Words:
    """The distinct words of a chunk by place."""

    def __init__(self) -> None:
        self.places: dict[bytes, int] = {}

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(places of the column's words in a row, bounds of its rows in them); new words are added."""
        hashes, starts, ends, first, data = hashed_words(column, fold=False)
        _, index, place = grouped(hashes)
        raw, places = data.tobytes(), self.places

        def found(some: np.ndarray) -> np.ndarray:
            return np.fromiter((places.setdefault(raw[a:b], len(places)) for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)), np.uint32, len(some))

        eights, sizes = Eights(data), ends - starts
        same = sizes == sizes[index][place]
        same[same] = same_words(eights, starts[same], eights, starts[index][place][same], sizes[same])
        out = found(index)[place]
        if not same.all():  # words of this column that share a hash with others
            odd = np.flatnonzero(~same)
            out[odd] = found(odd)
        return out, first


def in_places(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int, ranges: int) -> DataFrame:
    """(chunk, id, places, range, words): for each document its words' places in the list of its chunk (packed), and for each chunk and range the words
    of that range in order (packed); a list goes by range, then by word.

    A chunk is so many bytes of text of one partition, or one longer text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory("")
        part, chunk, size, words, held = TaskContext.get().partitionId() << 32, 0, 0, _Words(), []

        def rows(n: int, **found: pa.Array) -> pa.RecordBatch:
            kinds = {"id": kind, "places": pa.binary(), "range": pa.int32(), "words": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, part + chunk)), *(found.get(c, pa.nulls(n, k)) for c, k in kinds.items())], names=["chunk", *kinds])

        def listed() -> Iterator[pa.RecordBatch]:
            known = list(words.places)
            of = [xxhash.xxh3_64_intdigest(w) % ranges for w in known]
            order = sorted(range(len(known)), key=lambda k: (of[k], known[k]))
            final = np.empty(len(known), np.uint32)
            final[order] = np.arange(len(known), dtype=np.uint32)
            for ids, codes, first in held:
                moved = final[codes]
                yield rows(len(ids), id=ids, places=pa.array([packed(moved[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary()))
            own = np.array(of)[order] if order else np.zeros(0, np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(order)] if order else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                some = zstandard.compress(b"\n".join([known[k] for k in order[a:b]]), 3)
                yield rows(1, range=pa.array([int(own[a])], pa.int32()), words=pa.array([some], pa.binary()))

        kind = pa.int64()
        for batch in batches:
            kind = batch.column(0).type
            for some in parts_of(batch, 1):
                held.append((some.column(0), *words.of(some.column(1))))
                size += some.column(1).nbytes
                if size >= chunk_bytes:
                    yield from listed()
                    chunk, size, words, held = chunk + 1, 0, _Words(), []
        yield from listed()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"chunk long, id {kind}, places binary, range int, words binary")


def encoded_words(asked: DataFrame, tokenizer: str, ranges: int) -> DataFrame:
    """(chunk, range, ids, counts) for (chunk, range, words): the ids of the words in a row and how many each has (packed). Each distinct word is encoded once."""

    def answering(table: pa.Table) -> pa.Table:
        lean_memory("tokenizers")
        if tokenizer not in _tokenizers:
            _tokenizers[tokenizer] = whole_tokenizer(tokenizer)
        known: dict[bytes, int] = {}
        lists = [
            np.fromiter((known.setdefault(w, len(known)) for w in zstandard.decompress(x.as_py()).split(b"\n")), np.int64) for x in table.column("words")
        ]
        words, parts, count = list(known), [np.zeros(0, np.uint32)], np.zeros(len(known), np.int64)
        for lo in range(0, len(words), 5_000):
            found = [e.ids for e in _tokenizers[tokenizer].encode_batch_fast([w.decode() for w in words[lo : lo + 5_000]], add_special_tokens=False)]
            count[lo : lo + len(found)] = list(map(len, found))
            parts.append(np.fromiter((i for ids in found for i in ids), np.uint32))
        pool, begin = np.concatenate(parts), np.cumsum(count) - count
        ids = [packed(ragged(pool, begin[at], count[at], np.array([0, len(at)]))[0]) for at in lists]
        columns = [table.column("chunk"), table.column("range"), pa.array(ids, pa.binary()), pa.array([packed(count[at].astype(np.uint32)) for at in lists], pa.binary())]
        return pa.table(columns, ["chunk", "range", "ids", "counts"])

    return asked.repartition(ranges, "range").groupBy("range").applyInArrow(answering, "chunk long, range int, ids binary, counts binary")


def bpe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, chunk_bytes: int = 32 << 20) -> DataFrame:
    """A row per input row: id, ids (array<int>), text (what they decode to, special tokens included).

    ids are those of the tokenizers library for the whole text without added special tokens, truncation or padding; a special token that a text
    spells out is found as the library finds it. A null text is empty and gives no ids and an empty text; null ids stay null, repeated rows stay, an empty table gives an
    empty result. Other columns are not read. A worker holds one chunk; a text must fit in memory.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "bpe")
    path = tokenizer or default_tokenizer()
    own = whole_tokenizer(path)
    between = separator(own)
    vocabulary = own.get_vocab()
    pieces = spark.sparkContext.broadcast([piece for piece, _ in sorted(vocabulary.items(), key=lambda x: x[1])])  # as many as the vocabulary has
    numbers = spark.sparkContext.broadcast(np.array(sorted(vocabulary.values())))
    parts = max(1, docs.rdd.getNumPartitions())
    ranges = max(1, parts // 2)
    written = scratch.bucketed(in_places(docs, id_col, text_col, chunk_bytes, ranges), "chunks", min(parts, 100_000), "chunk", f"bpe_{uuid.uuid4().hex}")
    answers = encoded_words(written.where("words is not null").select("chunk", "range", "words"), path, ranges)
    answers = answers.withColumnRenamed("chunk", "of_chunk").repartition(min(parts, 100_000), "of_chunk")

    def assembled(texts: pa.Table, answers: pa.Table) -> pa.Table:
        lean_memory("")
        order = np.argsort(answers.column("range").to_numpy()).tolist()
        pool, count = (np.concatenate([np.zeros(0, np.uint32), *(unpacked(x[k].as_py(), np.uint32) for k in order)]) for x in (answers.column("ids"), answers.column("counts")))
        count = count.astype(np.int64)
        begin = np.cumsum(count) - count
        places = [unpacked(x.as_py(), np.uint32) for x in texts.column("places")]
        first = np.concatenate([[0], np.cumsum(list(map(len, places)))]).astype(np.int64)
        at = np.concatenate([np.zeros(0, np.uint32), *places]).astype(np.int64)
        ids, bounds = ragged(pool, begin[at], count[at], first)
        ids, bounds = ids.astype(np.int32), pa.array(bounds.astype(np.int32))
        decoded = pa.array(pieces.value, pa.string()).take(pa.array(np.searchsorted(numbers.value, ids)))
        text = pc.binary_join(pa.ListArray.from_arrays(bounds, decoded), between)
        return pa.table([texts.column("id"), pa.ListArray.from_arrays(bounds, pa.array(ids)), text], ["id", "ids", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    met = written.where("places is not null").select("chunk", "id", "places").groupBy("chunk").cogroup(answers.groupBy("of_chunk"))
    return met.applyInArrow(assembled, f"id {kind}, ids array<int>, text string").withColumnRenamed("id", id_col)
