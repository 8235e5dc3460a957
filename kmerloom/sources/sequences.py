"""FASTA and FASTQ, plain or gzip by content, as DataFrames of records.

The reader is a state machine over a stream of bytes, so it follows the format where line splitting cannot: markers inside
quality lines, several lines per record, carriage returns, junk before the first record. Files of usual size are read by
Spark (any store), one file a task; larger ones are cut into ranges (sources.ranges), a few megabytes at a time being held, so a file
may be of any size and only a record has to fit in memory. Long records are cut into windows later, so that hashing spreads over
tasks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File name endings that mean sequences; the rest are tried as sketch files first.
SEQUENCE_ENDINGS = tuple(f".{x}{z}" for x in ("fa", "fasta", "fq", "fastq") for z in ("", ".gz"))
SCHEMA = "path string, rec_idx long, name string, comment string, seq string, qual string"
#: What a reader can give of a record; length is that of its sequence.
KINDS = {"path": pa.string(), "rec_idx": pa.int64(), "name": pa.string(), "comment": pa.string(), "seq": pa.string(), "qual": pa.string(), "length": pa.int64()}
_SPACE = re.compile(rb"[ \t\n\v\f\r]")
_STEP = 4 << 20
GZIP = b"\x1f\x8b"

#: Where a byte of text is: its offset in a plain file, and 0; or the offset of its gzip member in the file, and its place in that member's text.
Place = tuple[int, int]
#: A stream's piece: the place of its first byte, with -1 for the second number in plain files, and its bytes.
Piece = tuple[Place, bytes]
#: (place, header, sequence, quality) of a record.
Record = tuple[Place, bytes, bytes, bytes | None]


class BadRecord(ValueError):
    """A truncated or mismatched record, under mode FAILFAST."""


def is_sequence_file(path: str) -> bool:
    return path.lower().endswith(SEQUENCE_ENDINGS)


def members(chunks: Iterable[bytes], base: int = 0) -> Iterator[Piece]:
    """The text of gzip members one after the other, of which the first begins at offset base of the file; of a damaged one, what can be read."""
    member, start, inner, read = zlib.decompressobj(31), base, 0, base
    for data in chunks:
        read += len(data)
        more = True
        while data or more:
            if member.eof:
                data = data.lstrip(b"\0")
                if not data:
                    break
                member, start, inner = zlib.decompressobj(31), read - len(data), 0
            try:
                out = member.decompress(data, _STEP)
            except zlib.error:
                return
            if out:
                yield (start, inner), out
                inner += len(out)
            data, more = member.unused_data if member.eof else member.unconsumed_tail, len(out) == _STEP


def _placed(chunks: Iterable[bytes]) -> Iterator[Piece]:
    at = 0
    for data in chunks:
        yield (at, -1), data
        at += len(data)


def pieces(chunks: Iterable[bytes]) -> Iterator[Piece]:
    """A whole file's text with its places, unpacked if it is gzip whatever the name says, member after member."""
    chunks = iter(chunks)
    first = b""
    while len(first) < 2 and (more := next(chunks, None)) is not None:
        first += more

    def again() -> Iterator[bytes]:
        yield first
        yield from chunks

    return (members if first[:2] == GZIP else _placed)(again())


def unpacked(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """A stream's bytes, unpacked if they are gzip."""
    return (data for _, data in pieces(chunks))


def opened(content: bytes) -> bytes:
    """All of a file's bytes, unpacked."""
    return b"".join(unpacked([content]))


class Stream:
    """Lines and markers of a stream of text, of which no more is held than what is being read."""

    def __init__(self, found: Iterable[Piece]):
        self.pieces, self.base, self.data, self.at = iter(found), (0, -1), b"", 0

    def _more(self) -> bool:
        """Goes on to the next bytes; all that is held has been read."""
        for base, data in self.pieces:
            if data:
                self.base, self.data, self.at = base, data, 0
                return True
        self.data, self.at = b"", 0
        return False

    def place(self) -> Place:
        """Where the next byte is; it must have been peeked at."""
        a, b = self.base
        return (a + self.at, 0) if b < 0 else (a, b + self.at)

    def peek(self) -> bytes:
        """The next byte, or none at the end."""
        return self.data[self.at : self.at + 1] if self.at < len(self.data) or self._more() else b""

    def line(self) -> bytes:
        """The next line, without its line end."""
        parts = []
        while True:
            end = self.data.find(b"\n", self.at)
            if end >= 0:
                parts.append(self.data[self.at : end])
                self.at = end + 1
                break
            parts.append(self.data[self.at :])
            if not self._more():
                break
        line = b"".join(parts)
        return line[:-1] if len(line) > 1 and line.endswith(b"\r") else line

    def marker(self) -> bool:
        """Goes to the next > or @ anywhere; False if there is none."""
        while True:
            found = [x for x in (self.data.find(b">", self.at), self.data.find(b"@", self.at)) if x >= 0]
            if found:
                self.at = min(found)
                return True
            if not self._more():
                return False


class Scan:
    """The records of a stream in a row, up to the first that begins at or after offset stop of the file; that one's place is then in after.

    A record begins at the first > or @ anywhere, at the start and after a record with quality; after one without,
    at a line that starts so. Sequence lines go on to a line that starts with >, + or @; blank lines are passed over and inner spaces
    stay. After a + line, quality lines are read until they are as long as the sequence; if they end short or run over, that is a BadRecord.
    """

    def __init__(self, stream: Stream, stop: int | None = None):
        self.stream, self.stop, self.after = stream, stop, None

    def __iter__(self) -> Iterator[Record]:
        stream, marked = self.stream, False  # marked: it stands at a marker
        while marked or stream.marker():
            place = stream.place()
            if self.stop is not None and place[0] >= self.stop:
                self.after = place
                return
            header = stream.line()[1:]
            parts: list[bytes] = []
            while (next_ := stream.peek()) and next_ not in b">+@":
                line = stream.line()
                if line and line != b"\r":
                    parts.append(line)
            seq = b"".join(parts)
            if next_ != b"+":
                marked = bool(next_)
                yield place, header, seq, None
                if not marked:
                    return
                continue
            marked = False
            stream.line()
            lines, have = [], 0
            while have < len(seq) and stream.peek():
                lines.append(stream.line())
                have += len(lines[-1])
            if have != len(seq):
                raise BadRecord(f"quality of {_named(header)[0].decode('latin-1')} has {have} of {len(seq)} characters")
            yield place, header, seq, b"".join(lines)


def _named(header: bytes) -> tuple[bytes, bytes]:
    """(name, comment): a name ends at white space, the rest of the line is the comment."""
    space = _SPACE.search(header)
    return (header[: space.start()], header[space.end() :]) if space else (header, b"")


def lenient(records: Iterable[Record], strict: bool) -> Iterator[Record]:
    """records, which end before a bad one unless strict."""
    try:
        yield from records
    except BadRecord:
        if strict:
            raise


def parse(data: bytes | Iterable[bytes], strict: bool = False) -> Iterator[tuple[str, str, str, str | None]]:
    """(name, comment, sequence, quality) of each record of some bytes, or of a stream of them, as Scan says; a bad record ends them (strict: BadRecord)."""
    chunks = [data] if isinstance(data, bytes) else data
    for _, header, seq, qual in lenient(Scan(Stream(_placed(chunks))), strict):
        yield *(x.decode("latin-1") for x in (*_named(header), seq)), None if qual is None else qual.decode("latin-1")


def batches_of(path: str, records: Iterable[Record], columns: Sequence[str], first: int = 0, bases: int = 1 << 26) -> Iterator[pa.RecordBatch]:
    """Some of KINDS of a file's records, a batch at a time; what is not asked for is not made into text. first is the number of the first record."""

    def text(x: bytes | None) -> str | None:
        return None if x is None else x.decode("latin-1")

    def batch(rows: list[tuple[int, Record]]) -> pa.RecordBatch:
        of = {
            "path": lambda: [path] * len(rows), "rec_idx": lambda: [k for k, _ in rows], "length": lambda: [len(r[2]) for _, r in rows],
            "name": lambda: [text(_named(r[1])[0]) for _, r in rows], "comment": lambda: [text(_named(r[1])[1]) for _, r in rows],
            "seq": lambda: [text(r[2]) for _, r in rows], "qual": lambda: [text(r[3]) for _, r in rows],
        }
        return pa.RecordBatch.from_arrays([pa.array(of[c](), KINDS[c]) for c in columns], names=list(columns))

    rows, size = [], 0
    for k, record in enumerate(records, first):
        rows.append((k, record))
        size += len(record[2])
        if size > bases or len(rows) >= 10_000:
            yield batch(rows)
            rows, size = [], 0
    if rows:
        yield batch(rows)


def schema_of(columns: Sequence[str]) -> str:
    """The columns as a schema in SQL."""
    unknown = [c for c in columns if c not in KINDS]
    if unknown:
        raise ValueError(f"no such column of a record: {', '.join(unknown)}; there are {', '.join(KINDS)}")
    return ", ".join(f"{c} {'long' if pa.types.is_integer(KINDS[c]) else 'string'}" for c in columns)


DEFAULT = ("path", "rec_idx", "name", "comment", "seq", "qual")


def _records(batches: Iterator[pa.RecordBatch], strict: bool, columns: Sequence[str]) -> Iterator[pa.RecordBatch]:
    for files in batches:
        for path, content in zip(files.column(0), files.column(1), strict=True):
            yield from batches_of(path.as_py(), lenient(Scan(Stream(pieces([content.as_py() or b""]))), strict), columns)


def parse_texts(files: DataFrame, path_col: str = "path", content_col: str = "content", mode: str = "PERMISSIVE", columns: Sequence[str] = DEFAULT) -> DataFrame:
    """Records of files that are rows already (path, content as text or binary)."""
    strict, schema = mode.upper() == "FAILFAST", schema_of(columns)
    rows = files.select(F.col(path_col).alias("path"), F.col(content_col).cast("binary").alias("content"))
    return rows.mapInArrow(lambda batches: _records(batches, strict, columns), schema)


def read_sequences(
    spark: SparkSession, *paths: str, mode: str = "PERMISSIVE", columns: Sequence[str] = DEFAULT, whole_up_to: int = 256 << 20, split: int = 128 << 20, step: int = _STEP,
) -> DataFrame:
    """Records of FASTA or FASTQ files or globs; a missing path is an error. mode FAILFAST raises on a bad record, else reading that
    file stops there and keeps what came before. columns: some of KINDS, in any order; what is not asked for is not made.

    Files of more than whole_up_to bytes are read in ranges of split bytes, each a task of its own: plain files at any byte, gzip files at their members (a file
    of one member stays in one task, as nothing in it can be read without what comes before). Rows and rec_idx are those of reading each
    file from its start, whatever its content; see ranges.planned, which reads such files once when this is called. The tasks must reach large
    files through one of Arrow's file systems (file, hdfs, s3, gs)."""
    from .ranges import planned, read_ranges

    if mode.upper() not in ("PERMISSIVE", "FAILFAST"):
        raise ValueError("mode must be PERMISSIVE or FAILFAST")
    strict = mode.upper() == "FAILFAST"
    files = spark.read.format("binaryFile").load(list(paths))
    whole = parse_texts(files.where(F.col("length") <= whole_up_to).select("path", "content"), mode=mode, columns=columns)
    large = files.where(F.col("length") > whole_up_to).select("path", "length").collect()  # without the contents, which Spark then does not read
    if not large:
        return whole
    ranges = planned(spark, [(r["path"], r["length"]) for r in large], split, step)
    return whole.unionByName(read_ranges(spark, ranges, columns, strict, step))


def read_fasta_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, name, comment, seq) of plain FASTA, split inside files at line starts of >; gzip goes by the .gz ending.

    For files whose records all begin with > at a line start; no rec_idx, as tasks see parts of files.
    """
    chunk = F.regexp_replace("value", "^>", "")
    rows = spark.read.option("lineSep", "\n>").text(list(paths)).select(F.input_file_name().alias("path"), chunk.alias("v"))
    header = F.regexp_replace(F.substring_index("v", "\n", 1), "\r$", "")
    body = F.when(F.instr("v", "\n") > 0, F.substring(F.col("v"), F.instr("v", "\n") + 1, F.length("v")))
    name = F.regexp_extract(header, r"^([^ \t\f\x0B]*)", 1)
    comment = F.regexp_extract(header, r"^[^ \t\f\x0B]*[ \t\f\x0B](.*)$", 1)
    return rows.select("path", name.alias("name"), comment.alias("comment"), F.coalesce(F.regexp_replace(body, "[\r\n]", ""), F.lit("")).alias("seq"))


def fasta_text(records: DataFrame, name_col: str = "name", seq_col: str = "seq") -> DataFrame:
    """(value): a record's two lines, for write.text."""
    return records.select(F.concat(F.lit(">"), F.col(name_col), F.lit("\n"), F.col(seq_col)).alias("value"))


def fastq_text(records: DataFrame, name_col: str = "name", seq_col: str = "seq", qual_col: str = "qual") -> DataFrame:
    return records.select(F.concat(F.lit("@"), F.col(name_col), F.lit("\n"), F.col(seq_col), F.lit("\n+\n"), F.col(qual_col)).alias("value"))
