"""Large sequence files in ranges, a task each, with the records that one task would have read.

A range owns the records that begin in it. Where its first one begins can only be guessed from within a file: in FASTA at a line that
starts with >; in FASTQ at a line with @ from which several records agree with their + lines and lengths; in gzip at a member,
known by its header and by a trailer that fits what it unpacks to. So each range is walked from its guess to the first record that belongs to
the next range, and that place is held against the next range's guess. The first range begins at the start of the file, so where all agree
all are proven; a range whose guess was wrong is walked again from where the one before it ended. Nothing rests on a guess.

The walk also counts records, which gives each range the number of its first one. The driver sees a row per range, as it does of splits.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import astuple, dataclass, replace

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from .sequences import GZIP, BadRecord, Piece, Place, Scan, Stream, batches_of, lenient, members, schema_of

#: From so many records in a row a guess in FASTQ is taken.
_AGREEING = 3
#: A guess is given up where so many bytes don't decide it; the range before then finds the place.
_UNDECIDED = 64 << 20


def open_file(path: str) -> pa.NativeFile:
    """A file by random access, from any store that Arrow knows."""
    system, inner = pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return system.open_input_file(inner)


def is_packed(file: pa.NativeFile) -> bool:
    return file.read_at(2, 0) == GZIP


def _chunks(file: pa.NativeFile, at: int, step: int) -> Iterator[bytes]:
    while data := file.read_at(step, at):
        yield data
        at += len(data)


def text_from(file: pa.NativeFile, place: Place, packed: bool, step: int) -> Iterator[Piece]:
    """The file's text from a place on."""
    at, skip = place
    if not packed:
        for data in _chunks(file, at, step):
            yield (at, -1), data
            at += len(data)
        return
    for (member, inner), data in members(_chunks(file, at, step), at):
        if skip and member == at:
            if skip >= inner + len(data):
                continue
            data, inner, skip = data[max(0, skip - inner) :], max(inner, skip), 0
        yield (member, inner), data


def _is_member(file: pa.NativeFile, at: int, step: int) -> bool:
    """Whether a gzip member begins here: it unpacks to an end whose checksum and length fit."""
    member = zlib.decompressobj(31)
    for data in _chunks(file, at, step):
        try:
            while data:
                member.decompress(data, step)
                if member.eof:
                    return True
                data = member.unconsumed_tail
        except zlib.error:
            return False
    return False


def first_member(file: pa.NativeFile, start: int, stop: int, step: int) -> int | None:
    """The offset of the first gzip member that begins from start on and before stop."""
    for at in range(start, stop, step):
        block = file.read_at(min(step, stop - at) + 3, at)  # the header's last bytes may lie in the next block
        k = block.find(GZIP + b"\x08")
        while 0 <= k < min(step, stop - at):
            if len(block) > k + 3 and block[k + 3] < 32 and _is_member(file, at + k, min(step, 1 << 18)):
                return at + k
            k = block.find(GZIP + b"\x08", k + 1)
    return None


def agrees(text: bytes, at: int, ended: bool) -> bool | None:
    """Whether records with quality follow one another from at; None if there is too little text to say. ended: there is none after it."""

    def line() -> bytes | None:
        nonlocal at
        end = text.find(b"\n", at)
        if end < 0 and (not ended or at >= len(text)):
            return None
        found, at = text[at:end] if end >= 0 else text[at:], end + 1 if end >= 0 else len(text)
        return found[:-1] if len(found) > 1 and found.endswith(b"\r") else found

    open_end = None if not ended else False
    for n in range(_AGREEING):
        header = b""
        while header in (b"", b"\r"):  # an empty quality, or blank lines
            if at >= len(text) and ended and n:
                return True
            if (header := line()) is None:
                return open_end
        if not header.startswith(b"@"):
            return False
        size = 0
        while True:
            if (found := line()) is None:
                return open_end
            if found[:1] in (b">", b"@"):
                return False
            if found[:1] == b"+":
                break
            size += len(found) if found != b"\r" else 0
        while size > 0:
            if (found := line()) is None:
                return open_end
            size -= len(found)
        if size:
            return False
    return True


def guessed(file: pa.NativeFile, packed: bool, kind: bytes, start: int, stop: int, step: int) -> Place | None:
    """Where the first record of a range seems to begin; None if nowhere in it."""
    if start == 0:
        return 0, 0
    if packed:
        member = first_member(file, start, stop, step)
        if member is None:
            return None
        found, text, at = text_from(file, (member, 0), True, step), bytearray(), 0
    else:
        found, text, at = text_from(file, (start - 1, 0), False, step), bytearray(), -1  # from the byte before, which may end a line
    begins: list[int] = []
    bases: list[Place] = []
    ended = False

    def more() -> None:
        nonlocal ended
        base, data = next(found, (None, b""))
        ended = not data
        if data:
            begins.append(len(text))
            bases.append(base)
            text.extend(data)

    def place(k: int) -> Place:
        i = bisect.bisect_right(begins, k) - 1
        a, b = bases[i]
        return (a + k - begins[i], 0) if b < 0 else (a, b + k - begins[i])

    seen = 0  # up to here there is no further line start
    while True:
        if at < 0:  # the next line start
            end = text.find(b"\n", seen)
            if end < 0:
                seen = len(text)
                if ended or (bases and bases[-1][0] >= stop):
                    return None
                more()
                continue
            at = end + 1
        while at >= len(text) and not ended:
            more()
        if at >= len(text) or place(at)[0] >= stop:
            return None
        verdict: bool | None = text[at : at + 1] == kind
        if verdict and kind == b"@":
            while (verdict := agrees(bytes(text[at:]) if at else bytes(text), 0, ended)) is None and len(text) - at < _UNDECIDED:
                more()
        if verdict:
            return place(at)
        if verdict is None:
            return None
        seen, at = at, -1
        if seen > 16 << 20:  # what has been passed is not held
            i = bisect.bisect_right(begins, seen) - 1
            (a, b), cut = bases[i], seen - begins[i]
            begins[: i + 1], bases[: i + 1] = [seen], [(a + cut, b) if b < 0 else (a, b + cut)]
            begins[:] = [x - seen for x in begins]
            del text[:seen]
            seen = 0


def kind_of(file: pa.NativeFile, packed: bool, step: int) -> bytes:
    """The marker of the file's first record, if any."""
    stream = Stream(text_from(file, (0, 0), packed, min(step, 1 << 16)))
    return stream.peek() if stream.marker() else b""


@dataclass(frozen=True)
class Range:
    """Bytes start to stop of the k-th range of a file, and what is known of it: where its first record begins (member, inner; -1 for nowhere, None for not known),
    how many records begin in it, where the first after it begins (-1 for nowhere), whether a bad record ends it, and the number of its first one."""

    path: str
    k: int
    start: int
    stop: int
    member: int | None = None
    inner: int | None = None
    count: int = 0
    next_member: int = -1
    next_inner: int = -1
    bad: bool = False
    first: int = 0


_RANGE = "path string, k int, start long, stop long, member long, inner long, count long, next_member long, next_inner long, bad boolean, first long"


def walked(own: Range, step: int) -> Range:
    """own with what a walk over it shows, from its guess if where it begins is not known."""
    with open_file(own.path) as file:
        packed = is_packed(file)
        place: Place | None = (own.member, own.inner) if own.member is not None else guessed(file, packed, kind_of(file, packed, step), own.start, own.stop, step)
        if place is None:
            return replace(own, member=-1, inner=-1)
        scan, count, bad = Scan(Stream(text_from(file, place, packed, step)), own.stop), 0, False
        try:
            for _ in scan:
                count += 1
        except BadRecord:
            bad = True
        after = scan.after or (-1, -1)
        return replace(own, member=place[0], inner=place[1], count=count, next_member=after[0], next_inner=after[1], bad=bad)


def cut(path: str, size: int, split: int) -> list[Range]:
    return [Range(path, k, at, min(at + split, size)) for k, at in enumerate(range(0, max(size, 1), split))]


def _each(spark: SparkSession, ranges: Sequence[Range]) -> DataFrame:
    """A row per range, each in a partition of its own."""
    rows = spark.createDataFrame([(i, *astuple(r)) for i, r in enumerate(ranges)], f"i long, {_RANGE}")
    return rows.repartitionByRange(len(ranges), "i").drop("i")  # a given number of partitions is not folded


def _of(batches: Iterator[pa.RecordBatch]) -> Iterator[Range]:
    for batch in batches:
        for row in batch.to_pylist():
            yield Range(**row)


def chained(ranges: list[Range]) -> tuple[list[Range], Range | None]:
    """Of a file's ranges, walked: those that are proven, from the first on; and the next one, if it has to be walked again from where they end."""
    done: list[Range] = []
    place, first = (0, 0), 0
    for r in ranges:
        if place[0] < 0 or place[0] >= r.stop:
            done.append(replace(r, member=-1, inner=-1, count=0, bad=False, first=first))  # no record begins in it
            continue
        if (r.member, r.inner) != place:
            return done, replace(r, member=place[0], inner=place[1])
        done.append(replace(r, first=first))
        if r.bad:
            break
        place, first = (r.next_member, r.next_inner), first + r.count
    return done, None


def planned(spark: SparkSession, files: Sequence[tuple[str, int]], split: int, step: int) -> list[Range]:
    """The proven ranges of files (path, size) in which records begin. A file is read once, and a range again for every wrong guess."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _of(batches):
            yield pa.RecordBatch.from_pylist([walked(own, step).__dict__], schema=arrow)

    arrow = pa.schema([(n, pa.string() if t == "string" else pa.int32() if t == "int" else pa.bool_() if t == "boolean" else pa.int64()) for n, t in (x.split() for x in _RANGE.split(", "))])
    known = {path: cut(path, size, split) for path, size in files}
    todo = [r for ranges in known.values() for r in ranges]
    while todo:
        for row in _each(spark, todo).mapInArrow(run, _RANGE).collect():  # a row per range
            known[row["path"]][row["k"]] = Range(**row.asDict())
        todo = [again for ranges in known.values() if (again := chained(ranges)[1])]
    return [r for ranges in known.values() for r in chained(ranges)[0] if r.count or r.bad]


def read_ranges(spark: SparkSession, ranges: Sequence[Range], columns: Sequence[str], strict: bool, step: int) -> DataFrame:
    """The records of proven ranges. strict: a bad record is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _of(batches):
            with open_file(own.path) as file:
                scan = Scan(Stream(text_from(file, (own.member, own.inner), is_packed(file), step)), own.stop)
                yield from batches_of(own.path, lenient(scan, strict), columns, own.first)

    schema = schema_of(columns)
    return _each(spark, ranges).mapInArrow(run, schema) if ranges else spark.createDataFrame([], schema)
