"""FASTA and FASTQ files as data sources: spark.read.format("fasta"), format("fastq") or, for either, format("sequences").

    register(spark)
    spark.read.format("fastq").schema("name string, seq string").load("reads/*.fq.gz").where("length >= 50")

The schema given is what is read: qualities nobody asked for never become text. Conditions on path leave out files before they are
opened, those on length leave out records before they are made. Files of more than split bytes are read in ranges of so many, each by a task.
Unlike read_sequences, which proves its ranges beforehand, each task holds the place where its range ends against the next range's guess
when it gets there, and fails if they differ (then set the option split to 0, which reads each file in one task). rec_idx counts from the start of a range.
"""

from __future__ import annotations

import glob
import operator
import os
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import LongType, StringType, StructType

from .ranges import Range, cut, guessed, is_packed, kind_of, open_file, text_from
from .sequences import _STEP, KINDS, Record, Scan, Stream, batches_of, lenient, schema_of

_SIZES: dict[type, Callable[[int, int], bool]] = {D.EqualTo: operator.eq, D.GreaterThan: operator.gt, D.GreaterThanOrEqual: operator.ge, D.LessThan: operator.lt, D.LessThanOrEqual: operator.le}
_PATHS: dict[type, Callable[[str, object], bool]] = {
    D.EqualTo: operator.eq, D.In: lambda path, values: path in values, D.StringStartsWith: str.startswith, D.StringEndsWith: str.endswith, D.StringContains: operator.contains,
}


class UnprovenRange(ValueError):
    """A range that ends elsewhere than the next one was guessed to begin."""


@dataclass
class SequencePartition(D.InputPartition):
    """A range of a file, and the later ranges of it."""

    own: Range
    later: list[Range]

    def __init__(self, own: Range, later: list[Range]):
        super().__init__(own.path)
        self.own, self.later = own, later


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of the files that a path, folder or glob names, in order; hidden ones in folders are passed over. A path that names nothing is an error."""
    bare = re.sub("^file:/+", "/", path)
    system, inner = pafs.FileSystem.from_uri(bare if "://" in bare else "file://" + os.path.abspath(bare))
    before = bare[: bare.index(inner)] if "://" in bare else "file:"
    fixed = re.split(r"[*?\[]", inner, maxsplit=1)[0]
    info = system.get_file_info(inner)
    if fixed == inner and info.type == pafs.FileType.File:
        return [(before + inner, info.size)]
    base = inner.rstrip("/") if fixed == inner else fixed.rsplit("/", 1)[0]
    found = system.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
    named = re.compile(glob.translate(inner, recursive=True) if fixed != inner else ".*", re.DOTALL)
    files = sorted((before + f.path, f.size) for f in found if f.type == pafs.FileType.File and named.match(f.path) and not re.search(r"/[._]", f.path[len(base) :]))
    if not files:
        raise FileNotFoundError(path)
    return files


class SequenceReader(D.DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns = [f.name for f in schema.fields]
        schema_of(self.columns)
        for f in schema.fields:
            if not isinstance(f.dataType, LongType if pa.types.is_integer(KINDS[f.name]) else StringType):
                raise ValueError(f"{f.name} is not a {f.dataType.simpleString()}")
        self.paths = [options["path"]] if "path" in options else []
        self.split, self.step = int(options.get("split", 128 << 20)), int(options.get("step", _STEP))
        self.strict = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.sizes: list[tuple[type, int]] = []
        self.of_paths: list[tuple[type, object]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("length",) and type(f) in _SIZES and isinstance(f.value, int):
                self.sizes.append((type(f), f.value))
            elif getattr(f, "attribute", None) == ("path",) and type(f) in _PATHS:
                self.of_paths.append((type(f), f.value))
            elif not (isinstance(f, D.IsNotNull) and f.attribute in (("length",), ("path",))):
                yield f

    def partitions(self) -> list[SequencePartition]:
        if not self.paths:
            raise ValueError("load() needs a path")
        files = [x for path in self.paths for x in listed(path) if all(_PATHS[kind](x[0], value) for kind, value in self.of_paths)]
        ranges = [cut(path, size, self.split or max(size, 1)) for path, size in files]
        return [SequencePartition(r, own[r.k + 1 :]) for own in ranges for r in own]

    def _wanted(self, records: Iterable[Record]) -> Iterator[Record]:
        return (r for r in records if all(_SIZES[kind](len(r[2]), value) for kind, value in self.sizes))

    def read(self, partition: SequencePartition) -> Iterator[pa.RecordBatch]:
        own = partition.own
        with open_file(own.path) as file:
            packed = is_packed(file)
            kind = kind_of(file, packed, self.step)
            place = guessed(file, packed, kind, own.start, own.stop, self.step)
            if place is None:
                return
            scan = Scan(Stream(text_from(file, place, packed, self.step)), own.stop)
            yield from batches_of(own.path, self._wanted(lenient(scan, self.strict)), self.columns)
            for after in partition.later:  # up to the first in which a record begins
                found = guessed(file, packed, kind, after.start, after.stop, self.step)
                true = scan.after if scan.after and scan.after[0] < after.stop else None
                if found != true:
                    raise UnprovenRange(f"{own.path}: its records can't be told from within it, or one is bad; set the option split to 0")
                if found:
                    return


class SequenceSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "sequences"

    def schema(self) -> str:
        return schema_of(tuple(KINDS))

    def reader(self, schema: StructType) -> SequenceReader:
        return SequenceReader(schema, dict(self.options))


class FastaSource(SequenceSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return schema_of(tuple(c for c in KINDS if c != "qual"))


class FastqSource(SequenceSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session, and has Spark hand conditions to them."""
    for source in (SequenceSource, FastaSource, FastqSource):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
