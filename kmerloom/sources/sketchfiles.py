"""Sketch files written by executors, with a commit.

    write_sketch_files(sketches, "sketches/")          # or, with columns as store.NESTED has them:
    rows.write.format("sketch_files").mode("append").option("folder", "sketches/").save()

A task writes its sketches under names of its own in a staging folder beside where they will be. Only when all tasks have ended does the driver,
which has seen nothing but names, move them to their places; so a job that fails leaves no file there, whole or half, and a task that ran
twice no second one. What a failed attempt wrote goes with the staging folder.
"""

from __future__ import annotations

import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.sketch import Sketches, nested
from .store import ENDING, encode


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and its name there."""
    bare = re.sub("^file:/+", "/", path)
    return pafs.FileSystem.from_uri(bare if "://" in bare else "file://" + os.path.abspath(bare))


def file_of(name: str, folder: str | None) -> str:
    """Where a sketch's file goes: beside the input of that name, or in the folder under its last part."""
    return f"{folder.rstrip('/')}/{name.rsplit('/', 1)[-1]}{ENDING}" if folder else f"{name}{ENDING}"


@dataclass
class Written(D.WriterCommitMessage):
    """What a task has written: (staged path, path) of each file."""

    files: list[tuple[str, str]]


class SketchFileWriter(D.DataSourceArrowWriter):
    def __init__(self, folder: str | None):
        self.folder, self.job = folder, uuid.uuid4().hex
        if folder:  # made once: a task that is late when the job has failed finds it gone
            system, inner = located(self._staging(file_of("", folder)))
            system.create_dir(inner)

    def _staging(self, path: str) -> str:
        return f"{path.rsplit('/', 1)[0] if '/' in path else '.'}/.sketches-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done: list[tuple[str, str]] = []
        try:
            for batch in iterator:
                columns = [batch.column(c) for c in ("name", "k", "threshold", "hashes", "simplicities")]
                for name, k, threshold, hashes, s in zip(*columns, strict=True):
                    path = file_of(name.as_py() or "", self.folder)
                    staged = f"{self._staging(path)}/{uuid.uuid4().hex}"
                    content = encode(name.as_py() or "", k.as_py(), int(threshold.as_py()), np.array(hashes.values, np.int64), np.array(s.values, np.int64))
                    system, inner = located(staged)
                    if not self.folder:
                        system.create_dir(inner.rsplit("/", 1)[0])
                    done.append((staged, path))
                    with system.open_output_stream(inner) as out:
                        out.write(content)
        except BaseException:
            self._remove(staged for staged, _ in done)
            raise
        return Written(done)

    def commit(self, messages: list[D.WriterCommitMessage | None]) -> None:
        files = [x for m in messages if m for x in m.files]
        twice = [path for path, n in Counter(path for _, path in files).items() if n > 1]
        if twice:
            self.abort(messages)
            raise ValueError(f"several sketches would be written to {', '.join(sorted(twice))}")
        for staged, path in files:
            (system, a), (_, b) = located(staged), located(path)
            system.move(a, b)
        self._clear(files)

    def abort(self, messages: list[D.WriterCommitMessage | None]) -> None:
        self._clear([x for m in messages if m for x in m.files])

    def _clear(self, files: list[tuple[str, str]]) -> None:
        for folder in {self._staging(path) for _, path in files} | ({self._staging(file_of("", self.folder))} if self.folder else set()):
            system, inner = located(folder)
            with suppress(OSError):
                system.delete_dir(inner)

    def _remove(self, staged: Iterator[str]) -> None:
        for path in staged:
            system, inner = located(path)
            with suppress(OSError):
                system.delete_file(inner)
            with suppress(OSError):  # the last of the staging folder
                if not system.get_file_info(pafs.FileSelector(inner.rsplit("/", 1)[0])):
                    system.delete_dir(inner.rsplit("/", 1)[0])


class SketchFiles(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "sketch_files"

    def writer(self, schema: StructType, overwrite: bool) -> SketchFileWriter:
        if overwrite:
            raise ValueError("sketch files are replaced one by one; use mode append")
        missing = {"name", "k", "threshold", "hashes", "simplicities"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"a sketch needs {', '.join(sorted(missing))}")
        return SketchFileWriter(self.options.get("folder") or None)


def write_sketch_files(spark: SparkSession, sketches: Sketches, folder: str | None = None) -> None:
    """A file per sketch, in the folder (which is made) or beside the input that the sketch is named after; files of the same name are replaced."""
    spark.dataSource.register(SketchFiles)
    rows = nested(sketches).withColumn("name", F.col("name").cast("string"))
    rows.write.format("sketch_files").mode("append").option("folder", folder or "").save()
