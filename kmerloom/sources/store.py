"""Sketch stores: Parquet tables, and the binary sketch file for exchange.

Binary layout, little-endian: magic, k u32, threshold u64, n u64, length of name u32, name, n hashes u64 ascending, n
simplicities u32.
"""

from __future__ import annotations

import atexit
import contextlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.params import SketchParams
from ..operators.sketch import Sketches, nested, sketch
from .sequences import is_sequence_file, read_sequences

# Fixed values of the file format.
MAGIC = b"PARA"
HEADER = "<4sIQQI"
#: Ending of sketch files; files with other endings are tried as sketches, then as sequences.
ENDING = ".sketch"
NESTED = "path string, name string, k int, threshold decimal(20,0), hashes array<bigint>, simplicities array<int>"


class BadSketch(ValueError):
    """A file that is not a whole sketch file."""


def encode(name: str, k: int, threshold: int, hashes: np.ndarray, simplicities: np.ndarray) -> bytes:
    """A sketch file's bytes; hashes as signed or unsigned 64-bit integers in any order."""
    h = np.asarray(hashes).view(np.uint64) if len(hashes) else np.zeros(0, np.uint64)
    order = np.argsort(h)
    raw = name.encode()
    return struct.pack(HEADER, MAGIC, k, threshold, len(h), len(raw)) + raw + h[order].astype("<u8").tobytes() + np.asarray(simplicities)[order].astype("<u4").tobytes()


def decode(data: bytes) -> tuple[str, int, int, np.ndarray, np.ndarray]:
    """(name, k, threshold, hashes, simplicities); bytes after the last are ignored."""
    head = struct.calcsize(HEADER)
    if len(data) < head or data[:4] != MAGIC:
        raise BadSketch("no sketch file: the magic is missing")
    _, k, threshold, n, size = struct.unpack_from(HEADER, data)
    if len(data) < head + size + 12 * n:
        raise BadSketch(f"the sketch file ends early: {len(data)} bytes of {head + size + 12 * n}")
    at = head + size
    return data[head:at].decode(), k, threshold, np.frombuffer(data, "<u8", n, at), np.frombuffer(data, "<u4", n, at + 8 * n)


def encoded(sketches: Sketches) -> DataFrame:
    """(name, content): the sketch file of each name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                encode(name.as_py() or "", k.as_py(), int(t.as_py()), np.array(h.as_py(), np.int64), np.array(s.as_py(), np.int64))
                for name, k, t, h, s in zip(*(batch.column(c) for c in range(5)), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["name", "content"])

    return nested(sketches).withColumn("name", F.col("name").cast("string")).mapInArrow(run, "name string, content binary")


def decoded(files: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """NESTED rows of files (path, content); under PERMISSIVE files that are no sketches are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    name, k, threshold, h, s = decode(content.as_py())
                except BadSketch as e:
                    if mode.upper() == "FAILFAST":
                        raise BadSketch(f"{path.as_py()}: {e}") from e
                    continue
                rows.append((path.as_py(), name, k, Decimal(threshold), h.view(np.int64), s.astype(np.int32)))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.decimal128(20, 0), pa.list_(pa.int64()), pa.list_(pa.int32()))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["path", "name", "k", "threshold", "hashes", "simplicities"])

    return files.select(F.col("path"), F.col("content").cast("binary").alias("content")).mapInArrow(run, NESTED)


def from_nested(rows: DataFrame) -> Sketches:
    """Sketches of NESTED rows with idx; scale and seed are not in the file and are null."""
    pairs = rows.select("name", F.explode(F.arrays_zip("hashes", "simplicities")).alias("p"))
    hashes = pairs.select("name", F.col("p.hashes").alias("hash"), F.col("p.simplicities").alias("s"))
    zero = F.lit(0).cast("long")
    sums = [F.aggregate("simplicities", zero, lambda a, x: a + x), F.aggregate("simplicities", zero, lambda a, x: a + x.cast("long") * x)]
    meta = rows.select(
        "idx", "name", "k", F.lit(None).cast("string").alias("scale"), "threshold", F.lit(None).cast("decimal(20,0)").alias("seed"),
        F.size("hashes").cast("long").alias("n"), sums[0].alias("sum_s"), sums[1].alias("sum_s2"),
    )
    return Sketches(hashes, meta)


def write_store(sketches: Sketches, path: str, buckets: int | None = None) -> None:
    """Parquet: path/meta, and path/hashes, in order of hash within each file.

    With buckets, hashes are dealt by hash into so many files, which path/layout remembers: stores of as many buckets join, and group by hash, where
    they lie. Without, they are ranged by hash, so that few of a file's blocks hold a given hash, but joins move them.
    """
    spark = sketches.meta.sparkSession
    own = str(_files(spark, path)[1].toUri().getPath())
    if any(f"{own}/hashes/" in f for f in sketches.hashes.inputFiles()):
        raise ValueError(f"{path} can't be written from itself")
    sketches.meta.write.mode("overwrite").parquet(f"{path}/meta")
    hashes = sketches.hashes.select("name", "hash", "s")
    for part in ("layout", "hashes"):
        files, at = _files(spark, f"{path}/{part}")
        files.delete(at, True)
    if not buckets:
        hashes.repartitionByRange("hash").sortWithinPartitions("hash", "name").write.mode("overwrite").parquet(f"{path}/hashes")
        return
    table = f"store_{uuid.uuid4().hex}"
    hashes.repartition(buckets, "hash").write.mode("overwrite").format("parquet").bucketBy(buckets, "hash").sortBy("hash", "name").option("path", f"{path}/hashes").saveAsTable(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay
    spark.createDataFrame([(buckets, hashes.schema.simpleString().removeprefix("struct<").removesuffix(">"))], "buckets int, columns string").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")


def read_store(spark: SparkSession, path: str) -> Sketches:
    """The sketches of a store; those of a store in buckets come as a table of the session that knows them, until the process ends."""
    meta = spark.read.parquet(f"{path}/meta")
    files, at = _files(spark, f"{path}/layout")
    if not files.exists(at):
        return Sketches(spark.read.parquet(f"{path}/hashes"), meta)
    layout = spark.read.parquet(f"{path}/layout").first()
    table = f"store_{uuid.uuid4().hex}"
    columns = ", ".join(c.replace(":", " ") for c in layout["columns"].split(","))
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (hash) SORTED BY (hash, name) INTO {layout['buckets']} BUCKETS LOCATION '{path}/hashes'")
    atexit.register(_forget, spark, table)
    return Sketches(spark.table(table), meta)


def _files(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The file system of a path, and the path there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _forget(spark: SparkSession, table: str) -> None:
    with contextlib.suppress(Exception):  # the session has ended, and its catalogue with it
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def read_sketches(spark: SparkSession, *paths: str, mode: str = "FAILFAST") -> DataFrame:
    return decoded(spark.read.format("binaryFile").load(list(paths)).select("path", "content"), mode)


def resolve_inputs(spark: SparkSession, paths: list[str], params: SketchParams = SketchParams()) -> Sketches:
    """Sketches of mixed inputs in the order given: sketch files as stored, sequence files built with params.

    The k of the first sketch file goes for all sequences; their scale and seed stay those of params. A file with the ENDING
    that is no sketch is an error; any other file that is none is read as sequences. A sequence file that yields no hash is an error;
    a stored empty sketch is not.
    """
    spots = {}
    for k, path in enumerate(paths):
        spots.setdefault(_plain(path), []).append(k)
    likely = [p for p in paths if not is_sequence_file(p)]
    stored, first_k = None, None
    loaded: set[str] = set()
    if likely:
        rows = read_sketches(spark, *dict.fromkeys(likely), mode="PERMISSIVE").withColumn("_path", F.regexp_replace("path", "^file:/*", "/"))
        heads = rows.select("_path", "k").collect()  # a row per input file
        loaded = {r["_path"] for r in heads}
        for p in likely:
            if _plain(p) not in loaded and p.lower().endswith(ENDING):
                raise BadSketch(f"{p} is no sketch file")
        if loaded:
            of = {r["_path"]: r["k"] for r in heads}
            first_k = next(of[_plain(p)] for p in likely if _plain(p) in loaded)
            order = spark.createDataFrame([(p, i) for p, at in spots.items() if p in loaded for i in at], "_path string, idx int")
            stored = from_nested(rows.join(F.broadcast(order), "_path").withColumn("name", F.concat_ws("\x1f", F.col("idx").cast("string"), "name")))
    others = [p for p in paths if _plain(p) not in loaded]
    built = None
    if others:
        if first_k is not None:
            params = SketchParams(first_k, params.scale, params.seed, params.min_count, params.max_simplicity)
        names = spark.createDataFrame([(i, f"{i}\x1f{p}", p) for p in dict.fromkeys(others) for i in spots[_plain(p)]], "idx int, name string, _given string")
        given = spark.createDataFrame([(_plain(p), f"{i}\x1f{p}") for p in dict.fromkeys(others) for i in spots[_plain(p)]], "_path string, key string")
        records = read_sequences(spark, *dict.fromkeys(others)).withColumn("_path", F.regexp_replace("path", "^file:/*", "/"))
        built = sketch(records.join(F.broadcast(given), "_path"), params, "key", "seq", names.select("idx", "name"))
        empty = built.meta.where("n = 0").select("name").head(1)
        if empty:
            raise BadSketch(f"{empty[0][0].split(chr(31), 1)[1]}: no sequence gives a hash")
    parts = [x for x in (stored, built) if x is not None]
    hashes, meta = parts[0].hashes, parts[0].meta
    for more in parts[1:]:
        hashes, meta = hashes.unionByName(more.hashes), meta.unionByName(more.meta)
    return Sketches(hashes, meta)


def shown(name: str) -> str:
    """An input's name as given, without its place among the inputs."""
    return name.split("\x1f", 1)[-1]


def _plain(path: str) -> str:
    import re

    return re.sub("^file:/*", "/", path) if "://" in path or path.startswith(("/", "file:")) else _absolute(path)


def _absolute(path: str) -> str:
    import os

    return os.path.abspath(path)
