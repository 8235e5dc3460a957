"""Shared pieces of the training-data operators: inputs, the shared scratch folder, dense naming."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters of [\x20\x09-\x0D]; bytes.split() splits at exactly these.
WHITESPACE = " \t\n\x0b\x0c\r"

_own_roots: dict[str, str] = {}
_lean = False
_kept: dict[str, dict] = {}


def kept(name: str) -> dict:
    """In a worker: a cache that outlives a task, until the kernel of an operator that does not use it lets it go."""
    return _kept.setdefault(name, {})


def lean_memory(uses: str | None = None) -> None:
    """In a worker: hand large freed blocks back to the system at once, so that its size is what it uses and not what it once used.

    uses: the cache that the caller keeps between tasks ("" for none); those that operators before it left behind go. By default all stay.
    """
    global _lean
    left = [cache for name, cache in _kept.items() if cache and uses is not None and name != uses]
    for cache in left:
        cache.clear()
    if left:
        gc.collect()
    if not _lean:
        pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        if not _lean:
            libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD: chunk-sized arrays go back at once, a batch's are used again
            libc.mallopt(-1, 32 << 20)  # M_TRIM_THRESHOLD
        if left:
            libc.malloc_trim(0)
    _lean = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of a data folder, read by Spark alone (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage: spark.checkpoint.dir, or an own folder where it is unset and all runs on this machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        _own_roots[app] = "file://" + tempfile.mkdtemp(prefix="kmerloom-")
    return _own_roots[app]


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs a task and not a lineage.

    A table stays until drop() or the end of the process: results returned to a caller are lazy and still read it.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{what}-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.root)

    def save(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """df, written and read again; by: with a folder name/by=value for each value of that column, its last."""
        path = f"{self.root}/{name}"
        (df.write.partitionBy(by) if by else df.write).option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, buckets: int, by: str, table: str) -> DataFrame:
        """df, written in buckets of by and read again as a table that knows them, so that joins and groups by that column move only the other side."""
        path = f"{self.root}/{name}"
        atexit.register(self._forget, table)
        df.write.bucketBy(buckets, by).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
        return self.spark.table(table)

    def read(self, *names: str) -> DataFrame:
        """Tables of the same columns that were saved, as one."""
        first = self.spark.read.parquet(f"{self.root}/{names[0]}")
        return self.spark.read.schema(first.schema).parquet(*(f"{self.root}/{name}" for name in names))

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(f"{self.root}/{name}")

    def _forget(self, table: str) -> None:
        with contextlib.suppress(Exception):  # the session has ended, and its catalogue with it
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session has ended, and its files with it or later
            pass


def dense_names(scratch: Scratch, df: DataFrame, keys: Sequence[str], name: str, table: str) -> DataFrame:
    """Each distinct key tuple with its rank in sorted order as a gapless integer.

    A range-partitioned sort gives (partition, place); the only thing the driver sees is one count per
    partition, whose prefix sums turn those into ranks. The ranks do not depend on the partition bounds.
    """
    placed = scratch.save(
        df.select(*keys).distinct().repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id()),
        table,
    )
    part = F.shiftright("_place", 33)
    counts = sorted(placed.groupBy(part.alias("p")).count().collect())
    rows, at = [], 0
    for p, n in counts:
        rows.append((p, at))
        at += n
    offsets = df.sparkSession.createDataFrame(rows, "_part long, _first long")  # a row per partition
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .select(*keys, (F.col("_first") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))
    )


def crc_bucket(col: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def first_by_hash(df: DataFrame, hash_col: str, most: int, *then: str) -> DataFrame:
    """The most rows of df with the smallest unsigned hashes (all, if there are fewer), ordered by hash and then.

    A first cut at a hash that keeps about twice as many leaves few rows for each task to send to the driver; should it keep too
    few, all rows compete.
    """
    key = F.shiftrightunsigned(hash_col, 1)
    n = df.count()
    cut = df.where(key < int((1 << 63) * min(1.0, 2 * most / max(n, 1))) - 1) if n > 4 * most else df
    if n > 4 * most and cut.count() < most:
        cut = df
    return cut.orderBy(key, *then).limit(most)


def whole_row(docs: DataFrame) -> Column:
    """All columns of docs as one, so that their names can't clash with an operator's own; select("_all.*") gives them back."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_all")
