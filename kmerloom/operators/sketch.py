"""Sketches: distinct kept hashes with their least simplicity, per sequence file or pool."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.params import SketchParams, seed_of
from ..sources.shared import saved
from .kmers import BATCH_BASES, kmers, row_sketches
from .prefilter import likely


@dataclass(frozen=True)
class Sketches:
    """hashes: (name, hash, s), unique by name and hash. meta: (idx, name, k, scale, threshold, seed, n, sum_s, sum_s2), a row per name,
    also for names without a hash; idx is the place in the order of input."""

    hashes: DataFrame
    meta: DataFrame


def distinct_hashes(found: DataFrame, min_count: int = 0) -> DataFrame:
    """Each (name, hash) once, with its least s; with min_count over 1 only those that occur so often."""
    if min_count > 1:
        counted = found.groupBy("name", "hash").agg(F.min("s").alias("s"), F.count(F.lit(1)).alias("n"))
        return counted.where(F.col("n") >= min_count).select("name", "hash", "s")
    return found.groupBy("name", "hash").agg(F.min("s").alias("s"))


def named(hashes: DataFrame) -> DataFrame:
    """The rows that can meet in joins. Every user of hashes asks for the same rows, so that one plan computes them once."""
    return hashes.where(F.col("name").isNotNull() & F.col("hash").isNotNull())


def totals(names: DataFrame, hashes: DataFrame, params: SketchParams) -> DataFrame:
    """The meta table of names (idx, name)."""
    s = F.col("s").cast("long")
    sums = named(hashes).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum(s).alias("sum_s"), F.sum(s * s).alias("sum_s2"))
    kept = names.join(sums, "name", "left")
    fixed = [
        F.lit(params.k).alias("k"), F.lit(str(params.scale)).alias("scale"),
        F.lit(str(params.threshold)).cast("decimal(20,0)").alias("threshold"), F.lit(str(seed_of(params.seed))).cast("decimal(20,0)").alias("seed"),
    ]
    return kept.select("idx", "name", *fixed, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "sum_s", "sum_s2")))


def sketch(
    seqs: DataFrame, params: SketchParams = SketchParams(), name_col: str = "name", seq_col: str = "seq", names: DataFrame | None = None, prefilter: int | None = None, keep: bool = False,
) -> Sketches:
    """One sketch per name. names: (idx, name) of all inputs; by default the names in seqs, in their own order.

    prefilter: under a least count, the bytes of a count-min sketch that keeps most hashes below it out of the shuffle; the result is the same. It costs
    a second reading of the kept hashes, and pays where many occur once, as in reads. keep: the hashes are written to the shared folder, for several jobs.
    """
    found = kmers(seqs, params, name_col, seq_col)
    hashes = distinct_hashes(likely(found, params.min_count, prefilter) if prefilter else found, params.min_count)
    if keep:
        hashes = saved(hashes, "sketch")
    if names is None:
        names = seqs.select(F.col(name_col).alias("name")).distinct().select(F.col("name").alias("idx"), "name")
    return Sketches(hashes, totals(names, hashes, params))


def pooled_sketch(seqs: DataFrame, params: SketchParams, pool: str = "pool", seq_col: str = "seq") -> Sketches:
    """All sequences as one sketch of the name pool; min_count counts over all of them."""
    return sketch(seqs.select(F.lit(pool).alias("name"), seq_col), params, "name", seq_col)


def nested(sketches: Sketches) -> DataFrame:
    """(name, k, threshold, hashes, simplicities): a row per sketch, hashes in unsigned order."""
    flipped = F.struct(F.col("hash").bitwiseXOR(F.lit(-(1 << 63))).alias("o"), "hash", "s")
    rows = sketches.hashes.groupBy("name").agg(F.array_sort(F.collect_list(flipped)).alias("p"))
    empty = F.array().cast("array<bigint>")
    return sketches.meta.join(rows, "name", "left").select(
        "name", "k", "threshold", F.coalesce("p.hash", empty).alias("hashes"), F.coalesce("p.s", F.array().cast("array<int>")).alias("simplicities")
    )


def by_name(sketches: Sketches) -> DataFrame:
    """(idx, name, k, n, sum_s, sum_s2, hashes, simplicities): a row per sketch, hashes in signed order."""
    rows = named(sketches.hashes).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("hash", "s"))).alias("p"))
    lists = (F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(x) for c, kind, x in (("p.hash", "bigint", "hashes"), ("p.s", "int", "simplicities")))
    return sketches.meta.join(rows, "name", "left").select("idx", "name", "k", "n", "sum_s", "sum_s2", *lists)


def sketch_rows(rows: DataFrame, params: SketchParams = SketchParams(), longest: int = BATCH_BASES) -> DataFrame:
    """by_name() of the sketches of (idx, name, seq), without a shuffle of what is found: a row's sketch is made where the row is read.

    Rows of more than longest bytes are cut and shuffled as ever; so are all rows if a name is null or has several of them, or under a least count.
    """

    def shuffled(some: DataFrame) -> DataFrame:
        return by_name(sketch(some, params, names=some.select("idx", "name")))

    if params.min_count > 1 or not rows.groupBy("name").count().where("count > 1 or name is null").isEmpty():
        return shuffled(rows)
    long = F.coalesce(F.octet_length(F.col("seq")), F.lit(0)) > longest
    short = row_sketches(rows.where(~long), params).select("idx", "name", F.lit(params.k).alias("k"), "n", "sum_s", "sum_s2", "hashes", "simplicities")
    return short.unionByName(shuffled(rows.where(long)))
