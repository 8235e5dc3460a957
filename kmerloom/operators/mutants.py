"""Simulated mutants: a fixed share of positions changed, chosen and changed by hashes, so that every run agrees."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: A record becomes bases in pieces of so many.
_PIECE = 1 << 16


def mutate(records: DataFrame, rate: float, seed: int = 42, indels: bool = True, name_col: str = "name", seq_col: str = "seq", block: int = 4096) -> DataFrame:
    """(name, seq, n_changed, true_d): floor(length * rate) distinct positions of each sequence changed.

    A changed base becomes one of the three others nine times of ten, and else a random base comes before it or it goes,
    evenly; without indels always another base. Positions are those with the smallest digests of (name, position, seed); choices come
    from later digits of the same digest. Letters other than ACGT become A, C, G or T when changed. Bases are ranked within
    buckets of digests, and counts per bucket say which buckets are in, so a long sequence spreads over tasks until it is put together again.
    """
    base = records.select(F.col(name_col).alias("name"), F.translate(seq_col, string.ascii_lowercase, string.ascii_uppercase).alias("seq"))  # ASCII alone, so that no letter becomes two
    pieces = base.select("name", F.length("seq").alias("n"), "seq", F.explode(F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(_PIECE))).alias("first"))
    pieces = pieces.select("name", "n", "first", F.substring("seq", F.col("first") + 1, F.lit(_PIECE)).alias("seq"))
    dealt = pieces.repartition(F.xxhash64("name", "first"))  # a record's pieces become bases in many tasks
    each = dealt.select("name", "n", "first", F.posexplode(F.filter(F.split("seq", ""), lambda c: c != "")).alias("pos", "base")).withColumn("pos", F.col("pos") + F.col("first")).drop("first")
    each = each.withColumn("digest", F.md5(F.concat_ws(":", "name", "pos", F.lit(seed)).cast("binary"))).withColumn("bucket", F.substring("digest", 1, 3))
    sums = each.groupBy("name", "n", "bucket").agg(F.count(F.lit(1)).alias("c"))  # at most 4096 buckets a name
    before = F.coalesce(F.sum("c").over(Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = sums.select("name", "bucket", (F.floor(F.col("n") * F.lit(rate)) - before).alias("room"))
    place = F.row_number().over(Window.partitionBy("name", "bucket").orderBy("digest", "pos"))

    def draw(first: int, n: int) -> Column:
        return (F.conv(F.substring("digest", first, 8), 16, 10).cast("long") % n).cast("int")

    letters = F.array(*map(F.lit, "ACGT"))
    other = F.element_at(F.array_except(letters, F.array("base")), draw(25, 3) + 1)
    extra = F.element_at(letters, draw(9, 4) + 1)
    kind = draw(17, 20) if indels else F.lit(0)
    changed = F.when(kind < 18, other).when(kind == 18, F.concat(extra, F.col("base"))).otherwise(F.lit(""))
    ranked = each.withColumn("place", place).join(room, ["name", "bucket"])
    written = ranked.withColumn("chosen", F.col("place") <= F.col("room")).withColumn("out", F.when(F.col("chosen"), changed).otherwise(F.col("base")))
    blocks = written.groupBy("name", "n", F.floor(F.col("pos") / block).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "out"))), lambda x: x["out"]), "").alias("part"), F.sum(F.col("chosen").cast("long")).alias("c")
    )
    whole = blocks.groupBy("name", "n").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda x: x["part"]), "").alias("seq"), F.sum("c").alias("n_changed")
    )
    return whole.select("name", "seq", "n_changed", (F.col("n_changed") / F.col("n")).alias("true_d"))


def replicas(records: DataFrame, n: int, name_col: str = "name") -> DataFrame:
    """Each record n times, named <name>_0 to <name>_<n - 1>."""
    copies = records.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return copies.withColumn(name_col, F.concat_ws("_", F.col(name_col).cast("string"), F.col("_i").cast("string"))).drop("_i")
