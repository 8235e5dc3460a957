"""Distances between sketches: one inner join on hash, one aggregate, one formula.

The union's moments follow from each sketch's totals and the shared hashes (sA + sB - max = min), so no outer
join is needed, sums are exact integers, and results do not depend on the order of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formula
from .sketch import Sketches, named

MOMENTS = ("inter", "uni", "sum_su", "sum_su2", "sum_si", "sum_si2")


#: Sketches that share a hash meet in parts of so many, and so do names of which all pairs are asked.
_PART = 2048


class MixedSketches(ValueError):
    """Sketches of different scales or seeds under strict=True."""


def _meta(side: str, meta: DataFrame) -> DataFrame:
    return meta.select(*(F.col(c).alias(f"{c}_{side}") for c in ("idx", "name", "k", "n", "sum_s", "sum_s2")))


def shared_moments(hashes: DataFrame) -> DataFrame:
    """(hi, lo, inter and sums of least and largest simplicities) of pairs of names, hi > lo, that share a hash.

    Names are ordered as such and not as inputs, so that hashes need no join with the names before they meet. A hash that very many
    sketches have is dealt out by parts of them, each of which meets all.
    """
    hashes = named(hashes).select("hash", "name", "s")
    common = hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > _PART).select("hash", F.ceil(F.col("c") / _PART).cast("int").alias("parts"))
    hashes = hashes.join(common, "hash", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    a = hashes.select("hash", F.pmod(F.xxhash64("name"), "parts").cast("int").alias("part"), F.col("name").alias("hi"), F.col("s").alias("s_a"))
    b = hashes.select("hash", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("name").alias("lo"), F.col("s").alias("s_b"))
    return _summed(a.join(b, ["hash", "part"]).where("hi > lo"))


def _summed(met: DataFrame, by: tuple[str, str] = ("hi", "lo")) -> DataFrame:
    """The sums over the hashes that two names share, of rows with both simplicities."""
    low, high = F.least("s_a", "s_b").cast("long"), F.greatest("s_a", "s_b").cast("long")
    return met.groupBy(*by).agg(
        F.count(F.lit(1)).alias("inter"), F.sum(low).alias("low"), F.sum(low * low).alias("low2"), F.sum(high).alias("sum_si"), F.sum(high * high).alias("sum_si2")
    )


def with_union(pairs: DataFrame) -> DataFrame:
    """MOMENTS of pairs (_meta columns of both sides and shared_moments' sums, null without a shared hash); none if their k differ."""
    same = (F.col("k_a") == F.col("k_b")) & (F.col("k_a") > 0)
    shared = {c: F.coalesce(c, F.lit(0)) for c in ("inter", "low", "low2", "sum_si", "sum_si2")}

    def of(c: Column) -> Column:
        return F.when(same, c).otherwise(F.lit(0)).cast("long")

    return pairs.select(
        "idx_a", "idx_b", "name_a", "name_b", F.col("k_a").alias("k"), same.alias("comparable"),
        of(shared["inter"]).alias("inter"), of(F.col("n_a") + F.col("n_b") - shared["inter"]).alias("uni"),
        of(F.col("sum_s_a") + F.col("sum_s_b") - shared["low"]).alias("sum_su"), of(F.col("sum_s2_a") + F.col("sum_s2_b") - shared["low2"]).alias("sum_su2"),
        of(shared["sum_si"]).alias("sum_si"), of(shared["sum_si2"]).alias("sum_si2"),
    )


def measured(moments: DataFrame, jukes_cantor: bool = False) -> DataFrame:
    """moments with jaccard, naive, homoplasy, distance, shared and total; without a shared hash the distance is 1."""
    inter, uni, su, su2, si, si2 = (F.col(c) for c in MOMENTS)
    k = F.col("k")
    some = (inter > 0) & (uni > 0)
    j = formula.jaccard(inter, uni)
    naive = F.when(some, formula.naive_distance(j, k)).otherwise(F.lit(1.0))
    x = F.when(some, formula.homoplasy(F.when(some, inter), F.when(some, uni), su, su2, si, si2, k)).otherwise(F.lit(0.0))
    d = F.when(some, formula.calibrated(F.col("naive"), F.col("homoplasy"), k, jukes_cantor)).otherwise(F.lit(1.0))
    return moments.select("*", j.alias("jaccard"), naive.alias("naive"), x.alias("homoplasy"), inter.alias("shared"), uni.alias("total")).withColumn("distance", d)


def _checked(sketches: Sketches, strict: bool) -> None:
    if strict and sketches.meta.select("threshold", "seed").distinct().count() > 1:
        raise MixedSketches("the sketches differ in scale or seed")


def grid(a: DataFrame, b: DataFrame, key_a: str, key_b: str, n: int, part: int = _PART) -> DataFrame:
    """Every row of a with every row of b, where both have the same n keys: keys are dealt to blocks, and pairs of blocks meet."""
    blocks = max(1, -(-n // part))

    def dealt(df: DataFrame, key: str, own: str) -> DataFrame:
        rows = df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return rows.select("*", F.greatest(own, "_other").alias("_i"), F.least(own, "_other").alias("_j")).drop("_other")

    met = dealt(a, key_a, "_of_a").join(dealt(b, key_b, "_of_b"), ["_i", "_j"])
    return met.where((F.greatest("_of_a", "_of_b") == F.col("_i")) & (F.least("_of_a", "_of_b") == F.col("_j"))).drop("_i", "_j", "_of_a", "_of_b")


def all_pairs(sketches: Sketches, strict: bool = False) -> DataFrame:
    """Moments of every pair with a.idx > b.idx, also of pairs that share nothing. Its size is the square of the number of names; linked_pairs grows
    with what is shared."""
    _checked(sketches, strict)
    pairs = grid(_meta("a", sketches.meta), _meta("b", sketches.meta), "name_a", "name_b", sketches.meta.count()).where("idx_a > idx_b")
    pairs = pairs.withColumns({"hi": F.greatest("name_a", "name_b"), "lo": F.least("name_a", "name_b")})
    return with_union(pairs.join(shared_moments(sketches.hashes), ["hi", "lo"], "left"))


def linked_pairs(sketches: Sketches, strict: bool = False) -> DataFrame:
    """Moments of the pairs with a.idx > b.idx that share a hash; grows with what is shared, not with the square of the names."""
    _checked(sketches, strict)
    return _sided(shared_moments(sketches.hashes), sketches.meta)


def _sided(found: DataFrame, meta: DataFrame) -> DataFrame:
    """Moments of shared_moments' rows, the later input being a."""
    names = [f.name for f in meta.schema if f.name in ("idx", "name", "k", "n", "sum_s", "sum_s2")]
    meta = meta.select("name", F.struct(*names).alias("m"))
    found = found.join(meta.select(F.col("name").alias("hi"), F.col("m").alias("x")), "hi").join(meta.select(F.col("name").alias("lo"), F.col("m").alias("y")), "lo")
    first = F.col("x.idx") > F.col("y.idx")
    sides = found.select("*", F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"))
    return with_union(sides.select("inter", "low", "low2", "sum_si", "sum_si2", *(F.col(f"{side}.{c}").alias(f"{c}_{side}") for side in "ab" for c in names)))


def least_jaccard(limit: float, k: Column) -> Column:
    """What the Jaccard index must exceed for a distance below limit. Homoplasy and Jukes-Cantor only raise the naive distance 1 - (2j / (1 + j))^(1 / k)."""
    q = F.pow(F.lit(1.0 - limit), k.cast("double"))
    return q / (2 - q)


def near_candidates(sketches: Sketches, limit: float) -> DataFrame:
    """(hi, lo) of names, hi > lo: all pairs whose distance may be below limit, and as few others as sizes and rare hashes can tell.

    A pair of such a distance shares more than a share j of the larger sketch, j being least_jaccard. So of a sketch with n hashes any n - floor(j n) have one that the
    other has, and has among as many of its own, if all leave out those that most sketches have. The hashes that make the most pairs are so the ones that
    make no candidate. A rounding error is left to the safe side.
    """
    hashes = named(sketches.hashes).select("hash", "name")
    spread = hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("_c"))
    sizes = sketches.meta.select("name", "n", (least_jaccard(limit, F.col("k")) * (1 - 1e-9)).alias("_j"))
    common = Window.partitionBy("name").orderBy(F.desc("_c"), "hash")
    ranked = hashes.join(spread, "hash").join(sizes, "name").withColumn("_place", F.row_number().over(common)).where(F.col("_place") > F.floor(F.col("_j") * F.col("n")))
    ranked = ranked.select("hash", "name", "n", "_j", F.ceil(F.col("_c") / _PART).cast("int").alias("parts"))
    a = ranked.select("hash", F.pmod(F.xxhash64("name"), "parts").cast("int").alias("part"), F.col("name").alias("hi"), F.col("n").alias("n_a"), F.col("_j").alias("j_a"))
    b = ranked.select("hash", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("name").alias("lo"), F.col("n").alias("n_b"), F.col("_j").alias("j_b"))
    sized = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.least("j_a", "j_b")
    return a.join(b, ["hash", "part"]).where((F.col("hi") > F.col("lo")) & sized).select("hi", "lo").distinct()


def near_pairs(sketches: Sketches, limit: float, jukes_cantor: bool = False, strict: bool = False) -> DataFrame:
    """The measured pairs, as linked_pairs gives them, whose distance is below limit (up to 1). Only candidates' hashes meet, so a small limit costs
    little even where nearly all sketches share something."""
    if not 0 < limit <= 1:
        raise ValueError(f"a limit must be above 0 and at most 1, not {limit}")
    _checked(sketches, strict)
    hashes = named(sketches.hashes).select("name", "hash", "s")
    first = near_candidates(sketches, limit).join(hashes.select(F.col("name").alias("hi"), "hash", F.col("s").alias("s_a")), "hi")
    met = first.join(hashes.select(F.col("name").alias("lo"), "hash", F.col("s").alias("s_b")), ["lo", "hash"])
    return measured(_sided(_summed(met), sketches.meta), jukes_cantor).where(F.col("distance") < limit)


def pairs_between(left: Sketches, right: Sketches) -> DataFrame:
    """Moments of the pairs (a of left, b of right) that share a hash, whatever their places among inputs.

    Hashes meet by hash alone: where both sides are stores of as many buckets, nothing is moved before they have met.
    """
    a = named(left.hashes).select("hash", F.col("name").alias("name_a"), F.col("s").alias("s_a"))
    b = named(right.hashes).select("hash", F.col("name").alias("name_b"), F.col("s").alias("s_b"))
    found = _summed(a.join(b, "hash"), ("name_a", "name_b"))
    return with_union(found.join(_meta("a", left.meta), "name_a").join(_meta("b", right.meta), "name_b"))


def triangle(sketches: Sketches, jukes_cantor: bool = False, strict: bool = False) -> DataFrame:
    """(i, j, a, b, distance, jaccard, shared, total) for all j before i in the order of input."""
    return measured(all_pairs(sketches, strict), jukes_cantor).select(
        F.col("idx_a").alias("i"), F.col("idx_b").alias("j"), F.col("name_a").alias("a"), F.col("name_b").alias("b"), "distance", "jaccard", "shared", "total"
    )


def first_inputs(sketches: Sketches, n: int) -> Sketches:
    """The first n sketches in the order of input."""
    meta = sketches.meta.orderBy("idx").limit(n)
    return Sketches(sketches.hashes.join(meta.select("name"), "name", "left_semi"), meta)


def _reported(sketches: Sketches, n: int, jukes_cantor: bool, strict: bool) -> DataFrame:
    """Pairs of the first n inputs, the earlier one as reference."""
    found = triangle(first_inputs(sketches, n), jukes_cantor, strict)
    return found.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("b").alias("reference"), F.col("a").alias("query"), "shared", "total", "jaccard", "distance")


def dist(sketches: Sketches, jukes_cantor: bool = False, strict: bool = False) -> DataFrame:
    """The pair of the first two inputs; more are ignored."""
    return _reported(sketches, 2, jukes_cantor, strict)


def three(sketches: Sketches, jukes_cantor: bool = False, strict: bool = False) -> DataFrame:
    """The three pairs of the first three inputs, by one join and one aggregate. If their k differ, none is comparable."""
    few = first_inputs(sketches, 3)
    found = _reported(few, 3, jukes_cantor, strict)
    ks = few.meta.agg(F.countDistinct("k").alias("ks"))
    mixed = F.col("ks") > 1
    return found.crossJoin(F.broadcast(ks)).select(
        "i", "j", "reference", "query", F.when(mixed, F.lit(0)).otherwise(F.col("shared")).cast("long").alias("shared"), F.when(mixed, F.lit(0)).otherwise(F.col("total")).cast("long").alias("total"),
        F.when(mixed, F.lit(0.0)).otherwise(F.col("jaccard")).alias("jaccard"), F.when(mixed, F.lit(1.0)).otherwise(F.col("distance")).alias("distance"),
    )
